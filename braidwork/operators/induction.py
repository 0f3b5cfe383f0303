"""Further ways to classes: Ward's linkage with a hierarchy, splits of incoherent classes, siblings, labels, header groups."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..models import LLMClient, ask
from ..session import bounded_rows, materialize
from .chunking import sliding_windows
from .clustering import LINKAGE_POINTS, cluster_parents, communities, labels_at, linkage_cut, silhouette
from .extraction import extract
from .fileclasses import bridge_columns, function_groups, functional_classes, prefix_groups, ungrouped
from .metrics import best_centroid
from .model_steps import HEADERS, MAX_NAMES, ask_per_item, expand_headers
from .resolution import components

#: Numbers of clusters tried, score below which a class is split, rounds of splitting, cosine at which siblings merge.
K_FROM, K_TO, COHERENT, ROUNDS, SIBLINGS = 5, 40, 3, 2, 0.95
#: Resolutions of communities from coarse to fine.
RESOLUTIONS = (0.3, 0.6, 1.2)


def ward_classes(vectors: DataFrame, k_from: int = K_FROM, k_to: int = K_TO, points: int = LINKAGE_POINTS) -> tuple[DataFrame, DataFrame]:
    """((entity, class_of, sim), (child, parent)) of vectors (id, v of length one) by Ward's linkage.

    The linkage is computed on about ``points`` vectors picked by a hash of the id; the number of clusters between
    ``k_from`` and ``k_to`` with the best silhouette is taken, clusters of one are dropped, and every vector joins the
    nearest centre. Half as many clusters of the same linkage give the hierarchy: of the classes in one of them the largest,
    then first, is the parent. Fewer than three vectors give no class.
    """
    spark, n = vectors.sparkSession, vectors.count()
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(min(1.0, points / max(n, 1)) * (1 << 30)))
    rows = sorted(bounded_rows(picked.select("id", "v"), 2 * points, "linkage sample"), key=lambda r: r["id"])
    names, centres, parents = [], [], []
    if len(rows) > 2:
        x = np.array([r["v"] for r in rows], dtype=np.float64)
        merges = linkage_cut(x, "ward")
        tried = [(silhouette(x, labels_at(merges, len(x), k)), -k) for k in range(min(k_from, len(x) - 1), min(k_to, len(x) - 1) + 1)]
        k = -max(tried)[1]
        fine, coarse = labels_at(merges, len(x), k), labels_at(merges, len(x), max(1, k // 2))
        size = np.bincount(fine)
        within = defaultdict(list)
        for c in np.flatnonzero(size > 1):
            mean = x[fine == c].mean(axis=0)
            names.append(f"class {c}")
            centres.append((mean / max(np.linalg.norm(mean), 1e-12)).tolist())
            within[coarse[fine == c][0]].append((-size[c], f"class {c}"))
        for group in within.values():
            head, *rest = sorted(group)
            parents += [(name, head[1]) for _, name in rest]
    classes = spark.createDataFrame(list(zip(names, centres)), "class_of string, v array<double>")
    return best_centroid(vectors, classes), spark.createDataFrame(sorted(parents), "child string, parent string")


def split_incoherent(assignments: DataFrame, edges: DataFrame, client: LLMClient, least: int = COHERENT, examples: int = 10) -> DataFrame:
    """Assignments (entity_id, class) whose classes the model scores below ``least`` of 5 are split by a relation.

    The relation is the outgoing one that nearest to half of the members have, ties to the first name; members that have it
    become "class with relation". Other is not scored; an answer that is no number keeps the class.
    """
    a = assignments.where("class <> 'Other'")
    few = a.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("entity_id"))).where(F.col("r") <= examples)
    shown = few.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ", ").alias("m"))
    said = ask(shown.select(F.col("class").alias("key"), F.concat(F.lit("Score from 1 to 5 how well these belong together.\nClass "), "class", F.lit(": "), "m").alias("prompt")), client)
    weak = said.where(F.trim("answer").try_cast("int") < least).select(F.col("key").alias("class"))
    members = a.join(weak, "class")
    held = edges.select(F.col("src").alias("entity_id"), "rel").where("rel is not null").distinct().join(members, "entity_id")
    counts = held.groupBy("class", "rel").agg(F.count(F.lit(1)).alias("k")).join(members.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class").where("k < n")
    by = counts.groupBy("class").agg(F.min(F.struct(F.abs(F.col("k") * 2 - F.col("n")).alias("off"), "rel"))["rel"].alias("rel"))
    new = held.join(by, ["class", "rel"]).select("entity_id", F.concat("class", F.lit(" with "), "rel").alias("_new"))
    return assignments.join(new, "entity_id", "left").select("entity_id", F.coalesce("_new", "class").alias("class"))


def refine(assignments: DataFrame, edges: DataFrame, client: LLMClient, rounds: int = ROUNDS) -> DataFrame:
    """:func:`split_incoherent` up to ``rounds`` times."""
    for _ in range(rounds):
        assignments = split_incoherent(assignments, edges, client)
    return assignments


def merge_siblings(centres: DataFrame, least: float = SIBLINGS) -> DataFrame:
    """(child, merged_into) of classes (parent, child, v of length one) under one parent whose centres are alike.

    Chains of alike siblings become one, by the first name. Siblings meet by equality on their parent.
    """
    a, b = centres.select("parent", F.col("child").alias("a"), F.col("v").alias("x")), centres.select("parent", F.col("child").alias("b"), F.col("v").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    near = a.join(b, "parent").where((F.col("a") < F.col("b")) & (dot >= least)).select("a", "b")
    return components(near).where("id <> component").select(F.col("id").alias("child"), F.col("component").alias("merged_into"))


def community_levels(edges: DataFrame, resolutions: tuple[float, ...] = RESOLUTIONS) -> tuple[DataFrame, DataFrame]:
    """((id, level, community), (child, parent, overlap)): communities at each resolution, and the coarser one above each."""
    edges = materialize(edges, "level-edges")
    found = [communities(edges, r).select("id", F.lit(i).alias("level"), F.concat(F.lit(f"{i}:"), F.col("community").cast("string")).alias("community")) for i, r in enumerate(resolutions)]
    out, links = found[0], None
    for coarse, fine in zip(found, found[1:]):
        out = out.unionByName(fine)
        up = cluster_parents(fine.select(F.col("community").alias("cluster"), F.col("id").alias("member")), coarse.select(F.col("community").alias("cluster"), F.col("id").alias("member")))
        links = up if links is None else links.unionByName(up)
    return out, links


def induced_labels(entities: DataFrame, classes: list[str], client: LLMClient) -> DataFrame:
    """(id, labels): the label of each entity (id, entity_type) and the class that one answer over all labels gives it."""
    labels = entities.select(F.col("entity_type").alias("item")).where("item is not null").distinct()
    said = ask_per_item(labels, client, f"Give each label one of these classes: {', '.join(classes)}.", MAX_NAMES)
    known = said.where(F.col("answer").isin(*classes)).select(F.col("item").alias("entity_type"), "answer")
    return entities.join(known, "entity_type", "left").select("id", F.array_compact(F.array("entity_type", "answer")).alias("labels"))


def baseline_triples(texts: DataFrame, client: LLMClient) -> DataFrame:
    """Triples of texts (source, text) through a model without a vocabulary, over windows of words."""
    windows = sliding_windows(texts)
    chunks = windows.select(F.concat_ws("/", F.col("source").cast("string"), F.col("window_no").cast("string")).alias("chunk_id"), F.col("source").cast("string").alias("source"), "content")
    return extract(chunks, client, [])


def grouped_headers(headers: DataFrame, client: LLMClient, none: str = "none") -> DataFrame:
    """(class, header): the group that the model names for headers that no prefix groups, HEADERS at a time."""
    said = ask_per_item(headers.select(F.col("header").alias("item")), client, f"Name the group of each column, or {none}.", HEADERS)
    return said.where((F.trim("answer") != "") & (F.trim("answer") != none)).select(F.trim("answer").alias("class"), F.col("item").alias("header"))


def header_classes(headers: DataFrame, client: LLMClient) -> DataFrame:
    """(class, header): headers by their prefix group, the rest by the group that the model names."""
    prefixes = prefix_groups(headers)
    return prefixes.select(F.col("prefix").alias("class"), "header").unionByName(grouped_headers(ungrouped(headers, prefixes), client))


def file_classes(headers: DataFrame, file_tokens: DataFrame, client: LLMClient) -> dict[str, DataFrame]:
    """Classes of files (file, header) in four phases: names, classes, functions and bridges.

    names: (header, name). classes: (class, header) by prefixes and, for the rest, by the model. functions: (group, file,
    header, shared) over files with one function. bridges: (source_class, target_class, bridge_column) between groups.
    """
    functions = functional_classes(headers, function_groups(headers, file_tokens))
    bridges = bridge_columns(functions.select(F.col("group").alias("class"), "header").distinct())
    return {"names": expand_headers(headers, client), "classes": header_classes(headers, client), "functions": functions, "bridges": bridges}
