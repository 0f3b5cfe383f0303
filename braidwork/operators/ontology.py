"""Classes over entities: evidence, structural checks, value typing, hierarchy, associations, provenance.

``assignments`` has entity_id and class with Other as the null class; ``entities`` has id, entity_type, lane; ``edges`` has
src, rel, dst. Vocabularies of classes and relations are small; entities and edges are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import contains_any
from ..session import bounded_rows

#: Spread from which members are flagged and its floor, smallest class, depth of the hierarchy.
SIGMA, SPREAD_FLOOR, SMALL_CLASS, MAX_DEPTH = 2.0, 0.05, 10, 4
#: Relations that define no class, and shares for subsumption.
GENERIC = ("HAS_VALUE", "HAS_NAME", "HAS_DATE", "HAS_TYPE", "HAS_ID", "IS_A", "~IS_A", "~HAS_VALUE", "~HAS_NAME", "~HAS_DATE")
DEFINING, INCLUSION, EXCLUSIVE = 0.3, 0.80, 0.5
#: Words of relations that point to places and to money.
PLACES = ("state", "city", "zip", "address", "county", "location", "community")
MONEY = ("amount", "cost", "payment", "premium", "fee", "price", "value", "coverage")
#: Class edges that the driver handles where they are not grouped by keys.
MAX_CLASSES = 10_000


def record_evidence(entities: DataFrame, edges: DataFrame, top: int = 4) -> DataFrame:
    """(prefix, n, relation, members, rank): records by id prefix with their ``top`` relations other than IS_A by members."""
    records = entities.where("lane = 'record'").select("id", F.concat(F.split("id", "-")[0], F.lit("-")).alias("prefix"))
    sizes = records.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    uses = edges.where("rel <> 'IS_A'").select(F.col("src").alias("id"), F.col("rel").alias("relation")).distinct().join(records, "id").groupBy("prefix", "relation").agg(F.count(F.lit(1)).alias("members"))
    ranked = uses.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("members"), "relation"))).where(F.col("rank") <= top)
    return sizes.join(ranked, "prefix")


def value_evidence(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: places, money: value entities that a geographic or financial relation points to."""
    rel = F.replace(F.lower("rel"), F.lit("_"), F.lit(" "))
    hits = edges.select(F.col("dst").alias("id"), contains_any(rel, PLACES).alias("p"), contains_any(rel, MONEY).alias("m")).where("p or m").groupBy("id").agg(F.max("p").alias("p"), F.max("m").alias("m"))
    return entities.where("lane = 'value'").join(hits, "id").agg(F.count(F.when(F.col("p"), 1)).alias("places"), F.count(F.when(F.col("m"), 1)).alias("money"))


def signatures(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, feature, value): counts of outgoing and incoming relations and the type, scaled to length one per entity."""
    out = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.concat("rel", F.lit("_OUT")).alias("feature")), F.struct(F.col("dst").alias("id"), F.concat("rel", F.lit("_IN")).alias("feature")))).alias("e")).select("e.*")
    counts = out.groupBy("id", "feature").agg(F.count(F.lit(1)).cast("double").alias("x")).join(entities.select("id"), "id", "left_semi")
    types = entities.select("id", F.concat(F.lit("type_"), F.coalesce("entity_type", F.lit("Unknown"))).alias("feature"), F.lit(1.0).alias("x"))
    rows = counts.unionByName(types)
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return rows.join(norms, "id").select("id", "feature", (F.col("x") / F.col("norm")).alias("value"))


def centroids(features: DataFrame, assignments: DataFrame) -> DataFrame:
    """(class, feature, weight, n): mean of the members' signatures scaled to length one. Other has none."""
    rows = features.join(assignments.where("class <> 'Other'").select(F.col("entity_id").alias("id"), "class"), "id")
    sums = rows.groupBy("class", "feature").agg(F.sum("value").alias("s"))
    norms = sums.groupBy("class").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    sizes = rows.select("class", "id").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(norms, "class").join(sizes, "class").select("class", "feature", (F.col("s") / F.col("norm")).alias("weight"), "n")


def class_similarity(features: DataFrame, cents: DataFrame) -> DataFrame:
    """(id, class, sim) of each entity with each class it shares a feature with."""
    return features.join(cents.select("class", "feature", "weight"), "feature").groupBy("id", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("sim"))


def structural_outliers(features: DataFrame, assignments: DataFrame) -> DataFrame:
    """(entity_id, class, sim, class_mean, class_std, nearest_class, nearest_sim) of members far from their class.

    Flagged below mean - SIGMA * max(population deviation, SPREAD_FLOOR). Without another class the nearest one is null.
    """
    sims = class_similarity(features, centroids(features, assignments))
    own = sims.join(assignments.where("class <> 'Other'").select(F.col("entity_id").alias("id"), "class"), ["id", "class"])
    stats = own.groupBy("class").agg(F.avg("sim").alias("class_mean"), F.stddev_pop("sim").alias("class_std"))
    flagged = own.join(stats, "class").where(F.col("sim") < F.col("class_mean") - SIGMA * F.greatest("class_std", F.lit(SPREAD_FLOOR)))
    other = sims.join(flagged.select("id", F.col("class").alias("own")), "id").where(F.col("class") != F.col("own")).groupBy("id").agg(F.min(F.struct((-F.round("sim", 9)).alias("neg"), "class", "sim")).alias("x")).select("id", F.col("x.class").alias("nearest_class"), F.col("x.sim").alias("nearest_sim"))
    return flagged.join(other, "id", "left").select(F.col("id").alias("entity_id"), "class", "sim", "class_mean", "class_std", "nearest_class", "nearest_sim")


def merge_small_classes(features: DataFrame, assignments: DataFrame, least: int = SMALL_CLASS, protected: Iterable[str] = ()) -> DataFrame:
    """(class, merged_into) of classes with fewer than ``least`` members: the large class with the most similar centroid."""
    sizes = assignments.where("class <> 'Other'").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where((F.col("n") < least) & ~F.lower("class").isin(*protected, "")).select("class")
    cents = centroids(features, assignments)
    a = cents.join(small, "class", "left_semi").select(F.col("class").alias("s"), "feature", F.col("weight").alias("w"))
    b = cents.join(small, "class", "left_anti")
    sims = a.join(b, "feature").groupBy("s", "class").agg(F.sum(F.col("w") * F.col("weight")).alias("sim"))
    return sims.groupBy("s").agg(F.min(F.struct((-F.round("sim", 9)).alias("neg"), "class"))["class"].alias("merged_into")).select(F.col("s").alias("class"), "merged_into")


def relation_classes(edges: DataFrame, assignments: DataFrame, entities: DataFrame, confidence: float = 0.5) -> DataFrame:
    """(signal, relation, class, confidence): the dominant class of a relation's targets (A) and of its sources to values (B).

    A relation needs two counted edges. Ties go to the class first in order of name.
    """
    a = assignments.select("entity_id", "class").where("class <> 'Other'")
    target = edges.join(a.select(F.col("entity_id").alias("dst"), "class"), "dst").select(F.lit("A").alias("signal"), F.col("rel").alias("relation"), "class")
    values = entities.where("lane = 'value'").select(F.col("id").alias("dst"))
    source = edges.join(values, "dst", "left_semi").join(a.select(F.col("entity_id").alias("src"), "class"), "src").select(F.lit("B").alias("signal"), F.col("rel").alias("relation"), "class")
    counts = target.unionByName(source).groupBy("signal", "relation", "class").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("signal", "relation").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), "class", "n")).alias("x"))
    share = F.col("x.n") / F.col("total")
    return best.where((F.col("total") >= 2) & (share >= confidence)).select("signal", "relation", F.col("x.class").alias("class"), share.alias("confidence"))


def type_values(edges: DataFrame, assignments: DataFrame, entities: DataFrame, confidence: float = 0.5) -> DataFrame:
    """(entity_id, class, signal) of value entities in Other that their incoming relations give a class.

    Evidence is the count of edges times the relation's confidence; signal A goes first, B where A says nothing. The best
    class needs a share of ``confidence``.
    """
    known = relation_classes(edges, assignments, entities, confidence)
    open_ = entities.where("lane = 'value'").select(F.col("id").alias("entity_id")).join(assignments.where("class <> 'Other'").select("entity_id"), "entity_id", "left_anti")
    counts = edges.groupBy(F.col("dst").alias("entity_id"), F.col("rel").alias("relation")).agg(F.count(F.lit(1)).alias("n")).join(open_, "entity_id", "left_semi")
    score = counts.join(known, "relation").groupBy("entity_id", "signal", "class").agg(F.sum(F.col("n") * F.col("confidence")).alias("e"))
    first = score.groupBy("entity_id").agg(F.min("signal").alias("signal"))
    best = score.join(first, ["entity_id", "signal"]).groupBy("entity_id", "signal").agg(F.sum("e").alias("total"), F.min(F.struct((-F.round("e", 9)).alias("neg"), "class", "e")).alias("x"))
    return best.where(F.col("x.e") / F.col("total") >= confidence).select("entity_id", F.col("x.class").alias("class"), "signal")


def remaps(before: DataFrame, after: DataFrame) -> DataFrame:
    """(class, new_class) of classes whose changed members all went to one other class."""
    moved = before.join(after.select("entity_id", F.col("class").alias("new")), "entity_id").where("class <> new and class <> 'Other'").select("class", "new").distinct()
    return moved.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("new").alias("new_class")).where("n = 1").select("class", "new_class")


def defining_relations(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """(class, relation) with at least max(2, 30 % of the members) edges; incoming ones are marked "~"."""
    a = assignments.where("class <> 'Other'").select("entity_id", "class")
    sizes = a.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("entity_id"), F.col("rel").alias("relation")), F.struct(F.col("dst").alias("entity_id"), F.concat(F.lit("~"), "rel").alias("relation")))).alias("e")).select("e.*")
    counts = ends.join(a, "entity_id").groupBy("class", "relation").agg(F.count(F.lit(1)).alias("k")).join(sizes, "class")
    return counts.where((F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") * DEFINING))) & ~F.col("relation").isin(*GENERIC)).select("class", "relation")


def subsumption_candidates(defining: DataFrame) -> DataFrame:
    """(child, parent, inclusion): the child has fewer defining relations, of which the parent has at least 80 %."""
    sizes = defining.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    d = defining.join(sizes, "class")
    c, p = d.select(F.col("class").alias("child"), "relation", F.col("n").alias("nc")), d.select(F.col("class").alias("parent"), "relation", F.col("n").alias("np"))
    both = c.join(p, "relation").where("child <> parent and nc < np").groupBy("child", "parent", "nc").agg(F.count(F.lit(1)).alias("k"))
    inclusion = F.col("k") / F.col("nc")
    return both.where((inclusion >= INCLUSION) & (1 - inclusion <= EXCLUSIVE)).select("child", "parent", inclusion.alias("inclusion"))


def consensus(votes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(child, parent, trusted, weak) of edges (child, parent, source, trusted) with a trusted source or two weak ones.

    With ``keys``, such as run_id, each of their groups votes apart, and the keys come first in the result.
    """
    per = votes.where("child <> parent").groupBy(*keys, "child", "parent").agg(F.max(F.coalesce("trusted", F.lit(False))).alias("trusted"), F.count_distinct(F.when(~F.coalesce("trusted", F.lit(False)), F.coalesce("source", F.lit("none")))).alias("weak"))
    return per.where("trusted or weak >= 2")


def tree_of(rows: Iterable[tuple[bool, int, str, str]], max_depth: int = MAX_DEPTH) -> list[tuple[str, str]]:
    """(child, parent) of a forest from (trusted, weak, child, parent), in order of trust, votes and names."""
    parent: dict[str, str] = {}

    def above(x: str) -> list[str]:
        out = []
        while x in parent:
            x = parent[x]
            out.append(x)
        return out

    kept = []
    for _, _, child, par in sorted((not t, -w, c, p) for t, w, c, p in rows):
        up = [par, *above(par)]
        if child not in up and len(up) <= max_depth and child not in parent:
            parent[child] = par
            kept.append((child, par))
    return kept


def acyclic_of(rows: Iterable[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """(child, parent) from (seq, child, parent) kept in order of seq unless the parent already reaches the child."""
    up: dict[str, set[str]] = {}
    kept = []
    for _, child, par in sorted(rows):
        seen, stack = set(), [par]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(up.get(x, ()))
        if child not in seen:
            up.setdefault(child, set()).add(par)
            kept.append((child, par))
    return kept


def _in_order(edges: DataFrame, columns: list[str], keys: tuple[str, ...], keep: Callable[[list[tuple]], list[tuple[str, str]]]) -> DataFrame:
    """``keep`` over all edges on the driver, whose number is checked, or over those of each group of ``keys`` in one task."""
    if not keys:
        kept = keep([tuple(r) for r in bounded_rows(edges.select(*columns), MAX_CLASSES, "class edges")])
        return edges.sparkSession.createDataFrame(kept, "child string, parent string")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept = keep(list(rows[columns].itertuples(index=False, name=None)))
        return pd.DataFrame([(*key, *e) for e in kept], columns=[*keys, "child", "parent"])

    schema = T.StructType([*(edges.schema[k] for k in keys), T.StructField("child", T.StringType()), T.StructField("parent", T.StringType())])
    return edges.select(*keys, *columns).where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def enforce_tree(edges: DataFrame, max_depth: int = MAX_DEPTH, keys: tuple[str, ...] = ()) -> DataFrame:
    """(child, parent) of a forest: edges in order of trust, votes and names; no cycle, no second parent, depth in bounds.

    Edges are between classes, a vocabulary whose size is checked; the order decides, so they are taken one by one. With
    ``keys``, such as run_id, each of their groups has a forest of its own, made in one task.
    """
    return _in_order(edges, ["trusted", "weak", "child", "parent"], keys, lambda rows: tree_of(rows, max_depth))


def acyclic_first(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(child, parent) of edges (seq, child, parent) kept in order of seq unless the parent already reaches the child.

    With ``keys``, such as run_id, each of their groups is judged apart, in one task.
    """
    return _in_order(edges, ["seq", "child", "parent"], keys, acyclic_of)


def interclass_edges(edges: DataFrame, assignments: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """(source_class, target_class, n): classes linked by at least max(3, 5 % of the smaller class) edges, the stronger direction."""
    a = assignments.where("class <> 'Other'").select("entity_id", "class")
    sizes = a.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    pair = edges.join(a.select(F.col("entity_id").alias("src"), F.col("class").alias("cs")), "src").join(a.select(F.col("entity_id").alias("dst"), F.col("class").alias("cd")), "dst").where("cs <> cd").groupBy("cs", "cd").agg(F.count(F.lit(1)).alias("k"))
    sized = pair.join(sizes.select(F.col("class").alias("cs"), F.col("n").alias("ns")), "cs").join(sizes.select(F.col("class").alias("cd"), F.col("n").alias("nd")), "cd")
    strong = sized.where(F.col("k") >= F.greatest(F.lit(least), F.floor(F.least("ns", "nd") * share)))
    rank = F.row_number().over(W.partitionBy(F.least("cs", "cd"), F.greatest("cs", "cd")).orderBy(F.desc("k"), "cs"))
    return strong.withColumn("r", rank).where("r = 1").select(F.col("cs").alias("source_class"), F.col("cd").alias("target_class"), F.col("k").alias("n"))


def confidence(cls: Column, arbitrated: Column, flagged: Column, consolidated: Column) -> Column:
    """0.3 for Other, 0.5 arbitrated, 0.7 flagged, 0.8 consolidated, else 1. Null flags are false."""
    no = F.lit(False)
    return F.when(cls == "Other", 0.3).when(F.coalesce(arbitrated, no), 0.5).when(F.coalesce(flagged, no), 0.7).when(F.coalesce(consolidated, no), 0.8).otherwise(1.0)


def provenance(assignments: DataFrame, flagged: DataFrame, arbitrated: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """(entity_id, final_type, flagged, arbitrated, consolidated_from, confidence) of every assignment."""
    out = assignments.select("entity_id", F.col("class").alias("final_type")).join(flagged.select("entity_id", F.lit(True).alias("flagged")).distinct(), "entity_id", "left")
    out = out.join(arbitrated.select("entity_id", F.lit(True).alias("arbitrated")).distinct(), "entity_id", "left") if arbitrated is not None else out.withColumn("arbitrated", F.lit(False))
    if before is not None:
        out = out.join(before.select("entity_id", F.col("class").alias("was")), "entity_id", "left").withColumn("consolidated_from", F.when(F.col("was") != F.col("final_type"), F.col("was"))).drop("was")
    else:
        out = out.withColumn("consolidated_from", F.lit(None).cast("string"))
    no = F.lit(False)
    out = out.withColumn("flagged", F.coalesce("flagged", no)).withColumn("arbitrated", F.coalesce("arbitrated", no))
    return out.withColumn("confidence", confidence(F.col("final_type"), F.col("arbitrated"), F.col("flagged"), F.col("consolidated_from").isNotNull()))


def provenance_summary(p: DataFrame) -> DataFrame:
    """(final_type, n, flagged, arbitrated, consolidated, low_confidence) per class."""
    return p.groupBy("final_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("int")).alias("flagged"), F.sum(F.col("arbitrated").cast("int")).alias("arbitrated"), F.count("consolidated_from").alias("consolidated"), F.sum((F.col("confidence") < 0.5).cast("int")).alias("low_confidence"))


def corrections(p: DataFrame, truth: DataFrame, top: int = 20) -> DataFrame:
    """(entity_id, was, should_be): at most ``top`` entities whose class differs from the expected one, surest first."""
    wrong = p.join(truth.select("entity_id", F.col("class").alias("should_be")), "entity_id").where("final_type <> should_be")
    return wrong.orderBy(F.desc("confidence"), "entity_id").limit(top).select("entity_id", F.col("final_type").alias("was"), "should_be")
