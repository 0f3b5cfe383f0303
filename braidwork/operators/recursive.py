"""Taxonomies by recursive splitting: fused entity vectors, and splits by type, name and structure, a level at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..models import Embedder, embed_column
from ..session import materialize
from .clustering import split_groups

#: Weights of name, relations, type and source in a fused vector.
WEIGHTS = (0.45, 0.30, 0.15, 0.10)
#: Levels, classes, members from which a class is split, and members and share that a part needs.
LEVELS, CLASSES, SPLIT, PART, PART_SHARE = 4, 25, 20, 8, 0.12
#: Numbers that relations, types and sources are hashed to.
RELATIONS, TYPES, SOURCES = 64, 32, 16


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # The norm is an array of its own: inside a lambda it would be computed once for every number.
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def hashed_counts(rows: DataFrame, feature: str, size: int, out: str) -> DataFrame:
    """(id, out): counts of a feature (id, feature) hashed to ``size`` numbers, damped by a logarithm, of length one."""
    counts = rows.where(F.col(feature).isNotNull()).groupBy("id", F.pmod(F.xxhash64(feature), F.lit(size)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    sparse = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.log1p("n").alias("x")))).alias("m"))
    return sparse.select("id", _unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))).alias(out))


def fused_vectors(entities: DataFrame, edges: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(id, v) of length one: name, relations, type and source of entities (id, entity_type), side by side by weight.

    ``edges``: src, rel, dst, source. What an entity lacks is zero. At most RELATIONS counts of one entity are gathered.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.concat(F.lit(">"), "rel").alias("rel"), "source"), F.struct(F.col("dst").alias("id"), F.concat(F.lit("<"), "rel").alias("rel"), "source"))).alias("e")).select("e.*")
    counted = entities.select("id").join(hashed_counts(ends, "rel", RELATIONS, "r"), "id", "left").join(hashed_counts(entities.select("id", "entity_type"), "entity_type", TYPES, "t"), "id", "left").join(hashed_counts(ends, "source", SOURCES, "s"), "id", "left")
    out = embed_column(counted, "id", embedder, "name")  # after the joins, whose shuffles are then narrow

    def part(c: str, weight: float, size: int | None) -> Column:
        v = F.col(c) if size is None else F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), size))
        return F.transform(v, lambda x: x * F.lit(weight**0.5))

    parts = [part("name", WEIGHTS[0], None), part("r", WEIGHTS[1], RELATIONS), part("t", WEIGHTS[2], TYPES), part("s", WEIGHTS[3], SOURCES)]
    return out.select("id", _unit(F.concat(*parts)).alias("v"))


def recursive_taxonomy(entities: DataFrame, vectors: DataFrame, root: str = "Root", levels: int = LEVELS, classes: int | None = CLASSES, least_silhouette: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """((id, class), (child, parent, depth, split_method)) of entities (id, entity_type) split a level at a time.

    A class of SPLIT members or more is split by entity type if two types or more hold max(PART, 12 %) of it each, else by
    its vectors (id, v), as all classes of a level are at once. Members of no large type stay in the class. Splitting ends
    after ``levels`` levels or once there are ``classes`` classes, None for any number. Entities without a vector stay where they are.
    """
    spark = entities.sparkSession
    state = materialize(entities.select("id", F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"), F.lit(root).alias("class")), "taxonomy")
    found, done, total = [], set(), 1
    for depth in range(1, levels + 1):
        sizes = [r for r in state.groupBy("class").count().collect() if r["count"] >= SPLIT and r["class"] not in done]
        if not sizes or (classes is not None and total >= classes):
            break
        todo = F.broadcast(spark.createDataFrame([(r["class"], r["count"]) for r in sizes], "class string, n long"))
        large = state.join(todo, "class").groupBy("class", "entity_type", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.greatest(F.lit(PART), F.col("n") * PART_SHARE))
        large = large.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("class"))).where("m >= 2")
        by_type = {(r["class"], r["entity_type"]): f"{r['class']}/{r['entity_type']}" for r in large.orderBy("class", "entity_type").collect()}
        typed = {c for c, _ in by_type}
        rest = [r["class"] for r in sizes if r["class"] not in typed]
        moves = [(c, t, -1, child) for (c, t), child in by_type.items()]
        if rest:
            others = F.broadcast(spark.createDataFrame([(c,) for c in rest], "class string"))
            parts = split_groups(state.join(others, "class").join(vectors, "id").select(F.col("class").alias("grp"), "id", "v"), least_silhouette=least_silhouette, least_size=PART, least_share=PART_SHARE)
            parts = materialize(parts, "taxonomy-parts")
            several = {r["grp"] for r in parts.groupBy("grp").agg(F.count_distinct("part").alias("k")).where("k > 1").collect()}
            named = {(r["grp"], r["part"]): f"{r['grp']}/{r['part'] + 1}" for r in parts.select("grp", "part").distinct().orderBy("grp", "part").collect() if r["grp"] in several}
            moves += [(c, None, p, child) for (c, p), child in named.items()]
        else:
            parts = spark.createDataFrame([], "grp string, id string, part int")
        moves = moves if classes is None else moves[: max(0, classes - total)]
        done |= {r["class"] for r in sizes}
        if not moves:
            break
        plan = F.broadcast(spark.createDataFrame(moves, "class string, t string, p int, child string"))
        at = state.join(parts.select("id", "part"), "id", "left")
        hit = (at["class"] == plan["class"]) & (((plan["p"] == -1) & (plan["t"] == at["entity_type"])) | (plan["p"] == at["part"]))
        state = materialize(at.join(plan, hit, "left").select(at["id"], at["entity_type"], F.coalesce(plan["child"], at["class"]).alias("class")), "taxonomy")
        found += [(child, c, depth, "entity_type" if p == -1 else "structural") for c, _, p, child in moves]
        total += len(moves)
    return state.select("id", "class"), spark.createDataFrame(found, "child string, parent string, depth int, split_method string")


def data_fingerprint(chunks: DataFrame, width: int = 300) -> DataFrame:
    """(source, schema_text, sample): each source's first schema chunk and first record, cut to ``width`` characters.

    ``chunks``: chunk_id, source, content, section_hierarchy. The first by chunk id is found with a minimum per source.
    """
    schema = F.array_contains("section_hierarchy", "schema")
    first = F.min(F.when(schema, F.struct("chunk_id", F.substring("content", 1, width).alias("t"))))["t"]
    record = F.regexp_extract("content", r"RECORD:\s*\n((?:[^\n]+\n?)+)", 1)
    sample = F.min(F.when(~F.coalesce(schema, F.lit(False)) & (record != ""), F.struct("chunk_id", F.substring(record, 1, width).alias("t"))))["t"]
    return chunks.where("source is not null").groupBy("source").agg(first.alias("schema_text"), sample.alias("sample"))
