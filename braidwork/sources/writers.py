"""Sinks: the property graph as tables, ontologies, and runs."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import normalize as N


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def current_version(spark: SparkSession, path: str) -> tuple[str | None, int]:
    """(folder of the version that ``path`` points to, last batch of a stream that it holds); (None, -1) without any."""
    p, fs = _path(spark, f"{path}/current")
    if not fs.exists(p):
        return None, -1
    name, batch = spark.read.text(f"{path}/current").first()[0].split("\t")
    return f"{path}/versions/{name}", int(batch)


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], batch: int = -1) -> None:
    """Write ``tables`` as a new version under ``path`` and point to it with one rename, so that readers see all or none.

    The version before stays for those who still read it; older ones are deleted.
    """
    before, _ = current_version(spark, path)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/versions/{name}/{table}")
    new, fs = _path(spark, f"{path}/current-{name}")
    out = fs.create(new, True)
    out.write(bytearray(f"{name}\t{batch}\n".encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, _path(spark, f"{path}/current")[0], options)
    for old in fs.listStatus(_path(spark, f"{path}/versions")[0]):
        if old.getPath().getName() not in (name, (before or "").rsplit("/", 1)[-1]):
            fs.delete(old.getPath(), True)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) under ``path``: the current version with the batches of a stream that came after it, merged by key.

    Of equal edges the first counts, by batch and then seq; a node has the first known type.
    """
    version, last = current_version(spark, path)
    parts = []
    for table in ("nodes", "edges"):
        base = spark.read.parquet(f"{version}/{table}").withColumn("batch", F.lit(-1)) if version else None
        new = None
        if _exists(spark, f"{path}/deltas/{table}"):
            new = spark.read.parquet(f"{path}/deltas/{table}").where(F.col("batch") > last)
        parts.append(base if new is None else new if base is None else base.unionByName(new, allowMissingColumns=True))
    nodes, edges = parts
    if nodes is None:
        raise ValueError(f"no graph under {path}")
    known = F.col("entity_type") != "Unknown"
    nodes = nodes.groupBy("id").agg(
        F.coalesce(F.min(F.when(known, F.struct("batch", "entity_type")))["entity_type"], F.lit("Unknown")).alias("entity_type"),
        F.min(F.struct("batch", "source_type"))["source_type"].alias("source_type"), F.any_value("props", True).alias("props"),
    )
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst", "batch", "seq")]
    first = F.min(F.struct("batch", "seq", *rest)).alias("x")
    return nodes, edges.groupBy("src", "rel", "dst").agg(first).select("src", "rel", "dst", *(f"x.{c}" for c in [*rest, "seq"]))


def graph_tables(triples: DataFrame, collapse: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples; with ``collapse`` the literal objects of few subjects become properties of their nodes."""
    if not collapse:
        return G.merge_nodes(triples).withColumn("props", F.lit(None).cast("map<string,string>")), G.merge_edges(triples)
    left, properties = N.collapse(triples)
    values = properties.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("props")).withColumnRenamed("subject", "id")
    nodes = G.merge_nodes(left).join(values, "id", "full").select("id", F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"), "source_type", "props")
    return nodes, G.merge_edges(left)


def write_graph(triples: DataFrame, path: str, wipe: bool = True, collapse: bool = True) -> None:
    """A new version of the nodes and edges under ``path``. Without ``wipe`` they merge into those there: what is there stays first."""
    spark = triples.sparkSession
    nodes, edges = graph_tables(triples, collapse)
    version, batch = current_version(spark, path)
    if not wipe and (version or _exists(spark, f"{path}/deltas/nodes")):
        batch = max([batch, *_batches(spark, path)])
        old_nodes, old_edges = read_graph(spark, path)
        nodes, edges = merge_nodes(old_nodes, nodes), merge_edges(old_edges, edges)
    elif wipe:
        batch = max([batch, *_batches(spark, path)])
    publish(spark, path, {"nodes": nodes, "edges": edges}, batch)


def clear_graph(spark: SparkSession, path: str) -> None:
    """Delete the graph under ``path`` with all its versions and batches."""
    for name in ("current", "versions", "deltas"):
        p, fs = _path(spark, f"{path}/{name}")
        fs.delete(p, True)


def _batches(spark: SparkSession, path: str) -> list[int]:
    p, fs = _path(spark, f"{path}/deltas/nodes")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.split("=")[1]) for n in names if n.startswith("batch=")]


def append_batch(triples: DataFrame, path: str, batch: int) -> None:
    """The nodes and edges of one batch beside the current version. A batch that runs again replaces what it wrote."""
    for table, df in zip(("nodes", "edges"), graph_tables(triples, collapse=False)):
        df.write.mode("overwrite").parquet(f"{path}/deltas/{table}/batch={batch}")


def compact(spark: SparkSession, path: str) -> None:
    """Merge the batches of a stream into a new version, then delete them; readers never see a batch twice or not at all."""
    _, last = current_version(spark, path)
    done = _batches(spark, path)
    if not done or max(done) <= last:
        return
    nodes, edges = read_graph(spark, path)
    publish(spark, path, {"nodes": nodes, "edges": edges}, max(done))
    for table in ("nodes", "edges"):
        for b in done:
            p, fs = _path(spark, f"{path}/deltas/{table}/batch={b}")
            fs.delete(p, True)


def edges_by_relation(edges: DataFrame, path: str) -> None:
    """The edges as a table with a folder per relation, so that a question over one relation reads that one only."""
    edges.hint("rebalance", "rel").write.mode("overwrite").partitionBy("rel").parquet(path)


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old nodes with an Unknown type upgraded and new properties added over old ones, and the new nodes."""
    o, n = old.alias("o"), new.alias("n")
    known = F.when(F.col("o.entity_type") != "Unknown", F.col("o.entity_type"))
    no = F.create_map().cast("map<string,string>")
    props = F.map_concat(F.map_filter(F.coalesce("o.props", no), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("n.props", no)), k)), F.coalesce("n.props", no))
    return o.join(n, "id", "full").select("id", F.coalesce(known, F.col("n.entity_type"), F.col("o.entity_type")).alias("entity_type"), F.coalesce("o.source_type", "n.source_type").alias("source_type"), props.alias("props"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.join(old.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti"), allowMissingColumns=True)


def append_raw(triples: DataFrame, path: str) -> None:
    """Triples and their documents as they are, without merging, after those already there."""
    triples.write.mode("append").parquet(f"{path}/raw_triples")
    triples.select(F.col("source").alias("document")).where("source is not null").distinct().write.mode("append").parquet(f"{path}/documents")


def write_ontology(assignments: DataFrame, hierarchy: DataFrame, associations: DataFrame, path: str, extra: DataFrame | None = None) -> None:
    """classes, class_edges (SUBCLASS_OF, ASSOCIATED_WITH) and instance_of tables under ``path``; what was there is replaced."""
    classes = assignments.where("class <> 'Other'").groupBy(F.col("class").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    if extra is not None:
        classes = classes.join(extra, "name", "left")
    classes.write.mode("overwrite").parquet(f"{path}/classes")
    edges = hierarchy.select("child", "parent", F.lit("SUBCLASS_OF").alias("edge_type")).unionByName(associations.select(F.col("source_class").alias("child"), F.col("target_class").alias("parent"), F.lit("ASSOCIATED_WITH").alias("edge_type")))
    edges.write.mode("overwrite").parquet(f"{path}/class_edges")
    assignments.where("class <> 'Other'").select("entity_id", "class").write.mode("overwrite").parquet(f"{path}/instance_of")


def decomposition_edges(parts: DataFrame) -> DataFrame:
    """(src, rel, dst) of decomposed records: HAS_COMPONENT, INSTANCE_OF and the copied fields of sub-nodes record:class."""
    node = F.concat("record", F.lit(":"), F.lower("class"))
    return (
        parts.select(F.col("record").alias("src"), F.lit("HAS_COMPONENT").alias("rel"), node.alias("dst")).distinct()
        .unionByName(parts.select(node.alias("src"), F.lit("INSTANCE_OF").alias("rel"), F.col("class").alias("dst")).distinct())
        .unionByName(parts.select(node.alias("src"), F.col("relation").alias("rel"), F.col("target").alias("dst")))
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def register_views(spark: SparkSession, path: str) -> None:
    """nodes, edges, classes, class_edges and instance_of under ``path`` as views of the session, as far as they exist."""
    if current_version(spark, path)[0] or _exists(spark, f"{path}/deltas/nodes"):
        for name, df in zip(("nodes", "edges"), read_graph(spark, path)):
            df.createOrReplaceTempView(name)
    for name in ("classes", "class_edges", "instance_of"):
        if _exists(spark, f"{path}/{name}"):
            spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(name)


def answer(spark: SparkSession, sql: str, limit: int = 200) -> DataFrame:
    """Rows of a read-only statement over the views, at most ``limit``; others raise ValueError."""
    from ..operators.filters import clamp_limit, is_read_only

    if not is_read_only(sql):
        raise ValueError("only a single SELECT or WITH statement may be run")
    return spark.sql(clamp_limit(sql, limit)).limit(limit)
