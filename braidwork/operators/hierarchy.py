"""Parent-child links to full hierarchies by heavy-path decomposition.

Pointer doubling over the links gives depth, root and subtree size in about log2(depth) rounds, and leaves over exactly
the nodes in or below a cycle. Each node's largest child continues its chain; chains are collected once, and a path is
the prefix of at most log2(nodes) chains. A chain is as long as a path of the tree, which a result row must hold anyway.
Preorder numbers follow from chain intervals, so the descendants of a node are one interval of its tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import SPACE
from ..session import drop_table, materialize

#: Siblings that one task orders at a time when it numbers the children of one node.
SIBLINGS = 100_000


def name_key(c):
    """Name without case and outer white space; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""))
    return F.when(bare != "", bare)


def parent_links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, name) and (links: id, parent with null for roots) from a node table and a table of child-parent pairs.

    ``nodes`` needs node_id, run_id, name, parent, updated_at; ``edges`` needs run_id, child, parent, edge_type. Names match
    within a run. Rows without node_id are left out; a null run is a run of its own; a null or blank name gives a node
    that no link can name. If one name belongs to several nodes, links mean the smallest id; if a node has several
    parents, the smallest id is taken. Of repeated node rows the latest gives the name, and all give parents.
    """
    run = F.coalesce(F.concat(F.lit("r"), "run_id"), F.lit("")).alias("run")
    rows = nodes.where("node_id is not null").select(F.col("node_id").alias("id"), run, "name", name_key(F.col("name")).alias("k"), name_key(F.col("parent")).alias("p"), "updated_at")
    rows = materialize(rows, "hierarchy-rows")
    own = rows.groupBy("id").agg(F.max(F.struct("updated_at", "name")).alias("x")).select("id", F.coalesce("x.name", F.lit("")).alias("name"))
    keys = rows.where("k is not null").groupBy("run", "k").agg(F.min("id").alias("id"))
    pairs = rows.where("p is not null").select("run", F.col("id").alias("child"), "p")
    listed = edges.where("edge_type = 'SUBCLASS_OF'").select(run, name_key(F.col("child")).alias("k"), name_key(F.col("parent")).alias("p"))
    listed = listed.where("k is not null and p is not null").distinct().join(keys, ["run", "k"]).select("run", F.col("id").alias("child"), "p")
    up = pairs.union(listed).distinct().join(keys.withColumnRenamed("k", "p"), ["run", "p"]).groupBy("child").agg(F.min("id").alias("parent"))
    own = materialize(own, "hierarchy-names")
    return own, own.select("id").join(up, F.col("id") == F.col("child"), "left").select("id", "parent")


def double_up(links: DataFrame, sizes: bool = False) -> DataFrame:
    """(id, top, dist, size) for nodes with a way to a root; top and dist are null for those in or below a cycle.

    ``links`` has id and parent, null for roots. Each round doubles how far every open node looks up. Depths have no
    gaps, so a round in which no node ends shows that only cycles are left.
    """
    state = links.select("id", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("dist"), F.when(F.col("parent").isNull(), F.col("id")).alias("top"), F.lit(1).cast("long").alias("size"))
    state = materialize(state, "doubling")
    open_before = state.where("ptr is not null").count()
    while open_before:
        active = state.where("ptr is not null")
        jump = state.select(F.col("id").alias("at"), F.col("ptr").alias("next"), F.col("dist").alias("far"), F.col("top").alias("end"))
        moved = active.join(jump, F.col("ptr") == F.col("at")).select("id", F.col("next").alias("ptr"), (F.col("dist") + F.col("far")).alias("dist"), F.col("end").alias("top"), "size")
        following = moved.union(state.where("ptr is null").select("id", "ptr", "dist", "top", "size"))
        if sizes:
            gained = active.groupBy(F.col("ptr").alias("to")).agg(F.sum("size").alias("gain"))
            following = following.join(gained, F.col("id") == F.col("to"), "left").select("id", "ptr", "dist", "top", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        following = materialize(following, "doubling")
        drop_table(state)
        state = following
        open_now = state.where("ptr is not null").count()
        if open_now == open_before:
            break
        open_before = open_now
    ended = F.col("ptr").isNull()
    return state.select("id", F.when(ended, F.col("top")).alias("top"), F.when(ended, F.col("dist")).alias("dist"), F.when(ended, F.col("size")).alias("size"))


def sibling_offsets(children: DataFrame, total: int) -> DataFrame:
    """(id, offset): sum of the sizes of smaller-numbered siblings. ``children``: id, parent, size.

    The children of one node are cut into buckets whose sums are added up first, so no task orders all of them.
    """
    buckets = max(1, -(-total // SIBLINGS))
    c = children.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sums = c.groupBy("parent", "b").agg(F.sum("size").alias("s"))
    before = sums.withColumn("start", F.sum("s").over(W.partitionBy("parent").orderBy("b")) - F.col("s")).select("parent", "b", "start")
    inside = c.withColumn("part", F.sum("size").over(W.partitionBy("parent", "b").orderBy("id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    if buckets == 1:
        return inside.select("id", F.col("part").alias("offset"))
    return inside.join(before, ["parent", "b"]).select("id", (F.col("part") + F.col("start")).alias("offset"))


def hierarchy(names: DataFrame, links: DataFrame, separator: str = " > ") -> DataFrame:
    """One row per node: node_id, root_id, depth, path, path_ids, first, last.

    ``first`` is the node's preorder number in its tree and ``last`` the largest among its descendants: u is below v if
    both have the same root and first(v) < first(u) <= last(v). Nodes in or below a cycle have root_id -1, depth -1, an
    empty path, and null numbers. ``names``: id, name. ``links``: id, parent. An empty input gives an empty table.
    """
    links = materialize(links, "links")
    up = double_up(links, sizes=True)
    tree = materialize(links.join(up, "id").select("id", "parent", "top", "dist", "size").where("top is not null"), "trees")
    total = tree.count()
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", (-F.col("id")).alias("neg"))).alias("h")).select(F.col("parent").alias("of"), (-F.col("h.neg")).alias("heavy"), F.col("h.size").alias("heavy_size"))
    marked = tree.join(heavy, F.col("parent") == F.col("of"), "left").withColumn("goes_on", F.coalesce(F.col("heavy") == F.col("id"), F.lit(False)))
    marked = materialize(marked.select("id", "parent", "top", "dist", "size", "goes_on", "heavy_size"), "heavy-links")
    chains = double_up(marked.select("id", F.when(F.col("goes_on"), F.col("parent")).alias("parent"))).select("id", F.col("top").alias("chain"), F.col("dist").alias("pos"))
    chains = materialize(chains, "chains")
    segments = chains.join(names, "id").groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name"))).alias("s")).select("chain", F.col("s.id").alias("ids"), F.col("s.name").alias("names"))
    light = marked.where("parent is not null and not goes_on")
    heads = light.join(sibling_offsets(light.select("id", "parent", "size"), total), "id").join(chains.select(F.col("id").alias("parent"), F.col("chain").alias("up_chain"), F.col("pos").alias("up_pos")), "parent")
    heads = heads.select(F.col("id").alias("chain"), "up_chain", "up_pos", (F.col("up_pos") + 1 + F.col("heavy_size") + F.col("offset")).alias("step"))
    waiting = materialize(segments.join(heads, "chain", "left"), "segments")
    empty = F.array()
    front = waiting.where("up_chain is null").select("chain", "ids", "names", empty.cast("array<bigint>").alias("pre_ids"), empty.cast("array<string>").alias("pre"), F.lit(0).cast("long").alias("start"))
    front = materialize(front, "chain-paths")
    done = [front]
    rest = waiting.where("up_chain is not null")
    while True:
        parent = front.select(F.col("chain").alias("up_chain"), F.col("ids").alias("up_ids"), F.col("names").alias("up_names"), F.col("pre_ids").alias("a"), F.col("pre").alias("b"), F.col("start").alias("s"))
        upto = (F.col("up_pos") + 1).cast("int")
        front = rest.join(parent, "up_chain").select("chain", "ids", "names", F.concat("a", F.slice("up_ids", F.lit(1), upto)).alias("pre_ids"), F.concat("b", F.slice("up_names", F.lit(1), upto)).alias("pre"), (F.col("s") + F.col("step")).alias("start"))
        front = materialize(front, "chain-paths")
        if front.isEmpty():
            break
        done.append(front)
    paths = done[0]
    for more in done[1:]:
        paths = paths.unionByName(more)
    upto = (F.col("pos") + 1).cast("int")
    ordered = chains.join(paths, "chain").select("id", (F.col("start") + F.col("pos")).alias("first"), F.concat("pre_ids", F.slice("ids", F.lit(1), upto)).alias("path_ids"), F.array_join(F.concat("pre", F.slice("names", F.lit(1), upto)), separator).alias("path"))
    found = tree.select("id", "top", "dist", "size").join(ordered, "id")
    return links.select("id").join(found, "id", "left").select(
        F.col("id").alias("node_id"),
        F.coalesce("top", F.lit(-1)).cast("long").alias("root_id"),
        F.coalesce("dist", F.lit(-1)).cast("int").alias("depth"),
        F.coalesce("path", F.lit("")).alias("path"),
        "path_ids",
        "first",
        (F.col("first") + F.col("size") - 1).alias("last"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node and each node above it, as many rows as the depths add up to."""
    above = tree.where("depth > 0").select("node_id", "depth", F.posexplode(F.slice("path_ids", F.lit(1), F.col("depth"))).alias("at", "ancestor_id"))
    return above.select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))
