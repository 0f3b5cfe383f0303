"""Queries of the further ways to classes, of judged and structural metrics, and of the cached graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import LineClient, RuleClient, SentenceTriples
from ..operators import clustering as C
from ..operators import hierarchy as H
from ..operators import induction as I
from ..operators import metrics as M
from ..operators import resolution as Re
from ..session import cached_table, table_path
from .cluster_queries import _HEADERS, _claims_sql, _file_tokens, _headers, _profiles
from .core_queries import UP
from .graph_queries import _VEC, assignments, edges, entities, unit_vectors
from .metric_queries import _F1, _NAMES, _runs
from .ontology_queries import BASE
from .registry import quoted, registry
from .tables import table

QUERIES, SQL, query = registry()


@query()
def ward_classes(spark: SparkSession, sf: str) -> DataFrame:
    return I.ward_classes(unit_vectors(spark, sf).select("id", "v"))[0]


@query()
def ward_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return I.ward_classes(unit_vectors(spark, sf).select("id", "v"))[1]


@query()
def community_levels(spark: SparkSession, sf: str) -> DataFrame:
    pairs = Re.similar_pairs(unit_vectors(spark, sf).select("id", "v"), 0.8)
    return I.community_levels(C.similarity_graph(pairs, _profiles(spark, sf), 0.3))[0]


_SPLIT = """weak AS (SELECT DISTINCT class FROM asg WHERE class <> 'Other' AND starts_with(class, 'C')), m AS (SELECT asg.* FROM asg JOIN weak USING (class)), h AS (SELECT DISTINCT entity_id, class, rel FROM m JOIN edges ON src = entity_id WHERE rel IS NOT NULL),
  k AS (SELECT class, rel, count(*) AS k FROM h GROUP BY class, rel), s AS (SELECT class, count(*) AS n FROM m GROUP BY class), b AS (SELECT class, rel, row_number() OVER (PARTITION BY class ORDER BY abs(2 * k - n), rel) AS r FROM k JOIN s USING (class) WHERE k < n)"""


@query(f"WITH {BASE}, {_SPLIT} SELECT asg.entity_id, coalesce(x.class || ' with ' || x.rel, asg.class) AS class FROM asg LEFT JOIN (SELECT entity_id, class, rel FROM h JOIN b USING (class, rel) WHERE r = 1) x USING (entity_id)")
def incoherent_splits(spark: SparkSession, sf: str) -> DataFrame:
    client = RuleClient([("\nClass C", "2"), ("\nClass Exclusion", "no number")], "4")
    return I.split_incoherent(assignments(spark, sf), edges(spark, sf), client)


_CENTROIDS = """u AS (SELECT id, entity_type, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vec),
  sc AS (SELECT class_of, k, sum(x) AS s FROM (SELECT entity_type AS class_of, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM u WHERE entity_type IS NOT NULL) GROUP BY class_of, k), ce AS (SELECT class_of, list(s ORDER BY k) AS w FROM sc GROUP BY class_of)"""


def _type_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return M.centroids(unit_vectors(spark, sf).where("entity_type is not null").select(F.col("entity_type").alias("class_of"), "v"))


@query(f"WITH {_VEC}, {_CENTROIDS} SELECT entity, class_of, sim FROM (SELECT u.id AS entity, class_of, list_cosine_similarity(v, w) AS sim, row_number() OVER (PARTITION BY u.id ORDER BY list_cosine_similarity(v, w) DESC, class_of) AS r FROM u, ce) WHERE r = 1")
def nearest_classes(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_centroid(unit_vectors(spark, sf).select("id", "v"), _type_centroids(spark, sf))


@query(f"""WITH RECURSIVE {_VEC}, {_CENTROIDS}, l AS (SELECT a.class_of AS a, b.class_of AS b FROM ce a JOIN ce b ON a.class_of <> b.class_of AND left(a.class_of, 1) = left(b.class_of, 1) WHERE list_cosine_similarity(a.w, b.w) >= 0.05),
  r AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id) SELECT id AS child, min(c) AS merged_into FROM r GROUP BY id HAVING min(c) <> id""")
def sibling_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Types as classes under their first letter; their means lie far apart here, so the limit is low."""
    c = _type_centroids(spark, sf).select(F.left("class_of", F.lit(1)).alias("parent"), F.col("class_of").alias("child"), "v")
    return I.merge_siblings(c, 0.05)


@query(f"WITH {BASE} SELECT id, concat_ws('|', entity_type, CASE WHEN ends_with(entity_type, 'Record') THEN 'Record' WHEN regexp_matches(entity_type, '^(Cov|Excl)') THEN 'Scope' END) AS labels FROM ents")
def induced_labels(spark: SparkSession, sf: str) -> DataFrame:
    client = LineClient([(r"Record\Z", "Record"), ("^(Cov|Excl)", "Scope"), ("Clause", "not a class")])
    return I.induced_labels(entities(spark, sf), ["Record", "Scope"], client).select("id", F.array_join("labels", "|").alias("labels"))


@query()
def baseline_triples(spark: SparkSession, sf: str) -> DataFrame:
    return I.baseline_triples(table(spark, sf, "documents").select(F.col("doc_id").alias("source"), "text"), SentenceTriples())


_RULES = [("DATE", "Times"), ("AMOUNT|COST|PREMIUM", "Money"), ("ZIP|CITY|STATE", "Places")]
_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(header, '{p}') THEN '{c}' END" if i == len(_RULES) - 1 else f"WHEN regexp_matches(header, '{p}') THEN '{c}'" for i, (p, c) in enumerate(_RULES))


@query(f"WITH {_HEADERS}, {_claims_sql()} SELECT prefix AS class, header FROM won UNION ALL SELECT class, header FROM (SELECT header, {_NAMED} AS class FROM f0) WHERE class IS NOT NULL")
def header_classes(spark: SparkSession, sf: str) -> DataFrame:
    return I.header_classes(_headers(spark, sf), LineClient(_RULES))


@query()
def file_class_bridges(spark: SparkSession, sf: str) -> DataFrame:
    return I.file_classes(_headers(spark, sf), _file_tokens(spark, sf), LineClient(_RULES))["bridges"]


@query(f"""WITH {_NAMES}, y AS (SELECT * FROM sim WHERE sim >= 0.6 AND right(induced, 4) = right(reference, 4)), n AS (SELECT run_id, count(*) AS nr FROM nm WHERE run_id <> (SELECT r FROM f) GROUP BY run_id), h AS (SELECT run_id, count(DISTINCT induced) AS i, count(DISTINCT reference) AS j FROM y GROUP BY run_id),
  v AS (SELECT run_id, coalesce(i, 0) * 1.0 / (SELECT count(*) FROM nm WHERE run_id = (SELECT r FROM f)) AS p, coalesce(j, 0) * 1.0 / nr AS r FROM n LEFT JOIN h USING (run_id)) SELECT run_id, p AS precision, r AS recall, {_F1} FROM v""")
def judged_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """A judge that takes names with the same last four letters for one class."""
    names, first = _runs(spark, sf)

    def judge(prompt: str) -> str:
        _, a, b = prompt.split("\n")
        return "yes" if a[-4:] == b[-4:] else "no"

    return M.judged_alignment(M.run_pairs(names, first), M.run_sizes(names, first), RuleClient([("", judge)]))


@query()
def graph_f1(spark: SparkSession, sf: str) -> DataFrame:
    return M.against_first(table(spark, sf, "taxonomy_nodes"), M.graph_f1_of, "precision double, recall double, f1 double")


@query()
def depth_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return M.against_first(table(spark, sf, "taxonomy_nodes"), M.depth_similarity_of, "similarity double")


@query(f"WITH RECURSIVE {UP} SELECT own.run_id, count(*) AS nodes, count(*) FILTER (tree.depth = 0) AS roots, max(tree.depth) AS max_depth, avg(tree.depth) AS mean_depth FROM own LEFT JOIN tree USING (id) GROUP BY own.run_id")
def ontology_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of each run's hierarchy, nodes in or below cycles left out of it."""
    nodes = table(spark, sf, "taxonomy_nodes")
    tree = H.hierarchy(*H.parent_links(nodes, table(spark, sf, "class_hierarchy"))).select("node_id", F.when(F.col("depth") >= 0, F.col("depth")).alias("depth"))
    runs = nodes.select("node_id", "run_id").distinct()
    return tree.join(runs, "node_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("depth") == 0, 1)).alias("roots"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"))


@query("SELECT DISTINCT lower(trim(child, ' ')) AS child, lower(trim(parent, ' ')) AS parent, edge_type FROM class_hierarchy WHERE child IS NOT NULL AND parent IS NOT NULL AND lower(trim(child, ' ')) <> lower(trim(parent, ' '))")
def induced_edges(spark: SparkSession, sf: str) -> DataFrame:
    c, p = F.lower(F.trim("child")), F.lower(F.trim("parent"))
    return table(spark, sf, "class_hierarchy").select(c.alias("child"), p.alias("parent"), "edge_type").where("child is not null and parent is not null and child <> parent").distinct()


@query(f"WITH {BASE} SELECT id, entity_type, lane FROM lanes")
def entities_cached(spark: SparkSession, sf: str) -> DataFrame:
    """The entities of a graph, made at the first call and read from the same table at the second."""
    folder = table_path(spark, "graph-cache")
    made = []

    def build() -> DataFrame:
        made.append(1)
        return entities(spark, sf)

    for _ in range(2):
        out = cached_table(spark, build, [f"{sf}/sampled_triples.parquet"], folder)
    if len(made) != 1:
        raise RuntimeError("the kept table was not used")
    return out


@query(f"WITH {BASE} SELECT rel, head, n FROM (SELECT rel, min({{'s': seq, 'd': dst}}).d AS head, count(*) AS n FROM edges GROUP BY rel) WHERE n >= 2")
def q_head_collect(spark: SparkSession, sf: str) -> DataFrame:
    """The first target of each relation with more than one edge."""
    return edges(spark, sf).groupBy("rel").agg(F.min_by("dst", "seq").alias("head"), F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(f"WITH {BASE} SELECT src AS id, 'source' AS side FROM edges WHERE contains(rel, 'CITY') UNION SELECT dst, 'target' FROM edges WHERE contains(rel, 'CITY')")
def q_union(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where(F.col("rel").contains("CITY"))
    return e.select(F.col("src").alias("id"), F.lit("source").alias("side")).union(e.select("dst", F.lit("target"))).distinct()


@query(f"WITH {BASE}, d AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src) SELECT e.entity_type, count(*) AS hubs FROM ents e JOIN d USING (id) WHERE d.n > (SELECT avg(n) FROM d) AND entity_type IN ({quoted(['PolicyRecord', 'ClaimRecord', 'Organization'])}) GROUP BY e.entity_type")
def q_subquery(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with more than the mean number of edges, by a subquery over the views."""
    edges(spark, sf).createOrReplaceTempView("q_edges")
    entities(spark, sf).createOrReplaceTempView("q_entities")
    return spark.sql("""WITH d AS (SELECT src AS id, count(*) AS n FROM q_edges GROUP BY src) SELECT e.entity_type, count(*) AS hubs FROM q_entities e JOIN d ON e.id = d.id
      WHERE d.n > (SELECT avg(n) FROM d) AND e.entity_type IN ('PolicyRecord', 'ClaimRecord', 'Organization') GROUP BY e.entity_type""")
