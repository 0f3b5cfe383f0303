"""Queries of the metrics and of graph questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import RuleClient
from ..operators import metrics as M
from .graph_queries import _VEC, assignments, edges, entities, triples, unit_vectors
from .ontology_queries import BASE
from .registry import registry
from .tables import table

QUERIES, SQL, query = registry()


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).select("id")


@query(f"WITH {BASE}, g AS (SELECT count(*) AS n FROM ents GROUP BY lower(trim(id, ' ')) HAVING count(*) > 1) SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_duplicated_nodes, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_nodes FROM g")
def duplication(spark: SparkSession, sf: str) -> DataFrame:
    return M.duplication(_ids(spark, sf))


@query(r"SELECT lower(string_split_regex(regexp_replace(regexp_replace(label, '([a-z])([A-Z])', '\1 \2', 'g'), '^[_ ]+', ''), '[_ ]')[1]) AS root, count(*) AS labels FROM (SELECT DISTINCT name AS label FROM taxonomy_nodes WHERE name IS NOT NULL) GROUP BY 1")
def type_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return M.type_consistency(table(spark, sf, "taxonomy_nodes").select(F.col("name").alias("label")))


_TERMS = "t AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(content, '([a-zA-Z]{3,})', 1)) AS w FROM hybrid_chunks))"


@query(rf"WITH {_TERMS}, w AS (SELECT DISTINCT unnest(string_split_regex(lower(subject), '[^a-z]+')) AS w FROM sampled_triples), c AS (SELECT DISTINCT word FROM t JOIN w ON contains(w, word)) SELECT (SELECT count(*) FROM t) AS terms, (SELECT count(*) FROM c) AS covered, (SELECT count(*) FROM c) * 1.0 / (SELECT count(*) FROM t) AS coverage")
def vocabulary_coverage(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "hybrid_chunks").select(F.explode(F.regexp_extract_all("content", F.lit("([a-zA-Z]{3,})"), 1)).alias("word"))
    return M.vocabulary_coverage(terms, triples(spark, sf).select(F.col("subject").alias("id")))


@query("SELECT count(*) FILTER (verdict = 'CORRECT') AS correct, count(*) FILTER (verdict = 'INCORRECT') AS incorrect, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (verdict = 'CORRECT') * 1.0 / count(*) FILTER (verdict IN ('CORRECT', 'INCORRECT')) AS precision FROM sampled_triples")
def triple_precision(spark: SparkSession, sf: str) -> DataFrame:
    return M.judged_precision(table(spark, sf, "sampled_triples").select("verdict"))


@query("SELECT count(*) FILTER (verdict = 'CORRECT') AS supported, count(*) FILTER (verdict = 'UNCERTAIN') AS partial, count(*) FILTER (verdict = 'INCORRECT') AS rejected, (count(*) FILTER (verdict = 'CORRECT') + 0.5 * count(*) FILTER (verdict = 'UNCERTAIN')) / count(verdict) AS score FROM sampled_triples WHERE verdict IN ('CORRECT', 'INCORRECT', 'UNCERTAIN')")
def source_grounding(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("verdict")
    said = F.when(v == "CORRECT", "SUPPORTED").when(v == "UNCERTAIN", "PARTIALLY SUPPORTED").when(v == "INCORRECT", "NOT SUPPORTED")
    return M.grounding_score(table(spark, sf, "sampled_triples").select(said.alias("verdict")).where("verdict is not null"))


#: Classes of the first run by run_id against those of every other run; the share of common words is the similarity of two names.
_NAMES = r"""nm AS (SELECT DISTINCT run_id, name FROM taxonomy_nodes WHERE run_id IS NOT NULL AND name IS NOT NULL), f AS (SELECT min(run_id) AS r FROM nm),
  wd AS (SELECT run_id, name, unnest(list_distinct(string_split(lower(trim(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), ' ')), ' '))) AS w FROM nm),
  sz AS (SELECT run_id, name, count(*) AS n, any_value(lower(regexp_extract(name, '([A-Z][a-z]+)\d*$', 1))) AS last FROM wd GROUP BY ALL),
  com AS (SELECT b.run_id, a.name AS induced, b.name AS reference, count(*) AS k FROM wd a JOIN wd b USING (w) WHERE a.run_id = (SELECT r FROM f) AND b.run_id <> (SELECT r FROM f) GROUP BY ALL),
  sim AS (SELECT y.run_id, x.name AS induced, y.name AS reference, round(coalesce(k / sqrt(x.n * y.n), 0.0), 9) AS sim, CAST(x.last = y.last AS INT) AS label
    FROM sz x JOIN sz y ON x.run_id = (SELECT r FROM f) AND y.run_id <> (SELECT r FROM f) LEFT JOIN com ON com.run_id = y.run_id AND com.induced = x.name AND com.reference = y.name)"""
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1"


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Names of every run, and the first run."""
    names = M.class_names(table(spark, sf, "taxonomy_nodes"))
    return names, names.agg(F.min("run_id")).first()[0]


@query(f"""WITH {_NAMES}, p AS (SELECT run_id, avg(m) AS p FROM (SELECT run_id, max(sim) AS m FROM sim GROUP BY run_id, induced) GROUP BY run_id), q AS (SELECT run_id, avg(m) AS r FROM (SELECT run_id, max(sim) AS m FROM sim GROUP BY run_id, reference) GROUP BY run_id)
  SELECT run_id, p AS precision, r AS recall, {_F1} FROM p JOIN q USING (run_id)""")
def bertscore_alignment(spark: SparkSession, sf: str) -> DataFrame:
    names, first = _runs(spark, sf)
    return M.alignment(M.run_pairs(names, first), M.run_sizes(names, first))


def _zeros(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of names that share nothing, by run."""
    found = pairs.groupBy("run_id").agg(F.count(F.lit(1)).alias("k"))
    return sizes.join(found, "run_id", "left").select("run_id", (F.col("n_induced") * F.col("n_reference") - F.coalesce("k", F.lit(0))).alias("n"))


@query(f"""WITH {_NAMES}, c AS (SELECT run_id, sim, sum(label) AS p, count(*) - sum(label) AS n FROM sim GROUP BY ALL), w AS (SELECT run_id, p, n, coalesce(sum(n) OVER (PARTITION BY run_id ORDER BY sim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
  SELECT run_id, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, sum(p * (below + 0.5 * n)) / nullif(sum(p) * sum(n), 0) AS auc FROM w GROUP BY run_id""")
def class_auc(spark: SparkSession, sf: str) -> DataFrame:
    names, first = _runs(spark, sf)
    pairs = M.run_pairs(names, first)
    return M.roc_auc(pairs.select("run_id", F.col("sim").alias("score"), "label"), _zeros(pairs, M.run_sizes(names, first)))


@query(f"""WITH {_NAMES}, c AS (SELECT run_id, sim, sum(label) AS p, count(*) AS n FROM sim WHERE sim > 0 OR label = 1 GROUP BY ALL), w AS (SELECT run_id, p, sum(p) OVER (PARTITION BY run_id ORDER BY sim DESC) AS hits, sum(n) OVER (PARTITION BY run_id ORDER BY sim DESC) AS seen FROM c)
  SELECT run_id, sum(p * hits / seen) / nullif(sum(p), 0) AS average_precision FROM w GROUP BY run_id""")
def class_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    names, first = _runs(spark, sf)
    return M.average_precision(M.run_pairs(names, first).select("run_id", F.col("sim").alias("score"), "label"))


@query(f"""WITH {_NAMES}, rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, reference ORDER BY sim DESC, induced) AS rank FROM sim WHERE sim > 0 OR label = 1), b AS (SELECT run_id, reference, min(rank) FILTER (sim > 0) AS rank FROM rk WHERE label = 1 GROUP BY run_id, reference)
  SELECT run_id, count(*) AS "references", avg(coalesce(1.0 / rank, 0)) AS mrr, avg(coalesce(CAST(rank = 1 AS DOUBLE), 0)) AS recall_at_1, avg(coalesce(CAST(rank <= 3 AS DOUBLE), 0)) AS recall_at_3 FROM b GROUP BY run_id""")
def class_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return M.retrieval(M.run_pairs(*_runs(spark, sf)))


@query(f"WITH {_NAMES} SELECT run_id, reference, rank, induced, sim FROM (SELECT *, row_number() OVER (PARTITION BY run_id, reference ORDER BY sim DESC, induced) AS rank FROM sim WHERE sim > 0) WHERE rank <= 3")
def class_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_matches(M.run_pairs(*_runs(spark, sf)))


def _parent_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "taxonomy_nodes").where("run_id is not null and name is not null and trim(parent) <> ''")
    return nodes.select("run_id", F.col("name").alias("child"), F.trim("parent").alias("parent")).distinct()


_RUNEDGES = """ed AS (SELECT DISTINCT run_id, name AS child, trim(parent, ' ') AS parent FROM taxonomy_nodes WHERE run_id IS NOT NULL AND name IS NOT NULL AND trim(parent, ' ') <> ''),
  ie AS (SELECT child, parent FROM ed WHERE run_id = (SELECT r FROM f)), re AS (SELECT * FROM ed WHERE run_id <> (SELECT r FROM f)), s AS (SELECT * FROM sim WHERE sim > 0.436)"""


@query(f"""WITH {_NAMES}, {_RUNEDGES}, h AS (SELECT re.run_id, ie.child AS c, ie.parent AS p, re.child AS rc, re.parent AS rp FROM s x JOIN ie ON ie.child = x.induced JOIN re ON re.run_id = x.run_id AND re.child = x.reference JOIN s y ON y.run_id = re.run_id AND y.induced = ie.parent AND y.reference = re.parent),
  m AS (SELECT run_id, count(DISTINCT (c, p)) AS mi, count(DISTINCT (rc, rp)) AS mr FROM h GROUP BY run_id), n AS (SELECT run_id, count(*) AS nr FROM re GROUP BY run_id),
  v AS (SELECT run_id, coalesce(mi, 0) * 1.0 / (SELECT count(*) FROM ie) AS p, coalesce(mr, 0) * 1.0 / nr AS r FROM n LEFT JOIN m USING (run_id))
  SELECT run_id, p AS precision, r AS recall, {_F1} FROM v""")
def fuzzy_f1(spark: SparkSession, sf: str) -> DataFrame:
    (names, first), links = _runs(spark, sf), _parent_edges(spark, sf)
    return M.edge_f1(links.where(F.col("run_id") == first), links.where(F.col("run_id") != first), M.run_pairs(names, first))


@query()
def continuous_f1(spark: SparkSession, sf: str) -> DataFrame:
    return M.against_first(table(spark, sf, "taxonomy_nodes"), M.continuous_f1_of, "precision double, recall double, f1 double")


_BAR = r"list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"


@query(rf"""WITH l AS (SELECT unnest(string_split(content, chr(10))) AS line FROM hybrid_chunks), p AS (SELECT {_BAR} AS p FROM l), f AS (SELECT lower(p[1]) AS s, lower(p[3]) AS o FROM p WHERE len(p) = 3 AND len(list_filter(p, lambda x: x = '')) = 0),
  ids AS (SELECT DISTINCT lower(id) AS id FROM (SELECT subject AS id FROM sampled_triples UNION SELECT object FROM sampled_triples) WHERE id <> ''), x AS (SELECT s AS t FROM f UNION SELECT o FROM f), hit AS (SELECT t FROM x WHERE EXISTS (SELECT 1 FROM ids WHERE contains(id, t) OR contains(t, id)))
  SELECT count(*) AS facts, count(*) FILTER (s IN (SELECT t FROM hit) AND o IN (SELECT t FROM hit)) AS found, coalesce(count(*) FILTER (s IN (SELECT t FROM hit) AND o IN (SELECT t FROM hit)) * 1.0 / nullif(count(*), 0), 0.0) AS recall FROM f""")
def fact_recall_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of three cells of every chunk as the facts."""
    lines = table(spark, sf, "hybrid_chunks").select("chunk_id", F.explode(F.split("content", "\n")).alias("line"))
    ids = triples(spark, sf).select(F.explode(F.array("subject", "object")).alias("id"))
    return M.fact_recall_substring(M.triple_facts(lines), ids)


@query()
def fact_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with a verb of policies as the facts that a model lists."""
    client = RuleClient([("", lambda p: "\n".join(re.findall(r"[A-Z][^.!?\n]* (?:covers|excludes|requires|includes|means|says) [^.!?\n]*", p.split("TEXT:", 1)[1])))])
    facts = M.chunk_facts(table(spark, sf, "hybrid_chunks").select("chunk_id", "source", "content"), client)
    return M.fact_recall(facts, triples(spark, sf).where("subject is not null and object is not null"))


@query(f"""WITH {BASE}, z AS (SELECT class, count(*) AS n FROM asg GROUP BY class), t AS (SELECT CAST(sum(n) AS BIGINT) AS entities, CAST(sum(n) FILTER (class <> 'Other') AS BIGINT) AS labeled, count(*) FILTER (class <> 'Other') AS n_classes FROM z)
  SELECT entities, labeled, labeled * 1.0 / entities AS coverage, n_classes, labeled * 1.0 / n_classes AS avg_class_size, (SELECT -sum(n * 1.0 / labeled * log2(n * 1.0 / labeled)) FROM z WHERE class <> 'Other') / log2(n_classes) AS entropy FROM t""")
def class_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return M.balance(assignments(spark, sf))


@query(f"""WITH {_VEC}, u AS (SELECT entity_type AS class, id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vec WHERE entity_type IS NOT NULL)
  SELECT a.class, count(DISTINCT a.id) AS n, coalesce(round(avg(list_dot_product(a.v, b.v)), 6), 1.0) AS coherence FROM u a LEFT JOIN u b ON a.class = b.class AND a.id <> b.id GROUP BY a.class""")
def class_coherence(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_vectors(spark, sf).where("entity_type is not null").select(F.col("entity_type").alias("class"), "v")
    return M.coherence(rows).withColumn("coherence", F.round("coherence", 6))


@query(f"""WITH {_VEC}, u AS (SELECT id, entity_type, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vec),
  s AS (SELECT class_of, k, sum(x) AS s FROM (SELECT entity_type AS class_of, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM u WHERE entity_type IS NOT NULL) GROUP BY class_of, k), c AS (SELECT class_of, list(s ORDER BY k) AS w FROM s GROUP BY class_of),
  b AS (SELECT u.id AS entity, max(list_cosine_similarity(u.v, c.w)) AS sim FROM u, c GROUP BY u.id)
  SELECT count(*) FILTER (sim >= 0.58) AS "full", count(*) FILTER (sim >= 0.42 AND sim < 0.58) AS half, count(*) FILTER (sim < 0.42) AS none, avg(CASE WHEN sim >= 0.58 THEN 1.0 WHEN sim >= 0.42 THEN 0.5 ELSE 0 END) AS score FROM b""")
def entity_assignment(spark: SparkSession, sf: str) -> DataFrame:
    # A reference class is an entity type's mean direction over all its vectors; every usable vector is scored.
    u = unit_vectors(spark, sf)
    classes = M.centroids(u.where("entity_type is not null").select(F.col("entity_type").alias("class_of"), "v"))
    return M.member_assignment(M.best_centroid(u, classes))


@query("SELECT metric, run, value, value - (SELECT value FROM (SELECT split_method AS run, avg(split_score) AS value FROM taxonomy_nodes WHERE split_method <> '' GROUP BY 1) WHERE run = 'macro') AS delta FROM (SELECT 'mean_split_score' AS metric, split_method AS run, avg(split_score) AS value FROM taxonomy_nodes WHERE split_method <> '' GROUP BY 2)")
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "taxonomy_nodes").where("split_method <> ''").groupBy(F.lit("mean_split_score").alias("metric"), F.col("split_method").alias("run")).agg(F.avg("split_score").alias("value"))
    return M.compare_runs(m, "macro")


# Questions over the graph, in the forms that property-graph queries take.


@query(f"WITH {BASE} SELECT DISTINCT id FROM ents WHERE contains(lower(id), 'flood') OR contains(lower(id), 'basement')")
def q_node_scan(spark: SparkSession, sf: str) -> DataFrame:
    i = F.lower("id")
    return _ids(spark, sf).where(i.contains("flood") | i.contains("basement")).distinct()


@query(f"WITH {BASE} SELECT rel, count(*) AS n FROM edges WHERE contains(rel, 'HAS') AND contains(rel, 'DATE') GROUP BY rel")
def q_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).where(F.col("rel").contains("HAS") & F.col("rel").contains("DATE")).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT rel, count(*) AS n, count(DISTINCT dst) AS targets FROM edges GROUP BY rel ORDER BY n DESC, rel LIMIT 10")
def q_top_relations(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("targets")).orderBy(F.desc("n"), "rel").limit(10)


@query(rf"WITH {BASE}, t AS (SELECT src, TRY_CAST(regexp_replace(dst, '[,$]', '', 'g') AS DOUBLE) AS amount FROM edges WHERE rel = 'HAS_TOTAL_BUILDING_INSURANCE_COVERAGE') SELECT src, amount FROM t WHERE amount IS NOT NULL ORDER BY amount DESC, src LIMIT 10")
def q_largest_amounts(spark: SparkSession, sf: str) -> DataFrame:
    t = edges(spark, sf).where("rel = 'HAS_TOTAL_BUILDING_INSURANCE_COVERAGE'").select("src", F.trim(F.regexp_replace("dst", "[,$]", "")).try_cast("double").alias("amount"))
    return t.where("amount is not null").orderBy(F.desc("amount"), "src").limit(10)


@query(f"WITH {BASE} SELECT a.dst AS shared, count(*) AS pairs FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.rel = 'HAS_REPORTED_ZIP_CODE' AND b.rel = 'HAS_REPORTED_ZIP_CODE' AND starts_with(a.src, 'POL-') AND starts_with(b.src, 'CLM-') GROUP BY a.dst")
def q_shared_values(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("rel = 'HAS_REPORTED_ZIP_CODE'")
    # Pairs per value are a product of two counts; the pairs themselves need not arise.
    per = e.groupBy("dst").agg(F.count(F.when(F.col("src").startswith("POL-"), 1)).alias("p"), F.count(F.when(F.col("src").startswith("CLM-"), 1)).alias("c"))
    return per.where("p > 0 and c > 0").select(F.col("dst").alias("shared"), (F.col("p") * F.col("c")).alias("pairs"))


@query(f"WITH {BASE} SELECT x.entity_type AS source_type, y.entity_type AS target_type, count(*) AS n FROM edges JOIN ents x ON x.id = src JOIN ents y ON y.id = dst WHERE x.entity_type <> y.entity_type GROUP BY ALL")
def q_type_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf)
    both = edges(spark, sf).join(e.select(F.col("id").alias("src"), F.col("entity_type").alias("source_type")), "src").join(e.select(F.col("id").alias("dst"), F.col("entity_type").alias("target_type")), "dst")
    return both.where("source_type <> target_type").groupBy("source_type", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT r.id, z.dst AS zone, c.dst AS city FROM lanes r LEFT JOIN (SELECT src, min(dst) AS dst FROM edges WHERE rel = 'HAS_RATED_FLOOD_ZONE' GROUP BY src) z ON z.src = r.id LEFT JOIN (SELECT src, min(dst) AS dst FROM edges WHERE rel = 'HAS_REPORTED_CITY' GROUP BY src) c ON c.src = r.id WHERE lane = 'record'")
def q_optional_chain(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)

    def one(rel: str, name: str) -> DataFrame:
        return e.where(F.col("rel") == rel).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias(name))

    return entities(spark, sf).where("lane = 'record'").select("id").join(one("HAS_RATED_FLOOD_ZONE", "zone"), "id", "left").join(one("HAS_REPORTED_CITY", "city"), "id", "left")


@query(rf"WITH {BASE} SELECT z.dst AS zone, round(avg(TRY_CAST(regexp_replace(p.dst, '[,$]', '', 'g') AS DOUBLE)), 4) AS mean FROM edges z JOIN edges p ON p.src = z.src WHERE z.rel = 'HAS_RATED_FLOOD_ZONE' AND p.rel = 'HAS_TOTAL_INSURANCE_PREMIUM' GROUP BY z.dst")
def q_star_average(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    z, p = e.where("rel = 'HAS_RATED_FLOOD_ZONE'").select("src", F.col("dst").alias("zone")), e.where("rel = 'HAS_TOTAL_INSURANCE_PREMIUM'").select("src", F.trim(F.regexp_replace("dst", "[,$]", "")).try_cast("double").alias("x"))
    return z.join(p, "src").groupBy("zone").agg(F.round(F.avg("x"), 4).alias("mean"))


@query(f"WITH {BASE} SELECT class, count(*) AS n, count(DISTINCT rel) AS relations FROM asg LEFT JOIN edges ON src = entity_id GROUP BY class")
def q_class_rollup(spark: SparkSession, sf: str) -> DataFrame:
    a = assignments(spark, sf).join(edges(spark, sf).select(F.col("src").alias("entity_id"), "rel"), "entity_id", "left")
    return a.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rel").alias("relations"))


@query("SELECT child, parent, count(*) AS n FROM class_hierarchy WHERE edge_type = 'SUBCLASS_OF' GROUP BY child, parent")
def q_subclass_listing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "class_hierarchy").where("edge_type = 'SUBCLASS_OF'").groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT entity_type, count(*) AS n FROM ents WHERE (entity_type IS NULL OR entity_type IN ('Unknown', 'Concept', 'Clause')) AND length(id) > 20 GROUP BY entity_type")
def q_null_in_size(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).where("(entity_type is null or entity_type in ('Unknown', 'Concept', 'Clause')) and length(id) > 20").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT substr(object, 1, 4) AS year, count(*) AS n FROM sampled_triples WHERE relation = 'HAS_DATE_OF_LOSS' AND starts_with(object, '20') AND regexp_matches(object, '^\d{4}-') GROUP BY 1")
def q_date_histogram(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf).where("relation = 'HAS_DATE_OF_LOSS'").where(F.col("object").startswith("20") & F.col("object").rlike(r"^\d{4}-"))
    return t.groupBy(F.substring("object", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT x AS label, count(*) AS n FROM (SELECT unnest([entity_type, lane]) AS x FROM lanes) GROUP BY x")
def q_unwind_labels(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).select(F.explode(F.array("entity_type", "lane")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
