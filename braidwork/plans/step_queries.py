"""Queries of the steps that ask a model, over whole tables. The model is a client that answers by rules, which SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..models import LineClient, RuleClient
from ..operators import model_steps as M
from ..operators import normalize as N
from ..operators import ontology as O
from .cluster_queries import _HEADERS, _headers
from .graph_queries import assignments, edges, entities, triples
from .ontology_queries import _CENT, _FEATURES, BASE
from .registry import quoted, registry
from .tables import table

QUERIES, SQL, query = registry()

VOCABULARY = ["PolicyRecord", "ClaimRecord", "SurveyRecord", "Coverage", "Exclusion", "Clause", "Organization"]
_RULES = [("(?i)exclu", "Exclusion"), ("(?i)cover", "Coverage"), ("(?i)clause|condition", "Clause")]


def _cases(c: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{a}'" for p, a in rules) + f" ELSE {otherwise} END"


_KNOWN = "CASE lower(entity_type) " + " ".join(f"WHEN '{v.lower()}' THEN '{v}'" for v in VOCABULARY) + " END"


@query(f"WITH {BASE} SELECT id AS entity_id, coalesce(CASE lane WHEN 'record' THEN {_KNOWN} WHEN 'concept' THEN {_cases(chr(39) + chr(39) + ' || id || ' + chr(39) + ' : ' + chr(39) + ' || entity_type', _RULES, 'NULL')} END, 'Other') AS class FROM lanes")
def model_types(spark: SparkSession, sf: str) -> DataFrame:
    return M.type_entities(entities(spark, sf), VOCABULARY, LineClient(_RULES))


_TYPE_WORDS = ["Policy", "Claim", "Organization", "Exclusion", "Conversation"]
_LOW = "regexp_replace(lower(entity_type), 'record$', '')"
_TYPE_MAP = f"""types AS (SELECT DISTINCT entity_type FROM ents WHERE entity_type IS NOT NULL), v AS (SELECT unnest([{quoted(_TYPE_WORDS)}]) AS v),
  part AS (SELECT entity_type, min(lower(v)) AS k FROM types JOIN v ON {_LOW} <> '' AND (contains(lower(v), {_LOW}) OR contains({_LOW}, lower(v))) GROUP BY entity_type),
  tmap AS (SELECT entity_type, coalesce((SELECT v FROM v WHERE lower(v) = {_LOW}), (SELECT v FROM v WHERE lower(v) = lower(entity_type)), CASE WHEN contains(lower(entity_type), 'chat') THEN 'Conversation' END, (SELECT v FROM v WHERE lower(v) = k), 'Other') AS class FROM types LEFT JOIN part USING (entity_type))"""


def _type_map(spark: SparkSession, sf: str) -> DataFrame:
    client = RuleClient([("(?i)record type chat", "conversation")], "none")
    return M.record_type_classes(entities(spark, sf), _TYPE_WORDS, client)


@query(f"WITH {BASE}, {_TYPE_MAP} SELECT entity_type, class FROM tmap")
def record_type_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _type_map(spark, sf)


@query(f"WITH {BASE}, {_TYPE_MAP} SELECT id AS entity_id, class FROM lanes JOIN tmap USING (entity_type) WHERE lane = 'record'")
def records_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Record entities with the class of their type."""
    records = entities(spark, sf).where("lane = 'record'").select(F.col("id").alias("entity_id"), "entity_type")
    return N.map_types(records, _type_map(spark, sf))


_PROPOSED = ["Flood Policy", "Damage", "coverage", "Other", "Waiver"]


@query(f"""WITH {BASE}, n AS (SELECT entity_type AS name, count(*) AS n FROM ents GROUP BY entity_type HAVING count(*) >= 10), a AS (SELECT unnest([{quoted(_PROPOSED)}]) AS name, 0 AS o UNION ALL SELECT name, 1 FROM n WHERE name <> '')
  SELECT name FROM (SELECT trim(name) AS name, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY o) AS r FROM a WHERE lower(trim(name)) NOT IN ('other', 'entity', 'thing', 'value')) WHERE r = 1""")
def class_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    support = entities(spark, sf).groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    names = M.propose_classes(support, RuleClient([("Propose", '["Flood Policy", "Damage", "coverage", "Other", "Waiver"]')]))
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(f"""WITH {BASE}, z AS (SELECT class, count(*) AS n FROM asg WHERE class <> 'Other' GROUP BY class), mega AS (SELECT class FROM z WHERE n > 0.4 * (SELECT sum(n) FROM z) AND n >= 50)
  SELECT entity_id, CASE WHEN class IN (SELECT class FROM mega) AND regexp_matches(entity_id, '[0-7]$') THEN 'Early' WHEN class IN (SELECT class FROM mega) AND regexp_matches(entity_id, '[89a-f]$') THEN 'Late' ELSE class END AS class FROM asg""")
def rebalanced_classes(spark: SparkSession, sf: str) -> DataFrame:
    return M.rebalance(assignments(spark, sf), LineClient([("[0-7]$", "Early"), ("[89a-f]$", "Late")], tasks=[("^Split the class", '["Early", "Late"]')]))


@query(f"""WITH {BASE}, c AS (SELECT asg.* FROM asg JOIN lanes ON id = entity_id WHERE lane = 'concept'), o AS (SELECT count(*) AS n, count(*) FILTER (class = 'Other') AS o FROM c)
  SELECT entity_id, CASE WHEN class = 'Other' AND entity_id IN (SELECT entity_id FROM c) AND (SELECT o > 0.01 * n FROM o) THEN {_cases('entity_id', [('(?i)flood', 'Coverage'), ('(?i)basement', 'Exclusion')], 'class')} ELSE class END AS class FROM asg""")
def rescued_entities(spark: SparkSession, sf: str) -> DataFrame:
    concepts = entities(spark, sf).where("lane = 'concept'").select(F.col("id").alias("entity_id"))
    return M.rescue_other(assignments(spark, sf), concepts, LineClient([("(?i)flood", "Coverage"), ("(?i)basement", "Exclusion")]), least=0.01)


@query(f"""WITH {BASE}, {_FEATURES}, {_CENT}, own AS (SELECT sim.id, sim.class, sim FROM sim JOIN asg ON entity_id = id AND asg.class = sim.class),
  st AS (SELECT class, avg(sim) AS mean, stddev_pop(sim) AS std FROM own GROUP BY class), fl AS (SELECT id, class FROM own JOIN st USING (class) WHERE sim < mean - 2.0 * greatest(std, 0.05)),
  alt AS (SELECT sim.id, sim.class AS nearest, row_number() OVER (PARTITION BY sim.id ORDER BY round(sim.sim, 9) DESC, sim.class) AS r FROM sim JOIN fl ON fl.id = sim.id AND fl.class <> sim.class)
  SELECT fl.id AS entity_id, CASE WHEN regexp_matches(fl.id, '^[A-Ma-m]') THEN coalesce(nearest, 'Other') ELSE class END AS class FROM fl LEFT JOIN alt ON alt.id = fl.id AND r = 1""")
def arbitrated_classes(spark: SparkSession, sf: str) -> DataFrame:
    flagged = O.structural_outliers(O.signatures(entities(spark, sf), edges(spark, sf)), assignments(spark, sf))
    return M.arbitrate(flagged, LineClient([("^[A-Ma-m]", lambda line: line.rsplit(" or ", 1)[1])]))


_CLASS_PAIRS = "k AS (SELECT DISTINCT class FROM asg WHERE class <> 'Other'), pr AS (SELECT a.class AS a, b.class AS b FROM k a JOIN k b ON a.class < b.class AND right(a.class, 6) = right(b.class, 6))"


@query(f"WITH {BASE}, {_CLASS_PAIRS} SELECT DISTINCT CASE WHEN length(a) < length(b) THEN b ELSE a END AS child, CASE WHEN length(a) < length(b) THEN a ELSE b END AS parent FROM pr")
def class_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Classes whose names end alike, the shorter name above the longer one."""
    k = assignments(spark, sf).where("class <> 'Other'").select("class").distinct().withColumn("e", F.right("class", F.lit(6)))
    pairs = k.select(F.col("class").alias("a"), "e").join(k.select(F.col("class").alias("b"), "e"), "e").select("a", "b", F.lit(0.5).alias("sim"))

    def shorter(prompt: str) -> str:
        a, b = prompt.split(": ")[0].removeprefix("Relation of the classes ").split(" and ")
        return "parent" if len(a) < len(b) else "child"

    return M.class_relations(pairs, RuleClient([("Relation", shorter)]))[1]


@query(f"""WITH {BASE}, o AS (SELECT src, count(DISTINCT rel) AS k FROM edges GROUP BY src), r AS (SELECT class, count(DISTINCT rel) AS relations FROM edges JOIN asg ON entity_id = src GROUP BY class),
  p AS (SELECT class, count(*) AS members, avg(CASE WHEN k IS NULL THEN 1.0 ELSE 0 END) AS leaves, count(*) FILTER (lane = 'record') AS records FROM asg JOIN lanes ON id = entity_id LEFT JOIN o ON src = id WHERE class <> 'Other' GROUP BY class)
  SELECT class, 'Thing' AS parent FROM p LEFT JOIN r USING (class) WHERE members <= 100 AND records = 0 AND ((members < 50 AND leaves > 0.7 AND coalesce(relations, 0) < 4) OR starts_with(class, 'C'))""")
def leaf_merges(spark: SparkSession, sf: str) -> DataFrame:
    e, a = edges(spark, sf), assignments(spark, sf).where("class <> 'Other'")
    out = e.select(F.col("src").alias("entity_id"), F.lit(1).alias("has")).distinct()
    rels = e.select(F.col("src").alias("entity_id"), "rel").join(a, "entity_id").groupBy("class").agg(F.count_distinct("rel").alias("relations"))
    rows = a.join(entities(spark, sf).select(F.col("id").alias("entity_id"), "lane"), "entity_id").join(out, "entity_id", "left")
    p = rows.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.avg(F.col("has").isNull().cast("double")).alias("leaf_share"), F.count(F.when(F.col("lane") == "record", 1)).alias("records"))
    p = p.join(rels, "class", "left").withColumn("relations", F.coalesce("relations", F.lit(0))).withColumn("parent", F.lit("Thing"))
    return M.leaf_merges(p, RuleClient([("the class C", "merge")], "keep"))


@query(f"WITH {BASE}, k AS (SELECT DISTINCT class FROM asg WHERE class <> 'Other') SELECT a.class AS child, b.class AS parent FROM k a JOIN k b ON a.class <> b.class WHERE right(a.class, 6) = right(b.class, 6) AND a.class < b.class")
def pairwise_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    classes = assignments(spark, sf).where("class <> 'Other'").groupBy("class").agg(F.count(F.lit(1)).alias("n"))

    def alike(prompt: str) -> str:
        a, b = prompt.removeprefix("Is every ").split("? ")[0].split(" a ")
        return "yes" if a[-6:] == b[-6:] and a < b else "no"

    return M.pairwise_taxonomy(classes, RuleClient([("Is every", alike)]))


@query("""WITH m AS (SELECT entity_type AS cluster, split_part(split_part(min(id), ', ', 1), ' ', 1) AS first FROM entity_embeddings WHERE entity_type IS NOT NULL GROUP BY 1), n AS (SELECT cluster, CASE WHEN trim(first) = '' THEN 'Cluster' ELSE trim(first) END AS name FROM m)
  SELECT cluster, name || CASE WHEN k > 1 THEN CAST(k AS VARCHAR) ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cluster) AS k FROM n)""")
def cluster_names(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "entity_embeddings").where("entity_type is not null and id is not null").select(F.col("entity_type").alias("cluster"), F.col("id").alias("member"))
    return M.name_clusters(members, RuleClient([("Name the class of: ", lambda p: p.split(": ", 1)[1].split(", ")[0].split(" ")[0])]))


@query(f"WITH {_HEADERS} SELECT DISTINCT header, CASE WHEN regexp_matches(header, '^[A-Z]{{1,12}}$') THEN 'the ' || lower(header) ELSE header END AS name FROM heads")
def expanded_headers(spark: SparkSession, sf: str) -> DataFrame:
    return M.expand_headers(_headers(spark, sf), LineClient([("", lambda line: "the " + line.lower())]))


_RELATION_RULES = [("(?i)cover", "COVERS"), ("(?i)exclu", "EXCLUDED_FROM"), ("(?i)requir", "REQUIRES")]


@query(f"SELECT relation, {_cases('relation', _RELATION_RULES, 'NULL')} AS canonical FROM (SELECT DISTINCT relation FROM sampled_triples WHERE relation IS NOT NULL AND (source_type IS NULL OR source_type <> 'structured')) WHERE canonical IS NOT NULL AND canonical <> relation")
def canonical_relations(spark: SparkSession, sf: str) -> DataFrame:
    return M.canonical_relations(triples(spark, sf), [a for _, a in _RELATION_RULES], LineClient(_RELATION_RULES))


_WORDS_OF = r"regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\s]+', ' ', 'g')"


@query(rf"SELECT DISTINCT name, trim(lower({_WORDS_OF}), ' ') AS human, lower(name) AS low, CASE WHEN length(name) > 3 AND ends_with(lower(name), 's') THEN left(lower(name), length(name) - 1) ELSE lower(name) END AS token FROM taxonomy_nodes WHERE name IS NOT NULL")
def label_forms(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return table(spark, sf, "taxonomy_nodes").select("name").where("name is not null").distinct().select("name", T.humanize_label(n).alias("human"), F.lower(n).alias("low"), T.normalize_token(n).alias("token"))


@query(r"SELECT DISTINCT relation, array_to_string(list_transform(list_filter(string_split_regex(relation, '[_\-\s]+'), lambda w: true), lambda w: upper(w[1]) || lower(w[2:])), '') AS pascal, regexp_replace(relation, '[^A-Za-z0-9]', '', 'g') AS label FROM sampled_triples WHERE relation IS NOT NULL")
def relation_labels(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("relation")
    return triples(spark, sf).select("relation").where("relation is not null").distinct().select("relation", T.pascal_case(r).alias("pascal"), F.regexp_replace(r, "[^A-Za-z0-9]", "").alias("label"))
