"""Queries of the ontology operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology as O
from .graph_queries import CLASSES, EDGES, ENDS, ENTITIES, LANE, assignments, edges, entities
from .registry import contains_sql, quoted, registry
from .tables import table

QUERIES, SQL, query = registry()

BASE = f"{ENDS}, {EDGES}, {ENTITIES}, lanes AS (SELECT id, entity_type, {LANE} AS lane FROM ents), {CLASSES}"


@query(f"""WITH {BASE}, r AS (SELECT id, split_part(id, '-', 1) || '-' AS prefix FROM lanes WHERE lane = 'record'), s AS (SELECT prefix, count(*) AS n FROM r GROUP BY prefix),
  u AS (SELECT prefix, rel AS relation, count(DISTINCT src) AS members FROM edges JOIN r ON r.id = src WHERE rel <> 'IS_A' GROUP BY prefix, rel)
  SELECT prefix, n, relation, members, rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY members DESC, relation) AS rank FROM u) JOIN s USING (prefix) WHERE rank <= 4""")
def record_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return O.record_evidence(entities(spark, sf), edges(spark, sf))


_R = "lower(replace(rel, '_', ' '))"


@query(f"""WITH {BASE}, h AS (SELECT dst AS id, bool_or({contains_sql(_R, O.PLACES)}) AS p, bool_or({contains_sql(_R, O.MONEY)}) AS m FROM edges GROUP BY dst)
  SELECT count(*) FILTER (p) AS places, count(*) FILTER (m) AS money FROM lanes JOIN h USING (id) WHERE lane = 'value'""")
def value_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return O.value_evidence(entities(spark, sf), edges(spark, sf))


_FEATURES = """f0 AS (SELECT id, feature, CAST(count(*) AS DOUBLE) AS x FROM (SELECT src AS id, rel || '_OUT' AS feature FROM edges UNION ALL SELECT dst, rel || '_IN' FROM edges) GROUP BY ALL UNION ALL SELECT id, 'type_' || entity_type, 1.0 FROM lanes),
  nrm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM f0 GROUP BY id), feat AS (SELECT id, feature, x / norm AS value FROM f0 JOIN nrm USING (id))"""
_CENT = """m AS (SELECT class, id, feature, value FROM feat JOIN asg ON entity_id = id WHERE class <> 'Other'), su AS (SELECT class, feature, sum(value) AS s FROM m GROUP BY ALL),
  nc AS (SELECT class, sqrt(sum(s * s)) AS norm FROM su GROUP BY class), cent AS (SELECT class, feature, s / norm AS weight FROM su JOIN nc USING (class)),
  sim AS (SELECT id, class, sum(value * weight) AS sim FROM feat JOIN cent USING (feature) GROUP BY id, class)"""


@query(f"WITH {BASE}, {_FEATURES} SELECT id, feature, round(value, 9) AS value FROM feat")
def structural_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return O.signatures(entities(spark, sf), edges(spark, sf)).withColumn("value", F.round("value", 9))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return O.signatures(entities(spark, sf), edges(spark, sf))


@query(f"""WITH {BASE}, {_FEATURES}, {_CENT}, own AS (SELECT sim.id, sim.class, sim FROM sim JOIN asg ON entity_id = id AND asg.class = sim.class),
  st AS (SELECT class, avg(sim) AS mean, stddev_pop(sim) AS std FROM own GROUP BY class), fl AS (SELECT id, class, sim, mean, std FROM own JOIN st USING (class) WHERE sim < mean - 2.0 * greatest(std, 0.05)),
  alt AS (SELECT sim.id, sim.class AS nearest_class, sim.sim AS nearest_sim, row_number() OVER (PARTITION BY sim.id ORDER BY round(sim.sim, 9) DESC, sim.class) AS r FROM sim JOIN fl ON fl.id = sim.id AND fl.class <> sim.class)
  SELECT fl.id AS entity_id, class, round(sim, 6) AS sim, nearest_class FROM fl LEFT JOIN alt ON alt.id = fl.id AND r = 1""")
def class_centroid_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return O.structural_outliers(_features(spark, sf), assignments(spark, sf)).select("entity_id", "class", F.round("sim", 6).alias("sim"), "nearest_class")


@query(f"""WITH {BASE}, {_FEATURES}, {_CENT}, sz AS (SELECT class, count(*) AS n FROM asg WHERE class <> 'Other' GROUP BY class),
  pr AS (SELECT a.class AS s, b.class AS c, sum(a.weight * b.weight) AS sim FROM cent a JOIN cent b USING (feature) WHERE a.class IN (SELECT class FROM sz WHERE n < 200) AND b.class NOT IN (SELECT class FROM sz WHERE n < 200) GROUP BY ALL)
  SELECT s AS class, c AS merged_into FROM (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY round(sim, 9) DESC, c) AS r FROM pr) WHERE r = 1""")
def merge_small_classes(spark: SparkSession, sf: str) -> DataFrame:
    return O.merge_small_classes(_features(spark, sf), assignments(spark, sf), least=200)


_RC = """cnt AS (SELECT 'A' AS signal, rel AS relation, class, count(*) AS n FROM edges JOIN asg ON entity_id = dst WHERE class <> 'Other' GROUP BY ALL
    UNION ALL SELECT 'B', rel, class, count(*) FROM edges JOIN asg ON entity_id = src WHERE class <> 'Other' AND dst IN (SELECT id FROM lanes WHERE lane = 'value') GROUP BY ALL),
  bst AS (SELECT *, sum(n) OVER (PARTITION BY signal, relation) AS total, row_number() OVER (PARTITION BY signal, relation ORDER BY n DESC, class) AS r FROM cnt),
  rc AS (SELECT signal, relation, class, n / total AS confidence FROM bst WHERE r = 1 AND total >= 2 AND n / total >= 0.5)"""


@query(f"WITH {BASE}, {_RC} SELECT * FROM rc")
def value_class_signals(spark: SparkSession, sf: str) -> DataFrame:
    return O.relation_classes(edges(spark, sf), assignments(spark, sf), entities(spark, sf))


@query(f"""WITH {BASE}, {_RC}, op AS (SELECT id FROM lanes WHERE lane = 'value' AND id NOT IN (SELECT entity_id FROM asg WHERE class <> 'Other')),
  sc AS (SELECT id, signal, class, sum(n * confidence) AS e FROM (SELECT dst AS id, rel AS relation, count(*) AS n FROM edges GROUP BY ALL) JOIN op USING (id) JOIN rc USING (relation) GROUP BY ALL),
  fs AS (SELECT * FROM sc WHERE signal = (SELECT min(signal) FROM sc s WHERE s.id = sc.id)), rk AS (SELECT *, sum(e) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY round(e, 9) DESC, class) AS r FROM fs)
  SELECT id AS entity_id, class, signal FROM rk WHERE r = 1 AND e / total >= 0.5""")
def value_typing(spark: SparkSession, sf: str) -> DataFrame:
    return O.type_values(edges(spark, sf), assignments(spark, sf), entities(spark, sf))


_AFTER = "aft AS (SELECT entity_id, CASE class WHEN 'Clause' THEN 'Condition' WHEN 'Agent' THEN CASE WHEN length(entity_id) % 2 = 0 THEN 'Organization' ELSE 'Person' END ELSE class END AS class FROM asg)"


def _after(a: DataFrame) -> DataFrame:
    return a.withColumn("class", F.when(F.col("class") == "Clause", "Condition").when(F.col("class") == "Agent", F.when(F.length("entity_id") % 2 == 0, "Organization").otherwise("Person")).otherwise(F.col("class")))


@query(f"WITH {BASE}, {_AFTER} SELECT class, min(new) AS new_class FROM (SELECT DISTINCT a.class, b.class AS new FROM asg a JOIN aft b USING (entity_id) WHERE a.class <> b.class AND a.class <> 'Other') GROUP BY class HAVING count(*) = 1")
def class_remaps(spark: SparkSession, sf: str) -> DataFrame:
    a = assignments(spark, sf)
    return O.remaps(a, _after(a)).select("class", "new_class")


_DEF = f"""sz AS (SELECT class, count(*) AS n FROM asg WHERE class <> 'Other' GROUP BY class), k AS (SELECT class, relation, count(*) AS k FROM (SELECT src AS entity_id, rel AS relation FROM edges UNION ALL SELECT dst, '~' || rel FROM edges) JOIN asg USING (entity_id) WHERE class <> 'Other' GROUP BY ALL),
  def AS (SELECT class, relation FROM k JOIN sz USING (class) WHERE k >= greatest(2, floor(n * 0.3)) AND relation NOT IN ({quoted(O.GENERIC)}))"""


@query(f"WITH {BASE}, {_DEF} SELECT * FROM def")
def defining_relations(spark: SparkSession, sf: str) -> DataFrame:
    return O.defining_relations(edges(spark, sf), assignments(spark, sf))


@query(f"""WITH {BASE}, {_DEF}, q AS (SELECT *, count(*) OVER (PARTITION BY class) AS n FROM def)
  SELECT c.class AS child, p.class AS parent, count(*) * 1.0 / c.n AS inclusion FROM q c JOIN q p USING (relation) WHERE c.class <> p.class AND c.n >= 2 AND p.n >= 2 AND c.n < p.n GROUP BY c.class, p.class, c.n HAVING count(*) * 1.0 / c.n >= 0.8""")
def taxonomy_subsumption(spark: SparkSession, sf: str) -> DataFrame:
    return O.subsumption_candidates(O.defining_relations(edges(spark, sf), assignments(spark, sf)))


_VOTES = "votes AS (SELECT run_id, edge_id AS seq, lower(trim(child, ' ')) AS child, lower(trim(parent, ' ')) AS parent, source, trusted FROM class_hierarchy)"
_CONS = "cons AS (SELECT run_id, child, parent, bool_or(coalesce(trusted, false)) AS trusted, count(DISTINCT CASE WHEN NOT coalesce(trusted, false) THEN coalesce(source, 'none') END) AS weak FROM votes WHERE child <> parent GROUP BY ALL HAVING bool_or(coalesce(trusted, false)) OR count(DISTINCT CASE WHEN NOT coalesce(trusted, false) THEN coalesce(source, 'none') END) >= 2)"


def _run_votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "class_hierarchy").select("run_id", F.col("edge_id").alias("seq"), F.lower(F.trim("child")).alias("child"), F.lower(F.trim("parent")).alias("parent"), "source", "trusted")


@query(f"WITH {_VOTES}, {_CONS} SELECT * FROM cons")
def consensus_edges(spark: SparkSession, sf: str) -> DataFrame:
    return O.consensus(_run_votes(spark, sf), ("run_id",))


@query()
def hierarchy_tree(spark: SparkSession, sf: str) -> DataFrame:
    return O.enforce_tree(consensus_edges(spark, sf), keys=("run_id",))


@query()
def acyclic_edges(spark: SparkSession, sf: str) -> DataFrame:
    return O.acyclic_first(_run_votes(spark, sf), ("run_id",))


@query(f"""WITH {BASE}, sz AS (SELECT class, count(*) AS n FROM asg WHERE class <> 'Other' GROUP BY class), pr AS (SELECT a.class AS cs, b.class AS cd, count(*) AS k FROM edges JOIN asg a ON a.entity_id = src JOIN asg b ON b.entity_id = dst WHERE a.class <> 'Other' AND b.class <> 'Other' AND a.class <> b.class GROUP BY ALL),
  st AS (SELECT cs, cd, k FROM pr JOIN sz x ON x.class = cs JOIN sz y ON y.class = cd WHERE k >= greatest(3, floor(least(x.n, y.n) * 0.05)))
  SELECT cs AS source_class, cd AS target_class, k AS n FROM (SELECT *, row_number() OVER (PARTITION BY least(cs, cd), greatest(cs, cd) ORDER BY k DESC, cs) AS r FROM st) WHERE r = 1""")
def interclass_edges(spark: SparkSession, sf: str) -> DataFrame:
    return O.interclass_edges(edges(spark, sf), assignments(spark, sf))


_PROV = """prov AS (SELECT b.entity_id, b.class AS final_type, b.entity_id IN (SELECT entity_id FROM flag) AS flagged, CASE WHEN a.class <> b.class THEN a.class END AS was FROM aft b JOIN asg a USING (entity_id)),
  conf AS (SELECT *, CASE WHEN final_type = 'Other' THEN 0.3 WHEN flagged THEN 0.7 WHEN was IS NOT NULL THEN 0.8 ELSE 1.0 END AS confidence FROM prov)"""
_FLAG = "flag AS (SELECT entity_id FROM asg WHERE length(entity_id) % 11 = 0)"


def _provenance(spark: SparkSession, sf: str) -> DataFrame:
    a = assignments(spark, sf)
    return O.provenance(_after(a), a.where(F.length("entity_id") % 11 == 0), before=a)


@query(f"WITH {BASE}, {_AFTER}, {_FLAG}, {_PROV} SELECT final_type, count(*) AS n, count(*) FILTER (flagged) AS flagged, 0 AS arbitrated, count(was) AS consolidated, count(*) FILTER (confidence < 0.5) AS low_confidence FROM conf GROUP BY final_type")
def provenance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return O.provenance_summary(_provenance(spark, sf))


@query(f"WITH {BASE}, {_AFTER}, {_FLAG}, {_PROV} SELECT entity_id, final_type AS was, class AS should_be FROM conf JOIN asg USING (entity_id) WHERE final_type <> class ORDER BY confidence DESC, entity_id LIMIT 20")
def corrections(spark: SparkSession, sf: str) -> DataFrame:
    return O.corrections(_provenance(spark, sf), assignments(spark, sf))
