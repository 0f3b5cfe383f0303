"""Queries of the normalization, resolution, linkage and graph operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as Fl
from ..operators import graph as G
from ..operators import linkage as L
from ..operators import normalize as N
from ..operators import resolution as Re
from ..operators import wide as Wd
from ..session import materialize
from .core_queries import CELLS
from .registry import contains_sql, quoted, registry
from .tables import table

QUERIES, SQL, query = registry()


def line_end(regex: str) -> str:
    """A pattern whose "$" may stand before a last line break, as it does in Spark."""
    return re.sub(r"(?<!\\)\$", r"\\n?$", regex)



def triples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sampled_triples").select("seq", "subject", "subject_type", "relation", "object", "object_type", "span", "confidence", "chunk_id", "source", "source_type")


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Fl.SYNONYMS.items())
_PATTERN = "CASE WHEN {0} LIKE 'EXCLUDES\\_%' ESCAPE '\\' THEN 'EXCLUDED_FROM' WHEN {0} LIKE 'COVERS\\_%' ESCAPE '\\' AND length({0}) > 8 THEN 'COVERS' WHEN {0} LIKE 'PROVIDES\\_%' ESCAPE '\\' AND (contains({0}, 'COVERAGE') OR contains({0}, 'INSURANCE') OR contains({0}, 'PROTECTION')) THEN 'COVERS' ELSE {0} END"


@query(f"""WITH a AS (SELECT relation, regexp_replace(trim(upper(relation)), '[^A-Z0-9_]', '_', 'g') AS r FROM sampled_triples), b AS (SELECT relation, CASE r {_MAP} ELSE r END AS r FROM a), c AS (SELECT relation, CASE r {_MAP} ELSE r END AS r FROM b)
  SELECT relation, {_PATTERN.format('r')} AS canonical, count(*) AS n FROM c GROUP BY ALL""")
def relation_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return counted(triples(spark, sf).select("relation", N.normalize_relation(F.col("relation")).alias("canonical")), "relation", "canonical")


def _name_similarity(t: DataFrame) -> DataFrame:
    """Share of content words that two relation names have in common; pairs that share none do not arise."""
    words = t.select("relation").where(F.col("relation").startswith("HAS_")).distinct().select("relation", F.explode(N.content_tokens(F.col("relation"))).alias("w"))
    sizes = counted(words, "relation")
    a, b = words.select(F.col("relation").alias("a"), "w"), words.select(F.col("relation").alias("b"), "w")
    both = a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    both = both.join(sizes.select(F.col("relation").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("relation").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("sim"))


@query()
def relation_merges(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf)
    return N.relation_merges(t, _name_similarity(t), 0.6)


@query()
def relations_merged(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf)
    return counted(N.apply_relation_map(t, N.relation_merges(t, _name_similarity(t), 0.6)), "relation")


_LITERAL = rf"""(CASE WHEN coalesce(object_type, 'Unknown') IN ({quoted(N.ENTITY_TYPES)}) THEN false WHEN coalesce(object_type, 'Unknown') IN ({quoted(N.VALUE_TYPES)}) THEN true
  ELSE regexp_matches(object, '{line_end(r"^\$[\d,]+\.?\d*$|^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{2,4}$|^\d{4}$|^-?[\d,]+\.?\d*%?$|^[A-Z0-9]{1,5}$")}') OR lower(object) IN ({quoted(N.VALUE_WORDS)}) END)"""
_ROLES = rf"""cand AS (SELECT * FROM sampled_triples WHERE starts_with(relation, 'HAS_') AND relation NOT IN ({quoted(N.ENTITY_RELATIONS)}) AND object IS NOT NULL AND {_LITERAL}),
  num AS (SELECT *, regexp_matches(replace(replace(object, '$', ''), ',', ''), '^-?[\d,]+\.?\d*%?\n?$') AS num, length(regexp_replace(object, '[$,.\-]', '', 'g')) > 8 AS long FROM cand),
  st AS (SELECT relation, count(*) AS total, count(DISTINCT object) AS n_values, count(*) FILTER (num) AS numeric, count(*) FILTER (num AND long) AS long_digits FROM num GROUP BY relation),
  roles AS (SELECT *, CASE WHEN numeric * 1.0 / total > 0.8 AND n_values * 1.0 / total > 0.5 AND n_values * 1.0 / total <= 0.95 AND (numeric = 0 OR long_digits * 1.0 / numeric < 0.5) THEN 'measure'
    WHEN total * 1.0 / n_values >= 2 AND n_values >= 2 THEN 'dimension' ELSE 'property' END AS role FROM st)"""


@query(f"WITH {_ROLES} SELECT relation, total, n_values, numeric, long_digits, role FROM roles")
def collapse_stats(spark: SparkSession, sf: str) -> DataFrame:
    return N.relation_roles(N.collapse_candidates(triples(spark, sf)))


@query(f"""WITH {_ROLES}, users AS (SELECT object, count(DISTINCT subject) AS u FROM cand GROUP BY object)
  SELECT subject, lower(regexp_replace(relation, '^HAS_', '')) AS property, max_by(object, seq) AS value FROM cand JOIN users USING (object) JOIN roles USING (relation)
  WHERE role = 'property' AND (u = 1 OR (u <= 3 AND length(object) <= 15)) GROUP BY 1, 2""")
def collapse_properties(spark: SparkSession, sf: str) -> DataFrame:
    return N.collapse(triples(spark, sf))[1]


@query("""WITH v AS (SELECT DISTINCT relation FROM relation_types), u AS (SELECT DISTINCT relation FROM sampled_triples WHERE relation IS NOT NULL)
  SELECT (SELECT count(*) FROM v) AS vocab_size, (SELECT count(*) FROM u) AS types_used, (SELECT count(*) FROM v JOIN u USING (relation)) AS vocab_used, (SELECT count(*) FROM v JOIN u USING (relation)) * 1.0 / (SELECT count(*) FROM v) AS utilization""")
def vocab_quality(spark: SparkSession, sf: str) -> DataFrame:
    return N.vocabulary_quality(triples(spark, sf), table(spark, sf, "relation_types"))


_PRE = "regexp_matches({0}, '^(POL|CLM|REC|PER|PROP)-')"


@query(f"""WITH e AS (SELECT subject AS id, coalesce(source_type = 'structured', false) OR {_PRE.format('subject')} AS o FROM sampled_triples UNION ALL SELECT object, coalesce(source_type = 'structured', false) OR {_PRE.format('object')} FROM sampled_triples),
  i AS (SELECT id, bool_or(o) AS o FROM e WHERE id IS NOT NULL GROUP BY id)
  SELECT id FROM i WHERE NOT o AND id NOT IN (SELECT object FROM sampled_triples WHERE starts_with(relation, 'HAS_') AND object IS NOT NULL AND subject IN (SELECT id FROM i WHERE o))""")
def resolution_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return Re.candidates(triples(spark, sf))


def usable_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, v, norm) of usable vectors as they are, with their length."""
    e = table(spark, sf, "entity_embeddings").where("size(embs) = 64").where(F.forall("embs", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embs", lambda x: x != 0))
    norm = F.sqrt(F.aggregate(F.transform("embs", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))
    return e.select(F.col("vec_id").alias("id"), F.col("embs").alias("v"), norm.alias("norm"), "entity_type")


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, v) of usable vectors scaled to length one."""
    # The norm is an array of its own: inside a lambda it would be computed once for every number.
    v = F.zip_with(F.transform("v", lambda x: x.cast("double")), F.array_repeat("norm", 64), F.try_divide)
    return usable_vectors(spark, sf).select("id", v.alias("v"), "entity_type")


_VEC = "vec AS (SELECT vec_id AS id, entity_type, CAST(embs AS DOUBLE[]) AS v FROM entity_embeddings WHERE len(embs) = 64 AND len(list_filter(embs, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embs, lambda x: x <> 0)) > 0)"


@query(f"""WITH {_VEC} SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9 - 1e-9""")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return Re.similar_pairs(usable_vectors(spark, sf).select("id", "v", "norm"), 0.9).select("a", "b")


_LINKS = "links AS (SELECT run_id || '|' || lower(trim(child)) AS a, run_id || '|' || lower(trim(parent)) AS b FROM class_hierarchy WHERE edge_type = 'SUBCLASS_OF')"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    def end(c: str):
        return F.concat("run_id", F.lit("|"), F.lower(F.trim(c)))

    return table(spark, sf, "class_hierarchy").where("edge_type = 'SUBCLASS_OF'").select(end("child").alias("a"), end("parent").alias("b"))


_CC = f"""WITH RECURSIVE {_LINKS}, both_ AS (SELECT DISTINCT a AS u, b AS v FROM links WHERE a <> b UNION SELECT DISTINCT b, a FROM links WHERE a <> b),
  r AS (SELECT u AS id, u AS c FROM both_ UNION SELECT both_.v, r.c FROM r JOIN both_ ON both_.u = r.id), comp AS (SELECT id, min(c) AS component FROM r GROUP BY id)"""


@query(_CC + " SELECT id, component FROM comp")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return Re.components(_links(spark, sf))


@query(_CC + " SELECT id, canonical FROM (SELECT id, first_value(id) OVER (PARTITION BY component ORDER BY length(id), id) AS canonical FROM comp) WHERE id <> canonical")
def canonical_election(spark: SparkSession, sf: str) -> DataFrame:
    return Re.elect(Re.components(_links(spark, sf)))


@query(r"""WITH m AS (SELECT id, canonical FROM (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY length(id), id) AS canonical FROM (SELECT id, lower(trim(id, ' ')) AS k FROM (SELECT subject AS id FROM sampled_triples UNION SELECT object FROM sampled_triples))) WHERE id <> canonical)
  SELECT seq, subject, object FROM (SELECT seq, coalesce(a.canonical, subject) AS subject, coalesce(b.canonical, object) AS object FROM sampled_triples t LEFT JOIN m a ON a.id = t.subject LEFT JOIN m b ON b.id = t.object) WHERE subject IS NULL OR object IS NULL OR subject <> object""")
def resolve_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf)
    ids = t.select(F.explode(F.array("subject", "object")).alias("id")).where("id is not null").distinct()
    return Re.rewrite(t, Re.elect(ids.withColumn("component", F.lower(F.trim("id"))))).select("seq", "subject", "object")


_PROFILES = """kinds AS (SELECT subject AS id, max_by(object, seq) AS type FROM sampled_triples WHERE relation = 'IS_A' AND object IS NOT NULL GROUP BY subject),
  p AS (SELECT type, id, relation, value, seq FROM (SELECT subject AS id, relation, max_by(object, seq) AS value, min(seq) AS seq FROM sampled_triples WHERE starts_with(relation, 'HAS_') AND object IS NOT NULL GROUP BY subject, relation) JOIN kinds USING (id) WHERE type IN ('ClaimRecord', 'PolicyRecord'))"""
#: Records by the cells of the wide table, labelled parts as fields of their own.
_FIELDS = rf"""{CELLS}, raw AS (SELECT split_part(subject, '-', 1) AS type, subject AS id, relation, CASE WHEN value_type IN ('text', 'parts') THEN o ELSE value END AS value FROM best),
  cut AS (SELECT *, string_split_regex(value, '[|;]') AS xs, NOT regexp_matches(value, '[|;]') OR len(list_filter(string_split_regex(value, '[|;]'), lambda x: NOT (regexp_matches(x, '^\s*([^:=|;]+?)\s*[:=]\s*(.*?)\s*$') OR trim(x) = ''))) > 0 AS whole FROM raw),
  each_ AS (SELECT type, id, relation, whole, unnest(CASE WHEN whole THEN [value] ELSE xs END) AS x FROM cut),
  named AS (SELECT type, id, relation, CASE WHEN whole THEN relation ELSE 'HAS_' || upper(regexp_replace(regexp_extract(x, '^\s*([^:=|;]+?)\s*[:=]\s*(.*?)\s*$', 1), '\s+', '_', 'g')) END AS field, CASE WHEN whole THEN x ELSE regexp_extract(x, '^\s*([^:=|;]+?)\s*[:=]\s*(.*?)\s*$', 2) END AS value FROM each_),
  p AS (SELECT type, id, field AS relation, min({{'r': relation, 'v': value}}).v AS value, field AS seq FROM named WHERE value <> '' GROUP BY type, id, field)"""
_SHARED = rf"""v AS (SELECT type, relation, value, count(*) AS n, row_number() OVER (PARTITION BY type, relation ORDER BY value) AS r FROM p GROUP BY type, relation, value),
  s0 AS (SELECT type, relation, count(*) AS card, sum(n) AS records, list(value) FILTER (r <= 5) AS samples FROM v GROUP BY type, relation),
  hl AS (SELECT type, count(DISTINCT id) * 0.05 AS least FROM p GROUP BY type), s AS (SELECT s0.* FROM s0 JOIN hl USING (type) WHERE records >= least),
  j AS (SELECT a.type AS type_a, b.type AS type_b, relation, a.card AS cardinality_a, b.card AS cardinality_b, ln(1 + 10 * ((a.card + b.card) / 2.0 / greatest(a.records, b.records))) + 0.1 AS idf_weight, list_concat(a.samples, b.samples) AS x FROM s a JOIN s b USING (relation) WHERE a.type < b.type),
  shared AS (SELECT type_a, type_b, relation, cardinality_a, cardinality_b, idf_weight, CASE WHEN {contains_sql('lower(relation)', L.DATE_WORDS)} THEN 'date' WHEN {contains_sql('lower(relation)', L.NUMBER_WORDS)} THEN 'numeric'
    WHEN len(list_filter(x, lambda v: regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}'))) > len(x) * 0.5 THEN 'date' WHEN len(list_filter(x, lambda v: regexp_matches(regexp_replace(v, '[,$]', '', 'g'), '^[\d.,$]+$'))) > len(x) * 0.5 THEN 'numeric'
    WHEN len(x) > 0 AND len(list_filter(x, lambda v: length(v) > 10)) = 0 THEN 'categorical' ELSE 'text' END AS field_type, CAST(row_number() OVER (PARTITION BY type_a, type_b ORDER BY round(idf_weight, 9) DESC, relation) AS INT) AS rank, count(*) OVER (PARTITION BY type_a, type_b) AS fields FROM j)"""
#: Relations that records are blocked by, and share of records that must hold one.
LINK_PASSES, LINK_SHARE = 4, 0.05
_PAIRS = f"""pairs AS (SELECT DISTINCT type_a, type_b, x.id AS a, y.id AS b FROM shared JOIN p x ON x.type = type_a AND x.relation = shared.relation JOIN p y ON y.type = type_b AND y.relation = shared.relation AND y.value = x.value WHERE rank <= {LINK_PASSES} AND x.value <> '')"""


def _num(c: str) -> str:
    return rf"TRY_CAST(regexp_replace(trim({c}), '[,$]', '', 'g') AS DOUBLE)"


def _date(c: str) -> str:
    return rf"TRY_CAST(regexp_extract(trim({c}), '^\d{{4}}-\d{{2}}-\d{{2}}') AS DATE)"


_SCORES = f"""cmp AS (SELECT pairs.type_a, pairs.type_b, a, b, fields, idf_weight AS w, greatest(cardinality_a, cardinality_b) AS card, CASE field_type
    WHEN 'date' THEN CASE WHEN {_date('x.value')} IS NOT NULL AND {_date('y.value')} IS NOT NULL THEN CASE WHEN {_date('x.value')} = {_date('y.value')} THEN 1.0 WHEN abs({_date('x.value')} - {_date('y.value')}) <= 30 THEN 0.5 ELSE 0.0 END ELSE CAST(trim(x.value) = trim(y.value) AS DOUBLE) END
    WHEN 'numeric' THEN CAST(CASE WHEN {_num('x.value')} IS NOT NULL AND {_num('y.value')} IS NOT NULL THEN abs({_num('x.value')} - {_num('y.value')}) / greatest(abs({_num('x.value')}), abs({_num('y.value')}), 1e-9) <= 0.05 ELSE trim(x.value) = trim(y.value) END AS DOUBLE)
    WHEN 'categorical' THEN CAST(trim(x.value) = trim(y.value) AS DOUBLE) ELSE CAST(lower(trim(x.value)) = lower(trim(y.value)) AS DOUBLE) END AS s
    FROM pairs JOIN p x ON x.id = a AND x.type = type_a JOIN shared ON shared.relation = x.relation AND shared.type_a = pairs.type_a AND shared.type_b = pairs.type_b JOIN p y ON y.id = b AND y.type = pairs.type_b AND y.relation = x.relation),
  agg AS (SELECT type_a, type_b, a, b, max(fields) AS fields, sum(w) AS w, sum(w * s) AS m, count(*) AS compared, count(*) FILTER (s > 0) AS n, bool_or(s > 0 AND card >= 50) AS anchor FROM cmp GROUP BY type_a, type_b, a, b),
  scored AS (SELECT type_a, type_b, a, b, CASE WHEN anchor THEN m / w * (0.5 + 0.5 * compared / fields) ELSE 0.0 END AS score, CAST(CASE WHEN anchor THEN n ELSE 0 END AS INT) AS n_matched FROM agg)"""


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return L.profiles(triples(spark, sf)).where("type in ('ClaimRecord', 'PolicyRecord')")


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of records in standard spelling; dates count in order of the field's name."""
    prefixes = ("POL", "CLM", "SRV", "CHAT", "EMAIL")
    schema = Wd.attribute_schema(table(spark, sf, "relation_types"))
    cells = Wd.attribute_cells(table(spark, sf, "sampled_triples"), schema, table(spark, sf, "placeholder_values"), prefixes)
    p = cells.select(F.split("subject", "-")[0].alias("type"), F.col("subject").alias("id"), "relation", "value")
    return materialize(L.parts_as_fields(p).withColumn("seq", F.col("relation")), "record-fields")


@query(f"WITH {_FIELDS}, {_SHARED} SELECT * FROM shared")
def shared_relations_idf(spark: SparkSession, sf: str) -> DataFrame:
    return L.shared_relations(_fields(spark, sf), LINK_SHARE)


@query(f"WITH {_FIELDS}, {_SHARED}, {_PAIRS} SELECT * FROM pairs")
def blocking_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = _fields(spark, sf)
    return L.blocking_pairs(p, materialize(L.shared_relations(p, LINK_SHARE), "shared-relations"), LINK_PASSES)


@query(f"WITH {_FIELDS}, {_SHARED}, {_PAIRS}, {_SCORES} SELECT type_a, type_b, a, b, score, n_matched FROM scored")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = _fields(spark, sf)
    return L.score_pairs(p, materialize(L.shared_relations(p, LINK_SHARE), "shared-relations"), LINK_PASSES)


def _first(words) -> str:
    return f"min(CASE WHEN {contains_sql('lower(relation)', words)} AND {_date('value')} IS NOT NULL THEN {{'s': seq, 'd': {_date('value')}}} END).d"


@query(f"""WITH {_FIELDS}, {_SHARED}, {_PAIRS}, {_SCORES}, w AS (SELECT id, {_first(L.START)} AS st, {_first(L.END)} AS en, {_first(L.EVENT)} AS ev FROM p GROUP BY id)
  SELECT a AS subject, b AS object, score, n_matched FROM scored JOIN w x ON x.id = a JOIN w y ON y.id = b WHERE n_matched >= 3 AND score >= 0.4
  AND ((y.ev IS NULL OR x.st IS NULL OR (y.ev >= x.st AND (x.en IS NULL OR y.ev <= x.en))) OR (x.ev IS NULL OR y.st IS NULL OR (x.ev >= y.st AND (y.en IS NULL OR x.ev <= y.en))))""")
def linked_to(spark: SparkSession, sf: str) -> DataFrame:
    return L.link(_fields(spark, sf), passes=LINK_PASSES, least_share=LINK_SHARE)


@query(f"WITH {_PROFILES} SELECT id, {_first(L.START)} AS start, {_first(L.END)} AS \"end\", {_first(L.EVENT)} AS event FROM p GROUP BY id")
def temporal_windows(spark: SparkSession, sf: str) -> DataFrame:
    return L.windows(_profiles(spark, sf))


@query("SELECT object AS type, count(*) AS n FROM sampled_triples WHERE relation = 'IS_A' AND source_type = 'structured' AND object NOT IN ('Numeric', 'Date', 'Text', 'Categorical', 'Currency', 'Percentage', 'RecordType', 'IdentityType') GROUP BY object HAVING bool_or(regexp_matches(subject, '^(POL|CLM|REC)-'))")
def linkable_types(spark: SparkSession, sf: str) -> DataFrame:
    return L.record_types(triples(spark, sf))


ENDS = "ends AS (SELECT subject AS id, subject_type AS t, source_type AS st, seq * 2 AS o FROM sampled_triples WHERE subject IS NOT NULL UNION ALL SELECT object, object_type, source_type, seq * 2 + 1 FROM sampled_triples WHERE object IS NOT NULL)"
EDGES = "edges AS (SELECT subject AS src, relation AS rel, object AS dst, min(seq) AS seq FROM sampled_triples WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY ALL)"
ENTITIES = f"ents AS (SELECT id, coalesce(min(CASE WHEN coalesce(t, 'Unknown') NOT IN ({quoted(G.VALUE_TYPES)}) THEN {{'o': o, 't': coalesce(t, 'Unknown')}} END).t, min({{'o': o, 't': coalesce(t, 'Unknown')}}).t) AS entity_type FROM ends GROUP BY id)"
LANE = rf"""CASE WHEN {_PRE.format('id')} THEN 'record' WHEN entity_type IN ({quoted(G.VALUE_TYPES)}) OR starts_with(id, '$') OR regexp_matches(replace(regexp_replace(regexp_replace(id, '^-+', ''), '^([^.]*)\.', '\1'), ',', ''), '^\d+$') THEN 'value' ELSE 'concept' END"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_edges(triples(spark, sf))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    e = G.entity_graph(triples(spark, sf))
    return e.withColumn("lane", G.lane(F.col("id"), F.col("entity_type")))


@query(f"WITH {ENDS} SELECT id, coalesce(min(CASE WHEN t IS NOT NULL AND t <> 'Unknown' THEN {{'o': o, 't': t}} END).t, 'Unknown') AS entity_type, min({{'o': o, 'st': st}}).st AS source_type FROM ends GROUP BY id")
def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_nodes(triples(spark, sf))


@query("SELECT src, rel, dst, x.span AS span, x.confidence AS confidence FROM (SELECT subject AS src, relation AS rel, object AS dst, min({'s': seq, 'span': span, 'confidence': confidence}) AS x FROM sampled_triples WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY ALL)")
def edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).select("src", "rel", "dst", "span", "confidence")


@query(f"WITH {ENDS}, {ENTITIES} SELECT id, entity_type, {LANE} AS lane FROM ents")
def entity_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf)


@query(rf"""WITH {ENDS}, {EDGES}, {ENTITIES}, d AS (SELECT src AS id, count(*) AS deg FROM edges GROUP BY src),
  s AS (SELECT entity_type, count(*) AS n, avg(CAST(regexp_matches(id, '{line_end(G.LITERALS)}') AS DOUBLE)) AS literal_share, avg(CAST(coalesce(deg, 0) AS DOUBLE)) AS avg_out_degree FROM ents LEFT JOIN d USING (id) GROUP BY entity_type),
  r AS (SELECT entity_type, count(DISTINCT rel) AS relation_diversity FROM (SELECT src AS id, rel FROM edges UNION SELECT dst, rel FROM edges) JOIN ents USING (id) GROUP BY entity_type),
  q AS (SELECT entity_type, n, literal_share, coalesce(relation_diversity, 0) AS relation_diversity, avg_out_degree, replace(lower(entity_type), '_', '') AS nm FROM s LEFT JOIN r USING (entity_type))
  SELECT entity_type, n, literal_share, relation_diversity, avg_out_degree, CASE WHEN entity_type IN ({quoted(G.VALUE_TYPES)}) THEN 'value'
    WHEN {contains_sql('nm', G.CONCEPT_WORDS)} THEN CASE WHEN avg_out_degree >= 3 AND relation_diversity >= 5 THEN 'anchor' ELSE 'concept' END
    WHEN literal_share > 0.6 THEN 'value' WHEN {contains_sql('nm', G.VALUE_WORDS)} AND relation_diversity < 4 THEN 'value' WHEN relation_diversity < 3 AND avg_out_degree < 1.0 AND literal_share > 0.3 THEN 'value'
    WHEN avg_out_degree < 0.5 AND relation_diversity < 3 THEN 'descriptor' WHEN avg_out_degree >= 3 AND relation_diversity >= 5 THEN 'anchor' ELSE 'concept' END AS role FROM q""")
def type_roles(spark: SparkSession, sf: str) -> DataFrame:
    return G.type_roles(G.entity_graph(triples(spark, sf)), edges(spark, sf))


_DEG = "deg AS (SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(o, 0) + coalesce(i, 0) AS degree FROM ents LEFT JOIN (SELECT src AS id, count(*) AS o FROM edges GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY dst) USING (id))"


@query(f"WITH {ENDS}, {EDGES}, {ENTITIES}, {_DEG} SELECT * FROM deg")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(entities(spark, sf), edges(spark, sf))


@query(f"WITH {ENDS}, {EDGES}, {ENTITIES}, {_DEG} SELECT count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS edges, avg(degree) AS mean_degree, median(degree) AS median_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS isolated, sum(out_degree) * 1.0 / (CAST(count(*) AS DOUBLE) * (count(*) - 1)) AS density FROM deg")
def graph_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return G.statistics(entities(spark, sf), edges(spark, sf))


def _side(end: str, text: str, p: str) -> str:
    return f"""{p}f AS (SELECT {end} AS id, {text} AS t, row_number() OVER (PARTITION BY {end} ORDER BY seq) AS r FROM edges), {p}s AS (SELECT id, string_agg(t, chr(10) ORDER BY r) AS s FROM {p}f WHERE r <= 5 GROUP BY id),
  {p}c AS (SELECT id, string_agg(t, ',' ORDER BY t) AS c FROM (SELECT {end} AS id, rel || '=' || count(*) AS t FROM edges GROUP BY {end}, rel) GROUP BY id)"""


@query(f"""WITH {EDGES}, {_side("src", "rel || ' -> ' || dst", "o")}, {_side("dst", "src || ' -> ' || rel", "i")}, ids AS (SELECT id FROM os UNION SELECT id FROM iss)
  SELECT ids.id, coalesce(os.s, '') AS out_summary, coalesce(oc.c, '') AS out_rel_counts, coalesce(iss.s, '') AS in_summary, coalesce(ic.c, '') AS in_rel_counts FROM ids LEFT JOIN os USING (id) LEFT JOIN oc USING (id) LEFT JOIN iss USING (id) LEFT JOIN ic USING (id)""".replace("is AS (SELECT id, string_agg(t, chr(10)", "iss AS (SELECT id, string_agg(t, chr(10)"))
def adjacency_summaries(spark: SparkSession, sf: str) -> DataFrame:
    s = G.summaries(edges(spark, sf))
    return s.select("id", *(F.array_join(c, sep).alias(c) for c, sep in (("out_summary", "\n"), ("out_rel_counts", ","), ("in_summary", "\n"), ("in_rel_counts", ","))))


#: Concept and record entities have their type as class, values have none; every third concept is left open for votes.
CLASSES = f"asg AS (SELECT id AS entity_id, CASE WHEN {LANE} = 'value' OR entity_type = 'Unknown' THEN 'Other' ELSE entity_type END AS class FROM ents)"


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf)
    return e.select(F.col("id").alias("entity_id"), F.when((F.col("lane") == "value") | (F.col("entity_type") == "Unknown"), "Other").otherwise(F.col("entity_type")).alias("class"))


_BOTH = "both_ AS (SELECT src AS id, dst AS n, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges)"


@query(f"""WITH {ENDS}, {EDGES}, {ENTITIES}, {CLASSES}, {_BOTH}, k AS (SELECT entity_id, class FROM asg WHERE class <> 'Other'),
  v AS (SELECT id, class, count(*) AS v FROM both_ JOIN k ON k.entity_id = n WHERE id NOT IN (SELECT entity_id FROM k) GROUP BY id, class)
  SELECT id, class FROM (SELECT id, class, row_number() OVER (PARTITION BY id ORDER BY v DESC, class) AS r FROM v) WHERE r = 1""")
def neighbor_vote(spark: SparkSession, sf: str) -> DataFrame:
    known = assignments(spark, sf).where("class <> 'Other'").select(F.col("entity_id").alias("id"), "class")
    return G.neighbor_vote(edges(spark, sf), known)


@query(f"""WITH {ENDS}, {EDGES}, {ENTITIES}, {CLASSES}, b AS (SELECT DISTINCT src AS id, dst AS n FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
  near AS (SELECT b.id, b.n, x.class AS c, y.class AS nc FROM b JOIN asg x ON x.entity_id = b.id JOIN asg y ON y.entity_id = b.n),
  direct AS (SELECT DISTINCT id FROM near WHERE c <> 'Other' AND nc <> 'Other' AND c <> nc),
  two AS (SELECT DISTINCT m.id FROM near m JOIN near f ON f.id = m.n WHERE m.c <> 'Other' AND m.nc = 'Other' AND f.nc <> 'Other' AND f.nc <> m.c)
  SELECT class, count(*) AS total, count(d.id) AS connected_direct, count(*) FILTER (d.id IS NULL AND t.id IS NOT NULL) AS connected_2hop, round(count(*) FILTER (d.id IS NOT NULL OR t.id IS NOT NULL) * 1.0 / count(*), 3) AS connectivity,
    round(count(*) FILTER (d.id IS NOT NULL OR t.id IS NOT NULL) * 1.0 / count(*), 3) < 0.1 AS disconnected FROM asg LEFT JOIN direct d ON d.id = entity_id LEFT JOIN two t ON t.id = entity_id WHERE class <> 'Other' GROUP BY class""")
def backbone_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return G.backbone(edges(spark, sf), assignments(spark, sf).withColumnRenamed("entity_id", "id"))


@query(f"""WITH {ENDS}, {EDGES}, {ENTITIES}, {CLASSES}, a AS (SELECT entity_id AS id, class, {_PRE.format('entity_id')} AS rec FROM asg), b AS (SELECT DISTINCT src AS id, dst AS n FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
  z AS (SELECT class, count(*) AS n FROM a GROUP BY class), t AS (SELECT coalesce(sum(n) FILTER (class = 'Other'), 0) AS other, coalesce(sum(n) FILTER (class <> 'Other'), 0) AS named, coalesce(max(n) FILTER (class <> 'Other'), 0) AS largest, count(*) FILTER (class <> 'Other') AS classes FROM z),
  near AS (SELECT b.id, b.n, x.class AS c, x.rec, y.class AS nc, y.rec AS nrec FROM b JOIN a x ON x.id = b.id JOIN a y ON y.id = b.n),
  hub AS (SELECT id, min(n) AS n1, max(n) AS n2 FROM near WHERE c = 'Other' AND nc <> 'Other' GROUP BY id),
  cov AS (SELECT id FROM near WHERE rec AND nc <> 'Other' AND NOT nrec UNION SELECT near.id FROM near JOIN hub ON hub.id = near.n WHERE rec AND (n1 <> near.id OR n2 <> near.id))
  SELECT round((SELECT count(DISTINCT id) FROM near WHERE c <> 'Other' AND nc <> 'Other' AND c <> nc) / named, 4) AS connectivity, round((SELECT count(DISTINCT c) FROM near WHERE c <> 'Other' AND nc <> 'Other' AND c <> nc) / classes, 4) AS completeness,
    round(1 - largest / named, 4) AS balance, round(other / (other + named), 4) AS other_fraction, round((SELECT count(*) FROM cov) / (SELECT count(*) FROM a WHERE rec), 4) AS backbone_coverage FROM t""")
def intrinsic_quality(spark: SparkSession, sf: str) -> DataFrame:
    return G.quality(edges(spark, sf), assignments(spark, sf).withColumnRenamed("entity_id", "id"))


_RELCLASS = "rc AS (SELECT relation, CASE value_type WHEN 'date' THEN 'Timeline' WHEN 'decimal' THEN 'Money' WHEN 'boolean' THEN 'Flag' END AS class FROM relation_types WHERE value_type IN ('date', 'decimal', 'boolean'))"


@query(f"""WITH {ENDS}, {EDGES}, {ENTITIES}, {CLASSES}, {_RELCLASS}, h AS (SELECT src, rel, dst, coalesce(o.class, 'Other') AS own, coalesce(CASE WHEN t.class <> 'Other' THEN t.class END, rc.class) AS cls FROM edges LEFT JOIN asg o ON o.entity_id = src LEFT JOIN asg t ON t.entity_id = dst LEFT JOIN rc ON rc.relation = rel
    WHERE starts_with(rel, 'HAS_') AND {_PRE.format('src')}), f AS (SELECT * FROM h WHERE cls IS NOT NULL AND cls <> own)
  SELECT src AS record, cls AS class, rel AS relation, dst AS target FROM f WHERE src IN (SELECT src FROM f GROUP BY src HAVING count(DISTINCT cls) >= 2)""")
def decompose_records(spark: SparkSession, sf: str) -> DataFrame:
    types = table(spark, sf, "relation_types")
    kind = F.when(F.col("value_type") == "date", "Timeline").when(F.col("value_type") == "decimal", "Money").when(F.col("value_type") == "boolean", "Flag")
    rc = types.select("relation", kind.alias("class")).where("class is not null")
    return G.decompose_records(edges(spark, sf), assignments(spark, sf).withColumnRenamed("entity_id", "id"), rc)


@query(f"WITH {ENDS}, {EDGES}, {ENTITIES} SELECT 'type' AS kind, entity_type AS name, count(*) AS n FROM ents GROUP BY entity_type UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY rel")
def schema_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.schema_summary(entities(spark, sf), edges(spark, sf))
