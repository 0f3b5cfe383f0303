"""Queries of the record and filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as Fl
from ..operators import records as R
from .registry import contains_sql, quoted, registry
from .tables import table

QUERIES, SQL, query = registry()

_CHUNKS = "(SELECT doc_id, coalesce(source, '') || '.json' AS source, text AS content FROM documents)"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit(".json")).alias("source"), F.col("text").alias("content"))


_RECORDS = r"""records AS (SELECT doc_id, generate_subscripts(b, 1) - 1 AS record_no, unnest(b) AS block FROM (SELECT doc_id, string_split_regex(text, '(?:^|\n)RECORD:\s*\n') AS b FROM documents WHERE text LIKE '%RECORD:%')),
lines AS (SELECT doc_id, record_no, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, record_no, string_split(block, chr(10)) AS l FROM records)),
pairs AS (SELECT doc_id, record_no, line_no, generate_subscripts(p, 1) AS pair_no, unnest(p) AS pair FROM (SELECT *, string_split(regexp_extract(line, '^\s*\[([^\]]+)\]\s*(.+)$', 2), '|') AS p FROM lines)),
parts AS (SELECT doc_id, record_no, line_no * 10000 + pair_no AS pos, trim(pair[: instr(pair, ':') - 1]) AS field, trim(pair[instr(pair, ':') + 1 :]) AS value FROM pairs WHERE instr(pair, ':') > 0),
fields AS (SELECT doc_id, record_no, field, max_by(value, pos) AS value FROM parts WHERE field <> '' AND value <> '' GROUP BY doc_id, record_no, field)"""


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").where("text like '%RECORD:%'").select("doc_id", F.col("text").alias("content"))
    return R.parse_records(chunks)


@query(f"WITH {_RECORDS} SELECT doc_id, CAST(record_no AS INT) AS record_no, field, value FROM fields")
def record_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(spark, sf).select("doc_id", "record_no", "field", "value")


@query(rf"""SELECT record_type, count(*) AS n FROM (SELECT CASE WHEN contains(s, 'policies') OR contains(c, 'policies') THEN 'policies' WHEN contains(s, 'claims') OR contains(c, 'claims') THEN 'claims'
  WHEN contains(s, 'survey') OR {contains_sql('c', ('nps_score', 'nps score', 'csat', 'rating', 'satisfaction', 'recommend', 'likelihood', 'feedback'))} THEN 'survey'
  WHEN contains(s, 'chat') OR {contains_sql('c', ('conversation', 'transcript', 'chat_id', 'chat session'))} THEN 'chat'
  WHEN contains(s, 'email') OR {contains_sql('c', ('subject_line', 'email_body', 'sender', 'recipient'))} THEN 'email'
  WHEN {contains_sql('c', ('date of loss', 'date of accident', 'date of incident', 'cause of damage', 'cause of loss', 'cause of accident'))} THEN 'claims'
  WHEN {contains_sql('c', ('policy effective date', 'policy cost', 'effective date', 'inception date'))} THEN 'policies' ELSE 'unknown' END AS record_type
  FROM (SELECT lower(source) AS s, lower(coalesce(content, '')) AS c FROM {_CHUNKS})) GROUP BY record_type""")
def record_types(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select(R.record_type(F.col("source"), F.col("content")).alias("record_type")).groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT chunk_id, coalesce((contains(lower(source), '.json') OR contains(lower(source), '.csv')) AND contains(lower(array_to_string(section_hierarchy, ' ')), 'records'), false) AS structured FROM hybrid_chunks""")
def structured_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hybrid_chunks").select("chunk_id", R.is_structured(F.col("source"), F.col("section_hierarchy")).alias("structured"))


#: Orders as claim records with named fields.
_CLAIMS = """claims AS (SELECT o_orderkey AS id, 'claims' AS record_type, unnest([
   {'field': 'date of loss', 'value': strftime(o_orderdate, '%Y-%m-%d')}, {'field': 'cause of damage', 'value': o_orderpriority},
   {'field': 'property state', 'value': o_orderstatus}, {'field': 'insured name', 'value': 'Customer ' || o_custkey}, {'field': 'claim amount', 'value': CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)},
   {'field': 'reported zip code', 'value': CAST(10000 + o_custkey AS VARCHAR)}, {'field': 'reported city', 'value': CASE WHEN o_custkey % 7 <> 0 THEN 'Town ' || (o_custkey % 7) END}], recursive := true) FROM orders)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pairs = [
        ("date of loss", F.date_format("o_orderdate", "yyyy-MM-dd")),
        ("cause of damage", F.col("o_orderpriority")),
        ("property state", F.col("o_orderstatus")),
        ("insured name", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))),
        ("claim amount", F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        ("reported zip code", (F.col("o_custkey") + 10000).cast("string")),
        ("reported city", F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("Town "), (F.col("o_custkey") % 7).cast("string")))),
    ]
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs]))
    return o.select(F.col("o_orderkey").alias("id"), F.lit("claims").alias("record_type"), cells.alias("c")).select("id", "record_type", "c.field", "c.value")


_RANK = "CASE field WHEN 'date of loss' THEN 0 WHEN 'cause of damage' THEN 1 WHEN 'total building insurance coverage' THEN 2 WHEN 'rated flood zone' THEN 3 WHEN 'amount paid on building claim' THEN 4 WHEN 'property state' THEN 5 ELSE 99 END"
_KEYS = f"""keys AS (SELECT id, 'CLM-' || sha256(array_to_string(list_transform(list({{'r': {_RANK}, 'f': field, 'v': value}} ORDER BY {_RANK}, field)[1:4], lambda x: x.v), '|'))[1:12] AS record_key
  FROM claims WHERE value IS NOT NULL AND value <> '' GROUP BY id)"""


@query(f"WITH {_CLAIMS}, {_KEYS} SELECT id, record_key FROM keys")
def record_keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.composite_key(_claims(spark, sf), ["id"])


_TYPE = rf"""CASE WHEN regexp_matches(value, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN 'Date' WHEN regexp_matches(value, '^\$[\d,]+(\.\d{{2}})?$') THEN 'Currency' WHEN regexp_matches(value, '^[\d.]+\s*%$') THEN 'Percentage'
  WHEN {contains_sql('lower(field)', R.DATE_WORDS)} THEN 'Date' WHEN regexp_matches(value, '^-?[\d,]+(\.\d+)?$') THEN 'Numeric'
  WHEN length(value) <= 5 AND regexp_matches(replace(replace(value, '.', ''), '-', ''), '^[\p{{L}}\p{{N}}]+$') THEN 'Categorical' ELSE 'Text' END"""
_REL = r"""'HAS_' || upper(regexp_replace(trim(regexp_replace(array_to_string(list_filter(string_split_regex(lower(field), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' '), '[^a-z0-9\s]', '', 'g')), '\s+', '_', 'g'))"""


@query(f"WITH {_RECORDS} SELECT doc_id, field, value, {_TYPE} AS value_type, {_REL} AS relation FROM fields")
def value_types(spark: SparkSession, sf: str) -> DataFrame:
    f, v = F.col("field"), F.col("value")
    return _fields(spark, sf).select("doc_id", "field", "value", R.value_type(f, v).alias("value_type"), R.relation_of(f).alias("relation"))


@query(f"""WITH {_CLAIMS}, {_KEYS}, r AS (SELECT *, {_TYPE} AS t, {_REL} AS rel FROM claims JOIN keys USING (id))
  SELECT record_key AS subject, 'IS_A' AS relation, 'ClaimRecord' AS object, 'RecordType' AS object_type, 'ClaimRecord record from orders.csv' AS span FROM keys
  UNION ALL SELECT record_key, rel, value, t, field || ': ' || value FROM r""")
def record_triples(spark: SparkSession, sf: str) -> DataFrame:
    fields = _claims(spark, sf).withColumn("chunk_id", F.lit("0")).withColumn("source", F.lit("orders.csv"))
    return R.record_triples(fields, R.composite_key(fields, ["id"]), ["id"]).select("subject", "relation", "object", "object_type", "span")


_IDENTITY = f"""g AS (SELECT id, field, value, CASE WHEN {contains_sql('lower(field)', R.IDENTITY['person'])} THEN 'person' WHEN {contains_sql('lower(field)', R.IDENTITY['property'])} THEN 'property' END AS grp FROM claims),
  n AS (SELECT *, count(*) OVER (PARTITION BY id, grp) AS n FROM g WHERE grp IS NOT NULL),
  c AS (SELECT id, grp, CASE field WHEN 'property state' THEN 'property:state' WHEN 'reported zip code' THEN 'reported:zip' WHEN 'reported city' THEN 'reported:city' ELSE field END AS c, lower(trim(value)) AS v FROM n WHERE n >= 2 AND trim(value) <> ''),
  idk AS (SELECT id, grp, CASE grp WHEN 'person' THEN 'PER-' ELSE 'PROP-' END || sha256(string_agg(c || '=' || v, '|' ORDER BY c))[1:12] AS identity_key FROM c GROUP BY id, grp)"""


@query(f"WITH {_CLAIMS}, {_IDENTITY} SELECT id, grp, identity_key FROM idk")
def identity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.identity_keys(_claims(spark, sf), ["id"])


_ID_TYPE = "CASE grp " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.IDENTITY_TYPE.items()) + " ELSE 'IdentityEntity' END"


@query(f"""WITH {_CLAIMS}, {_KEYS}, {_IDENTITY} SELECT identity_key AS subject, 'IS_A' AS relation, {_ID_TYPE} AS object FROM idk
  UNION ALL SELECT record_key, 'BELONGS_TO', identity_key FROM idk JOIN keys USING (id)
  UNION ALL SELECT identity_key, {_REL}, value FROM idk JOIN n USING (id, grp) WHERE n >= 2""")
def identity_triples(spark: SparkSession, sf: str) -> DataFrame:
    fields = _claims(spark, sf).withColumn("chunk_id", F.lit("0")).withColumn("source", F.lit("orders.csv"))
    return R.identity_triples(fields, R.composite_key(fields, ["id"]), ["id"]).select("subject", "relation", "object")


_EVENT_FIELDS = "(SELECT event_id, unnest([{'field': 'policy number', 'value': CAST(user_id AS VARCHAR)}, {'field': 'CLAIM_ID', 'value': CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END}, {'field': 'rating', 'value': '5'}], recursive := true) FROM events)"


def _event_fields(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(
        F.struct(F.lit("policy number").alias("field"), F.col("user_id").cast("string").alias("value")),
        F.struct(F.lit("CLAIM_ID").alias("field"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise("").alias("value")),
        F.struct(F.lit("rating").alias("field"), F.lit("5").alias("value")),
    )
    return table(spark, sf, "events").select("event_id", F.explode(cells).alias("c")).select("event_id", "c.field", "c.value")


@query(f"""SELECT event_id, CASE WHEN field = 'policy number' THEN 'policies' ELSE 'claims' END AS "references", CASE WHEN field = 'policy number' THEN 'POL-' ELSE 'CLM-' END || value AS target_key FROM {_EVENT_FIELDS} WHERE value <> '' AND field <> 'rating'""")
def fk_about(spark: SparkSession, sf: str) -> DataFrame:
    return R.foreign_keys(_event_fields(spark, sf), ["event_id"]).select("event_id", "references", "target_key")


@query(f"""SELECT event_id, 'POL-' || value AS target_key FROM {_EVENT_FIELDS} WHERE field = 'policy number' AND CAST(value AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def fk_known(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("POL-"), F.col("c_custkey").cast("string")).alias("record_key"))
    return R.foreign_keys(_event_fields(spark, sf), ["event_id"], known).select("event_id", "target_key")


@query()
def extract_structured(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").where("text like '%RECORD:%'").select(F.col("doc_id").alias("chunk_id"), F.lit("policies.json").alias("source"), F.col("text").alias("content"), F.array(F.lit("records 0–9")).alias("section_hierarchy"))
    return R.extract_structured(chunks)[0].groupBy("relation", "object_type").agg(F.count(F.lit(1)).alias("n"))


_SYN = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Fl.SYNONYMS.items()) + " ELSE relation END"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(f"""SELECT seq FROM (SELECT *, {_SYN} AS rel FROM sampled_triples) WHERE coalesce(confidence >= 0.5, true) AND coalesce({_strip('subject')}, '') <> '' AND coalesce({_strip('object')}, '') <> ''
  AND rel NOT IN ({quoted(Fl.BLACKLIST)}) AND length(rel) BETWEEN 2 AND 60""")
def keep_triples(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "sampled_triples")
    return t.where(Fl.keep_triple(F.col("subject"), F.col("relation"), F.col("object"), F.col("confidence"))).select("seq")


_NULLFORM = rf"regexp_replace(lower({_strip('object')}), '^[.\-*/ ]+|[.\-*/ ]+$', '', 'g')"
_PLACEHOLDER = f"""WITH b AS (SELECT seq, relation, object, {_strip('object')} AS v, {_NULLFORM} AS n, count(*) OVER (PARTITION BY relation, object) AS k, count(*) OVER (PARTITION BY relation) AS total FROM sampled_triples),
  f AS (SELECT *, {contains_sql('lower(relation)', Fl.TEXT_WORDS)} AND n IN ({quoted(Fl.NULL_TEXT)}) AS t, {contains_sql('lower(relation)', Fl.DATE_WORDS)} AND n IN ({quoted(Fl.NULL_DATE)}) AS d, {contains_sql('lower(relation)', Fl.AMOUNT_WORDS)} AND n IN ({quoted(Fl.NULL_NUMBER)}) AS a FROM b),
  r AS (SELECT seq, CASE WHEN coalesce(v, '') = '' THEN 'empty_value' WHEN k >= 50 AND k * 1.0 / total >= 0.2 AND n IN ({quoted(Fl.NULL_TEXT)}) THEN 'high_prevalence_placeholder'
    WHEN length(v) <= 3 AND (n IN ({quoted(Fl.NULL_TEXT)}) OR n = '' OR d OR a) THEN 'context_placeholder'
    WHEN length(v) <= 3 AND regexp_matches(replace(replace(v, '.', ''), '-', ''), '^[\\p{{L}}\\p{{N}}]+$') THEN NULL
    WHEN t OR d OR a THEN 'context_placeholder' END AS reason FROM f)"""


@query(_PLACEHOLDER + " SELECT seq, reason FROM r WHERE reason IS NOT NULL")
def placeholder_filter(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.placeholder_reason(table(spark, sf, "sampled_triples").select("seq", "relation", "object")).where("reason is not null").select("seq", "reason")


@query(_PLACEHOLDER + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def placeholder_stats(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.placeholder_reason(table(spark, sf, "sampled_triples").select("seq", "relation", "object")).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT seq, CASE WHEN relation IN ({quoted(Fl.AMOUNT_RELATIONS)}) AND NOT (regexp_matches(o, '^[\$]?[\d,]+(\.\d+)?(%)?$') OR coalesce(object_type IN ({quoted(Fl.AMOUNT_TYPES)}), false) OR regexp_matches(o, '(?i)^\d+\s*(days?|months?|years?|hours?)$')) AND length(o) > 5 THEN 'object_not_numeric'
  WHEN relation = 'COVERS' AND contains(lower(subject_type), 'organization') THEN 'organization_covers' END AS reason
  FROM (SELECT seq, CASE relation WHEN 'LIMITED_BY' THEN 'HAS_COVERAGE_LIMIT' WHEN 'INSURES' THEN 'COVERS' ELSE relation END AS relation, {_strip('object')} AS o, object_type, subject_type, source_type FROM sampled_triples)
  WHERE NOT coalesce(source_type IN ('structured', 'cross_source'), false) AND reason IS NOT NULL""")
def semantic_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "sampled_triples").withColumn("relation", F.when(F.col("relation") == "LIMITED_BY", "HAS_COVERAGE_LIMIT").when(F.col("relation") == "INSURES", "COVERS").otherwise(F.col("relation")))
    reason = Fl.semantic_reason(F.col("relation"), F.col("object"), F.col("object_type"), F.col("subject_type"), F.col("source_type"))
    return t.select("seq", reason.alias("reason")).where("reason is not null")


def _flat(c: str) -> str:
    return rf"lower(regexp_replace({_strip(c)}, '[\s\p{{Z}}]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT seq, chunk_id, coalesce(span, '') AS span FROM sampled_triples), c AS (SELECT chunk_id, min(content) AS content FROM hybrid_chunks GROUP BY chunk_id),
  j AS (SELECT seq, {_strip('span')} AS raw, {_flat('span')} AS s, coalesce({_flat('content')}, '') AS t FROM t JOIN c USING (chunk_id)),
  w AS (SELECT *, list_distinct(string_split(s, ' ')) AS ws FROM j)
  SELECT seq, CAST(CASE WHEN length(raw) < 5 THEN 0.0 WHEN contains(t, s) THEN 1.0 WHEN len(ws) >= 2 AND len(list_intersect(ws, list_distinct(string_split(t, ' ')))) * 1.0 / len(ws) >= 0.8 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS grounded FROM w""")
def span_grounding(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "sampled_triples").select("seq", "chunk_id", "span")
    c = table(spark, sf, "hybrid_chunks").groupBy("chunk_id").agg(F.min("content").alias("content"))
    return Fl.ground(t, c).select("seq", "grounded")


@query(f"SELECT min(seq) AS seq FROM sampled_triples GROUP BY lower({_strip('subject')}), relation, lower({_strip('object')})")
def triple_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.first_of_key(table(spark, sf, "sampled_triples").select("seq", "subject", "relation", "object")).select("seq")


@query("SELECT seq, chunk_id FROM (SELECT seq, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY seq) AS r FROM sampled_triples) WHERE r <= 50")
def chunk_triple_cap(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.first_rows(table(spark, sf, "sampled_triples").select("seq", "chunk_id"), "chunk_id", 50)


@query("SELECT DISTINCT source AS file, relation AS header FROM sampled_triples WHERE source IS NOT NULL AND relation NOT IN (SELECT relation FROM sampled_triples WHERE upper(relation) LIKE 'HAS%' AND source IS NOT NULL GROUP BY relation HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM sampled_triples))")
def audit_headers(spark: SparkSession, sf: str) -> DataFrame:
    headers = table(spark, sf, "sampled_triples").where("source is not null").select(F.col("source").alias("file"), F.col("relation").alias("header")).distinct()
    return Fl.strip_audit(headers, ("HAS",))


@query("SELECT subject, (contains(subject, ':') OR regexp_matches(subject, '^(POL|CLM|REC|PER|PROP|SRV|CHAT|EMAIL)-')) AS record FROM (SELECT DISTINCT subject FROM sampled_triples)")
def record_like_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sampled_triples").select("subject").distinct().select("subject", Fl.looks_like_record(F.col("subject")).alias("record"))
