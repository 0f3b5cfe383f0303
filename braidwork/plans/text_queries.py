"""Queries of the text, field-name and chunking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from .registry import contains_sql, quoted, registry
from .tables import table

QUERIES, SQL, query = registry()
#: Header line of the forms in the test tables.
HEADER = r"(?i)[A-Z]+ DWELLING FORM\s+P\s*AG\s*E\s*\d+\s*OF\s*\d+"


def _tok(c: str) -> str:
    return rf"CAST(floor(len(list_filter(string_split_regex({c}, '[\s\p{{Z}}]+'), lambda w: w <> '')) / 0.75) AS INT)"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _noise(c: str) -> str:
    return _strip(rf"regexp_replace(replace(regexp_replace({c}, '(?i)[A-Z]+ DWELLING FORM\s+P\s*AG\s*E\s*\d+\s*OF\s*\d+', '', 'g'), chr(173), ''), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT chunk_id, {_tok('content')} AS approx_tokens FROM hybrid_chunks")
def approx_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hybrid_chunks").select("chunk_id", T.approx_tokens(F.col("content")).alias("approx_tokens"))


@query(f"SELECT chunk_id, {_noise('content')} AS clean FROM hybrid_chunks")
def strip_noise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hybrid_chunks").select("chunk_id", T.strip_noise(F.col("content"), HEADER).alias("clean"))


@query()
def temporal_markers(spark: SparkSession, sf: str) -> DataFrame:
    # DuckDB's word borders and digits are ASCII, so no SQL says this for all texts.
    return table(spark, sf, "hybrid_chunks").select("chunk_id", F.array_join(F.array_sort(T.temporal_markers(F.col("content"))), "|").alias("markers"))


_LEVEL = rf"""CASE WHEN regexp_matches({_strip('line')}, '^(I{{1,3}}|IV|V?I{{0,3}}|IX|X{{1,2}})\.\s+[A-Z]{{2,}}') THEN 'major'
    WHEN regexp_matches({_strip('line')}, '^([A-Z])\.\s+[A-Z][a-z]') THEN 'sub' END"""


@query(rf"""SELECT level, label, count(*) AS n FROM (SELECT {_LEVEL} AS level, {_strip('line')} AS label
    FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM hybrid_chunks)) WHERE level IS NOT NULL GROUP BY level, label""")
def section_labels(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "hybrid_chunks").select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.select(T.section_level(F.col("line")).alias("level"), T.strip(F.col("line")).alias("label")).where("level is not null").groupBy("level", "label").agg(F.count(F.lit(1)).alias("n"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    # One document per chunk id, its repeated ingestions as further pages.
    return table(spark, sf, "hybrid_chunks").select(F.col("chunk_id").alias("source"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("page"), F.col("content").alias("text"))


@query(rf"""WITH l AS (SELECT source, page, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT chunk_id AS source, epoch_us(created_at) AS page, string_split({_noise('content')}, chr(10)) AS ls FROM hybrid_chunks)),
  v AS (SELECT *, {_LEVEL} AS level, {_strip('line')} AS label FROM l),
  s AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER w AS section_no, sum(CASE WHEN level = 'major' THEN 1 ELSE 0 END) OVER w AS major_no FROM v WINDOW w AS (PARTITION BY source ORDER BY page, n ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT *, last_value(CASE WHEN level = 'major' THEN label END IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS major,
      last_value(CASE WHEN level = 'sub' THEN label END IGNORE NULLS) OVER (PARTITION BY source, major_no ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS minor FROM s),
  g AS (SELECT source, section_no, string_agg(line, chr(10) ORDER BY page, n) AS t, list_filter([max(major), max(minor)], lambda x: x IS NOT NULL) AS hs FROM h GROUP BY source, section_no),
  c AS (SELECT source, CAST(section_no AS BIGINT) AS section_no, {_noise('t')} AS content, array_to_string(hs, ' > ') AS hierarchy FROM g)
  SELECT source, section_no, content, hierarchy FROM c WHERE length(content) > 40""")
def section_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_sections(_pages(spark, sf), HEADER).select("source", "section_no", "content", F.array_join("section_hierarchy", " > ").alias("hierarchy"))


@query()
def sub_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "hybrid_chunks").select("chunk_id", "content", "section_hierarchy")
    return C.sub_chunk(chunks).select("chunk_id", "content", F.array_join("section_hierarchy", " > ").alias("hierarchy"))


@query()
def text_file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.text_chunks(table(spark, sf, "documents").select(F.col("doc_id").alias("source"), "text"))


@query(r"""WITH w AS (SELECT doc_id AS source, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
  n AS (SELECT source, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 512) / 462.0)) AS INT) + 1)) AS window_no FROM w WHERE len(w) > 0)
  SELECT source, CAST(window_no AS INT) AS window_no, array_to_string(w[window_no * 462 + 1 : window_no * 462 + 512], ' ') AS content FROM n""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.sliding_windows(table(spark, sf, "documents").select(F.col("doc_id").alias("source"), "text"))


_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "POLICY_NUMBER", "GWP", "amountPaidOnBuildingClaim", "ENDORSEMENT_PET_ID", "OVERALL_CSAT", "claim_city", "bi_created_dt", "riskKind"]
_FIELDS = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + ") t(pos, name)"


def _fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_NAMES)), "pos int, name string")


def _group_sql(name: str) -> str:
    cases = "".join(f" WHEN {' OR '.join(f'contains(lower({name}), {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{g}'" for g, parts in T.FIELD_GROUPS.items())
    return f"CASE WHEN starts_with(lower({name}), 'endorsement') THEN 'Coverage' WHEN lower({name}) LIKE '%\\_date' ESCAPE '\\' OR lower({name}) LIKE '%\\_dt' ESCAPE '\\' THEN 'Date' WHEN lower({name}) LIKE '%\\_csat' ESCAPE '\\' OR lower({name}) LIKE '%\\_ces' ESCAPE '\\' THEN 'Status'{cases} ELSE 'Other' END"


_HUMAN = "CASE WHEN contains({0}, '_') AND {0} = upper({0}) THEN trim(replace(lower({0}), '_', ' ')) WHEN {0} = upper({0}) AND regexp_matches({0}, '^[A-Z]+$') THEN lower({0}) ELSE trim(lower(regexp_replace({0}, '([A-Z])', ' \\1', 'g'))) END"


@query(f"SELECT name, {_HUMAN.format('name')} AS human, {_group_sql('name')} AS grp FROM {_FIELDS}")
def humanize_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(spark).select("name", T.humanize_field(F.col("name")).alias("human"), T.field_group(F.col("name")).alias("grp"))


_ORDER = "CASE g " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(C.GROUP_ORDER)) + " END"


@query(f"""WITH k AS (SELECT pos, {_group_sql('name')} AS g, {_HUMAN.format('name')} AS h FROM {_FIELDS} WHERE lower(name) NOT IN ({quoted(C.AUDIT)})), l AS (SELECT g, '  [' || g || '] ' || string_agg(h, ', ' ORDER BY pos) AS line FROM k GROUP BY g)
  SELECT 'DATASET SCHEMA: sample' || chr(10) || 'Total fields: {len(_NAMES)}' || chr(10) || string_agg(line, chr(10) ORDER BY {_ORDER}) AS content FROM l""")
def schema_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return C.schema_chunk(_fields(spark), "sample")


ORDER_FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _formatted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("seq", F.col("o_orderkey")).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return C.format_records(rows, "orders.csv", "seq", ORDER_FIELDS)


@query(r"""SELECT 'orders.csv' AS source, o_orderkey AS seq, 'RECORD:' || chr(10) || concat_ws(chr(10), '  [Status] o_orderstatus: ' || o_orderstatus,
    '  [Other] ' || concat_ws(' | ', CASE WHEN o_custkey <> 0 THEN 'o_custkey: ' || o_custkey END, 'o_totalprice: ' || CAST(o_totalprice AS DECIMAL(18,2)), 'o_orderpriority: ' || o_orderpriority)) AS formatted FROM orders""")
def format_records(spark: SparkSession, sf: str) -> DataFrame:
    return _formatted(spark, sf)


@query()
def record_batches(spark: SparkSession, sf: str) -> DataFrame:
    return C.batch_records(_formatted(spark, sf), "Orders").select("source", "chunk_id", "content", F.col("section_hierarchy")[1].alias("label"))


@query(r"SELECT source, CASE WHEN contains(lower(source), 'polic') THEN 'policies' WHEN contains(lower(source), 'claim') THEN 'claims' WHEN contains(lower(source), 'survey') OR contains(lower(source), 'cancel') THEN 'survey' ELSE 'unknown' END AS record_type, lower(regexp_extract(source, '^([A-Za-z0-9]+)', 1)) AS lob, count(*) AS n FROM sampled_triples WHERE source IS NOT NULL GROUP BY ALL")
def file_record_types(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "sampled_triples").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return files.select("source", T.record_type_of_file(F.col("source")).alias("record_type"), T.line_of_business(F.col("source")).alias("lob"), "n")


@query(r"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(content, '([a-zA-Z]{3,})', 1)) AS w FROM hybrid_chunks) WHERE lower(w) NOT IN ('the','and','for','with','that','this')")
def vocab_terms(spark: SparkSession, sf: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in ("the", "and", "for", "with", "that", "this")], "word string")
    return table(spark, sf, "hybrid_chunks").select(F.explode(T.vocabulary(F.col("content"))).alias("word")).join(F.broadcast(stop), "word", "left_anti").distinct()


@query()
def semantic_merge(spark: SparkSession, sf: str) -> DataFrame:
    # Sections are vectors' entities of one type, in order of id; the threshold is low because the vectors are far apart.
    e = table(spark, sf, "entity_embeddings").where("embs is not null and size(embs) = 64").where(F.forall("embs", lambda x: ~F.isnan(x)))
    sections = e.select(F.concat(F.coalesce("entity_type", F.lit("none")), F.lit("-"), F.pmod(F.col("vec_id"), F.lit(50)).cast("string")).alias("source"), F.col("vec_id").alias("seq"), F.col("id").alias("content"), F.array("entity_type").alias("section_hierarchy"), F.col("embs").alias("vector"))
    return C.semantic_merge(sections, 0.4).select("source", "chunk_no", "content", F.size("merged_from").alias("n"))


def _slots() -> str:
    out, taken = [], "SELECT CAST(NULL AS BIGINT) AS s WHERE false"
    for i, words in enumerate(C.SAMPLE_GROUPS):
        out.append(f"g{i} AS (SELECT min(seq) AS s FROM c WHERE {contains_sql('lower(content)', words)} AND seq NOT IN ({taken}))")
        taken += f" UNION ALL SELECT s FROM g{i} WHERE s IS NOT NULL"
    return ", ".join(out) + ", found AS (" + " UNION ALL ".join(f"SELECT {i} AS o, s FROM g{i} WHERE s IS NOT NULL" for i in range(len(C.SAMPLE_GROUPS))) + ")"


@query(rf"WITH c AS (SELECT CAST(regexp_extract(chunk_id, '-(\d+)$', 1) AS BIGINT) AS seq, min(content) AS content FROM hybrid_chunks GROUP BY chunk_id), {_slots()} SELECT slot, seq, substr(content, 1, 800) AS excerpt FROM (SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS slot, s AS seq FROM found) JOIN c USING (seq) WHERE slot < 8")
def stratified_samples(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "hybrid_chunks").groupBy("chunk_id").agg(F.min("content").alias("content"))
    return C.stratified_samples(chunks.select(F.regexp_extract("chunk_id", r"-(\d+)$", 1).cast("long").alias("seq"), "content"))


@query(r"SELECT DISTINCT relation, regexp_replace(trim(upper(relation)), '[^A-Z0-9_]', '_', 'g') AS safe, replace(lower(regexp_replace(relation, '^HAS_', '')), '_', ' ') AS human FROM sampled_triples")
def relation_names(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("relation")
    return table(spark, sf, "sampled_triples").select("relation").distinct().select("relation", T.sanitize_relation(r).alias("safe"), T.humanize_relation(r).alias("human"))
