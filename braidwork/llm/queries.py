"""Queries of this subpackage's operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, language, mixing, neighbours, packing, splitting

TRIPLE = ["subject", "relation", "object"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sampled_triples").where("object is not null").select("seq", *TRIPLE)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.copy_pairs(_triples(spark, sf), TRIPLE, "seq").select(F.col("keep").alias("keep_seq"), F.col("dup").alias("dup_seq"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.copy_groups(dedup.keyed(_triples(spark, sf), TRIPLE, "seq")).select(F.col("keep").alias("keep_seq"), "copies", "collides")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "hybrid_chunks"), table(spark, sf, "size_limits"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("oversized").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "entity_embeddings"), k=10)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(p4_neighbours(spark, sf), 0.90).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def _capacity(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "size_limits").where("limit_name = 'container'").first()["max_tokens"]


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), _capacity(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf).where("pieces > 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf)


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.container_report(_containers(spark, sf), _capacity(spark, sf))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.sized(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1].where("not reachable").select("source")


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return language.identify(documents, language.fit(language.sample_labelled(documents)))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf).where("status in ('missing', 'wrong', 'mixed') and lang <> 'und'").select("doc_id", F.col("lang_no").alias("seg_no"), "lang")


def p8_stretches(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf)


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_pieces, p4_found, p4_neighbours, p6_found, p6_containers, p6_report, p7_found, p7_records, p7_shares, p8_found, p8_stretches)}


_TRIPLE_KEYS = r"""
WITH raw AS (SELECT seq, subject, relation, object FROM sampled_triples WHERE object IS NOT NULL),
fields AS (
  SELECT seq, 's' AS f, subject AS x FROM raw UNION ALL SELECT seq, 'r', relation FROM raw UNION ALL SELECT seq, 'o', object FROM raw),
marked AS (
  SELECT seq, f, x,
    regexp_replace(regexp_replace(regexp_replace(' ' || lower(x), '([0-9])\.([0-9])', '\1~P~\2', 'g'), '([0-9])\.([0-9])', '\1~P~\2', 'g'),
      '([^\p{L}\p{N}])-(\$?\.?[0-9])', '\1~M~\2', 'g') AS m,
    len(list_filter(string_split_regex(x, '[|;]'), lambda p: NOT (regexp_matches(p, '^\s*$') OR regexp_matches(p, '^[^:=]*[\p{L}\p{N}][^:=]*[:=]')))) = 0
      AND regexp_matches(x, '[|;]') AS labelled
  FROM fields),
parts AS (
  SELECT seq, f, x, labelled, list_transform(string_split_regex(m, '[|;]'), lambda p:
    replace(replace(regexp_replace(replace(replace(p, '~P~', 'ᴾ'), '~M~', 'ᴹ'), '[^\p{L}\p{N}\p{M}]', '', 'g'), 'ᴾ', '.'), 'ᴹ', '-')) AS p
  FROM marked),
canon AS (SELECT seq, f, CASE WHEN x IS NULL THEN NULL WHEN labelled THEN array_to_string(list_sort(p), '') ELSE array_to_string(p, '') END AS c FROM parts),
keys AS (SELECT seq, max(c) FILTER (f = 's') AS s, max(c) FILTER (f = 'r') AS r, max(c) FILTER (f = 'o') AS o FROM canon GROUP BY seq)
"""

_WORDS = r"len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> ''))"

SQL = {
    "p2_found": _TRIPLE_KEYS + "SELECT keep_seq, seq AS dup_seq FROM (SELECT seq, min(seq) OVER (PARTITION BY s, r, o) AS keep_seq FROM keys) WHERE seq <> keep_seq",
    "p2_counts": _TRIPLE_KEYS + "SELECT min(seq) AS keep_seq, count(*) AS copies, false AS collides FROM keys GROUP BY s, r, o",
    # The index is approximate; its pairs of 0.90 or more are all the true ones on the tables that SQL is run on.
    "p4_found": """WITH vec AS (SELECT vec_id AS id, CAST(embs AS DOUBLE[]) AS v FROM entity_embeddings WHERE len(embs) = 64 AND len(list_filter(embs, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embs, lambda x: x <> 0)) > 0),
  s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM vec a JOIN vec b ON a.id <> b.id),
  t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS r FROM s) SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t WHERE r <= 10 AND cos >= 0.9""",
    "p3_found": f"""SELECT DISTINCT chunk_id FROM hybrid_chunks, size_limits
        WHERE limit_name = CASE WHEN lower(trim(chunk_type)) = 'table' THEN 'chunk_table' ELSE 'chunk_text' END
        AND floor({_WORDS} / 0.75) > max_tokens""",
}
