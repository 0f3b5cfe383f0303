"""Filters over triples: quality, placeholders, meaning, grounding, duplicates; and a guard for read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_any, let, strip

#: Relations without meaning.
BLACKLIST = ("HAS", "IS", "IS_A", "ARE", "HAVE", "CONTAINS", "INCLUDES", "RELATES_TO", "ASSOCIATED_WITH", "CONNECTED_TO", "INVOLVES", "MENTIONS", "REFERS_TO", "LINKS_TO")
#: Synonyms of relations.
SYNONYMS = {
    "NOT_INSURED": "EXCLUDED_FROM", "NOT_COVERED": "EXCLUDED_FROM", "EXCLUDES": "EXCLUDED_FROM", "DOES_NOT_COVER": "EXCLUDED_FROM", "DOES_NOT_INSURE": "EXCLUDED_FROM",
    "INSURES": "COVERS", "PROVIDES_COVERAGE": "COVERS", "PROTECTS": "COVERS",
    "HAS_LIMIT": "HAS_COVERAGE_LIMIT", "COVERAGE_LIMIT": "HAS_COVERAGE_LIMIT", "MAXIMUM_AMOUNT": "HAS_COVERAGE_LIMIT", "HAS_MAXIMUM": "HAS_COVERAGE_LIMIT",
    "MUST_REPORT": "MUST_NOTIFY", "REQUIRES_NOTICE": "MUST_NOTIFY", "OBLIGATED_TO_NOTIFY": "MUST_NOTIFY",
    "MEANS": "DEFINED_AS", "IS_DEFINED_AS": "DEFINED_AS", "DEFINITION_OF": "DEFINED_AS",
    "WAITING_PERIOD": "HAS_WAITING_PERIOD", "HAS_WAIT": "HAS_WAITING_PERIOD",
}
#: Objects that mean "missing", exactly and after normalisation, as text, date and number.
NULL_TEXT = ("unavailable", "unknown", "n/a", "na", "not available", "not applicable", "none", "null", "redacted", "undetermined", "unspecified", "pending", "missing", "not provided", "tbd", "unk", "-", "--", "*", ".", "currently unavailable", "not reported")
NULL_DATE = ("0000-00-00", "9999-99-99", "99/99/9999")
NULL_NUMBER = ("0", "000000", "-1", "999999")
#: Words in a relation's name that say it bears text, dates or amounts.
TEXT_WORDS = ("city", "county", "state", "zip", "address", "street", "country", "province", "region", "municipality", "town", "name", "policyholder", "claimant", "insured", "agent", "adjuster", "beneficiary", "contact", "description", "type", "code", "class", "category", "zone", "status", "occupancy", "construction", "valuation", "condition")
DATE_WORDS = ("date", "effective", "termination", "expiration", "loss", "construction", "cancellation", "original")
AMOUNT_WORDS = ("amount", "cost", "coverage", "premium", "deductible", "limit", "payment", "fee", "value", "rate")
#: Share of a relation and number of rows from which a null-like object counts as prevalent.
PREVALENT_SHARE, PREVALENT_ROWS = 0.20, 50
#: Relations whose object must be an amount, and types that are one.
AMOUNT_RELATIONS = ("HAS_DEDUCTIBLE", "HAS_COVERAGE_LIMIT", "HAS_MAXIMUM", "HAS_PREMIUM", "HAS_COST", "HAS_FEE", "HAS_PAYMENT")
AMOUNT_TYPES = ("Currency", "Numeric", "Percentage", "FinancialAmount")
#: Fixed value: share of a span's words that its chunk must have.
OVERLAP = 0.80


def synonym(relation: Column) -> Column:
    """The relation that a synonym stands for, or the relation itself. One step."""
    pairs = [x for kv in SYNONYMS.items() for x in map(F.lit, kv)]
    return F.coalesce(F.element_at(F.create_map(*pairs), relation), relation)


def keep_triple(subject: Column, relation: Column, obj: Column, confidence: Column) -> Column:
    """Whether a triple is kept: confidence of 0.5 or more or none, no blank end, a relation of 2 to 60 characters with meaning."""
    named = let(synonym(F.coalesce(relation, F.lit(""))), lambda rel: ~rel.isin(*BLACKLIST) & F.length(rel).between(2, 60))
    sure = F.coalesce(confidence >= 0.5, F.lit(True))
    return sure & (F.coalesce(strip(subject), F.lit("")) != "") & (F.coalesce(strip(obj), F.lit("")) != "") & named


def null_form(value: Column) -> Column:
    """Lower case, without white space and . - * / at the edges."""
    return F.regexp_replace(F.lower(strip(value)), r"^[.\-*/ ]+|[.\-*/ ]+$", "")


def is_placeholder(relation: Column, value: Column) -> Column:
    """Whether a value means "missing" in this relation; short codes do not. True for blank values, null for null."""
    v, r = strip(value), F.lower(relation)
    n = null_form(v)
    text, date, amount = contains_any(r, TEXT_WORDS) & n.isin(*NULL_TEXT), contains_any(r, DATE_WORDS) & n.isin(*NULL_DATE), contains_any(r, AMOUNT_WORDS) & n.isin(*NULL_NUMBER)
    bare = F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    short = F.length(v) <= 3
    return F.when(v.isNull(), F.lit(None)).when(v == "", True).when(short & (n.isin(*NULL_TEXT) | (n == "")), True).when(short & (date | amount), True).when(short & bare.rlike(r"^[\p{L}\p{N}]+$"), False).otherwise(text | date | amount)


def placeholder_reason(triples: DataFrame) -> DataFrame:
    """``triples`` with ``reason``: empty_value, high_prevalence_placeholder, context_placeholder, or null for kept rows.

    A null object counts as empty. Shares come from two grouped counts with partial sums; only null-like pairs go back to
    the rows, and there are no more of those than relations times NULL_TEXT spellings.
    """
    counts = triples.groupBy("relation", "object").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("relation").agg(F.sum("n").alias("total"))
    likely = counts.where((F.col("n") >= PREVALENT_ROWS) & null_form(F.col("object")).isin(*NULL_TEXT)).join(totals, "relation").where(F.col("n") / F.col("total") >= PREVALENT_SHARE).select("relation", "object", F.lit(True).alias("_p"))
    reason = F.when(F.coalesce(strip(F.col("object")), F.lit("")) == "", "empty_value").when(F.col("_p"), "high_prevalence_placeholder").when(is_placeholder(F.col("relation"), F.col("object")), "context_placeholder")
    return triples.join(likely, ["relation", "object"], "left").withColumn("reason", reason).drop("_p").select(*triples.columns, "reason")


def semantic_reason(relation: Column, obj: Column, object_type: Column, subject_type: Column, source_type: Column) -> Column:
    """Why a triple makes no sense, or null. Structured and linked triples are not judged."""
    o = strip(obj)
    amount = o.rlike(r"^[\$]?[\d,]+(\.\d+)?(%)?$") | F.coalesce(object_type.isin(*AMOUNT_TYPES), F.lit(False)) | o.rlike(r"(?i)^\d+\s*(days?|months?|years?|hours?)$")
    judged = ~F.coalesce(source_type.isin("structured", "cross_source"), F.lit(False))
    return F.when(judged & relation.isin(*AMOUNT_RELATIONS) & ~amount & (F.length(o) > 5), "object_not_numeric").when(judged & (relation == "COVERS") & F.lower(subject_type).contains("organization"), "organization_covers")


def flat(c: Column) -> Column:
    """Lower case with single blanks; empty for null."""
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[\s\p{Z}]+", " "))


def grounding(span: Column, flat_text: Column) -> Column:
    """1.0 if the span is in the text, 0.9 if OVERLAP of its distinct words are, else 0. Case and white space do not count.

    ``flat_text`` went through :func:`flat`, once for each text and not for each span.
    """

    def judge(s: Column) -> Column:
        words = F.array_distinct(F.split(s, " "))
        share = F.size(F.array_intersect(words, F.split(flat_text, " "))) / F.size(words)
        return F.when(F.length(s) < 5, 0.0).when(flat_text.contains(s), 1.0).when((F.size(words) >= 2) & (share >= OVERLAP), 0.9).otherwise(0.0)

    return let(flat(span), judge)


def ground(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """``triples`` with ``grounded`` against the content of their chunk (chunk_id, content); without a chunk they are left out."""
    texts = chunks.select("chunk_id", flat(F.col("content")).alias("_t"))
    return triples.join(texts, "chunk_id").withColumn("grounded", grounding(F.col("span"), F.col("_t"))).drop("_t")


def first_of_key(triples: DataFrame, order: str = "seq") -> DataFrame:
    """The first row by ``order`` of each subject, relation and object; subject and object ignore case and outer blanks."""
    key = [F.lower(strip(F.col("subject"))).alias("s"), F.col("relation").alias("r"), F.lower(strip(F.col("object"))).alias("o")]
    firsts = triples.groupBy(*key).agg(F.min(order).alias(order)).select(order)
    return triples.join(firsts, order, "left_semi")


def strip_audit(headers: DataFrame, prefixes: tuple[str, ...] = ("BI_",)) -> DataFrame:
    """(file, header) without headers that begin with an audit prefix and are in every file."""
    files = headers.select("file").distinct().count()
    audit = F.lit(False)
    for p in prefixes:
        audit = audit | F.upper("header").startswith(p)
    everywhere = headers.where(audit).groupBy("header").agg(F.count_distinct("file").alias("n")).where(F.col("n") == files).select("header")
    return headers.join(everywhere, "header", "left_anti").select("file", "header")


def looks_like_record(c: Column, prefixes: tuple[str, ...] = ("POL-", "CLM-", "REC-", "PER-", "PROP-", "SRV-", "CHAT-", "EMAIL-")) -> Column:
    out = c.contains(":")
    for p in prefixes:
        out = out | c.startswith(p)
    return out


_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_WRITES = re.compile(r"\b(?:insert|update|delete|merge|create|drop|alter|truncate|replace|grant|revoke|load|set|call|refresh|cache|uncache|analyze|msck|use|add)\b", re.I)


def is_read_only(sql: str) -> bool:
    """Whether a statement is one SELECT or WITH, without words that write outside of quotes."""
    bare = _QUOTED.sub(" ", sql).strip().rstrip(";").strip()
    return bool(re.match(r"(?i)(?:select|with)\b", bare)) and ";" not in bare and not _WRITES.search(bare)


def clamp_limit(sql: str, limit: int = 200) -> str:
    """The statement with a LIMIT added if it has none."""
    bare = sql.strip().rstrip(";").strip()
    return bare if re.search(r"(?i)\blimit\s+\d+\s*(?:offset\s+\d+\s*)?$", _QUOTED.sub(" ", bare).strip()) else f"{bare} LIMIT {limit}"


def first_rows(triples: DataFrame, per: str, n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` rows of each ``per``: the safety cap on what one chunk may yield."""
    return triples.withColumn("_r", F.row_number().over(W.partitionBy(per).orderBy(order))).where(F.col("_r") <= n).drop("_r")
