"""Column expressions over text, field names and identifiers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script.
WS = r"[\s\p{Z}]"
#: Fixed value: header and footer line of the flood policy form.
PAGE_HEADER = r"(?i)NFIP GENERAL PROPERTY FORM SFIP\s+P\s*AG\s*E\s*\d+\s*OF\s*\d+"
#: A major section has a Roman number and capitals, a minor one a letter and a capitalised word.
MAJOR = r"^(I{1,3}|IV|V?I{0,3}|IX|X{1,2})\.\s+[A-Z]{2,}"
MINOR = r"^([A-Z])\.\s+[A-Z][a-z]"
#: Fixed value: a year, or a word and a year.
MARKER = r"(?<![\p{L}\p{N}_])(\p{Nd}{4}|[\p{L}\p{N}_]+ \p{Nd}{4})(?![\p{L}\p{N}_])"
#: Groups of fields by what their names contain, in order of precedence.
FIELD_GROUPS = {
    "Identity": ("id", "name", "insured", "client", "claimant", "master", "polno", "policy_no", "policy_number", "claim_number", "subscriber"),
    "Date": ("date", "eff_", "exp_", "cxl_", "trm_", "time", "begin_", "period", "month"),
    "Coverage": ("cov", "coverage", "ded", "deductible", "premium", "endorsement", "limit"),
    "Financial": ("amount", "paid", "cost", "fee", "gwp", "nwp", "tax", "credit", "loss", "payment", "prem"),
    "Location": ("state", "city", "zip", "county", "address", "add1", "add2", "add3", "terr", "loc", "risk_st"),
    "Status": ("status", "indicator", "code", "type", "kind", "reason", "category"),
}


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def let(c: Column, then) -> Column:
    """``then`` applied to a column that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(c), then)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def approx_tokens(c: Column) -> Column:
    """Words between white space divided by 0.75, truncated. Null for null."""
    return F.floor(F.size(words(c)) / F.lit(0.75)).cast("int")


def strip_noise(c: Column, header: str = PAGE_HEADER) -> Column:
    """Without page headers and soft hyphens, at most one blank line in a row, stripped."""
    return strip(F.regexp_replace(F.replace(F.regexp_replace(c, header, ""), F.lit("­"), F.lit("")), r"\n{3,}", "\n\n"))


def temporal_markers(c: Column) -> Column:
    """Distinct years and word-year pairs in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(MARKER), 1))


def section_level(line: Column) -> Column:
    """'major', 'sub' or null for a line."""
    s = strip(line)
    return F.when(s.rlike(MAJOR), "major").when(s.rlike(MINOR), "sub")


def humanize_field(name: Column, expansions: dict[str, str] | None = None) -> Column:
    """Readable field name: a given expansion, UPPER_SNAKE, ALLCAPS or camelCase taken apart."""
    upper = name == F.upper(name)
    out = (
        F.when(name.contains("_") & upper, F.trim(F.replace(F.lower(name), F.lit("_"), F.lit(" "))))
        .when(upper & name.rlike(r"^\p{L}+$"), F.lower(name))
        .otherwise(F.trim(F.lower(F.regexp_replace(name, "([A-Z])", " $1"))))
    )
    for k, v in (expansions or {}).items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def field_group(name: Column) -> Column:
    """Semantic group of a field name; the first whose words it contains, after a few stronger rules."""
    n = F.lower(name)
    out = F.when(n.startswith("endorsement"), "Coverage").when(n.endswith("_date") | n.endswith("_dt"), "Date").when(n.endswith("_csat") | n.endswith("_ces"), "Status")
    for group, parts in FIELD_GROUPS.items():
        out = out.when(contains_any(n, parts), group)
    return out.otherwise("Other")


def record_type_of_file(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("polic"), "policies").when(n.contains("claim"), "claims").when(n.contains("survey") | n.contains("cancel"), "survey").otherwise("unknown")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def line_of_business(path: Column) -> Column:
    """First word of a file's name without its extension."""
    return F.lower(F.regexp_extract(basename(path), r"^([A-Za-z0-9]+)", 1))


def sanitize_relation(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.upper(c)), "[^A-Z0-9_]", "_")


def sanitize_label(c: Column, fallback: str = "Entity", digit_prefix: str = "") -> Column:
    """Letters and digits only; ``fallback`` if nothing is left, ``digit_prefix`` before a leading digit."""
    bare = F.regexp_replace(c, "[^A-Za-z0-9]", "")
    return F.when(bare == "", fallback).when(F.lit(bool(digit_prefix)) & bare.rlike("^[0-9]"), F.concat(F.lit(digit_prefix), bare)).otherwise(bare)


def normalize_token(c: Column) -> Column:
    """Lower case; a final s is dropped from words of more than three letters."""
    t = F.lower(c)
    return F.when((F.length(t) > 3) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def humanize_label(c: Column) -> Column:
    """CamelCase and snake_case as lower-case words."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\s]+", " ")))


def humanize_relation(c: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(c, "^HAS_", "")), F.lit("_"), F.lit(" "))


def pascal_case(c: Column) -> Column:
    return F.replace(F.initcap(F.regexp_replace(c, r"[_\-\s]+", " ")), F.lit(" "), F.lit(""))


def vocabulary(c: Column) -> Column:
    """Lower-case words of three letters or more."""
    return F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z]{3,})"), 1), lambda w: F.lower(w))
