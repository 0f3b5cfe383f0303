"""Structured records to triples: parsing, keys, value types, identities and foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_any

#: Prefix and entity type of each record type, and which types are observations.
PREFIX = {"policies": "POL", "claims": "CLM", "survey": "SRV", "chat": "CHAT", "email": "EMAIL"}
ENTITY_TYPE = {"policies": "PolicyRecord", "claims": "ClaimRecord", "survey": "SurveyRecord", "chat": "ChatRecord", "email": "EmailRecord"}
OBSERVATIONS = ("survey", "chat", "email")
#: Salient fields in order; the first KEY_FIELDS that are filled make the key.
SALIENT = {
    "policies": ("policy effective date", "total building insurance coverage", "rated flood zone", "occupancy type", "property state", "policy cost"),
    "claims": ("date of loss", "cause of damage", "total building insurance coverage", "rated flood zone", "amount paid on building claim", "property state"),
}
KEY_FIELDS = 4
#: Words in a field's name that make its value a date.
DATE_WORDS = ("date", "effective", "termination", "expiration", "loss", "construction", "cancellation", "original")
#: Foreign-key names and the record type they point to, in order of precedence.
FOREIGN_KEYS = (("policy_number", "policies"), ("policy_no", "policies"), ("policy_id", "policies"), ("claim_number", "claims"), ("claim_no", "claims"), ("claim_id", "claims"))
#: Words in a field's name by which it identifies a person or a property; a person comes first.
IDENTITY = {
    "person": ("name", "first name", "last name", "full name", "policyholder", "insured name", "claimant", "email", "e-mail", "email address", "date of birth", "birth date", "dob", "birthday", "phone", "telephone", "mobile", "ssn", "social security"),
    "property": ("address", "street", "city", "state", "zip", "zip code", "postal code", "county", "property address", "mailing address"),
}
IDENTITY_PREFIX = {"person": "PER", "property": "PROP"}
IDENTITY_TYPE = {"person": "Person", "property": "Property"}
LEAST_IDENTITY = 2
#: Attribute that a word in a field's name stands for; the longest word wins.
ATTRIBUTES = {"state": "state", "zip": "zip", "zip code": "zip", "postal code": "zip", "city": "city", "county": "county", "address": "address", "street": "street", "name": "name", "first name": "first_name", "last name": "last_name", "full name": "name", "email": "email", "e-mail": "email", "phone": "phone", "telephone": "phone", "mobile": "phone"}
#: Words that give a field's scope; the first in the alphabet wins.
SCOPES = ("agent", "billing", "claimant", "insured", "loss", "mailing", "mortgagee", "original", "policyholder", "primary", "property", "rated", "reported", "secondary")


def is_structured(source: Column, hierarchy: Column, word: str = "records") -> Column:
    """Whether a chunk holds records (or, with word "schema", field descriptions) of a json or csv source. False for nulls."""
    s, h = F.lower(source), F.lower(F.array_join(hierarchy, " "))
    return F.coalesce((s.contains(".json") | s.contains(".csv")) & h.contains(word), F.lit(False))


def record_type(source: Column, content: Column) -> Column:
    """Record type by words in the source, then in the content, in a fixed order; 'unknown' if none fits."""
    s, c = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    return (
        F.when(s.contains("policies") | c.contains("policies"), "policies")
        .when(s.contains("claims") | c.contains("claims"), "claims")
        .when(s.contains("survey") | contains_any(c, ("nps_score", "nps score", "csat", "rating", "satisfaction", "recommend", "likelihood", "feedback")), "survey")
        .when(s.contains("chat") | contains_any(c, ("conversation", "transcript", "chat_id", "chat session")), "chat")
        .when(s.contains("email") | contains_any(c, ("subject_line", "email_body", "sender", "recipient")), "email")
        .when(contains_any(c, ("date of loss", "date of accident", "date of incident", "cause of damage", "cause of loss", "cause of accident")), "claims")
        .when(contains_any(c, ("policy effective date", "policy cost", "effective date", "inception date")), "policies")
        .otherwise("unknown")
    )


def parse_records(chunks: DataFrame) -> DataFrame:
    """Fields of the RECORD blocks in ``content``: the input's columns, record_no, pos, field, value.

    A line "[Group] a: b | c: d" gives its pairs; the first colon ends the name, and of a repeated field the last value
    holds. Pairs without name or value are left out; null contents have no records.
    """
    keep = [c for c in chunks.columns if c not in ("content", "record_no", "line", "pos", "field", "value")]
    blocks = chunks.select(*keep, F.posexplode(F.split("content", r"(?:^|(?<=\n))RECORD:[\s]*\n")).alias("record_no", "block"))
    lines = blocks.select(*keep, "record_no", F.posexplode(F.split("block", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("pairs", F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*(.+)$", 2)).where("pairs <> ''")
    pairs = lines.select(*keep, "record_no", "line_no", F.posexplode(F.split("pairs", r"\|")).alias("pair_no", "pair")).where(F.instr("pair", ":") > 0)
    at = F.instr("pair", ":")
    pairs = pairs.select(*keep, "record_no", (F.col("line_no") * 10_000 + F.col("pair_no")).alias("pos"), F.trim(F.substr("pair", F.lit(1), at - 1)).alias("field"), F.trim(F.substr("pair", at + 1)).alias("value")).where("field <> '' and value <> ''")
    last = pairs.groupBy(*keep, "record_no", "field").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
    return last.select(*keep, "record_no", "pos", "field", "value")


def composite_key(fields: DataFrame, by: list[str]) -> DataFrame:
    """(by..., record_key) from (by..., record_type, field, value): the prefix with the record's own id, or with a hash.

    The hash takes the first KEY_FIELDS filled salient fields, filled up by the other fields in order of name. Null values
    count as empty.
    """
    rank = F.lit(None).cast("int")
    for kind, names in SALIENT.items():
        for i, n in enumerate(names):
            rank = F.when((F.col("record_type") == kind) & (F.col("field") == n), F.lit(i)).otherwise(rank)
    prefix = F.lit("REC")
    for kind, p in PREFIX.items():
        prefix = F.when(F.col("record_type") == kind, F.lit(p)).otherwise(prefix)
    filled = fields.where("value is not null and value <> ''").select(*by, "record_type", "field", "value", F.struct(F.coalesce(rank, F.lit(99)).alias("r"), F.col("field").alias("f"), F.col("value").alias("v")).alias("x"))
    parts = filled.groupBy(*by, "record_type").agg(F.max(F.when(F.col("field") == "id", F.col("value"))).alias("own"), F.slice(F.array_sort(F.collect_list("x")), 1, KEY_FIELDS).alias("first"))
    digest = F.substring(F.sha2(F.array_join(F.col("first.v"), "|"), 256), 1, 12)
    return parts.select(*by, F.concat(prefix, F.lit("-"), F.coalesce("own", digest)).alias("record_key"))


def value_type(field: Column, value: Column) -> Column:
    """Date, Currency, Percentage, Numeric, Categorical or Text, by the value and by date words in the field's name."""
    bare = F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), "Date")
        .when(value.rlike(r"^\$[\d,]+(\.\d{2})?$"), "Currency")
        .when(value.rlike(r"^[\d.]+\s*%$"), "Percentage")
        .when(contains_any(F.lower(field), DATE_WORDS), "Date")
        .when(value.rlike(r"^-?[\d,]+(\.\d+)?$"), "Numeric")
        .when((F.length(value) <= 5) & bare.rlike(r"^[\p{L}\p{N}]+$"), "Categorical")
        .otherwise("Text")
    )


def relation_of(field: Column) -> Column:
    """HAS_UPPER_SNAKE of a field name without articles and other characters than letters and digits."""
    words = F.filter(F.split(F.lower(field), r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))
    bare = F.trim(F.regexp_replace(F.array_join(words, " "), r"[^a-z0-9\s]", ""))
    return F.concat(F.lit("HAS_"), F.upper(F.regexp_replace(bare, r"\s+", "_")))


def identity_group(field: Column) -> Column:
    """'person', 'property' or null for a field name."""
    f, out = F.lower(field), F.lit(None).cast("string")
    for group, names in reversed(IDENTITY.items()):
        out = F.when(contains_any(f, names), group).otherwise(out)
    return out


def canonical_field(field: Column) -> Column:
    """scope:attribute of a field name, or the attribute alone; the name itself if no attribute word is in it."""
    f = F.lower(field)
    attribute = f
    for word in sorted(ATTRIBUTES, key=lambda w: (len(w), w)):
        attribute = F.when(f.contains(word), ATTRIBUTES[word]).otherwise(attribute)
    scope = F.lit(None).cast("string")
    for word in reversed(SCOPES):
        scope = F.when(f.contains(word), word).otherwise(scope)
    return F.when(scope.isNotNull(), F.concat(scope, F.lit(":"), attribute)).otherwise(attribute)


def identity_fields(fields: DataFrame, by: list[str]) -> DataFrame:
    """(by..., grp, field, value) of identity groups with at least LEAST_IDENTITY fields."""
    marked = fields.select(*by, identity_group(F.col("field")).alias("grp"), "field", "value").where("grp is not null")
    n = F.count(F.lit(1)).over(W.partitionBy(*by, "grp"))
    return marked.withColumn("_n", n).where(F.col("_n") >= LEAST_IDENTITY).drop("_n")


def identity_keys(fields: DataFrame, by: list[str]) -> DataFrame:
    """(by..., grp, identity_key): the same for the same canonical fields and values in any order. Blank values do not count."""
    value = F.lower(F.trim("value"))
    pairs = identity_fields(fields, by).where(F.trim("value") != "").select(*by, "grp", F.struct(canonical_field(F.col("field")).alias("c"), F.col("field").alias("f"), value.alias("v")).alias("x"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["c"], F.lit("="), x["v"])), "|")
    prefix = F.lit("ID")
    for g, p in IDENTITY_PREFIX.items():
        prefix = F.when(F.col("grp") == g, F.lit(p)).otherwise(prefix)
    return pairs.groupBy(*by, "grp").agg(raw.alias("raw")).select(*by, "grp", F.concat(prefix, F.lit("-"), F.substring(F.sha2("raw", 256), 1, 12)).alias("identity_key"))


def foreign_keys(fields: DataFrame, by: list[str], known: DataFrame | None = None) -> DataFrame:
    """(by..., field, value, references, target_key) of fields that name another record; with ``known`` (record_key) only of those there."""
    f, ref = F.replace(F.lower("field"), F.lit(" "), F.lit("_")), F.lit(None).cast("string")
    for name, kind in reversed(FOREIGN_KEYS):
        ref = F.when(f.contains(name), kind).otherwise(ref)
    prefix = F.when(F.col("references") == "policies", "POL").otherwise("CLM")
    out = fields.where("value <> '' and length(value) <= 50").select(*by, "field", "value", ref.alias("references")).where("references is not null").withColumn("target_key", F.concat(prefix, F.lit("-"), "value"))
    return out if known is None else out.join(known.select(F.col("record_key").alias("target_key")), "target_key", "left_semi")


def _typed(kind: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


TRIPLE = ["subject", "subject_type", "relation", "object", "object_type", "span", "confidence", "chunk_id", "source", "source_type", "source_role"]


def record_triples(fields: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Triples of records: IS_A, one HAS_ relation per field, and ABOUT from observations to the records they name.

    ``fields``: by..., record_type, chunk_id, source, field, value. ``keys``: by..., record_key.
    """
    rows = fields.join(keys, by)
    kind = F.col("record_type")
    entity, role = _typed(kind, ENTITY_TYPE, "Record"), F.when(kind.isin(*OBSERVATIONS), "observation").otherwise("entity")
    rows = rows.withColumn("entity", entity).withColumn("role", role)

    def triple(df: DataFrame, relation, obj, obj_type, span) -> DataFrame:
        return df.select(F.col("record_key").alias("subject"), F.col("entity").alias("subject_type"), relation.alias("relation"), obj.alias("object"), obj_type.alias("object_type"), span.alias("span"), F.lit(1.0).alias("confidence"), "chunk_id", "source", F.lit("structured").alias("source_type"), F.col("role").alias("source_role"))

    own = rows.select("record_key", "entity", "chunk_id", "source", "role", *by).distinct()
    is_a = triple(own, F.lit("IS_A"), F.col("entity"), F.lit("RecordType"), F.concat("entity", F.lit(" record from "), "source"))
    span = F.concat("field", F.lit(": "), "value")
    has = triple(rows, relation_of(F.col("field")), F.col("value"), value_type(F.col("field"), F.col("value")), span)
    extra = [c for c in ("record_key", "entity", "chunk_id", "source", "role") if c not in by]
    links = foreign_keys(rows.where("role = 'observation'"), [*by, *extra])
    about = triple(links, F.lit("ABOUT"), F.col("target_key"), _typed(F.col("references"), ENTITY_TYPE, "Record"), span)
    return is_a.unionByName(has).unionByName(about)


def identity_triples(fields: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Triples of identity nodes: IS_A, BELONGS_TO from each record, and the identity's fields. Inputs as for record_triples."""
    info = fields.select(*by, "record_type", "chunk_id", "source").distinct().join(keys, by)
    ids = identity_keys(fields, by).join(info, by).withColumn("id_type", _typed(F.col("grp"), IDENTITY_TYPE, "IdentityEntity"))
    owner = _typed(F.col("record_type"), {k: ENTITY_TYPE[k] for k in ("policies", "claims")}, "Record")

    def triple(df, subject, subject_type, relation, obj, obj_type, span) -> DataFrame:
        return df.select(subject.alias("subject"), subject_type.alias("subject_type"), relation.alias("relation"), obj.alias("object"), obj_type.alias("object_type"), span.alias("span"), F.lit(1.0).alias("confidence"), "chunk_id", "source", F.lit("structured").alias("source_type"))

    key, kind = F.col("identity_key"), F.col("id_type")
    is_a = triple(ids, key, kind, F.lit("IS_A"), kind, F.lit("IdentityType"), F.concat(kind, F.lit(" identity from "), "source"))
    belongs = triple(ids, F.col("record_key"), owner, F.lit("BELONGS_TO"), key, kind, F.concat("record_key", F.lit(" belongs to "), kind, F.lit(" "), key))
    props = ids.join(identity_fields(fields, by), [*by, "grp"])
    has = triple(props, key, kind, relation_of(F.col("field")), F.col("value"), value_type(F.col("field"), F.col("value")), F.concat("field", F.lit(": "), "value"))
    return is_a.unionByName(belongs).unionByName(has)


def extract_structured(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, prose chunks, schema chunks) of chunks with chunk_id, source, content and section_hierarchy."""
    schema = is_structured(F.col("source"), F.col("section_hierarchy"), "schema")
    data = is_structured(F.col("source"), F.col("section_hierarchy")) & ~schema
    rows = chunks.where(data).select(F.col("chunk_id").cast("string").alias("chunk_id"), "source", "content", record_type(F.col("source"), F.col("content")).alias("record_type"))
    fields, by = parse_records(rows), ["source", "chunk_id", "record_no"]
    keys = composite_key(fields, by)
    return record_triples(fields, keys, by).unionByName(identity_triples(fields, keys, by), allowMissingColumns=True), chunks.where(~data & ~schema), chunks.where(schema)
