"""Relation names to canonical ones, and literal values to node properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import bounded_rows
from .filters import synonym

#: Relations that are never merged, and words that do not count as content of a name.
PROTECTED = ("HAS_VALUE", "HAS_AMOUNT", "HAS_COST", "HAS_NAME", "HAS_TYPE", "HAS_STATUS", "HAS_DATE", "HAS_ID", "HAS_CODE", "HAS_SCORE", "IS_A", "HAS")
STOP = ("HAS", "OF", "THE", "A", "AN", "IS", "FOR", "BY", "IN", "TO", "FROM")
#: Relations and types whose objects stay nodes, types that are values, and short words that are values.
ENTITY_RELATIONS = ("HAS_ADDRESS", "LOCATED_AT", "HAS_INSURED_NAME", "HAS_POLICYHOLDER", "HAS_AGENT", "HAS_CLAIMANT", "HAS_BENEFICIARY", "HAS_OWNER", "LINKED_TO", "SAME_AS")
ENTITY_TYPES = ("Person", "Organization", "Property", "Building", "InsuredProperty", "Company", "Agency", "Agent")
VALUE_TYPES = ("Currency", "Date", "Numeric", "Percentage", "Categorical", "Text", "TimePeriod", "FinancialAmount")
VALUE_WORDS = ("yes", "no", "n/a", "na", "true", "false", "unknown", "none", "null", "other", "pending", "active", "inactive", "closed", "open", "approved", "denied", "completed")
#: Names of relations that the driver may hold for the greedy merge.
MAX_RELATIONS = 5000


def pattern_normalize(relation: Column) -> Column:
    """EXCLUDES_... , long COVERS_... and PROVIDES_... of cover become EXCLUDED_FROM and COVERS."""
    provides = relation.startswith("PROVIDES_") & (relation.contains("COVERAGE") | relation.contains("INSURANCE") | relation.contains("PROTECTION"))
    return F.when(relation.startswith("EXCLUDES_"), "EXCLUDED_FROM").when(relation.startswith("COVERS_") & (F.length(relation) > 8), "COVERS").when(provides, "COVERS").otherwise(relation)


def normalize_relation(relation: Column) -> Column:
    """Upper snake case, two steps of synonyms, then the patterns."""
    safe = F.regexp_replace(F.trim(F.upper(relation)), "[^A-Z0-9_]", "_")
    return let(synonym(let(synonym(safe), lambda r: r)), pattern_normalize)


def content_tokens(relation: Column) -> Column:
    words = F.split(F.upper(F.replace(relation, F.lit("HAS_"), F.lit(""))), "_")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP)))


def relation_merges(triples: DataFrame, similarity: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(relation, canonical) of HAS_ relations that mean the same.

    ``similarity`` has a, b, sim for pairs of relations with a < b. A pair merges if its similarity reaches the threshold,
    the names share a content word, and the known object types overlap or one side has none. Relations are taken in order
    of name; each that is free gathers its partners, and the shortest name, then the first, stands for all. Chains end at
    their last name. The pairs are counted first: names are a vocabulary, not data.
    """
    spark = triples.sparkSession
    types = triples.where(F.col("relation").startswith("HAS_") & ~F.col("relation").isin(*PROTECTED)).groupBy("relation").agg(F.collect_set(F.when(F.col("object_type") != "Unknown", F.col("object_type"))).alias("types")).withColumn("words", content_tokens(F.col("relation")))
    a, b = types.select(F.col("relation").alias("a"), F.col("types").alias("ta"), F.col("words").alias("wa")), types.select(F.col("relation").alias("b"), F.col("types").alias("tb"), F.col("words").alias("wb"))
    pairs = similarity.where(F.col("sim") >= threshold).join(a, "a").join(b, "b").where(F.arrays_overlap("wa", "wb") & ((F.size("ta") == 0) | (F.size("tb") == 0) | F.arrays_overlap("ta", "tb")))
    partners: dict[str, list[str]] = {}
    for r in sorted(bounded_rows(pairs.select("a", "b"), MAX_RELATIONS, "relation pairs")):
        partners.setdefault(r["a"], []).append(r["b"])
    merged: dict[str, str] = {}
    for rel in sorted(partners):
        if rel in merged:
            continue
        group = [rel, *(x for x in partners[rel] if x not in merged)]
        best = min(group, key=lambda x: (len(x), x))
        merged.update({x: best for x in group if x != best})

    def root(x: str) -> str:
        seen = set()
        while x in merged and x not in seen:
            seen.add(x)
            x = merged[x]
        return x

    return spark.createDataFrame([(k, root(k)) for k in sorted(merged)], "relation string, canonical string")


def apply_relation_map(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """``triples`` with the canonical relation where ``mapping`` has one, else by synonyms and patterns."""
    m = mapping.select("relation", F.col("canonical").alias("_c"))
    fixed = let(synonym(F.col("relation")), lambda r: F.when(r != F.col("relation"), r).otherwise(pattern_normalize(F.col("relation"))))
    return triples.join(m, "relation", "left").withColumn("relation", F.coalesce("_c", fixed)).select(*triples.columns)


def is_literal(obj: Column, object_type: Column) -> Column:
    """Whether an object is a value rather than an entity. Null types count as unknown."""
    kind = F.coalesce(object_type, F.lit("Unknown"))
    shaped = obj.rlike(r"^\$[\d,]+\.?\d*$") | obj.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{2,4}$|^\d{4}$") | obj.rlike(r"^-?[\d,]+\.?\d*%?$") | obj.rlike(r"^[A-Z0-9]{1,5}$")
    return F.when(kind.isin(*ENTITY_TYPES), False).when(kind.isin(*VALUE_TYPES), True).otherwise(shaped | F.lower(obj).isin(*VALUE_WORDS))


def collapse_candidates(triples: DataFrame) -> DataFrame:
    literal = is_literal(F.col("object"), F.col("object_type"))
    return triples.where(F.col("relation").startswith("HAS_") & ~F.col("relation").isin(*ENTITY_RELATIONS) & F.col("object").isNotNull() & literal)


def relation_roles(candidates: DataFrame) -> DataFrame:
    """(relation, total, n_values, numeric, long_digits, role): measure and dimension stay nodes, property may collapse."""
    plain = F.replace(F.replace("object", F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    number = plain.rlike(r"^-?[\d,]+\.?\d*%?$")
    digits = F.length(F.regexp_replace("object", r"[$,.\-]", ""))
    by_value = candidates.groupBy("relation", "object").agg(F.count(F.lit(1)).alias("n")).withColumn("num", number).withColumn("long", number & (digits > 8))
    stats = by_value.groupBy("relation").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_values"), F.sum(F.when(F.col("num"), F.col("n")).otherwise(0)).alias("numeric"), F.sum(F.when(F.col("long"), F.col("n")).otherwise(0)).alias("long_digits"))
    card, frac, long = F.col("n_values") / F.col("total"), F.col("numeric") / F.col("total"), F.coalesce(F.try_divide("long_digits", "numeric"), F.lit(0.0))
    role = F.when((frac > 0.8) & (card > 0.5) & (card <= 0.95) & (long < 0.5), "measure").when((F.col("total") / F.col("n_values") >= 2) & (F.col("n_values") >= 2), "dimension").otherwise("property")
    return stats.withColumn("role", role)


def collapse(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples left, properties): literal objects of few subjects become (subject, property, value), the last by seq wins.

    An object collapses if its relation is a property and it has one subject, or up to three and at most 15 characters.
    The hottest objects are counted with partial sums and joined back as one row each.
    """
    c = collapse_candidates(triples)
    users = c.select("object", "subject").distinct().groupBy("object").agg(F.count(F.lit(1)).alias("users")).where((F.col("users") == 1) | ((F.col("users") <= 3) & (F.length("object") <= 15)))
    roles = relation_roles(c).where("role = 'property'").select("relation")
    gone = c.join(roles, "relation", "left_semi").join(users.select("object"), "object", "left_semi").select("seq", "subject", F.lower(F.regexp_replace("relation", "^HAS_", "")).alias("property"), "object")
    properties = gone.groupBy("subject", "property").agg(F.max_by("object", "seq").alias("value"))
    return triples.join(gone.select("seq"), "seq", "left_anti"), properties


def vocabulary_quality(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: vocab_size, types_used, vocab_used, utilization of a relation vocabulary (relation)."""
    used = triples.select("relation").where("relation is not null").distinct().withColumn("u", F.lit(1))
    vocab = vocabulary.select("relation").distinct().withColumn("v", F.lit(1))
    both = vocab.join(used, "relation", "full")
    return both.agg(F.count("v").alias("vocab_size"), F.count("u").alias("types_used"), F.count(F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), 1)).alias("vocab_used")).withColumn("utilization", F.coalesce(F.try_divide("vocab_used", "vocab_size"), F.lit(0.0)))


def map_types(assignments: DataFrame, mapping: DataFrame) -> DataFrame:
    """(entity_id, class) from (entity_id, entity_type) and (entity_type, class); a type mapped to null drops its entities."""
    m = mapping.select("entity_type", F.col("class").alias("_c"), F.lit(True).alias("_known"))
    return assignments.join(m, "entity_type", "left").where("_known is null or _c is not null").select("entity_id", F.coalesce("_c", "entity_type").alias("class"))
