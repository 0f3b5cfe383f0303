"""Attribute rows to wide tables by characteristic sets.

Entities are grouped by the exact set of attributes they have. Each set that a share of all entities has becomes a dense
table with just its columns. An entity with a rarer set joins the table of the smallest frequent set that has all its
attributes, so that few of its columns stay empty. Entities whose attributes no frequent set has, as those with a rare
attribute, share one table per record type, whose set is the union of all sets of that type. The tables are then united by
name with missing columns left null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import TYPES, letters_digits, read_as, squeeze
from ..session import bounded_rows, table_path

#: Columns a wide table may have. A schema table beyond it is refused: it holds data, not a schema.
MAX_ATTRIBUTES = 4000
#: Share of all entities from which a set is frequent; so there are at most 1/FREQUENT dense tables.
FREQUENT = 1 / 500


@dataclass(frozen=True)
class Attribute:
    name: str
    value_type: str


def attribute_schema(types: DataFrame) -> list[Attribute]:
    """Attributes in order of name. Rows with a null or a type that is not known are left out; repeated names count once."""
    known = types.select("relation", "value_type").where(F.col("value_type").isin(*TYPES) & F.col("relation").isNotNull()).distinct()
    found: dict[str, str] = {}
    for r in sorted(bounded_rows(known, MAX_ATTRIBUTES, "attribute schema")):
        found.setdefault(r["relation"], r["value_type"])
    return [Attribute(k, v) for k, v in found.items()]


def entity_key(c, prefixes: tuple[str, ...]):
    """``PREFIX-hex`` of a record id in any spelling of case, brackets, separators and white space; null for other names."""
    bare = F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    regex = rf"^({'|'.join(prefixes)})([0-9A-F]{{12}})$"
    return F.when(bare.rlike(regex), F.concat(F.regexp_extract(bare, regex, 1), F.lit("-"), F.lower(F.regexp_extract(bare, regex, 2))))


def attribute_cells(triples: DataFrame, schema: list[Attribute], markers: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(subject, relation, value): the latest readable object of each cell, as the normal string of its type.

    Null subjects, relations and objects, placeholders and objects that do not read as the type as a whole are left out.
    The latest is by extracted_at, then ingested_at, then seq; a null time is older than any. The partial maximum before
    the shuffle leaves at most one row per cell and task, however many rows one cell has.
    """
    spark = triples.sparkSession
    names = spark.createDataFrame([(a.name, a.value_type) for a in schema], "relation string, value_type string")
    names = names.withColumn("key", letters_digits(F.col("relation")))
    blank = [r[0] for r in bounded_rows(markers.select(F.lower(squeeze(F.col("marker"))).alias("m")).where("m is not null").distinct(), what="placeholder list")]
    rows = triples.select(
        entity_key(F.col("subject"), prefixes).alias("subject"), letters_digits(F.col("relation")).alias("key"), squeeze(F.col("object")).alias("object"), "extracted_at", "ingested_at", "seq"
    ).where(F.col("subject").isNotNull() & F.col("object").isNotNull())
    rows = rows.where(~F.lower("object").isin(*blank, ""))
    rows = rows.join(F.broadcast(names), "key").withColumn("value", read_as(F.col("object"), F.col("value_type"))).where("value is not null")
    latest = F.max(F.struct("extracted_at", "ingested_at", "seq", "value"))
    return rows.groupBy("subject", "relation").agg(latest.alias("best")).select("subject", "relation", F.col("best.value").alias("value"))


def _bits(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of 0 and 1: which of ``width`` attributes each set has."""
    out = np.zeros((len(sets), width), dtype=np.float32)
    if len(sets):
        out[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)] = 1
    return out


def smallest_superset(attributes: Column, frequent: list[tuple[int, ...]], width: int) -> Column:
    """Place in ``frequent`` of the smallest set that has all of ``attributes``, the first of equal ones; -1 if none has."""
    order = np.array(sorted(range(len(frequent)), key=lambda i: (len(frequent[i]), i)), dtype=np.int64)
    lacks = 1 - _bits([np.array(frequent[i]) for i in order], width).T

    @F.pandas_udf("int")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if not len(order):
                yield pd.Series(np.full(len(s), -1), index=s.index, dtype="int32")
                continue
            fits = (_bits([np.asarray(x) for x in s], width) @ lacks) == 0
            yield pd.Series(np.where(fits.any(axis=1), order[fits.argmax(axis=1)], -1), index=s.index, dtype="int32")

    return find(attributes)


def attribute_sets(cells: DataFrame, schema: list[Attribute]) -> DataFrame:
    """(subject, record_type, attributes, vals): the places in ``schema`` of an entity's attributes, ascending, and their values."""
    index = cells.sparkSession.createDataFrame([(a.name, i) for i, a in enumerate(schema)], "relation string, at int")
    sets = cells.join(F.broadcast(index), "relation").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))
    return sets.select("subject", F.split("subject", "-")[0].alias("record_type"), F.col("cells.at").alias("attributes"), F.col("cells.value").alias("vals"))


def table_plan(sets: DataFrame, share: float = FREQUENT) -> tuple[list[tuple[int, ...]], dict[str, tuple[int, ...]]]:
    """(frequent sets, most frequent first; all attributes of each record type).

    Sets are counted with partial sums. What is collected is at most 1/``share`` sets, and a row per record type.
    """
    rows = sets.count()
    counts = sets.groupBy("attributes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, rows * share))
    frequent = [tuple(r["attributes"]) for r in counts.orderBy(F.desc("n"), "attributes").collect()]
    per_type = sets.select("record_type", F.explode("attributes").alias("at")).distinct().groupBy("record_type").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return frequent, {r["record_type"]: tuple(r["at"]) for r in per_type.collect()}


def placed(sets: DataFrame, frequent: list[tuple[int, ...]], per_type: dict[str, tuple[int, ...]], width: int) -> DataFrame:
    """(subject, record_type, vals, table_id): ``vals`` in the order of the columns of the entity's table, null where missing."""
    spark = sets.sparkSession
    tables = [(f"set{i}", list(s)) for i, s in enumerate(frequent)] + [(f"rest-{k}", list(s)) for k, s in sorted(per_type.items())]
    columns = spark.createDataFrame(tables, "table_id string, columns array<int>")
    at = smallest_superset(F.col("attributes"), frequent, width)
    found = sets.withColumn("at", at).withColumn("table_id", F.when(F.col("at") >= 0, F.concat(F.lit("set"), F.col("at"))).otherwise(F.concat(F.lit("rest-"), F.col("record_type"))))
    aligned = F.transform("columns", lambda c: F.get("vals", (F.array_position("attributes", c) - 1).cast("int")))
    vals = F.when(F.col("columns") == F.col("attributes"), F.col("vals")).otherwise(aligned)
    return found.join(F.broadcast(columns), "table_id").select("subject", "record_type", vals.alias("vals"), "table_id")


def wide_table(triples: DataFrame, types: DataFrame, markers: DataFrame, prefixes: tuple[str, ...] = ("POL", "CLM", "SRV", "CHAT", "EMAIL"), share: float = FREQUENT) -> DataFrame:
    """One row per entity: subject, record_type and one typed column per attribute of ``types``.

    An entity with no readable cell has no row. An empty input gives an empty table with all columns. Extra columns of
    the inputs are ignored.
    """
    spark, schema = triples.sparkSession, attribute_schema(types)
    sets = attribute_sets(attribute_cells(triples, schema, markers, prefixes), schema)
    # The sets go to the shared folder once and are counted there; then each entity goes to its table's partition.
    path = table_path(spark, "attribute-sets")
    sets.write.parquet(path)
    sets = spark.read.schema(sets.schema).parquet(path)
    frequent, per_type = table_plan(sets, share)
    by_table = table_path(spark, "characteristic-sets")
    placed(sets, frequent, per_type, len(schema)).hint("rebalance", "table_id").write.partitionBy("table_id").parquet(by_table)
    stored = spark.read.schema("subject string, record_type string, vals array<string>, table_id string").parquet(by_table)
    empty = spark.createDataFrame([], "subject string, record_type string, " + ", ".join(f"`{a.name}` {TYPES[a.value_type]}" for a in schema))
    parts = [empty]
    for table_id, found in [*((f"set{i}", s) for i, s in enumerate(frequent)), *((f"rest-{k}", s) for k, s in sorted(per_type.items()))]:
        typed = [f"CAST(vals[{k}] AS {TYPES[schema[a].value_type]}) AS `{schema[a].name}`" for k, a in enumerate(found)]
        parts.append(stored.where(F.col("table_id") == table_id).selectExpr("subject", "record_type", *typed))
    while len(parts) > 1:  # in pairs, so that the plan is analysed a number of times that grows with the tables' logarithm
        parts = [a[0].unionByName(a[1], allowMissingColumns=True) if len(a) > 1 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0].select(*[f"`{c}`" for c in empty.columns])


def set_coverage(sets: DataFrame, share: float, width: int) -> DataFrame:
    """One row: entities, in_exact, in_superset, in_rest, tables, filled: entities by the kind of their table, and the share
    of filled cells over the columns of the tables."""
    frequent, per_type = table_plan(sets, share)
    sizes = sets.sparkSession.createDataFrame([(i, len(s)) for i, s in enumerate(frequent)], "at int, columns int")
    rest = F.create_map(*[x for k, s in sorted(per_type.items()) for x in (F.lit(k), F.lit(len(s)))]) if per_type else F.create_map().cast("map<string,int>")
    rows = sets.withColumn("at", smallest_superset(F.col("attributes"), frequent, width)).join(F.broadcast(sizes), "at", "left")
    own, n = F.size("attributes"), F.coalesce("columns", rest[F.col("record_type")])
    kind = F.when(F.col("at") < 0, "rest").when(own == F.col("columns"), "exact").otherwise("superset")
    counts = [F.count(F.when(kind == k, 1)).alias(f"in_{k}") for k in ("exact", "superset", "rest")]
    return rows.agg(F.count(F.lit(1)).alias("entities"), *counts, F.lit(len(frequent) + len(per_type)).alias("tables"), F.round(F.try_divide(F.sum(own), F.sum(n)), 4).alias("filled"))


def filled_cells(wide: DataFrame, schema: list[Attribute], skip: tuple[str, ...] = ("parts",)) -> DataFrame:
    """(subject, relation, value) of every filled cell, value in its normal written form."""
    kept = [a for a in schema if a.value_type not in skip]
    shown = [letters_digits(F.col(f"`{a.name}`")) if a.value_type in ("text", "parts") else F.col(f"`{a.name}`").cast("string") for a in kept]
    long = wide.select("subject", F.explode(F.array(*[F.struct(F.lit(a.name).alias("relation"), v.alias("value")) for a, v in zip(kept, shown)])).alias("cell")) if kept else None
    if long is None:
        return wide.select("subject", F.lit("").alias("relation"), F.lit("").alias("value")).limit(0)
    return long.select("subject", "cell.relation", "cell.value").where("value is not null")

