import datetime
from decimal import Decimal

from braidwork.functions import values as V
from braidwork.operators import wide as W
from pyspark.sql import functions as F

TRIPLES = "seq long, subject string, relation string, object string, extracted_at timestamp, ingested_at timestamp, value string, key string"


def at(day):
    return datetime.datetime(2024, 1, day)


def inputs(spark, rows):
    t = spark.createDataFrame(rows, TRIPLES)
    types = spark.createDataFrame([("HAS_COST", "decimal"), ("HAS_START_DATE", "date"), ("HAS_FLAG", "boolean"), ("HAS_COUNT", "integer"), ("HAS_RATE", "percent"), ("HAS_CITY", "text"), ("HAS_ADDRESS", "parts"), (None, "text"), ("HAS_ODD", "no type")], "relation string, value_type string")
    return t, types, spark.createDataFrame([("n/a",), ("-",), (None,)], "marker string")


def cells(spark, rows):
    t, types, markers = inputs(spark, rows)
    wide = W.wide_table(t, types, markers, share=0.2)
    return wide, {(r["subject"], r["relation"]): r["value"] for r in W.filled_cells(wide, W.attribute_schema(types)).collect()}


def test_cells_are_read_and_the_latest_readable_one_wins(spark):
    p = "POL-0123456789ab"
    rows = [
        (1, p, "HAS_COST", "$1,000.00", at(1), None, "x", "y"), (2, "pol_0123456789AB", "has cost", "USD -12.5", at(2), None, None, None), (3, p, "HAS_COST", "see note", at(3), None, None, None),
        (4, "[POL–0123456789AB]", "hasStartDate", " 02/27/2025 ", at(1), None, None, None), (5, p, "HAS_FLAG", "Y", at(1), None, None, None), (6, p, "HAS_COUNT", "2,169.0", at(1), None, None, None),
        (7, p, "HAS_RATE", "15.5 %", at(1), None, None, None), (8, p, "HAS_CITY", "«Marlow  Bend.»", at(1), None, None, None), (9, p, "HAS_ADDRESS", "city: A | zip: 1", at(1), None, None, None),
        (10, "CLM-0123456789ab", "HAS_CITY", " N/A ", at(1), None, None, None), (11, "Some Organization", "HAS_COST", "5", at(1), None, None, None), (12, None, "HAS_COST", "5", at(1), None, None, None),
        (13, "SRV-00000000000a", "HAS_COUNT", None, at(1), None, None, None), (14, "SRV-00000000000a", "HAS_COUNT", "3", None, None, None, None), (15, "SRV-00000000000a", None, "4", None, None, None, None),
        (16, "EMAIL-00000000000a", "HAS_COUNT", "7", at(1), at(1), None, None), (17, "EMAIL-00000000000a", "HAS_COUNT", "8", at(1), at(2), None, None), (16, "EMAIL-00000000000a", "HAS_COUNT", "7", at(1), at(1), None, None),
    ]
    wide, found = cells(spark, rows)
    assert found == {
        (p, "HAS_COST"): "-12.50", (p, "HAS_START_DATE"): "2025-02-27", (p, "HAS_FLAG"): "true", (p, "HAS_COUNT"): "2169", (p, "HAS_RATE"): "15.50", (p, "HAS_CITY"): "marlowbend",
        ("SRV-00000000000a", "HAS_COUNT"): "3", ("EMAIL-00000000000a", "HAS_COUNT"): "8",
    }
    row = wide.where(F.col("subject") == p).first()
    assert (row["HAS_COST"], row["HAS_START_DATE"], row["HAS_FLAG"], row["HAS_ADDRESS"], row["record_type"]) == (Decimal("-12.50"), datetime.date(2025, 2, 27), True, "city: A | zip: 1", "POL")
    assert wide.count() == 3


def test_many_sets_share_tables_and_an_empty_input_keeps_the_columns(spark):
    rows = [(i, f"CLM-{i:012x}", r, "1", at(1), None, None, None) for i in range(30) for k, r in enumerate(("HAS_COST", "HAS_COUNT", "HAS_FLAG")) if i >> k & 1]
    wide, found = cells(spark, rows)
    assert len(found) == len(rows) and wide.count() == len({r[1] for r in rows})
    empty, none = cells(spark, [])
    assert not none and set(wide.columns) == set(empty.columns)


def test_one_hot_cell(spark):
    t = spark.range(20_000).select(F.col("id").alias("seq"), F.lit("POL-00000000000a").alias("subject"), F.lit("HAS_COUNT").alias("relation"), F.col("id").cast("string").alias("object"), F.timestamp_seconds("id").alias("extracted_at"), F.lit(None).cast("timestamp").alias("ingested_at"))
    _, types, markers = inputs(spark, [])
    assert W.wide_table(t, types, markers).first()["HAS_COUNT"] == 19_999


def read(spark, reader, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", reader(V.squeeze(F.col("v"))).cast("string").alias("x")).orderBy("i").collect()]


def test_readers(spark):
    assert read(spark, V.read_date, ["2021-09-05T00:00:00.000Z", "20240626", "20 Apr 2024", "Apr 2, 2024", "2023-02-30", "spring 2022", None, ""]) == ["2021-09-05", "2024-06-26", "2024-04-20", "2024-04-02", None, None, None, None]
    assert read(spark, V.read_decimal, ["-$3,966.75", "12 USD", "12k-15k", "1.2.3", "$", "1,23", "USD 5 USD"]) == ["-3966.75", "12.00", None, None, None, None, None]
    assert read(spark, V.read_integer, ["18.0", "3-4", "7 or 8", "3.5", "99999999999999999999", "007"]) == ["18", None, None, None, None, "7"]
    assert read(spark, V.read_percent, ["73 pct", "%", "n.n %", "5"]) == ["73.00", None, None, None]
    assert read(spark, V.read_boolean, ["yES", "0", "maybe", "2"]) == ["true", "false", None, None]
    assert read(spark, V.read_text, ["--", "x" * 100_000]) == [None, "x" * 100_000]


def test_each_entity_in_the_smallest_table_that_has_its_attributes(spark):
    schema = [W.Attribute(f"A{i}", "text") for i in range(5)]
    rows = [("POL-a", [0, 1, 2])] * 10 + [("POL-b", [0, 1])] * 6 + [("POL-c", [1])] + [("CLM-d", [2])] * 2 + [("CLM-e", [3, 4])] + [("POL-f", [0, 3])]
    cells = [(f"{s}{n}", f"A{a}", f"v{a}") for n, (s, at) in enumerate(rows) for a in at]
    sets = W.attribute_sets(spark.createDataFrame(cells, "subject string, relation string, value string"), schema)
    frequent, per_type = W.table_plan(sets, 0.2)
    assert frequent == [(0, 1, 2), (0, 1)] and per_type == {"POL": (0, 1, 2, 3), "CLM": (2, 3, 4)}
    got = {r["subject"].rstrip("0123456789"): (r["table_id"], r["vals"]) for r in W.placed(sets, frequent, per_type, 5).collect()}
    assert got == {
        "POL-a": ("set0", ["v0", "v1", "v2"]), "POL-b": ("set1", ["v0", "v1"]), "POL-c": ("set1", [None, "v1"]), "CLM-d": ("set0", [None, None, "v2"]), "CLM-e": ("rest-CLM", [None, "v3", "v4"]),
        "POL-f": ("rest-POL", ["v0", None, None, "v3"]),
    }
    n = W.set_coverage(sets, 0.2, 5).first()
    assert (n["entities"], n["in_exact"], n["in_superset"], n["in_rest"], n["tables"]) == (21, 16, 3, 2, 4)
