from braidwork.llm import dedup as D
from pyspark.sql import functions as F

SCHEMA = "seq long, subject string, relation string, object string, copies string, h string"


def canon(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["c"] for r in df.select("i", D.canonical(F.col("v")).alias("c")).orderBy("i").collect()]


def test_canonical(spark):
    c = canon(spark, ["Waiting – Period (Clause)", "waiting period\tclause", "-$1,091.91", "USD -1091.91", "12k-15k", "1.2", "12", "a: 1 | b: x", "B = X; A=1", "b x a 1", "", None, "--", "x​y", "1. 2", "É", "x" * 200_000])
    assert c[0] == c[1] == "waitingperiodclause"
    assert c[2] == "-1091.91" and c[3] == "usd-1091.91" and c[4] == "12k15k" and c[5] != c[6]
    assert c[7] == c[8] == "a1bx" and c[9] == "bxa1"
    assert c[10] == "" and c[11] is None and c[12] == "" and c[13] == "xy" and c[14] == "12" and c[15] == "é" and len(c[16]) == 200_000


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["keep"], r["dup"]) for r in D.copy_pairs(df, ["subject", "relation", "object"], "seq").collect()}


def test_groups_nulls_and_clashing_columns(spark):
    rows = [(5, "A b", "R", "x: 1 | y: 2", "9", "z"), (3, "a-B", "r", "y=2;x=1", None, None), (8, "AB", "R", "x1y2", None, None), (9, "x1y2", "R", "AB", None, None), (1, None, "R", "x", None, None), (2, "", "R", "x", None, None), (4, None, "r", "X", None, None), (None, "AB", "R", "x1y2", None, None)]
    assert pairs(spark, rows) == {(3, 5), (3, 8), (1, 4)}
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r["seq"]: r["copies"] for r in D.collapse(df, ["subject", "relation", "object"], "seq").collect()}
    assert kept == {3: 3, 9: 1, 1: 2, 2: 1}
    assert not any(r["collides"] for r in D.copy_groups(D.keyed(df, ["subject", "relation", "object"], "seq")).collect())


def test_empty(spark):
    assert pairs(spark, []) == set()


def test_a_hot_group(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("subject"), F.lit("r").alias("relation"), F.lit("o").alias("object"))
    got = D.copy_pairs(df, ["subject", "relation", "object"], "seq")
    assert got.count() == n // 3 - 1 and got.select("keep").distinct().collect()[0][0] == 0


def test_a_collision_of_128_bits_is_reported_and_kept_apart(spark):
    keys = spark.createDataFrame([(1, bytearray(16), 5), (2, bytearray(16), 5), (3, bytearray(16), 6)], "id long, h binary, chk long")
    assert {(r["keep"], r["copies"], r["collides"]) for r in D.copy_groups(keys).collect()} == {(1, 2, True), (3, 1, True)}
