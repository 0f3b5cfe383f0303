import pytest

from braidwork.llm import mixing as M
from pyspark.sql import functions as F

TARGETS = "source string, target_share double, max_repeats int, budget double"


def sizes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    return df.select("doc_id", M.source_key(F.col("source")).alias("source"), "tokens", F.xxhash64("doc_id", F.lit("mix")).alias("h"))


def test_shares_repeats_and_reach(spark):
    rows = [(i, " Big_Source", 10) for i in range(3000)] + [(10_000 + i, "small source", 7) for i in range(100)] + [(20_000 + i, "tiny", 5) for i in range(10)] + [(30_000, None, 1000), (30_001, "other", 500), (30_002, "tiny", 0)]
    targets = spark.createDataFrame([("big_source", 0.5, 1, 0.0), ("SMALL_SOURCE", 0.05, 3, None), ("tiny", 0.4, 5, None), ("absent", 0.05, 2, None), (None, 0.1, 1, None), ("big_source", 0.9, 1, None)], TARGETS)
    docs = sizes(spark, rows)
    total = sum(r[2] for r in rows)
    taken, report = M.mix(docs, targets)
    r = {x["source"]: x for x in report.collect()}
    copies = {x["doc_id"]: x["copies"] for x in taken.collect()}
    assert set(r) == {"big_source", "small_source", "tiny", "absent"}
    assert r["big_source"]["budget"] - 10 < r["big_source"]["taken"] <= r["big_source"]["budget"] == pytest.approx(0.5 * total)
    assert not r["small_source"]["reachable"] or r["small_source"]["taken"] <= r["small_source"]["budget"]
    assert not r["tiny"]["reachable"] and r["tiny"]["taken"] == 250 and all(copies[20_000 + i] == 5 for i in range(10))
    assert not r["absent"]["reachable"] and r["absent"]["taken"] == 0 and 30_000 not in copies and 30_001 not in copies
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1) and max(copies.values()) == 5
    for s, x in r.items():
        assert x["taken"] == sum(copies.get(d, 0) * t for d, q, t in rows if q and q.strip().lower().replace(" ", "_") == s)


def test_mixes_are_nested(spark):
    docs = sizes(spark, [(i, "a", 1 + i % 9) for i in range(2000)])
    targets = spark.createDataFrame([("a", 1.0, 1, None)], TARGETS)
    small, large = ({r["doc_id"] for r in M.mix(docs, targets, n)[0].collect()} for n in (1000, 3000))
    assert small < large


def test_empty(spark):
    taken, report = M.mix(sizes(spark, []), spark.createDataFrame([("a", 1.0, 1, None)], TARGETS))
    assert taken.collect() == [] and report.first()["taken"] == 0
    taken, report = M.mix(sizes(spark, [(1, "a", 5)]), spark.createDataFrame([], TARGETS))
    assert taken.collect() == [] and report.collect() == []
