"""Mix sources to target shares of all tokens by hash thresholds.

Every record has a fixed hash. A source's records below a threshold get one copy more than the others, and a larger
budget only ever raises the threshold, so mixes are nested. The threshold comes from a histogram of tokens by source and
hash bucket: the running sum passes the budget in one bucket, and only that bucket is cut finer. Nothing is sorted, and
what reaches the driver is a few numbers per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import bounded_rows, materialize
from .tokens import TOKENIZERS, VOCABULARY, token_count

#: Sources a table of targets may name.
MAX_SOURCES = 10_000
#: Bits of the hash by which each level of histograms cuts, and how many levels there are.
BITS, LEVELS = 12, 4


def source_key(c: Column) -> Column:
    """Source name without case and outer white space, with "_" between words."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}_]+", " ")), " ", "_")


def sized(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, h) of every document, made once. A null source stays null, a null text has 0 tokens."""
    rows = documents.select(F.col(id_col).alias("doc_id"), source_key(F.col("source")).alias("source"), token_count(F.col(text_col), directory, vocabulary).alias("tokens"))
    return materialize(rows.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))), "document-sizes")


def thresholds(docs: DataFrame, budgets: dict[str, int]) -> dict[str, int]:
    """For each source the largest cut of the hash's upper 48 bits below which its tokens stay within the budget."""
    spark, width = docs.sparkSession, BITS * LEVELS
    state = {s: (0, b) for s, b in budgets.items() if b > 0}  # prefix of the bucket that the budget ends in, tokens left for it
    done = {s: 0 for s in budgets}
    for level in range(1, LEVELS + 1):
        if not state:
            break
        now = F.broadcast(spark.createDataFrame([(s, p, b) for s, (p, b) in state.items()], "source string, prefix long, budget long"))
        hit = docs.join(now, "source").withColumn("bucket", F.shiftrightunsigned("h", 64 - BITS * level))
        if level > 1:
            hit = hit.where(F.shiftrightunsigned("h", 64 - BITS * (level - 1)) == F.col("prefix"))
        sums = hit.groupBy("source", "bucket", "budget").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("t").over(W.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("t")).alias("left"), "n")).alias("x"))
        following = {}
        for r in over.select("source", "x.*").collect():
            done[r["source"]] = r["bucket"] << (width - BITS * level)
            if r["n"] > 1 and r["left"] > 0:
                following[r["source"]] = (r["bucket"], r["left"])
        state = following
    return done


def mix(docs: DataFrame, targets: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, report) of a mix of ``size`` tokens, by default as many as all documents have, each counted once.

    records: doc_id, source, tokens, copies of every record that is taken at least once. report: one row per target with
    source, target_share, max_repeats, available, budget, taken, plan_share (of the size asked for), actual_share (of what
    was taken) and reachable. ``docs`` comes from :func:`sized`; ``targets`` has source, target_share, max_repeats.

    A source takes whole passes as long as they fit, then the records below its threshold once more, which stays below
    the budget by less than one record. A source that cannot reach its share is taken max_repeats times. Records of
    sources without a target, or of none, are left out but count in the default size. A target without records reports
    0; targets with a null field are ignored, and of repeated targets the first by share and repeats counts.
    """
    spark = docs.sparkSession
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null")
    goals = {r["source"]: r for r in reversed(sorted(bounded_rows(wanted, MAX_SOURCES, "mix targets")))}
    names = spark.createDataFrame([(s,) for s in goals], "source string")
    sums = {r["source"]: r["t"] for r in docs.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    if size is None:
        size = docs.agg(F.sum("tokens")).first()[0] or 0
    plan = []
    for s, g in goals.items():
        available, budget = sums.get(s, 0), g["target_share"] * size
        passes = min(g["max_repeats"], int(budget // available)) if available else 0
        rest = int(budget - passes * available) if passes < g["max_repeats"] and available else 0
        plan.append((s, g["target_share"], g["max_repeats"], available, float(budget), passes, rest, available * g["max_repeats"] >= budget))
    cuts = thresholds(docs, {p[0]: p[6] for p in plan})
    rows = [(*p[:6], cuts[p[0]], p[7]) for p in plan]
    plans = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available long, budget double, passes int, cut long, reachable boolean")
    copies = F.col("passes") + (F.shiftrightunsigned("h", 64 - BITS * LEVELS) < F.col("cut")).cast("int")
    taken = docs.join(F.broadcast(plans.select("source", "passes", "cut")), "source").select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")
    by_source = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"))
    report = plans.join(F.broadcast(by_source), "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    total = F.sum("taken").over(W.partitionBy())
    report = report.select("source", "target_share", "max_repeats", "available", "budget", "taken", (F.col("taken") / F.lit(float(max(size, 1)))).alias("plan_share"), F.coalesce(F.try_divide("taken", total), F.lit(0.0)).alias("actual_share"), "reachable")
    return taken, report
