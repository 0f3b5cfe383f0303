"""Near-identical entity names to one: candidates, similar pairs, components, canonical names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, materialize

#: Prefixes of ids that are never merged, and the cosine from which names are.
PREFIXES = ("POL-", "CLM-", "REC-", "PER-", "PROP-")
THRESHOLD = 0.90
#: Keyed rows that one task compares.
TASK_ROWS = 200_000
#: Rows that one task compares with all rows behind them, at most and at least, and tasks that there are then.
STRIP_ROWS, STRIP_LEAST, STRIPS = 16_384, 256, 32


def has_prefix(c: Column, prefixes=PREFIXES) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def candidates(triples: DataFrame) -> DataFrame:
    """(id) of ends that may merge: not of structured triples, without a record prefix, no HAS_ value of such a subject.

    Both ends are looked at in one pass, whatever the order of the rows.
    """
    structured = F.coalesce(F.col("source_type") == "structured", F.lit(False))
    ends = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), structured.alias("s")), F.struct(F.col("object").alias("id"), structured.alias("s")))).alias("e")).select("e.id", (F.col("e.s") | has_prefix(F.col("e.id"))).alias("out")).where("id is not null")
    ids = ends.groupBy("id").agg(F.max("out").alias("out"))
    bound = ids.where("out").select("id")
    values = triples.where(F.col("relation").startswith("HAS_")).join(bound, F.col("subject") == F.col("id"), "left_semi").select(F.col("object").alias("id")).distinct()
    return ids.where("not out").select("id").join(values, "id", "left_anti")


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over the pairs (a, b), in any direction.

    Each round every component's smallest id goes to the neighbours of all its members (large star and small star), so
    the rounds grow with the logarithm of the diameter. The star steps group by node with a minimum only, so a node with
    very many links is never gathered into one task.
    """
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = materialize(edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct(), "linked")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        following = materialize(small, "links")
        same = following.count() == edges.count() and following.exceptAll(edges).isEmpty()
        drop_table(edges)
        edges = following
        if same:
            break
    return nodes.join(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def elect(members: DataFrame) -> DataFrame:
    """(id, canonical) of every member but the shortest, then first, of its component."""
    best = members.groupBy("component").agg(F.min(F.struct(F.length("id").alias("n"), F.col("id").alias("c"))).alias("x")).select("component", F.col("x.c").alias("canonical"))
    return members.join(best, "component").where("id <> canonical").select("id", "canonical")


def rewrite(triples: DataFrame, merges: DataFrame) -> DataFrame:
    """``triples`` with canonical ends; those that now point to themselves are gone. Null ends stay."""
    s, o = merges.select(F.col("id").alias("subject"), F.col("canonical").alias("_s")), merges.select(F.col("id").alias("object"), F.col("canonical").alias("_o"))
    out = triples.join(s, "subject", "left").join(o, "object", "left").withColumn("subject", F.coalesce("_s", "subject")).withColumn("object", F.coalesce("_o", "object"))
    return out.where("subject is null or object is null or subject <> object").select(*triples.columns)


def resolve(triples: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``triples`` with near-identical candidates merged. ``pairs`` has a, b, sim of any entity names."""
    c = candidates(triples)
    close = pairs.where(F.col("sim") >= threshold).join(c.select(F.col("id").alias("a")), "a", "left_semi").join(c.select(F.col("id").alias("b")), "b", "left_semi")
    return rewrite(triples, elect(components(close)))


def bands(threshold: float, rows: int, miss: float, compare: float = 0.1) -> tuple[int, int]:
    """(bits of a key, keys) with the least work by which a pair at ``threshold`` shares no key with probability ``miss``.

    A bit of both vectors is equal with 1 less their angle over pi. More bits mean more keys to shuffle, and fewer unlike
    vectors with the same key; ``compare`` is the work of one comparison against that of one key.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    if same >= 1:
        return 32, 1

    def keys(bits: int) -> int:
        return max(1, math.ceil(math.log(miss) / math.log1p(-(same**bits))))

    return min(((b, keys(b)) for b in range(4, 33)), key=lambda x: x[1] * (1 + compare * rows / 2 ** (x[0] + 1)))


def sketch_bits(differ: float) -> tuple[int, int]:
    """(bits, most that may differ) of a sketch that keeps pairs of which the share ``differ`` of bits differs.

    The limit is five standard deviations above their mean, and four below that of vectors at a right angle.
    """
    spread = math.sqrt(differ * (1 - differ))
    bits = 64 * math.ceil(((5 * spread + 2) / max(0.5 - differ, 0.05)) ** 2 / 64)
    return bits, math.ceil(bits * differ + 5 * spread * math.sqrt(bits))


def cosine_pairs(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = 1e-5, seed: int = 0, block: int = 4096) -> DataFrame:
    """(a, b, sim) of the rows (id, v) whose vectors of length one have a cosine of at least ``threshold``.

    Signs of inner products with random vectors are the bits of keys; vectors that share a key are compared, first by a
    sketch of further bits, then exactly. A pair at the threshold is missed with a probability of about ``miss``, one
    above it with less, so the choice between work and completeness is the caller's; no bucket is cut. Keys grow with a
    small power of the number of rows, the pairs compared by chance with the keys. Identical vectors are compared once, as
    the smallest id of their group, and the group's other ids are paired with that one alone. Null vectors and ids have no
    pairs.
    """
    rows = materialize(vectors.where("id is not null and v is not null").select("id", "v", F.md5(F.array_join("v", ",")).alias("h")), "pair-vectors")
    firsts = rows.groupBy("h").agg(F.min("id").alias("rep"))
    copies = rows.join(firsts, "h").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    own = materialize(rows.join(firsts.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "v"), "pair-firsts")
    n, first = own.count(), own.first()
    if not n:
        return copies
    (bits, keys), dim = bands(threshold, n, miss), len(first["v"])
    size, most = sketch_bits(math.acos(max(-1.0, min(1.0, threshold))) / math.pi)
    rng = np.random.default_rng(seed)
    planes, further = rng.normal(size=(dim, keys * bits)), rng.normal(size=(dim, size))
    id_type, weights = dict(own.dtypes)["id"], 1 << np.arange(bits, dtype=np.int64)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                x = np.stack(part["v"].to_numpy())
                found = ((x @ planes > 0).reshape(len(x), keys, bits) * weights).sum(axis=2)
                sketch = np.packbits(x @ further > 0, axis=1).view(np.int64)
                yield pd.DataFrame({"id": part["id"], **{f"s{i}": sketch[:, i] for i in range(size // 64)}, "keys": list(found + (np.arange(keys, dtype=np.int64) << 32))})

    words = [f"s{i}" for i in range(size // 64)]
    keyed = materialize(own.mapInPandas(key, f"id {id_type}, {', '.join(f'{w} long' for w in words)}, keys array<long>"), "pair-keys")
    each = keyed.select("id", *words, F.explode("keys").alias("key"))
    # A bucket beyond ``block`` rows is dealt to parts, and each pair of parts is compared apart, so no task holds all of it.
    hot = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = each.join(hot, "key", "left").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = dealt.withColumn("bucket", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("within", F.col("mine") == F.col("other"))
    groups = max(1, -(-n * keys // TASK_ROWS))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "key"], kind="stable")
        bucket, ids, part, within = (rows[c].to_numpy() for c in ("bucket", "id", "mine", "within"))
        sketch = rows[words].to_numpy().view(np.uint64)
        left, right = [], []
        at, step = np.arange(len(rows)), 0
        while True:
            step += 1
            at = at[at < len(rows) - step]
            at = at[bucket[at] == bucket[at + step]]
            if not len(at):
                break
            pair = at[within[at] | (part[at] != part[at + step])]
            close = pair[np.bitwise_count(sketch[pair] ^ sketch[pair + step]).sum(axis=1, dtype=np.int64) <= most]
            left.append(ids[close])
            right.append(ids[close + step])
        a, b = (np.concatenate(x) if x else ids[:0] for x in (left, right))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}) if id_type != "string" else pd.DataFrame([sorted(x) for x in zip(a, b)], columns=["a", "b"])

    found = dealt.withColumn("grp", F.pmod(F.xxhash64("bucket"), F.lit(groups))).groupBy("grp").applyInPandas(compare, f"a {id_type}, b {id_type}")
    near = found.where("a <> b").distinct()
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    exact = near.join(own.select(F.col("id").alias("a"), "v"), "a").join(own.select(F.col("id").alias("b"), F.col("v").alias("w")), "b").select("a", "b", dot.alias("sim"))
    return exact.where(F.col("sim") >= F.lit(threshold) - 1e-9).unionByName(copies)


def prefix_size(x: np.ndarray, least: float) -> int:
    """Leading coordinates of turned rows by which pairs are compared first with the least work; all of them if fewer save none.

    Work is judged on rows of ``x``: numbers multiplied for each pair, and pairs left to compare in full (in nanoseconds,
    as measured). With the length of the rest the product has a multiple of eight numbers.
    """
    dim, some = x.shape[1], x[:: max(1, len(x) // 512)]
    best, size = 0.037 * dim, dim
    for k in range(7, dim - 1, 8):
        rest = np.linalg.norm(some[:, k:], axis=1)
        left = (some[:, :k] @ some[:, :k].T + rest[:, None] * rest >= least).mean()
        if 0.037 * (k + 1) + 150 * left < best:
            best, size = 0.037 * (k + 1) + 150 * left, k
    return size


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, strip: int | None = None) -> DataFrame:
    """(a, b, sim) of every two rows (id, v), a < b, whose vectors of length one have a cosine of at least ``threshold``.

    All pairs are compared, those of equal vectors too. The rows are one table in the shared folder, and a task reads it
    from its own strip of rows on, so nothing is shuffled or held twice. Coordinates are turned so that the first say
    most; the product of these and of the lengths of the rest bounds the cosine, and what it leaves is compared in full.
    Null vectors and ids have no pairs. Vectors of any length come with it in a column ``norm``, and are divided by it as they
    are read; so the table holds single precision where ``v`` does, half the room of the quotients.
    """
    kinds = dict(vectors.dtypes)
    columns = ["id", "v", *["norm"] * ("norm" in kinds)]
    numbers = vectors if kinds["v"] == "array<float>" else vectors.withColumn("v", F.col("v").cast("array<double>"))
    rows = materialize(numbers.where(" and ".join(f"{c} is not null" for c in columns)).select(columns), "pair-rows")
    spark, id_type = rows.sparkSession, kinds["id"]

    def opened(uri: str) -> pq.ParquetFile:
        fs, path = pfs.FileSystem.from_uri(uri)
        return pq.ParquetFile(fs.open_input_file(path))

    files, n = [], 0
    for uri in sorted(rows.inputFiles()):
        k = opened(uri).metadata.num_rows
        files += [(uri, n, n + k)] if k else []
        n += k
    if n < 2:
        return spark.createDataFrame([], f"a {id_type}, b {id_type}, sim double")
    strip = strip or min(STRIP_ROWS, max(STRIP_LEAST, -(-n // STRIPS)))
    least = threshold - 1e-9

    def blocks(start: int, end: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """(number of the first row, ids, vectors) of the rows from start to end."""
        for uri, first, last in files:
            if last <= start or first >= end:
                continue
            for b in opened(uri).iter_batches(4096):
                lo, hi = max(start - first, 0), min(end - first, len(b))
                if lo < hi:
                    part = b.slice(lo, hi - lo)
                    x = part.column("v").flatten().to_numpy().reshape(len(part), -1).astype(np.float64, copy=False)
                    yield first + lo, part.column("id"), x / part.column("norm").to_numpy()[:, None] if "norm" in columns else x
                first += len(b)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start in (i * strip for b in batches for i in b.column("id").to_pylist()):
            own = list(blocks(start, min(n, start + strip)))
            ids, x = pa.concat_arrays([i for _, i, _ in own]), np.concatenate([v for *_, v in own])
            turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
            size = prefix_size(x @ turn, least)

            def bounds(v: np.ndarray) -> np.ndarray:
                t = (v @ turn).astype(np.float32)
                return t if size == t.shape[1] else np.column_stack([t[:, :size], np.linalg.norm(t[:, size:], axis=1)])

            left, longest = bounds(x), np.linalg.norm(x, axis=1).max()
            found, waiting = [], 0
            for at, other, y in blocks(start, n):
                right, product, near = bounds(y), np.empty((256, len(y)), np.float32), np.empty((256, len(y)), bool)
                slack = np.float32(least - 1e-5 * max(1.0, longest * np.linalg.norm(y, axis=1).max()))  # beyond the error of single precision
                for r in range(0, len(x), 256):
                    k = len(left[r : r + 256])
                    np.greater_equal(np.matmul(left[r : r + 256], right.T, out=product[:k]), slack, out=near[:k])
                    hit = np.flatnonzero(near[:k])
                    for h in range(0, len(hit), 1 << 16):
                        i, j = np.divmod(hit[h : h + (1 << 16)], len(y))
                        i, keep = i + r, start + i + r < at + j
                        i, j = i[keep], j[keep]
                        sim = np.einsum("ij,ij->i", x[i], y[j])
                        i, j, sim = i[sim >= least], j[sim >= least], sim[sim >= least]
                        if len(i):
                            p, q = ids.take(pa.array(i)), other.take(pa.array(j))
                            part = pa.table({"a": pc.if_else(pc.less(p, q), p, q), "b": pc.if_else(pc.less(p, q), q, p), "sim": sim})
                            found.append(part.filter(pc.not_equal(p, q)))
                            waiting += len(i)
                    if waiting > 50_000:
                        yield from pa.concat_tables(found).combine_chunks().to_batches()
                        found, waiting = [], 0
            if found:
                yield from pa.concat_tables(found).combine_chunks().to_batches()

    strips = -(-n // strip)
    return spark.range(0, strips, 1, strips).mapInArrow(compare, f"a {id_type}, b {id_type}, sim double")
