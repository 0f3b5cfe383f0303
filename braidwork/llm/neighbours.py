"""The k most similar vectors of every vector by cosine.

Vectors are normalised and dealt to coarse cells. Their residuals are quantised to four bits per subspace with codebooks
and codes that weigh the error parallel to the vector more than the rest, since only that error moves high inner
products. A query scans the four-bit tables of its nearest cells and reranks the best by their exact cosine. Cells and
codebooks are fitted on a bounded sample; every row is indexed and every row is a query.

The number of cells is in proportion to the rows, so that a cell has about CELL vectors at every size. As many as the
sample can fit are fitted directly; where more are needed, each of them is divided by the same set of second-level
offsets. A query visits as many cells as the root of their number, as recall needs more of them the finer they are.

Exact copies are found first: one of each group enters the index, and its neighbours are handed to the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize

#: Vectors that cells and codebooks are fitted on, and vectors per cell that are aimed at.
SAMPLE, CELL = 20_000, 1500
#: Vectors of the sample for each first-level cell; least cells that a query scans, and candidates of a scan that are reranked.
PER_CELL, PROBES, RERANK = 32, 7, 64
#: Vectors and queries that one scan holds at most; larger cells are cut into blocks.
BLOCK, QUERY_BLOCK = 4096, 8192
#: Inner product above which errors matter, for the weight of the parallel error.
THRESHOLD = 0.2
#: Dimensions of a subspace; each has 16 codewords.
SUB = 2
#: Groups of copies with a larger share of all rows than this join by broadcast; there are at most 1/HOT_SHARE.
HOT_SHARE = 1 / 2000


def usable(c: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers, not all zero. False for null."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    big = np.abs(m).max(axis=-1, keepdims=True)
    m = m / np.where(big > 0, big, 1)  # so that squares neither overflow nor vanish
    return (m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-30)).astype(np.float32)


@dataclass
class Index:
    coarse: np.ndarray  # A x dim, unit
    fine: np.ndarray  # B x dim, offsets; one zero row where the cells are the coarse ones
    books: np.ndarray  # M x 16 x SUB
    eta: float

    @property
    def size(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centres(self, cell: np.ndarray) -> np.ndarray:
        c = self.coarse[cell // len(self.fine)]
        return c if len(self.fine) == 1 else unit(c + self.fine[cell % len(self.fine)])

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector in any order, looked for below as many coarse cells."""
        s = x @ self.coarse.T
        top = min(n, s.shape[1])
        first = np.argpartition(-s, top - 1, axis=1)[:, :top]
        if len(self.fine) == 1:
            return first
        out, b = np.empty((len(x), min(n, top * len(self.fine))), dtype=np.int64), len(self.fine)
        step = max(1, BLOCK * QUERY_BLOCK // (top * b * x.shape[1]))
        for a in range(0, len(x), step):
            cells = (first[a : a + step, :, None] * b + np.arange(b)).reshape(len(first[a : a + step]), -1)
            score = np.einsum("ncd,nd->nc", self.centres(cells), x[a : a + step])
            k = out.shape[1]
            out[a : a + step] = np.take_along_axis(cells, np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1) if k < cells.shape[1] else cells
        return out

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell below the eight nearest coarse cells."""
        if len(self.fine) == 1:
            return (x @ self.coarse.T).argmax(axis=1)
        near = self.nearest_cells(x, 8)
        return np.take_along_axis(near, np.einsum("ncd,nd->nc", self.centres(near), x).argmax(axis=1)[:, None], axis=1)[:, 0]

    def probes(self, q: np.ndarray, least: int = PROBES) -> np.ndarray:
        return self.nearest_cells(q, min(self.size, max(least, round(self.size**0.5))))

    def encode(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of the residuals, n x M in 0..15, by coordinate descent on the score-aware loss."""
        return _codes(x, x - self.centres(cell), self.books, self.eta, sweeps)[0]

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte; the last of an odd number has its own."""
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)

    def unpacked(self, codes: np.ndarray) -> list[np.ndarray]:
        """The codes of each subspace as places in its table."""
        return [(half >> shift & 15).astype(np.intp) for half in codes.T for shift in (4, 0)][: len(self.books)]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword, M x 16 x n, as whole numbers whose sums stay below 65,000."""
        m = self.books.shape[0]
        t = np.einsum("nms,mks->mkn", q.reshape(len(q), m, SUB), self.books)
        t -= t.min(axis=1, keepdims=True)
        t *= 60_000 / np.maximum(t.max(axis=1).sum(axis=0), 1e-9)
        return np.ascontiguousarray(t.astype(np.uint16))


def _codes(x: np.ndarray, r: np.ndarray, books: np.ndarray, eta: float, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    n, m = len(x), books.shape[0]
    xs, rs = x.reshape(n, m, SUB), r.reshape(n, m, SUB)
    codes = np.empty((n, m), dtype=np.int16)
    along = np.zeros((n, m), dtype=np.float32)  # each subspace's error parallel to x
    rows = np.arange(n)
    for j in range(m):
        e = rs[:, j, None, :] - books[j][None]
        codes[:, j] = (e * e).sum(axis=2).argmin(axis=1)
        along[:, j] = (e[rows, codes[:, j]] * xs[:, j]).sum(axis=1)
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            e = rs[:, j, None, :] - books[j][None]
            p = np.einsum("nks,ns->nk", e, xs[:, j])
            rest = total - along[:, j]
            best = ((e * e).sum(axis=2) + (eta - 1) * (rest[:, None] + p) ** 2).argmin(axis=1)
            codes[:, j], along[:, j] = best, p[rows, best]
            total = rest + along[:, j]
    return codes, along


def _means(x: np.ndarray, own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Mean of the rows of each centre; an empty one, or one whose rows cancel out, stays as before."""
    sums, size = np.zeros_like(before), np.bincount(own, minlength=len(before))
    np.add.at(sums, own, x)
    good = (size > 0) & (np.abs(sums).sum(axis=1) > 0)
    return np.where(good[:, None], sums / np.maximum(size, 1)[:, None], before).astype(np.float32)


def fit(x: np.ndarray, rows: int, seed: int = 0) -> Index:
    """Cells and codebooks from a sample of unit vectors for an index of ``rows`` vectors."""
    rng, (n, dim) = np.random.default_rng(seed), x.shape
    wanted = max(1, round(rows / CELL))
    count = min(wanted, max(1, n // PER_CELL))
    cells = x[rng.choice(n, count, replace=False)]
    for _ in range(12):
        own = (x @ cells.T).argmax(axis=1)
        cells = unit(_means(x, own, cells))
    fine = np.zeros((1, dim), dtype=np.float32)
    if wanted > count:
        r = x - cells[(x @ cells.T).argmax(axis=1)]
        fine = r[rng.choice(n, min(-(-wanted // count), max(1, n // PER_CELL)), replace=False)]
        for _ in range(12):
            fine = _means(r, ((fine * fine).sum(axis=1) - 2 * r @ fine.T).argmin(axis=1), fine)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    index = Index(cells, fine, np.zeros((0, 16, SUB), np.float32), eta)
    r, m = x - index.centres(index.cell_of(x)), dim // SUB
    rs, xs = r.reshape(n, m, SUB), x.reshape(n, m, SUB)
    books = rs[rng.choice(n, 16, replace=n < 16)].transpose(1, 0, 2).copy()
    for step in range(8):
        codes, along = _codes(x, r, books, eta, 0 if step < 4 else 1)
        total = along.sum(axis=1)
        for j in range(m):
            rest = total - along[:, j]
            for k in range(16):
                at = codes[:, j] == k
                if at.any():
                    v = xs[at, j]
                    a = np.eye(SUB) * at.sum() + (eta - 1) * v.T @ v
                    goal = rest[at] + (rs[at, j] * v).sum(axis=1)
                    books[j, k] = np.linalg.solve(a, rs[at, j].sum(axis=0) + (eta - 1) * (goal[:, None] * v).sum(axis=0))
    return Index(cells, fine, books.astype(np.float32), float(eta))


def scan(index: Index, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines), one row per query: its k best in a block by table scan and exact reranking, -1 and -2 where none."""
    keep = min(max(rerank, k + 1) + 1, len(ids))  # a query may find itself
    out_ids, out_cos = np.full((len(q), k), -1, dtype=np.int64), np.full((len(q), k), -2.0, dtype=np.float32)
    columns = index.unpacked(codes)
    step = 256
    for a in range(0, len(q), step):
        part = q[a : a + step]
        tables = index.tables(part)  # a codeword's row holds all queries
        total = tables[0].take(columns[0], axis=0)
        row = np.empty_like(total)
        for table, column in zip(tables[1:], columns[1:]):
            np.take(table, column, axis=0, out=row, mode="clip")
            total += row
        best = np.argpartition(np.ascontiguousarray(total.T), len(ids) - keep, axis=1)[:, len(ids) - keep :]
        exact = np.einsum("nrd,nd->nr", x[best], part)
        exact = np.where(ids[best] == query_ids[a : a + step, None], -2.0, exact)
        order = np.lexsort((ids[best], -exact), axis=1)[:, :k]
        cos = np.take_along_axis(exact, order, axis=1)
        found = np.where(cos > -1.5, np.take_along_axis(ids[best], order, axis=1), -1)
        out_ids[a : a + step, : order.shape[1]], out_cos[a : a + step, : order.shape[1]] = found, np.where(found >= 0, cos, -2.0)
    return out_ids, out_cos


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def sample_vectors(vectors: DataFrame, rows: int, dim: int) -> np.ndarray:
    """At most SAMPLE unit vectors picked by a hash of the id."""
    chance = min(1.0, 0.97 * SAMPLE / max(rows, 1))
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.lit(chance * (1 << 30))).limit(SAMPLE)
    found = sorted(picked.select("id", "embs").collect())
    return unit(np.array([r["embs"] for r in found], dtype=np.float64).reshape(len(found), dim))


def index_neighbours(vectors: DataFrame, k: int, dim: int, probes: int = PROBES) -> DataFrame:
    """(id, near): up to k structs (cos, id) for each row of ``vectors``, which has unique ids and usable, distinct embs."""
    spark = vectors.sparkSession
    rows = vectors.count()
    if rows < 2:
        return vectors.select("id", F.array().cast("array<struct<cos:float,id:bigint>>").alias("near")).limit(0)
    index = fit(sample_vectors(vectors, rows, dim), rows)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = unit(np.stack([np.asarray(v, dtype=np.float64) for v in batch["embs"]]))
                cell = index.cell_of(x)
                codes = index.packed(index.encode(x, cell))
                yield pd.DataFrame({"id": batch["id"], "x": [v.tobytes() for v in x], "cell": cell.astype(np.int32), "codes": [v.tobytes() for v in codes], "probe": list(index.probes(x, probes).astype(np.int32))})

    placed = materialize(vectors.select("id", "embs").mapInPandas(place, "id long, x binary, cell int, codes binary, probe array<int>"), "vector-index")
    # One row per cell that has rows and is asked, of which a broadcast is left to the size of the table.
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = placed.select(F.explode("probe").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    blocks = sizes.join(asked, "cell").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("ni"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("nq"))
    blocks = materialize(blocks, "cell-blocks")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    key = ["cell", "ib", "qb"]
    items = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("ni")).cast("int").alias("ib"), every("nq").alias("qb"), "id", "x", "codes")
    asks = placed.select(F.col("id").alias("query"), F.col("x").alias("qx"), F.explode("probe").alias("cell")).join(blocks, "cell")
    asks = asks.select("cell", "query", "qx", F.pmod(F.xxhash64("query", F.lit(1)), F.col("nq")).cast("int").alias("qb"), every("ni").alias("ib"))

    def search(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(queries):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "ids": [], "cos": []})
        codes = np.frombuffer(b"".join(held["codes"]), dtype=np.uint8).reshape(len(held), -1)
        ids, cos = scan(index, held["id"].to_numpy(), _matrix(held["x"]), codes, queries["query"].to_numpy(), _matrix(queries["qx"]), k)
        return pd.DataFrame({"id": queries["query"], "ids": list(ids), "cos": list(cos)})

    hits = items.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(search, "id long, ids array<long>, cos array<float>")
    near = hits.select("id", F.arrays_zip(F.transform("cos", lambda c: -c).alias("neg"), F.col("ids").alias("id_")).alias("z")).groupBy("id").agg(F.slice(F.array_sort(F.filter(F.flatten(F.collect_list("z")), lambda z: z["id_"] >= 0)), 1, k).alias("z"))
    return near.select("id", F.transform("z", lambda z: F.struct((-z["neg"]).cast("float").alias("cos"), z["id_"].alias("id"))).alias("near"))


def nearest(embeddings: DataFrame, k: int = 10, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embs", probes: int = PROBES) -> DataFrame:
    """(vec_id, rank, other, cos): up to k most similar other rows of every usable row, best first, ties by id.

    Rows whose vector is null, of another length, all zero or not finite have no neighbours and are no neighbour; nor do
    rows with a null id. Ids must be unique. Exact copies are each other's neighbours with cosine 1; of more than k copies
    each names those with the smallest ids. Fewer than k others give fewer rows.
    """
    vectors = embeddings.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embs"))
    vectors = materialize(vectors.withColumn("h", F.unhex(F.md5(F.concat_ws(",", F.col("embs").cast("array<string>"))))), "vectors")
    rows = vectors.count()
    salts = max(1, -(-rows // 100_000))
    # The k + 1 smallest ids of each group of copies: first within a salt, then among those that are left.
    ids = vectors.select("h", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    some = ids.withColumn("r", F.row_number().over(W.partitionBy("h", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    groups = some.groupBy("h").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("members"))
    groups = materialize(groups.withColumn("rep", F.col("members")[0]), "copies")
    first = vectors.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "embs")
    near = index_neighbours(first, k, dim, probes)
    # Each neighbour stands for its group; a group of copies counts as many places as it has members.
    places = near.select(F.col("id").alias("rep"), F.posexplode("near").alias("at", "n")).select("rep", "at", F.col("n.cos").alias("cos"), F.col("n.id").alias("other"))
    many = groups.where(F.size("members") > 1).select(F.col("rep").alias("other"), "members")
    places = places.join(many, "other", "left").select("rep", "at", F.explode(F.coalesce("members", F.array("other"))).alias("other"), "cos")
    own = groups.where(F.size("members") > 1).select("rep", F.lit(-1).alias("at"), F.explode("members").alias("other"), F.lit(1.0).cast("float").alias("cos"))
    lists = places.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("neg"), F.col("other")))), 1, 2 * k + 1).alias("found"))
    lists = materialize(groups.select("h", "rep").join(lists, "rep").select("h", "found"), "neighbour-lists")
    sizes = vectors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(k, int(rows * HOT_SHARE))).select("h")
    hot = F.broadcast(lists.join(F.broadcast(sizes), "h", "left_semi"))
    member = vectors.select("id", "h")
    joined = member.join(hot, "h").unionByName(member.join(hot, "h", "left_anti").join(lists, "h"))
    mine = joined.select("id", F.posexplode(F.slice(F.filter("found", lambda f: f["other"] != F.col("id")), 1, k)).alias("at", "f"))
    return mine.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("rank"), F.col("f.other").alias("other"), (-F.col("f.neg")).alias("cos"))


def similar_pairs(neighbours: DataFrame, least: float, id_col: str = "vec_id") -> DataFrame:
    """(a, b, cos) of the pairs with cosine at least ``least`` in which one is a neighbour of the other, smaller id first."""
    close = neighbours.where(F.col("cos") >= F.lit(least).cast("float"))
    return close.select(F.least(id_col, "other").alias("a"), F.greatest(id_col, "other").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos"))
