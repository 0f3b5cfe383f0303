import numpy as np

from braidwork.llm import neighbours as N

SCHEMA = "vec_id long, embs array<float>, id string, cell int, cos double"


def table(spark, x, more=()):
    return spark.createDataFrame([(i, [float(v) for v in row], "same", 1, 0.5) for i, row in enumerate(x)] + list(more), SCHEMA)


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    return centres[rng.integers(0, 30, n)] + 0.8 * rng.normal(size=(n, dim))


def test_recall_against_brute_force(spark):
    x = vectors(6000, 64)
    near = N.nearest(table(spark, x * np.random.default_rng(1).uniform(0.1, 5, (6000, 1)))).collect()
    u = N.unit(x)
    got = {}
    for r in near:
        got.setdefault(r["vec_id"], []).append((r["rank"], r["other"], r["cos"]))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len({o for _, o, _ in got[i]} & set(top[i])) / 10 for i in range(6000)]) >= 0.9
    assert all([k for k, _, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    assert all(abs(c - s[i, o]) < 1e-4 for i in range(0, 6000, 500) for _, o, c in got[i])


def test_recall_with_second_level_cells(monkeypatch):
    monkeypatch.setattr(N, "CELL", 100)
    monkeypatch.setattr(N, "PER_CELL", 400)
    x = N.unit(vectors(8000, 64))
    index = N.fit(x, 8000)
    assert len(index.coarse) == 20 and index.size == 80
    cell, probes = index.cell_of(x), index.probes(x[:300])
    assert probes.shape[1] == round(index.size**0.5) and all(len(set(p)) == len(p) for p in probes.tolist())
    s = x[:300] @ x.T
    s[np.arange(300), np.arange(300)] = -2
    top = np.argsort(-s, axis=1)[:, :10]
    assert np.mean((cell[top][:, :, None] == probes[:, None, :]).any(axis=2)) >= 0.9
    assert np.bincount(cell, minlength=index.size).max() < 2000


def test_tables_give_the_scores_of_the_codes():
    x = N.unit(vectors(500, 32))
    index = N.fit(x, 500)
    cell = index.cell_of(x)
    codes = index.encode(x, cell)
    packed = index.packed(codes)
    assert packed.shape == (500, 8) and all((a == codes[:, m]).all() for m, a in enumerate(index.unpacked(packed)))
    t = index.tables(x[:5])
    total = sum(t[m][codes[:, m]].astype(np.int64) for m in range(16))
    exact = index.books[np.arange(16), codes].reshape(500, -1) @ x[:5].T
    assert total.max() < 65_000 and min(np.corrcoef(total[:, i], exact[:, i])[0, 1] for i in range(5)) > 0.99999


def test_copies_unusable_rows_and_ties(spark):
    x = np.repeat(np.eye(8)[:2], 20, axis=0)
    bad = [(900, None, None, None, None), (901, [1.0], None, None, None), (902, [0.0] * 8, None, None, None), (903, [float("nan")] * 8, None, None, None), (904, [float("inf")] + [0.0] * 7, None, None, None), (None, [1.0] * 8, None, None, None), (905, [1.0, 1.0] + [0.0] * 6, None, None, None)]
    near = N.nearest(table(spark, x, bad), k=5, dim=8).collect()
    got = {}
    for r in near:
        got.setdefault(r["vec_id"], []).append((r["rank"], r["other"], round(r["cos"], 4)))
    assert set(got) == set(range(40)) | {905}
    assert [o for _, o, _ in sorted(got[0])] == [1, 2, 3, 4, 5] and [o for _, o, _ in sorted(got[3])] == [0, 1, 2, 4, 5] and [o for _, o, _ in sorted(got[30])] == [20, 21, 22, 23, 24]
    assert len(got[905]) == 5 and all(abs(c - 0.7071) < 1e-3 for _, _, c in got[905])


def test_few_rows(spark):
    assert N.nearest(table(spark, []), dim=8).collect() == []
    assert N.nearest(table(spark, np.ones((1, 8))), dim=8).collect() == []
    two = N.nearest(table(spark, np.array([[1.0, 0], [1.0, 1.0]])), dim=2).collect()
    assert {(r["vec_id"], r["other"]) for r in two} == {(0, 1), (1, 0)}


def test_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 50)
    monkeypatch.setattr(N, "QUERY_BLOCK", 70)
    x = vectors(400, 16)
    pairs = {(r["a"], r["b"]) for r in N.similar_pairs(N.nearest(table(spark, x), dim=16), 0.8).collect()}
    u = N.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :10]
    want = {(min(i, j), max(i, j)) for i in range(400) for j in top[i] if s[i, j] >= 0.8}
    assert len(want & pairs) >= 0.95 * len(want) and all(s[a, b] > 0.799 for a, b in pairs)


def test_score_aware_codes_lose_less_of_the_inner_product():
    x = N.unit(vectors(2000, 32))
    index = N.fit(x, 2000)
    cell = index.cell_of(x)
    m = index.books.shape[0]

    def parallel(codes):
        back = index.centres(cell) + index.books[np.arange(m), codes].reshape(len(x), -1)
        return np.abs(((x - back) * x).sum(axis=1)).mean()

    assert parallel(index.encode(x, cell, 2)) < parallel(index.encode(x, cell, 0))
