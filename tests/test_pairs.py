"""Queries over pairs, on small tables with copies and with blocks that overlap."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork import session
from braidwork.operators import linkage as L
from braidwork.operators import recursive
from braidwork.plans import cluster_queries, graph_queries, induction_queries
from tests.compare import connection, same


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Folder of tables with vectors 1, 2 and 3 alike, and 4 near all of them; 5 is far."""
    sf = str(tmp_path_factory.mktemp("copies"))
    x, far = np.full(64, 0.125), np.where(np.arange(64) % 2, 0.125, -0.125)
    near = x + 0.3 * far
    vectors = [(1, "a", "Claim", 1, x), (2, "b", "Policy", 1, x), (3, "c", "Policy", 1, x), (4, "d", "Policy", 1, near), (5, "e", None, 1, far)]
    spark.createDataFrame([(i, n, t, d, v.tolist()) for i, n, t, d, v in vectors], "vec_id long, id string, entity_type string, degree int, embs array<float>").write.parquet(f"{sf}/entity_embeddings.parquet")
    triples = [(1, "a", "HAS_X", "v", "k1"), (2, "b", "HAS_X", "v", "k1"), (3, "d", "HAS_Y", "v", "k2")]
    spark.createDataFrame([(i, s, "T", r, o, "T", "s", 1.0, k, "f", "text") for i, s, r, o, k in triples], "seq long, subject string, subject_type string, relation string, object string, object_type string, span string, confidence double, chunk_id string, source string, source_type string").write.parquet(f"{sf}/sampled_triples.parquet")
    return sf


EVERY = {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_similarity_graph_weighs_every_copy(spark, copies):
    found = cluster_queries.similarity_graph(spark, copies)
    assert {(r["a"], r["b"]) for r in found.collect()} == EVERY
    same(found, cluster_queries.SQL["similarity_graph"], connection(copies))


def test_cosine_pairs_take_the_room_of_their_numbers_and_no_shuffle(spark, tmp_path):
    rng, n = np.random.default_rng(4), 3000
    x = (rng.normal(size=(400, 64))[rng.integers(0, 400, n)] + 0.3 * rng.normal(size=(n, 64))).astype(np.float32) * rng.uniform(0.1, 9, (n, 1)).astype(np.float32)
    spark.createDataFrame([(i, f"n{i}", "T", 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, id string, entity_type string, degree int, embs array<float>").write.parquet(f"{tmp_path}/entity_embeddings.parquet")
    before = len(session._MADE)
    found = graph_queries.cosine_pairs(spark, str(tmp_path))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    rows = [(r["a"], r["b"]) for r in found.collect()]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9 - 1e-9)) if i < j}
    assert len(rows) == len(want) > 1000 and set(rows) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sum(f.stat().st_size for p in session._MADE[before:] for f in Path(p).rglob("*.parquet")) < 300 * n


def test_community_levels_over_every_copy(spark, copies, monkeypatch):
    seen = []
    levels = induction_queries.I.community_levels
    monkeypatch.setattr(induction_queries.I, "community_levels", lambda edges: seen.append(edges) or levels(edges))
    assert {r["level"] for r in induction_queries.community_levels(spark, copies).collect()} == {0, 1, 2}
    assert {(r["a"], r["b"]) for r in seen[0].collect()} == EVERY


def test_norm_of_a_fused_vector_is_computed_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(recursive._unit(F.col("v")).alias("v"))
    assert [r["v"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan and not re.search(r"lambdafunction\([^)]*SQRT", plan)


def test_pairs_of_overlapping_blocks_once_and_never_shuffled(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 7)
    rng = np.random.default_rng(2)
    fields = {("A", "B")[i % 2] + str(i): {"HAS_NAME": f"n{rng.integers(9)}", "HAS_ZIP": f"{rng.integers(5)}", **({"HAS_DATE": f"2020-01-{rng.integers(10, 28)}"} if i % 3 else {})} for i in range(80)}
    p = spark.createDataFrame([(i[0], i, r, v) for i, x in fields.items() for r, v in x.items()], "type string, id string, relation string, value string")
    shared = spark.createDataFrame([("A", "B", r, 60, 60, w, k, n, 3) for n, (r, w, k) in enumerate([("HAS_NAME", 1.0, "text"), ("HAS_ZIP", 0.5, "numeric"), ("HAS_DATE", 0.7, "date")], 1)], "type_a string, type_b string, relation string, cardinality_a long, cardinality_b long, idf_weight double, field_type string, rank int, fields long")
    want = {}
    for a, x in fields.items():
        for b, y in fields.items():
            if a[0] == "A" and b[0] == "B" and any(x[r] == y[r] for r in ("HAS_NAME", "HAS_ZIP")):
                s = {"HAS_NAME": (1.0, float(x["HAS_NAME"] == y["HAS_NAME"])), "HAS_ZIP": (0.5, float(x["HAS_ZIP"] == y["HAS_ZIP"]))}
                if "HAS_DATE" in x and "HAS_DATE" in y:
                    s["HAS_DATE"] = (0.7, 1.0 if x["HAS_DATE"] == y["HAS_DATE"] else 0.5)
                want[a, b] = (round(sum(w * h for w, h in s.values()) / sum(w for w, _ in s.values()) * (0.5 + len(s) / 6), 6), sum(h > 0 for _, h in s.values()))
    pairs = L.blocking_pairs(p, shared, 2)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted(want)
    assert not re.search(r"Aggregate \[type_a#\d+, type_b#\d+, a#\d+, b#\d+\]", pairs._jdf.queryExecution().optimizedPlan().toString())
    scored = L.score_pairs(p, shared, 2).collect()
    assert len(scored) == len(want) and {(r["a"], r["b"]): (round(r["score"], 6), r["n_matched"]) for r in scored} == want


def test_rounds_of_communities_let_their_shuffles_go(spark, monkeypatch):
    from braidwork.operators import clustering

    went = []
    drop = clustering.drop_shuffles
    monkeypatch.setattr(clustering, "drop_shuffles", lambda df: went.append(1) or drop(df))
    got = {r["id"]: r["community"] for r in clustering.communities(spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "a string, b string, weight double")).collect()}
    assert len(went) >= 2 and set(got) == set("abcd")
