import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from braidwork.operators import hierarchy as H

NODES = "node_id long, run_id string, name string, parent string, updated_at timestamp, depth int, path string"
EDGES = "run_id string, child string, parent string, edge_type string, id long"


def brute(parents, names):
    out = {}
    for n in parents:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parents[x]
        out[n] = (-1, -1, "") if x is not None else (seen[-1], len(seen) - 1, " > ".join(names[y] for y in reversed(seen)))
    return out


def run(spark, parents, names=None):
    names = names or {n: f"n{n}" for n in parents}
    df = H.hierarchy(spark.createDataFrame(list(names.items()), "id long, name string"), spark.createDataFrame(list(parents.items()), "id long, parent long"))
    return {r["node_id"]: r for r in df.collect()}


def check(found, parents, names=None):
    names = names or {n: f"n{n}" for n in parents}
    assert {n: (r["root_id"], r["depth"], r["path"]) for n, r in found.items()} == brute(parents, names)
    below = {n: {m for m in parents if found[m]["path_ids"] and n in found[m]["path_ids"][:-1]} for n in parents}
    for n, r in found.items():
        if r["depth"] >= 0:
            inside = {m for m, x in found.items() if x["root_id"] == r["root_id"] and r["first"] < (x["first"] or 0) <= r["last"]}
            assert inside == below[n]


def test_shapes(spark):
    rng = random.Random(1)
    chain = {i: i - 1 if i else None for i in range(40)}
    star = {100 + i: 100 if i else None for i in range(50)}
    bush = {200 + i: 200 + rng.randrange(i) if i else None for i in range(60)}
    loop = {300: 302, 301: 300, 302: 301, 303: 302, 304: 303, 305: 305, 306: None}
    parents = chain | star | bush | loop
    check(run(spark, parents), parents)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-1, 11), min_size=1, max_size=12))
def test_any_links(spark, ups):
    parents = {i: (u if 0 <= u < len(ups) else None) for i, u in enumerate(ups)}
    check(run(spark, parents), parents)


def test_empty(spark):
    df = H.hierarchy(spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "id long, parent long"))
    assert df.collect() == []


def test_links_from_both_tables(spark):
    nodes = [
        (1, "r", "Root", None, None, None, "x"), (2, "r", "Mid", " root\t", None, 9, None), (2, "r", "Mid", None, None, None, None), (3, "r", "Leaf", "", None, 0, None), (4, "r", "Lost", "no such node", None, 1, None),
        (5, "s", "Root", "Leaf", None, None, None), (6, None, "Alone", "Root", None, None, None), (7, "r", None, "MID", None, None, None), (None, "r", "Ghost", "Root", None, None, None),
    ]
    edges = [("r", "LEAF ", "mid", "SUBCLASS_OF", 1), ("r", "leaf", "Mid", "SUBCLASS_OF", 2), ("r", "Lost", "Root", "ASSOCIATED_WITH", 3), ("r", None, "Root", "SUBCLASS_OF", 4), (None, "Leaf", "Root", None, 5)]
    names, links = H.parent_links(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    got = {r["node_id"]: (r["root_id"], r["depth"], r["path"]) for r in H.hierarchy(names, links).collect()}
    assert got == {1: (1, 0, "Root"), 2: (1, 1, "Root > Mid"), 3: (1, 2, "Root > Mid > Leaf"), 4: (4, 0, "Lost"), 5: (5, 0, "Root"), 6: (6, 0, "Alone"), 7: (1, 2, "Root > Mid > ")}
    pairs = {(r["ancestor_id"], r["node_id"], r["distance"]) for r in H.descendants(H.hierarchy(names, links)).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 7, 2), (2, 7, 1)}


@pytest.mark.parametrize("buckets", [1, 7])
def test_sibling_offsets(spark, monkeypatch, buckets):
    monkeypatch.setattr(H, "SIBLINGS", 100)
    rows = [(i, i % 3, i % 5 + 1) for i in range(60)]
    got = {r["id"]: r["offset"] for r in H.sibling_offsets(spark.createDataFrame(rows, "id long, parent long, size long"), buckets * 100).collect()}
    for p in range(3):
        spans = sorted((got[i], got[i] + s) for i, q, s in rows if q == p)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
