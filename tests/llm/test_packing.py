import itertools
import random
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import packing as P


def fewest(sizes, cap):
    """Containers of the best packing, by trying every order of assignment."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= cap:
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_small_packings_are_optimal(sizes):
    bins = P.pack(sizes, 20)
    assert Counter(itertools.chain(*bins)) == Counter(sizes) and all(sum(b) <= 20 for b in bins)
    assert len(bins) == fewest(sorted(sizes, reverse=True), 20) and P.lower_bound(sizes, 20) <= len(bins)


def test_bin_completion_beats_best_fit():
    sizes = [6, 6, 5, 5, 5, 3] * 1 + [4, 4, 2]
    assert len(P.pack(sizes, 10)) == 4


def test_fillings_are_undominated():
    found = list(P.fillings(6, Counter([4, 3, 2, 1]), 10, 50))
    assert found[0] == (4,) and (3,) not in found and (2,) not in found


def test_the_tightest_filling_of_many_is_found_first():
    rng = random.Random(3)
    left = Counter(rng.randint(50, 900) for _ in range(400))
    found = list(itertools.islice(P.fillings(901, left, 4096, 4096), 200))
    unused = [4096 - 901 - sum(f) for f in found]
    assert unused == sorted(unused) and unused[0] == 0 and len(set(found)) == 200 and all(Counter(f) <= left for f in found)


def test_a_group_that_best_fit_does_not_solve_ends_soon():
    rng = random.Random(5)
    sizes = [rng.randint(300, 900) for _ in range(600)]
    start = time.time()
    bins, proved = P.solve(sizes, 2048)
    assert time.time() - start < 15 and Counter(itertools.chain(*bins)) == Counter(sizes) and max(map(sum, bins)) <= 2048
    assert len(bins) == P.lower_bound(sizes, 2048) < len(P.best_fit(sizes, 2048)) and proved
    assert P.solve([7, 7, 6, 6, 5, 5, 4, 4, 4], 12, nodes=1)[1] in (True, False) and P.solve([], 5) == ([], True)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, tokens long, container string")


def test_operator(spark):
    rows = [(i, "word " * (i % 40), 1, "x") for i in range(300)] + [(1000, "word " * 950, None, None), (1001, None, None, None), (1002, "", None, None), (1003, "word " * 399, None, None)]
    out = [r.asDict() for r in P.pack_documents(docs(spark, rows), 100).collect()]
    pieces = Counter(r["doc_id"] for r in out)
    assert pieces[1000] == next(r["pieces"] for r in out if r["doc_id"] == 1000) == 10 and pieces[1003] == 4 and pieces[1001] == pieces[1002] == 1
    assert all(n == 1 for d, n in pieces.items() if d < 1000)
    fill = Counter()
    for r in out:
        fill[r["container"]] += r["tokens"]
    assert all(fill[r["container"]] == r["filled"] <= 100 for r in out)
    assert len([c for c in fill if fill[c]]) <= -(-sum(fill.values()) // 100) + 1
    report = P.container_report(P.pack_documents(docs(spark, rows), 100), 100).first()
    assert report["tokens"] == sum(fill.values()) and report["containers"] == len([c for c in fill if fill[c]]) >= report["least"] and report["not_proved"] == 0
    for d in (1000, 1003):
        spans = sorted((r["first_token"], r["first_token"] + r["tokens"]) for r in out if r["doc_id"] == d)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_groups_share_their_loose_containers(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_CONTAINERS", 2)
    out = P.pack_documents(docs(spark, [(i, "word " * (7 + i % 5), None, None) for i in range(200)]), 100)
    rows = out.collect()
    used = {r["container"] for r in rows}
    assert len(rows) == 200 and sum(r["tokens"] for r in rows) / (len(used) * 100) > 0.9


def test_empty(spark):
    assert P.container_report(P.pack_documents(docs(spark, []), 100), 100).first()["containers"] == 0
    assert P.pack_documents(docs(spark, []), 100).collect() == []
