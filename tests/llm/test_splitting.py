import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import splitting as S

CHUNKS = "chunk_id string, content string, section_hierarchy array<string>, chunk_type string, token_count int, max_tokens int, size int"


def check(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    words = text.split()
    if not words:
        assert pieces == []
        return pieces
    overlap = min(overlap, (limit - 1) // 2)
    at = 0
    for i, p in enumerate(pieces):
        own = text[p.start : p.end].split()
        assert len(own) == p.words <= limit
        assert p.overlap_words == (0 if not i else min(overlap, at))
        assert own == words[at - p.overlap_words : at - p.overlap_words + len(own)]
        at += len(own) - p.overlap_words
    assert at == len(words)
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["one", "two.", "three,", "\n", "\n\n", "RECORD:\n", "a: b |", "x"]), max_size=120), st.integers(1, 20), st.integers(0, 12))
def test_pieces_cover_the_text_within_the_limit(parts, limit, overlap):
    check(" ".join(parts), limit, overlap)


def test_cuts_lie_at_the_strongest_boundaries():
    para = "One two three four. Five six seven eight.\n"
    text = "\n".join([para] * 6)
    pieces = check(text, 20, 2)
    assert len(pieces) > 1 and all(p.boundary == "paragraph" for p in pieces[1:])
    assert all(p.boundary == "word" for p in check("word " * 50, 10, 0)[1:])
    assert all(p.boundary == "line" for p in check("\n".join(f"k: {i} | v: {i}" for i in range(60)), 30, 4)[1:])


def test_long_text():
    assert len(check("lorem ipsum dolor. " * 60_000, 900, 90)) >= 180_000 // 810


@pytest.mark.parametrize("tokens", [0, 1, 2, 60, 120, 1200])
def test_words_within(tokens):
    n = S.words_within(tokens)
    assert int(n / 0.75) <= tokens < int((n + 1) / 0.75)


def test_operator(spark):
    long = "A sentence of five words. " * 400
    rows = [("a", long, ["H"], "text", 1, None, None), ("a", long, ["H"], "text", 1, None, None), ("b", "short", None, None, 9999, 1, 1), ("c", None, [], "TABLE ", None, None, None), ("d", "", None, "text", 0, None, None), ("e", "w " * 901, ["T"], " table", 0, None, None), (None, "w " * 900, None, None, None, None, None)]
    limits = spark.createDataFrame([("chunk_text", 1200, 120), ("chunk_table", 1200, 60), ("container", 10, 0)], "limit_name string, max_tokens int, overlap_tokens int")
    out = S.split_oversized(spark.createDataFrame(rows, CHUNKS), limits).collect()
    cut = [r for r in out if r["oversized"]]
    assert {r["chunk_id"] for r in cut} == {"a", "e"} and all(r["token_count"] <= 1200 for r in out)
    assert {r["overlap_tokens"] for r in cut if r["piece_no"] > 1 and r["chunk_id"] == "e"} == {60} and all(r["section_hierarchy"] == ["H"] for r in cut if r["chunk_id"] == "a")
    assert sum(r["chunk_id"] in ("b", "c", "d") for r in out) == 3 and len([r for r in cut if r["chunk_id"] == "a" and r["piece_no"] == 1]) == 2
    assert S.split_oversized(spark.createDataFrame([], CHUNKS), limits).collect() == []
