"""Queries of the subpackage against their SQL; the others run and keep what they promise."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from braidwork.llm import mixing, queries, tokens
from braidwork.llm.queries import QUERIES, SQL
from tests.compare import SMALL, connection, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(QUERIES[name](spark, SMALL), SQL[name], connection())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    df.write.format("noop").mode("overwrite").save()
    assert df.columns


def test_every_chunk_is_covered_by_pieces_within_its_limit(spark):
    limits = {r["limit_name"]: r["max_tokens"] for r in queries.table(spark, SMALL, "size_limits").collect()}
    chunks = defaultdict(list)
    for r in queries.table(spark, SMALL, "hybrid_chunks").collect():
        chunks[r["chunk_id"]].append(r)
    found = defaultdict(list)
    for r in QUERIES["p3_pieces"](spark, SMALL).collect():
        found[r["chunk_id"]].append(r)
    assert set(found) == set(chunks)
    for k, pieces in found.items():
        if len(chunks[k]) > 1:
            continue  # taken in twice, so cut twice
        c = chunks[k][0]
        most = limits["chunk_table" if (c["chunk_type"] or "").strip().lower() == "table" else "chunk_text"]
        text, end = c["content"] or "", 0
        for p in sorted(pieces, key=lambda p: p["piece_no"]):
            assert int(len(p["content"].split()) / 0.75) == p["token_count"] <= most and p["section_hierarchy"] == c["section_hierarchy"]
            at = text.find(p["content"], max(0, end - len(p["content"])))
            assert 0 <= at and not text[end:at].strip()
            end = at + len(p["content"])
        assert not text[end:].strip()


def test_containers_hold_every_piece_once_and_waste_little(spark):
    capacity = queries._capacity(spark, SMALL)
    docs = queries.table(spark, SMALL, "documents").select("doc_id", tokens.token_count(F.col("text"), tokens.TOKENIZERS, tokens.VOCABULARY).alias("n"))
    size = {r["doc_id"]: r["n"] for r in docs.collect()}
    rows, fill, of = QUERIES["p6_containers"](spark, SMALL).collect(), Counter(), defaultdict(list)
    for r in rows:
        fill[r["container"]] += r["tokens"]
        of[r["doc_id"]].append((r["first_token"], r["tokens"], r["pieces"]))
    assert set(of) == set(size) and max(fill.values()) <= capacity
    for d, parts in of.items():
        assert sum(n for _, n, _ in parts) == size[d] and len(parts) == parts[0][2] and (len(parts) == 1) == (size[d] <= capacity)
        assert [a for a, _, _ in sorted(parts)] == [sum(n for _, n, _ in sorted(parts)[:i]) for i in range(len(parts))]
    used = len([c for c in fill if fill[c]])
    assert used <= -(-sum(size.values()) // capacity) + 1
    assert QUERIES["p6_report"](spark, SMALL).first()["containers"] == used


def test_the_mix_has_its_shares(spark):
    sized = {r["doc_id"]: r for r in mixing.sized(queries.table(spark, SMALL, "documents")).collect()}
    taken, report = {r["doc_id"]: r for r in QUERIES["p7_records"](spark, SMALL).collect()}, {r["source"]: r for r in QUERIES["p7_shares"](spark, SMALL).collect()}
    whole = sum(r["tokens"] for r in sized.values())
    per, most = Counter(), {}
    for d, r in taken.items():
        assert r["tokens"] == sized[d]["tokens"] and r["source"] == sized[d]["source"] and 1 <= r["copies"] <= report[r["source"]]["max_repeats"]
        per[r["source"]] += r["copies"] * r["tokens"]
    for r in sized.values():
        most[r["source"]] = max(most.get(r["source"], 0), r["tokens"])
    for s, r in report.items():
        assert r["taken"] == per[s] and r["budget"] == pytest.approx(r["target_share"] * whole) and r["actual_share"] == pytest.approx(per[s] / sum(per.values()))
        assert r["reachable"] == (r["available"] * r["max_repeats"] >= r["budget"])
        assert per[s] <= r["budget"] and (per[s] > r["budget"] - most.get(s, 0) if r["reachable"] else per[s] == r["available"] * r["max_repeats"])


def test_every_document_has_a_row_of_languages(spark):
    ids = {r["doc_id"] for r in queries.table(spark, SMALL, "documents").select("doc_id").collect()}
    rows = QUERIES["p8_stretches"](spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == ids and all(0 <= r["confidence"] <= 1 for r in rows)
    numbers = defaultdict(list)
    for r in rows:
        if r["lang"] not in (None, "und"):
            numbers[r["doc_id"]].append(r["lang_no"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in numbers.values())
