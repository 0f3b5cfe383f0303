"""Operators and queries that cover whole tables, not a subset of their rows."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.models import RuleClient, SentenceTriples
from braidwork.operators import extraction as X
from braidwork.operators import metrics as M
from braidwork.operators import ontology as O
from braidwork.plans import cluster_queries, core_queries, metric_queries, ontology_queries, text_queries
from tests.compare import SMALL

tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")
MARKER = re.compile(r"\b(\d{4}|\w+ \d{4})\b")


def test_temporal_markers_as_python(spark):
    texts = ["in 2024, März 2023 and März 2023", "é2024 2024é _2024 12345", "١٩٩٩ and mai ٢٠٠١", "Ⅻ 1999; ½ 1998; 東京 2020年", "no-year", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.temporal_markers(F.col("t")).alias("m")).collect()
    assert {r["i"]: r["m"] for r in got} == {i: None if t is None else list(dict.fromkeys(MARKER.findall(t))) for i, t in enumerate(texts)}


@tables
def test_temporal_markers_of_every_chunk(spark):
    rows = spark.read.parquet(f"{SMALL}/hybrid_chunks.parquet").select("chunk_id", "content").collect()
    want = sorted((r["chunk_id"] or "", "" if r["content"] is None else "|".join(sorted(set(MARKER.findall(r["content"]))))) for r in rows)
    assert sorted((r["chunk_id"] or "", r["markers"] or "") for r in text_queries.temporal_markers(spark, SMALL).collect()) == want


def test_parts_of_a_text():
    text = "A b c. " * 40 + "\n\n" + "D e f\n" * 30 + "x" * 250
    for size in (7, 20, 100):
        parts = X.parts_of(text, size)
        assert "".join(parts) == text and max(map(len, parts)) <= size
    assert X.parts_of("One is. Two is. Three is.", 20) == ["One is. Two is. ", "Three is."] and X.parts_of("") == [""]


def test_triples_beyond_the_first_prompt(spark):
    text = "".join(f"The Form{i} covers item{i}.\n" for i in range(400))
    rows = [("1", "s", text), ("2", "s", None)]
    got = X.extract(spark.createDataFrame(rows, "chunk_id string, source string, content string"), SentenceTriples(), []).collect()
    assert len(text) > 3 * X.PROMPT_CHARS and len({r["subject"] for r in got}) == 400 and {r["chunk_id"] for r in got} == {"1"}


def test_facts_beyond_the_first_prompt(spark):
    text = "".join(f"The Form{i} covers item{i}.\n" for i in range(200))
    facts = RuleClient([("List the single facts", lambda p: p.split("TEXT:")[1])])

    class Client:
        def answer(self, prompt):
            return (facts if prompt.startswith("List") else SentenceTriples()).answer(prompt)

    chunks = spark.createDataFrame([("a/1", "s", text)], "chunk_id string, source string, content string")
    none = spark.createDataFrame([], "chunk_id string")
    got = X.decompose(chunks, none, Client(), []).collect()
    assert len(got) == 200 and {r["chunk_id"] for r in got} == {"a/1"}


def test_chunks_without_type_are_asked(spark, tmp_path):
    rows = [("1", "s", "The Form covers Basement.", None), ("2", "s", "The Deed covers Garage.", "text"), ("3", "s", "The Bond covers Roof.", "table")]
    spark.createDataFrame(rows, "chunk_id string, source string, content string, chunk_type string").write.parquet(f"{tmp_path}/hybrid_chunks.parquet")
    assert {r["chunk_id"] for r in cluster_queries.model_triples(spark, str(tmp_path)).collect()} == {"1", "2"}


def test_votes_of_each_run(spark):
    votes = [(r, i, c, p, s, t) for r in ("r1", "r2", None) for i, (c, p, s, t) in enumerate([("a", "b", "s", True), ("b", "a", "s", True), ("c", "b", "w1", False)])]
    votes += [("r2", 9, "c", "b", "w2", False), ("r2", 10, None, "b", "s", True)]
    df = spark.createDataFrame(votes, "run_id string, seq long, child string, parent string, source string, trusted boolean")
    kept = O.consensus(df, ("run_id",))
    assert {(r["run_id"], r["child"]) for r in kept.collect()} == {(x, c) for x in ("r1", "r2", None) for c in "ab"} | {("r2", "c")}
    tree = {tuple(r) for r in O.enforce_tree(kept, keys=("run_id",)).collect()}
    assert tree == {("r1", "a", "b"), ("r2", "a", "b"), (None, "a", "b"), ("r2", "c", "b")}
    first = {tuple(r) for r in O.acyclic_first(df, ("run_id",)).collect()}
    assert first == {(x, c, "b") for x in ("r1", "r2", None) for c in "ac"}


@tables
@pytest.mark.parametrize("name", ["consensus_edges", "hierarchy_tree", "acyclic_edges"])
def test_every_run_as_if_alone(spark, name):
    rows = spark.read.parquet(f"{SMALL}/class_hierarchy.parquet")
    votes = rows.select("run_id", F.col("edge_id").alias("seq"), F.lower(F.trim("child")).alias("child"), F.lower(F.trim("parent")).alias("parent"), "source", "trusted")
    alone = {"consensus_edges": O.consensus, "hierarchy_tree": lambda v: O.enforce_tree(O.consensus(v)), "acyclic_edges": lambda v: O.acyclic_first(v.where("child is not null and parent is not null"))}[name]
    runs = [r[0] for r in rows.select("run_id").distinct().collect()]
    want = {(run, r["child"], r["parent"]) for run in runs for r in alone(votes.where(F.col("run_id") == run)).collect()}
    got = [(r["run_id"], r["child"], r["parent"]) for r in ontology_queries.QUERIES[name](spark, SMALL).collect()]
    assert len(runs) > 1 and set(got) == want


def test_more_edges_than_the_driver_takes(spark):
    n = O.MAX_CLASSES + 1
    edges = spark.range(n).selectExpr("concat('r', id % 7) as run_id", "id as seq", "concat('c', id) as child", "'top' as parent", "true as trusted", "0L as weak")
    assert O.acyclic_first(edges, ("run_id",)).count() == n and O.enforce_tree(edges, keys=("run_id",)).count() == n


def test_entities_of_every_type(spark, tmp_path):
    def v(*at):
        return [1.0 if i in at else 0.0 for i in range(64)]

    # 24 types, whose vectors beyond the first twenty have directions of their own, and one vector without a type.
    rows = [(i, f"t{i % 24}", v(i % 24)) for i in range(1, 97)] + [(97, None, v(3)), (98, None, v(40))]
    spark.createDataFrame(rows, "vec_id long, entity_type string, embs array<float>").write.parquet(f"{tmp_path}/entity_embeddings.parquet")
    assert metric_queries.entity_assignment(spark, str(tmp_path)).first().asDict() == {"full": 97, "half": 0, "none": 1, "score": pytest.approx(97 / 98)}


def run_rows(spark):
    return spark.createDataFrame([("a", "FloodForm", "Flood"), ("b", "Garage", None), ("c", "FloodForm", "Flood"), ("c", "Flood", ""), ("c", None, "x"), (None, "Flood", "x")], "run_id string, name string, parent string")


def test_runs_without_a_common_word(spark):
    nodes = run_rows(spark)
    names = M.class_names(nodes)
    pairs, sizes = M.run_pairs(names, "a"), M.run_sizes(names, "a")
    got = {r["run_id"]: r for r in M.alignment(pairs, sizes).collect()}
    assert set(got) == {"b", "c"} and got["b"]["f1"] == 0 and got["c"]["precision"] == pytest.approx(1) and got["c"]["recall"] == pytest.approx((1 + 2**-0.5) / 2)
    scores = pairs.select("run_id", F.col("sim").alias("score"), "label")
    auc = {r["run_id"]: r["auc"] for r in M.roc_auc(scores, metric_queries._zeros(pairs, sizes)).collect()}
    assert auc == {"b": None, "c": 1.0}
    assert {r["run_id"]: r["average_precision"] for r in M.average_precision(scores).collect()} == {"c": 1.0}
    assert {r["run_id"]: r["f1"] for r in M.against_first(nodes, M.continuous_f1_of, "precision double, recall double, f1 double").collect()} == {"b": 0.0, "c": 0.0}


@tables
def test_continuous_f1_by_all_matchings(spark):
    import itertools

    a, b = M.Run([("FloodForm", "Flood"), ("FloodZone", "Zone"), ("Zone", None)]), M.Run([("FormZone", "Zone"), ("Zone", ""), ("FloodForm", "Form"), ("Flood", "Zone")])
    m = [[min(*x) for x in zip(c, p)] for c, p in zip(*(y.tolist() for y in M._end_similarity(a, b)))]
    best = max(sum(m[i][j] for i, j in enumerate(order)) for order in itertools.permutations(range(len(m[0])), len(m)))
    p, r, _ = M.continuous_f1_of(a, b)[0]
    assert p * len(m) == pytest.approx(best) and r * len(m[0]) == pytest.approx(best)


@tables
def test_descendants_of_every_node(spark):
    pairs = core_queries.QUERIES["p5_descendant_pairs"](spark, SMALL).collect()
    tree = {r["node_id"]: r["n_descendants"] for r in core_queries.p5_descendants(spark, SMALL).collect()}
    assert len({(r["ancestor_id"], r["node_id"]) for r in pairs}) == len(pairs) and all(r["distance"] > 0 for r in pairs)
    assert Counter(r["ancestor_id"] for r in pairs) == {n: k for n, k in tree.items() if k} and len(pairs) > 0
