"""Ward's linkage, splits, siblings, labels, header groups, judged and structural metrics, kept tables and questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork import session
from braidwork.models import HashedEmbedder, LineClient, RuleClient, SentenceTriples
from braidwork.operators import induction as I
from braidwork.operators import metrics as M
from braidwork.operators import model_steps as S


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_ward_finds_planted_classes_and_a_hierarchy(spark):
    rng = np.random.default_rng(2)
    tops = np.repeat(np.eye(12)[:3], 3, axis=0) * 3
    centres = tops + np.eye(12)[3:12]
    x = unit(np.repeat(centres, 12, axis=0) + 0.05 * rng.normal(size=(108, 12)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    classes, tree = I.ward_classes(df)
    got = {r["entity"]: r["class_of"] for r in classes.collect()}
    assert len(got) == 108 and all(len({got[i] for i in range(12 * k, 12 * k + 12)}) == 1 for k in range(9)) and len(set(got.values())) == 9
    parents = {r["child"]: r["parent"] for r in tree.collect()}
    assert 4 <= len(parents) <= 8 and set(parents) | set(parents.values()) <= set(got.values()) and not any(p in parents for p in parents.values())
    assert I.ward_classes(df.where("id < 2"))[0].collect() == [] and I.ward_classes(df.where("id < 0"))[1].collect() == []


def test_incoherent_classes_split_by_a_relation_of_half(spark):
    a = spark.createDataFrame([(f"e{i}", "A") for i in range(4)] + [("o", "Other"), ("b", "B"), (None, "A")], "entity_id string, class string")
    edges = spark.createDataFrame([("e0", "R"), ("e1", "R"), ("e0", "S"), ("e1", "S"), ("e2", "S"), ("b", "R"), ("x", "R"), ("e3", None)], "src string, rel string")
    got = {(r["entity_id"], r["class"]) for r in I.split_incoherent(a, edges, RuleClient([("Class A", "1")], "5")).collect()}
    assert got == {("e0", "A with R"), ("e1", "A with R"), ("e2", "A"), ("e3", "A"), ("o", "Other"), ("b", "B"), (None, "A")}
    again = {r["class"] for r in I.refine(a, edges, RuleClient([("Class A: ", "1")], "none")).collect()}
    assert again >= {"A with R", "Other", "B"}


def test_siblings_merge_in_chains_under_one_parent(spark):
    rows = [("p", "a", [1.0, 0.0]), ("p", "b", [0.98, 0.199]), ("p", "c", [0.92, 0.392]), ("p", "d", [0.0, 1.0]), ("q", "e", [1.0, 0.0]), ("q", "f", None)]
    got = {(r["child"], r["merged_into"]) for r in I.merge_siblings(spark.createDataFrame(rows, "parent string, child string, v array<double>")).collect()}
    assert got == {("b", "a"), ("c", "a")}


def test_labels_windows_and_header_groups(spark):
    e = spark.createDataFrame([("x", "Deed"), ("y", None), ("z", "Deed"), ("w", "Bond")], "id string, entity_type string")
    got = {r["id"]: r["labels"] for r in I.induced_labels(e, ["Paper"], LineClient([("Deed", "Paper"), ("Bond", "Unheard")])).collect()}
    assert got == {"x": ["Deed", "Paper"], "y": [], "z": ["Deed", "Paper"], "w": ["Bond"]}
    t = I.baseline_triples(spark.createDataFrame([(1, "The Form covers Basement."), (2, None), (3, "")], "source long, text string"), SentenceTriples()).collect()
    assert [(r["subject"], r["relation"], r["source"]) for r in t] == [("The Form", "COVERS", "1")]
    heads = spark.createDataFrame([(f, h) for f in "ab" for h in ("P_A", "P_B", "P_C", "DATE", "X")] + [("c", "X")], "file string, header string")
    tokens = spark.createDataFrame([("a", "claim"), ("b", "claims"), ("c", "survey")], "file string, token string")
    phases = I.file_classes(heads, tokens, LineClient([("DATE", "Times"), ("^X$", "")], "none"))
    assert {(r["class"], r["header"]) for r in phases["classes"].collect()} == {("P", "P_A"), ("P", "P_B"), ("P", "P_C"), ("Times", "DATE")}
    assert {r["group"] for r in phases["functions"].collect()} >= {"a"} and set(phases) == {"names", "classes", "functions", "bridges"}


def test_answers_by_number_survive_odd_names(spark):
    odd = ["- a", '"b"', "c -> d", "e\nf", "  g ", "1. h", ""]
    items = spark.createDataFrame([(x,) for x in [*odd, None, "- a"]], "item string")
    got = {r["item"]: r["answer"] for r in S.ask_per_item(items, LineClient([("", lambda line: f"<{line}>".replace(" -> ", " to "))]), "Say it.", 3).collect()}
    assert set(got) == set(odd) and got["- a"] == "<- a>" and got["e\nf"] == "<e f>"


def test_judged_alignment_and_structure_of_runs(spark):
    pairs = spark.createDataFrame([("r", "A", "X", 0.9), ("r", "A", "Y", 0.7), ("r", "B", "Y", 0.5)], "run_id string, induced string, reference string, sim double")
    sizes = spark.createDataFrame([("r", 2, 4), ("s", 2, 1)], "run_id string, n_induced int, n_reference int")
    got = {r["run_id"]: (r["precision"], r["recall"]) for r in M.judged_alignment(pairs, sizes, RuleClient([("", "Yes.")])).collect()}
    assert got == {"r": (0.5, 0.5), "s": (0.0, 0.0)}
    a = M.Run([("Flood Form", "Flood"), ("Flood", None), ("Zone", "Zone")])
    assert M._depths(a).tolist()[: len(a.names)] == [0, 1, 1] and M.depth_similarity_of(a, a)[0][0] == pytest.approx(1)
    assert M.graph_f1_of(a, a)[0][2] == pytest.approx(1) and M.graph_f1_of(a, M.Run([("Other", None)]))[0][2] == pytest.approx(0)


def test_recall_of_facts(spark):
    facts = spark.createDataFrame([("1", "flood form covers basement"), ("1", "entirely unlike words here"), (None, None)], "chunk_id string, fact string")
    triples = spark.createDataFrame([("Flood Form", "Policy", "COVERS", "basement", "Thing"), ("POL-0123456789ab", "PolicyRecord", "HAS_ZIP", None, None)], "subject string, subject_type string, relation string, object string, object_type string")
    assert [r["text"] for r in M.linearized(triples).collect()] == ["Flood Form covers basement", "policy has zip"]
    assert M.fact_recall(facts, triples, block=1).first().asDict() == {"facts": 2, "found": 1, "recall": 0.5}
    assert M.fact_recall(facts.limit(0), triples).first()["recall"] == 0.0
    ids = spark.createDataFrame([("Flood",), ("ba",), ("é",), (None,), ("",)], "id string")
    said = M.triple_facts(spark.createDataFrame([("1", "the flood | x | basement"), ("1", "ood | x | nothing"), ("1", "a | b"), ("1", " | b | c"), ("1", None), ("1", "café|x|B")], "chunk_id string, line string"))
    assert said.count() == 3 and M.fact_recall_substring(said, ids).first().asDict() == {"facts": 3, "found": 2, "recall": pytest.approx(2 / 3)}
    client = RuleClient([("", "1. The form covers all basements.\n- short\n\nplain words that are long enough")])
    chunks = spark.createDataFrame([("7", "s", "text")], "chunk_id string, source string, content string")
    assert {r["fact"] for r in M.chunk_facts(chunks, client).collect()} == {"The form covers all basements.", "plain words that are long enough"}


def test_embedder_is_the_same_alone_and_in_a_batch():
    e = HashedEmbedder(64)
    texts = ["Flood form", "", None, "café 12", "a", "Flood form"]
    both = e.embed(texts)
    assert np.allclose(both, np.concatenate([e.embed([t]) for t in texts])) and np.allclose(both[0], both[5]) and not both[1].any()
    assert float(both[0] @ e.embed(["flood forms"])[0]) > 0.7 > float(both[0] @ e.embed(["something else"])[0]) + 0.2


def test_tables_are_kept_until_their_input_changes(spark, tmp_path):
    made, src = [], str(tmp_path / "in")
    spark.range(3).write.parquet(src)

    def build():
        made.append(1)
        return spark.read.parquet(src).withColumn("x", F.lit(len(made)))

    read = [session.cached_table(spark, build, [src], str(tmp_path / "kept"), v).first()["x"] for v in ("1", "1", "2", "1")]
    assert read == [1, 1, 2, 1]
    spark.range(5).write.mode("overwrite").parquet(src)
    assert session.cached_table(spark, build, [src], str(tmp_path / "kept")).count() == 5


def test_package_is_shipped_and_tables_are_dropped(spark):
    session.ship(spark)
    path = session.table_path(spark, "dropped")
    spark.range(1).write.parquet(path)
    made, session._MADE[:] = list(session._MADE), [path]
    session.drop_all(spark)
    session._MADE[:] = [p for p in made if p != path]
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_questions(spark):
    spark.createDataFrame([("a", 2), ("b", 3)], "name string, n int").createOrReplaceTempView("asked_about")
    client = RuleClient([("which names", "```sql\nSELECT name, n FROM asked_about\n```"), ("how many", "SELECT count(*) AS k FROM asked_about"), ("drop it", "DROP TABLE asked_about"), ("broken", "SELECT nope FROM asked_about"), ("Say in one sentence", "Two names.")], "UNANSWERABLE")
    got = S.answer_question(spark, "which names", "asked_about(name, n)", client)
    assert got["chart"] == {"kind": "bar", "x": "name", "y": "n"} and got["rows"].count() == 2 and got["sql"].startswith("SELECT")
    assert S.answer_question(spark, "how many", "", client)["chart"]["kind"] == "number" and S.answer_question(spark, "why", "", client)["sql"] is None
    assert S.answer_question(spark, "drop it", "", client)["error"] and S.answer_question(spark, "broken", "", client)["error"]
