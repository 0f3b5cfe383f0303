"""Small cases of the core operators: shapes, nulls, ties, empty inputs."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.models import HashedEmbedder, RuleClient, SentenceTriples, ask, embed_column
from braidwork.operators import chunking as C
from braidwork.operators import clustering as Cl
from braidwork.operators import extraction as X
from braidwork.operators import fileclasses as B
from braidwork.operators import filters as Fl
from braidwork.operators import graph as G
from braidwork.operators import linkage as L
from braidwork.operators import metrics as M
from braidwork.operators import model_steps as S
from braidwork.operators import normalize as N
from braidwork.operators import ontology as O
from braidwork.operators import records as R
from braidwork.operators import resolution as Re
from braidwork.plans import pipeline
from braidwork.sources import readers, writers
from braidwork.streaming.upsert import stream_graph

TRIPLE = "seq long, subject string, subject_type string, relation string, object string, object_type string, span string, confidence double, chunk_id string, source string, source_type string"


def triples(spark, rows):
    """Rows (subject, subject_type, relation, object, object_type), structured in order."""
    return spark.createDataFrame([(i, s, a, r, o, b, None, 1.0, "1", "f", "structured") for i, (s, a, r, o, b) in enumerate(rows)], TRIPLE)


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} {kind}" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r["x"] for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("x")).orderBy("i").collect()]


def test_field_names(spark):
    assert column(spark, ["amountPaidOnBuildingClaim", "POLICY_NUMBER", "POLNO"], T.humanize_field) == ["amount paid on building claim", "policy number", "polno"]
    assert column(spark, ["ENDORSEMENT_PET_ID", "x_date", "OVERALL_CSAT", "amount_paid", "zone"], T.field_group) == ["Coverage", "Date", "Status", "Identity", "Other"]
    assert column(spark, ["claims", "gas", "its"], T.normalize_token) == ["claim", "gas", "its"]
    assert column(spark, ["flood zone!", "", "9x"], lambda c: T.sanitize_label(c, "Entity", "Class")) == ["floodzone", "Entity", "Class9x"]


def test_sections(spark):
    text = "intro\nIV. PROPERTY NOT INSURED\nsome words that make this section long enough\nA. Coverage Under\nmore words that make this section long enough too"
    pages = spark.createDataFrame([("d", 0, text), ("d", 1, "words on the second page in 2024"), ("e", 0, None)], "source string, page int, text string")
    got = {r["section_no"]: r for r in C.split_sections(pages).collect()}
    assert [got[k]["section_hierarchy"] for k in sorted(got)] == [["IV. PROPERTY NOT INSURED"], ["IV. PROPERTY NOT INSURED", "A. Coverage Under"]]
    assert got[2]["pages"] == [0, 1] and "in 2024" in got[2]["temporal_markers"]


def test_sub_chunks_repeat_the_header_and_keep_an_oversize_item(spark):
    parts = ["HEAD"] + ["w " * 375] * 3 + ["w " * 1500]
    df = spark.createDataFrame([("a", "\n\n".join(parts), ["H"]), ("b", "short", None), ("c", None, None), ("d", "w " * 5000, ["H"])], "source string, content string, section_hierarchy array<string>")
    rows = C.sub_chunk(df).collect()
    a = [r for r in rows if r["source"] == "a"]
    assert [r["section_hierarchy"][-1] for r in a] == ["part 1", "part 2", "part 3"] and all(r["content"].startswith("HEAD\n\n") for r in a)
    assert sum(r["source"] in "bcd" for r in rows) == 3


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=30))
def test_batches_never_exceed_the_cap_unless_one_record_does(spark, sizes):
    df = spark.createDataFrame([("f", i, "w " * n) for i, n in enumerate(sizes)], "source string, seq long, formatted string")
    rows = C.batch_records(df, "X", cap=50).orderBy("chunk_id").collect()
    bodies = [r["content"].split("\n", 1)[1].split("\n\n") for r in rows]
    assert sum(map(len, bodies)) == len(sizes)
    assert all(sum(int(len(b.split()) / 0.75) for b in body) <= 50 or len(body) == 1 for body in bodies)


def test_semantic_merge_compares_with_the_first(spark):
    v = [[1.0, 0.0], [0.9, 0.436], [0.62, 0.785], [0.0, 1.0]]
    df = spark.createDataFrame([("s", i, f"t{i}", ["a"] * i, x) for i, x in enumerate(v)] + [("n", 0, None, None, None)], "source string, seq long, content string, section_hierarchy array<string>, vector array<double>")
    rows = {(r["source"], r["chunk_no"]): r["merged_from"] for r in C.semantic_merge(df).collect()}
    assert rows == {("s", 0): [0, 1], ("s", 1): [2], ("s", 2): [3], ("n", 0): [0]}


def test_record_blocks(spark):
    text = "DATASET: X\n\nRECORD:\n  [Policy] a: 1 | b: 10:30 | c:  | a: 2\n  no group: x\n\nRECORD:\n  [Other] z: 9"
    rows = R.parse_records(spark.createDataFrame([("1", text, 5), ("2", "No records here.", 5), ("3", None, 5)], "chunk_id string, content string, value int")).collect()
    assert {(r["record_no"], r["field"], r["value"]) for r in rows} == {(1, "a", "2"), (1, "b", "10:30"), (2, "z", "9")}


def test_value_types(spark):
    cases = [("d", "2024-01-10T00:00"), ("original construction date", "1990"), ("n", "250000"), ("m", "$1,500.00"), ("p", "15.5 %"), ("zone code", "A"), ("t", "NASHVILLE, CITY OF")]
    assert column(spark, cases, R.value_type) == ["Date", "Date", "Numeric", "Currency", "Percentage", "Categorical", "Text"]
    assert column(spark, ["number of floors in the insured building", "rated flood zone"], R.relation_of) == ["HAS_NUMBER_OF_FLOORS_IN_INSURED_BUILDING", "HAS_RATED_FLOOD_ZONE"]


def test_keys_and_identities(spark):
    def fields(rows):
        return spark.createDataFrame(rows, "id int, record_type string, field string, value string")

    f = fields([(1, "policies", "rated flood zone", "A"), (1, "policies", "x", "1"), (2, "policies", "x", "1"), (2, "policies", "rated flood zone", "A"), (3, "other", "q", "v"), (4, "claims", "id", "77"), (4, "claims", "q", None)])
    keys = {r["id"]: r["record_key"] for r in R.composite_key(f, ["id"]).collect()}
    assert keys[1] == keys[2] and keys[1].startswith("POL-") and len(keys[1]) == 16 and keys[3].startswith("REC-") and keys[4] == "CLM-77"
    p = fields([(1, "policies", "insured name", "Ann "), (1, "policies", "email", "a@b"), (2, "claims", "email", "A@B"), (2, "claims", "insured name", "ann"), (3, "claims", "email", "x@y"), (4, "claims", "property state", "FL"), (4, "claims", "reported zip code", "33019")])
    ids = {(r["id"], r["grp"]): r["identity_key"] for r in R.identity_keys(p, ["id"]).collect()}
    assert set(ids) == {(1, "person"), (2, "person"), (4, "property")} and ids[1, "person"] == ids[2, "person"] and ids[4, "property"].startswith("PROP-")


def test_placeholders(spark):
    cases = [("HAS_REPORTED_CITY", "Currently Unavailable"), ("HAS_NAME", "N/A Holdings"), ("HAS_X", "-"), ("HAS_X", "na"), ("HAS_COST", "0"), ("HAS_ZONE", "AE"), ("HAS_CITY", " "), ("HAS_DATE", "9999-99-99"), ("HAS_X", None)]
    assert column(spark, cases, Fl.is_placeholder) == [True, False, True, True, True, False, True, True, None]
    rows = [(i, "HAS_REPORTED", "Unavailable" if i < 60 else str(i)) for i in range(200)] + [(500 + i, "HAS_OTHER", "Unavailable" if i < 60 else str(i)) for i in range(400)]
    reasons = Fl.placeholder_reason(spark.createDataFrame(rows, "seq long, relation string, object string")).where("reason is not null").groupBy("relation", "reason").count().collect()
    assert {(r["relation"], r["reason"], r["count"]) for r in reasons} == {("HAS_REPORTED", "high_prevalence_placeholder", 60)}


def test_meaning_and_grounding(spark):
    df = spark.createDataFrame([("HAS_DEDUCTIBLE", "a very long text", "Text", "X", "llm"), ("HAS_DEDUCTIBLE", "30 days", "Text", "X", "llm"), ("COVERS", "Flood", "Peril", "Organization", None), ("COVERS", "Flood", "Peril", "Organization", "structured")], "r string, o string, ot string, s string, t string")
    got = [r["x"] for r in df.select(Fl.semantic_reason(F.col("r"), F.col("o"), F.col("ot"), F.col("s"), F.col("t")).alias("x")).collect()]
    assert got == ["object_not_numeric", None, "organization_covers", None]
    cases = [("Water  CAME in", "the water came in fast"), ("a b c d x", "d c b a"), ("a b x y", "a b c d"), ("abc", "abc"), ("single", "another word"), (None, "x"), ("some span", None)]
    assert column(spark, cases, lambda s, t: Fl.grounding(s, Fl.flat(t))) == [1.0, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_first_of_key_is_idempotent(spark):
    t = triples(spark, [("A ", "x", "R", "b", "y"), ("a", "x", "R", "B", "y"), ("a", "x", "S", "B", "y"), (None, "x", "R", "b", "y")])
    once = Fl.first_of_key(t)
    assert {r["seq"] for r in once.collect()} == {0, 2, 3} == {r["seq"] for r in Fl.first_of_key(once).collect()}


@pytest.mark.parametrize("sql, ok", [("SELECT 'delete' AS x", True), ("with a as (select 1) select * from a", True), ("DROP TABLE x", False), ("select 1; select 2", False), ("INSERT INTO t VALUES (1)", False), ("select 1 -- drop", True), ("", False)])
def test_read_only(sql, ok):
    assert Fl.is_read_only(sql) is ok


def test_limit():
    assert Fl.clamp_limit("select 1;") == "select 1 LIMIT 200" and Fl.clamp_limit("select 1 limit 5") == "select 1 limit 5"


def test_relation_names(spark):
    assert column(spark, ["excludes_many_things", "COVERS_HOMES", "COVERS", "PROVIDES_FLOOD_INSURANCE", "means", "HAS_LIMIT", None], N.normalize_relation) == ["EXCLUDED_FROM", "COVERS", "COVERS", "COVERS", "DEFINED_AS", "HAS_COVERAGE_LIMIT", None]
    t = triples(spark, [("s", "T", r, "o", k) for r, k in (("HAS_BUILDING_COST", "Currency"), ("HAS_BUILDING_COST_TOTAL", "Currency"), ("HAS_BUILDING_COST_FLAG", "Categorical"), ("HAS_DATE", "Date"))])
    sim = spark.createDataFrame([("HAS_BUILDING_COST", "HAS_BUILDING_COST_TOTAL", 0.9), ("HAS_BUILDING_COST", "HAS_BUILDING_COST_FLAG", 0.95), ("HAS_BUILDING_COST", "HAS_DATE", 0.99)], "a string, b string, sim double")
    assert [tuple(r) for r in N.relation_merges(t, sim).collect()] == [("HAS_BUILDING_COST_TOTAL", "HAS_BUILDING_COST")]


def test_collapse(spark):
    rows = [(f"s{i}", "T", "HAS_PREMIUM", str(i * 3 // 4), "Numeric") for i in range(20)] + [(f"s{i}", "T", "HAS_ZONE", "AX"[i % 2], "Categorical") for i in range(20)] + [(f"s{i}", "T", "HAS_SERIAL", str(10**9 + i), "Numeric") for i in range(20)] + [("s1", "T", "HAS_NOTE", "once", "Text"), ("s1", "T", "HAS_NOTE", "twice", "Text"), ("s1", "T", "HAS_OWNER", "Bob", "Text"), ("s1", "T", "HAS_X", None, "Text")]
    left, props = N.collapse(triples(spark, rows))
    got = {(r["subject"], r["property"]): r["value"] for r in props.collect()}
    assert got["s1", "note"] == "twice" and got["s3", "serial"] == "1000000003" and ("s1", "zone") not in got and ("s1", "owner") not in got
    roles = {r["relation"]: r["role"] for r in N.relation_roles(N.collapse_candidates(triples(spark, rows))).collect()}
    assert roles["HAS_ZONE"] == "dimension" and roles["HAS_SERIAL"] == "property" and left.count() == len(rows) - 22


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (203, 201), (None, 5)] + [(300, 300 + i) for i in range(1, 200)]
    got = {r["id"]: r["component"] for r in Re.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (200, 201, 203)} == {200} and 100 not in got and {got[300 + i] for i in range(200)} == {300}
    assert Re.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pairs_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 500)] + 0.25 * rng.normal(size=(500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3] = x[11]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = {(r["a"], r["b"]) for r in Re.cosine_pairs(df, 0.9, block=64).collect()}
    s = x @ x.T
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if s[i, j] >= 0.9 and not {i, j} & {7, 11}}
    assert got == want | {(3, 7), (3, 11)}


@pytest.mark.parametrize(("dim", "threshold", "kind"), [(6, 0.9, "long"), (40, 0.6, "string"), (40, 0.9, "long")])
def test_every_similar_pair(spark, dim, threshold, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, dim))[rng.integers(0, 12, 500)] + 0.3 * rng.normal(size=(500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3] = x[11]  # pairs of copies, and of each copy with its neighbours
    ids = [i if kind == "long" else f"n{i:03}" for i in range(500)]
    order = rng.permutation(500)
    df = spark.createDataFrame([(ids[i], x[i].tolist()) for i in order] + [(None, x[0].tolist()), (ids[0], None)], f"id {kind}, v array<double>").repartition(3)
    got = [(r["a"], r["b"]) for r in Re.similar_pairs(df, threshold, strip=70).collect()]
    s = x @ x.T
    assert sorted(got) == [(ids[i], ids[j]) for i in range(500) for j in range(i + 1, 500) if s[i, j] >= threshold] and {(ids[3], ids[7]), (ids[7], ids[11])} < set(got)
    assert Re.similar_pairs(df.where("v is null"), threshold).collect() == []


def test_rewrite(spark):
    t = triples(spark, [("Flood", "c", "R", "flood", "c"), ("x", "c", "R", "flood", "c"), (None, "c", "R", "y", "c")])
    merges = Re.elect(spark.createDataFrame([("Flood", "k"), ("flood", "k"), ("floods", "k")], "id string, component string"))
    assert {r["id"]: r["canonical"] for r in merges.collect()} == {"flood": "Flood", "floods": "Flood"}
    assert {(r["subject"], r["object"]) for r in Re.rewrite(t, merges).collect()} == {("x", "Flood"), (None, "y")}


def test_field_types_and_comparison(spark):
    df = spark.createDataFrame([("HAS_DATE_OF_LOSS", []), ("HAS_AMOUNT_PAID", []), ("X", ["2024-01-01", "2024-02-01"]), ("X", ["1", "2"]), ("X", ["AE", "X"]), ("X", ["a long county name", "b"]), ("X", [])], "r string, s array<string>")
    assert [r["x"] for r in df.select(L.field_type(F.col("r"), F.col("s")).alias("x")).collect()] == ["date", "numeric", "date", "numeric", "categorical", "text", "text"]
    cases = [("AE", "AE", "categorical"), ("AE", "X", "categorical"), ("100000", "100500", "numeric"), ("100000", "200000", "numeric"), ("$250,000", "250000", "numeric"), ("0", "0", "numeric"), ("2024-01-01", "2024-01-16", "date"), ("2024-01-01", "2024-06-01", "date"), ("2024-01-01T1", "2024-01-01", "date"), (" Ab", "aB ", "text")]
    assert column(spark, cases, L.compare) == [1, 0, 1, 0, 1, 1, 0.5, 0, 1, 1]


def test_links_respect_time(spark):
    rows = []
    for i in range(60):
        for kind, key in (("PolicyRecord", f"POL-{i}"), ("ClaimRecord", f"CLM-{i}")):
            rows += [(key, kind, "IS_A", kind, "RecordType"), (key, kind, "HAS_NAME", f"name {i}", "Text"), (key, kind, "HAS_STREET", f"street {i}", "Text"), (key, kind, "HAS_ZONE", "AX"[i % 2], "Categorical")]
        rows += [(f"POL-{i}", "PolicyRecord", "HAS_EFFECTIVE_DATE", "2024-01-01", "Date"), (f"CLM-{i}", "ClaimRecord", "HAS_DATE_OF_LOSS", "2023-01-01" if i < 5 else "2024-05-01", "Date")]
    t = triples(spark, rows)
    got = {(r["subject"], r["object"]) for r in L.link(L.profiles(t)).collect()}
    # Before its policy a claim fits only in the other direction, which has no event and so allows it.
    assert {(f"CLM-{i}", f"POL-{i}") for i in range(5, 60)} <= got and all(a[4:] == b[4:] for a, b in got)
    assert {r["type"] for r in L.record_types(t).collect()} == {"PolicyRecord", "ClaimRecord"}


def test_graph(spark):
    t = triples(spark, [("a", None, "R", "b", "Numeric"), ("a", "Policy", "R", "b", "Risk"), ("b", "Text", "S", "c", None), (None, "x", "R", "a", "Policy"), ("POL-1", "PolicyRecord", "HAS_X", "-12.5", "Odd")])
    nodes = {r["id"]: r["entity_type"] for r in G.merge_nodes(t).collect()}
    assert nodes == {"a": "Policy", "b": "Numeric", "c": "Unknown", "POL-1": "PolicyRecord", "-12.5": "Odd"}
    assert {r["id"]: r["entity_type"] for r in G.entity_graph(t).collect()}["b"] == "Risk" and G.merge_edges(t).count() == 3
    assert column(spark, [("POL-1", "x"), ("-12.5", "x"), ("$5", None), ("Flood", "Text"), ("Flood", None)], G.lane) == ["record", "value", "value", "value", "concept"]
    d = {r["id"]: (r["out_degree"], r["in_degree"]) for r in G.degrees(G.merge_nodes(t), G.merge_edges(t)).collect()}
    assert d["a"] == (1, 0) and d["b"] == (1, 1)


def edge_list(spark, rows):
    return spark.createDataFrame(rows, "src string, rel string, dst string")


def test_votes_and_backbone(spark):
    e = edge_list(spark, [("a", "r", "x"), ("b", "r", "x"), ("x", "r", "c"), ("p", "r", "h"), ("h", "r", "q"), ("p2", "r", "h")])
    known = spark.createDataFrame([("a", "K"), ("b", "J"), ("c", "J")], "id string, class string")
    votes = {r["id"]: r["class"] for r in G.neighbor_vote(e, known).collect()}
    assert votes == {"x": "J"}
    a = spark.createDataFrame([("p", "P"), ("p2", "P"), ("h", "Other"), ("q", "Q"), ("z", "Z")], "id string, class string")
    got = {r["class"]: (r["connected_direct"], r["connected_2hop"], r["disconnected"]) for r in G.backbone(e, a).collect()}
    assert got == {"P": (0, 2, False), "Q": (0, 1, False), "Z": (0, 0, True)}
    assert G.quality(e, a).first()["other_fraction"] == 0.2 and G.quality(edge_list(spark, []), a.limit(0)).first()["other_fraction"] == 1.0


def test_outlier_of_twenty(spark):
    rows = [(f"e{i}", "r", "t") for i in range(20)] + [("odd", "s", "t"), ("odd", "s", "u"), ("odd", "q", "u")]
    ents = spark.createDataFrame([(f"e{i}", "A", "concept") for i in range(20)] + [("odd", "B", "concept"), ("t", "V", "value"), ("u", "V", "value")], "id string, entity_type string, lane string")
    a = spark.createDataFrame([(f"e{i}", "K") for i in range(20)] + [("odd", "K"), ("t", "W"), ("u", "W")], "entity_id string, class string")
    out = O.structural_outliers(O.signatures(ents, edge_list(spark, rows)), a).collect()
    assert [(r["entity_id"], r["nearest_class"]) for r in out if r["class"] == "K"] in ([("odd", "W")], [("odd", None)])


def test_consensus_tree(spark):
    votes = [("a", "b", "s", True), ("c", "b", "w1", False), ("d", "b", "w1", False), ("d", "b", "w2", None), ("b", "a", "s", True), ("d", "a", "s", True), ("e", "e", "s", True)] + [(f"n{i + 1}", f"n{i}", "s", True) for i in range(6)]
    kept = O.consensus(spark.createDataFrame(votes, "child string, parent string, source string, trusted boolean"))
    tree = {(r["child"], r["parent"]) for r in O.enforce_tree(kept).collect()}
    assert ("a", "b") in tree and ("b", "a") not in tree and ("c", "b") not in tree and len([1 for c, _ in tree if c == "d"]) == 1
    # A fifth level is cut off, and what hung below it starts anew.
    assert {(c, p) for c, p in tree if c[0] == "n"} == {("n1", "n0"), ("n2", "n1"), ("n3", "n2"), ("n4", "n3"), ("n6", "n5")}


def test_interclass_edges(spark):
    e = edge_list(spark, [(f"a{i}", "r", f"b{i}") for i in range(10)] + [(f"b{i}", "s", f"a{i}") for i in range(4)] + [("a0", "r", "c0")])
    a = spark.createDataFrame([(f"{k}{i}", k.upper()) for k in "abc" for i in range(10)], "entity_id string, class string")
    assert [tuple(r) for r in O.interclass_edges(e, a).collect()] == [("A", "B", 10)]


def test_value_typing_boundary(spark):
    e = edge_list(spark, [("p1", "HAS_D", "v1"), ("p2", "HAS_D", "v1"), ("c1", "HAS_D", "v2"), ("c2", "HAS_D", "v2"), ("p1", "LONE", "v3")])
    ents = spark.createDataFrame([("p1", "P", "record"), ("p2", "P", "record"), ("c1", "C", "record"), ("c2", "C", "record"), ("v1", "Date", "value"), ("v2", "Date", "value"), ("v3", "Date", "value")], "id string, entity_type string, lane string")
    a = spark.createDataFrame([("p1", "P"), ("p2", "P"), ("c1", "C"), ("c2", "C"), ("v1", "Other"), ("v2", "Other"), ("v3", "Other")], "entity_id string, class string")
    assert {(r["entity_id"], r["class"], r["signal"]) for r in O.type_values(e, a, ents).collect()} == {("v1", "C", "B"), ("v2", "C", "B")}


def test_prefixes_and_siblings(spark):
    heads = [f"ENDORSEMENT_{k}_{s}" for k in ("EARTHQUAKE", "JEWELRY") for s in ("CODE", "NWP", "DED_CODE", "EXPOSURE")] + ["ALPHA", "COVPROP_A", "COVPROP_B", "COVPROP_C", "COVLIAB_A", "COVLIAB_B"]
    g = B.prefix_groups(spark.createDataFrame([(h,) for h in heads], "header string"))
    assert {r["prefix"] for r in g.collect()} == {"ENDORSEMENT_EARTHQUAKE", "ENDORSEMENT_JEWELRY", "COVPROP"}
    assert {(r["common_prefix"], r["prefix"]) for r in B.siblings(g).collect()} == {("ENDORSEMENT", "ENDORSEMENT_EARTHQUAKE"), ("ENDORSEMENT", "ENDORSEMENT_JEWELRY")}
    assert {r["header"] for r in B.ungrouped(spark.createDataFrame([(h,) for h in heads], "header string"), g).collect()} == {"ALPHA", "COVLIAB_A", "COVLIAB_B"}
    assert B.prefix_groups(spark.createDataFrame([], "header string")).collect() == []


def test_cross_file_classes(spark):
    rows = [("claim flood", "CLAIM", h) for h in ("ID", "DATE", "STATUS", "ADJUSTER")] + [("claim auto", "CLAIM", h) for h in ("ID", "DATE", "STATUS", "REGION")] + [("survey", "SURVEY", "SCORE")]
    got = {(r["parent"], r["class"], r["header"]): r["shared"] for r in B.cross_file_classes(spark.createDataFrame(rows, "class string, prefix string, header string")).collect()}
    assert got["claim auto", "claim flood", "ID"] and not got["claim auto", "claim flood", "ADJUSTER"] and ("survey", "survey", "SCORE") in got


def test_file_words(spark):
    files = {"a": ("geico", "renter", "survey"), "b": ("geico", "renter", "claims"), "c": ("tmobile", "phone", "survey"), "d": ("tmobile", "phone", "claim")}
    roles, clusters = B.token_roles(spark.createDataFrame([(f, t) for f, ts in files.items() for t in ts], "file string, token string"))
    assert {r["token"]: r["role"] for r in roles.collect()} == {"geico": "lob", "renter": "lob", "tmobile": "lob", "phone": "lob", "survey": "function", "claim": "function"}
    heads = spark.createDataFrame([(f, f"{k}_{i}") for f, k in (("a", "S"), ("b", "CLAIM"), ("c", "S"), ("d", "CLAIM")) for i in range(3)], "file string, header string")
    groups: dict = {}
    for r in B.function_groups(heads, spark.createDataFrame([(f, t) for f, ts in files.items() for t in ts], "file string, token string")).collect():
        groups.setdefault(r["group"], set()).add(r["file"])
    assert sorted(map(sorted, groups.values())) == [["a", "c"], ["b", "d"]]


def test_assignment_of_entities(spark):
    classes = B.file_class_map(spark.createDataFrame([("Policy", 1, "x/f1.csv"), ("FloodPolicy", 2, "x/f1.csv"), ("Claim", 1, "f2.csv")], "class string, level int, file string"))
    rows = [("e1", "f1.csv"), ("e1", "d/f2.csv"), ("e1", "f2.csv"), ("e2", "none.csv"), ("e3", None)]
    assert {r["id"]: r["class"] for r in B.assign_entities(spark.createDataFrame(rows, "id string, file string"), classes).collect()} == {"e1": "Claim", "e2": "Unclassified", "e3": "Unclassified"}


def test_communities_and_splits(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(6) for j in range(i + 1, 6)] + [("a0", "b0", 0.1)]
    got = {r["id"]: r["community"] for r in Cl.communities(spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    assert len({got[f"a{i}"] for i in range(6)}) == 1 == len({got[f"b{i}"] for i in range(6)}) and got["a0"] != got["b0"]
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(4)[k] + 0.05 * rng.normal(size=(20, 4)) for k in (0, 1)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = {r["id"]: r["part"] for r in Cl.split_groups(spark.createDataFrame([("g", i, r.tolist()) for i, r in enumerate(x)] + [("one", 99, x[0].tolist())], "grp string, id long, v array<double>")).collect()}
    assert len({parts[i] for i in range(20)}) == 1 and parts[0] != parts[25] and parts[99] == 0


def test_matching_metrics(spark):
    sim = np.array([[0.9, 0.1, 0.2], [0.8, 0.7, 0.1], [0.1, 0.6, 0.5]])
    assert M.assignment(-sim) == [(0, 0), (1, 1), (2, 2)]
    rows = spark.createDataFrame([("x", f"i{i}", f"r{j}", float(sim[i, j])) for i in range(3) for j in range(3)], "run_id string, induced string, reference string, sim double")
    a = M.alignment(rows, spark.createDataFrame([("x", 3, 3), ("y", 3, 2)], "run_id string, n_induced int, n_reference int")).orderBy("run_id").collect()
    assert a[0]["precision"] == pytest.approx((0.9 + 0.8 + 0.6) / 3) and a[0]["recall"] == pytest.approx((0.9 + 0.7 + 0.5) / 3) and a[1]["f1"] == 0
    scores = spark.createDataFrame([("x", 0.9, 1), ("x", 0.5, 1), ("x", 0.5, 0), ("x", 0.1, 0), ("y", 0.9, 1)], "run_id string, score double, label int")
    assert {r["run_id"]: r["auc"] for r in M.roc_auc(scores).collect()} == {"x": pytest.approx(3.5 / 4), "y": None}
    assert {r["run_id"]: r["average_precision"] for r in M.average_precision(scores).collect()} == {"x": pytest.approx((1 + 2 / 3) / 2), "y": 1.0}
    assert M.depth_similarity(sim, [0, 1, 2], [0, 1, 1]) == pytest.approx((1 + 1 + 4 / 5) / 3)
    v = {k: np.eye(3)[i] for i, k in enumerate("abc")}
    assert M.graph_f1(v, v, [("a", "b")], [("a", "b")])[2] == pytest.approx(1)


def test_verdicts(spark):
    g = M.grounding_score(spark.createDataFrame([("NOT_SUPPORTED",), ("PARTIALLY SUPPORTED",), ("SUPPORTED",), ("not supported",), (None,)], "verdict string")).first()
    assert (g["supported"], g["partial"], g["rejected"]) == (1, 1, 2) and g["score"] == pytest.approx(1.5 / 4)


def test_cosine_pairs_of_string_ids_and_hot_buckets(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(16)[0] + 0.08 * rng.normal(size=(150, 16)), rng.normal(size=(150, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"n{i:03}", r.tolist()) for i, r in enumerate(x)] + [(None, x[0].tolist()), ("no", None)], "id string, v array<double>")
    got = {(r["a"], r["b"]) for r in Re.cosine_pairs(df, 0.8, block=20).collect()}
    s = x @ x.T
    want = {(f"n{i:03}", f"n{j:03}") for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.8}
    assert got == want and len(want) > 5000
    assert Re.cosine_pairs(df.where("id is null"), 0.8).collect() == []


def test_work_of_cosine_pairs_falls_with_the_rows():
    for rows in (10**4, 10**6, 10**9):
        bits, keys = Re.bands(0.9, rows, 1e-5)
        assert keys / 2**bits < 0.05 and keys < 1000
    shares = [Re.bands(0.9, rows, 1e-5) for rows in (10**4, 10**6, 10**9)]
    assert [k / 2**b for b, k in shares] == sorted((k / 2**b for b, k in shares), reverse=True)


def test_labelled_parts_become_fields(spark):
    rows = [("POL", "1", "HAS_ADDRESS", "city: A | zip = 1 |"), ("POL", "1", "HAS_CONTACT", "city: B; name: N"), ("POL", "1", "HAS_NOTE", "a | b: c"), ("POL", "1", "HAS_TIME", "12:30"), ("POL", "2", "HAS_ADDRESS", None)]
    got = {(r["id"], r["relation"], r["value"]) for r in L.parts_as_fields(spark.createDataFrame(rows, "type string, id string, relation string, value string")).collect()}
    assert got == {("1", "HAS_CITY", "A"), ("1", "HAS_ZIP", "1"), ("1", "HAS_NAME", "N"), ("1", "HAS_NOTE", "a | b: c"), ("1", "HAS_TIME", "12:30")}


def test_links_of_every_two_types_and_of_none(spark):
    rows = [(t, f"{t}{i}", "HAS_NAME", f"n{i}", 1) for t in "ABC" for i in range(60)] + [(t, f"{t}{i}", "HAS_ZIP", f"z{i}", 1) for t in "AB" for i in range(60)] + [("D", "D1", "HAS_OTHER", "x", 1), ("D", "D2", "HAS_RARE", "x", 1)]
    p = spark.createDataFrame(rows, "type string, id string, relation string, value string, seq int")
    shared = {(r["type_a"], r["type_b"], r["relation"]): r["fields"] for r in L.shared_relations(p).collect()}
    assert shared == {("A", "B", "HAS_NAME"): 2, ("A", "B", "HAS_ZIP"): 2, ("A", "C", "HAS_NAME"): 1, ("B", "C", "HAS_NAME"): 1}
    assert L.shared_relations(p.where("type = 'D' or id = 'A1'")).count() == 0 and L.link(p.where("type = 'D'")).count() == 0
    got = {(r["subject"], r["object"]) for r in L.link(p, 1, 0.4).collect()}
    assert got == {(f"{a}{i}", f"{b}{i}") for a, b in ("AB", "AC", "BC") for i in range(60)}


def test_numbers_in_prose(spark):
    text = "The Flood Deductible is $1,250.00 per loss. Notice must reach the Claims Office within 30 days. Building Coverage: replacement cost of 80 percent applies. $5 alone."
    got = {(r["relation"], r["object"]) for r in X.numeric_triples(spark.createDataFrame([("1", "s", text), ("2", "s", None)], "chunk_id string, source string, content string")).collect()}
    assert {("HAS_DEDUCTIBLE", "$1,250.00"), ("HAS_DEADLINE", "30 days"), ("HAS_COINSURANCE_REQUIREMENT", "80%")} <= got and not any(o == "$5" for _, o in got)


def test_answers_of_models(spark):
    assert X.parse_json_list("```json\n[1]\n```") == [1] and X.parse_json_list('x [{"a": 1}] y') == [{"a": 1}] and X.parse_json_list('{"a": 1} junk {"b": 2} {') == [{"a": 1}, {"b": 2}] and X.parse_json_list(None) == []
    assert X.parse_arrow_map("A → B\nC D -> E\n\nnothing") == {"A": "B", "C D": "E"}
    calls = RuleClient([("fail", lambda p: 1 / 0), ("x", json.dumps([{"subject": "a", "relation": "means", "object": "b", "confidence": "odd"}]))])
    got = {r["key"]: r for r in ask(spark.createDataFrame([(1, "x"), (2, "x"), (3, "fail")], "key int, prompt string"), calls).collect()}
    assert got[1]["answer"] == got[2]["answer"] and got[3]["answer"] is None and "division" in got[3]["error"]
    t = X.extract(spark.createDataFrame([("1", "s", "x"), ("2", "s", None)], "chunk_id string, source string, content string"), calls, []).collect()
    assert [(r["subject"], r["relation"], r["confidence"]) for r in t] == [("a", "DEFINED_AS", 1.0)]
    kept = spark.createDataFrame([], "hash string, answer string")
    assert ask(spark.createDataFrame([(1, "x")], "key int, prompt string"), calls, kept).count() == 1
    assert X.bootstrap_vocabulary(["t"], RuleClient([(".", '["has it", "IS", "b", "c"]')])) == ["HAS_IT", "B", "C"]


def test_class_steps_of_models(spark):
    said = S.expand_headers(spark.createDataFrame([("GWP",), ("a_b",)], "header string"), RuleClient([(".", "GWP -> gross written premium")]))
    assert {r["header"]: r["name"] for r in said.collect()} == {"GWP": "gross written premium", "a_b": "a_b"}
    ents = spark.createDataFrame([("c", "T", "concept"), ("POL-1", "Policy", "record"), ("5", "Numeric", "value"), ("d", "T", "concept")], "id string, entity_type string, lane string")
    typed = S.type_entities(ents, ["Policy", "Risk"], RuleClient([(".", "c -> risk\nd -> Nonsense")]))
    assert {r["entity_id"]: r["class"] for r in typed.collect()} == {"c": "Risk", "POL-1": "Policy", "5": "Other", "d": "Other"}
    assert S.propose_classes(spark.createDataFrame([("Clause", 20)], "name string, n long"), RuleClient([(".", '["Policy", "Other", "policy", "Risk"]')])) == ["Policy", "Risk", "Clause"]
    assert S.question_sql("?", "", RuleClient([(".", "```sql\nselect 1\n```")])) == "select 1" and S.question_sql("?", "", RuleClient([(".", "UNANSWERABLE")])) is None


def test_embedder(spark):
    m = HashedEmbedder()
    v = m.embed(["flood zone", "Flood  Zone!", "deductible", ""])
    assert np.allclose(v[0], v[1]) and v[0] @ v[2] < 0.5 and not v[3].any()
    assert len(embed_column(spark.createDataFrame([("x",), (None,)], "t string"), "t").collect()) == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name, Age \n\"x, y\",\"two\nlines\"\n", encoding="utf-8")
    row = readers.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert row["name"] == "x, y" and row["_source"].endswith("a.csv")
    (tmp_path / "r.json").write_text(json.dumps({"Recs": [{"id": 1}, {"id": 2}]}))
    assert readers.read_records(spark, str(tmp_path / "r.json"), "Recs").count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("Source: u\nTitle: v\nBody one.\n\nBody two.")
    chunks = C.text_chunks(readers.read_texts(spark, str(tmp_path / "t"))).collect()
    assert [c["content"] for c in chunks] == ["Body one.\n\nBody two."]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "h.csv").write_text("a, b ,,\n1,2\n3,4\n")
    f = readers.csv_fingerprints(spark, str(tmp_path / "f")).first()
    assert f["headers"] == ["A", "B"] and f["record_count"] == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "flood-policy.json").write_text(json.dumps({"properties": {"zone": {"$ref": "risk.json#/x"}}}))
    props, links = readers.schema_classes(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in props.collect()] == [("FloodPolicy", "zone")] and [tuple(r) for r in links.collect()] == [("FloodPolicy", "Risk")]
    tables = spark.createDataFrame([("s", 1, [["h1", "h2"], ["a", None], ["", ""]]), ("s", 2, [["only"]])], "source string, table_no int, rows array<array<string>>")
    assert [r["content"] for r in readers.format_tables(tables).collect()] == ["TABLE: h1 | h2\nh1: a"]

    path = str(tmp_path / "graph")
    t = triples(spark, [("a", "Unknown", "R", "b", "Risk"), ("a", "Policy", "HAS_NOTE", "once", "Text")])
    writers.write_graph(t, path)
    writers.write_graph(triples(spark, [("b", "Peril", "S", "c", "Unknown"), ("a", "Policy", "R", "b", "Risk")]), path, wipe=False)
    nodes = {r["id"]: r for r in writers.read_graph(spark, path)[0].collect()}
    assert set(nodes) == {"a", "b", "c"} and nodes["a"]["props"] == {"note": "once"} and nodes["b"]["entity_type"] == "Risk" and writers.read_graph(spark, path)[1].count() == 2
    writers.register_views(spark, path)
    assert writers.answer(spark, "select count(*) as n from edges").first()["n"] == 2
    with pytest.raises(ValueError):
        writers.answer(spark, "drop table nodes")

    src, out = str(tmp_path / "in"), str(tmp_path / "streamed")
    t.write.parquet(src)
    q = stream_graph(spark.readStream.schema(t.schema).parquet(src), out, str(tmp_path / "ck"))
    q.awaitTermination()
    assert writers.read_graph(spark, out)[1].count() == 2
    more = triples(spark, [("c", "Peril", "S", "a", "Other"), ("a", "Policy", "R", "b", "Risk")])
    for _ in range(2):  # a batch that runs again
        writers.append_batch(more, out, 1)
    before = {r["id"]: r["entity_type"] for r in writers.read_graph(spark, out)[0].collect()}
    writers.compact(spark, out)
    writers.append_batch(more, out, 1)  # and one that runs again after it was merged
    nodes, edges = writers.read_graph(spark, out)
    assert {r["id"]: r["entity_type"] for r in nodes.collect()} == before == {"a": "Policy", "b": "Risk", "c": "Peril", "once": "Text"} and edges.count() == 3
    writers.write_graph(triples(spark, [("x", "Risk", "R", "y", "Risk")]), out)
    assert {r["id"] for r in writers.read_graph(spark, out)[0].collect()} == {"x", "y"}
    writers.edges_by_relation(edges, str(tmp_path / "by"))
    assert {r["rel"] for r in spark.read.parquet(str(tmp_path / "by")).collect()} == {"R", "S", "HAS_NOTE"}
    writers.clear_graph(spark, out)
    with pytest.raises(ValueError):
        writers.read_graph(spark, out)


def test_heads_of_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid,"last, first", note ,,"say ""x"""\r\n1,2,3,4,5\r\n\r\n6,7,8,9,0\n')
    (tmp_path / "b.csv").write_text("only\n")
    got = {r["file"].rsplit("/", 1)[1]: (r["headers"], r["record_count"]) for r in readers.csv_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (["ID", "LAST, FIRST", "NOTE", 'SAY "X"'], 2), "b.csv": (["ONLY"], 0)}


def test_chunks_to_triples(spark):
    chunks = spark.createDataFrame([
        ("1", "policies.csv", "RECORD:\n  [Policy] policy effective date: 2024-01-10 | rated flood zone: A | insured name: Ann Lee | email: a@b.c\n\nRECORD:\n  [Policy] rated flood zone: unknown", ["records 0–1"]),
        ("2", "a.pdf", "The Flood Form covers Finished Basement. The Flood Form has a deductible of $1,250.00 for each loss.", ["I. A"]),
    ], "chunk_id string, source string, content string, section_hierarchy array<string>")
    r = pipeline.chunks_to_triples(chunks, SentenceTriples(), ["COVERS"])
    kinds = {(x["relation"], x["source_type"]) for x in r.triples.collect()}
    assert {("IS_A", "structured"), ("BELONGS_TO", "structured"), ("COVERS", "llm"), ("HAS_DEDUCTIBLE", "regex")} <= kinds
    assert {x["reason"]: x["n"] for x in r.removed.collect()} == {"context_placeholder": 1} and r.links.count() == 0


@settings(max_examples=5, deadline=None)
@given(st.permutations(list(range(8))))
def test_components_do_not_depend_on_order(spark, order):
    links = [(0, 1), (1, 2), (3, 4), (5, 6), (6, 7)]
    pairs = [(order[a], order[b]) for a, b in links]
    got = {r["id"]: r["component"] for r in Re.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for group in ({0, 1, 2}, {3, 4}, {5, 6, 7}):
        assert {got[order[x]] for x in group} == {min(order[x] for x in group)}


def test_recursive_taxonomy(spark):
    from braidwork.operators import recursive as Rc

    rng = np.random.default_rng(0)
    rows, vecs = [], []
    for i in range(60):
        kind = "A" if i < 40 else None if i < 42 else "B"
        v = np.eye(4)[0 if i < 20 else 1 if i < 40 else 2] + 0.05 * rng.normal(size=4)
        rows.append((f"e{i}", kind))
        vecs.append((f"e{i}", (v / np.linalg.norm(v)).tolist()))
    e = spark.createDataFrame(rows, "id string, entity_type string")
    members, tree = Rc.recursive_taxonomy(e, spark.createDataFrame(vecs, "id string, v array<double>"))
    links = {(r["child"], r["parent"]): r["split_method"] for r in tree.collect()}
    assert links == {("Root/A", "Root"): "entity_type", ("Root/B", "Root"): "entity_type", ("Root/A/1", "Root/A"): "structural", ("Root/A/2", "Root/A"): "structural"}
    got = {r["id"]: r["class"] for r in members.collect()}
    assert got["e0"] != got["e30"] and got["e0"].startswith("Root/A/") and got["e40"] == "Root" and got["e50"] == "Root/B"
    v = Rc.fused_vectors(e, spark.createDataFrame([("e0", "R", "e1", None)], "src string, rel string, dst string, source string")).collect()
    assert len(v) == 60 and all(abs(np.linalg.norm(r["v"]) - 1) < 1e-9 for r in v)
