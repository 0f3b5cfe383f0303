import os

import pytest

from braidwork.llm import language as L
from tests.compare import SMALL

SENTENCES = {
    "en": ["The water came in through the back door and the pump failed again last night.", "Please note that the roof is limited unless both parties agree in writing.", "We could not find the invoice in the file so the agent will send another copy.", "Nobody has told me what happens with the payment although I have called many times."],
    "de": ["Das Wasser kam durch die Hintertür und die Pumpe ist letzte Nacht wieder ausgefallen.", "Bitte beachten Sie, dass das Dach begrenzt ist, wenn nichts anderes vereinbart wurde.", "Wir konnten die Rechnung in der Akte nicht finden, deshalb schickt der Makler eine Kopie.", "Niemand hat mir gesagt, was mit der Zahlung geschieht, obwohl ich oft angerufen habe."],
    "es": ["El agua entró por la puerta trasera y la bomba volvió a fallar la noche pasada.", "Le recordamos que el tejado tiene un límite salvo acuerdo por escrito entre las partes.", "No hemos encontrado la factura en el expediente, por lo que el perito enviará otra copia.", "Nadie me ha explicado qué pasa con el pago aunque he llamado muchas veces."],
}


@pytest.fixture(scope="module")
def model():
    pairs = [(" ".join(p), c) for c, p in SENTENCES.items() for _ in range(3)] + [(s, c) for c, p in SENTENCES.items() for s in p] + [(SENTENCES["en"][0], "de")]
    return L.fit(pairs)


def found(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int, code string")
    out = {}
    for r in L.identify(df, model).collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["seg_no"]) for k, v in out.items()}


def test_statuses_and_stretches(spark, model):
    en, de, es = (" ".join(SENTENCES[c]) for c in ("en", "de", "es"))
    rows = [
        (1, en, "en-GB", 1, "x"), (2, en, None, None, None), (3, en, "German", None, None), (4, en + "\n" + de + "\n" + en, "en", None, None), (5, "no comment", "fr", None, None), (6, None, "en", None, None), (7, " \n", "xx", None, None),
        (8, de + " Good morning everyone. " + de, "de", None, None), (9, "RECORD:\n[Policy] cost: 5 | city: Here and there and so on | date: 2024-01-01 | more: words than twelve in this line of it", "es", None, None), (None, en, "de", None, None), (10, es.upper(), "", None, None), (11, es * 400, "spa", None, None),
    ]
    got = found(spark, model, rows)
    assert set(got) == set(range(1, 12))
    status = {k: v[0]["status"] for k, v in got.items()}
    assert status == {1: "right", 2: "missing", 3: "wrong", 4: "mixed", 5: "short", 6: "short", 7: "short", 8: "right", 9: "short", 10: "missing", 11: "right"}
    assert [(r["seg_no"], r["lang"]) for r in got[4]] == [(1, "en"), (2, "de"), (3, "en")] and got[10][0]["lang"] == "es"
    text = rows[3][1]
    assert text[got[4][1]["start"] : got[4][1]["end"]] == de and all(0 < r["confidence"] <= 1 for r in got[4])


SWEDISH = ["Vattnet kom in genom bakdörren och pumpen slutade fungera igen i går kväll.", "Observera att taket är begränsat om inte båda parter kommer överens skriftligen.", "Vi kunde inte hitta fakturan i akten så handläggaren skickar en ny kopia.", "Ingen har berättat för mig vad som händer med betalningen fast jag har ringt många gånger."]


def test_a_language_learned_from_its_label(spark):
    pairs = [(" ".join(p), c) for c, p in (SENTENCES | {"sv": SWEDISH}).items() for _ in range(3)]
    mislabelled = [(" ".join(SENTENCES["en"]), "da")] * 2
    model = L.fit(pairs + mislabelled)
    assert model.languages == ["de", "en", "es", "sv"]
    got = found(spark, model, [(1, " ".join(SWEDISH), "sv", None, None), (2, " ".join(SWEDISH), "Swedish", None, None), (3, " ".join(SENTENCES["en"]), "sv-SE", None, None), (4, " ".join(SENTENCES["en"]), "da", None, None)])
    assert {k: v[0]["status"] for k, v in got.items()} == {1: "right", 2: "right", 3: "wrong", 4: "wrong"}


def test_running_text_in_lines_with_labels_and_bars():
    es = SENTENCES["es"]
    chat = "\n".join(f"[10:0{i}] Maria Lopez: {s}" for i, s in enumerate(es))
    assert sum(L.sentences(chat)[1]) == sum(len(line.split()) for line in chat.split("\n"))
    prose = " ".join(SENTENCES["en"] * 10)
    assert sum(L.sentences(f"[Note] Summary: {prose}")[1]) == len(prose.split()) + 2
    assert sum(L.sentences(f"a | b | c and {prose}")[1]) == len(prose.split()) + 2
    assert L.sentences("RECORD:\n[Policy] cost: 5 | city: Here\n---\n[Other] cost: 7") == ([], [])
    spans, words = L.sentences("Hola:\n" + es[0] + "\n[Policy] cost: 5 | city: Here")
    assert words == [1, len(es[0].split())] and L.sentences("") == ([], [])


def test_numbers_of_stretches_without_gaps(spark, model):
    noise = " ".join(["zqx vjk wqz xkq jvz qqk zzx vvj kkq xzq jjk wwq zxv qkz jqx zzq."] * 4)
    got = found(spark, model, [(1, " ".join(SENTENCES["en"]) + "\n" + noise + "\n" + " ".join(SENTENCES["de"]), "en", None, None)])[1]
    named = [r["lang_no"] for r in got if r["lang"] != "und"]
    assert named == list(range(1, len(named) + 1)) and {r["lang"] for r in got} >= {"en", "de"}


def test_rejection_and_no_model(spark, model):
    noise = "zqx vjk wqz xkq jvz qqk zzx vvj kkq xzq jjk wwq zxv qkz jqx"
    assert found(spark, model, [(1, noise, "en", None, None)])[1][0]["lang"] == "und"
    assert found(spark, L.fit([]), [(1, SENTENCES["en"][0], "en", None, None)])[1][0]["status"] in ("unknown", "short")
    assert found(spark, model, []) == {}


def test_labels(spark):
    from pyspark.sql import functions as F

    rows = ["en", "EN", "eng", "en_GB", " English", "pt-BR", "deu", "sv", "sv-SE", "Swedish", "svenska", "ja", "und", "xx", "", None, "mul", "unknown"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    assert [r["c"] for r in df.select("i", L.label_code(F.col("v"), L.notations(spark)).alias("c")).orderBy("i").collect()] == ["en"] * 5 + ["pt", "de"] + ["sv"] * 4 + ["ja"] + [None] * 6


@pytest.mark.skipif(not os.path.isdir(SMALL.replace("0.001", "0.01")), reason="test tables are missing")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    model = L.fit(L.sample_labelled(half))
    out = L.identify(docs.where("doc_id % 2 = 1 and length(text) < 2000"), model)
    judged = out.where("status in ('right', 'wrong')").groupBy("status").count().collect()
    n = {r["status"]: r["count"] for r in judged}
    assert n["right"] / (n["right"] + n["wrong"]) > 0.85  # about a tenth of the labels is wrong on purpose
