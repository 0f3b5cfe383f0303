"""Languages of documents and of their stretches by nearest centroid.

Sentences become normalised TF-IDF vectors of hashed character n-grams and are compared by cosine with several clustered
centroids per language; a sentence far from all of them is rejected. Sentences of one language join into stretches.
The languages are those that the labels of the documents name, in any notation of the Java locale data, and that have text
of their own. The centroids are fitted on the driver from a bounded sample of labelled documents, whose labels may be
partly wrong; the whole text of every document is then read in Arrow batches, each on its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents per label and of all labels, characters per document and sentences per language that the centroids are fitted on.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHARS, SAMPLE_SENTENCES = 400, 8000, (80, 4000), 1200
#: Hash buckets of n-grams, lengths of n-grams, centroids per language.
BUCKETS, ORDERS, CENTROIDS = 1 << 14, (2, 3), 4
#: Words that a stretch has at least; sentences longer than LONG words are cut for scoring.
STRETCH_WORDS, LONG = 12, 40
#: Cosine, as a share of what the sample's sentences reach, below which a sentence has no language.
REJECT = 0.45
#: What a change of language costs, in word-weighted cosine.
SWITCH = 1.2
#: Characters taken at a time, and n-grams scored at a time.
BLOCK, SCORED = 400_000, 5000
#: Cosine from which the means of two labels are of one language, which then is the label with more documents.
SAME = 0.97
#: Further names of languages, beside codes, English and own names.
ALIASES = {"ger": "de", "fre": "fr", "dut": "nl", "castellano": "es", "espanol": "es", "francais": "fr", "portugues": "pt"}
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+")
_LINE = re.compile(r"[^\r\n]*\S[^\r\n]*")
_NO_LETTER = re.compile(r"[\W\d_]+")
#: A label at the start of a cell, one behind a tag, and a line that is a label only.
_LABEL = re.compile(r"\s*(?:\[[^\]]{1,40}\]\s*)?[^:]{1,60}:")
_TAGGED = re.compile(r"\s*\[[^\]]{1,40}\]\s*[^|:]{1,60}:")
_HEADING = re.compile(r"[^:]{1,60}:\s*\Z")
_WORD, _ENDED = re.compile(r"[^\W\d_]{2,}"), re.compile(r"[^\W\d_]{2}[.!?…][\"'”»)\]]*\s*\Z")
#: Words that the value of a tagged label has at least to be running text; a cell between bars needs STRETCH_WORDS.
FIELD_WORDS = 4


def notations(spark: SparkSession) -> dict[str, str]:
    """Two-letter code by every lower-case code, English name and own name of a language, with ALIASES."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english, out = locale.forLanguageTag("en"), {}
    for code in sorted(locale.getISOLanguages()):
        if len(code) == 2:
            own = locale.forLanguageTag(code)
            for name in (own.getISO3Language(), own.getDisplayLanguage(english), own.getDisplayLanguage(own)):
                out.setdefault(name.lower(), code)
    return {**out, **{c: c for c in set(out.values())}, **ALIASES}


def label_code(c: Column, names: dict[str, str]) -> Column:
    """Two-letter code that a label names in any of ``names``, with or without a region; null if it names none."""
    head = F.split(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "[-_]")[0]
    return F.element_at(F.from_json(F.lit(json.dumps(names, sort_keys=True)), "map<string,string>"), head)


def _prose(value: str, words: int) -> bool:
    return bool(_ENDED.search(value)) or len(_WORD.findall(value)) >= words


def running(line: str) -> list[tuple[int, int]]:
    """Spans of the running text in a line. Short values behind a tagged label or between bars are fields, as are bare marks.

    A value is running text if it ends like a sentence or has FIELD_WORDS words, between bars STRETCH_WORDS, since fewer
    make no stretch. All other lines are running text as a whole.
    """
    if "|" not in line:
        m = _TAGGED.match(line)
        keep = _prose(line[m.end() :], FIELD_WORDS) if m else any(x.isalnum() for x in line)
        return [(0, len(line))] if keep else []
    out, at = [], 0
    for cell in line.split("|"):
        m = _LABEL.match(cell)
        if _prose(cell[m.end() if m else 0 :], STRETCH_WORDS):
            out.append((at, at + len(cell)))
        at += len(cell) + 1
    return out


def sentences(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the sentences of the running text, and their numbers of words. Long ones are cut.

    A line that is a label only belongs to the line after it and is left out where that one has fields only.
    """
    spans, words = [], []

    def add(a: int, b: int) -> None:
        part = text[a:b]
        n = len(part.split())
        if 0 < n <= LONG:
            spans.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
            words.append(n)
        elif n:
            found = [m.span() for m in re.finditer(r"\S+", part)]
            for i in range(0, n, LONG // 2):
                cut = found[i : i + LONG // 2]
                spans.append((a + cut[0][0], a + cut[-1][1]))
                words.append(len(cut))

    fields_follow = False
    kept = []
    for m in reversed(list(_LINE.finditer(text))):
        found = running(m[0])
        heading = bool(found) and bool(_HEADING.match(m[0]))
        if not (heading and fields_follow):
            kept += [(m.start() + a, m.start() + b) for a, b in reversed(found)]
            fields_follow = not found
    for a, b in reversed(kept):
        at = a
        for m in _SENTENCE.finditer(text, a, b):
            add(at, m.start())
            at = m.end()
        add(at, b)
    return spans, words


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, bucket, count) of the hashed character n-grams of each sentence's letters, sorted by sentence."""
    clean = [f" {_NO_LETTER.sub(' ', p.lower()).strip()} " for p in parts]
    lengths = np.array([len(c) for c in clean], dtype=np.int64)
    chars = np.frombuffer("".join(clean).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(clean)), lengths)
    keys = []
    rolling = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        rolling = rolling[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            inside = owner[: len(chars) - n + 1] == owner[n - 1 :]
            h = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (h >> np.uint64(64 - 14)).astype(np.int64)
            keys.append((owner[: len(chars) - n + 1] * BUCKETS + bucket)[inside])
    if not keys:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # BUCKETS x (languages * CENTROIDS)
    floor: float

    def weights(self, s: np.ndarray, b: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        v = (1 + np.log(c)) * self.idf[b]
        norm = np.sqrt(np.bincount(s, weights=v * v, minlength=n))
        return (v / np.maximum(norm, 1e-9)[s]).astype(np.float32)

    def scores(self, parts: list[str]) -> np.ndarray:
        """Best cosine with a centroid of each language, a row per sentence."""
        out = np.zeros((len(parts), len(self.languages)), dtype=np.float32)
        a = 0
        while a < len(parts):
            b, size = a, 0
            while b < len(parts) and (b == a or size + len(parts[b]) <= BLOCK):
                size += len(parts[b])
                b += 1
            s, k, c = ngrams(parts[a:b])
            if len(s):
                v = self.weights(s, k, c, b - a)
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                at = 0
                while at < len(first):  # sentences of about SCORED n-grams, whose rows of centroids stay in the processor's cache
                    to = max(at + 1, int(np.searchsorted(first, first[at] + SCORED)))
                    lo, hi = first[at], first[to] if to < len(first) else len(s)
                    rows = self.centroids.take(k[lo:hi], axis=0)
                    rows *= v[lo:hi, None]
                    sums = np.add.reduceat(rows, first[at:to] - lo, axis=0)
                    out[a + s[first[at:to]]] = sums.reshape(len(sums), -1, CENTROIDS).max(axis=2)
                    at = to
            a = b
        return out


def _dense(s: np.ndarray, k: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros((n, BUCKETS), dtype=np.float32)
    m[s, k] = v
    return m


def fit(labelled: list[tuple[str, str]], seed: int = 0) -> Model:
    """Centroids from (text, code) pairs. Sentences that another language's mean claims are left out before clustering.

    Languages with fewer than three sentences left are dropped, and so is a label whose mean has a cosine of SAME with that
    of a label with more sentences: its documents are of that language. Without any, the model has no language.
    """
    by: dict[str, list[str]] = {}
    for text, code in labelled:
        spans, words = sentences(text)
        by.setdefault(code, []).extend(text[a:b] for (a, b), w in zip(spans, words) if w >= 6)
    rng, total = np.random.default_rng(seed), {c: len(p) for c, p in by.items()}
    for code, parts in by.items():
        if len(parts) > SAMPLE_SENTENCES:
            by[code] = [parts[i] for i in sorted(rng.choice(len(parts), SAMPLE_SENTENCES, replace=False))]
    languages = sorted(c for c, p in by.items() if len(p) >= 3)
    grams = {c: ngrams(by[c]) for c in languages}
    n = sum(len(by[c]) for c in languages)
    seen = sum((np.bincount(grams[c][1], minlength=BUCKETS) for c in languages), np.zeros(BUCKETS))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    model = Model(languages, idf, np.zeros((BUCKETS, 0), np.float32), 0.0)
    if not languages:
        return model
    vectors = {c: (g[0], g[1], model.weights(*g, len(by[c]))) for c, g in grams.items()}

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)

    means = unit(np.stack([np.bincount(vectors[c][1], weights=vectors[c][2], minlength=BUCKETS) for c in languages]).astype(np.float32))
    order = sorted(range(len(languages)), key=lambda i: (-total[languages[i]], languages[i]))
    alike, own = means @ means.T, []
    for i in order:
        if all(alike[i, j] < SAME for j in own):
            own.append(i)
    languages, means = [languages[i] for i in sorted(own)], means[sorted(own)]
    kept_languages, tables, reached = [], [], []
    for i, c in enumerate(languages):
        dense = _dense(*vectors[c], len(by[c]))
        dense = dense[(dense @ means.T).argmax(axis=1) == i]
        if len(dense) < 3:
            continue
        centres = unit(dense[rng.choice(len(dense), min(CENTROIDS, len(dense)), replace=False)])
        for _ in range(8):
            nearest = (dense @ centres.T).argmax(axis=1)
            centres = unit(np.stack([dense[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))]))
        reached.append(np.median((dense @ centres.T).max(axis=1)))
        tables.append(np.concatenate([centres, np.zeros((CENTROIDS - len(centres), BUCKETS), np.float32)]))
        kept_languages.append(c)
    if not tables:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 0.0)
    return Model(kept_languages, idf, np.ascontiguousarray(np.concatenate(tables).T), float(min(reached)) * REJECT)


def _best_runs(gain: np.ndarray, words: list[int]) -> list[list[int]]:
    """[first sentence, end, language, words] of the sequence of languages with the highest gain less SWITCH for each change."""
    n, k = gain.shape
    best, back = gain[0].copy(), np.zeros((n, k), dtype=np.int32)
    for i in range(1, n):
        top = int(best.argmax())
        move = best[top] - SWITCH
        stay = best >= move
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, move) + gain[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    runs: list[list[int]] = []
    for i, lang in enumerate(reversed(path)):
        if runs and runs[-1][2] == lang:
            runs[-1][1], runs[-1][3] = i + 1, runs[-1][3] + words[i]
        else:
            runs.append([i, i + 1, lang, words[i]])
    return runs


def stretches(scores: np.ndarray, words: list[int], floor: float) -> list[tuple[int, int, int, float]]:
    """(first sentence, end, language, confidence) of each stretch; language -1 where all was rejected.

    The best sequence of languages by word-weighted cosine, less SWITCH for each change. Stretches of fewer than
    STRETCH_WORDS words then join the neighbour with more words, shortest first, so only a whole text may be shorter.
    """
    n, k = scores.shape
    if not n or not k:
        return [(0, n, -1, 0.0)] if n else []
    w, peak, top = np.minimum(np.array(words, dtype=np.float64), 25), scores.max(axis=1), scores.argmax(axis=1)
    sure = peak >= floor
    named = top[sure]
    if len(named) and (named == named[0]).all():  # no other sequence can gain more
        runs = [[0, n, int(named[0]), sum(words)]]
    else:
        runs = _best_runs(np.where(sure[:, None], scores, 0.0) * w[:, None], words)
    while len(runs) > 1:
        j = min(range(len(runs)), key=lambda x: (runs[x][3], x))
        if runs[j][3] >= STRETCH_WORDS:
            break
        to = max((x for x in (j - 1, j + 1) if 0 <= x < len(runs)), key=lambda x: (runs[x][3], -x))
        runs[to][0], runs[to][1], runs[to][3] = min(runs[to][0], runs[j][0]), max(runs[to][1], runs[j][1]), runs[to][3] + runs[j][3]
        del runs[j]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][2] == r[2]:
                merged[-1][1], merged[-1][3] = r[1], merged[-1][3] + r[3]
            else:
                merged.append(r)
        runs = merged
    out = []
    for a, b, lang, _ in runs:
        mean = np.maximum(w[a:b], 1e-9) @ scores[a:b] / max(w[a:b].sum(), 1e-9)
        e = np.exp((mean - mean.max()) / 0.05)
        known = mean[lang] >= floor
        out.append((a, b, lang if known else -1, float(e[lang] / e.sum()) if known else 0.0))
    return out


def sample_labelled(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(text, code) pairs of documents of SAMPLE_CHARS characters, picked by a hash of the id.

    About SAMPLE_DOCS of each label, and fewer where all labels together would have more than SAMPLE_TOTAL.
    """
    least, most = SAMPLE_CHARS
    code = label_code(F.col(lang_col), notations(documents.sparkSession))
    usable = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), code.alias("code")).where(F.col("code").isNotNull() & F.length("text").between(least, most))
    counts = {r["code"]: r["n"] for r in usable.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = min(SAMPLE_DOCS, SAMPLE_TOTAL // max(1, len(counts)))
    chance = F.lit(0.0)
    for code, n in sorted(counts.items()):
        chance = F.when(F.col("code") == code, F.lit(each / n)).otherwise(chance)
    taken = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < chance * float(1 << 30)).limit(2 * SAMPLE_TOTAL)
    return [(r["text"], r["code"]) for r in sorted(taken.collect(), key=lambda r: (r["code"], r["id"] if r["id"] is not None else -1))]


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, seg_no, lang_no, lang, confidence, start, end, words, segments, label, status: a row per stretch of each document.

    lang is "und" where all was rejected; lang_no numbers the other stretches from 1, und has 0. status: short (fewer than STRETCH_WORDS words of running text, which may have no
    stretch at all: seg_no 0, lang null), mixed (several languages), missing (the label names none), wrong (another one),
    unknown (no language found) or right. Null and blank texts are short. Rows with a null id are left out. Columns not named here are ignored.
    """
    schema = "doc_id long, seg_no int, lang_no int, lang string, confidence double, start long, end long, words int, segments int, label string, status string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and (end == at or size < BLOCK):
                    size += len(batch["text"].iloc[end] or "")
                    end += 1
                yield pd.DataFrame(rows(batch.iloc[at:end]), columns=names)
                at = end

    def rows(block: pd.DataFrame) -> list[tuple]:
        found = [sentences(t or "") for t in block["text"]]
        parts = [t[a:b] for t, (spans, _) in zip(block["text"], found) for a, b in spans]
        scores, at, out = model.scores(parts), 0, []
        for doc_id, label, (spans, words) in zip(block["doc_id"], block["code"], found):
            own = scores[at : at + len(spans)]
            at += len(spans)
            label = label if isinstance(label, str) else None
            segments = stretches(own, words, model.floor)
            total = sum(words)
            if not segments:
                out.append((doc_id, 0, 0, None, 0.0, 0, 0, 0, 0, label, "short"))
                continue
            named = {s[2] for s in segments if s[2] >= 0}
            status = "short" if total < STRETCH_WORDS else "mixed" if len(named) > 1 else "unknown" if not named else "missing" if label is None else "right" if model.languages[next(iter(named))] == label else "wrong"
            named_no = 0
            for no, (a, b, which, sure) in enumerate(segments, 1):
                named_no += which >= 0
                out.append((doc_id, no, named_no if which >= 0 else 0, model.languages[which] if which >= 0 else "und", sure, spans[a][0], spans[b - 1][1], sum(words[a:b]), len(segments), label, status))
        return out

    texts = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), label_code(F.col(lang_col), notations(documents.sparkSession)).alias("code"))
    return texts.mapInPandas(read, schema)
