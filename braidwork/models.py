"""Replaceable models: language models that answer prompts, and embedders. Answers are kept, so they are asked for once.

Both are plain objects that travel to the Python workers. The defaults are deterministic and need no network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize


class LLMClient(Protocol):
    def answer(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class RuleClient:
    """Answers by the first rule (pattern, answer or function of the prompt) that is found in the prompt."""

    def __init__(self, rules: list[tuple[str, str | Callable[[str], str]]], otherwise: str = "[]"):
        self.rules, self.otherwise = rules, otherwise

    def answer(self, prompt: str) -> str:
        for pattern, reply in self.rules:
            if re.search(pattern, prompt):
                return reply(prompt) if callable(reply) else reply
        return self.otherwise


class LineClient:
    """Answers each numbered line "n. text" of a prompt with "n -> answer" by the first rule that is found in the text.

    ``tasks`` are rules over whole prompts, which go first.
    """

    def __init__(self, rules: list[tuple[str, str | Callable[[str], str]]], otherwise: str = "none", tasks: list[tuple[str, str]] = ()):
        self.line, self.tasks = RuleClient(rules, otherwise), list(tasks)

    def answer(self, prompt: str) -> str:
        for pattern, reply in self.tasks:
            if re.search(pattern, prompt):
                return reply
        return "\n".join(f"{m[1]} -> {self.line.answer(m[2])}" for m in re.finditer(r"^(\d+)\. (.*)$", prompt, re.M))


class SentenceTriples:
    """A stand-in for extraction: sentences "The x verb y ..." as triples."""

    _SENTENCE = re.compile(r"([A-Z][\w-]+(?: [\w-]+){0,2}) (covers|excludes|requires|includes|means|reported|agreed|asked|says) ((?:[\w$,.-]+ ?){1,5})")

    def answer(self, prompt: str) -> str:
        text = prompt.rsplit("TEXT:", 1)[-1]
        return json.dumps([{"subject": s.strip(), "relation": v.upper(), "object": o.strip(" ."), "span": f"{s} {v} {o}"[:120], "confidence": 0.8} for s, v, o in self._SENTENCE.findall(text)])


class HashedEmbedder:
    """Character n-grams of two to four letters hashed to ``dim`` numbers, scaled to length one. An empty text is all zero."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        clean = [" ".join(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
        clean = [f" {t} " if t else "" for t in clean]
        chars = np.frombuffer("".join(clean).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(clean)), [len(t) for t in clean])
        out, rolling = np.zeros(len(texts) * self.dim), np.zeros(len(chars), dtype=np.uint64)
        for n in range(1, 5):
            if len(chars) < n:
                break
            rolling = rolling[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(1)
            if n > 1:
                inside = owner[: len(rolling)] == owner[n - 1 :]
                h = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                sign = np.where(h >> np.uint64(63), 1.0, -1.0)
                np.add.at(out, (owner[: len(rolling)] * self.dim + (h >> np.uint64(32) & np.uint64(0x3FFFFFFF)).astype(np.int64) % self.dim)[inside], sign[inside])
        out = out.reshape(len(texts), self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_column(df: DataFrame, column: str, embedder: Embedder | None = None, out: str = "v") -> DataFrame:
    """``df`` with the vectors of a text column as array<double>, made in Arrow batches."""
    model = embedder or HashedEmbedder()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model.embed(["" if x is None else x for x in s])))

    return df.withColumn(out, run(F.col(column)))


def ask(prompts: DataFrame, client: LLMClient, replay: DataFrame | None = None) -> DataFrame:
    """(key, answer, error) for (key, prompt); equal prompts are asked once, and those in ``replay`` (hash, answer) not at all.

    The answers are written to the shared folder before use, so that no lost task asks again for what was kept. A client
    that fails gives a null answer and the error's text.
    """
    hashed = prompts.select("key", "prompt", F.sha2("prompt", 256).alias("hash"))
    open_ = hashed.groupBy("hash").agg(F.first("prompt").alias("prompt"))
    if replay is not None:
        open_ = open_.join(replay.select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, p in zip(batch["hash"], batch["prompt"]):
                try:
                    rows.append((h, client.answer(p), None))
                except Exception as e:
                    rows.append((h, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["hash", "answer", "error"])

    answers = materialize(open_.mapInPandas(run, "hash string, answer string, error string"), "answers")
    if replay is not None:
        answers = answers.unionByName(replay.select("hash", "answer", F.lit(None).cast("string").alias("error")))
    return hashed.join(answers, "hash", "left").select("key", "answer", "error")
