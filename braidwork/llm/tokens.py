"""Text sizes in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public tokenizers' vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that byte-level BPE of this vocabulary splits words by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handed to the tokenizer at once; longer texts go in stretches that end at white space.
STRETCH = 100_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """One encoder per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> list[int]:
    own, out, at = encoder(path), [], 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        if end < len(text):
            back = max(text.rfind(" ", at + STRETCH // 2, end), text.rfind("\n", at + STRETCH // 2, end))
            end = back if back > at else end
        out += own.encode_ordinary(text[at:end])
        at = end
    return out


def token_count(c: Column, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a string; 0 for null and empty strings."""
    path = os.path.join(directory, vocabulary)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(encode(t, path)) if t else 0 for t in texts], dtype="int32")

    return count(c)
