"""Cut oversized texts at natural boundaries by agglomerative merging.

A text starts as atomic segments between all its boundaries. Adjacent pairs lie in a heap ordered by the strength of the
boundary between them; the weakest is merged first while the merged size plus the overlap fits. Texts within the limit
never leave the JVM; the others are independent of each other and are cut in Arrow batches.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: words per token in the size estimate.
WORDS_PER_TOKEN = 0.75
#: Strength of the boundary before a word, by what ends before it or begins with it.
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, SECTION = range(6)
BOUNDARY_NAMES = ("word", "clause", "sentence", "line", "paragraph", "section")

_WORD = re.compile(r"\S+")
_SECTION = re.compile(r"(?:RECORD:|TABLE:|---+$|#{1,6}\s|[IVXLC]+\.\s+[A-Z]{2}|[A-Z]\.\s+[A-Z][a-z])")
_SENTENCE_END = re.compile(r"[.!?…。][\"'”»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:|–—][\"'”»)\]]*$|^\|$")


def estimated_tokens(c: Column) -> Column:
    """Number of words between white space divided by 0.75, rounded down; 0 for null."""
    words = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return F.floor(words / F.lit(WORDS_PER_TOKEN)).cast("int")


def words_within(tokens: int) -> int:
    """Most words whose estimate is at most ``tokens``."""
    n = int((tokens + 1) * WORDS_PER_TOKEN) + 1
    while n and int(n / WORDS_PER_TOKEN) > tokens:
        n -= 1
    return n


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    words: int
    overlap_words: int
    boundary: str


def strengths(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the words, and for each the strength of the boundary before it."""
    spans = [m.span() for m in _WORD.finditer(text)]
    found = [SECTION]
    for (a, b), (c, _) in zip(spans, spans[1:]):
        breaks = text.count("\n", b, c) or text.count("\r", b, c)
        last = text[max(a, b - 8) : b]
        if breaks:
            found.append(SECTION if _SECTION.match(text, c) else PARAGRAPH if breaks > 1 else LINE)
        elif _SENTENCE_END.search(last):
            found.append(SENTENCE)
        else:
            found.append(CLAUSE if _CLAUSE_END.search(last) else WORD)
    return spans, found


def split_text(text: str, max_words: int, overlap_words: int) -> list[Piece]:
    """Pieces of at most ``max_words`` words, each after the first beginning with the ``overlap_words`` words before it.

    An overlap of half the limit or more is lowered to just under half, so that pieces always advance. A text within the
    limit is one piece; an empty one gives none. Equal boundaries merge the smaller pair first, then the earlier one.
    """
    spans, cut = strengths(text)
    n = len(spans)
    if not n:
        return []
    overlap = max(0, min(overlap_words, (max_words - 1) // 2))
    if n <= max_words:
        return [Piece(0, len(text), n, 0, BOUNDARY_NAMES[SECTION])]
    # Atomic segments: at every boundary stronger than between two words, and at each word of a longer stretch.
    room = max(1, max_words - overlap)
    starts = [0]
    for i in range(1, n):
        if cut[i] > WORD:
            starts.append(i)
    bounds, atoms = [*starts, n], []
    for a, b in zip(bounds, bounds[1:]):
        atoms.extend([a] if b - a <= room else range(a, b))
    ends = dict(zip(atoms, [*atoms[1:], n]))
    before = dict(zip(atoms[1:], atoms))
    heap = [(cut[b], ends[b] - a, a, b, ends[b]) for a, b in zip(atoms, atoms[1:])]
    heapq.heapify(heap)
    while heap:
        _, size, a, b, e = heapq.heappop(heap)
        if ends.get(a) != b or ends.get(b) != e or size + (overlap if a else 0) > max_words:
            continue
        ends[a] = e
        del ends[b]
        before.pop(b, None)
        if e < n:
            before[e] = a
            heapq.heappush(heap, (cut[e], ends[e] - a, a, e, ends[e]))
        if a:
            p = before[a]
            heapq.heappush(heap, (cut[a], e - p, p, a, e))
    out = []
    for a in sorted(ends):
        first = max(0, a - overlap)
        out.append(Piece(spans[first][0] if first else 0, spans[ends[a] - 1][1] if ends[a] < n else len(text), ends[a] - first, a - first, BOUNDARY_NAMES[cut[a]]))
    return out


def split_oversized(chunks: DataFrame, limits: DataFrame, text_col: str = "content", table_type: str = "table") -> DataFrame:
    """Pieces of every chunk: chunk_id, piece_no, content, section_hierarchy, chunk_type, token_count, overlap_tokens, boundary, oversized.

    ``limits`` has limit_name, max_tokens and overlap_tokens with the names chunk_text and chunk_table. A chunk of type
    table in any spelling gets the table limit; any other type and null get the text limit. The size is estimated from the
    content, whatever the recorded token_count says. Null and empty contents give one piece of size 0. Chunks that occur
    twice are cut twice. Columns not named here are ignored.
    """
    rows = {r["limit_name"]: (r["max_tokens"], r["overlap_tokens"]) for r in limits.where("limit_name in ('chunk_text', 'chunk_table')").limit(100).collect()}
    text_limit, table_limit = rows["chunk_text"], rows["chunk_table"]
    is_table = F.coalesce(F.lower(F.trim("chunk_type")) == table_type, F.lit(False))
    sized = chunks.select(
        "chunk_id", F.coalesce(F.col(text_col), F.lit("")).alias("content"), "section_hierarchy", "chunk_type",
        F.when(is_table, F.lit(table_limit[0])).otherwise(F.lit(text_limit[0])).alias("max_tokens"),
        F.when(is_table, F.lit(table_limit[1])).otherwise(F.lit(text_limit[1])).alias("overlap"),
    ).withColumn("size", estimated_tokens(F.col("content")))
    schema = "chunk_id string, piece_no int, content string, section_hierarchy array<string>, chunk_type string, token_count int, overlap_tokens int, boundary string, oversized boolean"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                pieces = split_text(r.content, words_within(int(r.max_tokens)), words_within(int(r.overlap)))
                out += [(r.chunk_id, k, r.content[p.start : p.end], r.section_hierarchy, r.chunk_type, int(p.words / WORDS_PER_TOKEN), int(p.overlap_words / WORDS_PER_TOKEN), p.boundary, True) for k, p in enumerate(pieces, 1)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    whole = sized.where("size <= max_tokens").select("chunk_id", F.lit(1).alias("piece_no"), "content", "section_hierarchy", "chunk_type", F.col("size").alias("token_count"), F.lit(0).alias("overlap_tokens"), F.lit(BOUNDARY_NAMES[SECTION]).alias("boundary"), F.lit(False).alias("oversized"))
    return whole.unionByName(sized.where("size > max_tokens").drop("size").mapInPandas(cut, schema))
