"""Pages, texts and records to chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import PAGE_HEADER, approx_tokens, field_group, humanize_field, section_level, strip, strip_noise, temporal_markers

#: Token cap of a chunk, shortest section kept, similarity of sections that merge.
MAX_TOKENS, SHORTEST, MERGE = 1200, 40, 0.85
#: Records that one task batches at a time; a new batch starts at each such block of one source.
BLOCK_ROWS = 100_000
#: What counts as empty in records, and audit columns.
EMPTY = ("", "nan", "none", "null", "false", "0", "0.0", "0.00", "1900-01-01", "1900-01-01t00:00:00.000z")
AUDIT = ("bi_created_dt", "bi_created_by", "bi_modified_dt", "bi_modified_by")
GROUP_ORDER = ("Identity", "Date", "Coverage", "Financial", "Location", "Status", "Other")


def split_sections(pages: DataFrame, header: str = PAGE_HEADER) -> DataFrame:
    """(source, section_no, content, section_hierarchy, pages, temporal_markers) from (source, page, text).

    A header line starts a section and belongs to it; a major header clears the minor one. Sections of SHORTEST
    characters or fewer are left out. Null texts have no lines. Each source is one document, ordered by page and line.
    """
    lines = pages.select("source", "page", F.posexplode(F.split(strip_noise(F.col("text"), header), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("level", section_level(F.col("line")))
    order = W.partitionBy("source").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section_no", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(order)).withColumn("major_no", F.sum(F.when(F.col("level") == "major", 1).otherwise(0)).over(order))
    heads = W.partitionBy("source", "major_no").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    label = strip(F.col("line"))
    lines = lines.withColumn("major", F.last(F.when(F.col("level") == "major", label), True).over(order)).withColumn("minor", F.last(F.when(F.col("level") == "sub", label), True).over(heads))
    rows = lines.groupBy("source", "section_no").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))).alias("l"), F.first("major", True).alias("major"), F.first("minor", True).alias("minor"))
    text = strip_noise(F.array_join(F.col("l.line"), "\n"), header)
    rows = rows.select("source", "section_no", text.alias("content"), F.filter(F.array("major", "minor"), lambda h: h.isNotNull()).alias("section_hierarchy"), F.array_distinct(F.col("l.page")).alias("pages"))
    return rows.where(F.length("content") > SHORTEST).withColumn("temporal_markers", temporal_markers(F.col("content")))


def paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines, or lines if there is no more than one paragraph."""

    def parts(sep: str) -> Column:
        return F.filter(F.transform(F.split(c, sep), strip), lambda p: p != "")

    return F.when(F.size(parts("\n\n")) > 1, parts("\n\n")).otherwise(parts("\n"))


def greedy(items: Column, cap: int, head: int | Column = 0) -> Column:
    """Batches of strings: a new one starts if the next string would exceed ``cap`` tokens and the batch is not empty."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(head).cast("int").alias("tok") if isinstance(head, int) else head.cast("int").alias("tok"))

    def step(acc: Column, x: Column) -> Column:
        t = approx_tokens(x)
        full = (acc["tok"] + t > cap) & (F.size(acc["cur"]) > 0)
        first = F.lit(head).cast("int") if isinstance(head, int) else head.cast("int")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(acc["cur"], F.array(x))).alias("cur"),
            F.when(full, first + t).otherwise(acc["tok"] + t).cast("int").alias("tok"),
        )

    return F.aggregate(items, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def sub_chunk(sections: DataFrame, cap: int = MAX_TOKENS) -> DataFrame:
    """Sections over ``cap`` cut at paragraphs, the first repeated in each part and "part N" added to the hierarchy.

    Sections within the cap or of a single paragraph stay as they are. A null content stays one row.
    """
    s = sections.withColumn("_p", paragraphs(F.col("content"))).withColumn("_cut", F.coalesce((approx_tokens(F.col("content")) > cap) & (F.size("_p") > 1), F.lit(False)))
    whole = s.where("not _cut").drop("_p", "_cut")
    head = F.col("_p")[0]
    parts = s.where("_cut").withColumn("_b", greedy(F.slice("_p", F.lit(2), F.size("_p")), cap, approx_tokens(head))).select("*", F.posexplode("_b").alias("_n", "_part"))
    label = F.concat(F.lit("part "), (F.col("_n") + 1).cast("string"))
    parts = parts.withColumn("content", F.array_join(F.concat(F.array(head), F.col("_part")), "\n\n")).withColumn("section_hierarchy", F.concat(F.coalesce("section_hierarchy", F.array().cast("array<string>")), F.array(label)))
    return whole.unionByName(parts.select(whole.columns))


def text_chunks(texts: DataFrame, cap: int = MAX_TOKENS) -> DataFrame:
    """(source, chunk_id, content, token_count) of whole texts (source, text); leading Source:, Title:, Retrieved: lines go."""
    body = strip(F.regexp_replace(strip(F.col("text")), r"^(?:(?:Source:|Title:|Retrieved:)[^\n]*(?:\n|$))+", ""))
    rows = texts.select("source", F.posexplode(greedy(paragraphs(body), cap)).alias("chunk_id", "b"))
    return rows.select("source", "chunk_id", F.array_join("b", "\n\n").alias("content")).withColumn("token_count", approx_tokens(F.col("content")))


def batch_records(records: DataFrame, title: str, cap: int = MAX_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, chunk_id, content, section_hierarchy) from formatted records (source, seq, formatted), seq from 0 without gaps.

    A batch starts where the next record would exceed the cap. Blocks of ``block_rows`` records are batched apart, so one
    large source is not one task. Chunk ids rise within a source from 1, which leaves 0 to the schema chunk; between blocks they
    may skip numbers.
    """
    schema = "source string, block long, no int, first long, last long, content string"

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        out, cur, tok, first = [], [], 0, 0
        for seq, text in zip(rows["seq"], rows["formatted"]):
            t = int(len(text.split()) / 0.75)
            if cur and tok + t > cap:
                out.append((first, seq - 1, cur))
                cur, tok = [], 0
            if not cur:
                first = seq
            cur.append(text)
            tok += t
        if cur:
            out.append((first, int(rows["seq"].iloc[-1]), cur))
        return pd.DataFrame([(rows["source"].iloc[0], rows["block"].iloc[0], i, a, b, "\n\n".join(c)) for i, (a, b, c) in enumerate(out)], columns=["source", "block", "no", "first", "last", "content"])

    kept = records.where("formatted is not null and formatted <> ''").select("source", "seq", "formatted").withColumn("block", F.floor(F.col("seq") / block_rows))
    done = kept.groupBy("source", "block").applyInPandas(batch, schema)
    done = done.withColumn("chunk_id", F.col("block") * block_rows + F.col("no") + 1)
    label = F.concat(F.lit("records "), F.col("first").cast("string"), F.lit("–"), F.col("last").cast("string"))
    return done.select("source", "chunk_id", F.concat(F.lit(f"DATASET: {title}\n"), F.col("content")).alias("content"), F.array(F.col("source"), label).alias("section_hierarchy"))


def format_records(rows: DataFrame, source: str, seq: str, fields: list[str], expansions: dict[str, str] | None = None) -> DataFrame:
    """(source, seq, formatted): each row as a RECORD block with its fields in groups; empty values and audit columns go."""
    lines, spark = [], rows.sparkSession
    named = spark.createDataFrame([(f,) for f in fields], "f string")
    of = {r["f"]: r["g"] for r in named.select("f", field_group(F.col("f")).alias("g")).collect()}
    for g in GROUP_ORDER:
        pairs = []
        for f in fields:
            if f.lower() not in AUDIT and of[f] == g:
                v = strip(F.coalesce(F.col(f).cast("string"), F.lit("")))
                pairs.append(F.when(~F.lower(v).isin(*EMPTY), F.concat(humanize_field(F.lit(f), expansions), F.lit(": "), v)))
        joined = F.concat_ws(" | ", *pairs) if pairs else F.lit("")
        lines.append(F.when(joined != "", F.concat(F.lit(f"  [{g}] "), joined)))
    body = F.concat_ws("\n", *lines)
    return rows.select(F.lit(source).alias("source"), F.col(seq).alias("seq"), F.when(body == "", "").otherwise(F.concat(F.lit("RECORD:\n"), body)).alias("formatted"))


def schema_chunk(fields: DataFrame, dataset: str) -> DataFrame:
    """One row (content): the fields (name) of a dataset listed by group, in order of pos."""
    kept = fields.where(~F.lower("name").isin(*AUDIT)).select("pos", field_group(F.col("name")).alias("g"), humanize_field(F.col("name")).alias("h"))
    groups = kept.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), ", ").alias("names"))
    order = F.array_position(F.array(*map(F.lit, GROUP_ORDER)), F.col("g"))
    lines = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(F.lit("  ["), "g", F.lit("] "), "names").alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    total = fields.agg(F.count(F.lit(1)).alias("n"))
    return lines.crossJoin(F.broadcast(total)).select(F.concat(F.lit(f"DATASET SCHEMA: {dataset}\nTotal fields: "), F.col("n").cast("string"), F.lit("\n"), F.col("lines")).alias("content"))


def sliding_windows(texts: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(source, window_no, content) of ``size`` white-space tokens, each beginning with the last ``overlap`` of the one before."""
    step = size - overlap
    t = texts.select("source", F.filter(F.split("text", r"[\s\p{Z}]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(step))).cast("int")
    return t.select("source", "w", F.explode(F.sequence(F.lit(0), last)).alias("window_no")).select("source", "window_no", F.array_join(F.slice("w", F.col("window_no") * step + 1, F.lit(size)), " ").alias("content"))


def semantic_merge(sections: DataFrame, threshold: float = MERGE, cap: int = MAX_TOKENS) -> DataFrame:
    """(source, chunk_no, content, merged_from, section_hierarchy) from (source, seq, content, section_hierarchy, vector).

    Sections of a source are read in order of seq and join the group while their cosine with the group's first one is at
    least ``threshold`` and the joined text stays within ``cap`` tokens. The longer hierarchy is kept. Vectors must have
    length one; a null vector never joins.
    """
    schema = "source string, chunk_no int, content string, merged_from array<long>, section_hierarchy array<string>"

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        anchor = None
        for r in rows.sort_values("seq").itertuples():
            h = list(r.section_hierarchy) if r.section_hierarchy is not None else []
            text = r.content or ""
            if out and anchor is not None and r.vector is not None and float(anchor @ r.vector) >= threshold:
                joined = out[-1][0] + "\n\n" + text
                if int(len(joined.split()) / 0.75) <= cap:
                    out[-1][0] = joined
                    out[-1][1].append(int(r.seq))
                    if len(h) > len(out[-1][2]):
                        out[-1][2] = h
                    continue
            out.append([text, [int(r.seq)], h])
            anchor = r.vector
        return pd.DataFrame([(rows["source"].iloc[0], i, *o) for i, o in enumerate(out)], columns=[x.split()[0] for x in schema.split(", ")])

    return sections.select("source", "seq", "content", "section_hierarchy", "vector").groupBy("source").applyInPandas(merge, schema)


#: Keyword groups by which chunks are sampled for a vocabulary.
SAMPLE_GROUPS = (
    ("coverage", "insure", "covered", "protect"),
    ("exclusion", "not covered", "does not", "except", "we do not"),
    ("definition", "means", "defined as", "the term"),
    ("claim", "loss", "notify", "report", "file", "proof"),
    ("condition", "requirement", "must", "shall", "obligation"),
    ("limit", "maximum", "deductible", "amount", "dollar"),
    ("period", "effective", "expir", "cancel", "renew", "waiting"),
    ("premium", "payment", "cost", "rate", "fee"),
)


def stratified_samples(chunks: DataFrame, n: int = 8, width: int = 800) -> DataFrame:
    """(slot, seq, excerpt) of at most ``n`` chunks (seq, content): per keyword group the first chunk not yet taken.

    The first ``n`` candidates of each group suffice for that, so no more than groups x n rows reach the driver.
    """
    spark, text = chunks.sparkSession, F.lower("content")
    hits = chunks.select("seq", F.posexplode(F.array(*[F.array_max(F.transform(F.array(*map(F.lit, g)), lambda k: text.contains(k))) for g in SAMPLE_GROUPS])).alias("g", "hit")).where("hit")
    best = hits.groupBy("g", "seq").count().withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("seq"))).where(F.col("r") <= n)
    taken: list[int] = []
    by_group: dict[int, list[int]] = {}
    for r in best.orderBy("g", "r").collect():
        by_group.setdefault(r["g"], []).append(r["seq"])
    for g in range(len(SAMPLE_GROUPS)):
        new = next((s for s in by_group.get(g, []) if s not in taken), None)
        if new is not None and len(taken) < n:
            taken.append(new)
    slots = spark.createDataFrame(list(enumerate(taken)), "slot int, seq long")
    return chunks.join(F.broadcast(slots), "seq").select("slot", "seq", F.substring("content", 1, width).alias("excerpt"))
