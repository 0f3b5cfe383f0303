"""Steps of class induction that ask a language model, each as prompts, kept answers, and a plain plan over them.

Prompts are numbered in order of their rows, so the same input always asks the same questions. Vocabularies of classes and
relations are small and checked; entities are asked about in batches on the workers.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..models import LLMClient, ask
from ..session import bounded_rows
from .extraction import parse_arrow_map, parse_json_list

#: Entities in a prompt, entities in an arbitration prompt, headers in a prompt, examples of corrections.
BATCH, ARBITRATE, HEADERS, EXAMPLES = 15, 10, 50, 5
#: Share and size from which a class is split, share of Other from which it is looked at again.
MEGA_SHARE, MEGA_SIZE, OTHER_SHARE = 0.40, 50, 0.05
#: Names that a vocabulary may have.
MAX_NAMES = 5000
MAPPING = "map<string,string>"


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _arrows(answers: pd.Series) -> pd.Series:
    return pd.Series([parse_arrow_map(a) for a in answers])


def batches(rows: DataFrame, key: str, size: int, *by: str) -> DataFrame:
    """``rows`` with ``batch`` of ``size`` rows in a hash order of ``key``, within ``by``, and their number ``no`` in it.

    Numbering is per hash bucket, not over all rows, so no task sees more than a bucket.
    """
    buckets = max(1, rows.count() // 20_000 + 1)
    b = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    b = b.withColumn("_n", F.row_number().over(W.partitionBy("_b", *by).orderBy(key)) - 1)
    n = F.floor(F.col("_n") / size)
    return b.withColumn("batch", F.concat_ws("/", *[F.col(c).cast("string") for c in by], F.col("_b").cast("string"), n.cast("string"))).withColumn("no", (F.col("_n") % size + 1).cast("string")).drop("_b", "_n")


def ask_per_item(items: DataFrame, client: LLMClient, task: str, size: int = BATCH, detail: str | None = None, replay: DataFrame | None = None) -> DataFrame:
    """(item, answer) of items (item, and the column ``detail``), asked ``size`` at a time.

    Each item is a numbered line, line breaks in it as blanks; a line "number -> answer" or "item -> answer" comes back.
    """
    line = F.concat("item", F.lit(" : "), F.coalesce(detail, F.lit(""))) if detail else F.col("item")
    b = batches(items.select("item", line.alias("line")).where("item is not null").dropDuplicates(["item"]), "item", size)
    b = b.withColumn("line", F.concat("no", F.lit(". "), F.regexp_replace("line", r"[\r\n]+", " ")))
    prompts = b.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("no").cast("int").alias("no"), "line"))), lambda x: x["line"]), "\n").alias("lines"))
    said = ask(prompts.select(F.col("batch").alias("key"), F.concat(F.lit(task + "\nAnswer with a line \"number -> answer\" for each.\n"), "lines").alias("prompt")), client, replay)
    pairs = said.select(F.col("key").alias("batch"), F.explode(_arrows("answer")).alias("name", "answer"))
    return pairs.join(b.select("batch", "no", "item"), "batch").where((F.col("name") == F.col("no")) | (F.col("name") == F.col("item"))).select("item", "answer").dropDuplicates(["item"])


def propose_classes(support: DataFrame, client: LLMClient, evidence: str = "", forbidden: tuple[str, ...] = ("Other", "Entity", "Thing", "Value"), least: int = 10, fallback: tuple[str, ...] = ("Policy", "Claim", "Coverage", "Property", "Person", "Organization")) -> list[str]:
    """Class names from a model, without forbidden and repeated ones, with the types of ``support`` (name, n) of ``least`` members."""
    rows = bounded_rows(support.where(F.col("n") >= least).select("name", "n"), MAX_NAMES, "types")
    frequent = [r["name"] for r in sorted(rows, key=lambda r: (-r["n"], r["name"])) if r["name"]]
    answer = client.answer(f"Propose 8 to 15 classes for these entity types as a JSON array.\n{evidence}\nTypes: {', '.join(frequent)}")
    found: dict[str, str] = {}
    banned = {f.lower() for f in forbidden}
    for name in [*(x for x in parse_json_list(answer) if isinstance(x, str)), *frequent]:
        if name.strip() and name.strip().lower() not in banned:
            found.setdefault(name.strip().lower(), name.strip())
    return list(found.values()) if len(found) >= 3 else list(fallback)


def type_entities(entities: DataFrame, vocabulary: list[str], client: LLMClient, corrections: list[tuple[str, str]] = (), replay: DataFrame | None = None) -> DataFrame:
    """(entity_id, class): records by their type if it is a class, values as Other, concepts by the model, unknown answers as Other."""
    known = F.create_map(*[x for v in vocabulary for x in (F.lit(v.lower()), F.lit(v))]) if vocabulary else F.create_map().cast(MAPPING)
    shown = "".join(f"\n{a} -> {b}" for a, b in list(corrections)[:EXAMPLES])
    said = ask_per_item(entities.where("lane = 'concept'").select(F.col("id").alias("item"), "entity_type"), client, f"Give each entity one of these classes: {', '.join(vocabulary)}." + (f"\nCorrect examples:{shown}" if shown else ""), BATCH, "entity_type", replay)
    rows = entities.join(said.select(F.col("item").alias("id"), "answer"), "id", "left")
    cls = F.when(F.col("lane") == "record", F.element_at(known, F.lower("entity_type"))).when(F.col("lane") == "concept", F.element_at(known, F.lower(F.trim("answer"))))
    return rows.select(F.col("id").alias("entity_id"), F.coalesce(cls, F.lit("Other")).alias("class"))


def rebalance(assignments: DataFrame, client: LLMClient, replay: DataFrame | None = None) -> DataFrame:
    """Assignments whose classes of more than MEGA_SHARE of all and MEGA_SIZE members are split by the model's sub-classes."""
    sizes = assignments.where("class <> 'Other'").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mega = [r["class"] for r in sizes.where((F.col("n") > MEGA_SHARE * total) & (F.col("n") >= MEGA_SIZE)).collect()]  # at most 1/MEGA_SHARE
    out = assignments
    for name in sorted(mega):
        parts = [x for x in parse_json_list(client.answer(f"Split the class {name} into sub-classes as a JSON array.")) if isinstance(x, str)]
        if len(parts) >= 2:
            said = ask_per_item(out.where(F.col("class") == name).select(F.col("entity_id").alias("item")), client, f"Give each entity one of these classes: {', '.join(parts)}.", replay=replay)
            new = said.where(F.col("answer").isin(*parts)).select(F.col("item").alias("entity_id"), F.col("answer").alias("_n"))
            out = out.join(new, "entity_id", "left").withColumn("class", F.coalesce("_n", "class")).drop("_n")
    return out


def rescue_other(assignments: DataFrame, concepts: DataFrame, client: LLMClient, examples: int = 3, replay: DataFrame | None = None, least: float = OTHER_SHARE) -> DataFrame:
    """Assignments with concepts of Other asked for again, with members of each class as examples, if Other exceeds ``least``."""
    c = assignments.join(concepts.select("entity_id"), "entity_id", "left_semi")
    n = c.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("class") == "Other", 1)).alias("o")).first()
    if not n["n"] or n["o"] <= least * n["n"]:
        return assignments
    ranked = c.where("class <> 'Other'").withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("entity_id"))).where(F.col("r") <= examples)
    shown: dict[str, list[str]] = {}
    for r in bounded_rows(ranked.select("class", "entity_id"), MAX_NAMES * examples, "examples"):
        shown.setdefault(r["class"], []).append(r["entity_id"])
    said = ask_per_item(c.where("class = 'Other'").select(F.col("entity_id").alias("item")), client, "Give each entity one of these classes:\n" + "\n".join(f"{k}: {', '.join(v)}" for k, v in sorted(shown.items())), replay=replay)
    new = said.where(F.col("answer").isin(*sorted(shown))).select(F.col("item").alias("entity_id"), F.col("answer").alias("_n")) if shown else said.limit(0).select(F.col("item").alias("entity_id"), F.col("answer").alias("_n"))
    return assignments.join(new, "entity_id", "left").withColumn("class", F.coalesce("_n", "class")).drop("_n")


def arbitrate(flagged: DataFrame, client: LLMClient, replay: DataFrame | None = None) -> DataFrame:
    """(entity_id, class): the model's choice between a flagged entity's class and its nearest one; another answer keeps its class."""
    items = flagged.select(F.col("entity_id").alias("item"), F.concat("class", F.lit(" or "), F.coalesce("nearest_class", F.lit("Other"))).alias("choice"))
    said = ask_per_item(items, client, "Decide between the two classes of each entity.", ARBITRATE, "choice", replay)
    rows = flagged.join(said.select(F.col("item").alias("entity_id"), F.trim("answer").alias("a")), "entity_id", "left")
    return rows.select("entity_id", F.when(F.col("a").isin("Other") | (F.col("a") == F.col("class")) | (F.col("a") == F.col("nearest_class")), F.col("a")).otherwise(F.col("class")).alias("class"))


def record_type_classes(types: DataFrame, vocabulary: list[str], client: LLMClient) -> DataFrame:
    """(entity_type, class) of record types: by name, with or without "Record", by the model, by a part of the name, else Other."""
    rows = bounded_rows(types.select("entity_type").where("entity_type is not null").distinct(), MAX_NAMES, "record types")
    by, out = {v.lower(): v for v in vocabulary}, []
    for name in sorted(r["entity_type"] for r in rows):
        low = name.lower().removesuffix("record")
        said = by.get(low) or by.get(name.lower()) or by.get(client.answer(f"Class of the record type {name} among {', '.join(vocabulary)}").strip().lower())
        out.append((name, said or next((v for k, v in sorted(by.items()) if low and (low in k or k in low)), "Other")))
    return types.sparkSession.createDataFrame(out, "entity_type string, class string")


def class_relations(similarity: DataFrame, client: LLMClient, least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """((class, merged_into), (child, parent)) from pairs of class names (a, b, sim) above ``least``, judged by the model.

    It answers equivalent, parent (a above b), child (a below b), related or unrelated; equivalent classes take the first name.
    """
    pairs = sorted(bounded_rows(similarity.where((F.col("sim") > least) & (F.col("a") < F.col("b"))).select("a", "b"), MAX_NAMES, "class pairs"))
    into: dict[str, str] = {}
    tree = []

    def root(x: str) -> str:
        while x in into:
            x = into[x]
        return x

    for r in pairs:
        said = client.answer(f"Relation of the classes {r['a']} and {r['b']}: equivalent, parent, child, related or unrelated?").strip().lower()
        a, b = root(r["a"]), root(r["b"])
        if said.startswith("equivalent") and a != b:
            into[max(a, b)] = min(a, b)
        elif said.startswith("parent"):
            tree.append((r["b"], r["a"]))
        elif said.startswith("child"):
            tree.append((r["a"], r["b"]))
    spark = similarity.sparkSession
    return spark.createDataFrame([(k, root(k)) for k in sorted(into)], "class string, merged_into string"), spark.createDataFrame(sorted({(root(c), root(p)) for c, p in tree if root(c) != root(p)}), "child string, parent string")


def leaf_merges(profiles: DataFrame, client: LLMClient) -> DataFrame:
    """(class, parent) of classes to merge into their parent, from (class, parent, members, leaf_share, relations, records).

    A class goes if the model says merge, or if it has under 50 members, over 70 % leaves and under four relations; one with
    over 100 members, or backed by records, stays.
    """
    out = []
    for r in sorted(bounded_rows(profiles.select("class", "parent", "members", "leaf_share", "relations", "records"), MAX_NAMES, "classes"), key=lambda r: r["class"]):
        if r["parent"] and r["members"] <= 100 and not r["records"]:
            weak = r["members"] < 50 and r["leaf_share"] > 0.7 and r["relations"] < 4
            if weak or client.answer(f"Keep or merge the class {r['class']} into {r['parent']}?").strip().lower().startswith("merge"):
                out.append((r["class"], r["parent"]))
    return profiles.sparkSession.createDataFrame(out, "class string, parent string")


def pairwise_taxonomy(classes: DataFrame, client: LLMClient) -> DataFrame:
    """(child, parent) where the model says that a class (class, n) is a kind of another; the smaller class is asked about first."""
    rows = sorted(bounded_rows(classes.select("class", "n"), 200, "classes"), key=lambda r: (r["n"], r["class"]))
    out = [(a["class"], b["class"]) for a in rows for b in rows if a["class"] != b["class"] and client.answer(f"Is every {a['class']} a {b['class']}? yes or no").strip().lower().startswith("y")]
    return classes.sparkSession.createDataFrame(out, "child string, parent string")


def name_clusters(members: DataFrame, client: LLMClient, examples: int = 10, replay: DataFrame | None = None) -> DataFrame:
    """(cluster, name) from (cluster, member): the model's name for the first members; repeated names get a number."""
    few = members.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("member"))).where(F.col("r") <= examples).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("member")), ", ").alias("m"))
    said = ask(few.select(F.col("cluster").alias("key"), F.concat(F.lit("Name the class of: "), "m").alias("prompt")), client, replay).select(F.col("key").alias("cluster"), F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit("Cluster")).alias("name"))
    k = F.row_number().over(W.partitionBy("name").orderBy("cluster"))
    return said.withColumn("k", k).select("cluster", F.when(F.col("k") > 1, F.concat("name", F.col("k").cast("string"))).otherwise(F.col("name")).alias("name"))


def expand_headers(headers: DataFrame, client: LLMClient, replay: DataFrame | None = None) -> DataFrame:
    """(header, name): the model's words for short upper-case headers of letters, HEADERS at a time; others keep their own."""
    short = headers.select(F.col("header").alias("item")).distinct().where(F.col("item").rlike(r"^[A-Z]{1,12}\z"))
    said = ask_per_item(short, client, "Write out these column names.", HEADERS, replay=replay)
    return headers.select("header").distinct().join(said.select(F.col("item").alias("header"), "answer"), "header", "left").select("header", F.coalesce("answer", "header").alias("name"))


def canonical_relations(triples: DataFrame, vocabulary: list[str], client: LLMClient) -> DataFrame:
    """(relation, canonical) of relations outside structured triples that the model maps to a word of the vocabulary."""
    names = triples.where("source_type is null or source_type <> 'structured'").select(F.col("relation").alias("item")).distinct()
    said = ask_per_item(names, client, f"Map each relation to one of: {', '.join(vocabulary)}.", HEADERS)
    return said.where(F.col("answer").isin(*vocabulary) & (F.col("item") != F.col("answer"))).select(F.col("item").alias("relation"), F.col("answer").alias("canonical")) if vocabulary else said.limit(0).select(F.col("item").alias("relation"), F.col("answer").alias("canonical"))


def question_sql(question: str, schema: str, client: LLMClient) -> str | None:
    """The statement that a model writes for a question over the views, without its code fence; None if it cannot."""
    answer = client.answer(f"Write one Spark SQL SELECT for the question, or UNANSWERABLE.\nViews:\n{schema}\nQuestion: {question}").strip()
    lines = [x for x in answer.splitlines() if not x.strip().startswith("```")]
    text = "\n".join(lines).strip()
    return None if not text or "UNANSWERABLE" in text.upper() else text


def answer_question(spark: SparkSession, question: str, schema: str, client: LLMClient, limit: int = 200, shown: int = 20) -> dict:
    """sql, rows, text and chart for a question over the views: a statement by the model, read-only and limited, and its words.

    sql is None where the model cannot answer; error holds why a statement did not run. chart is bar for a name and a number,
    line where the name is a date, number for one value, else table.
    """
    from ..sources.writers import answer

    sql = question_sql(question, schema, client)
    out = {"question": question, "sql": sql, "rows": None, "text": "", "chart": None, "error": None}
    if sql is None:
        return out
    try:
        rows = answer(spark, sql, limit)
        first = [r.asDict() for r in rows.limit(shown).collect()]
    except (ValueError, AnalysisException) as e:
        return {**out, "error": str(e).split("\n")[0]}
    numbers = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
    others = [f for f in rows.schema.fields if f.name not in numbers]
    kind = "number" if len(first) == 1 and len(numbers) == 1 and not others else "table"
    if len(numbers) == 1 and len(others) == 1 and len(first) > 1:
        kind = "line" if isinstance(others[0].dataType, (T.DateType, T.TimestampType)) else "bar"
    text = client.answer("Say in one sentence what these rows answer.\nQuestion: " + question + "\nRows: " + json.dumps(first, default=str))
    return {**out, "rows": rows, "text": text.strip(), "chart": {"kind": kind, "x": others[0].name if others else None, "y": numbers[0] if numbers else None}}
