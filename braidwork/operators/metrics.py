"""Quality of graphs, classes and ontologies, with and without a reference."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import strip
from ..models import Embedder, LLMClient, ask, embed_column
from ..session import LOOKUP_ROWS, bounded_rows, materialize
from .extraction import prompt_parts

#: Similarity from which names match, from which depths are compared, and from which members count fully or half.
MATCH, DEPTH_MATCH, FULL, HALF = 0.436, 0.3, 0.58, 0.42
#: Cosine from which a fact is found, and characters that a fact has more than.
FACT_MATCH, FACT_CHARS = 0.65, 15
#: Fixed value: similarity from which a model is asked if two names are one class.
CANDIDATE = 0.60
#: Names of classes that the driver may hold for an optimal matching.
MAX_NAMES = 5000
#: Slices of one unit of a score.
SLICES = 5000


def duplication(ids: DataFrame) -> DataFrame:
    """One row: duplicate_groups, total_duplicated_nodes, excess_nodes of ids that are equal but for case and outer blanks."""
    groups = ids.where("id is not null").groupBy(F.lower(F.trim("id")).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_duplicated_nodes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_nodes"))


def type_consistency(labels: DataFrame) -> DataFrame:
    """(root, labels): distinct labels by their first word; more than one label of a root is a sign of inconsistency."""
    word = F.lower(F.split(F.regexp_replace(F.regexp_replace("label", "([a-z])([A-Z])", "$1 $2"), "^[_ ]+", ""), "[_ ]")[0])
    return labels.select("label").where("label is not null").distinct().groupBy(word.alias("root")).agg(F.count(F.lit(1)).alias("labels"))


def vocabulary_coverage(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: terms, covered, coverage: vocabulary words that are part of some id.

    Words are looked up among the ids' own words first, which is an equality join; only the rest are searched inside words,
    over the distinct words of all ids in blocks by shared three letters.
    """
    t = terms.select(F.lower("word").alias("word")).distinct()
    words = ids.select(F.explode(F.split(F.lower("id"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    whole = t.join(words.select(F.col("w").alias("word")), "word", "left_semi")
    grams = words.where("length(w) > 3").select("w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substr("w", i, F.lit(3))))).alias("g"))
    inside = t.join(whole, "word", "left_anti").withColumn("g", F.substring("word", 1, 3)).join(grams, "g").where(F.col("w").contains(F.col("word"))).select("word").distinct()
    covered = whole.union(inside).distinct().agg(F.count(F.lit(1)).alias("covered"))
    return t.agg(F.count(F.lit(1)).alias("terms")).crossJoin(covered).withColumn("coverage", F.coalesce(F.try_divide("covered", "terms"), F.lit(0.0)))


def judged_precision(verdicts: DataFrame) -> DataFrame:
    """One row: correct, incorrect, uncertain, precision = correct / (correct + incorrect)."""
    v = F.upper(F.trim("verdict"))
    out = verdicts.agg(F.count(F.when(v == "CORRECT", 1)).alias("correct"), F.count(F.when(v == "INCORRECT", 1)).alias("incorrect"), F.count(F.when(v == "UNCERTAIN", 1)).alias("uncertain"))
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("correct"), F.col("correct") + F.col("incorrect")), F.lit(0.0)))


def grounding_score(verdicts: DataFrame) -> DataFrame:
    """One row: supported, partial, rejected, score. NOT_SUPPORTED is tested before the word it contains."""
    v = F.upper(F.regexp_replace("verdict", r"[\s_]+", "_"))
    no, part, yes = v.contains("NOT_SUPPORTED"), v.contains("PARTIAL"), v.contains("SUPPORTED")
    out = verdicts.agg(F.count(F.when(~no & ~part & yes, 1)).alias("supported"), F.count(F.when(~no & part, 1)).alias("partial"), F.count(F.when(no, 1)).alias("rejected"), F.count("verdict").alias("n"))
    return out.select("supported", "partial", "rejected", F.coalesce(F.try_divide(F.col("supported") + 0.5 * F.col("partial"), F.col("n")), F.lit(0.0)).alias("score"))


def chunk_facts(chunks: DataFrame, client: LLMClient, form: str = "sentence", replay: DataFrame | None = None) -> DataFrame:
    """(chunk_id, fact) that a model lists for chunks (chunk_id, source, content), long ones asked about in parts.

    ``form``: sentence, a line of more than FACT_CHARS characters without its bullet or number, or triple, a line
    "subject | relation | object" with three parts.
    """
    task = {"sentence": "List the facts in the text, one short sentence a line.\nTEXT:", "triple": "List the facts in the text, one a line, as subject | relation | object.\nTEXT:"}[form]
    prompts = prompt_parts(chunks).select(F.struct("chunk_id", "part").alias("key"), F.concat(F.lit(task), "content").alias("prompt"))
    lines = ask(prompts, client, replay).select("key.chunk_id", F.explode(F.split("answer", "\n")).alias("line"))
    if form == "sentence":
        return lines.select("chunk_id", F.regexp_replace(F.trim("line"), r"^[0-9.\-) •]+", "").alias("fact")).where(F.length("fact") > FACT_CHARS)
    return triple_facts(lines)


def triple_facts(lines: DataFrame) -> DataFrame:
    """(chunk_id, fact, subject, object) of lines (chunk_id, line) with three parts between bars, none blank."""
    parts = F.transform(F.split("line", r"\|"), strip)
    return lines.withColumn("p", parts).where((F.size("p") == 3) & F.forall("p", lambda x: x != "")).select("chunk_id", F.col("line").alias("fact"), F.col("p")[0].alias("subject"), F.col("p")[2].alias("object"))


def linearized(triples: DataFrame) -> DataFrame:
    """(text) of triples as sentences; record ids stand as the name of their type."""

    def shown(c: str, kind: str) -> Column:
        name = F.lower(F.regexp_replace(F.coalesce(kind, F.lit("record")), "Record$", ""))
        return F.when(F.col(c).rlike(r"^[A-Z]+-[0-9a-f]{8,}"), name).otherwise(F.col(c))

    return triples.select(F.concat_ws(" ", shown("subject", "subject_type"), F.lower(F.replace("relation", F.lit("_"), F.lit(" "))), shown("object", "object_type")).alias("text"))


def fact_recall(facts: DataFrame, triples: DataFrame, embedder: Embedder | None = None, least: float = FACT_MATCH, block: int = 4096) -> DataFrame:
    """One row: facts, found, recall: facts (chunk_id, fact) with a triple whose sentence has a cosine of ``least`` or more.

    Facts are compared with all distinct sentences, block by block, one matrix product each; only the hits leave a task.
    """
    both = facts.where("fact is not null").select("chunk_id", "fact")
    f = materialize(embed_column(both.select(F.col("fact").alias("text")).distinct(), "text", embedder), "facts")
    t = materialize(embed_column(linearized(triples).distinct(), "text", embedder), "sentences")
    nf, nt = max(1, -(-f.count() // block)), max(1, -(-t.count() // (4 * block)))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"text": pd.Series(dtype=str)})
        s = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        return pd.DataFrame({"text": a["text"][s.max(axis=1) >= least]})

    hits = dealt(f, "i", nf, "j", nt).groupBy("i", "j").cogroup(dealt(t, "j", nt, "i", nf).groupBy("i", "j")).applyInPandas(compare, "text string").distinct()
    found = both.join(hits.select(F.col("text").alias("fact"), F.lit(1).alias("hit")), "fact", "left")
    return _recall(found)


def _recall(found: DataFrame) -> DataFrame:
    n = found.agg(F.count(F.lit(1)).alias("facts"), F.count("hit").alias("found"))
    return n.withColumn("recall", F.coalesce(F.try_divide("found", "facts"), F.lit(0.0)))


def part_of_each_other(strings: DataFrame, ids: DataFrame) -> DataFrame:
    """(text) of distinct ``strings`` (text) that contain an id (text) or are part of one.

    A string is looked for where its first three letters, or all of fewer, occur, which is an equality join. Null and empty
    strings contain nothing and are part of nothing.
    """
    x, e = (df.select("text").where("text <> ''").distinct() for df in (strings, ids))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("text").alias(name), F.left("text", F.lit(3)).alias("k"))

    def grams(df: DataFrame, name: str) -> DataFrame:
        at = F.sequence(F.lit(1), F.length("text"))
        cut = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(F.substr("text", i, F.lit(n)) for n in (1, 2, 3))))))
        return df.select(F.col("text").alias(name), F.explode(cut).alias("k"))

    inside = keyed(x, "a").join(grams(e, "b"), "k").where(F.col("b").contains(F.col("a"))).select(F.col("a").alias("text"))
    around = keyed(e, "a").join(grams(x, "b"), "k").where(F.col("b").contains(F.col("a"))).select(F.col("b").alias("text"))
    return inside.union(around).distinct()


def fact_recall_substring(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: facts, found, recall: facts (subject, object) both of whose ends are part of an id or contain one, ignoring case."""
    f = facts.select(F.lower("subject").alias("s"), F.lower("object").alias("o"))
    hits = part_of_each_other(f.select(F.explode(F.array("s", "o")).alias("text")), ids.select(F.lower("id").alias("text"))).withColumn("hit", F.lit(1))
    s, o = hits.select(F.col("text").alias("s"), F.col("hit").alias("hs")), hits.select(F.col("text").alias("o"), F.col("hit").alias("ho"))
    return _recall(f.join(s, "s", "left").join(o, "o", "left").withColumn("hit", F.col("hs") * F.col("ho")))


def edge_f1(induced: DataFrame, reference: DataFrame, similarity: DataFrame, threshold: float = MATCH) -> DataFrame:
    """(run_id, precision, recall, f1) of edges that match if both ends' similarity exceeds the threshold.

    ``induced``: child, parent; ``reference``: run_id, child, parent; ``similarity``: run_id, induced, reference, sim. Only
    pairs above the threshold are joined, so no pair of edges arises without a matching child. A run without a match has 0.
    """
    s = similarity.where(F.col("sim") > threshold)
    i = induced.select("child", "parent").distinct()
    r = reference.select("run_id", F.col("child").alias("rc"), F.col("parent").alias("rp")).distinct()
    of_child = s.select("run_id", F.col("induced").alias("child"), F.col("reference").alias("rc"))
    of_parent = s.select("run_id", F.col("induced").alias("parent"), F.col("reference").alias("rp"))
    hits = i.join(of_child, "child").join(r, ["run_id", "rc"]).join(of_parent, ["run_id", "parent", "rp"])
    m = hits.groupBy("run_id").agg(F.countDistinct("child", "parent").alias("mi"), F.countDistinct("rc", "rp").alias("mr"))
    n = r.groupBy("run_id").agg(F.count(F.lit(1)).alias("nr")).join(m, "run_id", "left").withColumn("ni", F.lit(i.count()))
    return _balanced(n, F.try_divide("mi", "ni"), F.try_divide("mr", "nr"))


def _balanced(df: DataFrame, precision: Column, recall: Column) -> DataFrame:
    p, r = F.coalesce(precision, F.lit(0.0)), F.coalesce(recall, F.lit(0.0))
    return df.select("run_id", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def class_names(nodes: DataFrame) -> DataFrame:
    """(run_id, name, words, last): distinct names with their distinct lower-case words and the last capitalised word.

    Rows with a null name or run are left out.
    """
    spaced = F.lower(F.trim(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2")))
    last = F.lower(F.regexp_extract("name", r"([A-Z][a-z]+)\d*$", 1))
    named = nodes.select("run_id", "name").where("run_id is not null and name is not null").distinct()
    return named.select("run_id", "name", F.array_distinct(F.split(spaced, " ")).alias("words"), last.alias("last"))


def run_pairs(names: DataFrame, first: str) -> DataFrame:
    """(run_id, induced, reference, sim, label) of names of the run ``first`` and of each other run that share a word.

    ``sim`` is the number of common words over the root of the product of their numbers, ``label`` whether the last words
    are equal; names that share the last word only have sim 0. All other pairs have sim 0 and label 0 and do not arise.
    Both joins are on equality of a word, and words of a pair are added up before the shuffle.
    """
    def side(df: DataFrame, name: str, n: str) -> DataFrame:
        return df.select("run_id", F.col("name").alias(name), F.size("words").alias(n), "words", "last")

    a = side(names.where(F.col("run_id") == first), "induced", "na").drop("run_id")
    b = side(names.where(F.col("run_id") != first), "reference", "nb")

    def by_word(df: DataFrame) -> DataFrame:
        return df.withColumn("w", F.explode("words")).drop("words", "last")

    columns = ["run_id", "induced", "reference", "na", "nb"]
    words = by_word(a).join(by_word(b), "w").select(*columns, F.lit(1).alias("k"), F.lit(0).alias("label"))
    lasts = a.drop("words").join(b.drop("words"), "last").select(*columns, F.lit(0).alias("k"), F.lit(1).alias("label"))
    both = words.unionByName(lasts).groupBy(*columns).agg(F.sum("k").alias("k"), F.max("label").alias("label"))
    return both.select("run_id", "induced", "reference", F.round(F.col("k") / F.sqrt(F.col("na") * F.col("nb")), 9).alias("sim"), "label")


def run_sizes(names: DataFrame, first: str) -> DataFrame:
    """(run_id, n_induced, n_reference) of each run but ``first``."""
    n = names.where(F.col("run_id") == first).count()
    return names.where(F.col("run_id") != first).groupBy("run_id").agg(F.lit(n).alias("n_induced"), F.count(F.lit(1)).alias("n_reference"))


def alignment(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(run_id, precision, recall, f1) of classes by their best match; a class in no pair has 0."""
    def best(by: str, total: str) -> DataFrame:
        return pairs.groupBy("run_id", by).agg(F.max("sim").alias("m")).groupBy("run_id").agg(F.sum("m").alias(total))

    both = sizes.join(best("induced", "p"), "run_id", "left").join(best("reference", "r"), "run_id", "left")
    return _balanced(both, F.try_divide("p", "n_induced"), F.try_divide("r", "n_reference"))


def judged_alignment(pairs: DataFrame, sizes: DataFrame, client: LLMClient, least: float = CANDIDATE) -> DataFrame:
    """(run_id, precision, recall, f1): classes that the model judges the same as one of the other side.

    Only pairs (run_id, induced, reference, sim) with a similarity of ``least`` are asked about, each pair of names once.
    """
    near = pairs.where(F.col("sim") >= least).select("run_id", "induced", "reference")
    prompts = near.select("induced", "reference").distinct().select(F.struct("induced", "reference").alias("key"), F.concat(F.lit("Do these name the same class? yes or no\n"), "induced", F.lit("\n"), "reference").alias("prompt"))
    same = near.join(ask(prompts, client).where(F.lower(F.trim("answer")).startswith("yes")).select("key.*"), ["induced", "reference"])
    hits = same.groupBy("run_id").agg(F.countDistinct("induced").alias("p"), F.countDistinct("reference").alias("r"))
    return _balanced(sizes.join(hits, "run_id", "left"), F.try_divide("p", "n_induced"), F.try_divide("r", "n_reference"))


def roc_auc(scores: DataFrame, zeros: DataFrame | None = None) -> DataFrame:
    """(run_id, positives, negatives, auc) of (run_id, score, label); ties count half. Null auc without both labels.

    ``zeros``: (run_id, n) further rows of score and label 0. Rows are added up by distinct score. Running sums go over
    slices of the score first and then within each slice, so no task orders all scores of a run.
    """
    label = F.col("label").cast("long")
    rows = scores.select("run_id", "score", label.alias("p"), (1 - label).alias("n"))
    if zeros is not None:
        rows = rows.unionByName(zeros.select("run_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("p"), F.col("n").cast("long").alias("n")))
    by = rows.groupBy("run_id", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).withColumn("slice", F.floor(F.col("score") * SLICES))
    slices = by.groupBy("run_id", "slice").agg(F.sum("n").alias("n"))
    lower = slices.select("run_id", "slice", F.coalesce(F.sum("n").over(W.partitionBy("run_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lower"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("run_id", "slice").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("inside", inside).join(lower, ["run_id", "slice"]).withColumn("below", F.col("inside") + F.col("lower"))
    sums = won.groupBy("run_id").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))).alias("u"))
    return sums.select("run_id", "positives", "negatives", F.try_divide(F.col("u"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """(run_id, average_precision) of (run_id, score, label): precision at each distinct score, weighted by its gain in recall.

    Rows of score 0 and label 0 that are not given would only follow the last positive, unless it has score 0 as well; then
    they must be given.
    """
    label = F.col("label").cast("long")
    by = scores.groupBy("run_id", "score").agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("run_id").orderBy(F.desc("score"))
    run = by.select("run_id", "p", F.sum("p").over(down).alias("hits"), F.sum("n").over(down).alias("seen"))
    return run.groupBy("run_id").agg(F.try_divide(F.sum(F.col("p") * F.col("hits") / F.col("seen")), F.sum("p")).alias("average_precision"))


def retrieval(pairs: DataFrame) -> DataFrame:
    """(run_id, references, mrr, recall_at_1, recall_at_3) over references with a true match.

    Matches are ranked by sim, ties by name. A true match without a common word is not found: it counts as reference with 0.
    """
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("run_id", "reference").orderBy(F.desc("sim"), "induced")))
    best = ranked.where("label = 1").groupBy("run_id", "reference").agg(F.min(F.when(F.col("sim") > 0, F.col("rank"))).alias("rank"))

    def share(hit: Column) -> Column:
        return F.avg(F.coalesce(hit.cast("double"), F.lit(0.0)))

    return best.groupBy("run_id").agg(F.count(F.lit(1)).alias("references"), share(1 / F.col("rank")).alias("mrr"), share(F.col("rank") == 1).alias("recall_at_1"), share(F.col("rank") <= 3).alias("recall_at_3"))


def top_matches(pairs: DataFrame, k: int = 3) -> DataFrame:
    """(run_id, reference, rank, induced, sim): up to ``k`` most similar induced classes of each reference class."""
    ranked = pairs.where("sim > 0").withColumn("rank", F.row_number().over(W.partitionBy("run_id", "reference").orderBy(F.desc("sim"), "induced")))
    return ranked.where(F.col("rank") <= k).select("run_id", "reference", "rank", "induced", "sim")


def balance(assignments: DataFrame) -> DataFrame:
    """One row: entities, labeled, coverage, n_classes, avg_class_size, entropy (scaled to 1). Other does not count as class."""
    sizes = assignments.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("class") != "Other"
    t = sizes.agg(F.sum("n").alias("entities"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("labeled"), F.count(F.when(named, 1)).alias("n_classes"), F.sum(F.when(named, F.col("n") * F.log2("n"))).alias("h"))
    entropy = F.when((F.col("n_classes") > 1) & (F.col("labeled") > 0), (F.log2("labeled") - F.col("h") / F.col("labeled")) / F.log2("n_classes")).otherwise(0.0)
    return t.select("entities", "labeled", F.coalesce(F.try_divide("labeled", "entities"), F.lit(0.0)).alias("coverage"), "n_classes", F.coalesce(F.try_divide("labeled", "n_classes"), F.lit(0.0)).alias("avg_class_size"), entropy.alias("entropy"))


def coherence(vectors: DataFrame) -> DataFrame:
    """(class, n, coherence): mean cosine of all pairs of members (class, v of length one), from the sum of the vectors.

    The sum's squared length less n, over n (n - 1); 1 for a single member. Sums are partial, so no pair ever arises.
    """
    flat = vectors.where("v is not null").select("class", F.posexplode("v").alias("k", "x"))
    sums = flat.groupBy("class", "k").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("class").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    return per.select("class", "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("coherence"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(class_of, v): mean direction of all members (class_of, v of length one); a class whose vectors cancel out has none."""
    sums = vectors.select("class_of", F.posexplode("v").alias("k", "x")).groupBy("class_of", "k").agg(F.sum("x").alias("s"))
    per = sums.groupBy("class_of").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return per.withColumn("norm", norm).where("norm > 0").select("class_of", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def best_centroid(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """(entity, class_of, sim): the class of the highest cosine for each vector (id, v of length one), ties by name.

    ``classes``: (class_of, v), whose number is checked; each Arrow batch is one matrix product with them.
    """
    rows = sorted(bounded_rows(classes.select("class_of", "v"), MAX_NAMES, "classes"))
    names, table = [r["class_of"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64)
    id_type = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(names):
                s = np.stack(b["v"].to_numpy()) @ table.T
                at = s.argmax(axis=1)
                yield pd.DataFrame({"entity": b["id"], "class_of": [names[i] for i in at], "sim": s[np.arange(len(b)), at]})

    return vectors.select("id", "v").mapInPandas(run, f"entity {id_type}, class_of string, sim double")


def member_assignment(similarity: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row: full, half, none, score: the best similarity of each (entity, class_of, sim) counts 1, 0.5 or 0."""
    best = similarity.groupBy("entity").agg(F.max("sim").alias("sim"))
    if evidence is not None:
        best = best.join(evidence, "entity", "left_semi")
    credit = F.when(F.col("sim") >= FULL, 1.0).when(F.col("sim") >= HALF, 0.5).otherwise(0.0)
    return best.agg(F.count(F.when(credit == 1.0, 1)).alias("full"), F.count(F.when(credit == 0.5, 1)).alias("half"), F.count(F.when(credit == 0.0, 1)).alias("none"), F.coalesce(F.avg(credit), F.lit(0.0)).alias("score"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching with the least total cost, one for each of the fewer rows or columns."""
    c = np.asarray(cost, dtype=np.float64)
    if c.size == 0:
        return []
    if c.shape[0] > c.shape[1]:
        return sorted((r, k) for k, r in assignment(c.T))
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            row = owner[j0]
            slack = c[row - 1] - u[row] - v[1:]
            open_ = ~used[1:]
            better = open_ & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.where(open_, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][open_] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def _f1(score: float, n: int, m: int) -> tuple[float, float, float]:
    p, r = float(score) / n if n else 0.0, float(score) / m if m else 0.0
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


class Run:
    """Names of a run in order, and its distinct edges (child, parent) as places in ``ends``: the names, then other parents."""

    def __init__(self, rows: Iterable[tuple[str, str | None]]):
        rows = [(n, (p or "").strip(" ")) for n, p in rows if n is not None]
        self.names = sorted({n for n, _ in rows})
        edges = sorted({e for e in rows if e[1]})
        ends = self.names + sorted({p for _, p in edges} - set(self.names))
        at = {x: i for i, x in enumerate(ends)}
        self.n_ends, self.child, self.parent = len(ends), np.array([at[c] for c, _ in edges], dtype=int), np.array([at[p] for _, p in edges], dtype=int)
        self.words = [set(re.sub("([a-z])([A-Z])", r"\1 \2", n).strip(" ").lower().split(" ")) for n in self.names]


def word_similarity(a: Run, b: Run) -> np.ndarray:
    """Common words of each name of ``a`` and of ``b`` over the root of the product of their words; only common words are visited."""
    holders = defaultdict(list)
    for i, words in enumerate(a.words):
        for w in words:
            holders[w].append(i)
    out = np.zeros((len(a.names), len(b.names)))
    for j, words in enumerate(b.words):
        for w in words:
            out[holders.get(w, []), j] += 1
    return out / np.sqrt(np.outer([len(w) for w in a.words], [len(w) for w in b.words]))


def _end_similarity(a: Run, b: Run) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of the children and of the parents of all pairs of edges. Ends that are no names of the run have none."""
    s = np.zeros((a.n_ends, b.n_ends))
    s[: len(a.names), : len(b.names)] = word_similarity(a, b)
    return s[np.ix_(a.child, b.child)], s[np.ix_(a.parent, b.parent)]


def continuous_f1_of(a: Run, b: Run) -> list[tuple]:
    """(precision, recall, f1) of the best one-to-one matching of edges by the smaller similarity of their ends."""
    m = np.minimum(*_end_similarity(a, b))
    return [_f1(sum(m[i, j] for i, j in assignment(-m)), *m.shape)]


def _depths(run: Run) -> np.ndarray:
    """Links from each end up to its top; in a cycle, links until an end comes again."""
    up, out = dict(zip(run.child.tolist(), run.parent.tolist())), []
    for i in range(run.n_ends):
        seen = set()
        while i in up and i not in seen:
            seen.add(i)
            i = up[i]
        out.append(len(seen))
    return np.array(out, dtype=int)


def depth_similarity_of(a: Run, b: Run) -> list[tuple]:
    """As :func:`depth_similarity`, by common words of the names."""
    s = word_similarity(a, b)
    return [(depth_similarity(s, _depths(a)[: len(a.names)].tolist(), _depths(b)[: len(b.names)].tolist()),)]


def graph_f1_of(a: Run, b: Run) -> list[tuple]:
    """As :func:`graph_f1`, with vectors of the names by the words of both runs."""
    place = {w: i for i, w in enumerate(sorted(set().union(*a.words, *b.words)))}

    def vectors(r: Run) -> dict[str, np.ndarray]:
        out = {}
        for n, words in zip(r.names, r.words):
            out[n] = np.zeros(len(place))
            out[n][[place[w] for w in words]] = 1.0
        return out

    def links(r: Run) -> list:
        return [(r.names[c], r.names[p]) for c, p in zip(r.child, r.parent) if p < len(r.names)]

    return [graph_f1(vectors(a), vectors(b), links(a), links(b))]


def against_first(nodes: DataFrame, score: Callable[[Run, Run], list[tuple]], schema: str) -> DataFrame:
    """(run_id, *schema): ``score`` of the first run by run_id as the induced one with each other run of (run_id, name, parent).

    A run is scored in one task, with the first run at hand; its size is checked.
    """
    first = nodes.agg(F.min("run_id")).first()[0]
    a = Run((r["name"], r["parent"]) for r in bounded_rows(nodes.where(F.col("run_id") == first).select("name", "parent"), what="names of the first run"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > LOOKUP_ROWS:
            raise ValueError(f"run {key[0]} has more than {LOOKUP_ROWS} names")
        b = Run(zip(rows["name"], rows["parent"]))
        return pd.DataFrame([(*key, *x) for x in score(a, b)], columns=["run_id", *(c.split()[0].strip("`") for c in schema.split(", "))])

    others = nodes.where((F.col("run_id") != first) & F.col("name").isNotNull()).select("run_id", "name", "parent")
    return others.groupBy("run_id").applyInPandas(run, f"run_id string, {schema}")


def graph_f1(induced: dict[str, np.ndarray], reference: dict[str, np.ndarray], induced_edges: list, reference_edges: list, hops: int = 2) -> tuple[float, float, float]:
    """(precision, recall, f1) of the best matching of nodes by vectors smoothed over their neighbours ``hops`` times."""

    def smooth(vectors: dict[str, np.ndarray], edges: list) -> np.ndarray:
        names = sorted(vectors)
        x, at = np.stack([vectors[n] for n in names]).astype(np.float64), {n: i for i, n in enumerate(names)}
        if len(names) > 1 and edges:
            adj = np.eye(len(names))
            for c, p in edges:
                if c in at and p in at:
                    adj[at[c], at[p]] = adj[at[p], at[c]] = 1.0
            d = 1 / np.sqrt(adj.sum(axis=1))
            for _ in range(hops):
                x = (d[:, None] * adj * d[None, :]) @ x
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    if not induced or not reference:
        return 0.0, 0.0, 0.0
    s = smooth(induced, induced_edges) @ smooth(reference, reference_edges).T
    return _f1(sum(s[i, j] for i, j in assignment(-s)), len(induced), len(reference))


def depth_similarity(similarity: np.ndarray, depth_a: list[int], depth_b: list[int]) -> float:
    """Mean of 2 (min + 1) / (a + b + 2) over the optimally matched nodes with similarity of at least DEPTH_MATCH."""
    scores = [2 * (min(depth_a[i], depth_b[j]) + 1) / (depth_a[i] + depth_b[j] + 2) for i, j in assignment(-np.asarray(similarity)) if similarity[i][j] >= DEPTH_MATCH]
    return float(np.mean(scores)) if scores else 0.0


def compare_runs(metrics: DataFrame, base: str) -> DataFrame:
    """(metric, run, value, delta): each run's value less that of ``base``; null where the base has none."""
    b = metrics.where(F.col("run") == base).select("metric", F.col("value").alias("_b"))
    return metrics.join(b, "metric", "left").select("metric", "run", "value", (F.col("value") - F.col("_b")).alias("delta"))


def run_tasks(spark: SparkSession, tasks: list[tuple[str, str, list[str]]], limit: int = 200) -> DataFrame:
    """(task, passed) of (task, statement, keywords): whether a keyword is in the values of the first ``limit`` rows.

    A statement that may not run, or that fails, does not pass.
    """
    from ..sources.writers import answer

    out = None
    for name, sql, keywords in tasks:
        try:
            rows = answer(spark, sql, limit)
            text = F.concat_ws(" ", *[F.lower(F.col(f"`{c}`").cast("string")) for c in rows.columns])
            hits = rows.agg(F.coalesce(F.max(F.exists(F.array(*map(F.lit, keywords)), lambda k: text.contains(F.lower(k)))), F.lit(False)).alias("passed"))
        except (ValueError, AnalysisException):
            hits = spark.createDataFrame([(False,)], "passed boolean")
        hits = hits.select(F.lit(name).alias("task"), "passed")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], "task string, passed boolean")
