"""Triples to a property graph, and statistics over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_any
from .resolution import PREFIXES, has_prefix

#: Types that are values, words in a type's name that make it a value or a concept.
VALUE_TYPES = ("Numeric", "Date", "Text", "Categorical", "RecordType", "IdentityType", "FinancialAmount", "TimePeriod")
VALUE_WORDS = ("amount", "date", "numeric", "currency", "code", "score", "percentage", "number", "count", "rate", "duration", "period", "text", "categorical", "boolean", "flag", "status", "field", "value", "id", "identifier", "index", "timestamp")
CONCEPT_WORDS = ("policy", "claim", "person", "organization", "company", "property", "building", "coverage", "product", "risk", "peril", "hazard", "damage", "exclusion", "structure", "agent", "insured", "beneficiary", "location", "address")
#: Shapes of literals.
LITERALS = r"^\$[\d,]+\.?\d*$|^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{2,4}$|^-?[\d,]+\.?\d*%?$|^[A-Z0-9]{1,5}$"


def ends(triples: DataFrame) -> DataFrame:
    """(id, type, source_type, ord): both ends of every triple in order of appearance; null ends are left out."""
    s = F.struct(F.col("subject").alias("id"), F.col("subject_type").alias("type"), "source_type", F.struct("seq", F.lit(0).alias("end")).alias("ord"))
    o = F.struct(F.col("object").alias("id"), F.col("object_type").alias("type"), "source_type", F.struct("seq", F.lit(1).alias("end")).alias("ord"))
    return triples.select(F.explode(F.array(s, o)).alias("e")).select("e.*").where("id is not null")


def merge_nodes(triples: DataFrame) -> DataFrame:
    """(id, entity_type, source_type): the first known type, or Unknown, and the source type of the first row."""
    known = F.col("type").isNotNull() & (F.col("type") != "Unknown")
    e = ends(triples)
    return e.groupBy("id").agg(F.coalesce(F.min(F.when(known, F.struct("ord", "type")))["type"], F.lit("Unknown")).alias("entity_type"), F.min(F.struct("ord", "source_type"))["source_type"].alias("source_type"))


def merge_edges(triples: DataFrame, relation: str = "relation") -> DataFrame:
    """(src, rel, dst, span, confidence, chunk_id, source, seq): the first row of each edge; null ends are left out."""
    rows = triples.where("subject is not null and object is not null")
    first = F.min(F.struct("seq", "span", "confidence", "chunk_id", "source")).alias("x")
    return rows.groupBy(F.col("subject").alias("src"), F.col(relation).alias("rel"), F.col("object").alias("dst")).agg(first).select("src", "rel", "dst", "x.span", "x.confidence", "x.chunk_id", "x.source", "x.seq")


def entity_graph(triples: DataFrame) -> DataFrame:
    """(id, entity_type): the first type seen, but a concept type goes before a value type. Null types count as Unknown."""
    t = F.coalesce("type", F.lit("Unknown"))
    e = ends(triples).select("id", "ord", t.alias("type"))
    concept = F.min(F.when(~F.col("type").isin(*VALUE_TYPES), F.struct("ord", "type")))["type"]
    return e.groupBy("id").agg(F.coalesce(concept, F.min(F.struct("ord", "type"))["type"]).alias("entity_type"))


def type_roles(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_type, n, literal_share, relation_diversity, avg_out_degree, role): value, descriptor, concept or anchor."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    per = entities.join(out, "id", "left").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("id").rlike(LITERALS).cast("double")).alias("literal_share"), F.avg(F.coalesce("deg", F.lit(0)).cast("double")).alias("avg_out_degree"))
    touch = edges.select(F.explode(F.array("src", "dst")).alias("id"), "rel").distinct().join(entities, "id").select("entity_type", "rel").distinct().groupBy("entity_type").agg(F.count(F.lit(1)).alias("relation_diversity"))
    s = per.join(touch, "entity_type", "left").withColumn("relation_diversity", F.coalesce("relation_diversity", F.lit(0)))
    name, lit, div, deg = F.replace(F.lower("entity_type"), F.lit("_"), F.lit("")), F.col("literal_share"), F.col("relation_diversity"), F.col("avg_out_degree")
    strong = (deg >= 3) & (div >= 5)
    role = (
        F.when(F.col("entity_type").isin(*VALUE_TYPES), "value")
        .when(contains_any(name, CONCEPT_WORDS), F.when(strong, "anchor").otherwise("concept"))
        .when(lit > 0.6, "value")
        .when(contains_any(name, VALUE_WORDS) & (div < 4), "value")
        .when((div < 3) & (deg < 1.0) & (lit > 0.3), "value")
        .when((deg < 0.5) & (div < 3), "descriptor")
        .when(strong, "anchor")
        .otherwise("concept")
    )
    return s.select("entity_type", "n", "literal_share", "relation_diversity", "avg_out_degree", role.alias("role"))


def lane(id_: Column, entity_type: Column, value_types=VALUE_TYPES) -> Column:
    """record by the id's prefix, value by type or a number or amount as id, else concept."""
    number = F.replace(F.regexp_replace(F.regexp_replace(id_, r"^-+", ""), r"^([^.]*)\.", "$1"), F.lit(","), F.lit("")).rlike(r"^\d+\z")
    return F.when(has_prefix(id_, PREFIXES), "record").when(F.coalesce(entity_type.isin(*value_types), F.lit(False)) | id_.startswith("$") | number, "value").otherwise("concept")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of every node, 0 where it has no edge. Counted with partial sums."""
    flags = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = flags.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    o, i = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    return nodes.select("id").join(sums, "id", "left").select("id", o.alias("out_degree"), i.alias("in_degree"), (o + i).alias("degree"))


def summaries(edges: DataFrame, n: int = 5) -> DataFrame:
    """(id, out_summary, out_rel_counts, in_summary, in_rel_counts) of every end of an edge.

    The first ``n`` edges of each direction as text by seq, and counts by relation as "rel=n"; empty where there are none.
    Ranks are cut per node before anything is collected, so a node with very many edges yields n entries.
    """

    def side(end: str, shown: Column, prefix: str) -> DataFrame:
        first = edges.withColumn("r", F.row_number().over(W.partitionBy(end).orderBy("seq"))).where(F.col("r") <= n).groupBy(end).agg(F.array_sort(F.collect_list(F.struct("r", shown.alias("t")))).alias("s"))
        counts = edges.groupBy(end, "rel").agg(F.count(F.lit(1)).alias("k")).groupBy(end).agg(F.array_sort(F.collect_list(F.concat("rel", F.lit("="), F.col("k").cast("string")))).alias("c"))
        return first.join(counts, end).select(F.col(end).alias("id"), F.col("s.t").alias(f"{prefix}_summary"), F.col("c").alias(f"{prefix}_rel_counts"))

    out, into = side("src", F.concat("rel", F.lit(" -> "), "dst"), "out"), side("dst", F.concat("src", F.lit(" -> "), "rel"), "in")
    no = F.array().cast("array<string>")
    return out.join(into, "id", "full").select("id", *(F.coalesce(c, no).alias(c) for c in ("out_summary", "out_rel_counts", "in_summary", "in_rel_counts")))


def neighbor_vote(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, class) for ends without a class: the most frequent class among direct neighbours in either direction, ties by name."""
    known = classes.select(F.col("id").alias("n"), "class")
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("id"), F.col("src").alias("n")))).alias("e")).select("e.*")
    votes = both.join(known, "n").join(classes.select("id"), "id", "left_anti").groupBy("id", "class").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("v")).alias("v"), "class"))["class"].alias("class"))


def backbone(edges: DataFrame, assignments: DataFrame, least: float = 0.10) -> DataFrame:
    """(class, total, connected_direct, connected_2hop, connectivity, disconnected) per class other than Other.

    Direct: a neighbour of another class. Two hops: through a neighbour without a class, to a node of another class. A
    hub without a class passes on at most two of its neighbours' classes, which is enough to know if one differs.
    """
    a = assignments.select("id", F.coalesce("class", F.lit("Other")).alias("class"))
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("id"), F.col("src").alias("n")))).alias("e")).select("e.*").where("id <> n").distinct()
    near = both.join(a.select(F.col("id").alias("n"), F.col("class").alias("nc")), "n").join(a, "id")
    direct = near.where("class <> 'Other' and nc <> 'Other' and class <> nc").select("id").distinct().withColumn("d", F.lit(1))
    hubs = near.where("class = 'Other' and nc <> 'Other'").groupBy(F.col("id").alias("hub")).agg(F.min("nc").alias("c1"), F.max("nc").alias("c2"))
    two = near.where("class <> 'Other' and nc = 'Other'").join(hubs, F.col("n") == F.col("hub")).where("c1 <> class or c2 <> class").select("id").distinct().withColumn("t", F.lit(1))
    rows = a.where("class <> 'Other'").join(direct, "id", "left").join(two, "id", "left")
    d, t = F.sum(F.coalesce("d", F.lit(0))), F.sum(F.when(F.col("d").isNull() & F.col("t").isNotNull(), 1).otherwise(0))
    out = rows.groupBy("class").agg(F.count(F.lit(1)).alias("total"), d.alias("connected_direct"), t.alias("connected_2hop"))
    share = F.round((F.col("connected_direct") + F.col("connected_2hop")) / F.col("total"), 3)
    return out.withColumn("connectivity", share).withColumn("disconnected", share < least)


def quality(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: connectivity, completeness, balance, other_fraction, backbone_coverage; 0 (other_fraction 1) for no entity."""
    a = assignments.select("id", F.coalesce("class", F.lit("Other")).alias("class"))
    sizes = a.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    other, named = F.coalesce(F.sum(F.when(F.col("class") == "Other", F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("class") != "Other", F.col("n"))), F.lit(0))
    totals = sizes.agg(other.alias("other"), named.alias("named"), F.coalesce(F.max(F.when(F.col("class") != "Other", F.col("n"))), F.lit(0)).alias("largest"), F.count(F.when(F.col("class") != "Other", 1)).alias("classes"))
    linked = backbone(edges, a).agg(F.coalesce(F.sum("connected_direct"), F.lit(0)).alias("direct"))
    pair = edges.join(a.select(F.col("id").alias("src"), F.col("class").alias("cs")), "src").join(a.select(F.col("id").alias("dst"), F.col("class").alias("cd")), "dst").where("cs <> 'Other' and cd <> 'Other' and cs <> cd")
    between = pair.select(F.explode(F.array("cs", "cd")).alias("c")).distinct().agg(F.count(F.lit(1)).alias("linked_classes"))
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("id"), F.col("src").alias("n")))).alias("e")).select("e.*").where("id <> n").distinct()
    records = a.where(has_prefix(F.col("id"))).select("id")
    named_ids = a.where("class <> 'Other'").select(F.col("id").alias("n"))
    concept = both.join(named_ids.where(~has_prefix(F.col("n"))), "n", "left_semi").join(records, "id", "left_semi").select("id")
    hub = both.join(a.where("class = 'Other'").select("id"), "id", "left_semi").join(named_ids, "n", "left_semi").groupBy(F.col("id").alias("hub")).agg(F.min("n").alias("n1"), F.max("n").alias("n2"))
    far = both.join(records, "id", "left_semi").join(hub, F.col("n") == F.col("hub")).where("n1 <> id or n2 <> id").select("id")
    covered = concept.union(far).distinct().agg(F.count(F.lit(1)).alias("covered"))
    total_records = records.agg(F.count(F.lit(1)).alias("records"))
    one = totals.crossJoin(linked).crossJoin(between).crossJoin(covered).crossJoin(total_records)  # one row each

    def ratio(x: str, y: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(x), y), F.lit(0.0)), 4)

    all_ = F.col("other") + F.col("named")
    balance = F.when(F.col("named") > 0, F.round(1 - F.col("largest") / F.col("named"), 4)).otherwise(0.0)
    other_share = F.when(all_ > 0, F.round(F.col("other") / all_, 4)).otherwise(1.0)
    return one.select(ratio("direct", F.col("named")).alias("connectivity"), ratio("linked_classes", F.col("classes")).alias("completeness"), balance.alias("balance"), other_share.alias("other_fraction"), ratio("covered", F.col("records")).alias("backbone_coverage"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean_degree, median_degree, max_degree, isolated, density."""
    d = degrees(nodes, edges).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"), F.avg("degree").alias("mean_degree"), F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated"))
    return d.withColumn("density", F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes").cast("double") * (F.col("nodes") - 1)), F.lit(0.0)))


def decompose_records(edges: DataFrame, assignments: DataFrame, relation_classes: DataFrame | None = None) -> DataFrame:
    """(record, class, relation, target) of records whose HAS_ fields belong to two or more classes other than their own.

    A target without a class takes the class of its relation from ``relation_classes`` (relation, class), if there.
    """
    a = assignments.select("id", F.coalesce("class", F.lit("Other")).alias("class"))
    has = edges.where(F.col("rel").startswith("HAS_") & has_prefix(F.col("src"))).join(a.select(F.col("id").alias("src"), F.col("class").alias("own")), "src", "left").join(a.select(F.col("id").alias("dst"), F.col("class").alias("tc")), "dst", "left")
    cls = F.when(F.col("tc") != "Other", F.col("tc"))
    if relation_classes is not None:
        has = has.join(relation_classes.select(F.col("relation").alias("rel"), F.col("class").alias("rc")), "rel", "left")
        cls = F.coalesce(cls, F.col("rc"))
    rows = has.withColumn("cls", cls).where("cls is not null").where(F.col("cls") != F.coalesce("own", F.lit("Other"))).select(F.col("src").alias("record"), F.col("cls").alias("class"), F.col("rel").alias("relation"), F.col("dst").alias("target"))
    several = rows.select("record", "class").distinct().groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("record")
    return rows.join(several, "record", "left_semi")


def schema_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): counts of node types and of relations."""
    return nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), F.col("entity_type").alias("name"), "n").unionByName(edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("kind"), F.col("rel").alias("name"), "n"))
