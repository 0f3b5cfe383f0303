"""Queries of the clustering, file-class and extraction operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import SentenceTriples
from ..operators import clustering as C
from ..operators import extraction as X
from ..operators import fileclasses as B
from ..operators import recursive as Rc
from ..operators import resolution as Re
from .graph_queries import _VEC, EDGES, edges, triples, unit_vectors
from .registry import contains_sql, registry
from .tables import table

QUERIES, SQL, query = registry()

_HEADERS = "heads AS (SELECT DISTINCT source AS file, upper(regexp_replace(relation, '^HAS_', '')) AS header FROM sampled_triples WHERE source IS NOT NULL AND source_type = 'structured' AND regexp_matches(relation, '^HAS_[A-Z_]+$'))"


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "sampled_triples").where("source is not null and source_type = 'structured'").where(F.col("relation").rlike(r"^HAS_[A-Z_]+\z"))
    return t.select(F.col("source").alias("file"), F.upper(F.regexp_replace("relation", "^HAS_", "")).alias("header")).distinct()


def _file_tokens(spark: SparkSession, sf: str) -> DataFrame:
    f = _headers(spark, sf).select("file").distinct()
    return f.select("file", F.explode(F.split(F.regexp_replace(F.lower("file"), r"\.[a-z]+$", ""), "[_0-9]+")).alias("token")).where("token <> ''")


def _claims_sql(most: int = 12) -> str:
    """Prefixes of ``most`` parts down to one, each claimed by the headers that are still free."""
    out, parts = [f"f{most} AS (SELECT DISTINCT header, string_split(header, '_') AS p FROM heads)"], []
    for n in range(most, 0, -1):
        out.append(f"a{n} AS (SELECT header, array_to_string(p[1:{n}], '_') AS prefix FROM f{n} WHERE len(p) > {n})")
        out.append(f"w{n} AS (SELECT header, prefix FROM a{n} WHERE prefix IN (SELECT prefix FROM a{n} GROUP BY prefix HAVING count(*) >= 3))")
        out.append(f"f{n - 1} AS (SELECT * FROM f{n} WHERE header NOT IN (SELECT header FROM w{n}))")
        parts.append(f"SELECT * FROM w{n}")
    return f"{', '.join(out)}, won AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {_HEADERS}, {_claims_sql()} SELECT prefix, header, substr(header, length(prefix) + 2) AS suffix FROM won")
def prefix_groups(spark: SparkSession, sf: str) -> DataFrame:
    return B.prefix_groups(_headers(spark, sf))


@query(f"""WITH RECURSIVE {_HEADERS}, h AS (SELECT DISTINCT header, string_split(header, '_') AS p FROM heads), l AS (SELECT header, array_to_string(p[1:n], '_') AS prefix, n FROM h, range(1, 12) t(n) WHERE n < len(p)),
  top AS (SELECT prefix FROM l GROUP BY prefix HAVING count(*) >= 3) SELECT DISTINCT header FROM h WHERE NOT EXISTS (SELECT 1 FROM l JOIN top USING (prefix) WHERE l.header = h.header)""")
def ungrouped_headers(spark: SparkSession, sf: str) -> DataFrame:
    # Headers that no prefix of three headers covers are those left over unless claims use a prefix up.
    h = _headers(spark, sf)
    return B.ungrouped(h, B.prefix_groups(h))


@query()
def sibling_groups(spark: SparkSession, sf: str) -> DataFrame:
    return B.siblings(B.prefix_groups(_headers(spark, sf)))


@query(f"WITH {_HEADERS}, s AS (SELECT file, count(*) AS n FROM heads GROUP BY file) SELECT a.file AS a, b.file AS b, count(*) * 1.0 / (x.n + y.n - count(*)) AS jaccard FROM heads a JOIN heads b ON a.header = b.header AND a.file < b.file JOIN s x ON x.file = a.file JOIN s y ON y.file = b.file GROUP BY a.file, b.file, x.n, y.n")
def header_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return B.header_overlap(_headers(spark, sf))


@query()
def cross_file_classes(spark: SparkSession, sf: str) -> DataFrame:
    return B.cross_file_classes(_headers(spark, sf).select(F.col("file").alias("class"), F.lit("").alias("prefix"), "header"))


@query()
def token_roles(spark: SparkSession, sf: str) -> DataFrame:
    return B.token_roles(_file_tokens(spark, sf))[0]


@query()
def function_groups(spark: SparkSession, sf: str) -> DataFrame:
    return B.function_groups(_headers(spark, sf), _file_tokens(spark, sf))


@query()
def functional_classes(spark: SparkSession, sf: str) -> DataFrame:
    h = _headers(spark, sf)
    return B.functional_classes(h, B.function_groups(h, _file_tokens(spark, sf)))


@query(f"WITH {_HEADERS} SELECT a.file AS source_class, b.file AS target_class, a.header AS bridge_column FROM heads a JOIN heads b ON a.header = b.header AND a.file < b.file")
def bridge_columns(spark: SparkSession, sf: str) -> DataFrame:
    return B.bridge_columns(_headers(spark, sf).select(F.col("file").alias("class"), "header"))


@query("""WITH e AS (SELECT subject AS id, source AS file FROM sampled_triples WHERE source IS NOT NULL), m AS (SELECT DISTINCT source AS file, CASE WHEN contains(source, 'polic') THEN 'Policy' WHEN contains(source, 'claim') THEN 'Claim' END AS class FROM sampled_triples WHERE contains(source, 'polic') OR contains(source, 'claim')),
  v AS (SELECT id, class, count(*) AS v FROM e JOIN m USING (file) GROUP BY ALL), b AS (SELECT id, class, row_number() OVER (PARTITION BY id ORDER BY v DESC, class) AS r FROM v) SELECT i.id, coalesce(class, 'Unclassified') AS class FROM (SELECT DISTINCT id FROM e) i LEFT JOIN b ON b.id = i.id AND r = 1""")
def entity_file_class(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "sampled_triples").where("source is not null").select(F.col("subject").alias("id"), F.col("source").alias("file"))
    files = e.select("file").distinct().select(F.when(F.col("file").contains("polic"), "Policy").when(F.col("file").contains("claim"), "Claim").alias("class"), F.lit(1).alias("level"), "file").where("class is not null")
    return B.assign_entities(e, B.file_class_map(files))


_CL = "fine AS (SELECT DISTINCT run_id || ':' || depth AS cluster, name AS member FROM taxonomy_nodes WHERE depth IS NOT NULL), coarse AS (SELECT DISTINCT run_id AS cluster, name AS member FROM taxonomy_nodes)"


@query(f"""WITH {_CL}, n AS (SELECT cluster, count(*) AS n FROM fine GROUP BY cluster), s AS (SELECT f.cluster AS child, c.cluster AS parent, count(*) AS k FROM fine f JOIN coarse c USING (member) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY k DESC, parent) AS r FROM s)
  SELECT child, parent, k * 1.0 / n AS overlap FROM r JOIN n ON n.cluster = child WHERE r = 1 AND k * 1.0 / n >= 0.6""")
def cluster_overlap_parent(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "taxonomy_nodes")
    fine = t.where("depth is not null").select(F.concat("run_id", F.lit(":"), F.col("depth").cast("string")).alias("cluster"), F.col("name").alias("member"))
    return C.cluster_parents(fine, t.select(F.col("run_id").alias("cluster"), F.col("name").alias("member")))


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    return Re.similar_pairs(unit_vectors(spark, sf).select("id", "v"), 0.6)


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entity_embeddings").select(F.col("vec_id").alias("id"), F.col("id").alias("name"), "entity_type")
    t = triples(spark, sf).where("subject is not null").groupBy(F.col("subject").alias("name")).agg(F.collect_set("relation").alias("relations"), F.collect_set("chunk_id").alias("chunks"))
    return e.join(t, "name", "left").select("id", "entity_type", "relations", "chunks")


_JACCARD = "coalesce(len(list_intersect({0}, {1})) * 1.0 / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0)"


@query(f"""WITH {_VEC}, pr AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM vec a JOIN vec b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.6 - 1e-9),
  t AS (SELECT subject AS name, list_distinct(list(relation)) AS r, list_distinct(list(chunk_id)) AS c FROM sampled_triples WHERE subject IS NOT NULL GROUP BY subject), e AS (SELECT vec_id AS id, entity_type AS t, coalesce(r, []) AS r, coalesce(c, []) AS c FROM entity_embeddings LEFT JOIN t ON t.name = id)
  SELECT a, b, weight FROM (SELECT a, b, 0.4 * sim + 0.25 * {_JACCARD.format('x.r', 'y.r')} + 0.15 * {_JACCARD.format('x.c', 'y.c')} + 0.2 * CAST(coalesce(x.t = y.t AND x.t <> 'Unknown', false) AS INT) AS weight FROM pr JOIN e x ON x.id = a JOIN e y ON y.id = b) WHERE weight >= 0.3""")
def similarity_graph(spark: SparkSession, sf: str) -> DataFrame:
    return C.similarity_graph(_similar(spark, sf), _profiles(spark, sf), 0.3)


@query()
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return C.communities(C.similarity_graph(_similar(spark, sf), _profiles(spark, sf), 0.3))


@query()
def heterogeneous_splits(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_groups(unit_vectors(spark, sf).select(F.col("entity_type").alias("grp"), "id", "v"), least_silhouette=0.02)


@query(f"""WITH {EDGES}, c AS (SELECT split_part(rel, '_', 1) AS grp, CAST(length(src) % 3 AS INT) AS part, rel, count(*) AS n FROM edges WHERE rel IS NOT NULL GROUP BY ALL), t AS (SELECT grp, part, sum(n) AS t FROM c GROUP BY ALL),
  p AS (SELECT grp, part, rel, n / t AS p FROM c JOIN t USING (grp, part)), x AS (SELECT a.grp, a.part AS part_a, b.part AS part_b FROM t a JOIN t b ON a.grp = b.grp AND a.part < b.part), r AS (SELECT DISTINCT grp, rel FROM p),
  g AS (SELECT x.grp, part_a, part_b, coalesce(a.p, 0) AS a, coalesce(b.p, 0) AS b FROM x JOIN r USING (grp) LEFT JOIN p a ON a.grp = x.grp AND a.part = part_a AND a.rel = r.rel LEFT JOIN p b ON b.grp = x.grp AND b.part = part_b AND b.rel = r.rel)
  SELECT grp, part_a, part_b, sum((CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2) AS divergence FROM g GROUP BY ALL""")
def relation_divergence(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).select(F.split("rel", "_")[0].alias("grp"), (F.length("src") % 3).alias("part"), F.col("rel").alias("relation"))
    return C.relation_divergence(e.where("relation is not null").groupBy("grp", "part", "relation").agg(F.count(F.lit(1)).alias("n")))


@query()
def merged_clusters(spark: SparkSession, sf: str) -> DataFrame:
    u = unit_vectors(spark, sf).where("entity_type is not null").select("entity_type", "id", F.posexplode("v").alias("k", "x"))
    mean = u.groupBy("entity_type", "k").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    c = mean.groupBy(F.col("entity_type").alias("cluster")).agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("k", "s"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["s"] * x["s"]))
    return C.merge_clusters(c.select("cluster", "size", F.transform("v", lambda x: x["s"] / norm).alias("v")), 0.3)


def _about(rules) -> str:
    return "CASE " + " ".join(f"WHEN {contains_sql('lower(around)', words)} THEN '{name}'" for name, words in rules) + " END"


def _number_sql(s: X.Shape) -> str:
    around = f"right(before, {s.context[0]}) || m || left(rest, {s.context[1]})" if s.context else r"regexp_extract(before, '[^.\n]*\z') || m || regexp_extract(rest, '^[^.]*')"
    return rf"""SELECT chunk_id, source, '{s.kind}' AS object_type, {s.confidence} AS confidence, regexp_extract(m, '^[$\d,.]+') || '{s.unit}' AS object, {_about(s.about)} AS relation, right(before, {X.SUBJECT_CHARS}) AS head,
      left(right(before, {s.span[0]}) || m || left(rest, {s.span[1]}), {X.SPAN_CHARS}) AS span FROM (SELECT *, {around} AS around FROM (SELECT chunk_id, source, m, substr(content, 1, n_before) AS before, substr(content, n_before + length(m) + 1) AS rest FROM
      (SELECT *, f[i] AS m, length(array_to_string(g[1:i], '')) + length(array_to_string(f[1:i - 1], '')) AS n_before FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT chunk_id, source, content, regexp_extract_all(content, '{s.pattern}', 0) AS f, string_split_regex(content, '{s.pattern}') AS g FROM hybrid_chunks)))))"""


def _titled(c: str) -> str:
    return f"array_to_string(list_transform(string_split(trim({c}), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(rf"""WITH n AS ({" UNION ALL ".join(map(_number_sql, X.SHAPES))}), s AS (SELECT *, regexp_extract_all(head, '{X.PHRASE}', 0) AS ph, {_titled(f"regexp_extract(head, '{X.LABEL}', 1)")} AS lb, {_titled(f"regexp_extract(head, '{X.OF}', 1)")} AS fo FROM n WHERE relation IS NOT NULL)
  SELECT * FROM (SELECT CASE WHEN len(ph) > 0 THEN trim(ph[-1]) WHEN lb <> '' THEN lb ELSE fo END AS subject, relation, object, object_type, regexp_replace(span, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS span, confidence, chunk_id, source, 'Unknown' AS subject_type, 'regex' AS source_type FROM s) WHERE subject <> ''""")
def numeric_triples(spark: SparkSession, sf: str) -> DataFrame:
    return X.numeric_triples(table(spark, sf, "hybrid_chunks"))


@query()
def model_triples(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "hybrid_chunks").where("coalesce(chunk_type, 'text') = 'text'").select("chunk_id", "source", "content")
    return X.extract(chunks, SentenceTriples(), ["COVERS", "EXCLUDES", "REQUIRES"])


@query()
def fused_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entity_embeddings").select("id", "entity_type").dropDuplicates(["id"])
    return Rc.fused_vectors(e, edges(spark, sf)).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query()
def recursive_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    u = unit_vectors(spark, sf)
    e = table(spark, sf, "entity_embeddings").select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("degree") > 5, "hub").otherwise("leaf").alias("entity_type"))
    return Rc.recursive_taxonomy(e, u.select(F.col("id").cast("string").alias("id"), "v"), least_silhouette=0.02)[1]


@query("SELECT source, min(CASE WHEN list_contains(section_hierarchy, 'schema') THEN {'c': chunk_id, 't': substr(content, 1, 300)} END).t AS schema_text, min(CASE WHEN NOT coalesce(list_contains(section_hierarchy, 'schema'), false) AND contains(content, 'RECORD:') THEN {'c': chunk_id, 't': substr(regexp_extract(content, 'RECORD:\\s*\\n((?:[^\\n]+\\n?)+)', 1), 1, 300)} END).t AS sample FROM hybrid_chunks WHERE source IS NOT NULL GROUP BY source")
def data_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return Rc.data_fingerprint(table(spark, sf, "hybrid_chunks")).select("source", "schema_text", "sample")
