"""The whole way from chunks to a graph, as one program of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import Embedder, LLMClient, embed_column
from ..operators import extraction as X
from ..operators import filters as Fl
from ..operators import linkage as L
from ..operators import model_steps as M
from ..operators import normalize as N
from ..operators import records as R
from ..operators import resolution as Re
from ..session import materialize


#: Fixed value: cosine of names from which relations may be one.
RELATION_SIMILARITY = 0.85


@dataclass
class Result:
    triples: DataFrame
    links: DataFrame
    removed: DataFrame


def chunks_to_triples(chunks: DataFrame, client: LLMClient, vocabulary: list[str], embedder: Embedder | None = None) -> Result:
    """Structured and model triples of chunks, filtered, normalized, resolved and linked.

    What models said is written before it is used, so it is never asked for twice.
    """
    structured, prose, _ = R.extract_structured(chunks)
    said = X.extract(prose.select("chunk_id", "source", "content"), client, vocabulary)
    taken_apart = X.decompose(prose.select("chunk_id", "source", "content"), said, client, vocabulary)
    numbers = X.numeric_triples(prose)
    raw = structured
    for more in (said, taken_apart, numbers):
        raw = raw.unionByName(more, allowMissingColumns=True)
    # The order in which the first of equal triples counts: by origin and content, the same on every run.
    origin = F.when(F.col("source_type") == "structured", "0").when(F.col("source_type") == "llm", "1").when(F.col("source_type") == "decompose", "2").otherwise("3")
    raw = materialize(raw.withColumn("seq", F.concat_ws("\u0001", origin, "chunk_id", "subject", "relation", "object", "span")), "raw-triples")
    judged = Fl.placeholder_reason(Fl.first_of_key(raw))
    sense = Fl.semantic_reason(F.col("relation"), F.col("object"), F.col("object_type"), F.col("subject_type"), F.col("source_type"))
    judged = materialize(judged.withColumn("reason", F.coalesce("reason", sense)), "judged-triples")
    kept = judged.where("reason is null").drop("reason")
    said_names = M.canonical_relations(kept, vocabulary, client)
    kept = materialize(N.apply_relation_map(kept, said_names), "named-triples")
    relations = kept.select(F.col("relation").alias("id")).where("id is not null").distinct()
    alike = Re.cosine_pairs(embed_column(relations, "id", embedder).where(F.exists("v", lambda x: x != 0)), RELATION_SIMILARITY)
    kept = N.apply_relation_map(kept, N.relation_merges(kept, alike, RELATION_SIMILARITY))
    names = embed_column(Re.candidates(kept), "id", embedder)
    resolved = materialize(Re.resolve(kept, Re.cosine_pairs(names.where(F.exists("v", lambda x: x != 0)))), "resolved-triples")
    types = L.record_types(resolved).select("type")
    links = L.link(L.profiles(resolved).join(types, "type", "left_semi"))
    removed = judged.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return Result(resolved, links, removed)
