"""The retrieval pipeline over a whole table of questions: search, filters, spans, rerank, header, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..operators import retrieval


def retrieve(cfg: Config, index: DataFrame, queries: DataFrame, documents: DataFrame, source: str) -> DataFrame:
    """(q_id, question, chunk_id, rank, dist, context, metadata) of the top_k contexts.

    index: chunk_id, embedding and chunk metadata with `source`; queries: q_id, question, q_vec. The cut of 20 comes
    before the filters and is never filled up again; BM25 sees the bare text, headers come after it.
    """
    meta = index.drop("embedding")
    hits = retrieval.topk(index.select("chunk_id", "embedding"), queries).join(meta, "chunk_id")
    if cfg.metadata_filter and cfg.chunking_strategy == "structure":
        hits = retrieval.filter_metadata(hits)
    hits = retrieval.filter_threshold(hits, cfg.similarity_threshold)
    hits = retrieval.load_spans(hits, documents, source).join(queries.select("q_id", "question"), "q_id")
    if cfg.post_bm25_rerank:
        scored = retrieval.bm25_rerank(hits.select("q_id", "question", F.col("chunk_id").alias("c_id"), F.col("rank").alias("rank0"), F.col("span_text").alias("text")))
        hits = hits.drop("rank").join(scored.select("q_id", F.col("c_id").alias("chunk_id"), "rank"), ["q_id", "chunk_id"])
    if cfg.metadata_enhancement:
        hits = retrieval.context_header(hits)
    else:
        hits = hits.withColumn("context", F.col("span_text"))
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))
    return hits.withColumn("rank", at).filter(F.col("rank") <= cfg.top_k)
