"""End-to-end plans: collection to ranked results, one tier or two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..operators import chunking, dedup, retrieval
from ..storage import materialize


def corpus_index(docs: DataFrame, paragraph: str = chunking.PARAGRAPH, overrides: dict[str, str] | None = None) -> tuple[DataFrame, retrieval.Index]:
    """Chunks without duplicates and their index, from docs (path, title, folder, body); chunks are cut once and written to the shared folder."""
    chunks = materialize(chunking.corpus_chunks(docs, paragraph=paragraph, overrides=overrides), "chunks", keep=True)
    losers = dedup.dedup_losers(chunks, page="page_path")
    kept = chunks.join(losers.select(F.col("page").alias("page_path"), "chunk_index"), ["page_path", "chunk_index"], "left_anti")
    kept = kept.withColumn("chunk_id", F.concat_ws(":", "page_address", F.col("chunk_index").cast("string")))
    return kept, retrieval.build_index(kept, page="page_path", text="contextualized_text")


def _told(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, score, rank) with the rest of chunks (chunk_id, page, ...); ranks are dealt anew.

    An id may be of chunks of several pages, for addresses are short hashes: they follow each other by page.
    """
    return hits.join(chunks, "chunk_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "page")))


def search_corpus(chunks: DataFrame, index: retrieval.Index, queries: DataFrame, k: int = retrieval.TOP, bonus: dict[str, float] | None = None, candidates: int = retrieval.CANDIDATES) -> DataFrame:
    """Corpus tier without vectors: BM25 over-fetched, normalised, tier bonus, at most two chunks of a page."""
    hits = retrieval.bm25_top_k(index, retrieval.query_terms(queries), max(candidates, k + 10), pages=False)
    hits = _told(hits, chunks.select("chunk_id", F.col("page_path").alias("page"), "tier", "raw_text"))
    return retrieval.diversify(retrieval.with_tier_bonus(hits, "score", True, bonus=bonus), k)


def search_documents(docs: DataFrame, queries: DataFrame, k: int = retrieval.TOP, paragraph: str = chunking.PARAGRAPH, overrides: dict[str, str] | None = None, bonus: dict[str, float] | None = None, candidates: int = retrieval.CANDIDATES) -> DataFrame:
    """What ``search_corpus`` finds over ``corpus_index(docs)``, without making the index: for one set of queries.

    Chunks are written once, in the columns that are needed; losers are taken out of the table of lengths and query terms.
    """
    chunks = chunking.corpus_chunks(docs, paragraph=paragraph, overrides=overrides).select("page_path", "page_address", "chunk_index", "raw_text", "prefix", "tier")
    chunks = materialize(chunks, "chunks", keep=True)
    chunk_id = F.concat_ws(":", "page_address", F.col("chunk_index").cast("string"))
    losers = dedup.dedup_losers(chunks, page="page_path").select(F.col("page").alias("page_path"), "chunk_index")
    said = chunks.select(chunk_id.alias("chunk_id"), "page_path", "chunk_index", F.concat(F.col("prefix"), F.lit("\n\n"), F.col("raw_text")).alias("said"))
    hits = retrieval.search(said, queries, max(candidates, k + 10), page="page_path", text="said", without=losers, pages=False)
    # an id may be of several chunks, of which losers are none
    found = chunks.withColumn("chunk_id", chunk_id).join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    found = materialize(found.join(losers, ["page_path", "chunk_index"], "left_anti").select("chunk_id", F.col("page_path").alias("page"), "tier", "raw_text"), "found", keep=True)
    return retrieval.diversify(retrieval.with_tier_bonus(_told(hits, found), "score", True, bonus=bonus), k)


def search_pages(index: retrieval.Index, queries: DataFrame, k: int = retrieval.TOP) -> DataFrame:
    """Page tier without vectors: BM25 candidates, cut to k, best chunk of each page."""
    hits = retrieval.bm25_top_k(index, retrieval.query_terms(queries))
    return retrieval.page_collapse(hits.where(F.col("rank") <= k))


def both_tiers(wiki: DataFrame, corpus: DataFrame) -> DataFrame:
    """Both result lists under one roof, each ranked on its own."""
    return wiki.withColumn("source_tier", F.lit("wiki")).unionByName(corpus.withColumn("source_tier", F.lit("corpus")), allowMissingColumns=True)


def search_both(spark: SparkSession, queries: DataFrame, wiki: tuple[str, retrieval.Index | None], corpus: tuple[str, retrieval.Index | None], corpus_chunks: DataFrame | None = None, k: int = retrieval.TOP) -> tuple[dict[str, str], DataFrame | None]:
    """({tier: status}, results) of both tiers, whose indexes come with their status from ``sinks.ensure_index``.

    An unavailable tier has no rows; scores of the two are never mixed. None as results: neither tier is there.
    """
    parts = []
    if wiki[1] is not None:
        parts.append(search_pages(wiki[1], queries, k).withColumn("source_tier", F.lit("wiki")))
    if corpus[1] is not None and corpus_chunks is not None:
        parts.append(search_corpus(corpus_chunks, corpus[1], queries, k).withColumn("source_tier", F.lit("corpus")))
    found = parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) == 2 else parts[0] if parts else None
    return {"wiki": wiki[0], "corpus": corpus[0] if corpus_chunks is not None else "unavailable"}, found


def stage_counts(candidates: DataFrame, reranked: DataFrame, collapsed: DataFrame) -> DataFrame:
    """(query_id, candidates, reranked, collapsed)."""
    one = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    return one(candidates, "candidates").join(one(reranked, "reranked"), "query_id", "left").join(one(collapsed, "collapsed"), "query_id", "left")
