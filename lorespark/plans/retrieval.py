"""Hybrid retrieval for tables of questions: vectors, words, fusion, sections, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import name_key_column
from lorespark.operators import fusion, lexical, vectors
from lorespark.operators.ranking import ranked_topk
from lorespark.operators.sections import SECTION_WINDOW, expand_sections
from lorespark.session import written

DEFAULT_RESULTS = 5
RETRY_RESULTS = 8
RETRY_HINT = "\nIndice sur l'information manquante, à utiliser uniquement pour la recherche documentaire : "
Scorer = Callable[[Column, Column], Column]


def canonical_scope(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scope names as the corpus writes them. An unknown name stays: its search is empty, never global."""
    known = chunks.select(F.col("scope").alias("known_scope")).distinct().withColumn("scope_key", name_key_column(F.col("known_scope")))
    known = known.groupBy("scope_key").agg(F.min("known_scope").alias("known_scope"))
    keyed = questions.withColumn("scope_key", F.when(F.col("scope").isNotNull(), name_key_column(F.col("scope"))))
    return keyed.join(known, "scope_key", "left").withColumn("scope", F.coalesce("known_scope", "scope")).drop("scope_key", "known_scope")


def candidates(chunks: DataFrame, questions: DataFrame, n_fused: int) -> tuple[DataFrame, DataFrame]:
    """Fused candidates and structural candidates of scoped and global questions."""
    index = written(lexical.lexical_index(chunks, "doc_id", "text", "scope"))
    corpus = chunks.select("doc_id", "vector", "scope")
    parts = []
    for scoped, own in ((True, questions.filter("scope IS NOT NULL")), (False, questions.filter("scope IS NULL"))):
        near = vectors.nearest(corpus, own.select("query_id", "vector", "scope"), scope=scoped)
        words = lexical.bm25_topk(index, own, query_id="query_id", text="question", scope="scope" if scoped else None)
        parts.append(fusion.reciprocal_rank_fusion(near, words, n_fused))
    sections = fusion.section_candidates(
        chunks.select("scope", "section_path", "chunk_number", "doc_id"), questions.select("query_id", "scope", "question"))
    return parts[0].unionByName(parts[1]), sections


def retrieve(
    chunks: DataFrame, questions: DataFrame, scorer: Scorer = fusion.lexical_overlap, n_results: int = DEFAULT_RESULTS, rerank: bool = True,
) -> DataFrame:
    """Best chunks of each question.

    ``chunks`` holds (doc_id, scope, source_file, section_path, chunk_number,
    section_chunk_number, text, vector), ``questions`` (query_id, question, scope,
    vector). ``scorer`` compares the question with a text; without re-ranking the
    fusion order is kept.
    """
    questions = canonical_scope(questions, chunks)
    fused, sections = candidates(chunks, questions, fusion.RRF_CANDIDATES if rerank else n_results)
    detail = chunks.select("doc_id", "scope", "source_file", "section_path", "section_chunk_number", "text")
    if not rerank:
        kept = fused.filter(F.col("rrf_rank") <= n_results).withColumn("reranker_rank", F.col("rrf_rank"))
        return kept.join(detail, "doc_id")
    pool = fusion.merge_candidates(fused, sections).join(detail, "doc_id").join(questions.select("query_id", "question"), "query_id")
    return fusion.rerank(pool, scorer(F.col("question"), F.col("text")), n_results)


def context(results: DataFrame, chunks: DataFrame, window: int = SECTION_WINDOW) -> DataFrame:
    """Chunks around the best result of each question, inside its exact section."""
    best = fusion.best_sections(results).filter("section_choice = 1")
    seeds = best.select("query_id", "source_file", "section_path", "section_chunk_number", F.col("doc_id").alias("expanded_from"))
    expanded = expand_sections(
        seeds.drop("query_id").distinct(), chunks.select("source_file", "section_path", "section_chunk_number", "doc_id"),
        ["source_file", "section_path"], "section_chunk_number", "doc_id", window)
    asked = seeds.select("query_id", "expanded_from")
    return asked.join(expanded, "expanded_from").join(chunks.select("doc_id", "text"), "doc_id")


def retry_context(
    chunks: DataFrame, questions: DataFrame, scorer: Scorer = fusion.lexical_overlap, window: int = SECTION_WINDOW,
) -> DataFrame:
    """Context of the best section other than ``excluded_section``; nothing when there is none.

    ``questions`` also holds ``reason`` (what was missing) and ``excluded_section``.
    """
    hint = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(RETRY_HINT), F.trim("reason"))).otherwise("")
    asked = questions.withColumn("question", F.concat(F.trim("question"), hint))
    found = retrieve(chunks, asked, scorer, n_results=RETRY_RESULTS)
    excluded = asked.select("query_id", F.trim(F.coalesce("excluded_section", F.lit(""))).alias("excluded"))
    other = found.join(excluded, "query_id").filter((F.col("excluded") == "") | (F.col("section_path") != F.col("excluded")))
    first = ranked_topk(other.drop("reranker_rank"), ["query_id"], [F.desc("reranker_score"), F.asc("pool_rank")], 1, "reranker_rank")
    return context(first, chunks, window)
