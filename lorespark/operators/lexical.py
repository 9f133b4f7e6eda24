"""BM25 ranking of documents for many queries, by blocks of postings.

A block holds the postings of one term in one range of documents, and the largest contribution the term makes there. Ranges are
shares of a scope by hashed number, of about ``RANGE_DOCUMENTS`` documents, so no block grows with its term. Queries first meet the heads
of blocks: the sum of the largest contributions bounds every score in a range. The ranges of the largest bounds are scored first;
the ``k``-th best score they yield is a floor, and only ranges whose bound reaches it are scored too. Both kinds of join are
equality joins on terms, spread over slices of ranges, so queries never pass through the driver and a frequent term is no hot key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import TOKEN_PATTERN, token_counts_column, tokens_column
from lorespark.operators.ranking import ranked_topk
from lorespark.operators.topk_scan import SCAN_SCHEMA, SCORE_DECIMALS
from lorespark.session import written

# Fixed values of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
DEFAULT_CANDIDATES = 200
RANGE_DOCUMENTS, SLICES, SLICE_QUERIES = 256, 16, 256
INDEX_SCHEMA = "doc_id long, scope string, counts array<struct<term: string, tf: int>>, length int"
ROWS_COUNTED = 500  # texts whose words are in memory at once
# Room for the rounding of scores and bounds.
ROUNDING = 2e-6


def lexical_index(documents: DataFrame, doc_id: str, text: str, scope: str | None = None) -> DataFrame:
    """(doc_id, scope, counts, length): token counts of each document, computed inside its row.

    Letters are lowered by Spark; the words are counted batch by batch, because lambdas over the words of a text are interpreted.
    """
    scope_column = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    return documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), scope_column.alias("scope"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    ).mapInArrow(_counted, INDEX_SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the words of their lower-cased ``text`` counted, ``ROWS_COUNTED`` texts at a time."""
    words = re.compile(TOKEN_PATTERN).findall
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_COUNTED):
            part = batch.slice(at, ROWS_COUNTED)
            counts = [Counter(words(text)) for text in part.column("text").to_pylist()]
            bounds = np.cumsum([0] + [len(count) for count in counts], dtype=np.int32)
            items = pa.StructArray.from_arrays([
                pa.array([term for count in counts for term in count], pa.string()),
                pa.array([tf for count in counts for tf in count.values()], pa.int32())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("scope"), pa.ListArray.from_arrays(pa.array(bounds), items),
                pa.array([count.total() for count in counts], pa.int32())], names=["doc_id", "scope", "counts", "length"])


def term_totals(index: DataFrame) -> DataFrame:
    """(term, df, occurrences), and one row without term for the corpus size and total length.

    The corpus row travels with the terms of each document, so everything comes out of
    the same pass and the same aggregation.
    """
    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("length").alias("tf")))
    rows = index.select(F.explode(F.concat(marker, F.col("counts"))).alias("item"))
    return rows.groupBy("item.term").agg(F.count(F.lit(1)).alias("df"), F.sum("item.tf").alias("occurrences"))


def term_statistics(totals: DataFrame) -> DataFrame:
    """(term, df, raw_idf, documents, mean_length) over the whole corpus."""
    corpus = totals.filter("term IS NULL")
    documents = corpus.select("df").scalar()
    mean_length = corpus.select(F.col("occurrences") / F.col("df")).scalar()
    return totals.filter("term IS NOT NULL").select(
        "term", "df", (F.log(documents - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf"),
        documents.alias("documents"), mean_length.alias("mean_length"),
    )


def query_weights(queries: DataFrame, statistics: DataFrame, query_id: str, text: str, scope: str | None = None) -> DataFrame:
    """(query_id, scope, term, weight, mean_length): one row per distinct token of a query.

    A token repeated in the query counts as often as it is written. A negative idf is
    replaced by a share of the mean idf of the whole vocabulary. A query without any
    known token keeps one row without term.
    """
    mean_idf = statistics.agg(F.avg("raw_idf")).scalar()
    mean_length = statistics.agg(F.max("mean_length")).scalar()
    idf = F.when(F.col("raw_idf") < 0, EPSILON * mean_idf).otherwise(F.col("raw_idf"))
    scope_column = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    tokens = queries.select(
        F.col(query_id).cast("long").alias("query_id"), scope_column.alias("scope"),
        F.explode_outer(token_counts_column(tokens_column(F.coalesce(F.col(text), F.lit(""))))).alias("item"),
    ).select("query_id", "scope", "item.term", "item.tf")
    known = statistics.select("term", idf.alias("idf"))
    return tokens.join(known, "term", "left").select(
        "query_id", "scope", "term", F.coalesce(F.col("tf") * F.col("idf"), F.lit(0.0)).alias("weight"),
        mean_length.alias("mean_length"),
    )


def posting_blocks(index: DataFrame, totals: DataFrame, terms: DataFrame | None = None, scoped: bool = True, range_documents: int = RANGE_DOCUMENTS) -> DataFrame:
    """(term, scope_key, range, slice, best, postings): postings of each term and range with their contributions for a weight of one.

    With ``terms`` (term, number) only the blocks of these terms are built, by number: other postings never reach the exchange.
    """
    mean_length = totals.filter("term IS NULL").select(F.col("occurrences") / F.col("df")).scalar()
    rows = index.select("doc_id", _scope_key(F.col("scope") if scoped else F.lit(None).cast("string")).alias("scope_key"), "length", "counts")
    # Few scopes hold all documents: their sizes are written, so the join knows that they are few and no document moves to its scope.
    sizes = written(rows.groupBy("scope_key").agg(F.ceil(F.count(F.lit(1)) / range_documents).alias("ranges")))
    ranged = rows.join(sizes, "scope_key").withColumn("range", F.pmod(F.xxhash64("doc_id"), F.col("ranges")).cast("int"))
    postings = ranged.select("doc_id", "scope_key", "length", "range", F.explode("counts").alias("item")).select(
        "doc_id", "scope_key", "length", "range", "item.term", "item.tf")
    if terms is not None:
        postings = postings.join(terms, "term").drop("term").withColumnRenamed("number", "term")
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    return postings.withColumn("share", share).groupBy("term", "scope_key", "range").agg(
        F.max("share").alias("best"), F.collect_list(F.struct("doc_id", "share")).alias("postings")).withColumn("slice", F.col("range") % SLICES)


def _scope_key(scope: Column) -> Column:
    """A scope as a join key that keeps a missing scope apart from an empty one."""
    return F.coalesce(F.concat(F.lit("+"), scope), F.lit("-"))


def _scores(chosen: DataFrame, weighted: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score) of the documents with a query token in the chosen (query_id, scope_key, range).

    The blocks of a range and a slice of its queries meet as one row: a range holds a bounded number of documents, a slice a
    bounded number of queries. Where more than ``k`` documents of a range score above zero, the best ``k`` of them are rows.
    """
    own = ["scope_key", "range"]
    asked = chosen.select("query_id", *own).join(weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "query_id")
    sizes = asked.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / SLICE_QUERIES).alias("slices"))
    sliced = asked.join(sizes, own).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("slices")))
    slices = sliced.groupBy(*own, "part").agg(F.collect_list(F.struct("query_id", "terms")).alias("queries")).drop("part")
    ranges = blocks.groupBy(*own).agg(F.collect_list(F.struct("term", "postings")).alias("blocks"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _range_scores(batch.column("blocks").slice(row, 1).flatten(), batch.column("queries").slice(row, 1).flatten(), k)

    return ranges.join(slices, own).select("blocks", "queries").mapInArrow(score, SCAN_SCHEMA)


def _range_scores(blocks: pa.StructArray, queries: pa.StructArray, k: int) -> pa.RecordBatch:
    """Sparse product of the weights of some queries and the postings of one range."""
    postings = blocks.field("postings")
    own_term = blocks.field("term").to_numpy()[pc.list_parent_indices(postings).to_numpy()]
    items = postings.flatten()
    documents, place = np.unique(items.field("doc_id").to_numpy(), return_inverse=True)
    share = items.field("share").to_numpy()
    ids, terms = queries.field("query_id").to_numpy(), queries.field("terms")
    of_query, weights = pc.list_parent_indices(terms).to_numpy(), terms.flatten()
    order = np.argsort(weights.field("term").to_numpy(), kind="stable")
    term, of_query, weight = weights.field("term").to_numpy()[order], of_query[order], weights.field("weight").to_numpy()[order]
    # The weights of a term stand side by side; every posting meets all of them.
    first, last = np.searchsorted(term, own_term, "left"), np.searchsorted(term, own_term, "right")
    fan = last - first
    at = np.repeat(first - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
    cells = np.repeat(place, fan) + of_query[at] * len(documents)
    scores = np.bincount(cells, np.repeat(share, fan) * weight[at], len(ids) * len(documents)).reshape(len(ids), -1).round(SCORE_DECIMALS)
    kept = np.bincount(cells, minlength=scores.size).reshape(scores.shape) > 0
    for query in np.flatnonzero((kept & (scores > 0)).sum(axis=1) > k):
        kept[query] &= scores[query] > 0
        held = np.flatnonzero(kept[query])
        best = held[np.lexsort((documents[held], -scores[query, held]))[:k]]
        kept[query] = False
        kept[query, best] = True
    query, document = np.nonzero(kept)
    return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(documents[document]), pa.array(scores[kept])], names=["query_id", "doc_id", "score"])


def bm25_topk(
    index: DataFrame, queries: DataFrame, *, query_id: str, text: str, k: int = DEFAULT_CANDIDATES, scope: str | None = None,
    range_documents: int = RANGE_DOCUMENTS,
) -> DataFrame:
    """(query_id, doc_id, score, bm25_rank): best ``k`` documents of each query.

    Term rarity is measured on the whole corpus; a scope only restricts which documents
    are ranked (a query without scope ranks those without scope). Documents without any
    query token score zero and still fill the list, before documents with a negative score.
    """
    return ranked_blocks(index, queries, query_id=query_id, text=text, k=k, scope=scope, range_documents=range_documents)[0]


def ranked_blocks(
    index: DataFrame, queries: DataFrame, *, query_id: str, text: str, k: int = DEFAULT_CANDIDATES, scope: str | None = None,
    range_documents: int = RANGE_DOCUMENTS,
) -> tuple[DataFrame, DataFrame]:
    """The ranking of ``bm25_topk``, and per query how many blocks its terms have and how many of them were read."""
    totals = written(term_totals(index))
    weights = written(query_weights(queries, term_statistics(totals), query_id, text, scope))
    used = weights.filter("term IS NOT NULL AND weight <> 0")
    terms = written(used.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    weighted = written(used.join(terms, "term").select("query_id", _scope_key(F.col("scope")).alias("scope_key"), F.col("number").alias("term"), "weight"))
    blocks = written(posting_blocks(index, totals, terms, scope is not None, range_documents))
    spread = weighted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    hits = spread.join(blocks.select("term", "scope_key", "range", "slice", "best"), ["term", "scope_key", "slice"])
    keys = ["query_id", "scope_key", "range"]
    bounds = written(hits.groupBy(*keys).agg(F.sum(F.greatest(F.col("weight") * F.col("best"), F.lit(0.0))).alias("bound"), F.count(F.lit(1)).alias("blocks")))
    # First the ranges of the largest bounds: twice as many documents as are wanted, some ranges at least.
    first = ranked_topk(bounds, ["query_id"], [F.desc("bound"), F.asc("scope_key"), F.asc("range")], max(4, -(-2 * k // range_documents)), "place").drop("place")
    found = written(_scores(first, weighted, blocks, k))
    reached = ranked_topk(found.filter("score > 0"), ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "place").filter(F.col("place") == k)
    floor = reached.select("query_id", F.col("score").alias("floor"))
    further = bounds.join(first.select(*keys), keys, "left_anti").join(floor, "query_id", "left").filter(
        F.col("floor").isNull() | (F.col("bound") + ROUNDING >= F.col("floor")))
    further = written(further)
    scores = written(found.unionByName(_scores(further, weighted, blocks, k)))
    visits = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(
        first.select("query_id", "blocks").unionByName(further.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("blocks_read")), "query_id")
    order = [F.desc("score"), F.asc("doc_id")]
    return ranked_topk(scores.unionByName(_zeros(index, weights, scores, k, scope is not None)), ["query_id"], order, k, "bm25_rank"), visits


def _zeros(index: DataFrame, weights: DataFrame, scores: DataFrame, k: int, scoped: bool) -> DataFrame:
    """(query_id, doc_id, 0.0): documents without a query token, for queries with fewer than ``k`` documents above zero.

    Of the first ``k`` documents and as many more as such a query has matched, at least ``k`` are not matched by it, if there are so many.
    """
    known = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("score") > 0).alias("above"))
    short = weights.select("query_id", "scope").distinct().join(known, "query_id", "left").filter(F.coalesce("above", F.lit(0)) < k)
    most = short.agg(F.max(F.coalesce("matched", F.lit(0)))).first()[0]
    if most is None:
        return scores.limit(0)
    rows = index.select("doc_id", F.col("scope") if scoped else F.lit(None).cast("string").alias("scope"))
    leading = ranked_topk(rows, ["scope"], [F.asc("doc_id")], k + most, "place")
    pairs = short.alias("q").join(leading.alias("d"), F.col("q.scope").eqNullSafe(F.col("d.scope")) if scoped else F.lit(True)).select("query_id", "doc_id")
    return pairs.join(scores, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
