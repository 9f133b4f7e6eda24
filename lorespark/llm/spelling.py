"""Spelling variants: words one edit apart, found by pairs of trie nodes.

All prefixes of the words are the nodes of a trie, all suffixes those of the trie of the reversed words; both are numbered. Leaving
out the code point at one place of a word leaves a pair (prefix node, suffix node). Two words with the same pair differ by a
replacement there. A word that joins the pair without a gap between its own prefix and suffix differs from the first by an
insertion. So an equality join on pairs of integers finds exactly the words at distance one, each pair of words once: a
replacement has one place, and of a run of equal letters only the first one counts as the inserted one. The words that share a
pair differ in one letter, so a group has at most as many members as the alphabet has letters, and one more.

The tries are numbered from sorted words. Parts of about ``PART_WORDS`` words are cut by range, so a part is bounded however
often a prefix occurs. A prefix with words in two parts is a prefix of the first word of the later one: these few nodes (one
word per part) are numbered on the driver, all others inside their part, by comparing each word with the one before.

The form of a word is its near word of largest count (ties: the smallest in code-point order) if it is at least ``RATIO`` times
as frequent; the root is the last word reached by following forms. Counts grow by the ratio each time, so chains are
short; they are followed by doubling.

Defined results: a null text has no words, a null id reads as the empty text in the hash; rows that repeat count each; very long runs of
letters are words like others (work and rows grow with their length). Without words the result is empty. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import texts, written

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, RATIO, THINNED = 7, 2, 10, 31
PART_WORDS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_NODES = 200_000


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, thinned: int = THINNED) -> DataFrame:
    """(word, n): lower-cased runs of letters; where ``thinned`` divides the hash of a run and its document, one letter goes.

    Runs shorter than a word are never rows: a run only gets shorter.
    """
    run = F.regexp_extract_all("text", F.lit(f"(?<![{LETTERS}])[{LETTERS}]{{{shortest},}}+"), F.lit(0))
    runs = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    code = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("code"), F.length("run")).cast("int")
    thin = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + F.lit(2), F.length("run")))
    words = runs.select("run", code.alias("code")).select(F.when(F.col("code") % thinned == 0, thin).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= fewest)


def common_prefix(first: str, second: str, start: int = 0) -> int:
    """Length of the common prefix of two words that are known to agree in the first ``start`` letters."""
    limit = min(len(first), len(second))
    while start < limit and first[start] == second[start]:
        start += 1
    return start


def spines(firsts: list[str]) -> tuple[list[list[int]], int]:
    """Node numbers of all prefixes of some sorted words, and the next free number."""
    paths: list[list[int]] = []
    free = 0
    for at, word in enumerate(firsts):
        same = common_prefix(firsts[at - 1], word) + 1 if at else 0
        paths.append((paths[-1][:same] if at else []) + list(range(free, free + len(word) + 1 - same)))
        free += len(word) + 1 - same
    return paths, free


def numbered(words: Iterator[tuple[int, str]], firsts: dict[int, tuple[str, list[int]]], free: int) -> Iterator[list[int]]:
    """Node numbers of the prefixes of each word; (part, word) come in order.

    ``firsts`` holds the first word of a part with its node numbers. Only a prefix of the first word of a part or of the next one
    can have words in other parts. New numbers of a part start at its own range, wide enough for 2**40 letters.
    """
    current, before, path, own, following = None, "", [], 0, None
    for part, word in words:
        if part != current:
            current, own = part, free + (part << 40)
            before, path = firsts[part]
            following = firsts.get(part + 1)
        same = common_prefix(before, word)
        path = path[:same + 1]
        shared = common_prefix(following[0], word) if following else -1
        for depth in range(same + 1, len(word) + 1):
            if depth <= shared:
                path.append(following[1][depth])
            else:
                path.append(own)
                own += 1
        before = word
        yield path


def trie_nodes(words: DataFrame, key: str, nodes: str, part_words: int = PART_WORDS) -> DataFrame:
    """``words`` (a written table, one row per key) with the array ``nodes``: numbers of the prefixes of ``key``, shortest first.

    Equal prefixes have equal numbers, different ones different numbers.
    """
    parts = max(1, -(-words.count() // part_words))
    placed = written(words.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    found = sorted((row["part"], row["first"]) for row in placed.groupBy("part").agg(F.min(key).alias("first")).collect())
    paths, free = spines([first for _, first in found])
    # Parts without words leave no gap between neighbours.
    place = {part: at for at, (part, _) in enumerate(found)}
    firsts = {at: (first, path) for at, ((_, first), path) in enumerate(zip(found, paths))}
    schema = T.StructType([*words.schema.fields, T.StructField(nodes, T.ArrayType(T.LongType()))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def incoming() -> Iterator[tuple[int, str]]:
            for batch in batches:
                pending.append(batch)
                yield from zip((place[p] for p in batch.column("part").to_pylist()), batch.column(key).to_pylist())

        values, sizes, start = array("q"), [], 0
        for path in numbered(incoming(), firsts, free):
            values.extend(path)
            sizes.append(len(path))
            if start + len(sizes) == pending[0].num_rows or len(values) > BATCH_NODES:
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, dtype=np.int64).copy()))
                own = pending[0].slice(start, len(sizes)).drop_columns(["part"])
                yield pa.RecordBatch.from_arrays([*own.columns, lists], names=schema.names)
                start += len(sizes)
                values, sizes = array("q"), []
                if start == pending[0].num_rows:
                    pending.pop(0)
                    start = 0

    return placed.repartition(parts, "part").sortWithinPartitions("part", key).mapInArrow(number, schema)


def node_pairs(words: DataFrame) -> DataFrame:
    """(before, after, word, n, place, gap): the pairs around each letter (``gap``) and between letters of each word."""
    size = F.length("word")
    around = F.arrays_zip(F.slice("forward", 1, size).alias("before"), F.reverse(F.slice("backward", 1, size)).alias("after"))
    between = F.arrays_zip(F.col("forward").alias("before"), F.reverse("backward").alias("after"))

    def rows(pairs: Column, gap: bool) -> DataFrame:
        exploded = words.select("word", "n", F.posexplode(pairs).alias("place", "pair"))
        return exploded.select("pair.before", "pair.after", "word", "n", "place", F.lit(gap).alias("gap"))

    return rows(around, True).unionByName(rows(between, False))


def near_words(pairs: DataFrame) -> DataFrame:
    """(word, n_near, best): per pair of nodes and word, how many near words meet there, and the best of them."""
    first_of_run = lambda m: (m["place"] == 0) | (F.substring(m["word"], m["place"] + 1, F.lit(1)) != F.substring(m["word"], m["place"], F.lit(1)))
    members = pairs.groupBy("before", "after").agg(F.collect_list(F.struct("word", "n", "place", "gap")).alias("members")).where(F.size("members") > 1)
    members = members.select(F.transform("members", lambda m: F.struct(
        m["word"].alias("word"), m["n"].alias("n"), m["gap"].alias("gap"), (m["gap"] & first_of_run(m)).alias("counts"))).alias("members"))

    def others(member: Column) -> Column:
        near = lambda m: (m["word"] != member["word"]) & F.when(member["gap"], m["gap"] | member["counts"]).otherwise(m["counts"])
        return F.transform(F.filter("members", near), lambda m: F.struct((-m["n"]).alias("n"), m["word"].alias("word")))

    met = members.select(F.explode(F.transform("members", lambda m: F.struct(m["word"].alias("word"), others(m).alias("near")))).alias("m"))
    return met.select("m.word", F.size("m.near").cast("long").alias("n_near"), F.array_min("m.near").alias("best")).where("n_near > 0")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of their chain of forms, by doubling."""
    ends = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = written(ends.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        ends = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return ends


def spelling_variants(
    docs: DataFrame, *, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO, thinned: int = THINNED, part_words: int = PART_WORDS,
) -> DataFrame:
    """Per word: its form, the root of its chain, its count, how many words are near, and the count of the form."""
    words = written(word_counts(docs, shortest, fewest, thinned))
    forward = trie_nodes(words, "word", "forward", part_words).withColumn("drow", F.reverse("word"))
    both = trie_nodes(written(forward), "drow", "backward", part_words)
    near = near_words(node_pairs(written(both)))
    bare = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<n: bigint, word: string>").alias("best"), "n")
    counted = near.withColumn("n", F.lit(None).cast("long")).unionByName(bare).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    chosen = -F.col("best.n") >= ratio * F.col("n")
    forms = written(counted.select("word", F.when(chosen, F.col("best.word")).alias("form"), "n", "n_near", F.when(chosen, -F.col("best.n")).alias("form_n")))
    return forms.join(roots(forms.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
