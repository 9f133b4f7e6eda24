"""Document fingerprints: a Merkle tree over sections, paragraphs and short word groups.

A text is cut without loss: paragraphs are lines with their line end, leaves are groups of at most eight words inside a
paragraph. A section ends after a blank paragraph, or after a paragraph whose digest starts with ``0`` (one in sixteen):
cuts depend on content, so an insertion moves no other section. Digests are SHA-256, cut to 128 bits below the root.

The fingerprint is ``root|sections``: the root, then the leaves as eight hex digits, joined by ``.`` in a paragraph, ``,``
in a section and ``;`` between sections. Equal roots mean equal texts; ``differing_sections`` names the branches that differ;
``likeness`` is the Jaccard share of equal leaves.

Defined results: a null text is the empty text, whose tree has no leaves; two empty texts have likeness 1. Rows that share
a ``doc_id`` are each fingerprinted. A row without ``doc_id`` has no place in the order, so its next text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lorespark.llm.common import texts

PARAGRAPH = r"[^\n]*\n|[^\n]+"
LEAF = r"(?:[^ \t\r\n]{1,40}[ \t\r\n]*){1,8}|[ \t\r\n]+"
SECTION_ENDS = "0"  # first hex digit of the digest of a paragraph that closes its section
# Ranges of ids per shuffle partition when documents are put in order.
RANGES_PER_PARTITION = 4


def _digest(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, 32)


def _paragraph(paragraph: Column) -> Column:
    """``digest of the paragraph : closes its section : leaves`` as one string."""
    leaves = F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), _digest)
    return F.struct(
        _digest(F.array_join(leaves, "")).alias("digest"),
        F.array_join(F.transform(leaves, lambda leaf: F.substring(leaf, 1, 8)), ".").alias("leaves"),
        F.trim(F.translate(paragraph, "\t\r\n", "   ")).eqNullSafe("").alias("blank"),
    )


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` in the column ``name``."""
    tree = F.transform(F.regexp_extract_all(F.col(text), F.lit(PARAGRAPH), F.lit(0)), _paragraph)

    def closed(part: str) -> Column:
        return F.array_join(F.transform(F.col("_tree"), lambda p: F.concat(
            p[part], F.when(p["blank"] | p["digest"].startswith(SECTION_ENDS), F.lit(";")).otherwise(F.lit(",")))), "")

    df = df.withColumn("_tree", tree).withColumns({"_digests": closed("digest"), "_leaves": closed("leaves")})
    sections = F.transform(F.split("_digests", ";"), _digest)
    return df.withColumn(name, F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit("|"), F.col("_leaves"))).drop(
        "_tree", "_digests", "_leaves")


def leaves_of(fingerprint: Column) -> Column:
    """Leaf hashes of a fingerprint, as a set."""
    body = F.translate(F.substring_index(fingerprint, "|", -1), ";,", "..")
    return F.array_distinct(F.filter(F.split(body, r"\."), lambda leaf: leaf != ""))


def likeness(first: Column, second: Column) -> Column:
    """Share of equal leaves of two leaf sets; 1 for two empty ones."""
    union = F.size(F.array_union(first, second))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(first, second)) / union)


def differing_sections(first: Column, second: Column) -> Column:
    """Numbers (from 0) of the sections of the first fingerprint that the second does not hold."""
    own, other = (F.split(F.substring_index(c, "|", -1), ";") for c in (first, second))
    return F.filter(F.transform(own, lambda s, i: F.when(~F.array_contains(other, s), i)), lambda i: i.isNotNull())


def with_next(df: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """``next_<column>`` of the row that follows in ascending ``order`` (ties by text); the first follows the last.

    Rows are dealt to ranges of ids (quantiles over all rows). The first rows of a range also go to the range before it, so
    every row meets its successor inside one range: one shuffle, no window over the whole table. Rows without ``order`` keep
    empty successors.
    """
    spark = df.sparkSession
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.percentile_approx(order, [k / ranges for k in range(ranges)], 10 * ranges).alias("starts"),
                   F.min(order).alias("least")).first()
    bounds = sorted({*(found["starts"] or []), found["least"]} - {None}) or [0]
    key, starts, last = F.col(order), F.array(*[F.lit(b) for b in bounds]), len(bounds) - 1

    def place(range_number, copy, wraps):
        return F.struct(range_number.cast("int").alias("range"), F.lit(copy).alias("copy"), F.lit(wraps).alias("wraps"))

    placed = df.withColumn("_own", F.size(F.filter(starts, lambda b: b <= key)) - 1).withColumn("_place", F.explode(
        F.when(key.isNull(), F.array(place(-1 - F.pmod(F.xxhash64("text"), F.lit(ranges)), False, False)))
        .when(key == bounds[0], F.array(place(F.lit(0), False, False), place(F.lit(last), True, True)))
        .when(key == F.element_at(starts, F.col("_own") + 1), F.array(place(F.col("_own"), False, False), place(F.col("_own") - 1, True, False)))
        .otherwise(F.array(place(F.col("_own"), False, False)))))
    # A copy stands behind the rows of its range; by its id it would anyway, but for the one that wraps around.
    window = Window.partitionBy("_place.range").orderBy("_place.wraps", order, F.xxhash64("text"), "text")
    led = placed.withColumns({f"next_{c}": F.lead(c).over(window) for c in carried})
    return led.where(~F.col("_place.copy")).withColumns(
        {f"next_{c}": F.when(key.isNull(), F.lit("")).otherwise(F.col(f"next_{c}")) for c in carried}).drop("_own", "_place")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: length, fingerprint, fingerprint of the edited text, and both likenesses."""
    own = with_fingerprint(texts(docs), "text", "fingerprint")
    led = with_next(own, "doc_id", ["text", "fingerprint"])
    edited = led.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    edited = with_fingerprint(edited, "edited", "edited_fingerprint").withColumns(
        {f"_{c}": leaves_of(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    return edited.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("_fingerprint"), F.col("_edited_fingerprint")).alias("near_edited"),
        likeness(F.col("_fingerprint"), F.col("_next_fingerprint")).alias("near_next"))
