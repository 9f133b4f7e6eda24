"""Markdown sections, chunks and section windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.text import let

# Fixed values of the chunker.
CHUNK_SIZE = 900
CHUNK_OVERLAP = 120
MINIMUM_BODY = 350
DOCUMENTS_AT_ONCE = 128
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
SECTION_WINDOW = 8
CHUNK_ID_PREFIX = "pokemon"
WHOLE_DOCUMENT = "Document"

LINE_BREAK = "\r\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
HEADING = r"^\s*(#{1,6})\s+(.+?)\s*$"
SECTION_TYPE = "array<struct<path:array<string>,body:string>>"


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def markdown_sections(text: Column) -> Column:
    """``array<struct<path, body>>`` of a Markdown text, without empty bodies.

    The heading stack is folded inside the row: a heading closes the open ones of its
    level and below, and a first-level heading closes them all.
    """
    no_path = F.array().cast("array<string>")

    def build(lines: Column) -> Column:
        marked = F.transform(lines, lambda line, i: F.struct(
            i.alias("at"), F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
            F.trim(F.regexp_replace(F.regexp_extract(line, HEADING, 2), r"\s+#+\s*$", "")).alias("title")))
        headings = F.filter(marked, lambda h: h["level"] > 0)
        stack_type = "array<struct<level:int,title:string>>"
        start = F.struct(
            F.array().cast(stack_type).alias("stack"),
            F.array(F.struct(F.lit(-1).alias("at"), no_path.alias("path"))).alias("marks"))

        def step(state: Column, heading: Column) -> Column:
            opened = F.concat(
                F.filter(state["stack"], lambda open_: open_["level"] < heading["level"]),
                F.array(F.struct(heading["level"].alias("level"), heading["title"].alias("title"))))
            stack = F.when(heading["level"] == 1, F.array().cast(stack_type)).otherwise(opened)
            path = F.transform(stack, lambda open_: open_["title"])
            return F.struct(
                stack.alias("stack"),
                F.concat(state["marks"], F.array(F.struct(heading["at"].alias("at"), path.alias("path")))).alias("marks"))

        marks = F.aggregate(headings, start, step, lambda state: state["marks"])

        def cut(found: Column) -> Column:
            bodies = F.transform(found, lambda mark, k: F.struct(
                mark["path"].alias("path"),
                strip(F.array_join(F.transform(
                    F.slice(lines, mark["at"] + 2,
                            F.coalesce(F.get(found, k + 1)["at"], F.size(lines)) - mark["at"] - 1),
                    lambda line: F.regexp_replace(line, r"\s+$", "")), "\n")).alias("body")))
            return F.filter(bodies, lambda section: section["body"] != "")

        return let(marks, cut)

    sections = let(lines_of(text), build)
    whole = F.array(F.struct(no_path.alias("path"), strip(text).alias("body")))
    return let(sections, lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


def split_text(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Recursive splitting: cut on the coarsest separator present, glue small pieces back up to ``size``."""
    position = next(i for i, mark in enumerate(separators) if mark == "" or mark in text)
    mark, finer = separators[position], separators[position + 1:]
    pieces = list(text) if mark == "" else _keep_separator(text, mark)
    result: list[str] = []
    small: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        result += _glue(small, size, overlap)
        small = []
        result += split_text(piece, size, overlap, finer) if finer else [piece]
    return result + _glue(small, size, overlap)


def _keep_separator(text: str, mark: str) -> list[str]:
    first, *others = text.split(mark)
    return [piece for piece in [first, *[mark + other for other in others]] if piece]


def _glue(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy concatenation; each new chunk starts with up to ``overlap`` characters of the last one."""
    chunks, window, width = [], [], 0
    for piece in pieces:
        if width + len(piece) > size:
            chunks.append("".join(window).strip())
            while window and (width > overlap or width + len(piece) > size):
                width -= len(window.pop(0))
        window.append(piece)
        width += len(piece)
    chunks.append("".join(window).strip())
    return [chunk for chunk in chunks if chunk]


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def split_bodies(bodies: pa.Array, sizes: pa.Array) -> pa.Array:
    """Pieces of the long bodies of each document; short bodies arrive as null and stay null.

    The texts of ``DOCUMENTS_AT_ONCE`` documents at a time are Python strings, not those of the whole batch.
    """
    def one(texts, limits):
        return [
            None if text is None else split_text(text, int(limit), min(CHUNK_OVERLAP, max(0, int(limit) // 4)))
            for text, limit in zip(texts, limits)
        ]
    kind = pa.list_(pa.list_(pa.string()))
    slices = []
    for at in range(0, len(bodies), DOCUMENTS_AT_ONCE):
        texts, limits = (column.slice(at, DOCUMENTS_AT_ONCE).to_pylist() for column in (bodies, sizes))
        slices.append(pa.array([one(*row) for row in zip(texts, limits)], kind))
    return pa.concat_arrays(slices) if slices else pa.array([], kind)


def context_header(title: Column, path: Column) -> Column:
    """Header lines that place a chunk: entity, main section, subsection, path."""
    lines = F.array(
        F.concat(F.lit("Pokémon : "), title),
        F.when(F.size(path) > 0, F.concat(F.lit("Section principale : "), F.get(path, F.lit(0)))),
        F.when(F.size(path) > 1, F.concat(F.lit("Sous-section : "), F.element_at(path, -1))),
        F.when(F.size(path) > 0, F.concat(F.lit("Chemin : "), F.array_join(path, " > "))),
    )
    return F.array_join(F.array_compact(lines), "\n")


def chunk_documents(documents: DataFrame, *, source_file: str, title: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk with its identifier, section metadata and search text.

    Sections, pieces and numbers all come from inside the document row: chunking needs no
    shuffle, and only the bodies that must be split reach Python.
    """
    sections = markdown_sections(F.col(text))
    base = documents.filter(F.col(text).isNotNull() & (strip(F.col(text)) != "")).select(
        F.col(source_file).alias("source_file"), F.col(title).alias("title"), *keep, sections.alias("sections"))
    sizes = F.transform("sections", lambda s: F.greatest(
        F.lit(MINIMUM_BODY), CHUNK_SIZE - F.length(context_header(F.col("title"), s["path"])) - 2))
    base = base.withColumn("sizes", sizes)
    long_bodies = F.transform("sections", lambda s, i: F.when(F.length(s["body"]) > F.get(F.col("sizes"), i), s["body"]))
    base = base.withColumn("pieces", split_bodies(long_bodies, F.col("sizes")))
    parts = F.flatten(F.transform("sections", lambda s, i: F.transform(
        F.coalesce(F.get(F.col("pieces"), i), F.array(s["body"])),
        lambda piece, n: F.struct(s["path"].alias("path"), n.alias("section_chunk_number"), piece.alias("text")))))
    rows = base.select("source_file", "title", *keep, F.posexplode(parts).alias("chunk_number", "part"))
    path = F.col("part.path")
    joined = F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(F.lit(WHOLE_DOCUMENT))
    rows = rows.select(
        "source_file", "title", *keep, "chunk_number", "part.section_chunk_number", path.alias("section_names"),
        joined.alias("section_path"), F.col("part.text").alias("text"))
    names = F.col("section_names")
    return rows.select(
        chunk_id(F.col("source_file"), F.col("section_path"), F.col("chunk_number")).alias("chunk_id"), "*",
        F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(WHOLE_DOCUMENT)).alias("section_name"),
        F.coalesce(F.get(names, F.lit(0)), F.lit(WHOLE_DOCUMENT)).alias("section_root"),
        F.size(names).alias("section_depth"),
        strip(F.concat_ws("\n", context_header(F.col("title"), names), F.lit(""), F.col("text"))).alias("search_text"),
    )


def chunk_id(source_file: Column, section_path: Column, number: Column) -> Column:
    """Stable identifier: file, hash of the section path, chunk number."""
    return F.concat(
        F.lit(f"{CHUNK_ID_PREFIX}::"), F.regexp_replace(source_file, "[^a-zA-Z0-9_.-]+", "_"),
        F.lit("::section::"), F.substring(F.sha1(section_path), 1, 10),
        F.lit("::chunk::"), F.format_string("%05d", number))


def corpus_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    length = F.length(text)
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_id").alias("distinct_ids"),
        F.min(length).alias("min_chars"), F.max(length).alias("max_chars"), F.sum(length).alias("total_chars"))


def require_ingestible(chunks: DataFrame) -> None:
    row = corpus_statistics(chunks).first()
    if row["chunks"] != row["distinct_ids"]:
        raise ValueError(f"duplicate chunk identifiers: {row['chunks'] - row['distinct_ids']}")


def expand_sections(
    seeds: DataFrame, chunks: DataFrame, keys: list[str], number: str, chunk: str, window: int = SECTION_WINDOW,
) -> DataFrame:
    """Chunks around each seed inside its exact section, at most ``window``, clamped at both ends.

    ``seeds`` holds ``keys``, ``number`` and ``expanded_from``. Section numbers are
    consecutive from 0, so the bounds come from the size of the section and only the
    chunks inside them are joined.
    """
    sizes = chunks.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("section_chunks"))
    half = window // 2
    end = F.least(F.col("section_chunks"), F.greatest(F.lit(0), F.col(number) - half) + window)
    start = F.greatest(F.lit(0), end - window)
    wanted = seeds.join(sizes, keys).withColumn("first_number", start).withColumn("last_number", end - 1)
    numbers = F.explode(F.sequence(F.col("first_number"), F.col("last_number")))
    rows = wanted.select(*keys, "expanded_from", "section_chunks", numbers.alias(number))
    return rows.join(chunks.select(*keys, number, chunk), [*keys, number]).withColumn(
        "is_section_expansion", F.col(chunk) != F.col("expanded_from"))


def number_within(df: DataFrame, keys: list[str], order: list[str], output: str) -> DataFrame:
    """Consecutive numbers from 0 inside each section of a document."""
    return df.withColumn(output, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
