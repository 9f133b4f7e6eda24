"""Table sources: typed CSV files, workbooks, and the parquet layout of the catalogue."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.text import sanitise_identifier, unique_headers
from lorespark.plans.vocabulary import INTEGER_COLUMNS, SOURCE_TABLES


def column_type(name: str) -> T.DataType:
    """Columns are typed by name: a closed list and every ``_id`` are integers."""
    return T.IntegerType() if name in INTEGER_COLUMNS or name.endswith("_id") else T.StringType()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV: columns from the header, empty cells null, any malformed row an error."""
    lines = spark.read.text(path).limit(1).collect()
    if not lines:
        raise ValueError(f"empty CSV: {path}")
    header = [cell.strip().strip('"') for cell in lines[0][0].lstrip("﻿").split(",")]
    names = [sanitise_identifier(cell) for cell in header]
    schema = T.StructType([T.StructField(name, column_type(name)) for name in names])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)


def read_csv_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The known source tables present in a folder of CSV files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()
    paths = {sanitise_identifier(PurePosixPath(row["path"]).stem): row["path"] for row in found}
    known = {source for source, _ in SOURCE_TABLES.values()}
    return {name: read_csv(spark, path) for name, path in paths.items() if name in known}


# ---- workbooks -----------------------------------------------------------------

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CELLS_SCHEMA = "workbook string, sheet string, row_index int, kinds array<string>, cells array<string>"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell(cell, shared: list[str]) -> tuple[str | None, str | None]:
    """(kind, text) of a cell; booleans are integers and whole decimals too."""
    kind = cell.get("t")
    if kind == "inlineStr":
        node = cell.find(f"{MAIN}is")
        return (None, None) if node is None else ("text", "".join(part.text or "" for part in node.iter(f"{MAIN}t")))
    node = cell.find(f"{MAIN}v")
    if node is None or node.text is None:
        return None, None
    if kind == "s":
        return "text", shared[int(node.text)]
    if kind == "b":
        return "int", node.text
    if kind in ("str", "e"):
        return "text", node.text
    try:
        number = float(node.text)
    except ValueError:
        return "text", node.text
    return ("int", str(int(number))) if number.is_integer() else ("real", repr(number))


def _workbook_rows(content: bytes) -> Iterator[tuple[str, int, list, list]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        tree = lambda name: ElementTree.fromstring(archive.read(name))
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in tree("xl/sharedStrings.xml").findall(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target").replace("\\", "/").lstrip("/") for r in tree("xl/_rels/workbook.xml.rels").findall(f"{PACKAGE}Relationship")}
        for sheet in tree("xl/workbook.xml").find(f"{MAIN}sheets"):
            target = targets[sheet.get(f"{RELATION}id")]
            data = tree(target if target.startswith("xl/") else f"xl/{target}").find(f"{MAIN}sheetData")
            for index, row in enumerate(data.findall(f"{MAIN}row")):
                values = {_column_number(cell.get("r")): _cell(cell, shared) for cell in row.findall(f"{MAIN}c")}
                width = max(values, default=-1) + 1
                dense = [values.get(i, (None, None)) for i in range(width)]
                yield sheet.get("name"), index, [kind for kind, _ in dense], [text for _, text in dense]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row per worksheet row of every workbook: cell kinds and cell texts."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = [(name, *row) for row in _workbook_rows(content)]
                yield pd.DataFrame(rows, columns=["workbook", "sheet", "row_index", "kinds", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CELLS_SCHEMA)


def sheet_table(rows: DataFrame, sheet: str, header: bool = True) -> DataFrame:
    """Typed table of one worksheet with a ``source_row`` key.

    Blank rows are dropped and the others numbered in order (a worksheet has at most
    about a million rows). A column is an integer, a real or a text by its values.
    """
    own = rows.filter(F.col("sheet") == sheet)
    filled = F.exists("cells", lambda cell: cell.isNotNull() & (cell != ""))
    first = own.orderBy("row_index").limit(1).collect()
    if not first:
        raise ValueError(f"empty worksheet: {sheet}")
    if header:
        names, data, start = unique_headers(first[0]["cells"]), own.filter(F.col("row_index") > first[0]["row_index"]), 2
    else:
        width = own.agg(F.max(F.size("cells"))).first()[0]
        names, data, start = [f"column_{i}" for i in range(1, width + 1)], own, 1
    data = data.filter(filled)
    kind = lambda i: F.when(F.coalesce(F.get("cells", F.lit(i)), F.lit("")) != "", F.get("kinds", F.lit(i)))
    checks = [F.collect_set(kind(i)).alias(f"k{i}") for i in range(len(names))]
    kinds = data.agg(*checks).first()
    types = []
    for i in range(len(names)):
        seen = set(kinds[f"k{i}"])
        types.append("int" if seen == {"int"} else "double" if seen and seen <= {"int", "real"} else "string")
    numbered = data.withColumn("source_row", F.row_number().over(Window.partitionBy("sheet").orderBy("row_index")) + (start - 1))
    cells = [F.nullif(F.get("cells", F.lit(i)), F.lit("")).cast(types[i]).alias(name) for i, name in enumerate(names)]
    return numbered.select("source_row", *cells)


# ---- layout ------------------------------------------------------------------------


# Columns of the learning fact that must be whole numbers.
FACT_KEYS = ["pokemon_id", "version_group_id", "move_id", "pokemon_move_method_id", "level"]
EXPECTED = {"pokemon_moves": {"types": dict.fromkeys(FACT_KEYS, "int"), "required": FACT_KEYS}}


def _accepts(wanted: str, found: str) -> bool:
    whole = {"tinyint", "smallint", "int", "bigint"}
    return found == wanted or wanted == "int" and found in whole or wanted == "double" and found in whole | {"float", "double"}


def type_faults(name: str, df: DataFrame, expected: dict) -> list[str]:
    """Columns of a table that are absent or of another type than ``expected['types']`` names."""
    types = dict(df.dtypes)
    return [f"{name}.{column}: {wanted} expected, {types.get(column, 'no column')} found"
            for column, wanted in expected.get("types", {}).items() if not _accepts(wanted, types.get(column, ""))]


def observed(name: str, df: DataFrame, expected: dict) -> tuple[DataFrame, Observation]:
    """``df`` with its row count and the nulls of its required columns gathered in the pass that writes it."""
    seen = Observation(name)
    nulls = [F.count_if(F.col(column).isNull()).alias(column) for column in expected.get("required", [])]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls), seen


def write_catalogue(tables: dict[str, DataFrame], folder: str, expected: dict[str, dict] | None = None) -> dict[str, int]:
    """Parquet tables, and the number of rows of each. A fault of any table fails the build, naming table, column and count.

    Types are compared before anything is written; nulls in required columns are counted while the table is written, and repeated
    ``keys`` by one aggregation of the written columns. The learning fact is range-ordered so that one entity reads few row
    groups; the range key continues into the game and the method, so an entity with a third of the rows spreads over many files.
    """
    expected = EXPECTED if expected is None else expected
    faults = [fault for name, df in tables.items() for fault in type_faults(name, df, expected.get(name, {}))]
    if faults:
        raise ValueError("; ".join(faults))
    sizes = {}
    for name, df in tables.items():
        rules = expected.get(name, {})
        if name == "pokemon_moves":
            keys = ["pokemon_id", "version_group_id", "pokemon_move_method_id", "level", "move_id"]
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df, seen = observed(name, df, rules)  # behind the exchange: what samples its ranges must not count
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts = dict(seen.get)
        sizes[name] = counts.pop("rows")
        faults += [f"{name}.{column}: {count} of {sizes[name]} rows without a value" for column, count in counts.items() if count]
        for keys in rules.get("keys", []):
            doubled = df.sparkSession.read.parquet(f"{folder}/{name}").groupBy(*keys).count().filter("count > 1").count()
            faults += [f"{name}({', '.join(keys)}): {doubled} repeated keys"] if doubled else []
    if faults:
        raise ValueError("; ".join(faults))
    return sizes


def read_catalogue(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
