"""Text functions as Spark columns: name keys, slugs, tokens, token counts."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the word pattern of lexical search.
TOKEN_PATTERN = r"[0-9A-Za-zÀ-ÖØ-öø-ÿŒœÆæÉéÈèÊêËëÇç'-]+"

# Words that do not help to recognise a section path.
SECTION_STOPWORDS = [
    "a", "à", "au", "aux", "avec", "ce", "ces", "cette", "dans", "de", "des",
    "du", "elle", "en", "et", "il", "la", "le", "les", "leur", "leurs", "lui",
    "par", "pour", "que", "quel", "quelle", "quelles", "quels", "qui", "sa",
    "ses", "son", "sur", "un", "une",
]


def name_key(text: str | None) -> str:
    """Driver-side key of one argument: no accents, folded case, words joined by dashes."""
    if text is None:
        return ""
    decomposed = unicodedata.normalize("NFKD", str(text))
    plain = "".join(ch for ch in decomposed if not unicodedata.combining(ch))
    return re.sub(r"[^a-z0-9]+", "-", plain.casefold()).strip("-")


def _code_point_ranges(points: list[int]) -> str:
    """Body of a regex class covering the given sorted code points."""
    ranges, start = [], points[0]
    for current, following in zip(points, [*points[1:], None]):
        if following != current + 1:
            ranges.append(f"\\x{{{start:X}}}-\\x{{{current:X}}}")
            start = following
    return "".join(ranges)


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Per-character folding derived from the Unicode database.

    Returns the one-to-one sources and targets of ``translate``, the characters that
    expand to several ones, and the regex class of the marks that disappear.
    """
    sources, targets, expanding, dropped = [], [], {}, []
    for point in range(128, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        decomposed = unicodedata.normalize("NFKD", char)
        folded = "".join(ch for ch in decomposed if not unicodedata.combining(ch)).casefold()
        if not folded:
            dropped.append(point)
        elif re.search("[a-z0-9]", folded):
            if len(folded) == 1:
                sources.append(char)
                targets.append(folded)
            else:
                expanding[char] = folded
    upper = [chr(point) for point in range(ord("A"), ord("Z") + 1)]
    return (
        "".join(upper + sources),
        "".join([ch.lower() for ch in upper] + targets),
        expanding,
        "[" + _code_point_ranges(dropped) + "]+",
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A column is an expression, so naming it twice computes it twice, and once per
    element inside a lambda. Binding it as a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_text(column: Column) -> Column:
    """Accents removed and case folded, character by character, inside the JVM."""
    sources, targets, expanding, dropped = _fold_tables()
    expanding = {char: folded for char, folded in expanding.items() if char != "ß"}
    exact = "[" + _code_point_ranges(sorted(map(ord, expanding))) + "]"

    def expand(text: Column) -> Column:
        # One folded literal: a map built from hundreds of literals would slow planning down.
        replacements = F.from_json(F.lit(json.dumps(expanding)), "map<string,string>")
        return F.array_join(
            F.transform(F.split(text, ""), lambda ch: F.coalesce(F.element_at(replacements, ch), ch)), ""
        )

    # Marks and expanding characters are rare, and their exact classes are slow to test:
    # a cheap category test decides first, so ordinary texts only pay for ``translate``.
    marked = r"[\p{M}\p{Cf}\x{FF9E}\x{FF9F}]"
    rare = r"[\p{No}\p{So}\p{Sc}\x{132}-\x{1FFF}\x{2100}-\x{10FFFF}]"
    text = F.when(column.rlike(marked), F.regexp_replace(column, dropped, "")).otherwise(column)
    text = F.replace(text, F.lit("ß"), F.lit("ss"))
    text = let(text, lambda t: F.when(t.rlike(rare) & t.rlike(exact), expand(t)).otherwise(t))
    return F.translate(text, sources, targets)


def name_key_column(column: Column) -> Column:
    """Column twin of :func:`name_key`: the equality used between names everywhere."""
    dashed = F.regexp_replace(fold_text(F.coalesce(column, F.lit(""))), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def words_key_column(column: Column) -> Column:
    """Second normaliser, used for routing: ``œ`` becomes ``oe`` and words are joined by spaces."""
    ligature = F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("œ"), F.lit("oe")), F.lit("Œ"), F.lit("oe"))
    spaced = F.regexp_replace(fold_text(F.replace(ligature, F.lit("ß"), F.lit(" "))), "[^a-z0-9]+", " ")
    return F.trim(spaced)


def display_fold_column(column: Column) -> Column:
    """Third normaliser, used between displayed names: case and apostrophe only."""
    return F.replace(F.replace(F.lower(column), F.lit("ß"), F.lit("ss")), F.lit("’"), F.lit("'"))


def slug_column(column: Column) -> Column:
    """File slug: gender signs spelled out, other runs of symbols become ``_``."""
    folded = F.replace(F.replace(fold_text(column), F.lit("♀"), F.lit("_f")), F.lit("♂"), F.lit("_m"))
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ascii_lower(column: Column) -> Column:
    """Case folding restricted to ASCII letters, for name sorts that keep accented letters apart."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def sanitise_identifier(name: str) -> str:
    """Column or table name made of word characters only."""
    cleaned = re.sub(r"[^0-9a-zA-Z_]+", "_", name.strip())
    if not cleaned:
        raise ValueError("empty identifier")
    return "_" + cleaned if cleaned[0].isdigit() else cleaned


def sheet_header(value: object, fallback: str) -> str:
    """Column name of a worksheet header cell."""
    if value is None:
        return fallback
    name = name_key_like(str(value)) or fallback
    return "_" + name if name[0].isdigit() else name


def name_key_like(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    plain = "".join(ch for ch in decomposed if not unicodedata.combining(ch)).lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def unique_headers(values: list[object]) -> list[str]:
    """Header names in order, repeats numbered from 2."""
    seen: dict[str, int] = {}
    names = []
    for position, value in enumerate(values, start=1):
        base = sheet_header(value, f"column_{position}")
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return names


def tokens_column(column: Column) -> Column:
    """Lower-case words in text order, repeats kept."""
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN_PATTERN), F.lit(0))


def section_tokens_column(column: Column) -> Column:
    """Words of a section path or question without the general ones, repeats kept."""
    stopwords = F.array(*[F.lit(word) for word in SECTION_STOPWORDS])
    return F.filter(tokens_column(F.coalesce(column, F.lit(""))), lambda word: ~F.array_contains(stopwords, word))


def token_counts_column(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, computed inside the row.

    Sorting the array puts equal tokens side by side, so each count is the distance
    between two run starts: no row is exploded and nothing is shuffled.
    """

    def counts(ordered: Column) -> Column:
        size = F.size(ordered)
        positions = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(
            starts,
            lambda runs: F.transform(
                runs,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(runs, k + 1), size) - start).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), counts)


def json_object_column(text: Column) -> Column:
    """The JSON object held by a model answer: code fences removed, else the first ``{...}`` block."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    candidate = F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare).otherwise(block)
    return F.when((candidate != "") & F.try_parse_json(candidate).isNotNull(), candidate)
