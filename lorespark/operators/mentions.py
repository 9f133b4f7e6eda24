"""Names mentioned in texts: whole-word mentions, the longest one wins."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lorespark.functions.text import name_key_column
from lorespark.session import tasks_for

AUTOMATON_CHARS = 32_000_000
TEXTS_PER_TASK = 2000
HITS = "array<struct<start: int, size: int, alias_key: string>>"


def word_spans(words: Column, lengths: Column) -> Column:
    """``array<struct<start, size, phrase>>``: every run of consecutive words of the given sizes."""
    fitting = F.filter(lengths, lambda size: size <= F.size(words))
    return F.flatten(F.transform(fitting, lambda size: F.transform(
        F.sequence(F.lit(0), F.size(words) - size), lambda start: F.struct(
            start.alias("start"), size.alias("size"), F.array_join(F.slice(words, start + 1, size), "-").alias("phrase")))))


def mentions(texts: DataFrame, text_id: str, text: str, aliases: DataFrame, *, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(text_id, start, size, alias_key, target) of the alias mentions of each text.

    The names are one automaton over keys, built once from the collected keys and read by each task; texts are matched inside
    their rows and only hits are new rows. That holds while all keys together have at most ``automaton_chars`` characters. A larger
    catalogue meets the texts by equality joins on runs of words; the result is the same.
    """
    names = aliases.filter("alias_key <> ''").select("alias_key", "target").distinct()
    keys = names.select("alias_key").distinct()
    if (keys.agg(F.sum(F.length("alias_key"))).first()[0] or 0) > automaton_chars:
        return mentions_by_runs(texts, text_id, text, names)
    spotter = NameSpotter([row["alias_key"] for row in keys.collect()])

    @F.pandas_udf(HITS)
    def spot(keyed: pd.Series) -> pd.Series:
        return keyed.map(spotter.hits)

    found = texts.select(text_id, F.explode(spot(name_key_column(F.col(text)))).alias("hit")).select(text_id, "hit.start", "hit.size", "hit.alias_key")
    return found.join(names, "alias_key")


class NameSpotter:
    """All runs of whole words of a key that are names; the automaton is built where it is used and stays out of the closure."""

    def __init__(self, names: list[str]):
        self.names, self._automaton = names, None

    def __getstate__(self):
        return {"names": self.names, "_automaton": None}

    def hits(self, key: str | None) -> list[dict]:
        if not key or not self.names:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for name in self.names:
                self._automaton.add_word(f"-{name}-", (name, name.count("-") + 1))
            self._automaton.make_automaton()
        # The word that ends before a place has as many dashes before it as words before it.
        found, dashes = list(self._automaton.iter(f"-{key}-")), None
        if found:
            dashes = np.cumsum(np.frombuffer(f"-{key}-".encode(), dtype=np.uint8) == ord("-"))
        return [{"start": int(dashes[end]) - 1 - size, "size": size, "alias_key": name} for end, (name, size) in found]


def verbatim_holders(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, *, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(phrase_id, text_id): the texts that hold a phrase character by character; an empty phrase is held by none.

    Phrases are dealt by hash to as many automata as keep each near ``automaton_chars`` characters; every automaton is one pass over the texts.
    """
    parts = [texts.select(text_id, F.explode(_held(spotter)(F.col(text))).alias(phrase_id)) for spotter in _spotters(phrases, phrase_id, phrase, automaton_chars)]
    return reduce(DataFrame.unionByName, parts)


def held_counts(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, output: str, *, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``texts`` with how many of the distinct phrases each text holds, counted inside its row."""
    numbered = phrases.select(phrase).distinct().withColumn("_number", F.xxhash64(phrase))
    counts = [F.size(_held(spotter)(F.col(text))) for spotter in _spotters(numbered, "_number", phrase, automaton_chars)]
    return texts.withColumn(output, reduce(lambda a, b: a + b, counts).cast("long"))


def _spotters(phrases: DataFrame, phrase_id: str, phrase: str, automaton_chars: int) -> list[PhraseSpotter]:
    known = phrases.filter(F.length(phrase) > 0).select(phrase_id, phrase)
    passes = 1 + (known.agg(F.sum(F.length(phrase))).first()[0] or 0) // automaton_chars
    own = F.pmod(F.xxhash64(phrase), F.lit(passes))
    return [PhraseSpotter([(row[phrase], row[phrase_id]) for row in known.filter(own == n).collect()]) for n in range(passes)]


def _held(spotter: PhraseSpotter):
    @F.pandas_udf("array<long>")
    def held(texts: pd.Series) -> pd.Series:
        return spotter.held_by(texts)
    return held


class PhraseSpotter:
    """Numbers of the phrases that texts hold; like the names, the automaton is built where it is used."""

    def __init__(self, phrases: list[tuple[str, int]]):
        self.phrases, self._automaton = phrases, None

    def __getstate__(self):
        return {"phrases": self.phrases, "_automaton": None}

    def held_by(self, texts: pd.Series) -> pd.Series:
        if self._automaton is None and self.phrases:
            numbers: dict[str, list[int]] = {}
            for phrase, number in self.phrases:
                numbers.setdefault(phrase, []).append(number)
            self._automaton = ahocorasick.Automaton()
            for phrase, own in numbers.items():
                self._automaton.add_word(phrase, own)
            self._automaton.make_automaton()
        found = lambda text: sorted({number for _, own in self._automaton.iter(text) for number in own}) if text and self.phrases else []
        return texts.map(found)


def mentions_by_runs(texts: DataFrame, text_id: str, text: str, names: DataFrame) -> DataFrame:
    """The same by an equality join on runs of words, as long as some name: no bound on the catalogue, but each run is a row."""
    # One number per length of an alias: bounded by the longest name.
    lengths = names.agg(F.array_sort(F.collect_set(F.size(F.split("alias_key", "-"))))).scalar()
    words = F.split(name_key_column(F.col(text)), "-")
    spans = texts.select(text_id, words.alias("words"), lengths.alias("lengths")).select(
        text_id, F.explode(word_spans(F.col("words"), F.col("lengths"))).alias("span"))
    grouped = spans.select(text_id, "span.start", "span.size", F.col("span.phrase").alias("alias_key")).filter("alias_key <> ''")
    return grouped.join(names, "alias_key")


def dealt_mentions(texts: DataFrame, found: DataFrame, text_id: str) -> DataFrame:
    """``found`` by text, about ``TEXTS_PER_TASK`` texts to a task: what a task sorts does not grow with the number of texts."""
    return found.select(text_id, "start", "size", "target").repartition(tasks_for(texts, TEXTS_PER_TASK), text_id)


def longest_mentions(found: DataFrame, text_id: str) -> DataFrame:
    """Mentions that are not strictly inside a longer mention of the same text.

    A mention is covered if one that starts at the same word ends later, or one that starts earlier ends at its end or later:
    two running maxima over the mentions of a text in order, whatever the lengths.
    """
    end = F.col("start") + F.col("size")
    same, earlier = Window.partitionBy(text_id, "start"), Window.partitionBy(text_id).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    covered = (F.max(end).over(same) > end) | F.coalesce(F.max(end).over(earlier) >= end, F.lit(False))
    return found.withColumn("covered", covered).filter("NOT covered").drop("covered")


def required_mention(texts: DataFrame, found: DataFrame, text_id: str) -> DataFrame:
    """(text_id, target, error): the one target of the longest mentions of each text, nothing, or an error that lists several."""
    per_text = longest_mentions(dealt_mentions(texts, found, text_id), text_id).groupBy(text_id).agg(F.array_sort(F.collect_set(F.col("target").cast("string"))).alias("targets"))
    several = F.size("targets") > 1
    return texts.select(text_id).join(per_text, text_id, "left").select(
        text_id, F.when(F.size("targets") == 1, F.get("targets", F.lit(0))).alias("target"),
        F.when(several, F.concat(F.lit("several names: "), F.array_join("targets", ", "))).alias("error"))


def unique_mention(found: DataFrame, text_id: str) -> DataFrame:
    """(text_id, target) of the texts that mention exactly one (target, alias) pair."""
    per_text = found.select(text_id, "target", "alias_key").distinct().groupBy(text_id).agg(
        F.count(F.lit(1)).alias("n"), F.first("target").alias("target"))
    return per_text.filter("n = 1").select(text_id, "target")


def shortest_prefix_mention(found: DataFrame, text_id: str) -> DataFrame:
    """(text_id, target): the only target, or the shortest when its alias starts all the others."""
    per_text = found.groupBy(text_id).agg(F.collect_set(F.struct(
        F.length("alias_key").alias("length"), "alias_key", "target")).alias("found"))
    shortest = F.array_min("found")
    starts_all = F.forall("found", lambda m: (m["alias_key"] == shortest["alias_key"]) | m["alias_key"].startswith(F.concat(shortest["alias_key"], F.lit("-"))))
    one_target = F.size(F.array_distinct(F.transform("found", lambda m: m["target"]))) == 1
    return per_text.filter(one_target | starts_all).select(text_id, shortest["target"].alias("target"))
