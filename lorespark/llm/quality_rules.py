"""Quality rules: base limits, then robust multivariate outliers per language and source.

Words are runs without space, tab or line end. The base rules fail texts of fewer than ``FEWEST_WORDS`` words, and texts more than half
of whose words stand in three-word windows that occur twice or more. Every other document is a vector of six transformed
statistics: the logarithm of the mean word length, and ``asin(sqrt(share))`` of symbols, of words in repeated windows, of repeated lines,
of capitals and of other characters that are neither letters nor in the symbol list. None grows with the length of a text.

Centre and covariance of a group (language and source) are minimum-covariance-determinant estimates. From the medians and
quartile ranges, concentration steps follow: the ``SUBSET`` share of the group with the least distances gives the next centre and
covariance. Then all within the 97.5 % quantile of the chi-square law give the final ones. Both are scaled to be consistent
under the normal law. A document is rejected beyond the ``CUT`` quantile of its squared Mahalanobis distance.

Everything is an aggregation over all documents. Statistics are whole numbers (``SCALE`` units), so sums are exact and
the result is the same for any partitioning. Distances are counted in bins of a sixteenth of an octave together with the sums of
their members; the subset takes whole bins until it holds its share. One step is one scan with map-side partial sums, so a hot
group is combined where it lies, and what is joined back is one row per group. The covariance of ``n`` documents is weighed with ``PRIOR_ROWS``
rows of the prior spreads, and ``FLOOR`` is added, as in regularised estimates: small groups and constant statistics stay
invertible, at every size by the same formula.

Defined results: a null text has no words and fails; a null language or source reads as empty. Rows that repeat or share an id
are judged each and count each; very long texts are whole. Without documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorespark.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS, REPEATED_PERCENT, WINDOW_WORDS = 50, 50, 3
STATISTICS = ["length", "symbols", "repeats", "lines", "capitals", "others"]
P = len(STATISTICS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SCALE = 512
SUBSET, STEPS, WEIGHTED, CUT = 0.6, 5, 0.975, 0.999
# Least standard deviation of each statistic (a repeated line of a short text is no fault), and prior spread with its weight in documents.
FLOOR = [0.03, 0.03, 0.12, 0.12, 0.03, 0.03]
PRIOR, PRIOR_ROWS = [0.1] * P, 20
BINS_PER_OCTAVE = 16
GROUP = ["lang", "source"]


def chi_square(x: float, freedom: int) -> float:
    """Distribution function of the chi-square law with an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** i / math.factorial(i) for i in range(freedom // 2))


def chi_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the innermost share of a normal law consistent."""
    return share / chi_square(chi_quantile(share, P), P + 2)


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_letters)."""
    own = docs.select("doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    df = own.withColumns({"words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), "lines": lines})
    word = lambda i, k: F.get(F.col("words"), i + k)
    window = lambda i: F.concat_ws(" ", *[word(i, k) for k in range(WINDOW_WORDS)])
    n = F.size("words")
    windows = F.when(n >= WINDOW_WORDS, F.transform(F.sequence(F.lit(0), n - WINDOW_WORDS), window)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("windows", windows)
    # Equal windows stand side by side in sorted order; texts without any are told by the number of distinct windows.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    in_order = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    df = df.withColumn("ordered", F.when(repeated, in_order))
    beside = lambda x, k: F.coalesce(F.get(F.col("ordered"), k)["w"] == x["w"], F.lit(False))
    places = F.array_sort(F.array_compact(F.transform("ordered", lambda x, k: F.when(beside(x, k - 1) | beside(x, k + 1), x["i"]))))
    df = df.withColumn("places", places)
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(WINDOW_WORDS), F.get(F.col("places"), k + 1) - p)), F.lit(0).cast("long"), lambda total, x: total + x)
    size = F.length("text")
    left = lambda pattern: size - F.length(F.regexp_replace("text", pattern, ""))
    return df.select(
        "doc_id", *GROUP, n.cast("long").alias("n_words"), F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), left(r"\p{Lu}+").cast("long").alias("n_capitals"), left(r"\p{L}+").cast("long").alias("n_letters"))


def transformed(stats: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and the whole-number statistics ``z_<name>``."""
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))))
    chars = F.col("word_chars")
    others = F.greatest(chars - F.col("n_letters") - F.col("n_symbols"), F.lit(0))
    values = {
        "length": F.log(F.greatest(chars, F.lit(1)) / F.greatest("n_words", F.lit(1))), "symbols": share(F.col("n_symbols"), chars),
        "repeats": share(F.col("n_repeat_words"), F.col("n_words")), "lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "capitals": share(F.col("n_capitals"), chars), "others": share(others, chars)}
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, **{f"z_{name}": F.round(value * SCALE).cast("long") for name, value in values.items()}})


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    z = [F.col(f"z_{name}") for name in STATISTICS]
    return rows.groupBy(*GROUP, *keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(z[i]).alias(f"s_{i}") for i in range(P)], *[F.sum(z[i] * z[j]).alias(f"q_{i}_{j}") for i, j in PAIRS])


SUMS = ["n", *[f"s_{i}" for i in range(P)], *[f"q_{i}_{j}" for i, j in PAIRS]]


def estimate(sums: DataFrame, factor: float) -> DataFrame:
    """(lang, source, mean, inverse) from exact sums: ``inverse`` holds the rows of the inverse Cholesky factor."""
    n = F.col("n").cast("decimal(20,0)")
    moment = lambda i, j: (n * F.col(f"q_{i}_{j}") - F.col(f"s_{i}").cast("decimal(19,0)") * F.col(f"s_{j}").cast("decimal(19,0)")).cast("double") / (F.col("n") * F.col("n").cast("double"))
    prior = lambda i, j: (PRIOR[i] * SCALE) ** 2 if i == j else 0.0
    floor = lambda i, j: (FLOOR[i] * SCALE) ** 2 if i == j else 0.0
    rows = float(PRIOR_ROWS)
    df = sums.select(*GROUP, F.array(*[F.col(f"s_{i}") / F.col("n") for i in range(P)]).alias("mean"), *[
        ((F.col("n") * factor * moment(i, j) + rows * prior(i, j)) / (F.col("n") + rows) + floor(i, j)).alias(f"c_{i}_{j}") for i, j in PAIRS])
    total = lambda terms: reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)
    for j in range(P):  # Cholesky factor, column by column
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.col(f"c_{j}_{j}") - total([F.col(f"l_{j}_{k}") ** 2 for k in range(j)])))
        df = df.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - total([F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)])) / F.col(f"l_{j}_{j}")
                             for i in range(j + 1, P)})
    for i in range(P):  # its inverse, row by row
        df = df.withColumns({f"m_{i}_{j}": F.lit(1.0) / F.col(f"l_{i}_{i}") if i == j else
                             -total([F.col(f"l_{i}_{k}") * F.col(f"m_{k}_{j}") for k in range(j, i)]) / F.col(f"l_{i}_{i}") for j in range(i + 1)})
    return df.select(*GROUP, "mean", F.array(*[F.col(f"m_{i}_{j}") for i, j in PAIRS]).alias("inverse"))


def with_distance(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with ``distance``, their squared Mahalanobis distance under the state of their group."""
    gap = [F.col(f"z_{name}") - F.element_at("mean", i + 1) for i, name in enumerate(STATISTICS)]
    at = {pair: k + 1 for k, pair in enumerate(PAIRS)}
    turned = [reduce(lambda a, b: a + b, [F.element_at("inverse", at[i, j]) * gap[j] for j in range(i + 1)]) for i in range(P)]
    joined = rows.join(state.select(*GROUP, "mean", "inverse"), GROUP)
    return joined.withColumn("distance", reduce(lambda a, b: a + b, [t * t for t in turned])).drop("mean", "inverse")


def start(rows: DataFrame) -> DataFrame:
    """State of medians and quartile ranges, exact over all rows: statistics are whole numbers, so their counts are a small table."""
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"z_{name}").alias("z")) for i, name in enumerate(STATISTICS)])).alias("e")
    counts = rows.select(*GROUP, entries).groupBy(*GROUP, "e.i", "e.z").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(*GROUP, "i")
    ranked = counts.withColumns({"below": F.sum("n").over(window.orderBy("z")), "all": F.sum("n").over(window)})
    quantile = lambda share: F.min(F.when(F.col("below") >= F.col("all") * share, F.col("z")))
    per = ranked.groupBy(*GROUP, "i").agg(quantile(0.5).alias("median"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("spread"))
    floor = [(f * SCALE) ** 2 for f in FLOOR]
    diagonal = per.groupBy(*GROUP).agg(*[F.max(F.when(F.col("i") == i, F.col("median")).cast("double")).alias(f"mean_{i}") for i in range(P)],
                                       *[F.max(F.when(F.col("i") == i, F.sqrt(F.col("spread") ** 2 + floor[i]))).alias(f"spread_{i}") for i in range(P)])
    return diagonal.select(*GROUP, F.array(*[F.col(f"mean_{i}") for i in range(P)]).alias("mean"),
                           F.array(*[F.lit(1.0) / F.col(f"spread_{i}") if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"))


def concentrated(rows: DataFrame, state: DataFrame, subset: float = SUBSET) -> DataFrame:
    """Exact sums of the ``subset`` share of each group with the least distances, in whole bins of distance."""
    bin_ = F.floor(BINS_PER_OCTAVE * F.log2(1 + 64 * F.col("distance"))).cast("int")
    bins = _sums(with_distance(rows, state).withColumn("bin", bin_), "bin")
    window = Window.partitionBy(*GROUP)
    ranked = bins.withColumns({"below": F.sum("n").over(window.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(window)})
    return ranked.where(F.col("below") < F.col("all") * subset).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


def robust_state(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """State of each group: concentration steps from the medians, then the reweighted estimate. Each state is a written table."""
    state = written(start(rows))
    for _ in range(steps):
        state = written(estimate(concentrated(rows, state, subset), consistency(subset)))
    inside = with_distance(rows, state).where(F.col("distance") <= chi_quantile(WEIGHTED, P))
    final = written(estimate(_sums(inside), consistency(WEIGHTED)))
    # A group none of whose documents is inside keeps the state before.
    return final.unionByName(state.select(*final.columns).join(final, GROUP, "left_anti"))


def quality_rules(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Per document: base statistics, ``base_failed``, ``kept`` and the squared ``distance`` (null where the base rules fail)."""
    rows = written(transformed(base_statistics(docs)))
    judged = rows.where("NOT base_failed")
    scored = with_distance(judged, written(robust_state(judged)))
    failed = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    kept = F.coalesce(F.col("distance") <= chi_quantile(cut, P), F.lit(False))
    return scored.unionByName(failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
