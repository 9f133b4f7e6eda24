"""Personal data: base patterns, and weakly supervised spans beyond them, in DataFrame functions alone.

Base spans are the leftmost, non-overlapping matches of four patterns (``email``, ``ip``, ``card``, ``phone``); a match that fails its
check (parts up to 255, Luhn over 14 to 19 digits, 10 to 15 digits) is dropped. Places are counted in code points.

Further candidates (veiled addresses, card-like and phone-like numbers that fail the base checks, long mixed tokens) are put to
five labelers, which vote 1, -1 or abstain: two on form (regular expressions), one on word lists (gazetteer), two on context.
Votes are counted per pattern over all documents: at most 5 kinds x 3**5 numbers, on which expectation-maximisation estimates
how reliable each labeler is. Its posteriors train the final classifier, a logistic regression on binary features of a span,
again on a bounded table of counts. Candidates with a probability of ``ACCEPTED`` at least are added; base spans always stay.

Places come from the pieces between matches: their lengths are added up in blocks, in time linear in the text. Patterns begin
at the start of a run of their characters or where the last match ended, so that long runs cost no second scan.

Defined results: a null text is empty and has no spans (the digest of an empty list is that of the empty string); each row is
searched by itself, also where rows share a ``doc_id``; without candidates no classifier is trained and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import texts, written

KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns of the contract. The possessive forms and the guards match the same strings without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]{1,63}+|\.[a-z0-9-]{1,63}+)++",
    "card": BASE["card"],
    "phone": r"(?:(?<![0-9+])|\G)\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,4}+",
    "secret": r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{20,}+",
}
CUES = r"(?i)(token|secret|passw|api|key|card|carte|tarjeta|karte|credit|visa|phone|telefon|tel|call|mobil|mail|contact|kontakt|iban)\W{0,6}$"
TOP_DOMAINS = ("com", "org", "net", "edu", "info", "de", "fr", "es", "uk", "io")
TOKEN_STARTS = r"^(sk-|ghp_|AKIA|xox|eyJ|pk_)"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
ACCEPTED = 0.5
BLOCK = 256
LABELERS = ("form", "content", "gazetteer", "cue", "edges")
FEATURES = ("long", "very_long", "digits", "letters", "spaced", "assigned", "quoted", "cue", "edges", "repeated")


def running_totals(numbers: Column) -> Column:
    """Running totals of an array of integers, added up in blocks."""
    blocks = F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")))

    def totals(part: Column, start: Column) -> Column:
        state = F.struct(start.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(part, state, lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"] + x)).alias("all")), lambda s: s["all"])

    inner = F.transform(blocks, lambda b: totals(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0)))
    return bound(inner, lambda parts: bound(
        totals(F.transform(parts, lambda p: F.element_at(p, -1).cast("int")), F.lit(0)),
        lambda ends: F.flatten(F.transform(parts, lambda p, b: F.transform(
            p, lambda x: x + F.when(b == 0, F.lit(0)).otherwise(F.get(ends, b - 1)))))))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: kind, start, end, value and the neighbouring text on both sides."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(values: Column) -> Column:
        return bound(F.split(text, pattern, -1), lambda gaps: bound(
            running_totals(F.transform(values, lambda v, i: F.length(v) + F.length(F.get(gaps, i)))), lambda ends: F.transform(
                values, lambda v, i: F.struct(
                    F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"),
                    F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("after")))))

    kind_of = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"
    return bound(found, lambda values: F.when(F.size(values) == 0, F.array().cast(kind_of)).otherwise(spans(values)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: bound(
            F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255"))))
    if kind == "card":
        return bound(_digits(value), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _candidate(kind: str, value: Column) -> Column:
    """Matches of a candidate pattern that are worth a vote: of the shape, but no base span."""
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(14, 19) & ~luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 12)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _checked(check, kind: str):
    return lambda span: check(kind, span["value"])


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def judged(span: Column) -> Column:
    """A candidate with the votes of the labelers and the features of the classifier."""
    kind, value, before, after = span["kind"], span["value"], span["before"], span["after"]
    share = F.length(_digits(value)) / F.greatest(F.length(value), F.lit(1))

    def vote(yes: Column, no: Column | None = None) -> Column:
        last = F.lit(-1) if no is None else F.when(no, -1).otherwise(0)
        return F.when(yes, 1).otherwise(last).cast("int")

    form = F.when(kind == "card", value.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){3}$")).when(
        kind == "phone", value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")).when(
        kind == "secret", value.rlike(r"^([0-9a-f]{32,}|[0-9A-F]{32,})$|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9].*[0-9])")).otherwise(F.lit(True))
    content = F.when(kind == "secret", share.between(0.15, 0.85)).when(
        kind == "card", ~value.rlike(r"^([0-9])(?:[ -]?\1)+$")).otherwise(share.between(0.0, 0.99))
    listed = F.when(kind == "card", value.rlike(ISSUERS)).when(kind == "secret", value.rlike(TOKEN_STARTS)).when(
        kind == "phone", value.rlike(r"^\(?[2-9]")).otherwise(
        F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS))
    cue = before.rlike(CUES)
    edges = (before.rlike(r"(^|[\s\"'=:(\[,;])$") | (before == "")) & (after.rlike(r"^([\s\"'.,;:)\]!?#$%&*]|$)") | (after == ""))
    features = {
        "long": F.length(value) >= 16, "very_long": F.length(value) >= 32, "digits": share >= 0.9, "letters": share < 0.15,
        "spaced": value.rlike("[ .()-]"), "assigned": before.rlike("[=:][\\s\"']*$"), "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "cue": cue, "edges": edges, "repeated": value.rlike(r"([A-Za-z0-9])\1{4,}")}
    votes = (vote(form), vote(content), vote(listed, kind != "secret"), vote(cue, F.lit(False)), vote(edges))
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.array(*votes).alias("votes"),
                    F.array(*[F.coalesce(features[f], F.lit(False)).cast("int") for f in FEATURES]).alias("features"))


def searched(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans and judged candidates of every whole text; no shuffle, and no text in the result."""
    text = F.col("text")
    bare = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = texts(docs).withColumns({f"_{k}": matches(text, p, k) for k, p in BASE.items()})
    found = found.withColumns({f"_more_{k}": matches(text, p, k) for k, p in CANDIDATES.items() if k != "card"} | {"_more_card": F.col("_card")})
    base = F.flatten(F.array(*[F.filter(F.col(f"_{k}"), _checked(passes, k)) for k in BASE]))
    more = F.flatten(F.array(*[F.filter(F.col(f"_more_{k}"), _checked(_candidate, k)) for k in CANDIDATES]))
    found = found.select("doc_id", F.transform(base, lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(bare).alias("base"), more.alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return found.select("doc_id", "base", F.transform(apart, judged).alias("more"))


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of "personal" per (kind, votes), by expectation-maximisation over counted vote patterns.

    Each labeler has a share of each vote for both truths, each kind its own share of personal spans. The first posteriors are
    the share of yes votes.
    """
    posterior = {(k, v): (v.count(1) + 0.5) / (v.count(1) + v.count(-1) + 1.0) for k, v, _ in counts}
    for _ in range(rounds):
        mass = {k: [1.0, 1.0] for k, _, _ in counts}
        seen = [{t: {1: 1.0, 0: 1.0, -1: 1.0} for t in (0, 1)} for _ in LABELERS]
        for kind, votes, n in counts:
            for truth, p in ((1, posterior[kind, votes]), (0, 1 - posterior[kind, votes])):
                mass[kind][truth] += n * p
                for labeler, vote in enumerate(votes):
                    seen[labeler][truth][vote] += n * p
        following = {}
        for kind, votes, _ in counts:
            score = [math.log(mass[kind][t] / sum(mass[kind])) + sum(
                math.log(seen[j][t][v] / sum(seen[j][t].values())) for j, v in enumerate(votes)) for t in (0, 1)]
            following[kind, votes] = 1 / (1 + math.exp(min(50.0, max(-50.0, score[0] - score[1]))))
        moved = max(abs(following[c] - posterior[c]) for c in following)
        posterior = following
        if moved < 1e-6:
            break
    return posterior


def span_classifier(rows: list[tuple[str, tuple[int, ...], float, float]], rounds: int = 400) -> list[float]:
    """Weights (kinds, then features) of a logistic regression on (kind, features, personal mass, whole mass)."""
    size = len(KINDS) + len(FEATURES)
    weights, speed = [0.0] * size, [1e-6] * size
    coded = [([KINDS.index(k)] + [len(KINDS) + j for j, f in enumerate(fs) if f], yes, n) for k, fs, yes, n in rows]
    total = sum(n for _, _, n in coded) or 1.0
    for _ in range(rounds):
        gradient = [0.001 * w for w in weights]
        for on, yes, n in coded:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[j] for j in on)))))
            for j in on:
                gradient[j] += (p * n - yes) / total
        for j, g in enumerate(gradient):
            speed[j] += g * g
            weights[j] -= 0.5 * g / math.sqrt(speed[j])
    return weights


def trained(found: DataFrame) -> list[float] | None:
    """The classifier of all candidates in ``found``, or ``None`` without any. Only counts of bounded patterns are collected."""
    counted = found.select(F.explode("more").alias("m")).groupBy("m.kind", "m.votes", "m.features").agg(F.count("*").alias("n")).collect()
    if not counted:
        return None
    patterns: dict = {}
    for row in counted:
        key = row["kind"], tuple(row["votes"])
        patterns[key] = patterns.get(key, 0) + row["n"]
    posterior = reliabilities([(k, v, n) for (k, v), n in sorted(patterns.items())])
    cells: dict = {}
    for row in counted:
        yes, n = cells.get((row["kind"], tuple(row["features"])), (0.0, 0.0))
        cells[row["kind"], tuple(row["features"])] = yes + row["n"] * posterior[row["kind"], tuple(row["votes"])], n + row["n"]
    return span_classifier([(k, f, yes, n) for (k, f), (yes, n) in sorted(cells.items())])


def probability(span: Column, weights: list[float]) -> Column:
    score = F.lit(0.0)
    for kind, w in zip(KINDS, weights):
        score = score + F.when(span["kind"] == kind, F.lit(w)).otherwise(F.lit(0.0))
    for at, w in enumerate(weights[len(KINDS):]):
        score = score + F.get(span["features"], F.lit(at)) * F.lit(w)
    return 1 / (1 + F.exp(-score))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, by start and then by kind as the kinds are listed, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: numbers of base spans of each kind, the digest of the base spans, all spans, their number, and that of secrets."""
    found = written(searched(docs))
    weights = trained(found)
    bare = "array<struct<kind:string,start:bigint,end:bigint>>"
    added = F.array().cast(bare) if weights is None else F.transform(
        F.filter("more", lambda m: probability(m, weights) >= ACCEPTED), lambda m: F.struct(m["kind"], m["start"], m["end"])).cast(bare)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.concat(F.col("base"), added)).alias("spans"),
                        (F.size("base") + F.size(added)).cast("long").alias("n_spans"), F.size(F.filter(added, _of_kind("secret"))).cast("long").alias("n_secret"))
