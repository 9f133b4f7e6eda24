"""Small corpora and plain Python reference results for the corpus operators."""

import random
import re

WORDS = [a + b for a in ("ka", "lo", "mi", "su", "te", "ra", "no") for b in ("ber", "dan", "fil", "gor", "hum", "jes", "kil", "lam")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _gone string, key string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 1, 0.5, "x", "k") for i, t in zip(ids, texts)], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long_text = prose(rng, 3000)
    row = prose(rng, 80)
    return frame(spark, [None, "", "", "a", row, row, row, long_text, "\n\n\n", "é😀 ß", "x" * 5000, prose(rng, 60)],
                 [None, 1, 1, 2, 3, 3, 4, 5, 6, 7, 8, None])


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def changed(rng, text, edits, letters="abé😀"):
    chars = list(text)
    for _ in range(edits):
        kind, at = rng.random(), rng.randrange(len(chars) + 1)
        if kind < 0.33 and chars:
            chars.pop(min(at, len(chars) - 1))
        elif kind < 0.66:
            chars.insert(at, rng.choice(letters))
        elif chars:
            chars[min(at, len(chars) - 1)] = rng.choice(letters)
    return "".join(chars)
