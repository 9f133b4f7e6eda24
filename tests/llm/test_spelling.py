import random
import re
import zlib
from collections import Counter

from lorespark.llm import spelling
from tests.llm.helpers import awkward, distance, frame


def brute(rows, ratio=10):
    """Every word against every word by edit distance."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            code = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if code % 31 == 0:
                run = run[:code % len(run)] + run[code % len(run) + 1:]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and distance(w, v) == 1] for w in counts}
    form = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= ratio * counts[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts)


def vocabulary_texts(rng, words, texts=60, size=60):
    weights = [rng.choice((1, 1, 2, 30, 400)) for _ in words]
    return [" ".join(rng.choices(words, weights, k=size)) for _ in range(texts)]


def test_variants_equal_all_pairs(spark):
    rng = random.Random(7)
    words = set()
    for letters, size in (("ab", 8), ("aé", 7), ("xyz", 9)):
        words |= {"".join(rng.choice(letters) for _ in range(size + rng.randrange(-1, 3))) for _ in range(60)}
    texts = vocabulary_texts(rng, sorted(words)) + ["aaaaaaa aaaaaaaa aaaaaaaaa " * 3, None, "", "Éclatant ÉCLATANT éclatant1éclatant"]
    rows = list(enumerate(texts))
    for part_words in (50_000, 20, 3):
        got = sorted(tuple(r) for r in spelling.spelling_variants(frame(spark, texts), part_words=part_words).collect())
        assert got == brute(rows)


def test_chains_of_forms_end_at_their_root(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(2 * 10 ** k))
    got = {r["word"]: r for r in spelling.spelling_variants(frame(spark, [text]), thinned=10 ** 12).collect()}
    assert [got[w]["root"] for w in chain] == [chain[-1]] * 4
    assert [got[w]["form"] for w in chain] == chain[1:] + [None] and [got[w]["n_near"] for w in chain] == [1, 2, 2, 1]


def test_awkward_rows_repeats_and_very_long_runs(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in spelling.spelling_variants(docs).collect()) == brute(rows)
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    long = "z" * 60_000
    texts = [f"{long} {long}y"] * 12 + [long] * 300
    got = {len(r["word"]): r for r in spelling.spelling_variants(frame(spark, texts), thinned=10 ** 12).collect()}
    assert got[60_001]["form"] == long and got[60_000]["n_near"] == 1 and len(got) == 2


def test_trie_nodes_number_prefixes_one_to_one(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    of, prefixes = {}, set()
    for row in spelling.trie_nodes(table, "word", "nodes", part_words=11).collect():
        assert len(row["nodes"]) == len(row["word"]) + 1
        for p, node in enumerate(row["nodes"]):
            prefixes.add(row["word"][:p])
            assert of.setdefault(node, row["word"][:p]) == row["word"][:p]
    assert len(of) == len(prefixes)
