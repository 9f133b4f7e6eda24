import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lorespark.llm import decontamination, line_dedup, passages, probminhash
from lorespark.llm.components import components
from tests.llm.helpers import awkward, changed, distance, frame, prose, shingles


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registers_estimate_the_probability_jaccard_index():
    rng = np.random.RandomState(0)
    a = np.unique(rng.randint(1, 2 ** 62, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:360], rng.randint(1, 2 ** 62, 40).astype(np.uint64)]))
    one, other = probminhash.signatures([(a, np.ones(len(a), int)), (b, np.ones(len(b), int))], 4000)
    assert abs((one == other).mean() - 360 / 440) < 0.03
    few = probminhash.signatures([(a[:2], np.array([1, 1])), (a[:0], np.ones(0, int))], 64)
    assert set(few[0]) == set(a[:2]) and not few[1].any()


def test_near_duplicate_classes_equal_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(60, 160)).split()
        for _ in range(rng.randrange(1, 30)):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(10 ** 6))
            texts.append(" ".join(copy))
    texts += ["", "one two", "One, two!"]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] == sets[j] or (union and len(sets[i] & sets[j]) / union >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in range(len(texts))}
    docs = frame(spark, texts)
    paired = probminhash.PAIRED_BUCKET
    try:
        for bucket in (paired, 2):  # small buckets by pairs, then every bucket by prefixes
            probminhash.PAIRED_BUCKET = bucket
            assert {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs).collect()} == want
    finally:
        probminhash.PAIRED_BUCKET = paired
    assert probminhash.without_near_duplicates(docs).count() == len(set(want.values()))


def test_loose_copies_that_share_a_rare_shingle_do_not_meet(spark):
    rng = random.Random(14)
    base = prose(rng, 120).split()
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(20, 120), 12):
            words[at] = f"own{rng.randrange(10 ** 6)}"
        # one word that five copies share makes rare shingles in which copies meet
        words[10] = f"shared{k // 5}"
        rows.append((k, k, " ".join(words)))
    sets = {k: shingles(t) for k, _, t in rows}
    near = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    frames = spark.createDataFrame([(k, k) for k, _, _ in rows], "node long, component long")
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    met = {(r["a"], r["b"]) for r in probminhash._rarest_first(frames, probminhash._shingle_sets(docs, frames), 0.8).collect()}
    assert near <= met and len(met) <= len(near) + 5


def test_near_duplicates_of_awkward_rows(spark):
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(awkward(spark)).collect()}
    assert got[3] == got[4] == 3 and got[1] == got[6] == 1 and None not in got
    assert probminhash.near_duplicates(frame(spark, [])).count() == 0


def test_banded_distance(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        a = "".join(rng.choice("ab é😀") for _ in range(rng.randrange(0, 40)))
        rows.append((k, a, changed(rng, a, rng.randrange(0, 6))))
    pairs = spark.createDataFrame(rows, "k int, line_a string, line_b string")
    for edits in (1, 2, 3):
        assert {r["k"] for r in line_dedup.verified(pairs, edits).collect()} == {k for k, a, b in rows if distance(a, b) <= edits}


def test_line_links_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(20, 50))) for _ in range(10)]
    lines = sorted({changed(rng, rng.choice(base), rng.randrange(0, 5)) for _ in range(120)})
    lines = [x for x in lines if len(x) >= line_dedup.MIN_CHARS]
    found = line_dedup.document_lines(frame(spark, lines), line_dedup.MIN_CHARS)
    text = {r["h"]: r["line"] for r in found.collect()}
    want = {(a, b) for a in lines for b in lines if a < b and distance(a, b) <= 2}
    sampled, hot = line_dedup.SAMPLED, line_dedup.HOT_IN_SAMPLE
    try:
        for line_dedup.SAMPLED, line_dedup.HOT_IN_SAMPLE in ((sampled, hot), (1, 1)):  # the second refines every key
            got = {tuple(sorted((text[r["a"]], text[r["b"]]))) for r in line_dedup.near_lines(found).collect()}
            assert got == want
    finally:
        line_dedup.SAMPLED, line_dedup.HOT_IN_SAMPLE = sampled, hot


def test_lines_of_unlike_letters_do_not_meet(spark):
    rng = random.Random(12)
    texts = [prose(rng, 6) for _ in range(150)]
    texts += [changed(rng, t, rng.randrange(3), "adho é") for t in texts[:150]]
    rows = [(k, t, k // 150) for k, t in enumerate(texts)]
    counted = {r["k"]: r["c"] for r in spark.createDataFrame(rows, "k int, t string, side int").select(
        "k", line_dedup.letter_counts(F.col("t")).alias("c")).collect()}
    apart = {(a, b): bin((counted[a] ^ counted[b]) & 0xFFFFFFFF).count("1") for a in range(150) for b in range(150, 300)}
    assert all(apart[a, a + 150] <= 4 for a in range(150))
    entries = spark.createDataFrame([(1, k, counted[k]) for k in range(150)], "key long, h long, letters int")
    met = line_dedup._joined(entries, entries, 2).distinct().count()
    assert met < 150 * 149 / 2 / 5


def test_lines_dropped_and_texts_left(spark):
    docs = frame(spark, ["first line of some length\nshort\nshort", "another line of some length\nfirst line of some lengtH\nshort",
                         "first line of some length", None, ""])
    report = {r["doc_id"]: (r["n_lines"], list(r["dropped_lines"]), r["n_links"]) for r in line_dedup.line_report(docs).collect()}
    assert report == {0: (3, [], 0), 1: (3, [1], 1), 2: (1, [0], 1), 3: (1, [], 0), 4: (1, [], 0)}
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert left == {0: ("first line of some length\nshort\nshort", 37), 1: ("another line of some length\nshort", 33), 3: (None, None), 4: ("", 0)}
    assert line_dedup.line_report(awkward(spark)).count() == 12
    assert line_dedup.line_report(frame(spark, [])).count() == 0


def test_overlaps_with_changed_words_and_short_items(spark):
    rng = random.Random(4)
    items = [prose(rng, 40), prose(rng, 20), prose(rng, 8), "two words", None, ""]
    swapped = items[0].split()
    swapped[7], swapped[20] = "other", "words"
    texts = [prose(rng, 200) + " " + " ".join(swapped) + " " + prose(rng, 50), prose(rng, 30) + " " + items[1].upper() + "!", items[2],
             "x " + items[2] + " y", prose(rng, 300), "two words", None, "", " ".join(items[0].split()[:14])]
    docs = frame(spark, texts)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["equal_words"] for r in decontamination.overlaps(docs, benchmark).collect()}
    assert got == {(0, 0): 38, (1, 1): 20, (2, 2): 8, (3, 2): 8, (8, 0): 14}
    assert {r["doc_id"] for r in decontamination.without_contaminated(docs, benchmark).collect()} == {4, 5, 6, 7}
    assert decontamination.overlaps(awkward(spark), benchmark).count() == 0
    assert decontamination.overlaps(frame(spark, []), benchmark.limit(0)).count() == 0


def test_compact_windows_hold_every_passage_once():
    rng = np.random.RandomState(1)
    for values in (rng.randint(0, 2 ** 62, 60).astype(np.uint64) << np.uint64(1), np.full(60, 77 << 20, dtype=np.uint64)):
        windows = passages.compact_windows(values, 7)
        for i in range(60):
            for j in range(i + 6, 60):
                owners = [w for w in windows if w[0] <= i <= w[1] <= j <= w[2]]
                assert len(owners) == 1 and values[owners[0][1]] >> np.uint64(16) == (values[i:j + 1] >> np.uint64(16)).min()


def test_repeated_passages_and_clean_documents(spark):
    rng = random.Random(6)
    shared = prose(rng, 70)
    touched = shared.split()
    touched[35] = "changed"
    texts = [prose(rng, 100) + "\n" + shared + "\n" + prose(rng, 40), shared, prose(rng, 30) + " " + " ".join(touched) + " " + prose(rng, 200),
             prose(rng, 300), " ".join(shared.split()[:40]) + " " + prose(rng, 100), None, "", prose(rng, 60)]
    texts.append(texts[7])
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert got == {(0, 100, 170, 0), (1, 0, 70, 0), (2, 30, 100, 0), (7, 0, 60, 7), (8, 0, 60, 7)}
    assert {r["doc_id"] for r in passages.repeated_passages(awkward(spark)).collect()} == {3, 4}
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_passages_of_documents_that_are_not_the_ends_of_their_keys(spark):
    rng = random.Random(8)
    texts, want = [], set()
    for _ in range(12):
        one = prose(rng, 50).split()
        other = list(one)
        for at in (16, 33):  # a second variant, too far from the first to be its near copy
            other[at] = "drifted" + str(rng.randrange(10 ** 6))
        for at, body in enumerate((one, other, other, one)):
            if at in (1, 2):
                want.add(len(texts))
            texts.append(f"own{len(texts)} " + " ".join(body))
    docs = frame(spark, texts)
    paired = passages.PAIRED_KEY
    try:
        for passages.PAIRED_KEY in (paired, 2):  # keys paired at once, then by stars and what they leave
            got = {r["doc_id"]: r["first_doc_id"] for r in passages.repeated_passages(docs).collect() if r["end_word"] - r["start_word"] >= 50}
            assert want <= set(got) and all(got[k] == k - (k % 4 == 2) for k in want)
    finally:
        passages.PAIRED_KEY = paired


def test_passages_go_on_behind_inserted_words():
    rng = np.random.RandomState(3)
    for cuts in ((30,), (33, 66)):
        a = rng.randint(1, 2 ** 62, 60 if len(cuts) == 1 else 100).astype(np.uint64)
        b = np.insert(a, cuts, rng.randint(1, 2 ** 62, len(cuts)).astype(np.uint64))
        left, right = (rng.randint(1, 2 ** 62, 40).astype(np.uint64) for _ in "ab")
        assert passages.near_passages(np.concatenate([left, a]), np.concatenate([b, right]), 50, 0.8) == [(40, 40 + len(a), 0, len(b))]
        noise = np.concatenate([np.concatenate([a[k:k + 5], left[k:k + 1]]) for k in range(0, 20, 2)])  # many short chains stay open
        got = passages.near_passages(a, np.concatenate([noise, b]), 50, 0.8)
        assert (0, len(a), len(noise), len(noise) + len(b)) in got
    same = np.full(300, 7, dtype=np.uint64)
    held, passages.HITS_AT_ONCE = passages.HITS_AT_ONCE, 1000
    try:
        assert passages.common_shifts(same, same[:200]) == list(range(-195, 296))
    finally:
        passages.HITS_AT_ONCE = held


def _seed_hits(n, equal):
    """Whether some mask has all its ones on equal words of an item of ``n`` words."""
    for mask in [*decontamination.MASKS, *(m for m in decontamination.item_masks([n]) if len(m) == n)]:
        ones = [k for k, bit in enumerate(mask) if bit == "1"]
        if any(all(equal[at + k] for k in ones) for at in range(n - len(mask) + 1)):
            return True
    return False


def test_seeds_cover_every_accepted_pattern():
    for n in range(decontamination.SHORTEST, 26):
        for gone in itertools.combinations(range(n), n - -(-4 * n // 5)):
            equal = [k not in gone for k in range(n)]
            assert _seed_hits(n, equal), (n, gone)
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randrange(26, 120)
        equal = [True] * n
        for at in rng.sample(range(n), n // 5):
            equal[at] = False
        assert _seed_hits(n, equal)
    for unequal in (0, 1, 2):  # twelve equal words of a run, in a long item that is otherwise different
        for at in itertools.combinations(range(12 + unequal), unequal):
            assert _seed_hits(60, [False] * 20 + [k not in at for k in range(12 + unequal)] + [False] * (28 - unequal))


def test_overlaps_of_items_with_a_fifth_of_their_words_changed(spark):
    rng = random.Random(10)
    items, texts, want = [], [], {}
    for n in (5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 15, 16, 17, 18, 19, 20, 25):
        item = prose(rng, n).split()
        changed_words = list(item)
        places = rng.sample(range(n), n // 5) if len(items) != 9 else (5, 7, 9)
        for at in places:
            changed_words[at] = f"new{n}x{at}"
        want[len(texts), len(items)] = n - len(places)
        texts.append(prose(rng, 30) + " " + " ".join(changed_words) + " " + prose(rng, 30))
        want[len(texts), len(items)] = n - n // 5
        texts.append(" ".join(item[n // 5:]))  # begins inside the item
        want[len(texts), len(items)] = n - n // 5
        texts.append(prose(rng, 9) + " " + " ".join(item[:n - n // 5]))
        items.append(" ".join(item))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["equal_words"] for r in decontamination.overlaps(frame(spark, texts).coalesce(1), benchmark).collect()} == want


def test_report_of_kept_lines(spark):
    docs = frame(spark, ["first line of some length", "another line of some length\nfirst line of some lengtH", "first line of some length"])
    rows = {r["doc_id"]: r for r in line_dedup.line_report(docs).collect()}
    got = {k: [(x["at"], x["n_links"], x["kept"]) for x in r["class_lines"]] for k, r in rows.items()}
    assert got == {0: [(0, 1, True)], 1: [(1, 1, False)], 2: [(0, 1, False)]}
    assert {k: r["n_class_links"] for k, r in rows.items()} == {0: 1, 1: 1, 2: 1}
    assert len({x["class_id"] for r in rows.values() for x in r["class_lines"]}) == 1


def test_report_of_short_lines(spark):
    docs = frame(spark, ["first line of some length\nshort\nalone", "another line of some length\nfirst line of some lengtH\n \nshort",
                         "first line of some length\n\n ", "short"])
    rows = {r["doc_id"]: r for r in line_dedup.line_report(docs).collect()}
    got = {k: [(x["at"], x["n_links"], x["kept"], x["short"]) for x in r["class_lines"]] for k, r in rows.items()}
    assert got == {0: [(0, 1, True, False), (1, 0, True, True)], 1: [(1, 1, False, False), (3, 0, False, True)], 2: [(0, 1, False, False)],
                   3: [(0, 0, False, True)]}
    assert {k: r["n_class_links"] for k, r in rows.items()} == {0: 1, 1: 1, 2: 1, 3: 0}
    ids = {x["class_id"] for r in rows.values() for x in r["class_lines"] if not x["short"]}
    short = {x["class_id"] for r in rows.values() for x in r["class_lines"] if x["short"]}
    assert len(ids) == len(short) == 1 and ids != short


def _plain_passages(texts):
    """All links of all pairs of whole texts, merged, without windows, segments or blocks."""
    words = [passages.WordHashes().of(passages.words_of(t)) >> np.uint64(32) for t in texts]
    spans = {k: [] for k in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        for from_a, to_a, from_b, to_b in passages.near_passages(words[a], words[b], passages.LEAST_WORDS, passages.SIMILARITY):
            spans[a].append((from_a, to_a, b))
            spans[b].append((from_b, to_b, a))
    merged = set()
    for doc_id, found in spans.items():
        island = None
        for start, end, other in sorted(found):
            if island and start <= island[2]:
                island = (doc_id, island[1], max(island[2], end), island[3] + 1, min(island[4], other))
                continue
            merged |= {island} if island else set()
            island = (doc_id, start, end, 1, min(doc_id, other))
        merged |= {island} if island else set()
    return merged


def test_all_members_of_a_large_key_are_linked(spark):
    rng = random.Random(11)
    base, texts = prose(rng, 90).split(), []
    for at in range(30):  # more copies than a small key has windows; each with words of its own around
        body = list(base)
        if at % 3 == 0:
            body[rng.randrange(90)] = f"own{at}"
        texts.append(" ".join([prose(rng, 30), *body, prose(rng, 30)]))
    tail = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {' '.join(base)} x{at} {tail}" for at in range(3)]  # what only these share lies beside the large key
    texts += [" ".join(base + base) + " " + prose(rng, 20), prose(rng, 100)]  # twice in one text
    texts += [("again and " * 40).strip(), prose(rng, 20) + " " + ("again and " * 35).strip()]
    want = _plain_passages(texts)
    sizes = passages.BLOCK_SEGMENTS
    try:
        for passages.BLOCK_SEGMENTS in (sizes, 5):  # the component at once, then by pairs of blocks
            got = {(r["doc_id"], r["start_word"], r["end_word"], r["n_links"], r["first_doc_id"])
                   for r in passages.repeated_passages(frame(spark, texts)).collect()}
            assert got == want
    finally:
        passages.BLOCK_SEGMENTS = sizes


def test_a_segment_against_many_equals_pairs_alone():
    rng = np.random.RandomState(5)
    for words in (2 ** 31, 40, 4):
        base, texts = rng.randint(1, words, 200), []
        for _ in range(7):
            text = base[rng.randint(0, 60):rng.randint(120, 200)].copy()
            text[rng.randint(0, len(text), 5)] = rng.randint(1, 2 ** 31, 5)
            text = np.insert(text, rng.randint(len(text)), rng.randint(1, 2 ** 31, rng.randint(0, 9)))
            texts.append(np.tile(text[:rng.randint(1, 20)], 12) if rng.rand() < 0.3 else text)
        texts = [t.astype(np.uint32) for t in texts if len(t) >= 20]
        held, passages.HITS_AT_ONCE = passages.HITS_AT_ONCE, 300
        try:
            segments = passages._Segments(texts)
            for a in range(len(texts)):
                others = np.array([b for b in range(len(texts)) if b != a])
                got = np.concatenate([np.zeros((0, 5), dtype=np.int64), *segments.passages(a, others, 20, 0.8)])
                want = [(b, *p) for b in others for p in passages.near_passages(segments.words[a], segments.words[b], 20, 0.8)]
                assert sorted(map(tuple, got.tolist())) == sorted(want)
        finally:
            passages.HITS_AT_ONCE = held
