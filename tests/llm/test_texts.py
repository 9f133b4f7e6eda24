import hashlib
import random
import re
import zlib

import numpy as np

import corpus_pipeline
import __spark_entry__ as entry
from lorespark.llm import linear, merkle, pii, quality, toxicity
from tests.llm.helpers import awkward, frame, prose
from tests.oracle import compare, connect

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and _luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1234567890@@..+++--  ()_%é😀\n") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += ["1" * 3000, "a" * 3000 + "@", "1.2.3.4.5.6.7.8.9.10", "256.1.1.1 0255.1.1.1", "a@b.c@d.e", "x@y.z_w@v.u.t", "1 " * 600,
              "+1 (423) 555-7379", "4111 1111 1111 1111", "+1 2 3 4 5 6 7 8 9 0-", "a@b.cd " * 700, None, ""]
    rows = {r["doc_id"]: r for r in pii.personal_data(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        want = base_spans(text or "")
        assert rows[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(rows[k]["spans"].split(","))
        assert rows[k]["n_card"] == want.count("card")
        assert rows[k]["n_spans"] == len(list(filter(None, rows[k]["spans"].split(",")))) and rows[k]["n_secret"] == rows[k]["spans"].count("secret:")


def test_labelers_agree_on_tokens_and_leave_words_alone(spark):
    rng = random.Random(4)
    texts = []
    for k in range(60):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        texts.append(f'{prose(rng, 10)} token = "{token}" {prose(rng, 10)}' if k % 2 else prose(rng, 10) + " averyveryverylongword1inside-of-prose " + prose(rng, 5))
    rows = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        start = text.find('"') + 1
        assert rows[k] == (f"secret:{start}:{start + 40}" if k % 2 else "")


def test_personal_data_of_awkward_rows(spark):
    rows = pii.personal_data(awkward(spark)).collect()
    assert len(rows) == 12 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_expectation_maximisation_trusts_the_reliable_labelers():
    rng = random.Random(5)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = tuple((1 if truth else -1) if rng.random() < share else (-1 if truth else 1) for share in (0.95, 0.9, 0.9, 0.6, 0.5))
        counts["card", votes] = counts.get(("card", votes), 0) + 1
    posterior = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert posterior["card", (1, 1, 1, -1, -1)] > 0.9 and posterior["card", (-1, -1, -1, 1, 1)] < 0.1


def _labelled(spark, rng, n=400):
    texts, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.4
        texts.append(prose(rng, rng.randrange(5, 60)) + (" vile nasty insult" if bad else " fine calm remark") + " " + prose(rng, 20))
        labels.append((k, int(not bad), int(bad)))
    return frame(spark, texts + [None, ""]), spark.createDataFrame(labels + [(None, 1, 1), (n + 5, None, None)], "doc_id long, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark):
    docs, labels, truth = _labelled(spark, random.Random(6))
    toxic = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, labels)).collect()}
    good = {r["doc_id"]: r for r in quality.quality_scores(docs, quality.train_quality(docs, labels)).collect()}
    out = [(k, q, t) for k, q, t in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(out) > 80 and all(toxic[k]["held_out"] for k, _, _ in out) and sum(r["held_out"] for r in toxic.values()) < len(toxic) / 2
    assert np.mean([toxic[k]["predicted"] == t for k, _, t in out]) > 0.95
    assert np.mean([good[k]["predicted"] == q for k, q, _ in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in [*toxic.values(), *good.values()])
    assert len(toxic) == 402


def test_scores_without_labels_and_of_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(awkward(spark), toxicity.train_toxicity(awkward(spark), none)).collect()
    assert len(rows) == 12 and {round(r["score"], 6) for r in rows} == {0.5}
    assert quality.quality_scores(frame(spark, []), quality.train_quality(frame(spark, []), none)).count() == 0
    assert toxicity.without_toxic(awkward(spark), toxicity.train_toxicity(awkward(spark), none)).columns == awkward(spark).columns


def test_labels_of_held_out_rows_are_never_learnt(spark):
    docs, labels, _ = _labelled(spark, random.Random(7), 150)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    one, other = (toxicity.train_toxicity(docs, part) for part in (labels, turned))
    assert np.array_equal(one.weights, other.weights) and one.slope == other.slope


def test_features_cover_whole_texts():
    assert len(linear.features("", (2, 3), True)) == 0
    tail = "z" * 5000
    assert not np.array_equal(linear.features(tail + "abc", (3,), True), linear.features(tail, (3,), True))


def test_fingerprints_equal_their_twin(spark):
    text, good = compare(spark, connect("/root/testdata/sf0.001"), "op10", entry.queries()["op10_merkle_fingerprints"],
                         entry.oracle_sql()["op10_merkle_fingerprints"], "/root/testdata/sf0.001")
    assert good, text


def test_fingerprints_of_awkward_rows_and_edits(spark):
    rows = merkle.fingerprints(awkward(spark)).collect()
    assert len(rows) == 12
    by_text = {(r["n_chars"], r["fingerprint"]) for r in rows if r["doc_id"] in (3, 4)}
    assert len(by_text) == 1
    assert [r["near_next"] for r in rows if r["doc_id"] == 1 and r["n_chars"] == 0][0] == 1.0
    alone = merkle.fingerprints(frame(spark, ["abcdefgh"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1.0
    assert merkle.fingerprints(frame(spark, [])).count() == 0
    pair = frame(spark, ["a b c\n\nd e f\n\ng h i\n", "a b c\n\nd E f\n\ng h i\n"])
    prints = [r["fingerprint"] for r in merkle.fingerprints(pair).orderBy("doc_id").collect()]
    both = spark.createDataFrame([tuple(prints)], "x string, y string")
    differing = both.select(merkle.differing_sections(both["x"], both["y"])).first()[0]
    assert prints[0] != prints[1] and len(differing) == 1


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(8)
    docs, labels, truth = _labelled(spark, rng, 120)
    item = prose(rng, 30)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    extra = frame(spark, [base, " ".join(near), prose(rng, 40) + " " + item, "shared line that comes twice\n" + prose(rng, 50), prose(rng, 50) + "\nshared line that comes twice"],
                  [500, 501, 502, 503, 504])
    docs.unionByName(extra).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert {500, 503, 504} <= set(rows) and not {501, 502} & set(rows)
    assert rows[504]["text"].count("\n") == 0 and rows[504]["n_chars"] == len(rows[504]["text"])
    toxic = {k for k, _, t in truth if t}
    assert len(toxic & set(rows)) <= 2 and len({k for k, _, t in truth if not t} - set(rows)) <= 2
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == set(rows)
