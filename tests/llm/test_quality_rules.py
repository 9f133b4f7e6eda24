import random
import re

import numpy as np

import __spark_entry__ as entry
from lorespark.llm import quality_rules
from tests.llm.helpers import awkward, frame, prose
from tests.oracle import compare, connect


def base(text):
    """Plain version of the base statistics."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def columns(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_base_statistics_equal_the_plain_version(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "é😀", "#", " ", " ", " ", "\n", "\t", " ", "\x0b", "\r"]) for _ in range(rng.randrange(300))) for _ in range(150)]
    texts += [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a", "x\nx\n\nx y\nx y\n", prose(rng, 80), "a\r\na\r\n"]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert [columns(got[k]) for k in range(len(texts))] == [base(t) for t in texts]


def test_awkward_rows_long_texts_and_no_rows(spark):
    docs = awkward(spark)
    rows = quality_rules.quality_rules(docs).collect()
    assert sorted((columns(r) for r in rows)) == sorted(base(r["text"]) for r in docs.collect())
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    long = " ".join(f"w{k % 9000}" for k in range(30_000))
    row = quality_rules.quality_rules(frame(spark, [long])).first()
    assert row["n_repeat_words"] == 30_000 and row["base_failed"] and not row["kept"]


def _rows(spark, groups):
    names = [f"z_{name}" for name in quality_rules.STATISTICS]
    data = [(lang, "s", *map(int, z)) for lang, zs in groups.items() for z in zs]
    return spark.createDataFrame(data, "lang string, source string, " + ", ".join(f"{n} long" for n in names))


def test_estimates_withstand_a_third_of_outliers(spark):
    rng = np.random.default_rng(3)
    mix = np.eye(6) * 300 + rng.normal(size=(6, 6)) * 50  # well above the floor
    good = rng.normal(size=(600, 6)) @ mix
    bad = rng.normal(size=(280, 6)) * 20 + 4000
    groups = {"a": np.rint(np.vstack([good, bad])), "b": np.rint(rng.normal(size=(400, 6)) * 80)}
    rows = _rows(spark, groups)
    state = {r["lang"]: r for r in quality_rules.robust_state(rows).collect()}
    assert np.allclose(state["a"]["mean"], good.mean(axis=0), atol=60)
    inverse = np.zeros((6, 6))
    for (i, j), value in zip(quality_rules.PAIRS, state["a"]["inverse"]):
        inverse[i, j] = value
    ratio = np.linalg.eigvals(np.linalg.inv(inverse.T @ inverse) @ np.linalg.inv(np.cov(good.T)))
    assert 0.5 < ratio.real.min() and ratio.real.max() < 2
    far = quality_rules.with_distance(rows, quality_rules.robust_state(rows)).where("distance > 22.46")
    assert far.where("lang = 'a' AND z_length > 2000").count() == 280 and far.where("z_length <= 2000").count() <= 20


def test_one_step_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(4)
    z = np.rint(rng.normal(size=(80, 6)) * 100)
    state = quality_rules.estimate(quality_rules._sums(_rows(spark, {"a": z})), 1.3).first()
    prior, floor = np.diag((np.array(quality_rules.PRIOR) * 512) ** 2), np.diag((np.array(quality_rules.FLOOR) * 512) ** 2)
    cov = (80 * 1.3 * np.cov(z.T, bias=True) + 20 * prior) / 100 + floor
    inverse = np.linalg.inv(np.linalg.cholesky(cov))
    assert np.allclose(state["mean"], z.mean(axis=0)) and np.allclose(state["inverse"], [inverse[i, j] for i, j in quality_rules.PAIRS])


def test_rules_reject_junk_of_any_group_and_keep_prose(spark, tmp_path):
    rng = random.Random(5)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = []
    for k in range(160):
        text = prose(rng, rng.randrange(60, 400))
        if k % 8 == 0:
            text = " | ".join(text.split()[:80])
        if k % 8 == 1:
            text = " ".join(w + "%%%" for w in text.split())
        data.append((k, text, None if k % 3 == 0 else "en", "s1" if k % 2 else None, len(text)))
    docs = spark.createDataFrame(data, schema)
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(rows[k]["kept"] == (k % 8 > 1) for k in range(160) if not rows[k]["base_failed"])
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = connect("/nonexistent")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "op12_robust_quality_rules"
    text, good = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert good, text
