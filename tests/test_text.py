import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from lorespark.functions import text as t


def test_name_key_matches_the_driver_rule(spark):
    random.seed(7)
    blocks = [(32, 126), (0xA0, 0x24F), (0x300, 0x36F), (0x2000, 0x33FF), (0xFB00, 0xFB06), (0x1D400, 0x1D7FF), (0x900, 0xD7F)]
    samples = ["".join(chr(random.randint(*random.choice(blocks))) for _ in range(20)) for _ in range(400)]
    samples += ["Électrik œufs d'Alola", "Straße", "", "♀", "’x’"]
    rows = spark.createDataFrame([(s,) for s in samples] + [(None,)], "s string").select("s", t.name_key_column(F.col("s")).alias("k")).collect()
    assert all(row.k == t.name_key(row.s) for row in rows)


def test_other_normalisers(spark):
    row = spark.range(1).select(
        t.words_key_column(F.lit("Œufs d’Été ?")).alias("words"), t.slug_column(F.lit("Nidoran♀ Élu")).alias("slug"),
        t.display_fold_column(F.lit("Expuls’Organes")).alias("fold"), t.ascii_lower(F.lit("ÉCLAIR")).alias("ascii")).first()
    assert (row.words, row.slug, row.fold, row["ascii"]) == ("oeufs d ete", "nidoran_f_elu", "expuls'organes", "Éclair")


def test_token_counts(spark):
    random.seed(3)
    texts = [" ".join(random.choices(string.ascii_lowercase[:6], k=random.randint(0, 40))) for _ in range(50)] + ["L'été, c'est l'été"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for row in df.select("x", t.token_counts_column(t.tokens_column(F.col("x"))).alias("c")).collect():
        assert {item.term: item.tf for item in row.c} == dict(Counter(re.findall(t.TOKEN_PATTERN, row.x.lower())))


def test_json_object(spark):
    texts = ["```json\n{\"a\": 1}\n```", "voici {\"a\": {\"b\": 2}} fin", "rien", "{cassé", "[1]"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(t.json_object_column(F.col("x")).alias("j")).collect()
    assert [row.j for row in rows] == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None]


def test_headers():
    assert t.unique_headers(["Nom", "Type 1", "type-1", None, "2e"]) == ["nom", "type_1", "type_1_2", "column_4", "_2e"]
    assert t.sanitise_identifier("1 a-b") == "_1_a_b"
