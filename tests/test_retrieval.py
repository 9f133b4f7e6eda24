import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions.text import TOKEN_PATTERN, token_counts_column, tokens_column
from lorespark.operators import fusion, lexical, sections, vectors
from lorespark.plans import retrieval
from lorespark.sources import documents

random.seed(11)
WORDS = ["le", "feu", "eau", "roche", "type", "force", "lune", "soleil", "vent", "nuit", "rare", "unique"]
CORPUS = [(n, "fr" if n % 3 else "de", " ".join(random.choices(WORDS[: 4 + n % 9], k=random.randint(0, 25)))) for n in range(60)]
QUERIES = [(1, "fr", "feu feu rare lune"), (2, "de", "le type unique"), (3, "xx", "feu"), (4, "fr", "absent")]


def bm25(query, documents):
    tokens = {n: re.findall(TOKEN_PATTERN, text.lower()) for n, _, text in documents}
    size, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {}
    for words in tokens.values():
        for word in set(words):
            df[word] = df.get(word, 0) + 1
    idf = {w: math.log(size - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    scores = {}
    for n, words in tokens.items():
        total = 0.0
        for word in re.findall(TOKEN_PATTERN, query.lower()):
            tf = words.count(word)
            total += idf.get(word, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        scores[n] = round(total, 6)
    return scores


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("rows", [100_000, 7, 1])
def test_bm25_in_blocks_of_any_size(spark, scoped, rows):
    corpus = spark.createDataFrame(CORPUS, "n long, lang string, text string")
    queries = spark.createDataFrame(QUERIES, "q long, scope string, text string")
    index = lexical.lexical_index(corpus, "n", "text", "lang")
    found = lexical.bm25_topk(index, queries, query_id="q", text="text", k=10, scope="scope" if scoped else None, range_documents=rows).collect()
    for q, scope, text in QUERIES:
        scores = bm25(text, CORPUS)
        eligible = [n for n, lang, _ in CORPUS if not scoped or lang == scope]
        expected = sorted(eligible, key=lambda n: (-scores[n], n))[:10]
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r.bm25_rank)
        assert [r.doc_id for r in rows] == expected
        assert [r.score for r in rows] == pytest.approx([scores[n] for n in expected], abs=2e-6)


@pytest.mark.parametrize("scope", [False, True])
@pytest.mark.parametrize("bound", [1, 3])
def test_nearest_with_any_number_of_groups(spark, scope, bound):
    rng = np.random.default_rng(5)
    docs = [(int(n), rng.normal(size=6).astype(float).tolist(), "ab"[n % 2]) for n in range(80)]
    asked = [(int(n), rng.normal(size=6).astype(float).tolist(), "ab"[n % 2]) for n in range(7)]
    corpus = spark.createDataFrame(docs, "doc_id long, vector array<double>, scope string")
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>, scope string")
    found = vectors.nearest(corpus, queries, k=9, scope=scope, groups=bound).collect()
    for q, vector, own in asked:
        distance = {n: round(1 - np.dot(v, vector) / np.linalg.norm(v) / np.linalg.norm(vector), 6) for n, v, s in docs if not scope or s == own}
        expected = sorted(distance, key=lambda n: (distance[n], n))[:9]
        assert [r.doc_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.vector_rank)] == expected


def _embedded(rng, n, dims=8):
    return [(int(i), (rng.normal(size=dims) + 6 * (np.arange(dims) == i % dims)).tolist(), "ab"[i % 2]) for i in range(n)]


@pytest.mark.parametrize("scope", [False, True])
def test_exact_index_search_equals_the_scan(spark, scope):
    rng = np.random.default_rng(8)
    docs = _embedded(rng, 300) + [(1000, [0.0] * 8, "a"), (1001, [0.0] * 8, "b"), (1002, None, "a"), (1003, [1.0] * 8, None)]
    asked = _embedded(rng, 20) + [(500, [0.0] * 8, "a"), (501, docs[3][1], "c")]
    corpus = spark.createDataFrame(docs, "doc_id long, vector array<double>, scope string")
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>, scope string")
    index = vectors.vector_index(corpus, scope=scope, cells=12)
    for probes in (1, 4, 12):
        found = vectors.search_index(index, queries, k=10, probes=probes, exact=True)
        scan = vectors.nearest(corpus, queries, k=10, scope=scope)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect()))


def test_index_recall_with_few_probes(spark):
    rng = np.random.default_rng(9)
    corpus = spark.createDataFrame(_embedded(rng, 1200, 16), "doc_id long, vector array<double>, scope string")
    queries = corpus.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector", "scope")
    index = vectors.vector_index(corpus)
    probes = vectors.calibrated_probes(index, k=10, queries=20)
    assert probes < len(index.centroids)
    found, scan = ({(r.query_id, r.doc_id) for r in df.collect()} for df in (
        vectors.search_index(index, queries, k=10, probes=probes), vectors.nearest(corpus, queries, k=10)))
    assert len(found & scan) >= 0.9 * len(scan)
    empty = vectors.vector_index(corpus.where("doc_id < 0"))
    assert vectors.search_index(empty, queries, exact=True).count() == 0


def test_export_report_finds_one_changed_vector_and_one_doubled_row(spark):
    rng = np.random.default_rng(10)
    rows = [(i, v) for i, v, _ in _embedded(rng, 60)]
    frame = lambda data: spark.createDataFrame(data, "doc_id long, vector array<double>")
    changed = [(i, [x + 1e-9 for x in v] if i == 7 else v) for i, v in rows]
    lost = [(i, [0.0] * 8 if i == 7 else v) for i, v in rows]
    report = lambda data: tuple(documents.export_report(frame(rows), frame(data)).first())
    assert report(rows[::-1]) == (60, 60, True, 0)
    assert report(changed)[2] is False and report(rows[:-1] + rows[:1])[:3] == (60, 60, False) and report(lost) == (60, 60, False, 1)


def test_bm25_skips_blocks_below_the_floor(spark):
    # A rare word next to a frequent one: ranges without the rare word cannot reach the first places.
    rng = random.Random(12)
    texts = [(n, None, " ".join(rng.choices(["bois", *(f"mot{i}" for i in range(60))], k=10)) + (" rare rare rare" if n % 40 == 7 else "")) for n in range(2000)]
    corpus = spark.createDataFrame(texts, "n long, lang string, text string")
    queries = spark.createDataFrame([(1, "rare bois"), (2, "rare")], "q long, text string")
    index = lexical.lexical_index(corpus, "n", "text")
    found, visits = lexical.ranked_blocks(index, queries, query_id="q", text="text", k=3, range_documents=8)
    scores = {q: bm25(text, [(n, None, t) for n, _, t in texts]) for q, text in ((1, "rare bois"), (2, "rare"))}
    for q in (1, 2):
        expected = sorted(scores[q], key=lambda n: (-scores[q][n], n))[:3]
        assert [r.doc_id for r in sorted((r for r in found.collect() if r.query_id == q), key=lambda r: r.bm25_rank)] == expected
    read = {r["query_id"]: (r["blocks_read"], r["blocks"]) for r in visits.collect()}
    assert read[1][0] < read[1][1] / 2 and read[2][1] < 60


def test_bm25_orders_negative_scores_and_null_scopes_alike(spark):
    # "mot" is the whole vocabulary and stands in most documents: its weight is negative, so documents without it come first.
    corpus = spark.createDataFrame([(0, None, "mot"), (1, "a", "mot mot"), (2, "a", "mot"), (3, None, ""), (4, "a", "")], "n long, lang string, text string")
    queries = spark.createDataFrame([(1, None, "mot"), (2, "a", "mot")], "q long, scope string, text string")
    index = lexical.lexical_index(corpus, "n", "text", "lang")
    for rows in (100_000, 1):
        found = lexical.bm25_topk(index, queries, query_id="q", text="text", k=2, range_documents=rows).collect()
        assert {(r.query_id, r.bm25_rank): r.doc_id for r in found} == {(q, n + 1): doc for q in (1, 2) for n, doc in enumerate((3, 4))}
        scoped = lexical.bm25_topk(index, queries, query_id="q", text="text", k=2, scope="scope", range_documents=rows).collect()
        assert {(r.query_id, r.bm25_rank): r.doc_id for r in scoped} == {(1, 1): 3, (1, 2): 0, (2, 1): 4, (2, 2): 2}


def test_fusion_order_and_ties(spark):
    near = spark.createDataFrame([(1, 10, 0.1, 1), (1, 11, 0.2, 2)], "query_id long, doc_id long, score double, vector_rank int")
    words = spark.createDataFrame([(1, 11, 9.0, 1), (1, 12, 8.0, 2)], "query_id long, doc_id long, score double, bm25_rank int")
    rows = fusion.reciprocal_rank_fusion(near, words).orderBy("rrf_rank").collect()
    assert [row.doc_id for row in rows] == [11, 10, 12]
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    tied = fusion.reciprocal_rank_fusion(near.limit(1), words.limit(1)).orderBy("rrf_rank").collect()
    assert [row.doc_id for row in tied] == [10, 11]


def recursive_split(text, size, overlap, marks):
    """Plain restatement of recursive splitting, used as a twin."""
    mark = next(m for m in marks if m == "" or m in text)
    rest = marks[marks.index(mark) + 1:]
    parts = list(text)
    if mark:
        pieces = re.split(f"({re.escape(mark)})", text)
        parts = [p for p in [pieces[0], *["".join(pieces[i:i + 2]) for i in range(1, len(pieces), 2)]] if p]
    out, buffer = [], []

    def flush():
        start, length, window = 0, 0, []
        for part in buffer:
            if length + len(part) > size:
                if window and "".join(window).strip():
                    out.append("".join(window).strip())
                while length > overlap or (length + len(part) > size and length > 0):
                    length -= len(window[0])
                    window = window[1:]
            window.append(part)
            length += len(part)
        if "".join(window).strip():
            out.append("".join(window).strip())
        buffer.clear()

    for part in parts:
        if len(part) < size:
            buffer.append(part)
        else:
            if buffer:
                flush()
            out.extend(recursive_split(part, size, overlap, rest) if rest else [part])
    if buffer:
        flush()
    return out


def test_splitter_matches_its_twin():
    random.seed(2)
    for _ in range(200):
        text = "".join(random.choices(["mot", " ", "\n", "\n\n", ". ", "x" * 15, "été"], k=random.randint(1, 60))).strip() or "x"
        size, overlap = random.randint(8, 60), random.randint(0, 8)
        assert sections.split_text(text, size, overlap) == recursive_split(text, size, overlap, sections.SEPARATORS)


MARKDOWN = "intro\n\n# Titre\nsous le titre\n## A ##\ntexte a\n### B\n\n### C\ntexte c\n## D\n" + "phrase longue. " * 120


def test_sections_and_chunks(spark):
    df = spark.createDataFrame([("0001_x.md", "Titre", MARKDOWN), ("e.md", "E", "  \n "), ("s.md", "S", "# Seul")], "f string, t string, x string")
    row = df.select("f", sections.markdown_sections(F.col("x")).alias("s")).filter("f = '0001_x.md'").first()
    assert [(" > ".join(s.path), s.body[:13]) for s in row.s] == [
        ("", "intro"), ("", "sous le titre"), ("A", "texte a"), ("A > C", "texte c"), ("D", "phrase longue")]
    chunks = sections.chunk_documents(df, source_file="f", title="t", text="x")
    rows = chunks.orderBy("source_file", "chunk_number").collect()
    assert {r.source_file for r in rows} == {"0001_x.md", "s.md"}
    assert [r.text for r in rows if r.source_file == "s.md"] == ["# Seul"]
    own = [r for r in rows if r.source_file == "0001_x.md"]
    assert [r.chunk_number for r in own] == list(range(len(own))) and len(own) > 6
    last = [r for r in own if r.section_path == "D"]
    assert [r.section_chunk_number for r in last] == list(range(len(last))) and max(len(r.text) for r in last) <= 900
    header = "Pokémon : Titre\nSection principale : D\nChemin : D"
    expected = sections.split_text(("phrase longue. " * 120).strip(), 900 - len(header) - 2, 120)
    assert [r.text for r in last] == expected
    assert own[3].search_text == "Pokémon : Titre\nSection principale : A\nSous-section : C\nChemin : A > C\n\ntexte c"
    assert re.fullmatch(r"pokemon::0001_x\.md::section::[0-9a-f]{10}::chunk::00003", own[3].chunk_id)
    sections.require_ingestible(chunks)


@pytest.mark.parametrize("size,seed", [(3, 1), (8, 7), (20, 0), (20, 10), (20, 19), (9, 8)])
def test_window_is_clamped(spark, size, seed):
    chunks = spark.createDataFrame([("f", "p", n, n + 100) for n in range(size)], "f string, p string, n int, c int")
    seeds = spark.createDataFrame([("f", "p", seed, seed + 100)], "f string, p string, n int, expanded_from int")
    found = sorted(r.n for r in sections.expand_sections(seeds, chunks, ["f", "p"], "n", "c").collect())
    start = max(0, seed - 4)
    end = min(size, start + 8)
    assert found == list(range(max(0, end - 8), end))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = []
    for entity in ("Renard", "Maréon"):
        for path, topic in (("Habitat", "forêt nuit"), ("Statistiques > Vitesse", "vitesse attaque"), ("Description", "queue feu")):
            for n in range(3):
                rows.append((len(rows), entity, f"{entity}.md", path, len(rows) % 9, n, f"{entity} {topic} {n}", rng.normal(size=4).tolist()))
    schema = "doc_id long, scope string, source_file string, section_path string, chunk_number int, section_chunk_number int, text string, vector array<double>"
    folder = str(tmp_path_factory.mktemp("store"))
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def test_pipeline_scope_is_strict(spark, store):
    asked = spark.createDataFrame(
        [(1, "vitesse du renard", "renard", [1.0, 0.0, 0.0, 0.0]), (2, "forêt", "Inconnu", [1.0, 0.0, 0.0, 0.0]), (3, "queue feu", None, [0.0, 1.0, 0.0, 0.0])],
        "query_id long, question string, scope string, vector array<double>")
    found = retrieval.retrieve(store, asked)
    rows = found.collect()
    assert {r.query_id for r in rows} == {1, 3}
    own = sorted((r for r in rows if r.query_id == 1), key=lambda r: r.reranker_rank)
    assert {r.scope for r in own} == {"Renard"} and len(own) == 5
    assert own[0].section_path == "Statistiques > Vitesse"
    around = [r for r in retrieval.context(found, store).collect() if r.query_id == 1]
    assert sorted(r.section_chunk_number for r in around) == [0, 1, 2]
    again = asked.withColumn("reason", F.lit("habitat")).withColumn("excluded_section", F.lit("Statistiques > Vitesse"))
    retry = [r for r in retrieval.retry_context(store, again.filter("query_id = 1")).collect()]
    assert retry and {r.section_path for r in retry} == {"Habitat"}


def test_section_words_carry_no_text(spark, tmp_path, monkeypatch):
    """Sections as long as their text meet questions by hashes: no step before the choice writes or shuffles the text with its words."""
    text = " ".join(f"mot{n}" for n in range(3000))
    chunks = spark.createDataFrame([("s", f"{k} {text} cible{k % 2}", k, k) for k in range(8)] + [("s", "  ", 9, 9), (None, "cible0", 10, 10)],
                                   "scope string, section_path string, chunk_number long, doc_id long")
    questions = spark.createDataFrame([(1, "s", "mot7 cible1"), (2, "s", "le"), (3, "t", "mot7")], "query_id long, scope string, question string")
    read = []
    real = fusion.ranked_topk
    monkeypatch.setattr(fusion, "ranked_topk", lambda df, *rest: read.append(df.columns) or real(df, *rest))
    rows = fusion.section_candidates(chunks, questions, n_candidates=4).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(rows, key=lambda r: r.section_rank)] == [(1, 1), (1, 3), (1, 5), (1, 7)]
    assert all(r.section_path == f"{r.doc_id} {text} cible1" for r in rows)
    assert read and all("section_path" not in columns for columns in read)


def test_words_are_counted_without_interpreted_lambdas(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS_COUNTED", 2)
    texts = ["Feu feu l'eau", None, "", "?! 12", "ÉÉ éé Œuf œuf İl Straße -a", "a\nb\ta " * 50, "\u212a k ΟΔΟΣ"]
    docs = spark.createDataFrame([(n, text, None if n % 2 else n) for n, text in enumerate(texts)] + [(None, "a", 1)], "n long, text string, s int")
    index = lexical.lexical_index(docs, "n", "text", "s")
    assert "lambda" not in index._jdf.queryExecution().executedPlan().toString()
    tokens = tokens_column(F.coalesce("text", F.lit("")))
    expected = docs.select("n", F.col("s").cast("string"), token_counts_column(tokens).alias("counts"), F.size(tokens)).collect()
    assert [(r[0], r[1], sorted(r[2]), r[3]) for r in index.collect()] == [(r[0], r[1], sorted(r[2]), r[3]) for r in expected]
    assert index.columns == ["doc_id", "scope", "counts", "length"]


def test_documents_are_not_gathered_by_scope(spark):
    documents_ = spark.createDataFrame([(n, f"mot{n % 5} texte", "fr") for n in range(40)], "doc_id long, text string, lang string")
    index = lexical.lexical_index(documents_, "doc_id", "text", "lang")
    blocks = lexical.posting_blocks(index, lexical.term_totals(index), range_documents=10)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(scope_key#\d+, \d+\)", plan)
    assert {row["range"] for row in blocks.collect()} == {0, 1, 2, 3}


def test_bodies_are_split_a_few_documents_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sections, "DOCUMENTS_AT_ONCE", 3)
    bodies = pa.array([["a b " * 300, None], [], [None], ["c" * 900]] * 2)
    sizes = pa.array([[350, 350], [], [350], [400]] * 2)
    found = sections.split_bodies.func(bodies, sizes).to_pylist()
    assert found == [[sections.split_text("a b " * 300, 350, 87), None], [], [None], [sections.split_text("c" * 900, 400, 100)]] * 2
    assert sections.split_bodies.func(bodies.slice(0, 0), sizes.slice(0, 0)).to_pylist() == []
