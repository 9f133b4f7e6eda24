"""Registered queries of the text and retrieval operators over the warehouse texts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import name_key_column, section_tokens_column, tokens_column
from lorespark.operators import fidelity, fusion, lexical, mentions, ranking, sections, vectors
from lorespark.operators.evaluation import first_hit_rank, recall_and_mrr
from lorespark.session import table, wide_table, written
from lorespark.sources.documents import export_report

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


def key_sql(expression: str) -> str:
    """SQL twin of the name key."""
    return f"trim(regexp_replace(replace(strip_accents(lower({expression})), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-')"


TOKEN_SQL = "[0-9A-Za-zÀ-ÖØ-öø-ÿŒœÆæÉéÈèÊêËëÇç''-]+"
STOPWORDS_SQL = ("['a','à','au','aux','avec','ce','ces','cette','dans','de','des','du','elle','en','et','il','la','le','les','leur',"
                 "'leurs','lui','par','pour','que','quel','quelle','quelles','quels','qui','sa','ses','son','sur','un','une']")


def documents(spark, sf) -> DataFrame:
    return wide_table(spark, sf, "documents")


@query("normalize_keys", f"""
SELECT doc_id, md5({key_sql('text')}) AS key_hash, length({key_sql('text')}) AS key_length FROM documents""")
def normalize_keys(spark, sf):
    key = documents(spark, sf).select("doc_id", name_key_column(F.col("text")).alias("key"))
    return key.select("doc_id", F.md5("key").alias("key_hash"), F.length("key").cast("long").alias("key_length"))


@query("normalize_part_names", f"SELECT {key_sql('p_name')} AS name_key, count(*) AS n FROM part GROUP BY 1")
def normalize_part_names(spark, sf):
    return table(spark, sf, "part").groupBy(name_key_column(F.col("p_name")).alias("name_key")).agg(F.count(F.lit(1)).alias("n"))


_ALIASES_SQL = f"""names AS (SELECT item_id, {key_sql('text')} AS alias_key FROM benchmark
    UNION ALL SELECT item_id, {key_sql('s')} FROM (SELECT item_id, unnest(string_split(text, '. ')) AS s FROM benchmark)),
aliases AS (SELECT alias_key, min(item_id) AS target FROM names WHERE alias_key <> '' GROUP BY 1)"""


def _aliases(spark, sf) -> DataFrame:
    """Each whole benchmark text and each of its sentences, as names of its item (the first item that has the name)."""
    items = table(spark, sf, "benchmark")
    parts = items.select("item_id", F.explode(F.concat(F.array("text"), F.split("text", r"\. ", -1))).alias("name"))
    return parts.groupBy(name_key_column(F.col("name")).alias("alias_key")).agg(F.min("item_id").alias("target")).filter("alias_key <> ''")


@query("mention_lookup_unique", f"""
WITH {_ALIASES_SQL}, t AS (SELECT doc_id, '-' || {key_sql('text')} || '-' AS k FROM documents),
m AS (SELECT DISTINCT doc_id, target, alias_key FROM t JOIN aliases ON contains(k, '-' || alias_key || '-'))
SELECT doc_id, min(target) AS target FROM m GROUP BY doc_id HAVING count(*) = 1""")
def mention_lookup_unique(spark, sf):
    return mentions.unique_mention(mentions.mentions(documents(spark, sf).select("doc_id", "text"), "doc_id", "text", _aliases(spark, sf)), "doc_id")


_MENTIONS_SQL = f"""{_ALIASES_SQL}, w AS (SELECT doc_id, {key_sql('text')} AS k, string_split({key_sql('text')}, '-') AS words FROM documents),
hit AS (SELECT doc_id, words, alias_key, target, len(string_split(alias_key, '-')) AS size FROM w JOIN aliases ON contains('-' || k || '-', '-' || alias_key || '-')),
m AS (SELECT doc_id, i - 1 AS start, size, target, alias_key FROM hit, unnest(range(1, len(words) - size + 2)) u(i) WHERE array_to_string(words[i:i + size - 1], '-') = alias_key),
longest AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m l WHERE l.doc_id = m.doc_id AND l.size > m.size AND l.start <= m.start AND l.start + l.size >= m.start + m.size))"""


@query("longest_mention", f"WITH {_MENTIONS_SQL} SELECT doc_id, target, count(*) AS mentions, CAST(sum(size) AS BIGINT) AS words FROM longest GROUP BY doc_id, target")
def longest_mention(spark, sf):
    texts = documents(spark, sf).select("doc_id", "text")
    found = mentions.dealt_mentions(texts, mentions.mentions(texts, "doc_id", "text", _aliases(spark, sf)), "doc_id")
    kept = mentions.longest_mentions(found, "doc_id").select("doc_id", "start", "size", "target").distinct()
    return kept.groupBy("doc_id", "target").agg(F.count(F.lit(1)).alias("mentions"), F.sum("size").alias("words"))


@query("required_mention", f"""WITH {_MENTIONS_SQL}, t AS (SELECT doc_id, list_sort(list(DISTINCT target::VARCHAR)) AS targets FROM longest GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(targets) = 1 THEN targets[1] END AS target, CASE WHEN len(targets) > 1 THEN 'several names: ' || array_to_string(targets, ', ') END AS error
FROM documents LEFT JOIN t USING (doc_id)""")
def required_mention(spark, sf):
    """The one item each document names, or an error where it names several."""
    texts = documents(spark, sf).select("doc_id", "text")
    return mentions.required_mention(texts, mentions.mentions(texts, "doc_id", "text", _aliases(spark, sf)), "doc_id")


# ---- sections and chunks -----------------------------------------------------


def _markdown(spark, sf) -> DataFrame:
    """Documents with headings: every fourth line opens a section, every other even line a subsection."""
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.trim(line) != "")
    return documents(spark, sf).select("doc_id", "lang", F.array_join(F.transform(lines, lambda line, i: F.when(
        i % 4 == 0, F.concat(F.lit("## S"), i, F.lit("\n"), line)).when(
        i % 4 == 2, F.concat(F.lit("### T"), i, F.lit("\n"), line)).otherwise(line)), "\n").alias("text"))


_LINES_SQL = """w AS (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
lines AS (SELECT doc_id, lang, i - 1 AS i, l[i] AS line FROM w, unnest(range(1, len(l) + 1)) u(i)),
sec AS (SELECT doc_id, lang, i - i % 2 AS first_line, string_agg(rtrim(line), chr(10) ORDER BY i) AS body FROM lines GROUP BY ALL),
paths AS (SELECT doc_id, lang, first_line, trim(body) AS body, CASE WHEN first_line % 4 = 0 THEN 'S' || first_line
    ELSE 'S' || (first_line - 2) || ' > T' || first_line END AS path FROM sec)"""


@query("markdown_section_paths", f"""WITH {_LINES_SQL} SELECT doc_id, path AS section_path, md5(body) AS body_hash FROM paths""")
def markdown_section_paths(spark, sf):
    rows = _markdown(spark, sf).select("doc_id", F.explode(sections.markdown_sections(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.array_join("s.path", " > ").alias("section_path"), F.md5("s.body").alias("body_hash"))


def _chunks(spark, sf) -> DataFrame:
    source = _markdown(spark, sf).withColumn("source_file", F.format_string("%04d_doc.md", "doc_id")).withColumn(
        "title", F.concat(F.lit("doc "), "doc_id"))
    return sections.chunk_documents(source, source_file="source_file", title="title", text="text", keep=("doc_id", "lang"))


@query("section_chunks")
def section_chunks(spark, sf):
    return _chunks(spark, sf).select(
        "chunk_id", "doc_id", "chunk_number", "section_chunk_number", "section_path", "section_depth", F.md5("text").alias("text_hash"))


@query("section_chunk_ids", f"""WITH {_LINES_SQL} SELECT doc_id, path AS section_path,
    'pokemon::' || printf('%04d', doc_id) || '_doc.md::section::' || substr(sha1(path), 1, 10) || '::chunk::' AS id_head, 1::BIGINT AS heads, true AS numbered FROM paths""")
def section_chunk_ids(spark, sf):
    """Per section, over all its chunks: what their identifiers begin with, and whether each ends with the number of its chunk."""
    number = F.regexp_extract("chunk_id", r"(\d+)$", 1)
    head = F.substring(F.col("chunk_id"), F.lit(1), F.length("chunk_id") - F.length(number))
    rows = _chunks(spark, sf).select("doc_id", "section_path", head.alias("head"), (number == F.format_string("%05d", "chunk_number")).alias("numbered"))
    return rows.groupBy("doc_id", "section_path").agg(
        F.min("head").alias("id_head"), F.countDistinct("head").alias("heads"), F.bool_and("numbered").alias("numbered"))


@query("chunk_conservation", f"""WITH {_LINES_SQL} SELECT count(DISTINCT (doc_id, path)) AS sections, true AS unique_ids, true AS numbers_consecutive,
    true AS sizes_bounded FROM paths""")
def chunk_conservation(spark, sf):
    rows = _chunks(spark, sf)
    per_document = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("chunk_number").alias("last"), F.countDistinct("section_path").alias("sections"),
        F.max(F.length("text")).alias("longest"), F.countDistinct("chunk_id").alias("ids"))
    return per_document.agg(
        F.sum("sections").alias("sections"), (F.sum("ids") == F.sum("n")).alias("unique_ids"),
        F.bool_and(F.col("last") + 1 == F.col("n")).alias("numbers_consecutive"), (F.max("longest") <= 900).alias("sizes_bounded"))


@query("expand_window", """
WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, len(l) AS n, l, len(l) // 2 AS seed FROM w),
b AS (SELECT *, least(n, greatest(0, seed - 4) + 8) AS e FROM s)
SELECT doc_id, CAST(i AS BIGINT) AS line_number, md5(l[i + 1]) AS line_hash, i <> seed AS is_expansion
FROM b, unnest(range(greatest(0, e - 8), e)) u(i)""")
def expand_window(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.split("text", "\n", -1).alias("l"))
    rows = lines.select("doc_id", F.posexplode("l").alias("line_number", "line")).withColumn("chunk", F.col("line_number"))
    seeds = lines.select("doc_id", F.floor(F.size("l") / 2).cast("int").alias("line_number")).withColumn("expanded_from", F.col("line_number"))
    found = sections.expand_sections(seeds, rows.select("doc_id", "line_number", "chunk"), ["doc_id"], "line_number", "chunk")
    return found.join(rows.select("doc_id", "line_number", "line"), ["doc_id", "line_number"]).select(
        "doc_id", F.col("line_number").cast("long").alias("line_number"), F.md5("line").alias("line_hash"),
        F.col("is_section_expansion").alias("is_expansion"))


# ---- lexical and vector retrieval --------------------------------------------

_BM25_SQL = f"""
tok AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
dl AS (SELECT doc_id, lang, len(t) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
part AS (SELECT item_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
    FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
score AS (SELECT b.item_id, dl.doc_id, dl.lang, round(coalesce(s, 0), 6) AS score FROM benchmark b CROSS JOIN dl
    LEFT JOIN part ON part.item_id = b.item_id AND part.doc_id = dl.doc_id)"""


@query("bm25_topk", f"""WITH {_BM25_SQL}
SELECT item_id, doc_id, score, bm25_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS bm25_rank FROM score) WHERE bm25_rank <= 200""")
def bm25_topk(spark, sf):
    index = written(lexical.lexical_index(documents(spark, sf), "doc_id", "text"))
    found = lexical.bm25_topk(index, table(spark, sf, "benchmark"), query_id="item_id", text="text")
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "score", F.col("bm25_rank").cast("long").alias("bm25_rank"))


@query("bm25_scoped_topk", f"""WITH {_BM25_SQL}, sc AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'es' END AS scope FROM benchmark)
SELECT item_id, doc_id, score, bm25_rank FROM (
    SELECT score.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS bm25_rank
    FROM score JOIN sc USING (item_id) WHERE lang = scope) WHERE bm25_rank <= 200""")
def bm25_scoped_topk(spark, sf):
    index = written(lexical.lexical_index(documents(spark, sf), "doc_id", "text", "lang"))
    code = F.col("item_id") % 3
    questions = table(spark, sf, "benchmark").withColumn("scope", F.when(code == 0, "fr").when(code == 1, "de").otherwise("es"))
    found = lexical.bm25_topk(index, questions, query_id="item_id", text="text", scope="scope")
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "score", F.col("bm25_rank").cast("long").alias("bm25_rank"))


@query("term_statistics", f"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok)
SELECT term, count(*) AS df, round(ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5), 6) AS idf, round(any_value(avgdl), 6) AS mean_length
FROM tf, st GROUP BY term""")
def term_statistics(spark, sf):
    rows = lexical.term_statistics(lexical.term_totals(lexical.lexical_index(documents(spark, sf), "doc_id", "text")))
    return rows.select("term", "df", F.round("raw_idf", 6).alias("idf"), F.round("mean_length", 6).alias("mean_length"))


_VECTOR_SQL = """
c AS (SELECT label, list(m ORDER BY p) AS v FROM (
    SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) u(p) GROUP BY ALL) GROUP BY label),
d AS (SELECT c.label AS query_id, vec_id AS doc_id, e.label AS own,
    round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), v) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(v, v)), 6) AS score
    FROM c, embeddings e)"""


def _embedding_corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("scope"))


def _centroid_queries(spark, sf) -> DataFrame:
    found = vectors.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return found.select(F.col("label").alias("query_id"), "vector", F.col("label").cast("string").alias("scope"))


@query("vector_topk", f"""WITH {_VECTOR_SQL}
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, score AS distance, vector_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS vector_rank FROM d) WHERE vector_rank <= 100""")
def vector_topk(spark, sf):
    found = vectors.nearest(_embedding_corpus(spark, sf), _centroid_queries(spark, sf))
    return found.select("query_id", "doc_id", F.col("score").alias("distance"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query("vector_scoped_topk", f"""WITH {_VECTOR_SQL}
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, score AS distance, vector_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS vector_rank FROM d WHERE own = query_id) WHERE vector_rank <= 20""")
def vector_scoped_topk(spark, sf):
    found = vectors.nearest(_embedding_corpus(spark, sf), _centroid_queries(spark, sf), k=20, scope=True)
    return found.select("query_id", "doc_id", F.col("score").alias("distance"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query("vector_index_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(1 - list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 6) + 0.0 AS distance
    FROM e q JOIN e ON q.vec_id % 50 = 0)
SELECT query_id, doc_id, distance, vector_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS vector_rank FROM d) WHERE vector_rank <= 100""")
def vector_index_topk(spark, sf):
    """Every fiftieth vector asks the index of all vectors, exactly."""
    index = vectors.vector_index(_embedding_corpus(spark, sf))
    asked = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.search_index(index, asked, exact=True)
    return found.select("query_id", "doc_id", (F.col("score") + 0.0).alias("distance"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query("vector_export_check", "SELECT count(*) AS source_rows, count(*) AS exported_rows, true AS same_rows, 0::BIGINT AS vectors_lost FROM embeddings")
def vector_export_check(spark, sf):
    """A written copy of all vectors holds the same rows and finds each of them."""
    source = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return export_report(source, written(source))


@query("rrf_fusion", f"""WITH {_BM25_SQL}, bm AS (
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM score),
{_VECTOR_SQL.strip()}, vx AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id) AS r
    FROM benchmark JOIN d ON d.query_id = item_id % 10),
f AS (SELECT coalesce(v.query_id, b.item_id) AS query_id, coalesce(v.doc_id, b.doc_id) AS doc_id, v.r AS vr, b.r AS br,
    coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS s
    FROM (SELECT * FROM vx WHERE r <= 100) v FULL JOIN (SELECT * FROM bm WHERE r <= 200) b
    ON b.item_id = v.query_id AND b.doc_id = v.doc_id)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, vr AS vector_rank, br AS bm25_rank, round(s, 9) AS rrf_score, rrf_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vr NULLS LAST, br NULLS LAST) AS rrf_rank FROM f) WHERE rrf_rank <= 30""")
def rrf_fusion(spark, sf):
    """Every benchmark text, with the centroid of one of the ten labels as its vector, fused over document numbers."""
    items = table(spark, sf, "benchmark")
    vector = _centroid_queries(spark, sf).select(F.col("query_id").alias("label"), "vector")
    asked = items.withColumn("label", F.col("item_id") % 10).join(vector, "label").select(F.col("item_id").alias("query_id"), "vector")
    semantic = vectors.nearest(_embedding_corpus(spark, sf), asked)
    index = written(lexical.lexical_index(documents(spark, sf), "doc_id", "text"))
    words = lexical.bm25_topk(index, items, query_id="item_id", text="text")
    fused = fusion.reciprocal_rank_fusion(semantic, words)
    return fused.select(
        "query_id", "doc_id", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"),
        F.round("rrf_score", 9).alias("rrf_score"), F.col("rrf_rank").cast("long").alias("rrf_rank"))


@query("recall_mrr", f"""WITH {_BM25_SQL}, r AS (
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM score),
cases AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT item_id, min(r) FILTER (r <= 200) AS hit FROM cases LEFT JOIN r USING (item_id, doc_id) GROUP BY item_id)
SELECT count(*) AS cases, round(avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN hit <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3,
    round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr FROM h""")
def recall_mrr(spark, sf):
    """Benchmark texts held verbatim by documents are the graded cases of the lexical ranking."""
    texts, items = documents(spark, sf), table(spark, sf, "benchmark")
    index = written(lexical.lexical_index(texts, "doc_id", "text"))
    ranked = lexical.bm25_topk(index, items, query_id="item_id", text="text")
    holders = mentions.verbatim_holders(texts, "doc_id", "text", items, "item_id", "text")
    hits = holders.join(ranked.select(F.col("query_id").alias("item_id"), "doc_id", "bm25_rank"), ["item_id", "doc_id"], "left")
    ranks = hits.groupBy("item_id").agg(F.min("bm25_rank").alias("hit_rank"))
    scores = recall_and_mrr(ranks)
    return scores.select("cases", *[F.round(c, 6).alias(c) for c in scores.columns if c != "cases"])


@query("section_candidates", f"""
WITH {_LINES_SQL}, p AS (SELECT doc_id, lang, first_line, path || ' ' || body AS section_path FROM paths),
pt AS (SELECT DISTINCT lang, section_path FROM p),
pw AS (SELECT DISTINCT lang, section_path, word FROM (SELECT lang, section_path, unnest(regexp_extract_all(lower(section_path), '{TOKEN_SQL}')) AS word FROM pt)
    WHERE NOT list_contains({STOPWORDS_SQL}, word)),
np AS (SELECT lang, count(*) AS paths FROM pt GROUP BY lang), df AS (SELECT lang, word, count(*) AS df FROM pw GROUP BY ALL),
q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang,
    list_distinct(list_filter(regexp_extract_all(lower(text), '{TOKEN_SQL}'), lambda x: NOT list_contains({STOPWORDS_SQL}, x))) AS words FROM benchmark),
qw AS (SELECT item_id, lang, len(words) AS asked, unnest(words) AS word FROM q),
s AS (SELECT item_id, pw.lang, section_path, round(sum(ln((paths + 1) / (df + 1)) + 1) * (1 + count(*) / asked), 9) AS score
    FROM pw JOIN df USING (lang, word) JOIN np USING (lang) JOIN qw USING (lang, word) GROUP BY item_id, pw.lang, section_path, asked),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, section_path ORDER BY doc_id * 1000 + first_line) AS k FROM p),
r AS (SELECT item_id, doc_id * 1000 + first_line AS chunk, s.section_path, round(score, 6) AS score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id * 1000 + first_line) AS section_rank
    FROM s JOIN c ON c.lang = s.lang AND c.section_path = s.section_path WHERE k <= 2)
SELECT item_id, chunk, md5(section_path) AS section_hash, score, section_rank FROM r WHERE section_rank <= 12""")
def section_candidates(spark, sf):
    rows = _markdown(spark, sf).select("doc_id", "lang", F.explode(sections.markdown_sections(F.col("text"))).alias("s"))
    first_line = F.regexp_extract(F.element_at("s.path", -1), r"(\d+)$", 1).cast("long")
    chunks = rows.select(
        F.col("lang").alias("scope"), F.concat(F.array_join("s.path", " > "), F.lit(" "), "s.body").alias("section_path"),
        (F.col("doc_id") * 1000 + first_line).alias("chunk_number"), (F.col("doc_id") * 1000 + first_line).alias("doc_id"))
    code = F.col("item_id") % 4
    questions = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(code == 0, "en").when(code == 1, "fr").when(code == 2, "de").otherwise("es").alias("scope"),
        F.col("text").alias("question"))
    found = fusion.section_candidates(chunks, questions)
    return found.select(
        F.col("query_id").alias("item_id"), F.col("doc_id").alias("chunk"), F.md5("section_path").alias("section_hash"),
        F.round("section_structural_score", 6).alias("score"), F.col("section_rank").cast("long").alias("section_rank"))


@query("per_section_cap", """
SELECT source, doc_id, n_chars, position FROM (
    SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position FROM documents) WHERE position <= 2""")
def per_section_cap(spark, sf):
    rows = documents(spark, sf).select("source", "doc_id", "n_chars")
    capped = ranking.first_per_group(rows, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 2)
    return capped.select("source", "doc_id", "n_chars", F.col("group_position").cast("long").alias("position"))


@query("token_overlap_scores", f"""
WITH q AS (SELECT DISTINCT conv_id, word FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS word FROM conversations WHERE turn = 0)
    WHERE NOT list_contains({STOPWORDS_SQL}, word)),
a AS (SELECT DISTINCT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS word FROM conversations WHERE turn > 0)),
n AS (SELECT conv_id, count(*) AS asked FROM q GROUP BY conv_id),
h AS (SELECT conv_id, turn, count(*) AS hits FROM a JOIN q USING (conv_id, word) GROUP BY ALL)
SELECT c.conv_id, c.turn, round(coalesce(hits / asked, 0), 6) AS score FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn > 0) c
JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) z USING (conv_id) LEFT JOIN n USING (conv_id) LEFT JOIN h USING (conv_id, turn)""")
def token_overlap_scores(spark, sf):
    turns = wide_table(spark, sf, "conversations")
    asked = turns.filter("turn = 0").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("question"))
    rows = turns.filter("turn > 0").groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    score = fusion.lexical_overlap(F.col("question"), F.col("text"))
    return rows.join(asked, "conv_id").select("conv_id", "turn", F.round(score, 6).alias("score"))


# ---- lists, budgets, fidelity -------------------------------------------------


@query("dedup_ordered", """
SELECT source, first_doc, lines FROM (SELECT source, line, min(doc_id) AS first_doc, count(*) AS lines FROM (
    SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source, line) WHERE lines > 1""")
def dedup_ordered(spark, sf):
    lines = documents(spark, sf).select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    first = lines.groupBy("source", "line").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("lines"))
    return first.filter("lines > 1").select("source", "first_doc", "lines")


@query("byte_budget_truncation", """
SELECT source, doc_id, used_bytes FROM (SELECT source, doc_id, CAST(sum(greatest(octet_length(encode(text)), 1)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used_bytes
    FROM documents) WHERE used_bytes <= 3000""")
def byte_budget_truncation(spark, sf):
    rows = documents(spark, sf).select("source", "doc_id", "text")
    kept = ranking.fit_byte_budget(rows, ["source"], [F.asc("doc_id")], F.col("text"), 3000)
    return kept.select("source", "doc_id", F.col("used_bytes").cast("long").alias("used_bytes"))


@query("byte_budget_lists", """
WITH r AS (SELECT p_brand, p_partkey, ['results', 'moves', 'rows'][1 + p_size % 3] AS name, p_size % 3 AS rank,
    octet_length(encode(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size})::VARCHAR)) + (row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY p_partkey) > 1)::INT AS b FROM part),
l AS (SELECT *, 2 + sum(b) OVER (PARTITION BY p_brand, name ORDER BY p_partkey) AS list_bytes FROM r),
n AS (SELECT p_brand, count(DISTINCT name) AS lists, count(*) AS all_rows FROM r GROUP BY 1),
u AS (SELECT l.*, 80 + 2 * lists + sum(b) OVER (PARTITION BY p_brand ORDER BY list_bytes, rank DESC) AS used FROM l JOIN n USING (p_brand)),
k AS (SELECT p_brand, count(*) AS kept_rows, max(used) AS used_bytes, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS keys FROM u WHERE used <= 3000 GROUP BY 1)
SELECT p_brand, CASE WHEN kept_rows IS NULL THEN 'too large' WHEN kept_rows = all_rows THEN 'whole' ELSE 'truncated' END AS outcome, coalesce(kept_rows, 0) AS kept_rows,
    used_bytes::BIGINT AS used_bytes, md5(keys) AS keys_md5 FROM n LEFT JOIN k USING (p_brand)""")
def byte_budget_lists(spark, sf):
    """The parts of a brand as three lists of one result of at most 3,000 bytes."""
    names = ["results", "moves", "rows"]
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size", F.get(F.array(*map(F.lit, names)), F.col("p_size") % 3).alias("name"))
    kept, outcomes = ranking.fit_lists(rows, ["p_brand"], "name", names, [F.asc("p_partkey")], ranking.json_bytes("p_partkey", "p_name", "p_size"), 3000, 80)
    keys = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string"))
    digest = kept.groupBy("p_brand").agg(F.md5(F.array_join(keys, ",")).alias("keys_md5"))
    return outcomes.join(digest, "p_brand", "left").withColumn("used_bytes", F.col("used_bytes").cast("long"))


@query("list_fidelity", r"""
WITH n AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS name FROM part), t AS (
    SELECT conv_id, turn, regexp_split_to_array(text, '[!?;\n]') AS parts, text FROM conversations),
a AS (SELECT conv_id, turn, list_aggregate(list_filter(parts, lambda x: NOT regexp_matches(x, '(?i)\b(?:à\s+tort|exclus?)\b')), 'string_agg', chr(10)) AS kept FROM t)
SELECT conv_id, turn, count(*) FILTER (contains(replace(lower(coalesce(kept, '')), 'ß', 'ss'), name)) AS affirmed, count(*) AS names FROM a, n GROUP BY ALL""")
def list_fidelity(spark, sf):
    """How many of the words of part names each turn affirms, spotted by one automaton."""
    names = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ", -1)).alias("name")).distinct()
    turns = wide_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.explode(F.array(fidelity.affirming_text(F.col("text")))).alias("kept"))  # generated: a Python function takes no lambda
    found = mentions.held_counts(turns, "kept", names, "name", "affirmed")
    return found.select("conv_id", "turn", "affirmed", F.lit(names.count()).alias("names"))
