"""Registered queries of the corpus operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from lorespark.llm import best_fit, centroid_filter, decontamination, line_dedup, merkle, passages, pii, probminhash, quality, quality_rules, spelling, token_output, toxicity
from lorespark.llm.common import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


MERKLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
led AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM docs),
both_texts AS (SELECT doc_id, 'own' AS kind, text FROM led UNION ALL
    SELECT doc_id, 'edited', substr(text, 1, length(text) - length(text) // 4) || substr(following, 1, length(text) // 4) FROM led),
paragraphs AS (SELECT doc_id, kind, text, list_transform(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), lambda p: {'blank': trim(translate(p, chr(9) || chr(13) || chr(10), '   ')) = '',
    'leaves': list_transform(regexp_extract_all(p, '(?:[^ \t\r\n]{1,40}[ \t\r\n]*){1,8}|[ \t\r\n]+'), lambda l: sha256(l)[1:32])}) AS ps FROM both_texts),
digests AS (SELECT doc_id, kind, text, list_transform(ps, lambda p: {'digest': sha256(array_to_string(p.leaves, ''))[1:32], 'blank': p.blank,
    'leaves': array_to_string(list_transform(p.leaves, lambda l: l[1:8]), '.')}) AS ps FROM paragraphs),
closed AS (SELECT doc_id, kind, text,
    array_to_string(list_transform(ps, lambda p: p.digest || CASE WHEN p.blank OR starts_with(p.digest, '0') THEN ';' ELSE ',' END), '') AS d,
    array_to_string(list_transform(ps, lambda p: p.leaves || CASE WHEN p.blank OR starts_with(p.digest, '0') THEN ';' ELSE ',' END), '') AS body FROM digests),
prints AS (SELECT doc_id, kind, text, sha256(array_to_string(list_transform(string_split(d, ';'), lambda s: sha256(s)[1:32]), '')) || '|' || body AS fingerprint,
    list_filter(list_distinct(string_split(translate(body, ';,', '..'), '.')), lambda l: l <> '') AS leaves FROM closed),
own AS (SELECT *, coalesce(lead(leaves) OVER (ORDER BY doc_id), first_value(leaves) OVER (ORDER BY doc_id)) AS next_leaves FROM prints WHERE kind = 'own')
SELECT own.doc_id, length(own.text) AS n_chars, sha256(e.text) AS edited_sha256, own.fingerprint, e.fingerprint AS edited_fingerprint,
    CASE WHEN len(own.leaves) + len(e.leaves) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own.leaves, e.leaves)) / (len(own.leaves) + len(e.leaves) - len(list_intersect(own.leaves, e.leaves)))::DOUBLE END AS near_edited,
    CASE WHEN len(own.leaves) + len(own.next_leaves) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own.leaves, own.next_leaves)) / (len(own.leaves) + len(own.next_leaves) - len(list_intersect(own.leaves, own.next_leaves)))::DOUBLE END AS near_next
FROM own JOIN prints e ON e.doc_id = own.doc_id AND e.kind = 'edited'"""


@query("op10_merkle_fingerprints", MERKLE_SQL)
def op10_merkle_fingerprints(spark, sf):
    return merkle.fingerprints(documents(spark, sf))


@query("op7_toxicity_scores")
def op7_toxicity_scores(spark, sf):
    docs = documents(spark, sf)
    return toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op9_quality_scores")
def op9_quality_scores(spark, sf):
    docs = documents(spark, sf)
    return quality.quality_scores(docs, quality.train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf):
    return best_fit.best_fit_packing(documents(spark, sf))


@query("op6_token_rows")
def op6_token_rows(spark, sf):
    return token_output.token_rows(documents(spark, sf))


@query("op5_probminhash_near_duplicates")
def op5_probminhash_near_duplicates(spark, sf):
    return probminhash.near_duplicates(documents(spark, sf))


@query("op3_line_dedup")
def op3_line_dedup(spark, sf):
    return line_dedup.line_report(documents(spark, sf))


@query("op1_decontamination")
def op1_decontamination(spark, sf):
    return decontamination.overlaps(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op8_compact_window_passages")
def op8_compact_window_passages(spark, sf):
    return passages.repeated_passages(documents(spark, sf))


@query("op2_weakly_supervised_pii")
def op2_weakly_supervised_pii(spark, sf):
    return pii.personal_data(documents(spark, sf))


def _clusters_sql(k: int = 8, rounds: int = 10, seed: int = 3, dimension: int = 64, scale: int = 1024) -> str:
    """Plain Lloyd rounds: every vector is measured against every centroid."""
    gap = "list_sum(list_transform(list_zip(v.u, c.u), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS u FROM embeddings
    WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, u FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT v.vec_id, min({{'d': {gap}, 'c': c.cluster}}) AS best FROM kept v CROSS JOIN c{n} c GROUP BY v.vec_id)")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.u, c.u) AS u FROM c{n} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY place) AS u FROM (
        SELECT best.c AS cluster, place, sum(u[place])::BIGINT AS s, count(*) AS n FROM a{n} JOIN kept USING (vec_id) CROSS JOIN (SELECT unnest(range(1, {dimension + 1})) AS place) GROUP BY 1, 2) GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
    sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.u, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = best.c"""


@query("op11_centroid_clusters", _clusters_sql())
def op11_centroid_clusters(spark, sf):
    # The number of measured centroids depends on the axes and has no twin.
    return centroid_filter.centroid_clusters(spark.read.parquet(f"{sf}/embeddings.parquet")).drop("n_measured")


def _rules_sql() -> str:
    """The same estimates as chained views: a state is one row per group with means ``m<i>`` and inverse factor ``v<i><j>``."""
    p, scale, rules = 6, 512, quality_rules
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = "count(*) AS n, " + ", ".join([f"sum(z[{i + 1}]) AS s{i}" for i in range(p)] + [f"sum(z[{i + 1}] * z[{j + 1}]) AS q{i}{j}" for i, j in pairs])
    totals = "sum(n) AS n, " + ", ".join([f"sum(s{i}) AS s{i}" for i in range(p)] + [f"sum(q{i}{j}) AS q{i}{j}" for i, j in pairs])
    turned = ["(" + " + ".join(f"v{i}{j} * (z[{j + 1}] - m{j})" for j in range(i + 1)) + ")" for i in range(p)]
    views = []

    def distances(name, state):
        views.append(f"{name} AS MATERIALIZED (SELECT r.*, {' + '.join(f'{t} * {t}' for t in turned)} AS distance FROM judged r JOIN {state} USING (lang, source))")

    def estimate(name, source, factor):
        cells = [f"(n * {factor!r} * (n::HUGEINT * q{i}{j} - s{i}::HUGEINT * s{j})::DOUBLE / (n * n::DOUBLE) + {20.0 * (0.1 * scale) ** 2 if i == j else 0.0!r}) / (n + 20.0)"
                 f" + {(rules.FLOOR[i] * scale) ** 2 if i == j else 0.0!r} AS c{i}{j}" for i, j in pairs]
        views.append(f"{name}_0 AS (SELECT lang, source, {', '.join(f's{i} / n AS m{i}' for i in range(p))}, {', '.join(cells)} FROM {source})")
        step = 0
        for j in range(p):
            inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
            views.append(f"{name}_{step + 1} AS (SELECT *, sqrt(c{j}{j}{inner}) AS l{j}{j} FROM {name}_{step})")
            below = "".join(f", (c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, p))
            views.append(f"{name}_{step + 2} AS (SELECT *{below} FROM {name}_{step + 1})")
            step += 2
        for i in range(p):
            row = "".join(f", -({' + '.join(f'l{i}{k} * v{k}{j}' for k in range(j, i))}) / l{i}{i} AS v{i}{j}" for j in range(i)) + f", 1.0::DOUBLE / l{i}{i} AS v{i}{i}"
            views.append(f"{name}_{step + 1} AS (SELECT *{row} FROM {name}_{step})")
            step += 1
        views.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_{step})")

    views.append("""own AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
worded AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM own),
spots AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM spots) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY rid),
counted AS MATERIALIZED (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(ls) AS n_lines, length(text) - length(regexp_replace(text, '\\p{Lu}+', '', 'g')) AS caps, length(text) - length(regexp_replace(text, '\\p{L}+', '', 'g')) AS letters FROM worded LEFT JOIN covered USING (rid)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
judged AS MATERIALIZED (SELECT rid, lang, source, list_transform([ln(word_chars / n_words), asin(sqrt(n_symbols / word_chars)), asin(sqrt(n_repeat_words / n_words)), asin(sqrt(n_dup_lines / n_lines)),
    asin(sqrt(caps / word_chars)), asin(sqrt(greatest(word_chars - letters - n_symbols, 0) / word_chars))], lambda v: round(v * 512)::BIGINT) AS z FROM based WHERE NOT base_failed),
ranks AS (SELECT lang, source, i, v, (row_number() OVER (PARTITION BY lang, source, i ORDER BY v))::DOUBLE AS r, count(*) OVER (PARTITION BY lang, source, i) AS n
    FROM (SELECT lang, source, unnest(range(6)) AS i, unnest(z) AS v FROM judged)),
quartiles AS (SELECT lang, source, i, min(v) FILTER (r >= n * 0.5) AS med, (min(v) FILTER (r >= n * 0.75) - min(v) FILTER (r >= n * 0.25)) / 1.349 AS spread FROM ranks GROUP BY ALL)""")
    floors = "[" + ", ".join(repr((f * scale) ** 2) for f in rules.FLOOR) + "]"
    views.append("start AS MATERIALIZED (SELECT lang, source, " + ", ".join(
        [f"max(med) FILTER (i = {i})::DOUBLE AS m{i}" for i in range(p)] +
        [f"1.0::DOUBLE / max(sqrt(spread * spread + {floors}[i + 1])) FILTER (i = {i}) AS v{i}{j}" if i == j else f"0.0::DOUBLE AS v{i}{j}" for i, j in pairs]) + " FROM quartiles GROUP BY ALL)")
    state = "start"
    for n in range(rules.STEPS):
        distances(f"d{n}", state)
        views.append(f"b{n} AS (SELECT lang, source, floor(16 * log2(1 + 64 * distance)) AS bin, {sums} FROM d{n} GROUP BY ALL)")
        views.append(f"""h{n} AS (SELECT lang, source, {totals} FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source ORDER BY bin) - n AS below, sum(n) OVER (PARTITION BY lang, source) AS whole FROM b{n})
    WHERE below < whole * 0.6 GROUP BY ALL)""")
        state = f"e{n}"
        estimate(state, f"h{n}", rules.consistency(0.6))
    distances("inside", state)
    views.append(f"weighed AS (SELECT lang, source, {sums} FROM inside WHERE distance <= {rules.chi_quantile(0.975, p)!r} GROUP BY ALL)")
    estimate("f", "weighed", rules.consistency(0.975))
    names = ", ".join(["lang", "source"] + [f"m{i}" for i in range(p)] + [f"v{i}{j}" for i, j in pairs])
    views.append(f"final AS MATERIALIZED (SELECT {names} FROM f UNION ALL SELECT {names} FROM {state} WHERE (lang, source) NOT IN (SELECT (lang, source) FROM f))")
    distances("scored", "final")
    return f"""WITH {", ".join(views)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(distance <= {rules.chi_quantile(0.999, p)!r}, false) AS kept
FROM based LEFT JOIN (SELECT rid, distance FROM scored) USING (rid)"""


@query("op12_robust_quality_rules", _rules_sql())
def op12_robust_quality_rules(spark, sf):
    return quality_rules.quality_rules(documents(spark, sf)).drop("distance")


SPELLING_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v
    FROM range(256) r(b))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS code FROM runs, crc_table),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN code % 31 = 0 THEN substr(run, 1, (code % length(run))::INT) || substr(run, (code % length(run))::INT + 2) ELSE run END AS word, n FROM coded)
    WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
gaps AS (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
met AS (SELECT x.word, y.word AS near, y.n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word UNION
    SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.a || x.b = y.word UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, {'n': -n, 'w': encode(near)}) AS near, max(n) AS near_n FROM met GROUP BY word),
forms AS (SELECT w.word, CASE WHEN near_n >= 10 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chains(word, last, depth) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, depth) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13_spelling_variants(spark, sf):
    return spelling.spelling_variants(documents(spark, sf))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
