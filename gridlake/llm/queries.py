"""The thin queries over the driver's tables, one for each operator."""

from __future__ import annotations

from . import decontamination, html_extraction, jaccard_join, lm_scoring, packing, pii, quality_classifier, quality_rules, substring_dedup, toxicity

QUERIES = {}
ORACLES: dict[str, str] = {
    "op7_substring_dedup": r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs),
windows AS (SELECT *, CASE WHEN i <= n - 34 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS k FROM words),
seen AS (SELECT *, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS again FROM windows),
gone AS (SELECT r, word, i, coalesce(bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS out FROM seen),
each AS (SELECT r, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS kept FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN each USING (r)""",
    "op9_quality_rules": r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs),
windows AS (SELECT r, i, length(word) AS c, CASE WHEN i <= n - 2 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS w3,
CASE WHEN i <= n - 3 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS w4,
CASE WHEN i <= n - 5 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) END AS w6,
CASE WHEN i <= n - 9 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) END AS w10 FROM words),
seen AS (SELECT r, i, c, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w3) > 1 AS a3, w4 IS NOT NULL AND count(*) OVER (PARTITION BY r, w4) > 1 AS a4, w6 IS NOT NULL AND count(*) OVER (PARTITION BY r, w6) > 1 AS a6, w10 IS NOT NULL AND count(*) OVER (PARTITION BY r, w10) > 1 AS a10 FROM windows),
inside AS (SELECT r, c, bool_or(a3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS g3, bool_or(a4) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS g4, bool_or(a6) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS g6, bool_or(a10) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS g10 FROM seen),
each AS (SELECT r, sum(c)::BIGINT AS chars, count(*) FILTER (WHERE g3) AS again, coalesce(sum(c) FILTER (WHERE g4), 0)::BIGINT AS c4, coalesce(sum(c) FILTER (WHERE g6), 0)::BIGINT AS c6, coalesce(sum(c) FILTER (WHERE g10), 0)::BIGINT AS c10 FROM inside GROUP BY r),
split AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs),
lines AS (SELECT r, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS dup FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) AS n, sum(c)::BIGINT AS c FROM lines WHERE dup GROUP BY r),
counts AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words,
coalesce(c4, 0) / greatest(coalesce(chars, 0), 1)::DOUBLE AS cover_4, coalesce(c6, 0) / greatest(coalesce(chars, 0), 1)::DOUBLE AS cover_6, coalesce(c10, 0) / greatest(coalesce(chars, 0), 1)::DOUBLE AS cover_10, coalesce(dups.c, 0) / greatest(coalesce(chars, 0), 1)::DOUBLE AS cover_lines FROM docs LEFT JOIN each USING (r) LEFT JOIN dups USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND n_symbols <= 0.1::DOUBLE * word_chars AND cover_4 <= 0.5 AND cover_6 <= 0.47::DOUBLE AND cover_10 <= 0.45::DOUBLE AND cover_lines <= 0.3::DOUBLE AS kept FROM judged""",
    "op8_ngram_jaccard_join": r"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs),
runs AS (SELECT r, n, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM words),
sets AS MATERIALIZED (SELECT DISTINCT r, k FROM runs WHERE i <= greatest(n - 4, 1)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM sets GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.k = b.k AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM docs UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id FROM docs d JOIN reach ON reach.x = d.r JOIN docs e ON e.r = reach.y LEFT JOIN sizes s ON s.r = d.r GROUP BY d.r, d.doc_id""",
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op9_quality_rules(spark, sf):
    return quality_rules.repetition_coverage(_table(spark, sf, "documents"))


@query
def op1_benchmark_decontamination(spark, sf):
    return decontamination.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@query
def op2_quality_classifier(spark, sf):
    return quality_classifier.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query
def op3_html_extraction(spark, sf):
    return html_extraction.extract(_table(spark, sf, "pages"))


@query
def op4_pii(spark, sf):
    return pii.find(_table(spark, sf, "documents"))


@query
def op5_lm_scoring(spark, sf):
    return lm_scoring.score(_table(spark, sf, "documents"))


@query
def op6_best_fit_packing(spark, sf):
    return packing.pack(_table(spark, sf, "documents"))


@query
def op7_substring_dedup(spark, sf):
    return substring_dedup.remove_repeats(_table(spark, sf, "documents")).drop("kept")


@query
def op8_ngram_jaccard_join(spark, sf):
    return jaccard_join.jaccard_components(_table(spark, sf, "documents"))


@query
def op10_toxicity(spark, sf):
    return toxicity.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
