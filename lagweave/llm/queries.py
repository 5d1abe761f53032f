"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, kd_shards, license_scan, line_dedup, lm_trie, media, pii, repair, simhash, substrings, toxicity, winnow
from .common import LOWER, UPPER, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark, sf_dir):
    return media.features(media.load(spark, media.store(table(spark, sf_dir, "documents"))))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.drop_boilerplate(line_dedup.page_lines(table(spark, sf_dir, "pages")))


def op3_lm_score(spark, sf_dir):
    return lm_trie.train_and_score(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.shown(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_decontamination(spark, sf_dir):
    return winnow.digests(winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_kd_shards(spark, sf_dir):
    return kd_shards.shard(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.bpe(docs, public_tokenizers.path("word_bpe_49k.json")))


def op8_license_scan(spark, sf_dir):
    return license_scan.shown(license_scan.scan(table(spark, sf_dir, "documents")))


def op9_pii(spark, sf_dir):
    return pii.shown(pii.extract(table(spark, sf_dir, "documents")))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, toxicity.label_columns(table(spark, sf_dir, "labels"))))


def op11_centroids(spark, sf_dir):
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_substring_dedup(spark, sf_dir):
    return substrings.shown(substrings.repeats(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark, sf_dir):
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.shown(rows, materialize(repair.audits(rows), "audits"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media, op2_line_dedup, op3_lm_score, op4_simhash_near_dedup, op5_decontamination, op6_kd_shards, op7_bpe, op8_license_scan, op9_pii, op10_toxicity, op11_centroids, op12_substring_dedup, op13_conversation_repair, pipeline)}

LINES_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(lower(url), '{line_dedup.HOST}', 1), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup.HIDDEN}', chr(10), 'g'), '{line_dedup.BREAKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g') AS t FROM pages),
l AS (SELECT page_id, host, t, string_split(t, chr(10)) AS raw, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '{line_dedup.EDGES}', '', 'g')) AS line FROM p),
n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(line)) AS line FROM l) WHERE line <> '' GROUP BY ALL),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
d AS (SELECT host, list(line) AS drop FROM n JOIN h USING (host) WHERE n >= {line_dedup.LEAST} AND n > pages * {line_dedup.RATIO} GROUP BY 1),
k AS (SELECT l.*, list_filter(range(1, len(raw) + 1), lambda i: drop IS NULL OR NOT list_contains(drop, line[i])) AS kept FROM l LEFT JOIN d USING (host))
SELECT page_id, host, CASE WHEN t IS NULL THEN NULL ELSE array_to_string(list_transform(kept, lambda i: raw[i]), chr(10)) END AS text,
    CAST(coalesce(len(list_filter(line, lambda x: x <> '')), 0) AS BIGINT) AS n_lines,
    CAST(coalesce(len(list_filter(line, lambda x: x <> '')) - len(list_filter(kept, lambda i: line[i] <> '')), 0) AS BIGINT) AS n_dropped FROM k
"""

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK_SQL = f"""
WITH i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {winnow.SPAN}) AS k, array_to_string(w[pos : pos + least(len(w), {winnow.SPAN}) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {winnow.SPAN}) + 2)) AS pos FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
dw AS (SELECT r, k, pos, array_to_string(w[pos : pos + k - 1], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT r, pos, k, item_id FROM dw JOIN iw USING (k, g)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT r, pos, k FROM h)) GROUP BY 1),
hi AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

TEMPLATES = ", ".join("({template}, '{label}', {base}, {k}, {q}, {words}, {enough}, '{run}')".format(**t) for t in license_scan.templates())

LICENSE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
t AS (SELECT * FROM (VALUES {TEMPLATES}) AS v(template, label, base, k, q, words, enough, run)),
g AS (SELECT r, k, pos - 1 AS p, array_to_string(w[pos : pos + k - 1], ' ') AS run FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
v AS (SELECT r, template, label, base, words, enough, p - q AS diagonal, count(*) AS n, list(DISTINCT range(q, q + k)) AS places FROM g JOIN t USING (k, run) GROUP BY ALL),
a AS (SELECT *, base OR coalesce(diagonal - lag(diagonal) OVER o > {license_scan.NEAR}, true) AS fresh FROM v WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM a),
m AS (SELECT r, label, base, enough, arg_min(diagonal, (-n, diagonal)) AS start, len(list_distinct(flatten(flatten(list(places))))) / words AS cover FROM s GROUP BY r, template, label, base, words, enough, island),
f AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (cover >= enough))), ',') AS labels, max(cover) AS score
    FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN f USING (r)
"""

#: The others train a model, link through components, build a tree or read back files; tests/llm holds them to brute force.
SQL: dict[str, str] = {"op2_line_dedup": LINES_SQL, "op5_decontamination": BENCHMARK_SQL, "op8_license_scan": LICENSE_SQL, "op11_centroids": centroids.oracle_sql(), "op12_substring_dedup": substrings.oracle_sql(), "op13_conversation_repair": repair.oracle_sql()}
