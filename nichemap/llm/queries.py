"""The queries of this subpackage, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, codes, html, merkle, packing, pii, quality, repeats, secrets, simhash, spans, toxicity
from .common import documents, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(documents(table(spark, sf_dir, "documents")), pii.find, pii.KINDS, pii.KINDS)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(table(spark, sf_dir, "documents")), WORD_BPE)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(documents(table(spark, sf_dir, "documents")), ("n_words", "n_removed", "kept_sha256"))


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    model = secrets.train(more=secrets.labelled(docs))
    return spans.digest(docs, partial(secrets.find, model=model), secrets.KINDS, secrets.BASE)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(documents(table(spark, sf_dir, "documents")), BYTE_BPE, public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    out = codes.with_label_errors(coded).withColumn("codebooks_sha256", F.lit(codes.digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"))


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edits(documents(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_personal_data, op2_best_fit_packing, op3_substring_dedup, op4_one_bit_neighbours, op5_toxicity, op6_quality_rules, op7_simhash_components, op8_main_text, op9_secrets, op10_byte_bpe, op11_vector_codes, op12_filter_audit, op13_merkle_fingerprints)}


#: DuckDB SQL for the rows of queries; WORD is the pattern of words. Other queries have none: hashes, tokenizers, rounds, models,
#: Luhn sums and transducers are beyond SQL, and nearest neighbours are approximate; tests hold them against plain versions.
WORD = r"[^\x20\x09-\x0D]+"
SQL = {
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
l AS (SELECT doc_id, s FROM (SELECT *, min(doc_id * 100000000 + s) OVER (PARTITION BY k) AS first FROM k) WHERE doc_id * 100000000 + s > first),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, s + unnest(range(20)) AS p FROM l)),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
y AS (SELECT x.doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY p) AS t FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN y ON d.doc_id = y.doc_id""",
    "op12_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
  regexp_matches(t, '[#$%&*|]'), t.doc_id > min(t.doc_id) OVER (PARTITION BY t)] AS f FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
s AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT part, o, n, good, toxic, f, coalesce(list_position(list_transform(o, lambda i: f[i]), true), 6) AS gone FROM s, o),
r AS (SELECT part, o, step, o[step] AS i, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed, sum(n) FILTER (gone < step AND f[o[step]]) AS redundant,
  sum(n) FILTER (f[o[step]] AND len(list_filter(f, lambda b: b)) = 1) AS unique_fails, sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost FROM p, (SELECT i AS step FROM x) GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: chr(64 + i)), '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
 coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM r""",
    "op6_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
k AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w[s], w[s + 1], w[s + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, s + unnest(range(3)) AS p FROM k WHERE n > 1) GROUP BY 1),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) AS n_text FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR (100 * n_dup_lines > 40 * n_lines AND n_dup_lines >= 2) OR 100 * n_upper > 40 * n_text OR 100 * n_bangs > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM s""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
