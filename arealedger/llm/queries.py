"""Queries over the given tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, chat_rotation, config_packing, divergence_audit, embedding_whitening, iso_media, label_propagation, permutation_minhash, secret_battery, simhash_golay, toxic_crf, url_digests, wavelet_tokens
from .common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_crf.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_minhash.fingerprints(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_propagation.shard_documents(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_battery.secrets(documents(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso_media.media_columns(documents(spark, sf_dir))


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_tokens.wavelet_tokens(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.simhash_groups(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.bpe_digests(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(documents(spark, sf_dir))


#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digests.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_perspectives, op3_fingerprints, op4_sharding, op5_secrets, op6_media, op7_wavelet, op8_simhash, op9_packing, op10_bpe, op11_whitening, op12_divergence, op13_urls)
    return {f.__name__: f for f in ops}


#: In DuckDB's SQL. Dialogues in turn order; the trained part begins after the head's newline.
PERSPECTIVES = r"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') AS body
  FROM conversations),
named AS (SELECT *, translate(replace(replace(speaker, '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>'), chr(13) || chr(10), '  ') AS shown FROM base),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM base WHERE speaker <> 'system'),
every AS (
  SELECT *, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM named JOIN people ON conv_id IS NOT DISTINCT FROM c),
headed AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || shown ELSE '' END || chr(10) AS head FROM every),
cut AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
    coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_
  FROM cut WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, position, turn, speaker, role, segment, start_ AS "start", start_ + length(segment) AS "end",
  CASE WHEN role = 'assistant' THEN start_ + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN start_ + length(head) + length(body) + length('<|im_end|>') END AS mask_end
FROM placed
"""


DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, in_lang,
    (1 + (1000000000 * (coalesce(n, 0) + 2)) // (groups.total + 2 * v))::BIGINT AS p, (1 + (1000000000 * (in_lang + 2)) // (langs.total + 2 * v))::BIGINT AS q
  FROM groups JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cells x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN cells y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM cells WHERE n > 0 AND p > q),
both_parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS "rank"
FROM both_parts QUALIFY part = 'pair' OR "rank" <= 10
"""

URLS = r"""
WITH rules(rule_host, rule_path, said) AS (VALUES %s),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id, translate(regexp_extract(r, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(said, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
""" % ", ".join(map(repr, RULES))


def oracle_sql() -> dict[str, str]:
    return {"op2_perspectives": PERSPECTIVES, "op12_divergence": DIVERGENCE, "op13_urls": URLS}
