"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, license_scan, lm_score, near_dup, quality_rules, secret_scan, sentencepiece_codec, toxicity, url_filter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def piece_model() -> str:
    """The vocabulary file of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def guess_words() -> dict[str, float]:
    """The ranked words of the production queries, from two vocabulary files."""
    import public_tokenizers

    return secret_scan.dictionary(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model())


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), guess_words())


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.resolve(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


ORACLES["op3_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(rh, rp, rv) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rh || r.rp AS rule, r.rv,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rh || r.rp) DESC, length(r.rh) DESC) AS place
  FROM (SELECT DISTINCT * FROM parsed) p JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rv, CASE WHEN p.host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN fits f ON f.place = 1 AND p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_messages(table(spark, sf_dir, "conversations"), chat_format.tool_table(spark))


# The tables hold no tool calls; with some, only the operator's own tests apply.
ORACLES["op10_chat_format"] = """
SELECT conv_id, turn, role, turn AS order_turn, 0 AS order_depth, 0::BIGINT AS n_calls, 0::BIGINT AS n_answered, 0::BIGINT AS n_invalid,
       NULL::BIGINT AS answers_turn, false AS in_cycle, to_json({'content': text, 'role': role})::VARCHAR AS message
FROM conversations
"""
