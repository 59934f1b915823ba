"""The subpackage's registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm import bpe, decontam, lines, media, negatives, passages, pii, resample, sharding, simhash, suffix, toxicity, url_filter
from tonguemill.llm.common import documents, small_batches


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = media.media_columns(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "digest", "shard", "offset", "length")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.round_trip(documents(spark, sf_dir), *_vocabulary())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.toxicity(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines, and passages of over 50 words in one or two lines."""
    return lines.report(documents(spark, sf_dir).select("doc_id", "text"), over=lines.PASSAGE)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontam.flag(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.round("coverage", 6).alias("coverage"), "item_id", "contaminated")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=3, radius=2)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(documents(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir).select("doc_id", "text"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), shards=24)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return resample.resample(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"), percent=5, least_words=20)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector's label is moved by one, so that some labels are wrong; every hundredth vector is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def _url_sql() -> str:
    rules = sorted(url_filter.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in rules]
    case = lambda says: "CASE " + " ".join(f"WHEN {f} THEN '{x}'" for f, x in zip(fits, says, strict=True)) + " END"
    matches = " OR ".join(f"regexp_matches(low, '{pattern}')" for _, pattern, _ in url_filter.PATTERN_RULES)
    return rf"""
WITH parts AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
heads AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, 1, strpos(url, '://') + 2) || regexp_extract(rest, '^[^/?#]*') ELSE '' END AS head FROM parts),
hosts AS (SELECT page_id, lower(head) || substr(url, length(head) + 1) AS low, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM heads)
SELECT page_id, host, path, {case([h + p for _, h, p in rules])} AS rule,
  coalesce({case([a for a, _, _ in rules])}, CASE WHEN {matches} THEN 'block' ELSE 'allow' END) AS verdict
FROM hosts
"""


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_byte_bpe, op3_toxicity, op4_repeated_passages, op5_line_dedup, op6_decontamination, op7_simhash, op8_url_filter, op9_suffix_dedup, op10_pii, op11_sharding, op12_resampling, op13_hard_negatives)}
ORACLE_SQL = {"op5_line_dedup": lines.PASSAGES_SQL, "op8_url_filter": _url_sql()}
