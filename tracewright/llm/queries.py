"""The thin queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.token_files import read_tokens, with_crc, write_tokens

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return with_crc(read_tokens(spark, path))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.decontaminate import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_log_frequency_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.merkle import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.line_templates import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.size(F.split("row.text", "\n")).cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.col("kept").alias("text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.common import id_crc
    from tracewright.llm.toxicity import fit, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", (id_crc("row.doc_id") % 4 == 2).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.repair import repaired

    return repaired(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_merkle that SQL can express."""
    from tracewright.llm.merkle import compare_edited

    return compare_edited(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_url_filter that SQL can express."""
    from tracewright.llm.urls import with_features

    return with_features(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "known")


SQL = {
    "edited_texts": """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS f FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(f, length(t) // 2)) AS edited_sha256 FROM n""",
    "url_rules": """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS known FROM r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_decontamination, op3_log_frequency_lm, op4_simhash, op5_best_fit_packing, op6_merkle, op7_pii, op8_line_templates, op9_url_filter, op10_toxicity, op11_whitening, op12_conversation_repair, op13_token_counts, edited_texts, url_rules)}


def oracle_sql() -> dict[str, str]:
    from tracewright.llm import decontaminate, line_templates

    return SQL | {"op2_decontamination": decontaminate.ORACLE, "op8_line_templates": line_templates.ORACLE}
