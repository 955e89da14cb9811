"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import oracles
from spanforge.llm.decontamination import leak_report
from spanforge.llm.html_blocks import page_report
from spanforge.llm.near_dup import near_duplicates
from spanforge.llm.passages import passage_report
from spanforge.llm.periodic import run_report
from spanforge.llm.pieces import piece_report
from spanforge.llm.pii import pii_report
from spanforge.llm.resampling import resample
from spanforge.llm.secrets import secret_report
from spanforge.llm.sharding import shard_report
from spanforge.llm.topk import nearest
from spanforge.llm.toxicity import toxicity_report
from spanforge.llm.whitening import whitening_report
from spanforge.session import table


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_report(table(spark, folder, "documents"))


def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_report(table(spark, folder, "documents"))


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passage_report(table(spark, folder, "documents"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    return page_report(table(spark, folder, "pages"))


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_report(table(spark, folder, "documents"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening_report(table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline; token ids as a string, which compares by value everywhere."""
    got = corpus_pipeline.run(spark, folder)
    return got.select("doc_id", "n_tokens", F.array_join("token_ids", ",").alias("token_ids"), "lossless")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op2_pieces": op2_pieces, "op3_minhash": op3_minhash, "op4_topk": op4_topk, "op5_toxicity": op5_toxicity, "op6_passages": op6_passages, "op7_secrets": op7_secrets, "op8_decontamination": op8_decontamination, "op9_resampling": op9_resampling, "op10_html": op10_html, "op11_sharding": op11_sharding, "op12_runs": op12_runs, "op13_whitening": op13_whitening, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": oracles.PII, "op3_minhash": oracles.NEAR, "op4_topk": oracles.TOPK, "op8_decontamination": oracles.LEAKS, "op11_sharding": oracles.SHARDS, "op12_runs": oracles.RUNS}
