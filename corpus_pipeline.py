"""A pipeline over documents: toxicity, near-dedup, benchmark decontamination, PII, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of its input, save for
the last, which returns token ids. Documents that a stage has no reason to drop go on unchanged: those with null or empty
texts are never toxic, near-duplicates or leaks, their masked text is their text, and their token ids are null or empty. A
row with a null id stays. Columns that a stage adds for its own use begin with two underscores and leave with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.decontamination import find_leaks
from spanforge.llm.near_dup import near_duplicates
from spanforge.llm.pieces import encode_pieces
from spanforge.llm.pii import mask_pii
from spanforge.llm.shared import cut
from spanforge.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from spanforge.session import table

#: SQL can't express the fitted toxicity model or the seeded segmentation.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, out="__toxicity").where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, 0.8 or more)."""
    gone = near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), out="__leaks").where(F.size("__leaks") == 0).drop("__leaks")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars follows the new text."""
    masked = mask_pii(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return masked.select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and whether the ids decode to the whole text, for all documents."""
    both = encode_pieces(docs.select("doc_id", "text"), decoded="decoded")
    return both.select("doc_id", "token_ids", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
