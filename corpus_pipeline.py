"""Corpus pipeline: quality rules, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage works on all that the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldproof.llm import decontaminate, line_dedup, minhash, packing, quality
from fieldproof.llm.common import durable, table
from fieldproof.session import ship

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of windows that stand earlier; n_chars follows the text. A document whose
    every line stood earlier stays, with an empty text."""
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    out = line_dedup.dedup(docs).select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies (five words, 0.8)."""
    return minhash.keep(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    import public_tokenizers

    out = packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), limits=packing.PRODUCTION)
    return out.select("row.doc_id", "start", "length", "ids_crc32", F.col("item_tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near copies, edit distances and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
