"""A corpus pipeline: quality rules, near-duplicates, secret scans, mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import minhash, mixing, packing, quality_rules, secrets
from rallyframe.plans.scratch import stash, unstash
from rallyframe.plans.tables import table

#: No SQL: hashed ratios, the forest and the tokenizer have no equal there; tests/llm/test_pipeline.py compares each stage's rows.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target is what ``labels`` marks as of quality. Verdicts are by id and text."""
    marked = docs.withColumn("__text", F.xxhash64("text"))
    verdicts = quality_rules.judge(marked, table(spark, sf_dir, "labels").where("quality = 1"), more=["doc_id", "__text"], written=True)
    keys = verdicts.where("kept").select(F.col("doc_id").alias("__i"), F.col("__text").alias("__t")).distinct()
    return marked.join(keys, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the smallest id's; of rows equal in id and text one."""
    return minhash.deduplicate(docs, width=5, threshold=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    clean = secrets.redact(docs, secrets.forest_of(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets."""
    return mixing.repeated(mixing.mix(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequences and places."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", rules), ("near_duplicates", near_duplicates), ("secrets", without_secrets), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        unstash(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
