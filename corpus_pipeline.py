"""The corpus pipeline: each stage works on all that its predecessor kept and is written as Parquet and reread.

Stages: toxic documents go; of equal texts the row with the largest doc_id stays; of each near-duplicate group the document
with the smallest doc_id stays (SimHash sections with Golay keys find candidates, five-word shingles of Jaccard similarity
0.8 or more link them); sources are mixed to target weights, with repeats; what the mix holds is packed into sequences.
All stages but the last return the columns of documents; the last returns a row for each packed piece.

Edge cases, of every stage: a null text counts as empty, scores like one, has size 0 for the mix and one end token when packed; of rows with
null ids the exact stage keeps one for each text, and no near-duplicate group names them, so they stay; repeated rows are
copies, of which one row stays; columns beside those of documents are kept by all stages but the last. Repeated documents of the mix are packed as
documents of their own, so a (doc_id, piece) can come twice. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.best_fit_pack import pack
from ledgerloom.llm.common import stored
from ledgerloom.llm.fair_mix import mixed_documents
from ledgerloom.llm.fair_toxicity import keep_clean
from ledgerloom.llm.lsm_dedup import keep_one
from ledgerloom.llm.simhash_golay import keep_first

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(spark, docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(spark, docs, words=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, docs, weights=(5, 2, 1), share=1.5, repeats=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs, TOKENIZER, capacity=1024, remembered=200_000)


STAGES = [("toxicity", clean), ("exact dedup", exact), ("near dedup", near), ("mix", mixed), ("pack", packed)]
#: Fingerprints, hashes of the shuffle and token ids are beyond SQL: tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
