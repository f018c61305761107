"""A corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Rows are told apart by doc_id and a
hash of their text, so repeated ids are handled; of rows equal in both one
stays in the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, neardup, packing, pii, quality
from quern.llm.store import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a 128-bit key of all columns: at any size, different rows have different keys."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "lang", "source", "text")]
    return docs.select(*COLUMNS).withColumn("row_key", F.unhex(F.md5(F.concat_ws("\x01", *parts).cast("binary"))))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the learned cutoffs keep."""
    docs = _keyed(docs)
    rejected = quality.judge(docs, keys=("row_key",)).where("not kept").select("row_key")
    return docs.join(rejected, "row_key", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least doc_id's."""
    docs = _keyed(docs)
    found = neardup.near_duplicates(docs, keys=("row_key",))
    chosen = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    return docs.join(chosen.select("first.row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of benchmark windows; rows that are mostly such spans go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(decontam.remove_hits(docs.select(*COLUMNS), benchmark))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _columns(pii.mask_pii(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences."""
    tokens = packing.tokenize(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(materialize(tokens, "tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The learned cutoffs, sketches and field can't be said in SQL together; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
