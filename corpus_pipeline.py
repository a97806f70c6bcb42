"""From raw documents to encoded training text: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again before the next. All but the last return the columns of documents.

In every stage a null text counts as empty, other columns may be null, rows without an id are
documents like any other, texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seagrid.llm import exact_dedup, isolation, mixing, scan_encode, simhash
from seagrid.llm.common import new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go: all under 50 words, so also empty ones. Rows are judged alone, repeated ones alike."""
    return isolation.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays: the longest, of ties that of the least id (null last), of repeated rows any one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints two bits apart or less, directly or by others, that of the least id stays (null last; then by a hash of the text)."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 times to twice; a null source is a source. Draws depend on id and text, so ties and reruns agree."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row that is left: doc_id, n_tokens, ids. Copies that the mix made are encoded each."""
    return scan_encode.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mixture), ("encode", encoded)]

#: The stages draw, fit and iterate, which SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
