"""A corpus pipeline: five operators in a row, each stage written as Parquet and read again.

Stages take (spark, docs, sf_dir) and return documents with all their columns, but for the last,
which returns the packed pieces. Each works on everything that the stage before it kept.

Defined results: null and empty texts fail the quality rules and go there. A null doc_id is an id smaller
than any other for exact copies, linked with nothing by near_dedup (which keeps such rows), and carried
along by mix and packing; a null source is a source. Rows repeated with their doc_id and text are one
document after exact_dedup; ties go to the largest doc_id there and to the smallest in near_dedup. Empty
tables pass through all stages. Further columns are kept, whatever their names, until packing, which
returns its own. A stage that is run again gives the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, minhash, mixing, packing, quality
from tessera.llm.common import shared_dir
from tessera.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8)."""
    return minhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Minima of permutations and token ids have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
