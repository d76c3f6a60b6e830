"""Training corpus pipeline: each stage works on what the one before it kept, written and read again between them.

All stages take null, empty and very long texts, null and repeated ids, ties, repeated rows, empty tables and further
columns, whatever their names; what becomes of each is said by the operators. All but the last return the columns of
their input, and no rows for no rows.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from voltmill.llm import decontam, mixing, neardup, packing, toxicity
from voltmill.llm.text import shared_folder
from voltmill.sources.store import Files

#: Share of a document's words that benchmark windows may cover.
MAX_BENCHMARK_SHARE = 0.0


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the factorization machine rejects; each row is judged by its text alone."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, five-word shingles and a similarity of 0.8."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark windows; each row is judged by its text alone."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), MAX_BENCHMARK_SHARE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; documents without words leave."""
    return mixing.take(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_toxicity),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: SQL can express neither the trained model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written to the shared folder and read again.

    A stage's folder goes once the next one has written its own, so one copy is left, from which the result is read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, files = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", Files(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if k:
                files.remove(f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
