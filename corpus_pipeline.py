"""From raw documents to a tokenized training mix.

Each stage takes the documents that the one before it kept and returns the columns of the
documents table; the last returns a row per text of the mix with its token count and digests."""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from beaconlake.llm import bpe, line_dedup, mixing, ngram_join, quality
from beaconlake.session import scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG_RATIO = 0.005      # share of a source's documents for lines of five words or more: licence lines lie just above it
DIFFERENT = 3           # documents of a source that must hold a line


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low-quality and toxic documents go; the model learns from the labelled ones."""
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a tenth of a source's documents hold go, long ones from LONG_RATIO on; copies
    count as one document."""
    return line_dedup.drop_lines(docs, min_pages=DIFFERENT, long_ratio=LONG_RATIO)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target sizes: documents repeat or go."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", drop_boilerplate), ("ngram_join", drop_near_copies),
          ("mixing", mix_sources), ("byte_bpe", tokenize)]

#: The model and the vocabulary are outside SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
