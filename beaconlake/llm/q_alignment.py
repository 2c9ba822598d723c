"""op11: the tokens of two public tokenizers aligned over every document."""
import public_tokenizers
from pyspark.sql import functions as F

from beaconlake.llm import alignment
from beaconlake.llm.queries import query

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op11_alignment")
def op11_alignment(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    files = alignment.shared(spark, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES), public_tokenizers.PATTERN)
    return alignment.aligned(docs, files).withColumnRenamed("id", "doc_id")
