"""op2: the whole documents table encoded and decoded with a public vocabulary."""
import public_tokenizers

from beaconlake.llm import bpe
from beaconlake.llm.queries import query

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op2_byte_bpe")
def op2_byte_bpe(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")
