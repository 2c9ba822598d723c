"""op1: the whole documents table in eight shards of near-equal bytes."""
from pyspark.sql import functions as F

from beaconlake.llm import sharding
from beaconlake.llm.queries import query


@query("op1_sharding")
def op1_sharding(spark, folder):
    got = sharding.shards(spark.read.parquet(f"{folder}/documents.parquet"), 8)
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
