"""op4: every document graded by the model of the labelled ones."""
from pyspark.sql import functions as F

from beaconlake.llm import quality
from beaconlake.llm.queries import query


@query("op4_quality")
def op4_quality(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    got = quality.scored(docs, model)
    return got.select("doc_id", F.col("_expected").alias("expected_grade"), F.col("_tail").alias("tail"), (F.col("_tail") >= quality.TAIL).alias("kept"))
