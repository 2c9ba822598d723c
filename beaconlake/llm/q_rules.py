"""op8: every document judged by the quality rules."""
from beaconlake.llm import rules
from beaconlake.llm.queries import query


@query("op8_quality_rules")
def op8_quality_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return rules.judged(docs, spark.read.parquet(f"{folder}/labels.parquet")).withColumnRenamed("id", "doc_id")
