"""op7: personal data in every document."""
from beaconlake.llm import personal
from beaconlake.llm.queries import query


@query("op7_personal_data")
def op7_personal_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return personal.found(docs, personal.train(docs)).withColumnRenamed("id", "doc_id")
