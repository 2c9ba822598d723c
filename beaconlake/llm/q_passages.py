"""op12: every document without the passages that an earlier one holds."""
from pyspark.sql import functions as F

from beaconlake.llm import substring
from beaconlake.llm.queries import query

SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spans AS (SELECT doc_id, pos, array_to_string(w[pos:pos + {substring.WORDS - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WORDS - 2})) AS pos FROM words WHERE len(w) >= {substring.WORDS})),
firsts AS (SELECT s, min(doc_id) AS lowest FROM spans GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {substring.WORDS})) AS pos FROM spans JOIN firsts USING (s) WHERE lowest < doc_id),
singles AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
stays AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM singles ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN stays USING (doc_id)
"""


@query("op12_first_passages", SQL)
def op12_first_passages(spark, folder):
    got = substring.first_only(spark.read.parquet(f"{folder}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
