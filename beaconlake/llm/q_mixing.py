"""op10: the whole documents table, mixed to target weights."""
from beaconlake.llm import mixing
from beaconlake.llm.queries import query

#: Same rules in DuckDB: the level by windows over the sources, the cut by a running sum.
PLAN_SQL = """
sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM {docs}),
units AS (SELECT source, key, doc_id, size, count(*) AS copies, size * count(*) AS words FROM sized GROUP BY source, key, doc_id, size),
per AS (SELECT source, sum(words)::BIGINT AS source_size FROM units GROUP BY source),
weighed AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 + 1 AS w FROM per),
stepped AS (SELECT *, cap / w AS ratio FROM weighed),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::DOUBLE
  / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level,
  row_number() OVER (ORDER BY ratio, (source IS NOT NULL), source) AS place FROM stepped
  WINDOW earlier AS (ORDER BY ratio, (source IS NOT NULL), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, source_size, least(w * (SELECT arg_min(level, place) FROM leveled WHERE level <= ratio), cap::DOUBLE) AS target FROM weighed),
budgets AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM plan),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM budgets),
rests AS (SELECT *, budget - epochs * source_size AS rest FROM epochs),
placed AS (SELECT u.*, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units u),
shares AS (SELECT p.source, p.key, p.doc_id, p.size, r.source_size, r.target, r.epochs,
  CASE WHEN p.before + p.words <= r.rest THEN p.size WHEN p.before <= r.rest THEN (r.rest - p.before) // p.copies ELSE 0 END::BIGINT AS part
  FROM placed p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source)
"""
SQL = "WITH " + PLAN_SQL.format(docs="documents") + """
SELECT d.doc_id, d.size, s.source_size, s.target, (s.epochs * s.size + s.part)::BIGINT AS taken
FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source AND d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.size = s.size
"""


@query("op10_mixing", SQL)
def op10_mixing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mixing.mix(docs).withColumnRenamed("id", "doc_id").drop("source")
