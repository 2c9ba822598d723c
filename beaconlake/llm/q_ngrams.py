"""op6: every document with its group of near copies."""
from beaconlake.llm import ngram_join
from beaconlake.llm.queries import query

#: The same links by an inverted index, and the groups by a recursive walk.
GROUPS_SQL = """
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
walk AS (SELECT doc_id AS start, doc_id AS here FROM words UNION SELECT w.start, l.y FROM walk w JOIN linked l ON w.here = l.x),
"""
SQL = "WITH RECURSIVE " + GROUPS_SQL.format(docs="documents") + """
groups AS (SELECT start AS doc_id, min(here) AS component_id FROM walk GROUP BY start)
SELECT g.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, g.component_id FROM groups g LEFT JOIN sizes s USING (doc_id)
"""


@query("op6_ngram_join", SQL)
def op6_ngram_join(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return ngram_join.groups(docs).withColumnRenamed("id", "doc_id")
