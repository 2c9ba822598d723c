"""op5: every vector of the embeddings table with its links and its group of near copies."""
from beaconlake.llm import vector_join
from beaconlake.llm.queries import query

SQL = """
WITH RECURSIVE fit AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
walk AS (SELECT vec_id AS start, vec_id AS here FROM embeddings UNION SELECT w.start, l.y FROM walk w JOIN linked l ON w.here = l.x),
groups AS (SELECT start AS vec_id, min(here) AS component_id FROM walk GROUP BY start),
counts AS (SELECT x AS vec_id, count(*) AS n FROM linked GROUP BY x)
SELECT g.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, g.component_id, g.vec_id = g.component_id AS kept
FROM groups g LEFT JOIN counts c USING (vec_id)
"""


@query("op5_vector_join", SQL)
def op5_vector_join(spark, folder):
    return vector_join.near_copies(spark.read.parquet(f"{folder}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
