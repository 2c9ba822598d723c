"""op9: every page of the pages table against a dated list.

The tables hold neither fetch times nor lists, so both are derived from the pages: the fetch day
from the page id, and for each host, domain and path prefix seen a short history of listings and
delistings from a hash of its name."""
from pyspark.sql import functions as F

from beaconlake.llm import url_filter
from beaconlake.llm.queries import query

FIRST_DAY, DAYS = 19723, 730          # 2024-01-01, two years


def captures(pages):
    return pages.select("page_id", "url", (F.pmod(F.col("page_id") * 37, F.lit(DAYS)) + FIRST_DAY).alias("day"))


def entries(pages):
    """Up to six dated changes for each key; about a third of the keys are never listed."""
    keys = (pages.select(F.explode(url_filter.candidate_keys(url_filter.host_of(F.col("url")), url_filter.segment_of(F.col("url")))).alias("k"))
            .select(F.col("k.key").alias("key")).distinct())
    number = lambda place, size: F.conv(F.substring(F.md5(F.col("key").cast("binary")), place, size), 16, 10).cast("long")
    change = F.explode(F.sequence(F.lit(1), F.pmod(number(1, 2), F.lit(7)).cast("int")))
    return (keys.where(F.pmod(number(1, 2), F.lit(7)) > 0).withColumn("n", change)
            .select("key", (F.pmod(number(3, 6) * F.col("n"), F.lit(DAYS)) + FIRST_DAY).alias("day"),
                    F.when((F.col("n") + number(9, 1)) % 2 == 0, "block").otherwise("allow").alias("action")))


SQL = """
WITH caps AS (SELECT page_id, url, (page_id * 37) % 730 + 19723 AS day,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment FROM pages),
tries AS (
  SELECT url, day, 1000 AS kind, host || '/' || segment AS key FROM caps WHERE host IS NOT NULL
  UNION ALL SELECT url, day, 500, host FROM caps WHERE host IS NOT NULL
  UNION ALL SELECT url, day, n, '*.' || array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - n + 1, 1):], '.')
  FROM (SELECT url, day, host, unnest(range(2, greatest(len(string_split(host, '.')), 2) + 1)) AS n FROM caps WHERE host IS NOT NULL)),
keys AS (SELECT DISTINCT key, ('0x' || substr(md5(key), 1, 2))::BIGINT % 7 AS changes, ('0x' || substr(md5(key), 3, 6))::BIGINT AS step,
  ('0x' || substr(md5(key), 9, 1))::BIGINT AS turn FROM tries),
log AS (SELECT key, (step * n) % 730 + 19723 AS day, CASE WHEN (n + turn) % 2 = 0 THEN 'block' ELSE 'allow' END AS action
  FROM (SELECT *, unnest(range(1, changes + 1)) AS n FROM keys WHERE changes > 0)),
entries AS (SELECT key, day, max(action) AS action FROM log GROUP BY key, day),
spans AS (SELECT *, lead(day) OVER (PARTITION BY key ORDER BY day) AS to_day FROM entries),
best AS (SELECT t.url, t.day, arg_max(struct_pack(r := s.key, k := t.kind, l := s.day, a := s.action), (t.kind, s.key)) AS best
  FROM tries t JOIN spans s ON t.key = s.key AND s.day <= t.day AND (s.to_day IS NULL OR t.day < s.to_day) GROUP BY t.url, t.day)
SELECT c.page_id, c.day, c.host, coalesce(best.a, 'allow') AS verdict, best.r AS rule, best.k::INTEGER AS kind, best.l AS listed
FROM caps c LEFT JOIN best b ON c.url = b.url AND c.day = b.day
"""


@query("op9_url_filter", SQL)
def op9_url_filter(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = url_filter.verdicts(captures(pages), entries(pages), "page_id", "url", "day")
    return got.select(F.col("id").alias("page_id"), "day", "host", "verdict", "rule", "kind", "listed")
