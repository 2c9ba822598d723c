"""op3: every page of the pages table without its site's boilerplate lines."""
from pyspark.sql import functions as F

from beaconlake.llm import line_dedup, url_filter
from beaconlake.llm.queries import query

TAG = "<[^>]*>"         # a line of a web page: the text between two tags

SQL = f"""
WITH cut AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  list_filter(string_split_regex(html, '{TAG}|\\n'), lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)) <> '') AS lines FROM pages),
different AS (SELECT DISTINCT c.host, p.html, c.lines FROM cut c JOIN pages p USING (page_id)),
total AS (SELECT host, count(*) AS pages FROM different GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(list_transform(lines,
  lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12))))) AS line FROM different) GROUP BY host, line),
bad AS (SELECT s.host, list(line) AS bad FROM seen s JOIN total t ON s.host IS NOT DISTINCT FROM t.host
  WHERE n >= {line_dedup.MIN_PAGES} AND n > pages * {line_dedup.RATIO}::DOUBLE GROUP BY s.host),
kept AS (SELECT page_id, c.host, len(lines) AS n_lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []),
  trim(x, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)))) AS kept FROM cut c LEFT JOIN bad b ON c.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, n_lines, n_lines - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept
"""


@query("op3_line_dedup", SQL)
def op3_line_dedup(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    lines = F.filter(F.split("html", f"{TAG}|\n"), lambda x: F.trim(x, F.lit(" \t\n\r\x0b\x0c")) != "")
    cut = line_dedup.split_pages(pages, url_filter.host_of(F.col("url")), lines, F.md5(F.col("html").cast("binary")))
    return cut.select("page_id", url_filter.host_of(F.col("url")).alias("host"), F.size("_lines").cast("long").alias("n_lines"),
                      (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("text"))
