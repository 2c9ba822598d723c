"""Drop boilerplate lines by how many pages of a site carry them.

Pages are grouped by host. A line counts once per page; its frequency is the number of the host's
pages that hold it over all pages of the host. Lines above the ratio are dropped wherever they
stand on that host. Equal pages of a host count as one: pages are compared by a hash first, and only
those that occur again are sent to be folded. Counts are pre-aggregated where the pages lie, so a host or a
line with a third of all rows costs one row per task; only lines above the ratio (at most 1 / ratio times the
mean lines of a page, per host) travel back to the pages.

`drop_lines` looks twice. Near copies share most of their lines, and those would go from all of them.
So where lines above the ratio make up COPIED of a page's characters, the page is taken for a copy: of such pages
only one counts for a line, besides all other pages that hold it.

Defined results: lines are compared without the white space around them; blank lines and lines
on fewer than `min_pages` different pages of the host stay; a null host is a host of its own; a null text
stays null and counts as a page; a page that is all boilerplate keeps an empty text; an empty table gives an
empty result. Input columns keep their names and order. The counts don't depend on the order of rows.
"""
from pyspark.sql import Column, DataFrame, functions as F

from beaconlake.llm.arrays import plain
from beaconlake.llm.mixing import word_count
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.session import checkpointed

RATIO = 0.1             # share of the host's pages above which a line is boilerplate
MIN_PAGES = 2           # different pages that must hold it: one alone says nothing
LONG = 5                # words of a line that does not recur by chance
COPIED = 0.5            # share of a page's characters in such lines that makes it a copy
SMALL = 100_000         # boilerplate lines that may be broadcast; beyond, Spark joins by shuffle
EQUAL = 1_000_000       # repeated pages that may be broadcast by hash (24 MB)
_WHITE = " \t\n\r\x0b\x0c"


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(_WHITE)))


def different(pages: DataFrame, host: Column, lines: Column, same: Column) -> DataFrame:
    """(host, lines): the lines of each different page; pages of a host with equal `same` are one."""
    own = pages.select(host.alias("host"), same.alias("same"), F.filter(lines, lambda x: F.trim(x, F.lit(_WHITE)) != "").alias("lines"))
    again = checkpointed(pages.select(host.alias("_host"), same.alias("_same")).groupBy("_host", "_same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    again = broadcast_if_small(again, EQUAL)
    known = F.col("host").eqNullSafe(F.col("_host")) & F.col("same").eqNullSafe(F.col("_same"))
    folded = own.join(again, known, "left_semi").dropDuplicates(["host", "same"])           # equal pages have equal lines
    return own.join(again, known, "left_anti").unionByName(folded).select("host", "lines")


def _above(seen: DataFrame, total: DataFrame, ratio: float, min_pages: int, long_ratio: float | None) -> DataFrame:
    """(host, line) of the counted lines above the ratio."""
    limit = F.lit(ratio) if long_ratio is None else F.when(F.col("long"), F.lit(long_ratio)).otherwise(F.lit(ratio))
    seen = seen.where(F.col("on") >= min_pages).withColumnRenamed("host", "_host")
    return seen.join(total, F.col("_host").eqNullSafe(F.col("host"))).where(F.col("on") > F.col("pages") * limit).select("host", "line", "long")


def boilerplate(own: DataFrame, ratio: float, min_pages: int, long_ratio: float | None = None, copies: bool = False) -> DataFrame:
    """(host, line): the lines above the ratio of the different pages. With `long_ratio` that is the ratio
    of lines of LONG words or more; with `copies`, pages made of such lines count as one."""
    total = checkpointed(own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    keys = F.array_distinct(F.transform("lines", lambda x: F.struct(line_key(x).alias("line"), (word_count(x) >= LONG if long_ratio is not None else F.lit(False)).alias("long"))))
    each = own.select("host", F.explode(keys).alias("key")).select("host", "key.line", "key.long")
    above = checkpointed(_above(each.groupBy("host", "line", "long").agg(F.count(F.lit(1)).alias("on")), total, ratio, min_pages, long_ratio))
    if not copies:
        return above.select("host", "line")
    sized = F.array_distinct(F.transform("lines", lambda x: F.struct(line_key(x).alias("line"), F.length(F.trim(x, F.lit(_WHITE))).alias("size"))))
    held = own.select("host", sized.alias("keys")).join(listed(above), F.col("host").eqNullSafe(F.col("_host")))
    held = held.withColumn("held", F.filter("keys", lambda x: F.array_contains("_bad", x["line"])))
    size = lambda keys: F.aggregate(keys, F.lit(0), lambda n, x: n + x["size"])
    held = held.select("host", "held", (size("held") >= F.lit(COPIED) * size("keys")).alias("copied"))
    on = F.sum(F.when(F.col("copied"), 0).otherwise(1)) + F.max(F.col("copied").cast("int"))
    again = held.select("host", "copied", F.explode("held").alias("key")).groupBy("host", "key.line").agg(on.alias("on"))
    kind = above.select(F.col("host").alias("_h"), F.col("line").alias("_l"), "long")
    again = again.join(kind, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line") == F.col("_l"))).drop("_h", "_l")
    return checkpointed(_above(again, total, ratio, min_pages, long_ratio)).select("host", "line")


def listed(above: DataFrame) -> DataFrame:
    """(_host, _bad): the lines of each host in a row; broadcast if they are few."""
    known = above.groupBy(F.col("host").alias("_host")).agg(F.collect_list("line").alias("_bad"))
    return F.broadcast(known) if above.count() <= SMALL else checkpointed(known)


def split_pages(pages: DataFrame, host: Column, lines: Column, same: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                long_ratio: float | None = None, copies: bool = False) -> DataFrame:
    """The pages with two columns more: `_kept`, the lines that stay, and `_lines`, all of them."""
    known = listed(boilerplate(different(pages, host, lines, same), ratio, min_pages, long_ratio, copies))
    cut = pages.withColumns({"_at": host, "_lines": lines}).join(known, F.col("_at").eqNullSafe(F.col("_host")), "left")
    stays = F.filter("_lines", lambda x: ~F.array_contains(F.coalesce("_bad", F.array().cast("array<bigint>")), line_key(x))
                     | (F.trim(x, F.lit(_WHITE)) == ""))
    return cut.withColumn("_kept", stays).drop("_at", "_host", "_bad")


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
               long_ratio: float | None = None) -> DataFrame:
    """The documents with their boilerplate lines cut out of the text; all columns as before."""
    rows, at = plain(docs)
    same = F.md5(F.col(at[text]).cast("binary"))
    cut = split_pages(rows, F.col(at[host]), F.split(F.col(at[text]), "\n"), same, ratio, min_pages, long_ratio, copies=True)
    return cut.withColumn(at[text], F.array_join("_kept", "\n")).select(*rows.columns).toDF(*docs.columns)
