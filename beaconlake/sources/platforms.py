"""Captured platform payloads to opportunity rows.

Each function takes a frame with a JSON text column `value` (one payload per row, as a text
scan gives it), the `domain` it was captured for and an arrival number `seq`, and returns
rows that `schema.canonical` accepts.
"""
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake.functions import dates, text as tx
from beaconlake.schema import opportunity_key

c = F.col
BODY_CAP = 4000             # fixed value: longest body a repository or thread item keeps
TITLE_CAP = 300             # fixed value: longest title a thread snapshot keeps

HN = "struct<hits: array<struct<objectID: string, url: string, title: string, story_text: string, created_at: string, created_at_i: bigint, author: string, points: bigint, num_comments: bigint>>>"
DEVTO = ("array<struct<id: bigint, url: string, title: string, description: string, published_at: string, user: struct<username: string>, "
         "public_reactions_count: bigint, comments_count: bigint, tag_list: array<string>, reading_time_minutes: bigint>>")
GITHUB = ("struct<items: array<struct<id: bigint, repository_url: string, html_url: string, title: string, body: string, pull_request: string, created_at: string, updated_at: string, "
          "user: struct<login: string>, reactions: struct<total_count: bigint>, comments: bigint, labels: array<struct<name: string>>, state: string>>>")
REDDIT_POST = ("struct<id: string, title: string, selftext: string, permalink: string, created_utc: double, author: string, score: bigint, num_comments: bigint, "
               "upvote_ratio: double, is_self: boolean, over_18: boolean, stickied: boolean, link_flair_text: string, url: string>")
REDDIT = f"array<struct<domain: string, subreddit: string, posts: array<{REDDIT_POST}>>>"
BLUESKY = ("struct<posts: array<struct<uri: string, author: struct<handle: string>, record: struct<text: string, createdAt: string>, likeCount: bigint, replyCount: bigint, "
           "repostCount: bigint, quoteCount: bigint>>>")


def _rows(payloads, schema, path):
    """One row per element of the array at `path`; broken payloads give none."""
    got = payloads.withColumn("p", F.from_json("value", schema))
    return got.select(*[x for x in payloads.columns if x != "value"], F.posexplode(c(path) if path else c("p")).alias("pos", "x"))


def _finish(rows):
    return rows.withColumn("opportunity_id", opportunity_key(c("source"), c("source_native_id")))


def _or_empty(col):
    return F.coalesce(col, F.lit(""))


def hackernews(payloads: DataFrame, since: int) -> DataFrame:
    rows = _rows(payloads, HN, "p.hits").where(c("x.created_at_i") >= since)
    return _finish(rows.select(
        "seq", "pos", "domain", F.lit("hackernews").alias("source"), c("x.objectID").alias("source_native_id"),
        F.coalesce(F.nullif(c("x.url"), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), c("x.objectID"))).alias("url"),
        _or_empty(c("x.title")).alias("title"), _or_empty(c("x.story_text")).alias("body"), F.lit("story").alias("opportunity_type"),
        _or_empty(c("x.created_at")).alias("created_at"), c("x.author").alias("author"), c("x.points").alias("score"),
        c("x.num_comments").alias("num_comments"), F.lit("hackernews").alias("community")))


def devto(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles of a tag; with `limit` the first ones per domain in arrival order."""
    rows = _rows(payloads, DEVTO, None)
    if limit is not None:
        first = F.row_number().over(Window.partitionBy("domain").orderBy("seq", "pos"))
        rows = rows.withColumn("_n", first).where(c("_n") <= limit)
    return _finish(rows.select(
        "seq", "pos", "domain", F.lit("devto").alias("source"), c("x.id").cast("string").alias("source_native_id"), _or_empty(c("x.url")).alias("url"),
        _or_empty(c("x.title")).alias("title"), _or_empty(c("x.description")).alias("body"), F.lit("article").alias("opportunity_type"),
        _or_empty(c("x.published_at")).alias("created_at"), c("x.user.username").alias("author"), c("x.public_reactions_count").alias("score"),
        c("x.comments_count").alias("num_comments"), F.lit("dev.to").alias("community"),
        F.coalesce(c("x.tag_list"), F.array().cast("array<string>")).alias("tags"),
        F.struct(c("x.reading_time_minutes").alias("reading_time_min")).alias("signals")))


def github(payloads: DataFrame) -> DataFrame:
    rows = _rows(payloads, GITHUB, "p.items")
    names = F.transform(c("x.labels"), lambda l: l.getField("name"))
    return _finish(rows.select(
        "seq", "pos", "domain", F.lit("github").alias("source"), c("x.id").cast("string").alias("source_native_id"), _or_empty(c("x.html_url")).alias("url"),
        _or_empty(c("x.title")).alias("title"), F.substring(_or_empty(c("x.body")), 1, BODY_CAP).alias("body"),
        F.when(c("x.pull_request").isNotNull(), "pull_request").otherwise("issue").alias("opportunity_type"),
        _or_empty(c("x.created_at")).alias("created_at"), c("x.updated_at").alias("last_activity_at"), c("x.user.login").alias("author"),
        c("x.reactions.total_count").alias("score"), c("x.comments").alias("num_comments"), tx.repo_of_api(c("x.repository_url")).alias("community"),
        F.coalesce(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>")).alias("tags"),
        F.struct(c("x.state").alias("state")).alias("signals")))


def reddit_listing(payloads: DataFrame, limit: int, subreddits_of: DataFrame) -> DataFrame:
    """Hot posts per subreddit; a domain's limit is shared evenly by its subreddits.
    subreddits_of: domain, n_subs."""
    rows = _rows(payloads, REDDIT, None).select("seq", c("x.domain").alias("domain"), c("x.subreddit").alias("subreddit"), F.posexplode("x.posts").alias("pos", "p"))
    rows = rows.join(subreddits_of, "domain")
    n = F.row_number().over(Window.partitionBy("domain", "subreddit").orderBy("seq", "pos"))
    # The plain limit holds for every row and lets Spark cut each task's rows before the shuffle.
    rows = rows.withColumn("_n", n).where(c("_n") <= max(1, limit)).where(c("_n") <= F.greatest(F.lit(1), F.floor(F.lit(limit) / c("n_subs"))))
    return _finish(_reddit(rows, c("p.title")))


def reddit_snapshot(payloads: DataFrame) -> DataFrame:
    """Groups of saved posts; pinned posts and posts without id or title are left out."""
    rows = _rows(payloads, REDDIT, None).select("seq", c("x.domain").alias("domain"), c("x.subreddit").alias("subreddit"), F.posexplode("x.posts").alias("pos", "p"))
    rows = rows.where(~F.coalesce(c("p.stickied"), F.lit(False)) & (_or_empty(c("p.id")) != "") & (_or_empty(c("p.title")) != ""))
    return _finish(_reddit(rows, F.substring("p.title", 1, TITLE_CAP)))


def _reddit(rows, title):
    flair = F.nullif(c("p.link_flair_text"), F.lit(""))
    return rows.select(
        "seq", "pos", "domain", F.lit("reddit").alias("source"), c("p.id").alias("source_native_id"),
        F.concat(F.lit("https://www.reddit.com"), _or_empty(c("p.permalink"))).alias("url"), _or_empty(title).alias("title"),
        F.substring(_or_empty(c("p.selftext")), 1, BODY_CAP).alias("body"), F.lit("post").alias("opportunity_type"),
        dates.epoch_iso(c("p.created_utc")).alias("created_at"), c("p.author").alias("author"), c("p.score").alias("score"),
        c("p.num_comments").alias("num_comments"), F.concat(F.lit("r/"), "subreddit").alias("community"),
        F.array_compact(F.array(flair)).alias("tags"),
        F.struct(c("p.upvote_ratio").alias("upvote_ratio"), c("p.is_self").alias("is_self"), flair.alias("flair"), c("p.over_18").alias("over_18"),
                 F.when(~F.coalesce(c("p.is_self"), F.lit(False)), c("p.url")).alias("external_url")).alias("signals"))


def bluesky(payloads: DataFrame) -> DataFrame:
    rows = _rows(payloads, BLUESKY, "p.posts")
    handle, uri = _or_empty(c("x.author.handle")), _or_empty(c("x.uri"))
    rkey = F.element_at(F.split(uri, "/"), -1)
    page = F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), rkey)
    return _finish(rows.select(
        "seq", "pos", "domain", F.lit("bluesky").alias("source"), uri.alias("source_native_id"), F.when(handle != "", page).otherwise(uri).alias("url"),
        F.lit("").alias("title"), _or_empty(c("x.record.text")).alias("body"), F.lit("post").alias("opportunity_type"),
        _or_empty(c("x.record.createdAt")).alias("created_at"), handle.alias("author"), c("x.likeCount").alias("score"),
        c("x.replyCount").alias("num_comments"), F.lit("bluesky").alias("community"),
        F.struct(c("x.repostCount").alias("repostCount"), c("x.quoteCount").alias("quoteCount")).alias("signals")))
