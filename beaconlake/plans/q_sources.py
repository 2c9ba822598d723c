"""Sources, label files and sinks. Payload text is built from the given tables, then read
back by the same code that reads captured files."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx, schema
from beaconlake.functions import dates, jsontext
from beaconlake.operators import encode as en, features as ft, profiling as pf, sketches as sk, trends as tr
from beaconlake.plans import testbed as tb
from beaconlake.plans.q_columns import items, micro
from beaconlake.plans.q_trends import _GRID, N, act, near
from beaconlake.plans.q_vectors import entries, hashed_sql
from beaconlake.plans.registry import query
from beaconlake.plans.testbed import oracle
from beaconlake.session import checkpointed, scratch_path
from beaconlake.sources import archive as ar, labels as lb, platforms as pl, sinks as si

c = F.col
PAGE = 100
SINCE = 1769904000      # 2026-02-01 00:00 UTC


def epoch(text):
    return F.unix_seconds(dates.parsed(text))


def pages_of(rows, hit, wrap=None, keys=("domain",)):
    """JSON payloads of up to 100 rows each, in arrival order."""
    page = rows.groupBy(*keys, F.floor(c("ingest_seq") / PAGE).alias("seq")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ingest_seq", hit.alias("h")))), lambda s: s.h).alias("hits"))
    body = F.struct(c("hits").alias(wrap)) if wrap else c("hits")
    return page.select(*keys, "seq", F.to_json(body).alias("value"))


@query("SRC-03", oracle(f"""SELECT sha1('hackernews:' || doc_id) AS opportunity_id, CAST(doc_id AS VARCHAR) AS source_native_id, domain,
  CASE WHEN n_chars % 5 = 0 THEN 'https://news.ycombinator.com/item?id=' || doc_id ELSE url END AS url, title, length(body) AS body_length, 'story' AS opportunity_type, created_at, author, score, num_comments, 'hackernews' AS community
  FROM item WHERE epoch_us(cts) // 1000000 >= {SINCE}"""))
def hackernews(spark, d):
    o = tb.opportunities(spark, d)
    hit = F.struct(c("source_native_id").alias("objectID"), F.when(F.col("ingest_seq").isNull() | (F.length("body") % 5 != 0), c("url")).alias("url"), "title",
                   c("body").alias("story_text"), "created_at", epoch(c("created_at")).alias("created_at_i"), "author", c("score").alias("points"), "num_comments")
    got = pl.hackernews(pages_of(o, hit, "hits"), SINCE)
    return got.select("opportunity_id", "source_native_id", "domain", "url", "title", F.length("body").cast("bigint").alias("body_length"),
                      "opportunity_type", "created_at", "author", "score", "num_comments", "community")


@query("SRC-04", oracle("""SELECT source_native_id, domain, url, title, created_at, author, score, array_to_string(tag_list, '|') AS tags, reading FROM
  (SELECT *, 1 + n_chars % 14 AS reading, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS rn FROM item) t WHERE rn <= 100"""))
def devto(spark, d):
    o = items(spark, d)
    hit = F.struct(c("ingest_seq").alias("id"), "url", "title", c("title").alias("description"), c("created_at").alias("published_at"),
                   F.struct(c("author").alias("username")).alias("user"), c("score").alias("public_reactions_count"), c("num_comments").alias("comments_count"),
                   c("tag_list"), (1 + F.length("body") % 14).alias("reading_time_minutes"))
    got = pl.devto(pages_of(o, hit), 100)
    return got.select("source_native_id", "domain", "url", "title", "created_at", "author", "score", F.array_join("tags", "|").alias("tags"),
                      c("signals.reading_time_min").alias("reading"))


@query("SRC-05", oracle("""SELECT sha1('github:' || doc_id) AS opportunity_id, url, title, md5(substr(body, 1, 4000)) AS body_md5, CASE WHEN n_chars % 4 = 0 THEN 'pull_request' ELSE 'issue' END AS opportunity_type,
  'org1/repo' || (n_chars % 7) AS community, array_to_string(tag_list, '|') AS tags, CASE WHEN n_chars % 13 = 0 THEN 'closed' ELSE 'open' END AS state FROM item"""))
def github(spark, d):
    o, n = items(spark, d), F.length("body")
    hit = F.struct(c("ingest_seq").alias("id"), F.concat(F.lit("https://api.github.com/repos/org1/repo"), n % 7).alias("repository_url"), c("url").alias("html_url"), "title", "body",
                   F.when(n % 4 == 0, F.struct(c("url").alias("url"))).alias("pull_request"), "created_at", F.struct(c("author").alias("login")).alias("user"),
                   F.struct(c("score").alias("total_count")).alias("reactions"), c("num_comments").alias("comments"),
                   F.transform("tag_list", lambda t: F.struct(t.alias("name"))).alias("labels"), F.when(n % 13 == 0, "closed").otherwise("open").alias("state"))
    got = pl.github(pages_of(o, hit, "items"))
    return got.select("opportunity_id", "url", "title", F.md5("body").alias("body_md5"), "opportunity_type", "community", F.array_join("tags", "|").alias("tags"), "signals.state")


def reddit_pages(spark, d):
    o, n = tb.opportunities(spark, d), F.length("body")
    post = F.struct(F.when(n % 31 != 0, c("source_native_id")).alias("id"), "title", c("body").alias("selftext"), F.concat(F.lit("/r/x/"), "source_native_id").alias("permalink"),
                    epoch(c("created_at")).cast("double").alias("created_utc"), "author", "score", "num_comments", (n % 2 == 0).alias("is_self"), (n % 43 == 0).alias("stickied"),
                    F.when(n % 3 == 0, "Flair").alias("link_flair_text"), "url")
    o = o.withColumn("subreddit", F.concat(F.lit("sub"), n % 2))
    page = o.groupBy("domain", "subreddit", F.floor(c("ingest_seq") / PAGE).alias("seq")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ingest_seq", post.alias("h")))), lambda s: s.h).alias("posts"))
    return page.select("seq", F.to_json(F.array(F.struct("domain", "subreddit", "posts"))).alias("value"))


_ISO = "CASE WHEN cts IS NULL THEN '' ELSE strftime(cts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END"
_FLAIR = "CASE WHEN n_chars % 3 = 0 THEN 'Flair' ELSE '' END"


@query("SRC-06", oracle(f"""SELECT domain, community, source_native_id, title, created_at, tags FROM (SELECT domain, 'r/sub' || (n_chars % 2) AS community, CASE WHEN n_chars % 31 <> 0 THEN source_native_id END AS source_native_id,
  title, {_ISO} AS created_at, {_FLAIR} AS tags, row_number() OVER (PARTITION BY domain, n_chars % 2 ORDER BY doc_id) AS rn FROM item) t WHERE rn <= 30"""))
def reddit(spark, d):
    subs = spark.createDataFrame([(x, 2) for x in lx.DOMAINS + [""]], "domain string, n_subs int")
    got = pl.reddit_listing(reddit_pages(spark, d), 60, subs)
    return got.select("domain", "community", "source_native_id", "title", "created_at", F.array_join("tags", "|").alias("tags"))


@query("SRC-07", oracle(f"""SELECT sha1('reddit:' || doc_id) AS opportunity_id, 'r/sub' || (n_chars % 2) AS community, substr(title, 1, 300) AS title, md5(substr(body, 1, 4000)) AS body_md5,
  {_ISO} AS created_at, {_FLAIR} AS flair, CASE WHEN n_chars % 2 <> 0 THEN url END AS external_url FROM item WHERE n_chars % 43 <> 0 AND n_chars % 31 <> 0 AND title <> ''"""))
def reddit_snapshot(spark, d):
    got = pl.reddit_snapshot(reddit_pages(spark, d))
    return got.select("opportunity_id", "community", "title", F.md5("body").alias("body_md5"), "created_at", F.array_join("tags", "|").alias("flair"), "signals.external_url")


@query("SRC-08", oracle("""SELECT uri AS source_native_id, CASE WHEN COALESCE(author, '') <> '' THEN 'https://bsky.app/profile/' || author || '/post/' || doc_id ELSE uri END AS url, '' AS title, length(body) AS body_length,
  COALESCE(author, '') AS author, score, num_comments, n_chars % 5 AS reposts FROM (SELECT *, 'at://did/app.post/' || doc_id AS uri FROM item) t"""))
def bluesky(spark, d):
    o = tb.opportunities(spark, d)
    hit = F.struct(F.concat(F.lit("at://did/app.post/"), "ingest_seq").alias("uri"), F.struct(c("author").alias("handle")).alias("author"),
                   F.struct(c("body").alias("text"), c("created_at").alias("createdAt")).alias("record"), c("score").alias("likeCount"), c("num_comments").alias("replyCount"),
                   (F.length("body") % 5).alias("repostCount"))
    got = pl.bluesky(pages_of(o, hit, "posts"))
    return got.select("source_native_id", "url", "title", F.length("body").cast("bigint").alias("body_length"), "author", "score", "num_comments", c("signals.repostCount").alias("reposts"))


# What each kind of log event stands for in an hourly public event file.
KINDS = {"view": "PushEvent", "click": "PullRequestEvent", "purchase": "IssuesEvent", "error": "IssueCommentEvent", "signup": "WatchEvent"}


def event_lines(spark, d):
    """The event log as JSON lines of the public archive's shape, some of them broken."""
    from beaconlake.functions.numeric import lookup
    e = tb.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    repo = F.when(c("event_id") % 71 != 0, F.struct(F.concat(F.lit("org"), c("user_id") % 7, F.lit("/repo"), "k").alias("name")))
    line = F.to_json(F.struct(lookup(c("event_type"), KINDS).alias("type"), repo.alias("repo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")))
    return e.select(F.when(c("event_id") % 59 == 0, F.lit('{"type": "PushEv')).otherwise(line).alias("value"), F.date_format("ts", "yyyy-MM-dd-H").alias("hour"))


def archive_events(spark, d):
    path = scratch_path(spark, "archive")
    event_lines(spark, d).select("value").write.option("compression", "gzip").text(path)
    return ar.read_event_files(spark, path)


_KIND = "CASE event_type WHEN 'view' THEN 'PushEvent' WHEN 'click' THEN 'PullRequestEvent' WHEN 'purchase' THEN 'IssuesEvent' WHEN 'error' THEN 'IssueCommentEvent' ELSE 'WatchEvent' END"
GH = f"""ge AS (SELECT {_KIND} AS type, CASE WHEN event_id % 71 <> 0 THEN 'org' || (user_id % 7) || '/repo' || json_extract_string(props, '$.k') END AS repo,
  date_trunc('hour', ts) AS hour FROM events WHERE event_id % 59 <> 0),
gw AS (SELECT *, CASE type WHEN 'PushEvent' THEN 1 WHEN 'PullRequestEvent' THEN 3 WHEN 'IssuesEvent' THEN 3 WHEN 'IssueCommentEvent' THEN 2 END AS weight FROM ge),
gs AS (SELECT repo, CAST(sum(weight) AS BIGINT) AS activity FROM gw WHERE weight IS NOT NULL AND repo IS NOT NULL GROUP BY repo)"""


@query("SRC-09", f"WITH {GH} SELECT type, repo, count(*) AS n FROM ge GROUP BY ALL")
def archive_scan(spark, d):
    return archive_events(spark, d).groupBy("type", c("repo.name").alias("repo")).agg(N().alias("n"))


@query("PRJ-17", f"WITH {GH} SELECT type, repo, CAST(weight AS BIGINT) AS weight, count(*) AS n FROM gw WHERE weight IS NOT NULL AND repo IS NOT NULL GROUP BY ALL")
def weighted_events(spark, d):
    return ar.weighted_events(ar.parse_event_lines(event_lines(spark, d))).groupBy("type", "repo", c("weight").cast("bigint").alias("weight")).agg(N().alias("n"))


@query("AGG-12", f"WITH {GH} SELECT repo, activity FROM gs")
def activity_scores(spark, d):
    return ar.activity_scores(ar.weighted_events(archive_events(spark, d)))


def repo_dimension(spark, d):
    """One row per repository, from the customers: stars, language, topics, description."""
    cu = tb.table(spark, d, "customer")
    return cu.selectExpr("concat('org', c_custkey % 7, '/repo', c_custkey div 7) as repo", "cast(abs(c_acctbal) / 10 as bigint) as stars",
                         "element_at(array('Rust', 'Python', 'Go'), cast(c_custkey % 3 as int) + 1) as language",
                         "array(lower(c_mktsegment)) as topics", "element_at(array('react ui', 'notes', 'cloud helper'), cast(c_nationkey % 3 as int) + 1) as description")


def _dom_case():
    return "CASE " + " ".join(f"WHEN {tb._any('txt', w)} THEN '{k}'" for k, w in lx.DOMAIN_TERMS.items()) + f" ELSE '{lx.DEFAULT_REPO_DOMAIN}' END"


_REPOS = """, rd AS (SELECT 'org' || (c_custkey % 7) || '/repo' || (c_custkey // 7) AS repo, CAST(trunc(abs(c_acctbal) / 10) AS BIGINT) AS stars, ['Rust', 'Python', 'Go'][(c_custkey % 3) + 1] AS language,
  lower(c_mktsegment) AS topics, ['react ui', 'notes', 'cloud helper'][(c_nationkey % 3) + 1] AS description FROM customer)"""


@query("TOP-13", f"WITH {GH}{_REPOS} SELECT repo, activity, stars FROM (SELECT * FROM gs ORDER BY activity DESC, repo LIMIT 400) t JOIN rd USING (repo) WHERE stars >= 50")
def active_repos(spark, d):
    return ar.active_repos(ar.activity_scores(ar.weighted_events(archive_events(spark, d))), repo_dimension(spark, d)).select("repo", "activity", "stars")


@query("JOI-15", f"WITH x AS (SELECT 1){_REPOS}, tx AS (SELECT *, lower(repo || ' ' || language || ' ' || topics || ' ' || description) AS txt FROM rd) SELECT repo, count(*) AS n, min({_dom_case()}) AS domain FROM tx GROUP BY repo")
def first_matching_term(spark, d):
    cu = repo_dimension(spark, d)
    got = cu.withColumn("domain", ar.domain_of_text(F.concat_ws(" ", "repo", "language", F.array_join("topics", " "), "description")))
    return got.groupBy("repo").agg(N().alias("n"), F.min("domain").alias("domain"))


@query("SRC-12", oracle("SELECT opportunity_id, dims, entries, true AS unit_length FROM " + hashed_sql("opp", "opportunity_id", "trim(title || chr(10) || body)", 64)))
def embedding_build(spark, d):
    o = tb.opportunities(spark, d)
    v = o.select("opportunity_id", en.encoder(64)(en.embedding_text(c("title"), c("body"))).alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("opportunity_id", F.size("v").cast("bigint").alias("dims"), entries("v").alias("entries"), (F.abs(size - 1) < 1e-4).alias("unit_length"))


# ---- label files -------------------------------------------------------------------------
VALID = lx.DOMAINS + ["other"]


def chunk_files(spark, d):
    """Label files of up to 200 rows each; a second, later set overrides some of them."""
    o = items(spark, d)
    first = o.select("ingest_seq", F.to_json(F.concat(F.array(F.lit("bogus")), "domain_list")).alias("v"), F.lit("a").alias("wave"))
    again = o.where("length(body) > 3000").select("ingest_seq", F.lit('["cloud_apis","x","mobile_dev"]').alias("v"), F.lit("b").alias("wave"))
    broken = o.where("length(body) < 300").select("ingest_seq", F.lit('"text"').alias("v"), F.lit("c").alias("wave"))
    rows = first.unionByName(again).unionByName(broken)
    return rows.groupBy(F.concat("wave", F.format_string("%09d", F.floor(c("ingest_seq") / 200))).alias("file")).agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), c("ingest_seq").cast("string"), F.lit('":'), "v")), ","), F.lit("}")).alias("value"))


def written_chunks(spark, d):
    path = scratch_path(spark, "labels")
    chunk_files(spark, d).write.partitionBy("file").text(path)
    spark.createDataFrame([("zz_bad", "{broken")], "file string, value string").write.mode("append").partitionBy("file").text(path)
    return lb.whole_files(spark, path + "/file=*")


LAB = f"""lab AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN ['cloud_apis', 'mobile_dev'] WHEN len(k) = 0 THEN ['other'] ELSE list_slice(k, 1, 3) END AS labels FROM
  (SELECT *, list_filter(domain_list, lambda x: list_contains({tb.sql_list(VALID)}, x)) AS k FROM item) t)"""


@query("SRC-13", oracle("SELECT doc_id AS rid, array_to_string(labels, ',') AS labels FROM lab", extra="," + LAB))
def label_chunks(spark, d):
    return lb.label_chunks(written_chunks(spark, d), VALID).select("rid", F.array_join("labels", ",").alias("labels"))


@query("SRC-14", oracle(f"""SELECT source_native_id AS id, array_to_string(CASE WHEN late THEN ['b2b_saas'] ELSE k END, ',') AS labels, CASE WHEN late THEN false ELSE n_chars % 10 = 0 OR len(k) = 0 END AS noise FROM
  (SELECT *, list_slice(list_filter(domain_list, lambda x: list_contains({tb.sql_list(lx.DOMAINS)}, x)), 1, 3) AS k, n_chars > 3000 AS late FROM item) t"""))
def verdict_files(spark, d):
    return verdicts(spark, d).select("id", F.array_join("labels", ",").alias("labels"), "noise")


def verdicts(spark, d):
    o = items(spark, d)
    one = o.select("ingest_seq", F.struct(c("source_native_id").alias("id"), c("domain_list").alias("domains"), (F.length("body") % 10 == 0).alias("noise")).alias("v"), F.lit("a").alias("wave"))
    two = o.where("length(body) > 3000").select("ingest_seq", F.struct(c("source_native_id").alias("id"), F.array(F.lit("b2b_saas")).alias("domains"), F.lit(False).alias("noise")).alias("v"), F.lit("b").alias("wave"))
    files = one.unionByName(two).groupBy(F.concat("wave", F.format_string("%09d", F.floor(c("ingest_seq") / 200))).alias("file")).agg(F.to_json(F.collect_list("v")).alias("value"))
    return lb.verdicts(files, lx.DOMAINS)


def enrichment_files(spark, d):
    """Repository facts of the github items' communities, as one JSON map per name."""
    g = tb.opportunities(spark, d).where("source = 'github' and community <> ''").groupBy("community").agg(F.sum(F.length("body")).alias("t"), N().alias("n"))
    g = g.where(c("n") > 6)
    facts = F.to_json(F.struct((c("t") % 9000).alias("stars"), F.when(c("t") % 2 == 0, "Zig").alias("language"), (c("t") % 50).alias("forks"), (c("t") % 6).alias("contributors"), (c("t") % 4 == 0).alias("archived")))
    return g.select(c("community").alias("file"), F.concat(F.lit('{"'), "community", F.lit('":'), facts, F.lit("}")).alias("value"))


ENR = "enr AS (SELECT community AS repo, t % 9000 AS stars, CASE WHEN t % 2 = 0 THEN 'Zig' END AS language, t % 50 AS forks, t % 6 AS contributors, t % 4 = 0 AS archived FROM (SELECT community, CAST(sum(length(body)) AS BIGINT) AS t, count(*) AS n FROM opp WHERE source = 'github' AND community <> '' GROUP BY community) q WHERE n > 6)"


@query("SRC-15", oracle("SELECT repo, stars, language, forks, contributors, archived FROM enr", extra="," + ENR))
def repo_table(spark, d):
    return lb.repo_table(enrichment_files(spark, d)).select("repo", "stars", "language", "forks", "contributors", "archived")


@query("JOI-04", oracle("""SELECT o.opportunity_id, CASE WHEN e.repo IS NULL THEN o.community_size ELSE e.stars END AS community_size, COALESCE(e.language, o.language) AS language,
  CASE WHEN e.repo IS NULL THEN o.contributors ELSE e.contributors END AS contributors, o.state FROM item o LEFT JOIN enr e ON o.community = e.repo AND o.source = 'github'""", extra="," + ENR))
def enrich_items(spark, d):
    got = lb.enrich_items(tb.opportunities(spark, d), lb.repo_table(enrichment_files(spark, d)))
    sig = jsontext.signals_of(c("signals"))
    return got.select("opportunity_id", "community_size", "language", sig.contributors.alias("contributors"), sig.state.alias("state"))


# ---- sinks -------------------------------------------------------------------------------
def labelled(spark, d):
    return tb.opportunities(spark, d).join(tb.table(spark, d, "labels").selectExpr("doc_id as ingest_seq"), "ingest_seq", "left_semi")


@query("SRC-16", oracle("SELECT source, count(*) AS rows, (SELECT count(*) FROM opp) - (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM opp)) AS inserted FROM opp GROUP BY source"))
def insert_if_absent(spark, d):
    path = scratch_path(spark, "corpus")
    labelled(spark, d).write.parquet(path)
    arrivals = tb.opportunities(spark, d)
    inserted, _ = si.append_new(arrivals.unionByName(arrivals), path, "opportunity_id", "ingest_seq")
    return spark.read.parquet(path).groupBy("source").agg(N().alias("rows")).withColumn("inserted", F.lit(inserted).cast("bigint"))


@query("SRC-17", oracle("SELECT opportunity_id, popularity, effort_min FROM feat", feat=True))
def feature_sink(spark, d):
    table = ft.feature_table(tb.opportunities(spark, d), tb.as_of())
    return si.overwrite(table, scratch_path(spark, "features")).select("opportunity_id", "popularity", "effort_min")


_WEEKS = """SELECT 'momentum' AS result, domain, strftime(week, '%Y-%m-%d') AS name, n AS volume, CAST(floor(share * 1e6 + 0.5) AS BIGINT) AS share_micro,
  CAST(floor((share - lag(share, 1, 0e0) OVER (PARTITION BY domain ORDER BY week)) * 1e8 + 0.5) AS BIGINT) AS change_micro FROM grid WHERE domain <> ''"""


@query("SRC-18", oracle(f"""SELECT 'distribution' AS result, domain, NULL AS name, count(*) AS volume, count(DISTINCT voice) AS share_micro, CAST(NULL AS BIGINT) AS change_micro FROM item WHERE domain <> '' GROUP BY domain UNION ALL
  SELECT 'communities', domain, spot, count(*), count(DISTINCT voice), CAST(sum(engagement) AS BIGINT) FROM item WHERE spot IS NOT NULL AND domain <> '' GROUP BY domain, spot UNION ALL {_WEEKS}""",
  extra=_GRID.replace("WHERE week IS NOT NULL GROUP", "WHERE week IS NOT NULL AND domain <> '' GROUP")))
def result_tables(spark, d):
    """Three stored tables, read back whole: distribution (with authors), communities (authors,
    engagement) and the share of every week with its change in points."""
    a, path = act(spark, d).where("domain <> ''"), scratch_path(spark, "results")
    none = F.lit(None).cast("bigint")
    one = si.overwrite(tr.category_distribution(a), path + "/distribution", ["domain"])
    two = si.overwrite(tr.community_activity(a, ["domain", "community"]), path + "/communities", ["domain"])
    three = si.overwrite(tr.share_changes(tr.share_grid(tr.weekly_counts(a))), path + "/momentum", ["domain"])
    row = lambda df, name, *cols: df.select(F.lit(name).alias("result"), "domain", *[x.alias(n) for x, n in zip(cols, ("name", "volume", "share_micro", "change_micro"))])
    return (row(one, "distribution", F.lit(None).cast("string"), c("volume"), c("authors"), none)
            .unionByName(row(two, "communities", c("community"), c("volume"), c("authors"), c("engagement").cast("bigint")))
            .unionByName(row(three, "momentum", F.date_format("week", "yyyy-MM-dd"), c("n"), micro(c("share")), micro(c("change_pp")))))


@query("SRC-20", oracle("SELECT domain, count(DISTINCT voice) AS authors, true AS within_bound FROM item GROUP BY domain UNION ALL SELECT NULL, count(DISTINCT voice), true FROM item"))
def sketch_sink(spark, d):
    """One stored sketch per domain and one of the whole, merged from them."""
    a, path = act(spark, d), scratch_path(spark, "sketches")
    per = si.overwrite(sk.reach_sketches(a, ["domain"]), path + "/domains")
    whole = si.overwrite(per.agg(F.hll_union_agg("sketch").alias("sketch")), path + "/global")
    stored = per.select("domain", "sketch").unionByName(whole.select(F.lit(None).cast("string").alias("domain"), "sketch"))
    exact = a.groupBy("domain").agg(F.countDistinct("author").alias("authors")).unionByName(a.agg(F.countDistinct("author").alias("authors")).select(F.lit(None).cast("string").alias("domain"), "authors"))
    got = exact.join(stored.withColumnRenamed("domain", "of"), c("domain").eqNullSafe(c("of")))
    return got.select("domain", "authors", near(F.hll_sketch_estimate("sketch"), c("authors")).alias("within_bound"))


@query("SRC-21", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def event_sink(spark, d):
    path = scratch_path(spark, "log")
    log = tb.table(spark, d, "events").select("event_id", "event_type", "user_id")
    si.append_events(log, path)
    si.append_events(log, path)
    return spark.read.schema("event_id bigint, event_type string, user_id bigint").json(path).groupBy("event_type").agg(N().alias("n"))


@query("SRC-22", oracle("SELECT opportunity_id, (row_number() OVER (ORDER BY opportunity_id) - 1) % greatest(1, least(16, CAST(ceil((SELECT count(*) FROM opp) / 100e0) AS BIGINT))) AS chunk FROM opp"))
def dealt_chunks(spark, d):
    chunks = si.round_robin_chunks(tb.opportunities(spark, d).select("opportunity_id"), ["opportunity_id"], 100)
    return si.overwrite(chunks, scratch_path(spark, "dealt"), ["chunk"]).withColumn("chunk", c("chunk").cast("bigint"))


@query("SRC-23", oracle("SELECT opportunity_id, (row_number() OVER (ORDER BY opportunity_id) - 1) // 20 AS chunk FROM opp"))
def block_chunks(spark, d):
    chunks = si.block_chunks(tb.opportunities(spark, d).select("opportunity_id"), ["opportunity_id"], 20)
    return si.export_blocks(chunks, scratch_path(spark, "blocks")).withColumn("chunk", c("chunk").cast("bigint"))


@query("SRC-24", oracle("SELECT source, CAST(sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END) AS BIGINT) AS archived, CAST(sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 0 ELSE 1 END) AS BIGINT) AS kept FROM opp GROUP BY source"))
def archive_noise(spark, d):
    o, path = tb.opportunities(spark, d), scratch_path(spark, "noise")
    noise = tb.table(spark, d, "labels").where("toxic = 1").selectExpr("doc_id as ingest_seq")
    kept = si.archive_and_drop(o, noise, "ingest_seq", path)
    gone = spark.read.schema("opportunity_id string, source string").json(path)
    both = kept.select("source", F.lit(0).alias("a")).unionByName(gone.select("source", F.lit(1).alias("a")))
    return both.groupBy("source").agg(F.count_if(c("a") == 1).alias("archived"), F.count_if(c("a") == 0).alias("kept"))


# ---- profiles of the data ----------------------------------------------------------------
_COVER = " UNION ALL ".join(f"SELECT source, '{f}' AS field, CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS present, count(*) AS rows FROM opp GROUP BY source" for f, cond in [
    ("score", "score <> 0"), ("num_comments", "num_comments <> 0"), ("author_reputation", "false"), ("community", "community <> ''"), ("community_size", "community_size <> 0"),
    ("last_activity_at", "false"), ("language", "language <> ''"), ("tags", "len(tag_list) > 0 OR doc_id % 89 = 3")])
_RANGE = " UNION ALL ".join(f"""SELECT source, '{f}' AS field, min({f})::DOUBLE AS "min", median({f})::DOUBLE AS p50, list_sort(list({f}) FILTER (WHERE {f} IS NOT NULL))[CAST(floor((count({f}) - 1) * 0.9e0) AS INTEGER) + 1]::DOUBLE AS p90, max({f})::DOUBLE AS "max" FROM opp GROUP BY source HAVING count({f}) > 0""" for f in pf.NUMBERS)


_SIGNALS = " UNION ALL ".join(f"SELECT source, '{k}' AS name, '{t}' AS kind, count(*) AS present FROM opp WHERE {cond} GROUP BY source" for k, t, cond in [
    ("star_velocity", "number", "gsig AND n_chars % 19 <> 0"), ("contributors", "number", "gsig"), ("open_issues", "number", "gsig"), ("archived", "boolean", "gsig"),
    ("state", "string", "gsig AND (n_chars % 13 = 0 OR n_chars % 29 <> 0)"), ("reading_time_min", "number", "sig_ok AND source = 'devto' AND n_chars % 23 <> 0")])


@query("AGG-22", oracle(f"""SELECT source, 'signal ' || name || ' ' || kind AS item, CAST(present AS DOUBLE) AS a, CAST(rows AS DOUBLE) AS b, NULL AS c, NULL AS d FROM ({_SIGNALS}) t JOIN (SELECT source, count(*) AS rows FROM opp GROUP BY source) z USING (source)
  UNION ALL SELECT source, 'signals broken', CAST(sum(CASE WHEN sig_ok THEN 0 ELSE 1 END) AS DOUBLE), CAST(count(*) AS DOUBLE), NULL, NULL FROM opp GROUP BY source UNION ALL
  SELECT source, 'coverage ' || field AS item, CAST(present AS DOUBLE) AS a, CAST(rows AS DOUBLE) AS b, NULL AS c, NULL AS d FROM ({_COVER}) t
  UNION ALL SELECT source, 'range ' || field, "min", p50, p90, "max" FROM ({_RANGE}) t UNION ALL SELECT source, 'type ' || opportunity_type, count(*), NULL, NULL, NULL FROM opp GROUP BY source, opportunity_type
  UNION ALL SELECT source, 'dates ' || min(substr(created_at, 1, 10)) || ' ' || max(substr(created_at, 1, 10)), NULL, NULL, NULL, NULL FROM opp WHERE created_at <> '' GROUP BY source"""))
def data_profile(spark, d):
    o = tb.opportunities(spark, d)
    num = lambda *names: [c(n).cast("double").alias(a) if n else F.lit(None).cast("double").alias(a) for n, a in zip(names, "abcd")]
    cover = pf.field_coverage(o).select("source", F.concat(F.lit("coverage "), "field").alias("item"), *num("present", "rows", None, None))
    span = pf.numeric_ranges(o).select("source", F.concat(F.lit("range "), "field").alias("item"), *num("min", "p50", "p90", "max"))
    kinds = pf.type_counts(o).select("source", F.concat(F.lit("type "), "opportunity_type").alias("item"), *num("n", None, None, None))
    days = pf.date_range(o).select("source", F.concat_ws(" ", F.lit("dates"), "first_day", "last_day").alias("item"), *num(None, None, None, None))
    keys = checkpointed(pf.object_keys(o, "source", "signals"))
    held = keys.where("name is not null").select("source", F.concat_ws(" ", F.lit("signal"), "name", "kind").alias("item"), *num("present", "rows", None, None))
    broken = keys.select("source", "rows", "broken").distinct().select("source", F.lit("signals broken").alias("item"), *num("broken", "rows", None, None))
    return cover.unionByName(span).unionByName(kinds).unionByName(days).unionByName(held).unionByName(broken)


_P = "FROM (SELECT * FROM opp WHERE source = 'reddit') t"


_FIELDS = ["num_comments", "score", "body", "created_at", "author", "community", "community_size", "language", "url"]
_PRESENT = " UNION ALL ".join(f"SELECT 'field {f}', round_even(100e0 * sum(CASE WHEN {f} IS NOT NULL AND CAST({f} AS VARCHAR) <> '' THEN 1 ELSE 0 END) / count(*), 1), NULL, NULL, NULL {_P}" for f in _FIELDS)


@query("AGG-23", oracle(f"""SELECT 'all' AS part, count(*)::DOUBLE AS a, round_even(100e0 * sum(CASE WHEN num_comments > 10 THEN 1 ELSE 0 END) / count(*), 0) AS b, median(num_comments)::DOUBLE AS c,
  list_sort(list(num_comments))[CAST(least(count(*) - 1, floor(count(*) * 0.9e0)) AS INTEGER) + 1]::DOUBLE AS d {_P}
  UNION ALL SELECT 'shares', floor(avg(num_comments) * 1e6 + 0.5) / 1e6, round_even(100e0 * sum(CASE WHEN num_comments > 50 THEN 1 ELSE 0 END) / count(*), 0), round_even(100e0 * sum(CASE WHEN body <> '' THEN 1 ELSE 0 END) / count(*), 0), round_even(100e0 * sum(CASE WHEN body = '' OR body IS NULL THEN 1 ELSE 0 END) / count(*), 0) {_P}
  UNION ALL {_PRESENT}
  UNION ALL SELECT 'year ' || substr(created_at, 1, 4), count(*)::DOUBLE, NULL, NULL, NULL {_P} WHERE regexp_matches(created_at, '^[0-9]{{4}}-') GROUP BY substr(created_at, 1, 4)
  UNION ALL SELECT community, count(*)::DOUBLE, NULL, median(COALESCE(num_comments, 0))::DOUBLE, NULL {_P} GROUP BY community"""))
def thread_profile(spark, d):
    posts = tb.opportunities(spark, d).where("source = 'reddit'")
    head = pf.thread_profile(posts).select(F.lit("reddit").alias("source"), "posts", "over_10_pct")
    span = checkpointed(pf.numeric_ranges(posts, fields=["num_comments"], p90_of_n=True).select("source", "p50", "p90", "mean"))
    none = F.lit(None).cast("double")
    shares = pf.thread_profile(posts).withColumn("mean", span.select("mean").scalar()).select(
        F.lit("shares").alias("part"), (F.floor(c("mean") * 1e6 + 0.5) / 1e6).alias("a"), c("over_50_pct").cast("double").alias("b"), c("self_pct").cast("double").alias("c"), c("link_pct").cast("double").alias("d"))
    fields = pf.presence(posts, _FIELDS).select(F.concat(F.lit("field "), "field").alias("part"), c("pct").cast("double").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))
    years = pf.posts_by_year(posts).select(F.concat(F.lit("year "), c("year").cast("string")).alias("part"), c("n").cast("double").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))
    whole = head.join(span, "source").select(F.lit("all").alias("part"), c("posts").cast("double").alias("a"), c("over_10_pct").cast("double").alias("b"), c("p50").alias("c"), c("p90").alias("d"))
    per = pf.median_comments(posts, ["community"]).select(c("community").alias("part"), c("posts").cast("double").alias("a"), F.lit(None).cast("double").alias("b"),
                                                          c("median_comments").cast("double").alias("c"), F.lit(None).cast("double").alias("d"))
    return whole.unionByName(per).unionByName(shares).unionByName(years).unionByName(fields)


@query("UDF-06", oracle("SELECT domain, count(*) AS items, CAST(sum(length(title)) AS BIGINT) AS title_chars FROM item WHERE domain <> '' GROUP BY domain"))
def captured_source(spark, d):
    """Payload files per domain, read through the pluggable source and normalized."""
    from beaconlake.sources.captured import CapturedPayloads
    path = scratch_path(spark, "captured")
    o = tb.opportunities(spark, d).where("domain <> ''")
    hit = F.struct(c("ingest_seq").alias("id"), "url", "title")
    pages_of(o, hit).select("domain", "value").write.partitionBy("domain").text(path)
    spark.dataSource.register(CapturedPayloads)
    uri = path if "://" in path or path.startswith("file:") else "file://" + path
    uri = "file:///" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri
    payloads = spark.read.format("captured_payloads").option("path", uri).load()
    return pl.devto(payloads).groupBy("domain").agg(N().alias("items"), F.sum(F.length("title")).alias("title_chars"))
