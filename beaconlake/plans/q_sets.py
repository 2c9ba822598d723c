"""Joins, set operations, deduplication."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.operators import features as ft, trends as tr
from beaconlake.plans import testbed as tb
from beaconlake.plans.q_columns import items
from beaconlake.plans.q_sources import LAB, chunk_files, VALID, labelled, verdicts
from beaconlake.plans.q_trends import N, act, doc_weekly, text_week
from beaconlake.plans.registry import query
from beaconlake.plans.testbed import oracle, r_sql
from beaconlake.sources import labels as lb, sinks as si

c = F.col


@query("JOI-01", oracle("SELECT domain, count(*) AS n, CAST(floor(avg(velocity) * 1e8 + 0.5) AS BIGINT) AS velocity, max(effort_min) AS longest FROM feat GROUP BY domain", feat=True))
def join_features(spark, d):
    o = tb.opportunities(spark, d)
    j = o.select("opportunity_id", "domain").join(ft.feature_table(o, tb.as_of()), "opportunity_id")
    return j.groupBy("domain").agg(N().alias("n"), F.floor(F.avg("velocity") * 1e8 + 0.5).alias("velocity"), F.max("effort_min").alias("longest"))


@query("JOI-02", oracle("""SELECT w.domain, strftime(w.week, '%Y-%m-%d') AS week, w.n, CAST(floor(w.n::DOUBLE / t.total * 1e6 + 0.5) AS BIGINT) AS share_micro FROM (SELECT domain, week, count(*) AS n FROM item WHERE week IS NOT NULL GROUP BY ALL) w
  JOIN (SELECT week, count(*) AS total FROM item WHERE week IS NOT NULL GROUP BY week) t USING (week)"""))
def weekly_share(spark, d):
    w = doc_weekly(spark, d)
    totals = w.groupBy("week").agg(F.sum("n").alias("total"))
    return text_week(w.join(totals, "week")).select("domain", "week", "n", F.floor(c("n") / c("total") * 1e6 + 0.5).alias("share_micro"))


@query("JOI-03", oracle("SELECT h.rank, o.opportunity_id, o.title FROM (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM embeddings) h JOIN opp o USING (doc_id)"))
def hydrate(spark, d):
    """An ordered hit list joined to the corpus; its rank travels along."""
    from beaconlake.operators import ordered
    hits = tb.table(spark, d, "embeddings").select((-c("label")).alias("k"), c("vec_id").alias("ingest_seq"))
    hits = ordered.numbered(hits, ["k", "ingest_seq"], "rank").withColumn("rank", c("rank") + 1)
    return tb.opportunities(spark, d).join(hits, "ingest_seq").select("rank", "opportunity_id", "title").orderBy("rank")


@query("JOI-05", oracle("""SELECT o.opportunity_id, CASE WHEN l.labels IS NULL THEN o.domain ELSE l.labels[1] END AS domain, array_to_string(COALESCE(l.labels, o.domain_list), ',') AS domains
  FROM opp o LEFT JOIN (SELECT * FROM lab JOIN labels lq USING (doc_id)) l ON o.doc_id = l.doc_id""", extra="," + LAB.replace("labels FROM", "labels FROM", 1)))
def relabel(spark, d):
    fresh = lb.label_chunks(chunk_files(spark, d), VALID).join(tb.table(spark, d, "labels").selectExpr("doc_id as rid"), "rid", "left_semi")
    got = ft.decoded(lb.relabel(tb.opportunities(spark, d), fresh.withColumnRenamed("rid", "rid"), "ingest_seq"))
    return got.select("opportunity_id", "domain", F.array_join("domain_list", ",").alias("domains"))


@query("JOI-10", oracle("SELECT opportunity_id FROM opp WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def not_yet_done(spark, d):
    return tb.opportunities(spark, d).join(tb.table(spark, d, "labels").selectExpr("doc_id as ingest_seq"), "ingest_seq", "left_anti").select("opportunity_id")


@query("JOI-11", oracle("SELECT opportunity_id, domain FROM opp WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def ids_in_set(spark, d):
    good = tb.table(spark, d, "labels").where("quality = 1").selectExpr("doc_id as ingest_seq")
    return tb.opportunities(spark, d).join(good, "ingest_seq", "left_semi").select("opportunity_id", "domain")


@query("JOI-12", """WITH l AS (SELECT doc_id FROM labels UNION ALL SELECT -1 - doc_id FROM labels WHERE toxic = 1) SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM l)) AS covered,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS missing, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown""")
def coverage_diff(spark, d):
    l = tb.table(spark, d, "labels")
    rid = l.selectExpr("doc_id as rid").unionByName(l.where("toxic = 1").selectExpr("-1 - doc_id as rid"))
    return lb.label_coverage(tb.table(spark, d, "documents"), rid, "doc_id")


# ---- set operations ----------------------------------------------------------------------
@query("SET-02", oracle("""SELECT opportunity_id, min(place) AS place FROM (SELECT opportunity_id, 1000000 + row_number() OVER (ORDER BY score DESC NULLS LAST, opportunity_id) AS place FROM opp WHERE score IS NOT NULL
  UNION ALL SELECT opportunity_id, 2000000 + row_number() OVER (ORDER BY num_comments DESC, opportunity_id) FROM opp) t WHERE place % 1000000 <= 20 GROUP BY opportunity_id"""))
def pooled_first_seen(spark, d):
    """Two top-20 lists as one pool; an id keeps the place where it first appears."""
    o = tb.opportunities(spark, d).select("opportunity_id", "score", "num_comments").withColumn("all", F.lit(1))
    a = tr.top_n(o.where("score is not null"), ["all"], [F.desc("score"), c("opportunity_id")], 20, "rank").withColumn("list", F.lit(1))
    b = tr.top_n(o, ["all"], [F.desc("num_comments"), c("opportunity_id")], 20, "rank").withColumn("list", F.lit(2))
    return pool([a, b])


def pool(lists):
    """Union of ranked lists (list, rank, opportunity_id): first-seen order kept."""
    rows = lists[0].select("list", "rank", "opportunity_id")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("list", "rank", "opportunity_id"))
    return rows.groupBy("opportunity_id").agg(F.min(c("list").cast("bigint") * 1000000 + c("rank")).alias("place"))


_ALL = tb.sql_list(lx.SOURCES)


@query("SET-03", "WITH " + tb.PROF + f" SELECT user_id, array_to_string(list_filter(plats, lambda p: list_contains({_ALL}, p)), ',') AS sources, len(list_filter(doms, lambda x: list_contains(['machine_learning', 'devops_k8s', 'cloud_apis'], x))) > 0 AS overlaps FROM pers")
def intersections(spark, d):
    from beaconlake.plans.q_profiles import personas
    p = personas(spark, d)
    known = F.array(*[F.lit(s) for s in lx.SOURCES])
    return p.select("user_id", F.array_join(F.array_intersect("platforms", known), ",").alias("sources"),
                    F.arrays_overlap("domains", F.array(F.lit("machine_learning"), F.lit("devops_k8s"), F.lit("cloud_apis"))).alias("overlaps"))


@query("SET-04", oracle("SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) t WHERE rn > 1)"))
def survivors(spark, d):
    """All ids less the noise and the later copies."""
    docs = tb.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first = si.first_arrivals(docs, "key", "doc_id").select("doc_id")
    noise = tb.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return first.subtract(noise)


@query("SET-05", "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) t WHERE rn = 1")
def exact_dedup(spark, d):
    """First arrival per key, the key being the hash of the whole text. Copies fold on the
    map side, however many there are."""
    docs = tb.table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), "doc_id", "lang", "source", F.md5("text").alias("text_md5"))
    return si.first_arrivals(docs, "key", "doc_id").drop("key")


@query("SET-06", oracle("SELECT source, count(*) AS asked, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS members, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS others FROM opp GROUP BY source"))
def membership(spark, d):
    """Which rows are in a given set, by one look at it."""
    members = labelled(spark, d).select("opportunity_id").distinct().withColumn("member", F.lit(1))
    rows = tb.opportunities(spark, d).select("opportunity_id", "source").join(members, "opportunity_id", "left").fillna(0, ["member"])
    return rows.groupBy("source").agg(N().alias("asked"), F.sum("member").cast("bigint").alias("members"), F.sum(1 - c("member")).cast("bigint").alias("others"))


_OLD = "SELECT doc_id, 'old' AS v FROM labels WHERE quality = 1"
_NEW = "SELECT doc_id, 'new' AS v FROM labels WHERE toxic = 0"


@query("SET-08", f"""SELECT doc_id, v, 'fill' AS rule FROM ({_OLD}) a UNION ALL SELECT doc_id, v, 'fill' FROM ({_NEW}) b WHERE doc_id NOT IN (SELECT doc_id FROM ({_OLD}) a)
  UNION ALL SELECT doc_id, v, 'replace' FROM ({_NEW}) b UNION ALL SELECT doc_id, v, 'replace' FROM ({_OLD}) a WHERE doc_id NOT IN (SELECT doc_id FROM ({_NEW}) b)""")
def cache_merge(spark, d):
    done = tb.table(spark, d, "labels")
    old = done.where("quality = 1").select("doc_id", F.lit("old").alias("v"))
    new = done.where("toxic = 0").select("doc_id", F.lit("new").alias("v"))
    fill = lb.merged_cache(old, new, "doc_id", False).withColumn("rule", F.lit("fill"))
    return fill.unionByName(lb.merged_cache(old, new, "doc_id", True).withColumn("rule", F.lit("replace")))
