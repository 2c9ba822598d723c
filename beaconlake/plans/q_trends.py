"""Aggregation, window and top-k operators over the opportunity and event tables."""
from pyspark.sql import Window, functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import dates, numeric as nm, text as tx
from beaconlake.operators import rollup as ru, features as ft, ordered, sketches as sk, trends as tr
from beaconlake.operators import personas as ps
from beaconlake.plans import testbed as tb
from beaconlake.plans.q_columns import Q6, TERMS, items, micro, prototypes
from beaconlake.plans.q_profiles import P, personas
from beaconlake.plans.registry import query
from beaconlake.plans.testbed import oracle, r_sql
from beaconlake.session import checkpointed

c = F.col


def N():
    return F.count(F.lit(1))



def act(spark, d):
    return tr.activity(tb.opportunities(spark, d))


def featured(spark, d):
    o = tb.opportunities(spark, d)
    return o.join(ft.feature_table(o, tb.as_of()), "opportunity_id")


def event_activity(spark, d):
    """The event log as an activity table: event type = domain, user = author."""
    day = F.to_date("ts")
    return tb.table(spark, d, "events").select(
        c("event_id"), c("event_type").alias("domain"), day.alias("day"), F.trunc(day, "week").alias("week"),
        c("user_id").cast("string").alias("author"), "value", "ts")


# ---- aggregations ------------------------------------------------------------------------
@query("AGG-01", oracle(f"SELECT domain, count(*) AS volume, count(DISTINCT voice) AS authors, {r_sql('sum(engagement)::DOUBLE / count(*)', 1)} AS avg_engagement FROM item GROUP BY domain"))
def category_distribution(spark, d):
    return tr.category_distribution(act(spark, d))


@query("AGG-02", oracle("SELECT source, domain, count(*) AS n FROM item GROUP BY source, domain UNION ALL SELECT source, NULL, count(*) FROM item GROUP BY source"))
def source_mix(spark, d):
    return tr.source_mix(act(spark, d))


_COMM = "SELECT {0}, spot AS community, count(*) AS volume, CAST(sum(engagement) AS BIGINT) AS engagement, count(DISTINCT voice) AS authors FROM item WHERE spot IS NOT NULL GROUP BY {0}, spot"


@query("AGG-03", oracle(_COMM.format("domain")))
def community_activity(spark, d):
    return tr.community_activity(act(spark, d), ["domain", "community"])


@query("AGG-04", oracle(_COMM.format("source")))
def global_communities(spark, d):
    return tr.community_activity(act(spark, d), ["community", "source"])


@query("AGG-05", oracle("""SELECT strftime(week, '%Y-%m-%d') AS week, domain, count(*) AS n FROM item WHERE week IS NOT NULL GROUP BY week, domain
  UNION ALL SELECT strftime(week, '%Y-%m-%d'), NULL, count(*) FROM item WHERE week IS NOT NULL GROUP BY week"""))
def weekly_volume(spark, d):
    g = act(spark, d).where("week is not null").rollup("week", "domain").agg(N().alias("n"), F.grouping_id().alias("g")).where("g < 3")
    return g.select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.when(c("g") == 0, c("domain")).alias("domain"), "n")


def near(estimate, exact):
    return F.abs(estimate - exact) <= F.greatest(exact * 0.03, F.lit(1.0))


@query("AGG-06", oracle("SELECT domain, count(DISTINCT voice) AS authors, true AS within_bound FROM item GROUP BY domain UNION ALL SELECT NULL, count(DISTINCT voice), true FROM item"))
def distinct_reach(spark, d):
    """Exact and estimated reach of every domain and of all, in one pass."""
    both = act(spark, d).rollup("domain").agg(F.countDistinct("author").alias("authors"), F.hll_sketch_estimate(F.hll_sketch_agg("author", sk.LG_K)).alias("reach"))
    return both.select("domain", "authors", near(c("reach"), c("authors")).alias("within_bound"))


@query("AGG-07", oracle("SELECT scope, count(DISTINCT voice) AS authors, true AS within_bound FROM item JOIN scope USING (domain) GROUP BY scope", extra=tb.scope_sql(True)))
def merged_reach(spark, d):
    a, s = act(spark, d), tb.scopes(spark, True)
    est = sk.merged_reach(tr.scoped(sk.reach_sketches(a, ["domain"]), s), ["scope"])
    pairs = a.where("author is not null").select("domain", "author").distinct()
    exact = tr.scoped(pairs, s).groupBy("scope").agg(F.countDistinct("author").alias("authors"))
    return exact.join(est, "scope").select("scope", "authors", near(c("reach"), c("authors")).alias("within_bound"))


WORDS = _WORDS = f", words AS (SELECT domain, unnest({TERMS}) AS term FROM opp), tc AS (SELECT domain, term, count(*) AS n FROM words GROUP BY ALL)"


@query("AGG-08", oracle("SELECT domain, term, n FROM tc UNION ALL SELECT NULL, term, CAST(sum(n) AS BIGINT) FROM tc GROUP BY term", extra=_WORDS))
def term_frequency(spark, d):
    per = tr.term_counts(items(spark, d))
    whole = per.groupBy("term").agg(F.sum("n").alias("n"))
    return per.unionByName(whole.select(F.lit(None).cast("string").alias("domain"), "term", "n"))


def all_terms(spark, d):
    return items(spark, d).select(F.explode(tx.terms(c("title"), c("tag_list"))).alias("term"))


CM_EPS, CM_DELTA = 5e-4, 0.01
CM_WIDTH, CM_DEPTH = sk.count_min_size(CM_EPS, CM_DELTA)


def cells_sql(rows, keys="", weight="n"):
    """The count-min table of `rows` (term, weight) per key, and the estimate of each term from it."""
    number = lambda at: f"('0x' || substr(md5(term), {at}, 8))::BIGINT"
    return f"""(SELECT {keys}, r, b, sum(w)::BIGINT AS n FROM (SELECT {keys}, {weight} AS w, unnest(range({CM_DEPTH})) AS r,
      ({number(1)} + unnest(range({CM_DEPTH})) * ({number(9)} | 1)) % {CM_WIDTH} AS b FROM {rows}) GROUP BY ALL)""".replace("SELECT , ", "SELECT ")


_CM = f""", exact AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM tc GROUP BY term), cells AS {cells_sql('tc')},
  asked AS (SELECT term, n AS exact, unnest(range({CM_DEPTH})) AS r, (('0x' || substr(md5(term), 1, 8))::BIGINT
    + unnest(range({CM_DEPTH})) * (('0x' || substr(md5(term), 9, 8))::BIGINT | 1)) % {CM_WIDTH} AS b FROM exact),
  guessed AS (SELECT term, any_value(exact) AS exact, min(n) AS estimate FROM asked JOIN cells USING (r, b) GROUP BY term),
  size AS (SELECT sum(n) AS all_n FROM exact)"""


def domain_tables(spark, d):
    """One count-min table per domain."""
    return sk.count_min(tr.term_counts(items(spark, d)), ["domain"], "term", CM_WIDTH, CM_DEPTH, "n")


def exact_terms(spark, d):
    return tr.term_counts(items(spark, d)).groupBy("term").agg(F.sum("n").alias("exact"))


@query("AGG-09", oracle(f"SELECT term, exact, estimate, estimate >= exact AS never_under, estimate - exact <= {CM_EPS}::DOUBLE * all_n + 1 AS within_bound FROM guessed, size ORDER BY exact DESC, term LIMIT 40", extra=_WORDS + _CM))
def count_min(spark, d):
    """The most frequent terms, asked of the merged count-min tables of the domains, next to their exact counts."""
    counts = exact_terms(spark, d)
    top = counts.orderBy(F.desc("exact"), "term").limit(40)
    got = sk.count_min_estimates(sk.merged_count_min(domain_tables(spark, d)), top, "term", CM_WIDTH, CM_DEPTH)
    got = got.withColumn("size", counts.agg(F.sum("exact")).scalar())
    return got.select("term", "exact", "estimate", (c("estimate") >= c("exact")).alias("never_under"),
                      (c("estimate") - c("exact") <= c("size") * CM_EPS + 1).alias("within_bound"))


@query("AGG-10", oracle(f"""SELECT all_n::BIGINT AS stream_size, (SELECT count(*) FROM exact) AS distinct_terms, {CM_WIDTH} AS width, {CM_DEPTH} AS depth, q.*,
  {CM_WIDTH * CM_DEPTH * 8}::BIGINT AS table_bytes, x.bytes AS exact_bytes, {r_sql('x.bytes::DOUBLE / ' + str(CM_WIDTH * CM_DEPTH * 8), 4)} AS compression,
  (SELECT count(DISTINCT voice) FROM item) AS authors, true AS reach_ok FROM size,
  (SELECT CAST(sum(strlen(term) + 8) AS BIGINT) AS bytes FROM exact) x,
  (SELECT {r_sql('avg(estimate - exact)', 4)} AS mean_abs_err, max(estimate - exact) AS max_abs_err, {r_sql('max((estimate - exact)::DOUBLE / exact)', 4)} AS max_rel_err,
    {r_sql('avg(estimate - exact) FILTER (WHERE p <= 20)', 4)} AS top_mean_abs_err, max(estimate - exact) FILTER (WHERE p <= 20) AS top_max_abs_err,
    {r_sql('max((estimate - exact)::DOUBLE / exact) FILTER (WHERE p <= 20)', 4)} AS top_max_rel_err, min(estimate - exact) >= 0 AS never_under
   FROM (SELECT *, row_number() OVER (ORDER BY exact DESC, term) AS p FROM guessed)) q""", extra=_WORDS + _CM))
def sketch_accuracy(spark, d):
    """The count-min table against the exact counts of all terms and of the 20 most frequent, its bytes
    against those of the exact table, and reach against the exact number of authors."""
    counts = exact_terms(spark, d)
    got = sk.count_min_estimates(sk.merged_count_min(domain_tables(spark, d)), counts, "term", CM_WIDTH, CM_DEPTH)
    first = counts.orderBy(F.desc("exact"), "term").limit(20).select(c("term").alias("_term"))
    got = got.join(F.broadcast(first), c("term") == c("_term"), "left")
    off = c("estimate") - c("exact")
    at_top = lambda x: F.when(c("_term").isNotNull(), x)
    r4 = lambda x: nm.fixed_round(x, 4)
    out = got.agg(F.sum("exact").alias("stream_size"), N().alias("distinct_terms"), F.lit(CM_WIDTH).alias("width"), F.lit(CM_DEPTH).alias("depth"),
                  r4(F.avg(off)).alias("mean_abs_err"), F.max(off).alias("max_abs_err"), r4(F.max(off / c("exact"))).alias("max_rel_err"),
                  r4(F.avg(at_top(off))).alias("top_mean_abs_err"), F.max(at_top(off)).alias("top_max_abs_err"), r4(F.max(at_top(off / c("exact")))).alias("top_max_rel_err"),
                  (F.min(off) >= 0).alias("never_under"), F.lit(CM_WIDTH * CM_DEPTH * 8).cast("bigint").alias("table_bytes"),
                  F.sum(F.octet_length("term") + 8).alias("exact_bytes"))
    voices = act(spark, d)
    reach = sk.merged_reach(sk.reach_sketches(voices, ["source"]), [])
    out = out.select("*", r4(c("exact_bytes") / c("table_bytes")).alias("compression"), voices.agg(F.countDistinct("author")).scalar().alias("authors"), reach.scalar().alias("reach"))
    return out.withColumn("reach_ok", near(c("reach"), c("authors"))).drop("reach")


@query("AGG-13", oracle("SELECT source, count(*) AS n FROM opp GROUP BY source"))
def counts_by(spark, d):
    return tb.opportunities(spark, d).groupBy("source").agg(N().alias("n")).orderBy(F.desc("n"), "source")


_TOPT = ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, term) AS position FROM tc) t WHERE position <= 30)"


def top_terms(spark, d, n=30):
    return tr.top_n(tr.term_counts(items(spark, d)), ["domain"], [F.desc("n"), c("term")], n)


@query("AGG-15", oracle("""SELECT scope, term, n, position FROM (SELECT scope, term, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY scope ORDER BY sum(n) DESC, term) AS position
  FROM tc JOIN scope USING (domain) GROUP BY scope, term) t WHERE position <= 30""", extra=_WORDS + tb.scope_sql()))
def scope_terms(spark, d):
    whole = ru.merged_terms(tr.term_counts(items(spark, d)), tb.scopes(spark))
    return tr.top_n(whole, ["scope"], [F.desc("n"), c("term")], 30).select("scope", "term", "n", "position")


_FRESH = tb.scope_sql(True) + ", ins AS (SELECT i.*, scope, breadth FROM item i JOIN scope USING (domain)), newest AS (SELECT scope, max(cts) AS newest FROM ins GROUP BY scope)"


def every_scope(spark):
    return tb.scopes(spark, True)


@query("AGG-16", oracle("SELECT scope, source, count(*) AS n FROM ins JOIN newest USING (scope) WHERE cts >= newest - INTERVAL 7 DAY GROUP BY ALL", extra=_FRESH))
def fresh_inflow(spark, d):
    rows = tb.opportunities(spark, d).select("domain", "source", dates.parsed(c("created_at")).alias("at")).where("at is not null")
    return tr.fresh_inflow(rows, every_scope(spark), "at")


_KPI = tb.scope_sql(True) + ", fs AS (SELECT f.*, scope FROM feat f JOIN scope USING (domain))"


@query("AGG-17", oracle("""SELECT scope, CAST(sum(CASE WHEN source = 'github' THEN 1 ELSE 0 END) AS BIGINT) AS open_issues,
  CAST(round_even(100e0 * sum(CASE WHEN effort_min < 60 THEN 1 ELSE 0 END) / count(*), 0) AS BIGINT) AS quick_pct,
  CAST(floor(list_sort(list(effort_min))[CAST(count(*) // 2 AS INTEGER) + 1]) AS BIGINT) AS middle_effort,
  CAST(sum(CASE WHEN source = 'github' AND standout >= 0.55e0 THEN 1 ELSE 0 END) AS BIGINT) AS standout FROM fs GROUP BY scope""", feat=True, extra=_KPI))
def contribute_kpis(spark, d):
    return contribute_numbers(featured(spark, d), every_scope(spark))


def contribute_numbers(rows, scopes):
    github = c("source") == "github"
    # Counted per domain and effort first; scopes only meet these counts.
    per = checkpointed(rows.groupBy("domain", "effort_min").agg(N().alias("n"), F.count_if(github).alias("open"), F.count_if(github & (c("standout") >= 0.55)).alias("good")))
    in_scopes = tr.scoped(per, scopes)
    k = in_scopes.groupBy("scope").agg(F.sum("open").alias("open_issues"), F.bround(100.0 * F.sum(F.when(c("effort_min") < 60, c("n")).otherwise(0)) / F.sum("n"), 0).cast("bigint").alias("quick_pct"),
                                       F.sum("good").alias("standout"))
    middle = ordered.value_at(ordered.value_positions(in_scopes, ["scope"], "effort_min", "n"), ["scope"], "effort_min", F.floor(c("total") / 2), "middle")
    return k.join(middle, "scope").select("scope", "open_issues", "quick_pct", F.floor("middle").alias("middle_effort"), "standout")


@query("AGG-18", oracle("""SELECT k.scope, conversations, total_engagement, spot AS top_community FROM
  (SELECT scope, CAST(sum(CASE WHEN source IN ('reddit', 'bluesky', 'hackernews') AND engagement >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS conversations,
   CAST(sum(engagement) AS BIGINT) AS total_engagement FROM ins GROUP BY scope) k JOIN
  (SELECT scope, spot, row_number() OVER (PARTITION BY scope ORDER BY sum(engagement) DESC, count(*) DESC, spot) AS rn FROM ins WHERE spot IS NOT NULL GROUP BY scope, spot) t
  ON k.scope = t.scope AND rn = 1""", extra=_FRESH))
def discuss_kpis(spark, d):
    return discuss_numbers(act(spark, d), every_scope(spark))


def discuss_numbers(rows, scopes):
    talk = c("source").isin("reddit", "bluesky", "hackernews") & (c("engagement") >= 10)
    per = checkpointed(rows.groupBy("domain", "community").agg(F.count_if(talk).alias("talks"), F.sum("engagement").alias("e"), N().alias("v")))
    in_scopes = tr.scoped(per, scopes)
    k = in_scopes.groupBy("scope").agg(F.sum("talks").alias("conversations"), F.sum("e").alias("total_engagement"))
    places = in_scopes.where("community is not null").groupBy("scope", "community").agg(F.sum("e").alias("e"), F.sum("v").alias("v"))
    best = tr.top_n(places, ["scope"], [F.desc("e"), F.desc("v"), c("community")], 1)
    return k.join(best, "scope").select("scope", "conversations", "total_engagement", c("community").alias("top_community"))


_GRID = """, wk AS (SELECT domain, week, count(*) AS n FROM item WHERE week IS NOT NULL GROUP BY domain, week),
allw AS (SELECT week, CAST(sum(n) AS BIGINT) AS total, week + 6 <= (SELECT max(cts)::DATE FROM item) AS complete FROM wk GROUP BY week),
axis AS (SELECT week, total FROM allw WHERE complete OR NOT (SELECT bool_or(complete) FROM allw)),
grid AS (SELECT dm.domain, a.week, COALESCE(w.n, 0) AS n, a.total, COALESCE(w.n, 0)::DOUBLE / a.total AS share
  FROM (SELECT DISTINCT domain FROM wk) dm CROSS JOIN axis a LEFT JOIN wk w ON w.domain = dm.domain AND w.week = a.week)"""
_EGRID = """wk AS (SELECT event_type AS domain, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY ALL),
allw AS (SELECT week, CAST(sum(n) AS BIGINT) AS total, week + 6 <= (SELECT max(ts)::DATE FROM events) AS complete FROM wk GROUP BY week),
axis AS (SELECT week, total FROM allw WHERE complete OR NOT (SELECT bool_or(complete) FROM allw)),
grid AS (SELECT dm.domain, a.week, COALESCE(w.n, 0) AS n, a.total, COALESCE(w.n, 0)::DOUBLE / a.total AS share
  FROM (SELECT DISTINCT domain FROM wk) dm CROSS JOIN axis a LEFT JOIN wk w ON w.domain = dm.domain AND w.week = a.week)"""
MOM = f""", mom AS (SELECT domain, strftime(week, '%Y-%m-%d') AS last_week, n AS last, prev, {r_sql('share * 100', 1)} AS share_last, {r_sql('ps * 100', 1)} AS share_prev,
  {r_sql('(share - ps) * 100', 2)} AS delta_pp, CASE WHEN ps = 0 THEN 0e0 ELSE {r_sql('(share - ps) / ps * 100', 1)} END AS delta_pct,
  CASE WHEN ps = 0 THEN 1e0 ELSE {r_sql('share / ps', 2)} END AS momentum, CASE WHEN mean = 0 THEN 1e0 ELSE {r_sql('(recent / 3) / mean', 2)} END AS rising_score FROM
  (SELECT *, lag(share, 1, 0e0) OVER w AS ps, lag(n, 1, 0) OVER w AS prev, sum(share) OVER (PARTITION BY domain ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
   avg(share) OVER (PARTITION BY domain) AS mean, lead(week) OVER w AS later FROM grid WINDOW w AS (PARTITION BY domain ORDER BY week)) t WHERE later IS NULL)"""


def event_weekly(spark, d):
    return tr.weekly_counts(event_activity(spark, d))


def doc_weekly(spark, d):
    return tr.weekly_counts(act(spark, d))


def text_week(df, name="week"):
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd"))


@query("AGG-19", oracle("""SELECT s.scope, up, breakout, fresh FROM
  (SELECT scope, CAST(sum(CASE WHEN delta_pp > 0.1e0 THEN 1 ELSE 0 END) AS BIGINT) AS up FROM mom JOIN (SELECT * FROM scope WHERE domain <> '') q USING (domain) GROUP BY scope) s
  JOIN (SELECT scope, CAST(sum(CASE WHEN velocity >= 0.6e0 AND engagement >= 8 THEN 1 ELSE 0 END) AS BIGINT) AS breakout,
   CAST(sum(CASE WHEN cts >= newest - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS BIGINT) AS fresh
   FROM (SELECT fs.*, newest FROM fs JOIN (SELECT scope, max(cts) AS newest FROM fs GROUP BY scope) nw USING (scope)) z GROUP BY scope) b USING (scope)""", feat=True, extra=_KPI + _GRID + MOM))
def monitor_kpis(spark, d):
    up = tr.scoped(tr.momentum(tr.share_grid(doc_weekly(spark, d))), tb.scopes(spark)).groupBy("scope").agg(F.count_if(c("delta_pp") > 0.1).alias("up"))
    rows = checkpointed(featured(spark, d).select("domain", "source", "velocity", dates.parsed(c("created_at")).alias("at"), nm.engagement(c("score"), c("num_comments")).alias("engagement")))
    k = breakouts(rows, every_scope(spark))
    fresh = tr.fresh_inflow(rows, every_scope(spark), "at").groupBy("scope").agg(F.sum("n").alias("fresh"))
    return up.join(k, "scope").join(fresh, "scope")


def breakouts(rows, scopes):
    per = rows.groupBy("domain").agg(F.count_if((c("velocity") >= 0.6) & (c("engagement") >= 8)).alias("breakout"))
    return tr.scoped(per, scopes).groupBy("scope").agg(F.sum("breakout").alias("breakout"))


@query("AGG-20", oracle("SELECT source, " + ", ".join(f"CAST(floor(avg({x}) * 1e8 + 0.5) AS BIGINT) AS {x}" for x in
                        ("popularity", "discussion", "velocity", "recency", "community_health", "visibility", "effort_min")) + " FROM feat GROUP BY source", feat=True))
def mean_signals(spark, d):
    o = tb.opportunities(spark, d)
    m = ft.mean_signals_by_source(o, ft.feature_table(o, tb.as_of()))
    return m.select("source", *[F.floor(c(x) * 1e8 + 0.5).alias(x) for x in m.columns if x != "source"])


_TAGS = """, tg AS (SELECT domain, lower(trim(t)) AS tag, count(*) AS n FROM (SELECT domain, unnest(tag_list) AS t FROM opp) q WHERE trim(t) <> '' GROUP BY ALL),
ts AS (SELECT t.domain, t.tag, t.n, g.anywhere, z.size FROM tg t JOIN (SELECT tag, CAST(sum(n) AS BIGINT) AS anywhere FROM tg GROUP BY tag) g USING (tag)
  JOIN (SELECT domain, count(*) AS size FROM opp GROUP BY domain) z USING (domain))"""


@query("AGG-21", oracle("SELECT domain, tag, n, anywhere, size FROM ts", extra=_TAGS))
def tag_statistics(spark, d):
    return tr.tag_counts(items(spark, d))


@query("AGG-24", oracle("SELECT source, CAST(sum(CASE WHEN len(domain_list) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi, CAST(sum(CASE WHEN domain = '' THEN 1 ELSE 0 END) AS BIGINT) AS unlabeled FROM opp GROUP BY source"))
def multi_label(spark, d):
    return items(spark, d).groupBy("source").agg(F.count_if(F.size("domain_list") > 1).alias("multi"), F.count_if(c("domain") == "").alias("unlabeled"))


@query("AGG-26", oracle("SELECT source, count(*) AS covered FROM opp WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source"))
def coverage(spark, d):
    done = tb.table(spark, d, "labels").selectExpr("doc_id as ingest_seq")
    return tb.opportunities(spark, d).join(done, "ingest_seq", "left_semi").groupBy("source").agg(N().alias("covered"))


@query("AGG-27", oracle("SELECT count(*) AS total, count(DISTINCT week) AS weeks_total, count(DISTINCT CASE WHEN domain <> '' THEN domain END) AS domains_present, min(created_at) AS first_text, max(created_at) AS last_text FROM item"))
def corpus_rollup(spark, d):
    # Small per-(domain, week) groups first, then one final row: no wide distinct over the rows.
    g = act(spark, d).groupBy("domain", "week").agg(N().alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    return g.agg(F.sum("n").alias("total"), F.countDistinct("week").alias("weeks_total"),
                 F.countDistinct(F.nullif("domain", F.lit(""))).alias("domains_present"), F.min("lo").alias("first_text"), F.max("hi").alias("last_text"))


# ---- windows -----------------------------------------------------------------------------
@query("WIN-01", "WITH " + _EGRID + f"""SELECT domain, strftime(week, '%Y-%m-%d') AS week, n, {Q6.format('share')} AS share_micro, {r_sql('(share - lag(share) OVER (PARTITION BY domain ORDER BY week)) * 100', 2)} AS delta_pp
  FROM (SELECT domain, week, n, n::DOUBLE / sum(n) OVER (PARTITION BY week) AS share FROM wk) t""")
def share_momentum(spark, d):
    m = tr.simple_momentum(event_weekly(spark, d))
    return text_week(m).select("domain", "week", "n", micro(c("share")).alias("share_micro"), "delta_pp")


_MOMC = "domain, last_week, last, prev, share_last, share_prev, delta_pp, delta_pct, momentum"


@query("WIN-02", "WITH " + _EGRID + MOM + f" SELECT {_MOMC} FROM mom")
def dense_momentum(spark, d):
    return text_week(tr.momentum(tr.share_grid(event_weekly(spark, d))), "last_week").select(*_MOMC.split(", "))


@query("WIN-03", "WITH " + _EGRID + MOM + " SELECT domain, rising_score FROM mom")
def rising_score(spark, d):
    return tr.momentum(tr.share_grid(event_weekly(spark, d))).select("domain", "rising_score")


@query("WIN-04", "WITH " + _EGRID + " SELECT strftime(week, '%Y-%m-%d') AS week, total FROM axis")
def complete_weeks(spark, d):
    return text_week(tr.week_axis(event_weekly(spark, d)))


@query("WIN-05", oracle("SELECT opportunity_id, " + ", ".join(f"{Q6.format(x + '_pct')} AS {x}" for x in ft.RAW) + " FROM pct", feat=True))
def percentiles(spark, d):
    p = ft.source_percentiles(ft.with_raw_signals(items(spark, d), tb.as_of()))
    return p.select("opportunity_id", *[micro(c(f"{x}_pct")).alias(x) for x in ft.RAW])


@query("WIN-07", oracle("""SELECT domain, strftime(week, '%Y-%m-%d') AS week, n, CAST(2 * avg(n) OVER (PARTITION BY domain ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS smooth2 FROM
  (SELECT t.domain, a.week, COALESCE(w.n, 0) AS n FROM (SELECT domain FROM wk WHERE domain <> '' GROUP BY domain ORDER BY sum(n) DESC, domain LIMIT 6) t
   CROSS JOIN (SELECT DISTINCT week FROM wk WHERE week >= DATE '2026-01-01' AND domain IN (SELECT domain FROM wk WHERE domain <> '' GROUP BY domain ORDER BY sum(n) DESC, domain LIMIT 6)) a
   LEFT JOIN wk w ON w.domain = t.domain AND w.week = a.week) q""", extra=_GRID))
def rolling_mean(spark, d):
    return text_week(tr.rolling_mean(doc_weekly(spark, d), "2026-01-01")).select("domain", "week", "n", (c("smooth") * 2).cast("bigint").alias("smooth2"))


_SERIES = """, sc AS (SELECT scope, g.domain, week, n, sum(n) OVER (PARTITION BY scope, week) AS total FROM grid g JOIN scope USING (domain)),
big AS (SELECT scope, domain, row_number() OVER (PARTITION BY scope ORDER BY cnt DESC, domain) AS rk FROM (SELECT scope, o.domain, count(*) AS cnt FROM opp o JOIN scope USING (domain) GROUP BY ALL) z)"""


@query("WIN-08", oracle(f"SELECT scope, domain, strftime(week, '%Y-%m-%d') AS week, n, CASE WHEN total = 0 THEN 0e0 ELSE {r_sql('n::DOUBLE / total * 100', 1)} END AS share FROM sc JOIN big USING (scope, domain) WHERE rk <= 5", extra=_GRID + tb.scope_sql() + _SERIES))
def scope_series(spark, d):
    return text_week(scope_share_series(spark, d))


def scope_share_series(spark, d, n=5):
    a = act(spark, d)
    return share_series(tr.share_grid(tr.weekly_counts(a)), a.groupBy("domain").agg(N().alias("cnt")), tb.scopes(spark), n).drop("rk", "total")


def share_series(grid, sizes, scopes, n=5):
    """The shares of a scope's largest domains in the scope's weeks."""
    grid = tr.scoped(grid.drop("total"), scopes)
    grid = grid.withColumn("total", F.sum("n").over(Window.partitionBy("scope", "week")))
    big = tr.top_n(tr.scoped(sizes, scopes), ["scope"], [F.desc("cnt"), c("domain")], n, "rk").select("scope", "domain", "rk")
    share = F.when(c("total") == 0, 0.0).otherwise(nm.fixed_round(F.try_divide(c("n"), c("total")) * 100, 1))
    return grid.join(big, ["scope", "domain"]).select("scope", "domain", "week", "n", share.alias("share"), "rk", "total")


@query("WIN-10", """SELECT conv_id, arg_max(turn, turn) AS last_turn, arg_max(role, turn) AS last_role, arg_max(length(text), turn) AS last_length,
  arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id""")
def latest_per_key(spark, d):
    t = tb.table(spark, d, "conversations")
    return t.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"),
                                    F.max_by(F.length("text").cast("bigint"), "turn").alias("last_length"), F.min_by("role", "turn").alias("first_role"))


# ---- top-k -------------------------------------------------------------------------------
@query("TOP-03", oracle("SELECT domain, term, n, position FROM top UNION ALL SELECT NULL, term, n, position FROM (SELECT term, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (ORDER BY sum(n) DESC, term) AS position FROM tc GROUP BY term) g WHERE position <= 40", extra=_WORDS + _TOPT))
def top_terms_query(spark, d):
    counts = tr.term_counts(items(spark, d))
    per = tr.top_n(counts, ["domain"], [F.desc("n"), c("term")], 30)
    whole = counts.groupBy("term").agg(F.sum("n").alias("n")).withColumn("domain", F.lit(None).cast("string"))
    return per.unionByName(tr.top_n(whole, ["domain"], [F.desc("n"), c("term")], 40))


_TOPC = ", cm AS (" + _COMM.format("domain") + "), gm AS (" + _COMM.format("source") + "), ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY engagement DESC, volume DESC, community) AS position FROM cm) t WHERE position <= 8)"


def top_communities(spark, d, n=8):
    return top_of_communities(act(spark, d), n)


def top_of_communities(rows, n=8):
    per = tr.community_activity(rows, ["domain", "community"])
    return tr.top_n(per, ["domain"], [F.desc("engagement"), F.desc("volume"), c("community")], n)


@query("TOP-04", oracle("SELECT domain, community, engagement, volume, authors, position FROM ct UNION ALL SELECT NULL, community, engagement, volume, authors, position FROM (SELECT *, row_number() OVER (ORDER BY engagement DESC, volume DESC, community, source) AS position FROM gm) t WHERE position <= 12", extra=_TOPC))
def top_communities_query(spark, d):
    per = top_communities(spark, d)
    order = [F.desc("engagement"), F.desc("volume"), c("community"), c("source")]
    whole = tr.community_activity(act(spark, d), ["community", "source"]).withColumn("domain", F.lit(None).cast("string"))
    return per.unionByName(tr.top_n(whole, ["domain"], order, 12).select(*per.columns))


@query("TOP-05", oracle("""SELECT scope, community, domain, engagement, rank AS position FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY engagement DESC, community) AS rank FROM
  (SELECT scope, ct.domain, community, engagement, row_number() OVER (PARTITION BY scope, community ORDER BY engagement DESC, domain) AS again FROM ct JOIN scope USING (domain)) q WHERE again = 1) z WHERE rank <= 6""", extra=_TOPC + tb.scope_sql()))
def scope_communities(spark, d):
    rows = tr.scoped(top_communities(spark, d).drop("position"), tb.scopes(spark))
    first = tr.top_n(rows, ["scope", "community"], [F.desc("engagement"), c("domain")], 1, "again")
    return tr.top_n(first, ["scope"], [F.desc("engagement"), c("community")], 6).select("scope", "community", "domain", "engagement", "position")


_FLOOR = tb.sql_case("source", lx.RISING_FLOORS, lx.DEFAULT_RISING_FLOOR)


@query("TOP-08", oracle(f"""SELECT scope, opportunity_id, substr(trim(title), 1, 140) AS title, engagement, velocity, position FROM
  (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cut) AS position FROM
  (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY velocity DESC, opportunity_id) AS cut FROM fs) t
  WHERE cut <= 120 AND engagement >= {_FLOOR} AND trim(title) <> '') z WHERE position <= 4""", feat=True, extra=_KPI))
def breakout_items(spark, d):
    o = tb.opportunities(spark, d).drop("body")
    rows = ft.with_velocity(o, tb.as_of()).select("opportunity_id", "title", "source", "domain", "velocity", nm.engagement(c("score"), c("num_comments")).alias("engagement"))
    got = rising(rows.withColumn("titled", F.trim("title") != ""), every_scope(spark))
    return got.select("scope", "opportunity_id", F.substring(F.trim("title"), 1, 140).alias("title"), "engagement", "velocity", "position")


def rising(rows, scopes):
    keep = (c("engagement") >= nm.rising_floor(c("source"))) & c("titled")
    return tr.limit_filter_limit(rows, scopes, [F.desc("velocity"), c("opportunity_id")], 120, keep, 4)


@query("TOP-09", oracle("""SELECT scope, opportunity_id, substr(trim(title), 1, 130) AS title, CAST(floor((epoch_us(newest) - epoch_us(cts)) / 3600e6) AS BIGINT) AS ago_hours, position FROM
  (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cut) AS position FROM
   (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cts DESC, opportunity_id) AS cut FROM ins WHERE cts IS NOT NULL) t JOIN newest USING (scope) WHERE cut <= 60 AND trim(title) <> '') z WHERE position <= 6""", extra=_FRESH))
def freshest_items(spark, d):
    rows = tb.opportunities(spark, d).select("opportunity_id", "title", "domain", dates.parsed(c("created_at")).alias("at")).where("at is not null")
    newest = tr.newest_in_scope(rows, every_scope(spark), "at")
    got = tr.limit_filter_limit(rows, every_scope(spark), [F.desc("at"), c("opportunity_id")], 60, F.trim("title") != "", 6)
    return got.join(newest, "scope").select("scope", "opportunity_id", F.substring(F.trim("title"), 1, 130).alias("title"),
                                            dates.hours_before(c("newest"), c("at")).alias("ago_hours"), "position")


_OWN = "list_concat(regexp_extract_all(lower(lab), '[a-z0-9]+'), [replace(lower(lab), ' ', ''), replace(domain, '_', '')])"
_TOPICS = f""", tps AS (SELECT domain, tag, n, size, anywhere, row_number() OVER (PARTITION BY domain ORDER BY (n::DOUBLE / size) * (n::DOUBLE / (anywhere + 2)) DESC, tag) AS position FROM
  (SELECT *, {tb.sql_case('domain', lx.DOMAIN_LABELS, '')} AS lab FROM ts) t WHERE n >= 4 AND length(tag) BETWEEN 3 AND 20 AND NOT list_contains({tb.sql_list(lx.TOPIC_STOP)}, tag)
  AND NOT regexp_matches(tag, '[&!:/]') AND NOT regexp_matches(tag, '^(missing|level|size|dco|status)') AND NOT regexp_matches(tag, '(-classification|-review|-program)$')
  AND NOT contains(tag, 'news -') AND NOT regexp_matches(tag, '^[0-9]+$') AND NOT list_contains({_OWN}, tag) AND NOT list_contains({_OWN}, replace(replace(tag, ' ', ''), '-', '')))"""


@query("TXT-06", oracle(f"SELECT domain, tag, {Q6.format('(n::DOUBLE / size) * (n::DOUBLE / (anywhere + 2))')} AS score_micro FROM tps", extra=_TAGS + _TOPICS))
def distinctive_score(spark, d):
    t = tr.topic_scores(tr.tag_counts(items(spark, d)))
    return t.select("domain", "tag", micro(c("score")).alias("score_micro"))


@query("TOP-12", oracle("SELECT domain, tag, position FROM tps WHERE position <= 6", extra=_TAGS + _TOPICS))
def subtopics(spark, d):
    return tr.distinctive_topics(tr.tag_counts(items(spark, d))).select("domain", "tag", "position")


@query("TOP-14", "WITH " + tb.OPP + ", " + tb.PROF + """, vol AS (SELECT list(domain ORDER BY n DESC, domain) AS hot FROM (SELECT domain, count(*) AS n FROM opp WHERE domain <> '' GROUP BY domain) v)
  SELECT user_id, array_to_string(CASE WHEN len(pick) = 0 THEN list_slice(doms, 1, 5) ELSE list_slice(pick, 1, 5) END, ',') AS topics FROM
  (SELECT *, list_filter(hot, lambda x: len(doms) = 0 OR list_contains(doms, x)) AS pick FROM pers, vol) t""")
def hot_topics(spark, d):
    sizes = tb.opportunities(spark, d).where("domain <> ''").groupBy("domain").agg(N().alias("n"))
    hot = sizes.agg(F.transform(F.array_sort(F.collect_list(F.struct((-c("n")).alias("k"), "domain"))), lambda s: s.domain))
    p = personas(spark, d).withColumn("hot", hot.scalar())
    pick = F.filter("hot", lambda x: (F.size("domains") == 0) | F.array_contains("domains", x))
    return p.select("user_id", F.array_join(F.slice(F.when(F.size(pick) == 0, c("domains")).otherwise(pick), 1, 5), ",").alias("topics"))


def stratified(rows, key, ident, n, seed=7):
    """A repeatable random sample of up to n rows per key."""
    order = F.md5(F.concat(c(ident).cast("string"), F.lit(f":{seed}")))
    return tr.top_n(rows.withColumn("_draw", order), [key], [c("_draw")], n).drop("_draw")


@query("TOP-16", oracle("SELECT domain, opportunity_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(opportunity_id || ':7')) AS rn FROM opp) t WHERE rn <= 20"))
def sample_per_domain(spark, d):
    return stratified(tb.opportunities(spark, d).select("domain", "opportunity_id"), "domain", "opportunity_id", 20).drop("position")


@query("TOP-19", oracle("SELECT scope, domain, delta_pp, row_number() OVER (PARTITION BY scope ORDER BY delta_pp DESC, domain) AS position FROM mom JOIN scope USING (domain)", extra=_GRID + MOM + tb.scope_sql()))
def top_movers(spark, d):
    m = tr.scoped(tr.momentum(tr.share_grid(doc_weekly(spark, d))), tb.scopes(spark))
    return tr.numbered(m, ["scope"], [F.desc("delta_pp"), c("domain")]).select("scope", "domain", "delta_pp", "position")


@query("TRD-02", oracle("SELECT domain, CASE WHEN delta_pp > 0.1e0 THEN 'up' WHEN delta_pp < -0.1e0 THEN 'down' ELSE 'flat' END AS direction FROM mom", extra=_GRID + MOM))
def direction(spark, d):
    return tr.momentum(tr.share_grid(doc_weekly(spark, d))).select("domain", nm.direction(c("delta_pp")).alias("direction"))


_MOVE = ", cards AS (SELECT scope, breadth, m.domain, " + tb.sql_case('m.domain', lx.DOMAIN_LABELS, '') + " AS label, delta_pp FROM mom m JOIN scope USING (domain))"
NARR = f"""SELECT scope, CASE WHEN riser IS NULL AND cooler IS NULL THEN 'Activity ' || w || ' is steady week over week.' ELSE 'This week ' || w || ', ' || concat_ws(', while ', riser, cooler) || '.' END AS narrative FROM
  (SELECT scope, CASE WHEN breadth THEN 'across all topics' ELSE 'in your space' END AS w,
   max(CASE WHEN delta_pp = hi AND hi > 0.1e0 THEN label || ' is gaining momentum (+' || printf('%.1f', {r_sql('delta_pp', 1)}) || ' share points in the latest week)' END) AS riser,
   max(CASE WHEN delta_pp = lo AND lo < -0.1e0 THEN label || ' is cooling' END) AS cooler FROM
   (SELECT *, max(delta_pp) OVER (PARTITION BY scope) AS hi, min(delta_pp) OVER (PARTITION BY scope) AS lo FROM cards) t GROUP BY scope, breadth) z"""


def cards(spark, d):
    m = tr.scoped(tr.momentum(tr.share_grid(doc_weekly(spark, d))), tb.scopes(spark))
    return m.withColumn("label", tx.domain_label(c("domain"))).withColumn("direction", nm.direction(c("delta_pp")))


@query("TXT-13", oracle(NARR, extra=_GRID + MOM + tb.scope_sql() + _MOVE))
def narrative(spark, d):
    return tr.narrative(cards(spark, d))


@query("TRD-05", oracle("SELECT strftime(week, '%Y-%m-%d') AS week, " + ", ".join(f"CAST(sum(CASE WHEN source = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in lx.SOURCES) + " FROM item WHERE week IS NOT NULL GROUP BY week"))
def pivot_weeks(spark, d):
    p = act(spark, d).where("week is not null").groupBy("week").pivot("source", lx.SOURCES).agg(N()).fillna(0)
    return text_week(p)
