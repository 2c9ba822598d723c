"""Persona trend views and briefs."""
import re

from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import dates
from beaconlake.operators import encode as en, features as ft, feedback as fb, ranking as rk, rollup as ru, sketches as sk, trends as tr, vectors as vx
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.plans import q_ranking as qr, q_state as qs, q_trends as qt, testbed as tb
from beaconlake.plans.q_columns import items
from beaconlake.plans.q_vectors import corpus
from beaconlake.plans.registry import query
from beaconlake.plans.testbed import oracle
from beaconlake.session import checkpointed, scratch_path

c = F.col
_DC = """, dv AS (SELECT o.domain, generate_subscripts(e.embedding, 1) AS pos, unnest(e.embedding::DOUBLE[]) AS x FROM embeddings e JOIN opp o ON o.doc_id = e.vec_id WHERE o.domain <> ''),
dm AS (SELECT domain, pos, avg(x) AS m FROM dv GROUP BY ALL), dn AS (SELECT domain, sqrt(sum(m * m)) + 1e-9 AS nrm FROM dm GROUP BY domain), dc AS (SELECT domain, pos, m / nrm AS v FROM dm JOIN dn USING (domain)),
ds AS (SELECT a.domain, b.domain AS other, sum(a.v * b.v) AS sim FROM dc a JOIN dc b ON a.pos = b.pos AND a.domain <> b.domain GROUP BY ALL),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY floor(sim * 1e9) DESC, other) AS p FROM ds) t WHERE p <= 3)"""


def domain_similarity(spark, d):
    """(domain, other, sim) from the centroids of the domains' items."""
    o = tb.opportunities(spark, d).where("domain <> ''").select(c("ingest_seq").alias("id"), "domain")
    return vx.centroid_similarity(vx.centroids(corpus(spark, d).join(o, "id"), "domain", "vec"), "domain")


def related(spark, d):
    """The three nearest domains of each domain."""
    return tr.top_n(domain_similarity(spark, d), ["domain"], [F.desc(F.floor(c("sim") * 1e9)), c("other")], 3).drop("position")


@query("TOP-07", oracle("""SELECT scope, other, position FROM (SELECT scope, other, row_number() OVER (PARTITION BY scope ORDER BY floor(max(sim) * 1e9) DESC, other) AS position FROM dr JOIN scope s USING (domain)
  WHERE NOT breadth AND NOT EXISTS (SELECT 1 FROM scope z WHERE z.scope = s.scope AND z.domain = dr.other) GROUP BY scope, other) t WHERE position <= 4""", extra=tb.scope_sql() + _DC))
def outside_related(spark, d):
    r = related(spark, d).withColumn("sim", F.floor(c("sim") * 1e9))
    return ru.outside_related(r, tb.scopes(spark)).select("scope", "other", "position")


def facts(spark, d):
    """What the view needs of every item, stored once: no texts."""
    o = tb.opportunities(spark, d)
    f = ft.feature_table(o, tb.as_of()).select("opportunity_id", "velocity", "effort_min", "standout")
    rows = tr.activity(o).join(f, "opportunity_id")
    more = o.select("opportunity_id", (F.trim("title") != "").alias("titled"), dates.parsed(c("created_at")).alias("at"))
    return checkpointed(rows.join(more, "opportunity_id"))


def view(spark, d):
    """The whole trend view of every scope as one row."""
    scopes, every = tb.scopes(spark), tb.scopes(spark, True)
    rows = facts(spark, d)
    # One pass each over rows and terms; everything after works on per-domain summaries.
    grid = checkpointed(tr.share_grid(tr.weekly_counts(rows)))
    sizes = checkpointed(rows.groupBy("domain").agg(qt.N().alias("cnt"), F.countDistinct("author").alias("authors")))
    counts = checkpointed(tr.term_counts(items(spark, d)))
    near = checkpointed(related(spark, d))
    topics = tr.distinctive_topics(tr.tag_counts(items(spark, d)))
    topics = checkpointed(topics.groupBy("domain").agg(ru.ordered_list(c("tag"), c("position")).alias("topics")))
    words = tr.top_n(counts, ["domain"], [F.desc("n"), c("term")], 6).groupBy("domain").agg(ru.ordered_list(c("term"), c("position")).alias("top_terms"))
    cards = tr.scoped(tr.momentum(grid), scopes).withColumns({"label": qt.tx.domain_label(c("domain")), "direction": qt.nm.direction(c("delta_pp"))})
    inside = tr.scoped(near, scopes).join(scopes.select("scope", c("domain").alias("other")), ["scope", "other"])
    links = inside.groupBy("scope", "domain").agg(ru.ordered_list(F.struct("other", "sim"), -F.floor(c("sim") * 1e9), c("other")).alias("links"))
    cards = checkpointed(cards.join(sizes, "domain", "left").join(words, "domain", "left").join(topics, "domain", "left").join(links, ["scope", "domain"], "left"))
    mover = cards.groupBy("scope").agg(F.max_by(F.struct("domain", "label", "delta_pp", "direction"), F.struct("delta_pp", F.transform(F.split("domain", ""), lambda x: -F.ascii(x)))).alias("mover"))
    terms = ru.merged_terms(counts, scopes)
    best_terms = tr.top_n(terms, ["scope"], [F.desc("n"), c("term")], 14)
    places = checkpointed(ru.merged_communities(qt.top_of_communities(rows).drop("position"), scopes).withColumn("label", qt.tx.domain_label(c("domain"))))
    series = checkpointed(qt.share_series(grid, sizes, scopes))
    weeks = tr.scoped(grid.select("domain", "week", "n"), scopes).groupBy("scope", "week").agg(F.sum("n").alias("total"))
    lines = series.groupBy("scope", "domain", "rk").agg(ru.ordered_list(F.struct("week", "n", "share"), c("week")).alias("points"))
    outside = ru.outside_related(near, scopes).join(topics.withColumnRenamed("domain", "other"), "other", "left")
    risers = qt.rising(rows.select("opportunity_id", "source", "domain", "velocity", "engagement", "titled"), every)
    dated = rows.where("at is not null").select("opportunity_id", "source", "domain", "titled", "at", "engagement")
    newest = tr.newest_in_scope(dated, every, "at")
    freshest = tr.limit_filter_limit(dated, every, [F.desc("at"), c("opportunity_id")], 60, c("titled"), 6).join(newest, "scope")
    named = checkpointed(risers.select("opportunity_id").unionByName(freshest.select("opportunity_id")).distinct())
    titles = tb.opportunities(spark, d).join(broadcast_if_small(named), "opportunity_id", "left_semi").select("opportunity_id", F.trim("title").alias("title"), "url")
    titles = checkpointed(titles.withColumn("title", F.substring("title", 1, 140)))
    risers, freshest = (x.join(titles, "opportunity_id") for x in (risers, freshest))
    inflow = checkpointed(tr.fresh_inflow(dated, every, "at"))
    voices = rows.where("author is not null").select("domain", "author").distinct()
    reach = tr.scoped(voices, every).groupBy("scope").agg(F.countDistinct("author").alias("reach"))
    guess = sk.merged_reach(tr.scoped(sk.reach_sketches(rows, ["domain"]), every), ["scope"]).select("scope", c("reach").alias("reach_estimate"))
    modes = spark.createDataFrame(list(tb.PERSONA_MODES.items()), "scope string, mode string")
    numbers = (modes.join(scopes.groupBy("scope", "breadth").agg(qt.N().alias("n_domains")), "scope")
               .join(tr.scoped(sizes.select("domain", "cnt"), scopes).groupBy("scope").agg(F.sum("cnt").alias("opportunities"), qt.N().alias("domains_active")), "scope")
               .join(reach, "scope").join(guess, "scope").join(mover, "scope", "left")
               .join(cards.groupBy("scope").agg(qt.N().alias("n_cards"), F.count_if(c("direction") == "up").alias("up")), "scope", "left")
               .join(terms.groupBy("scope").agg(qt.N().alias("trending_terms")), "scope", "left")
               .join(places.where("position = 1").select("scope", F.struct("community", "engagement", "authors").alias("best")), "scope", "left")
               .join(qt.contribute_numbers(rows, every), "scope", "left").join(qt.discuss_numbers(rows, every).drop("top_community"), "scope", "left")
               .join(qt.breakouts(rows, every), "scope", "left").join(inflow.groupBy("scope").agg(F.sum("n").alias("fresh")), "scope", "left"))
    numbers = checkpointed(numbers)
    lists = ru.assembled({
        "cards": (cards, F.struct("domain", "label", "cnt", "authors", "share_last", "delta_pp", "momentum", "rising_score", "direction", "top_terms", "topics", "links"), [-c("delta_pp"), c("domain")]),
        "terms": (best_terms, F.struct("term", "n"), [c("position")]),
        "communities": (places, F.struct("community", "label", "volume", "engagement", "authors"), [c("position")]),
        "weeks": (weeks, F.struct("week", "total"), [c("week")]),
        "series": (lines, F.struct("domain", "points"), [c("rk")]),
        "related": (outside, F.struct(c("other").alias("domain"), "sim", "topics"), [c("position")]),
        "rising": (risers, F.struct("opportunity_id", "title", "url", "source", "engagement", "velocity"), [c("position")]),
        "fresh_sources": (inflow, F.struct("source", "n"), [-c("n"), c("source")]),
        "fresh_items": (freshest, F.struct("opportunity_id", "title", "url", "source", dates.hours_before(c("newest"), c("at")).alias("ago_hours")), [c("position")]),
        "kpi_cards": (ru.kpi_cards(numbers), c("card"), [c("place")])})
    return numbers.join(lists, "scope", "left").join(tr.narrative(cards), "scope", "left")


_VIEW = qt._GRID + qt.MOM + tb.scope_sql() + tb.scope_sql(True).replace("scope AS", "scopeb AS", 1) + qt._MOVE + qt._WORDS + qt._TOPC + qt._TOPT + qt._TAGS + qt._TOPICS + qt._SERIES + _DC + f""", nar AS ({qt.NARR}),
tsum AS (SELECT scope, term, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY scope ORDER BY sum(n) DESC, term) AS p FROM tc JOIN scope USING (domain) GROUP BY scope, term),
dsz AS (SELECT domain, count(*) AS cnt, count(DISTINCT voice) AS authors FROM item GROUP BY domain),
t6 AS (SELECT domain, string_agg(term, ',' ORDER BY position) AS words FROM top WHERE position <= 6 GROUP BY domain),
tpc AS (SELECT domain, string_agg(tag, ',' ORDER BY position) AS topics FROM tps WHERE position <= 6 GROUP BY domain),
lk AS (SELECT s.scope, dr.domain, string_agg(dr.other || '~' || CAST(floor(sim * 1e3 + 0.5) AS BIGINT), ',' ORDER BY p) AS links FROM dr JOIN scope s USING (domain) JOIN scope z ON z.scope = s.scope AND z.domain = dr.other GROUP BY ALL),
dirs AS (SELECT c.*, share_last, momentum, rising_score, cnt, authors, words, topics, links, CASE WHEN c.delta_pp > 0.1e0 THEN 'up' WHEN c.delta_pp < -0.1e0 THEN 'down' ELSE 'flat' END AS direction,
  row_number() OVER (PARTITION BY c.scope ORDER BY c.delta_pp DESC, c.domain) AS p FROM cards c JOIN mom m USING (domain) LEFT JOIN dsz USING (domain) LEFT JOIN t6 USING (domain) LEFT JOIN tpc USING (domain) LEFT JOIN lk ON lk.scope = c.scope AND lk.domain = c.domain),
pls AS (SELECT *, {tb.sql_case('domain', lx.DOMAIN_LABELS, '')} AS label, row_number() OVER (PARTITION BY scope ORDER BY engagement DESC, community) AS p FROM
  (SELECT scope, ct.domain, community, engagement, volume, authors, row_number() OVER (PARTITION BY scope, community ORDER BY engagement DESC, domain) AS again FROM ct JOIN scope USING (domain)) q WHERE again = 1),
wks AS (SELECT scope, string_agg(strftime(week, '%Y-%m-%d') || ':' || n, ' ' ORDER BY week) AS weeks FROM (SELECT scope, week, CAST(sum(n) AS BIGINT) AS n FROM sc GROUP BY ALL) q GROUP BY scope),
srs AS (SELECT scope, string_agg(line, ' ' ORDER BY rk) AS series FROM (SELECT scope, rk, domain || '=' || string_agg(n || ':' || printf('%.1f', CASE WHEN total = 0 THEN 0e0 ELSE {tb.r_sql('n::DOUBLE / total * 100', 1)} END), ',' ORDER BY week) AS line
  FROM sc JOIN big USING (scope, domain) WHERE rk <= 5 GROUP BY scope, rk, domain) q GROUP BY scope),
fs AS (SELECT f.*, scope FROM feat f JOIN scopeb USING (domain)), nws AS (SELECT scope, max(cts) AS newest FROM fs GROUP BY scope),
rel AS (SELECT scope, string_agg(other || ':' || CAST(floor(s * 1e3 + 0.5) AS BIGINT) || ':' || COALESCE(topics, ''), ' ' ORDER BY position) AS related FROM
  (SELECT scope, other, max(sim) AS s, row_number() OVER (PARTITION BY scope ORDER BY floor(max(sim) * 1e9) DESC, other) AS position FROM dr JOIN scope s USING (domain)
   WHERE NOT breadth AND NOT EXISTS (SELECT 1 FROM scope z WHERE z.scope = s.scope AND z.domain = dr.other) GROUP BY scope, other) q LEFT JOIN tpc ON tpc.domain = other WHERE position <= 4 GROUP BY scope),
rsn AS (SELECT scope, string_agg(opportunity_id || ':' || engagement || ':' || substr(trim(title), 1, 140), ' | ' ORDER BY position) AS rising FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cut) AS position FROM
  (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY velocity DESC, opportunity_id) AS cut FROM fs) t WHERE cut <= 120 AND engagement >= {qt._FLOOR} AND trim(title) <> '') z WHERE position <= 4 GROUP BY scope),
fsr AS (SELECT scope, CAST(sum(n) AS BIGINT) AS fresh, string_agg(source || ':' || n, ' ' ORDER BY n DESC, source) AS fresh_sources FROM (SELECT scope, source, count(*) AS n FROM fs JOIN nws USING (scope) WHERE cts >= newest - INTERVAL 7 DAY GROUP BY ALL) q GROUP BY scope),
fit AS (SELECT scope, string_agg(opportunity_id || ':' || CAST(floor((epoch_us(newest) - epoch_us(cts)) / 3600e6) AS BIGINT) || ':' || substr(trim(title), 1, 140), ' | ' ORDER BY position) AS fresh_items FROM
  (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cut) AS position FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cts DESC, opportunity_id) AS cut FROM fs WHERE cts IS NOT NULL) t JOIN nws USING (scope)
   WHERE cut <= 60 AND trim(title) <> '') z WHERE position <= 6 GROUP BY scope),
num AS (SELECT scope, count(DISTINCT voice) AS reach, CAST(sum(CASE WHEN source = 'github' THEN 1 ELSE 0 END) AS BIGINT) AS open_issues,
  CAST(round_even(100e0 * sum(CASE WHEN effort_min < 60 THEN 1 ELSE 0 END) / count(*), 0) AS BIGINT) AS quick_pct, CAST(floor(list_sort(list(effort_min))[CAST(count(*) // 2 AS INTEGER) + 1]) AS BIGINT) AS middle_effort,
  CAST(sum(CASE WHEN source = 'github' AND standout >= 0.55e0 THEN 1 ELSE 0 END) AS BIGINT) AS standout,
  CAST(sum(CASE WHEN source IN ('reddit', 'bluesky', 'hackernews') AND engagement >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS conversations, CAST(sum(engagement) AS BIGINT) AS total_engagement,
  CAST(sum(CASE WHEN velocity >= 0.6e0 AND engagement >= 8 THEN 1 ELSE 0 END) AS BIGINT) AS breakout FROM fs GROUP BY scope),
crd AS (SELECT scope, count(*) AS n_cards, count(*) FILTER (direction = 'up') AS up FROM dirs GROUP BY scope),
sco AS (SELECT scope, breadth, count(*) AS n_domains FROM scope GROUP BY ALL),
md AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{m}')" for s, m in tb.PERSONA_MODES.items())}) t(scope, mode)),
kp AS (SELECT *, format('{{:,}}', reach) AS reach_text FROM md JOIN sco USING (scope) JOIN num USING (scope) JOIN crd USING (scope) LEFT JOIN fsr USING (scope)
  LEFT JOIN (SELECT scope, label AS m_label, delta_pp AS m_delta, direction AS m_direction, domain AS m_domain FROM dirs WHERE p = 1) USING (scope)
  LEFT JOIN (SELECT scope, community AS b_name, engagement AS b_eng, authors AS b_authors FROM pls WHERE p = 1) USING (scope)),
kpc AS (SELECT scope, concat_ws(' ; ', reach_text || '|People active in your space|' || CASE WHEN breadth THEN 'across all topics' ELSE 'across your ' || n_domains || ' domains' END || '|',
  m_label || '|' || CASE WHEN m_direction = 'up' THEN 'Heating up fastest' ELSE 'Biggest mover this week' END || '|' || CASE WHEN m_delta > 0 THEN '+' ELSE '' END || printf('%.1f', {tb.r_sql('m_delta', 1)}) || ' share points this week|' || m_direction,
  CASE WHEN mode = 'contribute' THEN format('{{:,}}', open_issues) || '|Open issues you could take|the directly contributable work| ; ' || quick_pct || '%|Are quick wins, under an hour|median effort about ' || middle_effort || ' min| ; '
    || format('{{:,}}', standout) || '|Repos with room to be seen|high activity, few contributors|'
   WHEN mode IN ('discuss', 'promote') THEN format('{{:,}}', conversations) || '|Conversations you could join|live threads with real traction| ; ' || format('{{:,}}', total_engagement) || '|Total engagement in your space|comments + score, all sources| ; '
    || COALESCE(b_name, '-') || '|Most active community|' || COALESCE(format('{{:,}}', b_eng) || ' engagement, ' || format('{{:,}}', b_authors) || ' voices', 'no community signal') || '|'
   ELSE up || '|Topics gaining steam|of your ' || CASE WHEN breadth THEN n_cards ELSE n_domains END || ' domains| ; ' || format('{{:,}}', breakout) || '|Breakout items right now|accelerating fastest| ; ' || format('{{:,}}', fresh) || '|New this week|in the last 7 days|' END) AS kpi_cards FROM kp)"""
_CARD = "concat_ws(':', domain, cnt, authors, printf('%.1f', share_last), printf('%.2f', delta_pp), printf('%.2f', momentum), printf('%.2f', rising_score), direction, COALESCE(words, ''), COALESCE(topics, ''), COALESCE(links, ''))"
_LISTS = """(SELECT scope, string_agg(domain || ':' || printf('%.2f', delta_pp) || ':' || direction, ' ' ORDER BY p) AS cards FROM dirs WHERE p <= {n} GROUP BY scope)"""


def card_text(cards):
    return F.array_join(F.transform(cards, lambda x: F.concat_ws(":", x.domain, F.format_string("%.2f", x.delta_pp), x.direction)), " ")


def lines(name, text, between=" "):
    """A list of structs as one text."""
    return F.array_join(F.transform(name, text), between)


def whole_card(x):
    two, several = (lambda v: F.format_string("%.2f", v)), (lambda v: F.coalesce(F.array_join(v, ","), F.lit("")))
    links = F.coalesce(F.array_join(F.transform(x.links, lambda y: F.concat(y.other, F.lit("~"), F.floor(y.sim * 1e3 + 0.5).cast("string"))), ","), F.lit(""))
    return F.concat_ws(":", x.domain, x.cnt.cast("string"), x.authors.cast("string"), F.format_string("%.1f", x.share_last), two(x.delta_pp), two(x.momentum), two(x.rising_score),
                       x.direction, several(x.top_terms), several(x.topics), links)


@query("TRD-01", oracle(f"""SELECT s.scope, opportunities, domains_active, reach, true AS reach_ok, trending_terms, m_domain AS top_mover, cards, terms, communities, weeks, series, related, rising, fresh, fresh_sources, fresh_items, kpi_cards, narrative FROM
  (SELECT scope, count(*) AS opportunities, count(DISTINCT domain) AS domains_active FROM opp JOIN scope USING (domain) GROUP BY scope) s JOIN kp USING (scope)
  JOIN (SELECT scope, string_agg({_CARD}, ' ' ORDER BY p) AS cards FROM dirs GROUP BY scope) c USING (scope)
  JOIN (SELECT scope, count(*) AS trending_terms, string_agg(term || ':' || n, ' ' ORDER BY p) FILTER (p <= 14) AS terms FROM tsum GROUP BY scope) t USING (scope)
  JOIN (SELECT scope, string_agg(concat_ws(':', community, label, volume, engagement, authors), ' ' ORDER BY p) AS communities FROM pls WHERE p <= 6 GROUP BY scope) k USING (scope)
  LEFT JOIN wks USING (scope) LEFT JOIN srs USING (scope) LEFT JOIN rel USING (scope) LEFT JOIN rsn USING (scope) LEFT JOIN fit USING (scope) JOIN kpc USING (scope) JOIN nar USING (scope)""", feat=True, extra=_VIEW))
def persona_trends(spark, d):
    v = view(spark, d)
    words = lambda x: F.coalesce(F.array_join(x, ","), F.lit(""))
    none = lambda name, text: F.when(F.size(name) > 0, text).alias(name)
    return v.select(
        "scope", "opportunities", "domains_active", "reach", qt.near(c("reach_estimate"), c("reach")).alias("reach_ok"), "trending_terms", c("mover.domain").alias("top_mover"),
        lines("cards", whole_card).alias("cards"), lines("terms", lambda x: F.concat(x.term, F.lit(":"), x.n.cast("string"))).alias("terms"),
        lines("communities", lambda x: F.concat_ws(":", x.community, x.label, x.volume.cast("string"), x.engagement.cast("string"), x.authors.cast("string"))).alias("communities"),
        lines("weeks", lambda x: F.concat_ws(":", F.date_format(x.week, "yyyy-MM-dd"), x.total.cast("string"))).alias("weeks"),
        lines("series", lambda x: F.concat(x.domain, F.lit("="), F.array_join(F.transform(x.points, lambda y: F.concat_ws(":", y.n.cast("string"), F.format_string("%.1f", y.share))), ","))).alias("series"),
        none("related", lines("related", lambda x: F.concat_ws(":", x.domain, F.floor(x.sim * 1e3 + 0.5).cast("string"), words(x.topics)))),
        none("rising", lines("rising", lambda x: F.concat_ws(":", x.opportunity_id, x.engagement.cast("string"), x.title), " | ")), "fresh",
        none("fresh_sources", lines("fresh_sources", lambda x: F.concat_ws(":", x.source, x.n.cast("string")))),
        none("fresh_items", lines("fresh_items", lambda x: F.concat_ws(":", x.opportunity_id, x.ago_hours.cast("string"), x.title), " | ")),
        lines("kpi_cards", lambda x: F.concat_ws("|", x.value, x.label, x.hint, x.tone), " ; ").alias("kpi_cards"), "narrative")


_WHOLE = "'*'"         # the key of the row of the whole corpus
_DOC = qt._GRID + qt.MOM + qt._WORDS + qt._TOPT + qt._TOPC + _DC + f""", kit AS (SELECT *, domain AS key FROM item UNION ALL SELECT *, {_WHOLE} FROM item),
dist AS (SELECT key, count(*) AS volume, count(DISTINCT voice) AS authors, {tb.r_sql('sum(engagement)::DOUBLE / count(*)', 1)} AS avg_engagement, CAST(sum(engagement) AS BIGINT) AS total_engagement FROM kit GROUP BY key),
mix AS (SELECT key, string_agg(source || ':' || n, ' ' ORDER BY n DESC, source) AS sources FROM (SELECT key, source, count(*) AS n FROM kit GROUP BY ALL) q GROUP BY key),
ser AS (SELECT domain AS key, string_agg(strftime(week, '%Y-%m-%d') || ':' || n || ':' || CAST(floor(share * 1e6 + 0.5) AS BIGINT), ' ' ORDER BY week) AS weeks FROM grid GROUP BY domain
  UNION ALL SELECT {_WHOLE}, string_agg(strftime(week, '%Y-%m-%d') || ':' || total || ':1000000', ' ' ORDER BY week) FROM axis),
wrd AS (SELECT domain AS key, string_agg(term || ':' || n, ' ' ORDER BY position) AS terms FROM top GROUP BY domain
  UNION ALL SELECT {_WHOLE}, string_agg(term || ':' || n, ' ' ORDER BY p) FROM (SELECT term, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (ORDER BY sum(n) DESC, term) AS p FROM tc GROUP BY term) g WHERE p <= 40),
plc AS (SELECT domain AS key, string_agg(concat_ws(':', community, volume, engagement, authors), ' ' ORDER BY position) AS communities FROM ct GROUP BY domain
  UNION ALL SELECT {_WHOLE}, string_agg(concat_ws(':', community, source, volume, engagement, authors), ' ' ORDER BY p) FROM (SELECT *, row_number() OVER (ORDER BY engagement DESC, volume DESC, community, source) AS p FROM gm) g WHERE p <= 12),
kin AS (SELECT domain AS key, string_agg(other || ':' || CAST(floor(sim * 1e3 + 0.5) AS BIGINT), ' ' ORDER BY p) AS related FROM dr GROUP BY domain),
mat AS (SELECT domain AS key, string_agg(other || ':' || CAST(floor(sim * 1e3 + 0.5) AS BIGINT), ' ' ORDER BY other) AS similarity FROM ds GROUP BY domain)"""
_CHANGE = "last_week, last, prev, share_last, share_prev, delta_pp, delta_pct, momentum, rising_score"


@query("SRC-19", oracle(f"""SELECT NULLIF(key, {_WHOLE}) AS domain, CASE WHEN key <> {_WHOLE} THEN {tb.sql_case('key', lx.DOMAIN_LABELS, '')} END AS label, volume, authors, avg_engagement, total_engagement, sources, {_CHANGE}, weeks, terms, communities, related, similarity
  FROM dist LEFT JOIN (SELECT domain AS key, * FROM mom) m USING (key) LEFT JOIN mix USING (key) LEFT JOIN ser USING (key) LEFT JOIN wrd USING (key) LEFT JOIN plc USING (key) LEFT JOIN kin USING (key) LEFT JOIN mat USING (key)""", extra=_DOC))
def trend_document(spark, d):
    """The trends document: one nested JSON line per domain, and one for the whole corpus with its terms,
    communities and weeks; written and read back. Here its fields side by side."""
    a, whole = qt.act(spark, d), F.lit("*")
    rows = checkpointed(a.drop("opportunity_id", "created_at"))
    grid = checkpointed(tr.share_grid(tr.weekly_counts(rows)))
    counts = checkpointed(tr.term_counts(items(spark, d)))
    sims = checkpointed(domain_similarity(spark, d))
    key = lambda df: df.withColumnRenamed("domain", "key")
    both = lambda agg: key(agg(rows)).unionByName(key(agg(rows.withColumn("domain", whole))))
    dist = both(lambda x: tr.category_distribution(x).join(x.groupBy("domain").agg(F.sum("engagement").alias("total_engagement")), "domain"))
    mix = both(lambda x: x.groupBy("domain", "source").agg(qt.N().alias("n")))
    totals = grid.select("week", "total").distinct().select(whole.alias("key"), "week", c("total").alias("n"), F.lit(1.0).alias("share"))
    every = counts.groupBy("term").agg(F.sum("n").alias("n")).withColumn("key", whole)
    words = key(tr.top_n(counts, ["domain"], [F.desc("n"), c("term")], 30)).unionByName(tr.top_n(every, ["key"], [F.desc("n"), c("term")], 40))
    places = key(qt.top_of_communities(rows))
    more = tr.community_activity(rows, ["community", "source"]).withColumn("key", whole)
    more = tr.top_n(more, ["key"], [F.desc("engagement"), F.desc("volume"), c("community"), c("source")], 12)
    near = tr.top_n(sims, ["domain"], [F.desc(F.floor(c("sim") * 1e9)), c("other")], 3)
    lists = lambda df, order, value, name: df.groupBy("key").agg(ru.ordered_list(value, *order).alias(name))
    parts = [
        key(tr.momentum(grid)).select("key", F.struct(F.date_format("last_week", "yyyy-MM-dd").alias("last_week"), *_CHANGE.split(", ")[1:]).alias("change")),
        lists(mix, [-c("n"), c("source")], F.struct("source", "n"), "sources"),
        lists(key(grid).select("key", "week", "n", "share").unionByName(totals), [c("week")], F.struct(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", "share"), "weeks"),
        lists(words, [c("position")], F.struct("term", "n"), "terms"),
        lists(places.unionByName(more, allowMissingColumns=True), [c("position")], F.struct("community", "source", "volume", "engagement", "authors"), "communities"),
        lists(key(near), [c("position")], F.struct("other", "sim"), "related"), lists(key(sims), [c("other")], F.struct("other", "sim"), "similarity")]
    doc = dist
    for part in parts:
        doc = doc.join(part, "key", "left")
    path = scratch_path(spark, "trends")
    doc = doc.select(F.nullif("key", whole).alias("domain"), F.when(c("key") != "*", qt.tx.domain_label(c("key"))).alias("label"), *[x for x in doc.columns if x != "key"])
    doc.write.option("ignoreNullFields", "false").json(path)
    got = spark.read.schema(doc.schema).json(path)
    micro = lambda x, scale: F.floor(x * scale + 0.5).cast("string")
    text = lambda name, *cells: F.when(c(name).isNotNull(), F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[f(x) for f in cells])), " ")).alias(name)
    plain = lambda field: lambda x: x[field].cast("string")
    return got.select("domain", "label", "volume", "authors", "avg_engagement", "total_engagement", text("sources", plain("source"), plain("n")), "change.*",
                      text("weeks", plain("week"), plain("n"), lambda x: micro(x.share, 1e6)), text("terms", plain("term"), plain("n")),
                      text("communities", *[plain(x) for x in ("community", "source", "volume", "engagement", "authors")]),
                      text("related", plain("other"), lambda x: micro(x.sim, 1e3)), text("similarity", plain("other"), lambda x: micro(x.sim, 1e3)))


# The account under which each persona is read.
SESSIONS = [("nova", "u0", "p0"), ("otto", "u1", "p1"), ("iris", "u3", "p0"), ("remy", "u2", "p1")]
_SES = ", ses AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{u}', '{k}')" for p, u, k in SESSIONS) + ") t(scope, user_id, persona_key))"


_SCORED = qr._ASK + qr._POOL + _SES + f""", lw AS (SELECT s.scope AS persona, f.mode AS learned_mode, f.w AS learned FROM ses s JOIN fin f ON f.user_id = s.user_id AND f.persona_key = s.persona_key WHERE f.n > 0),
fx AS (SELECT q.*, {tb.clamp_sql('(rel - min(rel) OVER (PARTITION BY persona)) / CASE WHEN max(rel) OVER (PARTITION BY persona) = min(rel) OVER (PARTITION BY persona) THEN 1e0 ELSE max(rel) OVER (PARTITION BY persona) - min(rel) OVER (PARTITION BY persona) END')} AS relevance,
  {qr._FIT} AS platform_fit, 1e0 - {tb.clamp_sql('effort_min / 240e0')} AS effort_fit, {tb.sql_case('source', lx.SOURCE_BUCKET, 'discuss')} AS bucket, CASE WHEN learned_mode = mode THEN learned ELSE {qr._W} END AS w
  FROM (SELECT pooled.*, pscore.rel FROM pooled JOIN pscore USING (persona, id)) q LEFT JOIN lw USING (persona)),
f0 AS (SELECT *, {qr._TOTAL} AS total, {qr._PARTS} AS parts FROM fx JOIN pri USING (persona, bucket)),
f1 AS (SELECT *, total * CASE WHEN mode = 'contribute' THEN 0.45e0 + 0.55e0 * COALESCE(NULLIF(contribution_worth, 0), 0.5e0) ELSE 1e0 END AS imp FROM f0),
f2 AS (SELECT * REPLACE ({tb.r_sql('impact * prior', 4)} AS impact, {tb.r_sql('roi * prior', 4)} AS roi) FROM (SELECT *, {tb.r_sql('imp', 4)} AS impact, {tb.r_sql(f"CASE WHEN {qr._AWARE} THEN imp / greatest(COALESCE(NULLIF(effort_min, 0), 30e0) / 60e0, 0.1e0) ELSE imp END", 4)} AS roi FROM f1) t),
fk AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY impact DESC, sim DESC, id) AS place, CASE WHEN y = '' THEN 'weak match' ELSE y END || CASE WHEN {qr._AWARE} THEN ' · ~' || printf('%.1f', {tb.r_sql('effort_min / 60e0', 1)}) || 'h to engage' ELSE ' · monitor only' END AS why
  FROM (SELECT *, {qr._WHY} AS y FROM f2) t)"""
_FUNNEL = _SCORED + (qr.MMR.replace("{lam}", "0.75e0") + qr._PACK).replace("FROM rkd", "FROM fk") + """,
fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY 0.6e0 * standout + 0.4e0 * relevance DESC, sim DESC, id) AS position FROM f2 WHERE source = 'github' AND mode IN ('contribute', 'discuss')) t WHERE position <= 3)"""


@query("RNK-01", "WITH RECURSIVE " + tb.OPP + tb.FEAT + qr.CAND + qr._SPL + qr._PRIOR + ", " + tb.FB + tb.LMS + _FUNNEL + """ SELECT n.persona, n.mode, n_candidates, items, basket, lane FROM (SELECT persona, mode, count(*) AS n_candidates FROM fk GROUP BY persona, mode) n
  JOIN (SELECT m.persona, string_agg(f.id || ':' || CAST(floor(f.impact * 1e4 + 0.5) AS BIGINT) || ':' || CAST(floor(f.roi * 1e4 + 0.5) AS BIGINT) || ':' || f.why, ' | ' ORDER BY step) AS items FROM mmr m JOIN fk f ON f.persona = m.persona AND f.id = m.ids[m.pick] WHERE step > 0 GROUP BY m.persona) i USING (persona)
  LEFT JOIN (SELECT persona, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY place) AS basket FROM basket GROUP BY persona) b USING (persona)
  LEFT JOIN (SELECT persona, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY position) AS lane FROM fl GROUP BY persona) l USING (persona)""")
def recommend(spark, d):
    """The whole funnel for every persona in one job: pair scorer on the pool, learned weights where
    they fit the mode, the buckets' prior, picks, basket and lane."""
    got = rk.recommended(checkpointed(funnel(spark, d)), corpus(spark, d).select("id", "vec"))
    whole = lambda x: F.floor(x * 1e4 + 0.5).cast("string")
    shown = F.transform("items", lambda x: F.concat_ws(":", x.id.cast("string"), whole(x.impact), whole(x.roi), x.why))
    ids = lambda name: F.when(c(name).isNotNull(), F.array_join(F.transform(name, lambda x: x.cast("string")), " ")).alias(name)
    return got.select("persona", "mode", "n_candidates", F.array_join(shown, " | ").alias("items"), ids("basket"), ids("lane"))


def sessions(spark, name="persona"):
    return spark.createDataFrame(SESSIONS, f"{name} string, user_id string, persona_key string")


def session_weights(spark, d):
    """(persona, user_id, persona_key, mode, n, weights): what was learned from each session's own log, stored once."""
    asked = sessions(spark)
    return checkpointed(asked.join(qs.learned(spark, d, asked.select("user_id", "persona_key")), ["user_id", "persona_key"]))


def funnel(spark, d, known=None):
    """Every candidate with its scores; `known` is session_weights when it is at hand."""
    rows = qr.filtered(spark, d).join(qr.asked(spark), "persona")
    rows = rk.normalized_relevance(rk.with_relevance(rows, en.pair_scorer()(c("ask"), qr.tx.pair_text(c("title"), c("body")))))
    learned = (session_weights(spark, d) if known is None else known).where("n > 0").select("persona", c("mode").alias("learned_mode"), c("weights").alias("learned"))
    rows = rows.withColumn("bucket", qt.nm.bucket_of(c("source"))).join(qr.priors(spark), ["persona", "bucket"]).join(learned, "persona", "left")
    return rk.with_scores(rows, learned=F.when(c("learned_mode") == c("mode"), c("learned")), prior=c("prior"))


@query("TRD-03", ("WITH RECURSIVE " + tb.OPP + tb.FEAT + qr.CAND + qr._SPL + qr._PRIOR + re.sub(r"\b(sc|rel|fs)\b", r"view_\1", _VIEW) + ", " + tb.FB + tb.LMS
                  + _SCORED + qr._MMR30.replace("FROM rkp", "FROM fk") + f""", qt AS ({qr._QUOTA.replace('JOIN rkp k', 'JOIN fk k')}),
  sm AS (SELECT user_id, persona_key, n, CASE WHEN up = '' AND dn = '' THEN 'Still learning what you respond to.'
    ELSE concat_ws('. ', CASE WHEN up <> '' THEN 'Priority: ' || up END, CASE WHEN dn <> '' THEN 'Non-priority: ' || dn END) || '.' END AS summary FROM
  (SELECT *, array_to_string(list_transform(list_slice(list_filter(list_reverse_sort(dl), lambda r: r.d > 0.02), 1, 2), lambda r: ({qs._LAB})[r.i]), ', ') AS up,
   array_to_string(list_transform(list_slice(list_filter(list_sort(dl), lambda r: r.d < -0.02), 1, 2), lambda r: ({qs._LAB})[r.i]), ', ') AS dn FROM (SELECT *, {qs._DEL} AS dl FROM fin) q) t)
  SELECT s.scope, mode, plan, picks, cards AS movers, terms, opportunities, reach, trending_terms, domains_active, m_label || ':' || printf('%.2f', m_delta) || ':' || m_direction AS top_mover, narrative, n AS learned_n, summary AS learned
  FROM ses s JOIN kp USING (scope) JOIN (SELECT persona AS scope, string_agg(bucket || ':' || pct, ' ' ORDER BY bucket_pos) AS plan FROM spl WHERE pct > 0 GROUP BY persona) p USING (scope)
  JOIN (SELECT q.persona AS scope, string_agg(concat_ws(':', rank, q.id, q.bucket, source, printf('%.1f', effort_min), why, substr(trim(title), 1, 140)), ' | ' ORDER BY rank) AS picks FROM qt q JOIN fk ON fk.persona = q.persona AND fk.id = q.id GROUP BY q.persona) q USING (scope)
  JOIN {_LISTS.format(n=5)} c USING (scope) JOIN (SELECT scope, count(*) AS trending_terms, string_agg(term, ' ' ORDER BY p) FILTER (p <= 10) AS terms FROM tsum GROUP BY scope) t USING (scope)
  JOIN (SELECT scope, count(*) AS opportunities, count(DISTINCT domain) AS domains_active FROM opp JOIN scope USING (domain) GROUP BY scope) z USING (scope)
  JOIN nar USING (scope) LEFT JOIN sm ON sm.user_id = s.user_id AND sm.persona_key = s.persona_key"""))
def brief(spark, d):
    """One row per persona: plan, picks by bucket quota from the whole funnel with title, reason and effort, the
    space's movers, terms, figures and narrative, and what was learned from how many steps."""
    v = view(spark, d)
    plan = qr.split_rows(spark).where("pct > 0").groupBy(c("persona").alias("scope")).agg(
        F.array_join(ru.ordered_list(F.concat(c("bucket"), F.lit(":"), c("pct").cast("string")), c("bucket_pos")), " ").alias("plan"))
    known = session_weights(spark, d)
    ranked = rk.by_impact(checkpointed(funnel(spark, d, known)))
    told = ranked.select("persona", "id", "bucket", "source", "effort_min", rk.why(rk.top_drivers(c("parts")), c("mode"), c("effort_min")).alias("why"), F.substring(F.trim("title"), 1, 140).alias("title"))
    order = rk.diversified(ranked.join(corpus(spark, d).select("id", "vec"), "id"), 30, 0.75).select("persona", "id", c("rank").alias("place"))
    picks = rk.bucket_quota(order.join(told, ["persona", "id"]), qr.split_rows(spark))
    shown = F.concat_ws(":", c("rank").cast("string"), c("id").cast("string"), "bucket", "source", F.format_string("%.1f", "effort_min"), "why", "title")
    picks = picks.groupBy(c("persona").alias("scope")).agg(F.array_join(ru.ordered_list(shown, c("rank")), " | ").alias("picks"))
    learned = known.select(c("persona").alias("scope"), c("n").alias("learned_n"), fb.learned_summary(c("mode"), c("weights")).alias("learned"))
    out = sessions(spark, "scope").join(learned, "scope", "left").select("scope", "learned_n", "learned")
    mover = F.concat_ws(":", c("mover.label"), F.format_string("%.2f", c("mover.delta_pp")), c("mover.direction"))
    return out.join(plan, "scope").join(picks, "scope").join(v, "scope").select(
        "scope", "mode", "plan", "picks", card_text(F.slice("cards", 1, 5)).alias("movers"), lines(F.slice("terms", 1, 10), lambda x: x.term).alias("terms"),
        "opportunities", "reach", "trending_terms", "domains_active", mover.alias("top_mover"), "narrative", "learned_n", "learned")
