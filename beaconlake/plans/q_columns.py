"""Column operators: projections, text, dates, arithmetic, JSON, arrays, maps."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx, schema
from beaconlake.functions import dates, jsontext, numeric as nm, text as tx
from beaconlake.operators import features as ft
from beaconlake.plans import testbed as tb
from beaconlake.plans.registry import query
from beaconlake.plans.testbed import oracle, r_sql

c = F.col
Q6 = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"


def micro(col):
    """A double as whole millionths, so that both engines hash the same value."""
    return F.floor(col * 1e6 + 0.5).cast("bigint")


def items(spark, d):
    return ft.decoded(tb.opportunities(spark, d))


def raws(spark, d):
    return ft.with_raw_signals(items(spark, d), tb.as_of())


# ---- projections -------------------------------------------------------------------------
@query("SRC-01", oracle("""SELECT opportunity_id, source, source_native_id, url, title, length(body) AS body_length, opportunity_type, domain,
  created_at, CASE WHEN doc_id % 89 = 3 THEN 'oops' ELSE '["' || array_to_string(tag_list, '","') || '"]' END AS tags, language, author, community,
  community_size, score, num_comments, '{}' AS raw FROM item"""))
def canonical_record(spark, d):
    return schema.canonical(tb.opportunities(spark, d)).select(
        "opportunity_id", "source", "source_native_id", "url", "title", F.length("body").cast("bigint").alias("body_length"),
        "opportunity_type", "domain", "created_at", "tags", "language", "author", "community", "community_size",
        "score", "num_comments", "raw")


@query("SRC-02", oracle("SELECT source, source_native_id, opportunity_id FROM opp"))
def stable_key(spark, d):
    o = tb.opportunities(spark, d)
    return o.select("source", "source_native_id", schema.opportunity_key(c("source"), c("source_native_id")).alias("opportunity_id"))


@query("SRC-10", oracle("SELECT opportunity_id, source, title, domain, author, community, score, num_comments FROM opp"))
def corpus_scan(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", "source", "title", "domain", "author", "community", "score", "num_comments")


@query("SRC-11", oracle("""SELECT o.opportunity_id, o.domain, e.label, CAST(len(e.embedding) AS BIGINT) AS dims, """
                        + Q6.format("e.embedding[1]::DOUBLE") + " AS first_micro FROM embeddings e JOIN opp o ON e.vec_id = o.doc_id"))
def embedding_scan(spark, d):
    o = tb.opportunities(spark, d).select("opportunity_id", "domain", "ingest_seq")
    e = tb.table(spark, d, "embeddings")
    return o.join(e, o.ingest_seq == e.vec_id).select(
        "opportunity_id", "domain", "label", F.size("embedding").cast("bigint").alias("dims"),
        micro(c("embedding")[0].cast("double")).alias("first_micro"))


@query("SRC-25", oracle("SELECT opportunity_id, domain AS domain_scraped, array_to_string(domain_list, ',') AS domains FROM opp"))
def add_columns(spark, d):
    o = tb.opportunities(spark, d)
    o = schema.add_column_if_missing(o, "domain_scraped", c("domain"))
    return o.select("opportunity_id", "domain_scraped", F.array_join(jsontext.domains_of(c("domains"), c("domain")), ",").alias("domains"))


@query("PRJ-01", oracle("SELECT opportunity_id, engagement FROM item"))
def engagement(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", nm.engagement(c("score"), c("num_comments")).alias("engagement"))


@query("PRJ-02", oracle(f"SELECT opportunity_id, {Q6.format('pop')} AS pop, {Q6.format('disc')} AS disc, {Q6.format('vel')} AS vel,"
                        f" {Q6.format('standout_raw')} AS standout FROM raw2", feat=True))
def raw_signals(spark, d):
    return raws(spark, d).select("opportunity_id", micro(c("pop")).alias("pop"), micro(c("disc")).alias("disc"),
                                 micro(c("vel")).alias("vel"), micro(c("standout_raw")).alias("standout"))


@query("PRJ-03", oracle("SELECT opportunity_id, open_flag AS openness FROM pct", feat=True))
def openness(spark, d):
    return items(spark, d).select("opportunity_id", ft.openness().alias("openness"))


@query("PRJ-04", oracle("SELECT opportunity_id, community_health, visibility FROM feat", feat=True))
def health_and_visibility(spark, d):
    return ft.feature_table(tb.opportunities(spark, d), tb.as_of()).select("opportunity_id", "community_health", "visibility")


@query("PRJ-05", oracle("SELECT opportunity_id, contribution_worth FROM feat", feat=True))
def contribution_worth(spark, d):
    return ft.feature_table(tb.opportunities(spark, d), tb.as_of()).select("opportunity_id", "contribution_worth")


@query("PRJ-06", oracle("SELECT opportunity_id, " + ", ".join(schema.FEATURES) + " FROM feat", feat=True))
def feature_vector(spark, d):
    return ft.feature_table(tb.opportunities(spark, d), tb.as_of())


@query("PRJ-08", oracle("SELECT opportunity_id, domain FROM opp WHERE domain IS NOT NULL AND domain <> ''"))
def with_domain(spark, d):
    return tb.opportunities(spark, d).where(c("domain").isNotNull() & (c("domain") != "")).select("opportunity_id", "domain")


_FLOOR = tb.sql_case("source", lx.RISING_FLOORS, lx.DEFAULT_RISING_FLOOR)


@query("PRJ-09", oracle(f"SELECT opportunity_id, velocity >= 0.6e0 AND engagement >= {_FLOOR} AS rising FROM feat", feat=True))
def rising(spark, d):
    o = tb.opportunities(spark, d)
    f = ft.feature_table(o, tb.as_of()).select("opportunity_id", "velocity")
    return o.join(f, "opportunity_id").select("opportunity_id", nm.is_rising(
        c("velocity"), nm.engagement(c("score"), c("num_comments")), c("source")).alias("rising"))


@query("PRJ-11", oracle("SELECT opportunity_id, community, community_size FROM opp WHERE community_size >= 50"))
def starred_repos(spark, d):
    return tb.opportunities(spark, d).where(c("community_size") >= 50).select("opportunity_id", "community", "community_size")


_ONE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_DISP = (f"CASE WHEN {_TRIM.format('title')} <> '' THEN {_TRIM.format('title')} "
         f"ELSE substr({_ONE.format('body')}, 1, 90) END")


PAIR_TEXT = f"substr({_TRIM.format(_TRIM.format('title') + chr(32) + '|| chr(32) || body')}, 1, 400)"


@query("PRJ-12", oracle(f"SELECT opportunity_id, {_DISP} AS display, {PAIR_TEXT} AS pair,"
                        " length(substr(body, 1, 1600)) AS shown FROM opp"))
def display_title(spark, d):
    return tb.opportunities(spark, d).select(
        "opportunity_id", tx.display_title(c("title"), c("body")).alias("display"),
        tx.pair_text(c("title"), c("body")).alias("pair"), F.length(F.substring("body", 1, 1600)).cast("bigint").alias("shown"))


@query("PRJ-16", oracle(f"SELECT opportunity_id, {tb.sql_case('source', lx.SOURCE_BUCKET, lx.DEFAULT_BUCKET)} AS bucket FROM opp"))
def bucket(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", nm.bucket_of(c("source")).alias("bucket"))


# ---- text --------------------------------------------------------------------------------
_STOPS = tb.sql_list(lx.TERM_STOP)
TERMS = f"""list_concat(list_filter(list_transform(regexp_extract_all(lower(COALESCE(title, '')), '[a-z][a-z0-9+#.]{{2,}}'), lambda w: trim(w, '.')),
  lambda w: length(w) >= 3 AND NOT list_contains({_STOPS}, w)),
  list_filter(list_transform(tag_list, lambda t: trim(lower(t))), lambda w: length(w) >= 3 AND NOT list_contains({_STOPS}, w)))"""


@query("TXT-01", oracle(f"SELECT opportunity_id, array_to_string({TERMS}, ' ') AS terms FROM opp"))
def tokens(spark, d):
    return items(spark, d).select("opportunity_id", F.array_join(tx.terms(c("title"), c("tag_list")), " ").alias("terms"))


MARKED = ("'## ' || title || chr(10) || '- **' || lang || '** [' || source || '](' || url || ') ![i](u.png) `x`' || chr(10) || '---' || chr(10)"
          " || chr(10) || chr(10) || '> ' || body || chr(128640) || ' — end – of'")


def marked(spark, d):
    """Bodies wrapped in markdown built from the row's own fields."""
    o = tb.opportunities(spark, d).join(tb.table(spark, d, "documents").selectExpr("doc_id as ingest_seq", "lang"), "ingest_seq")
    return o.select("opportunity_id", "ingest_seq", F.concat(
        F.lit("## "), "title", F.lit("\n- **"), "lang", F.lit("** ["), "source", F.lit("]("), "url", F.lit(") ![i](u.png) `x`\n---\n\n\n> "),
        "body", F.lit("\U0001F680 — end – of")).alias("md"))


def _chain(col, rules):
    for pattern, rep in rules:
        pattern = pattern.replace("(?dm)", "(?m)").replace("'", "''")
        col = f"regexp_replace({col}, '{pattern}', '{rep.replace('$1', chr(92) + '1')}', 'g')"
    return col


def _left(col):
    for m in ("**", "##", "```", "`"):
        col = f"replace({col}, '{m}', '')"
    return f"regexp_replace({col}, '{tx.EMOJI}', '', 'g')"


def _trim_ws(col):
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


STRIP = _trim_ws(f"regexp_replace({_left(_chain('md', tx.INLINE_MARKUP + tx.FLAT_MARKUP))}, '\\s+', ' ', 'g')")
LINES = _trim_ws("regexp_replace(regexp_replace(" + _left(_chain('md', tx.INLINE_MARKUP + tx.LINE_MARKUP)) +
                 ", '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_MD = f", mk AS (SELECT opportunity_id, doc_id, {MARKED} AS md FROM opp)"


@query("TXT-02", oracle(f"SELECT opportunity_id, {STRIP} AS plain FROM mk", extra=_MD))
def strip_markdown(spark, d):
    return marked(spark, d).select("opportunity_id", tx.strip_markdown(c("md")).alias("plain"))


@query("TXT-03", oracle(f"SELECT opportunity_id, {LINES} AS plain FROM mk", extra=_MD))
def clean_lines(spark, d):
    return marked(spark, d).select("opportunity_id", tx.clean_lines(c("md")).alias("plain"))


def house_sql(col, cap, marks="*#`"):
    return (f"substr({_trim_ws(f'''regexp_replace(replace(replace(replace(regexp_replace({col}, '[{marks}]+', '', 'g'), ' — ', ', '), '—', ', '), '–', '-'), '{chr(92)}s+', ' ', 'g')''')}, 1, {cap})")


@query("TXT-04", oracle(f"SELECT opportunity_id, {house_sql('md', 650)} AS summary, {house_sql('md', 240, '*#`_')} AS section FROM mk", extra=_MD))
def house_style(spark, d):
    return marked(spark, d).select("opportunity_id", tx.house_style(c("md"), 650).alias("summary"),
                                   tx.house_style(c("md"), 240, "*#`_").alias("section"))


_KW = tb.sql_list(lx.KEYWORD_STOP)


@query("TXT-05", oracle(f"""SELECT opportunity_id, array_to_string(list_slice(list_transform(list_filter(list_transform(w, lambda x, i: {{'x': x, 'i': list_position(w, x) = i}}),
  lambda s: s.i), lambda s: s.x), 1, 5), ' ') AS keywords FROM (SELECT opportunity_id,
  list_filter(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9+#.]{{2,}}'), lambda x: NOT list_contains({_KW}, lower(x))) AS w FROM opp) t"""))
def title_keywords(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", F.array_join(tx.title_keywords(c("title")), " ").alias("keywords"))


@query("TXT-07", oracle("SELECT opportunity_id, issue_quality FROM feat", feat=True))
def issue_quality(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", nm.fixed_round(tx.issue_quality(c("source"), c("body")), 4).alias("issue_quality"))


@query("TXT-08", oracle(f"SELECT opportunity_id, len(list_filter(tag_list, lambda t: {tb._any('lower(t)', lx.GOOD_FIRST_WORDS)})) > 0 AS good_first FROM opp"))
def good_first(spark, d):
    return items(spark, d).select("opportunity_id", tx.good_first(c("tag_list")).alias("good_first"))


@query("TXT-09", oracle("SELECT opportunity_id, regexp_extract(url, 'github\\.com/([^/]+/[^/]+)', 1) AS repo FROM opp"))
def repo_of_url(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", tx.repo_of_page(c("url")).alias("repo"))


_BASIS = """CASE WHEN source = 'github' AND opportunity_type = 'pull_request' THEN '~' || m || ' min: reviewing and iterating on a pull request (about a 90-min base, plus the size of the change).'
 WHEN source = 'github' THEN '~' || m || ' min, from a transparent heuristic: ' || CASE WHEN m < 120 THEN 'a beginner-friendly issue (a 45-min base)' ELSE 'a standard issue (a 150-min base)' END
   || ', plus reading time scaled to the issue''s length. GitHub work is the heaviest category, so the estimate is deliberately generous.'
 WHEN source IN ('hackernews', 'reddit') THEN '~' || m || ' min: time to read the thread and write one substantive, non-obvious comment.'
 WHEN source = 'bluesky' THEN '~' || m || ' min: read the post and write a thoughtful reply.'
 WHEN source = 'devto' THEN '~' || m || ' min: the article''s reading time plus ~8 min to leave a comment that adds value.' ELSE '~' || m || ' min to meaningfully engage.' END"""


def minutes(df):
    return nm.effort_minutes(c("source"), c("opportunity_type"), c("body"), tx.good_first(c("tag_list")), c("sig.reading_time_min"))


@query("TXT-12", oracle(f"SELECT opportunity_id, {_BASIS} AS basis FROM (SELECT *, CAST(floor(minutes + 0.5e0) AS BIGINT) AS m FROM pct) t", feat=True))
def effort_basis(spark, d):
    i = items(spark, d)
    return i.select("opportunity_id", tx.effort_basis(c("source"), c("opportunity_type"), F.floor(minutes(i) + 0.5)).alias("basis"))


# ---- dates -------------------------------------------------------------------------------
@query("DAT-01", oracle("SELECT opportunity_id, strftime(week, '%Y-%m-%d') AS week FROM item"))
def week(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", F.date_format(dates.week_monday(c("created_at")), "yyyy-MM-dd").alias("week"))


@query("DAT-02", oracle(f"SELECT opportunity_id, {Q6.format('age')} AS age_micro FROM raw", feat=True))
def age(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", micro(dates.age_days(c("created_at"), tb.as_of())).alias("age_micro"))


@query("DAT-03", oracle("SELECT opportunity_id, recency FROM feat", feat=True))
def recency(spark, d):
    return tb.opportunities(spark, d).select("opportunity_id", nm.fixed_round(nm.recency_decay(dates.age_days(c("created_at"), tb.as_of())), 4).alias("recency"))


@query("DAT-04", "SELECT event_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events) t")
def epoch_iso(spark, d):
    e = tb.table(spark, d, "events").withColumn("s", F.unix_seconds(dates.utc_instant(c("ts"))))
    return e.select("event_id", dates.epoch_iso(c("s")).alias("iso"))


@query("DAT-05", oracle("SELECT opportunity_id, CAST(floor((epoch_us((SELECT max(cts) FROM opp)) - epoch_us(cts)) / 3600e6) AS BIGINT) AS ago_hours,"
                        " cts >= (SELECT max(cts) FROM opp) - INTERVAL 7 DAY AS fresh FROM opp WHERE cts IS NOT NULL"))
def hours_ago(spark, d):
    o = tb.opportunities(spark, d).select("opportunity_id", dates.parsed(c("created_at")).alias("at")).where("at is not null")
    newest = o.agg(F.max("at"))
    return o.withColumn("newest", newest.scalar()).select("opportunity_id", dates.hours_before(c("newest"), c("at")).alias("ago_hours"),
                                 (c("at") >= c("newest") - F.expr("INTERVAL 7 DAYS")).alias("fresh"))


@query("DAT-06", """SELECT 'https://data.example.org/' || strftime(h, '%Y-%m-%d-%-H') || '.json.gz' AS path FROM (SELECT date_trunc('hour', max(ts)) - to_hours(CAST(2 + i AS INTEGER)) AS h
  FROM events, range(0, 48) r(i) GROUP BY i) t""")
def hourly_paths(spark, d):
    newest = tb.table(spark, d, "events").agg(F.max("ts").alias("newest"))
    hours, path = dates.hourly_files("https://data.example.org/", c("newest"), 48)
    return newest.select(hours.alias("h")).select(path(c("h")).alias("path"))


# ---- arithmetic --------------------------------------------------------------------------
@query("MTH-01", oracle("SELECT opportunity_id, repo_reputation FROM feat WHERE source = 'github'", feat=True))
def reputation(spark, d):
    return tb.opportunities(spark, d).where("source = 'github'").select(
        "opportunity_id", nm.fixed_round(nm.repo_reputation(c("community_size")), 4).alias("repo_reputation"))


@query("MTH-02", oracle("SELECT opportunity_id, effort_min FROM feat", feat=True))
def effort(spark, d):
    i = items(spark, d)
    return i.select("opportunity_id", nm.fixed_round(minutes(i), 1).alias("effort_min"))


@query("MTH-03", oracle(f"SELECT opportunity_id, effort, {r_sql('1e0 - ' + tb.clamp_sql('effort_min / 240e0'), 4)} AS effort_fit FROM feat", feat=True))
def effort_share(spark, d):
    i = items(spark, d)
    return i.select("opportunity_id", nm.fixed_round(nm.effort_share(minutes(i)), 4).alias("effort"),
                    nm.fixed_round(1.0 - nm.effort_share(nm.fixed_round(minutes(i), 1)), 4).alias("effort_fit"))


@query("MTH-11", oracle(f"SELECT opportunity_id, CASE WHEN age > 0 THEN {r_sql('community_size / age', 3)} END AS star_velocity FROM raw WHERE source = 'github'", feat=True))
def star_velocity(spark, d):
    return raws(spark, d).where("source = 'github'").select("opportunity_id", nm.star_velocity(c("community_size"), c("age")).alias("star_velocity"))


PROTO = """proto AS (SELECT e.label, e.vec_id AS proto_id, e.embedding AS pv FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) m ON e.vec_id = m.vec_id)"""


def prototypes(spark, d):
    """The first vector of every label."""
    e = tb.table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("pv"), F.min("vec_id").alias("proto_id"))


@query("MTH-10", f"""WITH {PROTO} SELECT vec_id, {Q6.format('list_dot_product(embedding::DOUBLE[], pv::DOUBLE[])')} AS dot_micro,
  {Q6.format('list_cosine_similarity(embedding::DOUBLE[], pv::DOUBLE[])')} AS cos_micro, {Q6.format('sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS norm_micro
  FROM embeddings e JOIN proto p ON e.label = p.label""")
def similarity(spark, d):
    e = tb.table(spark, d, "embeddings").join(prototypes(spark, d), "label")
    return e.select("vec_id", micro(nm.dot(c("embedding"), c("pv"))).alias("dot_micro"),
                    micro(nm.cosine(c("embedding"), c("pv"))).alias("cos_micro"), micro(nm.norm(c("embedding"))).alias("norm_micro"))


# ---- JSON, arrays, maps ------------------------------------------------------------------
@query("JSN-01", oracle("SELECT opportunity_id, array_to_string(tag_list, '|') AS tags, array_to_string(domain_list, '|') AS domains, contributors, open_issues, state, archived FROM item"))
def decode_json(spark, d):
    return items(spark, d).select("opportunity_id", F.array_join("tag_list", "|").alias("tags"), F.array_join("domain_list", "|").alias("domains"),
                                  "sig.contributors", "sig.open_issues", "sig.state", "sig.archived")


@query("JSN-02", oracle("""SELECT source, key, count(*) AS n FROM (SELECT source, unnest([CASE WHEN star_velocity IS NOT NULL THEN 'star_velocity' END,
  CASE WHEN contributors IS NOT NULL THEN 'contributors' END, CASE WHEN open_issues IS NOT NULL THEN 'open_issues' END, CASE WHEN archived IS NOT NULL THEN 'archived' END,
  CASE WHEN state IS NOT NULL THEN 'state' END, CASE WHEN reading_time_min IS NOT NULL THEN 'reading_time_min' END]) AS key FROM item) t WHERE key IS NOT NULL GROUP BY ALL"""))
def json_keys(spark, d):
    o = tb.opportunities(spark, d).select("source", F.explode(jsontext.key_list(c("signals"))).alias("key"))
    return o.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))


@query("JSN-03", oracle("SELECT opportunity_id, state, CAST(num_comments AS VARCHAR) AS open_issues, '7' AS forks FROM item"))
def json_merge(spark, d):
    o = tb.opportunities(spark, d)
    new = F.to_json(F.struct(c("num_comments").cast("string").alias("open_issues"), F.lit("7").alias("forks")))
    m = o.select("opportunity_id", jsontext.merged(c("signals"), new).alias("m"))
    return m.select("opportunity_id", *[F.get_json_object("m", f"$.{k}").alias(k) for k in ("state", "open_issues", "forks")])


_VALID = tb.sql_list(lx.DOMAINS + ["other"])


@query("ARR-01", oracle(f"""SELECT opportunity_id, array_to_string(CASE WHEN len(k) = 0 THEN ['other'] ELSE list_slice(k, 1, 3) END, ',') AS labels FROM
  (SELECT opportunity_id, list_filter(list_concat(list_concat(['bogus'], domain_list), [lang, domain, domain]), lambda x: list_contains({_VALID}, x)) AS k FROM opp) t"""))
def valid_labels(spark, d):
    o = items(spark, d).join(tb.table(spark, d, "documents").selectExpr("doc_id as ingest_seq", "lang"), "ingest_seq")
    raw = F.concat(F.array(F.lit("bogus")), c("domain_list"), F.array("lang", "domain", "domain"))
    return o.select("opportunity_id", F.array_join(jsontext.valid_labels(raw, lx.DOMAINS + ["other"]), ",").alias("labels"))


@query("ARR-02", f"""WITH {PROTO} SELECT e.vec_id, {Q6.format('greatest(list_dot_product(e.embedding::DOUBLE[], p.pv::DOUBLE[]), list_dot_product(e.embedding::DOUBLE[], q.pv::DOUBLE[]))')} AS best_micro
  FROM embeddings e JOIN proto p ON p.label = e.label JOIN proto q ON q.label = (e.label + 1) % 10""")
def best_facet(spark, d):
    p = prototypes(spark, d).select("label", "pv")
    e = tb.table(spark, d, "embeddings").join(p, "label").withColumnRenamed("pv", "p1")
    e = e.withColumn("next", (c("label") + 1) % 10).join(p.selectExpr("label as next", "pv as p2"), "next")
    return e.select("vec_id", micro(F.array_max(F.transform(F.array("p1", "p2"), lambda f: nm.dot(c("embedding"), f)))).alias("best_micro"))


@query("MAP-01", """WITH w AS (SELECT event_id, [greatest(0e0, value - 20e0), 0e0, greatest(0e0, 5e0 - value), value] AS a FROM events)
  SELECT event_id, array_to_string(list_transform(a, lambda x: CAST(floor(x / (CASE WHEN a[1] + a[2] + a[3] + a[4] = 0 THEN 1e0 ELSE a[1] + a[2] + a[3] + a[4] END) * 1e6 + 0.5) AS BIGINT)), ',') AS weights FROM w""")
def normalized_weights(spark, d):
    e = tb.table(spark, d, "events")
    w = nm.renormalized(F.array(c("value") - 20.0, F.lit(0.0), F.lit(5.0) - c("value"), c("value")))
    return e.select("event_id", F.array_join(F.transform(w, micro).cast("array<string>"), ",").alias("weights"))
