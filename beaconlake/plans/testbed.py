"""The test tables read as the library's own model, in Spark and (for the checks) in SQL.

documents + labels become opportunities, embeddings become their vectors, events become
the feedback log and the activity log, customers become user profiles. Every rule below is
a fixed function of the row, so the derived tables grow with the given ones.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconlake import lexicon as lx
from beaconlake.operators.skew import spread

AS_OF = "2026-03-20T00:00:00Z"
AS_OF_SQL = "TIMESTAMP '2026-03-20 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def as_of():
    return F.try_to_timestamp(F.lit(AS_OF))


def _quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_list(values):
    return "[" + _quoted(values) + "]"


def sql_case(expr, table_, default):
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "CASE " + expr + "".join(f" WHEN {lit(k)} THEN {lit(v)}" for k, v in table_.items()) + f" ELSE {lit(default)} END"


def opportunities(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    base = docs.selectExpr(
        "doc_id", "text", "lang", "n_chars", "quality", "toxic", "source as src",
        "coalesce(try_cast(substring(source, 4) as bigint), 0) as sn",
        "case lang when 'en' then 0 when 'de' then 1 when 'es' then 2 else 3 end as li")
    base = base.selectExpr(
        "*", "element_at(array('github','devto','hackernews','reddit','bluesky'), cast(sn % 5 as int) + 1) as source",
        "cast(li * 4 + (sn div 5) % 4 as int) as di")
    dom = f"array({_quoted(lx.DOMAINS)})"
    base = base.selectExpr("*", f"case when di = 15 then '' else element_at({dom}, di + 1) end as domain",
                           f"element_at({dom}, cast(n_chars % 15 as int) + 1) as second")
    return base.selectExpr(
        "sha1(concat_ws(':', source, cast(doc_id as string))) as opportunity_id", "source",
        "cast(doc_id as string) as source_native_id",
        "case when source = 'github' then concat('https://github.com/org', sn, '/repo', n_chars % 7, '/issues/', doc_id)"
        " else concat('https://example.org/', source, '/', doc_id) end as url",
        "case when source = 'bluesky' then '' else split_part(text, '\\n', 1) end as title",
        "text as body",
        "case source when 'github' then if(n_chars % 4 = 0, 'pull_request', 'issue') when 'devto' then 'article'"
        " when 'hackernews' then 'story' else 'post' end as opportunity_type",
        "domain",
        "case when doc_id % 83 = 4 then '[broken' else to_json(case when n_chars % 3 = 0 and second <> domain"
        " then array(domain, second) else array(domain) end) end as domains",
        "case when doc_id % 50 = 7 then '' when doc_id % 101 = 9 then 'not a date' else concat(date_format("
        "timestamp_ntz'2026-01-05 00:00:00' + make_dt_interval(0, 0, cast((doc_id * 61) % 100800 as int), 0),"
        " \"yyyy-MM-dd'T'HH:mm:ss\"), if(doc_id % 2 = 0, 'Z', '+00:00')) end as created_at",
        "case when doc_id % 89 = 3 then 'oops' else to_json(concat(array(lang, src), if(quality = 1, array('Quality'),"
        " array()), if(source = 'github' and n_chars % 2 = 0, array('good first issue'), array()))) end as tags",
        "case when source = 'github' then element_at(array('Python','C++','Rust','Go'), cast(n_chars % 4 as int) + 1) end as language",
        "case when toxic = 1 then null when n_chars % 41 = 0 then '' else concat('user', n_chars % 97) end as author",
        "cast(null as double) as author_reputation",
        "case when n_chars % 53 = 0 then '' when source = 'github' then concat('org', sn, '/repo', n_chars % 7)"
        " when source = 'reddit' then concat('r/', lang, sn) when source = 'devto' then 'dev.to' else source end as community",
        "case when source = 'github' then (n_chars * 13) % 60000 end as community_size",
        "case when n_chars % 3 = 0 then 0 when n_chars % 17 = 0 then null else n_chars % 200 end as score",
        "case when n_chars % 4 = 0 then 0 else n_chars % 37 end as num_comments",
        "cast(null as string) as last_activity_at",
        "case when doc_id % 97 = 5 then '{broken' when source = 'github' then to_json(named_struct("
        "'star_velocity', if(n_chars % 19 = 0, null, cast(n_chars % 1000 as double) / 100D), 'contributors', n_chars % 9,"
        " 'open_issues', n_chars % 31, 'archived', n_chars % 11 = 0, 'state', case when n_chars % 13 = 0 then 'closed'"
        " when n_chars % 29 = 0 then null else 'open' end)) when source = 'devto' then to_json(named_struct("
        "'reading_time_min', if(n_chars % 23 = 0, null, 1 + n_chars % 14))) else '{}' end as signals",
        "'{}' as raw", "'2026-03-19T00:00:00Z' as fetched_at", "doc_id as ingest_seq")


_DOM = sql_list(lx.DOMAINS)
OPP = f"""
src0 AS (SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic, d.source AS src,
  COALESCE(TRY_CAST(substr(d.source, 4) AS BIGINT), 0) AS sn,
  CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS li
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
src1 AS (SELECT *, ['github','devto','hackernews','reddit','bluesky'][(sn % 5) + 1] AS source,
  li * 4 + (sn // 5) % 4 AS di FROM src0),
src2 AS (SELECT *, CASE WHEN di = 15 THEN '' ELSE ({_DOM})[di + 1] END AS domain,
  ({_DOM})[(n_chars % 15) + 1] AS second,
  CASE WHEN doc_id % 50 = 7 OR doc_id % 101 = 9 THEN NULL
    ELSE TIMESTAMP '2026-01-05 00:00:00' + to_minutes(CAST((doc_id * 61) % 100800 AS INTEGER)) END AS cts FROM src1),
opp AS (SELECT sha1(source || ':' || doc_id) AS opportunity_id, source, CAST(doc_id AS VARCHAR) AS source_native_id,
  CASE WHEN source = 'github' THEN 'https://github.com/org' || sn || '/repo' || (n_chars % 7) || '/issues/' || doc_id
    ELSE 'https://example.org/' || source || '/' || doc_id END AS url,
  CASE WHEN source = 'bluesky' THEN '' ELSE split_part(text, chr(10), 1) END AS title,
  text AS body,
  CASE source WHEN 'github' THEN CASE WHEN n_chars % 4 = 0 THEN 'pull_request' ELSE 'issue' END WHEN 'devto' THEN 'article'
    WHEN 'hackernews' THEN 'story' ELSE 'post' END AS opportunity_type,
  domain, CASE WHEN doc_id % 83 <> 4 AND n_chars % 3 = 0 AND second <> domain THEN [domain, second] ELSE [domain] END AS domain_list,
  cts, CASE WHEN doc_id % 50 = 7 THEN '' WHEN doc_id % 101 = 9 THEN 'not a date' ELSE strftime(cts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 2 = 0
    THEN 'Z' ELSE '+00:00' END END AS created_at,
  CASE WHEN doc_id % 89 = 3 THEN CAST([] AS VARCHAR[]) ELSE list_concat(list_concat([lang, src],
    CASE WHEN quality = 1 THEN ['Quality'] ELSE CAST([] AS VARCHAR[]) END),
    CASE WHEN source = 'github' AND n_chars % 2 = 0 THEN ['good first issue'] ELSE CAST([] AS VARCHAR[]) END) END AS tag_list,
  CASE WHEN source = 'github' THEN ['Python','C++','Rust','Go'][(n_chars % 4) + 1] END AS language,
  CASE WHEN toxic = 1 THEN NULL WHEN n_chars % 41 = 0 THEN '' ELSE 'user' || (n_chars % 97) END AS author,
  CASE WHEN n_chars % 53 = 0 THEN '' WHEN source = 'github' THEN 'org' || sn || '/repo' || (n_chars % 7)
    WHEN source = 'reddit' THEN 'r/' || lang || sn WHEN source = 'devto' THEN 'dev.to' ELSE source END AS community,
  CASE WHEN source = 'github' THEN (n_chars * 13) % 60000 END AS community_size,
  CASE WHEN n_chars % 3 = 0 THEN 0 WHEN n_chars % 17 = 0 THEN NULL ELSE n_chars % 200 END AS score,
  CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars % 37 END AS num_comments,
  doc_id % 97 <> 5 AS sig_ok, doc_id % 97 <> 5 AND source = 'github' AS gsig,
  n_chars, doc_id, lang, doc_id AS ingest_seq FROM src2),
item AS (SELECT *, date_trunc('week', cts)::DATE AS week, COALESCE(score, 0) + COALESCE(num_comments, 0) AS engagement,
  CASE WHEN gsig AND n_chars % 19 <> 0 THEN CAST(n_chars % 1000 AS DOUBLE) / 100 END AS star_velocity,
  CASE WHEN gsig THEN n_chars % 9 END AS contributors, CASE WHEN gsig THEN n_chars % 31 END AS open_issues,
  CASE WHEN gsig THEN n_chars % 11 = 0 END AS archived,
  CASE WHEN NOT gsig THEN NULL WHEN n_chars % 13 = 0 THEN 'closed' WHEN n_chars % 29 = 0 THEN NULL ELSE 'open' END AS state,
  CASE WHEN sig_ok AND source = 'devto' AND n_chars % 23 <> 0 THEN 1 + n_chars % 14 END AS reading_time_min,
  NULLIF(author, '') AS voice, NULLIF(community, '') AS spot FROM opp)
"""


def _any(expr, words):
    return "(" + " OR ".join("contains({}, '{}')".format(expr, w.replace("'", "''")) for w in words) + ")"


def r_sql(x, digits):
    s = f"1e{digits}"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def clamp_sql(x):
    return f"greatest(0e0, least(1e0, {x}))"


EFFORT_SQL = f"""CASE WHEN source = 'devto' THEN COALESCE(NULLIF(reading_time_min, 0), 5) + 8e0
  WHEN source IN ('hackernews', 'reddit') THEN 15e0 WHEN source = 'bluesky' THEN 8e0
  WHEN source = 'github' THEN least(CASE WHEN opportunity_type = 'pull_request' THEN 90e0
     WHEN len(list_filter(tag_list, lambda t: {_any('lower(t)', lx.GOOD_FIRST_WORDS)})) > 0 THEN 45e0 ELSE 150e0 END
     + least(length(body) / 500e0 * 15e0, 60e0), 480e0) ELSE 30e0 END"""
QUALITY_SQL = f"""CASE WHEN source <> 'github' OR body IS NULL OR body = '' THEN 0.5e0 ELSE {clamp_sql(
  "least(0.35e0, length(body) / 1200e0 * 0.35e0) + CASE WHEN contains(body, '```') THEN 0.15e0 ELSE 0e0 END"
  " + CASE WHEN regexp_matches(body, '(?m)^[ " + chr(92) + "s]*([0-9]+" + chr(92) + ".|[-*])" + chr(92) + "s') THEN 0.15e0 ELSE 0e0 END"
  " + CASE WHEN regexp_matches(body, 'https?://') THEN 0.10e0 ELSE 0e0 END"
  " + CASE WHEN " + _any('lower(body)', lx.REPRO_WORDS) + " THEN 0.15e0 ELSE 0e0 END"
  " + CASE WHEN " + _any('lower(body)', lx.NEWCOMER_WORDS) + " THEN 0.10e0 ELSE 0e0 END")} END"""
REPUTATION_SQL = f"""CASE WHEN COALESCE(community_size, 0) < 1 THEN 0e0 ELSE {clamp_sql(
  "least(1e0, log10(community_size + 1e0) / log10(5000e0)) * CASE WHEN community_size > 50000 THEN 0.85e0 ELSE 1e0 END")} END"""
FEAT = f""",
raw AS (SELECT *, greatest(0e0, COALESCE((epoch_us({AS_OF_SQL}) - epoch_us(cts)) / 86400e6, 9999e0)) AS age,
  CASE WHEN source = 'github' THEN COALESCE(community_size, 0) ELSE COALESCE(score, 0) END::DOUBLE AS pop,
  COALESCE(num_comments, 0)::DOUBLE AS disc,
  CASE WHEN source = 'github' AND contributors <> 0 THEN (COALESCE(open_issues, 0) + COALESCE(num_comments, 0)::DOUBLE) / greatest(contributors, 1) END AS standout_raw
  FROM item),
raw2 AS (SELECT *, CASE WHEN source = 'github' THEN star_velocity ELSE COALESCE(score, 0)::DOUBLE / greatest(age, 1e0) END AS vel FROM raw),
pct AS (SELECT *,
  (rank() OVER (PARTITION BY source ORDER BY pop) - 1) / count(pop) OVER (PARTITION BY source) AS pop_pct,
  (rank() OVER (PARTITION BY source ORDER BY disc) - 1) / count(disc) OVER (PARTITION BY source) AS disc_pct,
  CASE WHEN vel IS NULL THEN 0e0 ELSE (rank() OVER (PARTITION BY source ORDER BY vel NULLS LAST) - 1) / count(vel) OVER (PARTITION BY source) END AS vel_pct,
  CASE WHEN standout_raw IS NULL THEN 0e0 ELSE (rank() OVER (PARTITION BY source ORDER BY standout_raw NULLS LAST) - 1) / count(standout_raw) OVER (PARTITION BY source) END AS standout_pct,
  exp(-ln(2e0) * age / 30e0) AS rec,
  CASE WHEN source = 'github' AND (COALESCE(archived, false) OR COALESCE(NULLIF(state, ''), 'open') <> 'open') THEN 0e0 ELSE 1e0 END AS open_flag,
  CASE WHEN source = 'github' THEN {REPUTATION_SQL} ELSE 0.5e0 END AS rep, {QUALITY_SQL} AS qual, {EFFORT_SQL} AS minutes FROM raw2),
pct2 AS (SELECT *, {clamp_sql('0.45e0 * disc_pct + 0.30e0 * rec + 0.25e0 * vel_pct')} * CASE WHEN open_flag > 0 THEN 1e0 ELSE 0.4e0 END AS health FROM pct),
feat AS (SELECT *, {r_sql('pop_pct', 4)} AS popularity, {r_sql('disc_pct', 4)} AS discussion, {r_sql('vel_pct', 4)} AS velocity,
  {r_sql('rec', 4)} AS recency, {r_sql("CASE WHEN source <> 'github' OR standout_raw IS NULL THEN 0.5e0 ELSE standout_pct END", 4)} AS standout,
  open_flag AS openness, {r_sql('health', 4)} AS community_health,
  {r_sql(clamp_sql('0.6e0 * pop_pct + 0.4e0 * vel_pct'), 4)} AS visibility, {r_sql('rep', 4)} AS repo_reputation, {r_sql('qual', 4)} AS issue_quality,
  {r_sql("CASE WHEN source = 'github' THEN " + clamp_sql('0.30e0 * rep + 0.40e0 * qual + 0.30e0 * health') + " * CASE WHEN open_flag > 0 THEN 1e0 ELSE 0.5e0 END ELSE 0.5e0 END", 4)} AS contribution_worth,
  {r_sql('minutes', 1)} AS effort_min, {r_sql(clamp_sql('minutes / 240e0'), 4)} AS effort FROM pct2)
"""


def oracle(body, *, feat=False, extra=""):
    """A self-contained query over the opportunity model."""
    return "WITH " + OPP + (FEAT if feat else "") + extra + "\n" + body


# Goals, skills and roles that customers are given as profiles.
GOALS = ["Find good first issue work to contribute and build a portfolio", "Join expert commentary and discussion threads",
         "Spot rising tools before they go mainstream", "Grow awareness for a product integration",
         "Read and learn", "", "Fix bugs in libraries"]
SKILLS = ["Senior engineer with years of work", "student and beginner", "Likes data"]
AVOIDS = ["C++, Rust", "", "Java/Go;PHP", "php."]
ROLES = [" — Engineer", " - Writer", " – Founder", ""]


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as saved profiles."""
    k = "c_custkey"
    pick = lambda vals, n: f"element_at(array({_quoted(vals)}), cast(c_custkey % {n} as int) + 1)"
    dom = f"array({_quoted(lx.DOMAINS)})"
    at = lambda off: f"element_at({dom}, cast(({k} + {off}) % 15 as int) + 1)"
    return spread(table(spark, folder, "customer"), "c_custkey").selectExpr(
        "concat('u', c_custkey) as user_id", "concat('p', c_custkey % 3) as profile_key",
        f"concat(c_name, {pick(ROLES, 4)}) as name", f"{pick(GOALS, 7)} as goal",
        f"slice(array(if({k} % 6 = 0, 'blockchain_web3', {at(0)}), {at(5)}, {at(10)}), 1, cast({k} % 4 as int)) as domains",
        f"case {k} % 5 when 0 then array('github', 'reddit') when 1 then array('blogs', 'social') when 2 then array('hackernews')"
        " when 3 then cast(array() as array<string>) else array('reddit', 'github') end as platforms",
        f"cast(1 + {k} % 10 as double) as time_budget_hours", f"{pick(AVOIDS, 4)} as avoid",
        f"{pick(SKILLS, 3)} as skill_words", "c_custkey", "c_acctbal", "c_nationkey")


_at = lambda off: f"({_DOM})[((c_custkey + {off}) % 15) + 1]"
PROF = f"""prof AS (SELECT 'u' || c_custkey AS user_id, 'p' || (c_custkey % 3) AS profile_key,
  c_name || ({sql_list(ROLES)})[(c_custkey % 4) + 1] AS name, ({sql_list(GOALS)})[(c_custkey % 7) + 1] AS goal,
  list_slice([CASE WHEN c_custkey % 6 = 0 THEN 'blockchain_web3' ELSE {_at(0)} END, {_at(5)}, {_at(10)}], 1, c_custkey % 4) AS domains,
  CASE c_custkey % 5 WHEN 0 THEN ['github', 'reddit'] WHEN 1 THEN ['blogs', 'social'] WHEN 2 THEN ['hackernews']
    WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE ['reddit', 'github'] END AS platforms,
  CAST(1 + c_custkey % 10 AS DOUBLE) AS time_budget_hours, ({sql_list(AVOIDS)})[(c_custkey % 4) + 1] AS avoid,
  ({sql_list(SKILLS)})[(c_custkey % 3) + 1] AS skill_words, c_custkey, c_acctbal, c_nationkey FROM customer),
pers0 AS (SELECT *, list_transform(domains, lambda d: CASE d WHEN 'blockchain_web3' THEN 'blockchain' WHEN 'embedded_iot' THEN 'embedded_systems' ELSE d END) AS doms,
  CASE WHEN len(platforms) = 0 THEN {sql_list(lx.SOURCES)} ELSE list_transform(platforms, lambda p: CASE p WHEN 'blogs' THEN 'devto' WHEN 'social' THEN 'bluesky' ELSE p END) END AS plats,
  CASE WHEN goal = '' THEN 'Find relevant opportunities to contribute to and discuss' ELSE goal END AS the_goal FROM prof),
pers1 AS (SELECT *, CASE WHEN len(doms) = 0 THEN ['technology', 'open source'] ELSE list_transform(doms, lambda d: {sql_case('d', lx.DOMAIN_LABELS, '')}) END AS interests,
  list_filter(list_transform(regexp_split_to_array(avoid, '[,/;]'), lambda x: trim(x)), lambda x: x <> '') AS langs FROM pers0),
pers2 AS (SELECT *, lower(the_goal || ' ' || array_to_string(interests, ' ')) AS gi, lower(the_goal || ' ' || skill_words || ' ' || name || ' ' || array_to_string(interests, ' ')) AS blob FROM pers1),
pers AS (SELECT *, CASE WHEN {_any('gi', lx.MONITOR_WORDS)} THEN 'monitor' WHEN {_any('gi', lx.PROMOTE_WORDS)} THEN 'promote'
  WHEN {_any('gi', lx.CONTRIBUTE_WORDS)} AND plats[1] = 'github' THEN 'contribute' WHEN {_any('gi', lx.DISCUSS_WORDS)} THEN 'discuss'
  WHEN plats[1] = 'github' THEN 'contribute' ELSE 'discuss' END AS mode,
  CASE WHEN {_any('blob', lx.NEWBIE_WORDS)} THEN 'newbie' WHEN {_any('blob', lx.EXPERT_WORDS)} THEN 'expert' ELSE 'mid' END AS experience FROM pers2)
"""


# Four personas of different shapes (narrow, infra, breadth, promoter).
PERSONAS = [
    ("nova", "Nova — Student", ["machine learning", "data", "python"], "Find good first issue repos to contribute to for a portfolio",
     ["github", "reddit"], ["machine_learning", "ai_research", "python_data_eng"], ["C++", "Rust"], 5.0, "student", [0, 1]),
    ("otto", "Otto — Platform Engineer", ["kubernetes", "cloud", "observability"], "Find high-signal threads where expert commentary adds value",
     ["github", "reddit", "hackernews"], ["devops_k8s", "cloud_apis", "cybersecurity"], [], 3.0, "senior", [2, 3]),
    ("iris", "Iris — Journalist", ["emerging tools", "open source"], "Surface rising things before they go mainstream",
     ["github", "hackernews", "bluesky", "reddit"], [], [], 10.0, "writer", [4, 5, 6]),
    ("remy", "Remy — Founder", ["developer tools", "cli"], "Grow awareness where a product is relevant",
     ["reddit", "hackernews", "github", "devto"], ["developer_tools", "b2b_saas", "open_source_trending"], [], 4.0, "founder", [7, 8]),
]
PERSONA_MODES = {"nova": "contribute", "otto": "discuss", "iris": "monitor", "remy": "promote"}


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PERSONAS, "id string, name string, interests array<string>, goal string, platforms array<string>, domains array<string>,"
        " exclude_languages array<string>, time_budget_hours double, skills string, facet_labels array<int>")


def _scope_rows(blank):
    every = lx.DOMAINS + ([""] if blank else [])
    return [(p[0], dom, not p[5]) for p in PERSONAS for dom in (p[5] or every)]


def scopes(spark: SparkSession, blank=False) -> DataFrame:
    """(scope, domain, breadth): the domains each persona looks at; breadth = all."""
    return spark.createDataFrame(_scope_rows(blank), "scope string, domain string, breadth boolean")


def scope_sql(blank=False):
    return ", scope AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{dm}', {str(b).lower()})" for s, dm, b in _scope_rows(blank)) + ") t(scope, domain, breadth))"


def feedback_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event log read as clicks on cards."""
    return clicks(table(spark, folder, "events"))


def clicks(events: DataFrame) -> DataFrame:
    e = events.selectExpr("*", "cast(get_json_object(props, '$.k') as bigint) as k")
    return e.selectExpr(
        "event_id as seq", "ts", "concat('u', user_id) as user_id", "concat('p', k % 2) as persona_key", "concat('card', k div 20) as opportunity_id",
        "case event_type when 'purchase' then 'engage' when 'click' then if(value < 10, 'unsave', 'save') when 'error' then 'dismiss' when 'signup' then 'undo' else 'open_detail' end as action",
        "case when event_type = 'error' and value > 20 then concat('reason', k % 3) end as reason", "cast(k % 10 + 1 as int) as rank", "cast(k div 50 as int) as page",
        f"element_at(array({_quoted(lx.SOURCES)}), cast(k % 5 as int) + 1) as source", f"element_at(array({_quoted(lx.BUCKETS)}), cast(k % 4 as int) + 1) as bucket",
        "case when user_id % 3 = 0 and ts >= timestamp_ntz'2024-01-16 00:00:00' then 'monitor' when k % 2 = 0 then 'contribute' else 'discuss' end as mode",
        "case when k % 17 = 0 then cast(array() as array<double>) else transform(sequence(1, 10), i -> cast((k * 7 + i * 3) % 11 as double) / 10D) end as signals")


FB = f"""fb0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
fb AS (SELECT event_id AS seq, ts, 'u' || user_id AS user_id, 'p' || (k % 2) AS persona_key, 'card' || (k // 20) AS opportunity_id,
  CASE event_type WHEN 'purchase' THEN 'engage' WHEN 'click' THEN CASE WHEN value < 10 THEN 'unsave' ELSE 'save' END WHEN 'error' THEN 'dismiss' WHEN 'signup' THEN 'undo' ELSE 'open_detail' END AS action,
  CASE WHEN event_type = 'error' AND value > 20 THEN 'reason' || (k % 3) END AS reason, k % 10 + 1 AS rank, k // 50 AS page,
  ({sql_list(lx.SOURCES)})[(k % 5) + 1] AS source, ({sql_list(lx.BUCKETS)})[(k % 4) + 1] AS bucket,
  CASE WHEN events_user % 3 = 0 AND ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 'monitor' WHEN k % 2 = 0 THEN 'contribute' ELSE 'discuss' END AS mode,
  CASE WHEN k % 17 = 0 THEN CAST([] AS DOUBLE[]) ELSE list_transform(range(1, 11), lambda i: CAST((k * 7 + i * 3) % 11 AS DOUBLE) / 10e0) END AS signals, k FROM (SELECT *, user_id AS events_user FROM fb0) q),
trk AS (SELECT *, CASE WHEN action IN ('engage', 'dismiss', 'undo') THEN 'status' WHEN action IN ('save', 'unsave') THEN 'saved' END AS track FROM fb),
tr AS (SELECT *, action IN ('engage', 'dismiss', 'save') AND (before IS NULL OR before <> action) AS applied FROM
  (SELECT *, lag(action) OVER (PARTITION BY user_id, persona_key, opportunity_id, track ORDER BY seq) AS before FROM trk WHERE track IS NOT NULL) t),
st AS (SELECT user_id, persona_key, opportunity_id, CASE arg_max(action, seq) FILTER (track = 'status') WHEN 'engage' THEN 'interested' WHEN 'dismiss' THEN 'dismissed' ELSE 'none' END AS status,
  COALESCE(arg_max(action, seq) FILTER (track = 'saved') = 'save', false) AS saved, arg_max(reason, seq) FILTER (reason IS NOT NULL) AS reason, arg_min(rank, seq) AS rank, arg_min(page, seq) AS page,
  arg_min(bucket, seq) AS bucket, arg_min(source, seq) AS source, arg_min(mode, seq) AS mode, min(ts) AS first_at, max(ts) AS last_at, max(seq) AS last_seq, CAST(sum(CASE WHEN applied THEN 1 ELSE 0 END) AS BIGINT) AS applied FROM tr GROUP BY ALL)"""
_REWARD = sql_case("action", lx.REWARDS, 0.0)
_W0 = "CASE mode " + " ".join(f"WHEN '{m}' THEN [" + ", ".join(f"{float(w.get(s, 0.0))}::DOUBLE" for s in lx.SIGNALS) + "]" for m, w in lx.MODE_WEIGHTS.items()) + " END"
LMS = f""", stp0 AS (SELECT *, {_REWARD}::DOUBLE AS y, lag(mode) OVER (PARTITION BY user_id, persona_key ORDER BY seq) AS mb FROM tr WHERE applied AND len(signals) > 0),
stp1 AS (SELECT s.* FROM stp0 s JOIN (SELECT user_id, persona_key, max(CASE WHEN mb <> mode THEN seq END) AS since FROM stp0 GROUP BY ALL) z USING (user_id, persona_key) WHERE since IS NULL OR seq >= since),
stp AS (SELECT *, row_number() OVER (PARTITION BY user_id, persona_key ORDER BY seq) AS i, count(*) OVER (PARTITION BY user_id, persona_key) AS total FROM stp1),
lms AS (SELECT user_id, persona_key, mode, CAST(0 AS BIGINT) AS n, total, {_W0} AS w FROM stp WHERE i = 1
 UNION ALL SELECT user_id, persona_key, mode, n, total, list_transform(raw, lambda x: x / CASE WHEN list_sum(raw) = 0 THEN 1e0 ELSE list_sum(raw) END) FROM
  (SELECT l.user_id, l.persona_key, l.mode, l.n + 1 AS n, l.total, list_transform(l.w, lambda x, j: greatest(0e0, x + 0.3e0 * (s.y - list_dot_product(l.w, s.signals)) * s.signals[j])) AS raw
   FROM lms l JOIN stp s ON s.user_id = l.user_id AND s.persona_key = l.persona_key AND s.i = l.n + 1) q),
fin AS (SELECT * FROM lms WHERE n = total)"""
