"""State and streaming queries over the event log read as clicks."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import dates
from beaconlake.operators import feedback as fb, ordered
from beaconlake.plans import testbed as tb
from beaconlake.plans.q_trends import N
from beaconlake.plans.registry import query
from beaconlake.session import scratch_path
from beaconlake.streaming import events as se, folds

c = F.col
HOLD = 200                             # clicks behind the newest that are held back
EVENTS = "{}/events.parque[t]"        # a pattern, so that one file and a folder both stream


def W(body, extra="", recursive=False):
    return ("WITH RECURSIVE " if recursive else "WITH ") + tb.FB + extra + " " + body


def log(spark, d):
    return tb.feedback_log(spark, d)


def states(spark, d):
    return fb.interactions(log(spark, d))


_ST = "user_id, persona_key, opportunity_id, status, saved, reason, CAST(rank AS INTEGER) AS rank, CAST(page AS INTEGER) AS page, bucket, source, mode, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at"


@query("STR-02", W(f"SELECT {_ST} FROM st"))
def disposition_state(spark, d):
    s = states(spark, d).drop("last_seq")
    return s.withColumns({x: F.date_format(x, "yyyy-MM-dd HH:mm:ss") for x in ("first_at", "last_at")})


@query("WIN-11", W("SELECT seq, before, applied FROM tr"))
def previous_disposition(spark, d):
    return fb.transitions(log(spark, d)).select("seq", "before", "applied")


@query("STR-01", "SELECT event_type, count(*) AS n, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY event_type")
def append_stream(spark, d):
    """The event log as a stream, appended to a table."""
    src = tb.table(spark, d, "events")
    out = se.run_to_table(se.event_stream(spark, EVENTS.format(d), src.schema), "append")
    return out.groupBy("event_type").agg(N().alias("n"), F.count_if(c("value") > 20).alias("large"))


def shuffled(spark, events):
    """The log in files that do not follow the order of clicks."""
    path = scratch_path(spark, "clicks")
    events.repartition(24, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id", F.lit("any order"))).write.parquet(path)
    return path


@query("STR-02-stream", W("SELECT user_id, persona_key, opportunity_id, status, saved, applied FROM st"))
def disposition_stream(spark, d):
    src = tb.table(spark, d, "events")
    s = tb.clicks(se.event_stream(spark, shuffled(spark, src), src.schema, files=6))
    state, last = folds.run_folded(s, "cards", folds.dispositions(hold=HOLD))
    return state.current("cards", last).drop("last_seq")


_WTS = "array_to_string(list_transform(w, lambda x: CAST(floor(x * 1e6 + 0.5) AS BIGINT)), ',')"


def shown(w):
    return F.array_join(F.transform(w, lambda x: F.floor(x * 1e6 + 0.5).cast("string")), ",")


def learned(spark, d, accounts=None):
    """The weights of every account; with accounts (user_id, persona_key) theirs only, as each learns from its own log."""
    rows = log(spark, d)
    return fb.learned_weights(fb.training_steps(rows if accounts is None else rows.join(F.broadcast(accounts), ["user_id", "persona_key"], "left_semi")))


@query("STR-03", W(f"SELECT user_id, persona_key, mode, n, {_WTS} AS weights FROM fin", tb.LMS, True))
def learner(spark, d):
    return learned(spark, d).withColumn("weights", shown(c("weights")))


@query("STR-03-stream", W(f"SELECT user_id, persona_key, mode, n, {_WTS} AS weights FROM fin", tb.LMS, True))
def learner_stream(spark, d):
    """Clicks streamed over several triggers: dispositions first, then the learner, in one stored state."""
    src = tb.table(spark, d, "events")
    s = tb.clicks(se.event_stream(spark, shuffled(spark, src), src.schema, files=6))
    state, last = folds.run_folded(s, "learners", folds.learners(hold=HOLD))
    return state.current("weights", last).withColumn("weights", shown(c("weights")))


_CUR = ", cur AS (SELECT user_id, persona_key, arg_max(mode, seq) AS mode FROM fb GROUP BY ALL)"


def current_modes(spark, d):
    return log(spark, d).groupBy("user_id", "persona_key").agg(F.max_by("mode", "seq").alias("mode"))


@query("STR-04", W(f"""SELECT user_id, persona_key, mode, COALESCE(f.n > 0, false) AS learned, COALESCE(f.n, 0) AS n, {_WTS.replace('(w,', '(COALESCE(w, ' + tb._W0 + '),')} AS weights
  FROM (SELECT c.*, f.n, f.w FROM cur c LEFT JOIN fin f ON f.user_id = c.user_id AND f.persona_key = c.persona_key AND f.mode = c.mode) f""", tb.LMS + _CUR, True))
def valid_weights(spark, d):
    return fb.valid_weights(learned(spark, d), current_modes(spark, d)).withColumn("weights", shown(c("weights")))


_LAB = "[" + ", ".join("'" + lx.PRIORITY_LABELS[s].replace("'", "''") + "'" for s in lx.SIGNALS) + "]"
_DEL = f"list_transform(w, lambda x, i: {{'d': x - ({tb._W0})[i], 'i': i}})"


@query("AGG-25", W(f"""SELECT user_id, persona_key, CASE WHEN up = '' AND dn = '' THEN 'Still learning what you respond to.' ELSE concat_ws('. ', CASE WHEN up <> '' THEN 'Priority: ' || up END, CASE WHEN dn <> '' THEN 'Non-priority: ' || dn END) || '.' END AS summary FROM
  (SELECT *, array_to_string(list_transform(list_slice(list_filter(list_reverse_sort(dl), lambda r: r.d > 0.02), 1, 2), lambda r: ({_LAB})[r.i]), ', ') AS up,
   array_to_string(list_transform(list_slice(list_filter(list_sort(dl), lambda r: r.d < -0.02), 1, 2), lambda r: ({_LAB})[r.i]), ', ') AS dn FROM (SELECT *, {_DEL} AS dl FROM fin) q) t""", tb.LMS, True))
def learned_summary(spark, d):
    return learned(spark, d).select("user_id", "persona_key", fb.learned_summary(c("mode"), c("weights")).alias("summary"))


@query("AGG-14", W("""SELECT user_id, persona_key, count(DISTINCT opportunity_id) AS explored FROM (SELECT user_id, persona_key, opportunity_id FROM st WHERE status IN ('interested', 'dismissed')
  UNION SELECT user_id, persona_key, opportunity_id FROM fb WHERE action = 'open_detail') t GROUP BY ALL"""))
def explored_items(spark, d):
    return fb.explored(states(spark, d), log(spark, d))


@query("SET-01", W("SELECT user_id, persona_key, opportunity_id FROM st WHERE status IN ('interested', 'dismissed') UNION SELECT user_id, persona_key, opportunity_id FROM fb WHERE action = 'open_detail'"))
def union_distinct(spark, d):
    judged = states(spark, d).where(c("status").isin("interested", "dismissed")).select(*fb.KEY)
    return judged.union(log(spark, d).where("action = 'open_detail'").select(*fb.KEY)).distinct()


_FEED = ", feed AS (SELECT DISTINCT user_id, persona_key, opportunity_id FROM fb)"


def feed(spark, d):
    """Cards that were ever shown to a user."""
    return log(spark, d).select(*fb.KEY).distinct()


@query("PRJ-10", W("SELECT f.* FROM feed f WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.user_id = f.user_id AND st.persona_key = f.persona_key AND st.opportunity_id = f.opportunity_id AND status = 'dismissed')", _FEED))
def without_dismissed(spark, d):
    return feed(spark, d).join(states(spark, d).where("status = 'dismissed'").select(*fb.KEY), fb.KEY, "left_anti")


@query("JOI-13", W("SELECT f.*, COALESCE(status, 'none') AS status, COALESCE(saved, false) AS saved, reason FROM feed f LEFT JOIN st USING (user_id, persona_key, opportunity_id)", _FEED))
def restore_state(spark, d):
    s = states(spark, d).select(*fb.KEY, "status", "saved", "reason")
    return feed(spark, d).join(s, fb.KEY, "left").withColumns({"status": F.coalesce("status", F.lit("none")), "saved": F.coalesce("saved", F.lit(False))})


@query("JOI-14", "WITH " + tb.OPP + ", " + tb.FB + """ SELECT st.user_id, st.persona_key, st.opportunity_id, COALESCE(NULLIF(o.title, ''), st.opportunity_id) AS title, COALESCE(st.source, o.source, '') AS source, COALESCE(o.url, '') AS url, st.reason
  FROM st LEFT JOIN (SELECT 'card' || doc_id AS card, * FROM opp) o ON o.card = st.opportunity_id""")
def activity_view(spark, d):
    o = tb.opportunities(spark, d).select(F.concat(F.lit("card"), "ingest_seq").alias("opportunity_id"), "title", c("source").alias("item_source"), "url")
    s = states(spark, d).join(o, "opportunity_id", "left")
    return s.select(*fb.KEY, F.coalesce(F.nullif("title", F.lit("")), "opportunity_id").alias("title"), F.coalesce("source", "item_source", F.lit("")).alias("source"),
                    F.coalesce("url", F.lit("")).alias("url"), "reason")


@query("TOP-18", W("SELECT user_id, persona_key, opportunity_id, row_number() OVER (PARTITION BY user_id, persona_key ORDER BY last_seq DESC) AS position FROM st"))
def newest_first(spark, d):
    s = states(spark, d).select(*fb.KEY, (-c("last_seq")).alias("back"), F.lit(1).cast("bigint").alias("one"))
    return ordered.running_sum(s, ["user_id", "persona_key"], ["back"], "one", "before").select(*fb.KEY, (c("before") + 1).alias("position"))


# ---- keyed tables ------------------------------------------------------------------------
def changes(spark, d):
    """Orders read as profile edits of their customers."""
    return tb.table(spark, d, "orders").selectExpr("concat('u', o_custkey) as user_id", "concat('p', o_orderkey % 2) as profile_key", "o_orderkey as seq", "o_orderdate as ts",
                                                   "o_orderpriority as goal", "if(o_orderkey % 3 = 0, '', concat('[', o_orderkey % 50, ',', 100 - o_orderkey % 50, ']')) as split")


_CH = """ch AS (SELECT 'u' || o_custkey AS user_id, 'p' || (o_orderkey % 2) AS profile_key, o_orderkey AS seq, o_orderdate AS ts, o_orderpriority AS goal,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '[' || (o_orderkey % 50) || ',' || (100 - o_orderkey % 50) || ']' END AS split FROM orders),
up AS (SELECT user_id, profile_key, arg_max(goal, seq) AS goal, arg_max(split, seq) AS split, min(ts) AS created_at, max(ts) AS updated_at FROM ch GROUP BY ALL)"""


def day(x):
    return F.date_format(x, "yyyy-MM-dd").alias(x)


@query("STR-06", f"WITH {_CH} SELECT user_id, profile_key, goal, split, strftime(created_at, '%Y-%m-%d') AS created_at, strftime(updated_at, '%Y-%m-%d') AS updated_at FROM up")
def upsert(spark, d):
    return fb.upserted(changes(spark, d), ["user_id", "profile_key"], "seq", "ts").select("user_id", "profile_key", "goal", "split", day("created_at"), day("updated_at"))


@query("STR-07", f"WITH {_CH} SELECT user_id, profile_key, goal FROM up WHERE user_id NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    rows = fb.upserted(changes(spark, d), ["user_id", "profile_key"], "seq", "ts").select("user_id", "profile_key", "goal")
    gone = tb.table(spark, d, "customer").where("c_acctbal < 0").selectExpr("concat('u', c_custkey) as user_id")
    return fb.without_deleted(rows, gone, ["user_id"])


@query("STR-08", f"WITH {_CH} SELECT user_id, profile_key, split FROM up WHERE split <> ''")
def confirmed_split(spark, d):
    return fb.upserted(changes(spark, d), ["user_id", "profile_key"], "seq", "ts").where("split <> ''").select("user_id", "profile_key", "split")


_NAME = "CASE c_custkey % 3 WHEN 0 THEN '  ' || lower(c_mktsegment) || '   n' || c_nationkey WHEN 1 THEN upper(c_mktsegment) || ' N' || c_nationkey || ' ' ELSE c_mktsegment || ' n' || c_nationkey END"


@query("STR-09", f"""SELECT lower(nm) AS name_key, 'u' || min(c_custkey) AS user_id, upper(any_value(nm)[1:1]) || lower(any_value(split_part(nm, ' ', 1))[2:]) || ' ' || upper(any_value(split_part(nm, ' ', 2))) AS name, max(c_custkey) AS last_seen
  FROM (SELECT c_custkey, trim(regexp_replace({_NAME}, '\\s+', ' ', 'g')) AS nm FROM customer) t GROUP BY lower(nm)""")
def account_names(spark, d):
    cu = tb.table(spark, d, "customer")
    name = F.expr("case c_custkey % 3 when 0 then concat('  ', lower(c_mktsegment), '   n', c_nationkey) when 1 then concat(upper(c_mktsegment), ' N', c_nationkey, ' ') else concat(c_mktsegment, ' n', c_nationkey) end")
    return fb.accounts(cu.select(F.concat(F.lit("u"), "c_custkey").alias("user_id"), name.alias("name"), c("c_custkey").alias("created_at")))


# ---- streams -----------------------------------------------------------------------------
@query("STR-05", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    """The log arrives twice; every event passes once."""
    src, path = tb.table(spark, d, "events"), scratch_path(spark, "twice")
    src.write.parquet(path)
    src.write.mode("append").parquet(path)
    out = se.run_to_table(se.first_arrivals(se.event_stream(spark, path, src.schema), "event_id"), "once")
    return out.groupBy("user_id", "event_type").agg(N().alias("n"))


@query("STR-10", W("""SELECT f.seq, CAST(len(COALESCE(s.signals, CAST([] AS DOUBLE[]))) AS INTEGER) AS known, array_to_string(list_transform(COALESCE(s.signals, CAST([] AS DOUBLE[])), lambda x: CAST(floor(x * 1e6 + 0.5) AS BIGINT)), ',') AS signals
  FROM fb f ASOF LEFT JOIN (SELECT user_id, persona_key, opportunity_id, seq, signals FROM fb WHERE action = 'open_detail') s
  ON f.user_id = s.user_id AND f.persona_key = s.persona_key AND f.opportunity_id = s.opportunity_id AND f.seq > s.seq"""))
def session_context(spark, d):
    """A stream of clicks joined to the snapshot that was shown last before each."""
    src = tb.table(spark, d, "events")
    s = tb.clicks(se.event_stream(spark, EVENTS.format(d), src.schema)).drop("signals")
    out = se.with_context(s, se.snapshots(log(spark, d), fb.KEY), fb.KEY)
    return se.run_to_table(out.select("seq", F.size("signals").alias("known"), shown(c("signals")).alias("signals")), "context")


@query("STR-11", """SELECT strftime(week, '%Y-%m-%d') AS week, event_type AS domain, count(*) AS n, true AS within_bound FROM (SELECT *, date_trunc('week', ts)::DATE AS week FROM events) t
  WHERE week + 7 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def stream_weeks(spark, d):
    src = tb.table(spark, d, "events")
    s = se.event_stream(spark, EVENTS.format(d), src.schema).select(dates.utc_instant(c("ts")).alias("ts"), c("event_type").alias("domain"), c("user_id").alias("author"))
    out = se.run_to_table(se.weekly(s, ["domain"]), "weeks")
    exact = src.groupBy(F.date_format(F.trunc(F.to_date("ts"), "week"), "yyyy-MM-dd").alias("week"), c("event_type").alias("domain")).agg(F.countDistinct("user_id").alias("voices"))
    return out.join(exact, ["week", "domain"]).select("week", "domain", "n", (F.abs(c("reach") - c("voices")) <= F.greatest(c("voices") * 0.05, F.lit(2.0))).alias("within_bound"))


_WT = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 0 END"


@query("STR-12", f"""SELECT strftime(until, '%Y-%m-%d %H:%M') AS until, event_type, CAST(sum({_WT}) AS BIGINT) AS activity FROM (SELECT event_type, unnest([date_trunc('hour', ts) + to_hours(CAST(i AS INTEGER)) FOR i IN range(1, 7)]) AS until FROM events) t
  WHERE until <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def stream_hours(spark, d):
    src = tb.table(spark, d, "events")
    weight = F.expr("case event_type when 'view' then 1 when 'click' then 3 when 'purchase' then 3 when 'error' then 2 else 0 end")
    s = se.event_stream(spark, EVENTS.format(d), src.schema).select(dates.utc_instant(c("ts")).alias("ts"), "event_type", weight.alias("weight"))
    return se.run_to_table(se.hourly_activity(s, ["event_type"]), "hours")
