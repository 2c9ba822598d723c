"""Ranking, retrieval and evaluation queries over the four fixed personas."""
from pyspark.sql import Window, functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import dates, numeric as nm, text as tx
from beaconlake.operators import encode as en, evaluation as ev, features as ft, ordered, personas as ps, ranking as rk, sketches as sk, splits, tfidf, trends as tr, vectors as vx
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.plans import testbed as tb
from beaconlake.plans.q_columns import PAIR_TEXT, PROTO, Q6, items, micro
from beaconlake.plans.q_trends import CM_DEPTH, CM_WIDTH, N, WORDS, act, cells_sql, near
from beaconlake.plans.q_vectors import DOT, _FAC, corpus, facet_rows
from beaconlake.plans.registry import query
from beaconlake.plans.testbed import oracle, r_sql
from beaconlake.session import checkpointed

c = F.col

# Words that mark a document as on topic for a persona.
KEYWORDS = {"nova": ["erthe", "data"], "otto": ["tionin", "cloud"], "iris": ["eaux", "andth"], "remy": ["herein", "shthe"]}


def people(spark):
    return ps.enriched(tb.personas(spark))


def _keywords():
    return F.array_distinct(F.concat(F.transform("interests", F.lower), F.split(
        nm.lookup(c("id"), {k: "|".join(v) for k, v in KEYWORDS.items()}, ""), r"\|")))


def meta(spark, d, ids):
    """The items of these arrival ids with decoded columns and features; their signals are compared
    with those of all items."""
    o = items(spark, d).withColumnRenamed("ingest_seq", "id")
    few = checkpointed(o.join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi"))
    return few.join(ft.feature_table(few, tb.as_of(), corpus=o), "opportunity_id")


def candidates(spark, d, per_source=150):
    """Best rows per persona and source, by the best facet."""
    src = items(spark, d).select(c("ingest_seq").alias("id"), c("source").alias("stratum"))
    rows = corpus(spark, d).join(src, "id")
    f = facet_rows(spark, d).drop("strata").join(people(spark).select(c("id").alias("persona"), c("allowed").alias("strata")), "persona")
    return vx.best_facet_top(rows, f, per_source).select("persona", "id", c("stratum").alias("source"), "sim")


def filtered(spark, d):
    found = checkpointed(candidates(spark, d))
    got = found.join(meta(spark, d, found).drop("source"), "id")
    return rk.hard_filter(got, people(spark))


def scored(spark, d):
    return rk.with_scores(rk.normalized_relevance(rk.with_relevance(filtered(spark, d))))


def ranked(spark, d):
    return rk.by_impact(scored(spark, d))


def ranked_once(spark, d):
    """The ranked candidates (a few hundred per persona), stored because they are used again."""
    return checkpointed(ranked(spark, d))


def _lst(values):
    return tb.sql_list(values) if values else "CAST([] AS VARCHAR[])"


_PZ = ", pz AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p[0]}', '{tb.PERSONA_MODES[p[0]]}', {_lst(p[5])}, {_lst([x.lower() for x in p[6]])}, {_lst(p[4])}, {p[7]}, {_lst([x.lower() for x in p[2]] + KEYWORDS[p[0]])})" for p in tb.PERSONAS
) + ") t(persona, mode, whitelist, barred, allowed, hours, kws))"
_IN = "(len(whitelist) = 0 OR list_has_any(domain_list, whitelist)) AND NOT (source = 'github' AND list_contains(barred, lower(COALESCE(language, ''))))"
_W = "CASE mode " + " ".join(f"WHEN '{m}' THEN [" + ", ".join(f"{float(w.get(s, 0.0))}::DOUBLE" for s in lx.SIGNALS) + "]" for m, w in lx.MODE_WEIGHTS.items()) + " END"
_FIT = "CASE mode " + " ".join(f"WHEN '{m}' THEN {tb.sql_case('source', t, 0.5)}" for m, t in lx.MODE_PLATFORM_FIT.items()) + " END::DOUBLE"
_TOTAL = " + ".join(f"w[{i + 1}] * {s}" for i, s in enumerate(lx.SIGNALS))
_PARTS = "[" + ", ".join(f"w[{i + 1}] * {s}" for i, s in enumerate(lx.SIGNALS)) + "]"
_AWARE = f"list_contains({tb.sql_list(lx.EFFORT_AWARE_MODES)}, mode)"
CAND = f""", {PROTO}, {_FAC}{_PZ}, emb AS (SELECT f.*, e.vec_id AS id, e.embedding FROM feat f JOIN embeddings e ON e.vec_id = f.doc_id),
cand0 AS (SELECT persona, id, source, sim FROM (SELECT persona, e.id, e.source, max({DOT}) AS sim FROM emb e, facet GROUP BY ALL) q JOIN pz USING (persona) WHERE list_contains(allowed, source)),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY persona, source ORDER BY sim DESC, id) AS place FROM cand0) t WHERE place <= 150),
filt AS (SELECT p.*, c.sim, e.* FROM cand c JOIN pz p USING (persona) JOIN emb e USING (id) WHERE {_IN.replace('source', 'e.source')}),
rel AS (SELECT *, {tb.clamp_sql('(sim - min(sim) OVER (PARTITION BY persona)) / CASE WHEN max(sim) OVER (PARTITION BY persona) = min(sim) OVER (PARTITION BY persona) THEN 1e0 ELSE max(sim) OVER (PARTITION BY persona) - min(sim) OVER (PARTITION BY persona) END')} AS relevance,
  {_FIT} AS platform_fit, 1e0 - {tb.clamp_sql('effort_min / 240e0')} AS effort_fit, {_W} AS w FROM filt),
sc0 AS (SELECT *, {_TOTAL} AS total, {_PARTS} AS parts FROM rel),
sc1 AS (SELECT *, total * CASE WHEN mode = 'contribute' THEN 0.45e0 + 0.55e0 * COALESCE(NULLIF(contribution_worth, 0), 0.5e0) ELSE 1e0 END AS imp FROM sc0),
sc AS (SELECT *, {r_sql('imp', 4)} AS impact, {r_sql(f"CASE WHEN {_AWARE} THEN imp / greatest(COALESCE(NULLIF(effort_min, 0), 30e0) / 60e0, 0.1e0) ELSE imp END", 4)} AS roi FROM sc1),
rkd AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY impact DESC, sim DESC, id) AS place FROM sc)"""


def O(body, extra=""):
    return oracle(body, feat=True, extra=CAND + extra)


@query("PRJ-07", oracle(f"SELECT persona, opportunity_id FROM item, pz WHERE list_contains(allowed, source) AND {_IN}", extra=_PZ))
def hard_filter(spark, d):
    rows = items(spark, d).select("opportunity_id", "source", "domain_list", "language")
    return rk.hard_filter(rows, people(spark)).select("persona", "opportunity_id")


@query("TOP-02", O("SELECT persona, source, id, place FROM cand"))
def stratified_candidates(spark, d):
    got = candidates(spark, d)
    w = Window.partitionBy("persona", "source").orderBy(F.desc("sim"), "id")
    return got.select("persona", "source", "id", F.row_number().over(w).alias("place"))


@query("TOP-02-text")
def encoded_candidates(spark, d):
    """The best rows per persona and source by encoded texts: documents against a persona's goal
    and interests."""
    encode = en.encoder(64)
    rows = items(spark, d).select(c("ingest_seq").alias("id"), encode(en.embedding_text(c("title"), c("body"))).alias("vec"), c("source").alias("stratum"))
    p = people(spark)
    f = ps.facets(p).join(p.select("id", "allowed"), "id").select(c("id").alias("persona"), encode("facet").alias("vec"), c("allowed").alias("strata"))
    return vx.best_facet_top(rows, f, 20).select("persona", c("stratum").alias("source"), "id", "place", micro(c("sim")).alias("sim_micro"))


@query("WIN-06", O(f"SELECT persona, id, {Q6.format('relevance')} AS relevance_micro FROM rel"))
def relevance(spark, d):
    got = rk.normalized_relevance(rk.with_relevance(filtered(spark, d)))
    return got.select("persona", "id", micro(c("relevance")).alias("relevance_micro"))


@query("MTH-04", O(f"SELECT persona, id, {Q6.format('total')} AS impact_micro FROM sc0"))
def weighted_impact(spark, d):
    return scored(spark, d).select("persona", "id", micro(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)).alias("impact_micro"))


_SIGS = tb.sql_list(lx.SIGNALS)
_DRV = f"list_slice(list_sort(list_transform(parts, lambda v, i: {{'k': -v, 'i': i}})), 1, 3)"


@query("MTH-05", O(f"SELECT persona, id, array_to_string(list_transform({_DRV}, lambda x: ({_SIGS})[x.i] || ':' || CAST(floor(-x.k * 1e6 + 0.5) AS BIGINT)), ' ') AS drivers FROM sc0"))
def contributions(spark, d):
    s = scored(spark, d).withColumn("dr", rk.top_drivers(c("parts")))
    shown = F.transform("dr", lambda x: F.concat(x.signal, F.lit(":"), F.floor(x.v * 1e6 + 0.5).cast("string")))
    return s.select("persona", "id", F.array_join(shown, " ").alias("drivers"))


@query("MTH-06", O("SELECT persona, id, impact, roi FROM sc"))
def score(spark, d):
    return scored(spark, d).select("persona", "id", "impact", "roi")


_WHY = (f"array_to_string(list_transform(list_filter({_DRV}, lambda x: -x.k > 0.01), lambda x: {tb.sql_case('(' + _SIGS + ')[x.i]', lx.SIGNAL_REASONS, '')}), '; ')")


@query("TXT-11", O(f"SELECT persona, id, CASE WHEN y = '' THEN 'weak match' ELSE y END || CASE WHEN {_AWARE} THEN ' · ~' || printf('%.1f', {r_sql('effort_min / 60e0', 1)}) || 'h to engage' ELSE ' · monitor only' END AS why FROM (SELECT *, {_WHY} AS y FROM sc0) t"))
def why_this(spark, d):
    s = scored(spark, d)
    return s.select("persona", "id", rk.why(rk.top_drivers(c("parts")), c("mode"), c("effort_min")).alias("why"))


@query("TOP-10", O("SELECT persona, place, id, impact FROM rkd"))
def by_impact(spark, d):
    return ranked(spark, d).select("persona", "place", "id", "impact")


@query("TOP-11", O("SELECT persona, position, id FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY 0.6e0 * standout + 0.4e0 * relevance DESC, sim DESC, id) AS position FROM sc WHERE source = 'github' AND mode IN ('contribute', 'discuss')) t WHERE position <= 3"))
def standout_lane(spark, d):
    return rk.standout_lane(scored(spark, d)).select("persona", "position", "id")


@query("PRJ-15", O(f"""SELECT persona, id, source, {tb.sql_case('domain_list[1]', lx.DOMAIN_LABELS, '')} AS domain_label, {tb.sql_case('source', lx.SOURCE_BUCKET, 'discuss')} AS bucket, {r_sql('impact', 3)} AS impact, {r_sql('roi', 1)} AS roi, {r_sql('relevance', 2)} AS relevance,
  CASE WHEN source = 'github' THEN COALESCE(community_size, 0) END AS stars, CASE WHEN source = 'github' THEN regexp_extract(url, 'github\\.com/([^/]+/[^/]+)', 1) ELSE '' END AS repo,
  array_to_string(list_transform(list_filter({_DRV}, lambda x: -x.k > 0.01), lambda x: ({_SIGS})[x.i]), ',') AS drivers,
  velocity >= 0.6e0 AND engagement >= {tb.sql_case('source', lx.RISING_FLOORS, lx.DEFAULT_RISING_FLOOR)} AS rising FROM rkd"""))
def display_item(spark, d):
    r = ranked(spark, d).withColumn("dr", rk.top_drivers(c("parts")))
    github, eng = c("source") == "github", nm.engagement(c("score"), c("num_comments"))
    first = F.get("domain_list", F.lit(0))
    return r.select("persona", "id", "source", tx.domain_label(first).alias("domain_label"), nm.bucket_of(c("source")).alias("bucket"), nm.fixed_round(c("impact"), 3).alias("impact"),
                    nm.fixed_round(c("roi"), 1).alias("roi"), nm.fixed_round(c("relevance"), 2).alias("relevance"), F.when(github, F.coalesce("community_size", F.lit(0))).alias("stars"),
                    F.when(github, tx.repo_of_page(c("url"))).otherwise("").alias("repo"),
                    F.array_join(F.transform(F.filter("dr", lambda x: x.v > 0.01), lambda x: x.signal), ",").alias("drivers"), nm.is_rising(c("velocity"), eng, c("source")).alias("rising"))


MMR = """, pool AS (SELECT persona, id, impact, embedding::DOUBLE[] AS v, place FROM rkd WHERE place <= 40),
pl AS (SELECT persona, list(id ORDER BY place) AS ids, list((impact - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END ORDER BY place) AS use FROM (SELECT *, min(impact) OVER (PARTITION BY persona) AS lo, max(impact) OVER (PARTITION BY persona) AS hi FROM pool) t GROUP BY persona),
ln AS (SELECT a.persona, a.place, list(list_dot_product(a.v, b.v) ORDER BY b.place) AS sims FROM pool a JOIN pool b USING (persona) GROUP BY ALL),
mt AS (SELECT persona, list(sims ORDER BY place) AS mat FROM ln GROUP BY persona),
mmr AS (SELECT persona, 0 AS step, CAST(0 AS BIGINT) AS pick, ids, use, mat, list_transform(use, lambda u: 0e0) AS near, list_transform(use, lambda u: true) AS free FROM pl JOIN mt USING (persona)
 UNION ALL SELECT persona, step + 1, b, ids, use, mat, list_transform(near, lambda x, i: CASE WHEN step = 0 THEN mat[b][i] ELSE greatest(x, mat[b][i]) END), list_transform(free, lambda x, i: x AND i <> b)
 FROM (SELECT *, CAST(list_position(g, list_max(g)) AS BIGINT) AS b FROM (SELECT *, list_transform(use, lambda u, i: CASE WHEN free[i] THEN {lam} * u - (1 - {lam}) * near[i] ELSE -1e9 END) AS g FROM mmr WHERE step < 10) g1 WHERE list_max(g) > -1e8) g2)"""
_MMR30 = MMR.replace("{lam}", "0.75e0").replace("FROM rkd WHERE place <= 40", "FROM rkp WHERE place <= 120").replace("step < 10", "step < 30")


_SPLITS = {"nova": [50, 25, 15, 10], "otto": [22, 13, 45, 20], "iris": [12, 18, 30, 40], "remy": [12, 16, 42, 30]}
_SPL = ", spl AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{b}', {i}, {_SPLITS[p][i]})" for p in _SPLITS for i, b in enumerate(lx.BUCKETS)) + ") t(persona, bucket, bucket_pos, pct))"
# The list the quota cuts: impact times the prior of the bucket, then the thirty picks that trade it against likeness.
_PRIOR = f""", pri AS (SELECT persona, bucket, {r_sql('0.8e0 + 0.45e0 * (pct::DOUBLE / max(pct) OVER (PARTITION BY persona))', 4)} AS prior FROM spl WHERE pct > 0),
scp AS (SELECT * REPLACE ({r_sql('impact * prior', 4)} AS impact) FROM (SELECT *, {tb.sql_case('source', lx.SOURCE_BUCKET, 'discuss')} AS bucket FROM sc) q JOIN pri USING (persona, bucket)),
rkp AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY impact DESC, sim DESC, id) AS place FROM scp)"""
_QUOTA = """SELECT persona, id, bucket, row_number() OVER (PARTITION BY persona ORDER BY bucket_pos, place) AS rank FROM
  (SELECT persona, id, bucket, bucket_pos, q.place, pct, row_number() OVER (PARTITION BY persona, bucket ORDER BY q.place) AS n FROM
   (SELECT m.persona, m.step AS place, m.ids[m.pick] AS id, k.bucket FROM mmr m JOIN rkp k ON k.persona = m.persona AND k.id = m.ids[m.pick] WHERE m.step > 0) q JOIN spl USING (persona, bucket) WHERE pct > 0) t
  WHERE n <= greatest(1, round_even(pct / 10e0, 0))"""


def split_rows(spark):
    """Recommended split of each persona, one row per bucket."""
    p = people(spark).withColumn("split", splits.recommended_split(c("mode"), F.lit("mid")))
    names = F.array(*[F.lit(b) for b in lx.BUCKETS])
    return p.select(c("id").alias("persona"), F.posexplode("split").alias("bucket_pos", "pct"), names.alias("names")).withColumn("bucket", F.get("names", c("bucket_pos"))).drop("names")


def priors(spark):
    """(persona, bucket, prior) of the buckets a persona gives time to."""
    p = people(spark).withColumn("prior", splits.bucket_prior(splits.recommended_split(c("mode"), F.lit("mid"))))
    names = F.array(*[F.lit(b) for b in lx.BUCKETS])
    return p.select(c("id").alias("persona"), F.inline(F.arrays_zip(names.alias("bucket"), c("prior")))).where("prior is not null")


def prior_ranked(spark, d):
    """The ranked candidates with the prior of their bucket in impact and roi; a bucket set to
    zero has no candidates."""
    rows = rk.normalized_relevance(rk.with_relevance(filtered(spark, d))).withColumn("bucket", nm.bucket_of(c("source")))
    return rk.by_impact(rk.with_scores(rows.join(priors(spark), ["persona", "bucket"]), prior=c("prior")))


def recommended(spark, d, k=30):
    """The k picks per persona that the brief draws from, in order."""
    r = checkpointed(prior_ranked(spark, d))
    picks = rk.diversified(with_vectors(spark, d, r), k, 0.75).withColumnRenamed("rank", "place")
    return picks.join(r.drop("place"), ["persona", "id"])


def quota(spark, d):
    return rk.bucket_quota(recommended(spark, d).select("persona", "id", "place", "bucket"), split_rows(spark))


@query("TOP-15", O(f"SELECT persona, bucket, count(*) AS picked FROM ({_QUOTA}) t GROUP BY ALL", _SPL + _PRIOR + _MMR30).replace("WITH ", "WITH RECURSIVE ", 1))
def bucket_quota(spark, d):
    return quota(spark, d).groupBy("persona", "bucket").agg(N().alias("picked"))


@query("WIN-09", O(_QUOTA, _SPL + _PRIOR + _MMR30).replace("WITH ", "WITH RECURSIVE ", 1))
def rank_in_bucket_order(spark, d):
    return quota(spark, d).select("persona", "id", "bucket", "rank")


# What a persona asks the pair scorer, and its score: the share of the asked words in the text.
_ASK = ", ask AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(p[0], f"{p[3]}. Interests: {', '.join(p[2])}. {p[8]}".replace("'", "''")) for p in tb.PERSONAS) + ") t(persona, ask))"
_WORDSET = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
_OVERLAP = f"len(list_intersect({_WORDSET.format('ask')}, {_WORDSET.format(PAIR_TEXT)})) / len({_WORDSET.format('ask')})::DOUBLE"
_POOL = f""", pooled AS (SELECT * FROM (SELECT filt.*, ask, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, id) AS d FROM filt JOIN ask USING (persona)) t WHERE d <= 120),
pscore AS (SELECT persona, id, {_OVERLAP} AS rel FROM pooled)"""


def asked(spark):
    return people(spark).select(c("id").alias("persona"), ps.profile_text(c("goal"), c("interests"), c("skills")).alias("ask"))


@query("TOP-17", O(f"""SELECT persona, id, {Q6.format(tb.clamp_sql('(rel - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END'))} AS relevance_micro FROM
  (SELECT *, min(rel) OVER (PARTITION BY persona) AS lo, max(rel) OVER (PARTITION BY persona) AS hi FROM pscore) t""", _ASK + _POOL))
def scorer_pool(spark, d):
    """Pair scorer on the best 120 candidates only."""
    got = rk.with_relevance(filtered(spark, d).join(asked(spark), "persona"), en.pair_scorer()(c("ask"), tx.pair_text(c("title"), c("body"))))
    return rk.normalized_relevance(got).select("persona", "id", micro(c("relevance")).alias("relevance_micro"))


@query("UDF-02", O(f"SELECT persona, id, {Q6.format(_OVERLAP)} AS score_micro FROM filt JOIN ask USING (persona)", _ASK))
def pair_score(spark, d):
    """Candidates scored by a model behind the hook."""
    f = filtered(spark, d).join(asked(spark), "persona")
    return f.select("persona", "id", micro(en.pair_scorer(make=lambda: en.overlaps)(c("ask"), tx.pair_text(c("title"), c("body")))).alias("score_micro"))


def mmr_sql(lam):
    return O("SELECT persona, step AS rank, ids[pick] AS id FROM mmr WHERE step > 0", MMR.replace("{lam}", lam)).replace("WITH ", "WITH RECURSIVE ", 1)


def with_vectors(spark, d, rows):
    return rows.join(corpus(spark, d).select("id", "vec"), "id")


@query("RNK-02", mmr_sql("0.75e0"))
def diverse(spark, d):
    return rk.diversified(with_vectors(spark, d, ranked(spark, d)), 10, 0.75)


@query("UDF-04", O("SELECT persona, id, CAST(n AS INTEGER) AS rank FROM (SELECT persona, id, row_number() OVER (PARTITION BY persona ORDER BY roi DESC, sim DESC, id) AS n FROM sc) t WHERE n <= 10"))
def utility_column(spark, d):
    """The same picker with another utility column; without a diversity part it is top-k."""
    s = scored(spark, d).withColumn("impact", c("roi"))
    return rk.diversified(with_vectors(spark, d, rk.by_impact(s)), 10, 1.0).select("persona", "id", "rank")


# The basket solved again: best value for each number of minutes, item by item, and the way back.
_PACK = f""", bag AS (SELECT persona, place, id, effort_min, greatest(1, round_even(effort_min, 0))::BIGINT AS w, round_even(impact * 1000, 0)::BIGINT AS v, floor(hours * 60)::BIGINT AS cap FROM rkd WHERE place <= 40 AND {_AWARE}),
dp AS (SELECT persona, CAST(0 AS BIGINT) AS i, cap, list_transform(range(0, cap + 1), lambda x: CAST(0 AS BIGINT)) AS best, CAST([] AS BOOLEAN[]) AS took FROM (SELECT persona, any_value(cap) AS cap FROM bag GROUP BY persona) b0
 UNION ALL SELECT d.persona, d.i + 1, d.cap, list_transform(d.best, lambda x, j: CASE WHEN j > b.w THEN greatest(x, d.best[j - b.w] + b.v) ELSE x END),
  list_transform(d.best, lambda x, j: j > b.w AND d.best[j - b.w] + b.v > x) FROM dp d JOIN bag b ON b.persona = d.persona AND b.place = d.i + 1),
way AS (SELECT persona, max(i) + 1 AS i, any_value(cap) AS room, false AS chosen FROM dp GROUP BY persona
 UNION ALL SELECT y.persona, y.i - 1, y.room - CASE WHEN d.took[y.room + 1] THEN b.w ELSE 0 END, d.took[y.room + 1] FROM way y JOIN dp d ON d.persona = y.persona AND d.i = y.i - 1 JOIN bag b ON b.persona = y.persona AND b.place = y.i - 1),
basket AS (SELECT bag.* FROM way JOIN bag ON bag.persona = way.persona AND bag.place = way.i WHERE chosen)"""


@query("RNK-03", O("""SELECT b.persona, CAST(any_value(cap) AS INTEGER) AS budget, CAST(sum(w) AS BIGINT) AS used, CAST(sum(v) AS BIGINT) AS value, string_agg(CAST(b.id AS VARCHAR), ' ' ORDER BY place) AS ids
  FROM basket b GROUP BY b.persona""", _PACK).replace("WITH ", "WITH RECURSIVE ", 1))
def weekly_basket(spark, d):
    got = rk.packed(ranked(spark, d)).join(ranked(spark, d).select("persona", "id", "place"), ["persona", "id"])
    chosen = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x.id.cast("string"))
    return got.groupBy("persona").agg(F.max("budget").alias("budget"), F.sum("minutes").cast("bigint").alias("used"),
                                      F.sum(F.rint(c("impact") * 1000)).cast("bigint").alias("value"), F.array_join(chosen, " ").alias("ids"))


@query("RNK-05", O(f"""SELECT persona, id, {Q6.format('1e0 / (60 + ra) + 1e0 / (60 + rb)')} AS fused_micro FROM (SELECT persona, id, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, id) - 1 AS ra,
  row_number() OVER (PARTITION BY persona ORDER BY impact DESC, id) - 1 AS rb FROM sc) t"""))
def fusion(spark, d):
    got = rk.reciprocal_fusion(scored(spark, d).select("persona", "id", "sim", "impact"), [F.desc("sim"), c("id")], [F.desc("impact"), c("id")])
    return got.select("persona", "id", micro(c("fused")).alias("fused_micro"))


@query("RNK-06", O("""SELECT persona, id, row_number() OVER (PARTITION BY persona ORDER BY CASE WHEN given <= 20 THEN given ELSE 1000000 END, place) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY roi DESC, id) AS given FROM rkd) t"""))
def rerank(spark, d):
    """An outside order (here the best twenty per hour) for some rows; the rest follow."""
    r = checkpointed(ranked(spark, d).select("persona", "id", "place", "roi"))
    given = tr.top_n(r, ["persona"], [F.desc("roi"), c("id")], 20, "given").select("persona", "id", "given")
    return rk.external_order(r, given).select("persona", "id", "rank")


# ---- keyword search ----------------------------------------------------------------------
_ST = tb.sql_list(list(tfidf.stop_words()))


def _terms_sql(rel, key, text):
    return f"""SELECT {key}, unnest(list_concat(w, list_transform(list_slice(w, 1, len(w) - 1), lambda x, i: x || ' ' || w[i + 1]))) AS term FROM
  (SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_ST}, x)) AS w FROM {rel}) z"""


_TFIDF = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms_sql('documents', 'doc_id', 'text')}) t GROUP BY ALL),
voc AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 40000) v),
dw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN voc USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM dw GROUP BY doc_id),
qf AS (SELECT item_id, term, count(*) AS tf FROM ({_terms_sql('benchmark', 'item_id', 'text')}) t GROUP BY ALL), qw AS (SELECT item_id, term, tf * idf AS w FROM qf JOIN voc USING (term)),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS len FROM qw GROUP BY item_id),
sim AS (SELECT item_id AS qid, doc_id AS id, dot / d.len / q.len AS sim FROM (SELECT item_id, doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (term) GROUP BY ALL) t JOIN dn d USING (doc_id) JOIN qn q USING (item_id))"""


@query("RNK-04", _TFIDF + f" SELECT qid, id, {Q6.format('sim')} AS sim_micro FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(sim * 1e9 + 0.5) DESC, id) AS rn FROM sim) t WHERE rn <= 10")
def keyword_search(spark, d):
    docs = tb.table(spark, d, "documents").select(c("doc_id").alias("id"), "text")
    asks = tb.table(spark, d, "benchmark").select(c("item_id").alias("qid"), "text")
    got, _ = tfidf.search_top(docs, asks, 10)
    return tr.top_n(got, ["qid"], [F.desc(F.floor(c("sim") * 1e9 + 0.5)), c("id")], 10).select("qid", "id", micro(c("sim")).alias("sim_micro"))


# ---- evaluation --------------------------------------------------------------------------
_GRADE = """CASE WHEN source = 'github' AND list_contains(barred, lower(COALESCE(language, ''))) THEN 0
  WHEN len(whitelist) = 0 THEN CASE WHEN hit THEN 2 ELSE 1 END WHEN hit AND same THEN 2 WHEN hit OR same THEN 1 ELSE 0 END"""
_GR = f", gr AS (SELECT persona, doc_id AS id, {_GRADE} AS grade, source, domain_list, language, whitelist, barred FROM (SELECT *, len(list_filter(kws, lambda k: contains(lower(title || ' ' || body), k))) > 0 AS hit, list_has_any(domain_list, whitelist) AS same FROM item, pz WHERE list_contains(allowed, source)) t)"


def keyword_graded(spark, d, pool=None):
    """Every item a persona may see, with its keyword grade; with a pool (persona, id) only its items."""
    p = people(spark).withColumn("kws", _keywords())
    who = p.select(c("id").alias("persona"), F.explode("allowed").alias("source"), c("domains").alias("whitelist"), "barred", "kws")
    rows = items(spark, d).select(c("ingest_seq").alias("id"), "source", "language", "domain_list", F.concat_ws(" ", "title", "body").alias("text"))
    if pool is None:
        got = rows.join(who, "source")
    else:
        got = rows.join(pool, "id").join(who, ["persona", "source"])
    return got.select("persona", "id", "source", "language", "domain_list", "whitelist", "barred",
                      tx.keyword_grade(c("source"), c("language"), c("barred"), c("domain_list"), c("whitelist"), c("text"), c("kws")).alias("grade"))


def graded_groups(spark, d):
    """The grades counted: items are first grouped by what a grade reads of them, their source, language, domains
    and which of all keywords they hold, and only the groups meet the personas."""
    p = people(spark).withColumn("kws", _keywords())
    who = p.select(c("id").alias("persona"), F.explode("allowed").alias("source"), c("domains").alias("whitelist"), "barred", "kws")
    every = p.select(F.explode("kws").alias("k")).agg(F.sort_array(F.collect_set("k")))
    rows = items(spark, d).select("source", "language", "domain_list", F.lower(F.concat_ws(" ", "title", "body")).alias("text")).withColumn("every", every.scalar())
    rows = rows.withColumn("held", F.array_join(F.filter("every", lambda k: F.contains("text", k)), "\n"))
    groups = rows.groupBy("source", "language", "domain_list", "held").agg(N().alias("n")).join(who, "source")
    return groups.withColumn("grade", tx.keyword_grade(c("source"), c("language"), c("barred"), c("domain_list"), c("whitelist"), c("held"), c("kws")))


@query("TXT-17", oracle("SELECT persona, id, grade FROM gr", extra=_PZ + _GR))
def keyword_grade(spark, d):
    return keyword_graded(spark, d).select("persona", "id", "grade")


@query("UDF-03", oracle("SELECT persona, grade, count(*) AS n FROM gr GROUP BY ALL", extra=_PZ + _GR))
def grader_hook(spark, d):
    return graded_groups(spark, d).groupBy("persona", "grade").agg(F.sum("n").alias("n"))


@query("EVL-08", oracle(f"SELECT persona, grade, count(*) AS n FROM gr WHERE {_IN} GROUP BY ALL", extra=_PZ + _GR))
def ideal_grades(spark, d):
    g = graded_groups(spark, d)
    inside = (F.size("whitelist") == 0) | F.arrays_overlap("domain_list", "whitelist")
    shut = (c("source") == "github") & F.array_contains("barred", F.lower(F.coalesce("language", F.lit(""))))
    return g.where(inside & ~shut).groupBy("persona", "grade").agg(F.sum("n").alias("n"))


_JUDGE = f""", dense AS (SELECT persona, id, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, id) AS rank FROM cand0),
jpool AS (SELECT DISTINCT persona, id FROM (SELECT persona, id FROM rkd WHERE place <= 20 UNION ALL SELECT persona, id FROM dense WHERE rank <= 20) t){_GR},
jd AS (SELECT j.persona, j.id, COALESCE(CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 + l.doc_id % 2 ELSE 1 END, g.grade) AS grade FROM jpool j JOIN gr g ON g.persona = j.persona AND g.id = j.id LEFT JOIN labels l ON l.doc_id = j.id),
lists AS (SELECT persona, id, 'impact' AS list, place AS rank FROM rkd WHERE place <= 20 UNION ALL SELECT persona, id, 'dense', rank FROM dense WHERE rank <= 20),
lg AS (SELECT lists.*, grade FROM lists JOIN jd USING (persona, id))"""


def judged_lists(spark, d):
    """Two ranked lists and their graded pool: label grades, else the keyword grade."""
    lists_ = ranked(spark, d).where("place <= 20").select("persona", "id", c("place").alias("rank"), F.lit("impact").alias("list"))
    raw = rk.by_dense(20, "rank")(candidates(spark, d)).select("persona", "id", "rank", F.lit("dense").alias("list"))
    both = lists_.unionByName(raw)
    l = tb.table(spark, d, "labels")
    grade = F.when(c("toxic") == 1, 0).when(c("quality") == 1, 2 + c("doc_id") % 2).otherwise(1)
    judgments = l.select(c("doc_id").alias("id"), grade.cast("int").alias("judged"))
    pool = keyword_graded(spark, d, checkpointed(both.select("persona", "id").distinct())).select("persona", "id", c("grade").alias("words"))
    graded = pool.join(judgments, "id", "left").select("persona", "id", F.coalesce("judged", "words").alias("grade"))
    return both, graded


@query("EVL-07", O("SELECT persona, id, grade FROM jd", _JUDGE))
def judged_pool(spark, d):
    return judged_lists(spark, d)[1]


def _ndcg_sql(gain, k):
    return f"""SELECT i.persona, list, {Q6.format('dcg / ideal')} AS ndcg_micro FROM (SELECT persona, list, sum({gain} / log2(rank + 1)) AS dcg FROM lg WHERE rank <= {k} GROUP BY ALL) x JOIN
  (SELECT persona, sum({gain} / log2(r + 1)) AS ideal FROM (SELECT persona, grade, row_number() OVER (PARTITION BY persona ORDER BY grade DESC) AS r FROM jd) t WHERE r <= {k} GROUP BY persona) i ON i.persona = x.persona WHERE ideal > 0"""


def _ndcg(spark, d, k, gain):
    lists_, graded = (checkpointed(x) for x in judged_lists(spark, d))
    rows = lists_.join(graded, ["persona", "id"])
    parts = [ev.ndcg(rows.where(c("list") == name), graded, k, gain).withColumn("list", F.lit(name)) for name in ("impact", "dense")]
    return parts[0].unionByName(parts[1]).select("persona", "list", micro(c("ndcg")).alias("ndcg_micro"))


@query("EVL-01", O(_ndcg_sql("(pow(2e0, grade) - 1)", 10), _JUDGE))
def ndcg_at_10(spark, d):
    return _ndcg(spark, d, 10, ev.exponential_gain)


@query("EVL-02", O(_ndcg_sql("grade::DOUBLE", 5), _JUDGE))
def linear_ndcg_at_5(spark, d):
    return _ndcg(spark, d, 5, lambda g: g.cast("double"))


_TEN = "ten AS (SELECT * FROM rkd WHERE place <= 10)"
_CK = """, ck AS (SELECT persona, any_value(mode) AS mode, count(*) FILTER (source = 'github') AS github, count(*) FILTER (list_contains(barred, lower(COALESCE(language, '')))) AS bn, count(*) FILTER (list_has_any(domain_list, whitelist)) AS inside,
  count(*) FILTER (opportunity_type IN ('post', 'story', 'comment_thread', 'issue')) AS ti, count(*) FILTER (opportunity_type IN ('post', 'story', 'comment_thread')) AS t, count(*) FILTER (list_has_any(domain_list, ['beginner_coding', 'frontend_web', 'mobile_dev', 'gamedev_cpp'])) AS gen,
  quantile_cont(age, 0.5) AS age, avg(velocity) AS vel, count(DISTINCT source) AS srcs FROM ten GROUP BY persona),
lane AS (SELECT persona, max(standout) AS best FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY 0.6e0 * standout + 0.4e0 * relevance DESC, sim DESC, id) AS n FROM sc WHERE source = 'github') q WHERE n <= 3 GROUP BY persona),
ca AS (SELECT quantile_cont(age, 0.5) AS m FROM raw)"""


@query("EVL-06", O("""SELECT persona, 'three repositories' AS check, github >= 3 AS passed FROM ck WHERE mode = 'contribute' UNION ALL SELECT persona, 'no barred language', bn = 0 FROM ck WHERE mode = 'contribute'
  UNION ALL SELECT persona, 'six in own domains', inside >= 6 FROM ck WHERE mode <> 'monitor' UNION ALL SELECT persona, 'six discussions', ti >= 6 FROM ck WHERE mode = 'discuss'
  UNION ALL SELECT ck.persona, 'a standout repository', COALESCE(best >= 0.5e0, false) FROM ck LEFT JOIN lane USING (persona) WHERE mode = 'discuss' UNION ALL SELECT persona, 'fresher than corpus', age < (SELECT m FROM ca) FROM ck WHERE mode = 'monitor'
  UNION ALL SELECT persona, 'fast movers', vel >= 0.6e0 FROM ck WHERE mode = 'monitor' UNION ALL SELECT persona, 'two sources', srcs >= 2 FROM ck WHERE mode = 'monitor' UNION ALL SELECT persona, 'six threads', t >= 6 FROM ck WHERE mode = 'promote'
  UNION ALL SELECT persona, 'little general coding', gen <= 2 FROM ck WHERE mode = 'promote'
  UNION ALL SELECT ck.persona, 'short basket', COALESCE(longest <= 75, false) FROM ck LEFT JOIN (SELECT persona, max(effort_min) AS longest FROM basket GROUP BY persona) k USING (persona) WHERE mode = 'contribute'""",
  _PACK + ", " + _TEN + _CK).replace("WITH ", "WITH RECURSIVE ", 1))
def acceptance_checks(spark, d):
    """All thirteen checks."""
    s = ranked_once(spark, d).withColumn("age", dates.age_days(c("created_at"), tb.as_of()))
    ages = tb.opportunities(spark, d).select(dates.age_days(c("created_at"), tb.as_of()).alias("age"))
    middle = ordered.linear_percentile(ordered.value_positions(ages, [], "age"), [], "age", 0.5, "m")
    return ev.acceptance(s.where("place <= 10"), rk.packed(s), rk.standout_lane(s), middle.scalar())


@query("UDF-05", oracle(f"""SELECT domain, rows, authors, true AS union_equals_whole, cells, cell_sum, true AS tables_add_up
  FROM (SELECT domain, count(*) AS rows, count(DISTINCT voice) AS authors FROM item GROUP BY domain) JOIN
  (SELECT domain, count(*) AS cells, sum(n)::BIGINT AS cell_sum FROM {cells_sql('tc', 'domain')} GROUP BY domain) USING (domain)""", extra=WORDS))
def mergeable_sketches(spark, d):
    """Sketches and count-min tables per (domain, source), merged per domain, equal those of the whole."""
    a = act(spark, d)
    merged = sk.merged_reach(sk.reach_sketches(a, ["domain", "source"]), ["domain"])
    whole = a.groupBy("domain").agg(N().alias("rows"), F.countDistinct("author").alias("authors"), F.hll_sketch_estimate(F.hll_sketch_agg("author", sk.LG_K)).alias("direct"))
    words = items(spark, d).select("domain", "source", F.explode(tx.terms(c("title"), c("tag_list"))).alias("term"))
    table = lambda keys: sk.count_min(words, keys, "term", CM_WIDTH, CM_DEPTH)
    both = sk.merged_count_min(table(["domain", "source"]), ["domain"]).withColumn("side", F.lit(1)).unionByName(table(["domain"]).withColumn("side", F.lit(-1)))
    cells = (both.groupBy("domain", "row", "bucket").agg(F.sum(c("n") * c("side")).alias("off"), F.max("n").alias("n"))
             .groupBy("domain").agg(N().alias("cells"), F.sum("n").alias("cell_sum"), (F.max(F.abs("off")) == 0).alias("tables_add_up")))
    got = whole.join(merged, "domain").join(cells, "domain")
    return got.select("domain", "rows", "authors", (near(c("reach"), c("direct")) & near(c("reach"), c("authors"))).alias("union_equals_whole"), "cells", "cell_sum", "tables_add_up")
