"""The ranking funnel for a whole table of personas at once: candidates, hard filters,
relevance, score, order, diversity, time budget."""
import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import numeric as nm
from beaconlake.operators import trends as tr
from beaconlake.operators.skew import broadcast_if_small

c = F.col
POOL = 120              # fixed value: candidates that the pair scorer reads


def persona_sources(personas: DataFrame) -> DataFrame:
    """One row per persona and allowed source, broadcast when there are few."""
    return broadcast_if_small(personas.select(c("id").alias("persona"), F.explode("allowed").alias("source"), "mode", c("domains").alias("whitelist"),
                                              "barred", "time_budget_hours"))


def hard_filter(rows: DataFrame, personas: DataFrame) -> DataFrame:
    """Rows joined to the personas that allow their source, domain and language. `rows` may
    already carry a persona column."""
    keys = ["persona", "source"] if "persona" in rows.columns else ["source"]
    got = rows.join(persona_sources(personas), keys)
    in_domain = (F.size("whitelist") == 0) | F.arrays_overlap("domain_list", "whitelist")
    barred = (c("source") == "github") & F.array_contains("barred", F.lower(F.coalesce("language", F.lit(""))))
    return got.where(in_domain & ~barred)


def by_dense(n, out="dense_rank"):
    return lambda rows: tr.top_n(rows, ["persona"], [F.desc("sim"), c("id")], n, out)


def with_relevance(cands: DataFrame, scorer=None, pool=POOL) -> DataFrame:
    """`rel` = dense similarity, or, with a scorer column, its score on the best `pool`
    candidates per persona; the cut comes before the Python call."""
    if scorer is None:
        return cands.withColumn("rel", c("sim"))
    return by_dense(pool)(cands).drop("dense_rank").withColumn("rel", scorer)


def normalized_relevance(cands: DataFrame) -> DataFrame:
    """Min-max relevance inside each persona's candidate set (a few hundred rows)."""
    ends = cands.groupBy("persona").agg(F.min("rel").alias("lo"), F.max("rel").alias("hi"))
    got = cands.join(ends, "persona")
    span = F.when(c("hi") == c("lo"), 1.0).otherwise(c("hi") - c("lo"))
    return got.withColumn("relevance", nm.clamp01((c("rel") - c("lo")) / span)).drop("lo", "hi")


def mode_weights(mode, learned=None):
    """Ten weights in signal order: learned ones where given, else the mode's defaults."""
    base = nm.default_weights(mode)
    return base if learned is None else F.coalesce(learned, base)


def with_scores(cands: DataFrame, learned=None, prior=None) -> DataFrame:
    """Contributions, impact and impact per hour. `prior` multiplies the final figures."""
    aware = c("mode").isin(*lx.EFFORT_AWARE_MODES)
    s = cands.withColumns({"platform_fit": nm.platform_fit(c("mode"), c("source")), "effort_fit": 1.0 - nm.effort_share(c("effort_min")),
                           "weights": mode_weights(c("mode"), learned)})
    s = s.withColumn("parts", F.array(*[c("weights")[i] * F.coalesce(c(x), F.lit(0.0)) for i, x in enumerate(lx.SIGNALS)]))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x)
    worth = F.coalesce(F.nullif("contribution_worth", F.lit(0.0)), F.lit(0.5))
    s = s.withColumn("_raw", total * F.when(c("mode") == "contribute", 0.45 + 0.55 * worth).otherwise(1.0))
    hours = F.greatest(F.coalesce(F.nullif("effort_min", F.lit(0.0)), F.lit(30.0)) / 60.0, F.lit(0.1))
    r4 = lambda x: nm.fixed_round(x, 4)
    s = s.withColumns({"impact": r4(c("_raw")), "roi": r4(F.when(aware, c("_raw") / hours).otherwise(c("_raw")))}).drop("_raw")
    if prior is not None:
        s = s.withColumns({"impact": r4(c("impact") * prior), "roi": r4(c("roi") * prior)})
    return s


def top_drivers(parts):
    """The three largest contributions as (signal, value); the earlier signal wins ties."""
    named = F.transform(parts, lambda v, i: F.struct((-v).alias("k"), i.alias("i"), v.alias("v")))
    names = F.array(*[F.lit(s) for s in lx.SIGNALS])
    return F.transform(F.slice(F.array_sort(named), 1, 3), lambda x: F.struct(F.get(names, x.i).alias("signal"), x.v.alias("v")))


def why(drivers, mode, effort_min):
    """Plain reason text from the top contributions, with the effort at the end."""
    said = F.transform(F.filter(drivers, lambda x: x.v > 0.01), lambda x: nm.lookup(x.signal, lx.SIGNAL_REASONS))
    text = F.array_join(said, "; ")
    tail = F.when(mode.isin(*lx.EFFORT_AWARE_MODES), F.concat(F.lit(" · ~"), F.format_string("%.1f", nm.fixed_round(effort_min / 60.0, 1)), F.lit("h to engage"))
                  ).otherwise(F.lit(" · monitor only"))
    return F.concat(F.when(text == "", "weak match").otherwise(text), tail)


def by_impact(scored: DataFrame) -> DataFrame:
    return tr.numbered(scored, ["persona"], [F.desc("impact"), F.desc("sim"), c("id")], "place")


def diversified(ranked: DataFrame, k: int, lam: float) -> DataFrame:
    """Greedy pick of k rows per persona that trades impact against likeness to what is
    already picked. The pool per persona is cut to max(4k, 40) before the rows are grouped."""
    pool = ranked.where(c("place") <= max(4 * k, 40)).select("persona", "id", "impact", "place", "vec")

    def pick(pdf):
        pdf = pdf.sort_values("place")
        value = pdf["impact"].to_numpy(dtype=np.float64)
        span = (value.max() - value.min()) or 1.0
        use = (value - value.min()) / span
        m = np.stack(pdf["vec"].to_list()).astype(np.float64)
        like, open_, order = np.zeros(len(m)), np.ones(len(m), bool), []
        first = True
        while open_.any() and len(order) < k:
            gain = np.where(open_, lam * use - (1 - lam) * like, -np.inf)
            best = int(gain.argmax())
            order.append(best)
            open_[best] = False
            sims = m @ m[best]
            like = sims if first else np.maximum(like, sims)
            first = False
        out = pdf.iloc[order][["persona", "id"]].copy()
        out["rank"] = np.arange(1, len(order) + 1)
        return out

    return pool.groupBy("persona").applyInPandas(pick, "persona string, id bigint, rank int")


def packed(ranked: DataFrame, pool=40) -> DataFrame:
    """The best set of items within a persona's weekly minutes, from its top 40 by impact.
    Value is impact in thousandths, weight is whole minutes. Exact, for at most 40 items."""
    rows = ranked.where((c("place") <= pool) & c("mode").isin(*lx.EFFORT_AWARE_MODES))
    rows = rows.select("persona", "id", "place", "impact", "effort_min", F.floor(c("time_budget_hours") * 60).cast("int").alias("budget"))

    def choose(pdf):
        pdf = pdf.sort_values("place").reset_index(drop=True)
        cap = max(0, int(pdf["budget"].iloc[0]))
        minutes = np.maximum(1, np.rint(pdf["effort_min"].to_numpy())).astype(int)
        value = np.rint(pdf["impact"].to_numpy() * 1000).astype(np.int64)
        best = np.zeros(cap + 1, dtype=np.int64)
        took = np.zeros((len(pdf), cap + 1), dtype=bool)
        for i, (w, v) in enumerate(zip(minutes, value)):
            if w <= cap:
                with_it = best[:cap + 1 - w] + v
                took[i, w:] = with_it > best[w:]
                best[w:] = np.maximum(best[w:], with_it)
        left, chosen = cap, []
        for i in range(len(pdf) - 1, -1, -1):
            if took[i, left]:
                chosen.append(i)
                left -= minutes[i]
        out = pdf.iloc[chosen[::-1]][["persona", "id", "impact", "effort_min", "budget"]].copy()
        out["minutes"] = minutes[chosen[::-1]]
        return out

    return rows.groupBy("persona").applyInPandas(choose, "persona string, id bigint, impact double, effort_min double, budget int, minutes int")


def standout_lane(scored: DataFrame, n=3) -> DataFrame:
    """Busy repositories with few people, for those who contribute or discuss."""
    rows = scored.where((c("source") == "github") & c("mode").isin("contribute", "discuss"))
    rows = rows.withColumn("lane", 0.6 * c("standout") + 0.4 * c("relevance"))
    return tr.top_n(rows, ["persona"], [F.desc("lane"), F.desc("sim"), c("id")], n, "position")


def recommended(scored: DataFrame, vectors: DataFrame, k=10, lam=0.75) -> DataFrame:
    """The end of the funnel: one row per persona with its size, the k picks in order (id, impact,
    roi, why), the basket for the week and the standout lane. scored: from `with_scores`;
    vectors: id, vec."""
    ranked = by_impact(scored)
    lists = lambda rows, place, value, out: rows.groupBy("persona").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), value.alias("v")))), lambda x: x.v).alias(out))
    picks = diversified(ranked.join(vectors, "id"), k, lam)
    told = ranked.select("persona", "id", "impact", "roi", why(top_drivers(c("parts")), c("mode"), c("effort_min")).alias("why"))
    items = lists(picks.join(told, ["persona", "id"]), c("rank"), F.struct("id", "impact", "roi", "why"), "items")
    basket = lists(packed(ranked).join(ranked.select("persona", "id", "place"), ["persona", "id"]), c("place"), c("id"), "basket")
    lane = lists(standout_lane(scored), c("position"), c("id"), "lane")
    sizes = scored.groupBy("persona", "mode").agg(F.count(F.lit(1)).alias("n_candidates"))
    return sizes.join(items, "persona").join(basket, "persona", "left").join(lane, "persona", "left")


def bucket_quota(ranked: DataFrame, split: DataFrame) -> DataFrame:
    """About pct/10 of every ten items from each bucket, at least one, bucket by bucket.
    ranked: persona, id, place, bucket. split: persona, bucket, bucket_pos, pct."""
    rows = ranked.join(split, ["persona", "bucket"]).where("pct > 0")
    n = F.row_number().over(Window.partitionBy("persona", "bucket").orderBy("place"))
    took = rows.withColumn("n", n).where(c("n") <= F.greatest(F.lit(1), F.bround(c("pct") / 10, 0)))
    return took.withColumn("rank", F.row_number().over(Window.partitionBy("persona").orderBy("bucket_pos", "place")))


def external_order(rows: DataFrame, given: DataFrame) -> DataFrame:
    """Order by a given list; rows that are not on it follow in their old order."""
    got = rows.join(given, ["persona", "id"], "left")
    order = [c("given").isNull().cast("int"), c("given"), c("place")]
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("persona").orderBy(*order)))


def reciprocal_fusion(rows: DataFrame, a, b, k=60) -> DataFrame:
    """Fuse two orders per persona: the sum of 1 / (60 + position)."""
    pos = lambda o: F.row_number().over(Window.partitionBy("persona").orderBy(*o)) - 1
    got = rows.withColumn("ra", pos(a)).withColumn("rb", pos(b))
    return got.withColumn("fused", 1.0 / (F.lit(k) + c("ra")) + 1.0 / (F.lit(k) + c("rb")))
