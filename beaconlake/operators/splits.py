"""Weekly attention splits over the activity buckets, held as arrays in bucket order."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.functions.numeric import fixed_round, lookup, once


def largest_remainder(weights):
    """Scale an array to whole numbers that sum to exactly 100."""
    summed = lambda xs, zero: F.aggregate(xs, F.lit(zero), lambda a, x: a + x)
    shares = lambda raw: once(summed(raw, 0.0), lambda total: F.transform(raw, lambda x: x * 100.0 / F.when(total == 0, 1.0).otherwise(total)))
    raw = F.transform(weights, lambda x: F.greatest(F.lit(0.0), x.cast("double")))
    return once(once(raw, shares), lambda scaled: once(F.transform(scaled, lambda x: F.floor(x).cast("int")), lambda whole: once(
        F.struct((F.lit(100) - summed(whole, 0)).alias("missing"), F.zip_with(scaled, whole, lambda s, w: s - w).alias("rest")),
        lambda left: F.zip_with(whole, _bonus(left["rest"], left["missing"]), lambda w, b: w + b))))


def _bonus(rest, missing):
    """1 for the `missing` largest remainders, the earlier first among equal ones."""
    ahead = lambda x, i: F.size(F.filter(rest, lambda y, j: (y > x) | ((y == x) & (j < i))))
    return F.transform(rest, lambda x, i: F.when(ahead(x, i) < missing, 1).otherwise(0))


def recommended_split(mode, level):
    """Base split of the mode, shifted by experience, as whole percent in bucket order."""
    return largest_remainder(once(F.struct(mode.alias("mode"), level.alias("level")), lambda of: _shifted(of["mode"], of["level"])))


def _shifted(mode, level):
    base = {b: lookup(mode, {m: s[b] for m, s in lx.SPLIT_BASE.items()}, lx.SPLIT_BASE["contribute"][b])
            for b in lx.BUCKETS}
    ease = F.greatest(F.lit(0), F.least(F.lit(12), base["contribute"] - 8))
    push = F.greatest(F.lit(0), F.least(F.lit(8), base["learn"] - 6))
    to_learn = F.when(level == "newbie", ease).when(level == "expert", -push).otherwise(F.lit(0))
    return F.array(base["contribute"] - to_learn, base["learn"] + to_learn, base["discuss"], base["news"])


def bucket_prior(split):
    """Mild multiplier per bucket; NULL for a bucket set to zero."""
    top = F.array_max(split).cast("double")
    return F.transform(split, lambda p: F.when(p > 0, fixed_round(0.80 + 0.45 * (p.cast("double") / top), 4)))


def split_sources(split):
    """Sources of the buckets with a positive share."""
    lists = [F.when(split.getItem(i) > 0, F.array(*[F.lit(s) for s in lx.BUCKET_SOURCES[b]]))
             .otherwise(F.array().cast("array<string>")) for i, b in enumerate(lx.BUCKETS)]
    return F.array_intersect(F.concat(*lists), F.array(*[F.lit(s) for s in lx.SOURCES]))
