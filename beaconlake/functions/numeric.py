"""Row-level arithmetic as Column functions."""

import math

from pyspark.sql import functions as F

from beaconlake import lexicon as lx


def _sql(value):
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, list):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def lookup(key, table, default=None):
    """A small fixed table as a map literal; unknown keys give `default`."""
    literal = F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items()) + ")")
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def once(value, use):
    """`use(value)` with the value worked out a single time a row, however often it is read. A Column that
    is written down several times, or read inside a lambda, is worked out again at each place."""
    return F.transform(F.array(value), use).getItem(0)


def fixed_round(x, digits):
    """Half-up rounding by floor, so the same doubles come out on any engine."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale


def clamp01(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def engagement(score, comments):
    return F.coalesce(score, F.lit(0)) + F.coalesce(comments, F.lit(0))


def recency_decay(age):
    """Halves every 30 days."""
    return F.exp(F.lit(-math.log(2.0)) * age / 30.0)


def repo_reputation(stars):
    """Log-scaled stars, saturated near 5k, with a crowding penalty past 50k."""
    s = F.coalesce(stars, F.lit(0)).cast("double")
    grown = F.least(F.lit(1.0), F.log10(s + 1.0) / math.log10(5000.0))
    crowd = F.when(s > 50000, F.lit(0.85)).otherwise(F.lit(1.0))
    return F.when(s < 1, F.lit(0.0)).otherwise(clamp01(grown * crowd))


def effort_minutes(source, kind, body, good_first, reading_time):
    """Minutes to read and meaningfully answer an item, by source and type."""
    base = (F.when(kind == "pull_request", 90.0).when(good_first, 45.0).otherwise(150.0))
    length = F.least(F.length(F.coalesce(body, F.lit(""))) / 500.0 * 15.0, F.lit(60.0))
    reading = F.when(reading_time.isNull() | (reading_time == 0), 5.0).otherwise(reading_time)
    return (F.when(source == "devto", reading + 8.0)
            .when(source.isin("hackernews", "reddit"), 15.0)
            .when(source == "bluesky", 8.0)
            .when(source == "github", F.least(base + length, F.lit(480.0)))
            .otherwise(30.0))


def effort_share(minutes):
    """Minutes on a 0..1 scale that saturates at four hours."""
    return clamp01(minutes / 240.0)


def star_velocity(stars, age_days):
    return F.when(age_days > 0, fixed_round(stars / age_days, 3))



def dot(a, b):
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a):
    return F.sqrt(dot(a, a))


def cosine(a, b):
    """Dot of the two directions; a zero vector gives 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def unit(a):
    """L2-normalized copy; a zero vector stays zero."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size == 0, 0.0).otherwise(x.cast("double") / size))


def renormalized(weights):
    """Clip at zero and scale to sum 1; an all-zero vector stays zero."""
    clipped = F.transform(weights, lambda x: F.greatest(F.lit(0.0), x))
    total = F.aggregate(clipped, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(clipped, lambda x: x / F.when(total == 0, 1.0).otherwise(total))


def default_weights(mode):
    """A mode's ten default weights in signal order."""
    return lookup(mode, {m: [float(w.get(x, 0.0)) for x in lx.SIGNALS] for m, w in lx.MODE_WEIGHTS.items()})


def platform_fit(mode, source):
    table = {f"{m}|{s}": float(v) for m, fits in lx.MODE_PLATFORM_FIT.items() for s, v in fits.items()}
    return lookup(F.concat_ws("|", mode, source), table, lx.DEFAULT_PLATFORM_FIT)


def bucket_of(source):
    return lookup(source, lx.SOURCE_BUCKET, lx.DEFAULT_BUCKET)


def rising_floor(source):
    return lookup(source, lx.RISING_FLOORS, lx.DEFAULT_RISING_FLOOR)


def is_rising(velocity, engagement_value, source):
    return (velocity >= 0.6) & (engagement_value >= rising_floor(source))


def is_open(source, archived, state):
    """1 unless a repository item is archived or not in the open state."""
    shut = F.coalesce(archived, F.lit(False)) | (F.coalesce(F.nullif(state, F.lit("")), F.lit("open")) != "open")
    return F.when((source == "github") & shut, 0.0).otherwise(1.0)


def direction(delta_pp):
    return F.when(delta_pp > 0.1, "up").when(delta_pp < -0.1, "down").otherwise("flat")
