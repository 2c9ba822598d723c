"""Signals per item, made comparable across sources by each source's own distribution."""
from pyspark.sql import DataFrame, functions as F

from beaconlake.functions import dates, jsontext, numeric as nm, text as tx
from beaconlake.operators import ordered, skew
from beaconlake.session import checkpointed
from beaconlake.schema import FEATURES

RAW = ["pop", "disc", "vel", "standout"]


def decoded(opps: DataFrame) -> DataFrame:
    """Typed tags, domains and signals next to the raw text columns."""
    return opps.withColumns({"tag_list": jsontext.tags_of(F.col("tags")), "sig": jsontext.signals_of(F.col("signals")),
                             "domain_list": jsontext.domains_of(F.col("domains"), F.col("domain"))})


def with_raw_signals(items: DataFrame, as_of) -> DataFrame:
    """Raw popularity, discussion, velocity and standout, plus age in days."""
    github = F.col("source") == "github"
    score = F.coalesce(F.col("score"), F.lit(0)).cast("double")
    disc = F.coalesce(F.col("num_comments"), F.lit(0)).cast("double")
    people = F.col("sig.contributors")
    room = (F.coalesce(F.col("sig.open_issues"), F.lit(0)) + disc) / F.greatest(people, F.lit(1))
    return (items.withColumn("age", dates.age_days(F.col("created_at"), as_of))
            .withColumn("pop", F.when(github, F.coalesce(F.col("community_size"), F.lit(0)).cast("double")).otherwise(score))
            .withColumn("disc", disc)
            .withColumn("vel", F.when(github, F.col("sig.star_velocity")).otherwise(
                score / F.greatest(F.col("age"), F.lit(1.0))))
            .withColumn("standout_raw", F.when(github & (people != 0), room)))


RAW_COLUMNS = ["pop", "disc", "vel", "standout_raw"]


def _values(fields):
    return [(name, col) for name, col in zip(RAW, RAW_COLUMNS) if name in fields]


def value_shares(items: DataFrame, fields=RAW) -> DataFrame:
    """(source, field, v, n, share): per raw signal and source the different values, and the share of the
    source's non-null values that each strictly beats."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.col(col).alias("v")) for name, col in _values(fields)])
    positions = ordered.value_positions(items.select("source", F.inline(each)), ["source", "field"], "v")
    return checkpointed(positions.select("source", "field", "v", "n", (F.col("below") / F.col("total")).alias("share")))


def with_percentiles(items: DataFrame, fields=RAW, corpus: DataFrame | None = None) -> DataFrame:
    """The rows with, per raw signal, the share of their source's non-null values they strictly
    beat. A missing value beats nobody. `corpus` has the rows to compare with, where they are not the
    rows themselves. opportunity_id is unique.

    A row becomes one slim row per signal, which looks its value up, and is put together again by its
    id; the other columns travel with the first."""
    table = value_shares(items if corpus is None else corpus, fields)
    whole = F.struct(*items.columns)
    none = F.lit(None).cast(items.select(whole.alias("row")).schema["row"].dataType)
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.col(col).alias("v"), (none if i else whole).alias("row")) for i, (name, col) in enumerate(_values(fields))])
    found = skew.lookup_join(items.select("opportunity_id", "source", F.inline(each)), table, ["source", "field", "v"], "n", "opportunity_id")
    shares = [F.coalesce(F.max(F.when(F.col("field") == name, F.col("share"))), F.lit(0.0)).alias(f"{name}_pct") for name, _ in _values(fields)]
    again = found.groupBy("opportunity_id").agg(F.first("row", ignorenulls=True).alias("row"), *shares)
    return again.select("row.*", *[f"{name}_pct" for name, _ in _values(fields)])


def source_percentiles(items: DataFrame) -> DataFrame:
    """opportunity_id and one share per raw signal."""
    slim = items.select("opportunity_id", "source", *RAW_COLUMNS)
    return with_percentiles(slim).select("opportunity_id", *[f"{f}_pct" for f in RAW])


def with_velocity(opps: DataFrame, as_of) -> DataFrame:
    """The rows with the velocity feature alone."""
    raw = with_raw_signals(decoded(opps), as_of).select(*opps.columns, "vel")
    got = with_percentiles(raw, ["vel"])
    return got.select(*opps.columns, nm.fixed_round(F.col("vel_pct"), 4).alias("velocity"))


def openness(items_source="source"):
    return nm.is_open(F.col(items_source), F.col("sig.archived"), F.col("sig.state"))


def health(discussion, recency, velocity, open_flag):
    return nm.clamp01(0.45 * discussion + 0.30 * recency + 0.25 * velocity) * F.when(open_flag > 0, 1.0).otherwise(0.4)


def visibility(popularity, velocity):
    return nm.clamp01(0.6 * popularity + 0.4 * velocity)


def contribution_worth(source, reputation, quality, health_value, open_flag):
    worth = nm.clamp01(0.30 * reputation + 0.40 * quality + 0.30 * health_value) * F.when(open_flag > 0, 1.0).otherwise(0.5)
    return F.when(source == "github", worth).otherwise(0.5)


def feature_table(opps: DataFrame, as_of, corpus: DataFrame | None = None) -> DataFrame:
    """The 13 rounded feature columns per item. `corpus` has all items where `opps` are some of them:
    values are compared with all, the rest is computed for the few."""
    items = with_raw_signals(decoded(opps), as_of)
    slim = lambda rows: rows.select("opportunity_id", "source", *RAW_COLUMNS)
    corpus = None if corpus is None else slim(with_raw_signals(decoded(corpus), as_of))
    source = F.col("source")
    github = source == "github"
    flat = items.select(
        "opportunity_id", "source", *RAW_COLUMNS, nm.recency_decay(F.col("age")).alias("rec"), openness().alias("open_flag"),
        F.when(github, nm.repo_reputation(F.col("community_size"))).otherwise(0.5).alias("rep"),
        tx.issue_quality(source, F.col("body")).alias("qual"), F.col("standout_raw").isNull().alias("no_standout"),
        nm.effort_minutes(source, F.col("opportunity_type"), F.col("body"), tx.good_first(F.col("tag_list")),
                          F.col("sig.reading_time_min")).alias("minutes"))
    f = with_percentiles(flat, corpus=corpus)
    f = f.withColumn("health", health(F.col("disc_pct"), F.col("rec"), F.col("vel_pct"), F.col("open_flag")))
    r4 = lambda c: nm.fixed_round(c, 4)
    return f.select(
        "opportunity_id", r4(F.col("pop_pct")).alias("popularity"), r4(F.col("disc_pct")).alias("discussion"),
        r4(F.col("vel_pct")).alias("velocity"), r4(F.col("rec")).alias("recency"),
        r4(F.when((F.col("source") != "github") | F.col("no_standout"), 0.5).otherwise(F.col("standout_pct"))).alias("standout"),
        F.col("open_flag").alias("openness"), r4(F.col("health")).alias("community_health"),
        r4(visibility(F.col("pop_pct"), F.col("vel_pct"))).alias("visibility"),
        r4(F.col("rep")).alias("repo_reputation"), r4(F.col("qual")).alias("issue_quality"),
        r4(contribution_worth(F.col("source"), F.col("rep"), F.col("qual"), F.col("health"), F.col("open_flag"))).alias("contribution_worth"),
        nm.fixed_round(F.col("minutes"), 1).alias("effort_min"),
        r4(nm.effort_share(F.col("minutes"))).alias("effort")).select("opportunity_id", *FEATURES)


def mean_signals_by_source(opps: DataFrame, features: DataFrame) -> DataFrame:
    cols = ["popularity", "discussion", "velocity", "recency", "community_health", "visibility", "effort_min"]
    return (opps.select("opportunity_id", "source").join(features, "opportunity_id").groupBy("source")
            .agg(*[F.avg(c).alias(c) for c in cols]))
