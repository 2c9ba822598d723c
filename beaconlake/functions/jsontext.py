"""JSON text columns: decode with fallbacks, merge, list keys."""
from pyspark.sql import functions as F

from beaconlake.schema import SIGNAL_FIELDS


def tags_of(text):
    """Tag list; missing or broken text gives an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def domains_of(text, primary):
    """Domain labels; missing or broken text falls back to the primary label."""
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), "array<string>"), F.array(primary))


def signals_of(text):
    """The signal keys the scoring reads, typed; broken text gives NULL fields."""
    return F.from_json(text, SIGNAL_FIELDS)


def key_list(text):
    return F.coalesce(F.json_object_keys(F.when(F.try_parse_json(text).isNotNull(), text)),
                      F.array().cast("array<string>"))


def merged(old, new):
    """Two JSON objects as one; keys of `new` win. Value types stay as they were."""
    kind = "map<string,variant>"
    none = F.create_map().cast(kind)
    a, b = (F.coalesce(F.from_json(x, kind), none) for x in (old, new))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    both = F.map_concat(kept, b)
    return F.to_json(both)


def valid_labels(labels, allowed):
    """Allowed labels only, order and repeats kept, the first three, or ['other']."""
    keep = F.slice(F.filter(labels, lambda x: x.isin(*allowed)), 1, 3)
    return F.when(F.size(F.coalesce(keep, F.array().cast("array<string>"))) == 0,
                  F.array(F.lit("other"))).otherwise(keep)
