"""The opportunity record and the tables around it."""
from pyspark.sql import functions as F, types as T

OPPORTUNITY = T.StructType([
    T.StructField(name, T.StringType()) for name in (
        "opportunity_id", "source", "source_native_id", "url", "title", "body",
        "opportunity_type", "domain", "domains", "created_at", "tags", "language", "author")
] + [T.StructField("author_reputation", T.DoubleType()),
     T.StructField("community", T.StringType())] + [
    T.StructField(name, T.LongType()) for name in ("community_size", "score", "num_comments")
] + [T.StructField(name, T.StringType()) for name in (
    "last_activity_at", "signals", "raw", "fetched_at")])

FEATURES = ["popularity", "discussion", "velocity", "recency", "standout", "openness",
            "community_health", "visibility", "repo_reputation", "issue_quality",
            "contribution_worth", "effort_min", "effort"]

SIGNAL_FIELDS = T.StructType([
    T.StructField("star_velocity", T.DoubleType()), T.StructField("contributors", T.LongType()),
    T.StructField("open_issues", T.LongType()), T.StructField("archived", T.BooleanType()),
    T.StructField("state", T.StringType()), T.StructField("reading_time_min", T.DoubleType())])


def opportunity_key(source, native_id):
    """sha1 of "source:native id"."""
    return F.sha1(F.concat_ws(":", source, native_id))


def canonical(df):
    """Project any frame onto the opportunity columns; missing ones become NULL and
    array, struct or map values become JSON text."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in OPPORTUNITY.fields:
        if field.name not in have:
            col = F.lit(None)
        elif isinstance(have[field.name], (T.ArrayType, T.StructType, T.MapType)):
            col = F.to_json(F.col(field.name))
        else:
            col = F.col(field.name)
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


def add_column_if_missing(df, name, value):
    """Schema evolution: add `name` from `value`, or fill its gaps when it exists."""
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
