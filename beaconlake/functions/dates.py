"""Date handling on ISO text."""
from pyspark.sql import functions as F


def parsed(text):
    """ISO text to an instant; empty or broken text gives NULL."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def week_monday(text):
    """Monday of the week the text's own date part falls in; NULL when the text as a
    whole is no valid ISO moment."""
    day = F.to_date(F.when(parsed(text).isNotNull(), F.substring(text, 1, 10)))
    return F.trunc(day, "week")



def age_days(text, as_of):
    """Days before `as_of`, never negative; 9999 when the text has no valid moment."""
    micros = F.unix_micros(as_of) - F.unix_micros(parsed(text))
    return F.greatest(F.lit(0.0), F.coalesce(micros / 86400e6, F.lit(9999.0)))


def utc_instant(wall):
    """A zone-less UTC wall clock as an instant, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def utc_text(instant, pattern):
    """An instant as UTC text, whatever the session's zone is."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")), pattern)


def epoch_iso(seconds):
    """Epoch seconds to ISO text in UTC; missing or zero gives ''."""
    text = utc_text(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(seconds.isNull() | (seconds == 0), F.lit("")).otherwise(F.concat(text, F.lit("+00:00")))


def hours_before(newest, moment):
    """Whole hours from `moment` up to `newest`, at least 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_seconds(newest) - F.unix_seconds(moment)) / 3600)).cast("long")


def hourly_files(base, newest, hours):
    """One row per hourly capture file, newest first, after a two-hour publishing lag.
    `newest` is a timestamp_ntz column in UTC; the hour part carries no leading zero."""
    start = newest - F.expr("INTERVAL 2 HOURS")
    hour = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hours - 1)),
                                 lambda i: start - F.make_dt_interval(hours=i)))
    return hour, lambda h: F.concat(F.lit(base), F.date_format(h, "yyyy-MM-dd-H"), F.lit(".json.gz"))
