"""Prefix sums over a whole table that no single task has to see."""
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake.operators.ordered import PART, split_sorted


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """`out` = sum of `value` over all earlier rows in a global order. Each range partition is
    summed alone; one row per partition carries on."""
    cut = split_sorted(df, order)
    total = cut.groupBy(PART).agg(*[F.sum(v).alias(f"_sum_{o}") for o, v in sums.items()])
    ahead = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)       # one row per partition
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(PART, *[F.coalesce(F.sum(f"_sum_{o}").over(ahead), F.lit(0)).alias(f"_sum_{o}") for o in sums])
    here = cut.withColumns({o: F.coalesce(F.sum(v).over(inside), F.lit(0)) for o, v in sums.items()})
    return (here.join(F.broadcast(carry), PART)
            .withColumns({o: F.col(o) + F.col(f"_sum_{o}") for o in sums}).drop(PART, *[f"_sum_{o}" for o in sums]))
