"""Running sums and ranks over all rows without a task that holds all rows.

Rows are put into buckets by approximate quantiles of the order column.  Sums of
the buckets (a few hundred rows) give offsets, and inside a bucket a window
runs over that bucket alone.  A bucket is a function of the value, so results
don't depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 200


def sums_before(rows: DataFrame, order: str, amounts: Sequence[str], by: Sequence[str] = (), descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Adds before_<amount>: the sum over rows that come earlier in the order of
    a numeric column (of the same ``by`` values).  Rows with one value should
    have been counted together; null order values come first."""
    value = F.col(order).cast("double")
    value = -value if descending else value
    cuts = sorted(set(rows.select(F.col(order).cast("double").alias("v")).approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.001)))
    if descending:
        cuts = [-c for c in reversed(cuts)]
    if not cuts:  # no values at all
        window = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"before_{a}": F.coalesce(F.sum(a).over(window), F.lit(0)) for a in amounts})
    bucket = F.array_position(F.sort_array(F.array_append(F.lit(cuts), value)), value)
    placed = rows.withColumn("_bucket", F.coalesce(bucket, F.lit(0)).cast("int"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "_bucket").agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    offsets = sums.select(*by, "_bucket", *[F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_off_{a}") for a in amounts])
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, [*by, "_bucket"])
    added = {f"before_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"_off_{a}") for a in amounts}
    return joined.withColumns(added).drop("_bucket", *[f"_off_{a}" for a in amounts])


def value_counts(rows: DataFrame, value: str, by: Sequence[str] = (), count: str = "_c") -> DataFrame:
    return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias(count))


def mean_rank(before: Column, count: Column, n: Column) -> Column:
    """Rank from 0 to 1, ties sharing their mean; one value alone is 0.5."""
    return F.when(n > 1, (before + (count - 1) / 2) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.5))
