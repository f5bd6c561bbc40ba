"""Column helpers with the number rules of the data model: no NaN, guarded
division, half-up rounding towards plus infinity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), also for negative numbers."""
    return F.floor(x + 0.5)


def finite(x: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clean(x: Column) -> Column:
    """Feature value for scoring: missing 0, infinities plus or minus 10."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).when(x == float("inf"), F.lit(10.0)).when(x == float("-inf"), F.lit(-10.0)).otherwise(x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised array; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def greatest_or(values: Sequence[Column], default: float) -> Column:
    return F.coalesce(F.greatest(*values) if len(values) > 1 else values[0], F.lit(default)) if values else F.lit(default)


#: what adds columns to batches, and the kinds of these columns
Step = tuple[Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], dict[str, T.DataType]]


def stepped(df: DataFrame, *steps: Step) -> DataFrame:
    """Columns of all steps, added in one Python worker a task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for step, _ in steps:
            frames = step(frames)
        return frames

    return df.mapInPandas(run, schema_with(df, **{n: kind for _, kinds in steps for n, kind in kinds.items()}))


def schema_with(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """Schema of ``df`` with more fields at the end."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in kinds.items()]])
