"""Window primitives of the long model: rows (ts, symbol), no NaN, NULL where a value is missing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ANNUALIZE = math.sqrt(252.0)


def by_symbol():
    return W.partitionBy("symbol").orderBy("ts")


def running():
    return by_symbol().rowsBetween(W.unboundedPreceding, 0)


def by_date():
    return W.partitionBy("ts")


def td(a: Column, b: Column) -> Column:
    """Division that gives NULL on zero, as ANSI mode would raise."""
    return F.try_divide(a, b)


def trailing(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def roll(fn, x: Column, n: int, minimum: int | None = None) -> Column:
    """fn over the last n rows of the symbol, NULL unless `minimum` (default n) values are there."""
    return F.when(F.count(x).over(trailing(n)) >= (minimum or n), fn(x).over(trailing(n)))


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(by_symbol())


def root(x: Column) -> Column:
    """Square root of the non-negative part; greatest() alone would turn NULL into 0."""
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounds that leave NULL alone."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def pct_rank(x: Column, by=("ts",)) -> Column:
    """Average rank over the number of values, NULLs left out. Two ranks over one partitioning."""
    part = W.partitionBy(*by)
    up, down = F.rank().over(part.orderBy(x.asc_nulls_last())), F.rank().over(part.orderBy(x.desc_nulls_last()))
    n = F.count(x).over(part)
    return F.when(x.isNotNull(), td((up + n + 1 - down) / 2.0, n))


def first_rank(x: Column, descending: bool = True) -> Column:
    """1, 2, … per date; ties by symbol, NULLs last."""
    return F.row_number().over(by_date().orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last(), F.col("symbol")))


def mask_pair(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation over pairs; NULL if a side is constant, where corr() would raise."""
    x, y = mask_pair(x, y)
    parts = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return td(cov, sx * sy)


def skew(x: Column, n: int, over) -> Column:
    """Bias-corrected skewness of a full window; 0 for a constant one."""
    g = F.coalesce(F.skewness(x).over(over), F.lit(0.0))
    return g * (math.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: Column, n: int, over) -> Column:
    """Bias-corrected excess kurtosis of a full window; -3 for a constant one."""
    g = F.kurtosis(x).over(over)
    return F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6), F.lit(-3.0))


def with_ordinal(df: DataFrame, name: str = "d") -> DataFrame:
    """Number the distinct dates; only the list of dates is ordered in one place."""
    dates = df.select("ts").distinct().withColumn(name, F.row_number().over(W.orderBy("ts")))
    return df.join(dates, "ts")


def islands(df: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """Runs of rows where `flag` holds: keys, first, last, length. `order` is a gapless number."""
    at = F.col(order) - F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.filter(flag).withColumn("_run", at).groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")
