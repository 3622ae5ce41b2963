"""Quality reports and the ingest state: what is stored, how fresh and how good it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import by_symbol, td
from tessera.schemas import STATE_KEY


def quality_report(bars: DataFrame, as_of: str) -> DataFrame:
    """Twelve measures a symbol; `as_of` is the day that staleness is counted to."""
    last_ts, last_close = F.lag("ts").over(by_symbol()), F.lag("close").over(by_symbol())
    jump = td(F.col("close"), last_close)
    seen = bars.withColumns({"_gap": F.datediff("ts", last_ts), "_jump": (jump > 4) | (jump < 0.25)})
    empty = F.col("volume").isNull() | (F.col("volume") == 0)
    n = F.count("*")
    return seen.groupBy("symbol").agg(
        n.alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.datediff(F.lit(as_of).cast("date"), F.max("ts")).cast("long").alias("stale_days"),
        F.count_if(F.col("close").isNull()).alias("null_close"), F.count_if(empty).alias("zero_volume"), F.count_if("repaired").alias("repaired_rows"),
        F.count_if(F.col("adj_factor").isNull() | (F.col("adj_factor") <= 0)).alias("bad_adj_factor"), F.count_if("_jump").alias("price_jumps"), F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("max_gap_days"),
        F.round(F.count_if("repaired") / n, 6).alias("repaired_ratio"), F.round(F.count_if(empty) / n, 6).alias("zero_volume_ratio"),
    ).orderBy(F.desc("price_jumps"), F.desc("repaired_ratio"), "symbol")


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("row_count"))


def upsert_state(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace those with their key; a failure (no last_ts) never erases what is covered."""
    key = list(STATE_KEY)
    joined = state.alias("s").join(incoming.alias("i"), key, "full_outer")
    new = F.col("i.status").isNotNull()
    count = F.when(F.col("i.last_ts").isNull(), F.coalesce("s.row_count", F.lit(0))).otherwise(F.col("i.row_count"))
    return joined.select(
        *key, F.coalesce("i.first_ts", "s.first_ts").alias("first_ts"), F.coalesce("i.last_ts", "s.last_ts").alias("last_ts"), F.when(new, count).otherwise(F.col("s.row_count")).alias("row_count"),
        *[F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in ("status", "message", "updated_at")],
    )


def status(state: DataFrame, interval: str | None = None) -> DataFrame:
    held = state.filter(F.col("interval") == interval) if interval else state
    by = ["provider", "region", "asset_class", "interval"]
    return held.groupBy(*by).agg(F.count("*").alias("symbols"), F.sum("row_count").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count_if(F.col("status") != "ok").alias("failed")).orderBy(*by)


def watermarks(state: DataFrame, provider: str, region: str, asset_class: str, interval: str) -> DataFrame:
    wanted = {"provider": provider, "region": region, "asset_class": asset_class, "interval": interval}
    for column, value in wanted.items():
        state = state.filter(F.col(column) == value)
    return state.filter("last_ts is not null").select("symbol", "last_ts")
