"""Ingest: plan what to ask for, fetch, clean, merge into the lake, and record the state of every symbol.

Everything is a table keyed by symbol, so that thousands of symbols are one job: the plan is the symbols
joined to their watermarks, failures are symbols of the plan without bars, and counts are aggregates.
A failed symbol changes neither its bars nor what its state says is covered.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.operators.cleaning import clean_bars, merge_bars, normalize_bars, universe_symbols
from tessera.schemas import STATE, Partition
from tessera.sources import bars as lake
from tessera.sources.connectors import Connector

MODES = ("auto", "full", "incremental")


@dataclass(frozen=True)
class Report:
    """What one ingest did; `results` has a row a symbol (symbol, status, message, row_count, rows_added)."""

    requested: int
    updated: int
    unchanged: int
    failed: int
    rows_added: int
    results: DataFrame


def resolve_symbols(spark: SparkSession, symbols=None, path: str | None = None, universe: DataFrame | None = None, asset_class: str | None = None, region: str = "US", stored: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Distinct upper-case symbols of a list, of a text file (one a line, # begins a comment) and of a universe;
    if wanted only those that are stored, and of these the first so many by name."""
    parts = []
    if symbols:
        parts.append(spark.createDataFrame([(s,) for s in ([symbols] if isinstance(symbols, str) else symbols)], "symbol string"))
    if path:
        parts.append(spark.read.text(path).select(F.split("value", "#")[0].alias("symbol")))
    if universe is not None and asset_class:
        parts.append(universe_symbols(universe, asset_class, region).select("symbol"))
    if not parts:
        raise ValueError("give symbols, a file of symbols, or a universe and an asset class")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.select(F.upper(F.trim("symbol")).alias("symbol")).filter("symbol != ''").distinct()
    if stored is not None:
        found = found.join(stored.select("symbol").distinct(), "symbol", "left_semi")
    return found.orderBy("symbol").limit(first) if first else found


def state_path(root: str) -> str:
    return f"{root.rstrip('/')}/state"


def _versions(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(state_path(root))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return []
    names = sorted(x.getPath().getName() for x in files.listStatus(path))
    return [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))]


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole version of the state table; empty before the first."""
    found = _versions(spark, root)
    return spark.read.schema(STATE).parquet(f"{state_path(root)}/{found[-1]}") if found else spark.createDataFrame([], STATE)


def record_states(spark: SparkSession, root: str, incoming: DataFrame) -> DataFrame:
    """Upsert into the state table, as a new version: a run that fails half-way leaves the last one in force."""
    made = catalog.upsert_state(read_state(spark, root), incoming).select([F.col(f.name).cast(f.dataType) for f in STATE])
    made.write.parquet(f"{state_path(root)}/{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:6]}")
    return read_state(spark, root)


def _states(rows: DataFrame, provider: str, partition: Partition, now: datetime) -> DataFrame:
    fixed = {"region": partition.region, "asset_class": partition.asset_class, "interval": partition.interval, "provider": provider}
    return rows.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"updated_at": F.lit(now).cast("timestamp")}).select(STATE.names)


def refresh_state(spark: SparkSession, root: str, provider: str, now: datetime | None = None) -> DataFrame:
    """Rebuild the state from the bars that the lake holds."""
    held = lake.read_lake(spark, root).groupBy("symbol", "region", "asset_class", "interval").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("row_count"))
    rows = held.withColumns({"provider": F.lit(provider), "status": F.lit("ok"), "message": F.lit(None).cast("string"), "updated_at": F.lit(now or datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")})
    return record_states(spark, root, rows.select(STATE.names))


def plan_starts(symbols: DataFrame, state: DataFrame, connector: Connector, partition: Partition, mode: str = "auto", start: datetime | None = None, now: datetime | None = None) -> DataFrame:
    """symbol, start (NULL: all there is). What is known is asked for from its last bar on, which may have been partial."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
    asked = F.lit(start).cast("timestamp")
    known = catalog.watermarks(state, connector.name, partition.region, partition.asset_class, partition.interval)
    if mode == "full":
        planned = symbols.select("symbol", asked.alias("start"))
    else:
        if mode == "incremental" and known.isEmpty():
            raise ValueError("incremental mode found no state; run a full ingest first, or mode auto")
        planned = symbols.join(known, "symbol", "left").select("symbol", F.coalesce("last_ts", asked).alias("start"))
    earliest = connector.clamp_start(partition.interval, None, now)
    return planned if earliest is None else planned.select("symbol", F.greatest("start", F.lit(earliest).cast("timestamp")).alias("start"))


def ingest(spark: SparkSession, root: str, connector: Connector, symbols: DataFrame, partition: Partition | None = None, mode: str = "auto", start: datetime | None = None, end: datetime | None = None, drop_zero_volume: bool = False, now: datetime | None = None) -> Report:
    """Bars of the symbols into one partition of the lake, and their state."""
    partition = partition or Partition()
    connector.check_interval(partition.interval)
    now = now or datetime.now(UTC).replace(tzinfo=None)
    plan = plan_starts(symbols, read_state(spark, root), connector, partition, mode, start, now)
    raw, errors = connector.fetch(spark, plan, partition.interval, end)
    bars = normalize_bars(raw).join(plan, "symbol").filter(F.col("start").isNull() | (F.col("ts") >= F.col("start")))
    bars = (bars if end is None else bars.filter(F.col("ts") <= F.lit(end).cast("timestamp"))).drop("start")
    fresh = clean_bars(bars, drop_zero_volume)
    seen = bars.groupBy("symbol").agg(F.count("*").alias("fetched"))
    good = fresh.join(errors.select("symbol"), "symbol", "left_anti").select(fresh.columns)
    old = lake.read_bars(spark, root, partition)
    merged = merge_bars(old, good)

    # Written beside the lake first: the merge reads what it is to replace.
    staged = f"{root.rstrip('/')}/staging/{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    whole = spark.read.schema(merged.schema).parquet(staged)
    before = catalog.coverage(old).select("symbol", F.col("row_count").alias("rows_before"))
    after = catalog.coverage(whole)
    touched = good.groupBy("symbol").agg(F.count("*").alias("kept"))
    message = F.coalesce("message", F.when(F.col("fetched").isNull(), "no data").when(F.col("kept").isNull(), "no rows left after cleaning"))
    results = plan.select("symbol").join(errors, "symbol", "left").join(seen, "symbol", "left").join(touched, "symbol", "left").join(after, "symbol", "left").join(before, "symbol", "left").withColumn("message", message)
    failed = F.col("message").isNotNull()
    none = lambda c: F.when(~failed, F.col(c)).alias(c)
    results = results.select(
        "symbol", F.when(failed, "error").otherwise("ok").alias("status"), "message", none("first_ts"), none("last_ts"), none("row_count"),
        F.when(failed, 0).otherwise(F.col("row_count") - F.coalesce("rows_before", F.lit(0))).cast("long").alias("rows_added"),
    )
    results.write.parquet(f"{staged}-results")
    results = spark.read.parquet(f"{staged}-results")
    if not touched.isEmpty():
        lake.write_bars(whole, root, partition)
    record_states(spark, root, _states(results.drop("rows_added"), connector.name, partition, now))
    sums = results.agg(
        F.count("*"), F.count_if((F.col("status") == "ok") & (F.col("rows_added") > 0)), F.count_if((F.col("status") == "ok") & (F.col("rows_added") <= 0)),
        F.count_if(F.col("status") == "error"), F.coalesce(F.sum("rows_added"), F.lit(0)),
    ).first()
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return Report(*sums, results)
