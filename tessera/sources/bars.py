"""Bars: derived from star-schema tables, stored in and read from a partitioned Parquet lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.operators.cleaning import clean_bars, normalize_bars
from tessera.schemas import BAR, PARTITION_COLUMNS, Partition


def derive_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Bars from line items: brand by week or month (dense), supplier by day (sparse).

    Open and close are the first and last price by ship date, order, line and price, so that they don't
    depend on how rows are read. The order is one decimal (7 digits of seconds within the bar, 12 of the
    order, 1 of the line, 18 of the price), which a hash aggregation can hold where it can't hold a struct:
    nothing is sorted, and the aggregation is partial on the map side.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    if unit == "day":
        keyed = items.withColumn("symbol", F.col("l_suppkey").cast("string"))
    else:
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"))
        keyed = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    within = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.date_trunc(unit, "l_shipdate").cast("timestamp"))
    line = within.cast("decimal(20,0)") * F.expr("10000000000000BD") + (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(20,0)")
    place = (line.cast("decimal(20,0)") * F.expr("1000000000000000000BD")).cast("decimal(38,0)") + (px.cast("decimal(30,12)") * F.expr("1000000000000BD")).cast("decimal(18,0)")
    place = place.cast("decimal(38,0)")
    made = keyed.groupBy("symbol", F.date_trunc(unit, "l_shipdate").alias("ts")).agg(
        F.min_by(px, place).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, place).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.max("l_discount").alias("discount"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"),
    )
    return made.select(
        F.col("ts").cast("timestamp").alias("ts"), "symbol", "open", "high", "low", "close", "volume",
        (F.col("close") * (1 - F.col("discount"))).alias("adj_close"),
        F.lit(None).cast("double").alias("adj_factor"), F.lit(0.0).alias("dividend"), F.lit(0.0).alias("split_ratio"), (F.col("r") == 1).alias("repaired"),
    )


def _root(root: str) -> str:
    return f"{root.rstrip('/')}/bars"


def write_bars(bars: DataFrame, root: str, partition: Partition, mode: str = "overwrite") -> None:
    """Replace (or add to) one partition of the lake; rows are sorted by symbol for row-group skipping."""
    held = bars.select([F.col(f.name).cast(f.dataType) for f in BAR]).withColumns({"region": F.lit(partition.region), "asset_class": F.lit(partition.asset_class), "interval": F.lit(partition.interval)})
    writer = held.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode(mode).partitionBy("region", "asset_class", "interval")
    writer.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").parquet(_root(root))


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """All partitions, by a fixed schema: no file is opened to find it, and columns that older files lack are NULL.
    A lake that isn't there yet has no rows."""
    schema = StructType([*BAR, *[StructField(c, StringType()) for c in PARTITION_COLUMNS]])
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(root))
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_root(root))


def read_bars(spark: SparkSession, root: str, partition: Partition, symbols=None, columns=None) -> DataFrame:
    """One partition (pruned by folder), some symbols (pushed to the scan), some columns."""
    held = read_lake(spark, root).filter((F.col("region") == partition.region) & (F.col("asset_class") == partition.asset_class) & (F.col("interval") == partition.interval))
    if symbols is not None:
        held = held.filter(F.col("symbol").isin([s.upper() for s in symbols]))
    return held.select(*(columns or BAR.names))


def read_symbol(spark: SparkSession, root: str, symbol: str, partition: Partition, columns=None) -> DataFrame:
    return read_bars(spark, root, partition, [symbol], columns)


def stored_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def stored_partitions(lake: DataFrame) -> DataFrame:
    return lake.select("region", "asset_class", "interval").distinct()


def last_timestamps(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))


def read_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Old per-symbol CSV files; the symbol is the file name up to its first underscore; quality_* are skipped."""
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.csv").csv(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.csv$", 1)
    raw = raw.withColumn("_file", name).filter(~F.col("_file").startswith("quality_"))
    return raw.withColumn("symbol", F.split("_file", "_")[0]).drop("_file")


def read_matrix(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """A stored wide matrix (ts, a column a symbol) back as long rows (ts, symbol, metric); NULLs go."""
    wide = spark.read.parquet(path)
    return wide.unpivot(["ts"], [c for c in wide.columns if c != "ts"], "symbol", metric).filter(F.col(f"`{metric}`").isNotNull())


def migrate_csv(spark: SparkSession, folder: str, drop_zero_volume: bool = False) -> DataFrame:
    """Clean bars from a folder of CSV files; what can't be read as a bar is dropped by the cleaning rules."""
    return clean_bars(normalize_bars(read_csv_folder(spark, folder)), drop_zero_volume)


def feature_matrix(features: DataFrame, metric: str, symbols: list[str] | None = None) -> DataFrame:
    """Wide export of one metric: a row per date, a column per symbol (absent ones are NULL)."""
    grouped = features.groupBy("ts")
    return (grouped.pivot("symbol", symbols) if symbols else grouped.pivot("symbol")).agg(F.first(metric)).orderBy("ts")


def register_views(spark: SparkSession, root: str, universe: DataFrame | None = None, state: DataFrame | None = None) -> None:
    """SQL views bars, universe and ingest_state; spark.sql then takes any SELECT over them."""
    read_lake(spark, root).createOrReplaceTempView("bars")
    if universe is not None:
        universe.createOrReplaceTempView("universe")
    if state is not None:
        state.createOrReplaceTempView("ingest_state")


def query(spark: SparkSession, sql: str, parameters: list | None = None) -> DataFrame:
    return spark.sql(sql, args=parameters) if parameters else spark.sql(sql)
