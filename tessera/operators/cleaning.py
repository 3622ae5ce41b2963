"""Normalising, cleaning and merging bars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.windows import running, td
from tessera.schemas import BAR, PRICES

#: Vendor names (lower case, letters and digits only) of the bar columns.
ALIASES = {
    "date": "ts", "datetime": "ts", "timestamp": "ts", "time": "ts", "ts": "ts",
    "symbol": "symbol", "ticker": "symbol",
    "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
    "adjclose": "adj_close", "adjustedclose": "adj_close", "closeadj": "adj_close", "adjfactor": "adj_factor",
    "dividends": "dividend", "dividend": "dividend",
    "stocksplits": "split_ratio", "splits": "split_ratio", "splitratio": "split_ratio",
    "repaired": "repaired",
}


def canonical_name(column: str) -> str | None:
    return ALIASES.get(re.sub(r"[^a-z0-9]", "", column.lower()))


def normalize_bars(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Vendor columns to the bar schema: names, types, defaults; rows without a time go."""
    found: dict[str, str] = {}
    for column in raw.columns:
        name = canonical_name(column)
        if name and name not in found:
            found[name] = column
    kinds = dict(raw.dtypes)

    def get(name: str):
        return F.col(f"`{found[name]}`") if name in found else None

    def number(name: str):
        if name not in found:
            return F.lit(None).cast("double")
        x = get(name).try_cast("double") if kinds[found[name]] == "string" else get(name).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    if "ts" not in found:
        raise ValueError("no time column")
    ts = F.try_to_timestamp(get("ts")) if kinds[found["ts"]] == "string" else get("ts").cast("timestamp")
    named = F.lit(symbol) if symbol is not None else get("symbol")
    close, adj = number("close"), F.coalesce(number("adj_close"), number("close"))
    marks = F.lower(get("repaired").cast("string")).isin("true", "1", "1.0", "yes") if "repaired" in found else F.lit(False)
    factor = F.coalesce(F.when(close > 0, td(adj, close)), F.lit(1.0))
    out = raw.select(
        ts.alias("ts"), F.upper(F.trim(named)).alias("symbol"), *[number(c).alias(c) for c in (*PRICES, "volume")], adj.alias("adj_close"),
        F.coalesce(number("adj_factor"), factor).alias("adj_factor"), *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("dividend", "split_ratio")], F.coalesce(marks, F.lit(False)).alias("repaired"),
    )
    return out.filter("ts is not null").select([F.col(f.name).cast(f.dataType).alias(f.name) for f in BAR])


def clean_bars(bars: DataFrame, drop_zero_volume: bool = False, seq: str | None = None) -> DataFrame:
    """Bars that make sense; of bars with the same symbol and time the last by `seq` (or value) stays."""
    volume = F.coalesce("volume", F.lit(0.0))
    ok = (F.least(*PRICES) > 0) & (F.col("high") >= F.greatest("low", "open", "close")) & (F.col("low") <= F.least("open", "close"))
    for price in PRICES:
        ok = ok & F.col(price).isNotNull()
    kept = bars.filter(ok & ((volume > 0) if drop_zero_volume else (volume >= 0)))
    order = [F.desc(seq)] if seq else [F.desc_nulls_last(c) for c in ("close", "volume", "open", "high", "low")]
    return kept.withColumn("_n", F.row_number().over(W.partitionBy("symbol", "ts").orderBy(*order))).filter("_n = 1").drop("_n")


def merge_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of both; where both have a (symbol, ts) the incoming bar wins."""
    return incoming.unionByName(existing.join(incoming.select("symbol", "ts"), ["symbol", "ts"], "left_anti").select(incoming.columns))


def with_adjustments(bars: DataFrame) -> DataFrame:
    """adj_close that is positive (else carried forward, else the close) and the factor that goes with it."""
    given = F.coalesce("adj_close", F.col("close") * F.col("adj_factor"), "close")
    positive = F.when(given > 0, given)
    adj = F.coalesce(F.last(positive, ignorenulls=True).over(running()), F.col("close"))
    return bars.withColumn("adj_close", adj).withColumn("adj_factor", F.coalesce(td(F.col("adj_close"), F.col("close")), F.lit(1.0)))


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends included; a plain comparison that reaches the scan."""
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


#: Security names of ordinary equity, and words that rule it out.
COMMON = r"(?i)\b(?:common stock|common shares?|ordinary shares?|capital stock|american depositary shares?|shares of beneficial interest)\b"
NOT_COMMON = (
    r"(?i)\b(?:warrants?|rights|units|preferred|preference|depositary units|debentures?|notes?|bonds?|subordinated|"
    r"when[- ]issued|contingent value|fund|closed[- ]end|index[- ]linked)\b"
)


def read_listing(spark, path: str) -> DataFrame:
    """A pipe-separated symbol directory; its footer line has no security name."""
    raw = spark.read.option("header", "true").option("sep", "|").csv(path)
    exchange = F.col("`Listing Exchange`") if "Listing Exchange" in raw.columns else F.lit("")
    named = raw.filter(F.col("Symbol").isNotNull() & F.col("`Security Name`").isNotNull())
    return named.select(F.col("Symbol").alias("symbol"), F.col("`Security Name`").alias("name"), exchange.alias("exchange"), F.col("ETF").alias("etf"), F.col("`Test Issue`").alias("test_issue"))


def classify_universe(listing: DataFrame, region: str = "US", snapshot: str | None = None) -> DataFrame:
    """symbol, name, exchange, etf, test_issue to a universe of etf, stock and other; one row a symbol."""
    name = F.trim("name")
    kind = F.when(F.upper("etf") == "Y", "etf").when(name.rlike(COMMON) & ~name.rlike(NOT_COMMON), "stock").otherwise("other")
    symbol = F.translate(F.upper(F.trim("symbol")), ".", "-")
    real = listing.filter(F.upper("test_issue") == "N")
    out = real.select(symbol.alias("symbol"), name.alias("name"), "exchange", kind.alias("asset_class"), F.lit(region).alias("region"), F.lit(snapshot).cast("timestamp").alias("snapshot_date"))
    first = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("name").asc_nulls_last(), "asset_class"))
    return out.filter("symbol != ''").withColumn("_n", first).filter("_n = 1").drop("_n")


def universe_symbols(universe: DataFrame, asset_class: str, region: str = "US") -> DataFrame:
    return universe.filter((F.col("asset_class") == asset_class) & (F.upper("region") == region.upper())).select("symbol").orderBy("symbol")
