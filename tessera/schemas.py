"""Fixed schemas of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**kinds) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in kinds.items()])


_D = DoubleType
PRICES = ("open", "high", "low", "close")
BAR = _struct(ts=TimestampType, symbol=StringType, open=_D, high=_D, low=_D, close=_D, volume=_D, adj_close=_D, adj_factor=_D, dividend=_D, split_ratio=_D, repaired=BooleanType)
PARTITION_COLUMNS = ("region", "asset_class", "interval")
STATE_KEY = ("symbol", *PARTITION_COLUMNS, "provider")
STATE = _struct(symbol=StringType, region=StringType, asset_class=StringType, interval=StringType, provider=StringType, first_ts=TimestampType, last_ts=TimestampType, row_count=LongType, status=StringType, message=StringType, updated_at=TimestampType)
UNIVERSE = _struct(symbol=StringType, name=StringType, exchange=StringType, asset_class=StringType, region=StringType, snapshot_date=TimestampType)
EQUITY = "run_id string, ts timestamp, equity double, cash double, position_value double, long_value double, short_value double, gross double, net double, leverage double, ret double"
POSITIONS = "run_id string, ts timestamp, symbol string, shares double, value double, weight double"
TRADES = "run_id string, ts timestamp, symbol string, side string, qty double, price double, notional double, commission double, spread double, slippage double"

#: Bar lengths in days (months as 30.4, quarters as 91), and bars a year by interval.
INTERVAL_DAYS = {"1m": 1 / 1440, "2m": 2 / 1440, "5m": 5 / 1440, "15m": 15 / 1440, "30m": 30 / 1440, "60m": 60 / 1440, "90m": 90 / 1440, "1h": 60 / 1440, "1d": 1.0, "5d": 5.0, "1wk": 7.0, "1mo": 30.0, "3mo": 91.0}
PERIODS_PER_YEAR = {"1m": 98280, "5m": 19656, "15m": 6552, "30m": 3276, "60m": 1638, "1h": 1638, "1d": 252, "5d": 52, "1wk": 52, "1mo": 12, "3mo": 4}


def periods_per_year(interval: str) -> int:
    return PERIODS_PER_YEAR.get(interval, 252)


@dataclass(frozen=True)
class Partition:
    """Where a bar table lives: region, asset class and interval."""

    region: str = "us"
    asset_class: str = "stocks"
    interval: str = "1d"

    def __post_init__(self) -> None:
        for value in (self.region, self.asset_class):
            if not value or not value.replace("_", "").replace("-", "").isalnum() or value != value.lower():
                raise ValueError(f"bad partition value {value!r}")
        if self.interval not in INTERVAL_DAYS:
            raise ValueError(f"unknown interval {self.interval!r}")
