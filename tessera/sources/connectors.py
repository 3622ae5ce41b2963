"""Connectors: where raw bars come from. A connector answers one request for many symbols with long tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from datetime import UTC, datetime, timedelta
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Connector(ABC):
    """Base class. `fetch` takes the plan (symbol, start) as a table and never raises for one bad symbol."""

    name: ClassVar[str] = "base"
    #: Intervals it serves (empty: all) and how far back each may be asked for.
    intervals: ClassVar[frozenset[str]] = frozenset()
    lookback: ClassVar[dict[str, timedelta]] = {}

    @abstractmethod
    def fetch(self, spark: SparkSession, plan: DataFrame, interval: str, end: datetime | None = None) -> tuple[DataFrame, DataFrame]:
        """(raw bars with a symbol column, errors as symbol and message)."""

    def check_interval(self, interval: str) -> str:
        if self.intervals and interval not in self.intervals:
            raise ValueError(f"{self.name} does not serve {interval!r}; there are {sorted(self.intervals)}")
        return interval

    def clamp_start(self, interval: str, start: datetime | None, now: datetime | None = None) -> datetime | None:
        """No earlier than the connector reaches back."""
        if interval not in self.lookback:
            return start
        earliest = (now or datetime.now(UTC).replace(tzinfo=None)) - self.lookback[interval]
        return earliest if start is None else max(start, earliest)


class TableConnector(Connector):
    """A raw table of many symbols that Spark can read: vendor columns and a symbol column."""

    name = "table"

    def __init__(self, raw: DataFrame):
        self.raw = raw

    def fetch(self, spark, plan, interval, end=None):
        symbol = next(c for c in self.raw.columns if c.lower() in ("symbol", "ticker"))
        asked = plan.select(F.col("symbol").alias("_asked")).distinct()
        raw = self.raw.join(asked, F.upper(F.trim(F.col(f"`{symbol}`").cast("string"))) == F.col("_asked"), "left_semi")
        return raw, spark.createDataFrame([], "symbol string, message string")


class FileConnector(TableConnector):
    """A folder of Parquet files, or of CSV files with a header, which Spark lists and reads."""

    name = "files"

    def __init__(self, spark: SparkSession, folder: str, form: str = "parquet"):
        reader = spark.read.option("header", "true") if form == "csv" else spark.read
        super().__init__(reader.format(form).load(folder))


_REGISTRY: dict[str, type[Connector]] = {}


def register(connector: type[Connector]) -> type[Connector]:
    _REGISTRY[connector.name] = connector
    return connector


def connector_names() -> list[str]:
    return sorted(_REGISTRY)


def get_connector(name: str, *arguments, **named) -> Connector:
    if name not in _REGISTRY:
        raise ValueError(f"unknown connector {name!r}; there are {connector_names()}")
    return _REGISTRY[name](*arguments, **named)


for _kind in (TableConnector, FileConnector):
    register(_kind)
