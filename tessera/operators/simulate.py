"""Backtest simulation: one grouped-map kernel, sequential in time, parallel over runs.

A run is a densified grid of bars with target weights on instruction dates. The kernel keeps cash
and shares, and goes bar by bar: split, dividend, closing of names that stopped trading, risk exits,
orders, financing, marking. Both engines share it: risk rules only need the entry, peak and trough
price of each position on top. The state of a run (a vector per symbol) is all that a task holds
besides its own bars.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


YEAR = 252.0
BPS = 1e-4
_FIELDS = ("open", "high", "low", "close", "volume", "dividend", "split_ratio", "vol_20d", "advd_20")


@dataclass(frozen=True)
class Execution:
    fill_price: str = "next_open"  # or close, vwap_proxy
    lag: int = 1
    participation_rate: float = 0.1
    carry_unfilled: bool = False
    initial_capital: float = 1_000_000.0
    allow_margin: bool = False
    whole_shares: bool = True
    #: Value positions at the pre-split price on the bar of a split, as the plain order of steps does.
    adjust_mark_on_split: bool = False

    def __post_init__(self) -> None:
        if self.fill_price not in ("next_open", "close", "vwap_proxy") or self.lag < 0 or not 0 < self.participation_rate <= 1:
            raise ValueError(f"bad execution settings {self}")


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 0.5
    commission_per_share: float = 0.0
    min_commission: float = 0.0
    half_spread_bps: float = 2.0
    estimate_spread_from_range: bool = True
    range_spread_factor: float = 0.02
    max_half_spread: float = 0.01
    impact_coefficient: float = 0.1
    borrow_bps_annual: float = 50.0
    cash_rate_annual: float = 0.0
    enabled: bool = True

    def commission(self, notional, shares):
        fee = np.maximum(notional * self.commission_bps * BPS + np.abs(shares) * self.commission_per_share, self.min_commission)
        return np.where(notional > 0, fee, 0.0) * self.enabled

    def spread(self, notional, high=None, low=None, close=None):
        half = np.full(np.shape(notional), self.half_spread_bps * BPS)
        if self.estimate_spread_from_range and high is not None:
            with np.errstate(all="ignore"):
                width = np.nan_to_num(self.range_spread_factor * (high - low) / np.where(close > 0, close, np.nan), nan=0.0, posinf=0.0, neginf=0.0)
            half = np.maximum(half, np.clip(width, 0.0, self.max_half_spread))
        return notional * half * self.enabled

    def slippage(self, notional, sigma, advd):
        with np.errstate(all="ignore"):
            share = np.nan_to_num(np.sqrt(np.clip(notional / np.where(advd > 0, advd, np.nan), 0.0, 1.0)), nan=0.0)
        return notional * self.impact_coefficient * np.nan_to_num(sigma, nan=0.02) / np.sqrt(YEAR) * share * self.enabled

    def financing(self, cash: float, short: float) -> float:
        """Cash after borrow fees on shorts and interest on what is left."""
        if not self.enabled:
            return cash
        cash -= max(short, 0.0) * self.borrow_bps_annual * BPS / YEAR
        return cash + cash * self.cash_rate_annual / YEAR


@dataclass(frozen=True)
class Risk:
    stop_loss: float | None = None
    trailing_stop: float | None = None
    take_profit: float | None = None

    def trigger(self, long: bool, low: float, high: float, entry: float, peak: float, trough: float) -> float | None:
        """The price at which the first rule that is met exits: stop, trailing stop, profit."""
        side = 1.0 if long else -1.0
        best = peak if long else trough
        for level, falling in (
            (entry * (1 - side * self.stop_loss) if self.stop_loss and entry > 0 else None, True),
            (best * (1 - side * self.trailing_stop) if self.trailing_stop and np.isfinite(best) and best > 0 else None, True),
            (entry * (1 + side * self.take_profit) if self.take_profit and entry > 0 else None, False),
        ):
            if level is not None and ((low <= level) if falling == long else (high >= level)):
                return level
        return None


class Book:
    """Cash, shares and the records of one run."""

    def __init__(self, grid: dict[str, np.ndarray], dates: list, symbols: list[str], execution: Execution, costs: Costs, risk: Risk):
        self.g, self.dates, self.symbols = grid, dates, np.array(symbols, dtype=object)
        self.execution, self.costs, self.risk = execution, costs, risk
        n = len(symbols)
        self.cash = execution.initial_capital
        self.shares, self.carried, self.last, self.adjusted = (np.zeros(n) for _ in range(4))
        self.entry, self.peak, self.trough = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        self.equity, self.positions, self.trades = [], [], []

    def record(self, t: int, at: np.ndarray, qty, price, commission, spread, slippage) -> None:
        for row in zip(self.symbols[at], np.atleast_1d(qty), np.atleast_1d(price), *(np.broadcast_to(x, len(at)) for x in (commission, spread, slippage)), strict=True):
            symbol, q, p, c, s, k = row
            self.trades.append((self.dates[t], symbol, "buy" if q > 0 else "sell", float(q), float(p), float(abs(q) * p), float(c), float(s), float(k)))

    def costs_of(self, t: int, at: np.ndarray, qty: np.ndarray, price: np.ndarray):
        notional, g = np.abs(qty) * price, self.g
        return self.costs.commission(notional, qty), self.costs.spread(notional, g["high"][t, at], g["low"][t, at], g["close"][t, at]), self.costs.slippage(notional, g["vol_20d"][t, at], g["advd_20"][t, at])

    def corporate_actions(self, t: int, priced: np.ndarray) -> None:
        ratio = self.g["split_ratio"][t]
        at = (ratio > 0) & (ratio != 1)
        self.adjusted[at] += self.shares[at] * (ratio[at] - 1)
        for x in (self.shares, self.carried):
            x[at] *= ratio[at]
        for x in (self.entry, self.peak, self.trough):
            x[at] /= ratio[at]
        if self.execution.adjust_mark_on_split:
            self.last[at] /= ratio[at]
        self.cash += float(self.shares @ np.nan_to_num(self.g["dividend"][t]))
        gone = np.flatnonzero(~priced & (self.shares != 0) & (self.last > 0))
        if len(gone):
            self.cash += float(self.shares[gone] @ self.last[gone])
            self.record(t, gone, -self.shares[gone], self.last[gone], 0.0, 0.0, 0.0)
            self.shares[gone] = self.carried[gone] = 0.0

    def risk_exits(self, t: int) -> None:
        low, high = self.g["low"][t], self.g["high"][t]
        for k in np.flatnonzero((self.shares != 0) & np.isfinite(low) & np.isfinite(high)):
            price = self.risk.trigger(self.shares[k] > 0, low[k], high[k], self.entry[k], self.peak[k], self.trough[k])
            if price is None:
                continue
            at, qty = np.array([k]), -self.shares[k : k + 1]
            notional = np.abs(qty) * price
            fee, spread = self.costs.commission(notional, qty), self.costs.spread(notional)
            self.cash += float(-qty[0] * price - fee[0] - spread[0])
            self.record(t, at, qty, np.array([price]), fee, spread, 0.0)
            self.shares[k] = 0.0

    def rebalance(self, t: int, weights: np.ndarray | None, fill: np.ndarray, priced: np.ndarray, worth: float) -> None:
        x, volume = self.execution, self.g["volume"][t]
        open_ = priced & np.isfinite(fill) & (fill > 0) & np.isfinite(volume) & (volume > 0)
        qty = np.zeros(len(fill))
        if weights is not None:
            want = np.where(open_, weights * worth / np.where(open_, fill, 1.0), self.shares)
            qty = (np.trunc(want) if x.whole_shares else want) - self.shares
        qty = np.where(open_, qty + (self.carried if x.carry_unfilled else 0.0), 0.0)
        room = x.participation_rate * np.nan_to_num(volume)
        done = np.clip(qty, -room, room)
        self.carried = qty - done if x.carry_unfilled else np.zeros(len(fill))
        self.settle(t, np.trunc(done) if x.whole_shares else done, fill)

    def settle(self, t: int, qty: np.ndarray, fill: np.ndarray) -> None:
        at = np.flatnonzero(qty)
        if not len(at):
            return
        order, price = qty[at], fill[at]
        if not self.execution.allow_margin:
            fee = sum(self.costs_of(t, at, order, price))
            buys = order > 0
            have = self.cash + float(-(order * price)[~buys].sum() - fee[~buys].sum())
            need = float((order * price)[buys].sum() + fee[buys].sum())
            if need > max(have, 0.0) and need > 0:
                order = np.where(buys, order * max(have / need, 0.0), order)
                order = np.trunc(order) if self.execution.whole_shares else order
        kept = order != 0
        at, order, price = at[kept], order[kept], price[kept]
        if not len(at):
            return
        parts = self.costs_of(t, at, order, price)
        self.cash -= float((order * price).sum() + sum(p.sum() for p in parts))
        before = self.shares[at].copy()
        self.shares[at] += order
        fresh = at[(before == 0) | (np.sign(before) != np.sign(self.shares[at]))]
        for x in (self.entry, self.peak, self.trough):
            x[fresh] = fill[fresh]
        self.record(t, at, order, price, *parts)

    def mark(self, t: int, priced: np.ndarray) -> None:
        now = np.where(priced, self.g["close"][t], self.last)
        self.cash = self.costs.financing(self.cash, float(-(np.minimum(self.shares, 0) * now).sum()))
        self.last = now
        value = self.shares * now
        held = np.flatnonzero(self.shares)
        self.peak[held], self.trough[held] = np.maximum(self.peak[held], now[held]), np.minimum(self.trough[held], now[held])
        up, down = float(np.maximum(value, 0).sum()), float(-np.minimum(value, 0).sum())
        total = self.cash + up - down
        self.equity.append((self.dates[t], total, self.cash, up - down, up, down))
        self.positions += [(self.dates[t], self.symbols[k], float(self.shares[k]), float(value[k]), float(value[k] / total) if total else 0.0) for k in held]

    def run(self, instructions: dict[int, np.ndarray]) -> None:
        g, x = self.g, self.execution
        fills = {"next_open": g["open"], "close": g["close"], "vwap_proxy": (g["high"] + g["low"] + g["close"]) / 3}[x.fill_price]
        risky = any((self.risk.stop_loss, self.risk.trailing_stop, self.risk.take_profit))
        for t in range(len(self.dates)):
            close = g["close"][t]
            priced = np.isfinite(close) & (close > 0)
            self.corporate_actions(t, priced)
            if risky:
                self.risk_exits(t)
            mark = np.where(self.last > 0, self.last, np.where(priced, close, 0.0))
            weights = instructions.get(t)
            if weights is not None or (x.carry_unfilled and self.carried.any()):
                self.rebalance(t, weights, fills[t], priced, self.cash + float(self.shares @ mark))
            self.mark(t, priced)


_EQUITY = "array<struct<ts:timestamp,equity:double,cash:double,position_value:double,long_value:double,short_value:double,gross:double,net:double,leverage:double,ret:double>>"
_POSITIONS = "array<struct<ts:timestamp,symbol:string,shares:double,value:double,weight:double>>"
_TRADES = "array<struct<ts:timestamp,symbol:string,side:string,qty:double,price:double,notional:double,commission:double,spread:double,slippage:double>>"
RESULT = f"run_id string, equity {_EQUITY}, positions {_POSITIONS}, trades {_TRADES}, adjustments array<struct<symbol:string,shares:double>>"
OPTIONS = [f.name for c in (Execution, Costs, Risk) for f in fields(c)]


def _names(kind: str) -> list[str]:
    import re

    return re.findall(r"(\w+):", kind)


def simulate_frame(frame: pd.DataFrame, execution: Execution, costs: Costs, risk: Risk) -> pd.DataFrame:
    """One run: rows (ts, symbol, bars…, weight) of a run_id to one result row."""
    frame = frame.drop_duplicates(["ts", "symbol"])
    dates, symbols = sorted(frame["ts"].unique()), sorted(frame["symbol"].unique())
    row, column = pd.Index(dates).get_indexer(frame["ts"]), pd.Index(symbols).get_indexer(frame["symbol"])

    def dense(name: str, empty: float) -> np.ndarray:
        out = np.full((len(dates), len(symbols)), empty)
        if name in frame:
            out[row, column] = frame[name].astype(float).fillna(empty)
        return out

    grid = {name: dense(name, 0.0 if name in ("dividend", "split_ratio") else np.nan) for name in _FIELDS}
    weights = dense("weight", np.nan)
    orders = {t + execution.lag: np.nan_to_num(w) for t, w in enumerate(weights) if not np.isnan(w).all() and t + execution.lag < len(dates)}
    stamps = [pd.Timestamp(d) for d in dates]
    book = Book(grid, stamps, symbols, execution, costs, risk)
    book.run(orders)
    equity, last = [], None
    for ts, total, cash, net, up, down in book.equity:
        gross = up + down
        equity.append((ts, total, cash, net, up, down, gross, net, gross / total if total else 0.0, total / last - 1 if last else 0.0))
        last = total

    def rows(kind: str, values: list) -> list[dict]:
        return [dict(zip(_names(kind), v, strict=True)) for v in values]

    return pd.DataFrame(
        {"run_id": [frame["run_id"].iloc[0]], "equity": [rows(_EQUITY, equity)], "positions": [rows(_POSITIONS, book.positions)], "trades": [rows(_TRADES, book.trades)],
         "adjustments": [[{"symbol": s, "shares": float(a)} for s, a in zip(symbols, book.adjusted, strict=True)]]}
    )


def simulate(market: DataFrame, targets: DataFrame, execution: Execution | None = None, costs: Costs | None = None, risk: Risk | None = None, options: dict[str, dict] | None = None) -> DataFrame:
    """One result row a run, of arrays (see RESULT); targets: (run_id, ts, symbol, weight).

    `options` overrides settings by run_id, so that a sweep is a single job. Only names that a run ever
    targets are simulated, as others stay at zero shares.
    """
    execution, costs, risk, options = execution or Execution(), costs or Costs(), risk or Risk(), options or {}
    have = [c for c in _FIELDS if c in market.columns]
    # Both are read by several branches below; they spill to disk where memory is short.
    market, targets = market.persist(), targets.select("run_id", "ts", "symbol", "weight").persist()
    names = targets.select("run_id", "symbol").distinct()
    dates = market.select("ts").distinct()
    runs = targets.select("run_id").distinct()
    bars = names.join(market.select("ts", "symbol", *have), "symbol")
    grid = bars.join(targets, ["run_id", "symbol", "ts"], "full_outer")
    # Each run sees every market date, even those on which none of its names trades.
    calendar = runs.join(F.broadcast(dates.agg(F.array_sort(F.collect_set("ts")).alias("all"))), F.lit(True)).select("run_id", F.explode("all").alias("ts"))
    first = names.groupBy("run_id").agg(F.min("symbol").alias("symbol"))
    grid = grid.select("run_id", "ts", "symbol", *have, "weight").unionByName(
        calendar.join(first, "run_id").join(bars.select("run_id", "symbol", "ts"), ["run_id", "symbol", "ts"], "left_anti").join(targets.select("run_id", "symbol", "ts"), ["run_id", "symbol", "ts"], "left_anti"), allowMissingColumns=True
    )

    def pick(kind, base, own):
        return replace(base, **{k: v for k, v in own.items() if k in {f.name for f in fields(kind)}})

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        own = options.get(frame["run_id"].iloc[0], {})
        return simulate_frame(frame, pick(Execution, execution, own), pick(Costs, costs, own), pick(Risk, risk, own))

    return grid.groupBy("run_id").applyInPandas(one, RESULT)


def equity(result: DataFrame) -> DataFrame:
    return result.selectExpr("run_id", "inline(equity)")


def positions(result: DataFrame) -> DataFrame:
    return result.selectExpr("run_id", "inline(positions)")


def trades(result: DataFrame) -> DataFrame:
    return result.selectExpr("run_id", "inline(trades)")


def check_invariants(result: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per run: cash + positions = equity on all dates; traded shares + splits = shares held at the end."""
    result = result.persist()
    e = equity(result)
    scale = F.greatest(F.max(F.abs("equity")), F.lit(1.0))
    books = e.groupBy("run_id").agg((F.max(F.abs(F.col("cash") + F.col("position_value") - F.col("equity"))) <= tolerance * scale).alias("balanced"), F.count_if(F.col("equity").isNull()).alias("n_missing"), F.max("ts").alias("ts"))
    moved = trades(result).select("run_id", "symbol", F.col("qty").alias("q")).unionByName(result.selectExpr("run_id", "inline(adjustments)").withColumnRenamed("shares", "q"))
    end = positions(result).join(books.select("run_id", "ts"), ["run_id", "ts"], "left_semi").select("run_id", "symbol", (-F.col("shares")).alias("q"))
    off = moved.unionByName(end).groupBy("run_id", "symbol").agg(F.abs(F.sum("q")).alias("off")).groupBy("run_id").agg((F.max("off") <= tolerance).alias("reconciled"))
    return books.join(off, "run_id", "left").select("run_id", "balanced", "n_missing", F.coalesce("reconciled", F.lit(True)).alias("reconciled"))


def cost_summary(trades: DataFrame) -> DataFrame:
    held = trades.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("commission", "spread", "slippage")])
    return held.withColumn("total", F.col("commission") + F.col("spread") + F.col("slippage"))


def cost_components(orders: DataFrame, costs: Costs | None = None) -> DataFrame:
    """Commission, spread and slippage as columns, for orders (qty, price, high, low, close, sigma, advd)."""
    c = costs or Costs()
    notional = F.abs("qty") * F.col("price")
    fee = F.when(notional > 0, F.greatest(notional * (c.commission_bps * BPS) + F.abs("qty") * c.commission_per_share, F.lit(c.min_commission))).otherwise(0.0)
    width = F.coalesce(F.try_divide(c.range_spread_factor * (F.col("high") - F.col("low")), F.when(F.col("close") > 0, F.col("close"))), F.lit(0.0))
    half = F.greatest(F.lit(c.half_spread_bps * BPS), F.least(F.greatest(width, F.lit(0.0)), F.lit(c.max_half_spread))) if c.estimate_spread_from_range else F.lit(c.half_spread_bps * BPS)
    used = F.try_divide(notional, F.col("advd"))
    share = F.when(F.col("advd") > 0, F.sqrt(F.least(used, F.lit(1.0)))).otherwise(0.0)
    slip = notional * c.impact_coefficient * F.coalesce("sigma", F.lit(0.02)) / float(np.sqrt(YEAR)) * share
    on = 1.0 if c.enabled else 0.0
    return orders.withColumns({"notional": notional, "commission": fee * on, "spread": notional * half * on, "slippage": slip * on})


def lagged(targets: DataFrame, dates: DataFrame, lag: int) -> DataFrame:
    """Instructions moved `lag` market dates on; those past the end fall away."""
    numbered = dates.select("ts").distinct().withColumn("d", F.row_number().over(W.orderBy("ts")))
    at = targets.join(numbered, "ts").withColumn("d", F.col("d") + lag).drop("ts")
    return at.join(numbered, "d").drop("d")


