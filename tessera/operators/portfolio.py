"""Target weights: constructors, constraints and scheduling.

Weights are sparse rows (ts, symbol, weight) on instruction dates only; a date without rows means
hold. All but four operators are window functions over the date. The four are grouped-map kernels:
the capped refill and the mean-variance solve by date, the no-trade band by symbol, the turnover cap
by run (its state couples all symbols over time).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.windows import by_date, clip, first_rank, pct_rank, td


def masked(context: DataFrame) -> Column:
    """The score of tradable names."""
    return F.when(F.coalesce("tradable", F.lit(False)), F.col("score")) if "tradable" in context.columns else F.col("score")


def gross_scaled(w: Column, gross: float) -> Column:
    return F.coalesce(td(w, F.sum(F.abs(w)).over(by_date())) * gross, F.lit(0.0))


def normalize_gross(weights: DataFrame, gross: float = 1.0) -> DataFrame:
    return weights.withColumn("weight", gross_scaled(F.col("weight"), gross))


def refill(w: np.ndarray, cap: float, target: float, rounds: int = 12) -> np.ndarray:
    """Clip to the cap and hand what was cut to names with room, in proportion to it, until both agree."""
    for _ in range(rounds):
        held = np.clip(w, -cap, cap)
        short = target - np.abs(held).sum()
        if abs(short) < 1e-12:
            return held
        room = np.where(held != 0, cap - np.abs(held), 0.0)
        total = room.sum()
        w = held + (np.sign(held) * room / total * short if total else 0.0)
    return np.clip(w, -cap, cap)


def cap_and_refill(weights: DataFrame, cap: float, gross: float | None = None, iterations: int = 12) -> DataFrame:
    """Names stay within the cap while each date keeps its gross, as far as there is room."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        w = frame["weight"].fillna(0.0).to_numpy()
        return frame.assign(weight=refill(w, cap, np.abs(w).sum() if gross is None else gross, iterations))

    return weights.groupBy("ts").applyInPandas(one, weights.schema)


# --- constructors: context (ts, symbol, score[, tradable, volatility]) -> (ts, symbol, weight) ---------


def _rows(context: DataFrame, weight: Column) -> DataFrame:
    return context.select("ts", "symbol", weight.alias("weight"))


def top_n_equal_weight(context: DataFrame, n: int = 50, long_only: bool = True, gross: float = 1.0) -> DataFrame:
    s = masked(context)
    held = context.withColumn("s", s)
    w = F.when(F.col("s").isNotNull() & (first_rank(F.col("s")) <= n), 1.0).otherwise(0.0)
    if not long_only:
        w = w - F.when(F.col("s").isNotNull() & (first_rank(F.col("s"), False) <= n), 1.0).otherwise(0.0)
    return normalize_gross(_rows(held, w), gross)


def quantile_long_short(context: DataFrame, quantiles: int = 5, gross: float = 1.0, net: float = 0.0) -> DataFrame:
    edge = 1.0 / quantiles
    held = context.withColumn("r", pct_rank(masked(context)))
    held = held.withColumns({"up": F.coalesce((F.col("r") > 1 - edge).cast("double"), F.lit(0.0)), "down": F.coalesce((F.col("r") <= edge).cast("double"), F.lit(0.0))})
    n_up, n_down = F.sum("up").over(by_date()), F.sum("down").over(by_date())
    w = F.when((n_up > 0) & (n_down > 0), F.col("up") / F.nullif(n_up, F.lit(0.0)) * ((gross + net) / 2) - F.col("down") / F.nullif(n_down, F.lit(0.0)) * ((gross - net) / 2))
    return _rows(held, F.coalesce(w, F.lit(0.0)))


def score_proportional(context: DataFrame, cap_per_name: float = 0.05, gross: float = 1.0, demean: bool = True) -> DataFrame:
    held = context.withColumn("s", masked(context))
    s = F.col("s") - F.avg("s").over(by_date()) if demean else F.col("s")
    return cap_and_refill(normalize_gross(_rows(held, F.coalesce(s, F.lit(0.0))), gross), cap_per_name, gross)


def inverse_vol_weighted(context: DataFrame, quantiles: int = 5, gross: float = 1.0, net: float = 0.0, floor: float = 0.05, volatility: str = "volatility") -> DataFrame:
    base = quantile_long_short(context, quantiles, gross, net)
    if volatility not in context.columns:
        return base
    held = base.join(context.select("ts", "symbol", F.col(volatility).alias("v")), ["ts", "symbol"])
    held = held.withColumn("w", F.coalesce(td(F.col("weight"), clip(F.col("v"), low=floor)), F.lit(0.0)))
    up, down = F.greatest("w", F.lit(0.0)), F.least("w", F.lit(0.0))
    return _rows(held, gross_scaled(up, (gross + net) / 2) + gross_scaled(down, (gross - net) / 2))


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Covariance (over T, not T-1) pulled towards a scaled identity by the analytic intensity."""
    t, n = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / t
    scale = np.trace(s) / n
    away = ((s - scale * np.eye(n)) ** 2).sum()
    noise = ((x**2).T @ (x**2) / t - s**2).sum() / t
    pull = min(max(noise / away, 0.0), 1.0) if away > 0 else 0.0
    return pull * scale * np.eye(n) + (1 - pull) * s


def mean_variance(context: DataFrame, returns: DataFrame, risk_aversion: float = 5.0, lookback: int = 252, max_names: int = 100, gross: float = 1.0, long_only: bool = False) -> DataFrame:
    """Markowitz weights with shrunk covariance, solved one date at a time.

    Each date gets the trailing returns (ts, symbol, ret_1d) of its names only: the top `max_names` by
    absolute score, joined to at most `lookback` dates, so a date's group is bounded by both.
    """
    dates = returns.select("ts").distinct().withColumn("d", F.row_number().over(W.orderBy("ts")))
    names = context.withColumn("s", masked(context)).filter("s is not null")
    names = names.withColumn("_n", F.row_number().over(by_date().orderBy(F.abs("s").desc(), "symbol"))).filter(F.col("_n") <= max_names)
    chosen = names.join(dates, "ts").select(F.col("ts").alias("at"), F.col("d").alias("at_d"), "symbol", "s")
    # Equal join on (symbol, block of dates): each instruction reaches the blocks that its lookback spans.
    block = F.floor(F.col("d") / lookback)
    history = returns.join(dates, "ts").select("symbol", "d", F.col("ret_1d").alias("x"), block.alias("block"))
    reach = chosen.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("at_d") / lookback), F.floor((F.col("at_d") - lookback + 1) / lookback)))))
    joined = reach.join(history, ["symbol", "block"]).filter((F.col("d") <= F.col("at_d")) & (F.col("d") > F.col("at_d") - lookback))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        first = int(frame["at_d"].iloc[0])
        window = frame.pivot(index="d", columns="symbol", values="x").reindex(range(max(1, first - lookback + 1), first + 1))
        window = window.dropna(axis=1, thresh=int(0.8 * len(window)))
        out = pd.DataFrame({"ts": [], "symbol": [], "weight": []})
        if window.shape[0] < 60 or window.shape[1] < 2:
            return out
        expected = frame.groupby("symbol")["s"].first().reindex(window.columns).to_numpy()
        try:
            raw = np.linalg.solve(risk_aversion * shrunk_covariance(window.fillna(0.0).to_numpy()), expected)
        except np.linalg.LinAlgError:
            return out
        raw = np.clip(raw, 0.0, None) if long_only else raw
        total = np.abs(raw).sum()
        if not total:
            return out
        return pd.DataFrame({"ts": frame["at"].iloc[0], "symbol": window.columns, "weight": raw / total * gross})

    solved = joined.select("at", "at_d", "symbol", "s", "d", "x").groupBy("at").applyInPandas(solve, "ts timestamp, symbol string, weight double")
    return context.select("ts", "symbol").join(solved, ["ts", "symbol"], "left").select("ts", "symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"))


CONSTRUCTORS: dict[str, Callable] = {
    "top_n_equal_weight": top_n_equal_weight, "quantile_long_short": quantile_long_short, "score_proportional": score_proportional,
    "inverse_vol_weighted": inverse_vol_weighted, "mean_variance": mean_variance,
}


def get_constructor(name: str, **parameters) -> Callable:
    if name not in CONSTRUCTORS:
        raise ValueError(f"unknown constructor {name!r}; there are {sorted(CONSTRUCTORS)}")
    return partial(CONSTRUCTORS[name], **parameters)


# --- constraints: (ts, symbol, weight[, beta, grp, tradable]) -> the same ------------------------------


def _w() -> Column:
    return F.col("weight")


def _held() -> Column:
    return (F.col("weight") != 0).cast("double")


def max_weight_per_name(w: DataFrame, limit: float = 0.05, iterations: int = 12) -> DataFrame:
    return cap_and_refill(w, limit, None, iterations)


def max_group_weight(w: DataFrame, limit: float = 0.25) -> DataFrame:
    """Scale a group down where its net exposure exceeds the limit."""
    if "grp" not in w.columns:
        return w
    net = F.abs(F.sum(_w()).over(W.partitionBy("ts", "grp")))
    return w.withColumn("weight", F.when(F.col("grp").isNotNull() & (net > limit), _w() * td(F.lit(limit), net)).otherwise(_w()))


def max_gross(w: DataFrame, limit: float = 1.0) -> DataFrame:
    gross = F.sum(F.abs(_w())).over(by_date())
    return w.withColumn("weight", _w() * F.coalesce(F.least(td(F.lit(limit), gross), F.lit(1.0)), F.lit(1.0)))


def max_net(w: DataFrame, limit: float = 0.1) -> DataFrame:
    """Shift held names by the same amount until the net is within the limit."""
    net = F.sum(_w()).over(by_date())
    return w.withColumn("weight", _w() + F.coalesce(td(_held(), F.sum(_held()).over(by_date())) * (clip(net, -limit, limit) - net), F.lit(0.0)))


def max_beta(w: DataFrame, limit: float = 0.2) -> DataFrame:
    """Shift held names so that the book's beta (1 where unknown) comes within the limit."""
    if "beta" not in w.columns:
        return w
    book = F.sum(_w() * F.coalesce("beta", F.lit(1.0))).over(by_date())
    mean = F.avg(F.when(_w() != 0, F.col("beta"))).over(by_date())
    shift = td(_held(), F.sum(_held()).over(by_date())) * td(clip(book, -limit, limit) - book, mean)
    return w.withColumn("weight", _w() + F.when(F.abs(book) > limit, F.coalesce(shift, F.lit(0.0))).otherwise(0.0))


def min_positions(w: DataFrame, minimum: int = 10) -> DataFrame:
    return w.withColumn("weight", F.when(F.sum(_held()).over(by_date()) >= minimum, _w()).otherwise(0.0))


def renormalize_gross(w: DataFrame, gross: float = 1.0) -> DataFrame:
    return normalize_gross(w, gross)


def tradable_only(w: DataFrame) -> DataFrame:
    return w.withColumn("weight", F.when(F.coalesce("tradable", F.lit(False)), _w()).otherwise(0.0))


CONSTRAINTS = {f.__name__: f for f in (max_weight_per_name, max_group_weight, max_gross, max_net, max_beta, min_positions, renormalize_gross, tradable_only)}
_FIRST = {"max_weight_per_name": "limit", "max_group_weight": "limit", "max_gross": "limit", "max_net": "limit", "max_beta": "limit", "min_positions": "minimum", "renormalize_gross": "gross"}


def build_chain(specification: dict) -> Callable[[DataFrame], DataFrame]:
    """{'max_weight_per_name': 0.05, 'min_positions': {'minimum': 20}, 'max_net': None} -> one function."""
    steps = []
    for name, argument in specification.items():
        if name not in CONSTRAINTS:
            raise ValueError(f"unknown constraint {name!r}")
        if argument is None:
            continue
        if name == "tradable_only":
            argument = {}
        steps.append(partial(CONSTRAINTS[name], **(argument if isinstance(argument, dict) else {_FIRST[name]: argument})))

    def apply(weights: DataFrame) -> DataFrame:
        for step in steps:
            weights = step(weights)
        return weights.withColumn("weight", F.coalesce("weight", F.lit(0.0)))

    return apply


# --- scheduling ----------------------------------------------------------------------------------------


def rebalance_dates(dates: DataFrame, frequency: str = "weekly") -> DataFrame:
    """The last date of each period (a week ends on Friday), a partial last one included."""
    if frequency in ("daily", "on_signal_change"):
        return dates.select("ts").distinct()
    period = {"weekly": F.date_trunc("week", F.col("ts") + F.expr("interval 2 days")), "monthly": F.date_trunc("month", "ts"), "quarterly": F.date_trunc("quarter", "ts")}
    if frequency not in period:
        raise ValueError(f"unknown frequency {frequency!r}")
    return dates.groupBy(period[frequency].alias("p")).agg(F.max("ts").alias("ts")).select("ts")


def no_trade_band(weights: DataFrame, epsilon: float) -> DataFrame:
    """A name keeps its last weight while the new one differs by less than epsilon; starts from 0.

    A name without a row on one of the table's dates has weight 0 there: it gets a row on the first such
    date, and on all of them while the band lets it keep a weight.
    """
    if epsilon <= 0:
        return weights
    by_name = W.partitionBy("symbol").orderBy("d")
    dates = weights.select("ts").distinct().withColumn("d", F.row_number().over(W.orderBy("ts")))  # one row a date
    held = weights.join(dates, "ts").select("symbol", "d", "weight", F.lead("d").over(by_name).alias("next"))
    count = dates.agg((F.max("d") + 1).alias("past"))
    held = held.join(F.broadcast(count), F.lit(True)).withColumn("next", F.coalesce("next", "past"))  # a single number
    present = held.select("symbol", "d", "weight", F.col("d").alias("until"))
    absent = held.filter("next > d + 1").select("symbol", (F.col("d") + 1).alias("d"), F.lit(0.0).alias("weight"), (F.col("next") - 1).alias("until"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("d")
        held, out = 0.0, []
        for w in frame["weight"].fillna(0.0).tolist():
            held = held if abs(w - held) < epsilon else w
            out.append(held)
        return frame.assign(weight=out)

    banded = present.unionByName(absent).groupBy("symbol").applyInPandas(one, "symbol string, d int, weight double, until int")
    until = F.when(F.col("weight") != 0, F.col("until")).otherwise(F.col("d"))
    return banded.select("symbol", "weight", F.explode(F.sequence("d", until)).alias("d")).join(dates, "d").select("ts", "symbol", "weight")


def limit_turnover(weights: DataFrame, maximum: float | None, run: str | None = None) -> DataFrame:
    """Move only part of the way to each date's weights, so that the sum of changes is at most `maximum`.

    The state couples all symbols over time: one task a run, in parallel over runs.
    """
    if not maximum or maximum <= 0:
        return weights
    columns = weights.columns

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="ts", columns="symbol", values="weight").sort_index().fillna(0.0)
        held, out = np.zeros(wide.shape[1]), []
        for row in wide.to_numpy():
            moved = np.abs(row - held).sum()
            held = held + (row - held) * (maximum / moved) if moved > maximum else row
            out.append(held)
        wide.iloc[:, :] = np.array(out)
        long = wide.reset_index().melt(id_vars="ts", value_name="weight", var_name="symbol")
        return long.assign(**{run: frame[run].iloc[0]})[columns] if run else long[columns]

    if run:
        return weights.groupBy(run).applyInPandas(one, weights.schema)
    return weights.withColumn("_run", F.lit(1)).groupBy("_run").applyInPandas(one, weights.schema)


def drop_unchanged(weights: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Only the dates whose weights differ from those of the date before; the first stays.

    A name without a row has weight 0, so that entries and exits are changes: each weight counts on its
    own date and, negative, on the next one; what is left of the sums by name is what moved.
    """
    dates = weights.select("ts").distinct().withColumn("d", F.row_number().over(W.orderBy("ts")))  # one row a date
    held = weights.join(dates, "ts")
    both = held.select("symbol", "d", _w().alias("w")).unionByName(held.select("symbol", (F.col("d") + 1).alias("d"), (-_w()).alias("w")))
    moved = both.groupBy("d", "symbol").agg(F.sum("w").alias("w")).groupBy("d").agg(F.sum(F.abs("w")).alias("m"))
    changed = dates.join(moved, "d").filter((F.col("m") > tolerance) | (F.col("d") == 1)).select("ts")
    return weights.join(changed, "ts", "left_semi")


def build_targets(context: DataFrame, constructor: Callable, constraints: Callable | None = None, rebalance: str = "weekly", epsilon: float = 0.0, max_turnover: float | None = None) -> DataFrame:
    """Scores to target weights on rebalance dates: constructor, constraints, band, turnover cap."""
    dates = rebalance_dates(context, rebalance)
    at = context.join(dates, "ts", "left_semi")
    weights = constructor(at)
    if constraints:
        extra = [c for c in ("beta", "grp", "tradable") if c in at.columns]
        weights = constraints(weights.join(at.select("ts", "symbol", *extra), ["ts", "symbol"])).select("ts", "symbol", "weight")
    weights = limit_turnover(no_trade_band(weights, epsilon), max_turnover)
    return drop_unchanged(weights) if rebalance == "on_signal_change" else weights
