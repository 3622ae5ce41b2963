"""Performance of equity curves (run_id, ts, equity) and of the trades behind them.

All measures are aggregates or windows keyed by run_id, so many runs are compared in one job.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.windows import td

YEAR = 252.0


def by_run():
    return W.partitionBy("run_id").orderBy("ts")


def returns(curve: DataFrame) -> DataFrame:
    """run_id, ts, equity, bar (its number), ret (NULL on the first bar), drawdown."""
    peak = F.max("equity").over(by_run().rowsBetween(W.unboundedPreceding, 0))
    return curve.select("run_id", "ts", "equity", F.row_number().over(by_run()).alias("bar"), (td(F.col("equity"), F.lag("equity").over(by_run())) - 1).alias("ret"), (td(F.col("equity"), peak) - 1).alias("drawdown"))


def drawdown_duration(curve: DataFrame) -> DataFrame:
    """Longest run of bars below the peak, by gaps and islands."""
    r = returns(curve)
    under = r.filter("drawdown < 0").withColumn("island", F.col("bar") - F.row_number().over(by_run()))
    longest = under.groupBy("run_id", "island").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.max("n").alias("n"))
    return r.select("run_id").distinct().join(longest, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("drawdown_duration"))


def monthly_returns(curve: DataFrame) -> DataFrame:
    """Compounded return of each month between the first and last; a month without bars has 0."""
    r = returns(curve).withColumn("month", F.date_trunc("month", "ts"))
    made = r.groupBy("run_id", "month").agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))
    span = r.groupBy("run_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = span.select("run_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(made, ["run_id", "month"], "left").select("run_id", "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def year_month_table(curve: DataFrame) -> DataFrame:
    m = monthly_returns(curve).withColumn("m", F.month("month"))
    return m.groupBy("run_id", F.year("month").alias("year")).pivot("m", list(range(1, 13))).agg(F.avg("ret"))


def var_cvar(curve: DataFrame, level: float = 0.05) -> DataFrame:
    r = returns(curve).filter("ret is not null")
    cut = r.groupBy("run_id").agg(F.percentile("ret", F.lit(level)).alias("value_at_risk"))
    return r.join(cut, "run_id").groupBy("run_id", "value_at_risk").agg(F.avg(F.when(F.col("ret") <= F.col("value_at_risk"), F.col("ret"))).alias("conditional_var"))


def _bias_free(n, g1, g2):
    skew = F.coalesce(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)), F.lit(0.0))
    kurt = F.coalesce(td(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6), F.lit(0.0))
    return F.when(n >= 3, skew), F.when(n >= 4, kurt)


def performance(curve: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row a run: return, risk and ratio measures. `threshold` is the return a bar is held against."""
    r = returns(curve)
    x = F.col("ret")
    n = F.count(x)
    agg = r.groupBy("run_id").agg(
        F.count("*").alias("bars"), F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("last"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.sqrt(F.avg(F.when(x.isNotNull(), F.pow(F.least(x - threshold, F.lit(0.0)), F.lit(2.0))))).alias("down"), F.min("drawdown").alias("max_drawdown"),
        F.count_if(x > 0).alias("n_up"), n.alias("n"), F.avg(F.when(x > 0, x)).alias("avg_win"), F.avg(F.when(x < 0, x)).alias("avg_loss"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("won"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("lost"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
    )
    growth, years = td(F.col("last"), F.col("first")), (F.col("bars") - 1) / YEAR
    ok = (F.col("bars") >= 2) & (F.col("first") != 0)
    skew, kurt = _bias_free(F.col("n"), F.col("g1"), F.col("g2"))
    cagr = F.when(~ok, 0.0).when(growth <= 0, -1.0).otherwise(F.pow(growth, 1 / F.nullif(years, F.lit(0.0))) - 1)
    root = math.sqrt(YEAR)
    held = agg.withColumns({"total_return": F.when(ok, growth - 1).otherwise(0.0), "cagr": cagr})
    return held.select(
        "run_id", "bars", "total_return", "cagr", (F.col("sd") * root).alias("annual_volatility"), (F.col("down") * root).alias("downside_deviation"), "max_drawdown",
        F.coalesce(td(F.col("mean") - threshold, F.col("sd")) * root, F.lit(0.0)).alias("sharpe"), F.coalesce(td((F.col("mean") - threshold) * YEAR, F.col("down") * root), F.lit(0.0)).alias("sortino"),
        F.coalesce(td(F.col("cagr"), F.abs("max_drawdown")), F.lit(0.0)).alias("calmar"), F.coalesce(td(F.col("n_up"), F.col("n")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce("avg_win", F.lit(0.0)).alias("avg_win"), F.coalesce("avg_loss", F.lit(0.0)).alias("avg_loss"),
        F.when(F.col("lost") > 0, F.col("won") / F.nullif(F.col("lost"), F.lit(0.0))).otherwise(float("inf")).alias("profit_factor"), skew.alias("skew"), kurt.alias("kurtosis"),
    )


def alpha_beta(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta and annual alpha against a benchmark curve, on the dates that both have."""
    a, b = returns(curve).select("run_id", "ts", F.col("ret").alias("x")), returns(benchmark).select("ts", F.col("ret").alias("y"))
    both = a.join(b, "ts").filter("x is not null and y is not null")
    held = both.groupBy("run_id").agg(F.count("*").alias("n"), td(F.covar_samp("x", "y"), F.var_samp("y")).alias("beta"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (td(F.avg(F.col("x") - F.col("y")), F.stddev_samp(F.col("x") - F.col("y"))) * math.sqrt(YEAR)).alias("ir"))
    beta = F.when(F.col("n") >= 3, F.col("beta"))
    return held.select("run_id", "n", beta.alias("beta"), ((F.col("mx") - beta * F.col("my")) * YEAR).alias("alpha"), F.when(F.col("n") >= 3, F.coalesce("ir", F.lit(0.0))).alias("information_ratio"))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int = 1) -> float:
    """Probability that the annual Sharpe ratio exceeds what the best of `trials` would show by luck; kurtosis is excess."""
    if n < 3 or trials < 1:
        return math.nan
    normal, per_bar = NormalDist(), sharpe / math.sqrt(YEAR)
    luck = 0.0
    if trials > 1:
        gamma = 0.5772156649015329  # fixed value: Euler's constant
        luck = ((1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))) / math.sqrt(n - 1)
    spread = 1 - skew * per_bar + (kurtosis + 2) / 4 * per_bar**2
    if spread <= 0:
        return math.nan
    return normal.cdf((per_bar - luck) * math.sqrt(n - 1) / math.sqrt(spread))


def holding_period(positions: DataFrame, curve: DataFrame) -> DataFrame:
    """Mean length in bars of uninterrupted holdings."""
    bars = curve.select("run_id", "ts", F.row_number().over(by_run()).alias("bar"))
    own = W.partitionBy("run_id", "symbol").orderBy("bar")
    held = positions.join(bars, ["run_id", "ts"]).withColumn("new", F.coalesce(F.col("bar") - F.lag("bar").over(own) != 1, F.lit(True)))
    return held.groupBy("run_id").agg(td(F.count("*"), F.count_if("new")).alias("avg_holding_days"))


def trading_stats(trades: DataFrame, curve: DataFrame) -> DataFrame:
    """Turnover a year, costs and their share of gross profit. Equity is carried forward onto trade dates.

    A run without trades has a row of zeros (and no mean notional).
    """
    by_day = trades.groupBy("run_id", "ts").agg(F.sum("notional").alias("notional"))
    joined = by_day.join(curve.select("run_id", "ts", "equity"), ["run_id", "ts"], "left").withColumn("equity", F.last("equity", ignorenulls=True).over(by_run()))
    turned = joined.groupBy("run_id").agg(F.sum(F.coalesce(td(F.col("notional"), F.col("equity")), F.lit(0.0))).alias("turned"))
    cost = F.col("commission") + F.col("spread") + F.col("slippage")
    paid = trades.groupBy("run_id").agg(F.count("*").alias("trade_count"), F.avg("notional").alias("avg_trade_notional"), F.sum(cost).alias("total_cost"), *[F.sum(c).alias(c) for c in ("commission", "spread", "slippage")])
    span = curve.groupBy("run_id").agg(F.count("*").alias("n"), (F.max_by("equity", "ts") - F.min_by("equity", "ts")).alias("gain"))
    whole = span.join(paid, "run_id", "left").join(turned, "run_id", "left")
    ratio = F.when(F.col("trade_count").isNull(), 0.0).otherwise(td(F.col("total_cost"), F.col("gain") + F.col("total_cost")))
    return whole.select(
        "run_id", F.coalesce("trade_count", F.lit(0)).alias("trade_count"), F.coalesce(F.col("turned") / (F.col("n") / YEAR), F.lit(0.0)).alias("annual_turnover"), "avg_trade_notional",
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), ratio.alias("cost_ratio"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("commission", "spread", "slippage")],
    )


def worst_month(curve: DataFrame) -> DataFrame:
    return monthly_returns(curve).groupBy("run_id").agg(F.min("ret").alias("worst_month"))


def headline(equity: DataFrame, trades: DataFrame | None = None, benchmark: DataFrame | None = None, positions: DataFrame | None = None, trials: int = 1) -> DataFrame:
    """Every measure of a run in one row; equity may have leverage and net. All tables here have one row a run."""
    curve = equity.select("run_id", "ts", "equity")
    none = F.lit(None).cast("double")
    level = F.nullif(F.col("equity"), F.lit(0.0))
    exposure = equity.groupBy("run_id").agg(
        F.min("ts").cast("date").cast("string").alias("start"), F.max("ts").cast("date").cast("string").alias("end"),
        F.avg(F.when(F.abs("leverage") != float("inf"), F.col("leverage"))).alias("avg_leverage") if "leverage" in equity.columns else F.first(none).alias("avg_leverage"),
        F.avg(F.col("net") / level).alias("avg_net_exposure") if "net" in equity.columns else F.first(none).alias("avg_net_exposure"),
    )
    made = performance(curve)
    for part in (drawdown_duration(curve), var_cvar(curve), worst_month(curve), exposure):
        made = made.join(part, "run_id", "left")
    deflate = F.udf(lambda s, n, g, k: None if None in (s, n, g, k) else (None if math.isnan(x := deflated_sharpe(s, n, g, k, trials)) else x), "double")  # one call a run
    made = made.withColumn("deflated_sharpe", deflate("sharpe", (F.col("bars") - 1).cast("int"), "skew", "kurtosis")).withColumn("trials", F.lit(trials))
    if trades is not None:
        made = made.join(trading_stats(trades, curve), "run_id", "left")
    if positions is not None:
        count = positions.groupBy("run_id").agg(F.count("*").alias("held"))
        made = made.join(holding_period(positions, curve), "run_id", "left").join(count, "run_id", "left")
        made = made.withColumn("avg_positions", F.coalesce("held", F.lit(0)) / F.greatest("bars", F.lit(1))).drop("held").fillna(0.0, ["avg_holding_days"])
    if benchmark is not None:
        made = made.join(alpha_beta(curve, benchmark).drop("n"), "run_id", "left")
    return made


def contribution_by_symbol(positions: DataFrame, top: int = 20) -> DataFrame:
    held = positions.groupBy("run_id", "symbol").agg(F.avg("weight").alias("mean_weight"), F.count("*").alias("days_held"))
    rank = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("days_held"), "symbol"))
    return held.withColumn("_n", rank).filter(F.col("_n") <= top).drop("_n")


def compare(curve: DataFrame) -> DataFrame:
    """All runs side by side, best Sharpe ratio first."""
    return performance(curve).join(drawdown_duration(curve), "run_id").join(var_cvar(curve), "run_id", "left").orderBy(F.desc("sharpe"), "run_id")


def tearsheet(curve: DataFrame, title: str = "Backtest") -> str:
    """A self-contained HTML report: a table of measures and the equity curve as inline SVG (one run)."""
    from html import escape

    row = compare(curve).first().asDict()
    points = [(r.ts, r.equity) for r in curve.orderBy("ts").select("ts", "equity").collect()]  # one point a bar of one run
    low, high = min(e for _, e in points), max(e for _, e in points)
    step, scale = 900 / max(len(points) - 1, 1), 260 / ((high - low) or 1)
    path = " ".join(f"{k * step:.1f},{280 - (e - low) * scale:.1f}" for k, (_, e) in enumerate(points))
    cells = "".join(f"<tr><th>{escape(k)}</th><td>{escape(f'{v:.6g}' if isinstance(v, float) else str(v))}</td></tr>" for k, v in row.items())
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1><svg viewBox="0 0 900 300"><polyline fill="none" stroke="#246" points="{path}"/></svg><table>{cells}</table>'
