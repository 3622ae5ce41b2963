"""Signals: transforms over each date, a library, combinations, and the information-coefficient report."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.windows import by_date, running, clip, mask_pair, pct_rank, safe_corr, td, with_ordinal

MIN_NAMES = 20


# --- transforms: DataFrame (ts, symbol, score, …) -> the same with score changed -----------------


def winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99, col: str = "score") -> DataFrame:
    """Clip each date to its own linear quantiles."""
    if not 0 <= lower < upper <= 1:
        raise ValueError("0 <= lower < upper <= 1 is needed")
    x = F.col(col)
    return df.withColumn(col, clip(x, F.percentile(x, F.lit(lower)).over(by_date()), F.percentile(x, F.lit(upper)).over(by_date())))


def _floor(x: Column, value: Column, minimum: int) -> Column:
    return F.when(F.count(x).over(by_date()) >= minimum, value)


def demean(df: DataFrame, minimum: int = MIN_NAMES, col: str = "score") -> DataFrame:
    x = F.col(col)
    return df.withColumn(col, _floor(x, x - F.avg(x).over(by_date()), minimum))


def zscore(df: DataFrame, minimum: int = MIN_NAMES, col: str = "score") -> DataFrame:
    x = F.col(col)
    return df.withColumn(col, _floor(x, td(x - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date())), minimum))


def rank_normalize(df: DataFrame, minimum: int = MIN_NAMES, col: str = "score") -> DataFrame:
    x = F.col(col)
    return df.withColumn(col, _floor(x, 2 * pct_rank(x) - 1, minimum))


def group_neutral(df: DataFrame, groups: DataFrame | None, col: str = "score") -> DataFrame:
    """Demean inside each group (groups: symbol, grp); names without a group become NULL."""
    if groups is None:
        return demean(df, 1, col)
    x = F.col(col)
    held = df.join(groups.select("symbol", F.col("grp").alias("_grp")), "symbol", "left")
    return held.withColumn(col, F.when(F.col("_grp").isNotNull(), x - F.avg(x).over(W.partitionBy("ts", "_grp")))).select(df.columns)


def beta_neutral(df: DataFrame, col: str = "score", beta: str = "beta") -> DataFrame:
    """Residual of each date's least-squares line on beta, over names that have both."""
    x, b = mask_pair(F.col(col), F.col(beta))
    slope = td(F.covar_pop(x, b).over(by_date()), F.var_pop(b).over(by_date()))
    return df.withColumn(col, (x - F.avg(x).over(by_date())) - slope * (b - F.avg(b).over(by_date())))


def neutralize(df: DataFrame, method: str = "none", groups: DataFrame | None = None) -> DataFrame:
    simple = {"none": lambda d: d, "demean": demean, "zscore": zscore, "rank": rank_normalize}
    if method in simple:
        return simple[method](df)
    if method == "group":
        if groups is None:
            raise ValueError("group neutralisation needs groups")
        return group_neutral(df, groups)
    if method == "beta":
        if "beta" not in df.columns:
            raise ValueError("beta neutralisation needs a beta column")
        return beta_neutral(df)
    raise ValueError(f"unknown neutralisation {method!r}")


# --- tradability and the signal library ----------------------------------------------------------


@dataclass(frozen=True)
class Tradability:
    min_price: float = 5.0
    min_dollar_volume: float = 1e6
    max_stale: float = 0.5
    require_history: int = 252

    def column(self) -> Column:
        close, liquid, stale = F.col("close"), F.col("advd_20"), F.col("stale_px_frac_20")
        ok = close.isNotNull() & (close >= self.min_price)
        if self.min_dollar_volume > 0:
            ok = ok & liquid.isNotNull() & (liquid >= self.min_dollar_volume)
        if self.max_stale < 1:
            ok = ok & (stale.isNull() | (stale <= self.max_stale))
        if self.require_history > 0:
            ok = ok & (F.count("close").over(running()) >= self.require_history)
        return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class Signal:
    """Raw column -> tradable names only -> winsorized -> neutralised; result (ts, symbol, score)."""

    metric: str
    sign: float = 1.0
    name: str = ""
    tradability: Tradability | None = None
    winsor: tuple[float, float] | None = (0.01, 0.99)
    neutralization: str = "none"

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.metric, *(("close", "advd_20", "stale_px_frac_20") if self.tradability else ()))

    def raw(self, panel: DataFrame) -> Column:
        return self.sign * F.col(self.metric)

    def compute(self, panel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        missing = [c for c in self.needs if c not in panel.columns]
        if missing:
            raise ValueError(f"the panel lacks {missing}")
        score = self.raw(panel)
        if self.tradability:
            score = F.when(self.tradability.column(), score)
        extra = [F.col("beta_252d").alias("beta")] if "beta_252d" in panel.columns else []
        df = panel.select("ts", "symbol", score.alias("score"), *extra)
        if self.winsor:
            df = winsorize(df, *self.winsor)
        return neutralize(df, self.neutralization, groups).select("ts", "symbol", "score")


class RandomSignal(Signal):
    """Standard normal noise that only depends on seed, date and symbol, wherever a row is computed."""

    def __init__(self, seed: int = 0, **how):
        super().__init__(metric="close", name=f"random_{seed}", **how)
        object.__setattr__(self, "seed", seed)

    def raw(self, panel: DataFrame) -> Column:
        def uniform(salt: str) -> Column:
            return (F.pmod(F.xxhash64(F.lit(f"{self.seed}{salt}"), "ts", "symbol"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)

        normal = F.sqrt(-2 * F.ln(uniform("a"))) * F.cos(2 * math.pi * uniform("b"))
        return F.when(F.col("close").isNotNull(), normal)


LIBRARY = {
    "momentum_12_1": lambda **how: Signal("mom_12_1", 1.0, "momentum_12_1", **how),
    "reversal_5d": lambda **how: Signal("ret_5d", -1.0, "reversal_5d", **how),
    "low_vol_20d": lambda **how: Signal("vol_20d", -1.0, "low_vol_20d", **how),
    "metric": lambda metric, sign=1.0, **how: Signal(metric, sign, metric if sign > 0 else f"neg_{metric}", **how),
    "random": lambda seed=0, **how: RandomSignal(seed, **how),
}


def signal_names() -> list[str]:
    return sorted(LIBRARY)


def get_signal(name: str, **parameters) -> Signal:
    if name not in LIBRARY:
        raise ValueError(f"unknown signal {name!r}; there are {signal_names()}")
    if isinstance(parameters.get("tradability"), dict):
        parameters["tradability"] = Tradability(**parameters["tradability"])
    return LIBRARY[name](**parameters)


@dataclass(frozen=True)
class CompositeSignal:
    """Weighted sum of normalised components; a name that lacks one takes 0 for it, one that lacks all is NULL."""

    components: Sequence[Signal]
    weights: Sequence[float] = field(default_factory=tuple)
    method: str = "rank"
    minimum: int = MIN_NAMES

    def __post_init__(self) -> None:
        weights = list(self.weights) or [1.0] * len(self.components)
        if not self.components or len(weights) != len(self.components) or not sum(map(abs, weights)):
            raise ValueError("components and weights must match, and not all weights be zero")
        if self.method not in ("rank", "zscore", "raw"):
            raise ValueError(f"unknown method {self.method!r}")
        object.__setattr__(self, "weights", [w / sum(map(abs, weights)) for w in weights])

    def compute(self, panel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        shape = {"rank": rank_normalize, "zscore": zscore}.get(self.method, lambda d, _: d)
        parts = [shape(s.compute(panel, groups), self.minimum).withColumnRenamed("score", f"s{k}") for k, s in enumerate(self.components)]
        joined = reduce(lambda a, b: a.join(b, ["ts", "symbol"], "full_outer"), parts)
        columns = [F.col(f"s{k}") for k in range(len(parts))]
        total = reduce(lambda a, b: a + b, [F.coalesce(w * c, F.lit(0.0)) for w, c in zip(self.weights, columns, strict=True)])
        return joined.select("ts", "symbol", F.when(F.coalesce(*columns).isNotNull(), total).alias("score"))


def rank_combine(components, weights=()):
    return CompositeSignal(components, weights, "rank")


def zscore_combine(components, weights=()):
    return CompositeSignal(components, weights, "zscore")


# --- information-coefficient report --------------------------------------------------------------


def _paired(scores: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    return scores.join(labels.select("ts", "symbol", F.col(label).alias("y")), ["ts", "symbol"], "left")


def ic_series(scores: DataFrame, labels: DataFrame, label: str = "fwd_ret_1d", minimum: int = MIN_NAMES) -> DataFrame:
    """Spearman correlation a date; each side is ranked over its own values, then paired."""
    held = _paired(scores, labels, label).withColumns({"rx": pct_rank(F.col("score")), "ry": pct_rank(F.col("y"))})
    x, y = mask_pair(F.col("rx"), F.col("ry"))
    return held.groupBy("ts").agg(F.when(F.count(x) >= minimum, safe_corr(F.col("rx"), F.col("ry"))).alias("ic"))


def _joint_rank(scores: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    held = _paired(scores, labels, label)
    x, y = mask_pair(F.col("score"), F.col("y"))
    return held.select("ts", "symbol", y.alias("y"), pct_rank(x).alias("r"))


def quantile_spread(scores: DataFrame, labels: DataFrame, label: str = "fwd_ret_1d", quantiles: int = 10, minimum: int = MIN_NAMES) -> DataFrame:
    """Mean label of the top quantile less that of the bottom, a date."""
    held, edge = _joint_rank(scores, labels, label), 1.0 / quantiles
    top, low = F.avg(F.when(F.col("r") > 1 - edge, F.col("y"))), F.avg(F.when(F.col("r") <= edge, F.col("y")))
    return held.groupBy("ts").agg(F.when(F.count("r") >= minimum, top - low).alias("spread"))


def quantile_returns(scores: DataFrame, labels: DataFrame, label: str = "fwd_ret_1d", quantiles: int = 10) -> DataFrame:
    """Mean label by bucket: over names on each date, then over dates."""
    held = _joint_rank(scores, labels, label).filter("r is not null")
    edges = F.array(*[F.lit((k + 1) / quantiles) for k in range(quantiles)])
    bucket = F.size(F.filter(edges, lambda e: F.col("r") > e))
    by_date = held.withColumn("bucket", F.least(bucket, F.lit(quantiles - 1))).groupBy("ts", "bucket").agg(F.avg("y").alias("y"))
    return by_date.groupBy("bucket").agg(F.avg("y").alias("mean_return"))


def turnover(scores: DataFrame) -> DataFrame:
    """Mean absolute change of rank against the panel's previous date; names absent there don't count."""
    held = with_ordinal(scores.select("ts", "symbol", pct_rank(F.col("score")).alias("r")))
    own = W.partitionBy("symbol").orderBy("d")
    before = F.when(F.lag("d").over(own) == F.col("d") - 1, F.lag("r").over(own))
    return held.withColumn("move", F.abs(F.col("r") - before)).groupBy("ts").agg(F.avg("move").alias("turnover"))


def autocorrelation(scores: DataFrame, lag: int = 1, minimum: int = MIN_NAMES) -> DataFrame:
    """Correlation of ranks with those `lag` panel dates before, a date."""
    held = with_ordinal(scores.select("ts", "symbol", pct_rank(F.col("score")).alias("r")))
    old = held.select("symbol", (F.col("d") + lag).alias("d"), F.col("r").alias("q"))
    both = held.join(old, ["symbol", "d"])
    x, _ = mask_pair(F.col("r"), F.col("q"))
    return both.groupBy("ts").agg(F.when(F.count(x) >= minimum, safe_corr(F.col("r"), F.col("q"))).alias("autocorr"))


def coverage(scores: DataFrame) -> DataFrame:
    return scores.groupBy("ts").agg(F.count("score").alias("coverage"))


def by_date_measures(scores: DataFrame, labels: DataFrame, label: str = "fwd_ret_1d", quantiles: int = 10, minimum: int = MIN_NAMES, lags=(1, 5, 21)) -> DataFrame:
    """One row a date: ic, spread, coverage, turnover and rank autocorrelations, of scores that are ranked once.

    Ranks are windows by date, their lags windows by symbol over date numbers: one join and two
    partitionings, whatever the number of measures.
    """
    x, y = mask_pair(F.col("score"), F.col("y"))
    ranked = with_ordinal(_paired(scores, labels, label)).withColumns({"rx": pct_rank(F.col("score")), "ry": pct_rank(F.col("y")), "r": pct_rank(x), "y": y})
    own = W.partitionBy("symbol").orderBy("d")
    held = ranked.withColumns({f"q{k}": F.max("rx").over(own.rangeBetween(-k, -k)) for k in {1, *lags}})
    edge = 1.0 / quantiles
    top, low = F.avg(F.when(F.col("r") > 1 - edge, F.col("y"))), F.avg(F.when(F.col("r") <= edge, F.col("y")))

    def paired(a: str, b: str) -> Column:
        return F.when(F.count(mask_pair(F.col(a), F.col(b))[0]) >= minimum, safe_corr(F.col(a), F.col(b)))

    return held.groupBy("ts").agg(
        paired("rx", "ry").alias("ic"), F.when(F.count("r") >= minimum, top - low).alias("spread"), F.count("score").alias("coverage"),
        F.avg(F.abs(F.col("rx") - F.col("q1"))).alias("turnover"), *[paired("rx", f"q{k}").alias(f"autocorr_{k}") for k in lags],
    )


def ic_summary(scores: DataFrame, labels: DataFrame, label: str = "fwd_ret_1d", quantiles: int = 10, minimum: int = MIN_NAMES, lags=(1, 5, 21)) -> DataFrame:
    """One row: IC mean, deviation, IR, t, hit rate, spread, turnover, coverage and rank autocorrelations."""
    ic, n = F.col("ic"), F.count("ic")
    return by_date_measures(scores, labels, label, quantiles, minimum, lags).agg(
        F.avg(ic).alias("ic_mean"), F.stddev_samp(ic).alias("ic_std"), (td(F.avg(ic), F.stddev_samp(ic)) * math.sqrt(252)).alias("ic_ir"),
        (td(F.avg(ic), F.stddev_samp(ic)) * F.sqrt(n)).alias("ic_t"), (F.count_if(ic > 0) / F.greatest(n, F.lit(1))).alias("ic_hit"), n.alias("n_dates"),
        F.avg("spread").alias("spread_mean"), F.avg("turnover").alias("turnover_mean"), F.avg("coverage").alias("coverage_mean"), *[F.avg(f"autocorr_{k}").alias(f"autocorr_{k}") for k in lags],
    )


def report(scores: DataFrame, labels: DataFrame, horizons=("fwd_ret_1d", "fwd_ret_5d", "fwd_ret_21d"), quantiles: int = 10, minimum: int = MIN_NAMES) -> dict[str, DataFrame]:
    """The whole report of a signal: `summary` (a row a horizon), `by_date` and `buckets` (horizon, bucket, mean return)."""
    label = lambda df, h: df.select(F.lit(h).alias("horizon"), "*")
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return {
        "summary": union([label(ic_summary(scores, labels, h, quantiles, minimum), h) for h in horizons]),
        "by_date": union([label(by_date_measures(scores, labels, h, quantiles, minimum), h) for h in horizons]),
        "buckets": union([label(quantile_returns(scores, labels, h, quantiles), h) for h in horizons]),
    }


def save_report(made: dict[str, DataFrame], folder: str) -> None:
    """Each part of a report as Parquet in a folder that driver and executors share."""
    for name, part in made.items():
        part.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")
