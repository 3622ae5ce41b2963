"""Features across symbols on a date, and against the market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.windows import ANNUALIZE, by_date, mask_pair, pct_rank, root, td, with_ordinal

MIN_BREADTH = 20
RANKED = ("ret_21d", "mom_12_1", "vol_20d", "advd_20", "rsi_14")
SCORED = ("ret_21d", "mom_12_1")


def broad(x, value, minimum: int = MIN_BREADTH):
    """`value`, NULL on dates with fewer than `minimum` values of x."""
    return F.when(F.count(x).over(by_date()) >= minimum, value)


def cs_rank(x, minimum: int = MIN_BREADTH):
    return broad(x, pct_rank(x), minimum)


def cs_zscore(x, minimum: int = MIN_BREADTH):
    return broad(x, td(x - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date())), minimum)


def ranks_and_scores(features: DataFrame, ranked=RANKED, scored=SCORED) -> DataFrame:
    out = {f"cs_rank_{n}": cs_rank(F.col(n)) for n in ranked} | {f"cs_z_{n}": cs_zscore(F.col(n)) for n in scored}
    return features.select("ts", "symbol", *[c.alias(n) for n, c in out.items()])


def market(features: DataFrame, minimum: int = MIN_BREADTH) -> DataFrame:
    """One row a date: equal-weight return, its index, trailing returns and volatility. Dates, not symbols, bound its size."""
    by_date = features.groupBy("ts").agg(F.when(F.count("ret_1d") >= minimum, F.avg("ret_1d")).alias("mkt_ret_1d"))
    order = W.orderBy("ts")
    m = F.col("mkt_ret_1d")
    level = F.product(1 + F.coalesce(m, F.lit(0.0))).over(order.rowsBetween(W.unboundedPreceding, 0))
    last20 = order.rowsBetween(-19, 0)
    held = by_date.withColumn("level", level)
    x = F.col("level")
    return held.select(
        "ts", "mkt_ret_1d", (td(x, F.lag(x, 21).over(order)) - 1).alias("mkt_ret_21d"), (td(x, F.lag(x, 252).over(order)) - 1).alias("mkt_ret_252d"),
        F.when(m.isNotNull(), x).alias("mkt_index"), F.when(F.count(m).over(last20) >= 20, F.stddev_samp(m).over(last20) * ANNUALIZE).alias("mkt_vol_20d"),
    )


def densify(features: DataFrame) -> DataFrame:
    """All dates for each symbol (a symbol's row is NULL where it has no bar): per-symbol sequences of the
    date list, joined back by key, so that no row meets all others."""
    dates = features.select("ts").distinct().agg(F.array_sort(F.collect_set("ts")).alias("all"))
    grid = features.select("symbol").distinct().join(F.broadcast(dates), F.lit(True)).select("symbol", F.explode("all").alias("ts"))
    return grid.join(features, ["ts", "symbol"], "left")


def risk_to_market(features: DataFrame, window: int = 252, minimum: int = 126) -> DataFrame:
    """beta, correlation and idiosyncratic volatility over the last `window` market dates."""
    mkt = with_ordinal(market(features)).select("ts", "d", F.col("mkt_ret_1d").alias("m"))
    dates = W.orderBy("d").rowsBetween(-(window - 1), 0)
    mkt = mkt.withColumn("m_var", F.when(F.count("m").over(dates) >= minimum, F.var_samp("m").over(dates)))
    held = features.select("ts", "symbol", F.col("ret_1d").alias("r")).join(mkt, "ts")
    frame = W.partitionBy("symbol").orderBy("d").rangeBetween(-(window - 1), 0)
    x, y = mask_pair(F.col("r"), F.col("m"))
    enough = F.count(x).over(frame) >= minimum
    cov = F.when(enough, F.covar_samp(x, y).over(frame))
    corr = F.when(enough, td(F.covar_pop(x, y).over(frame), F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)))
    own = F.when(F.count("r").over(frame) >= minimum, F.stddev_samp("r").over(frame))
    return held.withColumns({"beta_252d": td(cov, F.col("m_var")), "corr_mkt_252d": corr, "own": own}).select(
        "ts", "symbol", "beta_252d", "corr_mkt_252d", (F.col("own") * root(1 - F.col("corr_mkt_252d") * F.col("corr_mkt_252d")) * ANNUALIZE).alias("idio_vol_252d")
    )


def relative_return(features: DataFrame) -> DataFrame:
    mkt = market(features).select("ts", "mkt_ret_21d")
    return features.join(mkt, "ts").select("ts", "symbol", (F.col("ret_21d") - F.col("mkt_ret_21d")).alias("rel_ret_21d"))


def panel(features: DataFrame, window: int = 252, minimum: int = 126) -> DataFrame:
    """All cross-sectional features beside the given ones, from one reading of the panel: the market (a row
    a date) is attached by date, ranks and scores are windows by date, betas windows by symbol."""
    mkt = with_ordinal(market(features)).withColumn("m", F.col("mkt_ret_1d"))
    dates = W.orderBy("d").rowsBetween(-(window - 1), 0)
    mkt = mkt.withColumn("m_var", F.when(F.count("m").over(dates) >= minimum, F.var_samp("m").over(dates)))
    added = {f"cs_rank_{n}": cs_rank(F.col(n)) for n in RANKED} | {f"cs_z_{n}": cs_zscore(F.col(n)) for n in SCORED}
    held = features.join(mkt, "ts").withColumns(added)
    frame = W.partitionBy("symbol").orderBy("d").rangeBetween(-(window - 1), 0)
    x, y = mask_pair(F.col("ret_1d"), F.col("m"))
    enough = F.count(x).over(frame) >= minimum
    corr = F.when(enough, td(F.covar_pop(x, y).over(frame), F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)))
    own = F.when(F.count("ret_1d").over(frame) >= minimum, F.stddev_samp("ret_1d").over(frame))
    held = held.withColumns({"beta_252d": td(F.when(enough, F.covar_samp(x, y).over(frame)), F.col("m_var")), "corr_mkt_252d": corr, "_own": own})
    idio = F.col("_own") * root(1 - F.col("corr_mkt_252d") * F.col("corr_mkt_252d")) * ANNUALIZE
    return held.withColumns({"idio_vol_252d": idio, "rel_ret_21d": F.col("ret_21d") - F.col("mkt_ret_21d")}).drop("_own", "m", "m_var", "d")
