"""Per-symbol features and labels.

All of them are windows over one partitioning and order (symbol, ts), so Spark shuffles and sorts
once; nested ones are layers of projections. Only the recursive averages (Wilder, EMA) run in a
grouped-map kernel, one symbol at a time, and only if asked for.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import ANNUALIZE, running, clip, kurt, lag, roll, root, skew, td, trailing
from tessera.operators.cleaning import with_adjustments

PASSED = ("open", "high", "low", "close", "volume", "adj_close", "adj_factor", "dividend", "split_ratio", "repaired")
RECURSIVE = ("rsi_14", "macd_line", "macd_signal", "macd_hist", "adx_14", "atr_14", "natr_14")
#: Rows of history before a feature is first defined, by the formulas below.
MIN_PERIODS = {name: 1 for name in PASSED} | {
    "ret_1d": 2, "logret_1d": 2, "ret_5d": 6, "ret_21d": 22, "ret_63d": 64, "ret_126d": 127, "ret_252d": 253, "ret_overnight": 2, "ret_intraday": 1,
    "mom_12_1": 253, "px_to_sma_10": 10, "px_to_sma_20": 20, "px_to_sma_50": 50, "px_to_sma_200": 200, "sma_50_to_200": 200, "dist_52w_high": 252, "dist_52w_low": 252,
    "rsi_14": 15, "macd_line": 26, "macd_signal": 34, "macd_hist": 34, "adx_14": 27,
    "vol_20d": 21, "vol_60d": 61, "vol_252d": 253, "parkinson_20d": 20, "garman_klass_20d": 20, "yang_zhang_20d": 21, "atr_14": 14, "natr_14": 14, "downside_dev_60d": 61,
    "sharpe_252d": 253, "sortino_252d": 253, "skew_252d": 253, "kurt_252d": 253, "dd_from_252d_high": 1, "max_dd_252d": 252, "hit_rate_252d": 253,
    "dollar_vol": 1, "advd_20": 20, "advd_60": 60, "amihud_60d": 61, "vol_zscore_20": 20, "obv": 1, "dist_vwap_20": 20, "zero_vol_frac_20": 20, "stale_px_frac_20": 20,
    "bb_pctb_20": 20, "bb_width_20": 20, "zscore_20": 20, "stoch_k_14": 14, "stoch_d_14": 16, "willr_14": 14, "cci_20": 20,
}
LABELS = {"fwd_ret_1d": 1, "fwd_ret_5d": 5, "fwd_ret_21d": 21}
LN2 = math.log(2.0)


def metric_names() -> list[str]:
    return list(MIN_PERIODS)


def adjusted(bars: DataFrame) -> DataFrame:
    """Bars with guarded adjustments and adjusted prices o, h, l, c."""
    held = with_adjustments(bars)
    return held.withColumns({"o": F.col("open") * F.col("adj_factor"), "h": F.col("high") * F.col("adj_factor"), "l": F.col("low") * F.col("adj_factor"), "c": F.col("adj_close")})


def _layers() -> list[dict]:
    o, h, l, c = map(F.col, "ohlc")  # noqa: E741
    rc, v = F.col("close"), F.col("volume")
    raw_tp = (F.col("high") + F.col("low") + rc) / 3.0
    ln = lambda a, b: F.ln(td(a, b))
    first = {"pc": lag(c), "prc": lag(rc)}
    pc = F.col("pc")
    flat = {
        "ret_1d": td(c, pc) - 1, "logret_1d": ln(c, pc), **{f"ret_{w}d": td(c, lag(c, w)) - 1 for w in (5, 21, 63, 126, 252)},
        "ret_overnight": td(o, pc) - 1, "ret_intraday": td(c, o) - 1, "mom_12_1": td(lag(c, 21), lag(c, 252)) - 1,
        "lhl": ln(h, l), "lco": ln(c, o), "lho": ln(h, o), "llo": ln(l, o), "lop": ln(o, pc),
        "dollar_vol": rc * v, "tp": (h + l + c) / 3.0, "tpv": raw_tp * v, "stale": F.coalesce(rc == F.col("prc"), F.lit(False)).cast("double"), "empty": (v == 0).cast("double"),
        "signed": F.coalesce(F.signum(rc - F.col("prc")), F.lit(0.0)) * v, "dd_from_252d_high": td(c, F.max(c).over(trailing(252))) - 1,
        "lo14": roll(F.min, l, 14), "hi14": roll(F.max, h, 14), "sma50": roll(F.avg, c, 50), "sma200": roll(F.avg, c, 200), "m20": roll(F.avg, c, 20), "s20": roll(F.stddev_samp, c, 20),
    }
    r, lr = F.col("ret_1d"), F.col("logret_1d")
    lhl, lco, lho, llo = map(F.col, ("lhl", "lco", "lho", "llo"))
    m20, s20, dv = F.col("m20"), F.col("s20"), F.col("dollar_vol")
    second = {
        "gk": 0.5 * lhl * lhl - (2 * LN2 - 1) * lco * lco, "rs": lho * (lho - lco) + llo * (llo - lco), "hl2": lhl * lhl, "down_r": clip(r, high=0.0), "down_lr": clip(lr, high=0.0),
        "hit": F.when(r.isNotNull(), (r > 0).cast("double")), "illiq": td(F.abs(r), dv),
        "stoch_k_14": 100.0 * td(c - F.col("lo14"), F.col("hi14") - F.col("lo14")), "tps": F.when(F.count("tp").over(trailing(20)) == 20, F.collect_list("tp").over(trailing(20))),
    }
    k = 0.34 / (1.34 + 21 / 19)
    full = F.count(r).over(trailing(252)) >= 252
    mean_tp = roll(F.avg, F.col("tp"), 20)
    third = {
        **{f"px_to_sma_{w}": td(c, roll(F.avg, c, w)) - 1 for w in (10, 20, 50, 200)}, "sma_50_to_200": td(F.col("sma50"), F.col("sma200")) - 1,
        "dist_52w_high": td(c, roll(F.max, h, 252)) - 1, "dist_52w_low": td(c, roll(F.min, l, 252)) - 1,
        **{f"vol_{w}d": roll(F.stddev_samp, lr, w) * ANNUALIZE for w in (20, 60, 252)},
        "parkinson_20d": root(roll(F.avg, F.col("hl2"), 20) / (4 * LN2)) * ANNUALIZE, "garman_klass_20d": root(roll(F.avg, F.col("gk"), 20)) * ANNUALIZE,
        "yang_zhang_20d": root(roll(F.var_samp, F.col("lop"), 20) + k * roll(F.var_samp, lco, 20) + (1 - k) * roll(F.avg, F.col("rs"), 20)) * ANNUALIZE,
        "downside_dev_60d": roll(F.stddev_samp, F.col("down_lr"), 60) * ANNUALIZE,
        "sharpe_252d": td(roll(F.avg, r, 252), roll(F.stddev_samp, r, 252)) * ANNUALIZE, "sortino_252d": td(roll(F.avg, r, 252), roll(F.stddev_samp, F.col("down_r"), 252)) * ANNUALIZE,
        "skew_252d": F.when(full, skew(r, 252, trailing(252))), "kurt_252d": F.when(full, kurt(r, 252, trailing(252))),
        "max_dd_252d": roll(F.min, F.col("dd_from_252d_high"), 252), "hit_rate_252d": roll(F.avg, F.col("hit"), 252),
        "advd_20": roll(F.avg, dv, 20), "advd_60": roll(F.avg, dv, 60), "amihud_60d": roll(F.avg, F.col("illiq"), 60) * 1e6,
        "vol_zscore_20": td(v - roll(F.avg, v, 20), roll(F.stddev_samp, v, 20)), "obv": F.sum("signed").over(running()), "dist_vwap_20": td(rc, td(roll(F.sum, F.col("tpv"), 20), roll(F.sum, v, 20))) - 1,
        "zero_vol_frac_20": roll(F.avg, F.col("empty"), 20), "stale_px_frac_20": roll(F.avg, F.col("stale"), 20),
        "bb_pctb_20": td(c - (m20 - 2 * s20), 4 * s20), "bb_width_20": td(4 * s20, m20), "zscore_20": td(c - m20, s20),
        "stoch_d_14": roll(F.avg, F.col("stoch_k_14"), 3), "willr_14": F.col("stoch_k_14") - 100, "mean_tp": mean_tp,
    }
    spread = F.aggregate("tps", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("mean_tp"))) / 20
    fourth = {"cci_20": td(F.col("tp") - F.col("mean_tp"), 0.015 * spread)}
    return [first, flat, second, third, fourth]


def features(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(ts, symbol, features). Columns that aren't asked for are pruned from the plan."""
    names = names or metric_names()
    unknown = [n for n in names if n not in MIN_PERIODS]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    held = adjusted(bars)
    if any(n in RECURSIVE for n in names):
        held = recursive(held)
    for layer in _layers():
        held = held.withColumns(layer)
    return held.select("ts", "symbol", *names)


def labels(bars: DataFrame) -> DataFrame:
    """Forward returns of the adjusted close; kept apart from features as they look ahead."""
    held = with_adjustments(bars)
    return held.select("ts", "symbol", *[(td(lag(F.col("adj_close"), -n), F.col("adj_close")) - 1).alias(name) for name, n in LABELS.items()])


def wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1.0 / n, adjust=False, min_periods=n).mean()


def ema(x: pd.Series, span: int) -> pd.Series:
    return x.ewm(span=span, adjust=False, min_periods=span).mean()


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def _recurse(frame: pd.DataFrame) -> pd.DataFrame:
    """One symbol's recursive averages."""
    frame = frame.sort_values("ts", ignore_index=True)
    h, l, c = frame["h"], frame["l"], frame["c"]  # noqa: E741
    move = c.diff()
    gain, loss = wilder(move.clip(lower=0), 14), wilder((-move).clip(lower=0), 14)
    frame["rsi_14"] = (100 * gain / (gain + loss).where(lambda s: s > 0)).where(gain.notna())
    frame["macd_line"] = ema(c, 12) - ema(c, 26)
    frame["macd_signal"] = ema(frame["macd_line"], 9)
    frame["macd_hist"] = frame["macd_line"] - frame["macd_signal"]
    before = c.shift()
    tr = pd.concat([h - l, (h - before).abs(), (l - before).abs()], axis=1).max(axis=1)
    atr = wilder(tr, 14)
    up, down = h.diff(), -l.diff()
    plus = 100 * _ratio(wilder(up.where((up > down) & (up > 0), 0.0), 14), atr)
    minus = 100 * _ratio(wilder(down.where((down > up) & (down > 0), 0.0), 14), atr)
    frame["adx_14"] = wilder(100 * _ratio((plus - minus).abs(), plus + minus), 14)
    frame["atr_14"], frame["natr_14"] = atr, _ratio(atr, c)
    return frame


def recursive(held: DataFrame) -> DataFrame:
    """Adds the recursive features; needs h, l, c of `adjusted`. A symbol's own history is one task's group."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in held.dtypes), *(f"{n} double" for n in RECURSIVE)])
    out = held.groupBy("symbol").applyInPandas(_recurse, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in out.dtypes if t == "double"})
