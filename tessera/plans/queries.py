"""Queries over the derived panels, each with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import calendar
from tessera.functions.windows import by_date, with_ordinal
from tessera.operators import catalog, cleaning, cross_section, evaluate, portfolio, signals, simulate
from tessera.operators import features as feats
from tessera.plans import ingest, strategy
from tessera.session import scratch
from tessera.sources import bars as source
from tessera.sources.connectors import TableConnector

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """Doubles to so many digits, without a negative zero. A shift keeps exact halves off the edge."""
    return df.select([(F.round(F.col(c) + F.lit(shift), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


_KEPT: dict = {}


def held(spark: SparkSession, key: tuple, make) -> DataFrame:
    """Panels that several branches of one query read are kept once a session (they spill to disk)."""
    key = (spark.sparkContext.applicationId, *key)
    found = _KEPT.get(key)
    if found is None or not found.storageLevel.useDisk:
        found = _KEPT[key] = make().persist()
    return found


def week(spark: SparkSession, sf: str) -> DataFrame:
    return held(spark, (sf, "week"), lambda: source.derive_bars(spark, sf, "week"))


def day(spark: SparkSession, sf: str) -> DataFrame:
    return source.derive_bars(spark, sf, "day")


# --- SQL building blocks ---------------------------------------------------------------------------

S = "PARTITION BY symbol ORDER BY ts"
D = "PARTITION BY ts"


def bars_sql(unit: str, name: str = "bars") -> str:
    symbol, join = ("l_suppkey::VARCHAR", "") if unit == "day" else ("p_brand", " JOIN part ON l_partkey = p_partkey")
    return (
        f"{name} AS (SELECT ts, symbol, open, high, low, close, volume, close * (1 - disc) AS adj_close, NULL::DOUBLE AS adj_factor, 0.0::DOUBLE AS dividend, 0.0::DOUBLE AS split_ratio, repaired FROM ("
        "SELECT symbol, ts, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, sum(l_quantity) AS volume, max(l_discount) AS disc, bool_or(l_returnflag = 'R') AS repaired FROM ("
        f"SELECT {symbol} AS symbol, date_trunc('{unit}', l_shipdate)::TIMESTAMP AS ts, l_extendedprice / l_quantity AS px, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS o, l_quantity, l_discount, l_returnflag FROM lineitem{join}) GROUP BY symbol, ts))"
    )


def over(n: int, by: str = S) -> str:
    return f"({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def R(fn: str, x: str, n: int, m: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} >= {m or n} THEN {fn}({x}) OVER {over(n)} END"


def L(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({S})" if k > 0 else f"lead({x}, {-k}) OVER ({S})"


def out(columns: dict[str, str], frm: str, keys: str = "ts, symbol", digits: int = 6, shift: float = 0.0) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round(({e}) + {shift}::DOUBLE, {digits}) + 0.0 AS {n}" for n, e in columns.items()) + f" FROM {frm}"


def rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({D} ORDER BY {x} NULLS LAST) + (count(*) OVER ({D}, {x}) - 1) / 2.0) / count({x}) OVER ({D}) END"


A = "sqrt(252.0::DOUBLE)"
BASE = bars_sql("week") + ", b AS (SELECT *, adj_close AS c, adj_close / close AS f, open * (adj_close / close) AS o, high * (adj_close / close) AS h, low * (adj_close / close) AS l, volume AS v FROM bars)"
F1 = (
    BASE + ", f1 AS (SELECT *, " + ", ".join(
        f"{e} AS {n}" for n, e in {
            "pc": L("c"), "prc": L("close"), "ret_1d": f"c / nullif({L('c')}, 0) - 1", "logret_1d": f"ln(c / nullif({L('c')}, 0))",
            **{f"ret_{w}d": f"c / nullif({L('c', w)}, 0) - 1" for w in (5, 21, 63, 126, 252)}, "ret_overnight": f"o / nullif({L('c')}, 0) - 1", "ret_intraday": "c / o - 1",
            "mom_12_1": f"{L('c', 21)} / nullif({L('c', 252)}, 0) - 1", "lhl": "ln(h / l)", "lco": "ln(c / o)", "lho": "ln(h / o)", "llo": "ln(l / o)", "lop": f"ln(o / {L('c')})",
            "dollar_vol": "close * v", "atp": "(h + l + c) / 3", "rtpv": "(high + low + close) / 3 * v", "stale": f"coalesce((close = {L('close')})::INT, 0)::DOUBLE",
            "signed_v": f"coalesce(sign(close - {L('close')}), 0) * v", "dd": f"c / max(c) OVER {over(252)} - 1", "lo14": R("min", "l", 14), "hi14": R("max", "h", 14),
            "sma50": R("avg", "c", 50), "sma200": R("avg", "c", 200), "m20": R("avg", "c", 20), "s20": R("stddev_samp", "c", 20), "rn": f"row_number() OVER ({S})",
            "tr": f"greatest(h - l, abs(h - {L('c')}), abs(l - {L('c')}))",
        }.items()) + " FROM b)"
)
F2 = F1 + ", f2 AS (SELECT *, 0.5 * lhl * lhl - (2 * ln(2.0::DOUBLE) - 1) * lco * lco AS gk, lho * (lho - lco) + llo * (llo - lco) AS rs, CASE WHEN ret_1d IS NOT NULL THEN least(ret_1d, 0) END AS down_r, CASE WHEN logret_1d IS NOT NULL THEN least(logret_1d, 0) END AS down_lr, abs(ret_1d) / nullif(dollar_vol, 0) AS illiq, 100 * (c - lo14) / nullif(hi14 - lo14, 0) AS stoch FROM f1)"


def root_sql(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN sqrt(greatest({x}, 0)) END"


def feature_query(name: str, names: list[str], columns: dict[str, str] | None, cte: str = F2, frm: str = "f2", digits: int = 6):
    shift = 0.013 * 10.0**-digits

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(feats.features(week(spark, sf), names), digits, shift)

    run.__name__ = name
    query(f"WITH RECURSIVE {cte} " + out(columns, frm, digits=digits, shift=shift) if columns else None)(run)


# --- bars, cleaning, catalog -----------------------------------------------------------------------


@query("WITH " + bars_sql("week") + " SELECT * REPLACE (repaired AS repaired) FROM bars")
def bars_week(spark, sf):
    return week(spark, sf)


@query("WITH " + bars_sql("month") + " SELECT ts, symbol, open, high, low, close, volume FROM bars")
def bars_month(spark, sf):
    return source.derive_bars(spark, sf, "month").select("ts", "symbol", "open", "high", "low", "close", "volume")


@query("WITH " + bars_sql("day") + " SELECT ts, symbol, open, high, low, close, volume, adj_close FROM bars")
def bars_day(spark, sf):
    return day(spark, sf).select("ts", "symbol", "open", "high", "low", "close", "volume", "adj_close")


_RAW = bars_sql("day") + ", raw AS (SELECT ts, symbol, open, CASE WHEN mod(volume::BIGINT, 7) = 0 THEN low / 2 ELSE high END AS high, low, CASE WHEN mod(volume::BIGINT, 11) = 0 THEN -close WHEN mod(volume::BIGINT, 13) = 0 THEN NULL ELSE close END AS close, CASE WHEN mod(volume::BIGINT, 5) = 0 THEN NULL ELSE volume END AS volume FROM bars)"
_CLEAN = "open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(low, open, close) AND low <= least(open, close)"


def _dirty(spark, sf):
    b = day(spark, sf)
    k = F.col("volume").cast("long")
    return b.withColumns({"high": F.when(k % 7 == 0, F.col("low") / 2).otherwise(F.col("high")), "close": F.when(k % 11 == 0, -F.col("close")).when(k % 13 == 0, F.lit(None)).otherwise(F.col("close")), "volume": F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("volume"))})


@query("WITH " + _RAW + f" SELECT ts, symbol, open, high, low, close, volume FROM raw WHERE {_CLEAN}")
def clean_bars(spark, sf):
    dirty = _dirty(spark, sf)
    return cleaning.clean_bars(dirty.unionByName(dirty)).select("ts", "symbol", "open", "high", "low", "close", "volume")


@query("WITH " + _RAW + f" SELECT symbol, count(*) AS n FROM raw WHERE {_CLEAN} AND volume > 0 GROUP BY symbol")
def clean_bars_traded(spark, sf):
    return cleaning.clean_bars(_dirty(spark, sf), drop_zero_volume=True).groupBy("symbol").agg(F.count("*").alias("n"))


@query("WITH " + bars_sql("day") + ", inc AS (SELECT ts, symbol, close + 1 AS close FROM bars WHERE ts >= TIMESTAMP '1995-01-01') SELECT coalesce(i.ts, b.ts) AS ts, coalesce(i.symbol, b.symbol) AS symbol, coalesce(i.close, b.close) AS close FROM (SELECT * FROM bars WHERE ts < TIMESTAMP '1996-01-01') b FULL JOIN inc i ON i.ts = b.ts AND i.symbol = b.symbol")
def merge_bars(spark, sf):
    b = day(spark, sf).select("ts", "symbol", "close")
    return cleaning.merge_bars(b.filter("ts < timestamp'1996-01-01'"), b.filter("ts >= timestamp'1995-01-01'").withColumn("close", F.col("close") + 1))


@query("WITH " + bars_sql("week") + " SELECT ts, upper(symbol) AS symbol, open, high, low, close, volume, close AS adj_close, 1.0::DOUBLE AS adj_factor, repaired FROM bars")
def normalize_bars(spark, sf):
    vendor = week(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.concat(F.lit(" "), F.lower("symbol")).alias("Ticker"), *[F.col(c).cast("string").alias(c.title()) for c in ("open", "high", "low", "close", "volume")], F.when(F.col("repaired"), "Yes").otherwise("no").alias("Repaired?"))
    return cleaning.normalize_bars(vendor).select("ts", "symbol", "open", "high", "low", "close", "volume", "adj_close", "adj_factor", "repaired")


_QUALITY = bars_sql("day") + ", q AS (SELECT *, date_diff('day', lag(ts) OVER w, ts) AS gap, close / nullif(lag(close) OVER w, 0) AS jump FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


@query("WITH " + _QUALITY + " SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('day', max(ts), DATE '2000-01-01') AS stale_days, count(*) FILTER (WHERE close IS NULL) AS null_close, count(*) FILTER (WHERE volume IS NULL OR volume = 0) AS zero_volume, count(*) FILTER (WHERE repaired) AS repaired_rows, count(*) FILTER (WHERE adj_factor IS NULL OR adj_factor <= 0) AS bad_adj_factor, count(*) FILTER (WHERE jump > 4 OR jump < 0.25) AS price_jumps, coalesce(max(gap), 0) AS max_gap_days, round(count(*) FILTER (WHERE repaired) / count(*), 6) AS repaired_ratio, round(count(*) FILTER (WHERE volume IS NULL OR volume = 0) / count(*), 6) AS zero_volume_ratio FROM q GROUP BY symbol")
def quality_report(spark, sf):
    return catalog.quality_report(day(spark, sf), "2000-01-01")


@query("WITH " + bars_sql("day") + " SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS row_count FROM bars GROUP BY symbol")
def coverage_summary(spark, sf):
    return catalog.coverage(day(spark, sf))


_STATE = bars_sql("day") + ", cov AS (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS row_count FROM bars GROUP BY symbol), st AS (SELECT 'file' AS provider, 'us' AS region, 'stocks' AS asset_class, '1d' AS interval, symbol, first_ts, last_ts, row_count, CASE WHEN mod(symbol::BIGINT, 9) = 0 THEN 'error' ELSE 'ok' END AS status, NULL::VARCHAR AS message, TIMESTAMP '2000-01-01' AS updated_at FROM cov WHERE mod(symbol::BIGINT, 4) > 0), inc AS (SELECT 'file' AS provider, 'us' AS region, 'stocks' AS asset_class, '1d' AS interval, symbol, CASE WHEN mod(symbol::BIGINT, 3) > 0 THEN first_ts END AS first_ts, CASE WHEN mod(symbol::BIGINT, 3) > 0 THEN last_ts END AS last_ts, row_count + 5 AS row_count, CASE WHEN mod(symbol::BIGINT, 3) > 0 THEN 'ok' ELSE 'failed' END AS status, 'second' AS message, TIMESTAMP '2000-01-02' AS updated_at FROM cov WHERE mod(symbol::BIGINT, 2) = 0)"


def _states(spark, sf):
    cov = catalog.coverage(day(spark, sf))
    k = F.col("symbol").cast("long")
    keys = {"provider": F.lit("file"), "region": F.lit("us"), "asset_class": F.lit("stocks"), "interval": F.lit("1d")}
    old = cov.withColumns(keys | {"status": F.when(k % 9 == 0, "error").otherwise("ok"), "message": F.lit(None).cast("string"), "updated_at": F.lit("2000-01-01").cast("timestamp")}).filter(k % 4 > 0)
    ok = k % 3 > 0
    new = cov.withColumns(keys | {"first_ts": F.when(ok, F.col("first_ts")), "last_ts": F.when(ok, F.col("last_ts")), "row_count": F.col("row_count") + 5, "status": F.when(ok, "ok").otherwise("failed"), "message": F.lit("second"), "updated_at": F.lit("2000-01-02").cast("timestamp")}).filter(k % 2 == 0)
    return old, new


@query("WITH " + _STATE + " SELECT coalesce(i.symbol, s.symbol) AS symbol, coalesce(i.provider, s.provider) AS provider, coalesce(i.first_ts, s.first_ts) AS first_ts, coalesce(i.last_ts, s.last_ts) AS last_ts, CASE WHEN i.symbol IS NULL THEN s.row_count WHEN i.last_ts IS NULL THEN coalesce(s.row_count, 0) ELSE i.row_count END AS row_count, CASE WHEN i.symbol IS NULL THEN s.status ELSE i.status END AS status, CASE WHEN i.symbol IS NULL THEN s.message ELSE i.message END AS message FROM st s FULL JOIN inc i ON i.symbol = s.symbol")
def state_upsert(spark, sf):
    return catalog.upsert_state(*_states(spark, sf)).select("symbol", "provider", "first_ts", "last_ts", "row_count", "status", "message")


@query("WITH " + _STATE + " SELECT provider, region, asset_class, interval, count(*) AS symbols, sum(row_count)::BIGINT AS rows, min(first_ts) AS first_ts, max(last_ts) AS last_ts, count(*) FILTER (WHERE status <> 'ok') AS failed FROM st WHERE interval = '1d' GROUP BY 1, 2, 3, 4")
def status(spark, sf):
    return catalog.status(_states(spark, sf)[0], "1d")


@query("WITH " + _STATE + " SELECT symbol, last_ts FROM inc WHERE last_ts IS NOT NULL")
def watermarks(spark, sf):
    return catalog.watermarks(_states(spark, sf)[1], "file", "us", "stocks", "1d")


_LISTING = "SELECT p_partkey::VARCHAR || CASE WHEN p_size > 25 THEN '.a' ELSE '' END AS symbol, p_name || CASE mod(p_size, 4) WHEN 0 THEN ' Common Stock' WHEN 1 THEN ' Ordinary Shares' WHEN 2 THEN ' Common Stock Warrants' ELSE ' Fund' END AS name, p_brand AS exchange, CASE WHEN mod(p_size, 10) = 0 THEN 'Y' ELSE 'N' END AS etf, CASE WHEN mod(p_size, 13) = 0 THEN 'Y' ELSE 'N' END AS test FROM part"


@query(rf"WITH x AS ({_LISTING}) SELECT replace(upper(trim(symbol)), '.', '-') AS symbol, trim(name) AS name, exchange, CASE WHEN etf = 'Y' THEN 'etf' WHEN regexp_matches(name, '\b(common stock|common shares?|ordinary shares?|capital stock|american depositary shares?|shares of beneficial interest)\b', 'i') AND NOT regexp_matches(name, '\b(warrants?|rights|units|preferred|preference|depositary units|debentures?|notes?|bonds?|subordinated|when[- ]issued|contingent value|fund|closed[- ]end|index[- ]linked)\b', 'i') THEN 'stock' ELSE 'other' END AS asset_class, 'US' AS region FROM x WHERE test = 'N'")
def universe_classify(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_size")
    suffix = F.when(k % 4 == 0, " Common Stock").when(k % 4 == 1, " Ordinary Shares").when(k % 4 == 2, " Common Stock Warrants").otherwise(" Fund")
    listing = p.select(F.concat(F.col("p_partkey").cast("string"), F.when(k > 25, ".a").otherwise("")).alias("symbol"), F.concat("p_name", suffix).alias("name"), F.col("p_brand").alias("exchange"), F.when(k % 10 == 0, "Y").otherwise("N").alias("etf"), F.when(k % 13 == 0, "Y").otherwise("N").alias("test_issue"))
    return cleaning.classify_universe(listing).drop("snapshot_date")


# --- calendar and schedule -------------------------------------------------------------------------


def _dates(spark, sf):
    return day(spark, sf).select("ts").distinct()


for _freq, _period in (("weekly", "date_trunc('week', ts + INTERVAL 2 DAY)"), ("monthly", "date_trunc('month', ts)"), ("quarterly", "date_trunc('quarter', ts)")):

    def _rebalance(spark, sf, _freq=_freq):
        return portfolio.rebalance_dates(_dates(spark, sf), _freq)

    _rebalance.__name__ = f"rebalance_{_freq}"
    query("WITH " + bars_sql("day") + f" SELECT max(ts) AS ts FROM (SELECT DISTINCT ts FROM bars) GROUP BY {_period}")(_rebalance)

_HOLIDAYS = ", ".join(f"DATE '{d}'" for y in range(1992, 1999) for d in sorted(calendar.holidays(y)))


@query("WITH " + bars_sql("day") + f", e AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY)) AS ts), s AS (SELECT ts FROM e WHERE isodow(ts) < 6 AND ts::DATE NOT IN ({_HOLIDAYS})), r AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY symbol) SELECT symbol, count(*) AS missing FROM r JOIN s ON s.ts BETWEEN r.a AND r.z WHERE (symbol, s.ts) NOT IN (SELECT (symbol, ts) FROM bars) GROUP BY symbol")
def missing_sessions(spark, sf):
    table = calendar.session_table(spark, date(1992, 1, 1), date(1998, 12, 31))
    return calendar.missing_sessions(day(spark, sf), table).groupBy("symbol").agg(F.count("*").alias("missing"))


# --- features --------------------------------------------------------------------------------------

_RET = ["ret_1d", "logret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d", "ret_overnight", "ret_intraday"]
feature_query("feat_returns", _RET, {n: n for n in _RET})
feature_query("feat_momentum", ["mom_12_1", "dist_52w_high", "dist_52w_low"], {"mom_12_1": "mom_12_1", "dist_52w_high": f"c / ({R('max', 'h', 252)}) - 1", "dist_52w_low": f"c / ({R('min', 'l', 252)}) - 1"})
feature_query("feat_sma", [*(f"px_to_sma_{w}" for w in (10, 20, 50, 200)), "sma_50_to_200"], {**{f"px_to_sma_{w}": f"c / ({R('avg', 'c', w)}) - 1" for w in (10, 20, 50, 200)}, "sma_50_to_200": "sma50 / sma200 - 1"})
feature_query("feat_realised_vol", ["vol_20d", "vol_60d", "vol_252d", "downside_dev_60d"], {**{f"vol_{w}d": f"({R('stddev_samp', 'logret_1d', w)}) * {A}" for w in (20, 60, 252)}, "downside_dev_60d": f"({R('stddev_samp', 'down_lr', 60)}) * {A}"})
feature_query("feat_range_vol", ["parkinson_20d", "garman_klass_20d"], {"parkinson_20d": f"sqrt(({R('avg', 'lhl * lhl', 20)}) / (4 * ln(2.0::DOUBLE))) * {A}", "garman_klass_20d": f"({root_sql(R('avg', 'gk', 20))}) * {A}"})
_K = 0.34 / (1.34 + 21 / 19)
feature_query("feat_yang_zhang", ["yang_zhang_20d"], {"yang_zhang_20d": f"({root_sql(f'({R("var_samp", "lop", 20)}) + {_K} * ({R("var_samp", "lco", 20)}) + {1 - _K} * ({R("avg", "rs", 20)})')}) * {A}"})
feature_query("feat_shape", ["sharpe_252d", "sortino_252d", "skew_252d", "kurt_252d", "hit_rate_252d"], {"sharpe_252d": f"({R('avg', 'ret_1d', 252)}) / nullif({R('stddev_samp', 'ret_1d', 252)}, 0) * {A}", "sortino_252d": f"({R('avg', 'ret_1d', 252)}) / nullif({R('stddev_samp', 'down_r', 252)}, 0) * {A}", "skew_252d": R("skewness", "ret_1d", 252), "kurt_252d": R("kurtosis", "ret_1d", 252), "hit_rate_252d": R("avg", "CASE WHEN ret_1d IS NOT NULL THEN (ret_1d > 0)::INT::DOUBLE END", 252)})
feature_query("feat_drawdown", ["dd_from_252d_high", "max_dd_252d"], {"dd_from_252d_high": "dd", "max_dd_252d": R("min", "dd", 252)})
feature_query("feat_liquidity", ["dollar_vol", "advd_20", "advd_60", "amihud_60d", "vol_zscore_20", "dist_vwap_20", "zero_vol_frac_20", "stale_px_frac_20"], {"dollar_vol": "dollar_vol", "advd_20": R("avg", "dollar_vol", 20), "advd_60": R("avg", "dollar_vol", 60), "amihud_60d": f"({R('avg', 'illiq', 60)}) * 1000000", "vol_zscore_20": f"(v - ({R('avg', 'v', 20)})) / nullif({R('stddev_samp', 'v', 20)}, 0)", "dist_vwap_20": f"close / nullif(({R('sum', 'rtpv', 20)}) / nullif({R('sum', 'v', 20)}, 0), 0) - 1", "zero_vol_frac_20": R("avg", "(v = 0)::INT::DOUBLE", 20), "stale_px_frac_20": R("avg", "stale", 20)}, digits=3)
feature_query("feat_obv", ["obv"], {"obv": f"sum(signed_v) OVER ({S} ROWS UNBOUNDED PRECEDING)"})
feature_query("feat_bollinger", ["bb_pctb_20", "bb_width_20", "zscore_20"], {"bb_pctb_20": "(c - (m20 - 2 * s20)) / nullif(4 * s20, 0)", "bb_width_20": "4 * s20 / m20", "zscore_20": "(c - m20) / nullif(s20, 0)"})
feature_query("feat_stochastic", ["stoch_k_14", "stoch_d_14", "willr_14"], {"stoch_k_14": "stoch", "stoch_d_14": R("avg", "stoch", 3), "willr_14": "stoch - 100"})
_CCI = F2 + f", f3 AS (SELECT *, CASE WHEN count(atp) OVER {over(20)} >= 20 THEN list(atp) OVER {over(20)} END AS tps, {R('avg', 'atp', 20)} AS mtp FROM f2)"
feature_query("feat_cci", ["cci_20"], {"cci_20": "(atp - mtp) / nullif(0.015 * list_sum(list_transform(tps, lambda x: abs(x - mtp))) / 20, 0)"}, _CCI, "f3")

_N = F1 + ", n AS (SELECT symbol, ts, rn, c, h, l, greatest(c - pc, 0) AS gain, greatest(pc - c, 0) AS loss, CASE WHEN rn = 1 THEN h - l ELSE tr END AS tr, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS pdm, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS mdm FROM (SELECT *, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)))"


def recursion(name: str, source_: str, start: int, sums: dict[str, tuple[str, str]]) -> str:
    """A recursive CTE with exponential averages: name -> (value, weight of the new value)."""
    first = ", ".join(f"({x})::DOUBLE AS {k}" for k, (x, _) in sums.items())
    step = ", ".join(f"e.{k} * (1 - {a}) + n.{x} * {a}" for k, (x, a) in sums.items())
    return f", {name} AS (SELECT symbol, rn, {first} FROM {source_} WHERE rn = {start} UNION ALL SELECT n.symbol, n.rn, {step} FROM {name} e JOIN {source_} n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"


_W14 = "(1.0::DOUBLE / 14)"
feature_query("feat_rsi", ["rsi_14"], {"rsi_14": "CASE WHEN n.rn >= 15 THEN 100 * e.g / nullif(e.g + e.lo, 0) END"}, _N + recursion("e", "n", 2, {"g": ("gain", _W14), "lo": ("loss", _W14)}), "n LEFT JOIN e USING (symbol, rn)")
_MACD = _N + recursion("e", "n", 1, {"fast": ("c", "(2.0::DOUBLE / 13)"), "slow": ("c", "(2.0::DOUBLE / 27)")}) + ", m AS (SELECT symbol, rn, fast - slow AS line FROM e WHERE rn >= 26)" + recursion("s", "m", 26, {"sig": ("line", "0.2::DOUBLE")})
feature_query("feat_macd", ["macd_line", "macd_signal", "macd_hist"], {"macd_line": "m.line", "macd_signal": "CASE WHEN n.rn >= 34 THEN s.sig END", "macd_hist": "CASE WHEN n.rn >= 34 THEN m.line - s.sig END"}, _MACD, "n LEFT JOIN m USING (symbol, rn) LEFT JOIN s USING (symbol, rn)", 3)
_ATR = _N + recursion("e", "n", 1, {"atr": ("tr", _W14), "p": ("pdm", _W14), "m": ("mdm", _W14)})
feature_query("feat_atr", ["atr_14", "natr_14"], {"atr_14": "CASE WHEN n.rn >= 14 THEN e.atr END", "natr_14": "CASE WHEN n.rn >= 14 THEN e.atr / n.c END"}, _ATR, "n LEFT JOIN e USING (symbol, rn)", 3)
feature_query("feat_adx", ["adx_14"], {"adx_14": "CASE WHEN n.rn >= 27 THEN a.adx END"}, _ATR + ", dx AS (SELECT symbol, rn, 100 * abs(p - m) / (p + m) AS dx FROM e WHERE rn >= 14)" + recursion("a", "dx", 14, {"adx": ("dx", _W14)}), "n LEFT JOIN a USING (symbol, rn)")


@query("WITH " + F1 + " " + out({n: f"{L('c', -k)} / nullif(c, 0) - 1" for n, k in feats.LABELS.items()}, "f1"))
def labels(spark, sf):
    return rounded(feats.labels(week(spark, sf)))


@query("WITH " + F1 + ", m AS (SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(ts) AS first_ts, max(ts) AS last_ts FROM f1) SELECT * FROM m")
def manifest_stats(spark, sf):
    f = feats.features(week(spark, sf), ["ret_1d"])
    return f.agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- cross-section and market ----------------------------------------------------------------------

P = F2 + f", p AS (SELECT ts, symbol, close, ret_1d, ret_5d, round(ret_21d, 9) AS ret_21d, round(mom_12_1, 9) AS mom_12_1, round({R('stddev_samp', 'logret_1d', 20)} * {A}, 9) AS vol_20d, round({R('avg', 'dollar_vol', 20)}, 6) AS advd_20, round({R('avg', 'stale', 20)}, 9) AS stale_px_frac_20 FROM f2)"
_PANEL = ["close", "ret_1d", "ret_5d", "ret_21d", "mom_12_1", "vol_20d", "advd_20", "stale_px_frac_20"]


def panel(spark, sf) -> DataFrame:
    """The weekly panel; values that are ranked are rounded first, so that ties are the same everywhere."""
    return held(spark, (sf, "panel"), lambda: _panel(spark, sf))


def _panel(spark, sf) -> DataFrame:
    f = feats.features(week(spark, sf), _PANEL)
    return f.withColumns({c: F.round(c, 6 if c == "advd_20" else 9) for c in ("ret_21d", "mom_12_1", "vol_20d", "advd_20", "stale_px_frac_20")})


def broad_sql(x: str, e: str) -> str:
    return f"CASE WHEN count({x}) OVER ({D}) >= 20 THEN {e} END"


def z_sql(x: str) -> str:
    return f"({x} - avg({x}) OVER ({D})) / nullif(stddev_samp({x}) OVER ({D}), 0)"


_RANKED = ("ret_21d", "mom_12_1", "vol_20d", "advd_20")


@query("WITH " + P + " " + out({f"cs_rank_{n}": broad_sql(n, rank_sql(n)) for n in _RANKED}, "p"))
def cs_rank(spark, sf):
    return rounded(cross_section.ranks_and_scores(panel(spark, sf), _RANKED, ()))


@query("WITH " + P + " " + out({f"cs_z_{n}": broad_sql(n, z_sql(n)) for n in ("ret_21d", "mom_12_1")}, "p"))
def cs_zscore(spark, sf):
    return rounded(cross_section.ranks_and_scores(panel(spark, sf), (), ("ret_21d", "mom_12_1")))


M = P + ", m0 AS (SELECT ts, CASE WHEN count(ret_1d) >= 20 THEN avg(ret_1d) END AS m FROM p GROUP BY ts), m1 AS (SELECT *, exp(sum(ln(1 + coalesce(m, 0))) OVER (ORDER BY ts)) AS x, row_number() OVER (ORDER BY ts) AS d FROM m0)"


@query("WITH " + M + " " + out({"mkt_ret_1d": "m", "mkt_ret_21d": "ln(x / lag(x, 21) OVER (ORDER BY ts))", "mkt_ret_252d": "ln(x / lag(x, 252) OVER (ORDER BY ts))", "mkt_index": "CASE WHEN m IS NOT NULL THEN ln(x) END", "mkt_vol_20d": f"CASE WHEN count(m) OVER w >= 20 THEN stddev_samp(m) OVER w * {A} END"}, "m1 WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING)", "ts"))
def market_series(spark, sf):
    """The synthetic returns compound beyond all scale, so the compounded columns are compared as logarithms."""
    m = cross_section.market(panel(spark, sf))
    return rounded(m.withColumns({"mkt_index": F.ln("mkt_index"), **{c: F.ln(1 + F.col(c)) for c in ("mkt_ret_21d", "mkt_ret_252d")}}))


_FR = "(PARTITION BY symbol ORDER BY d RANGE BETWEEN 251 PRECEDING AND CURRENT ROW)"
_BETA = M + ", mv AS (SELECT *, CASE WHEN count(m) OVER (ORDER BY d ROWS 251 PRECEDING) >= 126 THEN var_samp(m) OVER (ORDER BY d ROWS 251 PRECEDING) END AS mvar FROM m1), j AS (SELECT p.ts, symbol, d, ret_1d AS r, CASE WHEN ret_1d IS NOT NULL AND m IS NOT NULL THEN ret_1d END AS rx, CASE WHEN ret_1d IS NOT NULL AND m IS NOT NULL THEN m END AS my, mvar FROM p JOIN mv USING (ts)), k AS (SELECT *, CASE WHEN count(rx) OVER w >= 126 THEN covar_samp(rx, my) OVER w END / nullif(mvar, 0) AS beta, CASE WHEN count(rx) OVER w >= 126 THEN covar_pop(rx, my) OVER w / nullif(stddev_pop(rx) OVER w * stddev_pop(my) OVER w, 0) END AS corr_, CASE WHEN count(r) OVER w >= 126 THEN stddev_samp(r) OVER w END AS own FROM j WINDOW w AS " + _FR + ")"


@query("WITH " + _BETA + " " + out({"beta_252d": "beta", "corr_mkt_252d": "corr_", "idio_vol_252d": f"own * ({root_sql('1 - corr_ * corr_')}) * {A}"}, "k"))
def beta_corr_idio(spark, sf):
    return rounded(cross_section.risk_to_market(panel(spark, sf)))


@query("WITH " + M + ", m2 AS (SELECT ts, x / lag(x, 21) OVER (ORDER BY ts) - 1 AS m21 FROM m1) " + out({"rel_ret_21d": "sign(ret_21d - m21) * ln(1 + abs(ret_21d - m21))"}, "p JOIN m2 USING (ts)"))
def rel_ret(spark, sf):
    x = F.col("rel_ret_21d")
    return rounded(cross_section.relative_return(panel(spark, sf)).withColumn("rel_ret_21d", F.signum(x) * F.ln(1 + F.abs(x))))


@query("WITH " + bars_sql("day") + ", g AS (SELECT s.symbol, t.ts FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT DISTINCT ts FROM bars) t) SELECT g.symbol, count(*) AS dates, count(close) AS n_bars FROM g LEFT JOIN bars b ON b.ts = g.ts AND b.symbol = g.symbol GROUP BY g.symbol")
def densify(spark, sf):
    return cross_section.densify(day(spark, sf).select("ts", "symbol", "close")).groupBy("symbol").agg(F.count("*").alias("dates"), F.count("close").alias("n_bars"))


# --- signals ---------------------------------------------------------------------------------------

_GROUPS = "g AS (SELECT symbol, CASE WHEN mod(ascii(right(symbol, 1)), 4) < 3 THEN 'g' || mod(ascii(right(symbol, 1)), 3) END AS grp FROM (SELECT DISTINCT symbol FROM p))"


def groups(spark, sf) -> DataFrame:
    brands = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("symbol")).distinct()
    k = F.ascii(F.right("symbol", F.lit(1)))
    return brands.select("symbol", F.when(k % 4 < 3, F.concat(F.lit("g"), (k % 3).cast("string"))).alias("grp"))


_TRADABLE = signals.Tradability(min_price=900.0, min_dollar_volume=20000.0, max_stale=0.5, require_history=52)
_TRADE_SQL = f"(close IS NOT NULL AND close >= 900 AND advd_20 IS NOT NULL AND advd_20 >= 20000 AND (stale_px_frac_20 IS NULL OR stale_px_frac_20 <= 0.5) AND count(close) OVER ({S} ROWS UNBOUNDED PRECEDING) >= 52)"


@query("WITH " + P + f" SELECT ts, symbol, coalesce({_TRADE_SQL}, false) AS tradable FROM p")
def tradability_mask(spark, sf):
    return panel(spark, sf).select("ts", "symbol", _TRADABLE.column().alias("tradable"))


def _scores(spark, sf, metric="ret_21d"):
    return panel(spark, sf).select("ts", "symbol", F.col(metric).alias("score"))


SC = P + ", s AS (SELECT ts, symbol, ret_21d AS score FROM p)"


def _clip_sql(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, {lo}) OVER ({D})), quantile_cont({x}, {hi}) OVER ({D})) END"


_TRANSFORMS = {
    "winsorize": (lambda d, s, f: signals.winsorize(d, 0.05, 0.95), _clip_sql("score", 0.05, 0.95)),
    "demean": (lambda d, s, f: signals.demean(d), broad_sql("score", f"score - avg(score) OVER ({D})")),
    "zscore": (lambda d, s, f: signals.zscore(d), broad_sql("score", z_sql("score"))),
    "rank_normalize": (lambda d, s, f: signals.rank_normalize(d), broad_sql("score", f"2 * ({rank_sql('score')}) - 1")),
    "group_neutral": (lambda d, s, f: signals.group_neutral(d, groups(s, f)), None),
}
for _name, (_f, _e) in _TRANSFORMS.items():

    def _transform(spark, sf, _f=_f):
        return rounded(_f(_scores(spark, sf), spark, sf))

    _transform.__name__ = _name
    query("WITH " + SC + " " + out({"score": _e}, "s") if _e else "WITH " + SC + ", " + _GROUPS + f" SELECT ts, symbol, round(CASE WHEN grp IS NOT NULL THEN score - avg(score) OVER (PARTITION BY ts, grp) END, 6) + 0.0 AS score FROM s LEFT JOIN g USING (symbol)")(_transform)

_PAIR = ", pr AS (SELECT ts, symbol, CASE WHEN ret_21d IS NOT NULL AND vol_20d IS NOT NULL THEN ret_21d END AS x, CASE WHEN ret_21d IS NOT NULL AND vol_20d IS NOT NULL THEN vol_20d END AS b FROM p)"


@query("WITH " + P + _PAIR + " " + out({"score": f"(x - avg(x) OVER ({D})) - covar_pop(x, b) OVER ({D}) / nullif(var_pop(b) OVER ({D}), 0) * (b - avg(b) OVER ({D}))"}, "pr"))
def beta_neutral(spark, sf):
    held = panel(spark, sf).select("ts", "symbol", F.col("ret_21d").alias("score"), F.col("vol_20d").alias("beta"))
    return rounded(signals.beta_neutral(held).drop("beta"))


def signal_sql(x: str) -> str:
    return P + f", raw AS (SELECT ts, symbol, {x} AS score FROM p), s AS (SELECT ts, symbol, {_clip_sql('score', 0.01, 0.99)} AS score FROM raw)"


_MOM = {"tradability": _TRADABLE, "neutralization": "demean"}
_MASKED = P + f", raw AS (SELECT ts, symbol, CASE WHEN {_TRADE_SQL} THEN mom_12_1 END AS score FROM p), s AS (SELECT ts, symbol, {_clip_sql('score', 0.01, 0.99)} AS score FROM raw)"


@query("WITH " + _MASKED + " " + out({"score": broad_sql("score", f"score - avg(score) OVER ({D})")}, "s"))
def signal_momentum(spark, sf):
    return rounded(signals.get_signal("momentum_12_1", **_MOM).compute(panel(spark, sf)))


@query("WITH " + signal_sql("-ret_5d") + " " + out({"score": broad_sql("score", z_sql("score"))}, "s"))
def signal_reversal(spark, sf):
    return rounded(signals.get_signal("reversal_5d", neutralization="zscore").compute(panel(spark, sf)))


@query("WITH " + signal_sql("-vol_20d") + " " + out({"score": "score"}, "s"))
def signal_low_vol(spark, sf):
    return rounded(signals.get_signal("low_vol_20d").compute(panel(spark, sf)))


@query()
def signal_random(spark, sf):
    return rounded(signals.get_signal("random", seed=7).compute(panel(spark, sf)))


def _composite_sql(shape) -> str:
    base = P + "".join(f", r{k} AS (SELECT ts, symbol, {x} AS score FROM p), s{k} AS (SELECT ts, symbol, {_clip_sql('score', 0.01, 0.99)} AS score FROM r{k}), n{k} AS (SELECT ts, symbol, {shape('score')} AS score FROM s{k})" for k, x in enumerate(("mom_12_1", "-vol_20d")))
    return "WITH " + base + " SELECT ts, symbol, round(CASE WHEN n0.score IS NULL AND n1.score IS NULL THEN NULL ELSE coalesce(0.75 * n0.score, 0) + coalesce(-0.25 * n1.score, 0) END, 6) + 0.0 AS score FROM n0 FULL JOIN n1 USING (ts, symbol)"


for _name, _method, _shape in (("composite_rank", "rank", lambda x: broad_sql(x, f"2 * ({rank_sql(x)}) - 1")), ("composite_zscore", "zscore", lambda x: broad_sql(x, z_sql(x))), ("composite_weighted", "raw", lambda x: x)):

    def _composite(spark, sf, _method=_method):
        parts = [signals.get_signal("momentum_12_1"), signals.get_signal("low_vol_20d")]
        return rounded(signals.CompositeSignal(parts, [3, -1], _method).compute(panel(spark, sf)))

    _composite.__name__ = _name
    query(_composite_sql(_shape))(_composite)

# --- information coefficients ----------------------------------------------------------------------

_LAB = SC + f", y AS (SELECT ts, symbol, round({L('adj_close', -1)} / nullif(adj_close, 0) - 1, 9) AS y FROM bars), sy AS (SELECT s.ts, s.symbol, score, y FROM s LEFT JOIN y ON y.ts = s.ts AND y.symbol = s.symbol)"


def _ic_input(spark, sf):
    lab = feats.labels(week(spark, sf)).select("ts", "symbol", F.round("fwd_ret_1d", 9).alias("fwd_ret_1d"))
    return _scores(spark, sf), lab


def _corr_sql(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return f"CASE WHEN count({x}) >= 20 THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


_IC = _LAB + f", rk AS (SELECT ts, symbol, {rank_sql('score')} AS rx, {rank_sql('y')} AS ry FROM sy), ic AS (SELECT ts, {_corr_sql('rx', 'ry')} AS ic FROM rk GROUP BY ts)"
_JR = _LAB + f", jj AS (SELECT ts, symbol, CASE WHEN score IS NOT NULL AND y IS NOT NULL THEN score END AS x, CASE WHEN score IS NOT NULL AND y IS NOT NULL THEN y END AS y FROM sy), jr AS (SELECT ts, symbol, y, {rank_sql('x')} AS r FROM jj)"


@query("WITH " + _IC + " SELECT ts, round(ic, 6) + 0.0 AS ic FROM ic")
def ic_series(spark, sf):
    return rounded(signals.ic_series(*_ic_input(spark, sf)))


_SPREAD = "CASE WHEN count(r) >= 20 THEN avg(CASE WHEN r > 1 - 0.2::DOUBLE THEN y END) - avg(CASE WHEN r <= 0.2::DOUBLE THEN y END) END"


@query("WITH " + _JR + f" SELECT ts, round({_SPREAD}, 6) + 0.0 AS spread FROM jr GROUP BY ts")
def quantile_spread(spark, sf):
    return rounded(signals.quantile_spread(*_ic_input(spark, sf), quantiles=5))


@query("WITH " + _JR + ", bk AS (SELECT ts, y, CASE WHEN r <= 0.2::DOUBLE THEN 0 WHEN r <= 0.4::DOUBLE THEN 1 WHEN r <= 0.6::DOUBLE THEN 2 WHEN r <= 0.8::DOUBLE THEN 3 ELSE 4 END AS bucket FROM jr WHERE r IS NOT NULL) SELECT bucket, round(avg(y), 6) + 0.0 AS mean_return FROM (SELECT ts, bucket, avg(y) AS y FROM bk GROUP BY ts, bucket) GROUP BY bucket")
def quantile_returns(spark, sf):
    return rounded(signals.quantile_returns(*_ic_input(spark, sf), quantiles=5))


_TURN = SC + f", dd AS (SELECT ts, row_number() OVER (ORDER BY ts) AS d FROM (SELECT DISTINCT ts FROM s)), rr AS (SELECT s.ts, symbol, d, {rank_sql('score').replace('PARTITION BY ts', 'PARTITION BY s.ts')} AS r FROM s JOIN dd ON dd.ts = s.ts)"


@query("WITH " + _TURN + " SELECT a.ts, round(avg(abs(a.r - b.r)), 6) + 0.0 AS turnover FROM rr a LEFT JOIN rr b ON b.symbol = a.symbol AND b.d = a.d - 1 GROUP BY a.ts")
def signal_turnover(spark, sf):
    return rounded(signals.turnover(_scores(spark, sf)))


@query("WITH " + _TURN + f" SELECT a.ts, round({_corr_sql('a.r', 'b.r')}, 6) + 0.0 AS autocorr FROM rr a JOIN rr b ON b.symbol = a.symbol AND b.d = a.d - 5 GROUP BY a.ts")
def signal_autocorr(spark, sf):
    return rounded(signals.autocorrelation(_scores(spark, sf), 5))


@query("WITH " + SC + " SELECT ts, count(score) AS coverage FROM s GROUP BY ts")
def signal_coverage(spark, sf):
    return signals.coverage(_scores(spark, sf))


@query("WITH " + _IC + f", sp AS (SELECT avg(spread) AS spread_mean FROM (SELECT ts, {_SPREAD.replace('0.2::DOUBLE', '0.1::DOUBLE')} AS spread FROM (SELECT ts, y, {rank_sql('x')} AS r FROM (SELECT ts, symbol, CASE WHEN score IS NOT NULL AND y IS NOT NULL THEN score END AS x, CASE WHEN score IS NOT NULL AND y IS NOT NULL THEN y END AS y FROM sy)) GROUP BY ts)) SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0) * {A}, 6) AS ic_ir, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 6) AS ic_t, round(count(*) FILTER (WHERE ic > 0) / greatest(count(ic), 1), 6) AS ic_hit, count(ic) AS n_dates, (SELECT round(spread_mean, 6) FROM sp) AS spread_mean FROM ic")
def ic_summary(spark, sf):
    return rounded(signals.ic_summary(*_ic_input(spark, sf))).select("ic_mean", "ic_std", "ic_ir", "ic_t", "ic_hit", "n_dates", "spread_mean")


# --- portfolio -------------------------------------------------------------------------------------

_CTX = P + f", x AS (SELECT p.ts, p.symbol, mom_12_1 AS score, vol_20d AS volatility, CASE WHEN {_TRADE_SQL} THEN mom_12_1 END AS s FROM p)"


def context(spark, sf) -> DataFrame:
    return panel(spark, sf).select("ts", "symbol", F.col("mom_12_1").alias("score"), F.col("vol_20d").alias("volatility"), _TRADABLE.column().alias("tradable"), "ret_1d")


def gross_sql(w: str, g: float = 1.0) -> str:
    return f"coalesce({w} / nullif(sum(abs({w})) OVER ({D}), 0) * {g}, 0)"


_TOP = f"CASE WHEN s IS NOT NULL AND row_number() OVER ({D} ORDER BY s DESC NULLS LAST, symbol) <= 5 THEN 1.0::DOUBLE ELSE 0 END - CASE WHEN s IS NOT NULL AND row_number() OVER ({D} ORDER BY s NULLS LAST, symbol) <= 5 THEN 1.0::DOUBLE ELSE 0 END"


@query("WITH " + _CTX + f", t AS (SELECT ts, symbol, {_TOP} AS w FROM x) " + out({"weight": gross_sql("w")}, "t"))
def top_n(spark, sf):
    return rounded(portfolio.top_n_equal_weight(context(spark, sf), 5, long_only=False))


_QLS = _CTX + f", q0 AS (SELECT ts, symbol, volatility, {rank_sql('s')} AS r FROM x), q1 AS (SELECT *, coalesce((r > 1 - 0.2::DOUBLE)::INT, 0)::DOUBLE AS up, coalesce((r <= 0.2::DOUBLE)::INT, 0)::DOUBLE AS dn FROM q0), q AS (SELECT ts, symbol, volatility, coalesce(CASE WHEN sum(up) OVER ({D}) > 0 AND sum(dn) OVER ({D}) > 0 THEN up / nullif(sum(up) OVER ({D}), 0) * 0.6::DOUBLE - dn / nullif(sum(dn) OVER ({D}), 0) * 0.4::DOUBLE END, 0) AS w FROM q1)"


@query("WITH " + _QLS + " " + out({"weight": "w"}, "q"))
def quantile_long_short(spark, sf):
    return rounded(portfolio.quantile_long_short(context(spark, sf), 5, 1.0, 0.2))


@query("WITH " + _QLS + f", v AS (SELECT ts, symbol, coalesce(w / nullif(CASE WHEN volatility IS NOT NULL THEN greatest(volatility, 0.05) END, 0), 0) AS t FROM q), v2 AS (SELECT ts, symbol, greatest(t, 0) AS a, least(t, 0) AS z FROM v) " + out({"weight": f"{gross_sql('a', 0.6)} + {gross_sql('z', 0.4)}"}, "v2"))
def inverse_vol(spark, sf):
    return rounded(portfolio.inverse_vol_weighted(context(spark, sf), 5, 1.0, 0.2))


@query("WITH " + _CTX + f", t AS (SELECT ts, symbol, coalesce(s - avg(s) OVER ({D}), 0) AS w FROM x) " + out({"weight": gross_sql("w")}, "t"))
def score_proportional(spark, sf):
    """With a cap that never binds; tests cover the refill."""
    return rounded(portfolio.score_proportional(context(spark, sf), 10.0))


@query()
def score_proportional_capped(spark, sf):
    return rounded(portfolio.score_proportional(context(spark, sf), 0.08))


@query()
def mean_variance(spark, sf):
    c = context(spark, sf)
    at = c.join(portfolio.rebalance_dates(c, "quarterly"), "ts", "left_semi")
    return rounded(portfolio.mean_variance(at, c.select("ts", "symbol", "ret_1d"), lookback=104, max_names=15))


_BASEW = _CTX + f", t AS (SELECT ts, symbol, volatility AS beta, coalesce(s - avg(s) OVER ({D}) + 0.02::DOUBLE, 0) AS w0 FROM x), w AS (SELECT ts, symbol, beta, {gross_sql('w0', 1.5)} AS w FROM t)"
_HELD = "(w <> 0)::INT::DOUBLE"


def base_weights(spark, sf):
    c = context(spark, sf)
    held = c.select("ts", "symbol", F.col("volatility").alias("beta"), portfolio.masked(c).alias("s"))
    held = held.withColumn("weight", F.coalesce(F.col("s") - F.avg("s").over(by_date()) + 0.02, F.lit(0.0)))
    return portfolio.normalize_gross(held.select("ts", "symbol", "weight", "beta"), 1.5)


_net, _gross, _n = f"sum(w) OVER ({D})", f"sum(abs(w)) OVER ({D})", f"nullif(sum({_HELD}) OVER ({D}), 0)"
_book = f"sum(w * coalesce(beta, 1)) OVER ({D})"
_mean = f"nullif(avg(CASE WHEN w <> 0 THEN beta END) OVER ({D}), 0)"
_CONSTRAINTS = {
    "max_gross": (lambda w, s, f: portfolio.max_gross(w, 1.0), f"w * coalesce(least(1.0::DOUBLE / nullif({_gross}, 0), 1), 1)"),
    "max_net": (lambda w, s, f: portfolio.max_net(w, 0.05), f"w + coalesce({_HELD} / {_n} * (least(greatest({_net}, -0.05), 0.05) - {_net}), 0)"),
    "max_beta": (lambda w, s, f: portfolio.max_beta(w, 0.1), f"w + CASE WHEN abs({_book}) > 0.1 THEN coalesce({_HELD} / {_n} * ((least(greatest({_book}, -0.1), 0.1) - {_book}) / {_mean}), 0) ELSE 0 END"),
    "min_positions": (lambda w, s, f: portfolio.min_positions(w, 12), f"CASE WHEN sum({_HELD}) OVER ({D}) >= 12 THEN w ELSE 0 END"),
    "renormalize": (lambda w, s, f: portfolio.renormalize_gross(w, 0.8), gross_sql("w", 0.8)),
    "max_group": (lambda w, s, f: portfolio.max_group_weight(w.join(groups(s, f), "symbol", "left"), 0.1), None),
}
for _name, (_f, _e) in _CONSTRAINTS.items():

    def _constraint(spark, sf, _f=_f):
        return rounded(_f(base_weights(spark, sf), spark, sf).select("ts", "symbol", "weight"))

    _constraint.__name__ = _name
    query("WITH " + _BASEW + " " + out({"weight": _e}, "w") if _e else "WITH " + _BASEW + ", " + _GROUPS + ", wg AS (SELECT ts, symbol, w, grp, abs(sum(w) OVER (PARTITION BY ts, grp)) AS net FROM w LEFT JOIN g USING (symbol)) SELECT ts, symbol, round(CASE WHEN grp IS NOT NULL AND net > 0.1 THEN w * 0.1::DOUBLE / net ELSE w END, 6) + 0.0 AS weight FROM wg")(_constraint)


@query()
def max_weight(spark, sf):
    return rounded(portfolio.max_weight_per_name(base_weights(spark, sf), 0.1).select("ts", "symbol", "weight"))


# Sparse weights: of each day's suppliers the three with the most volume, by rank.
_SPARSE = bars_sql("day") + ", sw AS (SELECT ts, symbol, 0.1::DOUBLE * (4 - rk) AS w FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) AS rk FROM bars WHERE month(ts) <= 2) WHERE rk <= 3), dt AS (SELECT ts, row_number() OVER (ORDER BY ts) AS d FROM (SELECT DISTINCT ts FROM sw)), sd AS (SELECT symbol, d, w FROM sw JOIN dt USING (ts))"


def _sparse(spark, sf):
    rank = F.row_number().over(by_date().orderBy(F.desc("volume"), "symbol"))
    top = day(spark, sf).filter(F.month("ts") <= 2).withColumn("rk", rank).filter("rk <= 3")
    return top.select("ts", "symbol", (F.lit(0.1) * (4 - F.col("rk"))).alias("weight"))


@query(
    "WITH RECURSIVE " + _SPARSE + ", f AS (SELECT symbol, min(d) AS a FROM sd GROUP BY symbol), "
    "g AS (SELECT f.symbol, dt.d, coalesce(sd.w, 0) AS w, sd.w IS NOT NULL AS here, f.a FROM f JOIN dt ON dt.d >= f.a LEFT JOIN sd ON sd.symbol = f.symbol AND sd.d = dt.d), "
    "e AS (SELECT symbol, d, here, FALSE AS was, CASE WHEN abs(w) < 0.15 THEN 0.0::DOUBLE ELSE w END AS k FROM g WHERE d = a UNION ALL "
    "SELECT g.symbol, g.d, g.here, e.here, CASE WHEN abs(g.w - e.k) < 0.15 THEN e.k ELSE g.w END FROM e JOIN g ON g.symbol = e.symbol AND g.d = e.d + 1) "
    "SELECT ts, symbol, round(k, 6) + 0.0 AS weight FROM e JOIN dt USING (d) WHERE here OR was OR k <> 0"
)
def no_trade_band(spark, sf):
    return rounded(portfolio.no_trade_band(_sparse(spark, sf), 0.15))


@query()
def limit_turnover(spark, sf):
    w = base_weights(spark, sf).select("ts", "symbol", "weight")
    return rounded(portfolio.limit_turnover(w, 0.3))


_CHANGED = "k AS (SELECT d FROM (SELECT coalesce(a.d, b.d + 1) AS d, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS x FROM sd a FULL JOIN sd b ON a.symbol = b.symbol AND a.d = b.d + 1) GROUP BY d HAVING sum(x) > 1e-12 OR d = 1)"


@query("WITH " + _SPARSE.replace("0.1::DOUBLE * (4 - rk)", "0.5::DOUBLE").replace("WHERE rk <= 3", "WHERE rk <= 2").replace("PARTITION BY ts ORDER BY volume DESC, symbol", "PARTITION BY ts ORDER BY length(symbol), symbol") + ", " + _CHANGED + " SELECT ts, symbol, w AS weight FROM sd JOIN dt USING (d) JOIN k USING (d)")
def drop_unchanged(spark, sf):
    rank = F.row_number().over(by_date().orderBy(F.length("symbol"), "symbol"))
    w = day(spark, sf).filter(F.month("ts") <= 2).withColumn("rk", rank).filter("rk <= 2").select("ts", "symbol", F.lit(0.5).alias("weight"))
    return portfolio.drop_unchanged(w)


@query(
    "WITH " + _SPARSE.replace("0.1::DOUBLE * (4 - rk)", "1.0::DOUBLE / count(*) OVER (PARTITION BY ts)").replace("ORDER BY volume DESC, symbol", "ORDER BY length(symbol), symbol").replace("WHERE rk <= 3", "WHERE rk <= 3")
    + ", " + _CHANGED + " SELECT bars.ts, bars.symbol, round(coalesce(sd.w, 0), 6) + 0.0 AS weight FROM bars JOIN dt ON dt.ts = bars.ts JOIN k ON k.d = dt.d LEFT JOIN sd ON sd.d = dt.d AND sd.symbol = bars.symbol"
)
def build_targets(spark, sf):
    b = day(spark, sf).filter(F.month("ts") <= 2)
    rank = F.row_number().over(by_date().orderBy(F.length("symbol"), "symbol"))
    scored = b.withColumn("score", -rank.cast("double")).select("ts", "symbol", "score")
    return rounded(portfolio.build_targets(scored, portfolio.get_constructor("top_n_equal_weight", n=3), None, "on_signal_change"))


@query("WITH " + P + " SELECT symbol, round(median(advd_20), 6) AS median_advd FROM p GROUP BY symbol ORDER BY 2 DESC, 1 LIMIT 10")
def select_universe(spark, sf):
    return rounded(strategy.select_universe(panel(spark, sf), 10))


# --- simulation and evaluation ---------------------------------------------------------------------


def _market(spark, sf):
    return held(spark, (sf, "market"), lambda: _make_market(spark, sf))


def _make_market(spark, sf):
    f = feats.features(week(spark, sf), ["vol_20d", "advd_20"])
    return week(spark, sf).select("ts", "symbol", "open", "high", "low", "close", "volume", "dividend", "split_ratio").join(f, ["ts", "symbol"])


_EXEC = simulate.Execution(participation_rate=1.0, initial_capital=100_000.0)


def _simulated(spark, sf, **how):
    c = context(spark, sf)
    w = portfolio.build_targets(c, portfolio.get_constructor("top_n_equal_weight", n=5), None, "monthly")
    return simulate.simulate(_market(spark, sf), w.withColumn("run_id", F.lit("momentum")), how.get("execution", _EXEC), simulate.Costs(), how.get("risk"))


@query()
def backtest_equity(spark, sf):
    return rounded(simulate.equity(_simulated(spark, sf)), 4)


@query()
def backtest_trades(spark, sf):
    return rounded(simulate.trades(_simulated(spark, sf)), 4)


@query()
def backtest_positions(spark, sf):
    return rounded(simulate.positions(_simulated(spark, sf)), 4)


@query()
def backtest_risk_rules(spark, sf):
    return rounded(simulate.trades(_simulated(spark, sf, risk=simulate.Risk(stop_loss=0.05, trailing_stop=0.1, take_profit=0.2))), 4)


@query()
def invariants(spark, sf):
    return simulate.check_invariants(_simulated(spark, sf))


_ORD = F2 + f", o AS (SELECT ts, symbol, trunc(v / 3) AS qty, close AS price, high, low, close, {R('stddev_samp', 'logret_1d', 20)} * {A} AS sigma, {R('avg', 'dollar_vol', 20)} AS advd FROM f2), o2 AS (SELECT *, abs(qty) * price AS notional FROM o)"


@query("WITH " + _ORD + " " + out({"notional": "notional", "commission": "notional * 0.00005::DOUBLE", "spread": "notional * greatest(0.0002::DOUBLE, least(greatest(coalesce(0.02::DOUBLE * (high - low) / nullif(close, 0), 0), 0), 0.01::DOUBLE))", "slippage": "notional * 0.1::DOUBLE * coalesce(sigma, 0.02::DOUBLE) / sqrt(252.0::DOUBLE) * CASE WHEN advd > 0 THEN sqrt(least(notional / advd, 1)) ELSE 0 END"}, "o2", digits=4, shift=1.3e-6))
def cost_components(spark, sf):
    f = feats.features(week(spark, sf), ["vol_20d", "advd_20"])
    orders = week(spark, sf).join(f, ["ts", "symbol"]).select("ts", "symbol", F.floor(F.col("volume") / 3).cast("double").alias("qty"), F.col("close").alias("price"), "high", "low", "close", F.col("vol_20d").alias("sigma"), F.col("advd_20").alias("advd"))
    return rounded(simulate.cost_components(orders).select("ts", "symbol", "notional", "commission", "spread", "slippage"), 4, 1.3e-6)


_SPEC = strategy.Spec.from_dict({"name": "weekly_momentum", "components": [{"signal": "momentum_12_1"}, {"signal": "low_vol_20d", "weight": 0.5}], "construction": {"quantiles": 5}, "constraints": {"max_weight_per_name": 0.3, "max_net": 0.1}, "rebalance": "monthly", "execution": {"participation_rate": 1.0}, "initial_capital": 100_000.0})


def _full_panel(spark, sf):
    return held(spark, (sf, "full"), lambda: _make_full(spark, sf))


def _make_full(spark, sf):
    return _market(spark, sf).join(panel(spark, sf).select("ts", "symbol", "mom_12_1", "ret_1d", "ret_5d", "stale_px_frac_20"), ["ts", "symbol"])


@query()
def strategy_run(spark, sf):
    return rounded(simulate.equity(strategy.run(_SPEC, _full_panel(spark, sf), run_id="run")), 4)


@query()
def sweep(spark, sf):
    result, parameters = strategy.sweep(_SPEC, _full_panel(spark, sf), {"half_spread_bps": [1.0, 5.0], "commission_bps": [0.5, 2.0]}, "costs")
    return rounded(evaluate.performance(simulate.equity(result)).select("run_id", "total_return", "max_drawdown", "sharpe"))


@query()
def baselines(spark, sf):
    return rounded(evaluate.performance(simulate.equity(strategy.baselines(_SPEC, _full_panel(spark, sf), top=10))).select("run_id", "total_return", "sharpe"))


@query("WITH " + bars_sql("week") + ", s AS (SELECT * FROM bars WHERE symbol = (SELECT min(symbol) FROM bars)), n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM s), f AS (SELECT open AS px, trunc(1000 / open) AS q FROM n WHERE rn = 2) SELECT ts, round(CASE WHEN rn < 2 THEN 1000 ELSE 1000 - least(q, trunc(1.0 * q)) * px + q * close END, 4) AS equity FROM n, f")
def buy_and_hold(spark, sf):
    b = _market(spark, sf)
    first = week(spark, sf).agg(F.min("symbol")).first()[0]  # one value
    result = strategy.buy_and_hold(b, first, simulate.Execution(participation_rate=1.0, initial_capital=1000.0), simulate.Costs(enabled=False))
    return rounded(simulate.equity(result).select("ts", "equity"), 4)


def _folds(step: int) -> str:
    return f"WITH RECURSIVE n AS (SELECT count(DISTINCT date_trunc('day', l_shipdate)) AS n FROM lineitem), f AS (SELECT 0 AS fold, 0 AS s UNION ALL SELECT fold + 1, s + {step} FROM f, n WHERE s + 1034 < n AND s + {step} + 782 < n) SELECT fold::BIGINT AS fold, s::BIGINT AS train_start, (s + 756)::BIGINT AS train_end, (s + 782)::BIGINT AS test_start, least(s + 1034, n)::BIGINT AS test_end FROM f, n WHERE s + 782 < n"


def _walk(spark, sf, step):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.countDistinct(F.date_trunc("day", "l_shipdate"))).first()[0]
    rows = [(k, *a, *b) for k, (a, b) in enumerate(strategy.walk_forward(n, step=step))]
    return spark.createDataFrame(rows, "fold long, train_start long, train_end long, test_start long, test_end long")


@query(_folds(252))
def walk_forward(spark, sf):
    return _walk(spark, sf, None)


@query(_folds(63))
def walk_forward_overlap(spark, sf):
    return _walk(spark, sf, 63)


# Curves: each brand's weekly close as the equity of a run.
_CURVE = bars_sql("week") + ", cv AS (SELECT symbol AS run_id, ts, close AS equity FROM bars), rt AS (SELECT *, row_number() OVER w AS bar, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret, equity / max(equity) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY ts))"


def curve(spark, sf):
    return week(spark, sf).select(F.col("symbol").alias("run_id"), "ts", F.col("close").alias("equity"))


_PERF = "p AS (SELECT run_id, count(*) AS bars, arg_min(equity, ts) AS a, arg_max(equity, ts) AS z, avg(ret) AS m, stddev_samp(ret) AS sd, sqrt(avg(least(ret, 0) * least(ret, 0)) FILTER (WHERE ret IS NOT NULL)) AS dn, min(dd) AS mdd, count(*) FILTER (WHERE ret > 0) / count(ret) AS hit, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END), 0) AS pf, skewness(ret) AS sk, kurtosis(ret) AS ku, avg(ret) FILTER (WHERE ret > 0) AS aw, avg(ret) FILTER (WHERE ret < 0) AS al FROM rt GROUP BY run_id)"


@query("WITH " + _CURVE + ", " + _PERF + f", p2 AS (SELECT *, power(z / a, 252.0::DOUBLE / (bars - 1)) - 1 AS cagr FROM p) SELECT run_id, bars, round(z / a - 1, 6) AS total_return, round(cagr, 6) + 0.0 AS cagr, round(sd * {A}, 6) AS annual_volatility, round(dn * {A}, 6) AS downside_deviation, round(mdd, 6) AS max_drawdown, round(m / sd * {A}, 6) AS sharpe, round(m * 252 / (dn * {A}), 6) AS sortino, round(cagr / abs(mdd), 6) + 0.0 AS calmar, round(hit, 6) AS hit_rate, round(coalesce(aw, 0), 6) AS avg_win, round(coalesce(al, 0), 6) AS avg_loss, round(coalesce(pf, 'inf'::DOUBLE), 6) AS profit_factor, round(sk, 6) AS skew, round(ku, 6) AS kurtosis FROM p2")
def perf_summary(spark, sf):
    return rounded(evaluate.performance(curve(spark, sf)))


@query("WITH " + _CURVE + ", u AS (SELECT run_id, bar, bar - row_number() OVER (PARTITION BY run_id ORDER BY bar) AS g FROM rt WHERE dd < 0) SELECT run_id, max(n) AS drawdown_duration FROM (SELECT run_id, g, count(*) AS n FROM u GROUP BY run_id, g) GROUP BY run_id")
def drawdown_duration(spark, sf):
    return evaluate.drawdown_duration(curve(spark, sf))


@query("WITH " + _CURVE + ", q AS (SELECT run_id, quantile_cont(ret, 0.05) AS v FROM rt GROUP BY run_id) SELECT run_id, round(v, 6) AS value_at_risk, round(avg(ret) FILTER (WHERE ret <= v), 6) AS conditional_var FROM rt JOIN q USING (run_id) GROUP BY run_id, v")
def var_cvar(spark, sf):
    return rounded(evaluate.var_cvar(curve(spark, sf)))


@query("WITH " + _CURVE + " SELECT run_id, date_trunc('month', ts)::TIMESTAMP AS month, round(product(1 + coalesce(ret, 0)) - 1, 6) + 0.0 AS ret FROM rt GROUP BY 1, 2")
def monthly_returns(spark, sf):
    return rounded(evaluate.monthly_returns(curve(spark, sf)))


@query("WITH " + _CURVE + ", j AS (SELECT a.run_id, a.ret AS x, b.ret AS y FROM rt a JOIN rt b ON a.ts = b.ts AND b.run_id = (SELECT min(run_id) FROM cv) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL) SELECT run_id, count(*) AS n, round(covar_samp(x, y) / var_samp(y), 6) + 0.0 AS beta, round((avg(x) - covar_samp(x, y) / var_samp(y) * avg(y)) * 252, 6) + 0.0 AS alpha, round(coalesce(avg(x - y) / nullif(stddev_samp(x - y), 0) * " + A + ", 0), 6) + 0.0 AS information_ratio FROM j GROUP BY run_id")
def alpha_beta(spark, sf):
    c = curve(spark, sf)
    first = c.groupBy().agg(F.min("run_id").alias("run_id"))
    return rounded(evaluate.alpha_beta(c, c.join(F.broadcast(first), "run_id", "left_semi")))


_POS = "pz AS (SELECT 'r' AS run_id, ts, symbol FROM bars), bn AS (SELECT ts, row_number() OVER (ORDER BY ts) AS bar FROM (SELECT DISTINCT ts FROM bars))"


def _held(spark, sf):
    b = week(spark, sf)
    c = b.select("ts").distinct().select(F.lit("r").alias("run_id"), "ts", F.lit(1.0).alias("equity"))
    return b.select(F.lit("r").alias("run_id"), "ts", "symbol", (F.col("close") / 1e4).alias("weight")), c


@query("WITH " + bars_sql("week") + ", " + _POS + ", k AS (SELECT run_id, symbol, bar, lag(bar) OVER (PARTITION BY symbol ORDER BY bar) AS p FROM pz JOIN bn USING (ts)) SELECT run_id, round(count(*) / count(*) FILTER (WHERE p IS NULL OR bar - p <> 1), 6) AS avg_holding_days FROM k GROUP BY run_id")
def holding_period(spark, sf):
    return rounded(evaluate.holding_period(*_held(spark, sf)))


@query("WITH " + bars_sql("week") + ", k AS (SELECT symbol, avg(close / 10000) AS mean_weight, count(*) AS days_held FROM bars GROUP BY symbol) SELECT 'r' AS run_id, symbol, round(mean_weight, 6) AS mean_weight, days_held FROM k ORDER BY days_held DESC, symbol LIMIT 20")
def contribution_by_symbol(spark, sf):
    return rounded(evaluate.contribution_by_symbol(_held(spark, sf)[0]))


@query("WITH " + bars_sql("week") + ", t AS (SELECT ts, close * 2 AS notional, close * 0.001::DOUBLE AS c1, close * 0.002::DOUBLE AS c2, close * 0.003::DOUBLE AS c3 FROM bars), e AS (SELECT ts, 100000 + sum(close) AS eq FROM bars GROUP BY ts), d AS (SELECT t.ts, sum(notional) / any_value(eq) AS turned FROM t JOIN e USING (ts) GROUP BY t.ts) SELECT 'r' AS run_id, count(*) AS trade_count, round((SELECT sum(turned) FROM d) / ((SELECT count(*) FROM e) / 252.0::DOUBLE), 6) AS annual_turnover, round(avg(notional), 6) AS avg_trade_notional, round(sum(c1 + c2 + c3), 4) AS total_cost, round(sum(c1), 4) AS commission, round(sum(c2), 4) AS spread, round(sum(c3), 4) AS slippage FROM t")
def trading_stats(spark, sf):
    b = week(spark, sf)
    t = b.select(F.lit("r").alias("run_id"), "ts", (F.col("close") * 2).alias("notional"), *[(F.col("close") * x).alias(n) for n, x in (("commission", 0.001), ("spread", 0.002), ("slippage", 0.003))])
    e = b.groupBy("ts").agg((100000 + F.sum("close")).alias("equity")).withColumn("run_id", F.lit("r"))
    got = evaluate.trading_stats(t, e)
    return got.select("run_id", "trade_count", F.round("annual_turnover", 6).alias("annual_turnover"), F.round("avg_trade_notional", 6).alias("avg_trade_notional"), *[F.round(c, 4).alias(c) for c in ("total_cost", "commission", "spread", "slippage")])


@query("WITH " + _CURVE + ", " + _PERF + f" SELECT run_id, round(z / a - 1, 6) AS total_return, round(m / sd * {A}, 6) AS sharpe, round(mdd, 6) AS max_drawdown FROM p")
def compare_runs(spark, sf):
    return rounded(evaluate.compare(curve(spark, sf)).select("run_id", "total_return", "sharpe", "max_drawdown"))


@query("SELECT symbol, n FROM (SELECT p_brand AS symbol, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40 GROUP BY ALL) ORDER BY n DESC LIMIT 5")
def sql_passthrough(spark, sf):
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("lineitem")
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("part")
    return source.query(spark, "SELECT p_brand AS symbol, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > ? GROUP BY p_brand ORDER BY n DESC LIMIT 5", [40])


@query("WITH " + F1 + ", t AS (SELECT symbol, ts, ret_1d, rank() OVER (PARTITION BY ts ORDER BY round(ret_1d, 9) NULLS LAST) AS r FROM f1) SELECT symbol, max(ts) AS last_ts, round(arg_max(ret_1d, ts), 6) + 0.0 AS last_ret, arg_max(r, ts) AS last_rank FROM t GROUP BY symbol")
def latest_rank(spark, sf):
    f = feats.features(week(spark, sf), ["ret_1d"]).withColumn("r", F.rank().over(by_date().orderBy(F.round("ret_1d", 9).asc_nulls_last())))
    return rounded(f.groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.max_by("ret_1d", "ts").alias("last_ret"), F.max_by("r", "ts").cast("long").alias("last_rank")))


@query(f"SELECT * FROM ({SQL['cs_rank']}) JOIN ({SQL['beta_corr_idio']}) USING (ts, symbol)")
def cs_panel(spark, sf):
    made = cross_section.panel(feats.features(week(spark, sf), ["ret_1d", "ret_21d", "mom_12_1", "vol_20d", "advd_20", "rsi_14"]))
    columns = [c for name in ("cs_rank", "beta_corr_idio") for c in QUERIES[name](spark, sf).columns if c not in ("ts", "symbol")]
    return rounded(made.select("ts", "symbol", *columns))


# --- ingest ---------------------------------------------------------------------------------------


def _raw(spark, sf):
    b = week(spark, sf)
    return b.select(F.col("ts").alias("Date"), F.lower("symbol").alias("Ticker"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")], F.col("adj_close").alias("Adj Close"))


_COVER = "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS row_count FROM bars GROUP BY symbol"


def _ingested(spark, sf, runs):
    """The lake after ingests with (mode, end, symbols); the last report."""
    root, done = scratch(spark, "lake"), None
    names = week(spark, sf).select(F.upper("symbol").alias("symbol")).distinct()
    for mode, end, extra in runs:
        asked = names.unionByName(spark.createDataFrame([(x,) for x in extra], "symbol string"))
        done = ingest.ingest(spark, root, TableConnector(_raw(spark, sf)), asked, mode=mode, end=end, now=datetime(2024, 1, 2))
    return root, done


@query("WITH " + bars_sql("week") + " " + _COVER.replace("symbol,", "upper(symbol) AS symbol,", 1))
def ingest_full(spark, sf):
    root, _ = _ingested(spark, sf, [("full", None, [])])
    return catalog.coverage(source.read_bars(spark, root, source.Partition()))


@query("WITH " + bars_sql("week") + ", u AS (SELECT upper(symbol) AS symbol, ts FROM bars) SELECT symbol, 'ok' AS status, count(*) AS row_count, count(*) FILTER (WHERE ts > '1998-01-01') AS rows_added FROM u GROUP BY symbol")
def ingest_incremental(spark, sf):
    _, done = _ingested(spark, sf, [("auto", datetime(1998, 1, 1), []), ("incremental", None, [])])
    return done.results.select("symbol", "status", "row_count", "rows_added")


@query("WITH " + bars_sql("week") + ", u AS (SELECT upper(symbol) AS symbol, ts FROM bars) SELECT symbol, 'ok' AS status, NULL AS message, max(ts) AS last_ts, count(*) AS row_count FROM u GROUP BY symbol UNION ALL SELECT 'NO SUCH', 'error', 'no data', NULL, 0")
def ingest_failure(spark, sf):
    root, _ = _ingested(spark, sf, [("auto", None, ["NO SUCH"]), ("auto", None, ["NO SUCH"])])
    return ingest.read_state(spark, root).select("symbol", "status", "message", "last_ts", "row_count")


@query("WITH " + bars_sql("week") + " SELECT upper(symbol) AS symbol, 'us' AS region, '1d' AS interval, 'table' AS provider, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS row_count FROM bars GROUP BY symbol")
def refresh_state(spark, sf):
    root = scratch(spark, "lake")
    source.write_bars(cleaning.clean_bars(cleaning.normalize_bars(_raw(spark, sf))), root, source.Partition())
    return ingest.refresh_state(spark, root, "table").select("symbol", "region", "interval", "provider", "first_ts", "last_ts", "row_count")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly panel: features, market-relative return and cross-sectional rank."""
    f = feats.features(source.derive_bars(spark, sf, "month"), ["close", "ret_1d", "ret_5d", "vol_20d", "zscore_20"])
    ranked = f.withColumn("rank_ret_1d", cross_section.pct_rank(F.col("ret_1d")))
    return rounded(with_ordinal(ranked).orderBy("ts", "symbol"))
