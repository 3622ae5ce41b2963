import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import calendar
from tessera.functions.windows import pct_rank
from tessera.operators import catalog, cleaning, cross_section, features, signals
from tessera.schemas import Partition
from tessera.sources import bars as source


def make_bars(spark, closes, symbol="A", start="2021-01-04", **columns):
    n = len(closes)
    frame = pd.DataFrame({"ts": pd.bdate_range(start, periods=n), "symbol": symbol, "close": np.asarray(closes, float)})
    for name in ("open", "high", "low", "adj_close"):
        frame[name] = np.asarray(columns.get(name, closes), float)
    frame["volume"] = np.asarray(columns.get("volume", [1e6] * n), float)
    frame = frame.assign(adj_factor=np.nan, dividend=0.0, split_ratio=0.0, repaired=False)
    df = spark.createDataFrame(frame)
    return df.withColumn("adj_factor", F.lit(None).cast("double"))


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def walk(n, seed=0):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0.0003, 0.02, n)))


def test_returns_and_averages(spark):
    f = features.features(make_bars(spark, [100, 110, 99]), ["ret_1d"])
    assert column(f, "ret_1d")[1:] == pytest.approx([0.10, -0.10])
    f = features.features(make_bars(spark, [10] * 9 + [20]), ["px_to_sma_10"])
    assert column(f, "px_to_sma_10")[-1] == pytest.approx(20 / 11 - 1)
    assert column(f, "px_to_sma_10")[:-1] == [None] * 9


def test_splits_are_neutral(spark):
    f = features.features(make_bars(spark, [100, 50], adj_close=[50, 50]), ["ret_1d"])
    assert column(f, "ret_1d")[1] == 0


def test_recursive_features_match_pandas(spark):
    c = walk(120)
    b = make_bars(spark, c, high=c * 1.01, low=c * 0.99)
    got = features.features(b, ["rsi_14", "macd_hist", "atr_14", "adx_14"]).orderBy("ts").toPandas()
    move = pd.Series(c).diff()
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (move.clip(lower=0), (-move).clip(lower=0)))
    assert np.allclose(got["rsi_14"].astype(float), 100 - 100 / (1 + gain / loss), equal_nan=True)
    assert got["macd_hist"].notna().idxmax() == 33 and got["adx_14"].notna().idxmax() == 26 and got["atr_14"].notna().idxmax() == 13
    up = features.features(make_bars(spark, range(1, 31)), ["rsi_14"])
    assert column(up, "rsi_14")[-1] == 100
    down = features.features(make_bars(spark, range(40, 10, -1)), ["rsi_14"])
    assert column(down, "rsi_14")[-1] == 0


def test_bollinger_of_an_alternation(spark):
    closes = [100, 101] * 10
    f = features.features(make_bars(spark, closes), ["bb_pctb_20"])
    s = math.sqrt(5 / 19)
    assert column(f, "bb_pctb_20")[-1] == pytest.approx((101 - (100.5 - 2 * s)) / (4 * s))


def test_shape_of_a_constant_window(spark):
    f = features.features(make_bars(spark, [100.0] * 254), ["skew_252d", "kurt_252d", "sharpe_252d"])
    assert column(f, "skew_252d")[-1] == 0 and column(f, "kurt_252d")[-1] == -3 and column(f, "sharpe_252d")[-1] is None


def test_skew_and_kurtosis_match_pandas(spark):
    c = walk(260, 3)
    f = features.features(make_bars(spark, c), ["skew_252d", "kurt_252d"]).orderBy("ts").toPandas()
    r = pd.Series(c).pct_change()
    assert np.allclose(f["skew_252d"].astype(float), r.rolling(252).skew(), equal_nan=True)
    assert np.allclose(f["kurt_252d"].astype(float), r.rolling(252).kurt(), equal_nan=True)


def test_features_never_look_ahead(spark):
    c = walk(320, 5)
    full = features.features(make_bars(spark, c, high=c * 1.01, low=c * 0.98)).orderBy("ts").toPandas()
    cut = features.features(make_bars(spark, c[:270], high=c[:270] * 1.01, low=c[:270] * 0.98)).orderBy("ts").toPandas()
    for name in features.metric_names():
        if name != "repaired":
            assert np.allclose(full[name][:270].astype(float), cut[name].astype(float), rtol=1e-9, equal_nan=True), name
    ahead = features.labels(make_bars(spark, c)).orderBy("ts").toPandas()["fwd_ret_1d"][269]
    assert not pd.isna(ahead) and pd.isna(features.labels(make_bars(spark, c[:270])).orderBy("ts").toPandas()["fwd_ret_1d"][269])


def test_declared_history(spark):
    c = walk(320, 6)
    f = features.features(make_bars(spark, c, open=c * 0.995, high=c * 1.01, low=c * 0.98, volume=np.arange(320) + 1e6)).orderBy("ts").toPandas()
    for name, first in features.MIN_PERIODS.items():
        if name not in features.PASSED:
            assert f[name].notna().idxmax() == first - 1, name


def test_clean_and_merge(spark):
    b = make_bars(spark, [10.0, 11, -1, 13, 14], high=[10, 11, 12, 5, 14], low=[9, 9, 9, 9, 9])
    kept = cleaning.clean_bars(b.unionByName(b))
    assert [r.close for r in kept.orderBy("ts").collect()] == [10, 11, 14]
    late = make_bars(spark, [1.0, 2.0], start="2021-01-08")
    merged = cleaning.merge_bars(b, late)
    assert merged.count() == 6 and merged.filter("ts = timestamp'2021-01-08'").first().close == 1


def test_normalize_vendor_columns(spark):
    raw = spark.createDataFrame([("2024-01-01", " abc", "10", "12", "9", "nan", "YES"), ("never", "x", "1", "1", "1", "1", "no")], ["Date", "Ticker", "Open", "High", "Low", "Close", "Repaired?"])
    row = cleaning.normalize_bars(raw).collect()
    assert len(row) == 1 and row[0].symbol == "ABC" and row[0].repaired and row[0].close is None and row[0].dividend == 0 and row[0].adj_factor == 1


def test_lake_round_trip_and_csv(spark, tmp_path):
    b, part = make_bars(spark, [1.0, 2, 3], symbol="CON"), Partition("us", "stocks", "1d")
    source.write_bars(b, str(tmp_path), part)
    source.write_bars(make_bars(spark, [5.0]), str(tmp_path), Partition("eu", "stocks", "1d"))
    assert source.read_symbol(spark, str(tmp_path), "con", part).count() == 3
    assert source.read_bars(spark, str(tmp_path), part, columns=["ts", "close"]).columns == ["ts", "close"]
    assert source.stored_partitions(source.read_lake(spark, str(tmp_path))).count() == 2
    source.register_views(spark, str(tmp_path))
    assert source.query(spark, "SELECT count(*) AS n FROM bars WHERE close > ?", [1.5]).first().n == 3
    csv = tmp_path / "csv"
    csv.mkdir()
    (csv / "AAA_1d.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,100\nbad,1,2,1,2,3\n")
    (csv / "quality_x.csv").write_text("a,b\n1,2\n")
    got = source.migrate_csv(spark, str(csv)).collect()
    assert [(r.symbol, r.close) for r in got] == [("AAA", 2.0)]
    with pytest.raises(ValueError):
        Partition("us", "stocks", "1y")


def test_state_survives_a_failure(spark):
    key = ("A", "us", "stocks", "1d", "p")
    kinds = "symbol string, region string, asset_class string, interval string, provider string, first_ts timestamp, last_ts timestamp, row_count long, status string, message string, updated_at timestamp"
    old = spark.createDataFrame([(*key, datetime(2020, 1, 1), datetime(2020, 2, 1), 20, "ok", None, None)], kinds)
    new = spark.createDataFrame([(*key, None, None, 0, "failed", "timeout", None)], kinds)
    row = catalog.upsert_state(old, new).first()
    assert (row.last_ts, row.row_count, row.status) == (datetime(2020, 2, 1), 20, "failed")


def test_calendar():
    assert [calendar.easter(y) for y in (2024, 2025, 2000)] == [date(2024, 3, 31), date(2025, 4, 20), date(2000, 4, 23)]
    assert len(calendar.sessions(date(2024, 1, 1), date(2024, 12, 31))) == 252
    assert calendar.is_session(date(2021, 12, 31)) and not calendar.is_session(date(2021, 7, 5)) and not calendar.is_session(date(2022, 6, 20)) and not calendar.is_session(date(2012, 10, 29))
    assert calendar.close_time(date(2024, 7, 3)).hour == 13
    assert len(calendar.sessions(date(2024, 7, 1), date(2024, 7, 8))) == 5
    assert calendar.next_session(date(2024, 7, 3)) == date(2024, 7, 5) and calendar.previous_session(date(2024, 7, 5)) == date(2024, 7, 3)


def mini(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(start + timedelta(days=k), s, None if x is None else float(x)) for k, row in enumerate(rows) for s, x in zip("ABCD", row, strict=True)], "ts timestamp, symbol string, score double")


def by_date(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.ts, {})[r.symbol] = r.score
    return [[d.get(s) for s in "ABCD"] for _, d in sorted(out.items())]


ROWS = [[1, 2, 3, 100], [4, 5, 6, 7], [None, 1, 2, 3], [0, 0, 0, 0]]


def test_transforms(spark):
    s = mini(spark, ROWS)
    assert all(abs(sum(x for x in row if x is not None)) < 1e-9 for row in by_date(signals.demean(s, 2)))
    z = by_date(signals.zscore(s, 2))
    assert np.std(z[0], ddof=1) == pytest.approx(1) and z[3] == [None] * 4
    assert by_date(signals.rank_normalize(s, 2))[1] == pytest.approx([-0.5, 0, 0.5, 1])
    assert by_date(signals.winsorize(s, 0.0, 0.5))[0] == [1, 2, 2.5, 2.5]
    groups = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "symbol string, grp string")
    assert by_date(signals.group_neutral(s, groups))[0] == [-0.5, 0.5, 0, None]
    betas = {"A": 0.5, "B": 1.0, "C": 1.5, "D": 2.0}
    held = mini(spark, [[1, 2, 3, 4]]).withColumn("beta", F.create_map(*[F.lit(x) for kv in betas.items() for x in kv])[F.col("symbol")])
    assert by_date(signals.beta_neutral(held))[0] == pytest.approx([0, 0, 0, 0], abs=1e-12)
    with pytest.raises(ValueError):
        signals.winsorize(s, 0.9, 0.1)


def test_average_ranks(spark):
    got = mini(spark, [[5, 5, 1, None]]).select("ts", "symbol", pct_rank(F.col("score")).alias("score"))
    assert by_date(got)[0][:3] == pytest.approx([2.5 / 3, 2.5 / 3, 1 / 3])


def noise_panel(spark, dates=30, names=25, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(datetime(2024, 1, 1) + timedelta(days=d), f"S{n:02d}", float(rng.normal())) for d in range(dates) for n in range(names)]
    return spark.createDataFrame(rows, "ts timestamp, symbol string, score double")


def test_information_coefficient_extremes(spark):
    s = noise_panel(spark)
    same = s.select("ts", "symbol", F.col("score").alias("fwd_ret_1d"))
    assert all(r.ic == pytest.approx(1) for r in signals.ic_series(s, same).collect())
    flipped = same.withColumn("fwd_ret_1d", -F.col("fwd_ret_1d"))
    row = signals.ic_summary(s, flipped, quantiles=5).first()
    assert row.ic_mean == pytest.approx(-1) and row.spread_mean < 0 and row.coverage_mean == 25
    constant = s.withColumn("score", F.col("symbol").substr(2, 2).cast("double"))
    assert all(r.turnover in (None, 0) for r in signals.turnover(constant).collect())
    assert all(r.autocorr == pytest.approx(1) for r in signals.autocorrelation(constant, 5).collect())
    thin = s.filter("symbol < 'S10'")
    assert all(r.ic is None for r in signals.ic_series(thin, same).collect())


def test_composites_and_registry(spark):
    panel = noise_panel(spark).select("ts", "symbol", F.col("score").alias("x"), (-F.col("score")).alias("y"), F.lit(10.0).alias("close"))
    one, two = (signals.get_signal("metric", metric=m, winsor=None) for m in "xy")
    both = signals.rank_combine([one, two]).compute(panel)
    assert all(abs(r.score - 1 / 25) < 1e-9 for r in both.collect())  # ranks go from 1 to n, not 0 to n - 1
    assert signals.get_signal("random", seed=3).compute(panel).orderBy("ts", "symbol").collect() == signals.get_signal("random", seed=3).compute(panel.repartition(7)).orderBy("ts", "symbol").collect()
    for bad in (lambda: signals.get_signal("nope"), lambda: signals.CompositeSignal([], []), lambda: signals.CompositeSignal([one], [0.0])):
        with pytest.raises(ValueError):
            bad()


def test_beta_of_twice_the_market(spark):
    rng = np.random.default_rng(4)
    market = rng.normal(0, 0.01, 200)
    rows = []
    for k in range(24):
        own = market * (2 if k == 0 else 1) + (0 if k == 0 else rng.normal(0, 1e-9, 200))
        rows += [(datetime(2023, 1, 1) + timedelta(days=d), f"S{k:02d}", float(own[d]), 0.0) for d in range(200)]
    f = spark.createDataFrame(rows, "ts timestamp, symbol string, ret_1d double, ret_21d double")
    last = cross_section.risk_to_market(f).filter("symbol = 'S00'").orderBy(F.desc("ts")).first()
    assert last.beta_252d == pytest.approx(2 / (25 / 24), rel=1e-4) and last.corr_mkt_252d == pytest.approx(1, abs=1e-6)
    assert cross_section.risk_to_market(f).filter("beta_252d is not null").groupBy("symbol").count().first()["count"] == 200 - 125


def test_universe(spark):
    rows = [("A.B", "Alpha Common Stock", "N", "N", "N"), ("ETF", "Fund Trust", "N", "Y", "N"), ("W", "W Common Stock Warrants", "N", "N", "N"), ("T", "Test Common Stock", "N", "N", "Y"), ("A.B", "Beta Common Stock", "N", "N", "N")]
    got = {r.symbol: r.asset_class for r in cleaning.classify_universe(spark.createDataFrame(rows, "symbol string, name string, exchange string, etf string, test_issue string")).collect()}
    assert got == {"A-B": "stock", "ETF": "etf", "W": "other"}
