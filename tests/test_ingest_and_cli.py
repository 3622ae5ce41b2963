import json
import logging
import math
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import cli, settings
from tessera.operators import cleaning, cross_section, evaluate, features, portfolio, signals
from tessera.plans import ingest, strategy
from tessera.schemas import Partition
from tessera.sources import bars, connectors
from tessera.streaming import ingest as stream

DAY = timedelta(days=1)
START = datetime(2024, 1, 1)


def raw(spark, symbols=("AAA", "BBB"), n=40, dirty=()):
    rows = []
    for k, s in enumerate(symbols):
        for i in range(n):
            base = 10 + k + i * 0.1 + (i * 7 % 5) * 0.3
            high = 0.5 if (s, i) in dirty else base * 1.02
            rows.append((START + i * DAY, s, base, high, base * 0.98, base * 1.01, base * 1.0, 1000.0 + i))
    return spark.createDataFrame(rows, "Date timestamp, Ticker string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double")


def names(spark, *symbols):
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def test_ingest_resumes_and_records_failures(spark, tmp_path):
    root, part = str(tmp_path), Partition()
    first = connectors.TableConnector(raw(spark, n=30, dirty={("BBB", 3)}))
    done = ingest.ingest(spark, root, first, names(spark, "AAA", "BBB", "GONE"), part)
    assert (done.requested, done.updated, done.failed, done.rows_added) == (3, 2, 1, 59)
    state = {r.symbol: r for r in ingest.read_state(spark, root).collect()}
    assert state["GONE"].status == "error" and state["GONE"].message == "no data" and state["BBB"].row_count == 29
    again = ingest.ingest(spark, root, first, names(spark, "AAA", "BBB"), part, mode="incremental")
    assert (again.updated, again.unchanged, again.rows_added) == (0, 2, 0)
    more = ingest.ingest(spark, root, connectors.TableConnector(raw(spark, n=40, dirty={("BBB", 3)})), names(spark, "AAA"), part)
    assert more.rows_added == 10
    held = bars.read_bars(spark, root, part)
    assert {r.symbol: r["count"] for r in held.groupBy("symbol").count().collect()} == {"AAA": 40, "BBB": 29}
    # A failure later does not erase what is covered.
    empty = connectors.TableConnector(raw(spark, symbols=("ZZZ",)))
    assert ingest.ingest(spark, root, empty, names(spark, "AAA"), part).failed == 1
    row = {r.symbol: r for r in ingest.read_state(spark, root).collect()}["AAA"]
    assert row.status == "error" and row.row_count == 40 and row.last_ts == START + 39 * DAY
    # The state can be rebuilt from the bars.
    rebuilt = {r.symbol: r for r in ingest.refresh_state(spark, root, "table").collect()}
    assert rebuilt["AAA"].status == "ok" and rebuilt["AAA"].row_count == 40


def test_plan_starts_and_connectors(spark):
    state = ingest.read_state(spark, "/tmp/no-such-lake")
    source = connectors.TableConnector(raw(spark))
    with pytest.raises(ValueError, match="incremental"):
        ingest.plan_starts(names(spark, "AAA"), state, source, Partition(), "incremental")
    assert ingest.plan_starts(names(spark, "AAA"), state, source, Partition()).first().start is None

    class Short(connectors.TableConnector):
        name, intervals, lookback = "short", frozenset(["1d"]), {"1d": timedelta(days=7)}

    connectors.register(Short)
    made = connectors.get_connector("short", raw(spark))
    now = datetime(2024, 2, 1)
    assert ingest.plan_starts(names(spark, "AAA"), state, made, Partition(), now=now).first().start == datetime(2024, 1, 25)
    assert made.clamp_start("1d", datetime(2024, 1, 30), now) == datetime(2024, 1, 30)
    with pytest.raises(ValueError, match="serve"):
        made.check_interval("1m")
    with pytest.raises(ValueError, match="unknown connector"):
        connectors.get_connector("none")


def test_resolve_symbols(spark, tmp_path):
    (tmp_path / "s.txt").write_text("aaa\n# a comment\nccc # another\n\n")
    found = ingest.resolve_symbols(spark, ["bbb", "AAA"], str(tmp_path / "s.txt"))
    assert sorted(r.symbol for r in found.collect()) == ["AAA", "BBB", "CCC"]
    stored = names(spark, "CCC", "BBB")
    assert [r.symbol for r in ingest.resolve_symbols(spark, "bbb", str(tmp_path / "s.txt"), stored=stored, first=1).collect()] == ["BBB"]
    with pytest.raises(ValueError, match="give symbols"):
        ingest.resolve_symbols(spark)


def test_lake_that_is_not_there(spark, tmp_path):
    held = bars.read_symbol(spark, str(tmp_path / "none"), "AAA", Partition())
    assert held.count() == 0 and "adj_close" in held.columns


def test_stream_merges_once(spark, tmp_path):
    made = cleaning.normalize_bars(raw(spark, n=5))
    made.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream.merge_stream(stream.stream_bars(spark, str(tmp_path / "in")), str(tmp_path / "lake"), Partition(), str(tmp_path / "cp")).awaitTermination()
    late = made.filter("symbol = 'AAA'").withColumn("close", F.col("close") * 1.001)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream.merge_stream(stream.stream_bars(spark, str(tmp_path / "in")), str(tmp_path / "lake"), Partition(), str(tmp_path / "cp")).awaitTermination()
    held = bars.read_bars(spark, str(tmp_path / "lake"), Partition())
    assert held.count() == 10
    assert held.join(late.select("ts", "symbol", F.col("close").alias("c")), ["ts", "symbol"]).filter("close = c").count() == 5


def weights(spark, *rows):
    return spark.createDataFrame([(START + d * DAY, s, w) for d, s, w in rows], "ts timestamp, symbol string, weight double")


def test_drop_unchanged_sees_entries_and_exits(spark):
    w = weights(spark, (0, "A", 0.5), (0, "B", 0.5), (1, "A", 0.5), (2, "A", 0.5), (2, "C", 0.5), (3, "A", 0.5), (3, "C", 0.5))
    assert sorted({r.ts for r in portfolio.drop_unchanged(w).collect()}) == [START, START + DAY, START + 2 * DAY]


def test_no_trade_band_counts_absent_names_as_zero(spark):
    w = weights(spark, (0, "A", 0.05), (0, "B", 0.005), (1, "B", 0.2), (2, "A", 0.051), (2, "B", 0.205), (3, "B", 0.3), (4, "B", 0.3))
    got = sorted((r.symbol, (r.ts - START).days, r.weight) for r in portfolio.no_trade_band(w, 0.01).collect())
    assert [x for x in got if x[0] == "A"] == [("A", 0, 0.05), ("A", 1, 0.0), ("A", 2, 0.051), ("A", 3, 0.0)]
    assert [x[2] for x in got if x[0] == "B"] == [0.0, 0.2, 0.2, 0.3, 0.3]
    small = portfolio.no_trade_band(weights(spark, (0, "A", 0.05), (1, "B", 1.0), (2, "B", 1.0)), 0.06)
    assert {(r.symbol, (r.ts - START).days): r.weight for r in small.collect() if r.symbol == "A"} == {("A", 0): 0.0, ("A", 1): 0.0}


def test_walk_forward_stops_at_the_last_date():
    folds = strategy.walk_forward(1500, step=63)
    assert len(folds) == 9 and folds[-1][1][1] == 1500 and folds[-2][1][1] < 1500
    assert strategy.in_sample_split(10) == ((0, 7), (7, 10))


def test_deflated_sharpe_without_a_value():
    assert all(math.isnan(evaluate.deflated_sharpe(*x)) for x in [(1.0, 2, 0, 0), (30, 50, 3, -1), (1.0, 50, 0, 0, 0)])
    assert 0 < evaluate.deflated_sharpe(1.0, 252, 0.0, 0.0, 10) < evaluate.deflated_sharpe(1.0, 252, 0.0, 0.0) < 1


def test_headline_has_all_fields(spark):
    eq = [(r, START + k * DAY, v, 1.0, v * 0.5) for r, values in (("a", [100, 110, 105, 120]), ("b", [100, 101, 102, 103])) for k, v in enumerate(map(float, values))]
    equity = spark.createDataFrame(eq, "run_id string, ts timestamp, equity double, leverage double, net double")
    trades = spark.createDataFrame([("a", START, 50.0, 1.0, 2.0, 3.0)], "run_id string, ts timestamp, notional double, commission double, spread double, slippage double")
    positions = spark.createDataFrame([("a", START + k * DAY, "X", 1.0) for k in (0, 1, 3)], "run_id string, ts timestamp, symbol string, weight double")
    got = {r.run_id: r for r in evaluate.headline(equity, trades, equity.filter("run_id = 'b'"), positions, trials=3).collect()}
    a, b = got["a"], got["b"]
    assert (a.start, a.end, a.avg_leverage, a.avg_net_exposure, a.trials) == ("2024-01-01", "2024-01-04", 1.0, 0.5, 3)
    assert (a.trade_count, a.total_cost, a.avg_holding_days, a.avg_positions) == (1, 6.0, 1.5, 0.75)
    assert (b.trade_count, b.total_cost, b.cost_ratio, b.avg_loss, b.profit_factor, b.avg_positions) == (0, 0.0, 0.0, 0.0, math.inf, 0.0)
    assert a.worst_month == pytest.approx(0.2) and a.deflated_sharpe is None and a.beta is not None  # three returns have no kurtosis
    short = equity.filter(F.col("ts") < F.lit(START + 3 * DAY))
    assert evaluate.alpha_beta(short, short.filter("run_id = 'b'")).filter("information_ratio is not null").count() == 0
    table = evaluate.year_month_table(equity.select("run_id", "ts", "equity")).filter("run_id = 'a'").first()
    assert table.year == 2024 and table["1"] == pytest.approx(0.2)


def test_adjustments_carry_the_last_good_value(spark):
    rows = [(START + k * DAY, "A", c, adj) for k, (c, adj) in enumerate([(10.0, 9.0), (11.0, -1.0), (12.0, None), (13.0, 13.0)])]
    made = spark.createDataFrame(rows, "ts timestamp, symbol string, close double, adj_close double").withColumn("adj_factor", F.lit(None).cast("double"))
    assert [r.adj_close for r in cleaning.with_adjustments(made).orderBy("ts").collect()] == [9.0, 9.0, 12.0, 13.0]
    assert cleaning.date_range(made, "2024-01-02", "2024-01-03").count() == 2


def test_matrix_round_trip(spark, tmp_path):
    made = cleaning.normalize_bars(raw(spark, n=3))
    bars.feature_matrix(made, "close").write.parquet(str(tmp_path / "m"))
    back = bars.read_matrix(spark, str(tmp_path / "m"), "close")
    assert sorted(map(tuple, back.select("ts", "symbol", "close").collect())) == sorted(map(tuple, made.select("ts", "symbol", "close").collect()))


def test_settings_and_log(tmp_path):
    (tmp_path / "t.toml").write_text('root = "x"\nmin_breadth = 5\n')
    assert settings.load(str(tmp_path / "t.toml"), {"TESSERA_ROOT": "y"}) == settings.Settings(root="y", min_breadth=5)
    (tmp_path / "bad.toml").write_text("nothing = 1\n")
    with pytest.raises(ValueError, match="unknown settings"):
        settings.load(str(tmp_path / "bad.toml"), {})
    log = settings.logger("tessera-test", path=str(tmp_path / "log"))
    log.warning("hello", extra={"fields": {"n": 3}})
    row = json.loads((tmp_path / "log").read_text())
    assert (row["message"], row["level"], row["n"]) == ("hello", "WARNING", 3)
    logging.getLogger("tessera-test").handlers[0].close()


def test_library_specs():
    assert strategy.library_names() == ["momentum", "reversal"]
    assert strategy.library_spec("momentum").universe.top_n == 500
    with pytest.raises(ValueError, match="unknown engine"):
        strategy.Spec("x", (), engine="other")


def test_report_and_panel(spark):
    symbols = [f"S{k:02d}" for k in range(25)]
    held = cleaning.normalize_bars(raw(spark, symbols, 45))
    made = cross_section.panel(features.features(held), 20, 10).cache()
    last = made.orderBy(F.desc("ts")).first()
    assert last.beta_252d is not None and last.cs_rank_ret_21d is not None and last.rel_ret_21d is not None
    scores = signals.get_signal("reversal_5d").compute(made)
    report = signals.report(scores, features.labels(held))
    assert [r.horizon for r in report["summary"].orderBy("horizon").collect()] == ["fwd_ret_1d", "fwd_ret_21d", "fwd_ret_5d"]
    assert report["buckets"].filter("horizon = 'fwd_ret_1d'").count() == 10
    # The one-pass summary agrees with the single measures.
    one = report["by_date"].filter("horizon = 'fwd_ret_1d'")
    auto = signals.autocorrelation(scores, 5).join(one, "ts").filter("abs(autocorr - autocorr_5) > 1e-9 or (autocorr is null) != (autocorr_5 is null)")
    turned = signals.turnover(scores).withColumnRenamed("turnover", "t").join(one, "ts").filter("abs(t - turnover) > 1e-9")
    assert auto.count() == 0 and turned.count() == 0


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "lake")
    raw(spark, [f"S{k:02d}" for k in range(25)], 60).write.parquet(str(tmp_path / "files"))
    run = lambda *a: cli.main(["--root", root, *a])
    run("download", str(tmp_path / "files"), "--symbols", *[f"s{k:02d}" for k in range(25)])
    run("update", str(tmp_path / "files"))
    run("status")
    run("query", "select count(*) as n from bars", "--out", str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).first().n == 1500
    run("quality", "2024-03-10", "--out", str(tmp_path / "q"))
    run("build", str(tmp_path / "panel"))
    capsys.readouterr()
    run("build", str(tmp_path / "panel"))
    assert "up to date" in capsys.readouterr().out
    (tmp_path / "s.toml").write_text('name = "small"\nrebalance = "weekly"\nconstructor = "top_n_equal_weight"\n[[components]]\nsignal = "reversal_5d"\n[construction]\nn = 5\n')
    run("evaluate", "reversal_5d", "--out", str(tmp_path / "ic"), "--panel", str(tmp_path / "panel"))
    run("backtest", str(tmp_path / "s.toml"), "--panel", str(tmp_path / "panel"))
    run_id = capsys.readouterr().out.split()[-1]
    base = Path(root, "runs", "small", run_id)
    assert json.loads((base / "metrics.json").read_text())["bars"] == 60
    run("report", str(base))
    assert "<svg" in (base / "report.html").read_text()
    run("walkforward", str(tmp_path / "s.toml"), "--train", "10", "--test", "12", "--panel", str(tmp_path / "panel"))
    run("oos")
    assert '"touches"' in capsys.readouterr().out
    run("compare", str(base))
    run("strategies")
    assert "momentum" in capsys.readouterr().out
