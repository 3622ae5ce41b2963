import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, portfolio, simulate
from tessera.operators.simulate import Costs, Execution, Risk
from tessera.plans import strategy

FREE = Costs(enabled=False)
CLOSE = Execution(fill_price="close", lag=0, participation_rate=1.0)


def market(spark, closes, start="2024-01-02", **columns):
    """closes: {symbol: prices}; open = high = low = close unless given."""
    rows = []
    for s, prices in closes.items():
        n = len(prices)
        for k, ts in enumerate(pd.bdate_range(start, periods=n)):
            get = lambda name, default: float(columns.get(name, {}).get(s, [default] * n)[k])  # noqa: B023, E731
            if prices[k] is not None:
                p = float(prices[k])
                rows.append((ts.to_pydatetime(), s, get("open", p), get("high", p), get("low", p), p, get("volume", 1e6), get("dividend", 0), get("split_ratio", 0), 0.2, 1e9))
    return spark.createDataFrame(rows, "ts timestamp, symbol string, open double, high double, low double, close double, volume double, dividend double, split_ratio double, vol_20d double, advd_20 double")


def order(spark, weights, at="2024-01-02", run="r"):
    ts = datetime.fromisoformat(at)
    return spark.createDataFrame([(run, ts, s, float(w)) for s, w in weights.items()], "run_id string, ts timestamp, symbol string, weight double")


def equity(result):
    return [r.equity for r in simulate.equity(result).orderBy("ts").collect()]


def test_known_answers(spark):
    flat = market(spark, {"AAA": [100] * 10})
    result = simulate.simulate(flat, order(spark, {"AAA": 1}), CLOSE, FREE)
    assert equity(result) == [1_000_000] * 10
    assert simulate.positions(result).orderBy(F.desc("ts")).first().shares == 10_000
    rising = simulate.simulate(market(spark, {"BBB": range(100, 110)}), order(spark, {"BBB": 1}), Execution(participation_rate=1.0), FREE)
    assert simulate.positions(rising).orderBy(F.desc("ts")).first().shares == 9_900
    assert simulate.equity(rising).orderBy(F.desc("ts")).first().cash == 100
    dividend = simulate.simulate(market(spark, {"AAA": [100] * 10}, dividend={"AAA": [0] * 5 + [2] + [0] * 4}), order(spark, {"AAA": 1}), CLOSE, FREE)
    assert equity(dividend)[-1] == 1_020_000
    split = simulate.simulate(market(spark, {"AAA": [100] * 5 + [50] * 5}, split_ratio={"AAA": [0] * 5 + [2] + [0] * 4}), order(spark, {"AAA": 1}), CLOSE, FREE)
    assert equity(split) == [1_000_000] * 10


def test_interest_on_idle_cash(spark):
    result = simulate.simulate(market(spark, {"AAA": [100] * 10}), order(spark, {"AAA": 0}), CLOSE, Costs(cash_rate_annual=0.05))
    assert equity(result)[-1] == pytest.approx(1e6 * (1 + 0.05 / 252) ** 10)
    assert simulate.trades(result).count() == 0


def test_lag_and_participation(spark):
    flat = market(spark, {"AAA": [100] * 10})
    late = simulate.trades(simulate.simulate(flat, order(spark, {"AAA": 1}), Execution(lag=3, participation_rate=1.0), FREE)).first()
    assert late.ts == datetime(2024, 1, 5)
    thin = market(spark, {"AAA": [100] * 10}, volume={"AAA": [1000] * 10})
    got = simulate.trades(simulate.simulate(thin, order(spark, {"AAA": 1}), Execution(participation_rate=0.1, carry_unfilled=True), FREE)).collect()
    assert max(r.qty for r in got) == 100 and len(got) == 9
    none = market(spark, {"AAA": [100] * 5}, volume={"AAA": [0] * 5})
    assert simulate.trades(simulate.simulate(none, order(spark, {"AAA": 1}), CLOSE, FREE)).count() == 0


def test_delisting_and_cash_limit(spark):
    gone = market(spark, {"AAA": [100] * 5 + [None] * 5, "BBB": [10] * 10})
    result = simulate.simulate(gone, order(spark, {"AAA": 0.5, "BBB": 0.9}), CLOSE, Costs())
    assert min(r.cash for r in simulate.equity(result).collect()) >= 0
    sold = simulate.trades(result).filter("symbol = 'AAA' and side = 'sell'").first()
    assert sold.price == 100 and sold.commission == 0
    row = simulate.check_invariants(result).first()
    assert row.balanced and row.reconciled and row.n_missing == 0


def test_risk_rules(spark):
    fall = market(spark, {"AAA": [100, 100, 100, 90, 90]}, low={"AAA": [100, 100, 100, 80, 90]})
    stopped = simulate.trades(simulate.simulate(fall, order(spark, {"AAA": 1}), CLOSE, FREE, Risk(stop_loss=0.05))).filter("side = 'sell'").first()
    assert stopped.price == 95 and stopped.ts == datetime(2024, 1, 5)
    rise = market(spark, {"AAA": [100, 120, 130]}, high={"AAA": [100, 120, 130]})
    won = simulate.trades(simulate.simulate(rise, order(spark, {"AAA": 1}), CLOSE, FREE, Risk(take_profit=0.1))).filter("side = 'sell'").first()
    assert won.price == pytest.approx(110)
    trail = market(spark, {"AAA": [100, 150, 140]}, low={"AAA": [100, 150, 130]})
    left = simulate.trades(simulate.simulate(trail, order(spark, {"AAA": 1}), CLOSE, FREE, Risk(trailing_stop=0.1))).filter("side = 'sell'").first()
    assert left.price == pytest.approx(135)


def test_costs_agree_between_kernel_and_columns(spark):
    c = Costs(min_commission=1.0, commission_per_share=0.01)
    rows = [(100.0, 50.0, 52.0, 49.0, 50.0, 0.3, 1e6), (-5.0, 10.0, 10.0, 10.0, 10.0, None, 0.0), (0.0, 10.0, 11.0, 9.0, 10.0, 0.2, 1e5)]
    got = simulate.cost_components(spark.createDataFrame(rows, "qty double, price double, high double, low double, close double, sigma double, advd double"), c).collect()
    for r, (qty, price, high, low, close, sigma, advd) in zip(got, rows, strict=True):
        n = np.array([abs(qty) * price])
        want = c.commission(n, np.array([qty])), c.spread(n, np.array([high]), np.array([low]), np.array([close])), c.slippage(n, np.array([math.nan if sigma is None else sigma]), np.array([advd]))
        assert (r.commission, r.spread, r.slippage) == pytest.approx(tuple(float(x[0]) for x in want))


def panel(spark, n=20):
    ts = [datetime(2024, 1, 5), datetime(2024, 1, 12)]
    return spark.createDataFrame([(t, f"S{k:02d}", float(k), k % 7 != 3, 0.1 + 0.02 * k, 1.0, f"g{k % 3}") for t in ts for k in range(n)], "ts timestamp, symbol string, score double, tradable boolean, volatility double, beta double, grp string")


def weights(df):
    return {r.symbol: r.weight for r in df.filter("ts = timestamp'2024-01-05'").collect()}


def test_constructors(spark):
    c = panel(spark)
    top = weights(portfolio.top_n_equal_weight(c, 4))
    assert {s for s, w in top.items() if w} == {"S19", "S18", "S16", "S15"} and sum(top.values()) == pytest.approx(1)
    ls = weights(portfolio.quantile_long_short(c, 5, 1.0, 0.2))
    assert sum(map(abs, ls.values())) == pytest.approx(1) and sum(ls.values()) == pytest.approx(0.2)
    prop = weights(portfolio.score_proportional(c, 0.1))
    assert max(map(abs, prop.values())) <= 0.1 + 1e-12 and sum(map(abs, prop.values())) == pytest.approx(1)
    iv = weights(portfolio.inverse_vol_weighted(c))
    assert sum(map(abs, iv.values())) == pytest.approx(1) and iv["S00"] < iv["S01"] < 0
    with pytest.raises(ValueError):
        portfolio.get_constructor("nope")


def test_constraints(spark):
    c = panel(spark)
    base = portfolio.top_n_equal_weight(c, 8).join(c.select("ts", "symbol", "beta", "grp", "tradable"), ["ts", "symbol"])
    assert sum(weights(portfolio.max_gross(base, 0.5)).values()) == pytest.approx(0.5)
    assert abs(sum(weights(portfolio.max_net(base, 0.1)).values())) == pytest.approx(0.1)
    assert sum(weights(portfolio.max_beta(base, 0.3)).values()) == pytest.approx(0.3)
    assert not any(weights(portfolio.min_positions(base, 9)).values()) and any(weights(portfolio.min_positions(base, 8)).values())
    grouped = portfolio.max_group_weight(base, 0.2).groupBy("ts", "grp").agg(F.sum("weight").alias("w")).collect()
    assert max(r.w for r in grouped) <= 0.2 + 1e-12
    chain = portfolio.build_chain({"max_weight_per_name": 0.1, "max_gross": {"limit": 0.6}, "max_net": None, "tradable_only": True})
    assert sum(weights(chain(base)).values()) == pytest.approx(0.6)
    with pytest.raises(ValueError):
        portfolio.build_chain({"nope": 1})


def test_refill_keeps_gross_within_the_cap():
    w = portfolio.refill(np.array([0.5, 0.3, 0.1, -0.1, 0.0]), 0.3, 1.0)
    assert np.abs(w).max() <= 0.3 + 1e-12 and np.abs(w).sum() == pytest.approx(1) and w[4] == 0 and w[3] < 0
    assert np.abs(portfolio.refill(np.array([0.9, 0.1]), 0.2, 1.0)).sum() == pytest.approx(0.4)


def test_mean_variance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.01, (150, 6))
    cov = portfolio.shrunk_covariance(x)
    assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() > 0
    dates = pd.bdate_range("2023-06-01", periods=150)
    returns = spark.createDataFrame([(d.to_pydatetime(), f"S{k}", float(x[t, k])) for t, d in enumerate(dates) for k in range(6)], "ts timestamp, symbol string, ret_1d double")
    at = dates[-1].to_pydatetime()
    context = spark.createDataFrame([(at, f"S{k}", float(k - 2)) for k in range(6)], "ts timestamp, symbol string, score double")
    got = {r.symbol: r.weight for r in portfolio.mean_variance(context, returns, lookback=100).collect()}
    raw = np.linalg.solve(5 * portfolio.shrunk_covariance(x[-100:]), np.arange(6) - 2.0)
    assert [got[f"S{k}"] for k in range(6)] == pytest.approx(list(raw / np.abs(raw).sum()))


def series(spark, values, symbol="A"):
    return [(ts.to_pydatetime(), symbol, float(v)) for ts, v in zip(pd.bdate_range("2024-01-01", periods=len(values)), values, strict=True)]


def test_schedule(spark):
    kinds = "ts timestamp, symbol string, weight double"
    band = portfolio.no_trade_band(spark.createDataFrame(series(spark, [0.10, 0.101, 0.30]), kinds), 0.01)
    assert [r.weight for r in band.orderBy("ts").collect()] == [0.10, 0.10, 0.30]
    both = spark.createDataFrame(series(spark, [0.5, 0.5]) + series(spark, [0.5, -0.5], "B"), kinds)
    moved = portfolio.limit_turnover(both, 0.5).filter("ts = timestamp'2024-01-01'").agg(F.sum(F.abs("weight"))).first()[0]
    assert moved == pytest.approx(0.5)
    same = portfolio.drop_unchanged(spark.createDataFrame(series(spark, [0.1, 0.1, 0.2]), kinds))
    assert [r.weight for r in same.orderBy("ts").collect()] == [0.1, 0.2]
    days = spark.createDataFrame([(t.to_pydatetime(),) for t in pd.date_range("2024-01-01", "2024-02-07")], "ts timestamp")
    assert [r.ts.day for r in portfolio.rebalance_dates(days, "weekly").orderBy("ts").collect()] == [5, 12, 19, 26, 2, 7]
    assert [r.ts.day for r in portfolio.rebalance_dates(days, "monthly").orderBy("ts").collect()] == [31, 7]


def curve(spark, values, run="r"):
    return spark.createDataFrame([(run, ts.to_pydatetime(), float(v)) for ts, v in zip(pd.bdate_range("2024-01-01", periods=len(values)), values, strict=True)], "run_id string, ts timestamp, equity double")


def test_performance(spark):
    row = evaluate.performance(curve(spark, [100, 110, 121])).first()
    assert row.total_return == pytest.approx(0.21)
    assert evaluate.performance(curve(spark, [100, 120, 60, 90])).first().max_drawdown == -0.5
    assert evaluate.drawdown_duration(curve(spark, [100, 90, 95, 99, 101])).first().drawdown_duration == 3
    up_down = np.cumprod([100, 1.02, 0.99, 1.02, 0.99])
    row = evaluate.performance(curve(spark, up_down)).first()
    assert row.hit_rate == 0.5 and row.profit_factor == pytest.approx(2)
    flat = evaluate.performance(curve(spark, [100, 100, 100])).first()
    assert flat.sharpe == 0 and flat.calmar == 0
    x = 100 * np.exp(np.cumsum(np.random.default_rng(5).normal(0, 0.01, 300)))
    row, r = evaluate.performance(curve(spark, x)).first(), pd.Series(x).pct_change()
    assert (row.skew, row.kurtosis) == pytest.approx((r.skew(), r.kurt()))
    assert evaluate.var_cvar(curve(spark, x)).first().value_at_risk == pytest.approx(r.quantile(0.05))
    assert evaluate.monthly_returns(curve(spark, x)).agg(F.product(1 + F.col("ret"))).first()[0] == pytest.approx(x[-1] / x[0])
    assert 0 < evaluate.deflated_sharpe(1.0, 300, 0.0, 0.0, trials=10) < evaluate.deflated_sharpe(1.0, 300, 0.0, 0.0) < 1
    assert "<svg" in evaluate.tearsheet(curve(spark, x))


def test_beta_against_a_benchmark(spark):
    r = np.random.default_rng(1).normal(0, 0.01, 50)
    a, b = 100 * np.cumprod(1 + 2 * r), 100 * np.cumprod(1 + r)
    row = evaluate.alpha_beta(curve(spark, [100, *a]), curve(spark, [100, *b])).first()
    assert row.beta == pytest.approx(2) and row.alpha == pytest.approx(0, abs=1e-9)


def test_trades_and_holdings(spark):
    c = curve(spark, [100.0, 101.0])
    t = spark.createDataFrame([("r", datetime(2024, 1, 1), 1.0, 1.0, 2.0, 3.0)] * 2, "run_id string, ts timestamp, notional double, commission double, spread double, slippage double")
    row = evaluate.trading_stats(t, c).first()
    assert row.total_cost == 12 and row.annual_turnover == pytest.approx(0.02 * 252 / 2)
    held = spark.createDataFrame([("r", datetime(2024, 1, d), "A", 1.0) for d in (1, 2, 4)], "run_id string, ts timestamp, symbol string, weight double")
    assert evaluate.holding_period(held, curve(spark, [1, 1, 1, 1, 1])).first().avg_holding_days == 1.5


def test_spec_hash_and_errors():
    raw = {"name": "a", "components": [{"signal": "momentum_12_1"}], "execution_lag": 2}
    a, b = strategy.Spec.from_dict(raw), strategy.Spec.from_dict(raw | {"name": "b", "start": "2020-01-01"})
    assert a.spec_hash == b.spec_hash and a.full_hash != b.full_hash and a.execution == {"lag": 2}
    assert a.override("construction", quantiles=3).spec_hash != a.spec_hash
    with pytest.raises(ValueError):
        strategy.Spec.from_dict(raw | {"nope": 1})


def test_walk_forward_and_ledger(tmp_path):
    folds = strategy.walk_forward(1500)
    assert all(test[0] - train[1] == 26 for train, test in folds) and folds[-1][1][1] == 1500
    assert all(train[0] == 0 for train, _ in strategy.walk_forward(1500, anchored=True))
    spec, path = strategy.Spec("a", (strategy.Component("momentum_12_1"),)), str(tmp_path / "ledger.json")
    assert [strategy.record_touch(path, spec, "x", "y") for _ in range(2)] == [1, 2]


def strategy_panel(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(12):
        price = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
        rows += [(ts.to_pydatetime(), f"S{k:02d}", *[float(price[t])] * 4, 1e6, 0.0, 0.0, 0.2, 1e9, float(rng.normal())) for t, ts in enumerate(pd.bdate_range("2024-01-01", periods=60))]
    return spark.createDataFrame(rows, "ts timestamp, symbol string, open double, high double, low double, close double, volume double, dividend double, split_ratio double, vol_20d double, advd_20 double, mom double")


def test_strategy_end_to_end(spark, tmp_path):
    p = strategy_panel(spark)
    spec = strategy.Spec.from_dict({"name": "t", "components": [{"signal": "metric", "parameters": {"metric": "mom"}}], "universe": {"top_n": 10}, "constraints": {"max_weight_per_name": 0.4}})
    result = strategy.run(spec, p, run_id="one")
    row = simulate.check_invariants(result).first()
    assert row.balanced and row.reconciled
    again = strategy.run(spec, p.repartition(5), run_id="one")
    assert equity(result) == pytest.approx(equity(again))
    swept, parameters = strategy.sweep(spec, p, {"half_spread_bps": [0.0, 50.0]}, "costs")
    final = {r.run_id: r.e for r in simulate.equity(swept).groupBy("run_id").agg(F.max_by("equity", "ts").alias("e")).collect()}
    assert len(parameters) == 2 and final["sweep-0000"] > final["sweep-0001"]
    strategy.save_run(result, str(tmp_path), spec, "one")
    assert strategy.load_run(spark, f"{tmp_path}/t/one")["equity"].count() == 60 and strategy.latest_run(str(tmp_path), "t") == "one"
    assert strategy.baselines(spec, p, top=5).count() == 2
    assert strategy.select_universe(p, 3).count() == 3


def test_sweep_plans_grow_neither_with_the_grid_nor_with_the_panel(spark):
    p = strategy_panel(spark)
    deep = p.join(p.select("ts", "symbol"), ["ts", "symbol"]).join(p.select("ts", "symbol"), ["ts", "symbol"])
    spec = strategy.Spec.from_dict({"name": "t", "components": [{"signal": "metric", "parameters": {"metric": "mom"}}], "constraints": {"max_group_weight": 0.2}})
    groups = p.select("symbol", F.substring("symbol", 2, 1).alias("grp")).distinct()
    leaves = lambda result: result._jdf.queryExecution().analyzed().collectLeaves().size()
    for section, name, values in (("costs", "half_spread_bps", [0.0, 20.0, 50.0]), ("construction", "gross", [k / 10 for k in range(1, strategy.BATCH + 2)])):
        one, _ = strategy.sweep(spec, p, {name: values[:1]}, section, groups)
        many, parameters = strategy.sweep(spec, deep, {name: values}, section, groups)
        assert leaves(many) == leaves(one) < 30
        assert [own[name] for own in parameters.values()] == values
        got = many.filter(F.col("run_id").isin(min(parameters), max(parameters))).orderBy("run_id").collect()
        for row, run_id in zip(got, (min(parameters), max(parameters)), strict=True):
            alone = strategy.run(spec.override(section, **parameters[run_id]), p, groups, run_id=run_id).first()
            assert [e.equity for e in row.equity] == pytest.approx([e.equity for e in alone.equity]) and len(row.trades) == len(alone.trades) > 0
    with pytest.raises(ValueError):
        strategy.sweep(spec, p, {"half_spread_bps": []}, "costs")
