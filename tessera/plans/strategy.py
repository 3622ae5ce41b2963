"""Strategies end to end: specification, universe, targets, backtest, sweeps, walk-forward, ledger."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import subprocess
import sys
import tempfile
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluate, portfolio, signals, simulate
from tessera.session import scratch, stored


@dataclass(frozen=True)
class Component:
    signal: str
    weight: float = 1.0
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Universe:
    symbols: tuple[str, ...] = ()
    top_n: int | None = None
    #: Rank liquidity on data before this day only; by default over the whole window, look-ahead included.
    as_of: str | None = None


ENGINES = ("vectorised", "event")


@dataclass(frozen=True)
class Spec:
    name: str
    components: tuple[Component, ...]
    universe: Universe = Universe()
    combine: str = "rank"
    constructor: str = "quantile_long_short"
    construction: dict = field(default_factory=dict)
    constraints: dict = field(default_factory=dict)
    rebalance: str = "weekly"
    epsilon: float = 0.0
    max_turnover: float | None = None
    execution: dict = field(default_factory=dict)
    costs: dict = field(default_factory=dict)
    risk: dict = field(default_factory=dict)
    start: str | None = None
    end: str | None = None
    #: Both names run the one kernel; unfilled orders and risk rules are settings of it.
    engine: str = "vectorised"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.engine not in ENGINES:
            raise ValueError(f"unknown engine {self.engine!r}; there are {ENGINES}")

    @classmethod
    def from_dict(cls, raw: dict) -> Spec:
        raw = dict(raw)
        known = {f.name for f in fields(cls)} | {"execution_lag", "initial_capital"}
        if unknown := set(raw) - known:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        execution = dict(raw.get("execution", {}))
        if "execution_lag" in raw:
            execution["lag"] = raw.pop("execution_lag")
        if "initial_capital" in raw:
            execution["initial_capital"] = raw.pop("initial_capital")
        raw["execution"] = execution
        raw["components"] = tuple(Component(**c) for c in raw.get("components", ()))
        own = dict(raw.get("universe", {}))
        raw["universe"] = Universe(**own | {"symbols": tuple(own.get("symbols", ()))})
        return cls(**raw)

    @classmethod
    def from_toml(cls, path: str) -> Spec:
        return cls.from_dict(tomllib.loads(Path(path).read_text()))

    def _digest(self, without: tuple[str, ...]) -> str:
        return hashlib.sha256(json.dumps({k: v for k, v in asdict(self).items() if k not in without}, sort_keys=True, default=str).encode()).hexdigest()

    @property
    def spec_hash(self) -> str:
        """What the strategy does, whatever its name and dates."""
        return self._digest(("name", "start", "end"))

    @property
    def full_hash(self) -> str:
        return self._digest(())

    def override(self, section: str | None, **values) -> Spec:
        return replace(self, **{section: {**getattr(self, section), **values}}) if section else replace(self, **values)


def library_names() -> list[str]:
    """The bundled strategies."""
    return sorted(p.stem for p in (Path(__file__).parent / "library").glob("*.toml"))


def library_spec(name: str) -> Spec:
    if name not in library_names():
        raise ValueError(f"unknown strategy {name!r}; there are {library_names()}")
    return Spec.from_toml(str(Path(__file__).parent / "library" / f"{name}.toml"))


def make_run_id(spec_hash: str, now: datetime | None = None) -> str:
    return f"{(now or datetime.now(UTC)):%Y%m%dT%H%M%S}-{spec_hash[:8]}"


def select_universe(panel: DataFrame, n: int, as_of: str | None = None) -> DataFrame:
    """The n names with the highest median dollar volume; ties by symbol."""
    held = panel.filter(F.col("ts") < F.lit(as_of).cast("timestamp")) if as_of else panel
    return held.groupBy("symbol").agg(F.median("advd_20").alias("median_advd")).filter("median_advd is not null").orderBy(F.desc("median_advd"), "symbol").limit(n)


def scores(spec: Spec, panel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    parts = [signals.get_signal(c.signal, **c.parameters) for c in spec.components]
    if len(parts) == 1:
        return parts[0].compute(panel, groups)
    return signals.CompositeSignal(parts, [c.weight for c in spec.components], spec.combine).compute(panel, groups)


def universe_panel(spec: Spec, panel: DataFrame) -> DataFrame:
    own = spec.universe
    if own.symbols:
        panel = panel.filter(F.col("symbol").isin([s.upper() for s in own.symbols]))
    if own.top_n:
        panel = panel.join(F.broadcast(select_universe(panel, own.top_n, own.as_of).select("symbol")), "symbol", "left_semi")  # top_n rows
    return panel


def targets(spec: Spec, panel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Target weights of one strategy on its rebalance dates."""
    panel = universe_panel(spec, panel)
    held = panel.select("ts", "symbol", F.col("vol_20d").alias("volatility"), *([F.col("beta_252d").alias("beta")] if "beta_252d" in panel.columns else []), *([F.col("ret_1d")] if "ret_1d" in panel.columns else []))
    lacking = [name for name, column, have in (("max_beta", "beta_252d", panel.columns), ("max_group_weight", "groups", ["groups"] if groups is not None else [])) if name in spec.constraints and column not in have]
    if lacking:
        raise ValueError(f"no data for the constraints {lacking}: the panel needs beta_252d, or groups must be given")
    context = scores(spec, panel, groups).join(held, ["ts", "symbol"])
    if groups is not None:
        context = context.join(groups, "symbol", "left")
    make = portfolio.get_constructor(spec.constructor, **spec.construction)
    if spec.constructor == "mean_variance":
        solve = make
        make = lambda c: solve(c, context.select("ts", "symbol", "ret_1d"))
    out = portfolio.build_targets(context, make, portfolio.build_chain(spec.constraints) if spec.constraints else None, spec.rebalance, spec.epsilon, spec.max_turnover)
    return _between(out, spec)


def _between(df: DataFrame, spec: Spec) -> DataFrame:
    if spec.start:
        df = df.filter(F.col("ts") >= F.lit(spec.start).cast("timestamp"))
    return df.filter(F.col("ts") <= F.lit(spec.end).cast("timestamp")) if spec.end else df


def _market(spec: Spec, panel: DataFrame) -> DataFrame:
    return _between(panel.select("ts", "symbol", *[c for c in simulate._FIELDS if c in panel.columns]), spec)


def run(spec: Spec, panel: DataFrame, groups: DataFrame | None = None, run_id: str | None = None) -> DataFrame:
    """Backtest of one strategy; see simulate for its result row."""
    own = targets(spec, panel, groups).withColumn("run_id", F.lit(run_id or make_run_id(spec.spec_hash)))
    return simulate.simulate(_market(spec, panel), own, simulate.Execution(**spec.execution), simulate.Costs(**spec.costs), simulate.Risk(**spec.risk))


#: Target plans of a sweep that the driver holds at once.
BATCH = 8


def sweep(spec: Spec, panel: DataFrame, grid: dict[str, list], section: str = "construction", groups: DataFrame | None = None) -> tuple[DataFrame, dict[str, dict]]:
    """Every combination of the grid, simulated as one job: (result rows, parameters by run_id).

    Panel, groups and targets are stored first, as they stand in many places of the plans that follow: the
    driver's plans don't grow with the panel's own plan, nor with the grid.
    """
    names, combinations = list(grid), list(itertools.product(*grid.values()))
    if not combinations:
        raise ValueError(f"a grid without combinations: {grid}")
    parameters = {f"sweep-{k:04d}": dict(zip(names, values, strict=True)) for k, values in enumerate(combinations)}
    engine = section in ("execution", "costs", "risk")
    spark, panel = panel.sparkSession, stored(panel, "sweep-panel")
    groups = stored(groups, "sweep-groups") if groups is not None else None
    if engine:
        runs = spark.createDataFrame([(run_id,) for run_id in parameters], "run_id string")
        together = stored(targets(spec, panel, groups), "sweep-targets").crossJoin(F.broadcast(runs))  # one row a run
    else:
        path = scratch(spark, "sweep-targets")
        for some in itertools.batched(parameters.items(), BATCH):
            parts = [targets(spec.override(section, **own), panel, groups).withColumn("run_id", F.lit(run_id)) for run_id, own in some]
            reduce(DataFrame.unionByName, parts).write.mode("append").parquet(path)
        together = spark.read.schema(parts[0].schema).parquet(path)
    result = simulate.simulate(_market(spec, panel), together, simulate.Execution(**spec.execution), simulate.Costs(**spec.costs), simulate.Risk(**spec.risk), parameters if engine else None)
    return result, parameters


def baselines(spec: Spec, panel: DataFrame, seed: int = 0, top: int = 200) -> DataFrame:
    """Two strategies without skill: the equal weight of (randomly ranked) names, and the same spec on noise."""
    equal = Spec("equal_weight", (Component("random", 1.0, {"seed": seed}),), spec.universe, constructor="top_n_equal_weight", construction={"n": top}, rebalance="monthly", start=spec.start, end=spec.end)
    noise = replace(spec, name="random_signal", components=(Component("random", 1.0, {"seed": seed + 1}),))
    both = targets(equal, panel).withColumn("run_id", F.lit("equal_weight")).unionByName(targets(noise, panel).withColumn("run_id", F.lit("random_signal")))
    return simulate.simulate(_market(spec, panel), both, simulate.Execution(**spec.execution), simulate.Costs(**spec.costs))


def buy_and_hold(panel: DataFrame, symbol: str, execution: simulate.Execution | None = None, costs: simulate.Costs | None = None) -> DataFrame:
    """All capital into one name at its first bar."""
    own = panel.filter(F.col("symbol") == symbol)
    first = own.groupBy("symbol").agg(F.min("ts").alias("ts")).select(F.lit("buy_and_hold").alias("run_id"), "ts", "symbol", F.lit(1.0).alias("weight"))
    return simulate.simulate(own, first, execution, costs)


def walk_forward(n_dates: int, train: int = 756, test: int = 252, step: int | None = None, purge: int = 21, embargo: int = 5, anchored: bool = False) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """((train start, end), (test start, end)) as date numbers, ends excluded; the last test may be short."""
    if min(train, test) <= 0 or purge < 0 or embargo < 0:
        raise ValueError("train and test must be positive, purge and embargo not negative")
    folds, start = [], 0
    while (begin := start + train + purge + embargo) < n_dates:
        folds.append(((0 if anchored else start, start + train), (begin, min(begin + test, n_dates))))
        if begin + test >= n_dates:  # this test reaches the last date
            break
        start += step or test
    return folds


def in_sample_split(n_dates: int, fraction: float = 0.7) -> tuple[tuple[int, int], tuple[int, int]]:
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    cut = int(n_dates * fraction)
    return (0, cut), (cut, n_dates)


# --- artifacts ---------------------------------------------------------------------------------------


def write_json(path: str, value) -> None:
    """Write beside the target, then rename."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False) as out:
        json.dump(value, out, indent=2, sort_keys=True, default=str)
    os.replace(out.name, target)


def provenance() -> dict:
    import pyspark

    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, cwd=Path(__file__).parent).stdout.strip()
    return {"utc": datetime.now(UTC).isoformat(), "commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain")), "python": sys.version.split()[0], "spark": pyspark.__version__}


def save_run(result: DataFrame, root: str, spec: Spec, run_id: str) -> None:
    """Equity, positions and trades as Parquet under strategy and run; spec and provenance as JSON."""
    base = f"{root}/{spec.name}/{run_id}"
    for name, part in (("equity", simulate.equity), ("positions", simulate.positions), ("trades", simulate.trades)):
        part(result).write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    kept = load_run(result.sparkSession, base)
    rows = evaluate.headline(kept["equity"], kept["trades"], positions=kept["positions"]).limit(1).collect()  # one run
    write_json(f"{base}/metrics.json", {k: v for k, v in rows[0].asDict().items() if k != "run_id"} if rows else {})
    write_json(f"{base}/spec.json", asdict(spec) | {"spec_hash": spec.spec_hash, "provenance": provenance()})


def load_run(spark, base: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{base}/{name}.parquet") for name in ("equity", "positions", "trades")}


def latest_run(root: str, strategy: str) -> str | None:
    return max((p.name for p in Path(root, strategy).glob("*") if p.is_dir()), default=None)


def record_touch(path: str, spec: Spec, start: str, end: str) -> int:
    """Note that a strategy has seen an out-of-sample window; returns how often it now has seen any."""
    ledger = read_ledger(path)
    entry = ledger.setdefault(spec.spec_hash, {"name": spec.name, "touches": []})
    entry["touches"].append({"start": start, "end": end, "utc": datetime.now(UTC).isoformat()})
    write_json(path, ledger)
    return len(entry["touches"])


def read_ledger(path: str) -> dict:
    return json.loads(Path(path).read_text()) if Path(path).exists() else {}


def manifest(features: DataFrame) -> dict:
    row = features.agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("ts").alias("start"), F.max("ts").alias("end")).first()
    return row.asDict() | {"metrics": [c for c in features.columns if c not in ("ts", "symbol")], "provenance": provenance()}


