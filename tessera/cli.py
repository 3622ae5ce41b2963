"""Command line: python -m tessera.cli COMMAND … over a lake of bars."""

from __future__ import annotations

import argparse
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from tessera import settings
from tessera.operators import catalog, cleaning, cross_section, evaluate, features, signals, simulate
from tessera.plans import ingest, strategy
from tessera.schemas import Partition
from tessera.session import get_session
from tessera.sources import bars, connectors

#: Commands with their arguments; those with -- are optional.
COMMANDS = {
    "download": ["folder", "--symbols", "--symbols-file", "--mode", "--start", "--end", "--form"],
    "update": ["folder", "--form"],
    "status": [], "coverage": [], "refresh-state": [], "quality": ["as_of", "--out"], "universe": ["listing", "--out", "--snapshot"],
    "migrate": ["folder"], "query": ["sql", "--out"], "export": ["out", "--symbols"],
    "features": [], "build": ["out", "--force"], "show": ["path", "--symbol"], "signals": [], "evaluate": ["signal", "--out", "--panel"],
    "strategies": [], "backtest": ["spec", "--panel"], "baselines": ["spec", "--panel"], "sweep": ["spec", "grid", "--section", "--panel"], "walkforward": ["spec", "--train", "--test", "--step", "--panel"], "oos": [],
    "list": [], "report": ["run"], "compare": ["runs"],
}
_MANY, _FLAGS = {"--symbols", "runs"}, {"--force"}


def parser() -> argparse.ArgumentParser:
    own = settings.load()
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--root", default=own.root, help="folder of the lake")
    for name in ("region", "asset_class", "interval"):
        top.add_argument(f"--{name}", default=getattr(own, name))
    sub = top.add_subparsers(dest="command", required=True)
    for command, arguments in COMMANDS.items():
        made = sub.add_parser(command)
        for a in arguments:
            if a in _FLAGS:
                made.add_argument(a, action="store_true")
            else:
                made.add_argument(a, **({"nargs": "*" if a.startswith("--") else "+"} if a in _MANY else {}))
    return top


def _save(df, out: str | None) -> None:
    if not out:
        df.show(50, False)
    else:
        df.write.mode("overwrite").option("header", "true").format("csv" if out.endswith(".csv") else "parquet").save(out)


def _panel(spark, held, path: str | None):
    """The stored panel with the cross-section, or one that is built now; market data beside it."""
    made = spark.read.parquet(path) if path else cross_section.panel(features.features(held))
    return made


def _spec(name: str) -> strategy.Spec:
    return strategy.Spec.from_toml(name) if Path(name).exists() else strategy.library_spec(name)


def _day(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    names = {"features": features.metric_names, "signals": signals.signal_names, "strategies": strategy.library_names}
    if args.command in names:
        print(*names[args.command](), sep="\n")
        return
    runs = f"{args.root}/runs"
    if args.command == "list":
        print(*sorted(str(p.relative_to(runs)) for p in Path(runs).glob("*/*")), sep="\n")
        return
    if args.command == "oos":
        print(json.dumps(strategy.read_ledger(f"{args.root}/oos.json"), indent=2))
        return
    spark, part = get_session(), Partition(args.region, args.asset_class, args.interval)
    if args.command in ("download", "update"):
        source = connectors.FileConnector(spark, args.folder, args.form or "parquet")
        if args.command == "update":
            asked, how = ingest.read_state(spark, args.root).select("symbol").distinct(), {"mode": "incremental"}
        else:
            every = None
            if not args.symbols and not args.symbols_file:
                column = next(c for c in source.raw.columns if c.lower() in ("symbol", "ticker"))
                every = source.raw.select(F.upper(F.trim(F.col(column))).alias("symbol")).distinct()
            asked = every if every is not None else ingest.resolve_symbols(spark, args.symbols, args.symbols_file)
            how = {"mode": args.mode or "auto", "start": _day(args.start), "end": _day(args.end)}
        done = ingest.ingest(spark, args.root, source, asked, part, **how)
        settings.logger().info("ingest", extra={"fields": {k: v for k, v in vars(done).items() if k != "results"}})
        return
    if args.command == "migrate":
        bars.write_bars(bars.migrate_csv(spark, args.folder), args.root, part)
    elif args.command == "status":
        catalog.status(ingest.read_state(spark, args.root)).show(50, False)
    elif args.command == "refresh-state":
        ingest.refresh_state(spark, args.root, settings.load().connector).show(50, False)
    elif args.command == "universe":
        _save(cleaning.classify_universe(cleaning.read_listing(spark, args.listing), snapshot=args.snapshot), args.out)
    elif args.command == "show":
        made = spark.read.parquet(args.path)
        (made.filter(F.col("symbol") == args.symbol) if args.symbol else made).show(50, False)
    elif args.command in ("report", "compare"):
        if args.command == "report":
            run = strategy.load_run(spark, args.run)
            Path(args.run, "report.html").write_text(evaluate.tearsheet(run["equity"]))
        else:
            curves = [strategy.load_run(spark, r)["equity"] for r in args.runs]
            together = curves[0]
            for c in curves[1:]:
                together = together.unionByName(c)
            evaluate.compare(together).show(100, False)
    elif args.command == "query":
        bars.register_views(spark, args.root, state=ingest.read_state(spark, args.root))
        _save(bars.query(spark, args.sql), args.out)
    else:
        _on_bars(spark, args, bars.read_bars(spark, args.root, part), part, runs)


def _on_bars(spark, args, held, part: Partition, runs: str) -> None:
    if args.command == "coverage":
        catalog.coverage(held).show(50, False)
    elif args.command == "quality":
        _save(catalog.quality_report(held, args.as_of), args.out)
    elif args.command == "export":
        _save(bars.read_bars(spark, args.root, part, args.symbols), args.out)
    elif args.command == "build":
        note = Path(f"{args.out.rstrip('/')}.manifest.json")
        newest = str(held.agg(F.max("ts")).first()[0])
        if not args.force and note.exists() and json.loads(note.read_text()).get("end") == newest:
            print("up to date")
            return
        _panel(spark, held, None).write.mode("overwrite").parquet(args.out)
        strategy.write_json(str(note), strategy.manifest(spark.read.parquet(args.out)))
    elif args.command == "evaluate":
        scores = signals.get_signal(args.signal).compute(_panel(spark, held, args.panel))
        made = signals.report(scores, features.labels(held))
        if args.out:
            signals.save_report(made, args.out)
        else:
            made["summary"].show(10, False)
    else:
        _strategies(spark, args, held, runs)


def _strategies(spark, args, held, runs: str) -> None:
    spec, panel = _spec(args.spec), _panel(spark, held, args.panel)
    if args.command == "backtest":
        run_id = strategy.make_run_id(spec.spec_hash)
        strategy.save_run(strategy.run(spec, panel, run_id=run_id), runs, spec, run_id)
        print(run_id)
    elif args.command == "baselines":
        evaluate.compare(simulate.equity(strategy.baselines(spec, panel))).show(10, False)
    elif args.command == "sweep":
        result, parameters = strategy.sweep(spec, panel, json.loads(args.grid), args.section or "construction")
        evaluate.compare(simulate.equity(result)).show(1000, False)
        print(json.dumps(parameters, indent=2))
    elif args.command == "walkforward":
        dates = [r.ts for r in panel.select("ts").distinct().orderBy("ts").collect()]  # one value a date
        sizes = {k: int(v) for k, v in (("train", args.train), ("test", args.test), ("step", args.step)) if v}
        for _, (begin, end) in strategy.walk_forward(len(dates), **sizes):
            own = spec.override(None, start=str(dates[begin]), end=str(dates[end - 1]))
            run_id = f"{strategy.make_run_id(own.full_hash)}-{dates[begin]:%Y%m%d}"
            strategy.save_run(strategy.run(own, panel, run_id=run_id), runs, own, run_id)
            strategy.record_touch(f"{args.root}/oos.json", spec, own.start, own.end)
            print(run_id)


if __name__ == "__main__":
    main()
