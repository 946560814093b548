"""Command line: thin wrappers over the library. Errors go to standard error as JSON with exit code 2; audit issues give 3."""

from __future__ import annotations

import argparse
import json
import sys

from candela.errors import coded, ContractError, MarketDataError


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="candela")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, timeframe: bool = True) -> None:
        one = commands.add_parser(name)
        for option in options:
            one.add_argument(option)
        if timeframe:
            one.add_argument("--timeframe", default="1m")

    add("exchanges", timeframe=False)
    add("market-types", timeframe=False)
    add("validate", "path")
    add("coverage", "path")
    add("export", "path", "target", "kind")
    add("precompute", "path", "target", "to")
    for name in ("manifest", "compact", "vacuum", "current"):
        add(name, "store", timeframe=False)
    add("audit", "store", "source", timeframe=False)
    add("repair", "store", "source", timeframe=False)
    add("repair-logs", "store", timeframe=False)
    add("raw-inspect", "store", timeframe=False)
    add("ws-info", "exchange", "market", "symbol")
    add("checkpoints", "updates", timeframe=False)
    add("stream", "root", "updates", timeframe=False)
    add("fetch", "root", "recorded", "instrument", "start", "end")
    return top


def main(arguments: list[str] | None = None) -> int:
    options = _parser().parse_args(arguments)
    from candela import catalog
    from candela.engine import Engine
    from candela.functions import identity
    from candela.functions.timeframe import Timeframe
    from candela.operators import coverage, merge, quality, resample
    from candela.plans.query import BarQuery, Instrument
    from candela.session import session
    from candela.sources import decode, offline, recorded
    from candela.store import PARTITIONS, BarStore, RawStore
    from candela.streaming import klines

    spark = session("candela-cli")
    show = lambda df: [print(json.dumps(r.asDict(recursive=True), default=str)) for r in df.toLocalIterator()]
    try:
        if options.command == "exchanges":
            show(catalog.exchanges(spark))
        elif options.command == "market-types":
            show(catalog.market_type_aliases(spark).orderBy("market_type", "alias"))
        elif options.command in ("validate", "coverage", "export", "precompute"):
            from pyspark.sql import functions as F

            read = offline.read_bars_parquet if options.path.rstrip("/").endswith(".parquet") else offline.read_bars_csv
            bars = read(spark, options.path, options.timeframe).withColumn("symbol", F.lit("-"))
            if options.command == "validate":
                quality.guard(bars, quality.bar_violations(bars), "invalid bars")
                print(json.dumps({"ok": True, "bars": bars.count()}))
            elif options.command == "coverage":
                show(coverage.adjacent_gaps(bars))
            elif options.command == "export":
                offline.export(bars.drop("symbol"), options.target, options.kind)
            else:
                resample.resample(bars, options.to).drop("symbol").write.parquet(options.target)
        elif options.command == "ws-info":
            from pyspark.sql import functions as F

            one = spark.range(1).select(identity.kline_stream(options.exchange, F.lit(options.market), F.lit(options.symbol), options.timeframe).alias("s"))
            show(one.select("s.*"))
        elif options.command == "raw-inspect":
            show(RawStore(spark, options.store).inspect())
        elif options.command == "checkpoints":
            show(klines.checkpoints(decode.decode_updates(spark.read.text(options.updates))))
        elif options.command == "stream":
            done = Engine(spark, options.root).live(decode.decode_updates(spark.readStream.text(options.updates)))
            print(json.dumps({"ok": done.ok, "outcomes": done.value, "error": done.code, "message": done.message}))
            return 0 if done.ok else 2
        elif options.command == "fetch":
            engine = Engine(spark, options.root, rest=recorded.recorded(spark, options.recorded))
            end = int(options.end)
            show(engine.bars(BarQuery(Instrument.parse(options.instrument), Timeframe.parse(options.timeframe), int(options.start), end), end).orderBy("time"))
        else:
            store = BarStore(spark, options.store)
            if options.command == "manifest":
                show(store.manifest())
            elif options.command == "repair-logs":
                show(store.repairs())
            elif options.command == "current":
                show(store.latest())
            elif options.command == "compact":
                print(json.dumps({"version": store.compact()}))
            elif options.command == "vacuum":
                print(json.dumps({"deleted": list(store.vacuum())}))
            elif options.command == "audit":
                issues = merge.audit(spark.read.parquet(options.source), store.read_all(), keys=[*PARTITIONS, "time"], strict=True)
                show(issues)
                return 0 if issues.isEmpty() else 3
            else:
                print(json.dumps({"version": store.repair(spark.read.parquet(options.source))}))
    except Exception as failed:
        problem = failed if isinstance(failed, MarketDataError | ContractError) else coded(failed)
        if problem is None:
            raise
        print(json.dumps({"error": getattr(problem, "code", type(problem).__name__), "message": str(problem)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
