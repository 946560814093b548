"""Fixed cases of the market-data operators."""

import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from candela import catalog, errors
from candela.functions import hashing, identity
from candela.functions.timeframe import Timeframe, canonical, close_time, default_intrabar, epoch_ms, interval_name, micros_to_ms, milliseconds, next_open, parse_time_ms
from candela.operators import coverage, footprint, merge, projections, quality, resample, revisions, symbols
from candela.operators.ordered import with_previous
from candela.plans.query import BarQuery, FootprintQuery, Instrument, can_derive, in_range
from candela.sources import decode, offline
from candela.store import BarStore, SnapshotStore
from candela.streaming import klines

MINUTE = 60_000
BAR = "symbol string, time long, open double, high double, low double, close double, volume double"


def bars(spark, rows, timeframe="1m"):
    return spark.createDataFrame([("S", *r) for r in rows], BAR).withColumn("time_close", close_time(F.col("time"), timeframe))


def ms(text):
    import datetime

    return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.UTC).timestamp() * 1000)


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


# --- timeframes


def test_timeframe_names():
    assert [canonical(x) for x in ("D", "1d", "W", "5M", "M", "1M", "60", "60m", "015", "30S", "2H")] == ["1D", "1D", "1W", "5m", "1M", "1M", "60m", "60m", "15m", "30s", "2h"]
    for bad in ("", "0m", "2d", "x", "-5m", "1.5h"):
        with pytest.raises(errors.TimeframeUnsupported):
            canonical(bad)
    with pytest.raises(errors.TimeframeUnsupported):
        milliseconds("1M")
    with pytest.raises(errors.TimeframeUnsupported):
        Timeframe.parse("1s")
    assert Timeframe.parse("d") == Timeframe.parse("1D") and Timeframe.parse("60") != Timeframe.parse("1h")
    assert [interval_name(x, "binance") for x in ("60", "1D", "M", "1s")] == ["1h", "1d", "1M", "1s"]
    assert [interval_name(x, "bybit") for x in ("1h", "1D", "M")] == ["60", "D", "M"]
    assert [default_intrabar(x) for x in ("1D", "1h", "4h")] == ["60m", "1m", "5m"]
    assert can_derive("1m", "5m") and not can_derive("5m", "1m") and not can_derive("3m", "5m") and not can_derive("1m", "1M")


@pytest.mark.parametrize(
    "start, name, end",
    [("2024-02-29", "1D", "2024-03-01"), ("2024-02-01", "1M", "2024-03-01"), ("2023-12-01", "1M", "2024-01-01"), ("2024-01-03", "1W", "2024-01-08"), ("2024-01-01", "1h", "2024-01-01T01:00")],
)
def test_close_times(spark, start, name, end):
    assert one(spark, close_time(F.col("x"), name), ms(start), "long") == ms(end) - 1
    assert one(spark, next_open(F.col("x"), name), ms(start), "long") == ms(end)


def test_times(spark):
    assert one(spark, epoch_ms(F.col("x")), 1_700_000_000, "long") == 1_700_000_000_000
    assert one(spark, micros_to_ms(F.col("x")), 1_700_000_000_123_456, "long") == 1_700_000_000_123
    for text, want in (("1700000000", 1_700_000_000_000), ("2024-01-01T00:00:00Z", ms("2024-01-01")), ("2024-01-01T02:00:00+02:00", ms("2024-01-01")), ("2024-01-01", ms("2024-01-01")), ("x", None)):
        assert one(spark, parse_time_ms(F.col("x")), text, "string") == want


# --- resampling


def test_thirty_minutes_make_two_quarters(spark):
    source = bars(spark, [(i * MINUTE, float(i), i + 0.75, i - 0.25, i + 0.5, i + 1.0) for i in range(30)])
    found = resample.resample(source, "15m").orderBy("time").collect()
    assert [(r.time, r.open, r.high, r.low, r.close, r.volume) for r in found] == [(0, 0, 14.75, -0.25, 14.5, 120), (900_000, 15, 29.75, 14.75, 29.5, 345)]
    assert resample.resample(source, "15m", start=900_000).count() == 1


def test_untraded_bars_give_no_open(spark):
    source = bars(spark, [(0, 10.0, 10.0, 10.0, 10.0, 0.0), (MINUTE, 8.0, 11.0, 7.0, 9.0, 2.0), (2 * MINUTE, 9.0, 9.0, 9.0, 9.0, 0.0)])
    r = resample.resample(source, "1D").first()
    assert (r.open, r.close, r.high, r.low) == (8, 9, 11, 7)


def test_providers_must_agree(spark):
    source = bars(spark, [(0, 1.0, 1.0, 1.0, 1.0, 1.0), (MINUTE, 1.0, 1.0, 1.0, 1.0, 1.0)]).withColumn("provider", F.when(F.col("time") == 0, "a").otherwise("b"))
    with pytest.raises(Exception, match="MD_VALIDATION_ERROR"):
        resample.resample(source, "1h").collect()


# --- coverage


def test_five_coverages(spark):
    made = lambda times: bars(spark, [(t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in times])
    asked = spark.createDataFrame([("S", 0, 180_000)], "symbol string, start long, end long")
    hole = made([0, 120_000])
    assert [(r.start, r.end) for r in coverage.missing_slots(hole, asked, "1m").collect()] == [(60_000, 120_000)]
    assert [(r.start, r.end) for r in coverage.coalesced_gaps(made([60_000]), asked).orderBy("start").collect()] == [(0, 60_000), (120_000, 180_000)]
    assert coverage.coverage_report(hole, asked, "1m").first().status == "gap"
    assert coverage.coverage_report(made([0, 0]), asked, "1m").first().status == "duplicate"
    numbered = spark.createDataFrame([("S", t, t + 59_999, n) for n, t in enumerate([60_000, 0, 120_000])], "symbol string, time long, time_close long, n long")
    assert coverage.coverage_report(numbered, asked, "1m", ordinal="n").first().status == "unordered"
    whole = made([0, 60_000, 120_000])
    report = coverage.coverage_report(whole, asked, "1m").first()
    assert report.status == "valid" and report.is_complete and report.delivered_end == 180_000
    assert coverage.coverage_report(whole.where("false"), asked, "1m").first().status == "empty"
    assert coverage.contiguity(whole, asked, "1m").first().contiguous and not coverage.contiguity(hole, asked, "1m").first().contiguous
    assert coverage.is_covered(whole, asked, "1m").first().covered and not coverage.is_covered(hole, asked, "1m").first().covered
    assert not coverage.contiguity(whole, asked, "1M").first().contiguous and coverage.is_covered(whole, asked, "1M").first().covered
    assert coverage.missing_slots(hole, asked, "1M").count() == 0
    assert [(r.start, r.end) for r in coverage.islands(hole).orderBy("start").collect()] == [(0, 60_000), (120_000, 180_000)]
    spread = spark.createDataFrame([("S", 0, 10), ("S", 5, 7), ("S", 10, 12), ("S", 20, 30), ("S", 21, 22)], "symbol string, start long, end long")
    assert [(r.start, r.end) for r in coverage.coalesced_intervals(spread).orderBy("start").collect()] == [(0, 12), (20, 30)]
    assert [str(r.day) for r in coverage.touched_days(spark.createDataFrame([("S", 0, 86_400_001)], "symbol string, start long, end long")).orderBy("day").collect()] == ["1970-01-01", "1970-01-02"]


def test_previous_row_across_chunks(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 3, 25, 26, 90)] + [("b", 7)], "k string, t long")
    found = with_previous(rows, ["k"], "t", {"p": F.col("t")}, chunk_ms=10).orderBy("k", "t").collect()
    assert [(r.k, r.t, r.p) for r in found] == [("a", 0, None), ("a", 3, 0), ("a", 25, 3), ("a", 26, 25), ("a", 90, 26), ("b", 7, None)]


# --- footprint


def test_footprint_case(spark):
    trades = spark.createDataFrame([("S", 1, 1000, 100.1, 1.0, False), ("S", 2, 2000, 109.9, 2.0, True), ("S", 3, 3000, 110.0, 3.0, False)], "symbol string, trade_id long, time long, price double, quantity double, buyer_maker boolean")
    levels = footprint.footprint_levels(trades, "1m", 10.0)
    assert [(r.price_low, r.buy_volume, r.sell_volume, r.time_close) for r in levels.orderBy("price_low").collect()] == [(100, 1, 2, 60_000), (110, 3, 0, 60_000)]
    nested = footprint.footprint_bars(levels)
    assert nested.first().trades_count == 3 and footprint.flat(nested).count() == 2
    changed = footprint.footprint_bars(levels.withColumn("buy_count", F.col("buy_count") + 1))
    assert footprint.footprint_checksum(nested).first().checksum != footprint.footprint_checksum(changed).first().checksum


# --- revisions


def chain(spark, steps):
    rows = [("S", 0, n, r, s, "p", f"h{n}" if h is None else h, float(n)) for n, (r, s, h) in enumerate(steps)]
    return spark.createDataFrame(rows, "series string, time long, seq long, revision long, revision_state string, provider string, content_hash string, close double")


@pytest.mark.parametrize(
    "steps, reason, selected, revoked",
    [
        ([(0, "ORIGINAL", None)], None, 0, False),
        ([(0, "ORIGINAL", "a"), (0, "ORIGINAL", "a"), (1, "CORRECTED", None)], None, 1, False),
        ([(0, "ORIGINAL", None), (1, "CORRECTED", None), (2, "REVOKED", None)], None, None, True),
        ([(0, "ORIGINAL", None), (2, "CORRECTED", None), (1, "CORRECTED", None)], "falling_revision", None, False),
        ([(0, "ORIGINAL", None), (1, "REVOKED", None), (2, "CORRECTED", None)], "after_revocation", None, False),
        ([(1, "CORRECTED", None)], "no_original", None, False),
        ([(0, "ORIGINAL", None), (0, "ORIGINAL", None)], "repeated_revision", None, False),
    ],
)
def test_revision_chains(spark, steps, reason, selected, revoked):
    r = revisions.chains(chain(spark, steps)).first()
    assert (r.reason, r.selected_revision, r.revoked) == (reason, selected, revoked)


def _revised(spark, steps, time=0):
    """Revisions of one bar: (number, state, close)."""
    rows = [("b/s/S/1m", "b/s/S", "1m", time, time + 59_999, "1", "9", "1", str(c), "1", "FINAL", s, n, "b", "r1") for n, s, c in steps]
    names = ("series", *[c for c in revisions.CONTENT if c != "superseded_bar_hash"])
    return spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('time', 'time_close', 'revision') else 'string'}" for n in names))


def test_lineage_binds_revisions(spark):
    linked = revisions.with_lineage(_revised(spark, [(0, "ORIGINAL", 1), (1, "CORRECTED", 2), (1, "CORRECTED", 2)]), seq="revision")
    first, second, again = linked.orderBy("revision").collect()
    assert first.superseded_bar_hash is None and second.superseded_bar_hash == first.content_hash and second == again
    assert revisions.verified(linked).count() == 3  # the hash of a link is the hash of the bar's content
    assert revisions.chains(linked, seq="revision").first().reason is None
    torn = linked.withColumn("superseded_bar_hash", F.when(F.col("revision") == 1, "other"))
    assert revisions.chains(torn, seq="revision").first().reason == "broken_lineage"
    with pytest.raises(errors.ValidationError):
        revisions.with_lineage(linked, content=("open", "superseded_bar_hash", "close"))


def test_revisions_become_a_snapshot_in_one_plan(spark, tmp_path, capsys):
    rows = _revised(spark, [(0, "ORIGINAL", 1), (1, "CORRECTED", 2)]).unionByName(_revised(spark, [(0, "ORIGINAL", 3), (1, "REVOKED", 3)], 60_000)).unionByName(_revised(spark, [(0, "ORIGINAL", 4)], 120_000))
    chosen = revisions.resolved_revisions(rows)
    assert [(r.time, r.close) for r in chosen.orderBy("time").collect()] == [(0, "2"), (120_000, "4")]
    chosen.explain("formatted")
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 1
    store = SnapshotStore(spark, f"{tmp_path}/s")
    made = store.write_revisions(rows, start=0, end=180_000).first()
    assert (made.bar_count, made.gap_count, made.complete) == (2, 1, False)
    assert store.read(made.snapshot_id).count() == 2
    again = SnapshotStore(spark, f"{tmp_path}/t").write_revisions(rows.repartition(3), start=0, end=180_000).first()
    assert again.snapshot_id == made.snapshot_id
    other = SnapshotStore(spark, f"{tmp_path}/u").write_revisions(rows.where("close != '1'").unionByName(_revised(spark, [(0, "ORIGINAL", 5)])), start=0, end=180_000).first()
    assert other.snapshot_id != made.snapshot_id  # the original's content counts, though a correction replaces it
    for steps in ([(1, "CORRECTED", 1)], [(0, "ORIGINAL", 1), (1, "REVOKED", 1), (2, "CORRECTED", 2)], [(0, "ORIGINAL", 1), (0, "ORIGINAL", 2)]):
        with pytest.raises(errors.BarConflict), errors.from_jobs():
            revisions.resolved_revisions(_revised(spark, steps)).collect()


def test_a_snapshot_is_made_of_bars_that_are_asked_for_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            asked.add(len(frame))
            yield frame

    rows = _revised(spark, [(0, "ORIGINAL", 1), (1, "CORRECTED", 2)]).unionByName(_revised(spark, [(0, "ORIGINAL", 4)], 60_000))
    made = SnapshotStore(spark, f"{tmp_path}/s").write_revisions(rows.mapInPandas(counted, rows.schema), start=0, end=120_000)
    assert (made.first().bar_count, made.first().complete, asked.value) == (2, True, 3)
    assert made.collect() == SnapshotStore(spark, f"{tmp_path}/s").envelopes().select(*made.columns).collect()
    # A chain is folded once, however many conditions ask for what it comes to.
    plan = revisions.resolved_revisions(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("broken_lineage") == 1


def test_projections(spark):
    bars = spark.createDataFrame(
        [("B", "Spot", "s", "1m", 0, 1.0, 2.0, 0.5, 1.5, None, "1.00", "2", "0.50", "1.5", "0", True, "b", "r1"), ("b", "spot", "S", "1m", 60_000, 1.0, 2.0, 0.5, 1.5, 3.0, "1.00", "2", "0.50", "1.5", "3", None, "b", "r1")],
        "exchange string, market string, symbol string, timeframe string, time long, open double, high double, low double, close double, volume double, open_text string, high_text string, low_text string,"
        " close_text string, volume_text string, is_closed boolean, provider string, provider_revision string",
    )
    contract = projections.contract_bars(bars)
    assert [(r.instrument_id, r.time_close, r.closed, r.volume) for r in contract.orderBy("time").collect()] == [("b/spot/S", 59_999, True, None), ("b/spot/S", 119_999, True, 3)]
    market = projections.market_bars(contract)
    assert [(r.exchange, r.symbol, r.volume, r.is_closed) for r in market.orderBy("time").collect()] == [("b", "S", 0, True), ("b", "S", 3, True)]
    other = projections.market_bars(contract.withColumn("close", F.col("close") + 1))
    assert market.join(other, "provider_revision").count() == 0 and market.join(projections.market_bars(contract.fillna(0.0)), "provider_revision").count() == 2
    timed = bars.withColumn("time_close", F.col("time") + 59_999)
    rows = projections.canonical_rows(timed.where("is_closed"))
    row = rows.first()
    assert (row.series, row.open, row.low, row.finality, row.revision_state, row.revision) == ("b/spot/S/1m", "1", "0.5", "FINAL", "ORIGINAL", 0)
    back = projections.from_canonical(rows).first()
    assert (back.exchange, back.open, back.open_text, back.is_closed, back.provider_revision) == ("b", 1, "1", True, "r1")
    for wrong, kind in ((timed, errors.MissingFinality), (bars.where("is_closed"), errors.ValidationError), (timed.where("is_closed").withColumn("low_text", F.lit("")), errors.ValidationError),
                        (timed.where("is_closed").drop("provider_revision"), errors.ValidationError), (timed.where("is_closed").withColumn("low_text", F.lit("x")), errors.ValidationError)):
        with pytest.raises(kind), errors.from_jobs():
            projections.canonical_rows(wrong).collect()
    query = BarQuery(Instrument("b", "spot", "S"), Timeframe.parse("1m"), 0, 180_000)
    made, report = projections.series(bars, query)
    assert made.count() == 2 and (report.first().status, report.first().missing) == ("gap", 1)
    assert projections.strangers(bars.withColumn("timeframe", F.lit("1")), query).count() == 0
    for name in ("exchange", "symbol", "timeframe"):
        alien = bars.unionByName(bars.limit(1).withColumn(name, F.lit("5m")))
        assert [r.differs for r in projections.strangers(alien, query).collect()] == [name]
        with pytest.raises(errors.ValidationError), errors.from_jobs():
            projections.own_bars(alien, query).collect()


def test_snapshot_hash_depends_on_content_alone(spark):
    rows = spark.createDataFrame([("S", t, t + 59_999, f"h{t}", "FINAL", "r1") for t in (0, 60_000, 180_000)], "series string, time long, time_close long, content_hash string, finality string, provider_revision string")
    seal = lambda df, end=240_000: revisions.seal(df, start=0, end=end).first()
    a, b = seal(rows), seal(rows.repartition(3))
    assert a == b and a.gap_count == 1 and not a.complete and a.bar_count == 3
    assert seal(rows.withColumn("content_hash", F.concat("content_hash", F.lit("x")))).series_hash != a.series_hash
    with pytest.raises(Exception, match="range"):
        seal(rows, 200_000)
    with pytest.raises(Exception, match="overlap"):
        seal(rows.withColumn("time_close", F.col("time_close") + 1), 400_000)


# --- quality and merges


def test_guards(spark):
    bad = bars(spark, [(0, 5.0, 4.0, 1.0, 2.0, 1.0), (MINUTE, 1.0, 2.0, 1.5, 1.0, -1.0), (MINUTE, 1.0, 2.0, 0.5, 1.0, 1.0)])
    assert sorted((r.time, r.rule) for r in quality.bar_violations(bad).collect()) == [(0, "high"), (MINUTE, "duplicate"), (MINUTE, "low"), (MINUTE, "volume")]
    with pytest.raises(errors.ValidationError):
        quality.guard(bad, quality.bar_violations(bad), "bad")
    with pytest.raises(Exception, match="MD_MISSING_FINALITY"):
        quality.exclude_open(bad.withColumn("time_close", F.lit(None).cast("long")), 5).collect()
    with pytest.raises(errors.ValidationError):
        quality.exclude_open(bad, None)
    texts = spark.createDataFrame([("1", "2", "0.5", "1.5", "3"), ("1", "0.9", "0.5", "0.7", "3"), ("x", "2", "1", "1", "1")], "open_text string, high_text string, low_text string, close_text string, volume_text string")
    assert quality.text_violations(texts).count() == 2
    for text, want in (("1.2300", "1.23"), ("-0", "0"), ("100", "100"), ("NaN", None), ("0.0", "0"), ("1E2", "100")):
        assert one(spark, hashing.decimal_text(F.col("x")), text, "string") == want


def test_merges(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "symbol string, time long, open double, high double, low double, close double, volume double")
    source = rows(("S", 0, 1.0, 1.0, 1.0, 1.0, 1.0), ("S", 1, 2.0, 2.0, 2.0, 2.0, None))
    store = rows(("S", 0, 1.0, 1.0, 1.0, 9.0, 1.0), ("S", 2, 3.0, 3.0, 3.0, 3.0, 3.0))
    assert {(r.time, r.kind) for r in merge.audit(source, store, strict=True).collect()} == {(0, "mismatch"), (1, "missing"), (2, "extra")}
    assert merge.audit(source, merge.repaired(source, store)).count() == 0
    assert {r.time for r in merge.repaired(source, store, strict=True).collect()} == {0, 1} and merge.repaired(source, store).count() == 3
    chart = spark.createDataFrame([("S", 30_000, 149_999)], "symbol string, time long, time_close long")
    lower = spark.createDataFrame([("S", t) for t in range(0, 200_000, 30_000)], "symbol string, time long")
    assert sorted(r.time for r in merge.intrabar(chart, lower, "1m").collect()) == [30_000, 60_000, 90_000, 120_000]


# --- symbols


@pytest.mark.parametrize(
    "symbol, exchange, market, want",
    [
        ("binance:btcusdt", None, None, ("binance", "spot", "BTC", "BINANCE:BTCUSDT", False, None)),
        ("BTCUSDT.P", "bybit", None, ("bybit", "linear", "BTC", "BYBIT:BTCUSDT.P", True, None)),
        ("ETHUSD", "BINANCE", "delivery-futures", ("binance", "coinm", "ETH", "BINANCE:ETHUSD.P", True, None)),
        ("BTCUSDT", None, None, (None, "spot", "BTC", None, False, "MD_SYMBOL_AMBIGUOUS")),
        ("FOO:BTCUSDT", None, None, ("foo", "spot", "BTC", "FOO:BTCUSDT", False, "MD_SYMBOL_UNSUPPORTED")),
    ],
)
def test_symbols(spark, symbol, exchange, market, want):
    lit = lambda x: F.lit(x) if x else None
    r = one(spark, identity.normalised_symbol(F.col("x"), lit(exchange), lit(market)), symbol, "string")
    assert (r.exchange, r.market, r.base, r.tv_symbol, r.is_perpetual, r.error) == want


def test_symbol_tables(spark):
    assert one(spark, identity.quote_asset(F.col("x")), "ETHUSD_250101", "string") == "USD"
    assert one(spark, identity.safe_path_part(F.col("x")), " a/b c. ", "string") == "A_B_C" and one(spark, identity.safe_path_part(F.col("x")), "..", "string") == "UNKNOWN"
    assert one(spark, identity.parsed_instrument(F.col("x")), "a/b", "string") is None
    assert catalog.exchanges(spark).count() == 10 and one(spark, catalog.market_type(F.col("x")), " Linear", "string") == "usdt_futures"
    payload = json.dumps({"symbols": [{"symbol": "BTCUSDT", "status": "TRADING", "baseAsset": "BTC", "quoteAsset": "USDT"}, {"symbol": "X", "status": "BREAK", "baseAsset": "X", "quoteAsset": "Y"}]})
    assert [r.symbol for r in symbols.decode_catalogue(spark.createDataFrame([(payload,)], "payload string"), "binance").collect()] == ["BTCUSDT"]
    assert symbols.tradable(spark.createDataFrame([("Trading",), ("Halt",)], "status string")).count() == 1


# --- payloads and files


#: Payloads as exchanges send them: one candle of 2023-11-14T22:13:20Z, opening at 1.5 and closing at 2.50.
CANDLES = {
    "binance": [[1_700_000_000_000, "1.5", "3", "1", "2.50", "10", 1_700_000_059_999, "0", 1, "0", "0", "0"]],
    "bybit": {"retCode": 0, "result": {"category": "spot", "symbol": "BTCUSDT", "list": [["1700000000000", "1.5", "3", "1", "2.50", "10", "20"]]}},
    "okx": {"code": "0", "msg": "", "data": [["1700000000000", "1.5", "3", "1", "2.50", "10", "15", "15", "1"]]},
    "coinbase": [[1_700_000_000, 1, 3, 1.5, "2.50", 10]],
    "kraken": {"error": [], "result": {"last": 1_699_999_940, "XXBTZUSD": [[1_700_000_000, "1.5", "3", "1", "2.50", "2.1", "10", 7]]}},
    "kucoin": {"code": "200000", "data": [["1700000000", "1.5", "2.50", "3", "1", "10", "20"]]},
    "bitget": {"code": "00000", "data": [["1700000000000", "1.5", "3", "1", "2.50", "10", "20", "20"]]},
    "gateio": [["1700000000", "10", "2.50", "3", "1", "1.5", "5", "true"]],
    "htx": {"status": "ok", "data": [{"id": 1_700_000_000, "open": 1.5, "high": 3, "low": 1, "close": "2.50", "amount": 10, "vol": 20, "count": 4}]},
    "mexc": [[1_700_000_000_000, "1.5", "3", "1", "2.50", "10", 1_700_000_060_000, "20"]],
}
CONTRACTS = [
    ("gateio", [{"t": 1_700_000_000, "o": "1.5", "h": "3", "l": "1", "c": "2.50", "v": 10}]), ("gateio", {"data": [{"t": 1_700_000_000, "o": "1.5", "h": "3", "l": "1", "c": "2.50", "v": 10}]}),
    ("gateio", [["1700000000", "10", "2.50", "3", "1", "1.5"]]), ("kraken", {"candles": [{"time": 1_700_000_000_000, "open": "1.5", "high": "3", "low": "1", "close": "2.50", "volume": 10}]}),
    ("kucoin", {"data": [[1_700_000_000_000, 1.5, 3, 1, "2.50", 10]]}), ("kucoin", {"data": [[1_700_000_000, 1.5, 3, 1, "2.50", 10]]}), ("mexc", {"data": [[1_700_000_000_000, 1.5, 3, 1, "2.50", 10]]}),
    ("mexc", {"data": [[1_700_000_000, 1.5, 3, 1, "2.50", 10]]}), ("htx", {"data": [{"id": 1_700_000_000, "open": 1.5, "high": 3, "low": 1, "close": "2.50", "amount": 10}]}),
    ("okx", {"data": [["1700000000000", "1.5", "3", "1", "2.50", "10"]]}), ("bitget", {"data": [["1700000000000", "1.5", "3", "1", "2.50", "10"]]}),
]


def payload(spark, *bodies):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in bodies], "payload string")


@pytest.mark.parametrize(("exchange", "body", "derivative"), [(k, v, False) for k, v in CANDLES.items()] + [(k, v, True) for k, v in CONTRACTS])
def test_candle_layouts(spark, exchange, body, derivative):
    r = decode.decode_klines(payload(spark, body), exchange, "1m", derivative=derivative).first()
    assert (r.time, r.open, r.high, r.low, r.close, r.volume, r.close_text) == (1_700_000_000_000, 1.5, 3, 1, 2.5, 10, "2.50")


@pytest.mark.parametrize(("exchange", "body"), [("okx", {"code": "1"}), ("okx", "no json"), ("bybit", {"result": {}}), ("binance", {"code": -1121}), ("coinbase", [[1]]), ("kucoin", {"data": [["x", 1, 1, 1, 1, 1]]}), ("htx", {"data": [{"id": 1}]})])
def test_malformed_payloads_stop_the_job(spark, exchange, body):
    with pytest.raises(errors.InvalidExchangeResponse), errors.from_jobs():
        decode.decode_klines(payload(spark, body), exchange, "1m").collect()


def test_payloads_without_candles_give_none(spark):
    assert decode.decode_klines(payload(spark, {"data": []}), "okx", "1m").count() == 0
    assert decode.decode_klines(payload(spark, {"result": {"last": 0}}), "kraken", "1m").count() == 0


def test_columnar_payloads(spark):
    body = {"data": {"time": [1_700_000_000, 1_700_000_060_000], "open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1, 2], "vol": [3, 4]}}
    assert [(r.time, r.volume) for r in decode.decode_columnar(payload(spark, body)).collect()] == [(1_700_000_000_000, 3), (1_700_000_060_000, 4)]
    body["data"]["low"] = [1]
    with pytest.raises(errors.InvalidExchangeResponse), errors.from_jobs():
        decode.decode_columnar(payload(spark, body)).collect()


#: A live symbol, one that is barred and one of another kind, as each catalogue writes them.
CATALOGUES = [
    ("bybit", "spot", {"result": {"list": [{"symbol": "BTCUSDT", "status": "Trading", "baseCoin": "BTC", "quoteCoin": "USDT"}, {"symbol": "X", "status": "Closed", "baseCoin": "X", "quoteCoin": "USDT"}]}}, ("BTCUSDT", "BTC", "USDT")),
    ("okx", "spot", {"data": [{"instId": "BTC-USDT", "state": "live", "baseCcy": "BTC", "quoteCcy": "USDT"}, {"instId": "X-USDT", "state": "suspend", "baseCcy": "X", "quoteCcy": "USDT"}]}, ("BTC-USDT", "BTC", "USDT")),
    ("coinbase", "spot", [{"id": "BTC-USD", "base_currency": "BTC", "quote_currency": "USD", "status": "online", "trading_disabled": False}, {"id": "X-USD", "base_currency": "X", "quote_currency": "USD", "trading_disabled": True}], ("BTC-USD", "BTC", "USD")),
    ("kraken", "spot", {"result": {"XXBTZUSD": {"altname": "XBTUSD", "wsname": "XBT/USD", "base": "XXBT", "quote": "ZUSD", "status": "online"}, "Y": {"altname": "YUSD", "base": "Y", "quote": "USD", "status": "cancel_only"}}}, ("XBTUSD", "BTC", "USD")),
    ("bitget", "margin", {"data": [{"symbol": "btcusdt", "baseCoin": "", "quoteCoin": None, "status": "online"}, {"symbol": "XUSDT", "status": "halt"}]}, ("BTCUSDT", "BTC", "USDT")),
    ("htx", "spot", {"data": [{"sc": "btcusdt", "bcdn": "BTC", "qcdn": "USDT", "state": "online"}, {"sc": "x", "bcdn": "X", "qcdn": "USDT", "state": "offline"}]}, ("BTCUSDT", "BTC", "USDT")),
    ("mexc", "spot", {"symbols": [{"symbol": "BTCUSDT", "status": "1", "baseAsset": "BTC", "quoteAsset": "USDT"}, {"symbol": "X", "status": "OFFLINE", "baseAsset": "X", "quoteAsset": "Y"}]}, ("BTCUSDT", "BTC", "USDT")),
    ("okx", "linear", {"data": [{"instId": "BTC-USDT-SWAP", "state": "live", "ctType": "linear", "instFamily": "BTC-USDT", "baseCcy": "", "quoteCcy": "", "settleCcy": "USDT"}, {"instId": "BTC-USD-SWAP", "state": "live", "ctType": "inverse", "instFamily": "BTC-USD"}]}, ("BTC-USDT-SWAP", "BTC", "USDT")),
    ("kraken", "inverse", {"instruments": [{"symbol": "PI_XBTUSD", "type": "futures_inverse", "tradeable": True, "base": "XBT", "quote": "USD"}, {"symbol": "PF_XBTUSD", "type": "flexible_futures", "tradeable": True, "base": "XBT", "quote": "USD"}, {"symbol": "PI_X", "tradeable": False, "base": "X", "quote": "USD"}]}, ("PI_XBTUSD", "BTC", "USD")),
    ("kucoin", "delivery_futures", {"data": [{"symbol": "XBTMZ4", "baseCurrency": "XBT", "quoteCurrency": "USDT", "expireDate": 1_735_000_000_000, "isInverse": False}, {"symbol": "XBTUSDTM", "baseCurrency": "XBT", "quoteCurrency": "USDT", "expireDate": None, "isInverse": False}]}, ("XBTMZ4", "BTC", "USDT")),
    ("bitget", "linear", {"data": [{"symbol": "BTCUSDT", "baseCoin": "BTC", "quoteCoin": "USDT", "status": "normal"}, {"symbol": "X", "baseCoin": "X", "quoteCoin": "USDT", "status": "suspended"}]}, ("BTCUSDT", "BTC", "USDT")),
    ("gateio", "linear", [{"name": "BTC_USDT", "in_delisting": False, "trade_status": "tradable"}, {"name": "X_USDT", "in_delisting": True}], ("BTC_USDT", "BTC", "USDT")),
    ("htx", "linear", {"data": [{"contract_code": "BTC-USDT", "symbol": "BTC", "trade_partition": "USDT", "contract_status": 1}, {"contract_code": "X-USDT", "symbol": "X", "trade_partition": "USDT", "contract_status": "settled"}]}, ("BTC-USDT", "BTC", "USDT")),
    ("mexc", "inverse", {"data": [{"symbol": "BTC_USD", "settleCoin": "BTC", "state": 0, "apiAllowed": True}, {"symbol": "X_USD", "settleCoin": "X", "state": 1}, {"symbol": "BTC_USDT", "settleCoin": "USDT", "state": 0}]}, ("BTC_USD", "BTC", "USD")),
]


@pytest.mark.parametrize(("exchange", "market", "body", "want"), CATALOGUES)
def test_catalogues(spark, exchange, market, body, want):
    found = symbols.decode_catalogue(payload(spark, body), exchange, market=market).collect()
    assert [(r.exchange, r.market, r.symbol, r.base, r.quote) for r in found] == [(exchange, market, *want)]


def test_names_of_exchanges_and_markets(spark):
    assert [one(spark, catalog.market_type(F.col("x")), x, "string") for x in ("cross_margin", "usdt futures", "Dated-Futures", "none")] == ["margin", "usdt_futures", "delivery_futures", None]
    assert [one(spark, catalog.exchange_id(F.col("x")), x, "string") for x in ("Gate_IO", "huobi", "other")] == ["gateio", "htx", "other"]
    assert symbols.tradable(spark.createDataFrame([(None,), ("Cancel_Only",), ("post_only",)], "status string")).count() == 2


def test_live_events(spark):
    binance = {"E": 5, "s": "BTCUSDT", "k": {"s": "BTCUSDT", "i": "1m", "t": 0, "T": 59999, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "10", "n": 3, "x": True}}
    bybit = {"topic": "kline.1.BTCUSDT", "ts": 7, "data": [{"start": 0, "end": 59999, "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "10", "confirm": False}]}
    intervals = [dict(bybit, topic=f"kline.{x}.BTCUSDT") for x in ("60", "240", "D", "5")]
    names = decode.decode_updates(spark.createDataFrame([(json.dumps(x),) for x in intervals], "value string")).collect()
    assert [r.timeframe for r in names] == ["1h", "4h", "1D", "5m"]
    found = decode.decode_updates(spark.createDataFrame([(json.dumps(x),) for x in (binance, bybit)], "value string")).orderBy("exchange").collect()
    assert [(r.exchange, r.symbol, r.timeframe, r.event_time, r.close, r.is_closed) for r in found] == [("binance", "BTCUSDT", "1m", 5, 1.5, True), ("bybit", "BTCUSDT", "1m", 7, 1.5, False)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,open,high,low,close\n0,1,2,0.5,1.5\n60000,1,2,0.5,1.5\n")
    found = offline.read_bars_csv(spark, f"{tmp_path}/a.csv", "1m").orderBy("time").collect()
    assert [(r.time, r.volume, r.time_close) for r in found] == [(0, 0, 59_999), (60_000, 0, 119_999)]
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("k.csv", "open_time,open,high,low,close,volume\n1700000040000000,1,3,1,2,5\n1700000040500000,2,9,0.5,7,5\n1700000100000,7,7,7,7,1\n")
    (tmp_path / "k.zip").write_bytes(content.getvalue())
    found = offline.read_archives(spark, f"{tmp_path}/k.zip", "1m").orderBy("time").collect()
    assert [(r.time, r.open, r.high, r.low, r.close, r.volume) for r in found] == [(1_700_000_040_000, 1, 9, 0.5, 7, 10), (1_700_000_100_000, 7, 7, 7, 7, 1)]
    raw = spark.createDataFrame([("{}", "d1"), ("[]", "d2")], "payload string, day string")
    for _ in range(2):
        offline.write_raw(raw, f"{tmp_path}/raw", partition="day")
    assert offline.read_raw(spark, f"{tmp_path}/raw").where("day = 'd1'").count() == 2
    offline.export(raw, f"{tmp_path}/out", "json")
    with pytest.raises(errors.ValidationError):
        offline.export(raw, f"{tmp_path}/out", "xml")


def test_queries_are_checked():
    i = Instrument(" Binance", "SPOT", "btcusdt")
    assert Instrument.parse(i.serialize()) == i
    with pytest.raises(errors.InvalidInstrument):
        Instrument("a", " ", "c")
    with pytest.raises(errors.InvalidBarQuery):
        BarQuery(i, Timeframe.parse("1m"), 5, 5)
    with pytest.raises(errors.InvalidBarQuery):
        FootprintQuery(i, Timeframe.parse("1M"), 0, 5, 1.0)
    assert FootprintQuery(i, Timeframe.parse("1m"), 0, 5, tick_size=0.5, ticks_per_row=4).bucket_size == 2


def test_range_reaches_the_scan(spark, sf_dir, capsys):
    in_range(spark.read.parquet(f"{sf_dir}/events.parquet"), 1_705_000_000_000, 1_705_100_000_000, stored="ts").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


# --- store


@pytest.mark.parametrize(("field", "value"), [("quote_volume", 2.0), ("trades_count", 9), ("close_text", "1.00"), ("time_close", 1), ("taker_buy_base_volume", None), ("volume", 3.0)])
def test_every_field_of_a_candle_counts(spark, tmp_path, field, value):
    flat = series(spark, [(0, 1.0, 9.0, 1.0, 1.0, 1.0)]).withColumns({"quote_volume": F.lit(1.0), "trades_count": F.lit(1).cast("long"), "close_text": F.lit("1"), "source_kind": F.lit("kline"), "taker_buy_base_volume": F.lit(1.0), "source_transport": F.lit("rest"), "downloaded_at": F.lit(1).cast("long")})
    store = BarStore(spark, f"{tmp_path}/store")
    store.write_closed(flat)
    assert store.write_closed(flat.withColumns({"source_transport": F.lit("archive"), "downloaded_at": F.lit(9).cast("long")})) == {"new": 0, "duplicate": 1}
    with pytest.raises(errors.CacheConflict):
        store.write_closed(flat.withColumn(field, F.lit(value).cast(flat.schema[field].dataType)))


def test_commits_touch_their_series_alone(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/store")
    flat = lambda t, c=1.0: (t, 1.0, 9.0, 1.0, c, 1.0)
    both = series(spark, [flat(0), flat(MINUTE)]).unionByName(series(spark, [flat(0)]).withColumn("symbol", F.lit("T")))
    assert store.latest().count() == 0 and store.verify().count() == 0 and store.get({"symbol": "S"}, 0) is None and store.compact() is None
    store.write_closed(both)
    files = lambda name: {x: x.stat().st_mtime_ns for x in (tmp_path / "store/data").rglob(f"symbol={name}/**/*.parquet")}
    before = files("T")
    store.repair(series(spark, [flat(0, 7.0)]))
    store.append_newer(series(spark, [flat(MINUTE), flat(2 * MINUTE)]))
    assert files("T") == before and store.repairs().first().asDict()["mismatch"] == 1
    assert {(r.symbol, tuple(r.parts), r.rows_count, r.end_time) for r in store.manifest().collect()} == {("S", (2, 3), 3, 2 * MINUTE), ("T", (1,), 1, 0)}
    assert sorted((r.symbol, r.time, r.close) for r in store.read_all().collect()) == [("S", 0, 7), ("S", MINUTE, 1), ("S", 2 * MINUTE, 1), ("T", 0, 1)]
    assert store.verify().count() == 0
    store.compact()
    assert store.verify().count() == 0 and store.manifest().where("symbol = 'S'").first().parts == [4] and files("T") == before
    with pytest.raises(errors.BarConflict):
        store.append_newer(series(spark, [flat(2 * MINUTE, 5.0)]))
    with pytest.raises(errors.ValidationError):
        store.write_closed(series(spark, [flat(9 * MINUTE)]).withColumn("is_closed", F.lit(False)))
    version = store.versions()[-1]
    (tmp_path / f"store/current/{version}").unlink()  # a job that failed before its marker
    assert store.verify().count() == 0
    assert store.append_newer(series(spark, [flat(3 * MINUTE)])) == 1 and store.read_all().where("symbol = 'S'").count() == 4
    lost = next(iter((tmp_path / "store/data/commit=1").rglob("symbol=T/**/*.parquet")))
    lost.unlink()
    assert [r.symbol for r in store.verify().collect()] == ["T"]


def test_append_to_a_long_series(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/store")
    many = spark.range(30_000).select((F.col("id") * MINUTE).alias("time"), *[F.lit(x).alias(n) for n, x in zip(("open", "high", "low", "close", "volume"), (1.0, 9.0, 1.0, 1.0, 1.0), strict=True)])
    names = {"exchange": F.lit("binance"), "market": F.lit("spot"), "symbol": F.lit("S"), "timeframe": F.lit("1m"), "time_close": F.col("time") + MINUTE - 1}
    store.write_closed(many.withColumns(names))
    one_more = many.withColumns(names).limit(1).withColumns({"time": F.lit(30_000 * MINUTE).cast("long"), "time_close": F.lit(30_001 * MINUTE - 1).cast("long")})
    began = time.perf_counter()
    assert store.append_newer(one_more) == 1
    assert time.perf_counter() - began < 15 and store.manifest().first().rows_count == 30_001


def test_snapshots_are_bound(spark, tmp_path):
    bars = series(spark, [(t * MINUTE, 1.0, 9.0, 1.0, 1.0, 1.0) for t in range(3)])
    canonical = revisions.canonical_bars(bars, 3 * MINUTE - 1, provider_revision="r1")
    assert sorted(r.finality for r in canonical.collect()) == ["FINAL"] * 3
    store = SnapshotStore(spark, f"{tmp_path}/snapshots")
    made = store.write(canonical, start=0, end=3 * MINUTE).first()
    assert store.read(made.snapshot_id).count() == 3 and store.latest().first().snapshot_id == made.snapshot_id and made.complete
    again = store.write(canonical.repartition(2), start=0, end=3 * MINUTE).first()
    assert again.snapshot_id == made.snapshot_id and store.envelopes().count() == 1
    with pytest.raises(errors.ValidationError), errors.from_jobs():
        store.write(canonical.withColumn("close", F.lit(2.0)), start=0, end=3 * MINUTE)
    torn = spark.read.parquet(f"{tmp_path}/snapshots/bars").limit(2).toPandas()
    spark.createDataFrame(torn, spark.read.parquet(f"{tmp_path}/snapshots/bars").schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{tmp_path}/snapshots/bars")
    with pytest.raises(errors.ValidationError):
        store.read(made.snapshot_id)
    with pytest.raises(errors.ValidationError):
        store.read("none")


def series(spark, rows):
    return bars(spark, rows).withColumns({"exchange": F.lit("binance"), "market": F.lit("spot"), "timeframe": F.lit("1m")})


def test_different_candles_of_one_time_in_a_batch_conflict(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/store")
    flat = lambda t, c=1.0: (t, 1.0, 9.0, 1.0, c, 1.0)
    with pytest.raises(errors.CacheConflict):
        store.write_closed(series(spark, [flat(0), flat(0, 5.0)]))
    assert store.versions() == []
    named = lambda rows, name: series(spark, rows).withColumn("source", F.lit(name))
    first, second = named([flat(0)], "first"), named([flat(0)], "second")
    assert store.write_closed(first.unionByName(second)) == {"new": 1, "duplicate": 0}
    assert [r.source for r in store.read_all().collect()] == ["first"]
    with pytest.raises(errors.CacheConflict):
        store.write_closed(named([flat(MINUTE), flat(MINUTE, 5.0)], "first"))
    assert store.read_all().count() == 1


def test_store(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/store")
    flat = lambda t, c=1.0: (t, 1.0, 9.0, 1.0, c, 1.0)
    assert store.write_closed(series(spark, [flat(0), flat(MINUTE)])) == {"new": 2, "duplicate": 0}
    assert store.write_closed(series(spark, [flat(MINUTE), flat(2 * MINUTE)])) == {"new": 1, "duplicate": 1}
    with pytest.raises(errors.CacheConflict):
        store.write_closed(series(spark, [flat(0, 5.0)]))
    with pytest.raises(errors.BarConflict):
        store.append_newer(series(spark, [flat(MINUTE)]))
    assert store.append_newer(series(spark, [flat(3 * MINUTE)])) == 1
    query = BarQuery(Instrument("binance", "spot", "S"), Timeframe.parse("1m"), MINUTE, 3 * MINUTE)
    assert sorted(r.time for r in store.read(query).collect()) == [MINUTE, 2 * MINUTE]
    row = store.manifest().first()
    assert (row.rows_count, row.end_time) == (4, 3 * MINUTE)
    store.merge(series(spark, [flat(0, 7.0)]))
    assert store.get({"symbol": "S"}, 0).first().close == 7
    store.repair(series(spark, [flat(0)]), strict=True)
    assert store.read_all().count() == 1
    store.compact()
    assert len(store.vacuum()) == 4 and store.read_all().count() == 1


# --- streams


def updates(spark, rows):
    full = [("binance", "spot", "S", "1m", t, e, 1.0, 2.0, 0.5, c, 1.0, closed) for t, e, c, closed in rows]
    return spark.createDataFrame(full, "exchange string, market string, symbol string, timeframe string, open_time long, event_time long, open double, high double, low double, close double, volume double, is_closed boolean")


CASES = [(0, 1, 1.0, False), (0, 2, 1.5, True), (0, 3, 1.5, True), (0, 4, 1.2, False), (0, 5, 1.7, True), (60_000, 6, 1.0, False)]
OUTCOMES = ["upserted", "committed", "duplicate", "late_open_ignored", "conflict", "upserted"]


def test_commit_states(spark, tmp_path):
    rows = updates(spark, CASES)
    assert [r.outcome for r in klines.commit_batch(rows).orderBy("event_time").collect()] == OUTCOMES
    current = klines.current_candles(rows).collect()
    assert [(r.open_time, r.event_time) for r in current] == [(60_000, 6)]
    queue = klines.coalesce_updates(rows.withColumn("seq", F.col("event_time")))
    assert {(r.open_time, r.close, r.coalesced) for r in queue.collect()} == {(0, 1.7, 4), (60_000, 1.0, 0)}
    assert [r.open_time for r in klines.bounded(queue, 1).collect()] == [60_000]


def test_commit_stream_equals_batch(spark, tmp_path):
    for k, row in enumerate(CASES):
        updates(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(updates(spark, CASES).schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    out = klines.commit_stream(stream)
    query = out.writeStream.format("memory").queryName("outcomes").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.outcome for r in spark.table("outcomes").orderBy("event_time").collect()] == OUTCOMES


def test_each_batch(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    klines.each_batch(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda df, k: seen.append(df.count()), f"{tmp_path}/state")
    assert sum(seen) == 5


def test_reconnect_backfill_queue_and_revision(spark):
    kind = "exchange string, market string, symbol string, timeframe string, open_time long, event_time long, open double, high double, low double, close double, volume double, is_closed boolean, seq long"
    up = lambda t, closed, seq, close=1.0: ("binance", "spot", "S", "1m", t * MINUTE, t * MINUTE + seq, 1.0, 1.0, 1.0, close, 1.0, closed, seq)
    updates = spark.createDataFrame([up(0, False, 1), up(1, False, 2), up(0, True, 3), up(1, True, 4, 5.0)], kind)
    backfill = spark.createDataFrame([up(0, True, 0), up(1, True, 0), up(2, False, 0)], kind).drop("seq")
    found = klines.commit_batch(klines.with_backfill(updates, backfill, 2))
    counts = klines.commit_counts(found).first()
    assert (counts.processed, counts.upserted, counts.committed, counts.duplicate, counts.conflict) == (6, 2, 2, 1, 1)
    queue = klines.coalesce_updates(updates)
    assert [r.open_time for r in klines.dropped(queue, 1).collect()] == [0] and klines.bounded(queue, 1).count() == 1
    revision = updates.select(klines.event_revision(updates).alias("r")).distinct().count()
    named = updates.withColumn("raw_event_id", F.lit("e1"))
    assert revision == 4 and named.select(klines.event_revision(named).alias("r")).distinct().first().r == "e1"
    marked = updates.withColumns({"received_at": F.col("event_time") + 5, "reconnect": F.col("seq") == 3})
    row = klines.checkpoints(marked).first()
    assert (row.last_closed, row.reconnects, row.events, row.status) == (MINUTE, 1, 4, "live")


def test_closes_of_one_event_time_are_told_by_arrival(spark):
    kind = "exchange string, market string, symbol string, timeframe string, open_time long, event_time long, open double, high double, low double, close double, volume double, trades_count long, is_closed boolean, seq long"
    rows = [("binance", "spot", "S", "1m", 0, 5, 1.0, 1.0, 1.0, 1.0, 1.0, n, True, s) for n, s in ((7, 2), (8, 1), (8, 3))]
    found = klines.commit_batch(spark.createDataFrame(rows, kind))
    assert sorted(r.outcome for r in found.collect()) == ["committed", "conflict", "duplicate"]
