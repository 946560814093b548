"""Live candles over many micro-batches: outcomes, state that goes, current candles, and commits that happen once."""

import pytest
from pyspark.sql import functions as F

from candela.errors import CacheConflict
from candela.functions import timeframe
from candela.store import BarStore
from candela.streaming import live
from candela.streaming.klines import commit_batch, commit_counts

HOUR = 3_600_000
KIND = "exchange string, market string, symbol string, timeframe string, open_time long, event_time long, open double, high double, low double, close double, volume double, is_closed boolean, seq long"


def update(symbol, slot, after, close, closed, seq=0):
    return ("okx", "spot", symbol, "1h", slot * HOUR, slot * HOUR + after, 1.0, max(2.0, close), 0.5, close, 3.0, closed, seq)


@pytest.fixture
def fed(spark, tmp_path):
    """A file source of updates; each call adds a file, so that each file is a micro-batch."""
    root = f"{tmp_path}/in"
    number = [0]

    def add(*rows):
        number[0] += 1
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{root}/batch={number[0]:04}")

    stream = lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{root}/batch=*")
    return add, stream, f"{tmp_path}/state", BarStore(spark, f"{tmp_path}/store")


def test_state_is_read_back_across_batches(spark, fed):
    add, stream, state, store = fed
    batches = []
    sink = live.StoreSink(store, "live", on_commit=lambda k, c: batches.append((k, c["new"])))
    add(update("A", 0, 10, 1.1, False), update("B", 0, 10, 1.2, False))
    add(update("A", 0, HOUR, 1.5, True))
    add(update("A", 0, HOUR + 5, 1.5, True), update("A", 1, 10, 1.6, False))
    add(update("A", 0, HOUR + 6, 1.7, True), update("A", 0, HOUR + 7, 1.4, False), update("B", 0, 50, 1.3, False), update("B", 0, 40, 1.0, False))
    live.into_store(stream(), sink, state)
    assert sink.counts == {"upserted": 5, "committed": 1, "duplicate": 1, "conflict": 1, "late_open_ignored": 1}
    assert len(batches) >= 4 and [b for b in batches if b[1]] == [(1, 1)]
    assert [(r.symbol, r.close) for r in store.read_all().collect()] == [("A", 1.5)]
    assert sorted((r.symbol, r.open_time // HOUR, r.close) for r in live.current(spark, state).collect()) == [("A", 1, 1.6), ("B", 0, 1.3)]
    assert [(r.close, r.batch) for r in sink.conflicts().collect()] == [(1.7, 3)]

    add(update("B", 0, HOUR, 1.9, True))  # a new run goes on where the last one stopped
    live.into_store(stream(), live.StoreSink(BarStore(spark, store.path), "live"), state)
    assert sorted((r.symbol, r.close) for r in store.read_all().collect()) == [("A", 1.5), ("B", 1.9)]
    assert [r.symbol for r in live.current(spark, state).collect()] == ["A"]


def test_outcomes_equal_those_of_a_batch(spark, fed):
    add, stream, state, store = fed
    rows = [update(s, k, after, close, closed, 0) for s in "AB" for k in range(4) for after, close, closed in ((10, 1.0, False), (HOUR, 1.5, True), (HOUR + 1, 1.5, True), (HOUR + 2, 1.6, True), (HOUR + 3, 1.1, False))]
    for start in range(0, len(rows), 7):
        add(*rows[start : start + 7])
    sink = live.StoreSink(store, "live")
    live.into_store(stream(), sink, state, delay="30 days", keep_ms=30 * 24 * HOUR)
    want = commit_counts(commit_batch(spark.createDataFrame(rows, KIND).drop("seq")), ["exchange"]).first().asDict()
    assert sink.counts == {k: v for k, v in want.items() if k in live.OUTCOMES and v}


def test_state_of_closed_candles_goes(spark, fed):
    add, stream, state, store = fed
    for k in range(8):
        add(update("A", 3 * k, 10, 1.0, False), update("A", 3 * k, HOUR, 1.5, True))
    live.into_store(stream(), live.StoreSink(store, "live"), state, delay="1 hour", keep_ms=HOUR)
    assert store.read_all().count() == 8 and live.state_of(spark, state).count() <= 2


def test_a_crash_between_data_and_marker(spark, fed, monkeypatch):
    """The job dies when data and manifest are written and the marker isn't; the batch comes again, and no bar is there twice."""
    add, stream, state, store = fed
    add(update("A", 0, HOUR, 1.5, True))
    add(update("A", 1, HOUR, 1.6, True), update("B", 1, HOUR, 1.7, True))
    real = BarStore._mark
    monkeypatch.setattr(BarStore, "_mark", lambda self, version, part: real(self, version, part) if version == 1 else (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        live.into_store(stream(), live.StoreSink(store, "live"), state)
    assert store.read_all().count() == 1 and store.versions() == [1]
    monkeypatch.undo()
    live.into_store(stream(), live.StoreSink(store, "live"), state)
    assert sorted((r.symbol, r.time // HOUR) for r in store.read_all().collect()) == [("A", 0), ("A", 1), ("B", 1)] and store.verify().isEmpty()


def test_a_batch_that_was_written_is_passed_over(spark, fed):
    _, _, _, store = fed
    kind = "exchange string, market string, symbol string, timeframe string, open_time long, event_time long, is_closed boolean, backfilled boolean, open double, high double, low double, close double, volume double, outcome string"
    row = lambda slot, close: ("okx", "spot", "A", "1h", slot * HOUR, 0, True, False, 1.0, 2.0, 0.5, close, 3.0, "committed")
    sink = live.StoreSink(store, "live")
    sink(spark.createDataFrame([row(0, 1.5)], kind), 0)
    sink(spark.createDataFrame([row(1, 1.5)], kind), 1)
    sink(spark.createDataFrame([row(1, 1.75)], kind), 1)  # would be a conflict if it were looked at
    assert store.read_all().count() == 2 and store.token("live") == 1 and store.token("other") is None
    with pytest.raises(CacheConflict):
        live.StoreSink(store, "other")(spark.createDataFrame([row(1, 1.75)], kind), 1)
    store.compact()
    assert store.token("live") == 1
    store.vacuum()
    assert store.token("live") == 1 and store.read_all().count() == 2


def test_a_break_with_backfill_equals_the_whole_stream(spark, fed, tmp_path):
    add, stream, state, store = fed
    rows = [update("A", k, after, close, closed) for k in range(6) for after, close, closed in ((10, 1.0, False), (HOUR, 1.5 + k / 8, True))]
    add(*rows[:4])
    add(*rows[9:])  # candles 2 and 3 and an open update of 4 were missed
    fetched = f"{tmp_path}/fetched"
    spark.createDataFrame([rows[k] for k in (3, 5, 7)], KIND).coalesce(1).write.parquet(f"{fetched}/batch=1")
    backfill = spark.readStream.schema(KIND).parquet(f"{fetched}/batch=*")
    sink = live.StoreSink(store, "live")
    live.into_store(live.updates_with_backfill(stream(), backfill), sink, state, delay="1 day")
    whole = BarStore(spark, f"{tmp_path}/whole")
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/all/batch=1")
    live.into_store(spark.readStream.schema(KIND).parquet(f"{tmp_path}/all/batch=*"), live.StoreSink(whole, "live"), f"{tmp_path}/state2", delay="1 day")
    key = lambda s: sorted((r.time // HOUR, r.close) for r in s.read_all().collect())
    assert key(store) == key(whole) == [(k, 1.5 + k / 8) for k in range(6)]
    assert sink.counts["duplicate"] == 1 and "conflict" not in sink.counts


def test_close_times_of_rows(spark):
    names = ["1m", "1h", "1D", "1W", "1M", "7x"]
    rows = spark.createDataFrame([(n, 90 * 24 * HOUR) for n in names], "name string, ms long").select("name", timeframe.close_time_column(F.col("ms"), F.col("name")).alias("c"), *[timeframe.close_time(F.col("ms"), n).alias(n) for n in names[:-1]])
    for r in rows.collect():
        assert r.c == (None if r.name == "7x" else r[r.name])


def test_an_append_derives_the_days_it_touches(spark, tmp_path):
    from candela.operators.resample import resample
    from candela.plans.derived import changed_bars, derive

    base, days = BarStore(spark, f"{tmp_path}/base"), BarStore(spark, f"{tmp_path}/days")
    bar = lambda symbol, h, close: ("okx", "spot", symbol, "1h", h * HOUR, 1.0, 9.0, 0.5, close, 2.0, (h + 1) * HOUR - 1)
    kind = "exchange string, market string, symbol string, timeframe string, time long, open double, high double, low double, close double, volume double, time_close long"
    frame = lambda *rows: spark.createDataFrame(rows, kind)
    base.write_closed(frame(*[bar(s, h, h / 100 + 1) for s in "AB" for h in range(50)]))
    assert derive(base, days, "1D", source="1h") == {"bars": 100, "buckets": 6}
    assert derive(base, days, "1D", source="1h") == {"bars": 0, "buckets": 0}
    version = base.append_newer(frame(bar("A", 50, 3.0))) and base.versions()[-1]
    assert [(r.symbol, r.time // HOUR) for r in changed_bars(base, version - 1).collect()] == [("A", 50)]
    assert derive(base, days, "1D", source="1h") == {"bars": 1, "buckets": 1}
    base.write_closed(frame(bar("C", 3, 1.5), bar("B", 75, 1.5)))
    assert derive(base, days, "1D", source="1h") == {"bars": 2, "buckets": 2}
    base.merge(frame(bar("B", 0, 2.5)))  # a rewritten series is derived anew
    assert derive(base, days, "1D", source="1h") == {"bars": 51, "buckets": 4}
    want = resample(base.read_all(), "1D", keys=("exchange", "market", "symbol"))
    key = lambda rows: sorted((r.symbol, r.time, r.open, r.high, r.low, r.close, r.volume, r.time_close) for r in rows.collect())
    assert key(days.read_all()) == key(want) and days.verify().isEmpty()
    base.append_newer(frame(bar("A", 51, 3.5)))
    base.vacuum()  # the version that was derived is forgotten, so everything is derived again
    assert derive(base, days, "1D", source="1h")["buckets"] == 8 and key(days.read_all()) == key(resample(base.read_all(), "1D", keys=("exchange", "market", "symbol")))
