"""Writers of one store at the same time, and bars that aren't what was written."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest

from candela.errors import CacheConflict, InvalidExchangeResponse
from candela.functions.timeframe import Timeframe
from candela.plans.query import BarQuery, Instrument
from candela.store import BLOCK_MS, BarStore

HOUR = 3_600_000
KIND = "exchange string, market string, symbol string, timeframe string, time long, time_close long, open double, high double, low double, close double, volume double, is_closed boolean"


def _bars(spark, symbol, *times, close=1.5):
    return spark.createDataFrame([("okx", "spot", symbol, "1h", t, t + HOUR - 1, 1.0, 2.0, 0.5, close, 3.0, True) for t in times], KIND).coalesce(1)


def _race(monkeypatch, spark, path, *batches, act=BarStore.write_closed):
    """Each batch by a writer of its own; all have read the store and written their part before the first of them publishes."""
    gate, real = threading.Barrier(len(batches), timeout=120), BarStore._write

    def write(self, rows, part):
        real(self, rows, part)
        if not gate.broken:
            try:
                gate.wait()
                gate.abort()  # later attempts don't wait
            except threading.BrokenBarrierError:
                pass

    monkeypatch.setattr(BarStore, "_write", write)
    with ThreadPoolExecutor(len(batches)) as pool:
        running = [pool.submit(act, BarStore(spark, path), b) for b in batches]
        return [x.exception() or x.result() for x in running]


def test_writers_of_different_series_both_survive(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    BarStore(spark, path).write_closed(_bars(spark, "A", 0))
    found = _race(monkeypatch, spark, path, _bars(spark, "B", 0, HOUR), _bars(spark, "C", 0))
    assert sorted(x["new"] for x in found) == [1, 2]
    store = BarStore(spark, path)
    assert store.versions() == [1, 2, 3] and store.verify().isEmpty()
    assert {r.symbol: r.rows_count for r in store.manifest().collect()} == {"A": 1, "B": 2, "C": 1}
    store.vacuum()
    assert store.read_all().count() == 4 and store.versions() == [3]


def test_writers_of_one_series_compare_again(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    BarStore(spark, path).write_closed(_bars(spark, "A", 0))
    found = _race(monkeypatch, spark, path, _bars(spark, "A", HOUR, 2 * HOUR), _bars(spark, "A", 2 * HOUR, 3 * HOUR))
    assert not [x for x in found if isinstance(x, Exception)], found
    assert sorted((x["new"], x["duplicate"]) for x in found) == [(1, 1), (2, 0)]
    store = BarStore(spark, path)
    assert sorted(r.time // HOUR for r in store.read_all().collect()) == [0, 1, 2, 3] and store.verify().isEmpty()
    monkeypatch.undo()
    found = _race(monkeypatch, spark, path, _bars(spark, "A", 5 * HOUR), _bars(spark, "A", 5 * HOUR, close=1.75))
    assert sum(isinstance(x, CacheConflict) for x in found) == 1, found
    assert store.read_all().count() == 5
    # The part of the writer that gave up stays until it counts as abandoned.
    parts = lambda: len(list((tmp_path / "s/data").glob("commit=*")))
    before = parts()
    store.compact(), store.vacuum(abandoned_ms=10**10)
    kept = parts()
    store.vacuum(abandoned_ms=-(10**6))
    assert before > kept > parts() == 1 and store.read_all().count() == 5 and store.verify().isEmpty()


def test_a_version_that_a_dead_writer_took_is_taken_over(spark, tmp_path, monkeypatch):
    import candela.store

    store = BarStore(spark, f"{tmp_path}/s")
    store.write_closed(_bars(spark, "A", 0))
    (tmp_path / "s/current/2").write_bytes(b"")
    assert store.versions() == [1] and store.read_all().count() == 1
    monkeypatch.setattr(candela.store, "PATIENCE_SECONDS", 0.5)
    assert store.append_newer(_bars(spark, "A", HOUR)) == 1 and store.versions() == [1, 2]


def test_reads_are_checked_against_the_manifest(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/s")
    store.write_closed(_bars(spark, "S", 0, HOUR, BLOCK_MS).unionByName(_bars(spark, "T", 0, HOUR, BLOCK_MS)))
    store.write_closed(_bars(spark, "T", 2 * HOUR))
    query = lambda symbol, start=0, end=3 * HOUR: BarQuery(Instrument("okx", "spot", symbol), Timeframe.parse("1h"), start, end)

    def read(*asked):
        with store.checked(query(*asked)) as bars:
            return sorted(r.time // HOUR for r in bars.collect())

    assert read("S") == [0, 1] and read("T", HOUR) == [1, 2] and read("T", BLOCK_MS, BLOCK_MS + 1) == [BLOCK_MS // HOUR]
    with store.checked(query("S")) as bars:
        assert len(bars.limit(1).collect()) == 1  # an action that stops early is no damage
    with pytest.raises(ZeroDivisionError), store.checked(query("S")):
        1 / 0
    # Another bar in a whole file: the first block of T isn't what was written, its second block and S are.
    (changed,) = (tmp_path / "s/data/commit=1").rglob("symbol=T/**/*.parquet")
    whole, table = changed.read_bytes(), pq.read_table(changed, partitioning=None)
    at = table.schema.get_field_index("close")
    pq.write_table(table.set_column(at, table.schema.field(at), [[1.5, 1.75, 1.5]]), changed)
    changed.with_name(f".{changed.name}.crc").unlink()
    with pytest.raises(InvalidExchangeResponse):
        read("T")
    assert read("S") == [0, 1] and read("T", BLOCK_MS, BLOCK_MS + 1) == [BLOCK_MS // HOUR]
    # A flipped byte in a page: the scan stops, of that series alone.
    bent = bytearray(whole)
    bent[whole.index(b"PAR1") + 60] ^= 255
    changed.write_bytes(bytes(bent))
    with pytest.raises(InvalidExchangeResponse):
        read("T")
    assert read("S") == [0, 1]
