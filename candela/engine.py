"""One object with a place of its own for stores and caches: bars, footprints and live candles with given sources behind it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from candela.errors import coded, ContractError, MarketDataError
from candela.plans.provider import archive_cutoff, base_query, fetch_bars, kept_in, Settings, Source
from candela.plans.query import BarQuery, FootprintQuery
from candela.plans.trades import cached_footprint, Footprint, TradeCache, Trades
from candela.sources.cache import SegmentCache
from candela.store import BarStore, FootprintStore, RawStore, SnapshotStore
from candela.streaming.live import into_store, StoreSink


@dataclass(frozen=True)
class StoreResult:
    """How a write ended: what it returned, or the code and message of the rule that stopped it."""

    ok: bool
    value: object = None
    code: str | None = None
    message: str = ""


def attempted(write: Callable[[], object]) -> StoreResult:
    """The result of a write. Errors of the library's own rules are captured; any other error isn't a result and is raised."""
    try:
        return StoreResult(True, write())
    except Exception as failed:
        known = failed if isinstance(failed, MarketDataError | ContractError) else coded(failed)
        if known is None:
            raise
        return StoreResult(False, None, getattr(known, "code", type(known).__name__), str(known))


@dataclass
class Engine:
    """Stores below ``root`` and the sources that complete them: ``rest`` for recent bars, ``archive`` for older ones, ``trades``."""

    spark: SparkSession
    root: str
    rest: Source | None = None
    archive: Source | None = None
    trades: Trades | None = None
    settings: Settings = field(default_factory=Settings)

    @cached_property
    def store(self) -> BarStore:
        return BarStore(self.spark, f"{self.root}/bars")

    @cached_property
    def snapshots(self) -> SnapshotStore:
        return SnapshotStore(self.spark, f"{self.root}/snapshots")

    @cached_property
    def raw(self) -> RawStore:
        return RawStore(self.spark, f"{self.root}/raw")

    @cached_property
    def footprints(self) -> FootprintStore:
        return FootprintStore(self.spark, f"{self.root}/footprints")

    @cached_property
    def trade_cache(self) -> TradeCache:
        return TradeCache(self.spark, f"{self.root}/trades")

    @cached_property
    def segments(self) -> SegmentCache:
        return SegmentCache(self.spark, f"{self.root}/segments")

    def stored(self, query: BarQuery) -> DataFrame | None:
        """What the store holds of the query's timeframe and of the one that it is derived from; None before a first write."""
        if not self.store.versions():
            return None
        own, base = self.store.read(query), base_query(query, self.settings)
        return own if base is None or base.timeframe == query.timeframe else own.unionByName(self.store.read(base))

    def bars(self, query: BarQuery, now_ms: int, *, keep: bool = True) -> DataFrame:
        """Bars of the query from the store, completed by the sources and, unless told otherwise, kept."""
        cutoff = archive_cutoff(now_ms, self.settings.recent_lag_days)
        if self.rest is None:
            raise ContractError("the engine has no source of bars")
        return fetch_bars(query, self.stored(query), self.archive, self.rest, cutoff, settings=self.settings, keep=kept_in(self.store) if keep else None)

    def footprint(self, query: FootprintQuery) -> Footprint:
        """A footprint from cached trades; time that no fetch has covered is asked of the source of trades."""
        if self.trades is None:
            raise ContractError("the engine has no source of trades")
        return cached_footprint(query, self.trade_cache, self.trades)

    def save(self, bars: DataFrame) -> StoreResult:
        """Closed bars into the store, each once; a conflict, an open or a broken bar is a failed result and nothing is written."""
        return attempted(lambda: self.store.write_closed(bars))

    def append(self, bars: DataFrame) -> StoreResult:
        return attempted(lambda: self.store.append_newer(bars))

    def repair(self, source: DataFrame, *, strict: bool = False) -> StoreResult:
        return attempted(lambda: self.store.repair(source, strict=strict))

    def live(self, updates: DataFrame, name: str = "live") -> StoreResult:
        """Run a stream of updates, as far as its source goes, into the store; the value counts what became of them."""
        sink = StoreSink(self.store, name)

        def run() -> dict[str, int]:
            into_store(updates, sink, f"{self.root}/checkpoints/{name}")
            return sink.counts

        return attempted(run)
