"""Answering a bar query: stored bars first, then missing ranges from sources, then derivation from finer bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.errors import CoverageError
from candela.functions.timeframe import DAY, canonical, milliseconds
from candela.operators.coverage import islands, missing_slots
from candela.operators.merge import overlay_current, prefer_later
from candela.operators.resample import resample
from candela.plans.query import FAILS, BarQuery, FootprintQuery, can_derive, in_range
from candela.store import BarStore, FootprintStore

#: A source gives the bars of one instrument and timeframe in ``[start, end)``.
Source = Callable[[BarQuery], DataFrame]
KEYS = ("exchange", "market", "symbol", "timeframe")


@dataclass(frozen=True)
class Settings:
    base_timeframe: str = "1m"
    recent_lag_days: int = 2
    most_fetches: int = 100
    derive_for: tuple[str, ...] = field(default=("binance",))


def archive_cutoff(now_ms: int, lag_days: int) -> int:
    """Midnight (UTC) so many days before now: archives are complete up to there."""
    return now_ms - now_ms % DAY - lag_days * DAY


def base_query(query: BarQuery, settings: Settings) -> BarQuery | None:
    """The same range in the base timeframe, where the wanted bars can be made from it."""
    from dataclasses import replace

    from candela.functions.timeframe import Timeframe

    base = settings.base_timeframe
    if query.instrument.exchange not in settings.derive_for or canonical(base) == query.timeframe.canonical or not can_derive(base, query.timeframe.canonical):
        return None
    return replace(query, timeframe=Timeframe.parse(base))


def fetch(query: BarQuery, archive: Source | None, rest: Source, cutoff_ms: int) -> DataFrame:
    """Archive bars up to the cutoff and the rest from the other source, which wins where both have a bar."""
    from dataclasses import replace

    parts = []
    if archive is not None and query.start_ms < cutoff_ms:
        parts.append(archive(replace(query, end_ms=min(query.end_ms, cutoff_ms))))
    if archive is None or query.end_ms > cutoff_ms:
        parts.append(rest(query if archive is None else replace(query, start_ms=max(query.start_ms, cutoff_ms))))
    return prefer_later(parts, [*KEYS, "time"])


def _missing(bars: DataFrame, query: BarQuery) -> DataFrame:
    asked = bars.sparkSession.range(1).select(F.lit(query.start_ms).cast("long").alias("start"), F.lit(query.end_ms).cast("long").alias("end"), F.lit(0).alias("k"))
    return missing_slots(bars.withColumn("k", F.lit(0)), asked, query.timeframe.canonical, keys=("k",))


def missing_ranges(known: DataFrame, query: BarQuery, most: int = 100) -> list[tuple[int, int]]:
    """The ranges of the query that no bar covers, each a fetch of its own; one range around all where they are more than ``most``."""
    slots = _missing(known, query).select("k", F.col("start").alias("time"), (F.col("end") - 1).alias("time_close"))
    found = islands(slots, keys=("k",)).orderBy("start").limit(most + 1).collect()
    if len(found) <= most:
        return [(max(r["start"], query.start_ms), min(r["end"], query.end_ms)) for r in found]
    whole = slots.agg(F.min("time").alias("a"), F.max("time_close").alias("b")).first()
    return [(max(whole["a"], query.start_ms), min(whole["b"] + 1, query.end_ms))]


def fetch_bars(
    query: BarQuery, stored: DataFrame | None, archive: Source | None, rest: Source, cutoff_ms: int, *, settings: Settings = Settings(), current: DataFrame | None = None,
    keep: Callable[[DataFrame, BarQuery], DataFrame] | None = None,
) -> DataFrame:
    """Bars of the query. Stored bars answer it if they cover it; else those of the base timeframe are completed and resampled.

    The sources are asked for the missing ranges alone, wherever in the query they are. ``keep`` gets what they gave and the
    base query, may store it (``kept_in``) and returns the base bars as they are then. No bar at all gives an empty result; some but
    not all raise ``CoverageError``. Looking for missing ranges and the guard are the only actions here.
    """
    from dataclasses import replace

    wanted = stored.where(query.predicate()) if stored is not None else None
    if wanted is not None and query.timeframe.duration_ms and _missing(wanted, query).isEmpty():
        return overlay_current(wanted, current, keys=KEYS, start=query.start_ms, end=query.end_ms) if current is not None else wanted
    base = base_query(query, settings) or query
    known = stored.where(base.predicate()) if stored is not None else None
    ranges = [(base.start_ms, base.end_ms)]
    if known is not None and base.timeframe.duration_ms:
        ranges = missing_ranges(known, base, settings.most_fetches)
    parts = [fetch(replace(base, start_ms=a, end_ms=b), archive, rest, cutoff_ms) for a, b in ranges]
    if not parts:
        whole = known
    else:
        fetched = reduce(DataFrame.unionByName, parts)
        if keep is not None:
            whole = keep(fetched, base)
        else:
            whole = fetched if known is None else prefer_later([fetched, known.select(*fetched.columns)], [*KEYS, "time"])
    if base is not query:
        made = resample(whole, query.timeframe.canonical, keys=("exchange", "market", "symbol"), start=query.start_ms).withColumn("timeframe", F.lit(query.timeframe.canonical))
        whole = made.where(F.col("time") < query.end_ms)
    if query.timeframe.duration_ms and not whole.isEmpty():
        hole = _missing(whole, query).limit(1).collect()
        if hole:
            raise CoverageError(f"no bar at {hole[0]['start']}")
    return overlay_current(whole, current.select(*whole.columns), keys=KEYS, start=query.start_ms, end=query.end_ms) if current is not None else whole


def kept_in(store: BarStore) -> Callable[[DataFrame, BarQuery], DataFrame]:
    """Store what was fetched and has closed, stored bars taking precedence, and read the query's bars back.

    What was fetched is written aside once, so that its source is asked once. A candle that ``is_closed`` says is open is laid
    over the result and not stored: the next query asks for it again.
    """

    def keep(fetched: DataFrame, query: BarQuery) -> DataFrame:
        keys = [*KEYS, "time"]
        with store.held(fetched) as held:
            known = store.read(query) if store.versions() else None
            fresh = held if known is None else held.join(known.select(*keys), keys, "left_anti")
            closed = F.coalesce("is_closed", F.lit(True)) if "is_closed" in held.columns else F.lit(True)
            open_ = fresh.where(~closed).orderBy(F.desc("time")).limit(1).collect()  # a series has one open candle at most
            fresh = fresh.where(closed)
            if not fresh.isEmpty():
                store.merge(fresh)
            kind = held.schema
        kept = store.read(query) if store.versions() else store.spark.createDataFrame([], kind)
        if not open_:
            return kept
        return overlay_current(kept, store.spark.createDataFrame(open_, kind).select(*[c if c in kind.names else F.lit(None).alias(c) for c in kept.columns]), keys=KEYS, start=query.start_ms, end=query.end_ms)

    return keep


def footprint_coverage(levels: DataFrame, query: FootprintQuery) -> DataFrame:
    """One row: bars found and missing on the query's grid, ``status`` (empty, gap, valid), and the end of what was delivered."""
    step = milliseconds(query.timeframe.canonical)
    slots = -(-(query.end_ms - query.start_ms) // step)
    found = levels.agg(F.count_distinct("time").alias("bars"), (F.max("time") + step).alias("delivered_end"))
    status = F.when(F.col("bars") == 0, "empty").when(F.col("bars") < slots, "gap").otherwise("valid")
    return found.select("bars", (F.lit(slots) - F.col("bars")).alias("missing"), status.alias("status"), "delivered_end")


def fetch_footprint(query: FootprintQuery, trades: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Footprint levels of the query's trades; by a gap policy that fails every slot must have a bar, so no trade at all is an error too."""
    from candela.operators.footprint import footprint_levels

    inside = in_range(trades, query.start_ms, query.end_ms)
    levels = footprint_levels(inside, query.timeframe.canonical, query.bucket_size, keys=keys, start=query.start_ms)
    if query.gap_policy in FAILS:
        slots = -(-(query.end_ms - query.start_ms) // milliseconds(query.timeframe.canonical))
        counts = levels.groupBy(*keys).agg(F.count_distinct("time").alias("n"))
        least = counts.agg(F.min("n").alias("n")).first()["n"] or 0
        if least < slots:
            raise CoverageError(f"{slots - least} footprint bars are missing")
    return levels


def stored_footprint(query: FootprintQuery, store: FootprintStore, raw: Callable[[int, int], DataFrame]) -> DataFrame:
    """Levels from the store where it has every slot; else from the trades that ``raw`` gives of the range, which are stored then."""
    known = store.read(query) if store.exists() else None
    if known is None or footprint_coverage(known, query).first()["status"] != "valid":
        i = query.instrument
        names = {"exchange": F.lit(i.exchange), "market": F.lit(i.market), "symbol": F.lit(i.symbol), "timeframe": F.lit(query.timeframe.canonical)}
        made = fetch_footprint(query, raw(query.start_ms, query.end_ms).withColumns(names), keys=tuple(names))
        if not made.isEmpty():
            store.write(made)
            known = store.read(query)
        else:
            return made
    return known
