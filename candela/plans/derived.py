"""Coarser bars of a store kept up with it: what changed since the last time, and the buckets that this touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.errors import ValidationError
from candela.functions.timeframe import bucket, canonical
from candela.operators.resample import resample
from candela.plans.query import can_derive
from candela.store import PARTITIONS, BarStore

#: A series apart from its timeframe.
SERIES = tuple(k for k in PARTITIONS if k != "timeframe")
VALUES = ("open", "high", "low", "close", "volume")


def changed_series(store: BarStore, since: int | None) -> DataFrame:
    """Series that changed after a version: ``parts`` they had, ``added`` ones, and whether bars of before were ``rewritten``.

    Told by the manifests alone. Where the version is forgotten or none is given, every series counts as new.
    """
    now = store.manifest().select(*PARTITIONS, "parts")
    if since is None or since not in store.versions():
        return now.select(*PARTITIONS, "parts", F.col("parts").alias("added"), F.lit(True).alias("rewritten"))
    before = store.manifest(since).select(*PARTITIONS, F.col("parts").alias("old"))
    joined = now.join(before, list(PARTITIONS), "left").withColumn("old", F.coalesce("old", F.array().cast("array<bigint>")))
    added = F.array_except("parts", "old")
    return joined.select(*PARTITIONS, "parts", added.alias("added"), (F.size(F.array_except("old", "parts")) > 0).alias("rewritten")).where(F.size("added") > 0)


def changed_bars(store: BarStore, since: int | None) -> DataFrame | None:
    """The bars that commits after a version brought: those appended, and of a rewritten series all."""
    series = changed_series(store, since).select(*PARTITIONS, F.col("added").alias("parts"))
    return store.bars_of(series)


def derive(base: BarStore, into: BarStore, timeframe: str, *, source: str) -> dict[str, int]:
    """Bring the ``timeframe`` bars of ``into`` up to the ``source`` timeframe bars of ``base``.

    The last version that was derived stands with the commit. Only the buckets that bars since then touch are made again,
    from all their bars; of a series that was rewritten, all. Returns how many bars changed and how many buckets were made.
    """
    if not can_derive(source, timeframe) and canonical(timeframe) != "1M":
        raise ValidationError(f"{timeframe} isn't made of {source}")
    name, now = f"derive:{canonical(source)}:{canonical(timeframe)}", base.versions()[-1]
    since = into.token(name) if into.versions() else None
    if since == now:
        return {"bars": 0, "buckets": 0}
    series = changed_series(base, since).where(F.col("timeframe") == canonical(source))
    changed = base.bars_of(series.select(*PARTITIONS, F.col("added").alias("parts")))
    if changed is None:
        return {"bars": 0, "buckets": 0}
    at = bucket(F.col("time"), timeframe)
    touched = changed.groupBy(*SERIES, at.alias("bucket")).agg(F.count(F.lit(1)).alias("bars")).persist()
    try:
        sums = touched.agg(F.count(F.lit(1)).alias("buckets"), F.sum("bars").alias("bars"), F.min("bucket").alias("first")).first()
        if not sums["buckets"]:
            return {"bars": 0, "buckets": 0}
        # The bound reaches the scan, so that row groups of before the first touched bucket are skipped.
        whole = base.bars_of(series.select(*PARTITIONS, "parts")).where(F.col("time") >= sums["first"])
        whole = whole.withColumn("bucket", at).join(touched.select(*SERIES, "bucket"), [*SERIES, "bucket"], "left_semi")
        made = resample(whole.select(*SERIES, "time", *VALUES), timeframe, keys=SERIES).withColumn("timeframe", F.lit(canonical(timeframe)))
        into.merge(made, token=(name, now))
        return {"bars": sums["bars"], "buckets": sums["buckets"]}
    finally:
        touched.unpersist()
