"""Stores of bars, snapshots, raw payloads and footprints as partitioned Parquet and text, with manifests."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Thread
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from candela.errors import BarConflict, CacheConflict, InvalidExchangeResponse, ValidationError
from candela.operators.merge import audit_counts, batch_conflicts, classify_bulk, keep_first, manifest, prefer_later, repaired
from candela.operators.quality import bar_violations, guard
from candela.operators.revisions import resolved_revisions, seal, verified
from candela.plans.query import TRADE_KLINE, BarQuery, FootprintQuery

#: A series of a store. Bars without a ``source_kind`` are trade candles.
PARTITIONS = ("exchange", "market", "symbol", "timeframe", "source_kind")
#: What a file's folders tell.
KEYS = [*[StructField(k, StringType()) for k in PARTITIONS], StructField("commit", LongType())]
#: Series of a batch up to which only their own folders are opened to compare it with what is stored; beyond, all folders are listed.
MOST_FOLDERS = 1_000

#: Names of the store's own columns beside a series' identity in its manifest.
FACTS = ("parts", "rows_count", "start_time", "end_time", "last_close", "downloaded_at", "checksum", "blocks")
#: Length of a block: a series is written and checked by blocks of its time.
BLOCK_MS = 30 * 86_400_000
#: A file that claims a version and is still empty after so long was left by a writer that died.
PATIENCE_SECONDS = 60.0
#: How jobs fail.
FAILED = (PySparkException, Py4JJavaError)
T = TypeVar("T")


class _Overtaken(Exception):
    """Another writer changed what this one has read."""


@dataclass
class BarStore:
    """Bars below ``path``: one folder of data per commit and series, and a manifest per commit with a row per series.

    A series' row says in which commits its bars lie, and what they come to. An append adds a commit to the row, a rewrite
    replaces its commits by one; the files of other series aren't touched, and nothing is overwritten that a plan may read.
    Readers see the old or the new state.

    Writers may race. Each writes into a part of its own, whose number it has claimed, and publishes by creating the marker of
    the next version, which one of them can. The others take the new manifest as their base: where it leaves their series as
    they read them, the part is published on it as it is; else they compare and write anew. The file system must create a file
    for one of several callers only, as HDFS does.

    Beside each manifest stands the state that came with it: the columns of the store, which a later batch may add to, and
    for each ``token`` name the number that its last commit carried, by which a batch that comes again is recognised.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, at = self._fs()
        root = at(f"{self.path}/current")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(root) if x.getLen() > 0) if fs.exists(root) else []

    def _text(self, name: str) -> str:
        fs, at = self._fs()
        stream = fs.open(at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str, *, overwrite: bool) -> bool:
        """Write a small file; without ``overwrite``, whether it was this caller who created it. Hadoop's local file system looks
        and creates in two steps, so there the operating system is asked."""
        fs, at = self._fs()
        place = at(f"{self.path}/{name}")
        if not overwrite and fs.getScheme() == "file":
            fs.mkdirs(place.getParent())
            try:
                with open(place.toUri().getPath(), "x") as file:
                    file.write(text)
            except FileExistsError:
                return False
            return True
        try:
            stream = fs.create(place, overwrite)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _part(self, version: int) -> int:
        """The part by whose number the manifest and state of a version are named."""
        return int(self._text(f"current/{version}"))

    def _claimed(self) -> int:
        """The number of a new part, which no other writer gets."""
        fs, at = self._fs()
        root = at(f"{self.path}/claims")
        part = max([int(x.getPath().getName()) for x in fs.listStatus(root)] if fs.exists(root) else [0], default=0) + 1
        while not self._create(f"claims/{part}", "", overwrite=False):
            part += 1
        return part

    def manifest(self, version: int | None = None) -> DataFrame:
        """The current manifest, a row per series; of an empty store an empty one."""
        known = self.versions()
        kind = ", ".join(f"{k} string" for k in PARTITIONS) + ", parts array<long>, rows_count long, start_time long, end_time long, last_close double, downloaded_at long, checksum decimal(38,0), blocks array<struct<block:long,n:long,checksum:decimal(38,0)>>"
        version = (known or [0])[-1] if version is None else version
        if not version:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.path}/manifest/{self._part(version)}")

    def read_all(self) -> DataFrame | None:
        """Every bar: those files that the manifest names, told from replaced ones by commit and series."""
        known = self.versions()
        if not known:
            return None
        rows = self._files().parquet(f"{self.path}/data")
        live = self.manifest().select(*PARTITIONS, F.explode("parts").alias("commit"))
        return rows.join(live, ["commit", *PARTITIONS], "left_semi").drop("commit")

    def _state(self) -> dict:
        """What came with the current commit: ``schema`` and ``tokens``."""
        known = self.versions()
        return json.loads(self._text(f"state/{self._part(known[-1])}.json")) if known else {"schema": None, "tokens": {}}

    def _files(self) -> DataFrameReader:
        """A reader of the store's files, which compares each page with the checksum that stands in its head."""
        return self.spark.read.schema(self._schema()).option("basePath", f"{self.path}/data").option("parquet.page.verify-checksum.enabled", True)

    def _schema(self) -> StructType:
        """All columns that a commit has brought so far; earlier files read as null where they lack one."""
        return StructType.fromJson(self._state()["schema"])

    def token(self, name: str) -> int | None:
        """The number that the last commit of this name carried."""
        return self._state()["tokens"].get(name)

    def _came(self, token: tuple[str, int] | None) -> bool:
        """Whether a commit has carried this number, or a higher one, of its name."""
        last = None if token is None else self.token(token[0])
        return last is not None and last >= token[1]

    @contextmanager
    def held(self, rows: DataFrame, *, place: str | None = None) -> Iterator[DataFrame]:
        """The rows, written aside once: guards and commit then see the same rows, and their source is asked once. ``place``
        names a column for the order in which they came, which files don't keep."""
        fs, at = self._fs()
        path = f"{self.path}/incoming/{uuid.uuid4().hex}"
        if "source_kind" in rows.columns:
            rows = rows.withColumn("source_kind", F.coalesce("source_kind", F.lit(TRADE_KLINE)))
        else:
            rows = rows.withColumn("source_kind", F.lit(TRADE_KLINE))
        known = {f.name: f.dataType for f in self._schema()} if self.versions() else {}
        for f in rows.schema:
            if known.get(f.name, f.dataType) != f.dataType:
                raise ValidationError(f"{f.name} is {f.dataType.simpleString()}, the store has {known[f.name].simpleString()}")
        rows = rows.withColumn(place, F.monotonically_increasing_id()) if place else rows
        rows.write.parquet(path)
        try:
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            fs.delete(at(path), True)

    def _folders(self, rows: Sequence) -> DataFrame | None:
        """The bars of these rows of the manifest, from their own folders; no other folder is listed."""
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        paths = [f"{self.path}/data/commit={p}/" + "/".join(f"{k}={escape(r[k])}" for k in PARTITIONS) for r in rows for p in r["parts"]]
        return self._files().parquet(*paths).drop("commit") if paths else None

    def bars_of(self, series: DataFrame) -> DataFrame | None:
        """The bars of some series in some commits, as rows like the manifest's say; from their own folders, if they are few."""
        own = series.select(*PARTITIONS, "parts").limit(MOST_FOLDERS + 1).collect()
        if len(own) <= MOST_FOLDERS:
            return self._folders(own)
        rows = self._files().parquet(f"{self.path}/data")
        return rows.join(series.select(*PARTITIONS, F.explode("parts").alias("commit")), ["commit", *PARTITIONS], "left_semi").drop("commit")

    def _series(self, series: dict[str, str]) -> DataFrame | None:
        """The bars of one series, read from its own folders alone; of several, where not every key is given."""
        if set(series) | {"source_kind"} == set(PARTITIONS):
            series = {"source_kind": TRADE_KLINE} | series
        rows = self.manifest()
        for name, value in series.items():
            rows = rows.where(F.col(name) == value)
        if set(series) == set(PARTITIONS):
            return self._folders(rows.collect())  # one row at most
        every = self.read_all()
        for name, value in series.items():
            every = every if every is None else every.where(F.col(name) == value)
        return every

    def read(self, query: BarQuery) -> DataFrame:
        if not self.versions():
            raise ValidationError("the store is empty")
        i = query.instrument
        rows = self._series({"exchange": i.exchange, "market": i.market, "symbol": i.symbol, "timeframe": query.timeframe.canonical, "source_kind": query.source_kind})
        return (self.read_all().where("false") if rows is None else rows).where(query.predicate())

    @contextmanager
    def checked(self, query: BarQuery) -> Iterator[DataFrame]:
        """The bars of a query, for one action that reads them all; on leaving, they are compared with the manifest.

        The blocks that the range touches are counted and summed by the scan that reads them, so there is no second pass. Where
        that doesn't agree, or the action failed, stopped early or was none, the series' blocks are read once more to decide, and
        ``MD_INVALID_EXCHANGE_RESPONSE`` is raised if they aren't what was written. Other series aren't looked at.
        """
        i = query.instrument
        own = {"exchange": i.exchange, "market": i.market, "symbol": i.symbol, "timeframe": query.timeframe.canonical, "source_kind": query.source_kind}
        rows = self.manifest()
        for name, value in own.items():
            rows = rows.where(F.col(name) == value)
        known = rows.collect()  # one row at most
        found = self._folders(known)
        if found is None:
            raise ValidationError(f"the store has no {i.serialize()}/{query.timeframe.canonical}")
        first, last = query.start_ms // BLOCK_MS, (query.end_ms - 1) // BLOCK_MS
        blocks = [b for r in known for b in r["blocks"] if first <= b["block"] <= last]
        want = (sum(b["n"] for b in blocks), sum(int(b["checksum"]) for b in blocks))
        whole = found.where((F.col("time") >= first * BLOCK_MS) & (F.col("time") < (last + 1) * BLOCK_MS))
        sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(self._row_sum(whole.columns)), F.lit(0)).cast("decimal(38,0)").alias("h")]
        seen, torn = Observation(), InvalidExchangeResponse(f"{i.serialize()}/{query.timeframe.canonical} isn't what was written")

        def agrees() -> bool:
            r = whole.agg(*sums).first()
            return (r["n"], int(r["h"])) == want

        try:
            yield whole.observe(seen, *sums).where(query.predicate())
        except FAILED as error:
            try:
                good = agrees()
            except FAILED:
                good = False
            if good:
                raise
            raise torn from error
        got: list = []
        waiting = Thread(target=lambda: got.append(seen.get), daemon=True)
        waiting.start()
        waiting.join(10)
        if not got or (got[0]["n"], int(got[0]["h"])) != want:
            try:
                good = agrees()
            except FAILED as error:
                raise torn from error
            if not good:
                raise torn

    def get(self, series: dict[str, str], time: int) -> DataFrame | None:
        rows = self._series(series)
        return None if rows is None else rows.where(F.col("time") == time).limit(1)

    def _write(self, rows: DataFrame, commit: int) -> None:
        # Rows of a series lie in time order, so that row groups can be skipped by range; a large series is split by block.
        # A part's folder is the root of its own job: jobs below one root clear each other's unfinished files.
        placed = rows.repartition(*PARTITIONS, F.floor(F.col("time") / BLOCK_MS)).sortWithinPartitions(*PARTITIONS, "time")
        placed.write.mode("append").partitionBy(*PARTITIONS).parquet(f"{self.path}/data/commit={commit}")

    @staticmethod
    def _row_sum(columns: Sequence[str]) -> Column:
        """What a row adds to a checksum. Columns that a row lacks, as all rows do before a later commit brings them, add nothing."""
        own = sorted(c for c in columns if c not in PARTITIONS)
        return F.xxhash64("time", *[F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c)) for c in own]).cast("decimal(38,0)")

    def _facts(self, rows: DataFrame, commit: int) -> DataFrame:
        """Manifest rows of what a commit wrote. Checksums are sums over rows, so that appends add to them."""
        made = manifest(rows if "downloaded_at" in rows.columns else rows.withColumn("downloaded_at", F.lit(0).cast("long")), keys=PARTITIONS)
        total = lambda column: F.sum(column).cast("decimal(38,0)").alias("checksum")
        blocks = rows.groupBy(*PARTITIONS, F.floor(F.col("time") / BLOCK_MS).alias("block")).agg(F.count(F.lit(1)).alias("n"), total(self._row_sum(rows.columns)))
        sums = blocks.groupBy(*PARTITIONS).agg(total("checksum"), F.array_sort(F.collect_list(F.struct("block", "n", "checksum"))).alias("blocks"))
        return made.join(sums, list(PARTITIONS)).withColumn("parts", F.array(F.lit(commit).cast("long"))).select(*PARTITIONS, *FACTS)

    def _commit(self, rows: DataFrame, *, since: int, append: bool, alone: bool = False, token: tuple[str, int] | None = None) -> int:
        """Write bars as a new part and publish it: added to what their series hold, or in its place; ``alone``: other series are
        dropped. ``since`` is the version that the bars were compared with. The new version."""
        fields = rows.select(*[c for c in rows.columns if c not in PARTITIONS]).schema.fields
        part = self._claimed()
        self._write(rows, part)
        written = self.spark.read.schema(StructType([*fields, *KEYS])).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/commit={part}").drop("commit")
        self._facts(written, part).write.parquet(f"{self.path}/facts/{part}")
        fresh = self.spark.read.schema(self.manifest(0).schema).parquet(f"{self.path}/facts/{part}")
        blocked = None
        while True:
            base = (self.versions() or [0])[-1]
            state, before = self._state(), self.manifest(base)
            if self._came(token):
                raise _Overtaken
            if base != since and not alone:
                held = lambda version: self.manifest(version).join(fresh.select(*PARTITIONS), list(PARTITIONS), "left_semi").select(*PARTITIONS, F.array_sort("parts").alias("parts"))
                was, now = held(since), held(base)
                if not was.exceptAll(now).isEmpty() or not now.exceptAll(was).isEmpty():
                    raise _Overtaken
            old = [StructField.fromJson(f) for f in (state["schema"] or {"fields": []})["fields"] if f["name"] not in (*PARTITIONS, "commit")]
            kinds = {f.name: f.dataType for f in old}
            for f in fields:
                if kinds.get(f.name, f.dataType) != f.dataType:
                    raise ValidationError(f"{f.name} is {f.dataType.simpleString()}, the store has {kinds[f.name].simpleString()}")
            schema = StructType([*old, *[f for f in fields if f.name not in kinds], *KEYS])
            if append:
                facts = {
                    "parts": F.flatten(F.array_sort(F.collect_list("parts"))), "rows_count": F.sum("rows_count"), "start_time": F.min("start_time"), "end_time": F.max("end_time"),
                    "last_close": F.max_by("last_close", "end_time"), "downloaded_at": F.max("downloaded_at"), "checksum": F.sum("checksum").cast("decimal(38,0)"), "blocks": F.flatten(F.collect_list("blocks")),
                }
                now = before.unionByName(fresh).groupBy(*PARTITIONS).agg(*[c.alias(n) for n, c in facts.items()])
            else:
                now = fresh if alone else before.join(fresh, list(PARTITIONS), "left_anti").unionByName(fresh)
            now.write.mode("overwrite").parquet(f"{self.path}/manifest/{part}")
            tokens = state["tokens"] | ({token[0]: token[1]} if token else {})
            self._create(f"state/{part}.json", json.dumps({"schema": schema.jsonValue(), "tokens": tokens}), overwrite=True)
            if self._mark(base + 1, part):
                return base + 1
            # Another writer has this version, or died while it took it.
            blocked = blocked if blocked and blocked[0] == base else (base, time.monotonic())
            if (self.versions() or [0])[-1] == base:
                if time.monotonic() - blocked[1] > PATIENCE_SECONDS:
                    fs, at = self._fs()
                    fs.delete(at(f"{self.path}/current/{base + 1}"), False)
                time.sleep(0.05)

    def _mark(self, version: int, part: int) -> bool:
        """Make a part's manifest that of a version: of several that try, one can."""
        return self._create(f"current/{version}", str(part), overwrite=False)

    def _published(self, body: Callable[[int], T]) -> T:
        """What a write gives that starts from the current version, done anew as often as other writers overtake it."""
        while True:
            try:
                return body((self.versions() or [0])[-1])
            except _Overtaken:
                continue

    def replace(self, bars: DataFrame) -> int:
        """A new state with these bars alone; they must be valid."""
        with self.held(bars) as bars:
            guard(bars, bar_violations(bars, keys=PARTITIONS), "invalid bars")
            return self._commit(bars, since=0, append=False, alone=True)

    def _touched(self, batch: DataFrame) -> DataFrame | None:
        """The stored bars of the series that a batch has bars of, all of them."""
        if not self.versions():
            return None
        own = self.manifest().join(batch.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi").limit(MOST_FOLDERS + 1).collect()
        if len(own) <= MOST_FOLDERS:
            found = self._folders(own)
            return self.read_all().where("false") if found is None else found
        return self.read_all().join(batch.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi")

    def _alike(self, stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both with all columns that either has, null where it lacks one."""
        lacking = lambda rows, other: {f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name not in rows.columns}
        stored, batch = stored.withColumns(lacking(stored, batch)), batch.withColumns(lacking(batch, stored))
        return stored, batch.select(*stored.columns)

    def write_closed(self, batch: DataFrame, *, token: tuple[str, int] | None = None) -> dict[str, int]:
        """Add closed bars. A bar that the store holds as the same candle is skipped; a different candle of a known time, stored or
        in the batch, is a conflict, and an open or broken bar an error: nothing is written then.

        Candles are compared in all fields of their identity that the batch has. Only stored bars of the batch's series and times
        are looked at. With a ``token``, a name and a number, the commit carries it, and a batch whose number isn't above
        the last one of its name is passed over: it was written before.
        """
        keys = [*PARTITIONS, "time"]
        if self._came(token):
            return {"new": 0, "duplicate": 0}
        with self.held(batch, place="__seq") as batch:
            if "is_closed" in batch.columns:
                guard(batch, batch.where(~F.coalesce("is_closed", F.lit(False))).select(*keys), "a closed batch holds an open bar")
            clashing = batch_conflicts(batch, keys=keys).count()
            if clashing:
                raise CacheConflict(f"{clashing} bars of the batch are given with different candles")
            batch = keep_first(batch, keys, "__seq").drop("__seq")
            return self._published(lambda since: {"new": 0, "duplicate": 0} if self._came(token) else self._write_new(batch, keys, since, token))

    def _write_new(self, batch: DataFrame, keys: Sequence[str], since: int, token: tuple[str, int] | None) -> dict[str, int]:
        stored, fresh, counts = self._touched(batch), batch, {"new": None, "duplicate": 0}
        if stored is not None:
            span = batch.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
            marked = classify_bulk(batch, stored.where(F.col("time").between(span["a"] or 0, span["b"] or 0)), keys=keys)
            found = {r["outcome"]: r["count"] for r in marked.groupBy("outcome").count().collect()}
            if found.get("conflict"):
                raise CacheConflict(f"{found['conflict']} bars differ from stored ones")
            fresh, counts = marked.where("outcome = 'new'").drop("outcome"), {"new": found.get("new", 0), "duplicate": found.get("duplicate", 0)}
        if counts["new"] != 0:
            guard(fresh, bar_violations(fresh, keys=PARTITIONS), "invalid bars")
            counts["new"] = fresh.count() if counts["new"] is None else counts["new"]
        if counts["new"]:
            self._commit(fresh, since=since, append=True, token=token)
        return counts

    def append_newer(self, batch: DataFrame) -> int:
        """Append valid bars that are all later than what their series holds, by the manifest alone; the number appended.

        A bar at the last stored time is skipped if it is the same candle, else a conflict.
        """
        with self.held(batch) as batch:
            guard(batch, bar_violations(batch, keys=PARTITIONS), "invalid bars")
            return self._published(lambda since: self._append(batch, since))

    def _append(self, batch: DataFrame, since: int) -> int:
        last = self.manifest().select(*PARTITIONS, "end_time")
        placed = batch.join(last, list(PARTITIONS), "left")
        late = placed.where("time < end_time").limit(1).collect()
        if late:
            raise BarConflict(f"a bar isn't newer than its series: {late[0]['time']}")
        again = placed.where("time = end_time").drop("end_time")
        if not again.isEmpty():
            differ = classify_bulk(again, self._touched(again), keys=[*PARTITIONS, "time"]).where("outcome = 'conflict'").limit(1).collect()
            if differ:
                raise BarConflict(f"the last bar differs from the stored one: {differ[0]['time']}")
        fresh = placed.where("end_time IS NULL OR time > end_time").drop("end_time")
        count = fresh.count()
        if count:
            self._commit(fresh, since=since, append=True)
        return count

    def merge(self, bars: DataFrame, *, token: tuple[str, int] | None = None) -> int:
        """A new state in which these bars take precedence (derived or fetched over stored); only their series are rewritten."""
        with self.held(bars) as bars:
            return self._published(lambda since: self._merge(bars, since, token))

    def _merge(self, bars: DataFrame, since: int, token: tuple[str, int] | None) -> int:
        if self._came(token):
            return self.versions()[-1]
        stored = self._touched(bars)
        merged = bars if stored is None else prefer_later(self._alike(stored, bars), [*PARTITIONS, "time"])
        guard(merged, bar_violations(merged, keys=PARTITIONS), "invalid bars")
        return self._commit(merged, since=since, append=False, token=token)

    def repair(self, source: DataFrame, *, strict: bool = False) -> int:
        """A new state with the source's bars, by ``repaired``; only the source's series are rewritten. What it changed is a row
        per series in the log of repairs."""
        if not self.versions():
            return self.replace(source)
        with self.held(source) as source:
            return self._published(lambda since: self._repair(source, since, strict))

    def _repair(self, source: DataFrame, since: int, strict: bool) -> int:
        stored, keys = self._touched(source), [*PARTITIONS, "time"]
        counts = audit_counts(source, stored, keys=keys, strict=strict, by=PARTITIONS)
        stored, source = self._alike(stored, source)
        made = repaired(source, stored, keys=keys, strict=strict)
        guard(made, bar_violations(made, keys=PARTITIONS), "invalid bars")
        commit = self._commit(made, since=since, append=False)
        counts.withColumn("version", F.lit(commit).cast("long")).write.mode("append").parquet(f"{self.path}/repairs")
        return commit

    def repairs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/repairs")

    def verify(self) -> DataFrame:
        """Series whose bars aren't those that their manifest row stands for: number or checksum differ."""
        rows = self.read_all()
        if rows is None:
            return self.manifest().select(*PARTITIONS)
        found = self._facts(rows, 0).select(*PARTITIONS, F.col("rows_count").alias("n"), F.col("checksum").alias("c"))
        joined = self.manifest().join(found, list(PARTITIONS), "full")
        return joined.where(~F.col("rows_count").eqNullSafe(F.col("n")) | ~F.col("checksum").eqNullSafe(F.col("c"))).select(*PARTITIONS)

    def latest(self) -> DataFrame:
        return self.manifest().select(*PARTITIONS, F.col("end_time").alias("latest"))

    def compact(self) -> int | None:
        """The same bars in as few files as the layout allows, of those series that lie in several commits."""
        return self._published(self._compact)

    def _compact(self, since: int) -> int | None:
        scattered = self.manifest().where(F.size("parts") > 1)
        if scattered.isEmpty():
            return (self.versions() or [None])[-1]
        return self._commit(self._touched(scattered), since=since, append=False)

    def vacuum(self, keep: int = 1, *, abandoned_ms: int = 86_400_000) -> Sequence[int]:
        """Forget all but the last ``keep`` states, and delete the data that only those named; the states forgotten. Parts that no
        state names belong to writers that run or failed, and go when they are as old as ``abandoned_ms``."""
        fs, at = self._fs()
        old, kept = self.versions()[: -max(1, keep)], self.versions()[-max(1, keep) :]
        named = lambda versions: {r["p"] for v in versions for r in self.manifest(v).select(F.explode("parts").alias("p")).distinct().collect()}
        forgotten, live, heads = named(old), named(kept), {self._part(v) for v in kept}
        for version in old:
            part = self._part(version)
            fs.delete(at(f"{self.path}/current/{version}"), False)
            if part not in heads:
                fs.delete(at(f"{self.path}/manifest/{part}"), True)
                fs.delete(at(f"{self.path}/state/{part}.json"), False)
        latest = time.time() * 1000 - abandoned_ms
        for x in fs.listStatus(at(f"{self.path}/data")) if kept else []:
            name = x.getPath().getName()
            part = int(name.removeprefix("commit=")) if name.startswith("commit=") else None
            if part is not None and part not in live and (part in forgotten or x.getModificationTime() < latest):
                for left in (f"data/{name}", f"facts/{part}"):
                    fs.delete(at(f"{self.path}/{left}"), True)
        return old


@dataclass
class SnapshotStore:
    """Canonical snapshots below ``path``: their bars and, in a second table, the envelopes that bind them."""

    spark: SparkSession
    path: str

    def write(self, bars: DataFrame, *, start: int, end: int, keys: Sequence[str] = ("series",), allow_open: bool = False) -> DataFrame:
        """Verify and seal resolved bars, write both; the envelopes. Equal data written again replace themselves."""
        return self._sealed(verified(bars), start=start, end=end, keys=keys, allow_open=allow_open)

    def _sealed(self, bars: DataFrame, *, start: int, end: int, keys: Sequence[str], allow_open: bool) -> DataFrame:
        """Seal bars whose hashes hold, write both.

        The bars are made once and written aside until they are sealed. This write's envelopes, a row per series, stay below
        ``sealed``, so that those that are returned aren't made again either.
        """
        name, at = uuid.uuid4().hex, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        aside, sealed = f"{self.path}/incoming/{name}", f"{self.path}/sealed/{name}"
        try:
            bars.write.parquet(aside)
            held = self.spark.read.schema(bars.schema).parquet(aside)
            envelopes = seal(held, keys=keys, start=start, end=end, allow_open=allow_open)
            envelopes.write.parquet(sealed)
            envelopes = self.spark.read.schema(envelopes.schema).parquet(sealed)
            bound = held.join(envelopes.select(*keys, "snapshot_id"), list(keys))
            if not allow_open:
                bound = bound.where("finality = 'FINAL'")
            for rows, table in ((bound, "bars"), (envelopes, "envelopes")):
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{self.path}/{table}")
        finally:
            at(aside).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at(aside), True)
        return envelopes

    def write_revisions(self, rows: DataFrame, *, start: int, end: int, keys: Sequence[str] = ("series",), allow_open: bool = False) -> DataFrame:
        """Bind revisions (``canonical_rows``) to chains, resolve these, seal and write what is selected; the envelopes.

        Hashes are made on the way, so they aren't made again to verify them; ``read`` does that.
        """
        return self._sealed(resolved_revisions(rows, keys=(*keys, "time")), start=start, end=end, keys=keys, allow_open=allow_open)

    def envelopes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/envelopes")

    def read(self, snapshot_id: str, *, keys: Sequence[str] = ("series",), allow_open: bool = False) -> DataFrame:
        """The bars of a snapshot. Their hashes are recomputed, and the envelope made anew from them must be the stored one."""
        known = self.envelopes().where(F.col("snapshot_id") == snapshot_id).collect()
        if not known:
            raise ValidationError(f"no snapshot {snapshot_id}")
        bars = self.spark.read.parquet(f"{self.path}/bars").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
        again = seal(verified(bars), keys=keys, start=known[0]["start"], end=known[0]["end"], allow_open=allow_open).collect()
        if [r.asDict() for r in again] != [{k: r[k] for k in again[0].asDict()} if again else {} for r in known]:
            raise ValidationError(f"snapshot {snapshot_id} doesn't match its envelope")
        return bars

    def latest(self, keys: Sequence[str] = ("series",)) -> DataFrame:
        """Of each series the envelope that reaches furthest."""
        rest = [c for c in self.envelopes().columns if c not in keys]
        return self.envelopes().groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("covered_end", "start")).alias("r")).select(*keys, "r.*")


@dataclass
class RawStore:
    """Payloads as JSON lines below ``path``, a folder per series and partition, appended batch by batch with a manifest row each."""

    spark: SparkSession
    path: str

    def write(self, payloads: DataFrame, series: dict[str, str], *, partition: str | None = None, column: str = "payload", compression: str | None = None) -> str:
        """Append a batch; returns its id, a hash of its lines, so that the same batch written again is one batch."""
        rows = payloads.select(F.col(column).cast("string").alias("payload"))
        # The id is a hash over sums of all lines' SHA-256, quarter by quarter: any order of the lines gives the same.
        digest = F.sha2(F.coalesce("payload", F.lit("")), 256)
        quarters = [F.sum(F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
        name = rows.agg(F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *quarters), 256).alias("h")).first()["h"]
        keys = {k: F.lit(v) for k, v in series.items()} | {"partition": F.lit(partition or "root"), "batch": F.lit(name)}
        made = rows.withColumns(keys)
        writer = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
        (writer.option("compression", compression) if compression else writer).text(f"{self.path}/lines")
        entry = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_count"), F.sum(F.xxhash64("payload").cast("decimal(38,0)")).alias("checksum"))
        entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.path}/manifest")
        return name

    def inspect(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def read(self, series: dict[str, str] | None = None, partition: str | None = None) -> DataFrame:
        """Payloads of a series, root batch first in no particular order within it; a batch that differs from its manifest raises."""
        rows = self.spark.read.text(f"{self.path}/lines").withColumnRenamed("value", "payload")
        known = self.inspect()
        for name, value in {**(series or {}), **({"partition": partition} if partition else {})}.items():
            rows, known = rows.where(F.col(name) == value), known.where(F.col(name) == value)
        keys = [c for c in known.columns if c not in ("rows_count", "checksum")]
        found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("payload").cast("decimal(38,0)")).alias("h"))
        torn = known.join(found, keys, "full").where(~F.col("rows_count").eqNullSafe(F.col("n")) | ~F.col("checksum").eqNullSafe(F.col("h")))
        guard(known, torn, "a raw batch doesn't match its manifest")
        return rows.drop("batch")


@dataclass
class FootprintStore:
    """Footprint levels below ``path``, a folder per instrument, timeframe and day. New bars replace stored ones of their time;
    every other bar of the days that are written stays."""

    spark: SparkSession
    path: str

    KEYS = ("exchange", "market", "symbol", "timeframe")

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def write(self, levels: DataFrame) -> None:
        fresh = levels.withColumn("day", F.date_format(F.timestamp_millis("time"), "yyyy-MM-dd"))
        if self.exists():
            stored = self.spark.read.parquet(self.path).withColumn("day", F.col("day").cast("string")).join(fresh.select(*self.KEYS, "day").distinct(), [*self.KEYS, "day"], "left_semi")
            kept = stored.join(fresh.select(*self.KEYS, "time").distinct(), [*self.KEYS, "time"], "left_anti")
            # Read and overwritten folders are the same, so what stays is written aside first.
            aside = f"{self.path.rstrip('/')}.merging"
            kept.select(*fresh.columns).unionByName(fresh).write.mode("overwrite").parquet(aside)
            fresh = self.spark.read.schema(fresh.schema).parquet(aside)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.KEYS, "day").parquet(self.path)

    def read(self, query: FootprintQuery) -> DataFrame:
        i = query.instrument
        rows = self.spark.read.parquet(self.path).where((F.col("exchange") == i.exchange) & (F.col("market") == i.market) & (F.col("symbol") == i.symbol))
        days = [F.date_format(F.timestamp_millis(F.lit(x)), "yyyy-MM-dd") for x in (query.start_ms, query.end_ms - 1)]
        rows = rows.where((F.col("timeframe") == query.timeframe.canonical) & F.col("day").cast("string").between(*days))
        return rows.where((F.col("time") >= query.start_ms) & (F.col("time") < query.end_ms)).drop("day")
