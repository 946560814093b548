"""Revision chains of canonical bars, content hashes and sealed snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.errors import ValidationError
from candela.functions.hashing import digest, folded, marked
from candela.operators.ordered import with_previous

#: What a bar's content hash covers; not the snapshot it is in, nor when or by whom that was made.
CONTENT = (
    "instrument_id", "timeframe", "time", "time_close", "open", "high", "low", "close", "volume", "finality", "revision_state", "revision",
    "provider", "provider_revision", "superseded_bar_hash",
)

#: Domain of a bar's content hash.
CANONICAL = "canonical-bar/2"
DAY_MS = 86_400_000


def content_hash(columns: Sequence[str] = CONTENT):
    return digest([F.col(c) for c in columns], CANONICAL)


#: Rules of a chain, by the code that a broken one is reported with.
RULES = {
    "several_providers": "all revisions of a bar come from one provider",
    "repeated_revision": "a revision number stands for one content",
    "falling_revision": "revision numbers rise",
    "after_revocation": "nothing follows a revocation",
    "no_original": "the first revision is the original",
    "broken_lineage": "a revision names the hash of the bar that it replaces",
}


def _judged(chains: DataFrame, keys: Sequence[str], items: Column, *, lineage: bool) -> DataFrame:
    """The keys of ``chains`` with ``end``, what folding ``items`` comes to, and ``reason``, the first rule that is broken.

    The fold comes out of a generator, through which Spark copies no expression into the conditions that ask for its fields:
    it runs once a chain.
    """
    kind = chains.select(items.alias("x")).schema["x"].dataType.elementType["row"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(
        F.array().cast("array<string>").alias("seen"), F.array().cast("array<bigint>").alias("numbers"), F.array().cast("array<string>").alias("providers"),
        none("bigint").alias("number"), none("string").alias("own"), none("string").alias("before"), none("string").alias("state"), none("string").alias("broken"),
        none(kind).alias("row"), F.lit(0).cast("bigint").alias("duplicates"),
    )

    def step(so_far, x):
        first = F.size(so_far.seen) == 0
        torn = ~first & ~x.before.eqNullSafe(so_far.own) if lineage else F.lit(False)
        rule = (
            F.when(F.array_contains(so_far.numbers, x.number), "repeated_revision").when(x.number <= F.array_max(so_far.numbers), "falling_revision")
            .when(so_far.state == "REVOKED", "after_revocation").when(first & (x.state != "ORIGINAL"), "no_original").when(torn, "broken_lineage")
        )
        providers = F.array_distinct(F.array_append(so_far.providers, x.provider)).alias("providers")
        fresh = F.struct(
            F.array_append(so_far.seen, x.own).alias("seen"), F.array_append(so_far.numbers, x.number).alias("numbers"), providers, x.number.alias("number"), x.own.alias("own"),
            x.before.alias("before"), x.state.alias("state"), F.coalesce(so_far.broken, rule).alias("broken"), x.row.alias("row"), so_far.duplicates.alias("duplicates"),
        )
        kept = [so_far[n].alias(n) for n in ("number", "own", "before", "state", "broken", "row")]
        again = F.struct(so_far.seen.alias("seen"), so_far.numbers.alias("numbers"), providers, *kept, (so_far.duplicates + 1).alias("duplicates"))
        return F.when(F.array_contains(so_far.seen, x.own), again).otherwise(fresh)

    ended = chains.select(*keys, F.explode(F.array(F.aggregate(items, start, step))).alias("end"))
    return ended.withColumn("reason", F.when(F.size("end.providers") > 1, "several_providers").otherwise(F.col("end.broken")))


def _resolved(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """A row per key: what folding its revisions in order of arrival comes to. Revisions of a bar are few, so one array holds
    them and one shuffle brings them together."""
    lineage = "superseded_bar_hash" in rows.columns
    item = F.struct(
        F.col(seq).alias("at"), F.col("content_hash").alias("own"), F.col("revision").cast("long").alias("number"), F.col("revision_state").alias("state"),
        F.col("provider").alias("provider"), (F.col("superseded_bar_hash") if lineage else F.lit(None).cast("string")).alias("before"), F.struct(*[c for c in rows.columns if c not in keys]).alias("row"),
    )
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item), lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)).alias("items"))
    return _judged(grouped, keys, F.col("items"), lineage=lineage)


def chains(rows: DataFrame, *, keys: Sequence[str] = ("series", "time"), seq: str = "seq") -> DataFrame:
    """A row per (series, open time): what its revisions, in order of arrival, come to.

    Columns: ``reason`` (null, or the code in ``RULES`` of the first rule that the chain breaks), ``selected_revision`` (null if
    revoked or broken), ``revoked``, ``revisions`` (number of distinct ones), ``duplicates``. Rows need ``content_hash``,
    ``revision``, ``revision_state`` and ``provider``; with ``superseded_bar_hash`` the lineage is checked as well.
    """
    good, revoked = F.col("reason").isNull(), F.col("end.state") == "REVOKED"
    return _resolved(rows, keys, seq).select(
        *keys, "reason", F.when(good & ~revoked, F.col("end.number")).alias("selected_revision"), (good & revoked).alias("revoked"),
        F.size("end.seen").cast("long").alias("revisions"), F.col("end.duplicates").alias("duplicates"),
    )


def select_revisions(rows: DataFrame, *, keys: Sequence[str] = ("series", "time"), seq: str = "seq") -> DataFrame:
    """The bars that valid chains select; broken and revoked ones give none."""
    valid = _resolved(rows, keys, seq).where(F.col("reason").isNull() & (F.col("end.state") != "REVOKED"))
    return valid.select(*keys, "end.row.*").select(*rows.columns)


def _linked(rows: DataFrame, keys: Sequence[str], seq: str, content: Sequence[str]) -> tuple[DataFrame, Column]:
    """A row per key with ``items``, its revisions in order, and the array of their links: the hash of each and of the one before."""
    named = [c for c in content if c != "superseded_bar_hash"]
    if [*named, "superseded_bar_hash"] != list(content):
        raise ValidationError("the hash that a bar supersedes comes last in its content")
    body = F.concat_ws("\x1f", F.lit(CANONICAL), *[marked(F.col(c)) for c in named])
    item = F.struct(F.col(seq).alias("s"), body.alias("body"), (F.col("revision_state") == "ORIGINAL").alias("first"), F.struct(*[c for c in rows.columns if c not in keys]).alias("row"))
    start = F.array().cast("array<struct<body:string,own:string,before:string>>")

    def step(made, x):
        last = F.try_element_at(made, F.lit(-1))
        before = F.when(~x.first, last.own)
        own = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", x.body, marked(before)), 256))
        return F.concat(made, F.array(F.when(last.body == x.body, last).otherwise(F.struct(x.body.alias("body"), own.alias("own"), before.alias("before")))))

    # Items are made before they are collected: an aggregate would interpret what a projection compiles.
    made = rows.select(*keys, item.alias("__item"))
    return made.groupBy(*keys).agg(F.array_sort(F.collect_list("__item")).alias("items")), F.aggregate("items", start, step)


def with_lineage(rows: DataFrame, *, keys: Sequence[str] = ("series", "time"), seq: str = "seq", content: Sequence[str] = CONTENT) -> DataFrame:
    """Add ``superseded_bar_hash``, the hash of the revision before (null for originals), and ``content_hash``, which covers it.

    It is the hash that ``verified`` computes of the same columns. A revision that is given twice in a row, alike in all that the
    hash covers, is one revision. Revisions of one open time are few; their chain is folded inside one array.
    """
    grouped, links = _linked(rows, keys, seq, content)
    flat = grouped.select(*keys, F.inline(F.arrays_zip(F.col("items.row").alias("row"), links.alias("link"))))
    return flat.select(*keys, "row.*", F.col("link.own").alias("content_hash"), F.col("link.before").alias("superseded_bar_hash"))


def resolved_revisions(rows: DataFrame, *, keys: Sequence[str] = ("series", "time"), seq: str = "revision") -> DataFrame:
    """Revisions without hashes, bound to chains and resolved: the bars to seal, one per key that isn't revoked.

    A chain that breaks a rule stops the job. Rows are shuffled once, or not at all where they come dealt by the keys: a chain is
    resolved in the array in which it was bound.
    """
    grouped, links = _linked(rows, keys, seq, CONTENT)
    items = F.zip_with("items", links, lambda x, link: F.struct(
        link.own.alias("own"), x.row.revision.cast("long").alias("number"), x.row.revision_state.alias("state"), x.row.provider.alias("provider"), link.before.alias("before"), x.row.alias("row"),
    ))
    chain = _judged(grouped, keys, items, lineage=True)
    broken = F.raise_error(F.concat(F.lit("MD_BAR_CONFLICT: "), F.col("reason"), F.lit(" at "), F.concat_ws("/", *keys))).cast("boolean")
    kept = chain.where(F.when(F.col("reason").isNotNull(), broken).otherwise(F.col("end.state") != "REVOKED"))
    return kept.select(*keys, "end.row.*", F.col("end.own").alias("content_hash"), F.col("end.before").alias("superseded_bar_hash"))


def overlaps(bars: DataFrame, *, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Selected bars that open before the one before them has closed."""
    return with_previous(bars, keys, "time", {"previous_close": F.col("time_close")}).where("time <= previous_close")


def series_checksum(bars: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ("symbol",), day_ms: int = DAY_MS) -> DataFrame:
    """Per series one hash over its ordered rows: rows fold into days and days into the series, so no series is held whole."""
    rows = bars.select(*keys, "time", digest([F.col(c) for c in columns], "row").alias("d"))
    days = rows.groupBy(*keys, F.floor(F.col("time") / day_ms).alias("day")).agg(F.array_sort(F.collect_list(F.struct("time", "d"))).alias("x"), F.count(F.lit(1)).alias("n"))
    days = days.select(*keys, "day", folded(F.transform("x", lambda y: y.d)).alias("d"), "n")
    items = F.array_sort(F.collect_list(F.struct("day", "d")))
    return days.groupBy(*keys).agg(folded(F.transform(items, lambda y: y.d)).alias("checksum"), F.sum("n").alias("rows_count"))


def chained_days(days: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Days (``day, link``, the link over a day's own rows) with ``chain``: each link hashed onto the chain of the day before.

    A series' days are folded in one array, a row of 72 bytes a day, since a hash chain is sequential.
    """
    ordered = F.array_sort(F.collect_list(F.struct("day", "link")))
    link = lambda before, x: F.sha2(F.concat_ws("\x1f", before, x.link), 256)
    made = lambda so_far, x: F.array_append(so_far, F.struct(x.day.alias("day"), link(F.coalesce(F.try_element_at(so_far, F.lit(-1)).chain, F.lit("")), x).alias("chain")))
    start = F.array().cast("array<struct<day:bigint,chain:string>>")
    return days.groupBy(*keys).agg(F.aggregate(ordered, start, made).alias("links")).select(*keys, F.inline("links"))


def seal(bars: DataFrame, *, keys: Sequence[str] = ("series",), start: int, end: int, allow_open: bool = False) -> DataFrame:
    """Snapshot envelope of resolved canonical bars: a row per series with range, counts, gaps-free flag, series hash and id.

    Bars outside the range or overlapping raise; the finality policy applies after revisions are selected. The series hash
    depends on the query, provider revision and bars alone, so equal data give equal hashes whenever they are sealed.
    """
    outside = F.raise_error(F.lit("MD_VALIDATION_ERROR: a bar is outside the snapshot's range")).cast("boolean")
    inside = bars.select(*keys, "time", "time_close", "finality", "provider_revision", "content_hash").where(F.when((F.col("time") < start) | (F.col("time_close") >= end), outside).otherwise(F.lit(True)))
    stepped = with_previous(inside, keys, "time", {"previous_close": F.col("time_close")})
    clash = F.raise_error(F.lit("MD_BAR_CONFLICT: selected bars overlap")).cast("boolean")
    kept = stepped.where(F.when(F.col("time") <= F.col("previous_close"), clash).otherwise(F.lit(True)))
    if not allow_open:
        kept = kept.where("finality = 'FINAL'")
    gap = F.coalesce(F.col("time") > F.col("previous_close") + 1, F.col("time") > start)
    # Rows fold into days and days into the series, as in ``series_checksum``; the counts come along.
    row = F.struct("time", digest([F.col("content_hash")], "row").alias("d"))
    days = kept.withColumn("__gap", gap).groupBy(*keys, F.floor(F.col("time") / DAY_MS).alias("__day")).agg(
        F.array_sort(F.collect_list(row)).alias("x"), F.min("time").alias("covered_start"), F.max("time_close").alias("last_close"), F.count(F.lit(1)).alias("n"),
        F.count_if("__gap").alias("gaps"), F.min("provider_revision").alias("provider_revision"), F.max("provider_revision").alias("other_revision"),
    )
    days = days.withColumn("d", folded(F.transform("x", lambda y: y.d))).drop("x")
    totals = days.groupBy(*keys).agg(
        F.min("covered_start").alias("covered_start"), (F.max("last_close") + 1).alias("covered_end"), F.sum("n").alias("bar_count"), F.sum("gaps").alias("inner_gaps"),
        F.min("provider_revision").alias("provider_revision"), F.max("other_revision").alias("other_revision"),
        folded(F.transform(F.array_sort(F.collect_list(F.struct("__day", "d"))), lambda y: y.d)).alias("checksum"),
    )
    several = F.raise_error(F.lit("MD_VALIDATION_ERROR: several provider revisions in a snapshot")).cast("string")
    totals = totals.withColumn("provider_revision", F.when(F.col("provider_revision").eqNullSafe(F.col("other_revision")), F.col("provider_revision")).otherwise(several))
    gaps = F.col("inner_gaps") + (F.col("covered_end") < end).cast("long")
    query = [F.lit(start), F.lit(end)]
    return totals.select(
        *keys, F.lit(start).alias("start"), F.lit(end).alias("end"), "covered_start", "covered_end", "bar_count", gaps.alias("gap_count"), (gaps == 0).alias("complete"),
        "provider_revision", digest([*[F.col(k) for k in keys], *query, F.col("provider_revision"), F.col("checksum")], "series").alias("series_hash"),
    ).withColumn("snapshot_id", digest([F.col("series_hash")], "snapshot"))


def verified(bars: DataFrame, content: Sequence[str] = CONTENT) -> DataFrame:
    """``bars`` whose ``content_hash`` is recomputed and agrees; another one stops the job."""
    torn = F.raise_error(F.lit("MD_VALIDATION_ERROR: a bar doesn't match its content hash")).cast("boolean")
    return bars.where(F.when(~F.coalesce(F.col("content_hash") == content_hash(content), F.lit(False)), torn).otherwise(F.lit(True)))


def canonical_bars(klines: DataFrame, server_time_ms: int, *, provider_revision: str | None = None) -> DataFrame:
    """Decoded candles (``exchange, market, symbol, timeframe`` and OHLCV) as original canonical bars with their content hash."""
    from candela.operators.quality import finality

    made = klines.withColumns({
        "instrument_id": F.concat_ws("/", "exchange", "market", "symbol"), "finality": finality(F.col("time_close"), server_time_ms), "revision_state": F.lit("ORIGINAL"),
        "revision": F.lit(0).cast("long"), "provider": F.col("exchange"), "provider_revision": F.lit(provider_revision).cast("string"), "superseded_bar_hash": F.lit(None).cast("string"),
    })
    return made.withColumn("series", F.concat_ws("/", "instrument_id", "timeframe")).withColumn("content_hash", content_hash())
