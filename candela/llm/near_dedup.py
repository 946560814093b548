"""Near-duplicate grouping: one-permutation MinHash, banded buckets, star-shaped candidates, a prefix join of what stars leave, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import free_name, hash_words, materialize, mix, pieces, ship, table, text_of, words
from candela.llm.components import components

#: Words in a shingle and the least similarity of a link, in percent.
SHINGLE, PERCENT = 5, 75
#: Slots of the one permutation, and slots in a band. At similarity 0.75 a pair shares no band with chance (1-0.75^4)^32, about 5e-6.
SLOTS, ROWS = 128, 4
#: Where a bucket isn't linked through its centre: members that are paired with the others in the first further turn and in
#: each after it, and other bands that narrow the bucket for this.
HUBS, LATER_HUBS, FURTHER = 6, 2, 3
#: Text bytes that a task holds as tokens at once.
SLICE_BYTES = 3 << 20
#: Counters of shingles that order them by rarity (shingles of one counter share it, which costs time and no link), and rows
#: of a shingle that one task pairs with the others.
COUNTERS, SHARE = 1 << 21, 1000
#: Members of a centre that follow one copy of its text.
DEALT = 200
#: Tasks that the classes of one component are dealt to when they look up its least id.
SALTS = 16
#: For each slot the order in which other slots are asked for a value while it is empty.
PROBES = np.stack([np.random.RandomState(1_000_003 + slot).permutation(SLOTS) for slot in range(SLOTS)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text as sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle as a whole."""
    offsets, codes, distinct = words(texts)
    hashes = mix(hash_words(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _STEP + hashes[k : len(hashes) - SHINGLE + 1 + k]
        rolled = mix(rolled)
        out = []
        for start, end in zip(offsets[:-1], offsets[1:], strict=True):
            if end - start >= SHINGLE:
                out.append(np.unique(rolled[start : end - SHINGLE + 1]))
            elif end > start:
                whole = np.uint64(end - start)
                for x in hashes[start:end]:
                    whole = whole * _STEP + x
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SLOTS`` values per non-empty set: the least hash in each slot, empty slots filled by optimal densification.

    A slot asks others in an order that depends on the slot alone, so two sets fill it alike as often as they are similar.
    """
    sizes = np.array([len(x) for x in sets])
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    slot = (values >> np.uint64(64 - 7)).astype(np.int64)
    cell = owner * SLOTS + slot
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    table_ = np.zeros(len(sets) * SLOTS, np.uint64)
    full = np.zeros(len(sets) * SLOTS, bool)
    table_[cell[first]] = values[first]
    full[cell[first]] = True
    sparse = table_.copy()
    empty = np.flatnonzero(~full)
    for step in range(SLOTS):
        if not len(empty):
            break
        source = (empty // SLOTS) * SLOTS + PROBES[empty % SLOTS, step]
        found = full[source]
        table_[empty[found]] = sparse[source[found]]
        empty = empty[~found]
    return table_.reshape(len(sets), SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), SLOTS // ROWS, ROWS)
        keys = np.broadcast_to(np.arange(SLOTS // ROWS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
        for row in range(ROWS):
            keys = mix(keys * _STEP + parts[:, :, row])
    return keys


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text", SLICE_BYTES):
            sets = shingle_sets(batch.column("text"))
            some = [k for k, x in enumerate(sets) if len(x)]
            keys = band_keys(signatures([sets[k] for k in some])) if some else np.zeros((0, SLOTS // ROWS), np.uint64)
            lists = dict(zip(some, keys.view(np.int64), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("mark"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                    pa.array([lists.get(k) for k in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["id", "mark", "n", "digest", "bands"],
            )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members, which follow the row of their centre, the pairs with it whose full sets reach the threshold."""
    centre, own = None, np.zeros(0, np.uint64)
    for whole in batches:
        for batch in pieces(whole, "text", SLICE_BYTES):
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = []
            for k, members in enumerate(shingle_sets(batch.column("text"))):
                if v[k] is None:
                    centre, own = u[k], members
                    continue
                if u[k] != centre:
                    raise ValueError("members came without their centre")
                common = len(np.intersect1d(own, members, assume_unique=True))
                if 100 * common >= PERCENT * (len(own) + len(members) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in keep], pa.int64()), pa.array([v[k] for k in keep], pa.int64())], names=["u", "v"])


def _plausible(left: str, right: str) -> F.Column:
    """The smaller set can reach the threshold against the larger one."""
    return F.least(left, right) * 100 >= F.greatest(left, right) * PERCENT


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among ``pairs(u, v)``; ``texts(node, text)`` holds the text of every node in them.

    The members of a centre are dealt to several tasks if they are many. Each task gets the centre's text once, before them.
    """
    many = pairs.groupBy("u").agg(F.floor(F.count(F.lit(1)) / DEALT).alias("last"))
    dealt = pairs.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("last") + 1).alias("share"))
    members = dealt.join(texts.withColumnRenamed("node", "v"), "v").select("u", "share", "v", "text")
    spread = many.select("u", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("share"))
    centres = spread.join(texts.withColumnRenamed("node", "u"), "u").select("u", "share", F.lit(None).cast("long").alias("v"), "text")
    rows = centres.unionByName(members).repartition("u", "share").sortWithinPartitions("u", "share", F.col("v").asc_nulls_first())
    return rows.select("u", "v", "text").mapInArrow(_linked, "u long, v long")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Of ``members(key, node, n, more)`` those of buckets that still hold several components, each with its root.

    Components only grow together, so a bucket of one component stays one.
    """
    root = F.coalesce("root", "node").alias("root")
    placed = materialize(members.join(roots, "node", "left").select("key", "node", "n", "more", root), "near-rooted")
    held = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
    return materialize(placed.join(held, "key", "left_semi"), "near-open")


def _halved(tried: DataFrame, roots: DataFrame) -> DataFrame:
    """Of ``tried``, the buckets of a turn with the roots from before it, those with half as many components or fewer after it, and still several.

    So a bucket of m members comes to log2(m) + 1 turns at most, however many turns find single links elsewhere. What the
    others still hold is left to the prefix join.
    """
    after = F.coalesce("after", "root").alias("after")
    placed = materialize(tried.join(roots.withColumnRenamed("root", "after"), "node", "left").select("key", "node", "n", "more", "root", after), "near-rooted")
    merged = placed.groupBy("key", "root").agg(F.min("after").alias("after")).groupBy("key", "after").agg(F.count(F.lit(1)).alias("c"))
    fewer = merged.groupBy("key").agg(F.sum("c").alias("had"), F.count(F.lit(1)).alias("has")).where("has > 1 AND 2 * has <= had").select("key")
    return materialize(placed.join(fewer, "key", "left_semi").select("key", "node", "n", "more", F.col("after").alias("root")), "near-halved")


def _edges_by_hubs(left: DataFrame, turn: int) -> DataFrame:
    """Pairs of a hub and the members of its bucket that are still in another component; ``left`` is what ``_open`` or ``_halved`` gives.

    A bucket is narrowed here by each of ``FURTHER`` other bands, so that its hubs, members drawn anew each turn, are close
    to the rest.
    """
    hubs_now = HUBS if turn == 1 else LATER_HUBS
    # Written aside, so that hubs and members are taken from one narrowing.
    placed = materialize(left.select("node", "n", "root", F.explode(F.transform("more", lambda x: F.xxhash64("key", x))).alias("key")), "near-narrowed")
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + k)), "node", "n", "root")).alias(f"hub{k}") for k in range(hubs_now)]
    picked = F.array_distinct(F.array(*[F.struct(f"hub{k}.node", f"hub{k}.n", f"hub{k}.root") for k in range(hubs_now)]))
    hubs = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), *draws)
    hubs = hubs.where("least != most").select("key", "least", F.explode(picked).alias("hub"))
    return (
        placed.join(hubs, "key")
        .where("root != hub.root AND root != least")  # one way is enough for the fast way; the prefix join finds what it misses
        .where(_plausible("n", "hub.n"))
        .select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v"))
        .distinct()
    )


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text", SLICE_BYTES):
            cells, counts = np.unique(np.concatenate(shingle_sets(batch.column("text"))) % np.uint64(COUNTERS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["cell", "c"])


def _prefixes(rarity: np.ndarray):
    """Of each text the shingles, rarest first, one of which any text of a link with it has too; those of no other text left out.

    A set of n shares at least PERCENT of its n with a linked one, so the first they share is among the n - ceil(n * PERCENT / 100) + 1 first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", SLICE_BYTES):
                shingles, rows, places, sizes = [], [], [], []
                for row, x in enumerate(shingle_sets(batch.column("text"))):
                    count = rarity[x % np.uint64(COUNTERS)]
                    first = np.lexsort((x, count))[: len(x) + (-PERCENT * len(x) // 100) + 1]
                    place = np.flatnonzero(count[first] > 1)
                    shingles.append(x[first[place]])
                    places.append(place)
                    rows.append(np.full(len(place), row))
                    sizes.append(np.full(len(place), len(x)))
                rows = pa.array(np.concatenate(rows))
                arrays = [pa.array(np.concatenate(shingles).view(np.int64)), batch.column("node").take(rows), batch.column("root").take(rows)]
                arrays += [pa.array(np.concatenate(x).astype(np.int32)) for x in (places, sizes)]
                yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "node", "root", "place", "n"])

    return run


def _edges_by_prefixes(left: DataFrame, texts: DataFrame) -> DataFrame | None:
    """All pairs from different components that can reach the threshold, of members of buckets that hold several components.

    The join is exact: texts of a link have their first common shingle, in the order of rarity, in both prefixes, and what
    follows it in either set suffices for the threshold. Of two components at a shingle one isn't the least there, so those
    of the others are paired with all; a frequent shingle is dealt to several tasks.
    """
    left = materialize(texts.join(left.select("node", "root").distinct(), "node").select("node", "root", "text"), "near-left")
    counted = left.mapInArrow(_counters, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).where("c > 1")
    # Any order that all tasks share will do, so steps of a tenth are enough: a byte each, 2 to 255 (counts up to 3e10 differ).
    level = F.least(F.ceil(F.log(1.1, "c")) + 1, F.lit(255)) - 128
    found = counted.select(F.col("cell").cast("int").alias("cell"), level.cast("byte").alias("level")).toArrow()
    if not found.num_rows:
        return None
    rarity = np.ones(COUNTERS, np.uint8)
    rarity[np.asarray(found["cell"])] = np.asarray(found["level"]).astype(np.int16) + 128
    rows = materialize(left.mapInArrow(_prefixes(rarity), "shingle long, node long, root long, place int, n int"), "near-prefixes")
    held = rows.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("m")).where("least != most")
    rows = rows.join(held.select("shingle", "least", F.floor(F.col("m") / SHARE).alias("last")), "shingle")
    rows = materialize(rows, "near-shared")
    others = rows.where("root != least").select("shingle", F.pmod(F.xxhash64("node"), F.col("last") + 1).alias("share"), *[F.col(c).alias(f"o_{c}") for c in ("node", "root", "place", "n")])
    every = rows.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("share"), "node", "root", "place", "n")
    reach = F.least(F.col("n") - F.col("place"), F.col("o_n") - F.col("o_place")) * (100 + PERCENT) >= (F.col("n") + F.col("o_n")) * PERCENT
    pairs = every.join(others, ["shingle", "share"]).where(F.col("root") != F.col("o_root")).where(reach)
    return pairs.select(F.least("node", "o_node").alias("u"), F.greatest("node", "o_node").alias("v")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: ``id``, a hash of the text, number of shingles, component and whether the row is kept."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = materialize(source.mapInArrow(_features, f"id {kind}, mark long, n long, digest binary, bands array<long>"), "near-rows")
    first = F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("first")
    classes = rows.where("n > 0").groupBy("digest").agg(first, F.max("n").alias("n"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("digest", "n", "bands", "copies", F.col("first.id").alias("least"), F.col("first.mark").alias("mark"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    ring = F.concat("bands", F.slice("bands", 1, FURTHER))
    banded = classes.select("node", "n", (-F.col("copies")).alias("lead"), ring.alias("ring"), F.posexplode("bands").alias("band", "key"))
    banded = banded.select("node", "n", "lead", "key", F.slice("ring", F.col("band") + 2, FURTHER).alias("more"))
    centres = banded.groupBy("key").agg(F.min(F.struct("lead", "node", "n")).alias("centre"), F.count(F.lit(1)).alias("m"))
    members = materialize(banded.join(centres.where("m > 1").drop("m"), "key"), "near-members")
    pairs = members.where("node != centre.node").where(_plausible("n", "centre.n"))
    pairs = materialize(pairs.select(F.col("centre.node").alias("u"), F.col("node").alias("v")).distinct(), "near-pairs")

    # Texts are needed of candidates only, one row of each class: the set of any other is the same.
    pick = F.xxhash64("mark", "id").alias("pick")
    needed = members.select("node").distinct().join(classes.select("node", F.col("least").alias("id"), "mark"), "node").select("node", pick)
    texts = source.select(pick, "text").hint("merge").join(materialize(needed, "near-needed"), "pick").groupBy("pick", "node").agg(F.max("text").alias("text"))
    texts = materialize(texts.select("node", "text"), "near-texts")

    links = materialize(_confirmed(pairs, texts), "near-links")
    roots = components(links)
    left = _open(members.select("key", "node", "n", "more"), roots)
    tried, turn = left, 1
    while not tried.isEmpty():
        found = materialize(_confirmed(materialize(_edges_by_hubs(tried, turn), "near-pairs"), texts), "near-links")
        if found.isEmpty():
            break
        turn += 1
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
        tried = _halved(tried, roots)
    if turn > 1:
        left = _open(left.drop("root"), roots)
    if (rest := _edges_by_prefixes(left, texts)) is not None:
        found = materialize(_confirmed(materialize(rest, "near-pairs"), texts), "near-links")
        if not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))

    led = classes.select("node", "digest", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The classes of one component are looked up in several tasks: each root's row is there under each salt.
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    least = led.groupBy("root", salt.alias("salt")).agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n"))
    least = least.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n"))
    # A component of one class needs no look-up; the others are fewer than links.
    spread = least.where("n > 1").select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = led.withColumn("salt", salt).join(spread, ["root", "salt"], "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    placed = materialize(placed, "near-placed")
    out = rows.select("id", "mark", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(placed, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", "mark", "n", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles, component_id, kept``.

    Texts with equal shingle sets are one class. Classes that share a band are candidates: each bucket names the class of
    most rows (then the least) its centre and pairs it with every other member, so a bucket of m members gives m-1 pairs. Candidates are
    confirmed on their full sets. Where members of a bucket are still in different components after that, further hubs of
    the bucket are paired with them, turn after turn while that halves the bucket's components at least. This is the fast way; where
    buckets then still hold several components, a prefix join finds every link that remains between them. No bucket is left out or cut.

    ``component_id`` is the least id reachable over links (of a text without words: its own id); null ids come out as
    they are and lead no component. Repeated rows share class and component. A text of any length is compared whole. Other
    columns are ignored; an empty table gives an empty result.
    """
    found = _grouped(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id, all columns unchanged; see ``near_groups``.

    Rows that repeat this id and text stay too: exact copies are the exact stage's work. Of rows that repeat an id with
    different texts those stay whose own component it leads. Null and empty texts stay; an empty table gives an empty one.
    """
    id_name, mark = free_name(docs, "stay"), free_name(docs, "mark")
    stay = _grouped(docs, id_col, text_col).where("kept").select(F.col("id").alias(id_name), F.col("mark").alias(mark)).distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(id_name)) & (F.xxhash64(text_of(text_col)) == F.col(mark))
    return docs.join(stay, same, "left_semi")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
