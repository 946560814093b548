"""Benchmark decontamination: pigeonhole pieces found exactly, matches verified by bit-parallel edit distance."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import free_name, pieces, ship, table, text_bytes, text_of

#: Edits allowed per character of a test item.
ERROR_RATE = 0.08
#: Test items are searched in blocks of about this many bytes, so what a task holds doesn't grow with the benchmark.
BLOCK_BYTES = 4 << 20
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, every run of other characters than letters and digits as one space."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float) -> int:
    """Edits allowed in an item of so many characters; an item without any must occur as whole words."""
    return int(rate * length)


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part (Myers, one bit a row)."""
    masks: dict[str, int] = {}
    for k, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << k
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, distance = full, 0, len(pattern)
    best, at = distance, 0
    for k, char in enumerate(text):
        match = masks.get(char, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
            if distance < best:
                best, at = distance, k + 1
        rise, fall = rise << 1, fall << 1  # a part may start anywhere: the row above the first stays 0
        up = full & (fall | ~(diagonal | match | down | rise))
        down = full & rise & (diagonal | match)
    return best, at


@dataclass
class Items:
    """Test items cut into pieces, one more than the errors allowed: a match must hold at least one piece unchanged."""

    ids: list
    texts: list[str]
    rate: float

    def automaton(self) -> ahocorasick.Automaton:
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in enumerate(self.texts):
            parts = budget(len(text), self.rate) + 1
            cuts = [k * len(text) // parts for k in range(parts + 1)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start:
                    places.setdefault(text[start:end], []).append((item, start))
        found = ahocorasick.Automaton()
        for piece, where in places.items():
            found.add_word(piece, (len(piece), where))
        found.make_automaton()
        return found

    def matches(self, automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, int, int]]:
        """Item, distance, start and end in the normalised text: the best match of each item that is within its budget."""
        spots: dict[int, set[int]] = {}
        for end, (length, where) in automaton.iter(text):
            for item, start in where:
                spots.setdefault(item, set()).add(end + 1 - length - start)
        out = []
        for item, diagonals in spots.items():
            pattern = self.texts[item]
            allowed = budget(len(pattern), self.rate)
            best = (allowed + 1, 0, 0)
            if allowed == 0:
                for at in sorted(diagonals):
                    if f" {text} "[max(0, at) : at + len(pattern) + 2] == f" {pattern} ":
                        best = (0, at, at + len(pattern))
                        break
            else:
                for low, high in _merged(sorted(diagonals), allowed):
                    start = max(0, low - allowed)
                    window = text[start : high + len(pattern) + allowed]
                    distance, end = best_end(pattern, window)
                    if distance < best[0]:
                        back = best_end(pattern[::-1], window[:end][::-1])[1]
                        best = (distance, start + end - back, start + end)
            if best[0] <= allowed:
                out.append((item, *best))
        return sorted(out)


def _merged(diagonals: list[int], gap: int) -> Iterator[tuple[int, int]]:
    low = high = diagonals[0]
    for at in diagonals[1:]:
        if at - high > gap:
            yield low, high
            low = at
        high = at
    yield low, high


def spans(text: str) -> list[int]:
    """The place in ``text`` of each character of its normalised form. A character whose lower case is longer counts for all of it."""
    lower = text.lower()
    origin = range(len(text)) if len(lower) == len(text) else [k for k, char in enumerate(text) for _ in char.lower()]
    out: list[int] = []
    for found in re.finditer(r"[^\W_]+", lower):
        if out:
            out.append(origin[found.start() - 1])
        out.extend(origin[found.start() : found.end()])
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float, block_bytes: int) -> Iterator[Items]:
    count = max(1, math.ceil(text_bytes(benchmark, text_col) / block_bytes))
    rows = benchmark.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if count > 1:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    for block in range(count):
        part = rows.where(F.col("block") == block) if count > 1 else rows
        items = [(r["id"], t) for r in part.select("id", "text").collect() if (t := normalise(r["text"]))]
        if items:
            yield Items([x for x, _ in items], [t for _, t in items], rate)


def _searcher(spark: SparkSession, items: Items) -> Callable[[], tuple[Items, Callable[[str], list]]]:
    shared = spark.sparkContext.broadcast(items)

    def start() -> tuple[Items, Callable[[str], list]]:
        automaton = shared.value.automaton()
        return shared.value, lambda text: shared.value.matches(automaton, text)

    return start


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and test item found in it: the two ids, ``distance, item_chars, start, end, passage``.

    Both texts are normalised (case, and everything but letters and digits as one space). An item of m characters may be
    found with up to ``rate * m`` edits, rounded down; one too short for any must occur as whole words. Of several places the
    one with the fewest edits counts, then the first. Start and end are code points of the document's own text, ``passage`` is
    what stands there. Items without letters or digits are found nowhere, null texts count as empty, repeated documents or
    items give repeated rows, null ids come out as they are. Texts of any length are searched whole. Other columns are
    ignored. Without documents or items the result is empty.

    Items go to the tasks in blocks of about ``block_bytes``, and each block is one more pass over the documents: what a task
    holds doesn't grow with the benchmark, the number of passes does.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    names = [id_col, item_col, "distance", "item_chars", "start", "end", "passage"]
    kinds = [rows.schema["id"].dataType, benchmark.schema[item_col].dataType, *[T.LongType()] * 4, T.StringType()]
    kind = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    found = None
    for items in _blocks(benchmark, item_col, item_text_col, rate, block_bytes):
        start = _searcher(spark, items)

        def run(batches: Iterator[pa.RecordBatch], start: Callable = start) -> Iterator[pa.RecordBatch]:
            block, search = start()
            for batch in batches:
                ids, out = batch.column("id"), []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    hits = search(normalise(text))
                    if hits:
                        places = spans(text)
                        for item, distance, low, high in hits:
                            a, b = places[low], places[high - 1] + 1
                            out.append((row, block.ids[item], distance, len(block.texts[item]), a, b, text[a:b]))
                columns = [list(x) for x in zip(*out, strict=True)] or [[] for _ in range(7)]
                fields = [T.StructType([f]) for f in kind.fields[1:]]
                arrays = [pa.array(x, _arrow(f)) for x, f in zip(columns[1:], fields, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *arrays], names=names)

        part = rows.mapInArrow(run, kind)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], kind) if found is None else found


def _arrow(field: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.fields[0].dataType)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, all columns unchanged; see ``contaminated``.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives an empty one, and without items all
    rows stay. Columns may have any name.
    """
    spark = docs.sparkSession
    ship(spark)
    own = free_name(docs, "normal")
    rows = docs.withColumn(own, text_of(text_col))
    for items in _blocks(benchmark, item_col, item_text_col, rate, block_bytes):
        start = _searcher(spark, items)

        def run(batches: Iterator[pa.RecordBatch], start: Callable = start) -> Iterator[pa.RecordBatch]:
            _, search = start()
            for whole in batches:
                for batch in pieces(whole, own):
                    yield batch.filter(pa.array([not search(normalise(x)) for x in batch.column(own).to_pylist()], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
