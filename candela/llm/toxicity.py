"""Toxicity by class-conditional Kneser-Ney models over the characters of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import fold, free_name, mix, pieces, ship, table, text_of, words

#: Labelled rows of each class that are read at most, those with the least hash of their id.
SAMPLE = 8_000
#: One in so many of them sets the scale of the score instead of being counted.
SCALE_PART = 4
#: Rows with at least this score are predicted toxic.
THRESHOLD = 0.7
#: Text bytes that are scored at once.
SLICE_BYTES = 1 << 20
START, END = 1, 2
_BITS = np.uint64(21)
_CODE = np.uint64((1 << 21) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character and end of the distinct words: number of the word, three characters before (packed), character."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in distinct.to_pylist()]
    lengths = np.array([len(x) + 1 for x in codes], np.int64)
    total = int(lengths.sum())
    flat = np.full(total, END, np.uint64)
    ends = np.cumsum(lengths)
    inner = np.ones(total, bool)
    inner[ends - 1] = False
    flat[inner] = np.concatenate(codes) if codes else []
    owner = np.repeat(np.arange(len(codes)), lengths)
    place = np.arange(total) - (ends - lengths)[owner]
    context = np.zeros(total, np.uint64)
    for back in (3, 2, 1):
        before = np.full(total, START, np.uint64)
        before[place >= back] = flat[np.flatnonzero(place >= back) - back]
        context = (context << _BITS) | before
    return owner, context, flat


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            offsets, codes, distinct = words(batch.column("text"))
            toxic = np.repeat(np.asarray(batch.column("toxic")), np.diff(offsets)) == 1
            owner, context, char = _grams(distinct)
            counts = [np.bincount(codes[part], minlength=len(distinct))[owner] for part in (~toxic, toxic)]
            pairs, where = np.unique(np.stack([context, char]), axis=1, return_inverse=True)
            sums = [np.bincount(where.ravel(), x, minlength=pairs.shape[1]).astype(np.int64) for x in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                names=["context", "char", "ordinary", "toxic"],
            )


@dataclass
class Model:
    """Log-likelihood ratios (toxic to ordinary) of seen characters in context; elsewhere that of the context's free mass."""

    gram: np.ndarray
    gram_ratio: np.ndarray
    context: np.ndarray
    context_ratio: np.ndarray
    weights: np.ndarray | None = None

    def of_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its summed ratio and its number of characters, the end included."""
        owner, context, char = _grams(distinct)
        free = _look(self.context, self.context_ratio, context, 0.0)
        ratio = _look(self.gram, self.gram_ratio, _key(context, char), free)
        return np.bincount(owner, ratio, minlength=len(distinct)), np.bincount(owner, minlength=len(distinct))


def _key(context: np.ndarray, char: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * _STEP + char)


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(other, asked.shape)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], other)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from counts of counts."""
    n = [max(1, int((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.clip(d, [0, 0.1, 0.2, 0.3], [0, 0.95, 1.9, 2.85])[np.minimum(counts, 3).astype(int)]


def fit_ratios(context: np.ndarray, char: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
    """The two models from 4-gram counts of each class, over lower orders of continuation counts that the classes share."""
    # Shared lower orders: of how many different characters a shorter gram is the continuation.
    shared = np.full(len(char), 1.0 / (len(np.unique(char)) + 1))
    for order in (1, 2, 3):
        kept = np.uint64((1 << (21 * (order - 1))) - 1) if order > 1 else np.uint64(0)
        longer = np.uint64((1 << (21 * order)) - 1)
        types, first = np.unique(_key(context & longer, char), return_index=True)
        gram, gram_of = np.unique(_key(context & kept, char), return_inverse=True)
        base, base_of = np.unique(context & kept, return_inverse=True)
        n_gram = np.bincount(gram_of[first], minlength=len(gram))
        n_base = np.bincount(base_of[first], minlength=len(base))
        kinds = np.bincount(base_of[np.unique(gram_of, return_index=True)[1]], minlength=len(base))
        shared = (np.maximum(n_gram[gram_of] - 0.75, 0) + 0.75 * kinds[base_of] * shared) / n_base[base_of]
    base, base_of = np.unique(context, return_inverse=True)
    logs, free = [], []
    for counts in (ordinary, toxic):
        total = np.bincount(base_of, counts, minlength=len(base))
        less = _discounts(counts)
        mass = np.where(total > 0, np.bincount(base_of, less, minlength=len(base)) / np.maximum(total, 1), 1.0)
        seen = np.where(total[base_of] > 0, np.maximum(counts - less, 0) / np.maximum(total[base_of], 1), 0.0)
        logs.append(np.log(seen + mass[base_of] * shared))
        free.append(np.log(mass))
    keys = _key(context, char)
    order = np.argsort(keys)
    return Model(keys[order], (logs[1] - logs[0])[order], base, free[1] - free[0])


def features(model: Model, texts: pa.Array) -> np.ndarray:
    """A row per text: the mean ratio of its characters, and the ratios of its two most toxic words (0 at least)."""
    offsets, codes, distinct = words(texts)
    out = np.zeros((len(texts), 3))
    if not len(codes):
        return out
    ratio, size = model.of_words(distinct)
    per, row = ratio[codes], np.repeat(np.arange(len(texts)), np.diff(offsets))
    out[:, 0] = np.bincount(row, per, minlength=len(texts)) / np.maximum(np.bincount(row, size[codes], minlength=len(texts)), 1)
    high = np.flatnonzero(per > 0)
    high = high[np.lexsort((-per[high], row[high]))]
    rows = row[high]
    leads = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    out[rows[leads], 1] = per[high[leads]]
    second = np.zeros(len(rows), bool)
    second[1:] = leads[:-1] & ~leads[1:]
    out[rows[second], 2] = per[high[second]]
    return out


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip(x[:, 0], -1, 1) * 5, np.minimum(x[:, 1:], 16.0) / 4])


def score(model: Model, texts: pa.Array) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(features(model, texts)) @ model.weights, -30, 30)))


def fit_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a little ridge; only rising in every feature."""
    z, w = _inputs(x), np.array([-2.0, 0.0, 0.0, 0.0])
    ridge = np.diag([1e-3, 0.1, 0.1, 0.1])
    free = np.ones(4, bool)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - ridge @ w
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge
        step = np.zeros(4)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        falling = free & (w < 0) & (np.arange(4) > 0)
        w[falling], free = 0.0, free & ~falling
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows whose ``crc32(id) mod 3`` is not 1: at most ``sample`` of each class, each text once.

    Rows without label or with contradicting labels (any toxic one counts) and ids missing in ``docs`` are fine. Without
    rows of both classes every ratio is 0 and every score the share of toxic rows seen (0.5 without any).
    """
    ship(docs.sparkSession)
    known = labels.where("toxic IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")).where(fold("id", 3) != 1)
    near = F.xxhash64("id")
    chosen = [known.where(F.col("toxic") == k).orderBy(near, "id").limit(sample) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).withColumn("scale", F.pmod(F.shiftright(near, 7), F.lit(SCALE_PART)) == 0)
    # At most 2 * sample rows of three short columns: a bound that doesn't grow with the tables.
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("toxic").alias("toxic"), F.max_by("scale", "id").alias("scale"), F.max("text").alias("text"))
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"), "scale")
    counts = (
        rows.where("NOT scale").select("text", "toxic").mapInArrow(_counted, "context long, char long, ordinary long, toxic long")
        .groupBy("context", "char").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    )
    columns = [np.asarray(counts.column(x).combine_chunks()) for x in ("context", "char", "ordinary", "toxic")]
    model = fit_ratios(columns[0].view(np.uint64), columns[1].astype(np.uint64), columns[2], columns[3])
    if not (columns[2].sum() and columns[3].sum()):
        model.gram_ratio, model.context_ratio = model.gram_ratio * 0, model.context_ratio * 0

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                x = features(model, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, x.T)], names=["toxic", "mean", "first", "second"])

    seen = rows.where("scale").select("text", "toxic").mapInArrow(scaled, "toxic int, mean double, first double, second double").toArrow()
    x = np.column_stack([np.asarray(seen.column(k).combine_chunks()) for k in ("mean", "first", "second")])
    y = np.asarray(seen.column("toxic").combine_chunks()).astype(float)
    if not len(y):
        x, y = np.zeros((2, 3)), np.array([0.0, 1.0])
    model.weights = fit_scale(x, y)
    return model


def scorer(spark: SparkSession, model: Model, column: str, name: str = "score") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, column, SLICE_BYTES):
                yield batch.append_column(name, pa.array(score(shared.value, batch.column(column))))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: the id, ``held_out, score, predicted``.

    Two Kneser-Ney models of the characters in words, one of toxic and one of ordinary texts, back off to the same
    continuation counts, so that an expression neither class has seen often says little. Their log-likelihoods are compared
    per character over the whole text and per word over its two most toxic words; a logistic scale learned on labelled rows
    that weren't counted turns this into a score of 0 to 1. Label, language, source and id are no inputs. Null counts as the
    empty text, which gets the score of a text without evidence. A text of any length is scored whole. Rows that repeat a
    text get one score each, equal ones; null ids come out as they are. Other columns change nothing, an empty table gives an
    empty result, and without labels of both classes no row is told from another.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    kind = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(scorer(docs.sparkSession, model, "text"), kind)
    return scored.select(
        F.col(id_col), (fold(id_col, 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns unchanged; see ``toxicity``.

    Null and empty texts are scored as empty ones, rows that repeat a text stay or go together, an empty table gives an empty
    one. Columns may have any name.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    text, mark = free_name(docs, "plain"), free_name(docs, "score")
    rows = docs.withColumn(text, text_of(text_col))
    kind = T.StructType([*rows.schema.fields, T.StructField(mark, T.DoubleType())])
    scored = rows.mapInArrow(scorer(docs.sparkSession, model, text, mark), kind)
    return scored.where(F.col(mark) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_kn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
