"""Language-model scores by deleted interpolation of n-gram estimates, weights per context-frequency bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candela.llm.common import fold, hash_words, materialize, mix, pieces, ship, table, text_bytes, text_of, trim, words

#: Text bytes in a batch, about, and the most batches whose counts meet in one step: both bound what a task holds.
BATCH_BYTES, FAN = 12 << 20, 256
#: Text bytes that are held as tokens at once.
SLICE_BYTES = 3 << 20
#: Contexts share weights by the power of two of their frequency; above the last they are one bucket.
BUCKETS = 24
#: Steps per octave at which held-out ratios are gathered for expectation-maximisation, and their bound in octaves.
STEPS, OCTAVES = 4, 60
#: Training rows with these remainders of crc32(id) mod 10 are deleted from the counts while weights are learned.
DELETED = (1,)
HELD_OUT = 0
ROUNDS = 200
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
#: The end token, which is also the context of a text's first word. Words have even hashes, pairs odd ones.
END = np.uint64(0x5DEECE66D0000002)


class Batch:
    """The tokens of a batch of texts, as codes of its distinct words and distinct pairs (token before, token).

    ``keys`` are the sorted 64-bit keys of both, ``row`` is the text of each token. Texts are split in slices, so that
    only codes and keys are held for all of them.
    """

    def __init__(self, batches: list[pa.RecordBatch]):
        found, hashes, rows, done = [], [], [], 0
        for part in (p for batch in batches for p in pieces(batch, "text", SLICE_BYTES)):
            offsets, codes, distinct = words(part.column("text"))
            own = np.append(mix(hash_words(distinct)) & ~_ONE, END)
            found.append(np.insert(codes, offsets[1:], len(own) - 1).astype(np.int32))
            hashes.append(own)
            rows.append(np.insert(np.repeat(np.arange(part.num_rows), np.diff(offsets)), offsets[1:], np.arange(part.num_rows)).astype(np.int32) + done)
            done += part.num_rows
        self.texts = done
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.words, places = np.unique(np.concatenate(hashes), return_inverse=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))
        starts = np.cumsum([0, *map(len, hashes)])
        tokens = [places[a:b][codes] for a, b, codes in zip(starts[:-1], starts[1:], found, strict=True)]
        self.token = np.concatenate(tokens).astype(np.int32) if tokens else np.zeros(0, np.int32)
        end = int(np.searchsorted(self.words, END))
        self.before = np.concatenate([[end], self.token[:-1]]).astype(np.int32)[: len(self.token)]
        with np.errstate(over="ignore"):
            pair = mix(self.words[self.before] * _STEP + self.words[self.token]) | _ONE if len(self.token) else np.zeros(0, np.uint64)
        self.pairs, inverse = np.unique(pair, return_inverse=True)
        self.pair = inverse.astype(np.int32)
        self.keys = np.sort(np.concatenate([self.words, self.pairs]))

    def counts(self) -> np.ndarray:
        out = np.zeros(len(self.keys), np.uint64)
        for own, codes in ((self.words, self.token), (self.pairs, self.pair)):
            out[np.searchsorted(self.keys, own)] = np.bincount(codes, minlength=len(own))
        return out

    def estimates(self, totals: np.ndarray, tokens: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: bucket of its context, maximum-likelihood estimates of pair and token, count of the token."""
        single = totals[np.searchsorted(self.keys, self.words)]
        pair = totals[np.searchsorted(self.keys, self.pairs)]
        context = single[self.before]
        return bucket(single)[self.before], np.where(context > 0, pair[self.pair] / np.maximum(context, 1), 0.0), (single / max(tokens, 1))[self.token], single[self.token]


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as bytes: equal bytes of neighbouring numbers side by side, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _spread(data: bytes, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not count:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data, count * size, "zstd", asbytes=True), np.uint8).reshape(size, count)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


ASKED = "node long, child long, n int, keys binary, counted binary, deleted binary"
ANSWERED = "child long, node long, n int, counted binary, deleted binary, tokens long, deleted_tokens long, kinds long"


def fans(batches: int, most: int) -> list[int]:
    """Fan of each step: as few steps as let ``most`` children at a time reach all batches, and equal fans."""
    steps = 1
    while most**steps < batches:
        steps += 1
    fan = 2
    while fan**steps < batches:
        fan += 1
    return [fan] * steps


def _asked(child: int, keys: np.ndarray, counted: np.ndarray, deleted: np.ndarray, ranges: int, group: int) -> pa.Table:
    """Of one child's sorted keys, a row for each range of keys: to the node of that range in the group."""
    part = (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.zeros(0, np.int64)
    runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False))[: len(starts)]
    some = lambda x: _squeezed(x) if x.any() else None
    return pa.table(
        {
            "node": pa.array(group * ranges + part[starts], pa.int64()), "child": pa.array([child] * len(runs), pa.int64()), "n": pa.array([e - a for a, e in runs], pa.int32()),
            "keys": pa.array([_squeezed(keys[a:e]) for a, e in runs], pa.binary()),
            "counted": pa.array([some(counted[a:e]) for a, e in runs], pa.binary()), "deleted": pa.array([some(deleted[a:e]) for a, e in runs], pa.binary()),
        }
    )


def _joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a node's children, where each child's keys stand among them, and the children's counts added up."""
    keys, code = np.unique(np.concatenate([_spread(r["keys"], np.uint64, r["n"]) for r in rows]), return_inverse=True)
    sums = [np.zeros(len(keys), np.uint64) for _ in range(2)]
    at = 0
    for r in rows:
        for total, name in zip(sums, ("counted", "deleted"), strict=True):
            if r[name] is not None:  # a child's keys are distinct
                total[code[at : at + r["n"]]] += _spread(r[name], np.uint64, r["n"])
        at += r["n"]
    return keys, code, *sums


def _answers(rows: list[dict], code: np.ndarray, counted: np.ndarray, deleted: np.ndarray, sums: tuple[int, int, int] = (0, 0, 0)) -> pa.Table:
    """To each child the corpus totals of the keys it asked for; ``sums`` stand in the first row."""
    ends = np.cumsum([r["n"] for r in rows])
    slices = [code[e - r["n"] : e] for e, r in zip(ends, rows, strict=True)]
    some = lambda x: _squeezed(x) if x.any() else None
    out = {"child": pa.array([r["child"] for r in rows], pa.int64()), "node": pa.array([r["node"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int32())}
    out |= {name: pa.array([some(x[at]) for at in slices], pa.binary()) for name, x in (("counted", counted), ("deleted", deleted))}
    out |= {name: pa.array([int(x)] + [0] * (len(rows) - 1), pa.int64()) for name, x in zip(("tokens", "deleted_tokens", "kinds"), sums, strict=True)}
    return pa.table(out)


def _top(table_: pa.Table) -> pa.Table:
    """Of a node of the last step, whose keys occur in no other: the answers, and its share of all and of distinct training tokens."""
    trim()
    rows = table_.to_pylist()
    keys, code, counted, deleted = _joined(rows)
    single = (keys & _ONE) == 0
    return _answers(rows, code, counted, deleted, (counted[single].sum(), deleted[single].sum(), (counted[single] > 0).sum()))


def _totals(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of a child's sorted keys and those of the deleted rows; its runs are answered range by range."""
    rows = sorted(answers.to_pylist(), key=lambda r: r["node"])
    whole = lambda name: np.concatenate([np.zeros(r["n"], np.uint64) if r[name] is None else _spread(r[name], np.uint64, r["n"]) for r in rows])
    return whole("counted"), whole("deleted")


def _upward(ranges: int, fan: int) -> Callable[[pa.Table], pa.Table]:
    """What a node of a step with so many ranges passes on to the next step."""

    def up(table_: pa.Table) -> pa.Table:
        trim()
        rows = table_.to_pylist()
        node = rows[0]["node"]
        keys, _, counted, deleted = _joined(rows)
        return _asked(node, keys, counted, deleted, ranges * fan, node // ranges // fan)

    return up


def _downward(left: pa.Table, right: pa.Table) -> pa.Table:
    """What a node's children asked for, from what the step above answered to it."""
    trim()
    rows = left.to_pylist()
    code = _joined([r | {"counted": None, "deleted": None} for r in rows])[1]
    return _answers(rows, code, *_totals(right))


def _counts(asked: DataFrame, steps: list[int]) -> tuple[DataFrame, DataFrame]:
    """Answers to the batches' keys, and the table whose rows carry the sums over all tokens.

    Up: at each step the groups of ``fan`` children exchange their keys, each range of keys of a group meeting in one node; the
    next step joins ``fan`` groups and cuts each range in ``fan``. So a node gets at most ``fan`` rows whatever the corpus, any
    key comes at most ``fan`` times to one node, and rows grow with batches times steps. Down: each node hands its children
    the totals that the step above gave it.
    """
    levels, ranges = [asked], steps[0]
    for fan in steps[1:]:
        levels[-1] = materialize(levels[-1], "lm-asked")
        levels.append(levels[-1].groupBy("node").applyInArrow(_upward(ranges, fan), ASKED))
        ranges *= fan
    top = answers = materialize(levels.pop().groupBy("node").applyInArrow(_top, ANSWERED), "lm-answers")
    for below in reversed(levels):
        asked_here = below.select("node", "child", "n", "keys").groupBy("node")
        told = answers.select(F.col("child").alias("parent"), "node", "n", "counted", "deleted").groupBy("parent")
        answers = materialize(asked_here.cogroup(told).applyInArrow(_downward, ANSWERED), "lm-answers")
    return answers, top


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the power of two of the frequency."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def learn_weights(cells: np.ndarray) -> np.ndarray:
    """Expectation-maximisation of the mixture weights (pair, token, uniform) of each bucket.

    ``cells``: bucket, log2 of pair and of token estimate over the uniform one in steps (-1 where the estimate is 0), weight.
    """
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not len(cells):
        return weights
    at = cells[:, 0].astype(np.int64)
    ratio = np.column_stack([np.where(cells[:, k] == -1, 0.0, 2.0 ** ((cells[:, k] - OCTAVES * STEPS) / STEPS)) for k in (1, 2)] + [np.ones(len(cells))])
    seen = np.bincount(at, cells[:, 3], minlength=BUCKETS)
    for _ in range(ROUNDS):
        share = weights[at] * ratio
        share *= (cells[:, 3] / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.column_stack([np.bincount(at, share[:, k], minlength=BUCKETS) for k in range(3)])
        # A little mass for each part, so that no bucket calls a word impossible.
        fresh = (sums + [0.0, 0.5, 0.5]) / (seen + 1.0)[:, None]
        weights = np.where(seen[:, None] > 0, fresh, weights)
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def _steps(ratio: np.ndarray) -> np.ndarray:
    exact = np.round(STEPS * (np.log2(np.maximum(ratio, 2.0**-OCTAVES)) + OCTAVES)).astype(np.int64)
    return np.where(ratio > 0, np.clip(exact, 0, 2 * OCTAVES * STEPS), -1)


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, fan: int = FAN) -> DataFrame:
    """One row per input row: the id, ``held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary``.

    A token's probability after the token before it mixes the maximum-likelihood estimates of the pair and of the token
    with 1 / (V + 1); the weights depend on the bucket of the context's frequency. They are learned by
    expectation-maximisation on a deleted part of the training rows, with estimates from the other training rows, and then
    used with the counts of all. A word that training never saw has the uniform part alone, so each context's
    probabilities add up to 1 over V words and one unknown. The first token of a text has the end token as its context.

    Documents are dealt into batches by a hash of id, text and place in the input, so that neither a hot id nor a row repeated
    very often fills one. Each batch asks for its distinct tokens and pairs, as 64-bit
    hashes packed by part; a part adds up what all batches counted and answers each. So every key travels once per batch,
    whatever its frequency, and neither a word nor the counts of the whole corpus meet in one place. (Two of n distinct
    keys share a hash with chance n^2 / 2^64.) Null counts as the empty text: its end token alone. A null id is folded
    as the empty string. Repeated rows count each time and score alike. A text of any length is scored whole, in one batch.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    batches = max(6, -(-text_bytes(docs, text_col) // batch_bytes))
    # A batch is of held-out, deleted or other rows alone, in this order of numbers.
    few = -(-batches // 6)
    steps = fans(2 * few + batches, fan)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), fold(id_col, 10).cast("int").alias("rest"))
    # The place in the input spreads rows that repeat id and text. Both passes need the same batches, so they are written.
    spread = F.xxhash64("id", "text", F.monotonically_increasing_id())
    number = F.when(F.col("rest") == HELD_OUT, F.pmod(spread, F.lit(few))).when(F.col("rest").isin(*DELETED), F.pmod(spread, F.lit(few)) + few)
    rows = materialize(rows.withColumn("batch", number.otherwise(F.pmod(spread, F.lit(batches)) + 2 * few).cast("long")), "lm-rows", "zstd")

    def asked(group: pa.Table) -> pa.Table:
        trim()
        number = group.column("batch")[0].as_py()
        batch = Batch(group.to_batches())
        counts = batch.counts()
        none = np.zeros(len(counts), np.uint64)
        return _asked(number, batch.keys, counts if number >= few else none, counts if few <= number < 2 * few else none, steps[0], number // steps[0])

    answers, top = _counts(rows.select("batch", "text").groupBy("batch").applyInArrow(asked, ASKED), steps)
    sums = top.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "deleted_tokens", "kinds")]).first()
    tokens, kept_tokens, kinds = sums[0], sums[0] - sums[1], sums[2]
    answers = answers.select(F.col("child").alias("batch"), "node", "n", "counted", "deleted")

    def gathered(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        out = {"bucket": [], "pair": [], "token": [], "weight": []}
        if left.num_rows:
            batch = Batch(left.to_batches())
            counted, deleted = _totals(right)
            at, pair, single, _ = batch.estimates((counted - deleted).astype(np.float64), kept_tokens)
            steps = np.stack([at, _steps(pair * (kinds + 1)), _steps(single * (kinds + 1))])
            found, n = np.unique((steps[0] << 40) + ((steps[1] + 1) << 20) + steps[2] + 1, return_counts=True)
            out = {"bucket": found >> 40, "pair": ((found >> 20) & 0xFFFFF) - 1, "token": (found & 0xFFFFF) - 1, "weight": n}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    gone = rows.where(F.col("rest").isin(*DELETED)).select("batch", "text").groupBy("batch")
    held = gone.cogroup(answers.where(F.col("batch").between(few, 2 * few - 1)).groupBy("batch"))
    cells = held.applyInArrow(gathered, "bucket long, pair long, token long, weight long").groupBy("bucket", "pair", "token").agg(F.sum("weight").alias("weight"))
    # At most BUCKETS * (2 * OCTAVES * STEPS + 2)^2 rows, whatever the corpus.
    cells = cells.toPandas().to_numpy(float) if tokens else np.zeros((0, 4))
    weights = learn_weights(cells)

    names = ["id", "rest", "n_tokens", "n_known", "base_score", "score"]
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("rest", T.IntegerType())]
    fields += [T.StructField(n, k) for n, k in zip(names[2:], [T.LongType()] * 2 + [T.DoubleType()] * 2, strict=True)]
    empty = to_arrow_schema(T.StructType(fields)).empty_table()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not left.num_rows:
            return empty
        batch = Batch(left.to_batches())
        at, pair, single, count = batch.estimates(_totals(right)[0].astype(np.float64), tokens)
        w = weights[at]
        model = np.log10(w[:, 0] * pair + w[:, 1] * single + w[:, 2] / (kinds + 1))
        base = np.log10((count + 0.1) / (tokens + 0.1 * (kinds + 1)))
        sums = [np.bincount(batch.row, x, minlength=batch.texts) for x in (np.ones(len(batch.row)), count > 0, base, model)]
        arrays = [left.column("id"), left.column("rest"), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *(pa.array(x) for x in sums[2:])]
        return pa.table(dict(zip(names, arrays, strict=True)))

    out = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(scored, T.StructType(fields))
    return out.select(
        F.col("id").alias(id_col), (F.col("rest") == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", F.lit(kinds).cast("long").alias("vocabulary"),
    )


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
