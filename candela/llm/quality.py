"""Quality by compression: zstandard dictionaries of good and of bad texts, the difference of compressed sizes as a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import fold, materialize, pieces, ship, table, text_of

#: Labelled rows of each class that are read at most, those with the least hash of their id.
SAMPLE = 4_000
#: Pieces of a sampled text that a dictionary is trained on at most, evenly spaced over the whole text, and their bytes.
PIECES, PIECE_BYTES = 8, 2_000
#: Bytes of a dictionary, and the level at which dictionaries are used.
DICTIONARY_BYTES, LEVEL = 256 << 10, 6
#: Bytes of text that are compressed at once. Small blocks keep a text from becoming its own dictionary.
BLOCK = 256
#: Rows with at least this score are predicted good.
THRESHOLD = 0.5
#: Text bytes that are scored at once.
SLICE_BYTES = 3 << 20


@dataclass(frozen=True)
class Model:
    """Dictionaries of the two classes, and the logistic scale: offset and slope."""

    good: bytes
    bad: bytes
    scale: tuple[float, float] = (0.0, 0.0)


def spaced(text: str) -> list[bytes]:
    """Pieces of a text: all of them, or ``PIECES`` at even distances."""
    data = text.encode("utf-8", "surrogatepass")
    starts = range(0, len(data), PIECE_BYTES)
    chosen = starts if len(starts) <= PIECES else [starts[round(k * (len(starts) - 1) / (PIECES - 1))] for k in range(PIECES)]
    return [data[k : k + PIECE_BYTES] for k in chosen]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; of samples too few to train on, their bytes themselves."""
    samples = sorted(samples)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **bare)
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, **bare)


def differences(good: bytes, bad: bytes, texts: pa.Array) -> np.ndarray:
    """Of each text ``(bad - good) / (bad + good)``, its compressed sizes with the two dictionaries; 0 of an empty one."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros(len(texts))
    for row, text in enumerate(texts.to_pylist()):
        data = (text or "").encode("utf-8", "surrogatepass")
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        a, b = sum(len(by_good(x)) for x in blocks), sum(len(by_bad(x)) for x in blocks)
        out[row] = (b - a) / (a + b) if blocks else 0.0
    return out


def calibrated(scale: tuple[float, float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] + scale[1] * x, -30, 30)))


def fit_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one input by Newton steps with a little ridge; the slope isn't below 0."""
    z, w = np.column_stack([np.ones(len(x)), x * 10]), np.zeros(2)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(max(w[1], 0.0) * 10)


def _trained(group: pa.Table) -> pa.Table:
    samples = [x for text in group.column("text").to_pylist() for x in spaced(text)]
    return pa.table({"quality": group.column("quality")[:1], "half": group.column("half")[:1], "content": pa.array([dictionary(samples)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows whose ``crc32(id) mod 3`` is not 1: at most ``sample`` of each class, each text once.

    The scale is learned on differences that dictionaries of the other half of the sample gave; rows weigh as much as
    their class has labelled rows for each sampled one. Of contradicting labels the more frequent counts, of as many the
    good one; labels without a class or document are passed over. Without rows of both classes every score is 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).where(fold("id", 3) != 1)
    near = F.xxhash64("id")
    chosen = [known.where(F.col("quality") == k).orderBy(near, "id").limit(sample) for k in (0, 1)]
    # At most 2 * sample rows of two short columns: a bound that doesn't grow with the tables.
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")
    rows = rows.where("text != ''").groupBy(F.sha2("text", 256).alias("digest")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"), F.max("text").alias("text"))
    rows = materialize(rows.select("text", "quality", F.pmod(F.xxhash64("digest"), F.lit(2)).cast("int").alias("half")), "quality-sample")
    parts = rows.unionByName(rows.withColumn("half", F.lit(-1)))
    made = {(r["quality"], r["half"]): bytes(r["content"]) for r in parts.groupBy("quality", "half").applyInArrow(_trained, "quality int, half int, content binary").collect()}
    if not {(0, -1), (1, -1)} <= made.keys():
        return Model(b"", b"")
    pairs = {half: tuple(made.get((k, 1 - half), made[k, -1]) for k in (1, 0)) for half in (0, 1)}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                half = np.asarray(batch.column("half"))
                x = np.where(half == 0, *(differences(*pairs[k], batch.column("text")) for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(x)], names=["quality", "x"])

    seen = rows.mapInArrow(measured, "quality int, x double").toPandas()
    all_ = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    y = seen["quality"].to_numpy().astype(float)
    weight = np.where(y == 1, all_.get(1, 0) / max(1, (y == 1).sum()), all_.get(0, 0) / max(1, (y == 0).sum()))
    return Model(made[1, -1], made[0, -1], fit_scale(seen["x"].to_numpy(), y, weight / weight.mean()))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: the id, ``held_out, score, predicted, difference``.

    Every text is cut into small blocks, which are compressed with a dictionary trained on good texts and with one trained
    on bad texts. The difference of the two sizes over their sum, on a logistic scale learned on labelled rows, is the
    score. Label, language, source and id are no inputs. Null counts as the empty text, whose difference is 0. A text of any
    length is scored whole, block by block. Equal texts get equal scores; null ids come out as they are. Other columns
    change nothing, an empty table gives an empty result, and without labels of both classes every score is 0.5.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for batch in pieces(whole, "text", SLICE_BYTES):
                x = differences(m.good, m.bad, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(calibrated(m.scale, x)), pa.array(x)], names=["id", "score", "difference"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, difference double")
    return scored.select(
        F.col("id").alias(id_col), (fold("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference"
    )


def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
