"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code, control bytes apart from data bytes."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import fresh_path, materialize, pieces, ship, table, text_bytes, text_of

#: Bytes of text in a file, about, and at most in a block of it.
FILE_BYTES, BLOCK_BYTES = 24 << 20, 16 << 20
#: Pieces that the library encodes as one text, and such texts in one call.
JOINED, CALL = 500, 40
#: Encoded pieces that a worker keeps for its next batches.
KEPT = 300_000
#: A block, little-endian: this head; a long and a null flag per document; ids per document; ids by rank; control; data.
#: The head: magic, file, block, documents, ranks, ids, data bytes, ids of the file before this block, bits of a length code.
HEAD = struct.Struct("<8sIIIIQQQB")
MAGIC = b"FRQVBYT1"
#: Files whose ids are summed as one when the start of a file is computed.
CHUNK = 1000


def _lengths(bits: int) -> np.ndarray:
    """For each control byte the byte lengths of the ids it stands for, first id in the lowest bits."""
    shifts = np.arange(0, 8, bits)
    return ((np.arange(256)[:, None] >> shifts) & ((1 << bits) - 1)) + 1


TABLES = {bits: _lengths(bits) for bits in (1, 2)}


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids by rank (most frequent first, then least id), control bytes, data bytes, bits of a length code.

    A rank takes as many bytes as it needs. With up to 65,536 ranks that is one or two, told by one bit, else two bits tell.
    """
    every = np.bincount(ids)  # as long as the vocabulary at most
    known = np.flatnonzero(every)
    order = np.lexsort((known, -every[known]))
    rank = np.zeros(len(every), np.int32)
    rank[known[order]] = np.arange(len(known))
    ranks = rank[ids]
    bits = 1 if len(known) <= 1 << 16 else 2
    length = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24) + np.uint8(1)
    per = 8 // bits
    padded = np.zeros(-(-len(ranks) // per) * per, np.uint8)
    padded[: len(ranks)] = length - 1
    control = (padded.reshape(-1, per) << np.arange(0, 8, bits, dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    at = np.cumsum(length, dtype=np.int64) - length
    data = np.zeros(int(length.sum(dtype=np.int64)), np.uint8)
    for k in range(int(length.max(initial=1))):
        some = np.flatnonzero(length > k) if k else slice(None)
        data[at[some] + k] = (ranks[some] >> (8 * k)) & 255
    return known[order].astype(np.uint32), control, data, bits


def decode_ids(by_rank: np.ndarray, control: np.ndarray, data: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The ids again: lengths by table lookup of control bytes, places by their running sum."""
    length = TABLES[bits][control].ravel()[:count]
    at = np.cumsum(length) - length
    ranks = np.zeros(count, np.int64)
    for k in range(4):
        some = np.flatnonzero(length > k)
        if not len(some):
            break
        ranks[some] |= data[at[some] + k].astype(np.int64) << (8 * k)
    return by_rank[ranks]


def pack(ids: np.ndarray, counts: np.ndarray, names: np.ndarray, nulls: np.ndarray, part: int, block: int, before: int) -> bytes:
    by_rank, control, data, bits = encode_ids(ids)
    head = HEAD.pack(MAGIC, part, block, len(names), len(by_rank), len(ids), len(data), before, bits)
    arrays = (names.astype("<i8"), nulls.astype(np.uint8), counts.astype("<u4"), by_rank.astype("<u4"), control, data)
    return head + b"".join(x.tobytes() for x in arrays)


def unpack(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """File, block, ids before it in the file, document ids, their nulls, ids per document, all ids: of each block."""
    at = 0
    while at < len(content):
        magic, part, block, docs, ranks, count, size, before, bits = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block starts at byte {at}")
        at += HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, kind, n, at)
            at += found.nbytes
            return found

        names, nulls, counts, by_rank = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", ranks)
        control, data = take("u1", -(-count * bits // 8)), take("u1", size)
        yield part, block, before, names, nulls, counts, decode_ids(by_rank, control, data, bits, count)
        if content[at : at + 1] != b"\n":
            raise ValueError(f"the block before byte {at} doesn't end")
        at += 1


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(SparkFiles.get(name))
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def _token_bytes(tokenizer) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for: a character each, but for special tokens."""
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        out[k] = len(token)
    for k, token in tokenizer.get_added_tokens_decoder().items():
        out[k] = len(token.content.encode())
    return out


def _alone(tokenizer, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids per text and all ids."""
    found = [np.zeros(0, np.int32)]
    for at in range(0, len(wanted), CALL):
        found += [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(wanted[at : at + CALL], add_special_tokens=False)]
    return np.fromiter(map(len, found[1:]), np.int32, len(wanted)), np.concatenate(found)


def _joined(tokenizer, lengths: np.ndarray, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids per piece and all ids, of pieces that each stand after a space: ``JOINED`` are encoded as one text, and told apart by bytes."""
    cuts = np.append(np.arange(0, len(wanted), JOINED), len(wanted))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), wanted), pa.scalar(" ", wanted.type)).to_pylist()
    _, flat = _alone(tokenizer, [" " + x for x in texts])
    ends = np.cumsum(np.asarray(pc.binary_length(wanted)) + 1)
    owner = np.searchsorted(ends, np.cumsum(lengths[flat]) - 1, side="right")
    return np.bincount(owner, minlength=len(ends)).astype(np.int32), flat


class PieceEncoder:
    """Ids of whole texts as the library encodes them, with a table of encoded pieces kept from one batch to the next.

    For a byte-level vocabulary a space before another character always starts a new pre-token. Texts are cut there, each
    distinct piece is encoded once, and pieces that occur again stay in a table of ``most`` pieces at most.
    """

    def __init__(self, tokenizer, most: int = KEPT):
        self.tokenizer, self.most, self.lengths = tokenizer, most, _token_bytes(tokenizer)
        self.pieces = pa.array([], pa.large_string())
        self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _looked_up(self, used: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot of each used piece, and sizes and ids of all slots: those of the table, then those encoded now."""
        slot = np.array(pc.fill_null(pc.index_in(used, value_set=self.pieces), -1))
        fresh = np.flatnonzero(slot < 0)
        sizes, flat = _joined(self.tokenizer, self.lengths, used.take(pa.array(fresh)))
        slot[fresh] = len(self.sizes) + np.arange(len(fresh))
        found = slot, np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        keep = np.flatnonzero(counts[fresh] > 1)[: self.most - len(self.pieces)]
        if len(keep):
            chosen = np.zeros(len(fresh), bool)
            chosen[keep] = True
            self.pieces = pa.concat_arrays([self.pieces, used.take(pa.array(fresh[keep]))])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes[keep]]), np.concatenate([self.flat, flat[np.repeat(chosen, sizes)]])
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids per text, ``end_id`` included, and all ids. Null counts as the empty text."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, leading = np.asarray(coded.indices), offsets[:-1]  # every text has a first piece, without a space before it
        heads = pc.utf8_slice_codeunits(coded.dictionary, 0, 1).dictionary_encode()
        # A piece that is empty or starts with white space belongs to the one before it: such texts are encoded whole.
        odd = np.array([not c or c.isspace() for c in heads.dictionary.to_pylist()], bool)[np.asarray(heads.indices)]
        loose = odd[codes]
        loose[leading] = False
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(loose), side="right") - 1)
        parts = coded.dictionary
        del lists, coded, loose
        split = np.ones(len(texts), bool)
        split[whole] = False
        inner = np.repeat(split, np.diff(offsets))
        inner[leading] = False
        counts = np.bincount(codes[inner], minlength=len(parts))
        used = np.flatnonzero(counts)
        slot, sizes, flat = self._looked_up(parts.take(pa.array(used)), counts[used])
        first, where = np.unique(codes[leading], return_inverse=True)
        alone, alone_flat = _alone(self.tokenizer, parts.take(pa.array(first)).to_pylist() + texts.take(pa.array(whole)).to_pylist())
        none = len(sizes) + len(alone)
        by_code = np.full(len(parts), none, np.int32)
        by_code[used] = slot
        entry = by_code[codes]
        if len(whole):
            entry[~inner] = none  # the pieces of texts that are encoded whole, and, for now, first pieces
        entry[leading] = len(sizes) + where
        entry[leading[whole]] = len(sizes) + len(first) + np.arange(len(whole))
        sizes = np.concatenate([sizes, alone, np.zeros(1, np.int32)])
        flat = np.concatenate([flat, alone_flat, np.zeros(1, np.int32)])
        begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        n = sizes[entry]
        n[offsets[1:] - 1] += 1  # room for the end id
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(begin[entry] - (ends - n), n)
        at += np.arange(len(at), dtype=np.int32)
        out = flat[at]
        last = ends[offsets[1:] - 1]
        out[last - 1] = end_id
        return np.diff(last, prepend=0).astype(np.int64), out


@lru_cache(maxsize=1)
def _encoder(name: str) -> PieceEncoder:
    return PieceEncoder(_tokenizer(name))


def write_token_files(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2,
) -> None:
    """Write the ids of all documents, each with ``end_id`` at its end, in ascending order of the document id (a long).

    Documents are range-partitioned by id, then by a hash of the text and their place in the input, so that neither an id of
    very many rows nor a row repeated very often lands in one task. Null ids come first; rows of one id stand by hash, then
    text, the same in every run. Each task writes one file of self-contained blocks, in which ids are numbered by their
    frequency in the block. Null texts count as empty: the end id alone. Special strings that stand in a text are matched as
    the library does. A text of any length is one document; it may make a block longer than ``BLOCK_BYTES``. Other columns are
    ignored; an empty table gives files without blocks. Spark's text writer commits the files (a block is a line of bytes;
    its head says where it ends).
    """
    spark = docs.sparkSession
    ship(spark)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    files = max(8, -(-text_bytes(docs, text_col) // FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumns({"mark": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    order = F.col("id").asc_nulls_first()
    rows = rows.repartitionByRange(files, order, "mark", "spread").sortWithinPartitions(order, "mark", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        for batch in (b for whole in batches for b in pieces(whole, "text", BLOCK_BYTES)):
            counts, ids = _encoder(name).encode(batch.column("text"), end_id)
            nulls = np.asarray(pc.is_null(batch.column("id")))
            packed = pack(ids, counts, np.asarray(pc.fill_null(batch.column("id"), 0)), nulls, part, block, before)
            block, before = block + 1, before + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])

    rows.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.text(path, lineSep="\n")


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    ship(spark)
    fields = [("part", T.LongType()), ("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.ArrayType(T.LongType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for part, _, before, names, nulls, counts, ids in unpack(content.as_py()):
                    ends = np.cumsum(counts.astype(np.int64))
                    starts = ends - counts
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    arrays = [
                        pa.array(np.full(len(names), part, np.int64)), pa.array(names, mask=nulls.astype(bool)), pa.array(starts + before),
                        pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()),
                    ]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in fields])), "token-rows")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("chunk", F.floor(F.col("part") / CHUNK))
    # Running sums over the files of a chunk, in parallel, and over one row per chunk.
    before = lambda w: F.sum("n").over(w) - F.col("n")
    inside = totals.withColumn("inside", before(Window.partitionBy("chunk").orderBy("part")))
    chunks = totals.groupBy("chunk").agg(F.sum("n").alias("n")).select("chunk", before(Window.orderBy("chunk")).alias("before"))
    offsets = inside.join(chunks, "chunk").select("part", (F.col("inside") + F.col("before")).alias("before"))
    return rows.join(offsets, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def op6_frequency_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_token_files(spark, path, with_ids=False)
