"""Alignment of two tokenizers' tokens, and corpus-wide counts of the pairs they link, by external spill counting."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candela.llm.common import materialize, pieces, ship, table

#: Text bytes in a slice: its pair-document records are sorted in memory and spilled as one run for each part.
SLICE_BYTES = 3 << 20
#: Parts by the low bits of the A id, and runs that are merged into one.
PARTS, FAN = 32, 32
#: Bits of a pair's code that hold the B id.
B_BITS = 15
#: Chunks of text whose alignment a worker remembers, before the memory starts anew.
REMEMBERED = 400_000
#: Links of a group above which its pairs are counted by distinct ids and not listed one by one.
LARGE = 1 << 16
#: Where neither tokenizer's tokens cross: before a single space between characters that aren't white space.
CHUNK = re.compile(r"(?<=\S) (?=\S)")
ROWS = "part int, slice int, row int, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, heads binary, tails binary"


def spill(*columns: np.ndarray) -> bytes:
    """A run of columns as a zstd frame: their lengths, then their bytes by significance."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(c) for c in columns], "<u8").tobytes() + b"".join(planes))


def unspill(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes, at, out = raw[: 8 * columns].view("<u8").astype(int), 8 * columns, []
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view("<u8").ravel())
        at += 8 * n
    return out


def linked(ids_a: np.ndarray, size_a: np.ndarray, ids_b: np.ndarray, size_b: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Alignment of texts laid end to end, whose tokens of either kind cover the same bytes.

    ``text_ends`` are the places where texts end. Returns the text, code and number of links of the pairs, by text; each
    text's groups as written, every group with its semicolon; and the number of groups of each text.
    """
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    many_a, many_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    text = np.searchsorted(text_ends, common)
    # Every token of A with each of B in its group; groups of very many links by their distinct ids instead.
    large = many_a * many_b > LARGE
    each = np.where(large, 0, many_b)[group_a]
    at = np.repeat((np.cumsum(many_b) - many_b)[group_a] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    code, of = np.repeat(ids_a, each) << B_BITS | ids_b[at], np.repeat(text[group_a], each)
    count = np.ones(len(code), np.int64)
    for g in np.flatnonzero(large).tolist():
        (x, n), (y, m) = (np.unique(ids[group == g], return_counts=True) for ids, group in ((ids_a, group_a), (ids_b, group_b)))
        code, of = np.append(code, (x[:, None] << B_BITS | y).ravel()), np.append(of, np.full(len(x) * len(y), text[g]))
        count = np.append(count, (n[:, None] * m).ravel())
    if large.any():
        order = np.argsort(of, kind="stable")
        code, of, count = code[order], of[order], count[order]
    # Each id is written with what follows it: a comma inside a group, else a bar or a semicolon.
    place_a = np.arange(len(ids_a)) + (np.cumsum(many_b) - many_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(many_a)[group_b]
    shown = np.empty(len(ids_a) + len(ids_b), object)
    for place, ids, group, end in ((place_a, ids_a, group_a, "|"), (place_b, ids_b, group_b, ";")):
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        shown[place] = [f"{i}{end if x else ','}" for i, x in zip(ids.tolist(), last.tolist(), strict=True)]
    size = np.bincount(text, many_a + many_b, minlength=len(text_ends)).astype(np.int64)
    pieces_, stops = shown.tolist(), np.cumsum(size).tolist()
    groups = ["".join(pieces_[start:stop]) for start, stop in zip([0, *stops], stops, strict=False)]
    return of, code, count, groups, np.bincount(text, minlength=len(text_ends))


class Aligner:
    """Both tokenizers, and the alignments of the chunks that were seen lately."""

    def __init__(self, byte_level: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(byte_level, encoding="utf-8") as f:
            text = f.read()
        self.a = Tokenizer.from_str(text)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = [chr(k) for k in (*range(33, 127), *range(161, 173), *range(174, 256))]
        bytes_of = {c: ord(c) for c in letters} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if chr(k) not in letters)}
        vocabulary = json.loads(text)["model"]["vocab"]
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = b"" if i in self.a.get_added_tokens_decoder() else bytes(bytes_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if len(self.bytes_a) > 1 << (32 - B_BITS) or len(names) > 1 << B_BITS:
            raise ValueError("the vocabularies are too large for the codes of pairs")
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece goes over the start of a word, so texts can't be encoded chunk by chunk")
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = [array("q") for _ in range(4)]  # tokens of A, tokens of B, groups, links
        self.pairs, self.counts, self.ends = array("q"), array("q"), array("q")

    def add(self, texts: list[str]) -> list[int]:
        """Align texts, a space before each; the entry of each text, -1 where a tokenizer's tokens don't give its bytes back."""
        own_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        own_b = self.b.encode(texts, num_threads=1)
        whole = [(" " + t).encode() for t in texts]
        laid, good = self._laid(own_a, own_b, whole), range(len(texts))
        if laid is None:
            good = [k for k in good if self._laid([own_a[k]], [own_b[k]], [whole[k]])]
            laid = self._laid(*([own[k] for k in good] for own in (own_a, own_b, whole)))
        many_a, ids_a, many_b, ids_b, ends = laid
        of, code, count, groups, number = linked(ids_a, self.size_a[ids_a], ids_b, self.size_b[ids_b], ends)
        out, first, before = [-1] * len(texts), len(self.groups), self.ends[-1] if self.ends else 0
        for k, place in enumerate(good):
            out[place] = first + k
        self.groups += groups
        links = np.bincount(of, count, minlength=len(ends))
        stops = before + np.cumsum(np.bincount(of, minlength=len(ends)))
        for kept, new in zip((*self.sizes, self.pairs, self.counts, self.ends), (many_a, many_b, number, links, code, count, stops), strict=True):
            kept.frombytes(np.asarray(new, np.int64).tobytes())
        return out

    def _laid(self, own_a: list[list[int]], own_b: list[list[int]], whole: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """Tokens of both kinds laid end to end, how many each text has, and where texts end in bytes; None unless every text's
        tokens give its bytes back."""
        ends, joined, out = np.cumsum([len(w) for w in whole], dtype=np.int64), b"".join(whole), []
        for own, bytes_, size in ((own_a, self.bytes_a, self.size_a), (own_b, self.bytes_b, self.size_b)):
            many = np.array([len(x) for x in own], np.int64)
            ids = np.fromiter(chain.from_iterable(own), np.int64, int(many.sum()))
            if not many.all() or not np.array_equal(np.cumsum(size[ids])[np.cumsum(many) - 1], ends) or b"".join(map(bytes_.__getitem__, ids.tolist())) != joined:
                return None
            out += [many, ids]
        return (*out, ends)

    def chunked(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all texts' chunks, and how many each text has. Tokens of either kind never cross from one chunk to
        the next, so the groups of a text are those of its chunks. A text whose chunks don't all give their bytes back is
        aligned as a whole, and has no chunk if that fails as well."""
        if len(self.place) > REMEMBERED:
            self.forget()
        split = [CHUNK.split(t) if t else [] for t in texts]
        new = list({c for own in split for c in own if c not in self.place})
        if new:
            self.place.update(zip(new, self.add(new), strict=True))
        rows = [list(map(self.place.__getitem__, own)) for own in split]
        for k, row in enumerate(rows):
            if -1 in row:
                whole = self.add([texts[k]])[0]
                rows[k] = [] if whole < 0 else [whole]
        many = np.array([len(r) for r in rows], np.int64)
        return np.fromiter(chain.from_iterable(rows), np.int64, int(many.sum())), many

    def facts(self, entries: np.ndarray, many: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
        """Of each text its tokens of A and B, groups and links, and the digest of its groups."""
        row, stops = np.repeat(np.arange(len(many)), many), np.cumsum(many).tolist()
        sums = [np.bincount(row, np.frombuffer(x, np.int64)[entries], minlength=len(many)).astype(np.int64) if len(entries) else np.zeros(len(many), np.int64) for x in self.sizes]
        shown = list(map(self.groups.__getitem__, entries.tolist()))
        digests = [hashlib.sha256("".join(shown[a:b])[:-1].encode()).hexdigest() if a < b else "" for a, b in zip([0, *stops], stops, strict=False)]
        return sums, digests

    def records(self, entries: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, row and number of links of each pair in each row, by pair and then row."""
        if not len(entries):
            return (np.zeros(0, np.int64),) * 3
        used, code = np.unique(entries, return_inverse=True)
        held, times = np.unique(np.repeat(np.arange(len(many)), many) * len(used) + code, return_counts=True)
        row, entry = held // len(used), used[held % len(used)]
        ends = np.frombuffer(self.ends, np.int64)
        starts = np.where(entry > 0, ends[entry - 1], 0)
        each = ends[entry] - starts
        at = np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        key = np.frombuffer(self.pairs, np.int64)[at].astype(np.uint64) << np.uint64(32) | np.repeat(row, each).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, links = key[order], (np.frombuffer(self.counts, np.int64)[at] * np.repeat(times, each))[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return (key[first] >> np.uint64(32)).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.add.reduceat(links, first)


@lru_cache(maxsize=1)
def _loaded(byte_level: str, piece_model: str) -> Aligner:
    return Aligner(SparkFiles.get(byte_level), SparkFiles.get(piece_model))


def _encoder(byte_level: str, piece_model: str, kind: str, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, number = _loaded(byte_level, piece_model), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in pieces(whole, "text", slice_bytes):
                entries, many = aligner.chunked(batch.column("text").to_pylist())
                sums, digests = aligner.facts(entries, many)
                pair, row, links = aligner.records(entries, many)
                radix = (pair >> B_BITS) & (PARTS - 1)
                runs = []
                for k in np.unique(radix).tolist():
                    own = np.flatnonzero(radix == k)
                    first = np.flatnonzero(np.concatenate([[True], pair[own][1:] != pair[own][:-1]]))
                    runs.append((k, spill(pair[own][first], np.diff(np.append(first, len(own)))), spill(row[own], links[own])))
                n, m = batch.num_rows, len(runs)
                place = [pa.array(np.full(n + m, x, np.int32)) for x in (part, number)]
                facts = [pa.array([*s.tolist(), *[None] * m], pa.int64()) for s in sums]
                ids = pa.concat_arrays([batch.column("id"), pa.nulls(m, batch.column("id").type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *place, pa.array([*range(n), *[None] * m], pa.int32()), ids, *facts, pa.array([*digests, *[None] * m], pa.string()),
                        *[pa.array([*[None] * n, *[r[k] for r in runs]], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                    ],
                    names=[x.split()[0] for x in kind.split(", ")],
                )
                number += 1

    return run


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of pairs and counts as one: a heap of the runs' next pairs gives equal pairs one after the other."""

    def entries(pairs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
        for at in range(0, len(pairs), 4096):
            yield from zip(pairs[at : at + 4096].tolist(), counts[at : at + 4096].tolist(), strict=True)

    out, sums, last = [], [], -1
    for pair, count in heapq.merge(*[entries(*r) for r in runs]):
        if pair == last:
            sums[-1] += count
        else:
            out.append(pair)
            sums.append(count)
            last = pair
    return np.array(out, np.int64), np.array(sums, np.int64)


def highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is its A id's highest: pairs come by A id, so the maxima are those of neighbours."""
    if not len(pairs):
        return np.zeros(0, np.int64)
    side = pairs >> B_BITS
    first = np.concatenate([[True], side[1:] != side[:-1]])
    top = np.maximum.reduceat(counts, np.flatnonzero(first))
    return (counts == top[np.cumsum(first) - 1]).astype(np.int64)


def _merger(last: bool):
    def run(group: pa.Table) -> pa.Table:
        pairs, counts = merge_runs([tuple(x.astype(np.int64) for x in unspill(r, 2)) for r in group.column("run").to_pylist()])
        columns = (pairs, counts, highest(pairs, counts)) if last else (pairs, counts)
        return pa.table({"radix": group.column("radix")[:1], "block": group.column("above")[:1], "run": pa.array([spill(*columns)], pa.binary())})

    return run


def _handed_down(above: pa.Table, below: pa.Table) -> pa.Table:
    """From the totals of a merged run to those of the pairs of each run that went into it."""
    if not above.num_rows:
        raise ValueError("runs came without their totals")
    pairs, counts, best = unspill(above.column("run")[0].as_py(), 3)
    out = []
    for run in below.column("run").to_pylist():
        own = unspill(run, 2)[0]
        at = np.searchsorted(pairs, own)
        out.append(spill(own, counts[at], best[at]))
    return pa.table({"radix": below.column("radix"), "block": below.column("block"), "run": pa.array(out, pa.binary())})


def _contributed(slices: pa.Table, totals: pa.Table) -> pa.Table:
    """Of one slice: each row with what its links' totals come to."""
    facts = slices.filter(pa.compute.is_null(slices.column("radix"))).sort_by("row")
    runs = slices.filter(pa.compute.is_valid(slices.column("radix")))
    answers = dict(zip(totals.column("radix").to_pylist(), totals.column("run").to_pylist(), strict=True))
    sums, bests = np.zeros(facts.num_rows, np.int64), np.zeros(facts.num_rows, np.int64)
    for radix, heads, tails in zip(*[runs.column(c).to_pylist() for c in ("radix", "heads", "tails")], strict=True):
        many = unspill(heads, 2)[1].astype(np.int64)
        row, links = (x.astype(np.int64) for x in unspill(tails, 2))
        _, counts, best = (x.astype(np.int64) for x in unspill(answers[radix], 3))
        np.add.at(sums, row, links * np.repeat(counts, many))
        np.add.at(bests, row, links * np.repeat(best, many))
    names = ["id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table({**{n: facts.column(n) for n in names}, "n_best": pa.array(bests), "count_sum": pa.array(sums), "groups_sha256": facts.column("groups_sha256")})


def aligned(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", byte_level: str | None = None, piece_model: str | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row per input row: the id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A text is encoded by both tokenizers, a space before it. Where tokens of both end at one byte, a group ends; the tokens
    of a group are linked each with each. A pair's count is the number of rows that hold it linked.

    Each slice of texts spills its pair-document records, sorted by A id, B id and row, as zstd runs, one for each part of
    the A ids. Runs of a part are merged, ``FAN`` at a time, until there is one; its order by A id gives the maxima. The
    totals go back the way the runs came, to the slices, whose rows add them up. A frequent id is one entry of a run here,
    whatever number of rows holds it, so no task grows with its frequency.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty
    digest. A text of any length is encoded whole. Repeated rows count once each; null ids come out as they are. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    if byte_level is None or piece_model is None:
        import public_tokenizers

        byte_level, piece_model = byte_level or public_tokenizers.path("byte_bpe_50k.json"), piece_model or public_tokenizers.path("piece_bpe_32k.model")
    for path in (byte_level, piece_model):
        spark.sparkContext.addFile(path)
    names = [p.rsplit("/", 1)[-1] for p in (byte_level, piece_model)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = ROWS.format(id=rows.schema["id"].dataType.simpleString())
    made = materialize(rows.mapInArrow(_encoder(*names, kind, slice_bytes), kind), "align-slices")
    size = made.agg(F.max("part").alias("part"), F.max("slice").alias("slice")).first()
    most = 1 + (size["slice"] or 0)
    made = made.withColumn("block", F.col("part").cast("long") * most + F.col("slice")).drop("part", "slice")
    blocks = (1 + (size["part"] or 0)) * most
    levels = [made.where("radix IS NOT NULL").select("radix", "block", F.col("heads").alias("run"))]
    above = F.floor(F.col("block") / FAN).alias("above")
    while True:
        blocks = -(-blocks // FAN)
        merged = levels[-1].select("*", above).groupBy("radix", "above").applyInArrow(_merger(blocks == 1), "radix int, block long, run binary")
        levels.append(materialize(merged, "align-runs"))
        if blocks == 1:
            break
    totals = levels.pop()
    while levels:
        below = levels.pop().select("*", above).groupBy("radix", "above")
        totals = materialize(totals.withColumnRenamed("block", "above").groupBy("radix", "above").cogroup(below).applyInArrow(_handed_down, "radix int, block long, run binary"), "align-totals")
    out = f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    found = made.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_contributed, out)
    return found.withColumnRenamed("id", id_col)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
