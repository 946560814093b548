"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from candela.llm.common import pieces, ship, table, text_of, words

#: A final character stands for itself plus the end of its word; it is told from an inner one by this shift.
FINAL = 0x1000
#: Characters on which lower-casing, composing and splitting are the same here and in the library: printable Latin ones.
PLAIN = regex.compile("[!-~\u00a1-\u024f]+")
#: Pairs of tokens whose fit is remembered at most, before the memory starts anew.
REMEMBERED = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTrieBpe:
    """A word-level BPE vocabulary with an end-of-word mark, encoding many words at once.

    The last token of the encoding of a prefix is a state of the prefix alone: it is the one token that ends there and
    that fits the state where it starts. A depth-first walk over the trie of the words passes these states down, so a
    prefix that many words share is encoded once.
    """

    def __init__(self, vocabulary: str):
        """``vocabulary``: the text of the tokenizer's file."""
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(vocabulary)["model"]
        mark = model["end_of_word_suffix"]
        if not mark or model["continuing_subword_prefix"]:
            raise ValueError("the vocabulary must mark word ends and nothing else")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        steps = json.loads(vocabulary)
        split = steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [x["type"] for x in (*steps["normalizer"]["normalizers"], *steps["pre_tokenizer"]["pretokenizers"])]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError(f"steps of another kind of tokenizer: {kinds}")
        self.split = regex.compile(f"{split}|\n")
        letters = [chr(k) for k in (*range(33, 127), *range(161, 173), *range(174, 256))]
        shown = {ord(c): c for c in letters} | {k: chr(256 + n) for n, k in enumerate(k for k in range(256) if chr(k) not in letters)}
        self.shown = str.maketrans(shown)  # bytes as the byte-level vocabulary writes them

        def own(token: str) -> str:
            return token[: -len(mark) - 1] + chr(ord(token[-len(mark) - 1]) + FINAL) if token.endswith(mark) and token != mark else token

        self.names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        ids = {own(t): i for t, i in model["vocab"].items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(own, pair if isinstance(pair, list) else pair.split(" "))
            self.rank.setdefault((left, right), rank)
            self.parts.setdefault(left + right, (left, right, rank))
        self.known: dict[tuple[str, str], bool] = {}
        reached: dict[str, bool] = {}
        for token in sorted(ids, key=len):
            if len(token) == 1:
                reached[token] = True
            elif token in self.parts:
                left, right, rank = self.parts[token]
                reached[token] = reached.get(left, False) and reached.get(right, False) and not self._merges_across(left, right, rank)
        self.ids = {t: ids[t] for t, ok in reached.items() if ok}
        ends: dict[str, set[int]] = {}
        for token in self.ids:
            ends.setdefault(token[-3:], set()).add(len(token))
        #: By the last three characters: lengths of the tokens that may end there, longest first.
        self.lengths = {end: (*sorted((n for n in found if n > 2), reverse=True), 2, 1) for end, found in ends.items() if len(end) == 3}

    def _merges_across(self, left: str, right: str, before: float) -> bool:
        """Whether a merge of a rank below ``before`` joins the end of ``left`` to the start of ``right`` while both form.

        The end of ``left`` is held by ever longer tokens as its merges come; one of rank r can be joined across only by a
        merge that comes before the one that takes it in. Of equal ranks the leftmost goes first.
        """
        end, end_until = left, before
        while True:
            start, start_until = right, before
            while True:
                rank = self.rank.get((end, start))
                if rank is not None and rank < before and rank < end_until and rank <= start_until:
                    return True
                if start not in self.parts or len(start) == 1:
                    break
                start, _, start_until = self.parts[start]
            if end not in self.parts or len(end) == 1:
                return False
            _, end, end_until = self.parts[end]

    def fits(self, left: str, right: str) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[left, right] = not self._merges_across(left, right, float("inf"))
        return found

    def encode_words(self, distinct: list[str]) -> dict[str, list[int]]:
        """Ids of each word (of characters that stand for bytes).

        Words in sorted order are the trie in depth-first order: the nodes that a word adds are those past the prefix it
        shares with the word before, and the states of the path to it are still at hand.
        """
        out: dict[str, list[int]] = {}
        ids, known, fits, lengths = self.ids, self.known, self.fits, self.lengths
        last: list[str] = [""]
        before = ""
        for path, word in sorted([(w[:-1] + chr(ord(w[-1]) + FINAL), w) for w in distinct]):
            same = 0
            for a, b in zip(path, before, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(path) + 1):
                for length in lengths.get(path[end - 3 : end], (2, 1)) if end > 2 else range(end, 0, -1):
                    start = end - length
                    token = path[start:end]
                    if start >= 0 and token in ids:
                        if not start:
                            break
                        fit = known.get((last[start], token))
                        if fit or fit is None and fits(last[start], token):
                            break
                else:
                    raise ValueError(f"no token ends at {end} of {path!r}")
                last.append(token)
            token_ids, end = [], len(path)
            while end:
                token = last[end]
                token_ids.append(ids[token])
                end -= len(token)
            token_ids.reverse()
            out[word] = token_ids
            before = path
        return out

    def words_of(self, chunks: list[str]) -> list[list[str] | None]:
        """The words of each chunk, lower-cased and split as the library does; None if a special string stands in it."""
        out: list[list[str] | None] = []
        plain = [bool(PLAIN.fullmatch(c)) for c in chunks]
        found = self.split.findall("\n".join([c for c, ok in zip(chunks, plain, strict=True) if ok]).lower())
        found.append("\n")
        shown, at = {}, 0
        normal, split = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        for chunk, ok in zip(chunks, plain, strict=True):
            own: list[str] | None = []
            if ok:
                while (word := found[at]) != "\n":
                    if not word.isascii():
                        word = shown.get(word) or shown.setdefault(word, word.encode().decode("latin-1").translate(self.shown))
                    own.append(word)
                    at += 1
                at += 1
            else:
                own = [w for w, _ in split(normal(chunk))]
            out.append(None if "<" in chunk and any(s in chunk for s in self.special) else own)
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk of text without white space, as the library encodes it."""
        plain = self.words_of(chunks)
        ids = self.encode_words(list({w for own in plain if own for w in own}))
        return [
            self.library.encode(c, add_special_tokens=False).ids if own is None else ids[own[0]] if len(own) == 1 else [i for w in own for i in ids[w]]
            for c, own in zip(chunks, plain, strict=True)
        ]

    def run(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, the ids as decimals joined by a space, and the decoded text."""
        offsets, codes, distinct = words(texts, lower=False)
        encoded = self.encode_chunks(distinct.to_pylist())
        count = [len(x) for x in encoded]
        numbers = [" ".join(map(str, x)) for x in encoded]
        decoded = [" ".join([self.names[i] for i in x]) for x in encoded]
        gaps = not all(count)
        for start, end in zip(offsets[:-1], offsets[1:], strict=True):
            own = codes[start:end].tolist()
            if gaps:
                own = [k for k in own if count[k]]
            yield sum([count[k] for k in own]), " ".join([numbers[k] for k in own]), " ".join([decoded[k] for k in own])


@lru_cache(maxsize=2)
def _loaded(name: str) -> WordTrieBpe:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return WordTrieBpe(f.read())


def _ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the vocabulary's file to every executor; its size is fixed."""
    ship(spark)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def bpe_round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: the id, ``ids`` (array of int) and ``decoded``.

    As the tokenizers library encodes whole texts with this vocabulary, without adding special tokens, and decodes these
    ids with special ones kept. Null counts as the empty text: no ids, an empty decoded text. Special strings that stand in
    a text are matched as the library does. A text of any length is encoded whole. Null ids come out as they are, repeated rows
    give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    name = _ship_vocabulary(docs.sparkSession, vocabulary or default_vocabulary())
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "__text"):
                found = list(_loaded(name).run(batch.column("__text")))
                ids = pa.array([[int(i) for i in x.split()] for _, x, _ in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([x for _, _, x in found], pa.string())], names=[id_col, "ids", "decoded"])

    fields = [rows.schema.fields[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))


def bpe_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, slice_bytes: int = 16 << 20) -> DataFrame:
    """As ``bpe_round_trip``, with ``n_tokens, ids_sha256, decoded_sha256`` in place of the long columns.

    A task encodes about ``slice_bytes`` of text at once: larger slices share more words, smaller ones take less memory.
    """
    name = _ship_vocabulary(docs.sparkSession, vocabulary or default_vocabulary())
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "__text", slice_bytes):
                out: tuple[list, list, list] = ([], [], [])
                for count, ids, decoded in _loaded(name).run(batch.column("__text")):
                    for column, value in zip(out, (count, *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))), strict=True):
                        column.append(value)
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], *[T.StructField(n, k) for n, k in fields]]))


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
