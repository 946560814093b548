"""Token alignment, compression quality and spelling variants against brute force and held-out rows."""

import bisect
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candela.llm import align, quality, variants
from tests.llm.test_operators import CLASH, prose, texts


def odd_texts():
    rng = random.Random(5)
    pool = "ab é 　\t\n\x1c  .,'s<|endoftext|></s><s> 12日本語ß́😀​"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [*made, " lead", "trail ", "two  spaces", "a\n\n b", " ", "　", "don't we'll", "x" * 3000, "ａ full", "日本語のテキスト", "<s>", "<|endoftext|>", "a <0x41> b", "\x00 nul"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *[None] * 11) for i, t in texts()] + [(1000 + k, t, *[None] * 11) for k, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, " + CLASH).repartition(3)


# --- 11 -----------------------------------------------------------------------------------------------------------------


class Plain:
    """Whole texts by the libraries, links by comparing byte ranges of groups."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        vocabulary = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(k): k for k in keep} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in keep)}
        self.bytes_a = {i: bytes(table[c] for c in t) for t, i in vocabulary.items()}

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and self.b.is_byte(i) else p.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(self.bytes_a.get(i, b"") for i in a) != whole or b"".join(self.bytes_b(i) for i in b) != whole:
            return None
        ends_a, ends_b = np.cumsum([len(self.bytes_a[i]) for i in a]), np.cumsum([len(self.bytes_b(i)) for i in b])
        common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups = [([], []) for _ in common]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, end in zip(ids, ends.tolist(), strict=True):
                groups[bisect.bisect_left(common, end)][side].append(i)
        return a, b, groups, Counter((x, y) for p, q in groups for x in p for y in q)


def brute_alignment(rows):
    plain = Plain()
    found = [(i, plain(t)) for i, t in rows]
    counts = Counter(pair for _, f in found if f for pair in f[3])
    best = defaultdict(int)
    for (a, _), c in counts.items():
        best[a] = max(best[a], c)
    out = []
    for i, f in found:
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        n_best = sum(m for (x, y), m in links.items() if counts[x, y] == best[x])
        out.append((i, len(a), len(b), len(groups), sum(links.values()), n_best, sum(m * counts[p] for p, m in links.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=repr)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("slice_bytes", [200, 3 << 20])
def test_alignment_equals_brute_force(docs, slice_bytes):
    found = align.aligned(docs, slice_bytes=slice_bytes)
    assert tuple(found.columns) == ALIGNED
    assert sorted(map(tuple, found.collect()), key=repr) == brute_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_alignment_of_many_slices_and_none(spark, docs, monkeypatch):
    monkeypatch.setattr(align, "FAN", 2)  # several levels of merged runs
    rows = [(k, prose(k % 7, 5 + k % 40)) for k in range(120)]
    found = align.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), slice_bytes=300)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_alignment(rows)
    assert align.aligned(docs.where("false")).collect() == []


def test_a_hot_pair_is_one_entry_of_a_run():
    runs = [(np.array([3, 9]), np.array([2, 1])), (np.array([3]), np.array([5])), (np.array([], int), np.array([], int)), (np.array([1, 9, 70_000]), np.array([1, 1, 4]))]
    pairs, counts = align.merge_runs(runs)
    assert pairs.tolist() == [1, 3, 9, 70_000] and counts.tolist() == [1, 7, 2, 4]
    assert align.highest(pairs, counts).tolist() == [0, 1, 0, 1]  # 1, 3 and 9 are of A id 0
    assert align.highest(np.array([1, 3]), np.array([7, 7])).tolist() == [1, 1]
    assert [x.tolist() for x in align.unspill(align.spill(pairs, counts[:2]), 2)] == [[1, 3, 9, 70_000], [1, 7]]


@pytest.mark.parametrize("large", [1, 1 << 16])
def test_a_group_of_many_tokens_links_all(large, monkeypatch):
    monkeypatch.setattr(align, "LARGE", large)  # links of a group listed one by one, or by distinct ids
    ids = [np.array(x) for x in ([5, 5, 6, 7], [1, 2, 3])]
    of, code, count, groups, number = align.linked(ids[0], np.array([1, 1, 2, 9]), ids[1], np.array([3, 1, 9]), np.array([4, 13]))
    assert groups == ["5,5,6|1,2;", "7|3;"] and number.tolist() == [1, 1]
    links = Counter()
    for t, c, n in zip(of.tolist(), code.tolist(), count.tolist(), strict=True):
        links[t, c >> 15, c & 32767] += n
    assert links == {(0, 5, 1): 2, (0, 5, 2): 2, (0, 6, 1): 1, (0, 6, 2): 1, (1, 7, 3): 1}


# --- 12 -----------------------------------------------------------------------------------------------------------------


def junk(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["$$$", "###", "%%%", "click", "buy", "|", "@@"]) + rng.choice("abc") for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, junk(k, 80) if k % 4 == 0 else prose(k, 80)) for k in range(400)]
    marks = [(k, int(k % 4 != 0), "x") for k in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, text string")


def test_quality_of_held_out_rows(judged):
    docs, labels = judged
    found = quality.quality(docs, labels).collect()
    assert len(found) == 400 and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in found if r["held_out"])


def test_quality_learns_from_no_held_out_label(judged, spark):
    docs, labels = judged
    bent = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r["doc_id"], round(r["score"], 12)) for r in df.collect())
    assert key(quality.quality(docs, labels)) == key(quality.quality(docs, bent))


def test_difference_is_that_of_plain_compression(judged):
    import zstandard

    docs, labels = judged
    model = quality.fit(docs, labels)
    rows = [*[r["text"] for r in docs.limit(5).collect()], None, "", "a", "é" * 5000]
    want = []
    for text in rows:
        sizes = []
        for content in (model.good, model.bad):
            made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
            data = (text or "").encode()
            sizes.append(sum(len(made.compress(data[k : k + 256])) for k in range(0, len(data), 256)))
        want.append((sizes[1] - sizes[0]) / sum(sizes) if sum(sizes) else 0.0)
    assert np.allclose(quality.differences(model.good, model.bad, pa.array(rows)), want, atol=0.02)
    assert quality.differences(model.good, model.bad, pa.array([None, ""])).tolist() == [0.0, 0.0]


def test_quality_of_odd_rows(docs, judged, spark):
    _, labels = judged
    twice = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, "x"), (5, None, "x"), (99_999, 0, "x")], labels.schema))
    found = quality.quality(docs, twice).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    by = defaultdict(set)
    for r, t in zip(found, [r["text"] for r in docs.select("text").collect()], strict=True):
        by[t or ""].add(r["score"])
    assert quality.quality(docs.where("false"), labels).collect() == []
    assert {r["score"] for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert {r["score"] for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}


def test_pieces_are_spread_over_the_whole_text():
    text = "".join(chr(97 + k // 2000 % 26) for k in range(2000 * 40))
    assert [p[:1] for p in quality.spaced(text)][0] == b"a" and quality.spaced(text)[-1] == text[-2000:].encode()
    assert len(quality.spaced(text)) == quality.PIECES and quality.spaced("abc") == [b"abc"] and quality.spaced("") == []


# --- 13 -----------------------------------------------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)}))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    words = sorted(counts)
    around = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(around[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def lexicon(seed, size):
    """Words of few syllables, with misspelled ones; frequencies fall steeply, and there are chains of forms."""
    rng = random.Random(seed)
    made = ["".join(rng.choice(["an", "er", "th", "in", "é", "ou", "st"]) for _ in range(rng.randint(3, 5))) for _ in range(size)]
    out = []
    for k, word in enumerate(made):
        out += [word] * (1 + 400 // (k + 1))
        for _ in range(3):
            at = rng.randrange(len(word))
            out += [rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("aexyé") + word[at:], word[:at] + rng.choice("aexyé") + word[at + 1 :]])] * rng.randint(1, 3)
    out += ["abcdefgh"] * 4000 + ["abcdefgx"] * 300 + ["abcdefyx"] * 20 + ["abcdwfyx"] * 2 + ["zzzzzzzz"] * 2 + ["zzzzzzz"] * 2 + ["a" * 500] * 3 + ["a" * 501] * 40
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def spelled(spark):
    words = lexicon(1, 500)
    rows = [(k, " ".join(words[a : a + 60]) + ("." if k % 2 else "\n") + "Short ÄÖÜßabc") for k, a in enumerate(range(0, len(words), 60))]
    rows += [(None, "nulliddoc Nulliddoc"), (7, None), (8, ""), (9, " ".join(words))]
    return rows, spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], "doc_id long, " + CLASH).repartition(3)


@pytest.mark.parametrize("leaf", [4_000, 40])
def test_variants_equal_brute_force(spelled, leaf, monkeypatch):
    rows, docs = spelled
    monkeypatch.setattr(variants, "LEAST", 4)
    monkeypatch.setattr(variants, "SMALL", 8)
    monkeypatch.setattr(variants, "SEARCHES", 100 if leaf == 40 else 100_000)  # searches of a leaf in several tasks
    found = variants.variants(docs, leaf=leaf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_words(rows))
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert any(r[1] and r[1] != r[2] for r in want) and ("abcdwfyx", None) not in [(r[0], r[1]) for r in want]


def test_leaves_of_upper_trees_hold_all_points_once(spelled):
    words = sorted({w for w in lexicon(3, 3000) if len(w) == 9})
    counts = variants.letters(words)[1]
    tree = variants.Upper(counts[::3], 8)
    rows, leaves = tree.reached(counts, (0, 0))
    assert tree.leaves > 8 and sorted(rows.tolist()) == list(range(len(words)))
    own = dict(zip(rows.tolist(), leaves.tolist(), strict=True))
    reached = set(zip(*[x.tolist() for x in tree.reached(counts, (1, 1))], strict=True))
    assert len(reached) < 0.7 * len(words) * tree.leaves  # boxes are pruned
    for a in range(0, len(words), 7):
        for b in range(len(words)):
            if near(words[a], words[b]) and a != b:
                assert (a, own[b]) in reached


def test_no_words(spelled):
    _, docs = spelled
    assert variants.variants(docs.where("false")).collect() == []
    assert variants.variants(docs.where("text = ''")).collect() == []
