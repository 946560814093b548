"""Spelling variants: words one edit apart by range searches in k-d trees over letter counts, each led to its frequent form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import materialize, ship, table, text_of

#: Runs of letters, and what is lower-cased in them. Fixed by the task.
RUN, UPPER, LOWER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs whose crc32 this divides lose a letter; least letters and occurrences of a word; how much more frequent a form is.
DELETES, LETTERS, OCCURRENCES, RATIO = 31, 7, 2, 10
#: Words that the upper levels of the trees are drawn from at most; words in a leaf of them, and searches dealt to one task, about.
SAMPLE, LEAF, SEARCHES = 65_536, 4_000, 100_000
#: Sampled words that a leaf holds at least, so that splits are near the quantiles of all words.
LEAST = 16
#: Words in a leaf of a task's own tree, and pairs that are compared at once.
SMALL, AT_ONCE = 96, 1 << 20
#: Tasks that the words led to one form are dealt to.
SALTS = 16
#: Letters that words are made of: a-z and the range from U+00C0 to U+00FF.
DIMENSIONS = 26 + 64


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length: their code points, and how often each letter stands in them."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    at = np.where(code >= 0xC0, code.astype(np.int64) - 0xC0 + 26, code.astype(np.int64) - ord("a"))
    counts = np.zeros((len(words), DIMENSIONS), np.int32)
    for column in at.T:
        counts[np.arange(len(words)), column] += 1
    return code, counts


def split_of(counts: np.ndarray) -> tuple[int, int] | None:
    """Dimension and bound that part points best: of the dimensions by spread the first whose median parts them."""
    for dimension in np.argsort(-counts.var(axis=0), kind="stable")[:8]:
        values = np.sort(counts[:, dimension])
        if values[0] == values[-1]:
            return None
        middle = values[(len(values) - 1) // 2]
        bounds = [b for b in (middle - 1, middle) if values[0] <= b < values[-1]]
        return int(dimension), int(min(bounds, key=lambda b: abs(int((values <= b).sum()) * 2 - len(values))))
    return None


class Search:
    """Points that are being looked for in a box: how many letters they have more or fewer than fits into it.

    One edit adds a letter at most and takes one away at most, so a box that needs more of either holds no neighbour.
    """

    def __init__(self, counts: np.ndarray, rows: np.ndarray, most: tuple[int, int], needs: np.ndarray | None = None, box: dict | None = None):
        self.counts, self.rows, self.most, self.box = counts, rows, most, box or {}
        self.needs = np.zeros((2, len(rows)), np.int32) if needs is None else needs

    def halves(self, dimension: int, bound: int) -> tuple[Search, Search]:
        low, high = self.box.get(dimension, (0, 1 << 30))
        own = self.counts[self.rows, dimension]
        out = []
        for box in ((low, min(high, bound)), (max(low, bound + 1), high)):
            gain = np.maximum(box[0] - own, 0) - np.maximum(low - own, 0)
            loss = np.maximum(own - box[1], 0) - np.maximum(own - high, 0)
            needs = self.needs + np.stack([gain, loss])
            kept = (needs[0] <= self.most[0]) & (needs[1] <= self.most[1])
            out.append(Search(self.counts, self.rows[kept], self.most, needs[:, kept], self.box | {dimension: box}))
        return out[0], out[1]


class Upper:
    """The upper levels of the tree of one length: splits drawn from a sample, leaves numbered."""

    def __init__(self, counts: np.ndarray, least: int):
        self.nodes: list[tuple[int, int, int, int] | int] = []
        self.leaves = 0
        self._grow(counts, least)

    def _grow(self, counts: np.ndarray, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append(self.leaves)
        split = split_of(counts) if len(counts) > 2 * least else None
        if split is None:
            self.leaves += 1
            return at
        left = counts[:, split[0]] <= split[1]
        self.nodes[at] = (*split, self._grow(counts[left], least), self._grow(counts[~left], least))
        return at

    def reached(self, counts: np.ndarray, most: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of each leaf whose box can hold a neighbour of each point; with ``(0, 0)`` the leaf of each point."""
        rows, leaves, open_ = [], [], [(0, Search(counts, np.arange(len(counts)), most))]
        while open_:
            at, search = open_.pop()
            node = self.nodes[at]
            if not len(search.rows):
                continue
            if isinstance(node, int):
                rows.append(search.rows)
                leaves.append(np.full(len(search.rows), node))
            else:
                left, right = search.halves(node[0], node[1])
                open_ += [(node[2], left), (node[3], right)]
        none = np.zeros(0, np.int64)
        return np.concatenate(rows) if rows else none, np.concatenate(leaves) if leaves else none


def one_edit(point: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, whether the words differ by one replaced letter, or the query lacks one of the point's letters."""
    n = query.shape[1]
    if point.shape[1] == n:
        return (point != query).sum(axis=1) == 1
    ahead, behind = point[:, :n] == query, point[:, 1:] == query
    first = np.where(ahead.all(axis=1), n, np.argmin(ahead, axis=1))
    last = np.where(behind.all(axis=1), n, np.argmin(behind[:, ::-1], axis=1))
    return first + last >= n


def neighbours(points: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of points and queries that are one edit apart. Letters and counts of each; queries have as many letters, or one less."""
    (codes, counts), (asked, sought) = points, queries
    longer = codes.shape[1] - asked.shape[1]
    open_ = [(np.arange(len(codes)), Search(sought, np.arange(len(asked)), (1, 1 - longer)))]
    # Counts that differ by one edit have this squared distance and no other: one letter more, and one fewer if as long.
    apart = 1 if longer else 2
    point_real, query_real = counts.astype(np.float64), sought.astype(np.float64)
    point_square, query_square = (point_real**2).sum(axis=1), (query_real**2).sum(axis=1)
    while open_:
        rows, search = open_.pop()
        if not len(rows) or not len(search.rows):
            continue
        split = split_of(counts[rows]) if len(rows) > SMALL else None
        if split is not None:
            left = counts[rows, split[0]] <= split[1]
            open_ += list(zip((rows[left], rows[~left]), search.halves(*split), strict=True))
            continue
        step = max(1, AT_ONCE // max(len(rows), codes.shape[1]))
        for start in range(0, len(search.rows), step):
            own = search.rows[start : start + step]
            distance = point_square[rows][:, None] + query_square[own] - 2 * point_real[rows] @ query_real[own].T
            at, to = np.nonzero(distance == apart)
            at, to = rows[at], own[to]
            for k in range(0, len(at), max(1, AT_ONCE // codes.shape[1])):
                a, b = at[k : k + max(1, AT_ONCE // codes.shape[1])], to[k : k + max(1, AT_ONCE // codes.shape[1])]
                near = one_edit(codes[a], asked[b])
                if near.any():
                    yield a[near], b[near]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough, and how often they stand there.

    Counting combines before it shuffles, so a frequent word is one row of each task.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text_col), F.lit(RUN), 0)).alias("run"))
    runs = runs.where(F.length("run") >= LETTERS).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    marked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = F.pmod("h", "size").cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = marked.select(F.when(F.col("h") % DELETES == 0, without).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def upper_trees(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> tuple[dict[int, Upper], dict[tuple[int, int], int]]:
    """The upper levels of each length's tree from at most about ``sample`` words, and into how many shares the searches of a
    leaf are dealt. Any sample gives the same result; a poor one gives uneven leaves."""
    total = words.count()
    step = max(1, -(-total // sample))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(step)) == 0).select("word").toPandas()["word"].tolist()
    least = max(LEAST, leaf // (2 * step))
    trees, shares, counted = {}, {}, {}
    for size, rows in _by_length(drawn):
        counted[size] = letters([drawn[k] for k in rows])[1]
        trees[size] = Upper(counted[size], least)
    for size, tree in trees.items():
        for other, most in ((size, (1, 1)), (size - 1, (1, 0))):
            if other in counted:
                leaves, many = np.unique(tree.reached(counted[other], most)[1], return_counts=True)
                for k, m in zip(leaves.tolist(), many.tolist(), strict=True):
                    shares[size, k] = shares.get((size, k), 0) + m * step
    return {k: t for k, t in trees.items() if t.leaves > 1}, {k: -(-m // SEARCHES) for k, m in shares.items() if m > SEARCHES}


def _placer(trees: dict[int, Upper], shares: dict[tuple[int, int], int]):
    """Each word as a point of its own tree (role 0), and as a search of it (role 1) and of the tree of the next length (role 2)."""
    single = Upper(np.zeros((1, DIMENSIONS), np.int32), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for size, rows in _by_length(words):
                counts = letters([words[k] for k in rows])[1]
                for role, most in enumerate(((0, 0), (1, 1), (1, 0))):
                    tree = size + (role == 2)
                    at, leaf = trees.get(tree, single).reached(counts, most)
                    many = np.array([shares.get((tree, k), 1) for k in range(leaf.max() + 1)]) if len(leaf) else np.zeros(0, np.int64)
                    many = many[leaf] if len(leaf) else many
                    if role == 0:  # a point is there in every share of its leaf
                        share = np.concatenate([np.arange(k) for k in many]) if len(many) else many
                        at, leaf = np.repeat(at, many), np.repeat(leaf, many)
                    else:
                        share = rows[at] % many
                    columns = [pa.array(x.astype(np.int32)) for x in (np.full(len(at), tree), leaf, share, np.full(len(at), role))]
                    place = pa.array(rows[at])
                    yield pa.RecordBatch.from_arrays([*columns, batch.column("word").take(place), batch.column("n").take(place)], names=["tree", "leaf", "share", "role", "word", "n"])

    return run


def _found(group: pa.Table) -> pa.Table:
    """Of one leaf's points and searches: each word that has neighbours among them, their number, and the first of them by
    falling frequency and then by code points."""
    words, n, role = group.column("word").to_pylist(), np.asarray(group.column("n")), np.asarray(group.column("role"))
    order = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])), np.int64)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    many, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    places = [np.flatnonzero(role == k) for k in range(3)]
    made = [letters([words[k] for k in own]) if len(own) else None for own in places]
    for k in (1, 2):
        if made[0] is None or made[k] is None:
            continue
        for point, query in neighbours(made[0], made[k]):
            point, query = places[0][point], places[k][query]
            # Words of one length find each other in both directions; for a longer word this is the only place.
            for to, of in ((query, point), *([(point, query)] if k == 2 else [])):
                np.add.at(many, to, 1)
                np.minimum.at(best, to, rank[of])
    some = np.flatnonzero(many > 0)
    first = order[best[some]]
    return pa.table({"word": group.column("word").take(pa.array(some)), "n_near": pa.array(many[some]), "form": group.column("word").take(pa.array(first)), "form_n": pa.array(n[first])})


def _rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: where the forms end. Each turn doubles the way, and n grows tenfold a step."""
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        further = state.join(state.select(F.col("root").alias("word")).distinct(), "word", "left_semi")
        further = further.select(F.col("word").alias("root"), F.col("root").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        further = materialize(further, "variant-ways")
        if further.isEmpty():
            return state
        moved = state.withColumn("salt", salt).join(further, ["root", "salt"], "left")
        state = materialize(moved.select("word", F.coalesce("next", "root").alias("root")), "variant-roots")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are points of letter counts. One edit adds a letter at most and takes one away at most, so it moves a point by two
    in all. Each length has a k-d tree; a word is looked for in its own length's and in the next one's, in all boxes that
    one edit can reach, and letter order decides. The upper levels of the trees are drawn from a sample and deal words to
    tasks; each task goes on with trees of its own. Of a word's neighbours only their number and the best leave a task.

    Null and empty texts have no words; a null id counts as an empty one. Runs of any length are words. Repeated rows count
    again. Ties of frequency go to the least word in code-point order. Other columns are ignored; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    words = materialize(word_counts(docs, id_col=id_col, text_col=text_col), "variant-words")
    placed = words.mapInArrow(_placer(*upper_trees(words, sample, leaf)), "tree int, leaf int, share int, role int, word string, n long")
    near = placed.groupBy("tree", "leaf", "share").applyInArrow(_found, "word string, n_near long, form string, form_n long")
    first = F.min(F.struct((-F.col("form_n")).alias("lead"), "form")).alias("first")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    led = F.col("near_n") >= F.col("n") * RATIO
    found = words.join(near.select("word", "n_near", (-F.col("first.lead")).alias("near_n"), F.col("first.form").alias("near")), "word", "left")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("near")).alias("form"), F.when(led, F.col("near_n")).alias("form_n"))
    found = materialize(found, "variant-forms")
    roots = _rooted(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
