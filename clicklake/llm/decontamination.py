"""Benchmark decontamination by latent semantic retrieval: randomised SVD of TF-IDF passages, cosine search, shared words, LCS checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, fresh, read_table

#: Words a passage, and from one passage of a document to the next.
PASSAGE, STEP = 40, 20
#: Dimensions of the latent space, and those over them that the iteration carries; products A'(A Q) that the basis is
#: made by; seed of the sketch.
RANK, OVERSAMPLING, POWER, SEED = 128, 16, 1, 42
#: Cosine from which on a passage is a candidate for an item.
COSINE = 0.6
#: Longest common subsequence, as a share of the item's words, that makes a leak; and that does with the answer present
#: (this share of an answer of so many words at least).
LEAK, PARAPHRASE, ANSWER, LEAST_ANSWER = 0.7, 0.6, 0.9, 4
#: Of an item's rarest words, as many as a leak can lack and so many more are looked for: a leak has that many of them.
SHARED = 4
#: Numbers of one product of passages and queries at most.
_PRODUCT = 1 << 22
#: Items searched for at once: they and their words, of fixed size, are what every task holds.
BLOCK_ITEMS = 500
#: Bytes of texts that are turned into numbers at once; texts whose products are made at once, so that these stay in cache.
_GROUP_BYTES, _GROUP_TEXTS = 8 << 20, 64

_WORDS = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"[.!?:\n]+\s*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; one code point at a time, as the documents are folded."""
    return _WORDS(pc.utf8_lower(pa.scalar(text or "", pa.large_string())).as_py())


def lcs(item: dict[int, int], size: int, region: list[int]) -> int:
    """Length of the longest common subsequence of an item of `size` words and a region, both as numbers of words.

    `item` has the places of each word as bits.
    """
    full = (1 << size) - 1
    v = full
    for w in region:
        if bits := item.get(w):
            u = v & bits
            v = (v + u | v - u) & full
    return size - v.bit_count()


def bits_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Items:
    """A block of benchmark items: words, answers (the words of the last sentence), and vocabulary."""

    ids: list
    words: list[list[str]]
    answers: list[list[str]]
    terms: dict[str, int]

    @classmethod
    def of(cls, rows) -> Items:
        ids, words, answers, terms = [], [], [], {}
        for item_id, text in rows:
            if own := words_of(text):
                sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
                ids.append(item_id)
                words.append(own)
                answers.append(sentences[-1])
                for w in own:
                    terms.setdefault(w, len(terms))
        return cls(ids, words, answers, terms)


def numbers_of(terms: dict[str, int], texts: pa.Array) -> Iterator[bytes]:
    """Per text the numbers of its words as packed integers: the terms', and -1 for words outside the vocabulary.

    The pieces between spaces are looked up once for some megabytes of texts, then gathered.
    """
    import numpy as np

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at, vocabulary = 0, pa.array(list(terms), pa.large_string())
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _GROUP_BYTES, side="right")))
        cut = pc.split_pattern(texts.slice(at, stop - at), " ")
        pieces = pc.list_flatten(cut).dictionary_encode()
        # Most pieces are a word and a mark behind it; the others are looked at one by one.
        low = pc.utf8_lower(pieces.dictionary)
        word = pc.utf8_rtrim(low, ".,;:!?")
        plain = pc.utf8_is_alnum(word).to_numpy(zero_copy_only=False)
        number = pc.fill_null(pc.index_in(word, value_set=vocabulary), -1).to_numpy().astype("<i4")
        found = [[terms.get(w, -1) for w in _WORDS(p)] for p in low.filter(pa.array(~plain)).to_pylist()]
        size = np.ones(len(low), np.int64)
        size[~plain] = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.empty(int(size.sum()), "<i4")
        pool[np.repeat(plain, size)] = number[plain]
        pool[np.repeat(~plain, size)] = np.fromiter(chain.from_iterable(found), "<i4", int(size[~plain].sum()))
        start, index = np.cumsum(size) - size, pieces.indices.to_numpy()
        first = 0
        for last in np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False)).tolist():
            own = index[first:last]
            k = size[own]
            before = np.cumsum(k) - k
            yield pool[np.repeat(start[own] - before, k) + np.arange(int(k.sum()))].tobytes()
            first = last
        at = stop


def passages_of(packed: list[bytes], n_terms: int):
    """In how many passages of some texts each term occurs, and the number of passages."""
    import numpy as np

    words, size, steps = _joined(packed)
    windows = np.where(steps > 0, np.maximum(1, steps - 1), 0)
    at = np.flatnonzero(words >= 0)
    text = np.repeat(np.arange(len(size)), size)[at]
    base, every = (np.cumsum(steps) - steps)[text], int(steps.sum())
    place = (at - (np.cumsum(size) - size)[text]) // STEP
    key, first = np.unique(words[at].astype(np.int64) * every + base + place, return_index=True)
    # A step is in the passage that begins with it, and in the one before that; the passage before counts here unless
    # the step before has the term too.
    text, place = text[first], place[first]
    after = np.zeros(len(key), bool)
    after[1:] = (key[1:] == key[:-1] + 1) & (place[1:] > 0)
    counts = (place < windows[text]).astype(np.int64) + ((place > 0) & ~after)
    return np.bincount(key // max(1, every), counts, n_terms).astype(np.int64), int(windows.sum())


def _joined(packed: list[bytes]):
    """The words of some texts one after the other, how many each has, and its steps (runs of STEP words)."""
    import numpy as np

    words = np.frombuffer(b"".join(packed), "<i4")
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    return words, size, -(-size // STEP)


def n_windows(n_words: int) -> int:
    """Passages of a text: windows of PASSAGE words each STEP words, as many as reach its end; one for a short text."""
    return 0 if n_words == 0 else 1 + max(0, -(-(n_words - PASSAGE) // STEP))


def _sums(matrix, rows, groups, n: int):
    """Sums of matrix[rows] by sorted group numbers, as n rows.

    Groups are cut into runs of at most 64 rows. All runs' first rows are added, then all second ones, the longest runs first,
    and the sums of the runs are summed in turn.
    """
    import numpy as np

    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    if not len(groups):
        return out
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    place = np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))
    start = np.flatnonzero(place % 64 == 0)
    size = np.diff(np.r_[start, len(groups)])
    order = np.argsort(-size, kind="stable")
    ordered, down = start[order], -size[order]
    runs = np.zeros((len(start), matrix.shape[1]), matrix.dtype)
    for j in range(-int(down[0])):
        k = int(np.searchsorted(down, -j))  # the runs of more than j rows
        runs[:k] += matrix[rows[ordered[:k] + j]]
    if len(start) == len(first):
        out[groups[ordered]] = runs
        return out
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return _sums(runs, back, groups[start], n)


class Rows:
    """The rows of A, TF-IDF passages by terms, of some texts: what products with A and A' need.

    A passage is two steps of words that follow each other, so products go over steps: a word counts once, not for each passage.
    """

    def __init__(self, packed: list[bytes], idf):
        import numpy as np

        words, size, self.steps = _joined(packed)
        self.at = np.flatnonzero(words >= 0)
        self.term, self.idf = words[self.at], idf
        base = np.cumsum(self.steps) - self.steps
        text = np.repeat(np.arange(len(size)), size)[self.at]
        self.step = base[text] + (self.at - (np.cumsum(size) - size)[text]) // STEP
        self.windows = np.where(self.steps > 0, np.maximum(1, self.steps - 1), 0)
        # The steps in which passages begin, and whether another one follows in it.
        self.begin = np.flatnonzero(np.ones(int(self.steps.sum()), bool))
        last = np.zeros(len(self.begin), bool)
        last[np.cumsum(self.steps)[self.steps > 1] - 1] = True
        self.begin = self.begin[~last]
        self.two = np.repeat(self.steps > 1, self.windows)

    def times(self, matrix):
        """A times a matrix of terms by dimensions, a row a passage."""
        import numpy as np

        sums = _sums(matrix * self.idf[:, None].astype(matrix.dtype), self.term, self.step, int(self.steps.sum()))
        out = sums[self.begin]
        out[self.two] += sums[self.begin[self.two] + 1]
        return out

    def back(self, passages):
        """A' times a matrix of passages by dimensions, a row a term."""
        import numpy as np

        steps = np.zeros((int(self.steps.sum()), passages.shape[1]), passages.dtype)
        steps[self.begin] += passages
        steps[self.begin[self.two] + 1] += passages[self.two]
        order = np.argsort(self.term, kind="stable")
        return _sums(steps, self.step[order], self.term[order], len(self.idf)) * self.idf[:, None].astype(passages.dtype)


def with_numbers(docs: DataFrame, name: str, terms: dict[str, int], text_col: str) -> DataFrame:
    """`docs` with the texts' words as numbers: all that the search needs of a text."""

    @F.arrow_udf("binary")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array(numbers_of(terms, texts), pa.binary())

    return docs.withColumn(name, numbers(F.col(f"`{text_col}`").cast("string")))


def _inverse_frequencies(texts: DataFrame, n_terms: int):
    """Smoothed idf of the terms over the passages of all texts, the root of passages by a term's passages; null without passages.

    With the root, every term has about the same share of the matrix, so the leading singular vectors are words that occur
    together, as an item's do in its copies. By the logarithm the frequent words had nearly all of it, and most passages
    of one language looked alike.
    """
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for i in range(0, len(packed), 512):
                found, total = passages_of(packed[i : i + 512], n_terms)
                df, passages = df + found, passages + total
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int32)), pa.array(np.r_[df[some], passages])], names=["term", "n"])

    rows = texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term of the block
    found = {r["term"]: r["n"] for r in rows}
    n = found.pop(-1, 0)
    # Positive for every word at every size: an item in a hot group of copies keeps the weight of its words.
    return np.sqrt((1 + n) / (1 + np.array([found.get(i, 0) for i in range(n_terms)], float))) if n else None


def _right_vectors(texts: DataFrame, n_terms: int, idf):
    """The leading right singular vectors (terms x RANK at most) of A, all passages' TF-IDF by terms, and their singular values.

    Randomised SVD: a Gaussian sketch S of RANK + OVERSAMPLING columns, and Q from the QR of A'(A S), or after POWER such
    products from that of A'(A Q). B = A Q is taken by its square B'B, a matrix of the basis's size; its eigenvectors turn
    Q into the singular vectors, its eigenvalues are the squared singular values, of which the RANK largest stay. Tasks add
    up their shares, Spark sums them by row; terms x (RANK + OVERSAMPLING) numbers reach the driver.
    """
    import numpy as np

    rank = min(RANK + OVERSAMPLING, n_terms)
    basis = np.random.default_rng(SEED).standard_normal((n_terms, rank)).astype(np.float32)
    for _ in range(POWER):
        basis, scale = np.linalg.qr(_products(texts, idf, basis, n_terms, lambda rows, y: rows.back(y)))
        length = np.abs(np.diag(scale))
        basis = basis[:, length > 1e-9 * max(1e-30, length.max(initial=0))].astype(np.float32)
    small = _products(texts, idf, basis, basis.shape[1], lambda rows, y: y.T @ y)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(-values)[:RANK]
    return (basis @ turn[:, lead]).astype(np.float32), np.sqrt(np.maximum(values[lead], 0))


def _products(texts: DataFrame, idf, basis, n: int, product):
    """The sum of product(rows, A times the basis) over groups of texts, an array of n rows."""
    import numpy as np

    rank = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((n, rank), np.float64)
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for i in range(0, len(packed), _GROUP_TEXTS):
                rows = Rows(packed[i : i + _GROUP_TEXTS], idf)
                z += product(rows, rows.times(basis))
        some = np.flatnonzero(z.any(axis=1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(z[some].ravel()), rank).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), values], names=["place", "z"])

    z = np.zeros((n, rank))
    if rank:
        sums = texts.mapInArrow(run, "place int, z array<double>").groupBy("place").agg(F.array(*(F.sum(F.col("z")[j]) for j in range(rank))).alias("z"))
        for r in sums.collect():
            z[r["place"]] = r["z"]
    return z


def _among(words, own):
    """Which of some words' numbers are among an item's, which are sorted."""
    import numpy as np

    return own[np.minimum(np.searchsorted(own, words), len(own) - 1)] == words


@dataclass
class Search:
    """What tasks need to look for a block of items in texts."""

    items: Items
    idf: object
    basis: object
    values: object = None  # the singular values

    def __post_init__(self):
        import numpy as np

        words, n = self.items.words, len(self.items.terms)
        number = self.items.terms.__getitem__
        numbers = [np.fromiter(map(number, w), np.int64, len(w)) for w in words]
        # Items longer than a passage are searched for by passages of their own: a row of queries each.
        windows = [n_windows(len(w)) for w in words]
        self.first = np.r_[0, np.cumsum(windows)]
        latent = np.zeros((self.first[-1], self.basis.shape[1]), np.float32)
        for i, own in enumerate(numbers):
            for k in range(windows[i]):
                part = own[k * STEP : k * STEP + PASSAGE]
                latent[self.first[i] + k] = self.idf[part].astype(np.float32) @ self.basis[part]
        self.queries = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        self.bits = [bits_of(own.tolist()) for own in numbers]
        self.answer_bits = [bits_of(list(map(number, a))) for a in self.items.answers]
        self.own = [np.unique(own) for own in numbers]
        # How many of its words a leak of the item has at least; how many of its rarest ones; and by classes of size,
        # each term's items that have it among their rarest words: (stride, start by term, items, occurrences).
        self.least = [math.ceil(PARAPHRASE * len(w) - 1e-9) for w in words]
        self.shared = np.minimum(SHARED, self.least)
        classes: dict[int, list[tuple[int, int, int]]] = {}
        for i, own in enumerate(numbers):
            rarest = own[np.lexsort((own, -self.idf[own]))][: len(own) - self.least[i] + self.shared[i]]
            stride = PASSAGE + 2 * max(64, 1 << (len(own) - 1).bit_length())
            classes.setdefault(stride, []).extend((t, i, k) for t, k in zip(*(x.tolist() for x in np.unique(rarest, return_counts=True))))
        self.postings = []
        for stride, rows in sorted(classes.items()):
            term, item, occurrences = np.array(sorted(rows), np.int64).T
            self.postings.append((stride, np.searchsorted(term, np.arange(n + 1)), item, occurrences))

    def hits(self, packed: list[bytes]) -> list[list[tuple]]:
        """Per text (its words' numbers): (item id, cosine, item's share in the common subsequence, first word) of its leaks."""
        out: list[list[tuple]] = []
        for i in range(0, len(packed), 256):
            out += self._hits(packed[i : i + 256])
        return out

    def _near(self, latent) -> Iterator[tuple]:
        """(passages, items) with a cosine of COSINE or more, some passages at a time; an item once for each of its passages."""
        import numpy as np

        rows = max(1, _PRODUCT // max(1, len(self.queries)))
        item = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        for i in range(0, len(latent), rows):
            at, query = np.nonzero(latent[i : i + rows] @ self.queries.T >= COSINE)
            yield at + i, item[query]

    def _sharing(self, packed: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, passage of it, item) wherever the passage's region has enough of the item's words to hold a leak.

        A leak has `least` of an item's words, so of its rarest words, as many as it can lack and `shared` more, it has
        `shared` at least. They are counted in overlapping pieces of the texts, each region inside one of them; where they
        suffice, all of the item's words are counted in each region. Nothing that LCS could confirm is left out.
        """
        import numpy as np

        n, m = len(self.items.terms), len(self.items.words)
        texts = [np.frombuffer(t, "<i4") for t in packed]
        size = np.array([len(t) for t in texts], np.int64)
        words = np.concatenate(texts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        for stride, start, items, occurrences in self.postings:
            pieces = -(-size // stride)
            first = np.cumsum(pieces) - pieces
            length = np.append(np.diff(start), 0)  # the last one is for words outside the vocabulary
            at = np.flatnonzero(length[words])
            piece, term = np.repeat(first, size)[at] + place[at] // stride, words[at].astype(np.int64)
            back = place[at] >= stride
            key = np.unique(np.r_[piece * n + term, (piece[back] - 1) * n + term[back]])
            if not len(key):
                continue
            piece, term = key // n, key % n
            k = length[term]
            entry = np.repeat(start[term] - np.cumsum(k) + k, k) + np.arange(k.sum())
            pairs, which = np.unique(np.repeat(piece, k) * m + items[entry], return_inverse=True)
            pairs = pairs[np.bincount(which, occurrences[entry]) >= self.shared[pairs % m]]
            row = np.searchsorted(np.cumsum(pieces), pairs // m, side="right")
            for i, p, j in zip(row.tolist(), (pairs // m - first[row]).tolist(), (pairs % m).tolist()):
                own, base = len(self.items.words[j]), p * stride
                inside = np.cumsum(np.r_[0, _among(texts[i][base : base + 2 * stride], self.own[j])])
                if inside[-1] < self.least[j]:
                    continue
                # The passages whose regions begin in the piece's first half.
                number = np.arange(-(-(base + own) // STEP) if p else 0, min(-(-(base + stride + own) // STEP), n_windows(int(size[i]))))
                begin, end = np.maximum(0, number * STEP - own) - base, number * STEP + PASSAGE + own - base
                for x in number[inside[np.minimum(end, len(inside) - 1)] - inside[np.minimum(begin, len(inside) - 1)] >= self.least[j]].tolist():
                    yield i, x, j

    def _hits(self, packed: list[bytes]) -> list[list[tuple]]:
        import numpy as np

        n, m = len(self.items.terms), len(self.items.words)
        out: list[list[tuple]] = [[] for _ in packed]
        rows = Rows(packed, self.idf)
        windows = rows.windows
        if not windows.any() or not self.basis.shape[1]:
            return out
        latent = rows.times(self.basis)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        begin = np.cumsum(windows) - windows
        found = [at * m + item for at, item in self._near(latent)]
        found.append(np.array([(begin[i] + x) * m + j for i, x, j in self._sharing(packed)], np.int64))
        found = np.unique(np.concatenate(found))
        at, item = found // m, found % m
        texts = np.searchsorted(begin + windows, at, side="right")
        best: dict[tuple[int, int], tuple] = {}
        last, words = -1, []
        for row, passage, number, j in zip(texts.tolist(), at.tolist(), (at - begin[texts]).tolist(), item.tolist()):
            if row != last:
                last, words = row, np.frombuffer(packed[row], "<i4")
            size = len(self.items.words[j])
            region = words[max(0, number * STEP - size) : number * STEP + PASSAGE + size]
            region = region[_among(region, self.own[j])]
            if len(region) < self.least[j]:
                continue  # a subsequence is no longer than the words in common
            region = region.tolist()
            share = lcs(self.bits[j], size, region) / size
            if share < PARAPHRASE:
                continue
            if share < LEAK:
                answer = self.items.answers[j]
                if len(answer) < LEAST_ANSWER or lcs(self.answer_bits[j], len(answer), region) < ANSWER * len(answer):
                    continue
            c = float((self.queries[self.first[j] : self.first[j + 1]] @ latent[passage]).max())
            if (row, j) not in best or (share, c) > best[row, j][2:0:-1]:
                best[row, j] = (self.items.ids[j], c, share, number * STEP)
        for (row, _), hit in sorted(best.items()):
            out[row].append(hit)
        return out


def blocks_of(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of at most BLOCK_ITEMS benchmark items in the order of their ids: a larger benchmark makes more, not larger ones."""
    every = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    while block := [(r["item_id"], r["text"]) for _, r in zip(range(BLOCK_ITEMS), every)]:
        items = Items.of(block)
        if items.ids:
            yield items


def prepare(texts: DataFrame, items: Items) -> Search | None:
    """The search for a block of items in texts (numbers), null if there is nothing to search in.

    Frequencies and SVD go over all passages of all texts.
    """
    import numpy as np

    n = len(items.terms)
    idf = _inverse_frequencies(texts, n)
    if idf is None:
        return None
    basis, values = _right_vectors(texts, n, idf)
    return Search(items, idf, basis, values)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row and benchmark item that it holds: doc_id, item_id, cosine, lcs, first_word.

    Passages are windows of 40 words, 20 apart, of whole texts, weighted by TF-IDF in the benchmark's vocabulary, outside
    of which all items are zero. Passages and items, long ones by passages of their own, are compared in the space of a randomised SVD; pairs at a cosine of COSINE
    or more are candidates. So is every other pair with enough words in common for a leak (items of common words, and
    passages that hold little of a short item), so that the rows are those of comparing all passages with all items. A
    candidate is a leak if the longest common subsequence of the item's words and of the passage with as much again on
    both sides has LEAK of the item, or PARAPHRASE of it and ANSWER of the item's answer, its last sentence.

    Null and empty texts and items hold and match nothing; null item ids are ignored; repeated rows and items give rows
    of their own each; empty tables give no rows. Texts do not move between tasks. Other columns are not read.
    """
    out, scratch = None, Scratch(spark, "leaks")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    for items in blocks_of(benchmark):
        encoded = scratch.cut(with_numbers(named, "numbers", items.terms, "text").drop("text"), "numbers")
        search = prepare(encoded.select("numbers"), items)
        if search is None:
            continue
        shared = spark.sparkContext.broadcast(search)  # of the size of one block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *hit) for i, hits in enumerate(shared.value.hits(batch.column(1).to_pylist())) for hit in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "cosine", "lcs", "first_word"])

        found = encoded.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs double, first_word long")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, first_word long") if out is None else out


def keep_unleaked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, all columns as they are. They are written with their words' numbers once a block."""
    out, scratch, name = docs, Scratch(spark, "unleaked"), fresh(docs, "numbers")
    for items in blocks_of(benchmark):
        encoded = scratch.cut(with_numbers(out, name, items.terms, text_col), "numbers")
        search = prepare(encoded.select(F.col(name).alias("numbers")), items)
        if search is None:
            continue
        out = encoded.filter(~_is_leak(spark.sparkContext.broadcast(search))(F.col(name))).drop(name)
    return out


def _is_leak(shared):
    """A function that tells of texts as numbers whether they hold an item of a search."""

    @F.arrow_udf("boolean")
    def leaks(numbers: pa.Array) -> pa.Array:
        return pa.array([bool(h) for h in shared.value.hits(numbers.to_pylist())], pa.bool_())

    return leaks


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"), "first_word")
