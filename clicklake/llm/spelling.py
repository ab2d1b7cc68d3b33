"""Spelling variants: generated edits probe length-sharded blocked Bloom filters; positives meet the vocabulary by an exact join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import CRC_CTES, Scratch, crc_sql, read_table

#: A letter of a run: ASCII letters and U+00C0 to U+00FF; of these only A to Z have a lower case here.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
#: One pair of document and run in so many loses a code point; words are at least so long and so frequent.
ODDS, LEAST_LENGTH, LEAST_N = 97, 5, 3
#: Bits of a filter for each word, blocks of 256 bits in a part that is broadcast (32 MB), bytes of text at a time.
BITS, PART_BLOCKS, SLICE = 16, 1 << 20, 4 << 20
#: Edits probed at a time, and distinct words that a task holds before it hands their counts on.
PROBES, HELD = 1 << 20, 400_000


# ---- words and counts -------------------------------------------------------------------------------------------------


@lru_cache(1)
def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


@lru_cache(1)
def _crc_shifts(longest: int = 64) -> np.ndarray:
    """[n, k, b]: what byte b at place k of a crc32 becomes when n zero bytes follow."""
    table = _crc_table()
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(longest):
        now = table[now & 255] ^ (now >> 8)
        out.append(now)
    return np.stack(out)


def joined_crcs(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of texts joined pairwise, from the crc32 of both halves and the second's bytes (at most 64)."""
    shift = _crc_shifts()
    moved = shift[lengths, 0, first & 255] ^ shift[lengths, 1, (first >> 8) & 255] ^ shift[lengths, 2, (first >> 16) & 255] ^ shift[lengths, 3, first >> 24]
    return moved ^ second


def runs_of(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The runs of letters of UTF-8 texts, A to Z in lower case, and the number of each run's text."""
    data = np.frombuffer(b"".join(texts), np.uint8).copy()
    ends = np.cumsum([len(t) for t in texts])
    data[(data >= 65) & (data <= 90)] += 32
    lead = data == 0xC3  # begins U+00C0 to U+00FF, and nothing else
    letter = (data >= 97) & (data <= 122) | lead
    letter[1:] |= lead[:-1]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[ends] = True
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | fresh[1:-1]
    end[:-1] &= ~letter[1:] | fresh[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    offsets = np.concatenate([[0], np.cumsum(end - start + 1)]).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
    return runs, np.searchsorted(ends, start, "right")


def count_runs(ids: list, texts: list[bytes]) -> pa.Table:
    """(word, n) of the texts' runs after the deletions; an id of None is the empty text."""
    runs, doc = runs_of(texts)
    coded = runs.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    prefix = [f"{'' if i is None else i}:".encode() for i in ids]
    crc = joined_crcs(np.array([zlib.crc32(p) for p in prefix], np.uint32)[doc], np.array([zlib.crc32(w) for w in words], np.uint32)[code], np.minimum(size, 64)[code])
    for at in np.flatnonzero(size[code] > 64):
        crc[at] = zlib.crc32(prefix[doc[at]] + words[code[at]])
    hit = crc % ODDS == 0
    n = np.bincount(code[~hit], minlength=len(words))
    cut = []
    for at in np.flatnonzero(hit):
        word = words[code[at]].decode()
        place = int(crc[at]) % len(word)
        cut.append(word[:place] + word[place + 1 :])
    keep = [k for k, w in enumerate(words) if n[k] and len(w) - w.count(b"\xc3") >= LEAST_LENGTH]
    cut = [w for w in cut if len(w) >= LEAST_LENGTH]
    found = [words[k].decode() for k in keep] + cut
    return pa.table({"word": pa.array(found, pa.string()), "n": pa.array(np.concatenate([n[keep], np.ones(len(cut), np.int64)]).astype(np.int64))})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ids, texts, size = [], [], 0
            while at < batch.num_rows and size < SLICE:  # some texts at a time, one at least
                ids.append(batch.column(0)[at].as_py())
                texts.append((batch.column(1)[at].as_py() or "").encode())
                size += len(texts[-1])
                at += 1
            held.append(count_runs(ids, texts))
            if sum(t.num_rows for t in held) > 2 * HELD:
                held = [merged()]
                if held[0].num_rows > HELD:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held = []
    if held:
        yield from merged().to_batches(max_chunksize=100_000)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are frequent enough: counts are added up in each task before they are shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)


# ---- Bloom filters ----------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_hashes(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A number for each place and letter; a word's hash is the sum over its places, so one edit changes few terms."""
    return _mix((places.astype(np.uint64) << np.uint64(21)) + letters.astype(np.uint64) + np.uint64(1))


#: An odd multiplier for each of a block's eight 32-bit lanes.
_LANES = (_mix(np.arange(1, 9, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def block_and_key(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length: the block among that length's blocks, and what chooses the bits in it."""
    h = _mix(hashes)
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), h & np.uint64(0xFFFFFFFF)


def lane_bits(keys: np.ndarray, lane: int) -> np.ndarray:
    """The one bit of a lane that a key sets."""
    return np.uint32(1) << (((keys * _LANES[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)).astype(np.uint32)


def by_length(words: list[str], places: int = PROBES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their numbers in the list, and their code points as rows. At most so many code points, one word at least."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        length = len(words[order[at]])
        end = at
        while end < len(order) and len(words[order[end]]) == length and (end + 1 - at) * length <= max(places, length):
            end += 1
        own = order[at:end]
        yield np.array(own), np.frombuffer("".join(words[k] for k in own).encode("utf-32-le"), np.uint32).reshape(len(own), length)
        at = end


def word_hashes(points: np.ndarray) -> np.ndarray:
    return place_hashes(np.arange(points.shape[1])[None, :], points).sum(axis=1, dtype=np.uint64)


class Shards:
    """Where each length's filter lies among the blocks of all: blocks in proportion to the length's words."""

    def __init__(self, words_by_length: dict[int, int]):
        self.blocks = {length: max(1, -(-n * BITS // 256)) for length, n in sorted(words_by_length.items())}
        self.first, total = {}, 0
        for length, n in self.blocks.items():
            self.first[length], total = total, total + n
        self.parts = -(-total // PART_BLOCKS)


def fill(shards: Shards):
    """Each word's block and the bits that it sets there, a lane a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for _, points in by_length(words):
                length = points.shape[1]
                block, key = block_and_key(word_hashes(points), shards.blocks[length])
                lanes = [lane_bits(key, k).view(np.int32) for k in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64) + shards.first[length]), *map(pa.array, lanes)], names=["block", *(f"b{k}" for k in range(8))])

    return run


def contains(filter_: np.ndarray, low: int, shards: Shards, length: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the part of the filters that begins at block `low` holds, or seems to; blocks of other parts hold none."""
    block, key = block_and_key(hashes, shards.blocks[length])
    block = block.astype(np.int64) + (shards.first[length] - low)
    found = np.flatnonzero((block >= 0) & (block < len(filter_)))
    for lane in range(8):  # most are gone after the first lanes
        found = found[(filter_[block[found], lane] & lane_bits(key[found], lane)) != 0]
    return found


def probe(filter_, low: int, shards: Shards, alphabet: list[int]):
    """Edits of each word that the filters may hold. Of two near words the longer one, or the smaller at the place where they differ, names the other."""
    letters = np.array(sorted(alphabet), np.uint32)

    def candidates(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of words, code points of their edits)."""
        filters = filter_.value
        n, length = points.shape
        places = np.arange(length)
        own = place_hashes(places[None, :], points)
        total = own.sum(axis=1, dtype=np.uint64)
        if length - 1 in shards.blocks:
            # Without place i: what stands before it, and what stands after it one place earlier.
            before = np.cumsum(own, axis=1, dtype=np.uint64) - own
            moved = np.zeros_like(own)
            moved[:, 1:] = place_hashes(places[None, :-1], points[:, 1:])
            after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
            first = np.ones((n, length), bool)
            first[:, 1:] = points[:, 1:] != points[:, :-1]  # of equal neighbours one deletion is enough
            word, place = np.nonzero(first)
            found = contains(filters, low, shards, length - 1, (before + after)[word, place])
            word, place = word[found], place[found]
            if len(word):
                keep = np.ones((len(word), length), bool)
                keep[np.arange(len(word)), place] = False
                yield word, points[word][keep].reshape(len(word), length - 1)
        some = max(1, PROBES // (n * len(letters)))
        for at in range(0, length, some):  # some places at a time
            here = places[at : at + some]
            greater = letters[None, None, :] > points[:, here, None]
            word, place, letter = np.nonzero(greater)
            place += at
            changed = total[word] - own[word, place] + place_hashes(here[:, None], letters[None, :])[place - at, letter]
            found = contains(filters, low, shards, length, changed)
            word, place, letter = word[found], place[found], letter[found]
            if len(word):
                out = points[word]
                out[np.arange(len(word)), place] = letters[letter]
                yield word, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for numbers, points in by_length(words, PROBES // len(letters)):
                for word, edits in candidates(points):
                    length = edits.shape[1]
                    text = edits.tobytes().decode("utf-32-le")
                    own = numbers[word]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[k] for k in own], pa.string()), pa.array(counts[own]), pa.array([text[i * length : (i + 1) * length] for i in range(len(own))], pa.string())],
                        names=["word", "n", "near"],
                    )

    return run


def near_words(spark: SparkSession, scratch: Scratch, vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart once; `vocabulary` is a written table of distinct words.

    The filters are built by a grouped bitwise or and broadcast in parts of at most PART_BLOCKS blocks, 32 MB; a
    vocabulary of more than some 16 million words takes a pass for each part. A Bloom filter has no false negatives, and the
    join with the vocabulary takes out what it wrongly lets through, so the pairs are exact.
    """
    lengths = vocabulary.groupBy(F.length("word").alias("length")).count().collect()  # a row a word length
    if not lengths:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    shards = Shards({r["length"]: r["count"] for r in lengths})
    used = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().collect()  # at most as many as LETTERS
    alphabet = [ord(r["letter"]) for r in used if r["letter"]]
    bits = vocabulary.select("word").mapInArrow(fill(shards), "block long, " + ", ".join(f"b{k} int" for k in range(8)))
    filters = scratch.cut(bits.groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(8))), "filters")
    found = []
    for part in range(shards.parts):
        low = part * PART_BLOCKS
        rows = filters.filter((F.col("block") >= low) & (F.col("block") < low + PART_BLOCKS)).toArrow()
        held = np.zeros((PART_BLOCKS if shards.parts > 1 else sum(shards.blocks.values()), 8), np.uint32)
        held[rows["block"].to_numpy() - low] = np.stack([rows[f"b{k}"].to_numpy().view(np.uint32) for k in range(8)], axis=1)
        sent = spark.sparkContext.broadcast(held)
        found.append(scratch.cut(vocabulary.select("word", "n").mapInArrow(probe(sent, low, shards, alphabet), "word string, n long, near string"), "candidates"))
        sent.destroy()
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


# ---- forms and roots --------------------------------------------------------------------------------------------------


def follow(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: pointers are doubled until none moves, so rounds grow with the logarithm of the longest chain."""
    up = scratch.cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = scratch.cut(up.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = after.filter("moved").limit(1).count()
        up = after.drop("moved")
        if not moved:
            return up


def group_variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word: word, n, n_near, form, form_n, root.

    Words are runs of LETTERS of whole texts with A to Z in lower case. Where ODDS divides the crc32 of `<id>:<run>` the
    code point at place crc32 mod length goes. What has at least LEAST_LENGTH code points and occurs LEAST_N times is a
    word. Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its
    near word of the largest n, the smallest in code-point order of equals, if that n is at least twice the word's; the
    root is the last word that forms lead to, the word itself if it has none. n at least doubles at each step, so
    there are no circles.

    No near word is left out, and no list of a word's neighbours is made: forms are grouped minima. Null and empty texts
    have no words; a null id is the empty text; repeated rows count as often as they stand there; an empty table gives
    no rows; other columns are not read. Very long runs are words like others.
    """
    scratch = Scratch(spark, "spelling")
    vocabulary = scratch.cut(count_words(docs, id_col, text_col), "vocabulary")
    links = near_words(spark, scratch, vocabulary)
    both = F.array(F.struct(F.col("word"), F.col("n"), F.col("near"), F.col("near_n")), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = links.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.near"))
    words = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    words = scratch.cut(words, "words")
    roots = follow(scratch, words.filter("form is not null"))
    return words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark, read_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: The same rows in DuckDB, by joining what is left of words without each of their code points.
SQL = f"""
WITH RECURSIVE {CRC_CTES},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM lowered, crc_table),
cut AS (SELECT CASE WHEN h % {ODDS} = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_N}),
less AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
shorter AS (SELECT l.word AS a, v.word AS b FROM less l JOIN v ON l.rest = v.word),
near AS (
  SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
),
best AS (
  SELECT a, b, v.n, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN v ON v.word = b
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1
),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN b END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON a = v.word),
chain AS (
  SELECT word, form AS top FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.top WHERE formed.form IS NOT NULL
),
roots AS (SELECT chain.word, top FROM chain JOIN formed ON formed.word = chain.top WHERE formed.form IS NULL)
SELECT word, form, coalesce(top, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)
"""
