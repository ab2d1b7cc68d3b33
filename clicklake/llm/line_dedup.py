"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find; one line of each component stays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType

from .buckets import distinct, similar_components
from .common import Scratch, fresh, join_counted, read_table, slices, with_row_key

#: Characters a shingle, bands and rows a band: a pair of similarity 0.8 meets with a chance of 1 - (1 - 0.8^4)^14 > 0.999.
SHINGLE, BANDS, ROWS = 8, 14, 4
#: Jaccard similarity of two lines' sets of shingles from which on they are linked.
SIMILARITY = 0.8
#: Lines of one bucket up to which all its pairs are compared; larger ones begin with stars and go on in blocks.
DIRECT, BLOCK_LINES = 48, 512
_BLOCK = 1 << 20


def _rolled(codes, width: int):
    """64-bit hashes of all runs of `width` characters."""
    import numpy as np

    n = len(codes) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def shingle_hashes(line: str):
    """64-bit hashes of a line's character shingles, in order; a line shorter than a shingle is one shingle."""
    codes = _codes(line)
    return _rolled(codes, min(SHINGLE, len(codes)))


def batch_hashes(lines: list[str]):
    """The shingle hashes of several lines one after the other, and how many each has: as shingle_hashes line by line."""
    import numpy as np

    size = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(size)
    h = _rolled(_codes("".join(lines)), SHINGLE) if ends[-1] >= SHINGLE else np.zeros(0, np.uint64)
    out = np.zeros(ends[-1], np.uint64)
    out[: len(h)] = h
    whole = np.ones(ends[-1], bool)
    for back in range(1, SHINGLE):  # runs that begin in a line's last places reach into the next
        whole[(ends - back)[size >= back]] = False
    for i in np.flatnonzero(size < SHINGLE):
        at = ends[i] - size[i]
        out[at], whole[at] = shingle_hashes(lines[i])[0], True
    return out[whole], np.maximum(size - (SHINGLE - 1), 1)


def _permutations():
    import numpy as np

    draw = np.random.default_rng(42)
    n = BANDS * ROWS
    return (draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)), draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def signatures(lines: list[str]):
    """MinHash signatures of non-empty lines, a row each of BANDS * ROWS 32-bit minima."""
    import numpy as np

    a, b = _permutations()
    out = np.full((len(lines), len(a)), 0xFFFFFFFF, np.uint32)

    def run(first: int, hashes, starts) -> None:
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        stop, buffer = first + len(starts), np.empty_like(h)
        for j in range(len(a)):
            np.multiply(h, a[j], out=buffer)
            buffer += b[j]
            # The multiplication leaves low bits weak; they do not decide minima.
            out[first:stop, j] = np.minimum(out[first:stop, j], np.minimum.reduceat(buffer, starts))

    i = 0
    while i < len(lines):
        k, size = i, 0
        while k < len(lines) and (size := size + len(lines[k])) <= 1 << 15:  # so that buffers stay in the processor's cache
            k += 1
        if k > i:
            hashes, counts = batch_hashes(lines[i:k])
            run(i, hashes, np.cumsum(counts) - counts)
            i = k
        else:  # a very long line, in blocks
            h = shingle_hashes(lines[i])
            for at in range(0, len(h), _BLOCK):
                run(i, h[at : at + _BLOCK], np.zeros(1, np.int64))
            i += 1
    return out


def band_keys(signature):
    """A 64-bit key per line and band, different between bands."""
    import numpy as np

    out = np.empty((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(signature), band + 1, np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            h = (h ^ signature[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[:, band] = h * np.uint64(0xBF58476D1CE4E5B9)
    return out.view(np.int64)


def line_sets(lines: list[str]) -> list:
    """The sets of shingle hashes of some lines, sorted."""
    import numpy as np

    hashes, counts = batch_hashes(lines)
    return [distinct(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]


#: White space other than single spaces and line ends: only a text that has some needs its lines put together anew.
_ODD_SPACE = ("  ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


def normal_lines(text: str | None) -> list[str]:
    """A text's lines in lower case, with white space made one space and trimmed; blank lines are empty."""
    low = (text or "").lower()
    if any(mark in low for mark in _ODD_SPACE):
        return [" ".join(line.split()) for line in low.split("\n")]
    return [line.strip(" ") for line in low.split("\n")]


@F.arrow_udf(ArrayType(LongType()))
def line_names(texts: pa.Array) -> pa.Array:
    """Per line of a text its name in all that follows, the 64-bit hash of the normal line; null for blank lines."""
    import xxhash

    name = lambda line: xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) if line else None
    return pa.array([[name(line) for line in normal_lines(text)] for some in slices(texts) for text in some], pa.list_(pa.int64()))


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Names and normal lines of the texts of batches (names, text), those of a task once."""
    seen: set[int] = set()
    for batch in batches:
        for some, texts in zip(slices(batch.column(0)), slices(batch.column(1))):
            names, lines = [], []
            for own, text in zip(some, texts):
                if seen.issuperset(own):
                    continue
                for k, line in zip(own, normal_lines(text)):
                    if line and k not in seen:
                        seen.add(k)
                        names.append(k)
                        lines.append(line)
            if len(seen) > 200_000:  # repeats beyond are sorted out by the next step
                seen.clear()
            if names:
                yield names, lines


def _band_rows(docs: DataFrame) -> DataFrame:
    """(k, band): per distinct line of a task its name and each of its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for names, lines in _distinct_lines(batches):
            keys = band_keys(signatures(lines))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), BANDS)), pa.array(keys.ravel())], names=["k", "band"])

    return docs.select("names", "text").mapInArrow(run, "k long, band long")


def _texts(docs: DataFrame) -> DataFrame:
    """(k, content): per distinct line of a task its name and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lines in _distinct_lines(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lines, pa.string())], names=["k", "content"])

    return docs.select("names", "text").mapInArrow(run, "k long, content string")


def line_classes(spark: SparkSession, scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(node, root) for every line (by name) that a similar line exists for; docs has names (line_names) and text.

    A bucket is the distinct lines with one band key; what meets in any bucket is verified (buckets.similar_components).
    """

    def texts(wanted: DataFrame) -> DataFrame:
        return _texts(docs).join(wanted, "k", "left_semi").dropDuplicates(["k"])

    return similar_components(spark, scratch, _band_rows(docs), texts, line_sets, SIMILARITY, DIRECT, BLOCK_LINES)


def removed_lines(spark: SparkSession, scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(row_key, removed): per row of docs (row_key, doc_id, names, text) with lines that go their sorted numbers.

    Of each component of similar lines, equal ones included, the first line stays: by doc_id (null last), row and place.
    """
    roots = line_classes(spark, scratch, docs)
    lines = docs.select("row_key", "doc_id", F.posexplode("names").alias("line_no", "k")).filter("k is not null")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "line_no")
    firsts = lines.groupBy("k").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classes = firsts.join(roots.withColumnRenamed("node", "k"), "k", "left").filter("n > 1 or root is not null").select("k", F.coalesce("root", "k").alias("root"), "first", "n")
    classes = scratch.cut(classes, "classes")  # only lines that some other line repeats or resembles
    kept = classes.groupBy("root").agg(F.min("first").alias("kept"))
    kept = scratch.cut(classes.join(kept, "root").select("k", "n", F.col("kept.row_key").alias("kept_row"), F.col("kept.line_no").alias("kept_line")), "kept")
    total = docs.agg(F.sum(_number_of("names"))).first()[0] or 0
    found = join_counted(lines.select("row_key", "line_no", "k"), kept, "k", "n", total).filter("row_key <> kept_row or line_no <> kept_line")
    return found.groupBy("row_key").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))  # a document's own lines


def _number_of(names: str):
    """The number of lines that are not blank."""
    return F.size(F.filter(F.col(names), lambda k: k.isNotNull())).cast("long")


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """`docs` with the repeated and near-repeated lines taken out of its texts; with `counts`, also n_lines and n_removed.

    Every row stays, in order of nothing in particular; a text whose lines all go becomes empty, and a null text stays
    null. Blank lines stay. Lines are compared in lower case with white space made one; shorter ones than a shingle are
    equal or not. All columns are kept as they are, whatever their names; `counts` needs the names n_lines and
    n_removed to be free. Repeated rows keep their lines in the first row only. An empty table stays empty.

    The rows, with a key each and their lines' names, are written once; all steps read them from there.
    """
    key, names, gone = fresh(docs, "row_key"), fresh(docs, "names"), fresh(docs, "removed")
    scratch = Scratch(spark, "lines")
    own = scratch.cut(with_row_key(docs, key).withColumn(names, line_names(F.col(f"`{text_col}`"))), "keyed")
    plain = own.select(F.col(key).alias("row_key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(names).alias("names"), F.col(f"`{text_col}`").alias("text"))
    found = removed_lines(spark, scratch, plain).select(F.col("row_key").alias(key), F.col("removed").alias(gone))

    @F.arrow_udf("string")
    def without(texts: pa.Array, removed: pa.Array) -> pa.Array:
        changed, out = removed.is_valid(), []
        for some, numbers in zip(slices(texts.filter(changed)), slices(removed.filter(changed))):
            for text, own in zip(some, numbers):
                drop = set(own)
                out.append("\n".join(line for j, line in enumerate(text.split("\n")) if j not in drop))
        return pc.replace_with_mask(texts, changed, pa.array(out, texts.type))

    joined = own.join(found, key, "left").withColumn(text_col, without(F.col(f"`{text_col}`"), F.col(gone)))
    columns = [f"`{c}`" for c in docs.columns]
    if counts:
        return joined.select(*columns, _number_of(names).alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"))
    return joined.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(spark, docs, counts=True)
