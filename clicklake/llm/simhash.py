"""SimHash near-duplicates: links at few differing bits by one-wildcard segment variants; similar texts by wide fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from .buckets import distinct, similar_components
from .common import Scratch, connected_components, fresh, join_counted, read_table, slices, with_row_key

#: Fingerprints of one segment value up to which they are compared with each other directly.
DIRECT = 256
#: Wide fingerprints: segments of 32 bits, variants of a segment in the index, and of its least certain bits as many as they
#: choose from. Two texts of similarity 0.8 share a variant with a chance of 0.92, at 0.85 of over 0.99.
SEGMENTS, VARIANTS, UNSURE = 16, 12, 8
#: Words a shingle and similarity of near copies; texts of one bucket up to which all pairs are compared, and of a block.
WORDS, SIMILARITY, PAIRWISE, BLOCK_TEXTS = 5, 0.8, 32, 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles as an unsigned integer.

    A-Z are lower-cased, words are runs of characters other than space and U+0009 to U+000D, and a shingle is
    `shingle` words joined by spaces, counted as often as it occurs (fewer words: all of them). Each is hashed with
    XXH64, seed 42; a bit is 1 if it is set in more than half the hashes. No words (or null): zero.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    for at in range(0, n, 1 << 16):
        h = np.fromiter(map(xxhash.xxh64_intdigest, (s for s, _ in zip(shingles, range(min(1 << 16, n - at)))), repeat(42)), "<u8", min(1 << 16, n - at))
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str, shingle: int = 3) -> DataFrame:
    """The columns `keep` and fp, the fingerprint as a signed 64-bit number."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values)], names=[*keep, "fp"])

    return docs.select(*keep, text_col).mapInArrow(run, f"{schema}, fp long")


def _segment(i: int):
    """Segment i (0: low, 1: high 32 bits) of fp, as a long."""
    return F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))


def links(spark: SparkSession, scratch: Scratch, fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) among distinct fingerprints fp: enough links at `distance` (1 to 3) or fewer differing bits for exact components.

    Up to three differing bits leave one of two 32-bit segments with one at most. The index has each fingerprint under both of
    its segments' values; it is looked up with the same value and with each set bit of the segment cleared (the variant
    with that bit as wildcard, from the side that has it), and every hit is verified on all 64 bits. So each pair whose
    segment differs by one bit meets once. Segment values of more than DIRECT fingerprints, which large groups of near
    copies make, are not compared pair by pair: their members get all variants with `distance` of 64 bits masked; a
    bucket of these holds at most 2^distance fingerprints, all of them linked to its least.
    """
    if not 1 <= distance <= 3:
        raise ValueError("two segments find links at 1 to 3 differing bits")
    index = None
    for i in (0, 1):
        own = fps.select("fp", F.lit(i).alias("seg"), _segment(i).alias("val"))
        index = own if index is None else index.unionByName(own)
    sizes = index.groupBy("seg", "val").agg(F.count("*").alias("n"))
    hot = scratch.cut(sizes.filter(F.col("n") > DIRECT).select("seg", "val", F.lit(True).alias("hot")), "hot")
    index = scratch.cut(index.join(hot, ["seg", "val"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "index")
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)
    places = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda p: F.col("val").bitwiseAND(bit(p)) != 0)
    keys = F.concat(F.array(F.col("val")), F.transform(places, lambda p: F.col("val") - bit(p)))
    variants = index.select(F.col("fp").alias("a"), "seg", "hot", F.col("val").alias("from"), F.explode(keys).alias("key"))
    other = index.select(F.col("fp").alias("b"), "seg", F.col("val").alias("key"), F.col("hot").alias("hot_b"))
    found = variants.join(other, ["seg", "key"]).filter("not (hot and hot_b)").filter("key <> from or a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    if hot.isEmpty():
        return found.distinct()
    # Every choice of `distance` places, made one place at a time, each after the one before.
    masked = index.filter("hot").select("fp").distinct().select("fp", F.lit(-1).alias("last"), F.lit(0).cast("long").alias("mask"))
    for left in range(distance - 1, -1, -1):
        masked = masked.select("fp", "mask", F.explode(F.sequence(F.col("last") + 1, F.lit(63 - left))).alias("last")).withColumn("mask", F.col("mask").bitwiseOR(bit(F.col("last"))))
    stars = masked.groupBy("mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("key")).agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    stars = stars.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("a <> b")
    return found.unionByName(stars).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """Per row: doc_id, row_key, fp (signed), root (least fp of the component), component_id (least doc_id that links lead to).

    Texts are fingerprinted whole. Equal fingerprints are one node, so copies cost nothing beyond their rows. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows stay rows of their own. A component whose
    ids are all null has component_id null. An empty table gives no rows. Other columns of `docs` are not read.
    """
    scratch = Scratch(spark, "simhash")
    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "row_key")
    rows = scratch.cut(fingerprints(keyed, ["row_key", "doc_id"], "text", shingle), "fingerprints")
    nodes = scratch.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(spark, scratch, links(spark, scratch, nodes.select("fp"), distance))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.cut(named.join(component, "root").select("fp", "n", "root", "component_id"), "classes")
    return join_counted(rows, classes, "fp", "n", rows.count()).select("doc_id", "row_key", "fp", "root", "component_id")


def words_of(text: str | None) -> list[bytes]:
    """A text's words as in `fingerprint`."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int = WORDS):
    """XXH64 (seed 42) of a text's shingles; fewer words are one shingle."""
    import numpy as np
    import xxhash

    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if n > 1 else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), "<u8", n)


@F.arrow_udf(LongType())
def text_names(texts: pa.Array) -> pa.Array:
    """A text's name: the 64-bit hash of its words."""
    import xxhash

    return pa.array([xxhash.xxh64_intdigest(b" ".join(words_of(t))) - (1 << 63) for some in slices(texts) for t in some], pa.int64())


def wide_counts(hashes):
    """Per bit of the wide fingerprint by how much more of the hashes have it than not."""
    import numpy as np

    counts, n = np.zeros(32 * SEGMENTS, np.int64), len(hashes)
    factors = np.random.default_rng(42).integers(0, 1 << 63, SEGMENTS // 2, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    for at in range(0, n, 255):  # so that bytes can count
        h = hashes[at : at + 255, None] * factors
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * counts - n


def segment_variants(counts):
    """A 64-bit key for each segment and variant, from the counts of some texts (texts x bits).

    A variant is the segment with some of its least certain bits turned, those nearest to as many hashes with as without
    them: the segment itself, each such bit as wildcard alone, or a few. Of all choices those with the least sum of squared counts are taken.
    """
    import numpy as np

    choices = [c for k in range(5) for c in combinations(range(UNSURE), k)]
    turned = np.zeros((len(choices), UNSURE), np.uint64)
    for i, c in enumerate(choices):
        turned[i, list(c)] = 1
    m = counts.reshape(-1, SEGMENTS, 32)
    base = ((m > 0) << np.arange(32, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    size = np.abs(m)
    unsure = np.argsort(size, axis=2, kind="stable")[:, :, :UNSURE]
    score = np.take_along_axis(size, unsure, 2).astype(float) ** 2 @ turned.T.astype(float)
    best = np.argsort(score, axis=2, kind="stable")[:, :, :VARIANTS]
    bits = np.uint64(1) << unsure.astype(np.uint64)
    flips = bits @ turned.T
    keys = base[:, :, None] ^ np.take_along_axis(flips, best, 2)
    keys |= np.arange(SEGMENTS, dtype=np.uint64)[None, :, None] << np.uint64(32)
    return keys.reshape(len(m), -1).view(np.int64)


def _variant_rows(docs: DataFrame) -> DataFrame:
    """(k, band): per distinct text of a task its name and each key of its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seen: set[int] = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at in range(0, len(names), 256):
                new = [i for i in range(at, min(at + 256, len(names))) if names[i] not in seen and not seen.add(names[i])]
                if len(seen) > 200_000:  # repeats beyond are sorted out by the next step
                    seen.clear()
                if new:
                    counts = np.array([wide_counts(shingle_hashes(words_of(batch.column(1)[i].as_py()))) for i in new])
                    keys = segment_variants(counts)
                    own = np.repeat(np.array([names[i] for i in new], np.int64), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(keys.ravel())], names=["k", "band"])

    return docs.select("k", "text").mapInArrow(run, "k long, band long")


def near_copies(spark: SparkSession, scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(node, root) for every text (by name) with a near copy, from docs (row_key, k, text): similarity 0.8 of five-word shingles.

    A fingerprint of 64 bits cannot tell such texts: at 0.8 they differ in ten bits, so segments short enough for one
    differing bit would hold too many others. So this one has 512 bits from the same shingle hashes, and of its 16 segments
    one has to agree up to bits that are uncertain in both texts; these are the wildcards of the variants that are
    indexed. Texts with a common variant are verified by the Jaccard similarity of their sets of shingles.
    """

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([distinct(shingle_hashes(words_of(t))).tobytes() for some in slices(texts) for t in some], pa.binary())

    def contents(wanted: DataFrame) -> DataFrame:
        one = docs.groupBy("k").agg(F.min("row_key").alias("row_key")).join(wanted, "k", "left_semi").select("row_key")
        return docs.join(one, "row_key", "left_semi").select("k", sets("text").alias("content"))

    def hashes(content: list[bytes]) -> list:
        import numpy as np

        return [np.frombuffer(x, "<u8") for x in content]

    return similar_components(spark, scratch, _variant_rows(docs), contents, hashes, SIMILARITY, PAIRWISE, BLOCK_TEXTS)


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one of each group of near copies: the one with the least id, of repeated rows the first in the input.

    Texts are lower-cased (A-Z) and compared by their five-word shingles, linked from a similarity of 0.8 on (near_copies);
    equal texts are one node, so copies cost nothing beyond their rows. Null and empty texts are copies of each other. All
    columns are kept as they are, whatever their names. Rows without an id come after those with one. An empty table stays empty.
    The rows, with a key each, are written once; all steps read them from there.
    """
    scratch = Scratch(spark, "near-copies")
    key, name = fresh(docs, "row_key"), fresh(docs, "k")
    keyed = scratch.cut(with_row_key(docs, key).withColumn(name, text_names(F.col(f"`{text_col}`").cast("string"))), "keyed")
    plain = keyed.select(F.col(key).alias("row_key"), F.col(name).alias("k"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    roots = near_copies(spark, scratch, plain.select("row_key", "k", "text"))
    # The least (id, row) of a text, then of a component: map-side combined minima.
    best = plain.groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("best"))
    best = best.join(roots.withColumnRenamed("node", "k"), "k", "left").groupBy(F.coalesce("root", "k")).agg(F.min("best").alias("best"))
    return keyed.join(best.select(F.col("best.row_key").alias(key)), key, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
