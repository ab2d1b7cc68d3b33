"""Components of similar things from buckets of candidates: pairs, stars and blocks, exact Jaccard, union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, connected_components

#: Stars that a bucket too large for all its pairs begins with, and what permutes names to choose their centres.
LEADERS = (0x1B873593, 0x27D4EB2F165667C5, 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def distinct(hashes):
    """The different values of an array, sorted."""
    import numpy as np

    out = np.sort(hashes)
    first = np.empty(len(out), bool)
    first[:1] = True
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]


def similar(a, b, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted arrays of distinct hashes reaches `similarity`."""
    import numpy as np

    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges the two runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (len(both) - common)


def verify(pairs: DataFrame, contents: DataFrame, sets: Callable, similarity: float) -> DataFrame:
    """(a, b, similar): the pairs of names with whether their exact Jaccard similarity reaches `similarity`.

    `contents` has a name's content (k, content), and `sets` turns a list of contents into their sets of hashes.
    """
    side = lambda x: contents.select(F.col("k").alias(x), F.col("content").alias(f"content_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, columns = [], [batch.column(i) for i in (1, 2, 3)]
            for at in range(0, batch.num_rows, 256):
                names, left, right = (c.slice(at, 256).to_pylist() for c in columns)
                new = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]  # runs of one b come together
                centres = dict(zip(new, sets([right[i] for i in new])))
                for i, own in enumerate(sets(left)):
                    centre = centres.get(i, centre) if i else centres[0]
                    out.append(similar(own, centre, similarity))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.bool_())], names=["a", "b", "similar"])

    return both.select("a", "b", "content_a", "content_b").mapInArrow(run, "a long, b long, similar boolean")


def block_links(found: list, roots: list[int], similarity: float) -> set[tuple[int, int]]:
    """Pairs of different roots of which two sets of hashes are similar, from the product of their incidences."""
    import numpy as np

    size = np.array([len(x) for x in found])
    row, every = np.repeat(np.arange(len(found)), size), np.concatenate(found)
    _, column, seen = np.unique(every, return_inverse=True, return_counts=True)
    # Hashes of one set only are in no intersection. The others in slices, to bound the matrix.
    common, shared = np.zeros((len(found), len(found)), np.float32), np.flatnonzero(seen > 1)
    place = np.full(len(seen), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    for at in range(0, len(shared), 4096):
        inside = (column >= at) & (column < at + 4096)
        m = np.zeros((len(found), 4096), np.float32)
        m[row[inside], column[inside] - at] = 1
        common += m @ m.T
    alike = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-3
    r = np.array(roots)
    i, j = np.nonzero(np.triu(alike & (r[:, None] != r[None, :]), 1))
    return {(min(a, b), max(a, b)) for a, b in zip(r[i].tolist(), r[j].tolist())}


def compare_blocks(members: DataFrame, contents: DataFrame, sets: Callable, similarity: float, block: int) -> DataFrame:
    """(a, b): links between components of a bucket, from all pairs of its members (band, k, root) in two components.

    A bucket's members are dealt to blocks of about `block` by hash, those of its largest component to blocks of their
    own, and each pair of blocks is one group of bounded size, but for two blocks of the largest component: it needs no
    links to itself. A member is repeated once per block it meets; pairs of members are never rows.
    """
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    large = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    large = large.select("band", F.col("top.root").alias("top"), blocks(F.col("top.n")).alias("tops"), blocks(F.col("all") - F.col("top.n")).alias("rest"))
    own = members.join(large, "band").withColumn("is_top", F.col("root") == F.col("top"))
    own = own.withColumn("own", F.when(F.col("is_top"), F.col("rest") + F.pmod(F.xxhash64("k"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("k"), F.col("rest"))).cast("int"))
    # Blocks 0 to rest - 1 are the small components', those behind them the largest one's.
    dealt = own.withColumn("other", F.explode(F.when(F.col("is_top"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("tops") - 1))))
    dealt = dealt.select("k", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "root").join(contents, "k")

    def run(rows):
        import pandas as pd

        links = block_links(sets(rows["content"].tolist()), rows["root"].tolist(), similarity)
        return pd.DataFrame(sorted(links), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("band", "i", "j").applyInPandas(run, "a long, b long").distinct()


def similar_components(spark: SparkSession, scratch: Scratch, rows: DataFrame, contents: Callable[[DataFrame], DataFrame], sets: Callable, similarity: float, direct: int, block: int) -> DataFrame:
    """(node, root) for every name with a similar one, from rows (k, band): the names of things and the buckets they are in.

    `contents` gives (k, content) of a table of names k. All pairs of a bucket of up to `direct` members are verified. A
    larger bucket, such as thousands of near copies make, begins with a few stars: each member against some of the
    bucket's. After union-find, large buckets that hold several components are compared block by block
    (compare_blocks), which gives a link for every two components that have one, but no pairs. So every pair that meets in
    any bucket ends in one component if it is similar. Repeated rows count once.
    """
    # Buckets of one name end here.
    w = Window.partitionBy("band")
    members = rows.withColumns({"low": F.min("k").over(w), "high": F.max("k").over(w)}).filter("low <> high").select("band", "k").distinct()
    members = scratch.cut(members, "members")
    sizes = members.groupBy("band").agg(F.count("*").alias("size"), *(F.min(F.col("k").bitwiseXOR(F.lit(x))).alias(f"lead{j}") for j, x in enumerate(LEADERS)))
    sizes = sizes.select("band", "size", F.array_distinct(F.array(*(F.col(f"lead{j}").bitwiseXOR(F.lit(x)) for j, x in enumerate(LEADERS)))).alias("leads"))
    members = scratch.cut(members.join(sizes, "band").withColumn("leads", F.when(F.col("size") > direct, F.col("leads"))), "sized")
    found = scratch.cut(contents(members.select("k").distinct()), "contents")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    small = members.filter(F.col("size") <= direct).select("band", "k")
    pairs = small.join(small.withColumnRenamed("k", "k2"), "band").filter("k < k2").select(*pair(F.col("k"), F.col("k2")))
    stars = members.filter(F.col("size") > direct).select("k", F.explode("leads").alias("k2")).filter("k <> k2").select(*pair(F.col("k"), F.col("k2")))
    pairs = pairs.unionByName(stars).distinct().repartition("b").sortWithinPartitions("b")
    edges = scratch.cut(verify(pairs, found, sets, similarity).filter("similar").select("a", "b"), "links")
    roots = scratch.cut(connected_components(spark, scratch, edges), "roots")
    large = members.filter(F.col("size") > direct).select("band", "k").join(roots.withColumnRenamed("node", "k"), "k", "left").select("band", "k", F.coalesce("root", "k").alias("root"))
    mixed = large.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    mixed = scratch.cut(large.join(mixed, "band", "left_semi"), "mixed")
    if not mixed.isEmpty():
        more = compare_blocks(mixed, found, sets, similarity, block)
        roots = connected_components(spark, scratch, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return roots
