"""Hard negatives: one-bit codes of rotated vectors and their residuals bound every score; what the bounds leave is scored exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read_table, with_row_key

#: Components count in 256ths. Codes of a vector, each of what the ones before leave over; bits of an anchor's components.
SCALE, LEVELS, BITS = 256, 5, 8
#: Positives of an anchor and negatives of a positive; a negative's score in per cent of the positive's, from and to.
POSITIVES, NEGATIVES, FROM, TO = 5, 3, 50, 95
#: Numbers of the anchors that are broadcast at a time (8 MB), pairs bounded at a time, and rows of a task.
BLOCK, TILE, TASK_ROWS = 1 << 20, 1 << 19, 1 << 15
NO_ID = np.iinfo(np.int64).max


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(42).standard_normal((dims, dims)))[0]


def padded(vectors: list[list[float]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words; the rows' length is a multiple of 64."""
    return np.packbits(bits, axis=1).view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, words), alignments (row, level), and the last residual's norm.

    At each level what is left over is rotated once more. With b the vector of its signs, scaled to norm 1, the alignment
    is the inner product with b, and what the next level takes up is orthogonal to b.
    """
    left = vectors
    root = np.sqrt(vectors.shape[1])
    codes, aligned = [], []
    for _ in range(LEVELS):
        left = left @ turn.T
        signs = left >= 0
        a = np.abs(left).sum(axis=1) / root
        left = left - np.where(signs, 1.0, -1.0) * (a / root)[:, None]
        codes.append(packed(signs))
        aligned.append(a)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.linalg.norm(left, axis=1)


class Anchors:
    """A block of anchors: exact components, and for each level the rotated ones as bit planes of BITS-bit numbers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, turn: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norm = np.linalg.norm(vectors, axis=1)
        self.low, self.step, self.planes, self.total, self.error = [], [], [], [], []
        turned = vectors
        for _ in range(LEVELS):
            turned = turned @ turn.T
            low = turned.min(axis=1)
            step = np.maximum((turned.max(axis=1) - low) / ((1 << BITS) - 1), np.finfo(float).tiny)
            grid = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            near = low[:, None] + step[:, None] * grid
            self.planes.append(np.stack([packed((grid >> j) & 1 == 1) for j in range(BITS)], axis=1))
            self.low.append(low)
            self.step.append(step)
            self.total.append(near.sum(axis=1))
            self.error.append(np.linalg.norm(turned - near, axis=1))

    def bounds(self, rows: Rows, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above the scores of the anchors `some` with all rows, in any case (Cauchy-Schwarz).

        The estimate sums alignments times inner products with codes, which are popcounts over planes. What it leaves out is
        the anchor's part orthogonal to the last code times the last residual, and each level's distance from the grid
        times the alignment.
        """
        root = np.sqrt(self.vectors.shape[1])
        estimate = half = 0.0
        for level in range(LEVELS):
            code = rows.codes[:, level, :]
            plus = self.low[level][some, None] * np.bitwise_count(code).sum(axis=1)[None, :]
            for j in range(BITS):
                both = np.bitwise_count(self.planes[level][some, None, j, :] & code[None])
                both = both[:, :, 0] if both.shape[2] == 1 else both.sum(axis=2, dtype=np.int64)
                plus = plus + (self.step[level][some, None] * (1 << j)) * both
            inner = (2 * plus - self.total[level][some, None]) / root
            estimate = estimate + inner * rows.aligned[None, :, level]
            half = half + self.error[level][some, None] * rows.aligned[None, :, level]
        along = np.maximum(np.abs(inner) - self.error[-1][some, None], 0)
        across = np.sqrt(np.maximum(self.norm[some, None] ** 2 - along**2, 0))
        half = half + across * rows.rest[None, :] + 1e-9 * self.norm[some, None] * rows.norm[None, :] + 1e-6
        return estimate - half, estimate + half

    def scores(self, which: np.ndarray, rows: Rows, row: np.ndarray) -> np.ndarray:
        """Exact inner products of pairs. Where doubles could round, in whole numbers of any size; beyond 64 bits they stay at the limit."""
        out = np.empty(len(which), np.int64)
        dims = self.vectors.shape[1]
        exact = np.abs(self.vectors).max(initial=0) * np.abs(rows.vectors).max(initial=0) * dims < 2**53
        some = max(1, (1 << 20) // dims)
        for at in range(0, len(which), some):
            a, b = self.vectors[which[at : at + some]], rows.vectors[row[at : at + some]]
            if exact:
                out[at : at + some] = np.einsum("ij,ij->i", a, b).astype(np.int64)
            else:
                info = np.iinfo(np.int64)
                out[at : at + some] = [min(info.max, max(info.min, sum(int(x) * int(y) for x, y in zip(p, q)))) for p, q in zip(a, b)]
        return out


class Rows:
    """Some rows of the index."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        self.ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
        self.labels = batch.column("label").to_numpy()
        self.vectors = np.frombuffer(b"".join(batch.column("scaled").to_pylist()), np.float64).reshape(-1, dims)
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint64).reshape(-1, LEVELS, dims // 64)
        self.aligned = np.frombuffer(b"".join(batch.column("aligned").to_pylist()), np.float64).reshape(-1, LEVELS)
        self.rest = batch.column("rest").to_numpy()
        self.norm = np.linalg.norm(self.vectors, axis=1)

    def part(self, which: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        for name, value in vars(self).items():
            setattr(out, name, value[which])
        return out


def largest(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest value; minus infinity in rows of fewer."""
    return np.full(len(values), -np.inf) if values.shape[1] < k else -np.partition(-values, k - 1, axis=1)[:, k - 1]


class Best:
    """The first k of each group by score, then id."""

    def __init__(self, groups: int, k: int):
        self.groups, self.k = groups, k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, -np.inf)  # the k-th score so far

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, group))  # ~ turns the order round and cannot overflow
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        keep = rank < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.least[self.group[last]] = self.score[last]

    def batch(self, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.group), pa.array(self.score), pa.array(self.id, mask=self.id == NO_ID)], names=[name, "score", "vec_id"])


def tiles(batch: pa.RecordBatch, dims: int, anchors: int) -> Iterator[Rows]:
    some = max(1, TILE // max(1, anchors))
    for at in range(0, batch.num_rows, some):
        yield Rows(batch.slice(at, some), dims)


def find_positives(sent, dims: int, k: int):
    """Each anchor's best rows of its own label, but for itself, among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        best = Best(len(anchors.ids), k)
        for batch in batches:
            for rows in tiles(batch, dims, len(anchors.ids)):
                for label in np.intersect1d(rows.labels, anchors.labels):
                    own, part = np.flatnonzero(anchors.labels == label), rows.part(np.flatnonzero(rows.labels == label))
                    low, high = anchors.bounds(part, own)
                    itself = anchors.ids[own, None] == part.ids[None, :]
                    low[itself] = high[itself] = -np.inf
                    least = np.maximum(best.least[own], largest(low, k))
                    a, r = np.nonzero(~(high < least[:, None]) & ~itself)
                    best.add(own[a], anchors.scores(own[a], part, r), part.ids[r])
        yield best.batch("anchor")

    return run


def window_of(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest negative score that goes with a positive one: FROM and TO per cent, in whole numbers."""
    score = [int(s) for s in score]
    return np.array([-(-s * FROM // 100) for s in score], np.int64), np.array([s * TO // 100 for s in score], np.int64)


def find_negatives(sent, pairs, dims: int, k: int):
    """For each pair of anchor and positive the best rows of other labels whose score lies in the pair's window, among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        of, low_end, high_end = pairs.value
        best = Best(len(of), k)
        # Each anchor's pairs by number: the first, the second and so on.
        turn = np.arange(len(of)) - np.searchsorted(of, of)
        rounds = [np.flatnonzero(turn == t) for t in range(int(turn.max(initial=-1)) + 1)]
        every = np.arange(len(anchors.ids))
        for batch in batches:
            for rows in tiles(batch, dims, len(every)):
                low, high = anchors.bounds(rows, every)
                other = anchors.labels[:, None] != rows.labels[None, :]
                wanted = np.zeros(other.shape, bool)
                for own in rounds:
                    a = of[own]
                    lo, hi = low[a], high[a]
                    # Rows that lie in the window whatever their score is: the k-th best of their lower bounds must be met.
                    sure = np.where(other[a] & (hi <= high_end[own, None]) & (lo >= low_end[own, None]), lo, -np.inf)
                    least = np.maximum(np.maximum(best.least[own], largest(sure, k)), low_end[own])
                    wanted[a] |= other[a] & ~(lo > high_end[own, None]) & ~(hi < least[:, None])
                a, r = np.nonzero(wanted)
                score = anchors.scores(a, rows, r)
                for own in rounds:
                    pair = np.full(len(every), -1)
                    pair[of[own]] = own
                    p = pair[a]
                    fits = np.flatnonzero((p >= 0) & (score >= low_end[p]) & (score <= high_end[p]))
                    best.add(p[fits], score[fits], rows.ids[r[fits]])
        yield best.batch("pair")

    return run


def build_index(rows: DataFrame, dims: int):
    """Rows with finite components, scaled, with codes, alignments and the last residual's norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                lists = part.column(2).to_pylist()
                use = [k for k, v in enumerate(lists) if all(x is not None and np.isfinite(SCALE * float(x)) for x in v)]
                vectors = np.floor(SCALE * padded([lists[k] for k in use], dims))
                codes, aligned, rest = encode(vectors, turn)
                part = part.take(pa.array(use, pa.int64()))
                as_bytes = lambda x: pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), as_bytes(vectors), as_bytes(codes), as_bytes(aligned), pa.array(rest, pa.float64())], names=["vec_id", "label", "scaled", "codes", "aligned", "rest"])

    return rows.mapInArrow(run, "vec_id long, label long, scaled binary, codes binary, aligned binary, rest double")


def first_of(found: DataFrame, group: str, k: int) -> DataFrame:
    """The best k rows of each group, best first (rank from 1). Every task has k of them at most, and the limit also acts before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(spark: SparkSession, vectors: DataFrame, anchors: str = "vec_id % 50 = 0", id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor's positives.

    `anchors` is a condition on vec_id. A row's components x count as floor(256 x); a score is the inner product of two
    rows, higher ones and then smaller ids come first. An anchor's positives are its first POSITIVES other rows of its label;
    a positive's negatives are the first NEGATIVES rows of other labels whose score is FROM to TO per cent of its own.

    Every row is compared with every anchor, in blocks of anchors that are broadcast (BLOCK numbers at most), by its
    codes: bounds that hold in any case decide which pairs are scored exactly, so the result is that of scoring all pairs. Tasks
    keep the best few for each anchor and positive, so no anchor's rows are gathered. Groups of one label or hot
    vectors have no task of their own.

    Rows with a null label, vector or component, or one that is not finite (256-fold), take no part. Shorter vectors count
    as filled up with zeros. A row without id is no anchor and comes last of equal scores; rows with the anchor's id
    are not its positives; repeated anchors are each mined. Scores beyond 64 bits count as the limit. An empty table, or
    one without anchors, gives no rows; other columns are not read.
    """
    scratch = Scratch(spark, "hard-negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).filter("label is not null and vector is not null")
    count, longest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    dims = 64 * max(1, -(-(longest or 0) // 64))
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
    index = scratch.cut(build_index(rows, dims).repartition(tasks), "index")
    starts = scratch.cut(with_row_key(index.filter(anchors).select("vec_id", "label", "scaled"), "row_key"), "anchors")
    turn, last, blocks = rotation(dims), -1, []
    while True:
        some = starts.filter(F.col("row_key") > last).orderBy("row_key").limit(max(1, BLOCK // dims)).toArrow()
        if not some.num_rows:
            break
        last = int(some["row_key"][-1].as_py())
        block = Anchors(some["vec_id"].to_numpy(), some["label"].to_numpy(), np.frombuffer(b"".join(some["scaled"].to_pylist()), np.float64).reshape(-1, dims), turn)
        sent = spark.sparkContext.broadcast(block)
        # At most POSITIVES rows an anchor of the block.
        chosen = first_of(index.mapInArrow(find_positives(sent, dims, POSITIVES), "anchor long, score long, vec_id long"), "anchor", POSITIVES).orderBy("anchor", "rank").toArrow()
        of, score = chosen["anchor"].to_numpy(), chosen["score"].to_numpy()
        pairs = spark.sparkContext.broadcast((of, *window_of(score)))
        found = first_of(index.mapInArrow(find_negatives(sent, pairs, dims, NEGATIVES), "pair long, score long, vec_id long"), "pair", NEGATIVES)
        table = pa.table({"pair": np.arange(len(of)), "anchor_id": pa.array(block.ids[of]), "positive_id": chosen["vec_id"], "positive_score": chosen["score"]})
        named = spark.createDataFrame(table) if len(of) else None
        if named is not None:
            out = found.join(F.broadcast(named), "pair").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            blocks.append(scratch.cut(out, "negatives")._scratch_path)
        sent.destroy()
        pairs.destroy()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(kind).parquet(*blocks) if blocks else spark.createDataFrame([], kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(spark, rows)


#: All anchors against all rows, plainly.
SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {FROM} * positive_score <= 100 * score AND 100 * score <= {TO} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
