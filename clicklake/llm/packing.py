"""Best-fit packing of documents into sequences, certified by dual-feasible-function lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, read_table, with_row_key
from .tokens import encoder_for

#: Pieces that one task packs; a piece is three numbers there.
GROUP_PIECES = 50_000


def lower_bound(lengths, capacity: int) -> int:
    """The most bins that any of a family of dual-feasible functions proves `lengths` to need.

    u(x) = x: all lengths over the capacity. f_e(x), for a threshold e of at most half the capacity: 1 above
    capacity - e, x / capacity in between, 0 below e. A function f with f(0) = 0 that sums to at most 1 over any set
    that fits into one bin makes the sum of f over all items a lower bound.
    """
    import numpy as np

    return bound_of_counts(np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1), capacity)


def bound_of_counts(count, capacity: int) -> int:
    """`lower_bound` from the number of items of each length up to `capacity`."""
    import numpy as np

    if not count.sum():
        return 0
    x = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    above = number[-1] - number[capacity - e]  # x > capacity - e
    middle = total[capacity - e] - total[e - 1]  # e <= x <= capacity - e
    best = max(int(-(-total[-1] // capacity)), int((above + -(-middle // capacity)).max()) if len(e) else 0)
    return max(best, 1)


def best_fit_decreasing(lengths, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length: longest first, each into the fullest open bin that still takes it."""
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    out: list = [None] * len(lengths)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, bins = 0, 0  # rooms: bit r is set if a bin with r left is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, at, bins = capacity, bins, bins + 1
        out[i] = (at, capacity - room)
        if left := room - size:
            open_bins[left].append(at)
            rooms |= 1 << left
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, doc_id, piece, start, length, ids_crc32: each document's ids, then `end_id`, cut if over `capacity`.

    The first piece of a longer document takes what is over whole pieces; all others have `capacity` ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for key, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.encode(batch.column(2))):
                ids += end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                ends = range(first, n + 1, capacity)
                for piece, stop in enumerate(ends):
                    start = stop - capacity if piece else 0
                    rows.append((key, doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["row_key", "doc_id", "piece", "start", "length", "ids_crc32"])

    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "row_key")
    return keyed.select("row_key", "doc_id", "text").mapInArrow(cut, "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_round(items: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    """Deal items to groups by hash and pack each: adds part, bin, offset, and used and bound of the whole part."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_key", "piece"], ignore_index=True)
        placed = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["bin"], rows["offset"] = zip(*placed)
        rows["used"], rows["bound"] = rows["bin"].max() + 1, lower_bound(rows["length"].to_numpy(), capacity)
        return rows[["row_key", "piece", "length", "part", "bin", "offset", "used", "bound"]]

    dealt = items.select("row_key", "piece", "length", F.pmod(F.xxhash64("row_key", "piece", F.lit(number)), F.lit(groups)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "row_key long, piece int, length long, part int, bin long, offset long, used long, bound long")


def pack_pieces(spark: SparkSession, scratch: Scratch, pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """row_key, piece, sequence_id, offset for every piece (row_key, piece, length).

    Full pieces are sequences of their own. The others are dealt by hash to partitions of about `group_pieces`, each
    packed best-fit decreasing. A partition whose number of bins equals its lower bound is certified and done. The
    partitions with a gap exchange documents: the contents of their bins that are not full are dealt again, to fewer
    partitions, and packed again, until every partition is certified or a round saves no bin. Only sums over the
    partitions reach the driver; a round's result is kept only if it uses fewer bins.
    """
    whole = pieces.filter(F.col("length") == capacity)
    done = [whole.select("row_key", "piece", F.lit(-1).alias("round"), F.monotonically_increasing_id().alias("bin"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("offset"))]
    items = pieces.filter(F.col("length") < capacity).select("row_key", "piece", "length")
    n, number = items.count(), 0
    groups = max(1, -(-n // group_pieces))
    best = scratch.cut(_pack_round(items, 0, groups, capacity), "packed") if n else None
    keep = lambda df, k: df.select("row_key", "piece", F.lit(k).alias("round"), "bin", "part", "offset")
    while best is not None:
        fill = best.groupBy("part", "bin").agg(F.sum("length").alias("fill"))
        gaps = best.filter("bin = 0 and offset = 0").filter("used > bound").agg(F.count("*"), F.sum("used")).first()
        if not gaps[0]:
            done.append(keep(best, number))
            break
        # What is exchanged: bins with room of partitions with a gap. Full bins and certified partitions stay.
        marked = scratch.cut(best.join(fill, ["part", "bin"]).withColumn("moves", (F.col("used") > F.col("bound")) & (F.col("fill") < capacity)), "marked")
        moving = marked.filter("moves")
        old = moving.select("part", "bin").distinct().count()
        n = moving.count()
        again = scratch.cut(_pack_round(moving, number + 1, max(1, -(-n // group_pieces)), capacity), "packed")
        new = again.select("part", "bin").distinct().count()
        if new >= old:
            done.append(keep(marked, number))
            break
        done.append(keep(marked.filter("not moves"), number))
        best, number = again, number + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    # A number for each bin: packed bins by round, partition and bin, full pieces by their place, all apart.
    sequence = F.when(F.col("round") < 0, -F.col("bin") - 1).otherwise((F.col("round").cast("long") * 1_000_000 + F.col("part")) * 10_000_000 + F.col("bin"))
    return placed.select("row_key", "piece", sequence.alias("sequence_id"), "offset")


def packing_gap(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """(sequences used, sequences that any packing of the same pieces needs), for rows with sequence_id and length.

    The bound is that of `lower_bound` over all pieces, from how many there are of each length: at most `capacity` rows.
    """
    import numpy as np

    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    counts = {r["length"]: r["n"] for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return used, bound_of_counts(np.array([counts.get(i, 0) for i in range(capacity + 1)], np.int64), capacity)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most `capacity` ids; a row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the end id alone.
    Repeated rows and equal or null ids are packed row by row. An empty table gives no rows. Other columns of `docs`
    are not read. Texts are encoded once, whole; after that only piece numbers and lengths move.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.cut(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    placed = pack_pieces(spark, scratch, pieces, capacity)
    return pieces.join(placed, ["row_key", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
