"""Media columns: payloads stored once per content in tar shards, rows that point into them, and range reads.

Stored form of a payload: an 8-bit grayscale PNG, 64 samples a row, so that the payload's bytes are the samples. A shard
is an ordinary tar file whose members are named by the payload's SHA-256. Catalog rows carry digest, shard, offset and
length of the PNG inside the shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import filesystem, join_counted, read_table, Scratch, with_row_key, write_once

WIDTH, LEVEL = 64, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, then length, type, content and checksum of the IHDR chunk.
HEADER_BYTES = 8 + 4 + 4 + 13 + 4


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, filled with zeros to a positive multiple of WIDTH; and how many they were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))


def to_png(payload: bytes) -> bytes:
    """Each row of samples after a filter byte 0 (none), compressed without loss."""
    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png made."""
    import numpy as np

    width, height, depth, colour = png_header(media[:HEADER_BYTES])
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grayscale")
    at, parts = HEADER_BYTES, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            parts.append(media[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and the share of samples that are zero."""
    import numpy as np

    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(float)
    p, x = count / count.sum(), np.arange(256)
    mean = float((p * x).sum())
    spread = float(np.sqrt(max(0.0, (p * x * x).sum() - mean * mean)))
    some = p[p > 0]
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};zeros={p[0]:.4f}"


def write_media(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Store every document's payload; returns the folder of shards and the catalog.

    A task writes one shard from its part of the table, each content once, and texts never move between tasks. A
    content that several tasks hold is in each one's shard, and all rows point to the same copy, the first by shard
    and offset. A task that runs again writes the same file under the same name.

    Catalog: row_key, doc_id, n_bytes, digest, shard, offset, length. Null text is the empty text, whose payload is 64
    zero bytes. Repeated rows and equal texts share one digest and place. An empty table gives no rows. Other columns of
    `docs` are not read.
    """
    scratch = Scratch(spark, "media")
    folder = scratch.folder("shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, places = TaskContext.get(), [], {}
        name = f"shard-{task.partitionId():06d}.tar"

        def members() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                    payload, n = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in places:
                        media = to_png(payload)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(media)
                        head = info.tobuf(tarfile.USTAR_FORMAT if info.size < 8 << 30 else tarfile.GNU_FORMAT)
                        fill = -len(media) % 512
                        places[digest] = (at + len(head), len(media))
                        at += len(head) + len(media) + fill
                        yield head + media + bytes(fill)
                    rows.append((key, doc_id, n, digest, name, *places[digest]))
            yield bytes(1024)  # the end of a tar file

        write_once(folder, name, task.taskAttemptId(), members())
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["row_key", "doc_id", "n_bytes", "digest", "shard", "offset", "length"])

    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "row_key").select("row_key", "doc_id", "text")
    rows = scratch.cut(keyed.mapInArrow(write, "row_key long, doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "written")
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count("*").alias("n")).select("digest", "n", "at.*")
    first = scratch.cut(first, "places")
    return folder, scratch.cut(join_counted(rows.select("row_key", "doc_id", "n_bytes", "digest"), first, "digest", "n", rows.count()), "catalog")


def contents(catalog: DataFrame) -> DataFrame:
    """digest, shard, offset, length, copies: one row per content, dealt so that a task reads one stretch of a shard in order."""
    own = catalog.groupBy("digest").agg(F.first("shard").alias("shard"), F.first("offset").alias("offset"), F.first("length").alias("length"), F.count("*").alias("copies"))
    return own.withColumn("block", F.floor(F.col("offset") / (8 << 20))).repartition("shard", "block").sortWithinPartitions("shard", "offset").drop("block")


def _ranges(folder: str, batch: pa.RecordBatch, most: int | None = None) -> Iterator[bytes]:
    fs, base = filesystem(folder)
    opened, at = None, None
    for shard, offset, length in zip(*(batch.column(n).to_pylist() for n in ("shard", "offset", "length"))):
        if shard != at:
            if opened:
                opened.close()
            opened, at = fs.open_input_file(f"{base}/{shard}"), shard
        yield opened.read_at(min(length, most or length), offset)
    if opened:
        opened.close()


def with_metadata(folder: str, places: DataFrame) -> DataFrame:
    """Add width, height, bit_depth and colour_type, from a read of the header's bytes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png_header(x) for x in _ranges(folder, batch, HEADER_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.int32()) for i in range(4))], names=[*batch.schema.names, "width", "height", "bit_depth", "colour_type"])

    return places.mapInArrow(run, _schema(places) + ", width int, height int, bit_depth int, colour_type int")


def with_features(folder: str, places: DataFrame) -> DataFrame:
    """Add what the stored bytes, read back, hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A payload whose SHA-256 is not the digest it is stored under is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest").to_pylist(), _ranges(folder, batch)):
                payload = from_png(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"{digest} holds other content")
                rows.append((len(payload), sha, zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return places.mapInArrow(run, _schema(places) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, catalog = write_media(spark, read_table(spark, sf_dir, "documents"))
    read = with_features(folder, with_metadata(folder, contents(catalog)))
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth"]
    read = Scratch(spark, "media-read").cut(read.select("digest", "copies", *columns), "features")
    return join_counted(catalog.select("doc_id", "n_bytes", "digest"), read, "digest", "copies", catalog.count()).select("doc_id", "n_bytes", *columns)
