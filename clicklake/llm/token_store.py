"""Token-id files: one zstandard frame a document, a shared dictionary, and an index for reading one document alone.

File format of a shard: the frames one after the other, in ascending document id. A frame is the document's ids as
little-endian unsigned 32-bit integers, compressed with the shared dictionary. The index table has, for each
document, the shard's name, the frame's offset and length, the number of ids and the dictionary's SHA-256; the
dictionary is the file `dictionary-<SHA-256>` beside the shards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, filesystem, read_table, write_once
from .tokens import encoder_for

LEVEL = 3
#: Bytes of the shared dictionary, and documents and ids of each that it is trained on (bounds of a sample by hash).
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_IDS = 64 * 1024, 1_000, 1_024
#: Documents that a dictionary is trained on at least.
LEAST_DOCS = 16
#: Characters of a text that take part in dealing equal ids to tasks: range bounds stay small, whatever the texts.
RANGE_CHARS = 32


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary from the serialized ids of at most SAMPLE_DOCS documents, those with the least hash.

    Only the compression ratio depends on the sample. A sample too small to train on is the dictionary itself.
    """
    import zstandard

    h = F.xxhash64("doc_id")
    least = docs.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]  # only hashes are sorted
    rows = docs.filter(h <= F.lit(least)).select(F.substring("text", 1, 8 * SAMPLE_IDS).alias("text")).limit(2 * SAMPLE_DOCS).collect() if least is not None else []
    ids = [x[: 4 * SAMPLE_IDS] + end_id.to_bytes(4, "little") for x in encoder_for(tokenizer).encode([r["text"] for r in rows])]
    if sum(map(len, ids)) < 2 * DICTIONARY_BYTES or len(ids) < LEAST_DOCS:
        return b"".join(ids)[:DICTIONARY_BYTES]
    return zstandard.train_dictionary(DICTIONARY_BYTES, ids, level=LEVEL).as_bytes()


def write_store(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode every document, append `end_id`, and write shards; returns the folder and the index table.

    The documents are range-partitioned by id; each task sorts its range, encodes it and writes one shard, so shards
    in the order of their names hold the ids of all documents in ascending order. A task that runs again writes the
    same file under the same name. Only ids and the texts' first characters are sampled for the ranges. Null text: the
    end id alone. Null ids come first; equal ids (repeated rows) are ordered by text. An empty table gives an empty index. Other columns of `docs` are not read.

    Index: doc_id, shard, offset, length, local_start (ids before it in its shard), n_tokens, dictionary.
    """
    scratch = Scratch(spark, "token-store")
    folder = scratch.folder("shards")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trained = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(trained).hexdigest()
    write_once(folder, f"dictionary-{digest}", 0, [trained])
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task, index = TaskContext.get(), []
        name = f"shard-{task.partitionId():06d}"
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        encoder = encoder_for(tokenizer)

        def frames() -> Iterator[bytes]:
            offset = start = 0
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for doc_id, tokens in zip(ids, encoder.encode(batch.column(1))):
                    frame = pack.compress(tokens + end)
                    n = len(tokens) // 4 + 1
                    index.append((doc_id, name, offset, len(frame), start, n))
                    offset, start = offset + len(frame), start + n
                    yield frame

        write_once(folder, name, task.taskAttemptId(), frames())
        if index:
            columns = list(zip(*index))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "shard", "offset", "length", "local_start", "n_tokens"])

    ranged = docs.withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    index = ranged.mapInArrow(write, "doc_id long, shard string, offset long, length long, local_start long, n_tokens long")
    return folder, scratch.cut(index.withColumn("dictionary", F.lit(digest)), "index")


def read_store(folder: str, index: DataFrame) -> DataFrame:
    """Read documents back through the index: one range read and one frame each, for any subset of index rows.

    Adds ids_crc32 and read_tokens (number of ids read). A frame compressed with another dictionary is an error.
    """
    schema = index.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, base = filesystem(folder)
        unpackers: dict = {}
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("shard", "offset", "length", "dictionary")}
            crc, count, opened, at = [], [], None, None
            for shard, offset, length, digest in zip(*col.values()):
                if digest not in unpackers:
                    with fs.open_input_file(f"{base}/dictionary-{digest}") as f:
                        trained = f.read()
                    if hashlib.sha256(trained).hexdigest() != digest:
                        raise ValueError(f"dictionary {digest} has other content")
                    unpackers[digest] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
                if shard != at:
                    if opened:
                        opened.close()
                    opened, at = fs.open_input_file(f"{base}/{shard}"), shard
                ids = unpackers[digest].decompress(opened.read_at(length, offset))
                crc.append(zlib.crc32(ids))
                count.append(len(ids) // 4)
            if opened:
                opened.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64()), pa.array(count, pa.int64())], names=[*batch.schema.names, "ids_crc32", "read_tokens"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", ids_crc32 long, read_tokens long"
    # Rows of one shard and block of frames go to one task, in the order of the file.
    dealt = index.withColumn("block", F.floor(F.col("offset") / (1 << 22))).repartition("shard", "block").sortWithinPartitions("shard", "offset").drop("block")
    return dealt.mapInArrow(read, out)


def with_starts(index: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before this one, from the totals of the shards (one row a shard)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return index.join(F.broadcast(totals), "shard").withColumn("start", F.col("shard_start") + F.col("local_start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, index = write_store(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_store(folder, with_starts(index)).select("doc_id", "start", F.col("read_tokens").alias("n_tokens"), "ids_crc32")
