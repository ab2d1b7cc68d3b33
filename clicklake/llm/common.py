"""What the text operators share: row keys, shared scratch tables and files, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add a 64-bit key that is unique per row, so repeated ids and repeated rows stay apart.

    The key is a row's place in its input partition, and two scans of a table can be split differently (as executors
    come and go). So what needs the key twice writes the keyed rows once (`Scratch.cut`) and reads them from there.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


#: A key with more than one in so many of all rows is hot; there are at most as many hot keys.
HOT_SHARE = 1_000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of `left` with `right`, a row per key with the number `count` of rows that the key has in `left`.

    Keys with more than a HOT_SHARE-th of the `total` rows of `left`, at most HOT_SHARE of them, are broadcast, so no
    key's rows have to meet in one task; the rest is joined by shuffle.
    """
    hot = F.broadcast(right.filter(F.col(count) * HOT_SHARE > total).drop(count))
    rest = right.filter(F.col(count) * HOT_SHARE <= total).drop(count)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(rest, key))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"{name}_"
    return name


def slices(column, rows: int = 1_000):
    """A column's values some rows at a time, so that few are Python objects at once."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


class Scratch:
    """A folder of its own under the shared folder, for tables that cut lineage and for the operators' files.

    Tables are ordinary Parquet: a lost executor costs a re-read, not a recomputation of everything before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self._n = spark, shared_folder(spark, label), 0

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Write `df` and return the written table."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def folder(self, label: str) -> str:
        """A new folder's URI, for files that tasks write with pyarrow's file systems."""
        self._n += 1
        return f"{self.path}/{self._n:03d}-{label}"


def filesystem(uri: str):
    """pyarrow's file system for a folder's URI (or plain absolute path), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, name: str, attempt: int, chunks) -> None:
    """Write a file under a name of this attempt, then rename it: a repeated or second attempt ends with the same file."""
    fs, base = filesystem(uri)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{attempt}"
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, f"{base}/{name}")


def connected_components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that can be reached.

    Alternating large-star and small-star rounds: every step is a grouped minimum and an equality join, so a hub
    with very many neighbours is combined map-side and no neighbour list is ever gathered. The number of rounds
    grows with the logarithm of the longest path. Null ends and loops are ignored; no edges give no rows.
    """
    pairs = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.cut(pairs, "edges")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.cut(small.filter("u <> v").distinct(), "edges")
        scratch.drop(pairs)
        pairs = after
        # The edges are stars around minima once a round leaves them as they were: count and exact checksum.
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_distinct("u")).first()
        if row[0] == row[2] and tuple(row) == seen:
            break
        seen = tuple(row)
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


#: DuckDB has no crc32: its table of 256 entries from the definition, to go after WITH RECURSIVE, and a fold over a text's bytes.
CRC_CTES = """bits AS (
  SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB SQL of a text's crc32, where crc_table is joined."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT)"
