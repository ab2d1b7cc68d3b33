"""Storage layout: clustering, compaction, file reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import REQUIRED, WAREHOUSE_TYPES, schema
from ..storage import names, remove


def cluster_by_user(df: DataFrame, path: str, key: str = "user_id", files: int | None = None) -> None:
    """Rewrite so that each file holds a range of keys, sorted: a lookup reads the files whose statistics hold its key."""
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def compact_files(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite a folder in files of about `file_bytes`; returns their number. The source stays until readers have moved.

    Nothing is shuffled: a task reads stored bytes of at most `file_bytes`, of as many files as that takes, and writes one file.
    """
    wanted = {"maxPartitionBytes": str(file_bytes), "openCostInBytes": "0", "minPartitionNum": "1"}
    before = {name: spark.conf.get(f"spark.sql.files.{name}", None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(f"spark.sql.files.{name}", value)
    try:
        spark.read.parquet(source).write.mode("overwrite").parquet(target)
    finally:
        for name, value in before.items():
            spark.conf.unset(f"spark.sql.files.{name}") if value is None else spark.conf.set(f"spark.sql.files.{name}", value)
    return sum(n.startswith("part-") for n in names(spark, target))


def file_layout_report(df: DataFrame) -> DataFrame:
    """A row per file that a table's rows are in: path, bytes, rows."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")).agg(F.count("*").alias("rows"))


def interleaved(df: DataFrame, keys: list[str], bits: int = 5) -> Column:
    """The place of a row on a curve through the keys' cells: the bits of their buckets, in turn.

    A key's 2**bits buckets have about as many rows each (approximate percentiles, one row of bounds); nulls are in the first.
    Rows that are near on the curve are near in every key, so files of a stretch of it have a narrow range of each.
    """
    shares = [k / 2**bits for k in range(1, 2**bits)]
    number = lambda c: F.unix_micros(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)
    bounds = df.agg(*(F.percentile_approx(number(k), shares, 10_000).alias(k) for k in keys)).first()
    place = F.lit(0).cast("long")
    for n, key in enumerate(keys):
        bucket = F.lit(0)
        for bound in bounds[key] or []:
            bucket = bucket + F.coalesce((number(key) >= F.lit(bound)).cast("int"), F.lit(0))
        for bit in range(bits):
            place = place + F.shiftleft(F.shiftright(bucket, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(keys) + n)
    return place


def write_clustered(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    """Rewrite in files of a range of one key, or of a stretch of the curve through several, with each file's statistics beside.

    `rows` has the data, `files` a row per file: its name, rows, and each key's least and greatest value. A lookup by
    any of the keys then opens the files that can have it (`read_matching`), which no footer has to be read for.
    """
    order = [F.col(keys[0])] if len(keys) == 1 else [interleaved(df, keys)]
    ranged = df.withColumn("_place", order[0])
    ranged = ranged.repartitionByRange(files, "_place") if files else ranged.repartitionByRange("_place")
    ranged.sortWithinPartitions("_place", *keys).drop("_place").write.mode("overwrite").parquet(f"{path}/rows")
    write_statistics(df.sparkSession, path, keys)


def write_statistics(spark: SparkSession, path: str, keys: list[str]) -> None:
    """A row per file of `path`/rows with each key's range; nulls count apart, as a range does not tell of them."""
    ranges = [f(k).alias(f"{side}_{k}") for k in keys for side, f in (("least", F.min), ("greatest", F.max))]
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("rows"), *ranges).write.mode("overwrite").parquet(f"{path}/files")


def read_matching(spark: SparkSession, path: str, **ranges: tuple) -> DataFrame:
    """Rows whose keys lie in the given closed ranges (key=(from, to)), from the files whose statistics admit them alone."""
    files, wanted = spark.read.parquet(f"{path}/files"), F.lit(True)
    for key, (low, high) in ranges.items():
        files = files.filter((F.col(f"greatest_{key}") >= F.lit(low)) & (F.col(f"least_{key}") <= F.lit(high)))
        wanted = wanted & F.col(key).between(F.lit(low), F.lit(high))
    found = [r["file_path"] for r in files.select("file_path").collect()]  # names of the files to be read
    rows = spark.read.parquet(f"{path}/rows")
    return spark.read.schema(rows.schema).parquet(*found).filter(wanted) if found else rows.limit(0)


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Files and rows that the scans of a collected frame's executed plan have read, by their own metrics."""
    found = {"files": 0, "rows": 0}

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            for name, metric in (("files", "numFiles"), ("rows", "numOutputRows")):
                found[name] += node.metrics().apply(metric).value()
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def lookup_report(spark: SparkSession, layouts: dict[str, str], lookups: dict[str, dict[str, tuple]]) -> DataFrame:
    """A row per layout (name=path, as `write_clustered` leaves it) and lookup (name=ranges): rows found, rows and files read, files there."""
    out = []
    for layout, path in layouts.items():
        files = spark.read.parquet(f"{path}/files").count()
        for lookup, ranges in lookups.items():
            counted = read_matching(spark, path, **ranges).agg(F.count("*").alias("n"))
            rows = counted.collect()[0]["n"]
            read = scan_metrics(counted)
            out.append((layout, lookup, rows, read["rows"], read["files"], files))
    return spark.createDataFrame(out, "layout string, lookup string, rows long, rows_read long, files_read long, files long")


def write_partitioned(df: DataFrame, path: str, by: str = "date", max_records: int = 0) -> None:
    """Overwrite the dates that `df` has and keep all others; with `max_records`, in parts of at most as many rows."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    (w.option("maxRecordsPerFile", max_records) if max_records else w).parquet(path)


def write_dim(df: DataFrame, path: str) -> None:
    """Replace a dimension whole, schema included, in place; `publish` is for tables that are read meanwhile."""
    df.write.mode("overwrite").parquet(path)


def publish(df: DataFrame, path: str, keep: int = 2) -> int:
    """Replace a table whole for readers of `published`: written as a version beside the old one; returns its number.

    A version counts once its write has ended (_SUCCESS), so a reader, or a job that dies meanwhile, leaves the old one
    in place; what a dead job left is written over. Versions before the `keep` newest go: the one before the last is for queries
    that still read it.
    """
    spark = df.sparkSession
    done = versions(spark, path)
    number = done[-1] + 1 if done else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number:08d}")
    for old in [*done, number][:-keep]:
        remove(spark, f"{path}/version={old:08d}")
    return number


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a published table, oldest first."""
    found = [n for n in names(spark, path) if n.startswith("version=")]
    return sorted(int(n.split("=")[1]) for n in found if "_SUCCESS" in names(spark, f"{path}/{n}"))


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a table that `publish` writes."""
    done = versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no finished version in {path}")
    return spark.read.parquet(f"{path}/version={done[-1]:08d}")


def export_features(df: DataFrame, path: str) -> None:
    """A clean copy without the partition column."""
    df.drop("date").write.mode("overwrite").parquet(path)


def warehouse_copy(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """What goes into a relational table: these columns, rows with a first column, one row a key (the least of the rest)."""
    from pyspark.sql import Window

    out = df.select(*columns).dropna(subset=[columns[0]])
    if key:
        w = Window.partitionBy(key).orderBy(*(F.asc_nulls_last(c) for c in columns if c != key))
        out = out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return out


def warehouse_projection(df: DataFrame, types: dict[str, str], required: list[str]) -> DataFrame:
    """Columns cast to the warehouse's types, rows that lack a required one left out."""
    return df.select(*(F.col(c).try_cast(t).alias(c) for c, t in types.items())).dropna(subset=required)


def warehouse_table(df: DataFrame, name: str) -> DataFrame:
    """A canonical table as the warehouse declares it: its columns and types, amounts as decimals, rows that lack a required value left out."""
    types = {f.name: WAREHOUSE_TYPES.get(f.name, f.dataType.simpleString()) for f in schema(name)}
    return warehouse_projection(df, types, REQUIRED[name])


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    df.write.mode("append").jdbc(url, table, properties=properties)
