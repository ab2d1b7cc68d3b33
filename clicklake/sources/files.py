"""Event files and staging: typed reads, schema evolution, exactly-once ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import NEW_COLUMNS, OLD_COLUMNS, schema, text_schema
from ..storage import exists


def typed(df: DataFrame, ingestion_time: str | None = None) -> DataFrame:
    """Text columns as bronze columns: a value that cannot be cast is null, a missing discount is null."""
    when = F.to_timestamp(F.lit(ingestion_time)) if ingestion_time else F.current_timestamp()
    out = []
    for f in schema("raw_events"):
        if f.name == "ingestion_time":
            out.append(when.alias(f.name))
        elif f.name in df.columns:
            out.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def read_events_csv(spark: SparkSession, path: str | Sequence[str], new: bool, ingestion_time: str | None = None) -> DataFrame:
    """Event files of the old (9) or new (10 columns) generation, read as text and cast."""
    df = spark.read.schema(text_schema(NEW_COLUMNS if new else OLD_COLUMNS)).option("header", True).csv(path)
    return typed(df, ingestion_time)


def schema_drift_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that only one of two tables has, with the side."""
    spark = a.sparkSession
    rows = [(c, "only_first") for c in a.columns if c not in b.columns] + [(c, "only_second") for c in b.columns if c not in a.columns]
    return spark.createDataFrame(rows, "column string, side string")


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def bronze_append_merge(df: DataFrame, path: str) -> None:
    """Append a batch whose columns may be more than the table's; read_merged reads all generations as one."""
    df.write.mode("append").option("mergeSchema", "true").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def bootstrap_once(spark: SparkSession, history: DataFrame, path: str) -> bool:
    """Load history if the table is absent or has no rows. A table that cannot be read is an error, not an empty one."""
    if exists(spark, path):
        if not exists(spark, f"{path}/_SUCCESS"):
            raise RuntimeError(f"{path} holds an unfinished write")
        if not spark.read.parquet(path).isEmpty():
            return False
    history.write.mode("overwrite").parquet(path)
    return True


def ingest_staged_json(spark: SparkSession, staging: str, bronze: str, checkpoint: str, ingestion_time: str | None = None, archive: str | None = None) -> None:
    """Read each staged JSON file once, cast it and append it to bronze; with `archive`, consumed files move there.

    The file source's checkpoint knows what was read, so a second call takes only new files. Files whose names start
    with `_` or `.` are not staged yet and left alone, as Spark's file source does.
    """
    reader = spark.readStream.schema(text_schema(NEW_COLUMNS))
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = typed(reader.json(staging), ingestion_time)
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(bronze)
    query.awaitTermination()


def staged_sample(spark: SparkSession, staging: str, n: int = 5) -> DataFrame:
    """The first records of a staging folder: the limit is the feature."""
    return spark.read.schema(text_schema(NEW_COLUMNS)).json(staging).limit(n)


def read_partition(df: DataFrame, day: str) -> DataFrame:
    """One date of a table partitioned by date: a typed literal, so other partitions are not read."""
    return df.filter(F.col("date") == F.lit(day).cast("date"))


def read_table_by_format(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines of nine fields as typed events, or as rejects with a reason.

    A line of fewer fields (commas inside quotes part none) or with a number that is none is rejected; an empty price is
    0.0, other empty fields are null.
    """
    names = ", ".join(f"{c} string" for c in OLD_COLUMNS)
    f = F.from_csv(F.col(column), names, {"mode": "PERMISSIVE"})
    parts = lines.select(F.col(column).alias("line"), f.alias("f"), F.size(F.split(F.regexp_replace(F.col(column), r'(^|,)"(?:[^"\\]|""|\\.)*"', "$1"), ",")).alias("fields"))
    empty = lambda c: F.nullif(F.trim(F.col(f"f.{c}")), F.lit(""))
    number = lambda c, t: empty(c).try_cast(t)
    bad = lambda c, t: empty(c).isNotNull() & number(c, t).isNull()
    ids = [c for c in ("product_id", "category_id", "user_id")]
    reason = F.when(F.col("fields") < len(OLD_COLUMNS), "short line")
    for c in ids:
        reason = reason.when(bad(c, "bigint"), f"bad {c}")
    reason = reason.when(bad("price", "double"), "bad price")
    kinds = dict.fromkeys(ids, "bigint") | {"price": "double"}
    values = [F.coalesce(number(c, "double"), F.lit(0.0)).alias(c) if c == "price" else number(c, kinds[c]).alias(c) if c in kinds else empty(c).alias(c) for c in OLD_COLUMNS]
    return parts.select("line", reason.alias("reject_reason"), *values)
