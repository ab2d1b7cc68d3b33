"""Audits: nulls, values, cardinality, skew, lateness, throughput, discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import stored


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null and null rows, per cent of null. One aggregate over all columns, then turned."""
    kinds = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), (F.col("_n") - F.col(f"`{c}`")).alias("non_null"), F.col(f"`{c}`").alias("nulls")) for c in df.columns))
    return counts.select("_n", F.explode(rows).alias("r")).select("r.*", F.round(100 * F.col("r.nulls") / F.col("_n"), 4).alias("null_pct"))


def cardinality_profile(df: DataFrame, columns: list[str], rsd: float | None = None) -> DataFrame:
    """Per column: distinct values and their ratio to rows; exact, or by HyperLogLog with `rsd`."""
    distinct = F.count_distinct if rsd is None else lambda c: F.approx_count_distinct(c, rsd)
    one = df.agg(F.count("*").alias("_n"), *(distinct(c).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in columns))
    return one.select("_n", F.explode(rows).alias("r")).select("r.column", "r.distinct", F.round(F.col("r.distinct") / F.col("_n"), 6).alias("ratio"))


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Per value: rows, per cent of non-null rows and of all rows. The totals are sums over the values, one row."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("_some"))
    return counts.join(F.broadcast(total)).select("value", "n", F.when(F.col("value").isNotNull(), F.round(100 * F.col("n") / F.col("_some"), 4)).alias("pct_non_null"), F.round(100 * F.col("n") / F.col("_all"), 4).alias("pct_all"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; the value breaks ties."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def cumulative_share(df: DataFrame, column: str) -> DataFrame:
    """Values by falling count with rank and running share, from range partitions and their totals (with_row_numbers)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranked = with_row_numbers(counts.withColumn("_down", -F.col("n")), ["_down", "value"], running="n")
    total = ranked.agg(F.sum("n").alias("_all"))  # one row
    share = F.round(100 * F.col("n_running") / F.col("_all"), 4).alias("cumulative_pct")
    return ranked.join(F.broadcast(total)).select("value", "n", F.col("rn").cast("int").alias("rank"), share)


def skew_profile(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Keys, rows, rows of the k hottest keys and their share, greatest and median rows of a key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    counts = stored(df.sparkSession, counts, "counts")
    hot = counts.orderBy(F.desc("n"), "key").limit(k).agg(F.sum("n").alias("hot_rows"))
    one = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("max_rows"))
    return one.join(exact_percentiles(counts, "n", median_rows=0.5)).join(hot).withColumn("hot_ratio", F.round(F.col("hot_rows") / F.col("rows"), 6))


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys with more than `share` of all rows: fewer than 1 / share rows, whatever the table's size."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).filter(F.col("n") > F.col("_all") * share).select(key, "n")


def stream_partition_profile(records: DataFrame, key: str = "user_id") -> DataFrame:
    """Messages and keys per partition, and keys that are in more than one."""
    spread = records.groupBy(key).agg(F.count_distinct("partition").alias("_p")).filter("_p > 1").agg(F.count("*").alias("keys_on_many"))
    return records.groupBy("partition").agg(F.count("*").alias("messages"), F.count_distinct(key).alias("keys")).join(F.broadcast(spread))


def late_events(records: DataFrame, threshold_seconds: int = 288) -> DataFrame:
    """Per record of a partition in offset order: how far its time is behind the greatest before it, and whether late.

    The threshold is 4.8 minutes, a little under the least delay of late events.
    """
    seen = F.max("event_timestamp").over(Window.partitionBy("partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    behind = F.unix_timestamp(seen) - F.unix_timestamp("event_timestamp")
    return records.withColumn("lateness_seconds", behind).withColumn("is_late", F.col("lateness_seconds") >= threshold_seconds)


def delay_distribution(df: DataFrame, column: str = "lateness_seconds") -> DataFrame:
    """Number, least, median, greatest and mean of a column, nulls left out."""
    ranked = ranked_values(df, column)
    one = ranked.agg(F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).cast("double").alias("mean"))
    return one.join(percentiles_of(ranked, median=0.5)).select(F.coalesce("n", F.lit(0)).alias("n"), "min", "median", "max", "mean")


def with_row_numbers(df: DataFrame, order: list[str], running: str | None = None) -> DataFrame:
    """Add rn, a global number from 1 in this order: numbers inside ranges plus the ranges' starts, no single task.

    With `running`, also that column's sum up to each row, as `<running>_running`.
    """
    spark = df.sparkSession
    ranged = stored(spark, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    amount = F.col(running) if running else F.lit(0)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))  # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = counts.select("_part", start("_n").alias("_start"), start("_s").alias("_start_sum"))
    inside = Window.partitionBy("_part").orderBy(*order)
    out = ranged.withColumn("_rn", F.row_number().over(inside))
    if running:
        out = out.withColumn("_rs", F.sum(running).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(starts), "_part").withColumn("rn", F.col("_rn") + F.col("_start"))
    if running:
        out = out.withColumn(f"{running}_running", F.col("_rs") + F.col("_start_sum"))
    return out.drop("_part", "_rn", "_rs", "_start", "_start_sum")


def ranked_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that are not null, each once: value, n, and n_running, the rows up to it. Range partitions of values, no single task."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return with_row_numbers(counts, ["value"], running="n").drop("rn")


def percentiles_of(ranked: DataFrame, **shares: float) -> DataFrame:
    """One row: the value at each share of the rows of `ranked_values`, between two values in proportion; null without rows.

    A rank's value is the least one whose running count passes it: a grouped minimum, so nothing is sorted again or gathered.
    """
    total = ranked.agg(F.max("n_running").alias("_all"))  # one row
    both = ranked.join(F.broadcast(total))
    ends = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_all") - 1)
        ends += [F.min(F.when(F.col("n_running") > f(at), F.col("value"))).cast("double").alias(f"_{side}_{name}") for side, f in (("low", F.floor), ("high", F.ceil))]
        ends.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
    low, high, part = (lambda n, s=s: F.col(f"_{s}_{n}") for s in ("low", "high", "part"))
    value = lambda n: F.when(low(n) == high(n), low(n)).otherwise(low(n) + (high(n) - low(n)) * part(n))
    return both.agg(*ends).select(*(value(n).alias(n) for n in shares))


def exact_percentiles(df: DataFrame, column: str, **shares: float) -> DataFrame:
    """One row of exact percentiles of a column, by rank: name=share. Equal to percentile(), but no task holds all distinct values."""
    return percentiles_of(ranked_values(df, column), **shares)


def throughput_profile(events: DataFrame, time: str = "ts", key: str = "event_id", ahead: int = 250, every: int = 100) -> DataFrame:
    """Each hundredth row in time order with the rate of the following 250 rows.

    Rows are numbered globally; a row meets the row 250 further by an equality join on the number.
    """
    rows = with_row_numbers(events.select(time, key), [time, key]).select("rn", F.col(time).alias("t"))
    later = rows.select((F.col("rn") - ahead).alias("rn"), F.col("t").alias("later"))
    seconds = (F.unix_micros(F.col("later").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 1e6
    return rows.filter((F.col("rn") - 1) % every == 0).join(later, "rn").select("rn", F.when(seconds > 0, F.round(ahead / seconds, 6)).alias("rows_per_second"))


def busiest_user(events: DataFrame, least: int = 10) -> DataFrame:
    """The most active user of those with at least `least` events; the lower id breaks ties."""
    return events.filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("events")).filter(F.col("events") >= least).orderBy(F.desc("events"), "user_id").limit(1)


def point_lookup(events: DataFrame, user_id: int, since: str, time: str = "event_timestamp") -> DataFrame:
    """All events of one user since a time, newest first; files clustered by user are skipped by their statistics."""
    return events.filter((F.col("user_id") == user_id) & (F.col(time) >= F.to_timestamp(F.lit(since)))).orderBy(F.desc(time))


def partition_skew(df: DataFrame) -> DataFrame:
    """Rows of the partitions that a plan ends in: least, median, greatest, and their number."""
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("partitions"), F.min("n").alias("min_rows"), F.percentile("n", F.lit(0.5)).alias("median_rows"), F.max("n").alias("max_rows"))
