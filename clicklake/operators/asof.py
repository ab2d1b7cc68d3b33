"""The last value carried forward over time by key, in groups of bounded time: no key's whole history meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def carry_forward(rows: DataFrame, key: str, time: str, side: str, value: str, span: str = "day") -> DataFrame:
    """`value` of each row replaced by the last one that is not null at or before its time, of its key.

    At one time, rows of a lesser `side` come first, and there is one value a key and time at most. Rows are grouped by key and `span` of time;
    a group begins with the last value of the key's groups before it, which come from one row a group. A key with a third of all rows is
    as many groups as it has days. Rows without key or time carry nothing.
    """
    at = F.date_trunc(span, time)
    marked = rows.withColumn("_span", at)
    some = F.col(value).isNotNull()
    ends = marked.filter(F.col(key).isNotNull()).groupBy(key, "_span").agg(F.max_by(F.when(some, F.col(value)), F.when(some, F.col(time))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(key, "_span", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    within = Window.partitionBy(key, "_span").orderBy(time, side).rowsBetween(Window.unboundedPreceding, 0)
    known = marked.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(value, F.last(value, ignorenulls=True).over(within))
    carried = known.join(starts, [key, "_span"], "left").withColumn(value, F.coalesce(value, "_start"))
    lost = rows.filter(F.col(key).isNull() | F.col(time).isNull()).withColumn(value, F.lit(None).cast(rows.schema[value].dataType))
    return carried.select(*rows.columns).unionByName(lost)
