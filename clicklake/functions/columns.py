"""Scalar expressions that more than one operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def money(c: Column | str) -> Column:
    """An amount as exact decimal, to be summed before it becomes a double."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def money_sum(c: Column | str, when: Column | None = None) -> Column:
    """A sum that does not depend on the order of rows; 0 for none."""
    amount = money(c) if when is None else F.when(when, money(c))
    return F.coalesce(F.sum(amount), F.lit(0)).cast("double")


def event_timestamp(c: Column | str) -> Column:
    """`yyyy-MM-dd HH:mm:ss UTC` text as a time; null for anything else."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss 'UTC'"))


def event_timestamp_prefix(c: Column | str) -> Column:
    """The same from the first 19 characters, as the stream reads it."""
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def any_timestamp(c: Column | str) -> Column:
    """A time from any of the forms that feature messages use, fractions and offsets included; a date alone is its start."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), c.try_cast("timestamp"))


def range_end(c: Column | str) -> Column:
    """The end of a range given as text: a date alone means its last second."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) == 10, any_timestamp(c) + F.expr("interval 86399 seconds")).otherwise(any_timestamp(c))


def first_level(c: Column | str) -> Column:
    """`electronics` of `electronics.smartphone`."""
    return F.substring_index(c, ".", 1)


def key_hash(*parts: str) -> Column:
    """md5 of the parts joined by underscores; a null part is marked, so rows that differ in it differ in the hash."""
    return F.md5(F.concat_ws("_", *(F.coalesce(F.col(p).cast("string"), F.lit("~")) for p in parts)))


def key_hash_skipping_nulls(*parts: str | Column) -> Column:
    """The same with null parts left out."""
    return F.md5(F.concat_ws("_", *parts))


def bucket(n: int, *keys: str | Column) -> Column:
    """A repeatable number from 0 to n - 1 for a row's keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(n))


def portable_bucket(n: int, *keys: str | Column) -> Column:
    """The same from the first twelve digits of the md5 of the keys' texts: other engines give the same number."""
    text = F.concat_ws("|", *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("~")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint"), F.lit(n))


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of features as 0, and a flag for each that says so."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull() for c in columns}).na.fill(0, columns)
