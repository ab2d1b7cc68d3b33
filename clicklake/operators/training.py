"""Training sets: feature views, point-in-time joins, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import filled, portable_bucket
from .asof import carry_forward
from .audit import exact_percentiles


@dataclass(frozen=True)
class FeatureView:
    """A time-indexed feature table: entity key, time and creation columns, features, and how long a row is valid."""

    name: str
    source: DataFrame
    fields: tuple[str, ...]
    ttl: str
    entity: str = "user_id"
    timestamp: str = "event_timestamp"
    created: str = "created"

    def __post_init__(self):
        if missing := [c for c in (self.entity, self.timestamp, self.created, *self.fields) if c not in self.source.columns]:
            raise ValueError(f"{self.name} lacks {missing}")


def pit_join(rows: DataFrame, view: FeatureView, time: str, honour_created: bool = False) -> DataFrame:
    """Each row with the view's newest feature row at or before its time and at most `ttl` older; null without one.

    Of feature rows of one time the newest created counts. With `honour_created`, rows created after the decision are
    not seen. Both tables go into one column of time and the last feature row is carried forward day by day (carry_forward):
    work is linear in both tables, and a task has a day of a user at most. Rows without entity or time find nothing.
    Feature rows after the last row's time, or more than `ttl` before the first one's, serve nobody: they are left out first.
    """
    f = view.source.filter(F.col(view.entity).isNotNull() & F.col(view.timestamp).isNotNull())
    f = f.select(F.col(view.entity).alias("_key"), F.col(view.timestamp).alias("_t"), F.col(view.created).alias("_c"), *view.fields)
    if honour_created:
        f = f.withColumn("_t", F.greatest("_t", "_c")).withColumn("_valid", F.col("_t"))
    reach = rows.agg((F.min(time) - F.expr(f"interval {view.ttl}")).alias("_low"), F.max(time).alias("_high"))  # one row
    f = f.join(F.broadcast(reach), F.col("_t").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    w = Window.partitionBy("_key", "_t").orderBy(F.desc_nulls_last("_c"), *(F.desc_nulls_last(c) for c in view.fields))
    f = f.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    f = f.select("_key", "_t", F.lit(0).alias("_side"), F.struct(F.col("_t").alias("t"), *view.fields).alias("_f"))
    r = rows.withColumns({"_key": F.col(view.entity), "_t": F.col(time), "_side": F.lit(1)})
    both = carry_forward(r.unionByName(f, allowMissingColumns=True), "_key", "_t", "_side", "_f").filter("_side = 1")
    fresh = F.col("_f.t") >= F.col(time) - F.expr(f"interval {view.ttl}")
    return both.select(*rows.columns, *(F.when(fresh, F.col(f"_f.{c}")).alias(c) for c in view.fields))


def training_set(labels: DataFrame, views: list[FeatureView], time: str = "prediction_timestamp") -> DataFrame:
    """Labels with all views' features as of the decision time; missing ones are 0 and flagged."""
    out, names = labels, []
    for view in views:
        out = pit_join(out, view, time)
        names += view.fields
    return filled(out, names)


def label_balance(df: DataFrame, label: str = "target_purchase_1h") -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("rows"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.round(F.count_if(F.col(label) == 1) / n, 6).alias("positive_rate"))


def label_limit(labels: DataFrame, n: int) -> DataFrame:
    """The first n labels by time and user: the limit is the feature."""
    return labels.orderBy("prediction_timestamp", "user_id").limit(n)


def label_sample(labels: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A repeatable sample by the hash of the key, whatever the partitioning."""
    return labels.filter(portable_bucket(1_000_000, F.lit(seed), "user_id", F.date_format("prediction_timestamp", "yyyy-MM-dd HH:mm:ss")) < int(fraction * 1_000_000))


def sorted_within_files(labels: DataFrame) -> DataFrame:
    """Order for writing: readers skip by it within a file, and no global sort is paid for."""
    return labels.sortWithinPartitions("user_id", "prediction_timestamp")


def chronological_split(df: DataFrame, time: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Add split: train, validation or test by cuts of time at exact ranks, equal times on one side."""
    cuts = exact_percentiles(df.select(F.unix_timestamp(time).alias("_t")), "_t", _a=train, _b=train + validation)  # one row
    t = F.unix_timestamp(time)
    return df.join(F.broadcast(cuts)).withColumn("split", F.when(t <= F.col("_a"), "train").when(t <= F.col("_b"), "validation").otherwise("test")).drop("_a", "_b")
