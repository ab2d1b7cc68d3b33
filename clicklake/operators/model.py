"""Dimensions, the event fact, and joins to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import key_hash, key_hash_skipping_nulls
from .asof import carry_forward

ATTRIBUTES = ["category_id", "category_level1", "brand", "price", "discount_percent"]


def _attribute_order() -> list[Column]:
    return [F.desc_nulls_last("price"), *(F.asc_nulls_last(c) for c in ("discount_percent", "brand", "category_id", "category_level1"))]


def versions_of(starts: DataFrame) -> DataFrame:
    """Starts of versions (one a product and time) as [valid_from, valid_to) with keys; the key has the time's fraction if there is one."""
    following = F.lead("valid_from_ts").over(Window.partitionBy("product_id").orderBy("valid_from_ts"))
    keyed = starts.withColumn("product_sk", key_hash_skipping_nulls(F.col("product_id").cast("string"), F.col("valid_from_ts").cast("string")))
    return keyed.withColumn("valid_to_ts", following).withColumn("is_current", F.col("valid_to_ts").isNull()).select("product_sk", "product_id", *ATTRIBUTES, "valid_from_ts", "valid_to_ts", "is_current")


def first_seen(silver: DataFrame) -> DataFrame:
    """Every attribute tuple of a product with the first time it is seen."""
    return silver.groupBy("product_id", *ATTRIBUTES).agg(F.min("event_timestamp").alias("valid_from_ts"))


def winners(starts: DataFrame) -> DataFrame:
    """Of the tuples of a product that start at one instant, the one that counts."""
    w = Window.partitionBy("product_id", "valid_from_ts").orderBy(*_attribute_order())
    return starts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dim_product_scd2(silver: DataFrame) -> DataFrame:
    """A version per attribute tuple from the first time it is seen. A return to old values makes no new version.

    Of versions that start at one instant the one with the highest price counts, then by discount, brand, category.
    """
    return versions_of(winners(first_seen(silver)))


def dim_product_scd2_changes(silver: DataFrame) -> DataFrame:
    """A version whenever a product's attributes differ from those before, so a return to old values is kept."""
    w = Window.partitionBy("product_id", "event_timestamp").orderBy(*_attribute_order())
    one = silver.select("product_id", "event_timestamp", *ATTRIBUTES).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    before = F.lag(F.struct(*ATTRIBUTES)).over(Window.partitionBy("product_id").orderBy("event_timestamp"))
    changed = one.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.struct(*ATTRIBUTES).eqNullSafe(F.col("_before")))
    return versions_of(changed.withColumnRenamed("event_timestamp", "valid_from_ts"))


def dim_user(silver: DataFrame) -> DataFrame:
    out = silver.filter("user_id is not null").groupBy("user_id").agg(F.min("event_timestamp").alias("first_seen"), F.max("event_timestamp").alias("last_seen"), F.count("*").alias("total_lifetime_events"))
    return out.select("*", F.lit(True).alias("is_active"), F.col("first_seen").alias("valid_from_ts"), F.lit(None).cast("timestamp").alias("valid_to_ts"), F.lit(True).alias("is_current"))


def scd2_range_join(events: DataFrame, dim: DataFrame, columns: list[str]) -> DataFrame:
    """Each event with the version valid at its time: equality on the product and a slot of time, the range as residual.

    A product's time is cut into as many slots as it has versions. A version is in every slot that it touches, so at most
    twice as many rows as versions are joined, and an event meets the versions of its slot, not all of its product.
    """
    d = dim.select(F.col("product_id").alias("_pid"), F.col("valid_from_ts").alias("_from"), F.col("valid_to_ts").alias("_to"), *columns)
    d = d.filter("_pid is not null and _from is not null and (_to is null or _to > _from)")  # others hold no time
    micros = lambda c: F.unix_micros(F.col(c))
    spans = d.groupBy("_pid").agg(F.min(micros("_from")).alias("_start"), F.max(F.greatest(micros("_from"), micros("_to"))).alias("_end"), F.count("*").alias("_n"))
    spans = spans.select("_pid", "_start", "_n", F.greatest(F.lit(1.0), (F.col("_end") - F.col("_start")) / F.col("_n")).alias("_width"))
    slot = lambda c: F.least(F.greatest(F.floor((micros(c) - F.col("_start")) / F.col("_width")), F.lit(0)), F.col("_n"))
    d = d.join(spans, "_pid").withColumn("_slot", F.explode(F.sequence(slot("_from"), F.when(F.col("_to").isNull(), F.col("_n")).otherwise(slot("_to")))))
    d = d.drop("_start", "_n", "_width")
    placed = events.join(spans.withColumnRenamed("_pid", "_owner"), F.col("product_id") == F.col("_owner"), "left")
    placed = placed.withColumn("_place", F.when(F.col("event_timestamp").isNotNull(), slot("event_timestamp"))).drop("_owner", "_start", "_n", "_width")
    on = (F.col("product_id") == F.col("_pid")) & (F.col("_place") == F.col("_slot")) & (F.col("event_timestamp") >= F.col("_from")) & ((F.col("event_timestamp") < F.col("_to")) | F.col("_to").isNull())
    return placed.join(d, on, "left").drop("_pid", "_from", "_to", "_place", "_slot")


def scd2_asof_join(events: DataFrame, dim: DataFrame, columns: list[str]) -> DataFrame:
    """The same without pairing events and versions: both in one column of time, the last version carried forward.

    Work is linear in events plus versions, and a task has a day of a product at most (carry_forward); the way for products
    of many versions or events. Events without product or time have no version.
    """
    d = dim.select("product_id", F.col("valid_from_ts").alias("event_timestamp"), F.lit(0).alias("_side"), F.struct("valid_to_ts", *columns).alias("_version"))
    e = events.withColumn("_side", F.lit(1))
    both = carry_forward(e.unionByName(d, allowMissingColumns=True), "product_id", "event_timestamp", "_side", "_version").filter("_side = 1")
    valid = F.col("product_id").isNotNull() & F.col("event_timestamp").isNotNull() & (F.col("_version.valid_to_ts").isNull() | (F.col("event_timestamp") < F.col("_version.valid_to_ts")))
    return both.select(*events.columns, *(F.when(valid, F.col(f"_version.{c}")).alias(c) for c in columns))


def fact_user_events(silver: DataFrame, dim: DataFrame, compat: bool = False) -> DataFrame:
    """The event fact with the product's version key. With `compat` the id's hash is that of user, time and product alone, nulls left out."""
    joined = scd2_asof_join(silver, dim, ["product_sk"])
    event_id = key_hash_skipping_nulls(F.col("user_id").cast("string"), "event_time", F.col("product_id").cast("string")) if compat else key_hash("user_id", "event_time", "product_id", "event_type", "user_session")
    return joined.select(event_id.alias("event_id"), "event_timestamp", "event_time", "date", "user_id", "product_sk", "category_level1", "brand", "price", "discount_percent", "event_type", "user_session")


def category_dim(events: DataFrame) -> DataFrame:
    """Distinct categories with a group, a tax rate and a priority."""
    c = F.col("category_code")
    return events.filter("category_code is not null").select("category_code").distinct().select(
        "category_code",
        F.when(c.startswith("small"), "compact").when(c.like("large%"), "bulky").otherwise("standard").alias("category_group"),
        F.when(c.startswith("small"), 0.08).otherwise(0.1).alias("tax_rate"),
        F.when(c.startswith("large"), 1).otherwise(2).alias("priority"),
    )


def category_join(events: DataFrame, dim: DataFrame, how: str | None = "broadcast") -> DataFrame:
    """Events with their category's row; `how` is a join hint (broadcast for a dimension known to be small, merge) or None."""
    return events.join(dim.hint(how) if how else dim, "category_code", "inner")


def category_summary(joined: DataFrame) -> DataFrame:
    from ..functions.columns import money_sum

    return joined.groupBy("category_code", "category_group").agg(F.count("*").alias("events"), money_sum("price").alias("revenue"), (money_sum("price") / F.count("price")).alias("avg_price"))


def fk_orphans(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of `left` whose non-null key has no row in `right`."""
    keys = right.select(F.col(right_key).alias("_key"))
    return left.filter(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_key"), "left_anti")
