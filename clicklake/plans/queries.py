"""All registered batch queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import columns as C
from ..operators import audit, dims, events as ev, features, labels, layout, model, online, quality, shape, skew, training
from ..schemas import KEYS, NEW_COLUMNS, OLD_COLUMNS, REQUIRED
from ..sources import files, kafka
from ..sources.canonical import AS_OF, EVOLUTION_DATE, canonical_events, plain, sql, table
from ..storage import shared_folder, stored

DAY, LABEL_DAY = "2024-01-30", "2024-01-29"
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, check: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its check's SQL or None."""

    def register(f):
        QUERIES[name] = (lambda spark, sf_dir: plain(f(spark, sf_dir)), check)
        return f

    return register


def md5_bucket(n: int, *keys: str) -> str:
    """functions.columns.portable_bucket in SQL, of keys that are text and not null."""
    return f"(('0x' || md5(concat_ws('|', {', '.join(keys)}))[1:12])::BIGINT % {n})"


USER, PRODUCT = "coalesce(user_id::VARCHAR, '~')", "coalesce(product_id::VARCHAR, '~')"


def silver(spark: SparkSession, sf: str) -> DataFrame:
    return ev.stg_events(canonical_events(spark, sf))


def products(spark: SparkSession, sf: str) -> DataFrame:
    return model.dim_product_scd2(silver(spark, sf))


def features_30d(spark: SparkSession, sf: str) -> DataFrame:
    return features.user_features_30d(silver(spark, sf), DAY, "2024-02-01")


def features_15m(spark: SparkSession, sf: str) -> DataFrame:
    return features.hopping_features(silver(spark, sf))


def labels_1h(spark: SparkSession, sf: str, s: DataFrame | None = None) -> DataFrame:
    return labels.user_labels(silver(spark, sf) if s is None else s, LABEL_DAY)


def views(spark: SparkSession, sf: str, s: DataFrame | None = None) -> list[training.FeatureView]:
    s = silver(spark, sf) if s is None else s
    long = ("f_views_30d", "f_carts_30d", "f_purchases_30d", "f_spend_30d", "f_distinct_categories_30d")
    short = ("f_views_15m", "f_carts_15m", "f_purchases_15m", "total_spend_15m")
    day = features.user_features_30d(s, LABEL_DAY, LABEL_DAY)
    return [training.FeatureView("user_30d", day, long, "30 days"), training.FeatureView("user_15m", features.hopping_features(s), short, "2 hours")]


def csv_generations(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The canonical events written as event files of both generations."""
    folder = shared_folder(spark, "csv")
    old, new = shape.schema_split(canonical_events(spark, sf), EVOLUTION_DATE)
    old.select(*OLD_COLUMNS).write.option("header", True).csv(f"{folder}/old")
    new.select(*NEW_COLUMNS).write.option("header", True).csv(f"{folder}/new")
    return f"{folder}/old", f"{folder}/new"


def staged_json(spark: SparkSession, sf: str) -> str:
    folder = shared_folder(spark, "staged")
    canonical_events(spark, sf).select(*(F.col(c).cast("string").alias(c) for c in NEW_COLUMNS)).write.json(folder)
    return folder


# Sources and ingest

RAW = "event_time, event_type, product_id, category_id, category_code, brand, price, user_id, user_session, discount_percent"


@query("read_events_csv", sql(f"SELECT {RAW}, $T(ingestion_time) AS ingestion_time FROM raw", "raw"))
def _(spark, sf):
    old, new = csv_generations(spark, sf)
    return files.read_events_csv(spark, old, False, AS_OF).unionByName(files.read_events_csv(spark, new, True, AS_OF))


@query("schema_drift_report", "SELECT 'discount_percent' AS column, 'only_second' AS side")
def _(spark, sf):
    old, new = csv_generations(spark, sf)
    read = lambda p: spark.read.option("header", True).csv(p)
    return files.schema_drift_report(read(old), read(new))


@query("union_evolved", sql(f"SELECT {RAW} FROM raw", "raw"))
def _(spark, sf):
    old, new = shape.schema_split(canonical_events(spark, sf).select(*NEW_COLUMNS), EVOLUTION_DATE)
    return files.union_evolved(old.select(*OLD_COLUMNS), new)


@query("bronze_append_merge", sql(f"SELECT {RAW} FROM raw", "raw"))
def _(spark, sf):
    path = shared_folder(spark, "bronze")
    old, new = shape.schema_split(canonical_events(spark, sf).select(*NEW_COLUMNS), EVOLUTION_DATE)
    files.bronze_append_merge(old.select(*OLD_COLUMNS), path)
    files.bronze_append_merge(new, path)
    return files.read_merged(spark, path).select(*NEW_COLUMNS)


@query("bootstrap_once", sql("SELECT count(*) AS rows, true AS first, false AS second FROM raw", "raw"))
def _(spark, sf):
    path = shared_folder(spark, "bootstrap")
    rows = canonical_events(spark, sf)
    first, second = files.bootstrap_once(spark, rows, path), files.bootstrap_once(spark, rows, path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.lit(first).alias("first"), F.lit(second).alias("second"))


@query("ingest_staged_json", sql(f"SELECT {RAW} FROM raw", "raw"))
def _(spark, sf):
    staged, bronze, check = staged_json(spark, sf), shared_folder(spark, "bronze"), shared_folder(spark, "checkpoint")
    for _ in range(2):  # the second call finds nothing new
        files.ingest_staged_json(spark, staged, bronze, check, AS_OF)
    return spark.read.parquet(bronze).select(*NEW_COLUMNS)


@query("archive_after_ingest", sql(f"SELECT {RAW} FROM raw", "raw"))
def _(spark, sf):
    staged, bronze, check = staged_json(spark, sf), shared_folder(spark, "bronze"), shared_folder(spark, "checkpoint")
    files.ingest_staged_json(spark, staged, bronze, check, AS_OF, archive=shared_folder(spark, "archive"))
    return spark.read.parquet(bronze).select(*NEW_COLUMNS)


@query("kafka_events_source", sql("""SELECT event_type, count(*) AS n, $T(min(strptime(event_time, '%Y-%m-%d %H:%M:%S UTC'))) AS first_time
  FROM raw
  GROUP BY 1""", "raw"))
def _(spark, sf):
    parsed = kafka.parse_messages(kafka.to_messages(canonical_events(spark, sf)))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.min("row_time").alias("first_time"))


def records(spark: SparkSession, sf: str, time: str = "ts") -> DataFrame:
    """Events as topic records of three partitions by user, offsets in order of arrival (the id)."""
    e = table(spark, sf, "events").filter("user_id is not null").withColumn("partition", (F.col("user_id") % 3).cast("int"))
    return e.withColumns({"offset": (F.row_number().over(Window.partitionBy("partition").orderBy("event_id")) - 1).cast("bigint"), "event_timestamp": F.date_trunc("second", F.col(time).cast("timestamp"))})


RECORDS = "SELECT *, (user_id % 3)::INTEGER AS partition, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS \"offset\", date_trunc('second', ts) AS event_timestamp FROM events WHERE user_id IS NOT NULL"


@query("kafka_records_with_metadata", f"SELECT partition, \"offset\", key, user_id, event_type, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp FROM (SELECT *, user_id::VARCHAR AS key FROM ({RECORDS}))")
def _(spark, sf):
    r = records(spark, sf).withColumn("event_time", F.concat(F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
    messages = r.select("partition", "offset", F.col("event_timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_time", "event_type", "user_id")).alias("value"))
    return kafka.kafka_records_with_metadata(messages).select("partition", "offset", "key", "user_id", "event_type", "event_timestamp")


@query("parse_event_lines", sql("""SELECT event_time, event_type, CASE WHEN e % 3 = 0 THEN NULL ELSE product_id END AS product_id, CASE WHEN e % 5 = 0 THEN 0.0 ELSE price END AS price,
    CASE WHEN e % 3 = 0 THEN 'bad product_id' END AS reject_reason
  FROM (SELECT *, length(event_time) + coalesce(product_id, 0) AS e
  FROM raw)""", "raw"))
def _(spark, sf):
    raw = canonical_events(spark, sf).withColumn("e", F.length("event_time") + F.coalesce("product_id", F.lit(0)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [F.when(F.col("e") % 3 == 0, "x12").otherwise(text(c)) if c == "product_id" else F.when(F.col("e") % 5 == 0, "").otherwise(text(c)) if c == "price" else text(c) for c in OLD_COLUMNS]
    return files.parse_event_lines(raw.select(F.concat_ws(",", *parts).alias("value"))).select("event_time", "event_type", "product_id", "price", "reject_reason")


@query("read_partition", sql("SELECT event_time, user_id, product_id, event_type FROM silver WHERE date = DATE '2024-01-10'"))
def _(spark, sf):
    path = shared_folder(spark, "silver")
    layout.write_partitioned(silver(spark, sf), path)
    return files.read_partition(files.read_table_by_format(spark, path), "2024-01-10").select("event_time", "user_id", "product_id", "event_type")


@query("column_pruned_scan", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("staged_sample", "SELECT 5 AS n")
def _(spark, sf):
    return files.staged_sample(spark, staged_json(spark, sf), 5).agg(F.count("*").cast("int").alias("n"))


# Sinks

@query("write_partitioned", sql("SELECT $D(date) AS date, count(*) AS n FROM silver GROUP BY 1"))
def _(spark, sf):
    path = shared_folder(spark, "silver")
    rows = stored(spark, silver(spark, sf), "rows")
    layout.write_partitioned(rows, path)
    layout.write_partitioned(rows.filter("date = date'2024-01-05'"), path, max_records=1000)  # other dates stay
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"))


@query("write_dim", sql("SELECT count(*) AS n, count_if(is_current) AS n_current FROM dim_product", "dim_product"))
def _(spark, sf):
    path = shared_folder(spark, "dim")
    layout.write_dim(products(spark, sf), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if("is_current").alias("n_current"))


@query("published_dim", sql("SELECT count(*) AS n, count_if(is_current) AS n_current, 2::BIGINT AS versions, 3::BIGINT AS newest FROM dim_product", "dim_product"))
def _(spark, sf):
    """A dimension published four times, the last version unfinished: readers have the last finished one."""
    path, dim = shared_folder(spark, "dim"), stored(spark, products(spark, sf), "products")
    for share in (0.2, 0.5, 0.8, 1.0):
        layout.publish(dim.filter(C.portable_bucket(1_000, "product_sk") < int(share * 1_000)), path)
    dim.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=00000004")
    done = layout.versions(spark, path)
    return layout.published(spark, path).agg(F.count("*").alias("n"), F.count_if("is_current").alias("n_current"), F.lit(len(done)).cast("bigint").alias("versions"), F.lit(done[-1]).cast("bigint").alias("newest"))


F30 = "user_id, f_views_30d, f_carts_30d, f_purchases_30d, f_spend_30d, f_distinct_categories_30d"


@query("export_features", sql(f"SELECT {F30}, $T(event_timestamp) AS event_timestamp, $T(created) AS created FROM features_30d", "features_30d"))
def _(spark, sf):
    path = shared_folder(spark, "export")
    layout.export_features(features_30d(spark, sf), path)
    return spark.read.parquet(path)


@query("warehouse_copy", sql("""SELECT user_id, brand, category_level1
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY brand, category_level1) AS rn
  FROM silver
  WHERE user_id IS NOT NULL)
  WHERE rn = 1"""))
def _(spark, sf):
    return layout.warehouse_copy(silver(spark, sf), ["user_id", "brand", "category_level1"], "user_id")


@query("warehouse_projection", sql("""SELECT product_id, brand, price::DECIMAL(10,2)::DOUBLE AS price, discount_percent::DOUBLE AS discount
  FROM silver
  WHERE product_id IS NOT NULL AND brand IS NOT NULL"""))
def _(spark, sf):
    out = layout.warehouse_projection(silver(spark, sf), {"product_id": "bigint", "brand": "string", "price": "decimal(10,2)", "discount_percent": "decimal(5,2)"}, ["product_id", "brand"])
    return out.select("product_id", "brand", F.col("price").cast("double").alias("price"), F.col("discount_percent").cast("double").alias("discount"))


WAREHOUSE = {"raw_events": ("raw", "price"), "stg_events": ("silver", "price"), "dim_product": ("dim_product", "price"), "fact_user_events": ("fact", "price"), "feat_user_30d": ("features_30d", "f_spend_30d")}
STORED = " UNION ALL ".join(
    f"SELECT '{name}' AS table, count(*) AS rows, coalesce(sum({amount}::DECIMAL(12,2)), 0)::DOUBLE AS amount FROM {source}"
    + (" WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in REQUIRED[name]) if REQUIRED[name] else "")
    for name, (source, amount) in WAREHOUSE.items()
)


@query("warehouse_tables", sql(STORED, "features_30d"))
def _(spark, sf):
    raw, s = canonical_events(spark, sf), stored(spark, silver(spark, sf), "silver")
    dim = model.dim_product_scd2(s)
    tables = {"raw_events": raw, "stg_events": s, "dim_product": dim, "fact_user_events": model.fact_user_events(s, dim), "feat_user_30d": features.user_features_30d(s, DAY, "2024-02-01")}
    out = None
    for name, (_, amount) in WAREHOUSE.items():
        held = layout.warehouse_table(tables[name], name)
        row = held.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("amount"))
        out = row if out is None else out.unionByName(row)
    return out


@query("offline_feature_upgrade", sql("SELECT user_id, f_views_30d, 0::BIGINT AS f_carts_30d FROM features_30d", "features_30d"))
def _(spark, sf):
    full = features_30d(spark, sf).select("user_id", "f_views_30d", "f_carts_30d")
    return online.offline_feature_upgrade(full.drop("f_carts_30d"), full)


@query("sized_parts", sql("SELECT count(*) AS rows, true AS within FROM silver"))
def _(spark, sf):
    path = shared_folder(spark, "parts")
    layout.write_partitioned(silver(spark, sf), path, max_records=500)
    report = layout.file_layout_report(spark.read.parquet(path))
    return report.agg(F.sum("rows").alias("rows"), (F.max("rows") <= 500).alias("within"))


# Scalar functions

@query("cast_and_null", sql("""SELECT count(*) AS n, count(TRY_CAST(brand AS BIGINT)) AS brands_as_numbers, count(TRY_CAST(user_id::VARCHAR AS BIGINT)) AS users, 0::BIGINT AS nulls
  FROM raw""", "raw"))
def _(spark, sf):
    return canonical_events(spark, sf).agg(F.count("*").alias("n"), F.count(F.col("brand").try_cast("bigint")).alias("brands_as_numbers"), F.count(F.col("user_id").cast("string").try_cast("bigint")).alias("users"), F.count(F.lit(None).cast("int")).alias("nulls"))


@query("time_functions", sql("""SELECT event_time, $T(event_timestamp) AS parsed, $T(event_timestamp) AS parsed_prefix, $D(date) AS date, $D(date - 30) AS month_before,
    $D(date + 1) AS day_after, $T(date_trunc('minute', event_timestamp)) AS minute, $T(event_timestamp + INTERVAL 1 HOUR) AS hour_later,
    replace(event_time, ' UTC', '') AS stripped, event_time[1:10] AS day_text
  FROM silver"""))
def _(spark, sf):
    t, d = C.event_timestamp("event_time"), F.to_date(C.event_timestamp("event_time"))
    return silver(spark, sf).select("event_time", t.alias("parsed"), C.event_timestamp_prefix("event_time").alias("parsed_prefix"), d.alias("date"), F.date_sub(d, 30).alias("month_before"), F.date_add(d, 1).alias("day_after"), F.date_trunc("minute", t).alias("minute"), (t + F.expr("interval 1 hour")).alias("hour_later"), F.replace(F.col("event_time"), F.lit(" UTC"), F.lit("")).alias("stripped"), F.substring("event_time", 1, 10).alias("day_text"))


@query("mixed_timestamps", sql("""SELECT event_time, $T(event_timestamp) AS iso, $T(event_timestamp) AS spaced, $T(date::TIMESTAMP) AS day,
    $T(date::TIMESTAMP + INTERVAL 86399 SECOND) AS day_end
  FROM silver"""))
def _(spark, sf):
    s = silver(spark, sf)
    iso = F.concat(F.replace(F.substring("event_time", 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))
    return s.select("event_time", C.any_timestamp(iso).alias("iso"), C.any_timestamp("event_time").alias("spaced"), C.any_timestamp(F.substring("event_time", 1, 10)).alias("day"), C.range_end(F.substring("event_time", 1, 10)).alias("day_end"))


@query("text_functions", sql("""SELECT event_time, category_level1, md5(concat_ws('_', user_id::VARCHAR, event_time)) AS hash, starts_with(category_code, 'small') AS is_small,
    category_code LIKE 'large%' AS is_large, event_type IN ('view', 'cart') AS is_active
  FROM silver"""))
def _(spark, sf):
    return silver(spark, sf).select("event_time", C.first_level("category_code").alias("category_level1"), C.key_hash_skipping_nulls(F.col("user_id").cast("string"), "event_time").alias("hash"), F.col("category_code").startswith("small").alias("is_small"), F.col("category_code").like("large%").alias("is_large"), F.col("event_type").isin("view", "cart").alias("is_active"))


@query("array_functions", sql("""SELECT user_id, event_time, [4, 5, 8][(user_id % 3 + 1)::INTEGER] AS picked, unnest(range(0, 3))::INTEGER AS salt
  FROM raw""", "raw"))
def _(spark, sf):
    return canonical_events(spark, sf).select("user_id", "event_time", F.element_at(F.array(F.lit(4), F.lit(5), F.lit(8)), (F.col("user_id") % 3 + 1).cast("int")).alias("picked"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("salt"))


@query("json_fields_with_defaults", """SELECT event_id, coalesce((props->>'k')::BIGINT, -1) AS k, coalesce(props->>'absent', 'none') AS absent
  FROM events""")
def _(spark, sf):
    m = F.from_json("props", "k bigint, absent string")
    return table(spark, sf, "events").select("event_id", F.coalesce(m["k"], F.lit(-1)).alias("k"), F.coalesce(m["absent"], F.lit("none")).alias("absent"))


@query("money_rounding", sql("SELECT event_type, sum(price::DECIMAL(18,2))::DOUBLE AS total FROM raw GROUP BY 1", "raw"))
def _(spark, sf):
    return canonical_events(spark, sf).groupBy("event_type").agg(C.money_sum("price").alias("total"))


@query("repeatable_buckets", sql("SELECT count(*) AS rows, true AS in_range FROM raw", "raw"))
def _(spark, sf):
    b = canonical_events(spark, sf).select(C.bucket(4, "user_id", "event_time").alias("b"))
    return b.agg(F.count("*").alias("rows"), ((F.min("b") >= 0) & (F.max("b") < 4)).alias("in_range"))


# Filters

@query("event_date_window", sql("SELECT user_id, event_time FROM silver WHERE date >= DATE '2024-01-01' AND date < DATE '2024-01-15'"))
def _(spark, sf):
    return silver(spark, sf).filter("date >= date'2024-01-01' and date < date'2024-01-15'").select("user_id", "event_time")


@query("event_time_window", sql("""SELECT count(*) AS n
  FROM raw
  WHERE strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') >= TIMESTAMP '2024-01-03' AND strptime(event_time,
    '%Y-%m-%d %H:%M:%S UTC') < TIMESTAMP '2024-01-04'""", "raw"))
def _(spark, sf):
    t = C.event_timestamp("event_time")
    return canonical_events(spark, sf).filter((t >= F.to_timestamp(F.lit("2024-01-03"))) & (t < F.to_timestamp(F.lit("2024-01-04")))).agg(F.count("*").alias("n"))


@query("by_event_type", sql("SELECT user_id, event_time, event_type FROM silver WHERE event_type IN ('view', 'cart')"))
def _(spark, sf):
    return silver(spark, sf).filter(F.col("event_type").isin("view", "cart")).select("user_id", "event_time", "event_type")


@query("right_censor", sql("""SELECT user_id, event_time, product_id, event_type
  FROM silver, horizon
  WHERE date = DATE '2024-01-29' AND event_timestamp <= cut""", "horizon"))
def _(spark, sf):
    rows = silver(spark, sf).filter("date = date'2024-01-29'")
    return labels.right_censor(rows, rows).select("user_id", "event_time", "product_id", "event_type")


@query("null_filters", sql("SELECT count_if(brand IS NULL) AS no_brand, count_if(brand IS NOT NULL) AS with_brand FROM raw", "raw"))
def _(spark, sf):
    return canonical_events(spark, sf).agg(F.count_if(F.col("brand").isNull()).alias("no_brand"), F.count_if(F.col("brand").isNotNull()).alias("with_brand"))


@query("schema_split", sql(f"""SELECT CASE WHEN event_time[1:10] < '{EVOLUTION_DATE}' THEN 'old' ELSE 'new' END AS part, count(*) AS n, count(discount_percent) AS discounts
  FROM raw
  GROUP BY 1""", "raw"))
def _(spark, sf):
    old, new = shape.schema_split(canonical_events(spark, sf), EVOLUTION_DATE)
    both = old.withColumn("part", F.lit("old")).unionByName(new.withColumn("part", F.lit("new")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count("discount_percent").alias("discounts"))


@query("point_lookup", sql("""SELECT event_time, product_id, event_type, price
  FROM silver
  WHERE user_id = 7 AND event_timestamp >= TIMESTAMP '2024-01-05'"""))
def _(spark, sf):
    return audit.point_lookup(silver(spark, sf), 7, "2024-01-05").select("event_time", "product_id", "event_type", "price")


@query("date_exists", sql("SELECT $D(max(date)) AS date FROM silver"))
def _(spark, sf):
    return labels.latest_date(silver(spark, sf), "2031-01-01")


# Joins

CATEGORIES = """(SELECT DISTINCT category_code, CASE WHEN category_code LIKE 'small%' THEN 'compact' WHEN category_code LIKE 'large%' THEN 'bulky' ELSE 'standard' END AS category_group, CASE WHEN category_code LIKE 'small%' THEN 0.08 ELSE 0.1 END::DOUBLE AS tax_rate, CASE WHEN category_code LIKE 'large%' THEN 1 ELSE 2 END AS priority
  FROM raw
  WHERE category_code IS NOT NULL)"""
SUMMARY = sql(f"""SELECT r.category_code, category_group, count(*) AS events, coalesce(sum(price::DECIMAL(18,2)), 0)::DOUBLE AS revenue,
    coalesce(sum(price::DECIMAL(18,2)), 0)::DOUBLE / count(price) AS avg_price
  FROM raw r
  JOIN {CATEGORIES} c ON r.category_code = c.category_code
  GROUP BY 1, 2""", "raw")


@query("category_join_broadcast", SUMMARY)
def _(spark, sf):
    raw = canonical_events(spark, sf)
    return model.category_summary(model.category_join(raw, model.category_dim(raw), None))  # Spark broadcasts it while it is small


@query("category_join_shuffle", SUMMARY)
def _(spark, sf):
    raw = canonical_events(spark, sf)
    return model.category_summary(model.category_join(raw, model.category_dim(raw), "merge"))


QUERIES["category_summary"] = QUERIES["category_join_broadcast"]


@query("category_dim", sql(f"SELECT * FROM {CATEGORIES}", "raw"))
def _(spark, sf):
    return model.category_dim(canonical_events(spark, sf))


HOT = """hot AS (SELECT user_id
  FROM raw
  WHERE user_id IS NOT NULL
  GROUP BY 1 HAVING count(*) > 0.009 * (SELECT count(*)
  FROM raw
  WHERE user_id IS NOT NULL)), tiers AS (SELECT DISTINCT r.user_id, CASE WHEN h.user_id IS NULL THEN 'STANDARD' ELSE 'VIP' END AS tier
  FROM raw r
  LEFT JOIN hot h USING (user_id)
  WHERE r.user_id IS NOT NULL)"""


def tiered(body: str) -> str:
    text = sql("@", "raw")
    return text.replace("\n@", f",\n{HOT}\n{body}")


def _hot(spark, sf):
    raw = canonical_events(spark, sf)
    return raw, audit.hot_keys(raw, "user_id", 0.009)


@query("user_tier_dim", tiered("SELECT * FROM tiers"))
def _(spark, sf):
    return skew.user_tier_dim(*_hot(spark, sf))


TIERS = tiered("SELECT tier, count(*) AS events, sum(price::DECIMAL(18,2))::DOUBLE AS spend FROM raw JOIN tiers USING (user_id) GROUP BY 1")


@query("user_join_aqe_skew", TIERS)
def _(spark, sf):
    raw, hot = _hot(spark, sf)
    return skew.tier_summary(skew.user_join(raw, skew.user_tier_dim(raw, hot)))


@query("user_join_salted", TIERS)
def _(spark, sf):
    raw, hot = _hot(spark, sf)
    return skew.tier_summary(skew.user_join_salted(raw, skew.user_tier_dim(raw, hot), hot, 4, ["event_time", "product_id", "event_type"]))


#: Half of all events are one user's.
ONE_USER = "CASE WHEN product_id % 2 = 0 THEN 900000001 ELSE user_id END"


@query("skew_splits", sql(f"""SELECT way, CASE WHEN user_id = 900000001 THEN 'VIP' ELSE 'STANDARD' END AS tier, count(*) AS events, way = 'adaptive' AS split
  FROM (SELECT {ONE_USER} AS user_id FROM raw), (VALUES ('merge'), ('adaptive'), ('salted')) w(way)
  WHERE user_id IS NOT NULL GROUP BY ALL""", "raw"))
def _(spark, sf):
    """The three joins run, and which of them adaptive execution had to split, as their final plans show."""
    rows = canonical_events(spark, sf).withColumn("user_id", F.expr(ONE_USER))
    return skew.skew_splits(stored(spark, rows.repartition(8), "events"), 0.1)


@query("skew_compare", tiered("SELECT way, tier, count(*) AS events, sum(price::DECIMAL(18,2))::DOUBLE AS spend FROM raw JOIN tiers USING (user_id), (VALUES ('merge'), ('adaptive'), ('salted')) w(way) GROUP BY 1, 2"))
def _(spark, sf):
    return skew.skew_compare(canonical_events(spark, sf), 0.009)


@query("two_phase_salted_agg", sql("""SELECT user_id, count(*) AS events, coalesce(sum(price::DECIMAL(18,2)), 0)::DOUBLE AS spend
  FROM raw
  GROUP BY 1""", "raw"))
def _(spark, sf):
    return skew.two_phase_salted_agg(canonical_events(spark, sf), 4, ["event_time", "product_id"])


JOINED = """SELECT s.user_id, s.event_time, s.event_type, s.product_id, p.product_sk
  FROM silver s
  LEFT JOIN dim_product p ON s.product_id = p.product_id AND s.event_timestamp >= p.valid_from_ts AND (s.event_timestamp < p.valid_to_ts OR p.valid_to_ts IS NULL)"""


@query("scd2_temporal_join", sql(JOINED, "dim_product"))
def _(spark, sf):
    s = silver(spark, sf)
    return model.scd2_range_join(s, model.dim_product_scd2(s), ["product_sk"]).select("user_id", "event_time", "event_type", "product_id", "product_sk")


@query("scd2_temporal_join_asof", sql(JOINED, "dim_product"))
def _(spark, sf):
    s = silver(spark, sf)
    return model.scd2_asof_join(s, model.dim_product_scd2(s), ["product_sk"]).select("user_id", "event_time", "event_type", "product_id", "product_sk")


LABELS = sql("SELECT user_id, $T(prediction_timestamp) AS prediction_timestamp, target_purchase_1h, $D(date) AS date FROM labels_1h", "labels_1h")


@query("label_interval_join", sql("""SELECT c.user_id, $T(c.prediction_timestamp) AS prediction_timestamp, count(p.user_id) AS purchases
  FROM candidates c
  LEFT JOIN (SELECT *
  FROM silver
  WHERE event_type = 'purchase') p ON p.user_id = c.user_id AND p.event_timestamp >= c.prediction_timestamp AND p.event_timestamp < c.prediction_timestamp + INTERVAL 1 HOUR
  GROUP BY ALL""", "candidates"))
def _(spark, sf):
    s = silver(spark, sf)
    bought = s.filter("event_type = 'purchase'").select("user_id", F.col("event_timestamp").alias("bought"))
    joined = labels.interval_join(labels.active_user_minutes(s, LABEL_DAY), bought, "prediction_timestamp", "bought")
    return joined.groupBy("user_id", "prediction_timestamp").agg(F.count("bought").alias("purchases"))


@query("scalar_cross_join", sql("SELECT user_id, event_time, product_id, event_type, $T(last) AS last FROM silver, horizon", "horizon"))
def _(spark, sf):
    s = silver(spark, sf)
    last = s.filter("date = date'2024-01-29'").agg(F.max("event_timestamp").alias("last"))
    return s.join(F.broadcast(last)).select("user_id", "event_time", "product_id", "event_type", "last")


F15 = "f_views_15m, f_carts_15m, f_purchases_15m, total_spend_15m"


@query("pit_join", sql(f"""SELECT l.user_id, $T(l.prediction_timestamp) AS prediction_timestamp, CASE WHEN ok THEN f_views_15m END AS f_views_15m,
    CASE WHEN ok THEN total_spend_15m END AS total_spend_15m
  FROM (SELECT l.*, f.* EXCLUDE user_id, f.event_timestamp >= l.prediction_timestamp - INTERVAL 2 HOUR AS ok
  FROM labels_1h l
  ASOF LEFT JOIN features_15m f ON l.user_id = f.user_id AND l.prediction_timestamp >= f.event_timestamp) l""", "labels_1h"))
def _(spark, sf):
    view = training.FeatureView("user_15m", features_15m(spark, sf), ("f_views_15m", "total_spend_15m"), "2 hours")
    return training.pit_join(labels_1h(spark, sf), view, "prediction_timestamp").select("user_id", "prediction_timestamp", "f_views_15m", "total_spend_15m")


@query("fk_orphans", """SELECT l_orderkey, l_linenumber
  FROM lineitem
  WHERE NOT EXISTS (SELECT 1
  FROM orders
  WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def _(spark, sf):
    return model.fk_orphans(table(spark, sf, "lineitem"), "l_orderkey", table(spark, sf, "orders").filter("o_orderstatus = 'F'"), "o_orderkey").select("l_orderkey", "l_linenumber")


PREDICTIONS = """predictions AS (SELECT md5(concat_ws('_', user_id, strftime(prediction_timestamp, '%Y-%m-%d %H:%M:%S'))) AS prediction_id, user_id,
    prediction_timestamp
  FROM candidates)"""


def predictions(spark, sf):
    c = labels.active_user_minutes(silver(spark, sf), LABEL_DAY)
    return c.withColumn("prediction_id", C.key_hash_skipping_nulls(F.col("user_id").cast("string"), F.date_format("prediction_timestamp", "yyyy-MM-dd HH:mm:ss")))


OUTCOMES = sql("@", "candidates").replace("\n@", f""",
{PREDICTIONS}, hits AS (SELECT q.prediction_id, q.prediction_timestamp, max(CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END) AS hit FROM predictions q LEFT JOIN (SELECT * FROM silver WHERE event_type = 'purchase') p
  ON p.user_id = q.user_id AND p.event_timestamp >= q.prediction_timestamp AND p.event_timestamp < q.prediction_timestamp + INTERVAL 1 HOUR GROUP BY 1, 2),
outcomes AS (SELECT *, prediction_timestamp + INTERVAL 75 MINUTE <= TIMESTAMP '2024-01-29 18:00:00' AS ripe FROM hits)
SELECT prediction_id, strftime(prediction_timestamp, '%Y-%m-%d %H:%M:%S') AS label_window_start, strftime(prediction_timestamp + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS label_window_end,
CASE WHEN ripe THEN hit END AS target_purchase_1h, CASE WHEN ripe THEN 'matured' ELSE 'pending' END AS label_status, CASE WHEN ripe THEN strftime(prediction_timestamp + INTERVAL 75 MINUTE, '%Y-%m-%d %H:%M:%S') END AS label_matured_timestamp FROM outcomes""")


@query("prediction_labels", OUTCOMES)
def _(spark, sf):
    return labels.prediction_labels(predictions(spark, sf), silver(spark, sf), "2024-01-29 18:00:00")


@query("label_by_prediction_id", OUTCOMES.replace("SELECT prediction_id, strftime(prediction_timestamp, '%Y-%m-%d %H:%M:%S') AS label_window_start", "SELECT p.prediction_id, p.user_id, o.* EXCLUDE prediction_id FROM predictions p LEFT JOIN (SELECT prediction_id, strftime(prediction_timestamp, '%Y-%m-%d %H:%M:%S') AS label_window_start") + ") o USING (prediction_id)")
def _(spark, sf):
    p = predictions(spark, sf)
    out = labels.prediction_labels(p, silver(spark, sf), "2024-01-29 18:00:00")
    return labels.label_by_prediction_id(out, p.select("prediction_id", "user_id"))


# Aggregations

@query("user_activity_exact", sql("""SELECT user_id, count(*) AS events, count(DISTINCT category_id) AS categories, count(DISTINCT user_session) AS sessions,
    coalesce(sum(price::DECIMAL(18,2)), 0)::DOUBLE AS spend
  FROM silver
  GROUP BY 1"""))
def _(spark, sf):
    return features.user_activity(silver(spark, sf))


@query("user_activity_approx", sql("SELECT user_id, count(DISTINCT user_session) AS sessions, true AS within FROM silver GROUP BY 1"))
def _(spark, sf):
    return features.user_activity_error(silver(spark, sf)).drop("sessions_approx")


@query("sketched_activity", sql("""SELECT user_id, count(DISTINCT user_session) FILTER (date < DATE '2024-01-16') AS sessions_first, count(DISTINCT user_session) AS sessions_all, true AS within
  FROM silver WHERE date >= DATE '2024-01-01' AND date < DATE '2024-01-31' AND user_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (date < DATE '2024-01-16') > 0"""))
def _(spark, sf):
    """Distinct sessions of two windows from one set of stored daily sketches, beside the exact numbers."""
    s = stored(spark, silver(spark, sf), "silver")
    days = stored(spark, features.daily_sketches(s.filter("user_id is not null"), "user_id", "user_session"), "sketches")
    near = None
    for name, end in (("first", "2024-01-16"), ("all", "2024-01-31")):
        exact = s.filter(F.col("date").between("2024-01-01", F.date_sub(F.lit(end).cast("date"), 1))).groupBy("user_id").agg(F.count_distinct("user_session").alias(f"sessions_{name}"))
        both = exact.join(features.merged_distinct(days, "user_id", "2024-01-01", end).withColumnRenamed("distinct", f"near_{name}"), "user_id")
        near = both if near is None else near.join(both, "user_id")
    off = lambda n: F.abs(F.col(f"near_{n}") - F.col(f"sessions_{n}")) <= F.greatest(F.lit(1.0), 3 * features.sketch_deviation() * F.col(f"sessions_{n}"))
    return near.select("user_id", "sessions_first", "sessions_all", (off("first") & off("all")).alias("within"))


@query("user_features_30d", sql(f"""SELECT {F30}, $T(event_timestamp) AS event_timestamp, $T(created) AS created, $D(date) AS date
  FROM features_30d""", "features_30d"))
def _(spark, sf):
    return features_30d(spark, sf)


@query("user_features_30d_raw", sql("""SELECT user_id, count(*) FILTER (event_type = 'view') AS f_views_30d, count(*) FILTER (event_type = 'cart') AS f_carts_30d, count(*) FILTER (event_type = 'purchase') AS f_purchases_30d,
  coalesce(sum(price::DECIMAL(18,2)) FILTER (event_type = 'purchase'), 0)::DOUBLE AS f_spend_30d, count(DISTINCT category_id) AS f_distinct_categories_30d FROM raw WHERE strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') >= TIMESTAMP '2023-12-31' AND strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') < TIMESTAMP '2024-01-30' GROUP BY 1""", "raw"))
def _(spark, sf):
    return features.user_features_30d_raw(canonical_events(spark, sf), DAY)


@query("label_max", LABELS)
def _(spark, sf):
    return labels_1h(spark, sf)


QUERIES["user_labels"] = QUERIES["label_max"]


@query("distinct_keys", sql("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_time, product_id, event_type FROM raw)", "raw"))
def _(spark, sf):
    return canonical_events(spark, sf).select(*KEYS["stg_events"]).distinct().agg(F.count("*").alias("n"))


@query("dedup_events", sql(f"SELECT {RAW} FROM deduped", "deduped"))
def _(spark, sf):
    return ev.dedup_events(canonical_events(spark, sf)).select(*NEW_COLUMNS)


KEY_COUNTS = "(SELECT user_id, event_time, product_id, event_type, count(*) AS n FROM raw GROUP BY ALL)"


@query("dedup_effect", sql(f"""SELECT sum(n)::BIGINT AS rows_before, count(*) AS rows_after, sum(n - 1)::BIGINT AS rows_dropped
  FROM {KEY_COUNTS}""", "raw"))
def _(spark, sf):
    return ev.dedup_effect(canonical_events(spark, sf))


@query("duplicate_rate", sql("""SELECT part, rows, duplicates, round(100.0 * duplicates / rows, 4) AS duplicate_pct FROM (SELECT coalesce(part, 'all') AS part, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates FROM
  (SELECT event_time[1:10] AS part, user_id, event_time, product_id, event_type, count(*) AS n FROM raw GROUP BY ALL) GROUP BY ROLLUP (part))""", "raw"))
def _(spark, sf):
    return ev.duplicate_rate(canonical_events(spark, sf).withColumn("part", F.substring("event_time", 1, 10)), "part")


@query("null_profile", """SELECT 'o_orderkey' AS column, 'bigint' AS type, count(o_orderkey) AS non_null, count(*) - count(o_orderkey) AS nulls,
    round(100.0 * (count(*) - count(o_orderkey)) / count(*), 4) AS null_pct
  FROM orders
  UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority), count(*) - count(o_orderpriority),
    round(100.0 * (count(*) - count(o_orderpriority)) / count(*), 4)
  FROM orders""")
def _(spark, sf):
    return audit.null_profile(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))


@query("value_share", sql("""SELECT brand AS value, count(*) AS n, CASE WHEN brand IS NOT NULL THEN round(100.0 * count(*) / (SELECT count(brand)
  FROM raw), 4) END AS pct_non_null, round(100.0 * count(*) / (SELECT count(*)
  FROM raw), 4) AS pct_all
  FROM raw
  GROUP BY brand""", "raw"))
def _(spark, sf):
    return audit.value_share(canonical_events(spark, sf), "brand")


@query("cardinality_profile", sql("""SELECT 'user_id' AS column, count(DISTINCT user_id) AS distinct, round(count(DISTINCT user_id) / count(*), 6) AS ratio
  FROM raw
  UNION ALL SELECT 'product_id', count(DISTINCT product_id), round(count(DISTINCT product_id) / count(*), 6)
  FROM raw""", "raw"))
def _(spark, sf):
    return audit.cardinality_profile(canonical_events(spark, sf), ["user_id", "product_id"])


@query("skew_profile", sql("""SELECT count(*) AS keys, sum(n)::BIGINT AS rows, max(n) AS max_rows, median(n)::DOUBLE AS median_rows, (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM raw WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY n DESC LIMIT 3)) AS hot_rows,
  round((SELECT sum(n) FROM (SELECT count(*) AS n FROM raw WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY n DESC LIMIT 3)) / sum(n), 6) AS hot_ratio FROM (SELECT count(*) AS n FROM raw WHERE user_id IS NOT NULL GROUP BY user_id)""", "raw"))
def _(spark, sf):
    return audit.skew_profile(canonical_events(spark, sf), "user_id")


@query("stream_partition_profile", f"""SELECT partition, count(*) AS messages, count(DISTINCT user_id) AS keys, 0::BIGINT AS keys_on_many
  FROM ({RECORDS})
  GROUP BY 1""")
def _(spark, sf):
    return audit.stream_partition_profile(records(spark, sf))


LATE = f"(SELECT *, epoch(max(event_timestamp) OVER (PARTITION BY partition ORDER BY \"offset\"))::BIGINT - epoch(event_timestamp)::BIGINT AS lateness_seconds FROM ({RECORDS}))"


@query("late_events", f"SELECT event_id, lateness_seconds, lateness_seconds >= 288 AS is_late FROM {LATE}")
def _(spark, sf):
    return audit.late_events(records(spark, sf)).select("event_id", "lateness_seconds", "is_late")


@query("delay_distribution", f"""SELECT count(lateness_seconds) AS n, min(lateness_seconds) AS min, median(lateness_seconds)::DOUBLE AS median, max(lateness_seconds) AS max,
    sum(lateness_seconds)::DOUBLE / count(lateness_seconds) AS mean
  FROM {LATE}""")
def _(spark, sf):
    return audit.delay_distribution(audit.late_events(records(spark, sf)))


@query("discount_distribution", sql("""SELECT discount_percent AS value, count(*) AS n, CASE WHEN discount_percent IS NOT NULL THEN round(100.0 * count(*) / (SELECT count(discount_percent)
  FROM raw), 4) END AS pct_non_null, round(100.0 * count(*) / (SELECT count(*)
  FROM raw), 4) AS pct_all
  FROM raw
  GROUP BY 1""", "raw"))
def _(spark, sf):
    return audit.value_share(canonical_events(spark, sf), "discount_percent")


@query("label_balance", sql("""SELECT count(*) AS rows, count_if(target_purchase_1h = 1) AS positives, count_if(target_purchase_1h = 0) AS negatives,
    round(count_if(target_purchase_1h = 1) / count(*), 6) AS positive_rate
  FROM labels_1h""", "labels_1h"))
def _(spark, sf):
    return training.label_balance(labels_1h(spark, sf))


@query("busiest_user", sql("""SELECT user_id, count(*) AS events
  FROM silver
  WHERE user_id IS NOT NULL
  GROUP BY 1 HAVING count(*) >= 10
  ORDER BY 2 DESC, 1 LIMIT 1"""))
def _(spark, sf):
    return audit.busiest_user(silver(spark, sf))


HOPS = sql(f"SELECT user_id, {F15}, $T(event_timestamp) AS event_timestamp, $T(created) AS created FROM features_15m", "features_15m")


@query("user_features_15m_batch", HOPS)
def _(spark, sf):
    return features_15m(spark, sf)


@query("user_features_15m_at", sql("""SELECT c.user_id, $T(c.prediction_timestamp) AS t, count(*) FILTER (s.event_type = 'view') AS f_views_15m, count(*) FILTER (s.event_type = 'cart') AS f_carts_15m, count(*) FILTER (s.event_type = 'purchase') AS f_purchases_15m,
  coalesce(sum(s.price::DECIMAL(18,2)) FILTER (s.event_type = 'purchase'), 0)::DOUBLE AS total_spend_15m FROM candidates c LEFT JOIN silver s ON s.user_id = c.user_id AND s.event_timestamp >= c.prediction_timestamp - INTERVAL 15 MINUTE AND s.event_timestamp < c.prediction_timestamp GROUP BY ALL""", "candidates"))
def _(spark, sf):
    s = silver(spark, sf)
    return features.user_features_15m_at(s, labels.active_user_minutes(s, LABEL_DAY).withColumnRenamed("prediction_timestamp", "t"))


# Dimensional model

@query("dim_product_scd2", sql("""SELECT product_sk, product_id, category_id, category_level1, brand, price, discount_percent, $T(valid_from_ts) AS valid_from_ts,
    $T(valid_to_ts) AS valid_to_ts, is_current
  FROM dim_product""", "dim_product"))
def _(spark, sf):
    return products(spark, sf)


@query("dim_product_merged", sql("""SELECT product_sk, product_id, category_id, category_level1, brand, price, discount_percent, $T(valid_from_ts) AS valid_from_ts,
    $T(valid_to_ts) AS valid_to_ts, is_current
  FROM dim_product""", "dim_product"))
def _(spark, sf):
    """The dimension kept by merges: the last ten days come first, the first ones late, some events twice."""
    s, path = stored(spark, silver(spark, sf), "silver"), shared_folder(spark, "products")
    for low, high in (("2024-01-21", "2100-01-01"), ("2024-01-08", "2024-01-21"), ("1970-01-01", "2024-01-11")):
        dims.merge_products(spark, path, s.filter((F.col("date") >= low) & (F.col("date") < high)), 16)
    dims.merge_products(spark, path, s.filter("date is null"), 16)
    return dims.merged_products(spark, path)


@query("dim_product_scd2_changes", sql("""SELECT product_id, price, $T(valid_from_ts) AS valid_from_ts, $T(lead(valid_from_ts) OVER (PARTITION BY product_id ORDER BY valid_from_ts)) AS valid_to_ts FROM (
  SELECT *, event_timestamp AS valid_from_ts, lag({'a': category_id, 'b': category_level1, 'c': brand, 'd': price, 'e': discount_percent}) OVER (PARTITION BY product_id ORDER BY event_timestamp) AS before, {'a': category_id, 'b': category_level1, 'c': brand, 'd': price, 'e': discount_percent} AS now
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id, event_timestamp ORDER BY price DESC NULLS LAST, discount_percent NULLS LAST, brand NULLS LAST, category_id NULLS LAST, category_level1 NULLS LAST) AS rn FROM silver) WHERE rn = 1) WHERE before IS NULL OR before IS DISTINCT FROM now"""))
def _(spark, sf):
    return model.dim_product_scd2_changes(silver(spark, sf)).select("product_id", "price", "valid_from_ts", "valid_to_ts")


@query("dim_user", sql("""SELECT user_id, $T(min(event_timestamp)) AS first_seen, $T(max(event_timestamp)) AS last_seen, count(*) AS total_lifetime_events, true AS is_active,
    true AS is_current
  FROM silver
  WHERE user_id IS NOT NULL
  GROUP BY user_id"""))
def _(spark, sf):
    return model.dim_user(silver(spark, sf)).select("user_id", "first_seen", "last_seen", "total_lifetime_events", "is_active", "is_current")


@query("fact_user_events", sql("""SELECT event_id, $T(event_timestamp) AS event_timestamp, event_time, $D(date) AS date, user_id, product_sk, category_level1, brand, price,
    discount_percent, event_type, user_session
  FROM fact""", "fact"))
def _(spark, sf):
    s = silver(spark, sf)
    return model.fact_user_events(s, model.dim_product_scd2(s))


@query("fact_event_ids_compat", sql("""SELECT md5(concat_ws('_', user_id, event_time, product_id)) AS event_id, event_type, count(*) AS n FROM silver GROUP BY ALL"""))
def _(spark, sf):
    """The ids of the older hash, which several types of event of one user, time and product share."""
    s = silver(spark, sf)
    return model.fact_user_events(s, model.dim_product_scd2(s), compat=True).groupBy("event_id", "event_type").agg(F.count("*").alias("n"))


@query("stg_events", sql(f"SELECT {RAW}, $T(event_timestamp) AS event_timestamp, $D(date) AS date, category_level1 FROM silver"))
def _(spark, sf):
    return silver(spark, sf).drop("ingestion_time")


# Windows, top-k, sets

@query("brand_cumulative_share", sql("""SELECT value, n, row_number() OVER (ORDER BY n DESC, value)::INTEGER AS rank, round(100.0 * sum(n) OVER (ORDER BY n DESC,
    value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS cumulative_pct
  FROM (SELECT brand AS value, count(*) AS n
  FROM raw
  WHERE brand IS NOT NULL
  GROUP BY 1)""", "raw"))
def _(spark, sf):
    return audit.cumulative_share(canonical_events(spark, sf), "brand")


@query("throughput_profile", """WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts, event_id) AS rn
  FROM events) SELECT a.rn, CASE WHEN b.ts > a.ts THEN round(250 / ((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6), 6) END AS rows_per_second
  FROM r a
  JOIN r b ON b.rn = a.rn + 250
  WHERE (a.rn - 1) % 100 = 0""")
def _(spark, sf):
    return audit.throughput_profile(table(spark, sf, "events"))


@query("labels_sorted", LABELS)
def _(spark, sf):
    return training.sorted_within_files(labels_1h(spark, sf))


@query("top_categories", sql("""SELECT category_code AS value, count(*) AS n
  FROM raw
  WHERE category_code IS NOT NULL
  GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 15""", "raw"))
def _(spark, sf):
    return audit.top_values(canonical_events(spark, sf), "category_code", 15)


@query("top_brands", sql("SELECT brand AS value, count(*) AS n FROM raw WHERE brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "raw"))
def _(spark, sf):
    return audit.top_values(canonical_events(spark, sf), "brand", 8)


@query("label_limit", sql("""SELECT user_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS prediction_timestamp, target_purchase_1h, strftime(d, '%Y-%m-%d') AS date
  FROM (SELECT user_id, prediction_timestamp AS t, target_purchase_1h, date AS d
  FROM labels_1h
  ORDER BY t, user_id LIMIT 100)""", "labels_1h"))
def _(spark, sf):
    return training.label_limit(labels_1h(spark, sf), 100)


@query("label_sample", sql(f"SELECT user_id, $T(prediction_timestamp) AS prediction_timestamp, target_purchase_1h, $D(date) AS date FROM labels_1h WHERE {md5_bucket(1_000_000, "'42'", USER, "strftime(prediction_timestamp, '%Y-%m-%d %H:%M:%S')")} < 250000", "labels_1h"))
def _(spark, sf):
    return training.label_sample(labels_1h(spark, sf), 0.25)


@query("duplicate_examples", sql(f"SELECT * FROM {KEY_COUNTS} WHERE n > 1 ORDER BY user_id, event_time, product_id, event_type LIMIT 20", "raw"))
def _(spark, sf):
    return ev.duplicate_examples(canonical_events(spark, sf))


@query("chronological_split", sql("""SELECT split, count(*) AS n
  FROM (SELECT CASE WHEN epoch(prediction_timestamp) <= (SELECT quantile_cont(epoch(prediction_timestamp), 0.7)
  FROM labels_1h) THEN 'train' WHEN epoch(prediction_timestamp) <= (SELECT quantile_cont(epoch(prediction_timestamp), 0.85)
  FROM labels_1h) THEN 'validation' ELSE 'test' END AS split
  FROM labels_1h)
  GROUP BY 1""", "labels_1h"))
def _(spark, sf):
    return training.chronological_split(labels_1h(spark, sf), "prediction_timestamp").groupBy("split").agg(F.count("*").alias("n"))


@query("union_parts", sql("SELECT event_type, 2 * count(*) AS n FROM raw GROUP BY 1", "raw"))
def _(spark, sf):
    raw = canonical_events(spark, sf)
    return raw.union(raw).groupBy("event_type").agg(F.count("*").alias("n"))


# Feature store

DAYS = """SELECT user_id, count(*) FILTER (event_type = 'view') AS f_views_30d, count(*) FILTER (event_type = 'cart') AS f_carts_30d,
    count(*) FILTER (event_type = 'purchase') AS f_purchases_30d, coalesce(sum(price::DECIMAL(18,2)) FILTER (event_type = 'purchase'),
    0)::DOUBLE AS f_spend_30d, count(DISTINCT category_id) AS f_distinct_categories_30d
  FROM silver
  WHERE date >= DATE '2023-12-30' AND date < DATE '2024-01-29'
  GROUP BY 1"""
LONG = ("f_views_30d", "f_carts_30d", "f_purchases_30d", "f_spend_30d", "f_distinct_categories_30d")
SHORT = ("f_views_15m", "f_carts_15m", "f_purchases_15m", "total_spend_15m")
FRESH = "coalesce(h.event_timestamp >= l.prediction_timestamp - INTERVAL 2 HOUR, false)"
FEATURES = ", ".join([f"coalesce(d.{c}, 0) AS {c}, d.user_id IS NULL AS {c}_missing" for c in LONG] + [f"coalesce(CASE WHEN {FRESH} THEN h.{c} END, 0) AS {c}, NOT {FRESH} AS {c}_missing" for c in SHORT])


@query(
    "training_set",
    sql(
        f"""SELECT l.user_id, strftime(l.prediction_timestamp, '%Y-%m-%d %H:%M:%S') AS prediction_timestamp, l.target_purchase_1h, {FEATURES}
  FROM labels_1h l LEFT JOIN ({DAYS}) d ON d.user_id = l.user_id
  ASOF LEFT JOIN features_15m h ON l.user_id = h.user_id AND l.prediction_timestamp >= h.event_timestamp""",
        "labels_1h",
    ),
)
def _(spark, sf):
    s = stored(spark, silver(spark, sf), "silver")  # deduplicated once for labels and both views
    return training.training_set(labels_1h(spark, sf, s), views(spark, sf, s)).drop("date")


NEWEST = "SELECT user_id, {f}, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn FROM features_15m WHERE {w}) WHERE rn = 1".replace("{f}", F15)


@query("materialize_range", sql(NEWEST.replace("{w}", "event_timestamp >= TIMESTAMP '2024-01-10' AND event_timestamp < TIMESTAMP '2024-01-20 23:59:59'"), "features_15m"))
def _(spark, sf):
    return online.materialize_range(features_15m(spark, sf), "2024-01-10", "2024-01-20").drop("created")


def _incremental(spark, sf):
    f = features_15m(spark, sf)
    before = online.materialize_range(f, "2024-01-01", "2024-01-15 00:00:00")
    return before, online.materialize_incremental(f, before, "2024-01-15 00:00:00", "2024-01-25 00:00:00")


@query("materialize_incremental", sql(NEWEST.replace("{w}", "event_timestamp < TIMESTAMP '2024-01-25'"), "features_15m"))
def _(spark, sf):
    return _incremental(spark, sf)[1].drop("created")


@query("push_features", sql(NEWEST.replace("{w}", "true"), "features_15m"))
def _(spark, sf):
    f = stored(spark, features_15m(spark, sf), "features")
    target = online.PushTarget(spark, shared_folder(spark, "push"))
    cut = F.to_timestamp(F.lit("2024-01-15"))
    target.push(f.filter(F.col("event_timestamp") >= cut), 0)  # newer rows first, then older ones, then a repeat
    target.push(f.filter(F.col("event_timestamp") < cut), 1)
    target.push(f.filter(F.col("event_timestamp") < cut), 1)
    return target.online(1).drop("created")


@query("online_lookup", sql("""SELECT u.user_id, CASE WHEN ok THEN f_views_15m END AS f_views_15m
  FROM (SELECT DISTINCT user_id
  FROM silver) u
  LEFT JOIN (SELECT *, event_timestamp >= TIMESTAMP '2024-01-30 22:00:00' AND event_timestamp <= TIMESTAMP '2024-01-31' AS ok
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY event_timestamp DESC) AS rn
  FROM features_15m)
  WHERE rn = 1) f ON f.user_id = u.user_id""", "features_15m"))
def _(spark, sf):
    table_ = online.newest(features_15m(spark, sf))
    return online.online_lookup(table_, silver(spark, sf), "2024-01-31 00:00:00", "2 hours").select("user_id", "f_views_15m")


@query("active_user_minutes", sql("SELECT user_id, $T(prediction_timestamp) AS prediction_timestamp FROM candidates", "candidates"))
def _(spark, sf):
    return labels.active_user_minutes(silver(spark, sf), LABEL_DAY)


@query("freshness_report", sql("""SELECT count(DISTINCT user_id) FILTER (event_timestamp < TIMESTAMP '2024-01-15') AS keys_before, count(DISTINCT user_id) AS keys_after,
    count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (event_timestamp < TIMESTAMP '2024-01-15') AS keys_added
  FROM features_15m
  WHERE event_timestamp < TIMESTAMP '2024-01-25'""", "features_15m"))
def _(spark, sf):
    return online.freshness_report(*_incremental(spark, sf))


# Data quality

RESULT = "'{c}' AS check, '{t}' AS table, {p} AS passed, {o}::DOUBLE AS observed, {e}::DOUBLE AS expected, '' AS detail"


def result(check: str, name: str, passed: str, observed: str, expected: float, source: str) -> str:
    return "SELECT " + RESULT.format(c=check, t=name, p=passed, o=observed, e=expected) + f" FROM {source}"


DUPES = "(SELECT count(*) - 1 AS d FROM silver GROUP BY user_id, event_time, product_id, event_type)"


@query("check_bronze", sql(" UNION ALL ".join([result("bronze_rows", "raw_events", "count(*) >= 1", "count(*)", 1, "raw"), result("bronze_columns", "raw_events", "true", "11", 11, "(SELECT 1)"), result("bronze_null_users", "raw_events", "count_if(user_id IS NULL) = 0", "count_if(user_id IS NULL)", 0, "raw")]), "raw"))
def _(spark, sf):
    return quality.check_bronze(canonical_events(spark, sf))


@query("check_gold", sql(" UNION ALL ".join([result("silver_rows", "stg_events", "count(*) >= 1", "count(*)", 1, "silver"), result("fact_rows", "fact_user_events", "count(*) >= 1", "count(*)", 1, "fact"), result("fact_equals_silver", "fact_user_events", "(SELECT count(*) FROM silver) = count(*)", "(count(*) - (SELECT count(*) FROM silver))", 0, "fact"), result("fact_null_product_sk", "fact_user_events", "count_if(product_sk IS NULL) = 0", "count_if(product_sk IS NULL)", 0, "fact"), result("fact_without_product_id", "fact_user_events", "true", "0", 0, "(SELECT 1)")]), "fact"))
def _(spark, sf):
    s = silver(spark, sf)
    return quality.check_gold(s, model.fact_user_events(s, model.dim_product_scd2(s)))


@query("check_features", sql(" UNION ALL ".join([result("feature_columns", "feat_user_30d", "true", "0", 0, "(SELECT 1)"), result("feature_rows", "feat_user_30d", "count(*) >= 1", "count(*)", 1, "features_30d")]), "features_30d"))
def _(spark, sf):
    return quality.check_features(features_30d(spark, sf))


@query("check_labels", sql(" UNION ALL ".join([result("label_rows", "user_labels", "count(*) >= 1", "count(*)", 1, "labels_1h"), result("binary_labels", "user_labels", "true", "0", 0, "(SELECT 1)")]), "labels_1h"))
def _(spark, sf):
    return quality.check_labels(labels_1h(spark, sf))


@query("contract_bronze_nulls", sql(result("bronze_null_users", "raw_events", "count_if(user_id IS NULL) = 0", "count_if(user_id IS NULL)", 0, "raw"), "raw"))
def _(spark, sf):
    return quality.contract_bronze_nulls(canonical_events(spark, sf))


@query("contract_silver_duplicates", sql(result("silver_duplicates", "stg_events", "sum(d) = 0", "sum(d)", 0, DUPES)))
def _(spark, sf):
    return quality.contract_silver_duplicates(silver(spark, sf))


SCD2 = " UNION ALL ".join([
    result("scd2_null_key", "dim_product", "count_if(product_sk IS NULL) = 0", "count_if(product_sk IS NULL)", 0, "dim_product"),
    result("scd2_inverted", "dim_product", "count_if(valid_to_ts <= valid_from_ts) = 0", "count_if(valid_to_ts <= valid_from_ts)", 0, "dim_product"),
    result("scd2_many_current", "dim_product", "count_if(n > 1) = 0", "count_if(n > 1)", 0, "(SELECT count_if(is_current) AS n FROM dim_product GROUP BY product_id)"),
    result("scd2_overlap", "dim_product", "count_if(following < coalesce(valid_to_ts, TIMESTAMP '9999-01-01')) = 0", "count_if(following < coalesce(valid_to_ts, TIMESTAMP '9999-01-01'))", 0, "(SELECT *, lead(valid_from_ts) OVER (PARTITION BY product_id ORDER BY valid_from_ts) AS following FROM dim_product)"),
    result("scd2_gap", "dim_product", "count_if(following > valid_to_ts) = 0", "count_if(following > valid_to_ts)", 0, "(SELECT *, lead(valid_from_ts) OVER (PARTITION BY product_id ORDER BY valid_from_ts) AS following FROM dim_product)"),
])


@query("contract_scd2", sql(SCD2, "dim_product"))
def _(spark, sf):
    return quality.contract_scd2(products(spark, sf))


@query("contract_feature_timestamps", sql(result("feature_timestamps", "feat_user_15m", "count_if(event_timestamp IS NULL OR created IS NULL) = 0", "count_if(event_timestamp IS NULL OR created IS NULL)", 0, "features_15m"), "features_15m"))
def _(spark, sf):
    return quality.contract_feature_timestamps(features_15m(spark, sf))


@query("contract_binary_labels", sql(result("binary_labels", "user_labels", "count_if(target_purchase_1h NOT IN (0, 1)) = 0", "count_if(target_purchase_1h NOT IN (0, 1))", 0, "labels_1h"), "labels_1h"))
def _(spark, sf):
    return quality.contract_binary_labels(labels_1h(spark, sf))


@query("catalog_conformance", sql(" UNION ALL ".join([result("catalog_columns", "stg_events", "true", "0", 0, "(SELECT 1)"), result("catalog_key_null", "stg_events", "count_if(user_id IS NULL OR event_time IS NULL OR product_id IS NULL OR event_type IS NULL) = 0", "count_if(user_id IS NULL OR event_time IS NULL OR product_id IS NULL OR event_type IS NULL)", 0, "silver"), result("catalog_key_repeated", "stg_events", "count_if(d > 0) = 0", "count_if(d > 0)", 0, DUPES)])))
def _(spark, sf):
    return quality.catalog_conformance(silver(spark, sf), "stg_events")


@query("contract_suite", sql(" UNION ALL ".join([result("bronze_null_users", "raw_events", "count_if(user_id IS NULL) = 0", "count_if(user_id IS NULL)", 0, "raw"), result("silver_duplicates", "stg_events", "sum(d) = 0", "sum(d)", 0, DUPES), SCD2, result("feature_timestamps", "feat_user_15m", "true", "0", 0, "(SELECT 1)"), result("binary_labels", "user_labels", "true", "0", 0, "(SELECT 1)")]), "dim_product"))
def _(spark, sf):
    s = stored(spark, silver(spark, sf), "silver")
    return quality.contract_suite({"raw_events": canonical_events(spark, sf), "stg_events": s, "dim_product": model.dim_product_scd2(s), "feat_user_15m": features.hopping_features(s), "user_labels": labels.user_labels(s, LABEL_DAY)})


@query("table_summary", sql("""SELECT 'silver' AS table, count(*) AS rows, 14 AS columns, count(DISTINCT date) AS partitions
  FROM silver
  UNION ALL SELECT 'orders', count(*), 6, 0
  FROM orders"""))
def _(spark, sf):
    return quality.table_summary({"silver": silver(spark, sf), "orders": table(spark, sf, "orders")})


@query("gate", sql("SELECT count(*) AS n FROM silver"))
def _(spark, sf):
    s = silver(spark, sf)
    quality.gate(quality.contract_silver_duplicates(s))
    return s.agg(F.count("*").alias("n"))


@query("reconcile_copy", "SELECT count(*) AS source_rows, count(*) AS copy_rows, true AS equal FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return quality.reconcile_copy(orders, stored(spark, orders.repartition(4, "o_custkey"), "copy"))


# Storage layout

@query("cluster_by_user", sql("SELECT user_id, count(*) AS n FROM silver GROUP BY 1"))
def _(spark, sf):
    path = shared_folder(spark, "clustered")
    layout.cluster_by_user(silver(spark, sf), path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("compact_files", "SELECT count(*) AS rows, sum(o_custkey)::BIGINT AS check_sum FROM orders")
def _(spark, sf):
    source, target = shared_folder(spark, "scattered"), shared_folder(spark, "compact")
    orders = table(spark, sf, "orders")
    orders.repartition(max(16, orders.count() // 500_000)).write.parquet(source)
    layout.compact_files(spark, source, target)
    return spark.read.parquet(target).agg(F.count("*").alias("rows"), F.sum("o_custkey").alias("check_sum"))


@query("file_layout_report", "SELECT count(*) AS rows, 1::BIGINT AS files FROM orders")
def _(spark, sf):
    return layout.file_layout_report(table(spark, sf, "orders")).agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))


LOOKUPS = """SELECT layout, lookup, CASE lookup WHEN 'user' THEN (SELECT count(*) FROM silver WHERE user_id = 7) ELSE (SELECT count(*) FROM silver WHERE date = DATE '2024-01-10') END AS rows,
    layout = 'interleaved' OR (layout = 'by_user' AND lookup = 'user') AS few_files, (SELECT count(*) FROM silver) * 1.0 AS all_rows
  FROM (VALUES ('as_written'), ('by_user'), ('interleaved')) l(layout), (VALUES ('user'), ('day')) k(lookup)"""


@query("lookup_benchmark", sql(LOOKUPS))
def _(spark, sf):
    """Lookups by user and by day on three layouts of one table: rows found, and whether the executed scans opened at most half of the files."""
    rows, root = stored(spark, silver(spark, sf), "silver"), shared_folder(spark, "layouts")
    keys = ["user_id", "event_timestamp"]
    rows.repartition(32).write.parquet(f"{root}/as_written/rows")
    layout.write_statistics(spark, f"{root}/as_written", keys)
    layout.write_clustered(rows, f"{root}/by_user", ["user_id"], 32)
    layout.write_statistics(spark, f"{root}/by_user", keys)
    layout.write_clustered(rows, f"{root}/interleaved", keys, 32)
    day = (datetime(2024, 1, 10), datetime(2024, 1, 10, 23, 59, 59, 999_999))
    report = layout.lookup_report(spark, {n: f"{root}/{n}" for n in ("as_written", "by_user", "interleaved")}, {"user": {"user_id": (7, 7)}, "day": {"event_timestamp": day}})
    total = rows.agg(F.count("*").cast("double").alias("all_rows"))
    return report.join(F.broadcast(total)).select("layout", "lookup", "rows", (2 * F.col("files_read") <= F.col("files")).alias("few_files"), "all_rows")


@query("stage_skew_metrics", sql("""SELECT count(*) AS partitions, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows
  FROM (SELECT count(*) AS n
  FROM raw
  GROUP BY coalesce(user_id, 0) % 16)""", "raw"))
def _(spark, sf):
    # Dealt by the key itself, so that any engine can tell how full the partitions are.
    return audit.partition_skew(canonical_events(spark, sf).repartitionById(16, (F.coalesce("user_id", F.lit(0)) % 16).cast("int")))


# Table scaling and fault shaping

@query("replicate_time_shift", sql("""SELECT replica, $T(min(t)) AS first_time, count(*) AS n
  FROM (SELECT r::INTEGER AS replica, strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') + to_days((30 * r)::INTEGER) AS t
  FROM raw, range(3) x(r))
  GROUP BY 1""", "raw"))
def _(spark, sf):
    out = shape.replicate_time_shift(canonical_events(spark, sf), 3)
    return out.groupBy("replica").agg(F.min(C.event_timestamp("event_time")).alias("first_time"), F.count("*").alias("n"))


@query("remap_users", sql(f"""SELECT replica, count(DISTINCT moved) AS users, count_if(moved >= 1000000000) AS moved_rows
  FROM (SELECT replica, CASE WHEN replica > 0 AND {md5_bucket(100, USER, 'replica::VARCHAR')} < 30 THEN user_id + replica * 1000000000 ELSE user_id END AS moved
  FROM raw, (SELECT unnest(range(3))::INTEGER AS replica))
  GROUP BY 1""", "raw"))
def _(spark, sf):
    return shape.remap_users(shape.replicate_time_shift(canonical_events(spark, sf), 3)).groupBy("replica").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("user_id") >= 1_000_000_000).alias("moved_rows"))


JITTER = f"price * (1 + ({md5_bucket(20_001, PRODUCT, 'replica::VARCHAR')} - 10000) / 1000000 * 5)"


@query("jitter_prices", sql(f"""SELECT replica, event_type, count(*) AS n, sum((CASE WHEN replica > 0 THEN round(({JITTER})::DECIMAL(20,6),
    2) ELSE price END)::DECIMAL(18,2))::DOUBLE AS total
  FROM raw, (SELECT unnest(range(2))::INTEGER AS replica)
  GROUP BY ALL""", "raw"))
def _(spark, sf):
    out = shape.jitter_prices(shape.replicate_time_shift(canonical_events(spark, sf), 2))
    return out.groupBy("replica", "event_type").agg(F.count("*").alias("n"), C.money_sum("price").alias("total"))


@query("suffix_sessions", sql("""SELECT replica, user_session || CASE WHEN replica > 0 THEN '-r' || replica ELSE '' END AS user_session, count(*) AS n
  FROM (SELECT *, r::INTEGER AS replica
  FROM raw, range(2) x(r))
  GROUP BY ALL""", "raw"))
def _(spark, sf):
    return shape.suffix_sessions(shape.replicate_time_shift(canonical_events(spark, sf), 2)).groupBy("replica", "user_session").agg(F.count("*").alias("n"))


@query("evolve_schema", sql(f"""SELECT discount_percent, count(*) AS n
  FROM (SELECT CASE WHEN event_time[1:10] >= '{EVOLUTION_DATE}' THEN [4, 5, 8, 10, 12][((length(event_time) + coalesce(product_id,
    0)) % 5 + 1)::INTEGER] END AS discount_percent
  FROM raw)
  GROUP BY 1""", "raw"))
def _(spark, sf):
    return files.union_evolved(*shape.evolve_schema(canonical_events(spark, sf), EVOLUTION_DATE)).groupBy("discount_percent").agg(F.count("*").alias("n"))


ROW = (USER, "event_time", PRODUCT, "event_type", "coalesce(price::DECIMAL(18,2)::VARCHAR, '~')")
INJECTED = f"SELECT CASE WHEN {md5_bucket(10_000, *ROW)} < 3500 THEN 900000001 + {md5_bucket(3, "'hot'", *ROW)} ELSE user_id END AS user_id FROM raw"
SKEW = """SELECT count(*) AS keys, sum(n)::BIGINT AS rows, max(n) AS max_rows, median(n) AS median_rows, (SELECT sum(n)::BIGINT
  FROM (SELECT n
  FROM counts
  ORDER BY n DESC, user_id LIMIT 3)) AS hot_rows
  FROM counts"""


@query("inject_hot_keys", sql(f"""SELECT *, round(hot_rows / rows, 6) AS hot_ratio
  FROM (WITH counts AS (SELECT user_id, count(*) AS n
  FROM ({INJECTED})
  WHERE user_id IS NOT NULL
  GROUP BY 1) {SKEW})""", "raw"))
def _(spark, sf):
    return audit.skew_profile(shape.inject_hot_keys(canonical_events(spark, sf), 0.35, [900_000_001, 900_000_002, 900_000_003]), "user_id")


@query("drift_column", sql("""SELECT event_type, sum(round((price * 1.5)::DECIMAL(20,6), 2)::DECIMAL(18,2))::DOUBLE AS total
  FROM raw
  GROUP BY 1""", "raw"))
def _(spark, sf):
    return shape.drift_column(canonical_events(spark, sf)).groupBy("event_type").agg(C.money_sum("price").alias("total"))


@query("inject_duplicates", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM events")
def _(spark, sf):
    return shape.inject_duplicates(table(spark, sf, "events"), 50, "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


@query("assign_arrival", """SELECT event_id, delay_seconds, is_delayed, strftime(t + to_seconds(delay_seconds), '%Y-%m-%d %H:%M:%S') AS arrival
  FROM (SELECT event_id, date_trunc('second', ts) AS t,
    CASE WHEN event_id % 20 = 0 THEN 300 + (event_id * 37) % 301 ELSE 0 END::INTEGER AS delay_seconds, event_id % 20 = 0 AS is_delayed
  FROM events)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("event_timestamp"))
    return shape.assign_arrival(e).select("event_id", "delay_seconds", "is_delayed", "arrival")


@query("scaling_manifest", sql(f"""SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, (SELECT max(c)
  FROM (SELECT count(*) AS c
  FROM raw
  GROUP BY user_id)) AS max_user_rows, 11 AS columns, round((SELECT max(c)
  FROM (SELECT count(*) AS c
  FROM raw
  GROUP BY user_id)) / sum(n), 6) AS max_user_ratio
  FROM {KEY_COUNTS}""", "raw"))
def _(spark, sf):
    return shape.scaling_manifest(canonical_events(spark, sf), KEYS["stg_events"])
