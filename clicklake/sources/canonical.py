"""The driver's tables as canonical e-commerce events, and the same projection as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: First day of files with discounts, and the discounts.
EVOLUTION_DATE, DISCOUNTS = "2024-01-16", (4, 5, 8, 10, 12)
#: Ingestion and creation times are parameters; queries use this one.
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows: events joined to parts, every fiftieth a second time (repeats of the source)."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    e = e.withColumn("product_id", F.get_json_object("props", "$.k").cast("bigint"))
    rows = e.join(p, e.product_id == p.p_partkey, "left").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        "product_id",
        F.col("p_size").cast("bigint").alias("category_id"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(".")).alias("category_code"),
        F.when(F.col("event_id") % 7 != 0, F.col("p_brand")).alias("brand"),
        F.col("value").alias("price"),
        "user_id",
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("user_session"),
        F.when(F.to_date("ts") >= F.lit(EVOLUTION_DATE).cast("date"), F.element_at(F.array(*map(F.lit, DISCOUNTS)), (F.col("event_id") % 5 + 1).cast("int"))).alias("discount_percent"),
        F.to_timestamp(F.lit(AS_OF)).alias("ingestion_time"),
        F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text, so that a check compares them in any engine."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        pattern = {"timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd"}.get(kind)
        out.append(F.date_format(f"`{f.name}`", pattern).alias(f.name) if pattern else F.col(f"`{f.name}`"))
    return df.select(*out)


#: The same tables in DuckDB SQL, by name; each may use the ones before it.
CTES = {
    "raw": f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS event_time, CASE WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type,
  (props->>'k')::BIGINT AS product_id, p_size::BIGINT AS category_id, replace(p_name, ' ', '.') AS category_code, CASE WHEN event_id % 7 <> 0 THEN p_brand END AS brand,
  value AS price, user_id, user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS user_session,
  CASE WHEN ts >= TIMESTAMP '{EVOLUTION_DATE}' THEN {list(DISCOUNTS)}[event_id % 5 + 1] END AS discount_percent, TIMESTAMP '{AS_OF}' AS ingestion_time
  FROM (SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM events) e LEFT JOIN part ON p_partkey = (props->>'k')::BIGINT""",
    "deduped": """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_time, product_id, event_type
  ORDER BY price DESC NULLS LAST, brand NULLS LAST, category_code NULLS LAST, user_session NULLS LAST, discount_percent NULLS LAST) AS rn FROM raw) WHERE rn = 1""",
    "silver": """SELECT event_time, event_type, product_id, category_id, coalesce(category_code, 'unknown.unknown') AS category_code, coalesce(brand, 'unknown') AS brand, price,
  user_id, user_session, coalesce(discount_percent, 0) AS discount_percent, ingestion_time, strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') AS event_timestamp,
  strptime(event_time, '%Y-%m-%d %H:%M:%S UTC')::DATE AS date, split_part(coalesce(category_code, 'unknown.unknown'), '.', 1) AS category_level1 FROM deduped""",
    "versions": """SELECT *, row_number() OVER (PARTITION BY product_id, valid_from_ts ORDER BY price DESC NULLS LAST, discount_percent NULLS LAST, brand NULLS LAST, category_id NULLS LAST, category_level1 NULLS LAST) AS rn
  FROM (SELECT product_id, category_id, category_level1, brand, price, discount_percent, min(event_timestamp) AS valid_from_ts FROM silver GROUP BY ALL)""",
    "dim_product": """SELECT md5(concat_ws('_', product_id, strftime(valid_from_ts, '%Y-%m-%d %H:%M:%S'))) AS product_sk, product_id, category_id, category_level1, brand, price, discount_percent, valid_from_ts,
  lead(valid_from_ts) OVER w AS valid_to_ts, lead(valid_from_ts) OVER w IS NULL AS is_current FROM versions WHERE rn = 1 WINDOW w AS (PARTITION BY product_id ORDER BY valid_from_ts)""",
    "fact": """SELECT md5(concat_ws('_', coalesce(s.user_id::VARCHAR, '~'), s.event_time, coalesce(s.product_id::VARCHAR, '~'), coalesce(s.event_type, '~'), coalesce(s.user_session, '~'))) AS event_id,
  s.event_timestamp, s.event_time, s.date, s.user_id, p.product_sk, s.category_level1, s.brand, s.price, s.discount_percent, s.event_type, s.user_session
  FROM silver s LEFT JOIN dim_product p ON s.product_id = p.product_id AND s.event_timestamp >= p.valid_from_ts AND (s.event_timestamp < p.valid_to_ts OR p.valid_to_ts IS NULL)""",
    "features_30d": """SELECT user_id, count(*) FILTER (event_type = 'view') AS f_views_30d, count(*) FILTER (event_type = 'cart') AS f_carts_30d, count(*) FILTER (event_type = 'purchase') AS f_purchases_30d,
  coalesce(sum(price::DECIMAL(18,2)) FILTER (event_type = 'purchase'), 0)::DOUBLE AS f_spend_30d, count(DISTINCT category_id) AS f_distinct_categories_30d, TIMESTAMP '2024-01-30' AS event_timestamp,
  TIMESTAMP '2024-02-01' AS created, DATE '2024-01-30' AS date FROM silver WHERE date >= DATE '2023-12-31' AND date < DATE '2024-01-30' GROUP BY user_id""",
    "hops": """SELECT user_id, price, event_type, w_end FROM (SELECT *, unnest(range(1, 16)) AS k FROM silver) q, LATERAL (SELECT date_trunc('minute', event_timestamp) + to_minutes(k) AS w_end) z""",
    "features_15m": """SELECT user_id, count(*) FILTER (event_type = 'view') AS f_views_15m, count(*) FILTER (event_type = 'cart') AS f_carts_15m, count(*) FILTER (event_type = 'purchase') AS f_purchases_15m,
  coalesce(sum(price::DECIMAL(18,2)) FILTER (event_type = 'purchase'), 0)::DOUBLE AS total_spend_15m, w_end AS event_timestamp, w_end AS created FROM hops GROUP BY user_id, w_end""",
    "horizon": """SELECT max(event_timestamp) - INTERVAL 1 HOUR AS cut, max(event_timestamp) AS last FROM silver WHERE date = DATE '2024-01-29'""",
    "candidates": """SELECT DISTINCT user_id, date_trunc('minute', event_timestamp) AS prediction_timestamp FROM silver, horizon
  WHERE date = DATE '2024-01-29' AND event_type IN ('view', 'cart') AND event_timestamp <= cut""",
    "labels_1h": """SELECT c.user_id, c.prediction_timestamp, max(CASE WHEN p.user_id IS NOT NULL THEN 1 ELSE 0 END) AS target_purchase_1h, DATE '2024-01-29' AS date
  FROM candidates c LEFT JOIN (SELECT * FROM silver WHERE event_type = 'purchase') p ON p.user_id = c.user_id AND p.event_timestamp >= c.prediction_timestamp AND p.event_timestamp < c.prediction_timestamp + INTERVAL 1 HOUR GROUP BY 1, 2""",
}


def sql(body: str, upto: str = "silver") -> str:
    """A check's SQL: `body` after the tables up to and including `upto`. $T(x) writes a time, $D(x) a date as text."""
    names = list(CTES)
    text = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names[: names.index(upto) + 1]) + "\n" + body
    for mark, pattern in (("$T(", "%Y-%m-%d %H:%M:%S"), ("$D(", "%Y-%m-%d")):
        while (at := text.find(mark)) >= 0:
            end, depth = at + len(mark), 1
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = f"{text[:at]}strftime({text[at + len(mark) : end - 1]}, '{pattern}'){text[end:]}"
    return text
