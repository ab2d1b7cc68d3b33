"""The canonical tables as explicit types; readers never infer."""

from __future__ import annotations

from pyspark.sql.types import StructType

_CORE = "event_time string, event_type string, product_id bigint, category_id bigint, category_code string, brand string, price double, user_id bigint, user_session string"

#: Columns of the two generations of event files, in file order.
OLD_COLUMNS = [c.split()[0] for c in _CORE.split(", ")]
NEW_COLUMNS = [*OLD_COLUMNS, "discount_percent"]

DDL = {
    "raw_events": f"{_CORE}, discount_percent int, ingestion_time timestamp",
    "stg_events": f"{_CORE}, discount_percent int, ingestion_time timestamp, event_timestamp timestamp, date date, category_level1 string",
    "dim_product": "product_sk string, product_id bigint, category_id bigint, category_level1 string, brand string, price double, discount_percent int, valid_from_ts timestamp, valid_to_ts timestamp, is_current boolean",
    "dim_user": "user_id bigint, first_seen timestamp, last_seen timestamp, total_lifetime_events bigint, is_active boolean, valid_from_ts timestamp, valid_to_ts timestamp, is_current boolean",
    "fact_user_events": "event_id string, event_timestamp timestamp, event_time string, date date, user_id bigint, product_sk string, category_level1 string, brand string, price double, discount_percent int, event_type string, user_session string",
    "feat_user_30d": "user_id bigint, f_views_30d bigint, f_carts_30d bigint, f_purchases_30d bigint, f_spend_30d double, f_distinct_categories_30d bigint, event_timestamp timestamp, created timestamp, date date",
    "feat_user_15m": "user_id bigint, f_views_15m bigint, f_carts_15m bigint, f_purchases_15m bigint, total_spend_15m double, event_timestamp timestamp, created timestamp",
    "user_labels": "user_id bigint, prediction_timestamp timestamp, target_purchase_1h int, date date",
    "prediction_log": "prediction_id string, user_id bigint, prediction_timestamp timestamp, f_views_15m bigint, f_carts_15m bigint, f_purchases_15m bigint, total_spend_15m double, feature_timestamp timestamp, score double, model_version string",
    "prediction_labels": "prediction_id string, label_window_start timestamp, label_window_end timestamp, target_purchase_1h int, label_status string, label_matured_timestamp timestamp",
    "contract_results": "check string, table string, passed boolean, observed double, expected double, detail string",
}

#: Keys that identify a row; the staged table's is the deduplication key.
KEYS = {
    "stg_events": ["user_id", "event_time", "product_id", "event_type"],
    "dim_product": ["product_sk"],
    "dim_user": ["user_id"],
    "feat_user_30d": ["user_id", "event_timestamp"],
    "feat_user_15m": ["user_id", "event_timestamp"],
    "user_labels": ["user_id", "prediction_timestamp"],
}


#: What the warehouse's tables declare beyond DDL, types of amounts and columns that are never null.
WAREHOUSE_TYPES = {"price": "decimal(10,2)", "discount_percent": "decimal(5,2)", "f_spend_30d": "decimal(12,2)"}
REQUIRED = {
    "raw_events": [],
    "stg_events": ["event_timestamp", "date", "event_type", "product_id", "user_id"],
    "dim_product": ["product_sk", "product_id", "valid_from_ts", "is_current"],
    "dim_user": ["user_id"],
    "fact_user_events": ["event_id", "event_timestamp", "date", "user_id", "product_sk", "event_type"],
    "feat_user_30d": ["user_id", "event_timestamp", "date"],
    "user_labels": ["user_id", "prediction_timestamp", "target_purchase_1h", "date"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def text_schema(columns: list[str]) -> StructType:
    """All columns as text, as event files are read before anything is cast."""
    return StructType.fromDDL(", ".join(f"{c} string" for c in columns))
