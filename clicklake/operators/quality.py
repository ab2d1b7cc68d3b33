"""Data contracts: each check is a one-row frame (check, table, passed, observed, expected, detail)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import KEYS, schema


def _row(df: DataFrame, check: str, table: str, observed: Column, expected: float = 0.0, passed: Callable[[Column], Column] | None = None, detail: Column | None = None) -> DataFrame:
    o = F.coalesce(observed.cast("double"), F.lit(0.0))
    ok = passed(o) if passed else o == expected
    return df.agg(F.lit(check).alias("check"), F.lit(table).alias("table"), ok.alias("passed"), o.alias("observed"), F.lit(float(expected)).alias("expected"), (detail if detail is not None else F.lit("")).alias("detail"))


def _fixed(df: DataFrame, check: str, table: str, passed: bool, observed: float, expected: float, detail: str = "") -> DataFrame:
    """A result that the schema decides. Still computed from the frame, so an unreadable table fails."""
    return df.limit(0).agg(F.lit(check).alias("check"), F.lit(table).alias("table"), F.lit(passed).alias("passed"), F.lit(float(observed)).alias("observed"), F.lit(float(expected)).alias("expected"), F.lit(detail).alias("detail"))


def _missing(df: DataFrame, check: str, table: str, columns: list[str]) -> DataFrame | None:
    gone = [c for c in columns if c not in df.columns]
    return _fixed(df, check, table, False, len(gone), 0, "missing columns: " + ", ".join(gone)) if gone else None


def union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def check_bronze(df: DataFrame) -> DataFrame:
    """Rows, exactly 11 columns, no null user."""
    return union([
        _row(df, "bronze_rows", "raw_events", F.count("*"), 1, lambda o: o >= 1),
        _fixed(df, "bronze_columns", "raw_events", len(df.columns) == 11, len(df.columns), 11),
        contract_bronze_nulls(df),
    ])


def check_gold(silver: DataFrame, fact: DataFrame) -> DataFrame:
    """Staged and fact tables have rows, equally many; every fact has a product version; the fact has no product_id."""
    counts = silver.agg(F.count("*").alias("silver")).join(fact.agg(F.count("*").alias("fact"), F.count_if(F.col("product_sk").isNull()).alias("null_sk")))
    return union([
        _row(counts, "silver_rows", "stg_events", F.sum("silver"), 1, lambda o: o >= 1),
        _row(counts, "fact_rows", "fact_user_events", F.sum("fact"), 1, lambda o: o >= 1),
        _row(counts, "fact_equals_silver", "fact_user_events", F.sum(F.col("fact") - F.col("silver"))),
        _row(counts, "fact_null_product_sk", "fact_user_events", F.sum("null_sk")),
        _fixed(fact, "fact_without_product_id", "fact_user_events", "product_id" not in fact.columns, int("product_id" in fact.columns), 0),
    ])


def check_features(df: DataFrame, table: str = "feat_user_30d") -> DataFrame:
    """Time columns are there and there are rows."""
    times = ["event_timestamp", "created"]
    have = _missing(df, "feature_columns", table, times)
    return union([have if have is not None else _fixed(df, "feature_columns", table, True, 0, 0), _row(df, "feature_rows", table, F.count("*"), 1, lambda o: o >= 1)])


def check_labels(df: DataFrame, label: str = "target_purchase_1h") -> DataFrame:
    """There are rows, and labels are 0 or 1; a null label fails too."""
    return union([_row(df, "label_rows", "user_labels", F.count("*"), 1, lambda o: o >= 1), contract_binary_labels(df, label)])


def contract_bronze_nulls(df: DataFrame) -> DataFrame:
    bad = _missing(df, "bronze_null_users", "raw_events", ["user_id"])
    return bad if bad is not None else _row(df, "bronze_null_users", "raw_events", F.count_if(F.col("user_id").isNull()))


def contract_silver_duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or KEYS["stg_events"]
    bad = _missing(df, "silver_duplicates", "stg_events", keys)
    if bad is not None:
        return bad
    return _row(df.groupBy(*keys).agg(F.count("*").alias("n")), "silver_duplicates", "stg_events", F.sum(F.col("n") - 1))


def contract_scd2(df: DataFrame) -> DataFrame:
    """Null keys, inverted intervals, products with more than one current version, overlaps and gaps between versions."""
    need = ["product_sk", "product_id", "valid_from_ts", "valid_to_ts", "is_current"]
    bad = _missing(df, "scd2", "dim_product", need)
    if bad is not None:
        return bad
    w = Window.partitionBy("product_id").orderBy("valid_from_ts", F.asc_nulls_last("valid_to_ts"))
    rows = df.select(*need, F.lead("valid_from_ts").over(w).alias("_next"))
    current = df.groupBy("product_id").agg(F.count_if("is_current").alias("n"))
    return union([
        _row(rows, "scd2_null_key", "dim_product", F.count_if(F.col("product_sk").isNull())),
        _row(rows, "scd2_inverted", "dim_product", F.count_if(F.col("valid_to_ts") <= F.col("valid_from_ts"))),
        _row(current, "scd2_many_current", "dim_product", F.count_if(F.col("n") > 1)),
        _row(rows, "scd2_overlap", "dim_product", F.count_if(F.col("_next").isNotNull() & (F.col("valid_to_ts").isNull() | (F.col("valid_to_ts") > F.col("_next"))))),
        _row(rows, "scd2_gap", "dim_product", F.count_if(F.col("_next").isNotNull() & (F.col("valid_to_ts") < F.col("_next")))),
    ])


def contract_feature_timestamps(df: DataFrame, table: str = "feat_user_15m") -> DataFrame:
    bad = _missing(df, "feature_timestamps", table, ["event_timestamp", "created"])
    return bad if bad is not None else _row(df, "feature_timestamps", table, F.count_if(F.col("event_timestamp").isNull() | F.col("created").isNull()))


def contract_binary_labels(df: DataFrame, label: str = "target_purchase_1h") -> DataFrame:
    bad = _missing(df, "binary_labels", "user_labels", [label])
    return bad if bad is not None else _row(df, "binary_labels", "user_labels", F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)))


def contract_suite(tables: dict[str, DataFrame]) -> DataFrame:
    """All contracts over whole tables in one job; one that cannot be planned or fails as it runs is a failed row with the error.

    Only if the job fails are the contracts run again one by one, to tell which of them did. Of each a few rows are collected.
    """
    plan = {"raw_events": contract_bronze_nulls, "stg_events": contract_silver_duplicates, "dim_product": contract_scd2, "feat_user_15m": contract_feature_timestamps, "user_labels": contract_binary_labels}
    results, rows = schema("contract_results"), []
    error = lambda name, e: (plan[name].__name__, name, False, 1.0, 0.0, str(e)[:200])
    planned: dict[str, DataFrame] = {}
    for name in plan:
        if name in tables:
            try:
                planned[name] = plan[name](tables[name])
            except Exception as e:  # noqa: BLE001  any failure of a contract is its result
                rows.append(error(name, e))
    try:
        rows += union(list(planned.values())).collect() if planned else []
    except Exception:  # noqa: BLE001
        for name, contract in planned.items():
            try:
                rows += contract.collect()
            except Exception as e:  # noqa: BLE001
                rows.append(error(name, e))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, results)


def catalog_conformance(df: DataFrame, table: str) -> DataFrame:
    """Declared columns and types against the frame's; primary keys not null and unique."""
    want, have = {f.name: f.dataType for f in schema(table)}, {f.name: f.dataType for f in df.schema}
    wrong = [n for n, t in want.items() if n not in have or have[n] != t] + [n for n in have if n not in want]
    keys = [k for k in KEYS.get(table, []) if k in have]
    rows = [_fixed(df, "catalog_columns", table, not wrong, len(wrong), 0, ", ".join(wrong))]
    if keys:
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
        rows += [_row(groups, "catalog_key_null", table, F.sum(F.when(null, F.col("n")))), _row(groups, "catalog_key_repeated", table, F.count_if(F.col("n") > 1))]
    return union(rows)


def table_summary(tables: dict[str, DataFrame], partition: str = "date") -> DataFrame:
    """Rows, columns and distinct partitions by table."""
    return union([df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), (F.count_distinct(partition) if partition in df.columns else F.lit(0).cast("bigint")).alias("partitions")) for name, df in tables.items()])


class GateError(RuntimeError):
    """A contract of the layer before failed."""


def gate(results: DataFrame) -> None:
    """Raise, with the failed checks, before the next layer is written."""
    failed = [f"{r['table']}.{r['check']}: {r['observed']} (expected {r['expected']}) {r['detail']}" for r in results.filter("not passed").collect()]
    if failed:
        raise GateError("; ".join(failed))


def reconcile_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Counts of both tables, and whether the sums of their rows' hashes agree: equal contents in any order."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{name}_rows"), F.coalesce(F.sum(F.xxhash64(*sorted(source.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"_{name}"))

    both = digest(source, "source").join(digest(copy, "copy"))
    return both.select("source_rows", "copy_rows", ((F.col("_source") == F.col("_copy")) & (F.col("source_rows") == F.col("copy_rows"))).alias("equal"))


