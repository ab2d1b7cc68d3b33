"""Hand-computed frames for the boundaries: windows, ties, versions, as-of joins, labels, contracts, parsing."""

import pytest
from clicklake.functions.columns import event_timestamp, key_hash
from clicklake.operators import events, features, labels, model, online, quality, shape, skew, training
from clicklake.sources.files import bootstrap_once, parse_event_lines, schema_drift_report
from clicklake.storage import shared_folder
from pyspark.sql import functions as F

T = "timestamp'2024-01-10 {}'"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, values, names):
    return spark.sql(f"select * from values {values} as t({names})")


def test_dedup_keeps_a_fixed_row(spark):
    df = frame(spark, "(1L,'a',1L,'view',2.0D,'x'),(1L,'a',1L,'view',3.0D,'y'),(1L,'a',1L,'view',3.0D,'b'),(1L,'a',2L,'view',1.0D,'z')", "user_id,event_time,product_id,event_type,price,brand")
    for n in (1, 4, 16):
        assert rows(events.dedup_events(df.repartition(n)).select("product_id", "price", "brand")) == [(1, 3.0, "b"), (2, 1.0, "z")]


def test_versions_forget_or_keep_returns(spark):
    df = frame(spark, ",".join(f"(1L,1L,'c','b',{p}D,0,{T.format(t)})" for p, t in ((1.0, "10:00:00"), (2.0, "11:00:00"), (1.0, "12:00:00"))), "product_id,category_id,category_level1,brand,price,discount_percent,event_timestamp")
    assert [r["price"] for r in model.dim_product_scd2(df).orderBy("valid_from_ts").collect()] == [1.0, 2.0]
    kept = model.dim_product_scd2_changes(df).orderBy("valid_from_ts").collect()
    assert [(r["price"], r["is_current"]) for r in kept] == [(1.0, False), (2.0, False), (1.0, True)]
    quality.gate(quality.contract_scd2(model.dim_product_scd2_changes(df)))


def test_same_instant_versions_take_the_highest_price(spark):
    df = frame(spark, ",".join(f"(1L,1L,'c','{b}',{p}D,0,{T.format('10:00:00')})" for p, b in ((1.0, "a"), (2.0, "z"), (2.0, "b"))), "product_id,category_id,category_level1,brand,price,discount_percent,event_timestamp")
    assert rows(model.dim_product_scd2(df).select("price", "brand")) == [(2.0, "b")]


def test_scd2_joins_agree_at_edges(spark):
    dim = frame(spark, f"('k1',1L,{T.format('10:00:00')},{T.format('11:00:00')}),('k2',1L,{T.format('11:00:00')},null)", "product_sk,product_id,valid_from_ts,valid_to_ts")
    ev = frame(spark, ",".join(f"({p},{T.format(t)})" for p, t in (("1L", "09:59:59"), ("1L", "10:00:00"), ("1L", "10:59:59"), ("1L", "11:00:00"), ("2L", "11:00:00"), ("null", "11:00:00"))), "product_id,event_timestamp")
    a = model.scd2_range_join(ev, dim, ["product_sk"]).select(F.date_format("event_timestamp", "HH:mm:ss"), F.coalesce("product_id", F.lit(-1)), F.coalesce("product_sk", F.lit("-")))
    b = model.scd2_asof_join(ev, dim, ["product_sk"]).select(F.date_format("event_timestamp", "HH:mm:ss"), F.coalesce("product_id", F.lit(-1)), F.coalesce("product_sk", F.lit("-")))
    assert rows(a) == rows(b) == [("09:59:59", 1, "-"), ("10:00:00", 1, "k1"), ("10:59:59", 1, "k1"), ("11:00:00", -1, "-"), ("11:00:00", 1, "k2"), ("11:00:00", 2, "-")]


def test_feature_window_is_half_open(spark):
    ev = frame(spark, ",".join(f"(1L,'purchase',1.5D,timestamp'{t}')" for t in ("2024-01-10 09:45:00", "2024-01-10 09:59:59.999999", "2024-01-10 10:00:00", "2024-01-10 09:44:59.999999")), "user_id,event_type,price,event_timestamp")
    probe = frame(spark, f"(1L,{T.format('10:00:00')}),(2L,{T.format('10:00:00')})", "user_id,t")
    assert rows(features.user_features_15m_at(ev, probe).select("user_id", "f_purchases_15m", "total_spend_15m")) == [(1, 2, 3.0), (2, 0, 0.0)]
    window = features.hopping_features(ev).filter(F.col("event_timestamp") == F.expr(T.format("10:00:00")))
    assert rows(window.select("f_purchases_15m")) == [(2,)]


def test_label_hour_and_censoring(spark):
    times = {"view": ["10:00:30", "20:00:00", "20:00:01"], "purchase": ["10:00:00", "11:00:00"], "error": ["21:00:00"]}
    ev = frame(spark, ",".join(f"(1L,'{k}',{T.format(t)},date'2024-01-10')" for k, ts in times.items() for t in ts), "user_id,event_type,event_timestamp,date")
    out = labels.user_labels(ev, "2024-01-10").select(F.date_format("prediction_timestamp", "HH:mm"), "target_purchase_1h")
    assert rows(out) == [("10:00", 1), ("20:00", 0)]  # 20:00:01 is less than an hour before the day's last event
    late = labels.user_labels(ev, "2024-01-10", next_minute=True).select(F.date_format("prediction_timestamp", "HH:mm"), "target_purchase_1h")
    assert rows(late) == [("10:01", 1), ("20:01", 0)]


def test_pit_join_ttl_and_ties(spark):
    f = frame(spark, ",".join(f"(1L,{T.format(t)},{T.format(c)},{v})" for t, c, v in (("08:00:00", "08:00:00", 1), ("10:00:00", "10:00:01", 2), ("10:00:00", "10:00:02", 3))), "user_id,event_timestamp,created,x")
    view = training.FeatureView("v", f, ("x",), "2 hours")
    probe = frame(spark, ",".join(f"({u}L,{T.format(t)})" for u, t in ((1, "07:59:59"), (1, "09:59:59"), (1, "10:00:00"), (1, "12:00:00"), (1, "12:00:01"), (2, "10:00:00"))), "user_id,at")
    out = {(r["user_id"], r["t"]): r["x"] for r in training.pit_join(probe, view, "at").withColumn("t", F.date_format("at", "HH:mm:ss")).collect()}
    assert out == {(1, "07:59:59"): None, (1, "09:59:59"): 1, (1, "10:00:00"): 3, (1, "12:00:00"): 3, (1, "12:00:01"): None, (2, "10:00:00"): None}
    honest = training.pit_join(probe, view, "at", honour_created=True).withColumn("t", F.date_format("at", "HH:mm:ss"))
    assert {r["t"]: r["x"] for r in honest.filter("user_id = 1").collect()}["10:00:00"] == 1
    with pytest.raises(ValueError):
        training.FeatureView("v", f, ("y",), "2 hours")


def test_prediction_labels_mature(spark):
    p = frame(spark, f"('a',1L,{T.format('10:00:00')}),('b',1L,{T.format('12:00:00')})", "prediction_id,user_id,prediction_timestamp")
    ev = frame(spark, f"(1L,'purchase',{T.format('10:59:59')}),(1L,'purchase',{T.format('12:30:00')})", "user_id,event_type,event_timestamp")
    out = labels.prediction_labels(p, ev, "2024-01-10 12:00:00").select("prediction_id", "target_purchase_1h", "label_status")
    assert sorted(map(tuple, out.collect())) == [("a", 1, "matured"), ("b", None, "pending")]


def test_newest_wins_in_any_order(spark):
    one = frame(spark, f"(1L,{T.format('10:00:00')},{T.format('10:00:00')},1)", "user_id,event_timestamp,created,x")
    two = frame(spark, f"(1L,{T.format('10:00:00')},{T.format('10:00:05')},2),(2L,{T.format('09:00:00')},{T.format('09:00:00')},5)", "user_id,event_timestamp,created,x")
    want = [(1, 2), (2, 5)]
    for a, b in ((one, two), (two, one)):
        assert rows(online.upsert(online.upsert(online.newest(a), b), b).select("user_id", "x")) == want


@pytest.mark.parametrize("values,passed", [("(1L),(2L),(3L)", True), ("(1L),(null)", False)])
def test_contract_bronze(spark, values, passed):
    assert quality.contract_bronze_nulls(frame(spark, values, "user_id")).first()["passed"] is passed


def test_contracts_on_bad_frames(spark):
    inverted = frame(spark, f"('k',1L,{T.format('11:00:00')},{T.format('10:00:00')},false)", "product_sk,product_id,valid_from_ts,valid_to_ts,is_current")
    two = frame(spark, f"('k',1L,{T.format('10:00:00')},null,true),('l',1L,{T.format('11:00:00')},null,true)", "product_sk,product_id,valid_from_ts,valid_to_ts,is_current")
    failed = lambda df: {r["check"] for r in df.filter("not passed").collect()}
    assert failed(quality.contract_scd2(inverted)) == {"scd2_inverted"}
    assert failed(quality.contract_scd2(two)) == {"scd2_many_current", "scd2_overlap"}
    assert not quality.contract_binary_labels(frame(spark, "(0),(2),(-1),(null)", "target_purchase_1h")).first()["passed"]
    dummy = frame(spark, "(1)", "dummy")
    suite = quality.contract_suite(dict.fromkeys(("raw_events", "stg_events", "dim_product", "feat_user_15m", "user_labels"), dummy))
    assert [r["passed"] for r in suite.collect()] == [False] * 5
    with pytest.raises(quality.GateError):
        quality.gate(suite)


def test_event_lines(spark):
    good = "2019-10-26 10:00:00 UTC,view,1004856,2053013555631882655,electronics.smartphone,samsung,130.50,51234567,s"
    lines = [good, "a,b", good.replace("1004856", "x"), good.replace("130.50", ""), good.replace("51234567", ""), good.replace("samsung", '"a,b"')]
    out = parse_event_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["reject_reason"] for r in out] == [None, "short line", "bad product_id", None, None, None]
    assert (out[3]["price"], out[4]["user_id"], out[5]["brand"], out[0]["price"]) == (0.0, None, "a,b", 130.5)


def test_bad_casts_are_null(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00 UTC",), ("x",), (None,)], "t string").select(event_timestamp("t").isNull())
    assert rows(df) == [(False,), (True,), (True,)]


def test_event_id_differs_by_type_and_null(spark):
    df = frame(spark, "(1L,'view'),(1L,'cart'),(null,'view')", "user_id,event_type").select(key_hash("user_id", "event_type").alias("h"))
    assert df.distinct().count() == 3


def test_shaping_does_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id % 20 as user_id", "'2024-01-01 10:00:00 UTC' as event_time", "id as product_id", "'view' as event_type", "cast(id as double) as price", "'s' as user_session")
    build = lambda d: shape.inject_hot_keys(shape.jitter_prices(shape.remap_users(shape.replicate_time_shift(d, 2))), 0.35, [7, 8, 9])
    assert rows(build(df.repartition(1))) == rows(build(df.repartition(7)))
    moved = shape.remap_users(shape.replicate_time_shift(df, 2)).filter("replica = 1")
    assert moved.groupBy(F.col("user_id") % 1_000_000_000).agg(F.count_distinct("user_id").alias("n")).filter("n > 1").isEmpty()
    assert shape.jitter_prices(shape.replicate_time_shift(df, 2).withColumn("p0", F.col("price"))).filter("abs(price - p0) > 0.0501 * p0 + 0.01").isEmpty()


def test_salted_join_equals_plain(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 1, id) as user_id", "cast(id as double) as price", "id as n")
    hot = frame(spark, "(1L, 334L)", "user_id,n")
    dim = skew.user_tier_dim(df, hot)
    assert rows(skew.user_join_salted(df, dim, hot, 4, ["n"]).select("n", "tier")) == rows(skew.user_join(df, dim).select("n", "tier"))


def test_bootstrap_keeps_history(spark):
    path, one, two = shared_folder(spark, "b"), spark.range(3), spark.range(9)
    assert bootstrap_once(spark, one, path) and not bootstrap_once(spark, two, path)
    assert spark.read.parquet(path).count() == 3


def test_schema_drift(spark):
    assert rows(schema_drift_report(frame(spark, "(1,2)", "a,b"), frame(spark, "(1,2)", "b,c"))) == [("a", "only_first"), ("c", "only_second")]


def test_plans_have_no_python_and_prune_dates(spark):
    from clicklake.operators.layout import write_partitioned
    from clicklake.plans.queries import silver

    path = shared_folder(spark, "plan")
    write_partitioned(silver(spark, "/root/testdata/sf0.001"), path)
    plan = features.user_features_30d(spark.read.parquet(path), "2024-01-10", "2024-01-10")._jdf.queryExecution().toString()
    assert "Python" not in plan and "PartitionFilters: [isnotnull(date" in plan


def test_as_of_joins_of_hot_and_null_keys(spark):
    """A key with most rows over many days, and null keys: the same rows as pairing, in groups of a day."""
    f = spark.range(300).selectExpr("if(id % 3 = 0, id % 7, 1) as user_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id * 5 as int)) as event_timestamp", "cast(id as int) as x")
    f = f.withColumn("created", F.col("event_timestamp"))
    probe = spark.range(400).selectExpr("if(id % 5 = 0, null, if(id % 4 = 0, id % 9, 1)) as user_id", "timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, cast(id * 4 as int)) as at", "id as n")
    out = {r["n"]: r["x"] for r in training.pit_join(probe, training.FeatureView("v", f, ("x",), "3 days"), "at").collect()}
    assert len(out) == 400
    pairs = probe.join(f.withColumnRenamed("user_id", "u"), F.expr("user_id = u and event_timestamp <= at and event_timestamp >= at - interval 3 days"), "left")
    want = {r["n"]: r["x"] for r in pairs.groupBy("n").agg(F.max_by("x", "event_timestamp").alias("x")).collect()}
    assert out == want


def test_join_plans(spark):
    """J1 broadcasts a dimension of known size, J2 merges, J3 is left to adaptive execution with skew handling on."""
    ev = frame(spark, "('small.a',1L,2.0D),('large.b',2L,3.0D)", "category_code,user_id,price")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    dim = model.category_dim(ev)
    assert "BroadcastHashJoin" in plan(model.category_join(ev, dim, "broadcast"))
    assert "SortMergeJoin" in plan(model.category_join(ev, dim, "merge"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert "AdaptiveSparkPlan" in plan(skew.user_join(ev, frame(spark, "(1L,'VIP')", "user_id,tier"), "merge"))


def test_scans_read_what_is_asked(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:" in plan and "o_totalprice" not in plan


def test_push_target_stays_small_and_takes_batches_again(spark):
    from clicklake.storage import names

    target = online.PushTarget(spark, shared_folder(spark, "push"), "online", buckets=4)
    batch = lambda k: spark.range(k, k + 6).selectExpr("id as user_id", f"timestamp'2024-01-10 10:00:0{k}' as event_timestamp", f"timestamp'2024-01-10 10:00:0{k}' as created", f"{k} as x")
    want = {}
    for k in (0, 1, 2, 2, 3, 4, 4):
        target.push(batch(k), k)
        want |= {u: k for u in range(k, k + 6)}
        assert {r["user_id"]: r["x"] for r in target.online(k).collect()} == want
    kept = [b for v in names(spark, f"{target.folder}/online") for b in names(spark, f"{target.folder}/online/{v}") if b.startswith("bucket=")]
    assert all(kept.count(b) <= 2 for b in kept)


def test_materializer_saves_its_cursor(spark):
    f = spark.range(10).selectExpr("id % 3 as user_id", "timestamp'2024-01-10' + make_interval(0, 0, 0, cast(id as int)) as event_timestamp", "timestamp'2024-01-10' as created", "id as x")
    folder = shared_folder(spark, "cursor")
    for now, best in (("2024-01-12", {0: 0, 1: 1}), ("2024-01-15", {0: 3, 1: 4, 2: 2}), ("2024-01-15", {0: 3, 1: 4, 2: 2})):
        out = online.Materializer(spark, folder, "2024-01-01").run(f, now)
        assert {r["user_id"]: r["x"] for r in out.collect()} == best
    assert [c for _, c in online.Materializer(spark, folder, "2024-01-01").cursors()] == ["2024-01-12", "2024-01-15", "2024-01-15"]


def test_running_state_equals_pairing():
    import random

    from clicklake.streaming.state import window_features

    draw, minute = random.Random(1), 60_000_000
    events_ = sorted(((draw.randrange(200) * minute // 4, draw.choice(["view", "cart", "purchase"]), draw.choice([1.25, None, 3.5])) for _ in range(300)), key=lambda e: e[0])
    state, got = ([], [], []), []
    for i in range(0, 300, 37):
        new = tuple(map(list, zip(*events_[i : i + 37])))
        got += window_features(state, new)
        state = tuple(a + b for a, b in zip(state, new))
    for i, (t, views, carts, bought, spend) in enumerate(got):
        upto = events_[: min(300, (i // 37 + 1) * 37)]
        seen = [e for e in upto if t - 15 * minute <= e[0] < t]
        assert (views, carts, bought) == tuple(sum(e[1] == k for e in seen) for k in ("view", "cart", "purchase"))
        assert spend == sum(round((e[2] or 0) * 100) for e in seen if e[1] == "purchase") / 100


def test_late_rows_are_dropped_and_counted(spark):
    from clicklake.sources import kafka
    from clicklake.streaming import features as stream

    folder, sink, check = (shared_folder(spark, n) for n in ("files", "sink", "check"))
    event = lambda t, u: (f'{{"event_time": "2024-01-10 {t} UTC", "event_type": "view", "user_id": {u}}}',)
    dropped = 0
    for part in ([event("10:00:00", 1), event("11:00:00", 2)], [event("10:30:00", 3), event("10:59:59", 4), event("11:10:00", 5)]):
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").text(folder)
        q = stream.run_to_end(stream.stream_dedup(stream.event_time_watermark(kafka.text_events_source(spark, folder), "2 seconds"), ["user_id"]), sink, check)
        dropped += stream.dropped_by_watermark(q)
    assert sorted(r["user_id"] for r in spark.read.parquet(sink).select("user_id").collect()) == [1, 2, 4, 5] and dropped == 1


def test_jobs_run_by_layer_and_stop_at_a_failed_gate(spark):
    from clicklake.plans import jobs
    from clicklake.sources.canonical import canonical_events

    root, raw = shared_folder(spark, "lake"), canonical_events(spark, "/root/testdata/sf0.001")
    with pytest.raises(quality.GateError):
        jobs.write_bronze(spark, raw.withColumn("user_id", F.lit(None).cast("bigint")), root)
    good = raw.filter("user_id is not null and event_type is not null")
    try:
        jobs.write_bronze(spark, good, root)
    except quality.GateError as e:
        pytest.fail(str(e))
    jobs.write_silver_and_gold(spark, root)
    jobs.write_features_and_labels(spark, root, "2024-01-29", "2024-02-01")
    assert all(not spark.read.parquet(p).isEmpty() for p in jobs.paths(root).values())


def test_times_with_fractions_and_offsets(spark):
    from clicklake.functions.columns import any_timestamp

    texts = ["2024-01-10T10:00:00Z", "2024-01-10 10:00:00 UTC", "2024-01-10T12:00:00+02:00", "2024-01-10 10:00:00.250000", "2024-01-10", "x", "2024", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(any_timestamp("t"), "yyyy-MM-dd HH:mm:ss.SSS").alias("t"))
    ten = "2024-01-10 10:00:00.000"
    assert [r["t"] for r in df.collect()] == [ten, ten, ten, "2024-01-10 10:00:00.250", "2024-01-10 00:00:00.000", None, None, None]


def test_short_lines_with_quoted_commas(spark):
    out = parse_event_lines(spark.createDataFrame([('2019-10-26 10:00:00 UTC,view,1,2,code,"a,b",1.5,7',), ('2019-10-26 10:00:00 UTC,view,1,2,code,"a,b",1.5,7,s',)], "value string")).collect()
    assert [r["reject_reason"] for r in out] == ["short line", None]


def test_console_sink_takes_a_stream(spark):
    from clicklake.streaming.sinks import console_sink

    folder = shared_folder(spark, "rows")
    spark.range(3).write.parquet(folder)
    q = console_sink(spark.readStream.schema("id long").parquet(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) == 3


def test_contract_suite_reports_errors_of_running_jobs(spark):
    broken = frame(spark, "(1L),(2L)", "id").select(F.raise_error(F.concat(F.lit("no such block "), F.col("id").cast("string"))).cast("bigint").alias("user_id"))
    out = quality.contract_suite({"raw_events": broken, "user_labels": frame(spark, "(0),(1)", "target_purchase_1h")}).collect()
    assert [(r["passed"], "no such block" in r["detail"]) for r in out] == [(False, True), (True, False)]
