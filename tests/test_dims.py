"""The product dimension kept by merges equals one build over all events, and untouched buckets keep their files."""

import random

import pytest
from pyspark.sql import functions as F

from clicklake.operators import dims, model
from clicklake.storage import names, shared_folder

SCHEMA = "product_id long, category_id long, category_level1 string, brand string, price double, discount_percent int, event_timestamp timestamp"


def events(spark, rows):
    return spark.createDataFrame([(p, None, None, b, price, None, t) for p, b, price, t in rows], SCHEMA.replace("event_timestamp timestamp", "t long")).withColumn("event_timestamp", F.timestamp_seconds("t")).drop("t")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def files(spark, path):
    return {r["f"] for r in spark.read.parquet(f"{path}/rows").select(F.input_file_name().alias("f")).distinct().collect()}


def test_merges_in_any_order_equal_one_build(spark):
    draw = random.Random(3)
    rows = [(draw.choice([*range(12), None]), draw.choice(["a", "b", None]), draw.choice([1.0, 2.0, None]), draw.randrange(40)) for _ in range(400)]
    draw.shuffle(rows)
    path = shared_folder(spark, "dim")
    for k in range(0, 400, 80):
        dims.merge_products(spark, path, events(spark, rows[max(0, k - 20) : k + 80]), 4)
        assert same(dims.merged_products(spark, path), model.dim_product_scd2(events(spark, rows[: k + 80])))


def test_only_touched_buckets_are_written(spark):
    path = shared_folder(spark, "dim")
    rows = [(p, "a", 1.0, 10) for p in range(40)]
    assert len(dims.merge_products(spark, path, events(spark, rows), 8)) == 8
    before = files(spark, path)
    assert dims.merge_products(spark, path, events(spark, [(p, "a", 1.0, 50) for p in range(40)]), 8) == []  # nothing new
    assert files(spark, path) == before
    touched = dims.merge_products(spark, path, events(spark, [(3, "b", 1.0, 60), (4, "a", 1.0, 70)]), 8)
    assert len(touched) == 1
    wrote = files(spark, path) - before
    assert wrote and all(f"/bucket={touched[0]}/" in f for f in wrote)
    assert dims.merge_products(spark, path, events(spark, []), 8) == []


def test_loser_of_an_instant_is_no_version_when_seen_again(spark):
    path = shared_folder(spark, "dim")
    first, again = [(1, "a", 1.0, 10), (1, "b", 2.0, 10)], [(1, "a", 1.0, 20)]
    dims.merge_products(spark, path, events(spark, first), 2)
    dims.merge_products(spark, path, events(spark, again), 2)
    assert [r["brand"] for r in dims.merged_products(spark, path).collect()] == ["b"]
    assert same(dims.merged_products(spark, path), model.dim_product_scd2(events(spark, first + again)))


def test_merge_that_dies_leaves_the_old_dimension(spark, monkeypatch):
    path = shared_folder(spark, "dim")
    with pytest.raises(FileNotFoundError):
        dims.merged_products(spark, path)
    dims.merge_products(spark, path, events(spark, [(1, "a", 1.0, 10)]), 2)
    old = dims.merged_products(spark, path)

    def dies(*_):
        raise RuntimeError("lost after its rows were written")

    with monkeypatch.context() as m:
        m.setattr(dims, "publish", dies)
        with pytest.raises(RuntimeError):
            dims.merge_products(spark, path, events(spark, [(1, "b", 1.0, 20)]), 2)
    assert [r["brand"] for r in dims.merged_products(spark, path).collect()] == ["a"]
    for k in range(4):  # what the dead merge and older ones left goes; the dimension before the last can still be read
        dims.merge_products(spark, path, events(spark, [(1, f"c{k}", 1.0, 30 + k)]), 2)
        assert old.count() == 1 if k == 0 else True
    assert len(dims.merged_products(spark, path).collect()) == 5 and len(names(spark, f"{path}/rows")) == 2
