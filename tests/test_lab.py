import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.plans import lab

from . import test_queries

pytestmark = test_queries.pytestmark
tables = test_queries.tables


def named(spark, monkeypatch, folder, master="local-cluster[3,2,3000]"):
    """The session as on a cluster whose spark.checkpoint.dir is given in some form."""
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *more: folder if key == "spark.checkpoint.dir" else get(self, key, *more))
    monkeypatch.setattr(spark.sparkContext, "master", master)
    return spark


@pytest.mark.parametrize("form", ["{}", "{}/", "file:{}", "file://{}"])
@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "local[4]"])
def test_shared_folder_in_any_form(spark, monkeypatch, tmp_path, form, master):
    """spark-defaults.conf may name it by a plain path, which is on the default file system."""
    shared = tmp_path / "shared by all%20"
    made = lab.Lab(named(spark, monkeypatch, form.format(shared), master), test_queries.TABLES)
    assert made.folder.parent == shared


def test_other_stores_are_refused_on_a_cluster(spark, monkeypatch, tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lab.Lab(named(spark, monkeypatch, "viewfs://store/shared"), test_queries.TABLES)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://store/")
    try:
        assert lab.local_path(spark, str(tmp_path)) is None
    finally:
        hadoop.set("fs.defaultFS", before)


def test_a_folder_set_later_or_none(spark, monkeypatch, tmp_path):
    named(spark, monkeypatch, None)
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: f"file:{tmp_path}/later")
    assert lab.Lab(spark, test_queries.TABLES).folder.parent == tmp_path / "later"
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lab.Lab(spark, test_queries.TABLES)


@pytest.mark.parametrize("name", [
    "abandoned_batch",
    "cas_conflict",
    "clean_preserves_data",
    "definition_rollback",
    "clean_preview_count",
    "column_values",
    "definition_switch",
    "drop_dataset",
    "hive_prune",
    "format_gate",
    "list_datasets",
    "hive_scan",
    "inventory_delta",
    "metadata_only",
    "mixed_change",
    "orders_by_year",
    "noop_publish",
    "overlap_rejections",
    "path_rejections",
    "preflight_rejections",
    "prune_absent",
    "prune_directory",
    "prune_file",
    "publish_after_prune_rollback",
])
def test_on_a_cluster(spark, tables, monkeypatch, tmp_path, name):
    """With a plain path as spark.checkpoint.dir, as the machines' spark-defaults.conf has it."""
    test_queries.test_query_equals_sql(named(spark, monkeypatch, str(tmp_path)), tables, name)


@pytest.mark.parametrize(("name", "times"), [("definition_switch", 2), ("definition_rollback", 1)])
def test_events_without_a_user_count_in_the_total_alone(spark, tmp_path, name, times):
    """As SQL's count(DISTINCT user_id) has it."""
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), user, "view", 1.5, None) for i, user in enumerate([7, 7, None, 8, None])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.n, r.total) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()] == [(2, 7.5 * times)]


def test_cents_are_not_lost_in_a_large_total(spark, tmp_path):
    prices = F.when(F.col("id") == 0, 4e13).otherwise(0.01).alias("o_totalprice")
    orders = spark.range(0, 10_001, numPartitions=1).select(F.col("id").alias("o_orderkey"), prices, F.lit("1999-05-01").cast("timestamp").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert [(r.n, r.total) for r in plans.QUERIES["orders_by_year"](spark, str(tmp_path)).collect()] == [(10_001, 4e13 + 100)]


@pytest.mark.parametrize(("values", "total"), [([1.25, None, -0.5], 0.75), ([None], None), ([1.0, float("inf")], "inf"), ([1.0, float("nan")], "nan")])
def test_totals_of_odd_prices(spark, tmp_path, values, total):
    rows = [(datetime.datetime(1999, 5, 1), v) for v in values]
    spark.createDataFrame(rows, "o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    found = plans.QUERIES["orders_by_year"](spark, str(tmp_path)).first()["total"]
    assert (str(found) if isinstance(total, str) else found) == total
