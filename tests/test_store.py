"""Keyed checkpoints: reload by a later session, half-written folders, changed inputs and parameters."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shrinkfit.plans.experiment import Experiment
from shrinkfit.store import CheckpointStore


def _jobs(spark):
    """Ids of all jobs so far of this application."""
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.fixture
def store(spark, tmp_path):
    return CheckpointStore(spark, str(tmp_path / "store"))


def _input(spark, path, n):
    spark.range(n).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def test_step_is_computed_once(spark, store, tmp_path):
    path, calls = _input(spark, str(tmp_path / "in"), 10), []

    def build():
        calls.append(1)
        return spark.read.parquet(path).withColumn("x", F.col("id") * 2)

    first = store.step("double", build, inputs=[path], params={"by": 2})
    again = CheckpointStore(spark, store.root).step("double", build, inputs=[path], params={"by": 2})
    assert (len(calls), first.rows, again.rows, first.reloaded, again.reloaded) == (1, 10, 10, False, True)
    assert sorted(map(tuple, again.df.collect())) == [(i, 2 * i) for i in range(10)]
    assert again.df.schema == first.df.schema


def test_changed_input_parameter_or_earlier_step_computes_again(spark, store, tmp_path):
    path = _input(spark, str(tmp_path / "in"), 10)
    keys = {store.key("s", [path], {"p": 1}), store.key("s", [path], {"p": 2}), store.key("t", [path], {"p": 1}), store.key("s", [path], {"p": 1}, ["k"])}
    _input(spark, path, 11)
    keys.add(store.key("s", [path], {"p": 1}))
    assert len(keys) == 5
    with pytest.raises(FileNotFoundError):
        store.key("s", [str(tmp_path / "absent")])


def test_half_written_folder_is_ignored(spark, store, tmp_path):
    key = store.key("s")
    spark.range(3).write.parquet(os.path.join(store.root, "data", f"s-{key}-dead"))  # rows, but no marker
    assert store.load("s", key) is None
    found = store.step("s", lambda: spark.range(5).toDF("id"))
    assert found.rows == found.df.count() == 5
    assert store.sweep() == [f"s-{key}-dead"] and store.load("s", key).df.count() == 5


def test_first_marker_wins(spark, store):
    key = store.key("s")
    store.save(spark.range(4).toDF("id"), "s", key)
    late = store.save(spark.range(9).toDF("id"), "s", key)
    assert late.reloaded and late.rows == late.df.count() == 4
    assert len(store.sweep()) == 1


def test_marker_without_rows_is_not_loaded(spark, store):
    key = store.key("s")
    store.save(spark.range(4).toDF("id"), "s", key)
    with open(store.marker("s", key)) as f:
        data = os.path.join(store.root, json.load(f)["data"])
    os.rename(data, data + "-moved")
    assert store.load("s", key) is None


def test_partitioned_columns_keep_type_and_order(spark, store):
    df = spark.range(6).select((F.col("id") % 2 == 0).alias("even"), "id")
    back = store.step("p", lambda: df, partition_by=["even"]).df
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_second_application_starts_no_job_over_the_inputs(spark, small_dir, tmp_path):
    root = str(tmp_path / "store")
    first = Experiment(spark, small_dir, store=root)
    want = sorted(map(tuple, first.edx_split.select("rk", "is_test").collect()))
    second = Experiment(spark, small_dir, store=root)
    before = _jobs(spark)
    split = second.edx_split
    assert second.features.columns == first.features.columns
    assert _jobs(spark) == before  # markers only
    assert all(c.reloaded for c in second.checkpoints.values()) and not any(c.reloaded for c in first.checkpoints.values())
    assert sorted(map(tuple, split.select("rk", "is_test").collect())) == want
    scans = split._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in scans
    other = Experiment(spark, small_dir, store=root, seed=2)
    assert other.features is not None and other.checkpoints["features"].reloaded
    other.holdout_split
    assert not other.checkpoints["split-holdout"].reloaded
