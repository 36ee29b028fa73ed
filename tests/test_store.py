"""The versioned alert store: what a batch writes, what readers see, compaction and clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from scenespark.sinks import store, tables


def batch(spark, ids, at, priority="HIGH", notified=False):
    return spark.createDataFrame([(f"a{i}", priority, notified, at) for i in ids], "alert_id string, priority string, notified boolean, written_at int")


def state(spark, path):
    return {r["alert_id"]: (r["priority"], r["notified"], r["written_at"]) for r in store.read(spark, path).collect()}


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append(batch(spark, range(5000), 1), path)
    folder = store.append(batch(spark, range(4800, 5300), 2, "LOW"), path)
    assert spark.read.parquet(f"{path}/data/{folder}").count() == 500
    got = state(spark, path)
    assert len(got) == 5300 and got["a4799"] == ("HIGH", False, 1) and got["a4800"] == ("LOW", False, 2)
    # an older row that comes late does not win
    store.append(batch(spark, [5000], 1, "CRITICAL"), path)
    assert state(spark, path)["a5000"] == ("LOW", False, 2)


def test_repeated_batches_and_unfinished_ones(spark, tmp_path):
    path = str(tmp_path / "s")
    for _ in range(3):
        store.append(batch(spark, [1, 2, 2], 7), path, name="7")
    assert store.folders(spark, path) == ["v-7"] and len(state(spark, path)) == 2
    # data without a manifest entry was never committed
    batch(spark, [3], 8).write.partitionBy("priority").parquet(f"{path}/data/v-8")
    assert set(state(spark, path)) == {"a1", "a2"}
    assert store.vacuum(spark, path) == 1 and os.listdir(f"{path}/data") == ["v-7"]


def test_compaction_keeps_what_readers_see(spark, tmp_path):
    path = str(tmp_path / "s")
    for k in range(6):
        store.append(batch(spark, range(k * 10, k * 10 + 15), k, notified=k % 2 == 0), path)
    before = state(spark, path)
    assert store.compact(spark, path, least=7) is None and store.compact(spark, path, small=0, least=1) is None
    merged = store.compact(spark, path, least=6)
    assert store.folders(spark, path) == [merged] and state(spark, path) == before
    assert spark.read.parquet(f"{path}/data/{merged}").count() == len(before)
    assert store.vacuum(spark, path) == 6 and state(spark, path) == before
    # a large folder stays out of the next merge
    store.append(batch(spark, [0], 99), path)
    assert store.compact(spark, path, small=1, least=1) is None


def test_upserts_merge_by_themselves(spark, tmp_path):
    path = str(tmp_path / "s")
    for k in range(store.compact.__defaults__[2] + 1):
        tables.upsert_alerts(batch(spark, [k, 100], k), path, name=str(k))
    assert len(store.folders(spark, path)) < store.compact.__defaults__[2]
    assert state(spark, path)["a100"][2] == store.compact.__defaults__[2]


def test_nothing_written(spark, tmp_path):
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path / "none"))
    store.append(batch(spark, [1], 1).filter(F.lit(False)), str(tmp_path / "s"))
    store.append(batch(spark, [1], 1), str(tmp_path / "s"))
    assert len(state(spark, str(tmp_path / "s"))) == 1
