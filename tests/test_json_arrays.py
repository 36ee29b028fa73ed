"""Objects of JSON arrays that are cut anywhere into splits, against a plain parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scenespark.sources import json_arrays as J, labels as L, records


@pytest.fixture(params=[61, 5000])
def splits(spark, request):
    """The largest split in bytes; small ones also cut strings and escapes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def some_objects(n, seed):
    rng = random.Random(seed)
    words = ["a", "}", "{", '"', "\\", "},{", '"}', "é🥊", "[", "]", "\n", "\\\"", "{\"x\": 1}", " "]

    def text():
        return "".join(rng.choice(words) for _ in range(rng.randrange(9)))

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind > 3:
            return {text(): value(depth - 1)} if kind == 4 else [value(depth - 1), {}]
        return [text(), rng.random(), None, text()][kind]

    return [{"id": i, text(): value(2), "s": text(), "inner": {"k": value(1)}} for i in range(n)]


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_objects_of_an_array(spark, tmp_path, splits, form):
    want = {}
    for k, n in enumerate((120, 1, 0)):
        objects = some_objects(n, k)
        (tmp_path / f"f{k}.json").write_text(json.dumps(objects, **form) + "\n" * k, encoding="utf-8")
        want[f"f{k}.json"] = objects
    got = {}
    for r in J.read_objects(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["value"]))
    for name, objects in want.items():
        assert sorted(got.get(name, []), key=lambda o: o["id"]) == objects


def test_objects_of_a_list_inside(spark, tmp_path, splits):
    features = [{"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [i, 1]}, "properties": {
        "image_id": f'{i} "}}{{".tif', "type_id": 18, "bounds_imcoords": f"{i},2,3,4", "note": {"deep": {"er": "}"}}}} for i in range(60)]
    doc = {"type": "FeatureCollection", "name": 'a "{ name }', "crs": {"type": "name", "properties": {"name": "x}"}}, "features": features}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    got = [json.loads(r["value"]) for r in J.read_objects(spark, str(tmp_path), level=2).collect()]
    assert sorted((o for o in got if o["type"] == "Feature"), key=lambda o: o["id"]) == features and len(got) == 61
    rows = {r["image_id"]: (r["type_id"], r["bounds_imcoords"]) for r in L.read_geojson(spark, str(tmp_path)).collect()}
    assert rows == {f["properties"]["image_id"]: ("18", f["properties"]["bounds_imcoords"]) for f in features}


def test_many_tasks_read_one_array(spark, tmp_path):
    records_ = [{"alert_id": f"a{i}", "feed_id": i % 7, "frame_id": i, "timestamp": float(i), "priority": "HIGH", "reasons": ["x}", "y"]}
                for i in range(30_000)]
    (tmp_path / "log.json").write_text(json.dumps(records_))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        text = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert text.rdd.getNumPartitions() > 20
        got = records.read_alert_array(spark, str(tmp_path))
        plain = records.read_alert_log(spark, str(tmp_path))
        assert got.count() == 30_000 and got.filter("is_corrupt").count() == 0
        assert got.select(plain.columns).exceptAll(plain).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_arrays_are_arrays(spark, tmp_path):
    rows = spark.range(50).select(F.to_json(F.struct("id")).alias("value")).repartition(3).unionByName(
        spark.range(0).select(F.lit("").alias("value")))
    J.write_arrays(rows, str(tmp_path / "out"))
    held = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(o["id"] for part in held for o in part) == list(range(50))
