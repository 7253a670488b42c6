"""Documents cut anywhere say the same as read whole."""

import json
import random

import pytest

from millrace.sources import files, ranges


@pytest.fixture(params=["128m", "61", "7"])
def cut(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    spark.conf.set(names[0], request.param)
    if request.param != "128m":
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "400")
    yield request.param
    for n, v in zip(names, before):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def document(seed):
    rng = random.Random(seed)
    odd = ['a {b} "c" }', "\\", '"type": "Feature"', "é}{", "{{{", "", 'x\\"}']
    features = []
    for i in range(rng.randint(0, 12)):
        ring = [[rng.randint(-9, 9), rng.randint(-9, 9)] for _ in range(rng.randint(1, 5))]
        parts = [("type", "Feature"), ("properties", {"name": rng.choice(odd), "n": str(i)}), ("geometry", {"type": "Polygon", "coordinates": [ring]})]
        rng.shuffle(parts)
        features.append(dict(parts))
    whole = [("type", "FeatureCollection"), ("crs", {"type": "name", "properties": {"name": odd[seed % 7]}}), ("a{b", "c}d{"), ("features", features)]
    rng.shuffle(whole)
    return dict(whole)


@pytest.mark.parametrize("seed", [1, 2])
def test_features(spark, tmp_path, cut, seed):
    want = []
    for k, indent in enumerate((None, 2)):
        doc = document(seed * 10 + k)
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(k)))
        want += [(f["properties"]["n"], f["properties"]["name"], len(f["geometry"]["coordinates"][0])) for f in doc["features"]]
    if cut == "128m":
        objects = ranges.second_level_objects(spark, str(tmp_path))
        assert objects.count() == len(want) + 2
        assert all(isinstance(json.loads(r.text), dict) for r in objects.collect())
    got = files.read_geojson(spark, str(tmp_path)).collect()
    assert sorted((r.properties["n"], r.properties["name"], r.points) for r in got) == sorted(want) and want


def test_matrix(spark, tmp_path, cut):
    rng = random.Random(3)
    rows = [[rng.choice([0, 1.5, -2]) for _ in range(rng.randint(1, 6))] for _ in range(40)]
    text = "".join(rng.choice(["", "\n", "  \r\n"]) + "  ".join(map(str, r)) + rng.choice([" \n", "\r\n", "\n"]) for r in rows)
    path = tmp_path / "m.txt"
    path.write_bytes(text.encode())
    got = sorted((r.i, r.j, r.value) for r in files.read_matrix(spark, str(path)).collect())
    assert got == [(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
