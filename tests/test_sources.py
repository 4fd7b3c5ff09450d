import json

import pytest

from tilespan.sources import mbtiles, regions


def test_mbtiles(spark, tmp_path):
    mbtiles.register(spark)
    rows = [(z, x, (x * 7) % (1 << z), b"\x89PNG" + bytes([z, x])) for z in (1, 3, 5) for x in range(1 << z)]
    tiles = spark.createDataFrame(rows, mbtiles.SCHEMA).repartition(3)
    at = str(tmp_path / "t.mbtiles")
    tiles.write.format("mbtiles").mode("append").option("name", "n").save(at)
    back = spark.read.format("mbtiles").load(at)
    assert sorted(map(tuple, back.collect())) == sorted((z, x, y, bytearray(d)) for z, x, y, d in rows)
    assert back.rdd.getNumPartitions() == 3
    good = {"name": "n", "format": "png", "minzoom": "1", "maxzoom": "5"}
    assert all(r.ok for r in mbtiles.validate(back, good).collect())
    bad = {r.rule: r.ok for r in mbtiles.validate(back, {"format": "jpg", "minzoom": "0", "maxzoom": "5"}).collect()}
    assert bad == {"required_keys": False, "not_empty": True, "in_grid": True, "zooms": False, "format": False}
    with pytest.raises(Exception, match="outside its grid"):
        spark.createDataFrame([(1, 5, 0, b"x")], mbtiles.SCHEMA).write.format("mbtiles").mode("append").save(str(tmp_path / "u.mbtiles"))


def test_regions(spark, tmp_path):
    square = [[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1]]
    files = {
        "a.geojson": json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square, hole]}}),
        "b.geojson": json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}]}),
        "c.kml": '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 2,0,5 2,2</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>',
        "d.geojson": "{",
        "e.geojson": json.dumps({"type": "Polygon", "coordinates": [square], "crs": {"properties": {"name": "EPSG:3857"}}}),
        "f.geojson": json.dumps({"type": "Point", "coordinates": [1, 2]}),
        "g.geojson": json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.path[-9:].lstrip("/"): r for r in regions.read(spark, str(tmp_path)).collect()}
    a = got["a.geojson"].rings
    assert len(a) == 2 and [tuple(p) for p in a[0]][:2] == [(0.0, 0.0), (2.0, 0.0)] and len(a[1]) == 4
    assert len(got["b.geojson"].rings) == 2
    assert next(len(r.rings[0]) for k, r in got.items() if k.endswith("c.kml")) == 4
    assert all(got[f"{k}.geojson"].error for k in "defg")
