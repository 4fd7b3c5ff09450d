import numpy as np
from pyspark.sql import functions as F

from tilespan.functions import grid, text
from tilespan.operators import cache, polygons, raster, spans, tasks


def rings(*parts):
    return [[{"lon": float(x), "lat": float(y)} for x, y in [*p, p[0]]] for p in parts]


RING_TYPE = "key long, rings array<array<struct<lon: double, lat: double>>>"


def inside(point, parts):
    hit = False
    for p in parts:
        for (x1, y1), (x2, y2) in zip(p, [*p[1:], p[0]], strict=True):
            if (y1 > point[1]) != (y2 > point[1]) and point[0] < (x2 - x1) * (point[1] - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


SHAPES = {
    1: [[(0, 0), (40, 0), (40, 30), (0, 30)], [(10, 10), (10, 20), (30, 20), (30, 10)]],
    2: [[(-60, -50), (-20, -40), (-35, -10), (-55, -20)]],
    3: [[(170, -20), (200, -20), (200, 20), (170, 20)]],
    4: [[(5, 5), (50, 5.2), (50, 6), (5, 5.8)]],
}


def test_contains_and_join(spark):
    rng = np.random.default_rng(0)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 600), rng.uniform(-60, 60, 600), strict=True))]
    table = spark.createDataFrame(points, "id long, lon double, lat double")
    shapes = spark.createDataFrame([(k, rings(*p)) for k, p in SHAPES.items()], RING_TYPE)
    got = {tuple(r) for r in polygons.points_in_polygons(table, shapes, "key").collect()}
    assert got == {(k, i) for k, p in SHAPES.items() for i, x, y in points if inside((x, y), p) or inside((x + 360, y), p)}
    areas = {r.key: (r.a, r.n) for r in shapes.select("key", polygons.ring_area(F.col("rings")[0]).alias("a"), polygons.vertex_count(F.col("rings")).alias("n")).collect()}
    assert areas[1] == (1200.0, 8) and areas[3] == (1200.0, 4)


def test_antimeridian_count(spark):
    whole = spark.createDataFrame([(1, 10.0, -10.0, 190.0, -170.0), (2, 40.0, -40.0, 190.0, 170.0)], "region long, north double, south double, east double, west double")
    listed = spans.cells(spans.row_spans(whole, ["region"], 0, 5)).groupBy("region", "zoom").count().collect()
    counted = spans.count_tiles(whole, ["region"], 0, 5).collect()
    assert {(r.region, r.zoom, r["count"]) for r in listed} == {(r.region, r.zoom, r.tiles) for r in counted}


def test_contour_ladder(spark):
    rows = spark.range(8, 15).select(F.col("id").cast("int").alias("z"), raster.interval_at(F.lit(50.0), F.col("id").cast("int")).alias("i"), raster.interval_at(F.lit(50.0), F.col("id").cast("int"), gentle=True).alias("g")).collect()
    assert [r.i for r in rows] == [5000, 2500, 1000, 500, 250, 100, 50]
    assert [r.g for r in rows] == [500, 250, 250, 100, 100, 50, 50]
    flags = spark.range(1).select(raster.is_index_contour(F.lit(500.0), F.lit(50.0), 5).alias("a"), raster.is_index_contour(F.lit(550.0), F.lit(50.0), 5).alias("b")).first()
    assert (flags.a, flags.b) == (True, False)


def test_redact(spark):
    cases = {
        "see https://u:p@h/x?a=1&token=abc, ok": "see https://***:***@h/x?a=1&token=***, ok",
        "Authorization: Bearer abcdefgh": "Authorization: ***",
        "sent Bearer abcdefgh": "sent Bearer ***",
        "api_key=123, other=4": "api_key=***, other=4",
        "my-secret: 'x' and more": "my-secret: *** and more",
        "plain text": "plain text",
    }
    rows = spark.createDataFrame([*cases.items()], "said string, want string").select("want", text.redact(F.col("said")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    url = spark.range(1).select(text.mask_url(F.lit("ftp://u:p@h/x?a=1&my_token=abc&tk=&b=2#token")).alias("u")).first().u
    assert url == "ftp://***:***@h/x?a=1&my_token=***&tk=***&b=2#token"


def test_misc(spark):
    one = spark.range(1).select(
        grid.valid_zoom(F.lit("12")).alias("a"), grid.valid_zoom(F.lit("12.5")).alias("b"), grid.valid_zoom(F.lit(22)).alias("c"), grid.granule_id(F.lit(-3), F.lit(106)).alias("d"), text.is_namespace(F.lit("s-0123abcd")).alias("e"), text.human_bytes(F.lit(1536)).alias("f"), raster.zigzag(F.lit(-3)).alias("g"), cache.tile_bytes(F.lit("q"), F.lit(14)).alias("h")
    ).first()
    assert tuple(one) == (True, False, False, "S03E106", True, "1.5 KiB", 5, 76800)
    coded = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 2, 2, 1, 3])], "k int, i int, v int")
    assert [r.code for r in raster.high_water_codes(coded, "k", "i", "v").orderBy("i").collect()] == [0, 0, 0, 1, 2, 0]
    page = tasks.page(spark.createDataFrame([(i, i // 2, "map") for i in range(10)], "id int, created_at int, task_type string"), 2, 3)
    assert [r.id for r in page.collect()] == [6, 5, 4]


def test_first_rows_that_tie_do_not_depend_on_their_order(spark):
    rows = [(1, 10, 7), (1, 10, 5), (1, 11, 1), (2, None, 3), (2, 4, 9), (3, None, 2)]
    for given in (rows, rows[::-1]):
        found = tasks.keep_first(spark.createDataFrame(given, "task long, file_id long, size long").coalesce(1), ["task"], "file_id")
        assert sorted(map(tuple, found.collect())) == [(1, 10, 5), (2, 4, 9), (3, None, 2)]
