import datetime as dt

from pyspark.sql import functions as F

from tilespan.operators import deletion, spans

TASK = "id long, status string, namespace string, north double, south double, east double, west double, zoom_min int, zoom_max int, rings array<array<struct<lon: double, lat: double>>>"


def _ring(*points):
    return [[{"lon": float(x), "lat": float(y)} for x, y in [*points, points[0]]]]


def test_only_whole_tiles_are_listed(spark):
    paths = ["/c/m-1/5/3/4.png", "m-1/0/0/0.png", "/c/m-1/5/3/4.png.part.77.1", "/c/m-1/5/3/a.png", "/c/m-1/5/3/4.jpg", "/c/meta.json", "/c/m-1/5/99999999999999999999/4.png", None]
    listing = spark.createDataFrame([(p, 10) for p in paths], "path string, bytes int")
    assert sorted(tuple(r) for r in deletion.listed_tiles(listing).collect()) == [("m-1", 0, 0, 0, 10), ("m-1", 5, 3, 4, 10)]


def test_tasks_that_came_or_went_meanwhile_keep_their_tiles(spark):
    rows = lambda *ids: spark.createDataFrame([(i, f"s{i}") for i in ids], "id long, status string")
    found = deletion.survivors(rows(1, 2, 3), rows(2, 4), rows(1))
    assert sorted(r.id for r in found.collect()) == [2, 3, 4]
    left, stones = deletion.buried(rows(1, 2), rows(2, 9), F.lit(dt.datetime(2024, 1, 1)))
    assert [r.id for r in left.collect()] == [1] and [(r.id, r.was) for r in stones.collect()] == [(2, "s2")]


def test_what_goes_with_a_task(spark):
    box = lambda i, ns, n, s, e, w, lo=3, hi=5, rings=None: (i, "completed", ns, float(n), float(s), float(e), float(w), lo, hi, rings)
    tasks = [
        box(1, "a", 40, -40, 60, 0), box(2, "a", 20, 0, 30, 10), box(3, "b", 40, -40, 60, 0), box(4, "a", 1, -1, -179, 179),
        box(5, "a", 40, -40, 60, 0, rings=_ring((40, -30), (55, -30), (48, -5))), box(6, None, 1, 0, 1, 0), box(7, "a", 5, 0, float("nan"), 0), box(8, "a", 5, 0, 5, 0, 5, 3), box(9, "a", 10, 0, 10, 0, 4, 4, rings=[[]]),
    ]
    table = spark.createDataFrame(tasks, TASK)
    held = spans.cells(deletion.referenced(table)).collect()
    by_task = {}
    for r in held:
        by_task.setdefault(r.id, set()).add((r.namespace, r.zoom, r.x, r.y))
    assert set(by_task) == {1, 2, 3, 4, 5, 9} and by_task[5] < by_task[1]  # drawn inside the box
    assert {x for _, z, x, _ in by_task[4] if z == 3} == {0, 7}  # over the antimeridian
    files = spark.createDataFrame([(ns, z, x, y, 1) for ns in "ab" for z in (3, 4, 5) for x in range(1 << z) for y in range(1 << z)], "namespace string, zoom int, x long, y long, bytes long")
    gone, kept = table.where("id = 1"), table.where("id <> 1")
    runs = deletion.exclusive(deletion.referenced(gone), deletion.referenced(kept))
    others = set().union(*(v for k, v in by_task.items() if k != 1))
    assert {(r.namespace, r.zoom, r.x, r.y) for r in deletion.removable(files, runs).collect()} == by_task[1] - others
    total = deletion.freed(deletion.removable(files, runs)).collect()
    assert [(r.namespace, r.removed_files, r.removed_bytes) for r in total] == [("a", len(by_task[1] - others), len(by_task[1] - others))]
