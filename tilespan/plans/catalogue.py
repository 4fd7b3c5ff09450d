"""Queries over tile grids, the gap ledger and the task catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespan.functions import grid
from tilespan.operators import ledger, spans, tasks
from tilespan.plans import views as v
from tilespan.plans.views import sql_tile_x, sql_tile_y, with_views

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _xyz(lon, lat, z):
    return f"{sql_tile_x(lon, z)} AS x, {sql_tile_y(lat, z)} AS y"


_PARTS = """parts AS (SELECT region, west, least(east, 180) AS east, south, north FROM regions
    UNION ALL SELECT region, -180, east - 360, south, north FROM regions WHERE east > 180),
    ranges AS (SELECT region, zoom, least(a, b) AS x0, greatest(a, b) AS x1, least(c, d) AS y0, greatest(c, d) AS y1 FROM (
    SELECT region, CAST(z AS INT) AS zoom, {0} AS a, {1} AS b, {2} AS c, {3} AS d FROM parts, range(0, 13) t(z)))""".format(
    sql_tile_x("west", "z"), sql_tile_x("east", "z"), sql_tile_y("north", "z"), sql_tile_y("south", "z")
)


_ALL_PARTS = _PARTS.replace("range(0, 13)", "range(0, 22)")


@query(with_views("pts") + f"SELECT id, CAST(z AS INT) AS zoom, {_xyz('lon', 'lat', 'z')} FROM pts, range(0, 22) t(z)")
def point_to_tile_all_zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_of(v.points(spark, sf_dir))


def tiles_of(points: DataFrame) -> DataFrame:
    """The tile of each point at each zoom."""
    rows = spans.by_zoom(points, 0, 21)
    return rows.select("id", "zoom", grid.tile_x(F.col("lon"), F.col("zoom")).alias("x"), grid.tile_y(F.col("lat"), F.col("zoom")).alias("y"))


@query(
    with_views("pts")
    + f""", t AS (SELECT id, z, {_xyz('lon', 'lat', 'z')} FROM pts, (SELECT 12 AS z))
    SELECT id, x, y, round(x / pow(2, z) * 360 - 180, 9) AS west, round((x + 1) / pow(2, z) * 360 - 180, 9) AS east,
    round(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))), 9) AS north, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))), 9) AS south,
    CAST(pow(2, z) AS BIGINT) - 1 - y AS tms_y FROM t"""
)
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir).withColumns({"x": grid.tile_x(F.col("lon"), 12), "y": grid.tile_y(F.col("lat"), 12)})
    x, y = F.col("x"), F.col("y")
    edges = {"west": grid.tile_west(x, 12), "east": grid.tile_west(x + 1, 12), "north": grid.tile_north(y, 12), "south": grid.tile_north(y + 1, 12)}
    return rows.select("id", "x", "y", *(F.round(c, 9).alias(n) for n, c in edges.items()), grid.tms_row(12, y).alias("tms_y"))


@query(
    with_views("pts")
    + """, m AS (SELECT id, radians(lon) * 6378137.0::DOUBLE AS mx, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE AS my FROM pts)
    SELECT id, round(mx, 4) AS mx, round(my, 4) AS my, round(degrees(mx / 6378137.0::DOUBLE), 7) AS lon, round(degrees(2 * atan(exp(my / 6378137.0::DOUBLE)) - pi() / 2), 7) AS lat FROM m"""
)
def mercator_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir).select("id", grid.mercator_x(F.col("lon")).alias("mx"), grid.mercator_y(F.col("lat")).alias("my"))
    return rows.select("id", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), F.round(grid.mercator_lon(F.col("mx")), 7).alias("lon"), F.round(grid.mercator_lat(F.col("my")), 7).alias("lat"))


@query(
    with_views("pts")
    + """, e AS (SELECT id, radians(lon) AS l, radians(lat) AS p, CAST(id % 9000 AS DOUBLE) AS h FROM pts),
    n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - 0.00669437999014::DOUBLE * sin(p) * sin(p)) AS r FROM e)
    SELECT id, round((r + h) * cos(p) * cos(l), 3) AS x, round((r + h) * cos(p) * sin(l), 3) AS y, round((r * (1 - 0.00669437999014::DOUBLE) + h) * sin(p), 3) AS z FROM n"""
)
def ecef_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grid.ecef(F.col("lon"), F.col("lat"), (F.col("id") % 9000).cast("double"))
    return v.points(spark, sf_dir).withColumn("e", e).select("id", *(F.round(F.col("e")[c], 3).alias(c) for c in "xyz"))


@query(with_views("regions") + f", {_PARTS} SELECT region, zoom, x0, x1, y0, y1 FROM ranges")
def region_tile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.box_ranges(v.regions(spark, sf_dir), 0, 12).select("region", "zoom", "x0", "x1", "y0", "y1")


@query(
    with_views("regions")
    + f""", {_ALL_PARTS}, rows AS (SELECT region, zoom, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM ranges),
    far AS (SELECT *, max(x1) OVER (PARTITION BY region, zoom, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rows),
    isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY region, zoom, y ORDER BY x0, x1) AS g FROM far)
    SELECT region, zoom, y, min(x0) AS x0, max(x1) AS x1 FROM isl GROUP BY region, zoom, y, g"""
)
def region_row_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.row_spans(v.regions(spark, sf_dir), ["region"], 0, 21)


@query(
    with_views("regions")
    + f""", {_PARTS}, tiles AS (SELECT DISTINCT region, zoom, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM ranges)
    SELECT region, zoom, CAST(sum(y1 - y0 + 1) AS BIGINT) AS tiles FROM tiles GROUP BY region, zoom"""
)
def region_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.count_tiles(v.regions(spark, sf_dir), ["region"], 0, 12)


_CELLS = """parts AS (SELECT region, west, least(east, 180) AS east, south, north FROM regions UNION ALL SELECT region, -180, east - 360, south, north FROM regions WHERE east > 180),
    lats AS (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(greatest(floor(south), floor(north - 1e-12::DOUBLE)) AS BIGINT) + 1)) AS lat FROM parts),
    cells AS (SELECT DISTINCT region, CAST(lat AS INT) AS lat, CAST(unnest(range(CAST(floor(west) AS BIGINT), CAST(greatest(floor(west), floor(east - 1e-12::DOUBLE)) AS BIGINT) + 1)) AS INT) AS lon FROM lats)"""
_ID = "printf('%s%02d%s%03d', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lat), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END, abs(lon))"
_GLO = "printf('Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lat), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END, abs(lon))"


@query(with_views("regions") + f", {_CELLS} SELECT region, lat, lon, {_ID} AS granule, {_GLO} || '/' || {_GLO} || '.tif' AS glo30, CASE WHEN abs(lat) > 83 THEN 0 ELSE 2 END AS n_aster FROM cells")
def degree_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spans.granules(v.regions(spark, sf_dir), ["region"])
    lat, lon = F.col("lat"), F.col("lon")
    return cells.select("region", "lat", "lon", grid.granule_id(lat, lon).alias("granule"), grid.glo30_name(lat, lon).alias("glo30"), F.size(grid.aster_names(lat, lon)).alias("n_aster"))


@query(
    with_views("regions")
    + f""", {_CELLS}, named AS (SELECT region, {_ID} AS granule FROM cells)
    SELECT region, granule FROM named a WHERE NOT EXISTS (SELECT 1 FROM named b WHERE b.granule = a.granule AND b.region <> a.region)"""
)
def exclusive_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spans.granules(v.regions(spark, sf_dir), ["region"]).select("region", grid.granule_id(F.col("lat"), F.col("lon")).alias("granule"))
    return named.groupBy("granule").agg(F.count("*").alias("n"), F.first("region").alias("region")).where("n = 1").select("region", "granule")


_AXIS = "greatest(0, least({n} - 1, CAST(floor(({lo} + {o}) / ({s} / {n})) AS BIGINT))) AS {a}0, greatest(0, least({n} - 1, greatest(CAST(floor(({lo} + {o}) / ({s} / {n})) AS BIGINT), CAST(ceil(({hi} + {o}) / ({s} / {n})) AS BIGINT) - 1))) AS {a}1"
_COVER = "greatest(0, least({hi}, -{o} + {i} * ({s} / {n}) + {s} / {n}) - greatest({lo}, -{o} + {i} * ({s} / {n}))) / ({s} / {n}) >= 0.25::DOUBLE"


def _sql_axis(a, lo, hi, n, s, o):
    return _AXIS.format(a=a, lo=lo, hi=hi, n=n, s=s, o=o)


def _sql_cover(i, lo, hi, n, s, o):
    return _COVER.format(i=i, lo=lo, hi=hi, n=n, s=s, o=o)


@query(
    with_views("regions")
    + f""", z AS (SELECT region, least(east, 180) AS e, west, south, north, CAST(lv AS INT) AS level, CAST(pow(2, lv + 1) AS BIGINT) AS nx, CAST(pow(2, lv) AS BIGINT) AS ny FROM regions, range(0, 11) t(lv)),
    r AS (SELECT *, {_sql_axis('x', 'west', 'e', 'nx', '360.0::DOUBLE', '180.0::DOUBLE')}, {_sql_axis('y', 'south', 'north', 'ny', '180.0::DOUBLE', '90.0::DOUBLE')} FROM z),
    c AS (SELECT *, CASE WHEN {_sql_cover('x0', 'west', 'e', 'nx', '360.0::DOUBLE', '180.0::DOUBLE')} THEN x0 ELSE x0 + 1 END AS cx0,
    CASE WHEN {_sql_cover('x1', 'west', 'e', 'nx', '360.0::DOUBLE', '180.0::DOUBLE')} THEN x1 ELSE x1 - 1 END AS cx1,
    CASE WHEN {_sql_cover('y0', 'south', 'north', 'ny', '180.0::DOUBLE', '90.0::DOUBLE')} THEN y0 ELSE y0 + 1 END AS cy0,
    CASE WHEN {_sql_cover('y1', 'south', 'north', 'ny', '180.0::DOUBLE', '90.0::DOUBLE')} THEN y1 ELSE y1 - 1 END AS cy1 FROM r)
    SELECT region, level, x0, x1, y0, y1, cx0 <= cx1 AND cy0 <= cy1 AS available FROM c"""
)
def terrain_tile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.regions(spark, sf_dir).withColumn("e", F.least("east", F.lit(180.0))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(10))))
    nx, ny = grid.tiles_across(F.col("level") + 1), grid.tiles_across(F.col("level"))
    xs, ys = (F.col("west"), F.col("e"), nx, 360.0, -180.0), (F.col("south"), F.col("north"), ny, 180.0, -90.0)
    x, y = grid.axis_range(*xs), grid.axis_range(*ys)
    ok = grid.covered_axis(*xs).isNotNull() & grid.covered_axis(*ys).isNotNull()
    return rows.select("region", "level", x.i0.alias("x0"), x.i1.alias("x1"), y.i0.alias("y0"), y.i1.alias("y1"), ok.alias("available"))


@query(
    """WITH r AS (SELECT vec_id AS raster, CAST(vec_id % 50 AS DOUBLE) / 3600 + 0.0001::DOUBLE AS px, 100 + vec_id * 37 % 20000 AS w, 100 + vec_id * 91 % 9000 AS h FROM embeddings)
    SELECT raster, CAST(greatest(0, ceil(log2(2.8125::DOUBLE / px))) AS BIGINT) AS level,
    CAST(len(list_filter(range(1, 31), lambda k: greatest(w, h) / pow(2, k) >= 32)) AS INT) AS n_overviews FROM r"""
)
def raster_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    px = (k % 50).cast("double") / 3600 + 0.0001
    return v.table(spark, sf_dir, "embeddings").select(k.alias("raster"), grid.max_level(px).alias("level"), F.size(grid.overview_factors(100 + k * 37 % 20000, 100 + k * 91 % 9000)).alias("n_overviews"))


_STATUS = "CAST(CASE CAST(l_quantity AS INT) % 9 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN NULL ELSE 200 END AS INT)"


@query(
    f"""WITH o AS (SELECT {_STATUS} AS s, l_linenumber % 3 <> 0 AS image, l_linenumber = 7 AS late FROM lineitem),
    c AS (SELECT s AS http_status, CASE WHEN late OR s IS NULL THEN 'retryable_failure' WHEN s IN (404, 410) THEN 'no_data' WHEN s = 200 AND image THEN 'success'
    WHEN s = 200 THEN 'permanent_failure' WHEN s = 429 THEN 'retryable_failure' WHEN s BETWEEN 400 AND 499 THEN 'permanent_failure' ELSE 'retryable_failure' END AS outcome FROM o)
    SELECT http_status, outcome, count(*) AS n FROM c GROUP BY ALL"""
)
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int") % 9
    status = F.when(q == 0, 404).when(q == 1, 410).when(q == 2, 403).when(q == 3, 429).when(q == 4, 503).when(q == 5, F.lit(None)).otherwise(200)
    rows = v.table(spark, sf_dir, "lineitem").select(status.cast("int").alias("http_status"), (F.col("l_linenumber") % 3 != 0).alias("image"), (F.col("l_linenumber") == 7).alias("late"))
    return rows.groupBy("http_status", ledger.classify(F.col("http_status"), F.col("image"), F.col("late")).alias("outcome")).agg(F.count("*").alias("n"))


_LAST = "lastobs AS (SELECT task, zoom, x, y, arg_max(outcome, (ts, seq)) AS outcome, count(*) AS n_seen FROM obs GROUP BY task, zoom, x, y)"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.last_wins(v.observations(spark, sf_dir), ["task", "zoom", "x", "y"], ["ts", "seq"])


@query(with_views("obs") + f", {_LAST} SELECT task, zoom, x, y, outcome, n_seen FROM lastobs WHERE outcome <> 'success'")
def ledger_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).where(ledger.is_gap(F.col("outcome"))).select("task", "zoom", "x", "y", "outcome", "n_seen")


@query(
    with_views("obs")
    + f""", {_LAST}, g AS (SELECT task, count(*) FILTER (outcome <> 'success') AS total, count(*) FILTER (outcome = 'no_data') AS n_no_data, count(*) FILTER (outcome = 'retryable_failure') AS n_retryable_failure,
    count(*) FILTER (outcome = 'permanent_failure') AS n_permanent_failure, count(*) FILTER (outcome = 'cache_failure') AS n_cache_failure FROM lastobs GROUP BY task)
    SELECT *, n_retryable_failure + n_permanent_failure + n_cache_failure AS unexplained, n_retryable_failure + n_permanent_failure + n_cache_failure = 0 AS explained FROM g"""
)
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summary(_ledger(spark, sf_dir), ["task"])


@query(with_views("obs") + f", {_LAST} SELECT task, zoom, y, x, outcome, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY zoom, y, x) AS r FROM lastobs WHERE outcome <> 'success') WHERE r <= 3")
def gap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.samples(_ledger(spark, sf_dir), ["task"], 3).select("task", "zoom", "y", "x", "outcome", "rank")


@query(with_views("obs") + f", {_LAST} SELECT task, zoom, count(*) FILTER (outcome NOT IN ('success', 'no_data')) AS unexplained, count(*) FILTER (outcome NOT IN ('success', 'no_data')) = 0 AS may_stitch FROM lastobs GROUP BY task, zoom")
def zoom_stitch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(ledger.is_unexplained(F.col("outcome")))
    return _ledger(spark, sf_dir).groupBy("task", "zoom").agg(n.alias("unexplained"), (n == 0).alias("may_stitch"))


@query(
    with_views("obs", "tasks")
    + f""", {_LAST}, z AS (SELECT task, zoom, count(*) FILTER (outcome NOT IN ('success', 'no_data')) AS u, count(*) FILTER (outcome <> 'success') AS g FROM lastobs GROUP BY task, zoom),
    s AS (SELECT task, CAST(sum(u) AS BIGINT) AS u, CAST(sum(g) AS BIGINT) AS g, count(*) AS n, count(*) FILTER (u > 0) AS bad FROM z GROUP BY task)
    SELECT id AS task, CASE WHEN id % 97 = 0 THEN 'failed' WHEN coalesce(u, 0) > 0 AND id % 3 <> 0 THEN 'pending_decision' WHEN coalesce(n, 0) > 0 AND bad = n THEN 'failed' WHEN coalesce(g, 0) > 0 THEN 'completed_with_gaps' ELSE 'completed' END AS final_state
    FROM tasks LEFT JOIN s ON task = id"""
)
def terminal_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    zooms = _ledger(spark, sf_dir).groupBy("task", "zoom").agg(F.count_if(ledger.is_unexplained(F.col("outcome"))).alias("u"), F.count_if(ledger.is_gap(F.col("outcome"))).alias("g"))
    tally = zooms.groupBy("task").agg(F.sum("u").alias("u"), F.sum("g").alias("g"), F.count("*").alias("n"), F.count_if(F.col("u") > 0).alias("bad"))
    rows = v.tasks(spark, sf_dir).select(F.col("id").alias("task")).join(tally, "task", "left").fillna(0)
    state = ledger.terminal_state(F.col("task") % 97 == 0, F.col("u"), F.col("task") % 3 == 0, F.col("n"), F.col("bad"), F.col("g"))
    return rows.select("task", state.alias("final_state"))


_HALVES = """a AS (SELECT task, zoom, x, y, arg_max(outcome, (ts, seq)) AS outcome FROM obs WHERE seq % 2 = 0 GROUP BY ALL),
    b AS (SELECT task, zoom, x, y, arg_max(outcome, (ts, seq)) AS outcome FROM obs WHERE seq % 2 = 1 GROUP BY ALL),
    led AS (SELECT * FROM a WHERE outcome <> 'success')"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, keys = v.observations(spark, sf_dir), ["task", "zoom", "x", "y"]
    first = ledger.last_wins(rows.where("seq % 2 = 0"), keys, ["ts", "seq"]).where(ledger.is_gap(F.col("outcome"))).withColumn("retries", F.lit(0))
    return first, ledger.last_wins(rows.where("seq % 2 = 1"), keys, ["ts", "seq"])


@query(
    with_views("obs")
    + f""", {_HALVES} SELECT coalesce(l.task, b.task) AS task, coalesce(l.zoom, b.zoom) AS zoom, coalesce(l.x, b.x) AS x, coalesce(l.y, b.y) AS y, coalesce(b.outcome, l.outcome) AS outcome,
    CAST(CASE WHEN b.outcome IS NOT NULL AND l.outcome IS NOT NULL THEN 1 ELSE 0 END AS INT) AS retries
    FROM led l FULL JOIN b ON l.task = b.task AND l.zoom = b.zoom AND l.x = b.x AND l.y = b.y WHERE b.outcome IS NULL OR b.outcome <> 'success'"""
)
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merge(*_halves(spark, sf_dir), ["task", "zoom", "x", "y"])


@query(
    with_views("obs")
    + f""", {_HALVES} SELECT b.task, CAST(sum((b.outcome = 'success')::INT - coalesce(l.outcome = 'success', false)::INT) AS BIGINT) AS downloaded_delta,
    CAST(sum((b.outcome NOT IN ('success', 'no_data'))::INT - coalesce(l.outcome NOT IN ('success', 'no_data'), false)::INT) AS BIGINT) AS failed_delta
    FROM b LEFT JOIN led l ON l.task = b.task AND l.zoom = b.zoom AND l.x = b.x AND l.y = b.y GROUP BY b.task"""
)
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, batch = _halves(spark, sf_dir)
    keys = ["task", "zoom", "x", "y"]
    changes = batch.select(*keys, F.col("outcome").alias("new")).join(first.select(*keys, F.col("outcome").alias("old")), keys, "left")
    return ledger.counter_deltas(changes, ["task"])


def _branches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five pipelines' task tables; only some have boxes and zooms."""
    rows = v.tasks(spark, sf_dir)
    plain = ["id", "status", "created_at", "downloaded", "total"]
    boxes = ["north", "south", "east", "west"]
    has = {"map": [*plain, *boxes, "zoom_min", "zoom_max", "style"], "dem": [*plain, *boxes], "local_terrain": plain, "contour": [*plain, *boxes, "zoom_min", "zoom_max"], "plugin": [*plain, *boxes, "zoom_min", "zoom_max"]}
    return {kind: rows.where(F.col("pipeline") == kind).select(*columns) for kind, columns in has.items()}


_LINE = """SELECT pipeline AS task_type, id, status, created_at, downloaded, total, CASE WHEN pipeline <> 'local_terrain' THEN west END AS west,
    CASE WHEN pipeline IN ('map', 'contour', 'plugin') THEN zoom_max END AS zoom_max, CASE WHEN pipeline = 'map' THEN style END AS style FROM tasks"""
_ACTIVE = "('pending', 'running', 'paused', 'retrying', 'pending_decision')"


@query(with_views("tasks") + f"{_LINE} WHERE status IN {_ACTIVE} ORDER BY created_at DESC, id DESC, pipeline LIMIT 20 OFFSET 40")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.timeline(_branches(spark, sf_dir), "active").select("task_type", "id", "status", "created_at", "downloaded", "total", "west", "zoom_max", "style")
    return tasks.page(rows, 3, 20)


@query(with_views("tasks") + _LINE)
def history_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.timeline(_branches(spark, sf_dir)).select("task_type", "id", "status", "created_at", "downloaded", "total", "west", "zoom_max", "style")


@query(with_views("tasks") + "SELECT pipeline AS task_type, count(*) AS total, count(*) FILTER (status IN ('completed', 'completed_with_gaps')) AS done, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(downloaded), 0) AS BIGINT) AS downloaded FROM tasks GROUP BY ROLLUP (pipeline)")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.statistics(tasks.timeline(_branches(spark, sf_dir)))


@query(with_views("tasks") + "SELECT count(*) AS total_count, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM tasks WHERE status IN ('completed', 'completed_with_gaps')")
def history_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.paging(tasks.timeline(_branches(spark, sf_dir), "completed"), 20)


@query(with_views("tasks") + f"SELECT id, pipeline, status, created_at, CAST(CASE WHEN total = 0 THEN 0 ELSE downloaded * 100.0::DOUBLE / total END AS DOUBLE) AS progress FROM tasks WHERE status IN {_ACTIVE}")
def active_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("downloaded") * 100.0 / F.col("total"))
    return v.tasks(spark, sf_dir).where(tasks.status_filter("active")).select("id", "pipeline", "status", "created_at", progress.alias("progress"))


@query(with_views("tasks") + "SELECT id, status, CASE status WHEN 'running' THEN 'paused' ELSE 'pending_decision' END AS recovered_status FROM tasks WHERE status IN ('running', 'retrying')")
def orphan_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.orphans(v.tasks(spark, sf_dir)).select("id", "status", "recovered_status")


@query(
    with_views("tasks", "times")
    + """, last AS (SELECT task, max(ts) AS m FROM times WHERE action = 'start' OR action = 'resume' GROUP BY task)
    SELECT id AS task, id % 1000 + CASE WHEN status = 'running' AND m IS NOT NULL THEN CAST(floor((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(m)) / 1000000::DOUBLE) AS BIGINT) ELSE 0 END AS running_seconds
    FROM tasks LEFT JOIN last ON task = id"""
)
def running_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.tasks(spark, sf_dir).select(F.col("id").alias("task"), "status", (F.col("id") % 1000).alias("running_seconds"))
    return tasks.running_time(rows, v.time_records(spark, sf_dir), F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query(
    with_views("samples")
    + """, t AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY task ORDER BY ts) AS BIGINT) AS total FROM samples),
    w AS (SELECT *, max(ts) OVER back AS bt, max(total) OVER back AS bb, min(ts) OVER (PARTITION BY task ORDER BY ts) AS ft, min(total) OVER (PARTITION BY task ORDER BY ts) AS fb
      FROM t WINDOW back AS (PARTITION BY task ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3 SECONDS PRECEDING)),
    d AS (SELECT event_id, task, total, (epoch_us(ts) - epoch_us(coalesce(bt, ft))) / 1000000::DOUBLE AS dt, total - coalesce(bb, fb) AS db FROM w)
    SELECT event_id, task, total AS total_bytes, round(CASE WHEN dt > 0 THEN db / dt ELSE 0 END, 6) AS rate FROM d"""
)
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.byte_samples(spark, sf_dir)
    total = F.sum("bytes").over(Window.partitionBy("task").orderBy("ts"))
    return tasks.trailing_rate(rows.withColumn("total", total), "task").select("event_id", "task", F.col("total").alias("total_bytes"), F.round("rate", 6).alias("rate"))


@query(
    """WITH s AS (SELECT l_orderkey % 50 AS probe, l_linenumber * 10 AS concurrency, CAST(sum(l_quantity) AS DOUBLE) AS rate, count(*) FILTER (NOT (l_linenumber = 1 AND l_orderkey % 50 < 10)) AS ok FROM lineitem GROUP BY ALL),
    v AS (SELECT *, max(concurrency) OVER p AS top, max(rate) OVER p AS best FROM s WHERE ok > 0 WINDOW p AS (PARTITION BY probe)),
    k AS (SELECT probe, min(concurrency) FILTER (rate >= 0.9::DOUBLE * best) AS concurrency, any_value(best) AS best_rate, any_value(top) AS top, max(rate) FILTER (concurrency < top) AS below FROM v GROUP BY probe)
    SELECT probe, concurrency, best_rate, concurrency = top AND coalesce(below > 0 AND best_rate >= 1.15::DOUBLE * below, false) AS rising FROM k"""
)
def concurrency_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count_if(~((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 50 < 10)))
    samples = v.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("probe"), (F.col("l_linenumber") * 10).alias("concurrency")).agg(F.sum("l_quantity").cast("double").alias("rate"), ok.alias("ok"))
    return tasks.knee(samples, "probe")
