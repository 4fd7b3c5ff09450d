"""Queries over the cache, disk estimates, rasters and texts, with their SQL."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespan.functions import grid, text
from tilespan.operators import cache, config, ledger, polygons, raster, spans, tasks, terrain
from tilespan.plans import views as v
from tilespan.plans.catalogue import _ALL_PARTS, _LAST, _ledger, query, tiles_of
from tilespan.plans.views import sql_tile_x, sql_tile_y, with_views

_NS = "style || '-' || substr(md5(CAST(id % 6 AS VARCHAR)), 1, 8)"


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.tasks(spark, sf_dir).withColumn("namespace", F.concat_ws("-", "style", F.substring(F.md5((F.col("id") % 6).cast("string")), 1, 8)))


_USAGE = f"""owned AS (SELECT id, status, {_NS} AS namespace FROM tasks),
    sizes AS (SELECT namespace, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM files GROUP BY namespace),
    refs AS (SELECT namespace, count(DISTINCT id) AS tasks, bool_or(status IN ('pending', 'running', 'paused', 'retrying', 'pending_decision') AND id % 2 = 0) AS active FROM owned GROUP BY namespace),
    usage AS (SELECT s.namespace, bytes, files, coalesce(tasks, 0) AS tasks, coalesce(active, false) AS active FROM sizes s LEFT JOIN refs r ON s.namespace = r.namespace)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only even tasks count as active here, so that some namespaces can go."""
    owned = _owned(spark, sf_dir).withColumn("status", F.when(F.col("id") % 2 == 0, F.col("status")).otherwise("completed"))
    return cache.usage(v.files(spark, sf_dir), owned)


@query(with_views("files", "tasks") + f", {_USAGE} SELECT * FROM usage")
def cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


@query(with_views("files", "tasks") + f", {_USAGE} SELECT namespace FROM usage WHERE tasks = 0 AND namespace NOT LIKE 'y-%'")
def orphan_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = v.files(spark, sf_dir)
    return cache.orphan_namespaces(files, _owned(spark, sf_dir), files.where("namespace LIKE 'y-%'").select("namespace").distinct())


@query(
    with_views("files", "tasks")
    + f""", {_USAGE}, able AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY CASE WHEN tasks = 0 THEN 0 ELSE 1 END, bytes DESC, namespace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM usage WHERE NOT active)
    SELECT namespace, bytes, CAST(before AS BIGINT) AS freed_before FROM able WHERE (SELECT sum(bytes) FROM usage) - before > 800000000"""
)
def evict_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.eviction(_usage(spark, sf_dir), 800_000_000)


_SPANS = f"""{_ALL_PARTS}, rws AS (SELECT region, zoom, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM ranges)"""
#: Pieces of rows between all ends of spans, with the regions that cover each; merged again where they go on.
_PIECES = """cuts AS (SELECT zoom, y, x0 AS cut FROM rws UNION SELECT zoom, y, x1 + 1 FROM rws),
    steps AS (SELECT zoom, y, cut AS a, lead(cut) OVER (PARTITION BY zoom, y ORDER BY cut) - 1 AS b FROM cuts),
    held AS (SELECT s.zoom, s.y, s.a, s.b, r.region FROM steps s JOIN rws r ON r.zoom = s.zoom AND r.y = s.y AND r.x0 <= s.a AND r.x1 >= s.b WHERE s.b IS NOT NULL)"""


@query(
    with_views("regions")
    + f""", {_SPANS}, {_PIECES}, one AS (SELECT zoom, y, a, b, min(region) AS region FROM held GROUP BY zoom, y, a, b HAVING count(DISTINCT region) = 1),
    isl AS (SELECT *, a - sum(b - a + 1) OVER (PARTITION BY region, zoom, y ORDER BY a) + (b - a + 1) AS g FROM one)
    SELECT region, zoom, y, min(a) AS x0, max(b) AS x1 FROM isl GROUP BY region, zoom, y, g"""
)
def exclusive_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = cache.exclusive_runs(spans.row_spans(v.regions(spark, sf_dir), ["region"], 0, 21), "region", ["zoom", "y"])
    return spans.merge_runs(alone, ["region", "zoom", "y"])


@query(
    with_views("regions")
    + f""", {_SPANS}, {_PIECES}, d AS (SELECT zoom, y, a, b FROM held GROUP BY zoom, y, a, b HAVING bool_and(region % 2 = 0)),
    isl AS (SELECT *, a - sum(b - a + 1) OVER (PARTITION BY zoom, y ORDER BY a) + (b - a + 1) AS g FROM d)
    SELECT zoom, y, min(a) AS x0, max(b) AS x1 FROM isl GROUP BY zoom, y, g"""
)
def span_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.row_spans(v.regions(spark, sf_dir), ["region"], 0, 21)
    return spans.subtract(rows.where("region % 2 = 0"), rows.where("region % 2 = 1"), ["zoom", "y"])


@query(
    with_views("regions", "pts")
    + f""", {_SPANS}, p AS (SELECT id, CAST(z AS INT) AS zoom, {sql_tile_x('lon', 'z')} AS x, {sql_tile_y('lat', 'z')} AS y FROM pts, range(0, 22) t(z))
    SELECT id, zoom, x, y FROM p WHERE EXISTS (SELECT 1 FROM rws t WHERE t.zoom = p.zoom AND t.y = p.y AND p.x BETWEEN t.x0 AND t.x1)"""
)
def points_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.points_in_spans(tiles_of(v.dealt(v.points(spark, sf_dir), "id")), spans.row_spans(v.regions(spark, sf_dir), ["region"], 0, 21))


@query(
    with_views("obs", "files")
    + f""", {_LAST}, w AS (SELECT DISTINCT task, (['m', 's', 'y', 't'])[task % 4 + 1] || '-' || substr(md5(CAST(task % 12 AS VARCHAR)), 1, 8) AS namespace, zoom, x, y FROM obs),
    c AS (SELECT DISTINCT namespace, zoom, x, y, true AS cached FROM files),
    j AS (SELECT w.*, coalesce(cached, false) AS hit, outcome FROM w LEFT JOIN c USING (namespace, zoom, x, y) LEFT JOIN (SELECT * FROM lastobs WHERE outcome <> 'success') l USING (task, zoom, x, y))
    SELECT task, namespace, zoom, x, y, CASE WHEN hit THEN 'hit' ELSE 'pending' END AS state, hit AND outcome IS NOT NULL AS stale, NOT hit AND coalesce(outcome IN ('retryable_failure', 'cache_failure'), false) AS retry FROM j"""
)
def cache_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.element_at(F.array(*map(F.lit, "msyt")), (F.col("task") % 4 + 1).cast("int"))
    namespace = F.concat_ws("-", style, F.substring(F.md5((F.col("task") % 12).cast("string")), 1, 8))
    wanted = v.observations(spark, sf_dir).select("task", namespace.alias("namespace"), "zoom", "x", "y").distinct()
    gaps = _ledger(spark, sf_dir).where(ledger.is_gap(F.col("outcome")))
    return ledger.reconcile(wanted, v.files(spark, sf_dir), gaps, ["zoom", "x", "y"], ["namespace"])


@query(
    with_views("files")
    + """SELECT namespace, zoom, count(*) AS tiles, min(x) AS min_x, max(x) AS max_x, CAST(pow(2, zoom) AS BIGINT) - 1 - max(y) AS min_tms, CAST(pow(2, zoom) AS BIGINT) - 1 - min(y) AS max_tms,
    round(min(x) / pow(2, zoom) * 360 - 180, 6) AS west, round((max(x) + 1) / pow(2, zoom) * 360 - 180, 6) AS east FROM files GROUP BY namespace, zoom"""
)
def container_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.files(spark, sf_dir).groupBy("namespace", "zoom").agg(F.count("*").alias("tiles"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    z = F.col("zoom")
    return found.select("namespace", "zoom", "tiles", "min_x", "max_x", grid.tms_row(z, F.col("bottom")).alias("min_tms"), grid.tms_row(z, F.col("top")).alias("max_tms"), F.round(grid.tile_west(F.col("min_x"), z), 6).alias("west"), F.round(grid.tile_west(F.col("max_x") + 1, z), 6).alias("east"))


_BYTES = "(CASE style WHEN 'm' THEN CASE WHEN zoom <= 6 THEN 8192 WHEN zoom <= 10 THEN 12288 WHEN zoom <= 13 THEN 15360 WHEN zoom <= 16 THEN 18432 ELSE 20480 END WHEN 't' THEN CASE WHEN zoom <= 6 THEN 15360 WHEN zoom <= 10 THEN 25600 WHEN zoom <= 13 THEN 35840 WHEN zoom <= 16 THEN 46080 ELSE 56320 END ELSE CASE WHEN zoom <= 6 THEN 20480 WHEN zoom <= 10 THEN 35840 WHEN zoom <= 13 THEN 56320 WHEN zoom <= 16 THEN 76800 ELSE 97280 END END)"
_ESTIMATE = f"""zz AS (SELECT id, style, output_format, CAST(unnest(range(zoom_min, zoom_max + 1)) AS INT) AS zoom, north, south, east, west FROM tasks WHERE pipeline = 'map'),
    rr AS (SELECT *, (abs({sql_tile_x('east', 'zoom')} - {sql_tile_x('west', 'zoom')}) + 1) * (abs({sql_tile_y('south', 'zoom')} - {sql_tile_y('north', 'zoom')}) + 1) AS tiles FROM zz),
    agg AS (SELECT id, style, output_format, CAST(sum(tiles) AS BIGINT) AS tiles, CAST(sum(tiles * {_BYTES}) AS BIGINT) AS raw,
    CAST(sum(CAST(floor(tiles * 196608 * (CASE style WHEN 'm' THEN 0.35 WHEN 't' THEN 0.6 ELSE 0.9 END)::DOUBLE) AS BIGINT)) AS BIGINT) AS mosaic, max(tiles) AS most FROM rr GROUP BY id, style, output_format),
    est AS (SELECT id, tiles, CAST(floor(raw * (1 - CAST(id % 5 AS DOUBLE) / 10)) AS BIGINT) AS network_bytes,
    CAST(raw + CASE WHEN output_format <> 'tiles_only' THEN mosaic ELSE 0 END + CASE WHEN id % 2 = 0 THEN CAST(floor(raw * 1.05::DOUBLE) AS BIGINT) ELSE 0 END AS BIGINT) AS output_bytes,
    CAST(CASE WHEN output_format <> 'tiles_only' THEN most * 196608 ELSE 0 END AS BIGINT) AS temp_bytes FROM agg)"""


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.tasks(spark, sf_dir).where("pipeline = 'map'")
    zooms = spans.by_zoom(rows).withColumn("r", grid.bbox_tile_range(F.col("north"), F.col("south"), F.col("east"), F.col("west"), F.col("zoom")))
    tiles = (F.col("r.x1") - F.col("r.x0") + 1) * (F.col("r.y1") - F.col("r.y0") + 1)
    return cache.estimate(zooms.select("id", "style", "output_format", "zoom", tiles.alias("tiles"), ((F.col("id") % 5).cast("double") / 10).alias("cached_share"), (F.col("id") % 2 == 0).alias("mbtiles")), ["id"])


@query(with_views("tasks") + f", {_ESTIMATE} SELECT *, network_bytes + output_bytes + temp_bytes AS peak_bytes FROM est")
def task_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir)


@query(
    with_views("tasks")
    + f""", {_ESTIMATE}, q AS (SELECT id, CAST(floor((network_bytes + output_bytes + temp_bytes) * 1.15::DOUBLE) AS BIGINT) AS required FROM est)
    SELECT id, required, greatest(0, required + 2147483648 - greatest(0, 6000000000 + id * 1000 - (id % 7) * 100000000)) AS shortfall FROM q"""
)
def disk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return _estimates(spark, sf_dir).select("id", cache.verdict(F.col("peak_bytes"), 6_000_000_000 + k * 1000, k % 7 * 100_000_000).alias("v")).select("id", "v.required", "v.shortfall")


_STATUS = "(['pending', 'downloading', 'completed', 'skipped', 'failed'])[(l_linenumber + l_orderkey) % 5 + 1]"


@query(f"SELECT l_orderkey AS task, count(*) FILTER (s = 'failed') AS failed_count, count(*) FILTER (s IN ('pending', 'downloading')) AS pending_count, count(*) FILTER (s IN ('completed', 'skipped')) AS done_count FROM (SELECT l_orderkey, {_STATUS} AS s FROM lineitem) GROUP BY l_orderkey")
def file_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, ["pending", "downloading", "completed", "skipped", "failed"]))
    s = F.element_at(states, ((F.col("l_linenumber") + F.col("l_orderkey")) % 5 + 1).cast("int"))
    counts = {"failed_count": ("failed",), "pending_count": ("pending", "downloading"), "done_count": ("completed", "skipped")}
    return v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(*(F.count_if(s.isin(*names)).alias(n) for n, names in counts.items()))


@query("SELECT task, granule, file_id, size FROM (SELECT l_suppkey AS task, l_partkey % 97 AS granule, l_orderkey * 10 + l_linenumber AS file_id, CAST(floor(l_extendedprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 97 ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def keep_first_granule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), (F.col("l_partkey") % 97).alias("granule"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), F.floor("l_extendedprice").cast("long").alias("size"))
    return tasks.keep_first(rows, ["task", "granule"], "file_id")


_GRAD = "CASE WHEN lag(elev) OVER {w} IS NULL THEN (lead(elev) OVER {w} - elev) / {d} WHEN lead(elev) OVER {w} IS NULL THEN (elev - lag(elev) OVER {w}) / {d} ELSE (lead(elev) OVER {w} - lag(elev) OVER {w}) / (2 * {d}) END"


@query(
    with_views("pixels")
    + f""", g AS (SELECT raster, row, col, {_GRAD.format(w="(PARTITION BY raster, row ORDER BY col)", d="100.0::DOUBLE")} AS gx, {_GRAD.format(w="(PARTITION BY raster, col ORDER BY row)", d="(-100.0::DOUBLE)")} AS gy FROM pixels)
    SELECT raster, row, col, round(greatest(0, least(1, (-gx * (cos(radians(-225.0::DOUBLE)) * cos(radians(45.0::DOUBLE))) - gy * (sin(radians(-225.0::DOUBLE)) * cos(radians(45.0::DOUBLE))) + sin(radians(45.0::DOUBLE))) / sqrt(gx * gx + gy * gy + 1) - sin(radians(45.0::DOUBLE)) + 0.5::DOUBLE)), 6) AS shade FROM g"""
)
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.hillshade(v.pixels(spark, sf_dir), dx=100.0, dy=100.0)
    return found.select("raster", "row", "col", F.round("shade", 6).alias("shade"))


@query(with_views("pixels") + "SELECT raster, row // 2 AS row, col // 2 AS col, round(avg(elev), 6) AS elev FROM pixels GROUP BY ALL")
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.overview(v.pixels(spark, sf_dir), 2).select("raster", "row", "col", F.round("elev", 6).alias("elev"))


@query(
    with_views("pixels", "pts")
    + """, s AS (SELECT id, id % (SELECT max(vec_id) + 1 FROM embeddings) AS raster, CAST(id * 37 % 100 AS DOUBLE) / 11 - 0.5::DOUBLE AS x, CAST(id * 53 % 100 AS DOUBLE) / 11 - 0.5::DOUBLE AS y FROM pts),
    c AS (SELECT id, raster, greatest(0, least(6, CAST(floor(x) AS INT))) AS c, greatest(0, least(6, CAST(floor(y) AS INT))) AS r, x, y FROM s),
    f AS (SELECT *, greatest(0, least(1, x - c)) AS fx, greatest(0, least(1, y - r)) AS fy FROM c)
    SELECT f.id, f.raster, round(sum(coalesce(p.elev, 0) * CASE WHEN p.row = f.r THEN 1 - fy ELSE fy END * CASE WHEN p.col = f.c THEN 1 - fx ELSE fx END), 6) AS height
    FROM f JOIN pixels p ON p.raster = f.raster AND p.row IN (f.r, f.r + 1) AND p.col IN (f.c, f.c + 1) GROUP BY f.id, f.raster"""
)
def bilinear_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("id"), v.table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0] or 1
    samples = v.points(spark, sf_dir).select("id", (k % n).alias("raster"), ((k * 37 % 100).cast("double") / 11).alias("px"), ((k * 53 % 100).cast("double") / 11).alias("py"))
    pixels = v.pixels(spark, sf_dir)
    held = samples.join(pixels.select("raster").distinct(), "raster", "left_semi")
    return raster.bilinear(held, pixels, 8, 8).select("id", "raster", F.round("height", 6).alias("height"))


_INTERVAL = "50.0::DOUBLE * ([1, 2, 5])[greatest(0, 14 - zoom) % 3 + 1] * pow(10, greatest(0, 14 - zoom) // 3)"


@query(
    with_views("pixels")
    + f""", e AS (SELECT raster, min(elev) AS lo, max(elev) AS hi FROM pixels GROUP BY raster), z AS (SELECT *, CAST(t.z AS INT) AS zoom FROM e, range(8, 17) t(z)), i AS (SELECT *, {_INTERVAL} AS iv FROM z),
    l AS (SELECT raster, zoom, iv, floor(lo / iv) * iv AS first_level, ceil(hi / iv) * iv AS last_level, hi - lo AS relief FROM i)
    SELECT raster, zoom, iv AS interval, first_level, last_level, CASE WHEN relief < 1e-6 OR CAST(round((last_level - first_level) / iv) AS BIGINT) + 1 > 200 THEN 0 ELSE CAST(round((last_level - first_level) / iv) AS BIGINT) + 1 END AS n_levels FROM l"""
)
def contour_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    relief = v.pixels(spark, sf_dir).groupBy("raster").agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"))
    rows = spans.by_zoom(relief, 8, 16).withColumn("interval", raster.interval_at(F.lit(50.0), F.col("zoom")))
    rows = rows.withColumn("l", raster.contour_levels(F.col("lo"), F.col("hi"), F.col("interval")))
    return rows.select("raster", "zoom", "interval", F.col("l.first").alias("first_level"), F.col("l.last").alias("last_level"), F.col("l.n").alias("n_levels"))


@query(with_views("pixels") + "SELECT raster, bin, count(*) AS n FROM (SELECT raster, CAST((elev >= -100)::INT + (elev >= 0)::INT + (elev >= 50)::INT + (elev >= 200)::INT AS INT) AS bin FROM pixels) GROUP BY ALL")
def hypsometric_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pixels(spark, sf_dir).groupBy("raster", raster.tint_bin(F.col("elev"), [-100.0, 0.0, 50.0, 200.0]).alias("bin")).agg(F.count("*").alias("n"))


@query(
    with_views("pts")
    + """, n AS (SELECT id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM pts),
    p AS (SELECT id, x / (abs(x) + abs(y) + abs(z)) AS px, y / (abs(x) + abs(y) + abs(z)) AS py, z FROM n),
    q AS (SELECT id, CASE WHEN z < 0 THEN (1 - abs(py)) * CASE WHEN px >= 0 THEN 1 ELSE -1 END ELSE px END AS qx, CASE WHEN z < 0 THEN (1 - abs(px)) * CASE WHEN py >= 0 THEN 1 ELSE -1 END ELSE py END AS qy FROM p)
    SELECT id, CAST(floor((greatest(-1, least(1, qx)) * 0.5::DOUBLE + 0.5::DOUBLE) * 255 + 0.5::DOUBLE) AS INT) AS u, CAST(floor((greatest(-1, least(1, qy)) * 0.5::DOUBLE + 0.5::DOUBLE) * 255 + 0.5::DOUBLE) AS INT) AS v FROM q"""
)
def oct_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam, phi = F.radians("lon"), F.radians("lat")
    e = raster.oct_encode(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return v.points(spark, sf_dir).select("id", e.alias("e")).select("id", "e.u", "e.v")


@query(
    """WITH l AS (SELECT l_orderkey AS mesh, l_linenumber * 100000 + l_partkey % 65536 AS pos, CAST(l_partkey % 65536 AS INT) AS v FROM lineitem),
    d AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY mesh ORDER BY pos), 0) AS d FROM l) SELECT mesh, pos, CAST(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS INT) AS code FROM d"""
)
def zigzag_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mesh"), (F.col("l_linenumber") * 100000 + F.col("l_partkey") % 65536).alias("pos"), (F.col("l_partkey") % 65536).cast("int").alias("v"))
    return raster.zigzag_deltas(rows, "mesh", "pos", "v").select("mesh", "pos", "code")




def _sql_rules(column: str, rules: tuple[tuple[str, str], ...]) -> str:
    """Nested regexp_replace calls of redaction rules."""
    for pattern, instead in rules:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{instead.replace('$', chr(92))}', 'g')"
    return column


@query(f"SELECT page_id, 'GET https://***:***@tiles.example.com/' || page_id || '?tk=***&x=1&api_key=*** Bearer *** password = ***; note: ok' AS redacted, {_sql_rules('url', text.URL_RULES)} AS masked_url, {_sql_rules(_sql_rules('html', text.URL_RULES), text.TEXT_RULES)} AS masked_page FROM pages")
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    said = F.concat(F.lit("GET https://user"), k, F.lit(":pw@tiles.example.com/"), k, F.lit("?tk=abc"), k, F.lit("&x=1&api_key=zz Bearer abcd"), k, F.lit(" password = hunter"), k, F.lit("; note: ok"))
    return v.table(spark, sf_dir, "pages").select("page_id", text.redact(said).alias("redacted"), text.mask_url(F.col("url")).alias("masked_url"), text.redact(F.col("html")).alias("masked_page"))


@query(
    """WITH t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations),
    l AS (SELECT conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM t),
    n AS (SELECT *, turn % 3 = 0 AND line_no = 1 AS head, sum((turn % 3 = 0 AND line_no = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn, line_no) AS entry FROM l)
    SELECT conv_id, CAST(entry AS BIGINT) AS entry, max(CASE WHEN head THEN '2024-01-0' || (turn % 9 + 1) || ' 10:00:00' END) AS time, max(CASE WHEN head THEN 'INFO' END) AS level,
    string_agg(CASE WHEN head THEN regexp_replace(line, '^[\\s]+', '') ELSE line END, chr(10) ORDER BY turn, line_no) AS message FROM n WHERE entry > 0 GROUP BY conv_id, entry"""
)
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when((F.col("turn") % 3 == 0) & (F.col("at") == 0), F.concat(F.lit("2024-01-0"), (F.col("turn") % 9 + 1).cast("string"), F.lit(" 10:00:00 INFO "))).otherwise("")
    lines = v.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "said"))
    return text.log_entries(lines.select("conv_id", F.struct("turn", "at").alias("place"), F.concat(head, "said").alias("line")), "conv_id", "place", "line")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || '/{z}/{x}/{y}.png' || CASE WHEN page_id % 4 = 1 THEN '?v=2' ELSE '' END END AS template FROM pages")
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    host = F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0)
    tail = F.when(k % 4 == 0, F.lit("/about")).otherwise(F.concat(F.lit("/"), (k % 20).cast("string"), F.lit("/"), k.cast("string"), F.lit("/"), (k * 7).cast("string"), F.lit(".png"), F.when(k % 4 == 1, "?v=2").otherwise("")))
    return v.table(spark, sf_dir, "pages").select("page_id", text.tile_template(F.concat(host, tail)).alias("template"))


@query("""SELECT n_nationkey AS source, substr(sha256('{"max_zoom":' || (n_nationkey % 22) || ',"name":"' || n_name || '","scheme":"xyz","url_template":"https://t' || n_nationkey || '.example.com/{z}/{x}/{y}"}'), 1, 8) AS fingerprint FROM nation""")
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    record = F.struct((k % 22).alias("max_zoom"), F.col("n_name").alias("name"), F.lit("xyz").alias("scheme"), F.concat(F.lit("https://t"), k.cast("string"), F.lit(".example.com/{z}/{x}/{y}")).alias("url_template"))
    return v.table(spark, sf_dir, "nation").select(k.alias("source"), text.fingerprint(record).alias("fingerprint"))


def shaped(boxes: DataFrame) -> DataFrame:
    """A five-cornered polygon with a square hole in each region's box."""
    at = lambda fx, fy: F.struct((F.col("west") + (F.col("east") - F.col("west")) * fx).alias("lon"), (F.col("south") + (F.col("north") - F.col("south")) * fy).alias("lat"))
    outer = F.array(*(at(*p) for p in ((0.0, 0.0), (1.0, 0.0), (1.0, 0.75), (0.5, 1.0), (0.0, 0.5), (0.0, 0.0))))
    hole = F.array(*(at(*p) for p in ((0.25, 0.25), (0.25, 0.5), (0.5, 0.5), (0.5, 0.25), (0.25, 0.25))))
    return boxes.select("*", F.array(outer, hole).alias("rings"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(v.regions(spark, sf_dir))




@query(
    with_views("regions", "pts")
    + """, e(a, b, c, d) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0, 1, 0.75), (1, 0.75, 0.5, 1), (0.5, 1, 0, 0.5), (0, 0.5, 0, 0), (0.25, 0.25, 0.25, 0.5), (0.25, 0.5, 0.5, 0.5), (0.5, 0.5, 0.5, 0.25), (0.5, 0.25, 0.25, 0.25)),
    g AS (SELECT region, west + (east - west) * a AS x1, south + (north - south) * b AS y1, west + (east - west) * c AS x2, south + (north - south) * d AS y2 FROM regions, e),
    q AS (SELECT id, lon, lat FROM pts UNION ALL SELECT id, lon + 360, lat FROM pts)
    SELECT DISTINCT region, id FROM (SELECT region, id, lon FROM g, q WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY region, id, lon HAVING count(*) % 2 = 1)"""
)
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.points_in_polygons(v.points(spark, sf_dir), _shapes(spark, sf_dir), "region")


@query(
    with_views("regions")
    + """SELECT region, round((east - west) * (north - south) * 0.8125::DOUBLE, 6) AS outer_area, round(-(east - west) * (north - south) * 0.0625::DOUBLE, 6) AS hole_area, CAST(9 AS INT) AS vertices FROM regions"""
)
def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = lambda k: F.round(polygons.ring_area(F.col("rings")[k]), 6)
    return _shapes(spark, sf_dir).select("region", area(0).alias("outer_area"), area(1).alias("hole_area"), polygons.vertex_count(F.col("rings")).alias("vertices"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """65 x 65 heights of each embedding, at level 10; vectors are dealt over the tasks first, being much smaller."""
    rows = v.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double") * 1000).alias("v"))
    dealt = rows.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")
    heights = F.slice(F.flatten(F.array_repeat("v", F.ceil(F.lit(65 * 65) / F.size("v")).cast("int"))), 1, 65 * 65)
    return dealt.select(F.lit(10).alias("level"), (F.col("vec_id") % 2048).alias("x"), (F.floor(F.col("vec_id") / 2048) % 1024).alias("y"), heights.alias("heights"))


@query(
    """WITH h AS (SELECT vec_id, unnest(range(0, 4225)) AS i, embedding AS e FROM embeddings), g AS (SELECT vec_id, i, e[i % len(e) + 1]::DOUBLE * 1000 AS h FROM h),
    q AS (SELECT *, floor((h - min(h) OVER w) / (max(h) OVER w - min(h) OVER w) * 32767 + 0.5::DOUBLE) AS q FROM g WINDOW w AS (PARTITION BY vec_id))
    SELECT CAST(10 AS INT) AS level, vec_id % 2048 AS x, (vec_id // 2048) % 1024 AS y, min(h) AS low, max(h) AS high, CAST(4225 AS BIGINT) AS vertices, CAST(8192 AS BIGINT) AS triangles,
    CAST(sum(q * (i % 97 + 1)) AS BIGINT) AS places, CAST(8192 * 3 * 2112 AS BIGINT) AS corners, CAST(4 * 65 AS BIGINT) AS edges FROM q GROUP BY vec_id"""
)
def terrain_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as they are read again: heights weighed by their places, triangle corners by their vertices, and the four edges."""
    tiles = terrain.encode_tiles(_blocks(spark, sf_dir))

    def read(batches):
        weight = np.arange(65 * 65) % 97 + 1
        for batch in batches:
            sums = []
            for data in batch.column("tile").to_pylist():
                out = terrain.decode(gzip.decompress(data))
                at = np.round((1 - out["v"] / 32767) * 64).astype(int) * 65 + np.round(out["u"] / 32767 * 64).astype(int)
                sums.append((int((out["h"] * weight[at]).sum()), int(at[out["triangles"]].sum()), sum(len(e) for e in out["edges"])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([s[i] for s in sums], pa.int64()) for i in range(3))], [*kept, "places", "corners", "edges"])

    kept = [c for c in tiles.columns if c != "tile"]
    return tiles.mapInArrow(read, "level int, x long, y long, low double, high double, vertices long, triangles long, places long, corners long, edges long")


@query(
    """WITH t AS (SELECT DISTINCT CAST(6 + l_linenumber % 6 AS INT) AS level, (l_partkey * 31) % 64 AS x, (l_suppkey * 17) % 32 AS y FROM lineitem),
    r AS (SELECT *, x - row_number() OVER (PARTITION BY level, y ORDER BY x) AS g FROM t), s AS (SELECT level, y, min(x) AS a, max(x) AS b FROM r GROUP BY level, y, g)
    SELECT level, count(*) AS runs, string_agg(a || ',' || y || ',' || b || ',' || y, ';' ORDER BY a, y, b) AS ranges FROM s GROUP BY level"""
)
def layer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").select((6 + F.col("l_linenumber") % 6).cast("int").alias("level"), (F.col("l_partkey") * 31 % 64).alias("x"), (F.col("l_suppkey") * 17 % 32).alias("y"))
    text_of = F.array_join(F.transform("ranges", lambda r: F.concat_ws(",", r.startX, r.startY, r.endX, r.endY)), ";")
    return terrain.layer_availability(rows).select("level", F.size("ranges").cast("long").alias("runs"), text_of.alias("ranges"))


_RULES = "r(key, low, high, whole) AS (VALUES ('concurrency', 1, 50, true), ('speed_limit', 0, 1000, false), ('zoom', 0, 21, true))"


@query(
    f"""WITH {_RULES}, c AS (SELECT event_id, (['concurrency', 'speed_limit', 'zoom', 'colour'])[event_id % 4 + 1] AS key, CASE WHEN event_id % 11 = 0 THEN 'abc' ELSE CAST(CAST(event_id % 60 AS DOUBLE) / (1 + event_id % 2) AS VARCHAR) END AS value FROM events)
    SELECT event_id, c.key, CASE WHEN r.key IS NULL THEN 'unknown' WHEN try_cast(value AS DOUBLE) IS NULL THEN 'not_a_number' WHEN whole AND try_cast(value AS DOUBLE) <> floor(try_cast(value AS DOUBLE)) THEN 'not_whole'
    WHEN try_cast(value AS DOUBLE) NOT BETWEEN low AND high THEN 'out_of_range' ELSE 'ok' END AS verdict FROM c LEFT JOIN r ON c.key = r.key"""
)
def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 11 == 0, "abc").otherwise(((k % 60).cast("double") / (1 + k % 2)).cast("string"))
    entries = v.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, ["concurrency", "speed_limit", "zoom", "colour"])), (k % 4 + 1).cast("int")).alias("key"), value.alias("value"))
    rules = spark.createDataFrame([("concurrency", 1, 50, True), ("speed_limit", 0, 1000, False), ("zoom", 0, 21, True)], "key string, low int, high int, whole boolean")
    return config.check(entries, rules).select("event_id", "key", "verdict")


@query(
    """SELECT page_id, CAST(page_id % 360 - 180 AS DOUBLE) AS west, CAST(page_id % 170 - 85 AS DOUBLE) AS south, CAST(page_id % 360 - 179 AS DOUBLE) AS east, CAST(page_id % 170 - 84 AS DOUBLE) AS north, 'place ' || page_id AS name FROM pages WHERE page_id % 5 <> 4"""
)
def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in three shapes: GeoJSON bbox of four or six numbers, and [south, north, west, east] strings."""
    k = F.col("page_id")
    w, s = k % 360 - 180, k % 170 - 85
    four = F.format_string('{"features":[{"bbox":[%d,%d,%d,%d],"properties":{"name":"place %d"}}]}', w, s, w + 1, s + 1, k)
    six = F.format_string('{"features":[{"bbox":[%d,%d,0,%d,%d,9],"properties":{"name":"place %d"}}]}', w, s, w + 1, s + 1, k)
    nominatim = F.format_string('[{"boundingbox":["%d","%d","%d","%d"],"display_name":"place %d"}]', s, s + 1, w, w + 1, k)
    answer = F.when(k % 5 == 0, four).when(k % 5 == 1, six).when(k % 5 == 4, F.lit("{}")).otherwise(nominatim)
    return config.geocoded(v.table(spark, sf_dir, "pages").select("page_id", answer.alias("answer")), "answer").select("page_id", "west", "south", "east", "north", "name")
