"""Queries over jobs: estimates of each pipeline, cost checks, URLs and names, migrations, completeness; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespan.functions import text
from tilespan.operators import cache, config, spans, tasks
from tilespan.plans import views as v
from tilespan.plans.catalogue import _PARTS, query, terrain_tile_ranges
from tilespan.plans.catalogue import ORACLES as _ORACLES
from tilespan.plans.views import with_views


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 40 AS n, CAST(floor(o_totalprice) AS BIGINT) * 1000 AS src, o_orderkey % 3 AS k FROM orders),
    d AS (SELECT *, n * CASE WHEN k = 0 THEN 26214400 ELSE 47185920 END AS dem, CASE WHEN k <> 1 THEN CAST(floor(src * CASE WHEN k = 0 THEN 1.9::DOUBLE ELSE 0.78::DOUBLE END) AS BIGINT) ELSE 0 END AS tt,
    CAST(floor(src * 0.45::DOUBLE) AS BIGINT) AS tout, CAST(floor(src * 1.2::DOUBLE * (4.0::DOUBLE / 3.0::DOUBLE)) AS BIGINT) AS ct, n * 49152 AS cout FROM o)
    SELECT id, dem * 2 AS dem_peak, tt AS terrain_temp, tt + tout AS terrain_peak, ct AS contour_temp, ct + cout AS contour_peak FROM d"""
)
def pipeline_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).alias("n"), (F.floor("o_totalprice").cast("long") * 1000).alias("src"), (F.col("o_orderkey") % 3).alias("k"))
    k = F.col("k")
    made = rows.select("id", cache.dem_estimate(F.col("n"), F.when(k == 0, "ASTGTM.003").otherwise("COP-DEM-GLO-30")).alias("d"), cache.terrain_estimate(F.col("src"), k == 0, k != 1).alias("t"), cache.contour_estimate(F.col("src"), F.col("n")).alias("c"))
    return made.select("id", F.col("d.peak").alias("dem_peak"), F.col("t.temp").alias("terrain_temp"), F.col("t.peak").alias("terrain_peak"), F.col("c.temp").alias("contour_temp"), F.col("c.peak").alias("contour_peak"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS raw, 1 + o_orderkey % 90 AS total, o_orderkey % 120 AS done FROM orders),
    r AS (SELECT *, CAST(total - least(done, total) AS DOUBLE) / total AS part FROM o),
    b AS (SELECT id, CAST(floor(raw * part) AS BIGINT) AS network_bytes, CAST(floor((raw + raw // 2) * part) AS BIGINT) + 1000 AS output_bytes FROM r)
    SELECT *, network_bytes + output_bytes + 500 AS peak_bytes FROM b"""
)
def remaining_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, raw = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    r = cache.remaining(raw, raw, F.floor(raw / 2).cast("long"), F.lit(1000).cast("long"), F.lit(500).cast("long"), 1 + k % 90, k % 120)
    return v.table(spark, sf_dir, "orders").select(k.alias("id"), r.alias("r")).select("id", F.col("r.network").alias("network_bytes"), F.col("r.output").alias("output_bytes"), F.col("r.peak").alias("peak_bytes"))


@query(
    with_views("regions")
    + f""", {_PARTS}, s AS (SELECT region, CAST(sum((y1 - y0 + 1) * (x1 - x0 + 1)) AS BIGINT) AS box_tiles, CAST(sum(y1 - y0 + 1) AS BIGINT) AS scan_rows FROM ranges GROUP BY region)
    SELECT *, CASE WHEN region * 50000 > 1000000 THEN 'vertices' WHEN box_tiles > 20000 THEN 'tiles' WHEN region * 50000 * scan_rows > 20000000 THEN 'work' END AS refused FROM s"""
)
def preflight_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spans.box_ranges(v.regions(spark, sf_dir), 0, 12)
    return cache.preflight(ranges, ["region"], F.col("region") * 50000, most_tiles=20_000)


@query(with_views("obs") + "SELECT task, zoom, x, y, 'https://' || (['a', 'b', 'c'])[(x + y) % 3 + 1] || '.example.com/' || zoom || '/' || x || '/' || y || '.png' AS url FROM obs")
def tile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.observations(spark, sf_dir)
    url = text.tile_url(F.lit("https://{s}.example.com/{z}/{x}/{y}.png"), F.col("zoom"), F.col("x"), F.col("y"), ["a", "b", "c"], F.col("x") + F.col("y"))
    return rows.select("task", "zoom", "x", "y", url.alias("url"))


@query(r"""WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '../' || p_name || '?' WHEN 1 THEN ' .. ' WHEN 2 THEN p_name || ':' || p_brand ELSE p_name END AS name FROM part),
    c AS (SELECT id, trim(replace(regexp_replace(name, '[\\/:*?"<>|]+', '_', 'g'), '..', '_'), ' ._') AS name FROM n) SELECT id, CASE WHEN name = '' THEN 'task' ELSE name END AS name FROM c""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 4 == 0, F.concat(F.lit("../"), name, F.lit("?"))).when(k % 4 == 1, F.lit(" .. ")).when(k % 4 == 2, F.concat(name, F.lit(":"), F.col("p_brand"))).otherwise(name)
    return v.table(spark, sf_dir, "part").select(k.alias("id"), text.safe_name(raw).alias("name"))


@query(with_views("files") + "SELECT category, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM (SELECT CASE WHEN x % 10 = 0 THEN '' ELSE namespace END AS category, bytes FROM files) GROUP BY ROLLUP (category)")
def cache_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("x") % 10 == 0, F.lit("loose.txt")).otherwise(F.concat_ws("/", "namespace", "zoom", "x", "y"))
    return cache.by_category(v.files(spark, sf_dir).select(path.alias("path"), "bytes"))


@query(with_views("tasks") + "SELECT id, CASE WHEN id % 50 = 0 THEN 'failed' WHEN status = 'running' THEN 'paused' WHEN status = 'retrying' THEN 'pending_decision' ELSE status END AS status FROM tasks")
def migrated_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = v.tasks(spark, sf_dir).withColumn("status", F.when(F.col("id") % 50 == 0, "cancelled").otherwise(F.col("status")))
    return tasks.migrated(old).select("id", "status")


@query(_ORACLES["terrain_tile_ranges"].replace("SELECT region, level, x0, x1, y0, y1, cx0 <= cx1 AND cy0 <= cy1 AS available FROM c", "SELECT level, count(*) AS ranges, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM (SELECT DISTINCT level, x0, x1, y0, y1 FROM c WHERE cx0 <= cx1 AND cy0 <= cy1) GROUP BY level"))
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terrain_tile_ranges(spark, sf_dir).where("available")
    return tasks.available(found.where("region % 2 = 0"), found, ["level", "x0", "x1", "y0", "y1"])


@query(with_views("obs") + "SELECT task, zoom, count(*) AS tiles, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS needed, count(*) = (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS complete FROM (SELECT DISTINCT task, zoom, x, y FROM obs WHERE outcome = 'success') GROUP BY task, zoom")
def mosaic_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.mosaic_complete(v.observations(spark, sf_dir).where("outcome = 'success'"), ["task", "zoom"])


@query("SELECT c_mktsegment || (c_custkey % 200) AS key, CAST(max(c_custkey) AS VARCHAR) AS value FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT key, 'default' FROM (SELECT DISTINCT c_mktsegment || (c_custkey % 200) AS key FROM customer) d WHERE key NOT IN (SELECT c_mktsegment || (c_custkey % 200) FROM customer WHERE c_custkey % 2 = 0)")
def config_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("c_mktsegment", (F.col("c_custkey") % 200).cast("string")).alias("key")
    rows = v.table(spark, sf_dir, "customer")
    entries = rows.where("c_custkey % 2 = 0").groupBy(key).agg(F.max("c_custkey").cast("string").alias("value"))
    return config.with_defaults(entries, rows.select(key).distinct().withColumn("value", F.lit("default")))
