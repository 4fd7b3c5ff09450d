"""Geospatial views of the driver's tables: the same whole-number formulas in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over sixteen tasks a core: a table of few bytes is read by one, however much is made of its rows."""
    return rows.repartition(16 * rows.sparkSession.sparkContext.defaultParallelism, key)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = (F.col("c_custkey") * 7919 % 360000).cast("double") / 1000 - 180
    lat = (F.col("c_custkey") * 104729 % 170000).cast("double") / 1000 - 85
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lon.alias("lon"), lat.alias("lat"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    west = F.when(k % 8 == 7, F.lit(178.5)).otherwise((k * 37 % 340).cast("double") - 170.25)
    south = (k * 23 % 140).cast("double") - 70.25
    rows = table(spark, sf_dir, "nation").select(k.alias("region"), west.alias("west"), south.alias("south"))
    return rows.select("region", "west", (F.col("west") + 2 * (1 + F.col("region") % 5)).alias("east"), "south", (F.col("south") + 2 * (1 + F.col("region") % 3)).alias("north"))


_STATES = ["completed", "failed", "pending", "running", "completed_with_gaps", "paused", "retrying", "pending_decision"]
_PIPES = ["map", "dem", "local_terrain", "contour", "plugin"]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    group = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    state = (group * 5 + F.substring("o_orderpriority", 1, 1).cast("int")) % 8
    total = 10 + k % 90
    half = 0.05 * (1 + k % 7)
    lon, lat = (c * 7919 % 360000).cast("double") / 1000 - 180, (c * 104729 % 170000).cast("double") / 1000 - 85
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, _PIPES)), (k % 5 + 1).cast("int")).alias("pipeline"), F.element_at(F.array(*map(F.lit, _STATES)), (state + 1).cast("int")).alias("status"), F.col("o_orderdate").alias("created_at"),
        (lon - half).alias("west"), (lon + half).alias("east"), (lat - half).alias("south"), (lat + half).alias("north"), (k % 4).cast("int").alias("zoom_min"), (k % 4 + 3 + k % 5).cast("int").alias("zoom_max"),
        F.element_at(F.array(*map(F.lit, "msyt")), (k % 4 + 1).cast("int")).alias("style"), F.element_at(F.array(*map(F.lit, ["both", "tiles_only", "image_only"])), (k % 3 + 1).cast("int")).alias("output_format"), total.alias("total"), F.least(total, k * 7 % 100).alias("downloaded"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile outcomes over time: task, zoom, x, y, outcome, ts, seq."""
    flags = F.concat("l_returnflag", "l_linestatus")
    outcome = F.when(flags == "NO", "success").when(flags == "NF", "no_data").when(flags == "RF", "permanent_failure").when(flags == "AO", "cache_failure").otherwise("retryable_failure")
    rows = table(spark, sf_dir, "lineitem").withColumn("zoom", (6 + F.col("l_linenumber") % 6).cast("int"))
    across = F.expr("shiftleft(1L, zoom)")
    return rows.select(F.col("l_orderkey").alias("task"), "zoom", (F.col("l_partkey") * 31 % across).alias("x"), (F.col("l_suppkey") * 17 % across).alias("y"), outcome.alias("outcome"), F.col("l_shipdate").alias("ts"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"))


def time_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.col("event_type")
    named = F.when(action == "signup", "start").when(action == "view", "pause").when(action == "click", "resume").when(action == "purchase", "complete")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), "ts", named.alias("action")).where("action is not null")


def byte_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task"), "ts", F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("bytes"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached tiles: namespace, zoom, x, y, bytes."""
    style = F.element_at(F.array(*map(F.lit, "msyt")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    namespace = F.concat_ws("-", style, F.substring(F.md5((F.col("l_suppkey") % 12).cast("string")), 1, 8))
    rows = table(spark, sf_dir, "lineitem").withColumn("zoom", (6 + F.col("l_linenumber") % 6).cast("int"))
    across = F.expr("shiftleft(1L, zoom)")
    return rows.select(namespace.alias("namespace"), "zoom", (F.col("l_partkey") * 31 % across).alias("x"), (F.col("l_suppkey") * 17 % across).alias("y"), F.floor("l_extendedprice").cast("long").alias("bytes"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 elevation blocks: raster, row, col, elev."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster"), F.posexplode("embedding").alias("at", "v"))
    return rows.select("raster", F.floor(F.col("at") / 8).cast("int").alias("row"), (F.col("at") % 8).cast("int").alias("col"), F.round(F.col("v").cast("double") * 1000, 3).alias("elev"))


#: The same views in SQL.
CTE = {
    "pts": "pts AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 360000 AS DOUBLE) / 1000 - 180 AS lon, CAST((c_custkey * 104729) % 170000 AS DOUBLE) / 1000 - 85 AS lat FROM customer)",
    "regions": """reg0 AS (SELECT CAST(n_nationkey AS BIGINT) AS region,
        CASE WHEN n_nationkey % 8 = 7 THEN 178.5::DOUBLE ELSE CAST((n_nationkey * 37) % 340 AS DOUBLE) - 170.25::DOUBLE END AS west,
        CAST((n_nationkey * 23) % 140 AS DOUBLE) - 70.25::DOUBLE AS south FROM nation),
        regions AS (SELECT region, west, west + 2 * (1 + region % 5) AS east, south, south + 2 * (1 + region % 3) AS north FROM reg0)""",
    "tasks": """t0 AS (SELECT *, o_orderkey AS k, CAST((o_custkey * 7919) % 360000 AS DOUBLE) / 1000 - 180 AS lon, CAST((o_custkey * 104729) % 170000 AS DOUBLE) / 1000 - 85 AS lat,
        0.05::DOUBLE * (1 + o_orderkey % 7) AS half,
        ((CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 5 + CAST(substr(o_orderpriority, 1, 1) AS INT)) % 8 AS st FROM orders),
        tasks AS (SELECT k AS id, (['map', 'dem', 'local_terrain', 'contour', 'plugin'])[k % 5 + 1] AS pipeline,
        (['completed', 'failed', 'pending', 'running', 'completed_with_gaps', 'paused', 'retrying', 'pending_decision'])[st + 1] AS status,
        o_orderdate AS created_at, lon - half AS west, lon + half AS east, lat - half AS south, lat + half AS north,
        CAST(k % 4 AS INT) AS zoom_min, CAST(k % 4 + 3 + k % 5 AS INT) AS zoom_max, (['m', 's', 'y', 't'])[k % 4 + 1] AS style,
        (['both', 'tiles_only', 'image_only'])[k % 3 + 1] AS output_format, 10 + k % 90 AS total, least(10 + k % 90, (k * 7) % 100) AS downloaded FROM t0)""",
    "obs": """l0 AS (SELECT *, 6 + l_linenumber % 6 AS zoom, l_returnflag || l_linestatus AS f FROM lineitem),
        obs AS (SELECT l_orderkey AS task, zoom, (l_partkey * 31) % (1::BIGINT << zoom) AS x, (l_suppkey * 17) % (1::BIGINT << zoom) AS y,
        CASE f WHEN 'NO' THEN 'success' WHEN 'NF' THEN 'no_data' WHEN 'RF' THEN 'permanent_failure' WHEN 'AO' THEN 'cache_failure' ELSE 'retryable_failure' END AS outcome,
        l_shipdate AS ts, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq FROM l0)""",
    "times": "times AS (SELECT * FROM (SELECT user_id AS task, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'purchase' THEN 'complete' END AS action FROM events) WHERE action IS NOT NULL)",
    "samples": "samples AS (SELECT event_id, user_id AS task, ts, CAST(floor(coalesce(value, 0) * 100) AS BIGINT) AS bytes FROM events)",
    "files": """f0 AS (SELECT *, 6 + l_linenumber % 6 AS zoom FROM lineitem),
        files AS (SELECT (['m', 's', 'y', 't'])[l_suppkey % 4 + 1] || '-' || substr(md5(CAST(l_suppkey % 12 AS VARCHAR)), 1, 8) AS namespace, zoom,
        (l_partkey * 31) % (1::BIGINT << zoom) AS x, (l_suppkey * 17) % (1::BIGINT << zoom) AS y, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM f0)""",
    "pixels": """p0 AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
        pixels AS (SELECT vec_id AS raster, CAST(pos // 8 AS INT) AS row, CAST(pos % 8 AS INT) AS col, round(CAST(v AS DOUBLE) * 1000, 3) AS elev FROM p0)""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(CTE[n] for n in names) + " "


def sql_tile_x(lon: str, z: str) -> str:
    return f"CAST(greatest(0, least(pow(2, {z}) - 1, floor(({lon} + 180) / 360 * pow(2, {z})))) AS BIGINT)"


def sql_tile_y(lat: str, z: str) -> str:
    phi = f"radians(greatest(-85.0511::DOUBLE, least(85.0511::DOUBLE, {lat})))"
    return f"CAST(greatest(0, least(pow(2, {z}) - 1, floor((1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2 * pow(2, {z})))) AS BIGINT)"
