"""Queries over tables of raster blocks: relief, colour, mosaics, overviews, contour lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespan.operators import blocks, contours, pyramid
from tilespan.plans import views as v
from tilespan.plans.catalogue import query

SIDE = 8
_BREAKS, _COLOURS = [-100.0, 0.0, 50.0, 200.0], [(0, 60, 200), (40, 160, 40), (180, 180, 60), (160, 110, 40), (250, 250, 250)]


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred vectors to a raster of 80 x 80 heights, each a block; heights from 260 up are no data."""
    k = F.col("vec_id")
    height = F.transform("embedding", lambda e: F.round(e.cast("double") * 1000, 3))
    data = F.transform(height, lambda e: F.when(e < 260, e).otherwise(float("nan")))
    return v.table(spark, sf_dir, "embeddings").select(F.floor(k / 100).alias("raster"), F.floor(k % 100 / 10).cast("int").alias("brow"), (k % 10).cast("int").alias("bcol"), data.alias("data"))


_BIG = """b0 AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    big AS (SELECT vec_id // 100 AS raster, CAST(vec_id % 100 // 10 * 8 + pos // 8 AS INT) AS row, CAST(vec_id % 10 * 8 + pos % 8 AS INT) AS col, round(CAST(e AS DOUBLE) * 1000, 3) AS elev FROM b0 WHERE round(CAST(e AS DOUBLE) * 1000, 3) < 260)"""


def _sql_slope(before: str, after: str, spacing: str) -> str:
    return f"CASE WHEN {before} IS NULL AND {after} IS NULL THEN 0 WHEN {before} IS NULL THEN ({after} - elev) / {spacing} WHEN {after} IS NULL THEN (elev - {before}) / {spacing} ELSE ({after} - {before}) / (2 * {spacing}) END"


_SHADE = f"""{_BIG}, near AS (SELECT p.*, l.elev AS l, r.elev AS r, u.elev AS u, d.elev AS d FROM big p LEFT JOIN big l ON l.raster = p.raster AND l.row = p.row AND l.col = p.col - 1 LEFT JOIN big r ON r.raster = p.raster AND r.row = p.row AND r.col = p.col + 1
      LEFT JOIN big u ON u.raster = p.raster AND u.row = p.row - 1 AND u.col = p.col LEFT JOIN big d ON d.raster = p.raster AND d.row = p.row + 1 AND d.col = p.col),
    g AS (SELECT raster, row, col, elev, {_sql_slope("l", "r", "90.0::DOUBLE")} AS gx, {_sql_slope("u", "d", "(-90.0::DOUBLE)")} AS gy FROM near),
    shaded AS (SELECT raster, row, col, elev, greatest(0, least(1, (-gx * cos(radians(-225.0::DOUBLE)) * cos(radians(45.0::DOUBLE)) - gy * sin(radians(-225.0::DOUBLE)) * cos(radians(45.0::DOUBLE)) + sin(radians(45.0::DOUBLE))) / sqrt(gx * gx + gy * gy + 1) - sin(radians(45.0::DOUBLE)) + 0.5::DOUBLE)) AS shade FROM g)"""


@query(f"WITH {_SHADE} SELECT raster, row, col, round(shade, 6) AS shade FROM shaded")
def relief_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.to_pixels(blocks.relief(blocks_of(spark, sf_dir), SIDE, dx=90.0, dy=90.0), SIDE, "shade", "shade")
    return found.withColumn("shade", F.round("shade", 6))


def _sql_colour(channel: int) -> str:
    tint = " ".join(f"WHEN elev >= {b} THEN {_COLOURS[i + 1][channel]}" for i, b in reversed(list(enumerate(_BREAKS))))
    c = f"((CASE {tint} ELSE {_COLOURS[0][channel]} END) / 255::DOUBLE)"
    return f"greatest(0, least(1, 2 * shade * {c} + (1 - 2 * shade) * {c} * {c})) * 255"


@query(
    f"""WITH {_SHADE}, wet AS (SELECT vec_id // 100 AS raster, vec_id % 100 // 10 AS brow, vec_id % 10 AS bcol, label % 5 AS kind FROM embeddings WHERE vec_id % 3 = 0),
    c AS (SELECT s.raster, s.row, s.col, coalesce(kind, 0) AS kind, {_sql_colour(0)} AS red, {_sql_colour(1)} AS green, {_sql_colour(2)} AS blue FROM shaded s LEFT JOIN wet w ON w.raster = s.raster AND w.brow = s.row // 8 AND w.bcol = s.col // 8)
    SELECT raster, CAST(row // 8 AS INT) AS brow, CAST(col // 8 AS INT) AS bcol, count(*) FILTER (kind = 1) AS ocean, count(*) FILTER (kind IN (2, 3)) AS inland,
    CAST(coalesce(sum(CAST(floor(red + 0.5) AS BIGINT)) FILTER (kind NOT IN (1, 2, 3)), 0) AS BIGINT) AS red, CAST(coalesce(sum(CAST(floor(green + 0.5) AS BIGINT)) FILTER (kind NOT IN (1, 2, 3)), 0) AS BIGINT) AS green, CAST(coalesce(sum(CAST(floor(blue + 0.5) AS BIGINT)) FILTER (kind NOT IN (1, 2, 3)), 0) AS BIGINT) AS blue
    FROM c GROUP BY ALL"""
)
def painted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour sums of dry pixels and counts of wet ones in blocks of tint, relief and water; a third of the blocks have water of their label's class."""
    k, kind = F.col("vec_id"), (F.col("label") % 5).cast("double")
    wet = v.table(spark, sf_dir, "embeddings").where(k % 3 == 0).select(F.floor(k / 100).alias("raster"), F.floor(k % 100 / 10).cast("int").alias("brow"), (k % 10).cast("int").alias("bcol"), F.array_repeat(kind, SIDE * SIDE).alias("data"))
    # Water lies over no data too; heights say which pixels count.
    given = blocks_of(spark, sf_dir)
    found = blocks.painted(given, SIDE, _BREAKS, _COLOURS, water=wet, ocean=(0, 0, 0, 1), inland=(0, 0, 0, 2), dx=90.0, dy=90.0)
    byte = lambda p, c: F.conv(F.hex(F.substring("rgba", p * 4 + c + 1, 1)), 16, 10).cast("long")
    pixels = found.join(given, ["raster", "brow", "bcol"]).select("raster", "brow", "bcol", "rgba", F.posexplode("data").alias("p", "elev")).where(~F.isnan("elev"))
    parts = pixels.select("raster", "brow", "bcol", *(byte(F.col("p"), i).alias(n) for i, n in enumerate(("red", "green", "blue", "alpha"))))
    return parts.groupBy("raster", "brow", "bcol").agg(F.count_if(F.col("alpha") == 1).alias("ocean"), F.count_if(F.col("alpha") == 2).alias("inland"), *(F.sum(n).alias(n) for n in ("red", "green", "blue")))


@query(
    f"""WITH {_BIG}, placed AS (SELECT raster // 2 AS mosaic, raster % 3 AS rank, raster, row + raster % 2 * 37 - raster % 5 AS y, col + raster % 2 * 29 + raster % 7 AS x, elev FROM big)
    SELECT mosaic AS raster, CAST(y AS INT) AS row, CAST(x AS INT) AS col, arg_min(elev, (rank, raster)) AS elev FROM placed GROUP BY mosaic, y, x"""
)
def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rasters that overlap, at odd pixels, made one."""
    given = blocks_of(spark, sf_dir)
    r = F.col("raster")
    placing = given.select("raster").distinct().select("raster", F.floor(r / 2).alias("mosaic"), (r % 2 * 37 - r % 5).alias("top"), (r % 2 * 29 + r % 7).alias("left"), (r % 3).alias("rank"))
    return blocks.to_pixels(blocks.mosaic(given, placing, SIDE), SIDE)


@query(
    f"""WITH {_BIG} SELECT CAST(level AS INT) AS level, raster, CAST(row // CAST(pow(2, level) AS INT) AS INT) AS row, CAST(col // CAST(pow(2, level) AS INT) AS INT) AS col, round(avg(elev) + 1.23e-8::DOUBLE, 6) AS elev
    FROM big, (SELECT unnest(range(1, 5)) AS level) GROUP BY ALL"""
)
def overview_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overviews of each raster down to five pixels."""
    found = blocks.ladder(blocks_of(spark, sf_dir), SIDE, least=5)
    flat = found.select(F.struct("level", "raster").alias("raster"), "brow", "bcol", "data")
    return blocks.to_pixels(flat, SIDE).select("raster.level", "raster.raster", "row", "col", F.round(F.col("elev") + 1.23e-8, 6).alias("elev"))  # off the ties of rounding


#: Crossings of sides between pixel centres that belong to a cell with four heights.
_CROSSED = f"""{_BIG}, cell AS (SELECT a.raster, a.row, a.col, a.elev AS tl, b.elev AS tr, c.elev AS bl, d.elev AS br FROM big a JOIN big b ON b.raster = a.raster AND b.row = a.row AND b.col = a.col + 1
      JOIN big c ON c.raster = a.raster AND c.row = a.row + 1 AND c.col = a.col JOIN big d ON d.raster = a.raster AND d.row = a.row + 1 AND d.col = a.col + 1),
    levels AS (SELECT *, unnest(range(CAST(floor(least(tl, tr, bl, br) / 75) AS BIGINT), CAST(ceil(greatest(tl, tr, bl, br) / 75) AS BIGINT) + 1)) * 75.0::DOUBLE AS lv FROM cell),
    side AS (SELECT raster, row, col, lv, unnest([{{'k': 0, 'r': row, 'c': col, 'a': tl, 'b': tr}}, {{'k': 0, 'r': row + 1, 'c': col, 'a': bl, 'b': br}}, {{'k': 1, 'r': row, 'c': col, 'a': tl, 'b': bl}}, {{'k': 1, 'r': row, 'c': col + 1, 'a': tr, 'b': br}}]) AS s FROM levels),
    crossed AS (SELECT raster, row, col, lv, s.k, s.r, s.c, s.c + 0.5::DOUBLE + CASE WHEN s.k = 0 THEN (lv - s.a) / (s.b - s.a) ELSE 0 END AS x, s.r + 0.5::DOUBLE + CASE WHEN s.k = 1 THEN (lv - s.a) / (s.b - s.a) ELSE 0 END AS y FROM side WHERE (s.a > lv) <> (s.b > lv)),
    node AS (SELECT raster, lv, k, r, c, any_value(x) AS x, any_value(y) AS y, count(*) AS cells FROM crossed GROUP BY raster, lv, k, r, c)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contours.contours(blocks_of(spark, sf_dir), SIDE, 75.0, 2)


@query(f"WITH {_CROSSED} SELECT raster, lv AS level, CAST(lv AS BIGINT) % 150 = 0 AS is_index, round(x, 6) AS x, round(y, 6) AS y FROM node")
def contour_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where contour lines pass between pixel centres; those in a block and its neighbour count once, and two sides crossed at one place count twice."""
    path = F.arrays_zip("xs", "ys", "nodes")
    points = _pieces(spark, sf_dir).select("raster", "level", "is_index", F.inline(path)).dropDuplicates(["raster", "level", "nodes"])
    return points.select("raster", "level", "is_index", F.round("xs", 6).alias("x"), F.round("ys", 6).alias("y"))


@query(
    f"""WITH {_CROSSED}, saddle AS (SELECT l.*, (tl > lv AND br > lv AND NOT tr > lv AND NOT bl > lv) OR (tr > lv AND bl > lv AND NOT tl > lv AND NOT br > lv) AS two, ((tl + tr + bl + br) / 4 > lv) = (tl > lv) AS turned FROM levels l),
    four AS (SELECT s.*, t.x AS tx, t.y AS ty, b.x AS bx, b.y AS "by", l.x AS lx, l.y AS ly, r.x AS rx, r.y AS ry FROM saddle s
      LEFT JOIN node t ON t.raster = s.raster AND t.lv = s.lv AND t.k = 0 AND t.r = s.row AND t.c = s.col LEFT JOIN node b ON b.raster = s.raster AND b.lv = s.lv AND b.k = 0 AND b.r = s.row + 1 AND b.c = s.col
      LEFT JOIN node l ON l.raster = s.raster AND l.lv = s.lv AND l.k = 1 AND l.r = s.row AND l.c = s.col LEFT JOIN node r ON r.raster = s.raster AND r.lv = s.lv AND r.k = 1 AND r.r = s.row AND r.c = s.col + 1),
    seg AS (SELECT raster, lv, CASE WHEN NOT two THEN sqrt(pow(list_max(xs) - list_min(xs), 2) + pow(list_max(ys) - list_min(ys), 2))
        WHEN turned THEN sqrt(pow(tx - rx, 2) + pow(ty - ry, 2)) + sqrt(pow(bx - lx, 2) + pow("by" - ly, 2)) ELSE sqrt(pow(tx - lx, 2) + pow(ty - ly, 2)) + sqrt(pow(bx - rx, 2) + pow("by" - ry, 2)) END AS len
      FROM (SELECT *, list_filter([tx, bx, lx, rx], lambda v: v IS NOT NULL) AS xs, list_filter([ty, "by", ly, ry], lambda v: v IS NOT NULL) AS ys FROM four) WHERE len(xs) > 0),
    n AS (SELECT raster, lv, count(*) AS points, count(*) FILTER (cells = 1) // 2 AS open_lines FROM node GROUP BY raster, lv)
    SELECT raster, lv AS level, points, open_lines, round(sum(len), 4) AS length FROM seg JOIN n USING (raster, lv) GROUP BY raster, lv, points, open_lines"""
)
def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, open lines and length (pixels) of each level's contours, joined over the blocks of a raster."""
    found = contours.lines(_pieces(spark, sf_dir))
    return found.groupBy("raster", "level").agg(F.sum("points").alias("points"), F.count_if(~F.col("closed")).alias("open_lines"), F.round(F.sum("length"), 4).alias("length"))


def placed(given: DataFrame) -> DataFrame:
    """Where the rasters of blocks lie: 0.01 degrees a pixel, 80 x 80."""
    r = F.col("raster")
    return given.select("raster").distinct().select("raster", (10.0031 + r % 30 * 1.37).alias("west"), (47.0213 - r % 20 * 0.83).alias("north"), F.lit(0.01).alias("pixel"), F.lit(80).alias("rows"), F.lit(80).alias("cols"))


def _sql_vertices(n: int, low: int, high: int) -> str:
    """Common tables down to vertex (raster, z, x, y, i, j, h): the heights of each tile's vertices, i from the north."""
    m = n - 1
    return f"""{_BIG}, facts AS (SELECT DISTINCT raster, 10.0031::DOUBLE + raster % 30 * 1.37::DOUBLE AS west, 47.0213::DOUBLE - raster % 20 * 0.83::DOUBLE AS north FROM big),
    lev AS (SELECT *, 180::DOUBLE / (1 << z) AS step FROM facts, (SELECT unnest(range({low}, {high + 1})) AS z)),
    k AS (SELECT *, CAST(greatest(0, floor(log2(step / {m} / 0.01::DOUBLE))) AS INT) AS k FROM lev),
    px AS (SELECT k.k, big.raster, row // (1 << k.k) AS r, col // (1 << k.k) AS c, avg(elev) AS e FROM big, (SELECT DISTINCT k FROM k) k GROUP BY ALL),
    tile AS (SELECT *, unnest(range(CAST(floor((west + 180) / step) AS BIGINT), CAST(ceil((west + 0.8::DOUBLE + 180) / step) AS BIGINT))) AS x FROM k),
    tiles AS (SELECT *, unnest(range(CAST(floor((north - 0.8::DOUBLE + 90) / step) AS BIGINT), CAST(ceil((north + 90) / step) AS BIGINT))) AS y FROM tile),
    spot AS (SELECT raster, z, k, x, y, i, j, (north - (-90 + y * step + ({m} - i) * (step / {m}))) / 0.01::DOUBLE / (1 << k) - 0.5::DOUBLE AS pr, ((-180 + x * step + j * (step / {m})) - west) / 0.01::DOUBLE / (1 << k) - 0.5::DOUBLE AS pc
      FROM tiles, (SELECT unnest(range(0, {n})) AS i) a, (SELECT unnest(range(0, {n})) AS j) b),
    cellof AS (SELECT *, CAST(greatest(0, least(floor(pr), 80 // (1 << k) - 2)) AS BIGINT) AS r, CAST(greatest(0, least(floor(pc), 80 // (1 << k) - 2)) AS BIGINT) AS c FROM spot),
    vertex AS (SELECT s.raster, z, x, y, i, j, greatest(0, least(1, pr - s.r)) AS fy, greatest(0, least(1, pc - s.c)) AS fx,
      coalesce((a.e * (1 - greatest(0, least(1, pc - s.c))) + b.e * greatest(0, least(1, pc - s.c))) * (1 - greatest(0, least(1, pr - s.r))) + (d.e * (1 - greatest(0, least(1, pc - s.c))) + f.e * greatest(0, least(1, pc - s.c))) * greatest(0, least(1, pr - s.r)), 0) AS h
      FROM cellof s LEFT JOIN px a ON a.k = s.k AND a.raster = s.raster AND a.r = s.r AND a.c = s.c LEFT JOIN px b ON b.k = s.k AND b.raster = s.raster AND b.r = s.r AND b.c = s.c + 1
      LEFT JOIN px d ON d.k = s.k AND d.raster = s.raster AND d.r = s.r + 1 AND d.c = s.c LEFT JOIN px f ON f.k = s.k AND f.raster = s.raster AND f.r = s.r + 1 AND f.c = s.c + 1)"""


@query(
    f"""WITH {_sql_vertices(17, 8, 10)} SELECT raster, CAST(z AS INT) AS level, x, y, CAST(i AS INT) AS row, CAST(j AS INT) AS col,
    CAST(floor((h - min(h) OVER w) / CASE WHEN max(h) OVER w > min(h) OVER w THEN max(h) OVER w - min(h) OVER w ELSE 1 END * 32767 + 0.5::DOUBLE) AS INT) AS q FROM vertex WINDOW w AS (PARTITION BY raster, z, x, y)"""
)
def terrain_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heights, as fractions of 32767, that the tiles of three levels hold when they are read again; two levels sample overviews."""
    given = blocks_of(spark, sf_dir)
    found = pyramid.decoded(pyramid.pyramid(given, placed(given), SIDE, 8, 10, 17), 17)
    return found.select("raster", "level", "x", "y", F.posexplode("q").alias("at", "q")).select("raster", "level", "x", "y", F.floor(F.col("at") / 17).cast("int").alias("row"), (F.col("at") % 17).cast("int").alias("col"), "q")


@query(
    f"""WITH {_sql_vertices(65, 9, 11)}, t AS (SELECT raster, z, x, y, min(h) AS low, max(h) AS high FROM vertex GROUP BY ALL)
    SELECT raster, CAST(z AS INT) AS level, count(*) AS tiles, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(sum(low), 6) AS low, round(sum(high), 6) AS high, CAST(count(*) * 4225 AS BIGINT) AS vertices, CAST(count(*) * 8192 AS BIGINT) AS triangles FROM t GROUP BY raster, z"""
)
def terrain_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pyramids of 65 x 65 tiles hold by level."""
    given = blocks_of(spark, sf_dir)
    found = pyramid.pyramid(given, placed(given), SIDE, 9, 11)
    ends = [f("x" if n[0] == "x" else "y").alias(n) for n, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))]
    return found.groupBy("raster", "level").agg(F.count("*").alias("tiles"), *ends, *(F.round(F.sum(c), 6).alias(c) for c in ("low", "high")), F.sum("vertices").alias("vertices"), F.sum("triangles").alias("triangles"))
