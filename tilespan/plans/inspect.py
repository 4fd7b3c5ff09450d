"""Queries over raster headers, boxes, values, hosts, URLs and task changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespan.functions import addresses, grid, rules
from tilespan.operators import config, headers, ledger, tasks, wizard
from tilespan.plans import views as v
from tilespan.plans.catalogue import _ledger, query
from tilespan.plans.views import sql_tile_x, sql_tile_y, with_views

_X9, _Y9 = sql_tile_x("lon", "9"), sql_tile_y("lat", "9")


@query(
    with_views("pts")
    + f""", t AS (SELECT id, lon, lat, {_X9} AS x, {_Y9} AS y FROM pts), m AS (SELECT *, 40075016.685578488::DOUBLE / 512 AS s FROM t)
    SELECT id, x, y, round(x * s - 20037508.342789244::DOUBLE, 6) AS xmin, round(20037508.342789244::DOUBLE - (y + 1) * s, 6) AS ymin, round(s / 256, 9) AS pixel, round(-180 + 360 * (x % 1024)::DOUBLE / 1024, 9) AS west, round(-90 + 180 * (y + 1)::DOUBLE / 512, 9) AS north,
    round(180::DOUBLE / 512 / 64 * 111320, 6) AS spacing, 'https://t/9/' || x || '/' || y AS probe FROM m"""
)
def tile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents in metres and degrees, pixel and vertex sizes, and a sample URL of the tile under each point."""
    rows = v.points(spark, sf_dir).select("id", grid.tile_x(F.col("lon"), 9).alias("x"), grid.tile_y_asinh(F.col("lat"), 9).alias("y"))
    metres, box = grid.tile_metres(9, F.col("x"), F.col("y")), grid.geographic_extent(9, F.col("x") % 1024, F.col("y"))
    pixel = F.get(grid.tile_geotransform(9, F.col("x"), F.col("y"), 256, 256), F.lit(1))
    probe = F.concat(F.lit("https://t/9/"), F.col("x").cast("string"), F.lit("/"), F.col("y").cast("string"))
    return rows.select("id", "x", "y", F.round(metres.xmin, 6).alias("xmin"), F.round(metres.ymin, 6).alias("ymin"), F.round(pixel, 9).alias("pixel"), F.round(box.west, 9).alias("west"), F.round(box.north, 9).alias("north"), F.round(grid.level_error(9), 6).alias("spacing"), probe.alias("probe"))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header for each part: some by matrix, some by scale and tie point, some projected or broken."""
    k = F.col("p_partkey")
    step = 1 / (F.lit(600.0) + 300 * (k % 5))
    lon, lat = (k * 37 % 340).cast("double") - 170, (k * 23 % 140).cast("double") - 60
    zero = F.lit(0.0)
    matrix = F.when(k % 3 == 0, F.array(step, F.when(k % 9 == 0, 0.00001).otherwise(0.0), zero, lon, zero, -step, zero, lat, *[zero] * 8))
    return v.table(spark, sf_dir, "part").select(
        F.concat(F.lit("dem"), k.cast("string")).alias("name"), k.alias("id"), (k % 50).alias("set"), (k * 1000).alias("size"), F.when(k % 31 == 0, 0).otherwise(3600).cast("long").alias("width"), F.lit(1800).cast("long").alias("height"), (1 + (k % 7 == 0).cast("int")).alias("samples"),
        matrix.alias("transform"), F.when(k % 3 == 1, F.array(step, step, zero)).alias("scale"), F.when(k % 3 == 1, F.array(F.lit(10.0), F.lit(20.0), zero, lon, lat, zero)).alias("tie"),
        F.when(k % 11 == 0, 1).otherwise(2).alias("model"), F.when(k % 22 == 0, 32767).when(k % 11 == 0, 32650).cast("int").alias("projected"), F.lit(4326).alias("geographic"),
    )


_HEADERS = """h AS (SELECT p_partkey AS id, p_partkey % 50 AS set, p_partkey * 1000 AS size, p_partkey % 31 <> 0 AS readable, 1 / (600::DOUBLE + 300 * (p_partkey % 5)) AS step, CAST(p_partkey * 37 % 340 AS DOUBLE) - 170 AS lon, CAST(p_partkey * 23 % 140 AS DOUBLE) - 60 AS lat FROM part),
    g AS (SELECT *, readable AND id % 3 <> 2 AS has_gt, CASE WHEN NOT readable THEN NULL WHEN id % 22 = 0 THEN NULL WHEN id % 11 = 0 THEN 32650 ELSE 4326 END AS epsg, CASE WHEN id % 3 = 0 THEN lon ELSE lon - 10 * step END AS ox, CASE WHEN id % 3 = 0 THEN lat ELSE lat + 20 * step END AS oy,
      CASE WHEN id % 9 = 0 THEN 0.00001::DOUBLE ELSE 0 END AS rot FROM h),
    r AS (SELECT *, has_gt AND epsg IS NOT NULL AS placed, has_gt AND coalesce(epsg = 4326, false) AS plain FROM g),
    rec AS (SELECT id, set, size, epsg, CASE WHEN placed THEN ox END AS west, CASE WHEN placed THEN ox + 3600 * step + 1800 * rot END AS east, CASE WHEN placed THEN oy - 1800 * step END AS south, CASE WHEN placed THEN oy END AS north, CASE WHEN plain THEN step END AS pixel_deg,
      CASE WHEN plain THEN CAST(greatest(0, ceil(log2(2.8125::DOUBLE / step))) AS INT) END AS lvl, CASE WHEN plain THEN CAST(least(21, ceil(log2(156543.03392::DOUBLE / (step * 111320))) + 1) AS INT) END AS max_zoom,
      concat_ws(',', CASE WHEN NOT readable THEN 'header_unreadable' END, CASE WHEN readable AND id % 7 = 0 THEN 'multi_band' END, CASE WHEN readable AND NOT has_gt THEN 'no_georeference' WHEN readable AND epsg IS NULL THEN 'unknown_crs' END, CASE WHEN placed AND rot <> 0 THEN 'rotated' END, CASE WHEN placed AND NOT plain THEN 'crs_unresolved' END) AS warnings FROM r)"""


@query(f"WITH {_HEADERS} SELECT id, CAST(epsg AS INT) AS epsg, round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east, round(north, 9) AS north, round(pixel_deg, 12) AS pixel_deg, lvl AS max_level, CASE WHEN lvl IS NOT NULL THEN least(21, lvl + 1) END AS level_precision, CASE WHEN lvl IS NOT NULL THEN greatest(0, lvl - 1) END AS level_speed, max_zoom, warnings FROM rec")
def raster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headers.records(_headers(spark, sf_dir))
    sides = [F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")]
    return rows.select("id", "epsg", *sides, F.round("pixel_deg", 12).alias("pixel_deg"), "max_level", "level_precision", "level_speed", "max_zoom", F.array_join("warnings", ",").alias("warnings"))


_SUMS = f"""{_HEADERS}, up AS (SELECT *, CASE WHEN west < 0 THEN west + 360 ELSE west END AS uw, CASE WHEN east < 0 THEN east + 360 ELSE east END AS ue FROM rec),
    s AS (SELECT set, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, min(west) FILTER (pixel_deg IS NOT NULL) AS w, max(east) FILTER (pixel_deg IS NOT NULL) AS e, min(uw) FILTER (pixel_deg IS NOT NULL) AS nw, max(ue) FILTER (pixel_deg IS NOT NULL) AS ne,
      min(least(uw, ue)) FILTER (pixel_deg IS NOT NULL) AS ul, max(greatest(uw, ue)) FILTER (pixel_deg IS NOT NULL) AS uh, min(south) FILTER (pixel_deg IS NOT NULL) AS south, max(north) FILTER (pixel_deg IS NOT NULL) AS north, min(pixel_deg) AS pixel_deg, max(lvl) AS max_level, count(DISTINCT epsg) AS systems,
      bool_or(regexp_matches(warnings, 'no_georeference|unknown_crs|header_unreadable')) AS bad FROM up GROUP BY set),
    f AS (SELECT *, coalesce(e - w > 180 AND uh - ul <= 180, false) AS wraps FROM s)"""


@query(
    f"""WITH {_SUMS} SELECT set, files, total_size, round(CASE WHEN wraps THEN nw ELSE w END, 9) AS west, round(south, 9) AS south, round(CASE WHEN wraps THEN ne ELSE e END, 9) AS east, round(north, 9) AS north, round(pixel_deg, 12) AS pixel_deg, max_level,
    concat_ws(',', CASE WHEN wraps THEN 'antimeridian' END, CASE WHEN systems > 1 THEN 'mixed_crs' END, CASE WHEN bad THEN 'some_unusable' END) AS warnings FROM f"""
)
def raster_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headers.summary(headers.records(_headers(spark, sf_dir)), "set")
    sides = [F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")]
    return rows.select("set", "files", "total_size", *sides, F.round("pixel_deg", 12).alias("pixel_deg"), "max_level", F.array_join("warnings", ",").alias("warnings"))


@query(
    with_views("regions")
    + """, p AS (SELECT region, west AS w, least(east, 180) AS e, south, north FROM regions UNION ALL SELECT region, -180, east - 360, south, north FROM regions WHERE east > 180),
    i AS (SELECT region, CAST(z AS INT) AS level, pow(2, z + 1) AS nx, pow(2, z) AS ny, floor((w + 180) / 360 * pow(2, z + 1)) AS a, ceil((e + 180) / 360 * pow(2, z + 1)) - 1 AS b, floor((south + 90) / 180 * pow(2, z)) AS c, ceil((north + 90) / 180 * pow(2, z)) - 1 AS d FROM p, range(0, 22) t(z)),
    k AS (SELECT region, level, greatest(0, least(nx - 1, a)) AS a, greatest(0, least(nx - 1, greatest(a, b))) AS b, greatest(0, least(ny - 1, c)) AS c, greatest(0, least(ny - 1, greatest(c, d))) AS d FROM i)
    SELECT region, level, CAST(sum((b - a + 1) * (d - c + 1)) AS BIGINT) AS tiles FROM k GROUP BY region, level"""
)
def level_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.tile_counts(v.regions(spark, sf_dir), "region")


_BOXES = "b AS (SELECT c_custkey AS id, CAST(c_custkey * 13 % 200 AS DOUBLE) - 100 AS n, CAST(c_custkey * 29 % 200 AS DOUBLE) - 110 AS s, CAST(c_custkey * 7 % 420 AS DOUBLE) - 200 + 0.5::DOUBLE AS e, CAST(c_custkey * 11 % 380 AS DOUBLE) - 190 AS w FROM customer)"


@query(
    f"""WITH {_BOXES} SELECT id, CASE WHEN n <= s THEN 'north_not_above_south' WHEN s < -90 OR s > 90 THEN 'south_out_of_range' WHEN n < -90 OR n > 90 THEN 'north_out_of_range' WHEN w < -180 OR w > 180 THEN 'west_out_of_range' WHEN e < -180 OR e > 180 THEN 'east_out_of_range' WHEN e <= w THEN 'east_not_beyond_west' END AS error,
    CASE WHEN e < w THEN e + 360 ELSE e END AS lifted, CAST(ceil(n - 1e-12) AS BIGINT) AS cells_north, CAST(floor(s) AS BIGINT) AS cells_south, CAST(floor(e - 1e-12) + 1 AS BIGINT) AS cells_east, CAST(floor(w) AS BIGINT) AS cells_west,
    CASE WHEN abs(floor(s)) <= 83 THEN 'ASTWBDV001_' || CASE WHEN s >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(CAST(floor(s) AS INT)) AS VARCHAR), 2, '0') || CASE WHEN w >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(CAST(floor(w) AS INT)) AS VARCHAR), 3, '0') || '_att.tif' END AS water FROM b"""
)
def box_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    n, s, e, w = (k * 13 % 200).cast("double") - 100, (k * 29 % 200).cast("double") - 110, (k * 7 % 420).cast("double") - 199.5, (k * 11 % 380).cast("double") - 190
    rows = v.table(spark, sf_dir, "customer").select(k.alias("id"), n.alias("n"), s.alias("s"), e.alias("e"), w.alias("w"))
    cells = grid.whole_degrees(F.col("n"), F.col("s"), F.col("e"), F.col("w"))
    return rows.select("id", rules.bbox_error(F.col("n"), F.col("s"), F.col("e"), F.col("w")).alias("error"), rules.unwrapped_east(F.col("e"), F.col("w")).alias("lifted"), *(cells[c].alias(f"cells_{c}") for c in ("north", "south", "east", "west")), grid.water_name(F.floor("s"), F.floor("w")).alias("water"))


_VALUES = ["12", "12.5", "auto", "", "AUTO", "-1", "22", " 7", "true", "No", "#12aB3c", "#ff", "red", "NaN"]
_SQL_VALUES = "([" + ", ".join(f"'{x}'" for x in _VALUES) + "])"


@query(
    f"""WITH e AS (SELECT event_id, {_SQL_VALUES}[event_id % 14 + 1] AS a, {_SQL_VALUES}[event_id * 5 % 14 + 1] AS b FROM events),
    n AS (SELECT *, CASE WHEN isfinite(try_cast(a AS DOUBLE)) THEN try_cast(a AS DOUBLE) END AS x, CASE WHEN isfinite(try_cast(b AS DOUBLE)) THEN try_cast(b AS DOUBLE) END AS y FROM e)
    SELECT event_id, CASE WHEN a = '' THEN NULL WHEN a = 'auto' THEN 'auto' WHEN x = floor(x) AND x BETWEEN 0 AND 21 THEN CAST(CAST(x AS INT) AS VARCHAR) ELSE 'invalid' END AS max_zoom,
    CASE WHEN a = '' THEN NULL WHEN lower(trim(a)) IN ('true', '1', 'yes', 'on') THEN 'true' WHEN lower(trim(a)) IN ('false', '0', 'no', 'off') THEN 'false' ELSE 'invalid' END AS switch,
    regexp_full_match(trim(a), '#([0-9A-Fa-f]{{3,4}}|[0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{8}})') AS colour,
    coalesce(x = floor(x) AND x BETWEEN 0 AND 21 AND y = floor(y) AND y BETWEEN 0 AND 21 AND x <= y, false) AS zooms FROM n"""
)
def value_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.element_at(F.array(*map(F.lit, _VALUES)), (k % 14 + 1).cast("int"))
    k = F.col("event_id")
    rows = v.table(spark, sf_dir, "events").select("event_id", pick(k).alias("a"), pick(k * 5).alias("b"))
    return rows.select("event_id", rules.max_zoom_choice(F.col("a")).alias("max_zoom"), rules.switch(F.col("a")).alias("switch"), rules.is_colour(F.col("a")).alias("colour"), rules.usable_zooms(F.col("a"), F.col("b")).isNotNull().alias("zooms"))


@query(
    """WITH p AS (SELECT p_partkey AS id, (p_partkey * 7919) % 256 AS a, (p_partkey * 104729) % 256 AS b, p_partkey % 256 AS c FROM part),
    k AS (SELECT id, a || '.' || b || '.' || c || '.' || (id % 3) AS host, CASE WHEN a = 169 AND b = 254 THEN 'link_local' WHEN a BETWEEN 224 AND 239 THEN 'multicast' WHEN a + b + c + id % 3 = 0 THEN 'unspecified' WHEN a = 127 THEN 'loopback'
      WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a = 0 OR (a = 192 AND b = 0 AND c = 0 AND id % 3 < 8) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'private'
      WHEN a >= 240 THEN 'reserved' ELSE 'public' END AS kind FROM p)
    SELECT id, kind, kind <> 'public' AS blocked, kind IN ('link_local', 'multicast', 'unspecified') AS always, CASE id % 6 WHEN 0 THEN 'scheme' WHEN 1 THEN 'user_info' WHEN 2 THEN 'port' WHEN 3 THEN 'no_host' WHEN 4 THEN CASE WHEN kind <> 'public' THEN 'blocked_address' END END AS url_error,
    CASE id % 6 WHEN 0 THEN 'missing_placeholders' WHEN 1 THEN 'unknown_placeholders' WHEN 3 THEN 'scheme' WHEN 4 THEN 'unknown_host' WHEN 5 THEN 'empty' END AS server_error FROM k"""
)
def host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    octets = [(k * 7919) % 256, (k * 104729) % 256, k % 256, k % 3]
    host, kind = F.col("host"), F.col("kind")
    url = F.when(k % 6 == 0, F.concat(F.lit("ftp://"), host)).when(k % 6 == 1, F.concat(F.lit("http://tiles.example.com@"), host, F.lit("/a"))).when(k % 6 == 2, F.concat(F.lit("http://"), host, F.lit(":99999/"))).when(k % 6 == 3, F.lit("https:///x")).when(k % 6 == 4, F.concat(F.lit(" HTTP://"), host, F.lit(":80/p?q#f "))).otherwise(F.lit("https://tiles.example.com/"))
    entry = F.when(k % 6 == 0, "https://h/{z}/{x}").when(k % 6 == 1, "http://h/{z}/{x}/{y}?k={q}").when(k % 6 == 2, "https://{s}.h/{z}/{x}/{y}").when(k % 6 == 3, "ftp://h").when(k % 6 == 4, "no host").otherwise("  ")
    rows = v.dealt(v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id").withColumn("host", F.concat_ws(".", *(o.cast("string") for o in octets)))
    rows = rows.withColumn("kind", addresses.kind4(addresses.ipv4(host)))
    return rows.select("id", "kind", addresses.blocked(kind).alias("blocked"), addresses.blocked(kind, True).alias("always"), rules.url_error(url).alias("url_error"), rules.server_error(entry).alias("server_error"))


_V4 = """CASE WHEN a = 169 AND b = 254 THEN 'link_local' WHEN a BETWEEN 224 AND 239 THEN 'multicast' WHEN a + b + c + d = 0 THEN 'unspecified' WHEN a = 127 THEN 'loopback'
      WHEN a IN (0, 10) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'private' WHEN a >= 240 THEN 'reserved' ELSE 'public' END"""


@query(
    f"""WITH h AS (SELECT page_id, 'x' || md5(coalesce(html, '')) AS m FROM pages), o AS (SELECT page_id, page_id % 10 AS k, ('0x' || substr(m, 2, 2))::INT AS r, ('0x' || substr(m, 4, 2))::INT AS b0, ('0x' || substr(m, 6, 2))::INT AS c, ('0x' || substr(m, 8, 2))::INT AS d FROM h),
    p AS (SELECT page_id, k, CASE WHEN r < 128 THEN ([10, 127, 169, 172, 192, 224, 250, 198])[r % 8 + 1] ELSE r END AS a, CASE WHEN r < 64 THEN ([254, 168, 18, 16])[b0 % 4 + 1] ELSE b0 END AS b, c, d FROM o),
    v AS (SELECT *, {_V4} AS v4 FROM p),
    w AS (SELECT *, CASE k WHEN 0 THEN 'link_local' WHEN 6 THEN 'private' WHEN 7 THEN 'multicast' WHEN 8 THEN 'public' WHEN 9 THEN CASE WHEN a % 2 = 0 THEN 'loopback' ELSE 'unspecified' END ELSE CASE WHEN k = 5 AND a = 0 AND b = 0 AND c = 0 AND d < 2 THEN CASE d WHEN 1 THEN 'loopback' ELSE 'unspecified' END ELSE v4 END END AS kind FROM v)
    SELECT page_id, CASE WHEN kind <> 'public' THEN kind END AS blocked, CASE WHEN kind IN ('link_local', 'multicast', 'unspecified') THEN kind END AS always, CASE WHEN kind <> 'public' THEN 'blocked_address' END AS url_error, kind <> 'public' AND kind <> 'multicast' AS direct FROM w"""
)
def ipv6_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 hosts that hold an IPv4 address made of the page's hash, in each way there is, or lie in a block of their own."""
    m = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    byte = lambda i: F.conv(F.substring(m, 2 * i + 1, 2), 16, 10).cast("int")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    r = byte(0)
    rows = v.table(spark, sf_dir, "pages").select("page_id", F.when(r < 128, pick((10, 127, 169, 172, 192, 224, 250, 198), r % 8)).otherwise(r).alias("a"), F.when(r < 64, pick((254, 168, 18, 16), byte(1) % 4)).otherwise(byte(1)).alias("b"), byte(2).alias("c"), byte(3).alias("d"))
    k, (a, b, c, d) = F.col("page_id") % 10, map(F.col, "abcd")
    dotted, word = F.concat_ws(".", a, b, c, d), lambda x, y: F.lower(F.hex(x * 256 + y))
    flipped = lambda x, y: F.lower(F.hex(65535 - (x * 256 + y)))
    join = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    host = (
        F.when(k == 0, join("fe80::", word(a, b), "%eth0"))
        .when(k == 1, join("::FFFF:", dotted))
        .when(k == 2, join("2002:", word(a, b), ":", word(c, d), "::1"))
        .when(k == 3, join("64:ff9b::", word(a, b), ":", word(c, d)))
        .when(k == 4, join("2001:0:808:808:0:1:", flipped(a, b), ":", flipped(c, d)))
        .when(k == 5, join("::", dotted))
        .when(k == 6, join("fd00:", word(a, b), "::", word(c, d)))
        .when(k == 7, join("ff02:0:0:0:0:0:0:", word(c, d)))
        .when(k == 8, join("2606:4700::", word(a, b), ":0:", word(c, d)))
        .otherwise(F.when(a % 2 == 0, "::1").otherwise("::"))
    )
    url = join("http://[", host, "]:8080/x")
    return rows.select("page_id", addresses.blocked_kind(host).alias("blocked"), addresses.blocked_kind(host, True).alias("always"), rules.url_error(url).alias("url_error"), rules.bypasses_proxy(host).alias("direct"))


@query(
    """WITH p AS (SELECT page_id AS id, page_id % 6 AS k, CAST(3 + page_id % 9 AS INT) AS z, page_id % 8 AS x, (page_id * 3) % 8 AS y FROM pages)
    SELECT id, CASE k WHEN 0 THEN 'https://a.tiles.example.com/v1/{z}/{x}/{y}.png?key=5' WHEN 1 THEN 'https://tiles.example.com/tile/{z}/{y}/{x}' WHEN 2 THEN 'http://1.base.example.com/wmts?tilematrix={z}&tilecol={x}&tilerow={y}&v=2' WHEN 3 THEN 'https://h.example.com/tms/{z}/{x}/{y}.jpg' END AS template,
    CASE WHEN k = 3 THEN 'tms' ELSE 'xyz' END AS scheme, CASE k WHEN 0 THEN 'a,b,c' WHEN 2 THEN '1,2,3' WHEN 3 THEN 'a,b,c' ELSE '' END AS subdomains FROM (SELECT * REPLACE (CASE WHEN k = 1 AND NOT (y < pow(2, z)) THEN 9 ELSE k END AS k) FROM p) WHERE k < 4 AND k <> 1
    UNION ALL SELECT id, 'https://tiles.example.com/tile/{z}/{x}/{y}', 'xyz', '' FROM p WHERE k = 1"""
)
def wizard_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of tile URLs in four layouts; the rest have none."""
    i = F.col("page_id")
    z, x, y = ((3 + i % 9).cast("string"), (i % 8).cast("string"), (i * 3 % 8).cast("string"))
    c = lambda *p: F.concat(*(F.lit(q) if isinstance(q, str) else q for q in p))
    url = (
        F.when(i % 6 == 0, c("https://a.tiles.example.com/v1/", z, "/", x, "/", y, ".png?key=5"))
        .when(i % 6 == 1, c("https://tiles.example.com/tile/", z, "/", x, "/", y))
        .when(i % 6 == 2, c("http://1.base.example.com/wmts?tilematrix=", z, "&tilecol=", x, "&tilerow=", y, "&v=2"))
        .when(i % 6 == 3, c("https://h.example.com/tms/", z, "/", x, "/", y, ".jpg"))
        .when(i % 6 == 4, c("https://h.example.com/about/", z))
        .otherwise(c("https://h.example.com/1700000000123/", z, "/a"))
    )
    return wizard.templates(v.table(spark, sf_dir, "pages").select(i.alias("id"), url.alias("url")), "id")


@query(
    with_views("tasks", "obs", "times")
    + """, lastobs AS (SELECT task, zoom, x, y, arg_max(outcome, (ts, seq)) AS outcome FROM obs GROUP BY ALL), o AS (SELECT task, max(ts) AS since FROM times WHERE action IN ('start', 'resume') GROUP BY task), r AS (SELECT DISTINCT task FROM lastobs WHERE outcome IN ('retryable_failure', 'cache_failure'))
    SELECT id AS task, id % 1000 + CASE WHEN status IN ('running', 'retrying') THEN coalesce((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(since)) // 1000000, 0) ELSE 0 END AS paused_seconds, CASE WHEN status IN ('running', 'retrying') THEN 'paused' ELSE status END AS paused, CASE WHEN status IN ('completed_with_gaps', 'pending_decision', 'failed') AND r.task IS NOT NULL THEN 'retrying' ELSE status END AS refilled,
    CASE WHEN status = 'pending_decision' THEN 'completed_with_gaps' ELSE status END AS accepted, CASE WHEN status IN ('completed', 'completed_with_gaps', 'failed', 'paused', 'pending_decision') THEN status ELSE 'failed' END AS plugin FROM tasks LEFT JOIN r ON r.task = id LEFT JOIN o ON o.task = id"""
)
def task_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("status")
    rows = v.tasks(spark, sf_dir).select(F.col("id").alias("task"), "status", (F.col("id") % 1000).alias("running_seconds"), tasks.accepted(state).alias("accepted"), tasks.plugin_state(state).alias("plugin"), state.alias("given"))
    gaps = _ledger(spark, sf_dir).where(ledger.is_gap(F.col("outcome")))
    held, _ = tasks.paused(rows, v.time_records(spark, sf_dir), F.lit("2024-03-01").cast("timestamp"))
    again = tasks.refilled(held.withColumnsRenamed({"status": "paused", "given": "status"}), gaps, ledger.RETRYABLE_OUTCOMES)
    return again.select("task", "paused", F.col("running_seconds").alias("paused_seconds"), F.col("status").alias("refilled"), "accepted", "plugin")


@query(with_views("tasks") + "SELECT id AS task, 'pause' AS action, TIMESTAMP '2024-03-01' AS ts FROM tasks WHERE status IN ('running', 'retrying')")
def pause_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.tasks(spark, sf_dir).select(F.col("id").alias("task"), "status", F.lit(0).alias("running_seconds"))
    return tasks.paused(rows, v.time_records(spark, sf_dir), F.lit("2024-03-01").cast("timestamp_ntz"))[1]


@query(
    """WITH RECURSIVE p AS (SELECT event_id, user_id, epoch_us(ts) // 100000 AS t FROM events), u AS (SELECT user_id, t, min(event_id) AS event_id FROM p GROUP BY ALL),
    n AS (SELECT user_id, t, min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 500000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_t FROM u),
    go AS (SELECT user_id, min(t) AS t FROM u GROUP BY user_id UNION ALL SELECT n.user_id, n.next_t FROM go JOIN n USING (user_id, t) WHERE n.next_t IS NOT NULL),
    sent AS (SELECT event_id FROM u JOIN go USING (user_id, t) UNION SELECT arg_max(event_id, (t, event_id)) FROM p GROUP BY user_id)
    SELECT event_id, user_id, t AS "at" FROM p JOIN sent USING (event_id)"""
)
def throttled_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events told in a hundred-thousandth of their time, so that many lie closer than half a second."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000)
    rows = v.table(spark, sf_dir, "events").select("event_id", "user_id", F.timestamp_micros(at).alias("ts"))
    return tasks.throttled(rows, "user_id", ("event_id",)).select("event_id", "user_id", F.unix_micros("ts").alias("at"))


@query(
    """WITH have AS (SELECT 'k' || c_custkey AS key, CAST(c_acctbal AS VARCHAR) AS value FROM customer WHERE c_custkey % 2 = 0), put AS (SELECT 'k' || c_custkey AS key, 'new' || c_custkey AS value FROM customer WHERE c_custkey % 3 = 0),
    m AS (SELECT coalesce(p.key, h.key) AS key, coalesce(p.value, h.value) AS value, p.key IS NOT NULL AS changed FROM have h FULL JOIN put p ON h.key = p.key)
    SELECT key, CASE WHEN key IN ('k3', 'k6') AND value <> '' THEN '<kept>' ELSE value END AS value, changed FROM m"""
)
def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "customer")
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key")
    have = rows.where("c_custkey % 2 = 0").select(key, F.col("c_acctbal").cast("string").alias("value"))
    put = rows.where("c_custkey % 3 = 0").select(key, F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("value"))
    return config.upsert(have, put, "<kept>").select("key", rules.shown(F.col("key"), F.col("value"), ("k3", "k6"), "<kept>").alias("value"), "changed")


@query(
    with_views("tasks")
    + """SELECT id, (CASE style WHEN 'm' THEN 'map' WHEN 's' THEN 'satellite' WHEN 'y' THEN 'hybrid' WHEN 't' THEN 'terrain' END) AS style_name, style AS code, 'cache/' || style || '/' || zoom_max || '/' || (id % 100) || '/' || (id % 77) || '.png' AS path,
    substr(sha256('https://t.example.com/' || style), 1, 8) AS version, CASE WHEN id % 3 = 0 THEN 'only_one' WHEN id % 3 = 1 THEN NULL ELSE 'not_rising' END AS tint_error FROM tasks"""
)
def task_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, style = F.col("id"), F.col("style")
    breaks = F.when(k % 3 == 0, "").when(k % 3 == 1, "1, 2.5,9").otherwise("3,2")
    colours = F.when(k % 3 == 2, "#fff,#000,#123456").otherwise("#fff,#000,#123456,#ABCDEF80")
    path = F.concat_ws("/", F.lit("cache"), style, F.col("zoom_max").cast("string"), (k % 100).cast("string"), F.concat((k % 77).cast("string"), F.lit(".png")))
    version = F.substring(F.sha2(F.concat(F.lit("https://t.example.com/"), style), 256), 1, 8)
    return v.tasks(spark, sf_dir).select("id", rules.style_name(style).alias("style_name"), rules.style_code(style).alias("code"), path.alias("path"), version.alias("version"), rules.tint_error(breaks, colours).alias("tint_error"))
