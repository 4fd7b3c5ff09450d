"""Tile-grid and geodesy functions as native columns: Web-Mercator XYZ tiles, TMS rows, geographic tiles, granules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespan.schemas import EARTH_RADIUS, ECCENTRICITY_2, MAX_ZOOM, WEB_MERCATOR_MAX_LAT


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def tiles_across(zoom) -> Column:
    """2 ** zoom as a long."""
    return F.pow(F.lit(2.0), _col(zoom)).cast("long")


def _clamp(value: Column, n: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor(value).cast("long")))


def tile_x(lon, zoom) -> Column:
    """Column of the tile that holds a longitude; out of the grid: the nearest."""
    n = tiles_across(zoom)
    return _clamp((_col(lon) + 180.0) / 360.0 * n, n)


def tile_y(lat, zoom) -> Column:
    """Row (from the north) of the tile that holds a latitude, clamped to the projection's limits."""
    n = tiles_across(zoom)
    phi = F.radians(F.greatest(F.lit(-WEB_MERCATOR_MAX_LAT), F.least(F.lit(WEB_MERCATOR_MAX_LAT), _col(lat))))
    return _clamp((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n, n)


def tile_west(x, zoom) -> Column:
    """Longitude of a tile's west edge; of x + 1: its east edge."""
    return _col(x) / tiles_across(zoom) * 360.0 - 180.0


def tile_north(y, zoom) -> Column:
    """Latitude of a tile's north edge; of y + 1: its south edge."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * _col(y) / tiles_across(zoom)))))


def bbox_tile_range(north, south, east, west, zoom) -> Column:
    """struct<x0, x1, y0, y1>: the closed index range of a box, swapped where inverted."""
    a, b, c, d = tile_x(west, zoom), tile_x(east, zoom), tile_y(north, zoom), tile_y(south, zoom)
    return F.struct(F.least(a, b).alias("x0"), F.greatest(a, b).alias("x1"), F.least(c, d).alias("y0"), F.greatest(c, d).alias("y1"))


def valid_zoom(zoom) -> Column:
    """Whether a zoom is a whole number of the grid's levels."""
    z = _col(zoom).try_cast("double")
    return F.coalesce(z.between(0, MAX_ZOOM) & (z == F.floor(z)), F.lit(False))


def tms_row(zoom, y) -> Column:
    """The row counted from the south instead of the north, and back."""
    return tiles_across(zoom) - 1 - _col(y)


def mercator_x(lon) -> Column:
    return F.radians(_col(lon)) * EARTH_RADIUS


def mercator_y(lat) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / 2.0)) * EARTH_RADIUS


def mercator_lon(x) -> Column:
    return F.degrees(_col(x) / EARTH_RADIUS)


def mercator_lat(y) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(_col(y) / EARTH_RADIUS)) - math.pi / 2)


def ecef(lon, lat, height) -> Column:
    """struct<x, y, z>: earth-centred metres of WGS 84 degrees and a height."""
    lam, phi, h = F.radians(_col(lon)), F.radians(_col(lat)), _col(height)
    radius = F.lit(EARTH_RADIUS) / F.sqrt(1.0 - ECCENTRICITY_2 * F.sin(phi) * F.sin(phi))
    across = (radius + h) * F.cos(phi)
    return F.struct((across * F.cos(lam)).alias("x"), (across * F.sin(lam)).alias("y"), ((radius * (1.0 - ECCENTRICITY_2) + h) * F.sin(phi)).alias("z"))


def axis_range(low, high, count, span: float, origin: float) -> Column:
    """struct<i0, i1>: indices along an axis of `count` tiles that truly overlap [low, high]."""
    step = F.lit(span) / _col(count)
    i0 = F.floor((_col(low) - origin) / step)
    i1 = F.ceil((_col(high) - origin) / step) - 1
    last = _col(count) - 1
    keep = lambda i: F.greatest(F.lit(0).cast("long"), F.least(last, i)).cast("long")
    return F.struct(keep(i0).alias("i0"), keep(F.greatest(i0, i1)).alias("i1"))


def axis_coverage(index, count, span: float, origin: float, low, high) -> Column:
    """The share of a tile's extent along an axis that [low, high] covers."""
    step = F.lit(span) / _col(count)
    edge = F.lit(origin) + _col(index) * step
    return F.greatest(F.lit(0.0), F.least(_col(high), edge + step) - F.greatest(_col(low), edge)) / step


def covered_axis(low, high, count, span: float, origin: float, least: float = 0.25) -> Column:
    """struct<i0, i1> of axis_range without end tiles that are covered by less than `least`; null if none is left.

    Only an end tile can be partly covered, so at most one goes from either side.
    """
    r = axis_range(low, high, count, span, origin)
    ok = lambda i: axis_coverage(i, count, span, origin, low, high) >= least
    i0 = F.when(ok(r.i0), r.i0).otherwise(r.i0 + 1)
    i1 = F.when(ok(r.i1), r.i1).otherwise(r.i1 - 1)
    return F.when(i0 <= i1, F.struct(i0.alias("i0"), i1.alias("i1")))


def max_level(pixel_degrees, tile_size: int = 65) -> Column:
    """The geographic level at which vertices are as dense as a raster's pixels; 14 for no pixel size."""
    level = F.greatest(F.lit(0).cast("long"), F.ceil(F.log2(F.lit(180.0 / (tile_size - 1)) / _col(pixel_degrees))))
    return F.when(_col(pixel_degrees) <= 0, F.lit(14).cast("long")).otherwise(level)


def granule_id(lat, lon) -> Column:
    """`N29E106` of the one-degree cell whose south-west corner is given."""
    ns, ew = F.when(_col(lat) >= 0, "N").otherwise("S"), F.when(_col(lon) >= 0, "E").otherwise("W")
    return F.format_string("%s%02d%s%03d", ns, F.abs(_col(lat)).cast("int"), ew, F.abs(_col(lon)).cast("int"))


def glo30_name(lat, lon) -> Column:
    """Path of a Copernicus GLO-30 granule."""
    ns, ew = F.when(_col(lat) >= 0, "N").otherwise("S"), F.when(_col(lon) >= 0, "E").otherwise("W")
    name = F.format_string("Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM", ns, F.abs(_col(lat)).cast("int"), ew, F.abs(_col(lon)).cast("int"))
    return F.concat(name, F.lit("/"), name, F.lit(".tif"))


def aster_names(lat, lon, with_num: bool = True) -> Column:
    """Names of ASTER granules of a cell; none beyond 83 degrees."""
    cell = granule_id(lat, lon)
    names = [F.concat(F.lit("ASTGTMV003_"), cell, F.lit("_dem.tif"))] + [F.concat(F.lit("ASTGTMV003_"), cell, F.lit("_num.tif"))] * with_num
    return F.when(F.abs(_col(lat)) > 83, F.array().cast("array<string>")).otherwise(F.array(*names))


def overview_factors(width, height, least: int = 32) -> Column:
    """2, 4, 8, ... while the longest side, so divided, is at least `least`."""
    side = F.greatest(_col(width), _col(height))
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2.0), k).cast("int")), lambda f: side / f >= least)


#: Half of the equator in metres of EPSG:3857, metres of a pixel at zoom 0, metres of a degree.
ORIGIN_SHIFT = 20037508.342789244
PIXEL_AT_ZERO = 156543.03392
DEGREE_METRES = 111320.0


def tile_y_asinh(lat, zoom) -> Column:
    """tile_y by asinh(tan), as renderers of contours have it."""
    n = tiles_across(zoom)
    phi = F.radians(F.greatest(F.lit(-WEB_MERCATOR_MAX_LAT), F.least(F.lit(WEB_MERCATOR_MAX_LAT), _col(lat))))
    return _clamp((1.0 - F.asinh(F.tan(phi)) / math.pi) / 2.0 * n, n)


def tile_metres(zoom, x, y) -> Column:
    """struct<xmin, ymin, xmax, ymax> of an XYZ tile in EPSG:3857."""
    size = F.lit(2 * ORIGIN_SHIFT) / tiles_across(zoom)
    xmin, ymax = _col(x) * size - ORIGIN_SHIFT, F.lit(ORIGIN_SHIFT) - _col(y) * size
    return F.struct(xmin.alias("xmin"), (ymax - size).alias("ymin"), (xmin + size).alias("xmax"), ymax.alias("ymax"))


def tile_geotransform(zoom, x, y, width, height) -> Column:
    """The six numbers that place a tile's pixels in EPSG:3857."""
    at, size = tile_metres(zoom, x, y), F.lit(2 * ORIGIN_SHIFT) / tiles_across(zoom)
    return F.array(at.xmin, size / _col(width), F.lit(0.0), at.ymax, F.lit(0.0), -size / _col(height))


def geographic_extent(level, x, y) -> Column:
    """struct<west, south, east, north> of a geographic tile that counts from the south-west; each edge worked out by itself."""
    nx, ny = tiles_across(_col(level) + 1), tiles_across(level)
    edge = lambda i, n, span, origin: F.lit(origin) + F.lit(span) * i / n
    return F.struct(edge(_col(x), nx, 360.0, -180.0).alias("west"), edge(_col(y), ny, 180.0, -90.0).alias("south"), edge(_col(x) + 1, nx, 360.0, -180.0).alias("east"), edge(_col(y) + 1, ny, 180.0, -90.0).alias("north"))


def level_error(level, tile_size: int = 65, k: float = 1.0) -> Column:
    """Metres that a mesh of a level may be off: k times the distance of its vertices."""
    return F.lit(180.0) / tiles_across(level) / max(1, tile_size - 1) * DEGREE_METRES * k


def max_zoom_3857(pixel_metres, least=0) -> Column:
    """The zoom whose tiles are one level finer than a raster's pixels, from `least` to MAX_ZOOM; unknown pixels: MAX_ZOOM."""
    z = F.ceil(F.log2(F.lit(PIXEL_AT_ZERO) / _col(pixel_metres))).cast("int") + 1
    return F.when(_col(pixel_metres) <= 0, F.lit(MAX_ZOOM)).otherwise(F.least(F.lit(MAX_ZOOM), F.greatest(_col(least), z)))


#: Tiling qualities and the levels that they add.
QUALITY_OFFSETS = {"precision": 1, "balanced": 0, "speed": -1}


def level_by_quality(pixel_degrees, quality: str = "balanced") -> Column:
    """The last level that a quality makes of a raster; the offset comes before the clamp. Unknown pixels: null."""
    level = F.greatest(F.lit(0), F.least(F.lit(MAX_ZOOM), max_level(pixel_degrees) + QUALITY_OFFSETS[quality]))
    return F.when(_col(pixel_degrees) > 0, level.cast("int"))


def to_pixel(geotransform: Column, lon, lat) -> Column:
    """struct<px, py>: where a place lies in a raster, in pixels from its corner."""
    g = [F.get(geotransform, F.lit(k)) for k in range(6)]
    dx, dy, det = _col(lon) - g[0], _col(lat) - g[3], g[1] * g[5] - g[2] * g[4]
    return F.struct(((g[5] * dx - g[2] * dy) / det).alias("px"), ((g[1] * dy - g[4] * dx) / det).alias("py"))


def raster_bounds(geotransform: Column, width, height) -> Column:
    """struct<west, south, east, north> of a raster's four corners."""
    g = [F.get(geotransform, F.lit(k)) for k in range(6)]
    corner = [(g[0] + px * g[1] + py * g[2], g[3] + px * g[4] + py * g[5]) for px in (F.lit(0), _col(width)) for py in (F.lit(0), _col(height))]
    xs, ys = [c[0] for c in corner], [c[1] for c in corner]
    return F.struct(F.least(*xs).alias("west"), F.least(*ys).alias("south"), F.greatest(*xs).alias("east"), F.greatest(*ys).alias("north"))


def whole_degrees(north, south, east, west) -> Column:
    """struct<north, south, east, west>: the box of all one-degree cells that a box meets."""
    up = lambda v: F.floor(_col(v) - 1e-12) + 1
    return F.struct(up(north).alias("north"), F.floor(_col(south)).alias("south"), up(east).alias("east"), F.floor(_col(west)).alias("west"))


def water_name(lat, lon) -> Column:
    """Name of a cell's water granule; none beyond 83 degrees."""
    return F.when(F.abs(_col(lat)) <= 83, F.concat(F.lit("ASTWBDV001_"), granule_id(lat, lon), F.lit("_att.tif")))
