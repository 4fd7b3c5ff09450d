"""Polygons as arrays of rings of (lon, lat): area, even-odd containment, tile spans, boxes, self-crossings.

A ring is array<struct<lon, lat>>, closed; a region's rings are array<ring>. East of the antimeridian lon goes on
beyond 180. What grows with a polygon is dealt as rows: its edges, cut into the rows (bands) of a grid that they pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespan.operators import spans
from tilespan.schemas import WEB_MERCATOR_MAX_LAT

#: How far two lines must pass each other to cross, how much of a box counts as its border, the longest ring that is looked at.
CROSSING = 1e-12
BORDER = 1e-9
MOST_EDGES = 2000


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.lon.alias("x1"), a.lat.alias("y1"), b.lon.alias("x2"), b.lat.alias("y2")))


def _all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), _edges))


def ring_area(ring: Column) -> Column:
    """Signed area in square degrees: positive for rings against the clock."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e.x1 * e.y2 - e.x2 * e.y1)) / 2.0


def vertex_count(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda s, r: s + F.size(r) - 1)


def hole_count(polygons: Column) -> Column:
    """Of polygons as arrays of rings, all but the first ring of each."""
    return F.aggregate(polygons, F.lit(0), lambda s, p: s + F.greatest(F.size(p) - 1, F.lit(0)))


def _odd(edges: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies east of an odd number of the edges that pass its latitude."""
    return F.size(F.filter(edges, lambda e: ((e.y1 > lat) != (e.y2 > lat)) & (lon < (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1))) % 2 == 1


def contains(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd over all rings, so holes and overlapping parts cancel."""
    return _odd(_all_edges(rings), lon, lat)


def cross(a: Column, b: Column) -> Column:
    """Whether two edges (structs of x1, y1, x2, y2) truly cross; a shared end, a touch or an overlap is no crossing."""
    side = lambda e, x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    apart = lambda p, q: ((p > CROSSING) & (q < -CROSSING)) | ((p < -CROSSING) & (q > CROSSING))
    return apart(side(b, a["x1"], a["y1"]), side(b, a["x2"], a["y2"])) & apart(side(a, b["x1"], b["y1"]), side(a, b["x2"], b["y2"]))


def _meets(edges: Column, north: Column, south: Column, east: Column, west: Column) -> Column:
    """Whether a box, less its border, holds some of what the edges enclose; edges: all that pass the box's latitudes."""
    n, s, e, w = F.greatest(north, south) - BORDER, F.least(north, south) + BORDER, F.greatest(east, west) - BORDER, F.least(east, west) + BORDER
    probes = F.lit(False)
    for lon, lat in ((w, s), (e, s), (e, n), (w, n), ((w + e) / 2.0, (s + n) / 2.0)):
        probes = probes | _odd(edges, lon, lat)
    side = lambda x1, y1, x2, y2: {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    sides = (side(w, s, e, s), side(e, s, e, n), side(e, n, w, n), side(w, n, w, s))
    enters = lambda g: ((g.x1 > w) & (g.x1 < e) & (g.y1 > s) & (g.y1 < n)) | cross(g, sides[0]) | cross(g, sides[1]) | cross(g, sides[2]) | cross(g, sides[3])
    return (w < e) & (s < n) & (probes | F.exists(edges, enters))


def meets_box(rings: Column, north: Column, south: Column, east: Column, west: Column) -> Column:
    """Whether a polygon and a box share some area; a common border is none. A box given upside down is turned."""
    return F.coalesce(_meets(_all_edges(rings), north, south, east, west), F.lit(False))


def boxes_met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, met: whether each box, less its border, holds some of what the edges enclose.

    rows: keys, the box (north, south, east, west) and one of the edges (x1, y1, x2, y2; null: none), all that pass the
    box's latitudes. A box given upside down is turned. Each edge is a row, so that no list of them is walked again for each test.
    """
    box = {"n": F.greatest("north", "south") - BORDER, "s": F.least("north", "south") + BORDER, "e": F.greatest("east", "west") - BORDER, "w": F.least("east", "west") + BORDER}
    flat = rows.select(*keys, *(c.alias(k) for k, c in box.items()), "x1", "y1", "x2", "y2")
    n, s, e, w, x1, y1, x2, y2 = map(F.col, ("n", "s", "e", "w", "x1", "y1", "x2", "y2"))
    rise = F.nullif(y2 - y1, F.lit(0.0))
    east = lambda lon, lat: ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / rise + x1)
    probes = ((w, s), (e, s), (e, n), (w, n), ((w + e) / 2.0, (s + n) / 2.0))
    edge, side = {"x1": x1, "y1": y1, "x2": x2, "y2": y2}, lambda x1, y1, x2, y2: {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    enters = (x1 > w) & (x1 < e) & (y1 > s) & (y1 < n)
    for one in (side(w, s, e, s), side(e, s, e, n), side(e, n, w, n), side(w, n, w, s)):
        enters = enters | cross(edge, one)
    sums = flat.groupBy(*keys).agg(F.max((w < e) & (s < n)).alias("sound"), F.max(F.coalesce(enters, F.lit(False))).alias("entered"), *(F.count_if(east(*p)).alias(f"p{i}") for i, p in enumerate(probes)))
    held = F.col("entered")
    for i in range(len(probes)):
        held = held | (F.col(f"p{i}") % 2 == 1)
    return sums.select(*keys, F.coalesce(F.col("sound") & held, F.lit(False)).alias("met"))


def edge_rows(polygons: DataFrame, key: str) -> DataFrame:
    """A row per edge: key, ring, place, n (edges of the ring), x1, y1, x2, y2."""
    rings = polygons.select(key, F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 1)
    return rings.select(key, "ring", (F.size("points") - 1).alias("n"), F.posexplode(_edges(F.col("points"))).alias("place", "e")).select(key, "ring", "place", "n", "e.*")


def in_bands(edges: DataFrame, size: float, low: float = -90.0) -> DataFrame:
    """edges by the bands of latitude they pass (band: counted from low, `size` degrees each)."""
    at = lambda c: F.floor((c - low) / size)
    return edges.withColumn("band", F.explode(F.sequence(at(F.least("y1", "y2") - BORDER), at(F.greatest("y1", "y2") + BORDER))))


def bands(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """key, band, edges: the edges that pass each band, which decide for all that lies in it."""
    rows = in_bands(edge_rows(polygons, key), size)
    return rows.groupBy(key, "band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))


def _extent(edges: Column, low: Column, high: Column) -> Column:
    """The edges' columns (struct<a, b> of least and greatest x) between two latitudes."""

    def cut(e: Column) -> Column:
        steep = e.y2 != e.y1
        along = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - e.y1) / F.when(steep, e.y2 - e.y1).otherwise(1.0)))
        a, b = (F.when(steep, e.x1 + along(y) * (e.x2 - e.x1)) for y in (low, high))
        p, q = F.coalesce(a, e.x1), F.coalesce(b, e.x2)
        return F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))

    return F.transform(edges, cut)


def cells(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """key, band, col, edge: the cells of a grid of `size` degrees that polygons touch; edge: an edge passes, else the cell lies inside whole.

    Columns count from -180 and go on beyond 180. A band's inner cells come from where its middle line crosses the
    edges, in pairs; none of them is tested.
    """
    found = bands(polygons, key, size).withColumns({"south": F.col("band") * size - 90.0, "north": (F.col("band") + 1) * size - 90.0})
    col = lambda x: F.floor((x + 180.0) / size)
    touched = F.transform(_extent(F.col("edges"), F.col("south") - BORDER, F.col("north") + BORDER), lambda r: F.struct(col(r.a - BORDER).alias("x0"), col(r.b + BORDER).alias("x1")))
    middle = (F.col("south") + F.col("north")) / 2.0
    across = F.filter("edges", lambda e: (e.y1 > middle) != (e.y2 > middle))
    at = F.array_sort(F.transform(across, lambda e: (e.x2 - e.x1) * (middle - e.y1) / (e.y2 - e.y1) + e.x1))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("at") / 2).cast("int")), lambda k: F.struct(F.element_at("at", 2 * k - 1).alias("a"), F.element_at("at", 2 * k).alias("b")))
    # Cells whose middle lies between the two.
    inner = F.transform(pairs, lambda p: F.struct(F.ceil((p.a + 180.0) / size - 0.5).alias("x0"), (F.ceil((p.b + 180.0) / size - 0.5) - 1).alias("x1")))
    listed = lambda runs: F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: r.x0 <= r.x1), lambda r: F.sequence(r.x0, r.x1))))
    rows = found.select(key, "band", listed(touched).alias("touched"), at.alias("at"))
    rows = rows.select(key, "band", "touched", F.when(F.size("at") > 1, listed(inner)).otherwise(F.array().cast("array<bigint>")).alias("inside"))
    marked = F.concat(F.transform("touched", lambda c: F.struct(c.alias("col"), F.lit(True).alias("edge"))), F.transform(F.array_except("inside", "touched"), lambda c: F.struct(c.alias("col"), F.lit(False).alias("edge"))))
    return rows.select(key, "band", F.explode(marked).alias("c")).select(key, "band", "c.col", "c.edge")


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, size: float = 2.8125) -> DataFrame:
    """(key, id) of points (id, lon, lat) inside polygons: an equi-join on grid cells; inner cells decide by themselves, others by the edges of their band.

    A point west of a region that runs beyond the antimeridian is tested 360 degrees on.
    """
    across = round(360.0 / size)
    held = cells(polygons, key, size).select(key, "band", "edge", (F.floor(F.col("col") / across) * 360.0).alias("shift"), F.pmod("col", F.lit(across)).alias("col"))
    placed = points.select("id", "lon", "lat", F.floor((F.col("lon") + 180.0) / size).alias("col"), F.floor((F.col("lat") + 90.0) / size).alias("band"))
    near = placed.join(held, ["col", "band"]).select(key, "id", "band", "edge", (F.col("lon") + F.col("shift")).alias("lon"), "lat")
    tested = near.where("edge").join(bands(polygons, key, size), [key, "band"]).where(_odd(F.col("edges"), F.col("lon"), F.col("lat")))
    return near.where(~F.col("edge")).select(key, "id").union(tested.select(key, "id")).distinct()


def granules_in(polygons: DataFrame, key: str) -> DataFrame:
    """key, lat, lon of the one-degree cells that share area with polygons; cells beyond the antimeridian are folded back.

    Cells that no edge passes are inside or outside whole; the others are tested against the edges of their degree of latitude.
    """
    found = cells(polygons, key, 1.0).select(key, "band", "edge", (F.col("band") - 90).cast("int").alias("lat"), (F.col("col") - 180).cast("int").alias("x"))
    near = found.where("edge").join(in_bands(edge_rows(polygons, key), 1.0).select(key, "band", "x1", "y1", "x2", "y2"), [key, "band"])
    box = {"north": F.col("lat") + 1.0, "south": F.col("lat").cast("double"), "east": F.col("x") + 1.0, "west": F.col("x").cast("double")}
    met = boxes_met(near.withColumns(box), [key, "lat", "x"]).where("met")
    both = found.where(~F.col("edge")).select(key, "lat", "x").union(met.select(key, "lat", "x"))
    folded = F.when(F.col("x") >= 180, F.col("x") - 360).otherwise(F.col("x")).cast("int")
    return both.select(key, "lat", folded.alias("lon")).distinct()


def self_crossings(polygons: DataFrame, key: str, most_edges: int | None = MOST_EDGES) -> DataFrame:
    """key, ring of the rings that cross themselves; rings of more than most_edges are not looked at (None: all are).

    Edges are dealt over a grid of their ring, about as fine as its edges are many, by the cells they pass, and compared
    only where they share one. Neighbouring edges share an end and are not compared.
    """
    edges = edge_rows(polygons, key)
    edges = edges.where(F.col("n") <= most_edges) if most_edges else edges
    own = Window.partitionBy(key, "ring")
    box = {"left": F.min(F.least("x1", "x2")), "right": F.max(F.greatest("x1", "x2")), "low": F.min(F.least("y1", "y2")), "high": F.max(F.greatest("y1", "y2"))}
    side = F.ceil(F.sqrt(F.col("n")))
    step = lambda a, b: F.greatest((F.col(b) - F.col(a)) / side, F.lit(BORDER))
    dealt = edges.withColumns({c: f.over(own) for c, f in box.items()}).withColumns({"across": step("left", "right"), "up": step("low", "high")})
    slack = BORDER / 1000
    row = lambda y: F.floor((y - F.col("low")) / F.col("up"))
    dealt = dealt.withColumn("row", F.explode(F.sequence(row(F.least("y1", "y2") - slack), row(F.greatest("y1", "y2") + slack))))
    here = F.col("low") + F.col("row") * F.col("up")
    reach = _extent(F.array(F.struct("x1", "y1", "x2", "y2")), here - slack, here + F.col("up") + slack)[0]
    col = lambda x: F.floor((x - F.col("left")) / F.col("across"))
    dealt = dealt.withColumn("col", F.explode(F.sequence(col(reach.a - slack), col(reach.b + slack)))).select(key, "ring", "row", "col", "place", "n", F.struct("x1", "y1", "x2", "y2").alias("e"))
    one, two = dealt.alias("one"), dealt.alias("two")
    same = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in (key, "ring", "row", "col")]
    ends = (F.col("one.place") == 0) & (F.col("two.place") == F.col("one.n") - 1)
    pairs = one.join(two, [*same, F.col("one.place") + 1 < F.col("two.place"), ~ends])
    return pairs.where(cross(F.col("one.e"), F.col("two.e"))).select(F.col(f"one.{key}").alias(key), F.col("one.ring").alias("ring")).distinct()


def polygon_spans(polygons: DataFrame, key: str, zoom_min: int, zoom_max: int) -> DataFrame:
    """key, zoom, y, x0, x1: spans of the tiles that an edge touches or whose row's middle line is inside, disjoint.

    Edges are straight on the tile grid. Each is cut into the rows of tiles it passes; a row's spans are those of its
    pieces and those between its middle line's crossings, in pairs. Columns beyond the antimeridian are folded at the end.
    """
    lat = lambda c: F.radians(F.greatest(F.lit(-WEB_MERCATOR_MAX_LAT), F.least(F.lit(WEB_MERCATOR_MAX_LAT), F.col(c))))
    x = lambda c: (F.col(c) + 180.0) / 360.0
    y = lambda c: (1.0 - F.ln(F.tan(lat(c)) + 1.0 / F.cos(lat(c))) / math.pi) / 2.0
    flat = edge_rows(polygons, key).select(key, x("x1").alias("xa"), y("y1").alias("ya"), x("x2").alias("xb"), y("y2").alias("yb"))
    turned = F.col("ya") > F.col("yb")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    flat = flat.select(key, pick("xa", "xb").alias("xa"), pick("ya", "yb").alias("ya"), pick("xb", "xa").alias("xb"), pick("yb", "ya").alias("yb"))
    grid = spans.by_zoom(flat, zoom_min, zoom_max).withColumn("n", F.expr("shiftleft(1L, zoom)"))
    grid = grid.select(key, "zoom", "n", *((F.col(c) * F.col("n")).alias(c) for c in ("xa", "ya", "xb", "yb")))
    first, last = F.greatest(F.lit(0).cast("long"), F.floor("ya")), F.least(F.col("n") - 1, F.floor("yb"))
    rows = grid.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    level = F.col("ya") == F.col("yb")
    rise = F.when(level, 1.0).otherwise(F.col("yb") - F.col("ya"))
    x_at = lambda t: F.col("xa") + t * (F.col("xb") - F.col("xa"))
    enter = F.when(level, F.col("xa")).otherwise(x_at(F.greatest(F.lit(0.0), (F.col("y") - F.col("ya")) / rise)))
    leave = F.when(level, F.col("xb")).otherwise(x_at(F.least(F.lit(1.0), (F.col("y") + 1 - F.col("ya")) / rise)))
    middle = F.col("y") + 0.5
    crossing = F.when((F.col("ya") <= middle) & (middle < F.col("yb")), x_at((middle - F.col("ya")) / rise))
    run = F.struct(F.floor(F.least(enter, leave)).alias("a"), F.floor(F.greatest(enter, leave)).alias("b"))
    held = rows.select(key, "zoom", "n", "y", run.alias("run"), crossing.alias("at")).groupBy(key, "zoom", "n", "y").agg(F.collect_set("run").alias("runs"), F.array_sort(F.collect_list("at")).alias("at"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("at") / 2).cast("int")), lambda k: F.struct(F.floor(F.element_at("at", 2 * k - 1)).alias("a"), (F.ceil(F.element_at("at", 2 * k)) - 1).alias("b")))
    found = held.select(key, "zoom", "n", "y", F.explode(F.when(F.size("at") > 1, F.concat("runs", pairs)).otherwise(F.col("runs"))).alias("s")).where("s.a <= s.b")
    n, a, b = F.col("n"), F.col("s.a"), F.col("s.b")
    span = lambda lo, hi: F.struct(lo.alias("x0"), hi.alias("x1"))
    zero = F.lit(0).cast("long")
    folded = F.when(b - a + 1 >= n, F.array(span(zero, n - 1))).when(F.floor(a / n) == F.floor(b / n), F.array(span(F.pmod(a, n), F.pmod(b, n)))).otherwise(F.array(span(F.pmod(a, n), n - 1), span(zero, F.pmod(b, n))))
    return spans.merge_runs(found.select(key, "zoom", "y", F.inline(folded)), [key, "zoom", "y"])
