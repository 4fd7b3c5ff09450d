"""Region files (GeoJSON, KML) to rings, a file a row, with warnings; bad files give a row with an error."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, rings array<array<struct<lon: double, lat: double>>>, error string"
MOST_BYTES = 32 << 20
DEPTH = 8
#: Names of WGS 84 that a legacy `crs` member may have.
WGS84 = ("epsg:4326", "urn:ogc:def:crs:ogc:1.3:crs84", "urn:ogc:def:crs:epsg::4326", "ogc:crs84", "crs84")


def _closed(points: list) -> list[tuple[float, float]]:
    ring: list[tuple[float, float]] = []
    for p in points:
        here = (float(p[0]), float(p[1]))
        if not ring or here != ring[-1]:
            ring.append(here)
    if len(set(ring)) < 3:
        raise ValueError("a ring needs three points")
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def _turned(ring: list[tuple[float, float]], against_clock: bool) -> list[tuple[float, float]]:
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
    return ring if (area > 0) == against_clock else ring[::-1]


def _polygon(rings: list) -> list[list[tuple[float, float]]]:
    return [_turned(_closed(r), k == 0) for k, r in enumerate(rings)]


def from_geojson(obj: dict, depth: int = 0) -> list[list[tuple[float, float]]]:
    """All polygons' rings: outer ones against the clock, holes with it."""
    if depth > DEPTH:
        raise ValueError("too deeply nested")
    crs = (obj.get("crs") or {}).get("properties", {}).get("name", "crs84")
    if str(crs).lower() not in WGS84:
        raise ValueError(f"coordinates in {crs}")
    kind = obj.get("type")
    if kind == "Polygon":
        return _polygon(obj["coordinates"])
    if kind == "MultiPolygon":
        return [r for p in obj["coordinates"] for r in _polygon(p)]
    inside = {"Feature": [obj.get("geometry") or {}], "FeatureCollection": obj.get("features") or [], "GeometryCollection": obj.get("geometries") or []}.get(kind, [])
    return [r for x in inside for r in from_geojson(x, depth + 1)]


def from_kml(text: bytes) -> list[list[tuple[float, float]]]:
    """The rings of every Polygon."""
    out = []
    for polygon in (e for e in ElementTree.fromstring(text).iter() if e.tag.rpartition("}")[2] == "Polygon"):
        rings = []
        for part in ("outerBoundaryIs", "innerBoundaryIs"):
            for boundary in (e for e in polygon.iter() if e.tag.rpartition("}")[2] == part):
                for c in (e for e in boundary.iter() if e.tag.rpartition("}")[2] == "coordinates"):
                    rings.append([p.split(",")[:2] for p in (c.text or "").split()])
        out += _polygon(rings)
    return out


def parse(data: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a file whose first byte tells its kind."""
    if len(data) > MOST_BYTES:
        raise ValueError("file too large")
    if data.lstrip()[:1] == b"<":
        rings = from_kml(data)
    else:
        try:
            text = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = data.decode("gb18030")
        rings = from_geojson(json.loads(text))
    if not rings:
        raise ValueError("no polygon")
    return rings


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, rings, error of each region file under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
        for batch in batches:
            rings, errors = [], []
            for data in batch.column("content").to_pylist():
                try:
                    rings.append([[{"lon": x, "lat": y} for x, y in r] for r in parse(data)])
                    errors.append(None)
                except (ValueError, KeyError, TypeError, IndexError, ElementTree.ParseError) as x:
                    rings.append(None)
                    errors.append(f"{type(x).__name__}: {x}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rings, pa.list_(pa.list_(point))), pa.array(errors, pa.string())], ["path", "rings", "error"])

    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInArrow(run, SCHEMA)
