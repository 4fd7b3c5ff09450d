"""MBTiles containers as a Spark data source: `spark.read.format("mbtiles")`, `df.write.format("mbtiles")`.

Reading gives zoom, x, y (rows from the north) and data, a partition for each zoom. Writing takes the same columns
(and, as options, name, attribution, format): tasks hand over sorted SQLite parts beside the target, and the commit
merges them on the driver into one container of the MBTiles 1.3 layout, the later part winning where tiles repeat, and moves it into place. The path
must be in a folder that all executors see.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tilespan.functions import grid

SCHEMA = "zoom int, x long, y long, data binary"
#: What a tile's first bytes say of its format.
MAGIC = {b"\x89PNG": "png", b"\xff\xd8\xff": "jpg", b"RIFF": "webp", b"\x1f\x8b": "pbf"}


def _plain(path: str) -> str:
    return path.removeprefix("file://")


class MBTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_plain(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


@dataclass
class _Zoom(InputPartition):
    zoom: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            return [_Zoom(z) for (z,) in db.execute("SELECT DISTINCT zoom_level FROM tiles ORDER BY 1")] or [_Zoom(-1)]

    def read(self, partition: _Zoom) -> Iterator[tuple]:
        with self._open() as db:
            for x, row, data in db.execute("SELECT tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ? ORDER BY 1, 2", (partition.zoom,)):
                yield partition.zoom, x, (1 << partition.zoom) - 1 - row, data


@dataclass
class _Part(WriterCommitMessage):
    path: str
    order: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.path = options, overwrite, _plain(options["path"])
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        at = f"{self.path}.{self.run}.{task.partitionId()}.{task.taskAttemptId()}.part"
        with sqlite3.connect(at) as db:
            _make(db)
            for batch in iterator:
                rows = []
                for z, x, y, data in zip(*(batch.column(c).to_pylist() for c in ("zoom", "x", "y", "data")), strict=True):
                    if data and z is not None and 0 <= z <= 30 and 0 <= x < 1 << z and 0 <= y < 1 << z:
                        rows.append((z, x, (1 << z) - 1 - y, data))
                    elif data:
                        raise ValueError(f"tile {z}/{x}/{y} is outside its grid")
                db.executemany("INSERT OR REPLACE INTO tiles VALUES (?, ?, ?, ?)", rows)
        db.close()
        return _Part(at, task.partitionId())

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.order)
        target = f"{self.path}.{self.run}.whole"
        db = sqlite3.connect(target)
        _make(db)
        db.commit()
        for part in parts:
            db.execute("ATTACH ? AS part", (part.path,))
            db.execute("INSERT OR REPLACE INTO tiles SELECT * FROM part.tiles")
            db.commit()
            db.execute("DETACH part")
            os.remove(part.path)
        low, high = db.execute("SELECT min(zoom_level), max(zoom_level) FROM tiles").fetchone()
        if low is None:
            db.close()
            os.remove(target)
            raise ValueError("a container needs a tile")
        meta = {"name": self.options.get("name", "tiles"), "format": self.options.get("format", "png"), "type": self.options.get("type", "baselayer"), "version": "1.1", "minzoom": low, "maxzoom": high, "bounds": _bounds(db)}
        if "attribution" in self.options:
            meta["attribution"] = self.options["attribution"]
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [(k, str(v)) for k, v in meta.items()])
        db.commit()
        db.close()
        if os.path.exists(self.path) and not self.overwrite:
            os.remove(target)
            raise FileExistsError(self.path)
        os.replace(target, self.path)

    def abort(self, messages: list[_Part | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


def _make(db: sqlite3.Connection) -> None:
    db.execute("CREATE TABLE IF NOT EXISTS metadata (name TEXT, value TEXT)")
    db.execute("CREATE TABLE IF NOT EXISTS tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB, PRIMARY KEY (zoom_level, tile_column, tile_row)) WITHOUT ROWID")


def _bounds(db: sqlite3.Connection) -> str:
    import math

    west, south, east, north = 180.0, 90.0, -180.0, -90.0
    for z, x0, x1, r0, r1 in db.execute("SELECT zoom_level, min(tile_column), max(tile_column), min(tile_row), max(tile_row) FROM tiles GROUP BY 1"):
        n = 1 << z
        lat = lambda row, n=n: math.degrees(math.atan(math.sinh(math.pi * (2 * row / n - 1))))
        west, east = min(west, x0 / n * 360 - 180), max(east, (x1 + 1) / n * 360 - 180)
        south, north = min(south, lat(r0)), max(north, lat(r1 + 1))
    return ",".join(f"{v:.6f}" for v in (west, south, east, north))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MBTilesSource)


def validate(tiles: DataFrame, declared: dict[str, str]) -> DataFrame:
    """rule, ok for each rule of a container: required metadata, tiles inside the grid, declared zooms and format."""
    sniffed = F.lit("unknown")
    for start, kind in MAGIC.items():
        sniffed = F.when(F.substring("data", 1, len(start)) == F.lit(start), kind).otherwise(sniffed)
    across = grid.tiles_across(F.col("zoom"))
    outside = ~(F.col("x").between(0, across - 1) & F.col("y").between(0, across - 1))
    found = tiles.agg(F.count("*").alias("n"), F.min("zoom").alias("low"), F.max("zoom").alias("high"), F.count_if(outside).alias("outside"), F.count_if(sniffed != declared.get("format", "")).alias("odd"))
    needed = all(declared.get(k) for k in ("name", "format"))
    zooms = (F.col("low") == int(declared.get("minzoom", -1))) & (F.col("high") == int(declared.get("maxzoom", -1)))
    rules = {"required_keys": F.lit(needed), "not_empty": F.col("n") > 0, "in_grid": F.col("outside") == 0, "zooms": F.coalesce(zooms, F.lit(False)), "format": F.col("odd") == 0}
    return found.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("ok")) for k, v in rules.items()))))
