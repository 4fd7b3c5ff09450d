"""GeoTIFF files as tables: the header of each (`geotiff_header`), and single-band rasters as blocks of heights (`geotiff_blocks`).

Only the directory and the values it names are read for a header, in ranges of the file; a raster's strips or tiles are
read one by one, those of a band of blocks at a time. Files are named by a folder or a file on any file system that
pyarrow reaches from driver and executors.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: bytes of each field type, tags, and keys of coordinate systems.
FIELD_TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u4,u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4,i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_sizes", 317: "predictor", 322: "tile_width", 323: "tile_height",
    324: "tile_offsets", 325: "tile_sizes", 339: "sample_format", 33550: "scale", 33922: "tie", 34264: "transform", 34735: "geo_keys", 42112: "metadata", 42113: "nodata",
}
GEO_KEYS = {1024: "model", 2048: "geographic", 3072: "projected"}
SUFFIXES = (".tif", ".tiff")
#: More entries, or a longer value, are not believed.
MOST_ENTRIES = 4096
MOST_BYTES = 64 << 20
_HEADER = "path string, name string, size long, big_tiff boolean, width long, height long, samples int, bits int, sample_format int, compression int, tile_width int, tile_height int, rows_per_strip long, scale array<double>, tie array<double>, transform array<double>, model int, geographic int, projected int, nodata double, low double, high double, error string"
_LISTS = ("strip_offsets", "strip_sizes", "tile_offsets", "tile_sizes")


def directory(read: Callable[[int, int], bytes], size: int, lists: bool = False) -> dict:
    """The tags of the first image, by name; read(offset, length) gives bytes of the file. lists: also where strips and tiles lie."""
    head = read(0, min(16, size))
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    if big and (len(head) < 16 or struct.unpack(order + "H", head[4:6])[0] != 8):
        raise ValueError("offsets of another size")
    word, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    at = struct.unpack(order + word, head[8:16] if big else head[4:8])[0]
    wide = "Q" if big else "H"
    n = struct.unpack(order + wide, _exactly(read, at, struct.calcsize(wide)))[0]
    if not 0 < n <= MOST_ENTRIES:
        raise ValueError("implausible number of entries")
    block = _exactly(read, at + struct.calcsize(wide), n * entry)
    out: dict = {"big_tiff": big, "order": order}
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HH" + word, block[k * entry : k * entry + 4 + inline])
        name = TAGS.get(tag)
        if name is None or kind not in FIELD_TYPES or name in _LISTS and not lists:
            continue
        field = np.dtype([(f"f{i}", order + t) for i, t in enumerate(FIELD_TYPES[kind].split(","))])
        total = field.itemsize * count
        if total > MOST_BYTES:
            continue
        value = block[k * entry + 4 + inline : (k + 1) * entry][:total]
        if total > inline:
            value = _exactly(read, struct.unpack(order + word, block[k * entry + 4 + inline : (k + 1) * entry])[0], total)
        if kind == 2:
            out[name] = value.split(b"\0")[0].decode("latin-1")
            continue
        parts = np.frombuffer(value, field)
        numbers = parts["f0"].astype(np.float64) / np.maximum(parts["f1"], 1) if len(field) == 2 else parts["f0"]
        out[name] = numbers.tolist()
    if not out.get("width") or not out.get("height"):
        raise ValueError("no image size")
    return out


def _exactly(read: Callable[[int, int], bytes], at: int, n: int) -> bytes:
    data = read(at, n)
    if len(data) != n:
        raise ValueError("the file ends early")
    return data


def header(tags: dict) -> dict:
    """A row of the header table from a directory."""
    first = lambda name, default=None: (tags.get(name) or [default])[0]
    keys = tags.get("geo_keys") or []
    found = {}
    for k in range(min(keys[3], (len(keys) - 4) // 4) if len(keys) >= 4 else 0):
        key, where, _, value = keys[4 + 4 * k : 8 + 4 * k]
        if where == 0 and key in GEO_KEYS:
            found[GEO_KEYS[key]] = value
    said = {k: re.search(f'name="STATISTICS_{k}"[^>]*>([^<]+)<', tags.get("metadata") or "") for k in ("MINIMUM", "MAXIMUM")}
    low, high = (_number(m[1]) if m else None for m in said.values())
    numbers = lambda name: [float(x) for x in tags[name]] if tags.get(name) else None
    return {
        "big_tiff": tags["big_tiff"], "width": int(first("width")), "height": int(first("height")), "samples": first("samples") or 1, "bits": first("bits") or 8, "sample_format": first("sample_format") or 1,
        "compression": first("compression") or 1, "tile_width": first("tile_width"), "tile_height": first("tile_height"), "rows_per_strip": first("rows_per_strip"), "scale": numbers("scale"), "tie": numbers("tie"), "transform": numbers("transform"),
        **{n: found.get(n) for n in GEO_KEYS.values()}, "nodata": _number(tags.get("nodata")), "low": None if low is None or high is None else low, "high": None if low is None or high is None else high,
    }


def _number(text: str | None) -> float | None:
    try:
        value = float(text) if text else None
    except ValueError:
        return None
    return value if value is not None and np.isfinite(value) else None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of the rasters at a path: itself, or those under it."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path[: path.index(at)] if at in path else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path.lower().endswith(SUFFIXES) or info.type == fs.FileType.File))


class _Some(InputPartition):
    def __init__(self, files: list[tuple[str, int]], rows: tuple[int, int] | None = None):
        self.files, self.rows = files, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("filesPerTask", 64))


class _Headers(_Reader):
    def partitions(self) -> list[InputPartition]:
        files = _files(self.path)
        return [_Some(files[k : k + self.per_task]) for k in range(0, len(files), self.per_task)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        names = [f.split()[0] for f in _HEADER.split(", ")]
        for path, size in partition.files:
            system, at = _opened(path)
            row = {"path": path, "name": path.rsplit("/", 1)[-1], "size": size}
            try:
                with system.open_input_file(at) as f:
                    row |= header(directory(lambda offset, n, f=f: f.read_at(n, offset), size))
            except (ValueError, struct.error, OSError) as e:
                row["error"] = str(e)
            yield tuple(row.get(n) for n in names)


class GeoTiffHeaders(DataSource):
    """format("geotiff_header").load(path): a row per raster under path; a file that can't be read has an error and no sizes."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_header"

    def schema(self) -> str:
        return _HEADER

    def reader(self, schema) -> DataSourceReader:
        return _Headers(self.options)


def _unpacked(data: bytes, tags: dict, rows: int, cols: int, kind: np.dtype) -> np.ndarray:
    """The heights of a strip or tile of rows x cols."""
    way, predictor = (tags.get("compression") or [1])[0], (tags.get("predictor") or [1])[0]
    if way in (8, 32946):
        data = zlib.decompress(data)
    elif way != 1:
        raise ValueError(f"compression {way} is not read")
    if predictor == 3:
        # Bytes of each row lie by significance, the highest first, and are differences.
        planes = np.cumsum(np.frombuffer(data, np.uint8, rows * cols * kind.itemsize).reshape(rows, -1), axis=1, dtype=np.uint8)
        return planes.reshape(rows, kind.itemsize, cols).transpose(0, 2, 1).copy().view(kind.newbyteorder(">"))[..., 0]
    cells = np.frombuffer(data, kind, rows * cols).reshape(rows, cols)
    if predictor == 2:
        whole = np.dtype(f"u{kind.itemsize}")
        return np.cumsum(cells.astype(kind.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(kind.newbyteorder("="))
    return cells


class _Blocks(_Reader):
    """Partitions are bands of blocks of a file, so a large raster is many tasks."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.side, self.bands = int(options.get("side", 256)), int(options.get("bandsPerTask", 8))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for raster, (path, size) in enumerate(_files(self.path)):
            system, at = _opened(path)
            with system.open_input_file(at) as f:
                height = int(directory(lambda offset, n, f=f: f.read_at(n, offset), size)["height"][0])
            for band in range(0, -(-height // self.side), self.bands):
                out.append(_Some([(path, size)], (raster, band)))
        return out or [_Some([])]

    def read(self, partition: _Some) -> Iterator[pa.RecordBatch]:
        for path, size in partition.files:
            raster, first = partition.rows
            system, at = _opened(path)
            with system.open_input_file(at) as f:
                tags = directory(lambda offset, n, f=f: f.read_at(n, offset), size, lists=True)
                for band in range(first, min(first + self.bands, -(-int(tags["height"][0]) // self.side))):
                    yield self._band(f, tags, raster, band)

    def _band(self, f, tags: dict, raster: int, band: int) -> pa.RecordBatch:
        width, height = int(tags["width"][0]), int(tags["height"][0])
        if (tags.get("samples") or [1])[0] != 1:
            raise ValueError("rasters of one band are read")
        letter = {1: "u", 2: "i", 3: "f"}[(tags.get("sample_format") or [1])[0]]
        kind = np.dtype(f"{tags['order']}{letter}{(tags.get('bits') or [8])[0] // 8}")
        tiled = "tile_offsets" in tags
        high = int(tags["tile_height"][0]) if tiled else min(height, int((tags.get("rows_per_strip") or [height])[0]))
        wide = int(tags["tile_width"][0]) if tiled else width
        offsets, sizes = (tags["tile_offsets"], tags["tile_sizes"]) if tiled else (tags["strip_offsets"], tags["strip_sizes"])
        across, side = -(-width // wide), self.side
        top, bottom = band * side, min(height, (band + 1) * side)
        columns = -(-width // side)
        whole = np.full((side, columns * side), np.nan)
        for r in range(top // high, (bottom - 1) // high + 1):
            for c in range(across):
                k = r * across + c
                rows = high if tiled else min(high, height - r * high)
                if not sizes[k]:  # a hole of a sparse file
                    continue
                cells = _unpacked(f.read_at(int(sizes[k]), int(offsets[k])), tags, rows, wide, kind).astype(np.float64)
                a, b = max(top, r * high), min(bottom, r * high + rows)
                end = min(width, (c + 1) * wide)
                whole[a - top : b - top, c * wide : end] = cells[a - r * high : b - r * high, : end - c * wide]
        nodata = _number(tags.get("nodata"))
        if nodata is not None:
            whole[whole == nodata] = np.nan
        made = whole.reshape(side, columns, side).transpose(1, 0, 2).reshape(columns, side * side)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(columns + 1, dtype=np.int32) * side * side), pa.array(made.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(columns, raster)), pa.array(np.full(columns, band, np.int32)), pa.array(np.arange(columns, dtype=np.int32)), lists], ["raster", "brow", "bcol", "data"])


class GeoTiffBlocks(DataSource):
    """format("geotiff_blocks").option("side", n).load(path): blocks of the rasters under path, numbered in the order of their paths; no data is NaN.

    Single-band rasters of numbers, in strips or tiles, plain or deflated, with or without differences.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff_blocks"

    def schema(self) -> str:
        return "raster long, brow int, bcol int, data array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Blocks(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    for source in (GeoTiffHeaders, GeoTiffBlocks):
        spark.dataSource.register(source)
