import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespan.operators import blocks, headers
from tilespan.sources import geotiff

CODES = {"u1": 1, "s": 2, "u2": 3, "u4": 4, "f8": 12, "u8": 16}


def _tiff(z, order="<", big=False, tile=None, rows_per_strip=None, compression=1, predictor=1, extra=(), statistics=None):
    """A small writer, independent of the reader: header, image data, values, directory."""
    kind = {"f": 3, "i": 2, "u": 1}[z.dtype.kind]
    body, word = bytearray(16 if big else 8), "Q" if big else "I"
    h, w = z.shape
    parts = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                p = np.zeros((tile, tile), z.dtype)
                p[: min(tile, h - r), : min(tile, w - c)] = z[r : r + tile, c : c + tile]
                parts.append(p)
    else:
        n = rows_per_strip or h
        parts = [z[r : r + n] for r in range(0, h, n)]
    offsets, sizes = [], []
    for p in parts:
        p = p.astype(z.dtype.newbyteorder(order))
        if predictor == 2:
            whole = p.astype(z.dtype).view(f"u{z.dtype.itemsize}")
            p = np.diff(whole, axis=1, prepend=np.zeros((len(whole), 1), whole.dtype)).astype(np.dtype(whole.dtype).newbyteorder(order))
        data = p.tobytes()
        if predictor == 3:
            planes = p.astype(z.dtype.newbyteorder(">")).view(np.uint8).reshape(*p.shape, -1).transpose(0, 2, 1).reshape(len(p), -1)
            data = np.diff(planes, axis=1, prepend=np.zeros((len(p), 1), np.uint8)).astype(np.uint8).tobytes()
        data = zlib.compress(data) if compression == 8 else data
        offsets.append(len(body))
        sizes.append(len(data))
        body += data
    tags = [(256, "u4", [w]), (257, "u4", [h]), (258, "u2", [z.dtype.itemsize * 8]), (259, "u2", [compression]), (277, "u2", [1]), (317, "u2", [predictor]), (339, "u2", [kind])]
    tags += [(322, "u4", [tile]), (323, "u4", [tile]), (324, "u4", offsets), (325, "u4", sizes)] if tile else [(273, "u4", offsets), (278, "u4", [rows_per_strip or h]), (279, "u4", sizes)]
    tags += [(42112, "s", f'<GDALMetadata><Item name="STATISTICS_MINIMUM" sample="0">{statistics[0]}</Item><Item name="STATISTICS_MAXIMUM">{statistics[1]}</Item></GDALMetadata>')] if statistics else []
    entries = b""
    for tag, code, value in sorted([*tags, *extra]):
        data = value.encode() + b"\0" if code == "s" else np.array(value, dtype=order + code).tobytes()
        count = len(data) if code == "s" else len(value)
        room = 8 if big else 4
        if len(data) > room:
            at = len(body)
            body += data
            data = struct.pack(order + word, at)
        entries += struct.pack(order + "HH" + word, tag, CODES[code], count) + data.ljust(room, b"\0")
    at = len(body)
    body += struct.pack(order + ("Q" if big else "H"), len(tags) + len(extra)) + entries + b"\0" * 8
    body[: 16 if big else 8] = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return bytes(body)


PLACED = ((33550, "f8", [0.01, 0.02, 0.0]), (33922, "f8", [0, 0, 0, 10.0, 50.0, 0]), (34735, "u2", [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326]), (42113, "s", "-9999"))


def test_headers(spark, tmp_path):
    geotiff.register(spark)
    z = np.arange(600, dtype="f4").reshape(20, 30)
    (tmp_path / "a.tif").write_bytes(_tiff(z, extra=PLACED, statistics=(-5.5, 599)))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.TIFF").write_bytes(_tiff(z, ">", True, tile=16, compression=8, extra=((34264, "f8", [0.1, 0, 0, 5, 0, -0.1, 0, 6, *[0] * 8]), (34735, "u2", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32650]))))
    (tmp_path / "c.tif").write_bytes(b"II*\0\xff\xff\0\0" + b"\0" * 20)
    (tmp_path / "d.tif").write_bytes(b"not one at all, by its first bytes")
    (tmp_path / "e.tif").write_bytes(b"")
    (tmp_path / "f.txt").write_bytes(b"II*\0")
    rows = {r["name"]: r for r in spark.read.format("geotiff_header").option("filesPerTask", 2).load(str(tmp_path)).collect()}
    assert set(rows) == {"a.tif", "b.TIFF", "c.tif", "d.tif", "e.tif"}
    a, b = rows["a.tif"], rows["b.TIFF"]
    assert (a.width, a.height, a.bits, a.sample_format, a.samples, a.compression, a.scale, a.tie, a.model, a.geographic, a.projected, a.nodata, a.low, a.high, a.big_tiff, a.error) == (30, 20, 32, 3, 1, 1, [0.01, 0.02, 0.0], [0, 0, 0, 10, 50, 0], 2, 4326, None, -9999.0, -5.5, 599.0, False, None)
    assert (b.big_tiff, b.tile_width, b.compression, b.transform[3], b.model, b.projected, b.nodata, b.low) == (True, 16, 8, 5.0, 1, 32650, None, None)
    assert all(rows[n].width is None and rows[n].error for n in ("c.tif", "d.tif", "e.tif"))
    found = {r["name"]: r for r in headers.records(spark.read.format("geotiff_header").load(str(tmp_path))).collect()}
    a = found["a.tif"]
    assert (a.west, a.north, round(a.east, 9), round(a.south, 9), a.epsg, a.warnings) == (10.0, 50.0, 10.3, 49.6, 4326, [])
    assert found["b.TIFF"].warnings == ["crs_unresolved"] and found["c.tif"].warnings == ["header_unreadable", ] and found["b.TIFF"].geotransform == [5.0, 0.1, 0.0, 6.0, 0.0, -0.1]


def test_only_the_directory_is_read():
    z = np.zeros((500, 500), dtype="f4")
    data, asked = _tiff(z, rows_per_strip=1, extra=PLACED), []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    assert geotiff.header(geotiff.directory(read, len(data)))["height"] == 500
    assert sum(asked) < 600 and len(data) > 1_000_000


@pytest.mark.parametrize(
    ("kind", "options"),
    [("f4", {}), ("i2", {"order": ">", "rows_per_strip": 7}), ("u1", {"tile": 16, "compression": 8}), ("i2", {"compression": 8, "predictor": 2, "rows_per_strip": 5}), ("f4", {"compression": 8, "predictor": 3, "tile": 16}), ("f8", {"big": True, "order": ">", "tile": 32}), ("u2", {"predictor": 2, "order": ">"})],
)
def test_rasters_come_as_blocks(spark, tmp_path, kind, options):
    geotiff.register(spark)
    rng = np.random.default_rng(0)
    rasters = [(rng.normal(size=s) * 50 + 100).astype(kind) for s in ((37, 50), (8, 8))]
    rasters[0][3, 4:9] = 7
    for k, z in enumerate(rasters):
        (tmp_path / f"r{k}.tif").write_bytes(_tiff(z, extra=((42113, "s", "7"),), **options))
    found = blocks.to_pixels(spark.read.format("geotiff_blocks").option("side", 8).option("bandsPerTask", 2).load(str(tmp_path)), 8)
    got = {(r.raster, r.row, r.col): r.elev for r in found.collect()}
    assert got == {(k, r, c): float(v) for k, z in enumerate(rasters) for (r, c), v in np.ndenumerate(z) if v != 7}


def test_what_is_not_read(spark, tmp_path):
    geotiff.register(spark)
    (tmp_path / "a.tif").write_bytes(_tiff(np.zeros((4, 4), "u1"), compression=5))
    with pytest.raises(Exception, match="compression 5"):
        spark.read.format("geotiff_blocks").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="none"):
        spark.read.format("geotiff_header").load(str(tmp_path / "none")).select(F.lit(1)).collect()
