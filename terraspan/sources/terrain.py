"""Elevation files: tiled level files, float GeoTIFF, and single delta-coded grids, as Python data sources and sinks.

A level file has a header of 32 bytes, an index entry of 16 bytes a tile, and the tiles'
payloads: zlib over 16-bit residuals (see ``raster.encode``). All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain, groupby
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .. import storage
from ..operators import raster
from . import staged

#: Fixed values of the format. The magic is eight ASCII characters and an option.
MAGIC, VERSION, HEADER, ENTRY = "TILELEVL", 2, "<8sHHBBBxIIIhxx", "<IIHhhxx"
HEADER_BYTES, ENTRY_BYTES = 32, 16
#: TIFF tags, with what they must be.
TIFF_EXPECTED = {258: (32, "bits per sample"), 339: (3, "sample format"), 259: (8, "compression"), 317: (3, "predictor")}
MAX_LEVELS = 6


def check_levels(levels: int) -> int:
    """Refuses numbers of levels that the format's users don't know."""
    if not 0 <= levels <= MAX_LEVELS:
        raise ValueError(f"levels must be 0 to {MAX_LEVELS}, not {levels}")
    return levels


def residuals(samples: np.ndarray) -> bytes:
    """Differences from the left neighbour, or in the first column from the one above, in 16 bits."""
    wide = samples.astype(np.int64)
    left = np.zeros_like(wide)
    left[:, 1:] = wide[:, :-1]
    left[1:, 0] = wide[:-1, 0]
    return (wide - left).astype("<i2").tobytes()


def encode_tile(samples: np.ndarray) -> bytes:
    """Payload of a square tile of 16-bit samples."""
    return zlib.compress(residuals(samples), 9)


def decode_grid(residuals: np.ndarray) -> np.ndarray:
    """Samples from residuals: running sums down the first column and along rows, modulo 2^16."""
    wide = residuals.astype(np.int64)
    wide[:, 0] = np.cumsum(wide[:, 0])
    return np.cumsum(wide, axis=1).astype(np.int16)


def decode_tile(payload: bytes, stored: int) -> np.ndarray:
    return decode_grid(np.frombuffer(zlib.decompress(payload), "<i2").reshape(stored, stored))


def read_header(data: bytes, magic: str | None = None) -> dict:
    """The header's fields; refuses another magic (if one is asked for) or version."""
    found, version, tile, border, levels, level, index_bytes, data_offset, count, peak = struct.unpack_from(HEADER, data)
    if magic is not None and found != magic.encode("ascii"):
        raise ValueError(f"the file's magic is {found!r}")
    if version != VERSION:
        raise ValueError(f"the file has version {version}, expected {VERSION}")
    return {"tile": tile, "border": border, "levels": levels, "level": level, "index_bytes": index_bytes, "data_offset": data_offset, "tiles": count, "peak": peak}


def write_levels(tiles: DataFrame, stats: DataFrame, path: str, levels: int, peak: int, tile: int = raster.TILE, magic: str = MAGIC) -> DataFrame:
    """Writes ``level-<z>.bin`` files under ``path``, in place of what is there; returns ``(z, file, bytes, tiles)``.

    ``tiles`` is ``(z, ty, tx, r, c, h)`` with borders, ``stats`` is ``(z, ty, tx, error, low, high)``.
    Tiles are packed where they are; one task streams a level's index and payloads, in order, into its file. Files appear when all are written.
    """
    stored = tile + 2 * raster.BORDER

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((stored, stored), dtype=np.int64)
        grid[frame["r"].to_numpy(), frame["c"].to_numpy()] = frame["h"].to_numpy()
        first = frame.iloc[0]
        return pd.DataFrame({"z": [first["z"]], "ty": [first["ty"]], "tx": [first["tx"]], "payload": [encode_tile(grid)]})

    packed = tiles.select("z", "ty", "tx", "r", "c", "h").groupBy("z", "ty", "tx").applyInPandas(pack, "z int, ty long, tx long, payload binary")
    joined = storage.materialize(packed.join(stats.select("z", "ty", "tx", *(F.col(c).cast("long").alias(c) for c in ("error", "low", "high"))), ["z", "ty", "tx"]))
    rows = staged.indexed(joined.withColumn("length", F.length("payload").cast("long")), "z", ["ty", "tx"], ["length", "error", "low", "high"])
    spark = tiles.sparkSession
    spark.dataSource.register(TerrainSource)
    rows.write.format("terrain").mode("overwrite").options(magic=magic, tile=tile, levels=levels, peak=peak).save(path)
    made = []
    for f in storage.files(path):  # a file a level
        head = read_header(storage.read_range(f, 0, HEADER_BYTES), magic)
        last = struct.unpack(ENTRY, storage.read_range(f, head["data_offset"] - ENTRY_BYTES, head["data_offset"]))
        made.append((head["level"], f.rsplit("/", 1)[1], head["data_offset"] + last[0] + last[1], head["tiles"]))
    return spark.createDataFrame(made, "z int, file string, bytes long, tiles long")


class LevelWriter(staged.StagedWriter):
    """Level files from ``staged.indexed`` rows of tiles."""

    def __init__(self, path: str, overwrite: bool, magic: str, tile: int, levels: int, peak: int):
        super().__init__(path, overwrite)
        self.magic, self.tile, self.levels, self.peak = magic, tile, levels, peak

    def parts(self, rows):
        for z, level in groupby(rows, key=lambda r: r["z"]):
            yield f"level-{z}.bin", self._level(z, level)

    def _level(self, z: int, rows) -> Iterator[bytes]:
        index, offset, begun = [], 0, False
        for r in rows:
            if r["kind"] == 0:
                index.append(struct.pack(ENTRY, offset, r["length"], r["error"], r["low"], r["high"]))
                offset += r["length"]
                continue
            if not begun:
                begun, size = True, len(index) * ENTRY_BYTES
                yield struct.pack(HEADER, self.magic.encode("ascii"), VERSION, self.tile, raster.BORDER, self.levels, z, size, HEADER_BYTES + size, len(index), self.peak) + b"".join(index)
            yield bytes(r["payload"])


class _Run(InputPartition):
    def __init__(self, path: str, head: dict, entries: list[tuple]):
        self.path, self.head, self.entries = path, head, entries


class TerrainReader(DataSourceReader):
    """A partition is a run of up to ``run`` tiles of one file, read by one range; z, ty and tx predicates choose them."""

    def __init__(self, path: str, magic: str | None, run: int):
        self.path, self.magic, self.run, self.wanted = path, magic, run, {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("z", "ty", "tx"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self):
        out = []
        for path in storage.files(self.path):
            head = read_header(storage.read_range(path, 0, HEADER_BYTES), self.magic)
            z = head["level"]
            if z not in self.wanted.get("z", {z}):
                continue
            chosen = [e for e in _entries(path, head) if e[0] in self.wanted.get("ty", {e[0]}) and e[1] in self.wanted.get("tx", {e[1]})]
            out += [_Run(path, head, chosen[i : i + self.run]) for i in range(0, len(chosen), self.run)]
        return out or [_Run("", {}, [])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        return _tiles(partition)


def _entries(path: str, head: dict) -> list[tuple]:
    """``(ty, tx, offset, length, error, low, high)`` of a level's tiles, in the order of the file."""
    index = storage.read_range(path, HEADER_BYTES, HEADER_BYTES + head["index_bytes"])
    return [(*divmod(k, 4 << head["level"]), *struct.unpack_from(ENTRY, index, k * ENTRY_BYTES)) for k in range(head["tiles"])]


def _tiles(partition: _Run) -> Iterator[pa.RecordBatch]:
    """A run's tiles, read by one range, a batch a tile."""
    if partition.entries:
        base, stored = partition.head["data_offset"], partition.head["tile"] + 2 * partition.head["border"]
        first, last = partition.entries[0][2], max(e[2] + e[3] for e in partition.entries)
        block = storage.read_range(partition.path, base + first, base + last)
        for ty, tx, offset, length, error, low, high in partition.entries:
            samples = decode_tile(block[offset - first : offset - first + length], stored)
            yield pa.RecordBatch.from_arrays([
                pa.array([partition.head["level"]], pa.int32()), pa.array([ty], pa.int64()), pa.array([tx], pa.int64()), pa.ListArray.from_arrays(pa.array([0, samples.size], pa.int32()), pa.array(samples.ravel())),
                *(pa.array([v], pa.int32()) for v in (error, low, high)),
            ], names=["z", "ty", "tx", "samples", "error", "low", "high"])


class TerrainStream(DataSourceStreamReader):
    """Tiles of level files as they appear in a folder. An offset says how many tiles of each level there are.

    A level that isn't there although a finer one is counts as missing (-1), and stays so if it comes later. Files must appear whole, as
    the sinks of this package make them.
    """

    def __init__(self, path: str, magic: str | None, run: int):
        self.path, self.magic, self.run = path, magic, run

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        there = {h["level"]: h["tiles"] for _, h in self._heads()}
        return {str(z): there.get(z, -1) for z in range(max(there, default=-1) + 1)}

    def partitions(self, start: dict, end: dict) -> list[_Run]:
        out = []
        for path, head in self._heads():
            z = str(head["level"])
            if start.get(z, 0) >= 0 and start.get(z, 0) < end.get(z, 0):
                chosen = _entries(path, head)[start.get(z, 0) : end[z]]
                out += [_Run(path, head, chosen[i : i + self.run]) for i in range(0, len(chosen), self.run)]
        return out or [_Run("", {}, [])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        return _tiles(partition)

    def commit(self, end: dict) -> None:
        pass

    def _heads(self) -> list[tuple[str, dict]]:
        return [(p, read_header(storage.read_range(p, 0, HEADER_BYTES), self.magic)) for p in storage.files(self.path) if "/_" not in p]


class TerrainSource(DataSource):
    """``spark.read.format("terrain").load(path)``; options ``magic`` (checked if given) and ``run`` (tiles a partition).

    Writes ``staged.indexed`` rows ``(z, kind, ty, tx, length, error, low, high, payload)``; options ``magic``, ``tile``, ``levels``, ``peak``.
    """

    @classmethod
    def name(cls) -> str:
        return "terrain"

    def schema(self) -> str:
        return "z int, ty long, tx long, samples array<short>, error int, low int, high int"

    def reader(self, schema) -> DataSourceReader:
        return TerrainReader(self.options["path"], self.options.get("magic"), int(self.options.get("run", "64")))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return TerrainStream(self.options["path"], self.options.get("magic"), int(self.options.get("run", "64")))

    def writer(self, schema, overwrite: bool) -> LevelWriter:
        number = lambda name, default: int(self.options.get(name, default))
        return LevelWriter(self.options["path"], overwrite, self.options.get("magic", MAGIC), number("tile", raster.TILE), number("levels", 1), number("peak", 0))


def read_levels(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(TerrainSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("terrain").options(**options).load(path)


def stream_levels(spark: SparkSession, path: str, **options) -> DataFrame:
    """The tiles of a folder's level files as a stream; ``read_levels`` has its columns."""
    spark.dataSource.register(TerrainSource)
    return spark.readStream.format("terrain").options(**options).load(path)


def samples_of(tiles: DataFrame, stored: int) -> DataFrame:
    """``(z, ty, tx, r, c, h)`` from tiles with arrays of samples."""
    each = tiles.select("z", "ty", "tx", F.posexplode("samples").alias("_i", "h"))
    return each.select("z", "ty", "tx", F.expr(f"_i div {stored}").alias("r"), (F.col("_i") % stored).cast("long").alias("c"), F.col("h").cast("long").alias("h"))


class GeoTiffReader(DataSourceReader):
    """A partition is a TIFF tile; the directory is read once, on the driver."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        head = storage.read_range(self.path, 0, 8)
        if head[:4] != b"II*\0":
            raise ValueError("not a little-endian classic TIFF")
        start = struct.unpack_from("<I", head, 4)[0]
        count = struct.unpack("<H", storage.read_range(self.path, start, start + 2))[0]
        raw = storage.read_range(self.path, start + 2, start + 2 + 12 * count)
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from("<HHI", raw, 12 * i)
            tags[tag] = (n, struct.unpack_from("<H" if kind == 3 else "<I", raw, 12 * i + 8)[0])
        for tag, (wanted, what) in TIFF_EXPECTED.items():
            if tags.get(tag, (0, None))[1] != wanted:
                raise ValueError(f"unexpected {what}: {tags.get(tag, (0, None))[1]} instead of {wanted}")
        size = {n: tags[t][1] for n, t in (("w", 256), ("h", 257), ("tw", 322), ("th", 323))}
        n = tags[324][0]
        places = [[v] if n == 1 else list(struct.unpack(f"<{n}I", storage.read_range(self.path, v, v + 4 * n))) for v in (tags[324][1], tags[325][1])]
        across = -(-size["w"] // size["tw"])
        return [_Run(self.path, size, [(k // across, k % across, at, length)]) for k, (at, length) in enumerate(zip(*places))]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        s = partition.head
        for ty, tx, at, length in partition.entries:
            plane = np.frombuffer(zlib.decompress(storage.read_range(partition.path, at, at + length)), np.uint8).reshape(s["th"], s["tw"] * 4)
            values = undo_predictor(plane, s["tw"])
            high, wide = min(s["th"], s["h"] - ty * s["th"]), min(s["tw"], s["w"] - tx * s["tw"])
            sy, sx = np.mgrid[ty * s["th"] : ty * s["th"] + high, tx * s["tw"] : tx * s["tw"] + wide]
            yield pa.RecordBatch.from_arrays([pa.array(sx.ravel()), pa.array(sy.ravel()), pa.array(values[:high, :wide].ravel().astype(np.float64))], names=["sx", "sy", "value"])


def undo_predictor(plane: np.ndarray, width: int) -> np.ndarray:
    """Floats from rows of byte-wise differences whose four byte planes, most significant first, lie side by side."""
    summed = np.cumsum(plane, axis=1, dtype=np.uint64).astype(np.uint8)
    return summed.reshape(len(plane), 4, width).transpose(0, 2, 1).copy().view(">f4")[..., 0]


def predicted(values: np.ndarray) -> np.ndarray:
    """Rows of byte-wise differences from floats: the inverse of ``undo_predictor``."""
    planes = np.ascontiguousarray(values, dtype=">f4").view(np.uint8).reshape(*values.shape, 4).transpose(0, 2, 1).reshape(len(values), -1)
    return np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8)


class GeoTiffWriter(staged.StagedWriter):
    """One ``raster.tif`` from ``staged.indexed`` rows of tiles, in the order of rows of tiles."""

    def __init__(self, path: str, overwrite: bool, width: int, height: int, tile: int):
        super().__init__(path, overwrite)
        self.width, self.height, self.tile = width, height, tile

    def parts(self, rows):
        rows = iter(rows)
        first = next(rows, None)
        if first is not None:
            yield "raster.tif", self._file(chain([first], rows))

    def _file(self, rows) -> Iterator[bytes]:
        sizes, begun = [], False
        for r in rows:
            if r["kind"] == 0:
                sizes.append(r["length"])
                continue
            if not begun:
                begun = True
                yield self._head(sizes)
            yield bytes(r["payload"])

    def _head(self, sizes: list[int]) -> bytes:
        n, tags = len(sizes), {256: self.width, 257: self.height, 262: 1, 277: 1, 322: self.tile, 323: self.tile} | {t: v for t, (v, _) in TIFF_EXPECTED.items()}
        arrays = 8 + 2 + 12 * (len(tags) + 2) + 4
        data = arrays + 8 * n * (n > 1)
        offsets = [data + sum(sizes[:k]) for k in range(n)] if n < 2 else (data + np.cumsum([0, *sizes[:-1]])).tolist()
        if data + sum(sizes) >= 1 << 32:
            raise ValueError("a classic TIFF has 4 GB at most")
        tags |= {324: arrays if n > 1 else offsets[0], 325: arrays + 4 * n if n > 1 else sizes[0]}
        entries = b"".join(struct.pack("<HHII", t, 4, n if t in (324, 325) else 1, v) for t, v in sorted(tags.items()))
        return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + bytes(4) + (struct.pack(f"<{2 * n}I", *offsets, *sizes) if n > 1 else b"")


def write_geotiff(samples: DataFrame, path: str, width: int, height: int, tile: int = 64) -> None:
    """Writes ``raster.tif`` under ``path`` from ``(sx, sy, value)``, absent samples as 0. Tiles are packed apart; one task streams them into the file."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((tile, tile), dtype=np.float32)
        grid[frame["sy"].to_numpy() % tile, frame["sx"].to_numpy() % tile] = frame["value"].to_numpy()
        return pd.DataFrame({"ty": [frame["sy"].iloc[0] // tile], "tx": [frame["sx"].iloc[0] // tile], "payload": [zlib.compress(predicted(grid).tobytes(), 9)]})

    spark = samples.sparkSession
    every = spark.range(-(-height // tile) * -(-width // tile)).select((F.floor(F.col("id") / -(-width // tile)) * tile).alias("sy"), (F.col("id") % -(-width // tile) * tile).alias("sx"), F.lit(None).cast("double").alias("value"))
    given = samples.select("sy", "sx", F.col("value").cast("double").alias("value")).unionByName(every).groupBy("sy", "sx").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))
    packed = given.groupBy(F.floor(F.col("sy") / tile).alias("_ty"), F.floor(F.col("sx") / tile).alias("_tx")).applyInPandas(lambda f: pack(f[["sy", "sx", "value"]]), "ty long, tx long, payload binary")
    packed = storage.materialize(packed).withColumns({"file": F.lit("raster"), "length": F.length("payload").cast("long")})
    spark.dataSource.register(GeoTiffSource)
    rows = staged.indexed(packed, "file", ["ty", "tx"], ["length"])
    rows.write.format("geotiff").mode("overwrite").options(width=width, height=height, tile=tile).save(path)


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: 32-bit float, Deflate, floating-point predictor, tiled. Writes ``staged.indexed`` rows; options ``width``, ``height``, ``tile``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "sx long, sy long, value double"

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options["path"], overwrite, *(int(self.options[k]) for k in ("width", "height", "tile")))


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").load(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """``(sx, sy, value)`` of single-grid files: zlib over a head with width and height (bytes 4 to 7) and residuals from byte 8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column("content"):
                data = zlib.decompress(packed.as_py())
                width, height = struct.unpack_from("<HH", data, 4)
                grid = decode_grid(np.frombuffer(data, "<i2", offset=8).reshape(height, width))
                sy, sx = np.mgrid[:height, :width]
                yield pa.RecordBatch.from_arrays([pa.array(sx.ravel()), pa.array(sy.ravel()), pa.array(grid.ravel().astype(np.float64))], names=["sx", "sy", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sx long, sy long, value double")


class GridWriter(staged.StagedWriter):
    """A ``<name>.bin`` a row ``(name, content)``."""

    def parts(self, rows):
        for r in rows:
            yield f"{quote(r['name'], safe='')}.bin", iter([bytes(r["content"])])


class GridSource(DataSource):
    """The sink of single grids, from ``(name, content)``; they are read by ``read_grid``."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(self.options["path"], overwrite)


def write_grids(samples: DataFrame, path: str) -> None:
    """Writes ``<name>.bin`` under ``path`` for each grid of ``(name, sx, sy, value)``, 16-bit samples; a grid has 65,535 rows and columns at most, and absent samples are 0."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(frame["sy"].max()) + 1, int(frame["sx"].max()) + 1), dtype=np.int16)
        grid[frame["sy"].to_numpy(), frame["sx"].to_numpy()] = frame["value"].to_numpy()
        head = b"\0" * 4 + struct.pack("<HH", grid.shape[1], grid.shape[0])
        return pd.DataFrame({"name": [frame["name"].iloc[0]], "content": [zlib.compress(head + residuals(grid), 9)]})

    spark = samples.sparkSession
    spark.dataSource.register(GridSource)
    packed = samples.select("name", "sx", "sy", F.col("value").cast("short").alias("value")).groupBy("name").applyInPandas(pack, "name string, content binary")
    packed.write.format("grid").mode("overwrite").save(path)
