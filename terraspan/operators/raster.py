"""Elevation rasters as long tables: averaging, pyramids, prediction, tiles, codecs, sampling.

A grid is ``(y, x, h)`` row-major from the north-west; a level ``z`` with tiles of ``tile``
samples is ``4 tile 2^z`` wide and ``2 tile 2^z`` high. Everything is keyed by cell or by
tile, so every shuffle spreads over the grid; windows run inside one tile or over one
level's tile index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, round_up, wrap16
from .series import along, total

#: Samples a side of a tile, border samples, the no-data bound, the cap of an error.
TILE, BORDER, NODATA, MAX_ERROR = 128, 1, -99_999, 65_535
EARTH_RADIUS_M, MIN_COS_LAT = 6_371_000, 0.02


def valid_samples(df: DataFrame, value: str = "value") -> DataFrame:
    """Without null, non-finite and no-data samples."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v > NODATA))


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All cells ``(y, x)``."""
    cells = spark.range(width * height)
    return cells.select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))


def box_average(samples: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """``(y, x, h, hits)`` for every target cell from ``(sx, sy, value)``: the rounded mean, 0 without samples.

    Sums of whole numbers are exact, so the result doesn't depend on the order of rows.
    """
    (sw, sh), (w, h) = source, target
    cell = samples.groupBy(F.expr(f"cast((sy * {h}) div {sh} as long)").alias("y"), F.expr(f"cast((sx * {w}) div {sw} as long)").alias("x"))
    mean = cell.agg(F.sum("value").alias("_sum"), F.count("value").alias("hits")).select("y", "x", round_up(F.col("_sum") / F.col("hits").cast("double")).alias("h"), "hits")
    dense = grid(samples.sparkSession, w, h).join(mean, ["y", "x"], "left")
    return dense.select("y", "x", F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("hits", F.lit(0)).alias("hits"))


def reduce_level(fine: DataFrame) -> DataFrame:
    """The next coarser level: rounded means of 2 x 2 cells."""
    quarter = fine.groupBy(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"))
    return quarter.agg(round_up(F.sum("h") / F.lit(4.0)).alias("h"))


def pyramid(finest: DataFrame, levels: int) -> DataFrame:
    """``(z, y, x, h)`` of all levels; each is averaged from the one above it, for each rounds."""
    out, now = None, finest.select("y", "x", "h")
    for z in range(levels - 1, -1, -1):
        out = now.withColumn("z", F.lit(z)) if out is None else out.unionByName(now.withColumn("z", F.lit(z)))
        now = reduce_level(now)
    return out.select("z", "y", "x", "h")


def peak(finest: DataFrame) -> DataFrame:
    """``peak``: the highest sample, 0 at least."""
    return finest.agg(F.greatest(F.lit(0), F.coalesce(F.max("h"), F.lit(0))).alias("peak"))


def predict(parent: DataFrame, width: int, height: int) -> DataFrame:
    """``(y, x, predicted)`` of a level of the given size, bilinear from its parent.

    Each parent sample is sent to the cells that read it, with its weight in sixteenths, and
    cells sum what they get: one shuffle and no join. Longitude wraps, latitude clamps.
    """
    ph = height // 2
    xs = [(2, 0, 3), (2, 1, 3), (2, 2, 1), (2, -1, 1)]
    across = F.array(*(F.struct(F.pmod(F.col("x") * m + d, F.lit(width)).alias("x"), F.lit(w).alias("w")) for m, d, w in xs))
    down = F.array(*(F.struct((F.col("y") * m + d).alias("y"), F.lit(w).alias("w")) for m, d, w in xs))
    edge = F.array(
        F.struct(F.when(F.col("y") == 0, F.lit(0)).cast("long").alias("y"), F.lit(1).alias("w")),
        F.struct(F.when(F.col("y") == ph - 1, F.lit(height - 1)).cast("long").alias("y"), F.lit(1).alias("w")),
    )
    sent = parent.select("h", F.explode(across).alias("_x"), F.lit(1).alias("_"), "y").select("h", "_x", F.explode(F.concat(down, edge)).alias("_y"))
    sent = sent.filter(F.col("_y.y").between(0, height - 1))
    weighted = F.sum(F.col("h") * F.col("_x.w") * F.col("_y.w")) / F.lit(16.0)
    return sent.groupBy(F.col("_y.y").alias("y"), F.col("_x.x").alias("x")).agg(round_up(weighted).alias("predicted"))


def tile_stats(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Per tile of ``(z, y, x, h, predicted)``: ``error`` (capped), ``low``, ``high``; interior samples only."""
    keys = ["z", F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx")]
    return cells.groupBy(*keys).agg(F.least(F.lit(MAX_ERROR), F.max(F.abs(F.col("h") - F.col("predicted")))).alias("error"), F.min("h").alias("low"), F.max("h").alias("high"))


def payload_offsets(tiles: DataFrame, length: str = "length", order: tuple[str, ...] = ("ty", "tx")) -> DataFrame:
    """Adds ``offset``: where a tile's payload begins in its level's file. A level is cut into pieces of tiles."""
    summed = along(tiles, ["z"], list(order), _end=total(length))
    return summed.select(*tiles.columns, (F.coalesce(F.col("_end"), F.lit(0)) - F.coalesce(F.col(length), F.lit(0))).alias("offset"))


def cut_tiles(cells: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """``(z, ty, tx, r, c, h)``: each cell sent to its tile and, at an edge, into the neighbours' borders.

    Borders are one sample wide; longitude wraps and latitude repeats the outermost row.
    """
    across, down = width // tile, height // tile
    pair = lambda t, at: F.struct(t.cast("long").alias("t"), at.cast("long").alias("at"))
    tx, px, ty, py = (F.expr(e) for e in (f"x div {tile}", f"x % {tile}", f"y div {tile}", f"y % {tile}"))
    xs = F.array(pair(tx, px + 1), F.when(px == 0, pair(F.pmod(tx - 1, F.lit(across)), F.lit(tile + 1))), F.when(px == tile - 1, pair(F.pmod(tx + 1, F.lit(across)), F.lit(0))))
    ys = F.array(
        pair(ty, py + 1), F.when((py == 0) & (ty > 0), pair(ty - 1, F.lit(tile + 1))), F.when((py == tile - 1) & (ty < down - 1), pair(ty + 1, F.lit(0))),
        F.when(F.col("y") == 0, pair(ty, F.lit(0))), F.when(F.col("y") == height - 1, pair(ty, F.lit(tile + 1))),
    )
    sent = cells.select("z", "h", F.explode(F.array_compact(xs)).alias("_x"), "y").select("z", "h", "_x", F.explode(F.array_compact(ys)).alias("_y"))
    return sent.select("z", F.col("_y.t").alias("ty"), F.col("_x.t").alias("tx"), F.col("_y.at").alias("r"), F.col("_x.at").alias("c"), "h")


def encode(tiles: DataFrame, keys: tuple[str, ...] = ("z", "ty", "tx")) -> DataFrame:
    """Adds ``residual``: a sample less its left neighbour, in column 0 the one above, as 16 bits."""
    row, column = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    before = F.coalesce(F.lag("h").over(row), F.when(F.col("c") == 0, F.lag("h").over(column)), F.lit(0))
    return tiles.withColumn("residual", wrap16(F.col("h") - before))


def decode(tiles: DataFrame, keys: tuple[str, ...] = ("z", "ty", "tx")) -> DataFrame:
    """Adds ``h`` from ``residual``: running sums down column 0 and along rows, reduced once to 16 bits."""
    row, column = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    first = F.when(F.col("c") == 0, F.sum("residual").over(column)).otherwise(F.col("residual"))
    return tiles.withColumn("_first", first).withColumn("h", wrap16(F.sum("_first").over(row))).drop("_first")


def tiles_across(z: Column) -> Column:
    return F.shiftleft(F.lit(4), 0) * F.pow(F.lit(2.0), z).cast("long")


def tile_of(z: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """``(tx, ty)`` of a position; u wraps, both are clamped to the level."""
    across = tiles_across(z)
    down = F.expr("0") + (across / 2).cast("long")
    return clamp(F.floor((u - F.floor(u)) * across), F.lit(0), across - 1), clamp(F.floor(v * down), F.lit(0), down - 1)


def tile_base(z: Column) -> Column:
    """Tiles of all coarser levels: the sum of 8 * 4^k below z."""
    return ((F.pow(F.lit(4.0), z) - 1) * 8 / 3).cast("long")


def tile_id(z: Column, tx: Column, ty: Column) -> Column:
    return tile_base(z) + ty * tiles_across(z) + tx


def level_of(tile_id: Column, levels: int) -> Column:
    """The level whose ids include ``tile_id``; ids below 0 belong to level 0."""
    out = F.lit(0)
    for z in range(1, levels):
        out = F.when(tile_id >= 8 * (4**z - 1) // 3, F.lit(z)).otherwise(out)
    return out


def in_tile(z: Column, u: Column, v: Column, tile: int = TILE) -> tuple[Column, Column]:
    """``(fx, fy)``: the position in stored samples of its tile, border included."""
    tx, ty = tile_of(z, u, v)
    width = tiles_across(z) * tile
    return (u - F.floor(u)) * width - 0.5 - tx * tile + BORDER, v * (width / 2) - 0.5 - ty * tile + BORDER


def tile_arrays(stored: DataFrame, tile: int = TILE) -> DataFrame:
    """``(z, ty, tx, samples)`` from samples ``(z, ty, tx, r, c, h)``: a row a tile, its samples row by row as ``(at, h)``."""
    at = (F.col("r") * (tile + 2 * BORDER) + F.col("c")).cast("int")
    return stored.groupBy("z", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("h").cast("double").alias("h")))).alias("samples"))


def _tap(samples: Column, at: Column, whole: int, plain: bool) -> Column:
    """The sample at a place; in tiles that lack some it is looked for. ``plain``: an array of numbers."""
    at = at.cast("int")
    if plain:
        return F.get(samples, at).cast("double")
    return F.when(F.size(samples) == whole, F.get(samples, at)["h"]).otherwise(F.get(F.filter(samples, lambda s: s["at"] == at), F.lit(0))["h"])


def sample_heights(points: DataFrame, stored: DataFrame, level: int, tile: int = TILE, slopes: bool = False) -> DataFrame:
    """Adds ``height, answered`` (and ``east, north``) to points ``(point_id, u, v)``; other columns stay.

    ``stored`` has the resident tiles' samples ``(z, ty, tx, r, c, h)``, or is ``tile_arrays`` or tiles as they are read, with whole arrays of numbers. The finest level up to
    ``level`` that has the point's tile answers, bilinearly; without any the height is 0 and the
    level -1. A point meets its tile of each level in one equi-join on (z, ty, tx) and takes four elements of the tile's array;
    the finest answer is a partial aggregate, so neither samples nor tiles travel with the points.
    """
    z, n = F.col("z"), tile + 2 * BORDER
    tiles = stored if "samples" in stored.columns else tile_arrays(stored, tile)
    asked = points.select(F.monotonically_increasing_id().alias("_n"), F.struct(*points.columns).alias("_row"), "u", "v")
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(level))).alias("z"))
    tx, ty = tile_of(z, F.col("u"), F.col("v"))
    fx, fy = in_tile(z, F.col("u"), F.col("v"), tile)
    asked = asked.withColumns({"tx": tx, "ty": ty, "_fx": fx, "_fy": fy})
    met = asked.join(tiles.select("z", "ty", "tx", "samples"), ["z", "ty", "tx"], "left")
    first = F.floor("_fy") * n + F.floor("_fx")
    plain = not tiles.schema["samples"].dataType.simpleString().startswith("array<struct")
    taps = [_tap(F.col("samples"), first + step, n * n, plain).alias(f"h{i}") for i, step in enumerate((0, 1, n, n + 1))]
    four = F.struct(z.alias("z"), (F.col("_fx") - F.floor("_fx")).alias("sx"), (F.col("_fy") - F.floor("_fy")).alias("sy"), *taps)
    best = met.select("_n", "_row", F.when(F.col("samples").isNotNull(), four).alias("_s")).groupBy("_n").agg(F.any_value("_row").alias("_row"), F.max_by("_s", F.col("_s.z")).alias("_s"))
    got = best.select("_row.*", F.col("_s.z").alias("_z"), *(F.col(f"_s.{c}").alias(f"_{c}") for c in ("sx", "sy", "h0", "h1", "h2", "h3")))
    top, bottom = F.expr("_h0 + (_h1 - _h0) * _sx"), F.expr("_h2 + (_h3 - _h2) * _sx")
    added = {"height": F.coalesce(top + (bottom - top) * F.col("_sy"), F.lit(0.0)), "answered": F.coalesce("_z", F.lit(-1))}
    if slopes:
        width = tiles_across(F.col("_z")) * tile
        cos_lat = F.greatest(F.lit(MIN_COS_LAT), F.cos((0.5 - F.col("v")) * F.pi()))
        added["east"] = F.coalesce(F.expr("_h1 - _h0 + (_h3 - _h2 - (_h1 - _h0)) * _sy") * width / (2 * F.pi() * EARTH_RADIUS_M * cos_lat), F.lit(0.0))
        added["north"] = F.coalesce(-F.expr("_h2 - _h0 + (_h3 - _h1 - (_h2 - _h0)) * _sx") * (width / 2) / (F.pi() * EARTH_RADIUS_M), F.lit(0.0))
    return got.select(*points.columns, *(c.alias(k) for k, c in added.items()))
