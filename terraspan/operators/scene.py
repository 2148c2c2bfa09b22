"""Scenes: label boxes and decluttering, models, painter's order, layers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.numbers import clamp, round_up
from ..storage import materialize
from . import raster, tracks

#: Padding of a label box, line height, least visible alpha, light direction and share, steps of shading.
PADDING, LINE, FAINT = 2, 1.2, 0.02
LIGHT, AMBIENT, SHADES = (-0.42, 0.58, 0.7), 0.3, 64
LAYERS = ("overlay", "disc", "regions", "graticule", "coast", "limb", "shapes", "orbits", "models", "labels")
#: The labels of a scene that one row decides.
FOLD = 512


def label_boxes(labels: DataFrame) -> DataFrame:
    """Adds ``bl, bt, br, bb`` to labels ``(x, y, width, size, placement, gap, dx, dy)``; defaults: size 12, right, gap 10, no shift."""
    size, gap = F.coalesce("size", F.lit(12.0)), F.coalesce("gap", F.lit(10.0))
    height, place = size * LINE, F.coalesce("placement", F.lit("right"))
    middle_x = F.col("x") - F.col("width") / 2
    left = F.when(place == "left", F.col("x") - gap - F.col("width")).when(place.isin("above", "below", "centre"), middle_x).otherwise(F.col("x") + gap)
    middle = F.when(place == "above", F.col("y") - gap - height / 2).when(place == "below", F.col("y") + gap + height / 2).otherwise(F.col("y"))
    left, middle = left + F.coalesce("dx", F.lit(0.0)), middle + F.coalesce("dy", F.lit(0.0))
    return labels.select("*", (left - PADDING).alias("bl"), (middle - height / 2 - PADDING).alias("bt"), (left + F.col("width") + PADDING).alias("br"), (middle + height / 2 + PADDING).alias("bb"))


def declutter(labels: DataFrame, by: str = "scene", cell: float = 64.0) -> DataFrame:
    """The labels that are drawn, of ``(scene, priority, text, visible, alpha, declutter, bl, bt, br, bb)``.

    In order of priority a label claims its box if it overlaps no claimed one; with ``declutter``
    false it is drawn anyway, and claims too. Hidden, faint and empty labels claim nothing.

    The rule is sequential. Scenes of at most FOLD labels are folded each in one row. In larger ones it is sequential only along chains of overlapping
    labels, so they are carried out in rounds that take all labels at once, until FOLD are undecided, which are then folded.
    Boxes lie in the cells of a grid. First, polite labels go that overlap an earlier one drawn anyway. In a round, a label that comes first in
    every cell it touches has nothing undecided before it and is drawn; there is one such label a cell at most, and labels that overlap it go.
    A round is a few aggregates and joins on cells with a row a (label, cell), never pairs of labels; rounds are as many as the longest chain of labels
    each held up by the one before, which for priorities unrelated to places grows with the logarithm of the labels.
    """
    shown = F.col("visible") & (F.col("alpha") >= FAINT) & (F.coalesce(F.col("text"), F.lit("")) != "")
    box = F.struct("priority", F.coalesce("declutter", F.lit(True)).alias("polite"), "bl", "bt", "br", "bb").alias("box")
    boxes = materialize(labels.filter(shown).select(by, box).distinct())
    crowded = _crowded(boxes, by)
    if crowded.isEmpty():
        drawn = [_folded(boxes, by)]
    else:
        drawn = [_folded(_without(boxes, crowded, by, [by]), by), *_rounds(_without(boxes, crowded, by, [by], "left_semi"), by, cell)]
    chosen = drawn[0]
    for more in drawn[1:]:
        chosen = chosen.unionByName(more)
    return labels.filter(shown).join(chosen.select(F.col(by).alias("_by"), F.col("box.priority").alias("_priority")), [F.col(by).eqNullSafe(F.col("_by")), F.col("priority") == F.col("_priority")], "left_semi")


def _hit(a: Column, b: Column) -> Column:
    return (a["bl"] < b["br"]) & (a["br"] > b["bl"]) & (a["bt"] < b["bb"]) & (a["bb"] > b["bt"])


def _crowded(boxes: DataFrame, by: str) -> DataFrame:
    return boxes.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FOLD).select(by)


def _folded(boxes: DataFrame, by: str) -> DataFrame:
    """The boxes ``(scene, box)`` that are drawn, by the rule itself, a scene a row."""
    listed = boxes.groupBy(by).agg(F.array_sort(F.collect_list("box")).alias("_boxes"))
    claim = lambda taken, b: F.when(F.exists(taken, lambda t: _hit(b, t)) & b["polite"], taken).otherwise(F.concat(taken, F.array(b)))
    return listed.select(by, F.explode(F.aggregate("_boxes", F.array().cast(listed.schema["_boxes"].dataType), claim)).alias("box"))


def _rounds(boxes: DataFrame, by: str, cell: float) -> list[DataFrame]:
    """Tables of the boxes that are drawn, for scenes of any size."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"box.{lo}") / cell), F.floor(F.col(f"box.{hi}") / cell))
    cells = boxes.select(by, "box", F.explode(span("bl", "br")).alias("cx"))
    cells = materialize(cells.select(by, "box", "cx", F.explode(span("bt", "bb")).alias("cy")))
    place = [by, "cx", "cy"]
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in place]
    always, polite = cells.filter(~F.col("box.polite")), cells.filter("box.polite")
    refused = polite.alias("p").join(always.alias("q"), [*same, _hit(F.col("p.box"), F.col("q.box")), F.col("q.box") < F.col("p.box")], "left_semi").select(by, "box").distinct()
    open_ = materialize(_without(polite, refused, by))
    drawn = [always.select(by, "box").distinct()]
    while not _crowded(open_.select(by, "box").distinct(), by).isEmpty():
        first = open_.groupBy(*place).agg(F.min("box").alias("first"))
        seen = open_.alias("p").join(first.alias("q"), same).select(*(F.col(f"p.{c}").alias(c) for c in (*place, "box")), "first")
        winners = materialize(seen.groupBy(by, "box").agg(F.min((F.col("box") == F.col("first")).cast("int")).alias("_won")).filter("_won = 1").select(by, "box"))
        held = _without(open_, winners, by, how="left_semi")
        gone = open_.alias("p").join(held.alias("q"), [*same, _hit(F.col("p.box"), F.col("q.box"))], "left_semi").select(by, "box").distinct()  # the winners themselves too
        drawn.append(winners)
        open_ = materialize(_without(open_, gone, by))
    return [*drawn, _folded(open_.select(by, "box").distinct(), by)]


def _without(rows: DataFrame, others: DataFrame, by: str, columns: list[str] | None = None, how: str = "left_anti") -> DataFrame:
    return rows.alias("p").join(others.alias("q"), [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in columns or [by, "box"]], how)


def overlaps(boxes: DataFrame, by: str = "scene", key: str = "priority", cell: float = 64.0) -> DataFrame:
    """``(scene, a, b)``, a < b: boxes of a scene that overlap; touching edges don't.

    Boxes meet in the cells of a grid that they cover, by an equi-join, and a pair counts in the
    cell of its intersection's first corner only, so pairs come once without a distinct.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = boxes.select(by, key, "bl", "bt", "br", "bb", F.explode(span("bl", "br")).alias("_cx"))
    cells = cells.withColumn("_cy", F.explode(span("bt", "bb")))
    a, b = cells.alias("a"), cells.alias("b")
    near = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    hit = (F.col("a.bl") < F.col("b.br")) & (F.col("a.br") > F.col("b.bl")) & (F.col("a.bt") < F.col("b.bb")) & (F.col("a.bb") > F.col("b.bt"))
    once = (F.floor(F.greatest("a.bl", "b.bl") / cell) == F.col("a._cx")) & (F.floor(F.greatest("a.bt", "b.bt") / cell) == F.col("a._cy"))
    return a.join(b, near & hit & once).select(F.col(f"a.{by}").alias(by), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def anchor_radius(kind: Column, altitude_km: Column, metres: Column, exaggeration: float) -> Column:
    """Distance from the centre: an altitude above it, and on the surface the exaggerated terrain as well."""
    base = 1 + F.coalesce(altitude_km, F.lit(0.0)) / geo.EARTH_RADIUS_KM
    return F.when(kind == "surface", base + F.coalesce(metres, F.lit(0.0)) / (geo.EARTH_RADIUS_KM * 1000) * exaggeration).otherwise(base)


def _at(lon: Column, lat: Column, radius: Column) -> list[Column]:
    return [(c * radius).alias(n) for n, c in zip("xyz", geo.to_unit(lon, lat))]


def tracking(feed: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds ``x, y, z`` in globe radii to ``(anchor_id, query_id, time)``: where a label or model is that follows a position feed.

    The feed is ``(anchor_id, at, lon, lat, altitude_km)``; its latest position holds, and the first one before it begins.
    Anchors without a feed have nulls. The as-of lookup is that of ``tracks``: a union and windows, no join on times.
    """
    frames = feed.select(F.col("anchor_id").alias("series_id"), F.col("at").cast("double").alias("at"), F.struct("lon", "lat", "altitude_km").alias("value"))
    asks = asked.select(F.col("anchor_id").alias("series_id"), "query_id", "time")
    got = tracks.sample(frames, asks)
    place = F.col("a")
    radius = anchor_radius(F.lit("air"), place["altitude_km"], F.lit(0.0), 0.0)
    return got.select(F.col("series_id").alias("anchor_id"), "query_id", "time", *_at(place["lon"], place["lat"], radius))


def on_terrain(anchors: DataFrame, stored: DataFrame, level: int, exaggeration: float, tile: int = raster.TILE) -> DataFrame:
    """Adds ``answered, x, y, z`` to anchors ``(anchor_id, lon, lat, altitude_km)`` that stand on the terrain as it is displaced.

    The finest level up to ``level`` that holds the place's tile answers (see ``raster.sample_heights``); without any the
    globe is smooth there.
    """
    points = anchors.select(F.col("anchor_id").alias("point_id"), ((F.col("lon") + 180) / 360).alias("u"), ((90 - F.col("lat")) / 180).alias("v"))
    heights = raster.sample_heights(points, stored, level, tile).select(F.col("point_id").alias("anchor_id"), "height", "answered")
    radius = anchor_radius(F.lit("surface"), F.col("altitude_km"), F.col("height"), exaggeration)
    return anchors.join(heights, "anchor_id").select(*anchors.columns, "answered", *_at(F.col("lon"), F.col("lat"), radius))


def box_model(spark: SparkSession, name: str, centre: tuple, size: tuple, colour: tuple) -> tuple[DataFrame, DataFrame]:
    """``(vertices, faces)`` of a box: 8 corners, 12 triangles in one colour."""
    i = F.col("i")
    # corners run around the back (z low), then the front
    dx = F.when((i % 4).isin(1, 2), 1).otherwise(-1)
    dy = F.when(i % 4 >= 2, 1).otherwise(-1)
    dz = F.when(i >= 4, 1).otherwise(-1)
    v = spark.range(8).select(F.lit(name).alias("model"), F.col("id").cast("int").alias("i")).select("model", "i", *((F.lit(float(c)) + d * (s / 2)).alias(n) for n, c, s, d in zip("xyz", centre, size, (dx, dy, dz))))
    # fixed values: the sides, counter-clockwise from outside
    sides = [(4, 5, 6, 7), (1, 0, 3, 2), (5, 1, 2, 6), (0, 4, 7, 3), (7, 6, 2, 3), (0, 1, 5, 4)]
    rows = [(name, 2 * k + h, q[0], q[1 + h], q[2 + h], *colour) for k, q in enumerate(sides) for h in (0, 1)]
    return v, spark.createDataFrame(rows, "model string, f int, a int, b int, c int, r int, g int, bl int")


def cylinder_model(spark: SparkSession, name: str, centre: tuple, radius: float, length: float, axis: str, sides: int, colour: tuple) -> tuple[DataFrame, DataFrame]:
    """``(vertices, faces)`` of a capped cylinder: 2 sides + 2 vertices, 4 sides triangles."""
    i = F.col("i")
    at = F.when(i < 2 * sides, (i % sides) / sides * (2 * math.pi))
    u, v = (F.coalesce(f(at) * radius, F.lit(0.0)) for f in (F.cos, F.sin))
    end = F.when((i < sides) | (i == 2 * sides), -length / 2).otherwise(length / 2)
    offsets = {"x": (end, u, v), "y": (u, end, v), "z": (u, v, end)}[axis]
    vertices = spark.range(2 * sides + 2).select(F.lit(name).alias("model"), F.col("id").cast("int").alias("i")).select("model", "i", *((F.lit(float(c)) + o).alias(n) for n, c, o in zip("xyz", centre, offsets)))
    k, j = F.col("k"), (F.col("k") + 1) % sides
    four = F.array(*(F.struct(F.lit(n).alias("n"), a.alias("a"), b.alias("b"), c.alias("c")) for n, (a, b, c) in enumerate([
        (k, k + sides, j + sides), (k, j + sides, j), (F.lit(2 * sides), j, k), (F.lit(2 * sides + 1), k + sides, j + sides),
    ])))
    faces = spark.range(sides).select(F.col("id").cast("int").alias("k")).select("k", F.explode(four).alias("t"))
    return vertices, faces.select(F.lit(name).alias("model"), (k * 4 + F.col("t.n")).cast("int").alias("f"), *(F.col(f"t.{n}").cast("int").alias(n) for n in "abc"), *(F.lit(c).alias(n) for n, c in zip(("r", "g", "bl"), colour)))


def model_faults(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(model, f, fault)``: faces with a missing corner or colour, or an index beyond the vertices."""
    counts = vertices.groupBy("model").agg(F.count(F.lit(1)).alias("_n"))
    fault = F.when(F.col("a").isNull() | F.col("b").isNull() | F.col("c").isNull(), "not a triple").when(F.col("r").isNull() | F.col("g").isNull() | F.col("bl").isNull(), "no colour")
    fault = fault.when(F.greatest("a", "b", "c") >= F.coalesce("_n", F.lit(0)), "index out of range")
    return faces.join(counts, "model", "left").withColumn("fault", fault).filter("fault is not null").select("model", "f", "fault")


def frame(here: geo.Vec, turn: Column) -> tuple[geo.Vec, geo.Vec, geo.Vec]:
    """``(right, up, forward)`` of a model standing at a place and turned by degrees from north towards east."""
    up = geo.normalised(here)
    flat = F.sqrt(up[0] * up[0] + up[2] * up[2])
    ex = F.when(flat > 1e-6, up[2] / flat).otherwise(1.0)
    ez = F.when(flat > 1e-6, -up[0] / flat).otherwise(0.0)
    north = (up[1] * ez, up[2] * ex - up[0] * ez, -up[1] * ex)
    c, s = F.cos(geo.rad(turn)), F.sin(geo.rad(turn))
    forward = (north[0] * c + ex * s, north[1] * c, north[2] * c + ez * s)
    return geo.cross(up, forward), up, forward


def paint(placements: DataFrame, vertices: DataFrame, faces: DataFrame, cam: geo.Camera) -> DataFrame:
    """Faces ``(placement, rank, f, colour)`` in painter's order: farthest first, ties by face.

    Placements are ``(placement, model, x, y, z, size, turn)``. Hidden placements and flat faces are
    left out. A face is made in the row of its placement, which meets its model in one join; a placement's faces are ranked in its own window.
    """
    here = tuple(F.col(c) for c in "xyz")
    seen = geo.rotate(cam, here)
    right, up, forward = (geo.rotate(cam, v) for v in frame(here, F.col("turn")))
    place = placements.filter(geo.length(here) >= geo.TINY).select(
        "placement", "model", "size", *(c.alias("p" + n) for n, c in zip("xyz", seen)), *(c.alias(p + n) for p, v in (("r", right), ("u", up), ("f", forward)) for n, c in zip("xyz", v)),
    ).filter(~((F.col("pz") < 0) & (F.col("px") * F.col("px") + F.col("py") * F.col("py") < 1)))
    models = faces.withColumnRenamed("f", "_f")
    for n in "abc":  # a model's own faces with their corners; placements come to it in one join
        models = models.join(vertices.select("model", F.col("i").alias(n), F.struct(*"xyz").alias("_v" + n)), ["model", n])
    corner = lambda n, k: F.col("p" + k) + F.col("size") * F.col("r" + k) * F.col(f"_v{n}.x") + F.col("size") * F.col("u" + k) * F.col(f"_v{n}.y") + F.col("size") * F.col("f" + k) * F.col(f"_v{n}.z")
    out = place.join(models.withColumnsRenamed({"r": "red", "g": "green", "bl": "blue"}).drop("a", "b", "c"), "model")
    once = lambda df, **made: df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("_t")).select(*df.columns, "_t.*")  # noqa: E731  # no expression is written out again in those that use it
    out = once(out.select("*"), **{"_" + n: F.struct(*(corner(n, k).alias(k) for k in "xyz")) for n in "abc"})
    edge = lambda n: tuple(F.col(f"_{n}.{k}") - F.col(f"_a.{k}") for k in "xyz")
    out = once(out.select("placement", "_f", "red", "green", "blue", "_a", "_b", "_c"), **dict(zip(("_nx", "_ny", "_nz"), geo.cross(edge("b"), edge("c")))))
    normal = tuple(F.col(c) for c in ("_nx", "_ny", "_nz"))
    out = once(out, _size=geo.length(normal))
    size = F.col("_size")
    lit = sum(normal[k] / size * F.when(normal[2] < 0, -1.0).otherwise(1.0) * LIGHT[k] for k in range(3))
    level = clamp(F.floor((AMBIENT + (1 - AMBIENT) * F.greatest(F.lit(0.0), lit)) * SHADES), F.lit(0), F.lit(SHADES - 1))
    shade = (level + 0.5) / SHADES
    colour = text.rgb(*(round_up(F.col(c) * shade).cast("int") for c in ("red", "green", "blue")))
    depth = (F.col("_a.z") + F.col("_b.z") + F.col("_c.z")) / 3
    shown = out.filter(size >= 1e-12).select("placement", F.col("_f").alias("f"), depth.alias("depth"), colour.alias("colour"))
    return shown.withColumn("rank", F.row_number().over(Window.partitionBy("placement").orderBy("depth", "f")))


def layered(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts of a picture in their fixed order, as ``layer, name`` columns before a part's own."""
    out = None
    for n, name in enumerate(LAYERS):
        if name in parts:
            part = parts[name].select(F.lit(n).alias("layer"), F.lit(name).alias("name"), "*")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
