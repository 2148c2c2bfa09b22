"""Lines on the sphere as long tables ``(line_id, idx, ...)``: great and small circles, grids, clipping, rings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import materialize


def _next(by: str, order: str, *columns: str, wrap: bool = False) -> list:
    w = Window.partitionBy(by).orderBy(order)
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return [F.coalesce(F.lead(c).over(w), F.first(c).over(first)) if wrap else F.lead(c).over(w) for c in columns]


def geodesic(waypoints: DataFrame, step: float = 1.0, closed: bool = False) -> DataFrame:
    """``(line_id, leg, i, lon, lat)`` along great circles through waypoints ``(line_id, idx, lon, lat)``.

    A leg of w degrees has max(1, ceil(w / step)) steps; joints come once. Equal or opposite
    ends are joined directly, and a single waypoint is a point. ``closed`` returns to the first
    corner if there are two at least.
    """
    near = geo.to_unit(F.col("lon"), F.col("lat"), geo.NEAR)
    at = waypoints.select("line_id", "idx", "lon", *(c.alias("_a" + n) for n, c in zip("xyz", near)))
    after = _next("line_id", "idx", "lon", "_ax", "_ay", "_az", wrap=closed)
    w = Window.partitionBy("line_id")
    ordered = w.orderBy("idx")
    names = ["lon2", "_bx", "_by", "_bz"]
    legs = at.select("line_id", (F.row_number().over(ordered) - 1).alias("leg"), "_ax", "_ay", "_az", *(c.alias(n) for n, c in zip(names, after)), F.count(F.lit(1)).over(w).alias("_n"))
    legs = legs.filter((F.col("lon2").isNotNull() & (F.col("_n") > 1)) | (F.col("_n") == 1))
    a, b = (tuple(F.col(side + c) for c in "xyz") for side in ("_a", "_b"))
    legs = legs.withColumn("_omega", geo.angle(a, b, geo.NEAR)).withColumn("_sine", geo.NEAR.sin(F.col("_omega")))
    direct = F.col("_sine") < geo.TINY
    steps = F.when(F.col("_n") == 1, 0).when(direct, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_omega") / (math.pi / 180) / step))).cast("int")
    first = F.when(F.col("leg") == 0, 0).otherwise(1)
    points = legs.withColumn("_steps", steps).withColumn("i", F.explode(F.sequence(first, F.col("_steps"))))
    t = F.col("i") / F.col("_steps")
    lone = F.col("_n") == 1

    def point(trig: geo.Trig) -> geo.Vec:
        wa = F.when(direct, 1 - F.col("i")).otherwise(trig.sin((1 - t) * F.col("_omega")) / F.col("_sine"))
        wb = F.when(direct, F.col("i")).otherwise(trig.sin(t * F.col("_omega")) / F.col("_sine"))
        return tuple(F.when(lone, p).otherwise(p * wa + q * wb) for p, q in zip(a, b))

    return geo.settled(points, ["line_id", "leg", "i"], point)


def small_circles(centres: DataFrame, segments: int = 180) -> DataFrame:
    """``(line_id, i, lon, lat)``: ``segments`` + 1 points around centres ``(line_id, lon, lat, radius)`` in degrees."""
    vector = lambda name: tuple(F.col(f"_{name}.{k}") for k in "xyz")
    struct = lambda v: F.struct(*(x.alias(k) for k, x in zip("xyz", v)))
    r = geo.rad(F.col("radius"))
    each = centres.select("line_id", struct(geo.to_unit(F.col("lon"), F.col("lat"), geo.NEAR)).alias("_c"), geo.NEAR.sin(r).alias("_sin"), geo.NEAR.cos(r).alias("_cos"))
    steep = F.abs(F.col("_c.y")) < 0.9
    away = (F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0))
    each = each.withColumn("_u", struct(geo.normalised(geo.cross(vector("c"), away))))
    each = each.withColumn("_v", struct(geo.cross(vector("c"), vector("u")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(segments))))
    a = F.col("i") / segments * (2 * math.pi)

    def point(trig: geo.Trig) -> geo.Vec:
        ca, sa = trig.cos(a) * F.col("_sin"), trig.sin(a) * F.col("_sin")
        return tuple(p * F.col("_cos") + q * ca + s * sa for p, q, s in zip(vector("c"), vector("u"), vector("v")))

    return geo.settled(each, ["line_id", "i"], point)


def graticule(spark: SparkSession, step: int = 30) -> DataFrame:
    """``(kind, line, i, lon, lat)``: meridians by 2 degrees of latitude, parallels (without poles) by 2 of longitude."""
    lines = spark.range(1).select(F.explode(F.sequence(F.lit(-180), F.lit(179), F.lit(step))).alias("line")).select(F.lit("meridian").alias("kind"), "line", F.posexplode(F.sequence(F.lit(-90), F.lit(90), F.lit(2))).alias("i", "at"))
    out = lines.select("kind", "line", "i", F.col("line").alias("lon"), F.col("at").alias("lat"))
    if step < 180:
        rows = spark.range(1).select(F.explode(F.sequence(F.lit(-90 + step), F.lit(89), F.lit(step))).alias("line")).select(F.lit("parallel").alias("kind"), "line", F.posexplode(F.sequence(F.lit(-180), F.lit(180), F.lit(2))).alias("i", "at"))
        out = out.unionByName(rows.select("kind", "line", "i", F.col("at").alias("lon"), F.col("line").alias("lat")))
    return out


def clean_rings(points: DataFrame, places: int = 2) -> DataFrame:
    """Rings ``(polygon_id, ring_id, idx, lon, lat)`` with rounded points, without consecutive repeats and rings of under 3 points."""
    w = Window.partitionBy("polygon_id", "ring_id").orderBy("idx")
    near = points.withColumn("lon", F.round("lon", places)).withColumn("lat", F.round("lat", places))
    near = near.withColumn("_same", F.coalesce((F.lag("lon").over(w) == F.col("lon")) & (F.lag("lat").over(w) == F.col("lat")), F.lit(False))).filter("not _same").drop("_same")
    ring = Window.partitionBy("polygon_id", "ring_id")
    kept = near.withColumn("_n", F.count(F.lit(1)).over(ring)).filter("_n >= 3").drop("_n")
    return kept.withColumn("idx", F.row_number().over(w) - 1)


def ring_counts(points: DataFrame) -> DataFrame:
    """Polygons, rings and points."""
    return points.agg(F.countDistinct("polygon_id").alias("polygons"), F.countDistinct("polygon_id", "ring_id").alias("rings"), F.count(F.lit(1)).alias("points"))


def ring_measures(rings: DataFrame) -> DataFrame:
    """Per ring of unit vectors ``(ring_id, idx, x, y, z)``: centroid ``cx, cy, cz``, ``perimeter``, ``turn``, ``n``.

    ``turn`` is the vector area along the centroid's direction; a ring with a negative one runs backwards.
    """
    here = tuple(F.col(c) for c in "xyz")
    after = tuple(c for c in _next("ring_id", "idx", "x", "y", "z", wrap=True))
    pairs = rings.select("ring_id", "idx", *"xyz", *(c.alias("n" + n) for n, c in zip("xyz", after)))
    nxt = tuple(F.col("n" + c) for c in "xyz")
    area = geo.cross(here, nxt)
    sums = pairs.groupBy("ring_id").agg(
        *(F.sum(c).alias("m" + n) for n, c in zip("xyz", here)), *(F.sum(c).alias("a" + n) for n, c in zip("xyz", area)),
        F.sum(geo.angle(here, nxt)).alias("perimeter"), F.min_by(F.struct(*"xyz"), "idx").alias("_first"), F.count(F.lit(1)).alias("n"),
    )
    m, a = tuple(F.col("m" + c) for c in "xyz"), tuple(F.col("a" + c) for c in "xyz")
    size = geo.length(m)
    centre = [F.when(size < 1e-12, F.col(f"_first.{n}")).otherwise(c / size).alias("c" + n) for n, c in zip("xyz", m)]
    return sums.select("ring_id", "n", *centre, "perimeter", (geo.dot(a, m)).alias("turn"))


def orient_rings(rings: DataFrame) -> DataFrame:
    """Rings with ``idx`` reversed where they run backwards."""
    turns = ring_measures(rings).select("ring_id", (F.col("turn") < 0).alias("_back"), "n")
    joined = rings.join(turns, "ring_id")
    return joined.withColumn("idx", F.when(F.col("_back"), F.col("n") - 1 - F.col("idx")).otherwise(F.col("idx"))).drop("_back", "n")


def clip_lines(lines: DataFrame, cam: geo.Camera, space: bool = False) -> DataFrame:
    """Visible pieces of lines ``(line_id, idx, x, y, z)`` as screen points ``(line_id, piece, seq, sx, sy)``.

    On the globe a piece ends on the limb; in ``space`` it ends where the globe begins to hide it,
    found by halving. A point's own order is 2 idx, a crossing before it 2 idx - 1.
    """
    w = Window.partitionBy("line_id").orderBy("idx")
    r = geo.rotate(cam, tuple(F.col(c) for c in "xyz"))
    seen = ~geo.occluded(r) if space else geo.facing(r)
    turned = lines.select("line_id", "idx", *(c.alias(n) for n, c in zip("xyz", r)), seen.alias("seen"))
    pairs = turned.select("*", *(F.lag(c).over(w).alias("p" + c) for c in ("x", "y", "z", "seen")))
    here, past = tuple(F.col(c) for c in "xyz"), tuple(F.col("p" + c) for c in "xyz")
    flip = F.col("pseen").isNotNull() & (F.col("pseen") != F.col("seen"))
    if space:
        pairs = pairs.withColumn("_c", F.when(flip, geo.occlusion_crossing(past, here)))
        cross = F.struct((F.col("idx") * 2 - 1).alias("seq"), F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))
    else:
        lx, ly = geo.limb_crossing(past, here)
        cross = F.struct((F.col("idx") * 2 - 1).alias("seq"), lx.alias("x"), ly.alias("y"))
    own = F.struct((F.col("idx") * 2).alias("seq"), F.col("x").alias("x"), F.col("y").alias("y"))
    begins = F.col("seen") & ~F.coalesce(F.col("pseen"), F.lit(False))
    pieces = pairs.withColumn("piece", F.sum(begins.cast("int")).over(w))
    out = pieces.select("line_id", "piece", F.explode(F.array_compact(F.array(F.when(flip, cross), F.when(F.col("seen"), own)))).alias("p"))
    return out.select("line_id", "piece", F.col("p.seq").alias("seq"), (cam.cx + F.col("p.x") * cam.radius).alias("sx"), (cam.cy - F.col("p.y") * cam.radius).alias("sy"))


def clip_rings(rings: DataFrame, cam: geo.Camera) -> DataFrame:
    """Loops ``(ring_id, loop, seq, sx, sy)`` of the near side of closed rings ``(ring_id, idx, x, y, z)``, joined along the limb.

    Visible chains run from where the ring comes over the limb to where it goes behind it. From an
    exit the outline follows the limb counter-clockwise to the nearest entry, in steps of about two
    degrees, two at least. A ring of fewer than 3 points, or wholly behind, has no loop; one wholly in front is its own.

    Exits and entries are sorted by their angle on the limb, so an exit's entry is the next row, around the circle. Which chains make a loop,
    and in what order, is found by pointer doubling: every chain is known by the first one that leads to it and by how many hops.
    """
    order = Window.partitionBy("ring_id").orderBy("idx")
    whole = Window.partitionBy("ring_id")
    turned = rings.select("ring_id", "idx", *(c.alias(n) for n, c in zip("xyz", geo.rotate(cam, tuple(F.col(c) for c in "xyz")))))
    point = F.struct(*"xyz")
    seen = turned.select("*", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("n"), F.sum((F.col("z") > 0).cast("int")).over(whole).alias("_near"))
    seen = seen.filter((F.col("n") >= 3) & (F.col("_near") > 0))
    ends = {"_p": F.coalesce(F.lag(point).over(order), F.max_by(point, "idx").over(whole)), "_q": F.coalesce(F.lead(point).over(order), F.min_by(point, "idx").over(whole))}
    seen = seen.select("*", *(c.alias(k) for k, c in ends.items())).filter("z > 0")
    front = seen.filter(F.col("_near") == F.col("n")).select("ring_id", F.lit(0).alias("_first"), F.col("i").cast("long").alias("seq"), "x", "y")

    enters, leaves = F.col("_p.z") <= 0, F.col("_q.z") <= 0
    cut = seen.filter(F.col("_near") < F.col("n")).withColumns({"_count": F.sum(enters.cast("int")).over(order), "_chains": F.sum(enters.cast("int")).over(whole)})
    cut = materialize(cut.withColumn("chain", F.pmod(F.col("_count") - 1, F.col("_chains")).cast("int")))
    here = tuple(F.col(c) for c in "xyz")
    vec = lambda name: tuple(F.col(f"{name}.{c}") for c in "xyz")
    (ex, ey), (lx, ly) = geo.limb_crossing(vec("_p"), here), geo.limb_crossing(here, vec("_q"))
    chains = cut.groupBy("ring_id", "chain").agg(
        F.max(F.when(enters, F.struct(F.col("i").alias("s"), ex.alias("ex"), ey.alias("ey")))).alias("_e"), F.max(F.when(leaves, F.struct(lx.alias("lx"), ly.alias("ly")))).alias("_l"), F.count(F.lit(1)).alias("m"), F.max("_chains").alias("_chains"),
    ).select("ring_id", "chain", "m", "_chains", "_e.*", "_l.*")
    chains = materialize(chains.withColumns({"enter": F.atan2("ey", "ex"), "leave": F.atan2("ly", "lx")}))

    around = chains.select("ring_id", "chain", F.col("leave").alias("angle"), F.lit(0).alias("kind")).unionByName(chains.select("ring_id", "chain", F.col("enter").alias("angle"), F.lit(1).alias("kind")))
    entry = F.when(F.col("kind") == 1, F.struct(F.col("angle"), F.col("chain")))
    ahead = Window.partitionBy("ring_id").orderBy("angle", "kind", "chain").rowsBetween(1, Window.unboundedFollowing)
    hops = around.select("ring_id", "chain", "kind", F.first(entry, ignorenulls=True).over(ahead).alias("_next"), F.min(entry).over(whole).alias("_least")).filter("kind = 0")
    hops = hops.select("ring_id", "chain", F.coalesce("_next", "_least").alias("_to"), F.col("_next").isNull().cast("int").alias("_round"))
    hops = materialize(hops.select("ring_id", "chain", F.col("_to.chain").alias("ahead"), (F.col("_to.angle") + F.col("_round") * 2 * math.pi).alias("until")))

    known, jump, reach = hops.select("ring_id", "chain", F.struct(F.col("chain").alias("first"), F.lit(0).cast("long").alias("hops")).alias("by")), hops.select("ring_id", "chain", "ahead"), 1
    most = chains.agg(F.max("_chains")).first()[0] or 0
    while reach < most:
        sent = known.join(jump, ["ring_id", "chain"]).select("ring_id", F.col("ahead").alias("chain"), F.struct(F.col("by.first").alias("first"), (F.col("by.hops") + reach).alias("hops")).alias("by"))
        known = materialize(known.unionByName(sent).groupBy("ring_id", "chain").agg(F.min("by").alias("by")))
        jump = materialize(jump.join(jump.select("ring_id", F.col("chain").alias("ahead"), F.col("ahead").alias("_further")), ["ring_id", "ahead"]).select("ring_id", "chain", F.col("_further").alias("ahead")))
        reach *= 2

    turn = F.col("until") - F.col("leave")
    whole_chains = chains.join(hops.select("ring_id", "chain", "until"), ["ring_id", "chain"]).join(known, ["ring_id", "chain"]).select("*", F.col("by.first").alias("_first"), turn.alias("turn"))
    whole_chains = whole_chains.withColumn("steps", F.greatest(F.lit(2), F.ceil(F.col("turn") / (2 * math.pi) * 180)).cast("int"))
    before = Window.partitionBy("ring_id", "_first").orderBy("by.hops").rowsBetween(Window.unboundedPreceding, -1)
    whole_chains = materialize(whole_chains.withColumn("_at", F.coalesce(F.sum(F.col("m") + 2 + F.col("steps")).over(before), F.lit(0))))
    arc = F.col("leave") + F.col("turn") * F.col("k") / F.col("steps")
    limb = whole_chains.select("*", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("k"))
    points = cut.select("ring_id", "chain", "i", "n", "x", "y").join(whole_chains.select("ring_id", "chain", "_first", "_at", "s"), ["ring_id", "chain"])
    made = [
        front, whole_chains.select("ring_id", "_first", F.col("_at").alias("seq"), F.col("ex").alias("x"), F.col("ey").alias("y")), whole_chains.select("ring_id", "_first", (F.col("_at") + F.col("m") + 1).alias("seq"), F.col("lx").alias("x"), F.col("ly").alias("y")),
        points.select("ring_id", "_first", (F.col("_at") + 1 + F.pmod(F.col("i") - F.col("s"), F.col("n"))).alias("seq"), "x", "y"), limb.select("ring_id", "_first", (F.col("_at") + F.col("m") + 1 + F.col("k")).alias("seq"), F.cos(arc).alias("x"), F.sin(arc).alias("y")),
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    loop = F.dense_rank().over(Window.partitionBy("ring_id").orderBy("_first")) - 1
    return out.select("ring_id", loop.cast("int").alias("loop"), F.col("seq").cast("int").alias("seq"), (cam.cx + F.col("x") * cam.radius).alias("sx"), (cam.cy - F.col("y") * cam.radius).alias("sy"))
