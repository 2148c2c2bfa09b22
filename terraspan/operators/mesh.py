"""The globe's surface: octahedron chunks, their vertices, visibility and build order; the view-dependent quadtree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import materialize

#: How deep chunks and the mesh are, the level aimed for, pixels at which a triangle splits, weight of depth.
CHUNK_LEVEL, MESH_LEVEL, TARGET_LEVEL, UNBUILT = 2, 9, 2, -2
SPLIT_PIXELS, FORESHORTEN, STITCH_DEPTH = 16, 0.25, 4
# The octahedron's corners and faces; their order defines the chunks' ids.
AXES = [(0, 1, 0), (0, -1, 0), (0, 0, 1), (1, 0, 0), (0, 0, -1), (-1, 0, 0)]
FACES = [(0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 5, 2), (1, 3, 2), (1, 4, 3), (1, 5, 4), (1, 2, 5)]
TRIANGLE = "a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>"


def _vec(p: Column | str) -> geo.Vec:
    c = F.col(p) if isinstance(p, str) else p
    return c["x"], c["y"], c["z"]


def _point(v: geo.Vec) -> Column:
    return F.struct(*(c.alias(n) for n, c in zip("xyz", v)))


def middle(p: str, q: str) -> Column:
    """The direction halfway between two; the same from either side, so neighbours share it exactly."""
    return _point(geo.normalised(tuple(a + b for a, b in zip(_vec(p), _vec(q)))))


def octahedron(spark: SparkSession) -> DataFrame:
    """``(k, a, b, c)``: the 8 base triangles."""
    rows = [(k, *(tuple(float(v) for v in AXES[i]) for i in face)) for k, face in enumerate(FACES)]
    return spark.createDataFrame(rows, f"k long, {TRIANGLE}")


def split(triangles: DataFrame) -> DataFrame:
    """Each triangle's four children, ``k`` = 4 k + n: at a, b, c, and the middle one. Other columns are kept."""
    own = [c for c in triangles.columns if c not in ("k", "a", "b", "c")]
    cut = triangles.select(*own, "k", "a", "b", "c", middle("a", "b").alias("ab"), middle("b", "c").alias("bc"), middle("c", "a").alias("ca"))
    corners = [("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")]
    each = F.array(*(F.struct(F.lit(n).alias("n"), *(F.col(s).alias(t) for s, t in zip(three, "abc"))) for n, three in enumerate(corners)))
    return cut.select(*own, F.col("k").alias("_k"), F.explode(each).alias("t")).select(*own, (F.col("_k") * 4 + F.col("t.n")).alias("k"), "t.a", "t.b", "t.c")


def chunks(spark: SparkSession, level: int = CHUNK_LEVEL) -> DataFrame:
    """``(k, a, b, c)``: the 8 * 4^level chunks in their order."""
    out = octahedron(spark)
    for _ in range(level):
        out = split(out)
    return out


def caps(of: DataFrame) -> DataFrame:
    """Adds ``cap`` (a direction) and ``reach`` (a sine): the bounding cap of each triangle."""
    centre = geo.normalised(tuple(p + q + r for p, q, r in zip(_vec("a"), _vec("b"), _vec("c"))))
    with_cap = of.withColumn("cap", _point(centre))
    cos = F.least(F.lit(1.0), *(geo.dot(_vec("cap"), _vec(n)) for n in "abc"))
    return with_cap.withColumn("reach", F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos)))


def visible(capped: DataFrame, cam: geo.Camera, width: float, height: float, slack: float = 0.0) -> DataFrame:
    """Adds ``shown``: the cap isn't behind the globe, and its box meets the viewport."""
    v = geo.rotate(cam, _vec("cap"))
    reach = F.col("reach") + slack
    r, sx, sy = reach * cam.radius, cam.cx + v[0] * cam.radius, cam.cy - v[1] * cam.radius
    return capped.withColumn("shown", (v[2] + reach >= 0) & (sx + r >= 0) & (sx - r <= width) & (sy + r >= 0) & (sy - r <= height))


def vertices(of: DataFrame, n: int = 1 << (MESH_LEVEL - CHUNK_LEVEL)) -> DataFrame:
    """``(k, i, j, x, y, z, u, v)``: the grid of (n + 1)(n + 2) / 2 directions of each chunk."""
    grid = of.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i"))))
    wa, wb, wc = (n - F.col("i")) / n, (F.col("i") - F.col("j")) / n, F.col("j") / n
    v = geo.normalised(tuple(p * wa + q * wb + r * wc for p, q, r in zip(_vec("a"), _vec("b"), _vec("c"))))
    placed = grid.select("k", "i", "j", *(c.alias(m) for m, c in zip("xyz", v)))
    uv = geo.unit_to_uv(tuple(F.col(c) for c in "xyz"))
    return placed.select("*", uv[0].alias("u"), uv[1].alias("v"))


def chunk_indices(spark: SparkSession, n: int = 1 << (MESH_LEVEL - CHUNK_LEVEL)) -> DataFrame:
    """``(i, j, up, a, b, c)``: the n * n triangles of a chunk as vertex numbers; row i begins at i (i + 1) / 2."""
    rows = spark.range(1, n + 1).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") - 1)))
    above, row = F.expr("(i - 1) * i div 2"), F.expr("i * (i + 1) div 2")
    j = F.col("j")
    both = F.array_compact(F.array(
        F.struct(F.lit(True).alias("up"), (above + j).alias("a"), (row + j).alias("b"), (row + j + 1).alias("c")),
        F.when(j < F.col("i") - 1, F.struct(F.lit(False).alias("up"), (above + j).alias("a"), (row + j + 1).alias("b"), (above + j + 1).alias("c"))),
    ))
    return rows.select("i", "j", F.explode(both).alias("t")).select("i", "j", "t.*")


def wants(sampled: Column, stamped: Column, resident: int) -> Column:
    """Whether a chunk is to be built: not yet, or coarser than it might be and tiles have come since."""
    return (sampled == UNBUILT) | (sampled < TARGET_LEVEL) & (stamped != resident)


def build_queue(state: DataFrame, resident: int) -> DataFrame:
    """``(k, shown, class)`` of chunks ``(k, shown, sampled, stamped)`` to build, in order: new before stale, shown before hidden."""
    new = F.col("sampled") == UNBUILT
    rank = F.when(new & F.col("shown"), 0).when(new, 1).when(F.col("shown"), 2).otherwise(3)
    return state.filter(wants(F.col("sampled"), F.col("stamped"), resident)).select("k", "shown", rank.alias("class")).orderBy("class", "k")


def stats(state: DataFrame, per_chunk: int = 4 ** (MESH_LEVEL - CHUNK_LEVEL)) -> DataFrame:
    """``drawn, triangles, built, chunks, detail``: detail is the coarsest level among built chunks, -1 without."""
    built = F.col("sampled") != UNBUILT
    return state.agg(
        F.count(F.when(F.col("shown"), 1)).alias("drawn"), (F.count(F.when(F.col("shown"), 1)) * per_chunk).alias("triangles"), F.count(F.when(built, 1)).alias("built"), F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.min(F.when(built, F.least(F.col("sampled"), F.lit(TARGET_LEVEL)))), F.lit(-1)).alias("detail"),
    )


def rebuilt(spark: SparkSession, state: DataFrame, resident: int, sample) -> DataFrame:
    """``(k, i, j, x, y, z, height, level)`` of the chunks that want it: only those are sampled anew.

    ``sample`` adds ``height, answered`` to points with ``(point_id, u, v)`` and other columns, as ``raster.sample_heights`` does.
    """
    todo = build_queue(state, resident).select("k")
    grid = vertices(chunks(spark).join(todo, "k", "left_semi")).withColumn("point_id", F.struct("k", "i", "j"))
    return sample(grid).select("k", "i", "j", "x", "y", "z", "height", F.col("answered").alias("level"))


def bulge(level: Column) -> Column:
    """How far the sphere rises over a flat triangle of a level."""
    return 1 - F.cos(F.acos(F.lit(1 / math.sqrt(3))) / F.pow(F.lit(2.0), level))


def _screen(cam: geo.Camera, p: str) -> tuple[Column, Column, Column]:
    v = geo.rotate(cam, _vec(p))
    return cam.cx + v[0] * cam.radius, cam.cy - v[1] * cam.radius, v[2]


def oversized(cam: geo.Camera, pixels: float = SPLIT_PIXELS) -> Column:
    """Whether the longest edge is over the limit; depth counts a quarter."""
    at = {n: _screen(cam, n) for n in "abc"}

    def length2(p: str, q: str) -> Column:
        dx, dy, dz = (s - t for s, t in zip(at[p], at[q]))
        return dx * dx + dy * dy + FORESHORTEN * (dz * cam.radius) * (dz * cam.radius)

    return F.greatest(length2("a", "b"), length2("b", "c"), length2("c", "a")) > pixels * pixels


def culled(cam: geo.Camera, width: float, height: float, level: Column, lift: float = 0.0) -> Column:
    """Whether a triangle, with the room that its level's bulge and the terrain need, is behind or beside the view."""
    at = [_screen(cam, n) for n in "abc"]
    slack = bulge(level) + lift
    margin = slack * cam.radius
    x, y, z = ([p[i] for p in at] for i in range(3))
    return (F.greatest(*z) + slack < 0) | (F.least(*x) - margin > width) | (F.greatest(*x) + margin < 0) | (F.least(*y) - margin > height) | (F.greatest(*y) + margin < 0)


def front_facing(cam: geo.Camera) -> Column:
    """Whether a triangle's corners run clockwise on the screen (y down), by more than rounding."""
    a, b, c = (_screen(cam, n) for n in "abc")
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 1e-12


def select_leaves(spark: SparkSession, cam: geo.Camera, width: float, height: float, deepest: int, pixels: float = SPLIT_PIXELS, lift: float = 0.0) -> DataFrame:
    """``(k, level, a, b, c)``: triangles of the view-dependent quadtree that aren't split further.

    A level at a time: culled ones go, oversized ones are split, the rest are leaves. Each level
    is written before the next is split off from it, so none is computed twice; the loop is over
    levels, ``deepest`` at most, and ends when nothing is left to split.
    """
    now, leaves = octahedron(spark), None
    for level in range(deepest + 1):
        grows = oversized(cam, pixels) if level < deepest else F.lit(False)
        kept = materialize(now.filter(~culled(cam, width, height, F.lit(level), lift)).withColumn("grows", grows))
        done = kept.filter(~F.col("grows")).withColumn("level", F.lit(level))
        leaves = done if leaves is None else leaves.unionByName(done)
        if kept.filter("grows").isEmpty():
            break
        now = split(kept.filter("grows").drop("grows"))
    return leaves.select("k", "level", "a", "b", "c")


def edges(triangles: DataFrame) -> DataFrame:
    """``(p, q, n)``: undirected edges, the smaller end first, with the number of triangles that have them."""
    each = F.array(*(F.struct(F.least(F.col(s), F.col(t)).alias("p"), F.greatest(F.col(s), F.col(t)).alias("q")) for s, t in ("ab", "bc", "ca")))
    return triangles.select(F.explode(each).alias("e")).select("e.p", "e.q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))


def t_junctions(leaves: DataFrame, depth: int = STITCH_DEPTH) -> DataFrame:
    """``(k, side, steps, m)``: points that finer neighbours put on a leaf's edge, by halving up to ``depth`` times.

    An edge is cut at its middle if that is a corner of some leaf; its halves are then looked at.
    """
    corners = leaves.select(F.explode(F.array("a", "b", "c")).alias("m")).distinct()
    each = F.array(*(F.struct(F.lit(s + t).alias("side"), F.col(s).alias("p"), F.col(t).alias("q")) for s, t in ("ab", "bc", "ca")))
    now, out = leaves.select("k", F.explode(each).alias("e")).select("k", "e.*"), None
    for step in range(1, depth + 1):
        cut = now.withColumn("m", middle("p", "q")).join(corners, "m", "left_semi").withColumn("steps", F.lit(step))
        found = cut.select("k", "side", "steps", "m")
        out = found if out is None else out.unionByName(found)
        halves = F.array(F.struct(F.col("p"), F.col("m").alias("q")), F.struct(F.col("m").alias("p"), F.col("q")))
        now = cut.select("k", "side", F.explode(halves).alias("h")).select("k", "side", "h.p", "h.q")
    return out
