"""Queries on morphs, labels, models and the surface mesh, with fixtures made of the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import micro
from ..operators import mesh, morphs, raster, scene
from . import raster_queries
from .geo_queries import CAM, CLEAN, M, C, PLACES, clean, places, quantised, unit, xyz
from .raster_queries import read


def rings(spark, sf_dir) -> DataFrame:
    return unit(clean(spark, sf_dir)).select("ring_id", "idx", *"xyz")


UU = f"{CLEAN}, uu AS (SELECT ring_id, idx, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS x, sin(lat * (pi() / 180)) AS y, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS z FROM kept)"
COUNT = 24


def q_resample(spark, sf_dir):
    return quantised(morphs.resample(rings(spark, sf_dir), COUNT), "x", "y", "z")


RESAMPLE = f"""WITH {UU},
pp AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lead(z) OVER w, first_value(z) OVER w) AS nz, lead(x) OVER w IS NULL AS last FROM uu WINDOW w AS (PARTITION BY ring_id ORDER BY idx)),
ll AS (SELECT *, acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, x * nx + y * ny + z * nz))) AS len FROM pp),
cc AS (SELECT *, sum(len) OVER (PARTITION BY ring_id ORDER BY idx) AS upto, sum(len) OVER (PARTITION BY ring_id) AS total FROM ll),
ss AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY ring_id ORDER BY idx), 0) AS since, max(upto) OVER (PARTITION BY ring_id) AS whole FROM cc),
ee AS (SELECT ss.*, s, s / {COUNT}.0::DOUBLE * whole AS target FROM ss, range({COUNT}) t(s)),
mm AS (SELECT *, CASE WHEN len > 0 THEN (target - since) / len ELSE 0 END AS t FROM ee WHERE target >= since AND (last OR target < upto)),
ww AS (SELECT *, CASE WHEN sin(len) > 1e-9 THEN sin((1 - t) * len) / sin(len) ELSE 1 - t END AS wa, CASE WHEN sin(len) > 1e-9 THEN sin(t * len) / sin(len) ELSE t END AS wb FROM mm),
vv AS (SELECT ring_id, s, x * wa + nx * wb AS x, y * wa + ny * wb AS y, z * wa + nz * wb AS z FROM ww)
SELECT ring_id, s::INTEGER AS s, {', '.join(M(f'{c} / sqrt(x * x + y * y + z * z)') + f' AS {c}' for c in 'xyz')} FROM vv"""


def point_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of neighbouring embeddings as rings of 16 points with whole-number coordinates."""
    e = read(spark, sf_dir, "embeddings")
    whole = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(*(F.floor(F.element_at("embedding", (i * 3 + k + 1).cast("int")).cast("double") * 100).cast("long").alias(n) for k, n in enumerate("xyz"))))
    r = e.select("vec_id", whole.alias("points"))
    a, b = r.filter("vec_id % 2 = 0"), r.filter("vec_id % 2 = 1")
    return a.select(F.expr("vec_id div 2").alias("pair"), F.col("points").alias("a")).join(b.select(F.expr("vec_id div 2").alias("pair"), F.col("points").alias("b")), "pair")


def q_align(spark, sf_dir):
    k = morphs.best_rotation(F.col("a"), F.col("b"))
    out = point_pairs(spark, sf_dir).withColumn("k", k)
    return out.select("pair", F.col("k").cast("int").alias("k"), F.element_at(morphs.rotated(F.col("b"), F.col("k")), 1)["x"].alias("first_x"))


ALIGN = """WITH v AS (SELECT vec_id, i, floor(embedding[i * 3 + 1]::DOUBLE * 100)::BIGINT AS x, floor(embedding[i * 3 + 2]::DOUBLE * 100)::BIGINT AS y, floor(embedding[i * 3 + 3]::DOUBLE * 100)::BIGINT AS z FROM embeddings, range(16) t(i)),
p AS (SELECT a.vec_id // 2 AS pair, (b.i - a.i + 16) % 16 AS k, sum(a.x * b.x + a.y * b.y + a.z * b.z) AS s FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 GROUP BY 1, 2),
w AS (SELECT pair, k FROM p QUALIFY row_number() OVER (PARTITION BY pair ORDER BY s DESC, k) = 1)
SELECT pair, k::INTEGER AS k, v.x AS first_x FROM w JOIN v ON v.vec_id = pair * 2 + 1 AND v.i = k"""


def polygons(spark, sf_dir, rest: int) -> DataFrame:
    """Points of a whole-number lattice as polygon centres, 6 morphs for every 144 customers: even ones before, odd ones after (some morphs have more of one)."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").filter((k % 2 == rest) & ~((k % 12).isin(3, 4) & (k % 144 > 60)))  # a side of the morphs
    return c.select((k % 12 % 6 + F.floor(k / 144) * 6).alias("morph_id"), k.alias("idx"), *(((k * m) % 97 / 128.0).alias(n) for n, m in zip("xyz", (31, 57, 83))), ((k * 41) % 23 / 4.0).alias("extent"))


def q_match(spark, sf_dir):
    return morphs.match(polygons(spark, sf_dir, 0), polygons(spark, sf_dir, 1)).withColumn("pos", F.col("pos").cast("long"))


MATCH = """WITH RECURSIVE p AS (SELECT c_custkey AS k, c_custkey % 12 % 6 + (c_custkey // 144) * 6 AS m, (c_custkey * 31) % 97 / 128.0::DOUBLE AS x, (c_custkey * 57) % 97 / 128.0::DOUBLE AS y, (c_custkey * 83) % 97 / 128.0::DOUBLE AS z, (c_custkey * 41) % 23 / 4.0::DOUBLE AS e
  FROM customer WHERE NOT (c_custkey % 12 IN (3, 4) AND c_custkey % 144 > 60)),
a AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY e DESC, k) AS n FROM p WHERE k % 2 = 0), b AS (SELECT * FROM p WHERE k % 2 = 1),
d AS (SELECT a.m, a.n, a.k AS i, b.k AS j, 1 - (a.x * b.x + a.y * b.y + a.z * b.z) AS d FROM a JOIN b ON a.m = b.m),
ms AS (SELECT DISTINCT m FROM p),
r AS (
  SELECT m, 0::BIGINT AS n, NULL::BIGINT AS i, NULL::BIGINT AS j, []::BIGINT[] AS taken FROM ms
  UNION ALL
  SELECT r.m, r.n + 1, a.k, q.j, CASE WHEN q.j IS NULL THEN r.taken ELSE list_append(r.taken, q.j) END
  FROM r JOIN a ON a.m = r.m AND a.n = r.n + 1
  LEFT JOIN LATERAL (SELECT d.j FROM d WHERE d.m = r.m AND d.n = r.n + 1 AND NOT list_contains(r.taken, d.j) ORDER BY d.d, d.j LIMIT 1) q ON true
), f AS (SELECT m AS morph_id, n - 1 AS pos, i, j FROM r WHERE n > 0),
rest AS (SELECT b.m AS morph_id, (SELECT count(*) FROM a WHERE a.m = b.m) + row_number() OVER (PARTITION BY b.m ORDER BY b.k) - 1 AS pos, NULL::BIGINT AS i, b.k AS j FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.morph_id = b.m AND f.j = b.k))
SELECT * FROM f UNION ALL SELECT * FROM rest"""


def q_morph_blend(spark, sf_dir):
    """Between each customer's place and the opposite of its neighbour's; every tenth holds its start."""
    p = unit(places(spark, sf_dir))
    b = tuple(F.when(F.col("id") % 10 == 0, -c).otherwise(F.lit(v)) for c, v in zip(xyz(), (0.6, 0.0, 0.8)))
    v = geo.morphed(xyz(), b, (F.col("id") % 13) / 10.0 - 0.1)
    out = p.select("id", *(c.alias(n) for n, c in zip("xyz", v)))
    return quantised(out, "x", "y", "z")


def q_morph(spark, sf_dir):
    """Nations as polygons, two states each, at share 0.3."""
    pts = clean(spark, sf_dir).select((F.col("ring_id") % 5).alias("morph_id"), F.col("ring_id").alias("polygon"), F.lit(0).alias("ring"), "idx", "lon", "lat")
    moved = pts.filter("polygon < 20").withColumn("lon", F.col("lon") + 3).withColumn("lat", F.col("lat") * 0.9)
    out = morphs.at(morphs.morph(pts, moved, 16), 0.3)
    return quantised(out, "x", "y", "z")


def labels(spark, sf_dir) -> DataFrame:
    """Customers as labels of scenes, one for every nation among a thousand of them."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pick = F.element_at(F.array(*map(F.lit, ("right", "left", "above", "below", "centre"))), (k % 5 + 1).cast("int"))
    return c.select(
        (F.col("c_nationkey") + 25 * F.floor(k / 1000)).alias("scene"), k.alias("priority"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("text"), (k % 19 != 0).alias("visible"), ((k % 50) / 50.0).alias("alpha"),
        F.when(k % 7 == 0, F.lit(False)).alias("declutter"), ((k * 37) % 400).cast("double").alias("x"), ((k * 53) % 300).cast("double").alias("y"), (20 + (k * 11) % 60).cast("double").alias("width"),
        F.when(k % 3 == 0, F.lit(20.0)).alias("size"), F.when(k % 4 > 0, pick).alias("placement"), F.when(k % 6 == 0, F.lit(4.0)).alias("gap"), F.when(k % 8 == 0, F.lit(3.0)).alias("dx"), F.lit(None).cast("double").alias("dy"),
    )


BOXES = """lab AS (SELECT c_nationkey + 25 * (c_custkey // 1000) AS scene, c_custkey AS priority, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'c' || c_custkey END AS text, c_custkey % 19 <> 0 AS visible, (c_custkey % 50) / 50.0::DOUBLE AS alpha, c_custkey % 7 <> 0 AS polite,
  ((c_custkey * 37) % 400)::DOUBLE AS x, ((c_custkey * 53) % 300)::DOUBLE AS y, (20 + (c_custkey * 11) % 60)::DOUBLE AS w, CASE WHEN c_custkey % 3 = 0 THEN 20.0 ELSE 12.0 END::DOUBLE * 1.2::DOUBLE AS h,
  CASE WHEN c_custkey % 4 > 0 THEN (['right', 'left', 'above', 'below', 'centre'])[c_custkey % 5 + 1] ELSE 'right' END AS place, CASE WHEN c_custkey % 6 = 0 THEN 4.0 ELSE 10.0 END::DOUBLE AS gap, CASE WHEN c_custkey % 8 = 0 THEN 3.0 ELSE 0.0 END::DOUBLE AS dx FROM customer),
mid AS (SELECT *, CASE place WHEN 'left' THEN x - gap - w WHEN 'right' THEN x + gap ELSE x - w / 2 END + dx AS l, CASE place WHEN 'above' THEN y - gap - h / 2 WHEN 'below' THEN y + gap + h / 2 ELSE y END AS m FROM lab),
box AS (SELECT scene, priority, text, visible, alpha, polite, l - 2 AS bl, m - h / 2 - 2 AS bt, l + w + 2 AS br, m + h / 2 + 2 AS bb FROM mid)"""


def q_label_boxes(spark, sf_dir):
    return scene.label_boxes(labels(spark, sf_dir)).select("scene", "priority", *(micro(F.col(c)).alias(c) for c in ("bl", "bt", "br", "bb")))


def q_declutter(spark, sf_dir):
    return scene.declutter(scene.label_boxes(labels(spark, sf_dir))).select("scene", "priority", "text")


DECLUTTER = f"""WITH RECURSIVE {BOXES}, shown AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY priority) AS n FROM box WHERE visible AND alpha >= 0.02 AND text <> ''),
r AS (
  SELECT scene, 0::BIGINT AS n, NULL::BIGINT AS priority, NULL::VARCHAR AS text, []::BIGINT[] AS taken FROM (SELECT DISTINCT scene FROM shown)
  UNION ALL
  SELECT r.scene, s.n, CASE WHEN q.hit AND s.polite THEN NULL ELSE s.priority END, s.text, CASE WHEN q.hit AND s.polite THEN r.taken ELSE list_append(r.taken, s.n) END
  FROM r JOIN shown s ON s.scene = r.scene AND s.n = r.n + 1
  LEFT JOIN LATERAL (SELECT count(*) > 0 AS hit FROM shown t WHERE t.scene = r.scene AND list_contains(r.taken, t.n) AND s.bl < t.br AND s.br > t.bl AND s.bt < t.bb AND s.bb > t.bt) q ON true
) SELECT scene, priority, text FROM r WHERE priority IS NOT NULL"""


def q_declutter_one_scene(spark, sf_dir):
    """All customers in one scene, on a plane that grows with them; their priorities are shuffled."""
    c = read(spark, sf_dir, "customer")
    n = c.count()
    side, k = max(1, math.isqrt(n)), F.col("c_custkey")
    one = labels(spark, sf_dir).select(
        F.lit(0).alias("scene"), (F.col("priority") * 7919 % 1_000_003).alias("priority"), "text", "visible", "alpha", "declutter", (F.col("priority") * 7907 % (50 * side)).cast("double").alias("x"), (F.col("priority") * 104_729 % (30 * side)).cast("double").alias("y"),
        *(c for c in ("width", "size", "placement", "gap", "dx", "dy")),
    )
    return scene.declutter(scene.label_boxes(one)).select("priority", "text")


ONE_SCENE = f"""WITH RECURSIVE {BOXES}, n AS (SELECT floor(sqrt(count(*)))::BIGINT AS side FROM customer),
moved AS (SELECT (priority * 7919) % 1000003 AS priority, text, visible, alpha, polite, ((priority * 7907) % (50 * side))::DOUBLE - ((priority * 37) % 400) AS ox, ((priority * 104729) % (30 * side))::DOUBLE - ((priority * 53) % 300) AS oy, bl, bt, br, bb FROM box, n),
shown AS (SELECT row_number() OVER (ORDER BY priority) AS n, priority, text, polite, bl + ox AS bl, bt + oy AS bt, br + ox AS br, bb + oy AS bb FROM moved WHERE visible AND alpha >= 0.02 AND text <> ''),
before AS (SELECT b.n, list(a.n) AS those FROM shown a JOIN shown b ON a.n < b.n AND a.bl < b.br AND a.br > b.bl AND a.bt < b.bb AND a.bb > b.bt GROUP BY b.n),
r AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS taken
  UNION ALL
  SELECT s.n, CASE WHEN s.polite AND b.those IS NOT NULL AND list_has_any(b.those, r.taken) THEN r.taken ELSE list_append(r.taken, s.n) END FROM r JOIN shown s ON s.n = r.n + 1 LEFT JOIN before b ON b.n = s.n
) SELECT priority, text FROM shown JOIN (SELECT unnest(taken) AS n FROM r WHERE n = (SELECT count(*) FROM shown)) t ON t.n = shown.n"""


def q_overlaps(spark, sf_dir):
    return scene.overlaps(scene.label_boxes(labels(spark, sf_dir)))


def q_anchors(spark, sf_dir):
    """Places as anchors: on the surface, above it, or as high as an orbit; those in reach of nothing stand on flat ground."""
    p = unit(places(spark, sf_dir)).withColumn("kind", F.element_at(F.array(F.lit("surface"), F.lit("above"), F.lit("orbit")), (F.col("id") % 3 + 1).cast("int")))
    r = scene.anchor_radius(F.col("kind"), F.when(F.col("kind") != "surface", (F.col("id") % 900).cast("double")), F.when(F.col("id") % 4 > 0, (F.col("id") % 5000).cast("double")), 30.0)
    return p.select("id", "kind", *(micro(F.col(c) * r).alias(c) for c in "xyz"))


def models(spark) -> tuple[DataFrame, DataFrame]:
    v1, f1 = scene.box_model(spark, "hut", (0.5, 0.25, -0.125), (1.0, 2.0, 4.0), (200, 100, 50))
    v2, f2 = scene.cylinder_model(spark, "mast", (0.0, 1.0, 0.0), 0.5, 3.0, "y", 8, (20, 120, 220))
    return v1.unionByName(v2), f1.unionByName(f2)


def q_model_vertices(spark, sf_dir):
    return quantised(models(spark)[0], "x", "y", "z")


def q_model_faces(spark, sf_dir):
    return models(spark)[1].withColumnRenamed("bl", "blue")


def q_model_faults(spark, sf_dir):
    v, f = models(spark)
    broken = f.withColumn("b", F.when(F.col("f") % 5 != 0, F.col("b"))).withColumn("c", F.when(F.col("f") % 7 == 0, 99).otherwise(F.col("c"))).withColumn("g", F.when(F.col("f") % 11 != 0, F.col("g")))
    return scene.model_faults(v, broken)


FACE_ROWS = """box AS (SELECT 'hut' AS model, (q * 2 + h)::INTEGER AS f, s[1] AS a, s[2 + h] AS b, s[3 + h] AS c, 200 AS r, 100 AS g, 50 AS blue
  FROM (SELECT row_number() OVER (ORDER BY o) - 1 AS q, s FROM (VALUES (0, [4, 5, 6, 7]), (1, [1, 0, 3, 2]), (2, [5, 1, 2, 6]), (3, [0, 4, 7, 3]), (4, [7, 6, 2, 3]), (5, [0, 1, 5, 4])) v(o, s)), range(2) t(h)),
mast AS (SELECT 'mast' AS model, (k * 4 + n)::INTEGER AS f, (CASE n WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 16 ELSE 17 END)::INTEGER AS a, (CASE n WHEN 0 THEN k + 8 WHEN 1 THEN (k + 1) % 8 + 8 WHEN 2 THEN (k + 1) % 8 ELSE k + 8 END)::INTEGER AS b,
  (CASE n WHEN 0 THEN (k + 1) % 8 + 8 WHEN 1 THEN (k + 1) % 8 WHEN 2 THEN k ELSE (k + 1) % 8 + 8 END)::INTEGER AS c, 20 AS r, 120 AS g, 220 AS blue FROM range(8) a(k), range(4) b(n)),
faces AS (SELECT * FROM box UNION ALL SELECT * FROM mast)"""


def q_paint(spark, sf_dir):
    """Customers' places carry a hut or a mast each."""
    s = unit(places(spark, sf_dir))
    p = s.select(F.col("id").alias("placement"), F.when(F.col("id") % 2 == 0, "hut").otherwise("mast").alias("model"), *"xyz", F.lit(0.03).alias("size"), (F.col("id") * 17 % 360).cast("double").alias("turn"))
    return scene.paint(p, *models(spark), CAM).select("placement", "f", micro(F.col("depth")).alias("depth"), "colour", F.dense_rank().over(_by_depth()).alias("rank"))


def _by_depth():
    from pyspark.sql import Window

    return Window.partitionBy("placement").orderBy(micro(F.col("depth")))


def paint_sql() -> str:
    """Frames of the placements, corners of their faces in the camera's frame, normals, light, and ranks by depth."""
    turn = lambda v: (f"({v}x * {C['cos_lon']} - {v}z * {C['sin_lon']})", f"({v}y * {C['cos_lat']} - ({v}x * {C['sin_lon']} + {v}z * {C['cos_lon']}) * {C['sin_lat']})", f"({v}y * {C['sin_lat']} + ({v}x * {C['sin_lon']} + {v}z * {C['cos_lon']}) * {C['cos_lat']})")
    turned = ", ".join(f"{e} AS {n}{k}" for n, v in (("p", "h"), ("r", "w"), ("u", "n"), ("f", "d")) for k, e in zip("xyz", turn(v)))
    corners = ", ".join(f"p{k} + 0.03::DOUBLE * r{k} * v{n}.x + 0.03::DOUBLE * u{k} * v{n}.y + 0.03::DOUBLE * f{k} * v{n}.z AS k{n}{k}" for n in "abc" for k in "xyz")
    e = {n + k: f"(k{n}{k} - ka{k})" for n in "bc" for k in "xyz"}
    light = " + ".join(f"{'xyz'[k]} / size * CASE WHEN z < 0 THEN -1.0 ELSE 1.0 END::DOUBLE * ({scene.LIGHT[k]})::DOUBLE" for k in range(3))
    tint = lambda c: f"CAST(floor({c} * shade + 0.5) AS INTEGER)"
    return f"""WITH {PLACES}, v AS ({HUT} UNION ALL {MAST}), {FACE_ROWS}, h AS (SELECT id AS placement, CASE WHEN id % 2 = 0 THEN 'hut' ELSE 'mast' END AS model, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS hx, sin(lat * (pi() / 180)) AS hy, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS hz, (id * 17 % 360)::DOUBLE * (pi() / 180) AS t FROM places),
  n AS (SELECT *, hx / sqrt(hx * hx + hy * hy + hz * hz) AS nx, hy / sqrt(hx * hx + hy * hy + hz * hz) AS ny, hz / sqrt(hx * hx + hy * hy + hz * hz) AS nz FROM h),
  ez AS (SELECT *, CASE WHEN sqrt(nx * nx + nz * nz) > 1e-6 THEN nz / sqrt(nx * nx + nz * nz) ELSE 1 END AS ex, CASE WHEN sqrt(nx * nx + nz * nz) > 1e-6 THEN -nx / sqrt(nx * nx + nz * nz) ELSE 0 END AS ez FROM n),
  d AS (SELECT *, ny * ez * cos(t) + ex * sin(t) AS dx, (nz * ex - nx * ez) * cos(t) AS dy, -ny * ex * cos(t) + ez * sin(t) AS dz FROM ez), w AS (SELECT *, ny * dz - nz * dy AS wx, nz * dx - nx * dz AS wy, nx * dy - ny * dx AS wz FROM d),
  p AS (SELECT placement, model, {turned} FROM w), seen AS (SELECT * FROM p WHERE NOT (pz < 0 AND px * px + py * py < 1)),
  c AS (SELECT placement, q.f, q.r, q.g, q.blue, {corners} FROM seen JOIN faces q ON q.model = seen.model JOIN v va ON va.model = q.model AND va.i = q.a JOIN v vb ON vb.model = q.model AND vb.i = q.b JOIN v vc ON vc.model = q.model AND vc.i = q.c),
  m AS (SELECT *, {e['by']} * {e['cz']} - {e['bz']} * {e['cy']} AS x, {e['bz']} * {e['cx']} - {e['bx']} * {e['cz']} AS y, {e['bx']} * {e['cy']} - {e['by']} * {e['cx']} AS z FROM c), s AS (SELECT *, sqrt(x * x + y * y + z * z) AS size FROM m),
  l AS (SELECT *, (least({scene.SHADES - 1}, greatest(0, floor(({scene.AMBIENT}::DOUBLE + (1 - {scene.AMBIENT}::DOUBLE) * greatest(0.0::DOUBLE, {light})) * {scene.SHADES}))) + 0.5::DOUBLE) / {scene.SHADES} AS shade, {M('(kaz + kbz + kcz) / 3')} AS depth FROM s WHERE size >= 1e-12)
SELECT placement, f, depth, 'rgb(' || {tint('r')} || ',' || {tint('g')} || ',' || {tint('blue')} || ')' AS colour, dense_rank() OVER (PARTITION BY placement ORDER BY depth)::INTEGER AS rank FROM l"""


def q_layers(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"))
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("item"))
    return scene.layered({"labels": n, "regions": r, "overlay": r.filter("item = 0")})


def flat(t: DataFrame, *keys: str) -> DataFrame:
    return t.select(*keys, *(micro(F.col(f"{p}.{c}")).alias(p + c) for p in "abc" for c in "xyz"))


def q_chunks(spark, sf_dir):
    return flat(mesh.chunks(spark), "k")


#: Corners a, b, c in SQL, where "by" is a word of its own.
CORNERS = "aec"


def triangles_sql(level: int, recurse: str = "true") -> str:
    """The octahedron's triangles down to a level; ``recurse`` says which ones are split."""
    n = lambda p, q: ", ".join(f"({p}{c} + {q}{c}) / sqrt(({p}x + {q}x) * ({p}x + {q}x) + ({p}y + {q}y) * ({p}y + {q}y) + ({p}z + {q}z) * ({p}z + {q}z)) AS {p}{q}{c}" for c in "xyz")
    corner = lambda *three: ", ".join(f"{s}{c} AS {t}{c}" for s, t in zip(three, CORNERS) for c in "xyz")
    child = "\n    UNION ALL ".join(f"SELECT k * 4 + {i} AS k, l + 1 AS l, {corner(*t)} FROM cut" for i, t in enumerate([("a", "ae", "ca"), ("ae", "e", "ec"), ("ca", "ec", "c"), ("ae", "ec", "ca")]))
    base = ", ".join("(" + ", ".join([str(k), *(f"{float(v)}::DOUBLE" for i in f for v in mesh.AXES[i])]) + ")" for k, f in enumerate(mesh.FACES))
    names = ", ".join(f"{t}{c}" for t in CORNERS for c in "xyz")
    return f"""tri AS (SELECT k::BIGINT AS k, 0 AS l, {names} FROM (VALUES {base}) v(k, {names})
  UNION ALL SELECT * FROM (WITH cut AS (SELECT *, {n('a', 'e')}, {n('e', 'c')}, {n('c', 'a')} FROM tri WHERE l < {level} AND {recurse}) {child}))"""


CHUNKS = f"WITH RECURSIVE {triangles_sql(2)}, ch AS (SELECT * FROM tri WHERE l = 2)"
CAPS = f"""{CHUNKS}, c0 AS (SELECT *, ax + ex + cx AS sx, ay + ey + cy AS sy, az + ez + cz AS sz FROM ch), c1 AS (SELECT *, sx / sqrt(sx * sx + sy * sy + sz * sz) AS px, sy / sqrt(sx * sx + sy * sy + sz * sz) AS py, sz / sqrt(sx * sx + sy * sy + sz * sz) AS pz FROM c0),
c2 AS (SELECT *, least(1.0::DOUBLE, px * ax + py * ay + pz * az, px * ex + py * ey + pz * ez, px * cx + py * cy + pz * cz) AS co FROM c1), c3 AS (SELECT *, sqrt(greatest(0.0::DOUBLE, 1 - co * co)) AS reach,
  px * {C['cos_lon']} - pz * {C['sin_lon']} AS vx, py * {C['cos_lat']} - (px * {C['sin_lon']} + pz * {C['cos_lon']}) * {C['sin_lat']} AS vy, py * {C['sin_lat']} + (px * {C['sin_lon']} + pz * {C['cos_lon']}) * {C['cos_lat']} AS vz FROM c2),
c4 AS (SELECT *, vz + reach >= 0 AND {C['cx']} + vx * {C['radius']} + reach * {C['radius']} >= 0 AND {C['cx']} + vx * {C['radius']} - reach * {C['radius']} <= 800 AND {C['cy']} - vy * {C['radius']} + reach * {C['radius']} >= 0 AND {C['cy']} - vy * {C['radius']} - reach * {C['radius']} <= 600 AS shown FROM c3)"""


def capped(spark) -> DataFrame:
    return mesh.visible(mesh.caps(mesh.chunks(spark)), CAM, 800, 600)


def q_caps(spark, sf_dir):
    return capped(spark).select("k", *(micro(F.col(f"cap.{c}")).alias(c) for c in "xyz"), micro(F.col("reach")).alias("reach"), "shown")


def state(spark, sf_dir) -> DataFrame:
    """What is known of each chunk: some unbuilt, some coarse, some stamped with today's tiles."""
    return capped(spark).select("k", "shown", F.when(F.col("k") % 3 == 0, mesh.UNBUILT).otherwise((F.col("k") % 4).cast("int") - 1).alias("sampled"), F.when(F.col("k") % 5 == 0, 40).otherwise(32).alias("stamped"))


STATE = f"{CAPS}, st AS (SELECT k, shown, CASE WHEN k % 3 = 0 THEN -2 ELSE k % 4 - 1 END::INTEGER AS sampled, CASE WHEN k % 5 = 0 THEN 40 ELSE 32 END AS stamped FROM c4)"


def q_build_queue(spark, sf_dir):
    return mesh.build_queue(state(spark, sf_dir), 40)


def q_mesh_stats(spark, sf_dir):
    return mesh.stats(state(spark, sf_dir))


def q_chunk_vertices(spark, sf_dir):
    v = mesh.vertices(mesh.chunks(spark), 8)
    return quantised(v.drop("u", "v"), "x", "y", "z")


def q_chunk_indices(spark, sf_dir):
    return mesh.chunk_indices(spark, 16)


def q_rebuild(spark, sf_dir):
    """Chunks that want it, sampled on an 128-step grid each, from the raster of ``lineitem``; the mean height of each in thousandths."""
    stored = raster_queries.stored(spark, sf_dir)
    built = mesh.rebuilt(spark, state(spark, sf_dir), 40, lambda p: raster.sample_heights(p, stored, 1, raster_queries.T))
    return built.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("detail"), F.floor(F.avg("height") * 1000 + 0.5).cast("long").alias("mean"))


def rebuild_sql() -> str:
    taps = ", ".join(f"f{d}.h::DOUBLE AS h{d}" for d in range(4))
    joins = " ".join(f"JOIN fine f{d} ON f{d}.x = (px + {d % 2} + 64) % 64 AND f{d}.y = least(31, greatest(0, py + {d // 2}))" for d in range(4))
    return f"""{STATE}, {raster_queries.SAMPLES.strip()}, gg AS (SELECT ch.*, i, j, (128 - i) / 128.0::DOUBLE AS wa, (i - j) / 128.0::DOUBLE AS wb, j / 128.0::DOUBLE AS wc FROM ch JOIN st ON st.k = ch.k, range(129) a(i), range(129) b(j) WHERE j <= i AND (sampled = -2 OR (sampled < 2 AND stamped <> 40))),
  gv AS (SELECT k, {', '.join(f'a{c} * wa + e{c} * wb + c{c} * wc AS {c}' for c in 'xyz')} FROM gg), gn AS (SELECT k, x, y / sqrt(x * x + y * y + z * z) AS y, z FROM gv),
  gs AS (SELECT k, ((atan2(x, z) + pi()) / (2 * pi())) AS u, (pi() / 2 - asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, y)))) / pi() AS v FROM gn), gf AS (SELECT k, (u - floor(u)) * 64 - 0.5::DOUBLE AS fx, v * 32 - 0.5::DOUBLE AS fy FROM gs),
  gt AS (SELECT k, fx - floor(fx) AS sx, fy - floor(fy) AS sy, floor(fx)::BIGINT AS px, floor(fy)::BIGINT AS py FROM gf), gh AS (SELECT k, sx, sy, {taps} FROM gt {joins})
SELECT k, count(*) AS n, 1::INTEGER AS detail, CAST(floor(avg((h0 + (h1 - h0) * sx) + ((h2 + (h3 - h2) * sx) - (h0 + (h1 - h0) * sx)) * sy) * 1000 + 0.5) AS BIGINT) AS mean FROM gh GROUP BY k"""


def q_quadtree(spark, sf_dir):
    leaves = mesh.select_leaves(spark, CAM, 800, 600, 4, 60)
    return leaves.select("k", "level", mesh.front_facing(CAM).alias("front"))


def q_quadtree_edges(spark, sf_dir):
    leaves = mesh.select_leaves(spark, CAM, 800, 600, 4, 60)
    return mesh.edges(leaves).groupBy("n").agg(F.count(F.lit(1)).alias("edges"))


def q_quadtree_stitch(spark, sf_dir):
    leaves = mesh.select_leaves(spark, CAM, 800, 600, 4, 60)
    return mesh.t_junctions(leaves).select("k", "side", "steps", *(micro(F.col(f"m.{c}")).alias(c) for c in "xyz"))


def q_bulge(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("level"))
    return n.select("level", micro(mesh.bulge(F.col("level")) * 1000).alias("bulge"))


def _quadtree_sql() -> str:
    """Leaves of the same tree, recursively."""
    def screen(p: str) -> tuple[str, str, str]:
        z1 = f"({p}x * {C['sin_lon']} + {p}z * {C['cos_lon']})"
        return f"({C['cx']} + ({p}x * {C['cos_lon']} - {p}z * {C['sin_lon']}) * {C['radius']})", f"({C['cy']} - ({p}y * {C['cos_lat']} - {z1} * {C['sin_lat']}) * {C['radius']})", f"({p}y * {C['sin_lat']} + {z1} * {C['cos_lat']})"

    at = {p: screen(p) for p in CORNERS}
    slack = "(1 - cos(acos(1 / sqrt(3.0::DOUBLE)) / pow(2, l)))"
    mm = lambda f, i: f"{f}({at['a'][i]}, {at['e'][i]}, {at['c'][i]})"
    r = C["radius"]
    culled = f"({mm('greatest', 2)} + {slack} < 0 OR {mm('least', 0)} - {slack} * {r} > 800 OR {mm('greatest', 0)} + {slack} * {r} < 0 OR {mm('least', 1)} - {slack} * {r} > 600 OR {mm('greatest', 1)} + {slack} * {r} < 0)"
    sq = lambda e: f"(({e}) * ({e}))"
    length2 = lambda p, q: f"({sq(at[p][0] + ' - ' + at[q][0])} + {sq(at[p][1] + ' - ' + at[q][1])} + 0.25::DOUBLE * {sq('(' + at[p][2] + ' - ' + at[q][2] + ') * ' + r)})"
    over = f"(l < 4 AND greatest({length2('a', 'e')}, {length2('e', 'c')}, {length2('c', 'a')}) > 3600)"
    front = f"({at['e'][0]} - {at['a'][0]}) * ({at['c'][1]} - {at['a'][1]}) - ({at['e'][1]} - {at['a'][1]}) * ({at['c'][0]} - {at['a'][0]}) > 1e-12"
    return f"""WITH RECURSIVE {triangles_sql(4, f'NOT {culled} AND {over}')}, leaves AS (SELECT *, {front} AS front FROM tri WHERE NOT {culled} AND NOT {over})"""


QUADTREE = _quadtree_sql()


def _stitch_sql() -> str:
    """Edges of leaves, cut at corners of other leaves, up to four times over."""
    half = lambda a, b: ", ".join(f"({a}{c} + {b}{c}) / sqrt(({a}x + {b}x) * ({a}x + {b}x) + ({a}y + {b}y) * ({a}y + {b}y) + ({a}z + {b}z) * ({a}z + {b}z)) AS m{c}" for c in "xyz")
    ends = lambda a, b, p, q: ", ".join(f"{s}{c} AS {t}{c}" for s, t in ((a, p), (b, q)) for c in "xyz")
    sides = " UNION ALL ".join(f"SELECT k, '{side}' AS side, {ends(a, b, 'p', 'q')} FROM leaves" for side, a, b in (("ab", "a", "e"), ("bc", "e", "c"), ("ca", "c", "a")))
    corners = " UNION ".join(f"SELECT {', '.join(f'{t}{c} AS {c}' for c in 'xyz')} FROM leaves" for t in CORNERS)
    halves = " UNION ALL ".join(f"SELECT k, side, {ends(a, b, 'p', 'q')}, steps FROM cut{{n}}" for a, b in (("p", "m"), ("m", "q")))
    parts, source = [], "SELECT *, 0 AS steps FROM sides"
    for n in range(1, mesh.STITCH_DEPTH + 1):
        parts.append(f"mid{n} AS (SELECT *, {half('p', 'q')} FROM ({source})), cut{n} AS (SELECT k, side, {', '.join(t + c for t in 'pqm' for c in 'xyz')}, {n} AS steps FROM mid{n} SEMI JOIN corners o ON o.x = mx AND o.y = my AND o.z = mz)")
        source = halves.format(n=n)
    cuts = " UNION ALL ".join(f"SELECT k, side, steps, mx, my, mz FROM cut{n}" for n in range(1, mesh.STITCH_DEPTH + 1))
    return f"{QUADTREE}, sides AS ({sides}), corners AS ({corners}), {', '.join(parts)}, cuts AS ({cuts})"


STITCH = _stitch_sql()

QUERIES = {
    "morph_resample": q_resample, "morph_align": q_align, "morph_match": q_match, "morph_blend": q_morph_blend, "morph_polygons": q_morph, "label_boxes": q_label_boxes, "label_declutter": q_declutter, "label_declutter_one_scene": q_declutter_one_scene, "label_overlaps": q_overlaps,
    "scene_anchors": q_anchors, "model_vertices": q_model_vertices, "model_faces": q_model_faces, "model_faults": q_model_faults, "model_paint": q_paint, "scene_layers": q_layers, "mesh_chunks": q_chunks, "mesh_caps": q_caps,
    "mesh_build_queue": q_build_queue, "mesh_stats": q_mesh_stats, "mesh_vertices": q_chunk_vertices, "mesh_indices": q_chunk_indices, "mesh_rebuild": q_rebuild, "quadtree_leaves": q_quadtree, "quadtree_edges": q_quadtree_edges,
    "quadtree_stitch": q_quadtree_stitch, "quadtree_bulge": q_bulge,
}

HUT = "SELECT 'hut' AS model, i::INTEGER AS i, 0.5::DOUBLE + CASE WHEN i % 4 IN (1, 2) THEN 1 ELSE -1 END * 0.5::DOUBLE AS x, 0.25::DOUBLE + CASE WHEN i % 4 >= 2 THEN 1 ELSE -1 END * 1.0::DOUBLE AS y, -0.125::DOUBLE + CASE WHEN i >= 4 THEN 1 ELSE -1 END * 2.0::DOUBLE AS z FROM range(8) t(i)"
MAST = "SELECT 'mast', i::INTEGER, CASE WHEN i < 16 THEN cos((i % 8) / 8.0::DOUBLE * (2 * pi())) * 0.5::DOUBLE ELSE 0 END, 1 + CASE WHEN i < 8 OR i = 16 THEN -1.5 ELSE 1.5 END::DOUBLE, CASE WHEN i < 16 THEN sin((i % 8) / 8.0::DOUBLE * (2 * pi())) * 0.5::DOUBLE ELSE 0 END FROM range(18) t(i)"
BLEND_B = {"x": "0.6::DOUBLE", "y": "0.0::DOUBLE", "z": "0.8::DOUBLE"}
SQL = {
    "morph_resample": RESAMPLE, "morph_align": ALIGN, "morph_match": MATCH, "label_declutter": DECLUTTER, "label_declutter_one_scene": ONE_SCENE,
    "morph_blend": f"""WITH {PLACES}, u AS (SELECT id, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS x, sin(lat * (pi() / 180)) AS y, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS z, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (id % 13) / 10.0::DOUBLE - 0.1::DOUBLE)) AS t FROM places),
  b AS (SELECT *, {', '.join(f"{c} + (CASE WHEN id % 10 = 0 THEN -{c} ELSE {v} END - {c}) * t AS m{c}" for c, v in BLEND_B.items())} FROM u), n AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS n FROM b)
  SELECT id, {', '.join(M(f'CASE WHEN n < 1e-9 THEN {c} ELSE m{c} / n END') + f' AS {c}' for c in 'xyz')} FROM n""",
    "label_boxes": f"WITH {BOXES} SELECT scene, priority, {M('bl')} AS bl, {M('bt')} AS bt, {M('br')} AS br, {M('bb')} AS bb FROM box",
    "label_overlaps": f"WITH {BOXES} SELECT a.scene, a.priority AS a, b.priority AS b FROM box a JOIN box b ON a.scene = b.scene AND a.priority < b.priority AND a.bl < b.br AND a.br > b.bl AND a.bt < b.bb AND a.bb > b.bt",
    "scene_anchors": f"""WITH {PLACES}, u AS (SELECT id, (['surface', 'above', 'orbit'])[id % 3 + 1] AS kind, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS x, sin(lat * (pi() / 180)) AS y, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS z FROM places),
  r AS (SELECT *, CASE WHEN kind = 'surface' THEN 1 + CASE WHEN id % 4 > 0 THEN id % 5000 ELSE 0 END::DOUBLE / 6371000 * 30.0::DOUBLE ELSE 1 + (id % 900)::DOUBLE / 6371 END AS r FROM u) SELECT id, kind, {', '.join(M(f'{c} * r') + f' AS {c}' for c in 'xyz')} FROM r""",
    "model_vertices": f"WITH v AS ({HUT} UNION ALL {MAST}) SELECT model, i, {', '.join(M(c) + f' AS {c}' for c in 'xyz')} FROM v",
    "model_faces": f"WITH {FACE_ROWS} SELECT * FROM faces",
    "model_faults": f"""WITH {FACE_ROWS} SELECT model, f, CASE WHEN f % 5 = 0 THEN 'not a triple' WHEN f % 11 = 0 THEN 'no colour' ELSE 'index out of range' END AS fault FROM faces WHERE f % 5 = 0 OR f % 11 = 0 OR f % 7 = 0""",
    "scene_layers": """SELECT 9 AS layer, 'labels' AS name, n_nationkey AS item FROM nation UNION ALL SELECT 2, 'regions', r_regionkey FROM region UNION ALL SELECT 0, 'overlay', r_regionkey FROM region WHERE r_regionkey = 0""",
    "mesh_chunks": f"{CHUNKS} SELECT k, {', '.join(M(q + c) + f' AS {p}{c}' for p, q in zip('abc', CORNERS) for c in 'xyz')} FROM ch",
    "mesh_caps": f"{CAPS} SELECT k, {M('px')} AS x, {M('py')} AS y, {M('pz')} AS z, {M('reach')} AS reach, shown FROM c4",
    "mesh_build_queue": f"{STATE} SELECT k, shown, CASE WHEN sampled = -2 AND shown THEN 0 WHEN sampled = -2 THEN 1 WHEN shown THEN 2 ELSE 3 END AS class FROM st WHERE sampled = -2 OR (sampled < 2 AND stamped <> 40)",
    "mesh_stats": f"{STATE} SELECT count(*) FILTER (shown) AS drawn, count(*) FILTER (shown) * 16384 AS triangles, count(*) FILTER (sampled <> -2) AS built, count(*) AS chunks, min(least(sampled, 2)) FILTER (sampled <> -2) AS detail FROM st",
    "mesh_vertices": f"""{CHUNKS}, g AS (SELECT *, (8 - i) / 8.0::DOUBLE AS wa, (i - j) / 8.0::DOUBLE AS wb, j / 8.0::DOUBLE AS wc FROM ch, range(9) a(i), range(9) b(j) WHERE j <= i), v AS (SELECT k, i, j, {', '.join(f'a{c} * wa + e{c} * wb + c{c} * wc AS {c}' for c in 'xyz')} FROM g)
  SELECT k, i::INTEGER AS i, j::INTEGER AS j, {', '.join(M(f'{c} / sqrt(x * x + y * y + z * z)') + f' AS {c}' for c in 'xyz')} FROM v""",
    "mesh_rebuild": rebuild_sql(),
    "model_paint": paint_sql(),
    "mesh_indices": """WITH t AS (SELECT i, j, (i - 1) * i // 2 AS above, i * (i + 1) // 2 AS r FROM range(1, 17) a(i), range(16) b(j) WHERE j < i)
  SELECT i, j, true AS up, above + j AS a, r + j AS b, r + j + 1 AS c FROM t UNION ALL SELECT i, j, false, above + j, r + j + 1, above + j + 1 FROM t WHERE j < i - 1""",
    "quadtree_edges": f"""{QUADTREE}, p AS (SELECT {', '.join(f"concat_ws(',', {M(t + 'x')}, {M(t + 'y')}, {M(t + 'z')}) AS p{t}" for t in CORNERS)} FROM leaves),
  e AS (SELECT least(pa, pe) AS u, greatest(pa, pe) AS v FROM p UNION ALL SELECT least(pe, pc), greatest(pe, pc) FROM p UNION ALL SELECT least(pc, pa), greatest(pc, pa) FROM p), n AS (SELECT count(*) AS n FROM e GROUP BY u, v)
SELECT n, count(*) AS edges FROM n GROUP BY n""",
    "quadtree_stitch": f"""{STITCH} SELECT k, side, steps::INTEGER AS steps, {', '.join(M('m' + c) + f' AS {c}' for c in 'xyz')} FROM cuts WHERE steps > 0""",
    "quadtree_leaves": f"{QUADTREE} SELECT k, l AS level, front FROM leaves",
    "quadtree_bulge": f"SELECT n_nationkey AS level, {M('(1 - cos(acos(1 / sqrt(3.0::DOUBLE)) / pow(2, n_nationkey))) * 1000')} AS bulge FROM nation",
}
