"""Row generators for SQL: functions that give arrays of rows, for ``inline``.

``register`` makes them temporary functions of a session:

    great_circle(lon1, lat1, lon2, lat2, step)   -> (i, lon, lat)     points along a leg, both ends included
    small_circle(lon, lat, radius, segments)     -> (i, lon, lat)     segments + 1 points around a centre, the last on the first
    triangle_grid(ax, ay, az, ..., cz, n)        -> (i, j, x, y, z)   the (n + 1)(n + 2) / 2 directions of a triangle's grid

as in ``SELECT line, inline(points) FROM (SELECT line, great_circle(lon1, lat1, lon2, lat2, 1.0) AS points FROM lines)``. They are expressions of SQL,
which Spark writes into the query that calls them: no Python, no join, no shuffle. Angle functions are the near ones of ``geo`` a call, and by points where ``geo.settled`` takes them. (SQL's own table functions, called with LATERAL, are joined
back to the rows that they are called with, and a generator can't call a function of SQL itself.) Their rules are those of ``curves.geodesic`` (a leg), ``curves.small_circles`` and
``mesh.vertices``; nulls give no rows. What is common to a call's rows is computed once, in a one-element array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from .geo import HALF_BAND, NEAR_CLASS, POLE, TINY


def _let(values: dict[str, str], name: str, body: str) -> str:
    """``body`` with the array lambda variable ``name`` as a struct of the values, each computed once."""
    return f"transform(array(named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())})), {name} -> {body})[0]"


def _near(name: str, *args: str) -> str:
    """``geo.NEAR``'s function in SQL."""
    return f"CAST(java_method('{NEAR_CLASS}', '{name}', {', '.join(args)}) AS DOUBLE)"


def _plain(name: str, *args: str) -> str:
    return f"{name}({', '.join(args)})"


def _unit(lon: str, lat: str, name: str) -> dict[str, str]:
    lon, lat = f"({lon} * (pi() / 180))", f"({lat} * (pi() / 180))"
    return {f"{name}x": f"{_near('cos', lat)} * {_near('sin', lon)}", f"{name}y": _near("sin", lat), f"{name}z": f"{_near('cos', lat)} * {_near('cos', lon)}"}


def _dot(a: str, b: str) -> str:
    return " + ".join(f"{a}{c} * {b}{c}" for c in "xyz")


def _settled(rule: Callable[[Callable[..., str]], str]) -> str:
    """The struct of ``i, lon, lat`` that ``rule`` gives: by plain functions, and by near ones where ``geo.settled`` takes them."""
    half = lambda c: f"abs(pmod(d.p.{c} * 1e6D, 1.0D) - 0.5D) < {HALF_BAND}D"
    return _let({"p": rule(_plain)}, "d", f"CASE WHEN abs(d.p.lat) > {POLE}D OR {half('lon')} OR {half('lat')} THEN {rule(_near)} ELSE d.p END")


def _lonlat(trig: Callable[..., str]) -> str:
    return f"named_struct('i', i, 'lon', {trig('atan2', 'v.x', 'v.z')} * 180 / pi(), 'lat', {trig('asin', 'least(1.0D, greatest(-1.0D, v.y))')} * 180 / pi())"


def _great_circle() -> str:
    def point(trig: Callable[..., str]) -> str:
        shares = {
            "a": f"CASE WHEN s.sine < {TINY}D THEN 1 - i ELSE {trig('sin', '(1 - i / s.steps) * s.omega')} / s.sine END",
            "b": f"CASE WHEN s.sine < {TINY}D THEN i ELSE {trig('sin', 'i / s.steps * s.omega')} / s.sine END",
        }
        return _let(shares, "w", _let({c: f"s.a{c} * w.a + s.b{c} * w.b" for c in "xyz"}, "v", _lonlat(trig)))

    steps = f"CASE WHEN o.sine < {TINY}D THEN 1 ELSE CAST(greatest(1, ceil(o.omega / (pi() / 180) / step)) AS INT) END"
    names = [f"{n}{c}" for n in "ab" for c in "xyz"]
    rows = _let({n: f"o.{n}" for n in [*names, "omega", "sine"]} | {"steps": steps}, "s", f"transform(sequence(0, s.steps), i -> {_settled(point)})")
    sine = _let({n: f"m.{n}" for n in [*names, "omega"]} | {"sine": _near("sin", "m.omega")}, "o", rows)
    angle = _let({n: f"u.{n}" for n in names} | {"omega": _near("acos", f"least(1.0D, greatest(-1.0D, {_dot('u.a', 'u.b')}))")}, "m", sine)
    whole = _let(_unit("lon1", "lat1", "a") | _unit("lon2", "lat2", "b"), "u", angle)
    return f"CASE WHEN lon1 + lat1 + lon2 + lat2 + step IS NOT NULL THEN {whole} END"


def _small_circle() -> str:
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    on = {c: f"s.c{c} * s.cosine + s.u{c} * w.c + (s.c{p} * s.u{q} - s.c{q} * s.u{p}) * w.s" for c, (p, q) in cross.items()}

    def point(trig: Callable[..., str]) -> str:
        rim = {"c": f"{trig('cos', 'i / segments * (2 * pi())')} * s.sine", "s": f"{trig('sin', 'i / segments * (2 * pi())')} * s.sine"}
        return _let(rim, "w", _let(on, "v", _lonlat(trig)))

    size = "sqrt(a.ux * a.ux + a.uy * a.uy + a.uz * a.uz)"
    angles = {"sine": _near("sin", "(radius * (pi() / 180))"), "cosine": _near("cos", "(radius * (pi() / 180))")}
    rows = _let({f"c{c}": f"a.c{c}" for c in "xyz"} | {f"u{c}": f"a.u{c} / {size}" for c in "xyz"} | angles, "s", f"transform(sequence(0, segments), i -> {_settled(point)})")
    steep = "abs(c.cy) < 0.9D"
    away = {"ux": f"CASE WHEN {steep} THEN -c.cz ELSE 0.0D END", "uy": f"CASE WHEN {steep} THEN 0.0D ELSE c.cz END", "uz": f"CASE WHEN {steep} THEN c.cx ELSE -c.cy END"}
    whole = _let(_unit("lon", "lat", "c"), "c", _let({f"c{c}": f"c.c{c}" for c in "xyz"} | away, "a", rows))
    return f"CASE WHEN lon + lat + radius + segments IS NOT NULL THEN {whole} END"


def _triangle_grid() -> str:
    sums = {c: f"a{c} * ((n - i) / n) + b{c} * ((i - j) / n) + c{c} * (j / n)" for c in "xyz"}
    size = "sqrt(v.x * v.x + v.y * v.y + v.z * v.z)"
    point = _let(sums, "v", f"named_struct('i', i, 'j', j, {', '.join(f"'{c}', v.{c} / {size}" for c in 'xyz')})")
    return f"flatten(transform(sequence(0, n), i -> transform(sequence(0, i), j -> {point})))"


_PLACE, _GRID = "ARRAY<STRUCT<i: INT, lon: DOUBLE, lat: DOUBLE>>", "ARRAY<STRUCT<i: INT, j: INT, x: DOUBLE, y: DOUBLE, z: DOUBLE>>"
FUNCTIONS = {
    "great_circle": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE, step DOUBLE", _PLACE, _great_circle()),
    "small_circle": ("lon DOUBLE, lat DOUBLE, radius DOUBLE, segments INT", _PLACE, _small_circle()),
    "triangle_grid": (", ".join(f"{n}{c} DOUBLE" for n in "abc" for c in "xyz") + ", n INT", _GRID, _triangle_grid()),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, in place of earlier ones of these names."""
    for name, (given, made, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {made} RETURN {body}")
