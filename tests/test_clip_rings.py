"""Clipped rings against a walk over their chains, one after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import geo
from terraspan.operators import curves


def crossing(p, q):
    at = (p + (q - p) * (p[2] / (p[2] - q[2])))[:2]
    size = np.hypot(*at)
    return at / size if size > geo.TINY else at * 0


def loops(v):
    near = v[:, 2] > 0
    if len(v) < 3 or not near.any():
        return []
    if near.all():
        return [v[:, :2]]
    chains = []
    for s in np.flatnonzero(near & ~np.roll(near, 1)):
        run = int(np.argmin(np.roll(near, -s)))
        idx = (s + np.arange(run)) % len(v)
        chains.append(np.vstack([crossing(v[s - 1], v[s]), v[idx, :2], crossing(v[idx[-1]], v[(idx[-1] + 1) % len(v)])]))
    enter = np.array([math.atan2(c[0, 1], c[0, 0]) for c in chains])
    leave = np.array([math.atan2(c[-1, 1], c[-1, 0]) for c in chains])
    free, out = set(range(len(chains))), []
    while free:
        at, parts = min(free), []
        while at in free:
            free.remove(at)
            turn = np.mod(enter - leave[at], 2 * np.pi)
            ahead = int(np.argmin(turn))
            steps = max(2, math.ceil(turn[ahead] / (2 * math.pi) * 180))
            arc = leave[at] + turn[ahead] * np.arange(1, steps + 1) / steps
            parts += [chains[at], np.stack([np.cos(arc), np.sin(arc)], axis=1)]
            at = ahead
        out.append(np.vstack(parts))
    return out


@pytest.mark.parametrize("seed, cam", [(1, geo.camera(50, 60, 100, 0.0, 0.0)), (2, geo.camera(0, 0, 1, 0.7, -0.4))])
def test_loops_against_a_walk(spark, seed, cam):
    """Zigzags that cross the limb and themselves many times, rings in front, behind, too short, and a long one."""
    r = random.Random(seed)
    rows = []
    for ring in range(30):
        n = 300 if ring == 0 else r.choice([1, 2, 3, 4, 7, 12, 25, 40])
        narrow = ring % 5 == 1
        for i in range(n):
            lon, lat = (r.uniform(-20, 20) + 180 * (ring % 2), r.uniform(-20, 20)) if narrow else (r.uniform(-180, 180), r.uniform(-80, 80))
            a, b = math.radians(lon), math.radians(lat)
            rows.append((ring, i * 2 + 1, math.cos(b) * math.sin(a), math.sin(b), math.cos(b) * math.cos(a)))
    df = spark.createDataFrame(rows, "ring_id long, idx long, x double, y double, z double").repartition(5)
    turned = df.select("ring_id", "idx", *(c.alias(n) for n, c in zip("xyz", geo.rotate(cam, tuple(F.col(c) for c in "xyz"))))).toPandas().sort_values(["ring_id", "idx"])
    got = curves.clip_rings(df, cam).toPandas().sort_values(["ring_id", "loop", "seq"])
    assert got.groupby(["ring_id", "loop"])["seq"].agg(lambda s: list(s) == list(range(len(s)))).all()
    want = {}
    for ring, f in turned.groupby("ring_id"):
        for k, p in enumerate(loops(f[["x", "y", "z"]].to_numpy())):
            want[ring, k] = p
    found = {k: f[["sx", "sy"]].to_numpy() for k, f in got.groupby(["ring_id", "loop"])}
    assert found.keys() == want.keys() and len(want) > 30
    for k, p in want.items():
        assert found[k].shape == p.shape and np.allclose(found[k], np.array([cam.cx, cam.cy]) + p * np.array([1, -1]) * cam.radius, atol=1e-7), k
