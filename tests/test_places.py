import math
import random
import struct

import numpy as np
import pytest

from tarnflow.operators import places
from tarnflow.sources.wkb import edge_rows, rings

SCHEMA = "who string, lat double, lon double, id long, x int"
KD = {"leaf_rows": 40, "sample_rows": 100}


def metres(a, b):
    p, q = (np.array([math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))]) for y, x in (a, b))
    return 2 * places.EARTH_M * math.asin(min(1, np.linalg.norm(p - q) / 2))


def line(points, order="<"):
    return struct.pack(order + "BII", order == "<", 2, len(points)) + b"".join(struct.pack(order + "dd", *p) for p in points)


def polygon(*parts):
    return struct.pack("<BII", 1, 3, len(parts)) + b"".join(struct.pack("<I", len(p)) + b"".join(struct.pack("<dd", *q) for q in p) for p in parts)


def spots(seed=1, n=150):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = r.choice([(10, 20), (10, 179.999), (10, -179.999), (-40, 359.99), (89.999, 5)])
        out.append((f"s{i:03d}", lat + r.uniform(-0.01, 0.01) if lat < 89 else lat, lon + r.uniform(-0.01, 0.01), i, 0))
    out += [(f"t{i}", 10.0, 20.0, i, 0) for i in range(8)]
    return out + out[:9]


BAD = [("n1", None, 3.0, 1, 1), ("n2", 3.0, math.nan, 1, 1), ("n3", 95.0, 3.0, 1, 1), (None, 3.0, 3.0, 1, 1), ("n4", 1.0, math.inf, 1, 1)]


@pytest.mark.parametrize("kd", [{}, KD])
def test_neighbours(spark, kd):
    rows = spots()
    at = places.positions(spark.createDataFrame(rows + BAD, SCHEMA), "who", "lat", "lon")
    got = [tuple(r) for r in places.neighbours(at, "who", 500.0, **kd).collect()]
    uniq = {r[0]: (r[1], r[2]) for r in rows}
    want = {(a, b) for a in uniq for b in uniq if a < b and metres(uniq[a], uniq[b]) <= 500}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


@pytest.mark.parametrize("kd", [{}, KD])
def test_lines_across_the_date_line(spark, kd):
    r = random.Random(2)
    at = places.positions(spark.createDataFrame(spots() + BAD, SCHEMA), "who", "lat", "lon")
    lines = {}
    for k in range(30):
        lat, lon = r.choice([(10, 20), (10, 179.99), (-40, -0.01)])
        lines[k] = [(lon + r.uniform(-0.03, 0.03), lat + r.uniform(-0.03, 0.03)) for _ in range(r.randrange(2, 5))]
        lines[k] = [(((x + 180) % 360) - 180, y) for x, y in lines[k]]
    geoms = [(k, line(v, "<" if k % 2 else ">")) for k, v in lines.items()] + [(99, None), (98, b""), (97, b"\x01\x02"), (None, line([(0, 0), (1, 1)])), (0, line(lines[0]))]
    edges = edge_rows(spark.createDataFrame(geoms[:-1] + geoms[:2], "id long, geom binary"), "id")
    got = {(x["who"], x["line"]) for x in places.near_lines(at, "who", edges, 1000.0, **kd).collect()}
    scale = math.radians(1) * places.EARTH_M

    def distance(p, v):
        best = math.inf
        for (x0, y0), (x1, y1) in zip(v, v[1:]):
            w = lambda x: (x - p[1] + 180) % 360 - 180
            c = math.cos(math.radians(p[0])) * scale
            a, b = np.array([w(x0) * c, (y0 - p[0]) * scale]), np.array([w(x1) * c, (y1 - p[0]) * scale])
            s = b - a
            t = np.clip(-(a @ s) / max(s @ s, 1e-12), 0, 1)
            best = min(best, np.linalg.norm(a + t * s))
        return best

    uniq = {r["who"]: (r["lat"], r["lon"]) for r in at.collect()}
    assert got == {(w, k) for w, p in uniq.items() for k, v in lines.items() if distance(p, v) <= 1000} and got


@pytest.mark.parametrize("kd", [{}, {"leaf_rows": 30, "sample_rows": 60}])
def test_regions_with_holes(spark, kd):
    def ring(cx, cy, radius, n=17):
        p = [(cx + radius * (1 + 0.3 * math.sin(3 * a)) * math.cos(a), cy + radius * math.sin(a)) for a in np.linspace(0, 2 * math.pi, n)[:-1]]
        return [*p, p[0]]

    shapes = {1: [ring(5, 5, 4), ring(5, 5, 1.5)], 2: [ring(8, 6, 3)], 3: [ring(180, 0, 3)], 4: [ring(-100, 50, 2), ring(-100, 50, 0.5)]}
    rows = [(k, polygon(*v)) for k, v in shapes.items()] + [(9, None), (8, polygon())]
    r = random.Random(3)
    pts = [(f"p{i}", y + r.uniform(-5, 5), x + r.uniform(-5, 5), i, 0) for i, (x, y) in enumerate(r.choices([(5, 5), (180, 0), (-100, 50), (260, 50)], k=300))]
    pts += pts[:5]
    at = places.positions(spark.createDataFrame(pts + BAD, SCHEMA), "who", "lat", "lon")
    edges = edge_rows(spark.createDataFrame(rows, "id long, geom binary"), "id")
    got = [tuple(x) for x in places.inside_regions(at, "who", edges, **kd).collect()]

    def inside(p, parts):
        odd = 0
        for x in (p[1] - 360, p[1], p[1] + 360):
            odd |= sum((y0 <= p[0]) != (y1 <= p[0]) and x0 + (p[0] - y0) / (y1 - y0) * (x1 - x0) > x for v in parts for (x0, y0), (x1, y1) in zip(v, v[1:])) % 2
        return odd

    uniq = {x["who"]: (x["lat"], x["lon"]) for x in at.collect()}
    want = {(w, k) for w, p in uniq.items() for k, v in shapes.items() if inside(p, v)}
    assert len(got) == len(set(got)) and set(got) == want and {k for _, k in want} == {1, 2, 3, 4}


def test_empty_tables(spark):
    none = places.positions(spark.createDataFrame([], SCHEMA), "who", "lat", "lon")
    some = places.positions(spark.createDataFrame(spots(n=3), SCHEMA), "who", "lat", "lon")
    edges = edge_rows(spark.createDataFrame([(1, polygon([(0, 0), (0, 1), (1, 1), (0, 0)]))], "id long, geom binary"), "id")
    assert places.neighbours(none, "who", 500.0).collect() == []
    for a, e in ((none, edges), (some, edges.limit(0)), (none, edges.limit(0))):
        assert places.near_lines(a, "who", e, 1000.0).collect() == [] and places.inside_regions(a, "who", e).collect() == []


def test_wkb_with_z_srid_and_parts():
    z = struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 1, 2, 9, 3, 4, 9)
    assert [x.tolist() for x in rings(z)] == [[[1, 2], [3, 4]]]
    e = struct.pack("<BIII", 1, 0x20000002, 4326, 2) + struct.pack("<4d", 1, 2, 3, 4)
    assert [x.tolist() for x in rings(e)] == [[[1, 2], [3, 4]]]
    m = struct.pack("<BII", 1, 5, 2) + line([(0, 0), (1, 1)]) + line([(2, 2), (3, 3)], ">")
    assert [x.tolist() for x in rings(m)] == [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]


def test_nearest_line_takes_tiers_and_positions(spark):
    at = places.positions(spark.createDataFrame([("a", 10.0, 20.001, 1, 1), ("b", 10.05, 20.04, 1, 1), ("c", -50.0, 0.0, 1, 1)], SCHEMA), "who", "lat", "lon")
    edges = edge_rows(spark.createDataFrame([(1, line([(20.0, 9.9), (20.0, 10.0), (20.0, 10.1)])), (2, line([(20.1, 9.9), (20.1, 10.1)]))], "id long, geom binary"), "id")
    got = {r["who"]: r for r in places.nearest_line(at, "who", edges, (500.0, 20_000.0)).collect()}
    km = math.radians(1) * places.EARTH_M
    assert set(got) == {"a", "b"} and got["a"]["line"] == 1 and got["b"]["line"] == 1
    assert got["a"]["along"] == pytest.approx(0.1 * km, rel=1e-4) and got["b"]["along"] == pytest.approx(0.15 * km, rel=1e-4)
    assert got["a"]["metres"] == pytest.approx(0.001 * km * math.cos(math.radians(10)), rel=1e-3) and got["a"]["lon"] == pytest.approx(20.0, abs=1e-6)


def test_nearest_where_three_tiers(spark):
    at = places.positions(spark.createDataFrame([("a", 0.0, 0.0, 1, 1), ("b", 10.0, 0.0, 1, 1), ("c", 60.0, 100.0, 1, 1), ("d", 0.0, 179.99, 1, 1)], SCHEMA), "who", "lat", "lon")
    targets = spark.createDataFrame([(1, 0.0, 0.01, False), (2, 0.0, 0.03, True), (3, 10.0, 0.02, False), (4, 10.0, -0.02, False), (5, 0.0, -179.99, True)], "id long, lat double, lon double, valid boolean")
    got = {r["who"]: (r["target"], r["tier"]) for r in places.nearest_where(at, "who", targets, 5000.0).collect()}
    assert got["a"] == (2, 1) and got["b"] == (3, 2) and got["c"][1] == 3 and got["d"] == (5, 1)
    assert places.nearest_where(at, "who", targets.limit(0), 5000.0).collect() == []
    assert places.nearest_where(at.limit(0), "who", targets, 5000.0).collect() == []


@pytest.mark.parametrize("kd", [{}, {"leaf_rows": 20, "sample_rows": 50}])
def test_nearest_where_and_near_any_against_all_pairs(spark, kd):
    r = random.Random(12)
    spot = lambda: (r.choice([10.0, 10.1, 60.0, -70.0]) + r.uniform(-0.2, 0.2), r.choice([0.0, 179.9, -179.9, 100.0]) + r.uniform(-0.1, 0.1))
    targets = [(i, *spot(), r.random() < 0.5) for i in range(200)] + [(500 + i, *spot(), None) for i in range(5)]
    targets += [(900 + i, *targets[i][1:]) for i in range(20)]
    at = {f"s{i}": spot() for i in range(120)} | {"far": (-5.0, 40.0), "pole": (89.9, 10.0)}
    at = {k: (y, (x + 180) % 360 - 180) for k, (y, x) in at.items()}
    got = {x["who"]: (x["target"], x["tier"], round(x["km"], 6)) for x in places.nearest_where(spark.createDataFrame([(k, *v) for k, v in at.items()], "who string, lat double, lon double"), "who", spark.createDataFrame(targets, "id long, lat double, lon double, valid boolean"), 5000.0, **kd).collect()}

    def best(y, x):
        out = []
        for i, a, b, ok in targets:
            km = min(math.hypot((a - y) * 111, (b - x + turn) * 111 * math.cos(math.radians(y))) for turn in (-360, 0, 360))
            out.append((1 if km <= 5 and ok else 2 if km <= 5 else 3, km, i))
        tier, km, i = min(out)
        return i, tier, round(km, 6)

    assert got == {k: best(*v) for k, v in at.items()} and {x[1] for x in got.values()} == {1, 2, 3}
    point = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double").select("id", *places.unit_vector("lat", "lon"))
    q, u = [(i, *v) for i, v in enumerate(at.values())], [x[:3] for x in targets]
    near = [x["id"] for x in places.near_any(point(q), point(u), 8000.0, **kd).collect()]
    assert len(near) == len(set(near)) and set(near) == {i for i, y, x in q if any(metres((y, x), b[1:]) <= 8000 for b in u)} and len(near) > 20


def test_dense_points_are_compared_in_parts():
    import numpy as np

    from tarnflow.operators.places import LocalTree

    points = np.random.default_rng(3).normal(size=(300, 3))
    parts = list(LocalTree(points).within(points, 1.0, block=64, candidates=50))
    got = sorted((int(a), int(b)) for q, p, _ in parts for a, b in zip(q, p))
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert got == [(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 1.0))] and len(parts) > 50
    assert [len(q) for q, _, _ in LocalTree(points).within(points + 1e3, 1.0)] == [0]


@pytest.mark.parametrize("kd", [{}, {"leaf_rows": 15, "sample_rows": 40}])
def test_regions_with_level_and_upright_edges(spark, kd):
    r = random.Random(11)
    boxes = {k: (r.randrange(0, 12), r.randrange(0, 12), r.randrange(1, 9), r.randrange(1, 9)) for k in range(25)}
    rows = []
    for k, (x, y, w, h) in boxes.items():
        outer = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        inner = [(x + w / 3, y + h / 3), (x + w / 3, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h / 3), (x + w / 3, y + h / 3)]
        rows.append((k, polygon(outer, inner)))
    edges = edge_rows(spark.createDataFrame(rows, "id long, geom binary"), "id")
    pts = {f"s{i}": (r.uniform(-1, 21), r.uniform(-1, 21)) for i in range(400)}
    at = spark.createDataFrame([(k, y, x) for k, (x, y) in pts.items()], "who string, lat double, lon double")
    got = {tuple(x) for x in places.inside_regions(at, "who", edges, **kd).collect()}
    within = lambda px, py, x, y, w, h: x < px < x + w and y < py < y + h and not (x + w / 3 < px < x + w / 2 and y + h / 3 < py < y + h / 2)
    assert got == {(s, k) for s, (px, py) in pts.items() for k, b in boxes.items() if within(px, py, *b)} and len(got) > 300
