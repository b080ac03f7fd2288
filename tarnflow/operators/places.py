"""Points near other points, lines or regions, by k-d partitions with halo copies and local k-d trees."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.lanes import map_lanes
from tarnflow.session import materialise

# fixed value of the data description: mean radius of the earth in metres
EARTH_M = 6_371_008.8
#: Rows of a k-d leaf, rows (about) from which the splits are fitted, and those for each leaf where the leaves are many.
LEAF_ROWS, SPLIT_SAMPLE, LEAF_SAMPLE = 20_000, 200_000, 16
#: Points at the bottom of a local k-d tree.
BUCKET = 16


def unit_vector(lat: str, lon: str) -> list[Column]:
    """Columns x, y, z of the unit vector of a position in degrees."""
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def chord(metres: float) -> float:
    """Straight distance of unit vectors that lie `metres` apart on the sphere."""
    return 2 * math.sin(min(metres / EARTH_M, math.pi) / 2)


class Splits:
    """A k-d tree over space: inner node i has children 2i+1 and 2i+2, its axis and its split value."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(leaves, 1))))
        inner = 2**self.depth - 1
        self.axis, self.value = np.zeros(inner, np.int64), np.zeros(inner)
        parts = {0: sample}
        for i in range(inner):
            p = parts.pop(i)
            if len(p):
                self.axis[i] = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                self.value[i] = np.median(p[:, self.axis[i]])
            low = p[:, self.axis[i]] < self.value[i]
            parts[2 * i + 1], parts[2 * i + 2] = p[low], p[~low]

    def leaves(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, leaf) of every leaf that the boxes [low, high] touch; a point is a box without size."""
        box, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        for _ in range(self.depth):
            axis, value = self.axis[node], self.value[node]
            left, right = low[box, axis] < value, high[box, axis] >= value
            box, node = np.concatenate([box[left], box[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return box, node - (2**self.depth - 1)


    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Low and high corner of every leaf, infinite at the outside."""
        dims = int(self.axis.max(initial=0)) + 1
        low, high = np.full((1, max(dims, 2)), -np.inf), np.full((1, max(dims, 2)), np.inf)
        for level in range(self.depth):
            at = np.arange(2**level) + 2**level - 1
            axis, value, row = self.axis[at], self.value[at], np.arange(2**level)
            left_high, right_low = high.copy(), low.copy()
            left_high[row, axis] = right_low[row, axis] = value
            low, high = (np.stack(x, axis=1).reshape(2 ** (level + 1), -1) for x in ((low, right_low), (left_high, high)))
        return low, high


def fit_splits(points: DataFrame, axes: list[str], leaf_rows: int = LEAF_ROWS, sample_rows: int = SPLIT_SAMPLE) -> Splits:
    """Splits that give leaves of about `leaf_rows` of `points`, fitted on about `sample_rows` of them.

    With more than sample_rows / LEAF_SAMPLE leaves the sample grows to LEAF_SAMPLE positions a leaf: 8 million, or 0.2 GB,
    for ten billion points. Only the splits come from the sample; every row is placed by them. The sample is picked by
    hash of the position.
    """
    n = points.count()
    part = max(1, math.ceil(n / max(sample_rows, LEAF_SAMPLE * n / leaf_rows)))
    picked = points.filter(F.pmod(F.xxhash64(*axes), F.lit(part)) == 0).select(*axes).toPandas().to_numpy(float)
    return Splits(picked.reshape(-1, len(axes)), math.ceil(n / leaf_rows))


class LocalTree:
    """A balanced k-d tree over the points of one leaf, built level by level, queried for all balls at once."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = max(0, math.ceil(math.log2(max(n / BUCKET, 1))))
        self.order = np.arange(n)
        edges = np.array([0, n])
        self.low, self.high = [], []
        for level in range(self.depth + 1):
            p = points[self.order]
            first = np.minimum(edges[:-1], max(n - 1, 0))
            self.low.append(np.minimum.reduceat(p, first, axis=0))
            self.high.append(np.maximum.reduceat(p, first, axis=0))
            if level == self.depth:
                break
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            axis = np.argmax(self.high[-1] - self.low[-1], axis=1)
            self.order = self.order[np.lexsort((p[np.arange(n), axis[group]], group))]
            edges = np.sort(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
        self.edges, self.points = edges, points

    def within(self, centres: np.ndarray, radius: float, block: int = 4096, candidates: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (centre, point, squared distance) of all pairs at most `radius` apart."""
        for at in range(0, len(centres), block):
            c = centres[at : at + block]
            q, node = np.arange(len(c)), np.zeros(len(c), np.int64)
            for level in range(self.depth + 1):
                gap = np.maximum(np.maximum(self.low[level][node] - c[q], c[q] - self.high[level][node]), 0)
                keep = (gap * gap).sum(axis=1) <= radius * radius
                q, node = q[keep], node[keep]
                if level < self.depth:
                    q, node = np.repeat(q, 2), np.column_stack([2 * node, 2 * node + 1]).ravel()
            size = self.edges[node + 1] - self.edges[node]
            upto = np.cumsum(size)
            # dense places have many candidates: they are compared some at a time
            cuts = np.searchsorted(upto, np.arange(candidates, upto[-1] if len(upto) else 0, candidates))
            for part in np.split(np.arange(len(q)), cuts):
                many = size[part]
                a = np.repeat(q[part], many)
                inside = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
                p = self.order[np.repeat(self.edges[node[part]], many) + inside]
                d = ((c[a] - self.points[p]) ** 2).sum(axis=1)
                hit = d <= radius * radius
                yield at + a[hit], p[hit], d[hit]


    def closest(self, centres: np.ndarray, scale: np.ndarray, least: float, block: int = 1024, candidates: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (centre, point, distance) that hold each centre's nearest points and all points within `least`.

        Points and centres are planar; differences are multiplied by `scale` (centre x axis). Nodes further than both
        `least` and the surest upper bound of a centre's nearest distance are left out at every level.
        """
        for at in range(0, len(centres), block):
            c, s = centres[at : at + block], scale[at : at + block]
            q, node = np.arange(len(c)), np.zeros(len(c), np.int64)
            bound = np.full(len(c), np.inf)
            for level in range(self.depth + 1):
                low, high = self.low[level][node], self.high[level][node]
                near = np.sqrt((np.maximum(np.maximum(low - c[q], c[q] - high), 0) ** 2 * s[q] ** 2).sum(axis=1))
                far = np.sqrt((np.maximum(np.abs(low - c[q]), np.abs(high - c[q])) ** 2 * s[q] ** 2).sum(axis=1))
                np.minimum.at(bound, q, far)
                keep = near <= np.maximum(bound[q], least) * (1 + 1e-12)
                q, node = q[keep], node[keep]
                if level < self.depth:
                    q, node = np.repeat(q, 2), np.column_stack([2 * node, 2 * node + 1]).ravel()
            size = self.edges[node + 1] - self.edges[node]
            upto = np.cumsum(size)
            for part in np.split(np.arange(len(q)), np.searchsorted(upto, np.arange(candidates, upto[-1] if len(upto) else 0, candidates))):
                many = size[part]
                a = np.repeat(q[part], many)
                p = self.order[np.repeat(self.edges[node[part]], many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)]
                yield at + a, p, np.sqrt(((c[a] - self.points[p]) ** 2 * s[a] ** 2).sum(axis=1))


def _assign(splits: Splits, radius: float, own_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.column_stack([b.column(a).to_numpy() for a in ("x", "y", "z")])
            r = 0.0 if own_only else radius
            box, leaf = splits.leaves(p - r, p + r)
            out = b.take(pa.array(box))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaf, pa.int64())], [*out.schema.names, "leaf"])

    return run


PAYLOAD = ["p0", "p1", "p2", "p3", "p4"]


def _pair_kernel(radius: float):
    def pairs(table: pa.Table, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.Table:
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        col = lambda c, at: table.column(c).take(at)
        metres = 2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(d) / 2, 1))
        return pa.table([col("id", a), *(col(p, a) for p in PAYLOAD[:2]), col("id", b), *(col(p, b) for p in PAYLOAD), pa.array(metres)], names=["q_id", "q0", "q1", "t_id", "t0", "t1", "t2", "t3", "t4", "metres"])

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        xyz = np.column_stack([table.column(a).to_numpy() for a in ("x", "y", "z")])
        side = table.column("side").to_numpy()
        for s, e in zip(starts[:-1], starts[1:]):
            m = s + np.searchsorted(side[s:e], 1)  # targets first
            if s < m < e:
                for q, p, d in LocalTree(xyz[s:m]).within(xyz[m:e], radius):
                    yield pairs(table, m + q, s + p, d)

    return run


def within_distance(queries: DataFrame, targets: DataFrame, metres: float, leaf_rows: int = LEAF_ROWS, sample_rows: int = SPLIT_SAMPLE) -> DataFrame:
    """All pairs of a query and a target point at most `metres` apart on the sphere.

    Both have id BIGINT, x, y, z (unit vector) and up to five DOUBLE columns p0..p4 that are carried along;
    result: q_id, q0, q1, t_id, t0..t4, metres. Space is cut by k-d splits fitted on both inputs; a query goes to
    the one leaf that holds it, a target also to every leaf within the radius. No rows come from empty inputs or
    NULL coordinates. Points should be distinct positions: a leaf can't be cut between equal ones.
    """
    def shape(df: DataFrame, side: int) -> DataFrame:
        extra = [F.col(p) if p in df.columns else F.lit(None).cast("double").alias(p) for p in PAYLOAD]
        return df.dropna(subset=["id", "x", "y", "z"]).select("id", "x", "y", "z", *extra, F.lit(side).alias("side"))

    q, t = shape(queries, 1), shape(targets, 0)
    splits = fit_splits(q.unionByName(t), ["x", "y", "z"], leaf_rows, sample_rows)
    schema = "id bigint, x double, y double, z double, p0 double, p1 double, p2 double, p3 double, p4 double, side int, leaf bigint"
    placed = q.mapInArrow(_assign(splits, chord(metres), True), schema).unionByName(t.mapInArrow(_assign(splits, chord(metres), False), schema))
    out = "q_id bigint, q0 double, q1 double, t_id bigint, t0 double, t1 double, t2 double, t3 double, t4 double, metres double"
    return map_lanes(placed, ["leaf"], ["side"], _pair_kernel(chord(metres)), out, batch_rows=leaf_rows)


def _near_kernel(radius: float):
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        xyz = np.column_stack([table.column(a).to_numpy() for a in ("x", "y", "z")])
        side = table.column("side").to_numpy()
        hit = np.zeros(len(side), bool)
        for s, e in zip(starts[:-1], starts[1:]):
            m = s + np.searchsorted(side[s:e], 1)  # targets first
            if s < m < e:
                for q, _, _ in LocalTree(xyz[s:m]).within(xyz[m:e], radius):
                    hit[m + q] = True
        return pa.table([table.column("id").filter(pa.array(hit))], names=["id"])

    return run


def near_any(queries: DataFrame, targets: DataFrame, metres: float, leaf_rows: int = LEAF_ROWS, sample_rows: int = SPLIT_SAMPLE) -> DataFrame:
    """Ids of the queries with any target at most `metres` away: id, a row per query row, no pairs are listed.

    Inputs and partitions are those of `within_distance`.
    """
    q, t = (df.dropna(subset=["id", "x", "y", "z"]).select("id", "x", "y", "z", F.lit(k).alias("side")) for df, k in ((queries, 1), (targets, 0)))
    splits = fit_splits(q.unionByName(t), ["x", "y", "z"], leaf_rows, sample_rows)
    schema = "id bigint, x double, y double, z double, side int, leaf bigint"
    placed = q.mapInArrow(_assign(splits, chord(metres), True), schema).unionByName(t.mapInArrow(_assign(splits, chord(metres), False), schema))
    return map_lanes(placed, ["leaf"], ["side"], _near_kernel(chord(metres)), "id bigint", batch_rows=leaf_rows)


def positions(df: DataFrame, ident: str, lat: str, lon: str) -> DataFrame:
    """ident, lat, lon of every distinct position; longitudes are brought to -180..180, odd rows dropped.

    Dropped are NULL ids, NULL, NaN or infinite coordinates, and latitudes beyond 90 degrees.
    """
    good = F.col(ident).isNotNull() & (F.abs(F.col(lat)) <= 90) & (F.abs(F.col(lon)) <= 3600)
    east = F.pmod(F.col(lon) + 180, F.lit(360.0)) - 180
    return df.filter(good).select(ident, F.col(lat).cast("double").alias("lat"), east.cast("double").alias("lon")).distinct()


def neighbours(places: DataFrame, ident: str, metres: float, **kd) -> DataFrame:
    """Pairs id_a < id_b of distinct `ident` in `positions` rows at most `metres` apart, each once.

    Ids that share a position are joined on it; positions themselves are matched once however many ids they hold.
    """
    spots = materialise(places.select("lat", "lon").distinct().withColumn("id", F.monotonically_increasing_id()))
    points = spots.select("id", *unit_vector("lat", "lon"))
    pairs = within_distance(points, points, metres, **kd).filter("q_id <= t_id").select("q_id", "t_id")
    held = places.join(spots, ["lat", "lon"]).select(F.col(ident).alias("who"), "id")
    a, b = held.select(F.col("who").alias("a"), F.col("id").alias("q_id")), held.select(F.col("who").alias("b"), F.col("id").alias("t_id"))
    found = pairs.join(a, "q_id").join(b, "t_id").filter("a <> b")
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def near_lines(places: DataFrame, ident: str, edges: DataFrame, metres: float, piece_m: float = 2000.0, **kd) -> DataFrame:
    """Pairs of places and lines (`wkb.edge_rows`) at most `metres` apart: who, line, metres, along, lat, lon.

    `along` is the position of the line's nearest point in metres from its start, lat and lon are that point's. Edges are
    cut into pieces of at most `piece_m`; a place is a candidate within metres + piece_m / 2 of a piece's middle, and
    its distance to the piece is taken in the local plane of the place. A place with several positions counts with the
    nearest.
    """
    spots = materialise(places.select("lat", "lon").distinct().withColumn("id", F.monotonically_increasing_id()))
    queries = spots.select("id", *unit_vector("lat", "lon"), F.col("lat").alias("p0"), F.col("lon").alias("p1"))
    rad = math.pi / 180 * EARTH_M
    length = F.hypot((F.col("x1") - F.col("x0")) * F.cos(F.radians(F.least(F.abs("y0"), F.abs("y1")))) * rad, (F.col("y1") - F.col("y0")) * rad)
    n = F.greatest(F.lit(1), F.ceil(length / piece_m)).cast("int")
    cut = edges.filter((F.abs("y0") <= 90) & (F.abs("y1") <= 90)).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("n")
    ends = [at("x0", "x1", F.col("k")), at("y0", "y1", F.col("k")), at("x0", "x1", F.col("k") + 1), at("y0", "y1", F.col("k") + 1)]
    cut = cut.select("id", *(e.alias(p) for e, p in zip(ends, PAYLOAD)), (F.col("run") + F.col("k") * length / F.col("n")).alias("p4"))
    cut = cut.withColumn("mlat", (F.col("p1") + F.col("p3")) / 2).withColumn("mlon", (F.col("p0") + F.col("p2")) / 2)
    targets = cut.select("id", *unit_vector("mlat", "mlon"), *PAYLOAD)
    near = within_distance(queries, targets, metres + piece_m / 2 * 1.01, **kd)
    turn = lambda c: F.pmod(F.col(c) - F.col("q1") + 180, F.lit(360.0)) - 180
    flat = F.cos(F.radians("q0")) * rad
    near = near.select("q_id", "q0", "q1", "t_id", "t4", (turn("t0") * flat).alias("ax"), ((F.col("t1") - F.col("q0")) * rad).alias("ay"), (turn("t2") * flat).alias("bx"), ((F.col("t3") - F.col("q0")) * rad).alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    part = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(F.col("ax") * dx + F.col("ay") * dy) / square))).otherwise(0.0)
    near = near.withColumns({"px": F.col("ax") + part * dx, "py": F.col("ay") + part * dy, "along": F.col("t4") + part * F.sqrt(square)})
    near = near.withColumn("metres", F.hypot("px", "py")).filter(F.col("metres") <= metres)
    east = F.pmod(F.col("q1") + F.col("px") / F.nullif(flat, F.lit(0.0)) + 180, F.lit(360.0)) - 180
    best = F.min(F.struct("metres", "along", (F.col("q0") + F.col("py") / rad).alias("lat"), east.alias("lon")))
    near = near.groupBy("q_id", "t_id").agg(best.alias("best"))
    held = places.join(spots, ["lat", "lon"]).select(F.col(ident).alias("who"), F.col("id").alias("q_id"))
    return near.join(held, "q_id").groupBy("who", F.col("t_id").alias("line")).agg(F.min("best").alias("best")).select("who", "line", "best.*")


def nearest_line(places: DataFrame, ident: str, edges: DataFrame, tiers: tuple[float, ...], **kd) -> DataFrame:
    """The nearest line of every place within the last of `tiers` (metres, rising): who, line, metres, along, lat, lon.

    Ties go to the smaller line id. A line found within a tier is the nearest there is, so only places without one go on
    to the next, wider tier; a wide tier then looks at few places.
    """
    parts = []
    for t in tiers:
        near = near_lines(places, ident, edges, t, **kd)
        best = F.min(F.struct("metres", "line", "along", "lat", "lon"))
        parts.append(materialise(near.groupBy("who").agg(best.alias("best")).select("who", "best.*")))
        places = materialise(places.join(parts[-1].select(F.col("who").alias(ident)), ident, "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("who", "line", "metres", "along", "lat", "lon")


def _own_leaf(splits: Splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.column_stack([b.column("lat").to_numpy(), b.column("lon").to_numpy()])
            box, leaf = splits.leaves(p, p)  # a point lies in one leaf: below a split, or at and above it
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf[np.argsort(box)], pa.int64())], [*b.schema.names, "leaf"])

    return run


def _reaching(splits: Splits, least: float):
    """Kernel: a row of each query for every leaf within `least`, or within what it has found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.column_stack([b.column("lat").to_numpy(), b.column("lon").to_numpy()])
            reach = np.maximum(b.column("best").to_numpy(), least) * (1 + 1e-9) / DEGREE_KM
            wide = np.column_stack([reach, reach / np.maximum(np.cos(np.radians(at[:, 0])), 1e-9)])
            q, leaf = splits.leaves(at - wide, at + wide)
            out = b.take(pa.array(q))
            yield pa.RecordBatch.from_arrays([out.column("id"), out.column("lat"), out.column("lon"), pa.array(leaf, pa.int64())], ["id", "lat", "lon", "leaf"])

    return run


def _closest_kernel(least: float):
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, side, valid = (table.column(c).to_numpy() for c in ("id", "side", "valid"))
        at = np.column_stack([table.column(c).to_numpy() for c in ("lat", "lon")])
        parts = []
        for s, e in zip(starts[:-1], starts[1:]):
            m = s + np.searchsorted(side[s:e], 1)  # targets first
            if s < m < e:
                scale = DEGREE_KM * np.column_stack([np.ones(e - m), np.cos(np.radians(at[m:e, 0]))])
                for q, p, km in LocalTree(at[s:m]).closest(at[m:e], scale, least):
                    for sure in (0, 1):  # the nearest, and the nearest valid one within reach
                        ok = np.flatnonzero((valid[s + p] >= sure) & ((km <= least) | (sure == 0)))
                        ok = ok[np.lexsort((ids[s + p[ok]], km[ok], q[ok]))]
                        ok = ok[np.append(True, q[ok][1:] != q[ok][:-1])[: len(ok)]]
                        parts.append((ids[m + q[ok]], ids[s + p[ok]], km[ok], np.full(len(ok), sure)))
        q, p, km, sure = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0) for k in range(4))
        return pa.table([pa.array(q, pa.int64()), pa.array(p, pa.int64()), pa.array(km, pa.float64()), pa.array(sure, pa.int32())], names=["q_id", "target", "km", "sure"])

    return run


# fixed value of the reference method: kilometres of a degree
DEGREE_KM = 111.0


def nearest_where(places: DataFrame, ident: str, targets: DataFrame, metres: float, leaf_rows: int = LEAF_ROWS, sample_rows: int = SPLIT_SAMPLE) -> DataFrame:
    """The nearest target of every place by three tiers: who, target, km, tier (1, 2, 3).

    `targets` has id, lat, lon, valid BOOLEAN. Tier 1 is the nearest valid one within `metres`, tier 2 the nearest at all
    within it, tier 3 the nearest however far. Distances are 111 km a degree, longitudes by the place's cosine; ties go to
    the smaller id. Targets are cut into k-d leaves over latitude and longitude, each in one. A place first looks in the
    leaf it lies in, and then in those whose targets may be nearer than what it found there, so a far place costs a few
    leaves and not pairs with all that lies as near.
    """
    target = materialise(targets.dropna(subset=["id", "lat", "lon"]).select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce("valid", F.lit(False)).cast("int").alias("valid")))
    splits = fit_splits(target, ["lat", "lon"], leaf_rows, sample_rows)
    held = materialise(target.mapInArrow(_own_leaf(splits), "id bigint, lat double, lon double, valid int, leaf bigint"))
    spots = materialise(places.select("lat", "lon").distinct().withColumn("id", F.monotonically_increasing_id()))
    rows = held.withColumn("side", F.lit(0))
    least = metres / 1000

    def search(queries: DataFrame) -> DataFrame:
        both = rows.unionByName(queries.select("id", "lat", "lon", F.lit(0).alias("valid"), "leaf", F.lit(1).alias("side")))
        return map_lanes(both, ["leaf"], ["side"], _closest_kernel(least), "q_id bigint, target bigint, km double, sure int", leaf_rows)

    own = search(spots.select("id", "lat", "lon", F.lit(0).alias("valid")).mapInArrow(_own_leaf(splits), "id bigint, lat double, lon double, valid int, leaf bigint"))
    own = own.filter("sure = 0").groupBy(F.col("q_id").alias("id")).agg(F.min("km").alias("best"))
    turned = spots.join(own, "id", "left").select("id", "lat", F.explode(F.array(*(F.col("lon") + F.lit(360.0 * k) for k in (-1, 0, 1)))).alias("lon"), F.coalesce("best", F.lit(1e9)).alias("best"))
    found = search(turned.mapInArrow(_reaching(splits, least), "id bigint, lat double, lon double, leaf bigint"))
    inside = F.col("km") * 1000 <= metres
    tier = F.when(inside & (F.col("sure") == 1), 1).when(inside, 2).otherwise(3)
    best = found.groupBy("q_id").agg(F.min(F.struct(tier.alias("tier"), "km", "target")).alias("best"))
    where = places.join(spots, ["lat", "lon"]).select(F.col(ident).alias("who"), F.col("id").alias("q_id"))
    return best.join(where, "q_id").select("who", "best.target", "best.km", "best.tier")


def _assign_boxes(splits: Splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x0, y0, x1, y1 = (b.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1"))
            box, leaf = splits.leaves(np.column_stack([np.minimum(x0, x1), np.minimum(y0, y1)]), np.column_stack([np.maximum(x0, x1), np.maximum(y0, y1)]))
            out = b.take(pa.array(box))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaf, pa.int64())], [*out.schema.names, "leaf"])

    return run


def _corners(splits: Splits, most: int = 2_000_000):
    """Kernel over edges: (leaf, region) with the number of the region's edges east of the leaf's south-east corner.

    Only corners between the region's west end and the edge count: further west no place of the leaf is inside. An edge
    meets the few corners whose latitude it spans.
    """
    low, high = splits.boxes()
    leaf = np.flatnonzero(np.isfinite(low[:, 1]) & np.isfinite(high[:, 0]))
    leaf = leaf[np.argsort(low[leaf, 1], kind="stable")]
    xs, ys = high[leaf, 0], low[leaf, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x0, y0, x1, y1, west, region = (b.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "west", "id"))
            lo, hi = np.searchsorted(ys, np.minimum(y0, y1)), np.searchsorted(ys, np.maximum(y0, y1))
            size = np.maximum(hi - lo, 0)
            upto = np.cumsum(size)
            for part in np.split(np.arange(len(size)), np.searchsorted(upto, np.arange(most, upto[-1] if len(upto) else 0, most))):
                e = np.repeat(part, size[part])
                c = np.repeat(lo[part], size[part]) + np.arange(len(e)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                hit = (xs[c] >= west[e]) & (xs[c] < x0[e] + (ys[c] - y0[e]) / (y1[e] - y0[e]) * (x1[e] - x0[e]))
                pair, n = np.unique(np.column_stack([leaf[c[hit]], region[e[hit]]]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64()), pa.array(n, pa.int64())], ["leaf", "id", "n"])

    return run


def _sweep(py: np.ndarray, px: np.ndarray, e: np.ndarray, region: np.ndarray, around: np.ndarray, south: float, east: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) pairs with the point inside, by a sweep northward over the points and edges of one leaf.

    `around` are the regions that hold the leaf's south-east corner, (`east`, `south`). From there a path leads north
    along the leaf's east side and then west to the point; the point is inside a region if the corner is, or not, as the
    path crosses an even or odd number of the region's edges. All of these touch the leaf. A block of points rising in y
    meets only the edges that the sweep line cuts there. An edge holds its lower and its west end, not the other.
    """
    order = np.argsort(py, kind="stable")
    py, px = py[order], px[order]
    bottom, top = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    by_bottom = np.argsort(bottom, kind="stable")
    entered, active = 0, np.zeros(0, np.int64)
    names, region_no = np.unique(np.concatenate([region, around]), return_inverse=True)
    start = np.zeros(len(names), np.int64)
    start[region_no[len(region) :]] = 1
    region_no = region_no[: len(region)]
    # where edges cross the leaf's east side, by region and then by y
    side = np.flatnonzero((e[:, 0] <= east) != (e[:, 2] <= east))
    at_y = e[side, 1] + (east - e[side, 0]) / (e[side, 2] - e[side, 0]) * (e[side, 3] - e[side, 1])
    side, at_y = side[at_y > south], at_y[at_y > south]
    points, regions = [], []
    for at in range(0, len(py), block):
        y, x = py[at : at + block], px[at : at + block]
        upto = np.searchsorted(bottom[by_bottom], y[-1], side="right")
        active = np.concatenate([active, by_bottom[entered:upto]])
        entered = max(entered, upto)
        active = active[top[active] > y[0]]
        lo, hi = np.searchsorted(y, bottom[active]), np.searchsorted(y, top[active])
        size = np.maximum(hi - lo, 0)
        edge = np.repeat(active, size)
        p = np.repeat(lo, size) + np.arange(len(edge)) - np.repeat(np.cumsum(size) - size, size)
        x0, y0, x1, y1 = (e[edge, k] for k in range(4))
        cross = x0 + (y[p] - y0) / (y1 - y0) * (x1 - x0)
        met = (cross > x[p]) & (cross <= east)
        # on the way north: a step at the first point at or above each crossing, summed up over the points
        odd = np.zeros((len(names), len(y) + 1), np.int64)
        odd[:, 0] = start
        np.add.at(odd, (region_no[side], np.searchsorted(y, at_y)), 1)
        odd = np.cumsum(odd, axis=1)[:, :-1]
        np.add.at(odd, (region_no[edge[met]], p[met]), 1)
        r, k = np.nonzero(odd % 2)
        points.append(order[at + k])
        regions.append(names[r])
    return np.concatenate(points) if points else np.zeros(0, np.int64), np.concatenate(regions) if regions else np.zeros(0, np.int64)


def _sweep_kernel(splits: Splits):
    low, high = splits.boxes()

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, e = table.column("id").to_numpy(), np.column_stack([table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")])
        side, leaf = table.column("side").to_numpy(), table.column("leaf").to_numpy()
        who, where = [], []
        for s, t in zip(starts[:-1], starts[1:]):
            m, n = s + np.searchsorted(side[s:t], 0), s + np.searchsorted(side[s:t], 1)  # corners, edges, points
            if s < n < t:
                p, r = _sweep(e[n:t, 1], e[n:t, 0], e[m:n], ids[m:n], ids[s:m], low[leaf[s], 1], high[leaf[s], 0])
                who.append(ids[n:t][p])
                where.append(r)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([join(who), join(where)], ["q_id", "region"])

    return run


def inside_regions(places: DataFrame, ident: str, edges: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SPLIT_SAMPLE) -> DataFrame:
    """Pairs (who, region) of places inside polygons given as `wkb.edge_rows`; inner rings are outside.

    Longitude and latitude are cut by k-d splits; every leaf gets its points, the edges that touch it, and the regions that
    hold its south-east corner, which are counted over all edges beforehand, and sweeps over both. So an edge goes to the
    leaves it touches, however many leaves its region covers. A point on an edge may fall to either side.
    """
    spots = materialise(places.select("lat", "lon").distinct().withColumn("id", F.monotonically_increasing_id()))
    edges = materialise(edges)
    reach = edges.agg(F.min(F.least("x0", "x1")).alias("w"), F.max(F.greatest("x0", "x1")).alias("e")).first()
    turned = spots.select("id", F.explode(F.array(*(F.col("lon") + F.lit(360.0 * k) for k in (-1, 0, 1)))).alias("x0"), F.col("lat").alias("y0"))
    turned = turned.filter(F.col("x0").between(*((reach[0], reach[1]) if reach[0] is not None else (1.0, 0.0))))
    points = turned.select("id", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.lit(1).alias("side"))
    rows = edges.select("id", "x0", "y0", "x1", "y1", F.lit(0).alias("side"))
    splits = fit_splits(points.select("x0", "y0").unionByName(rows.select("x0", "y0")), ["x0", "y0"], leaf_rows, sample_rows)
    splits.value += 1.2345e-11  # no vertex lies on a split, which then has no sides to choose from
    schema = "id bigint, x0 double, y0 double, x1 double, y1 double, side int, leaf bigint"
    placed = points.unionByName(rows).mapInArrow(_assign_boxes(splits), schema)
    corners = edges.filter("y0 <> y1").mapInArrow(_corners(splits), "leaf bigint, id bigint, n bigint").groupBy("leaf", "id").agg(F.sum("n").alias("n")).filter("n % 2 = 1")
    zero = F.lit(0.0)
    corners = corners.select("id", *(zero.alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(-1).alias("side"), "leaf")
    found = map_lanes(placed.unionByName(corners), ["leaf"], ["side"], _sweep_kernel(splits), "q_id bigint, region bigint", batch_rows=leaf_rows)
    held = places.join(spots, ["lat", "lon"]).select(F.col(ident).alias("who"), F.col("id").alias("q_id"))
    return found.join(held, "q_id").select("who", "region").distinct()
