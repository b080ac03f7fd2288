"""Well-known-binary geometries as rows of edges."""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

# fixed values of the WKB format: geometry types
LINE, POLYGON, MULTI_LINE, MULTI_POLYGON = 2, 3, 5, 6
#: Metres of a degree on a sphere of 6,371,008.8 m.
METRES = np.pi / 180 * 6_371_008.8


def rings(data: bytes) -> list[np.ndarray]:
    """The vertex arrays (n, 2) of a line or polygon (or a multi-part one): each line, each ring.

    Z and M values are passed over. Anything else, or a cut-off geometry, gives what was read before it.
    """
    out: list[np.ndarray] = []

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if code & 0x20000000:  # an SRID follows
            at += 4
        width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        width += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
        code %= 1000
        if code not in (LINE, POLYGON, MULTI_LINE, MULTI_POLYGON):
            raise ValueError(code)
        count = 1
        if code != LINE:
            count = struct.unpack_from(order + "I", data, at)[0]
            at += 4
        for _ in range(count):
            if code in (MULTI_LINE, MULTI_POLYGON):
                at = read(at)
                continue
            n = struct.unpack_from(order + "I", data, at)[0]
            out.append(np.frombuffer(data, order + "f8", n * width, at + 4).reshape(n, width)[:, :2].astype(float))
            at += 4 + n * width * 8
        return at

    try:
        read(0)
    except (struct.error, ValueError, IndexError):
        pass
    return out


def _plain_lines(geom: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are little-endian LineStrings of two coordinates, and all their vertices: rows, owner (row) and xy per vertex."""
    offset = np.frombuffer(geom.buffers()[1], np.int64 if pa.types.is_large_binary(geom.type) else np.int32)[geom.offset : geom.offset + len(geom) + 1].astype(np.int64)
    data = np.frombuffer(geom.buffers()[2] or b"", np.uint8)
    size = np.diff(offset)
    rows = np.flatnonzero((size >= 9) & geom.is_valid().to_numpy(zero_copy_only=False))
    head = data[offset[rows][:, None] + np.arange(9)]
    code, count = head[:, 1:5].copy().view("<u4").ravel(), head[:, 5:9].copy().view("<u4").ravel().astype(np.int64)
    good = (head[:, 0] == 1) & (code == LINE) & (size[rows] >= 9 + 16 * count)
    rows, count = rows[good], count[good]
    owner = np.repeat(rows, count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = offset[owner] + 9 + 16 * within
    return rows, owner, data[at[:, None] + np.arange(16)].view("<f8").reshape(-1, 2)


def _edges(ident: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.compute.is_valid(b.column(ident))
            b = b.filter(keep)
            geom = b.column("geom")
            if not len(b):
                continue
            rows, owner, xy = _plain_lines(geom)
            parts = [(owner, owner * 0, xy)]
            plain = np.zeros(len(b), bool)
            plain[rows] = True
            for i in np.flatnonzero(~plain & geom.is_valid().to_numpy(zero_copy_only=False)).tolist():
                for k, ring in enumerate(rings(geom[i].as_py())):
                    parts.append((np.full(len(ring), i), np.full(len(ring), k), ring))
            owner, ring, xy = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(owner, kind="stable")
            order = order[np.isfinite(xy[order]).all(axis=1)]
            owner, ring, x, y = owner[order], ring[order], xy[order, 0], xy[order, 1]
            joint = (owner[1:] == owner[:-1]) & (ring[1:] == ring[:-1])
            jump = np.where(joint, np.diff(x), 0.0)
            turn = np.append(0, np.cumsum((jump < -180).astype(int) - (jump > 180).astype(int)))
            first = np.append(True, ~joint)[: len(x)]
            x = x + 360 * (turn[: len(x)] - turn[: len(x)][np.flatnonzero(first)][np.cumsum(first) - 1]) if len(x) else x
            step = np.where(joint, METRES * np.hypot(np.diff(x) * np.cos(np.radians((y[1:] + y[:-1]) / 2)), np.diff(y)), 0.0)
            length = np.append(0.0, np.cumsum(step))[: len(x)]
            e = np.flatnonzero(joint)
            if not len(e):
                continue
            start = np.flatnonzero(first)[(np.cumsum(first) - 1)[e]]
            lowest = np.minimum(x[e], x[e + 1])
            of, at = np.unique(owner[e], return_index=True)
            west = np.minimum.reduceat(lowest, at)[np.searchsorted(of, owner[e])]
            yield pa.RecordBatch.from_arrays([b.column(ident).cast(pa.int64()).take(pa.array(owner[e])), *map(pa.array, (x[e], y[e], x[e + 1], y[e + 1], west, length[e] - length[start]))], ["id", "x0", "y0", "x1", "y1", "west", "run"])

    return run


def edge_rows(df: DataFrame, ident: str) -> DataFrame:
    """One row per edge of the WKB column `geom`: id, x0, y0, x1, y1 (degrees), west (least x of the geometry), run (metres along
    the line or ring before the edge).

    Longitudes run on across the date line, so x may leave -180..180. NULL, empty or broken geometries, and
    NULL ids, give no rows; whole-row copies are taken once.
    """
    return df.select(ident, "geom").distinct().mapInArrow(_edges(ident), "id bigint, x0 double, y0 double, x1 double, y1 double, west double, run double")
