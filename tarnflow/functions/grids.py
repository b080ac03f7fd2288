"""Cells of a regular geographic grid as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the global 30 arc-second grid, and the WGS84 axes in metres
COLUMNS, CELL_DEGREES = 43_200, 1 / 120
MAJOR_AXIS, MINOR_AXIS = 6_378_137.0, 6_356_752.3142
# fixed values: D8 codes and their steps (rows down, columns right); 0 is the cell itself
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1), 0: (0, 0)}


def _step(code: Column, part: int) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, step in D8.items():
        out = out.when(code == k, F.lit(step[part]))
    return out


def d8_target(row: Column, col: Column, code: Column, rows: int, columns: int) -> Column:
    """Id (row * columns + column) of the cell that a D8 code points to; NULL off the grid or for another code."""
    r, c = row + _step(code, 0), col + _step(code, 1)
    return F.when((r >= 0) & (r < rows) & (c >= 0) & (c < columns), r.cast("bigint") * columns + c)


def d8_code(rows_down: Column, columns_right: Column) -> Column:
    """The D8 code of a step, 255 for a step to no neighbour and for NULL."""
    out = F.when(F.lit(False), F.lit(0))
    for k, (r, c) in D8.items():
        out = out.when((rows_down == r) & (columns_right == c), F.lit(k))
    return out.otherwise(F.lit(255))


def row_of(lat: Column, cell: float = CELL_DEGREES) -> Column:
    """Row whose centre is nearest, counted from 90 north; ties to even."""
    return F.rint((90 - lat) / cell - 0.5).cast("int")


def column_of(lon: Column, cell: float = CELL_DEGREES) -> Column:
    """Column whose centre is nearest, counted from 180 west; ties to even."""
    return F.rint((lon + 180) / cell - 0.5).cast("int")


def cell_area_km2(lat: Column, cell: float = CELL_DEGREES) -> Column:
    """Area of a grid cell on the ellipsoid, by its closed form between two parallels."""
    e = math.sqrt(1 - (MINOR_AXIS / MAJOR_AXIS) ** 2)

    def zone(degrees: Column) -> Column:
        s = F.sin(F.radians(degrees))
        return F.atanh(e * s) / (2 * e) + s / (2 * (1 - e * e * s * s))

    band = math.pi * MINOR_AXIS**2 * 2
    return F.abs(zone(lat + cell / 2) - zone(lat - cell / 2)) * band * (cell / 360) / 1e6
