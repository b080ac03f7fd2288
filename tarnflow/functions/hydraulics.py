"""Hydraulic geometry of a river cell as column expressions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.bounds import at_least


@dataclass(frozen=True)
class Channel:
    """Fixed values of the model: width a Q^b, depth c Q^f, Manning's n, cell length dx in metres."""

    a: float = 2.71
    b: float = 0.557
    c: float = 0.349
    f: float = 0.341
    mannings: float = 0.044
    dx: float = 1000.0


# fixed values: seconds of a time unit (a month is 365/12 days)
SECONDS = {"month": 2_628_000, "week": 604_800, "day": 86_400, "hour": 3_600, "minute": 60}
# fixed values: density of water kg/m3, its viscosity Pa s
DENSITY, VISCOSITY = 997.1, 0.894e-3


def seconds_of(unit: str) -> int:
    """Seconds of a time unit; ValueError for an unknown one."""
    if unit not in SECONDS:
        raise ValueError(f"unknown time unit {unit!r}; use one of {', '.join(SECONDS)}")
    return SECONDS[unit]


def width(q: Column, k: Channel = Channel()) -> Column:
    """Channel width in metres at discharge q (m3/s)."""
    return F.lit(k.a) * F.pow(q, F.lit(k.b))


def depth(q: Column, k: Channel = Channel()) -> Column:
    """Channel depth in metres."""
    return F.lit(k.c) * F.pow(q, F.lit(k.f))


def hydraulic_radius(q: Column, k: Channel = Channel()) -> Column:
    """H W / (2 H + W), 0 where the wetted perimeter is 0."""
    w, h = width(q, k), depth(q, k)
    return F.when(2 * h + w > 0, h * w / (2 * h + w)).otherwise(F.lit(0.0))


def velocity(q: Column, slope: Column, k: Channel = Channel()) -> Column:
    """Manning's velocity in m/s."""
    return F.pow(hydraulic_radius(q, k), F.lit(2.0 / 3.0)) * F.sqrt(at_least(slope, 0.0)) / k.mannings


def chemistry_velocity(q: Column, slope: Column, k: Channel = Channel()) -> Column:
    """Velocity as the chemistry takes it: 1 m/s where Manning's is not above 0."""
    v = velocity(q, slope, k)
    return F.when(v > 0, v).otherwise(F.lit(1.0))


def area(q: Column, v: Column) -> Column:
    """Cross-section in m2, at least 1e-6, and 1e-6 where there is no velocity (the output's rule)."""
    return F.when(v > 0, at_least(q / F.nullif(v, F.lit(0.0)), 1e-6)).otherwise(F.lit(1e-6))


def volume(cross_section: Column, k: Channel = Channel()) -> Column:
    """Water in a cell in litres."""
    return cross_section * k.dx * 1000


def dispersion(q: Column, slope: Column, k: Channel = Channel()) -> Column:
    """Longitudinal dispersion in m2/s from friction velocity."""
    w, h, v = width(q, k), depth(q, k), velocity(q, slope, k)
    reynolds = DENSITY * v * 4 * hydraulic_radius(q, k) / VISCOSITY
    shear = (64 / (reynolds + 1e-30)) / 8 * DENSITY * v * v
    friction = F.sqrt(at_least(shear / DENSITY, 1e-30))
    return 5.4 * F.pow(w / (h + 1e-30), F.lit(0.7)) * F.pow(v / (friction + 1e-30), F.lit(0.13)) * h * v


def courant_substeps(v: Column, dt: float, most: int = 100, k: Channel = Channel()) -> Column:
    """Substeps that keep the Courant number at 1 or less, from 1 to `most`."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(v * dt / k.dx))).cast("int")
