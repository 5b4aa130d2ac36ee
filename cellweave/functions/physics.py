"""Geometry, unit conversions and derived ocean variables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.missing import ColumnLike, as_column

# Fixed values.
SEAWATER_DENSITY = 1.02518  # kg per litre
CELL_DEGREES = 0.125  # width of a regridded cell
BAR_PER_METRE = 0.1
WGS84_RADIUS = 6378137.0
WGS84_E2 = 0.00669437999014


def thickness_full(depth: ColumnLike) -> Column:
    """Layer thickness in metres for the full profile."""
    d = as_column(depth)
    return (
        F.when(d == 0, 2.5)
        .when(d < 80, 5.0)
        .when(d == 80, 7.5)
        .when(d == 90, 10.0)
        .when(d == 100, 15.0)
        .when(d < 300, 20.0)
        .when(d.isNotNull(), 10.0)
    )


def thickness_top100(depth: ColumnLike) -> Column:
    """Layer thickness in metres when the column ends at 100 m."""
    d = as_column(depth)
    return (
        F.when(d == 0, 2.5)
        .when(d < 80, 5.0)
        .when(d == 80, 7.5)
        .when(d < 100, 10.0)
        .when(d.isNotNull(), 5.0)
    )


def cell_area(lat: ColumnLike, degrees: float = CELL_DEGREES) -> Column:
    """Area in square metres of a ``degrees`` x ``degrees`` cell on the WGS-84 ellipsoid."""
    phi = F.radians(as_column(lat))
    w = F.lit(1.0) - F.lit(WGS84_E2) * F.sin(phi) * F.sin(phi)
    scale = WGS84_RADIUS**2 * (1.0 - WGS84_E2) * (math.pi / 180.0 * degrees) ** 2
    return F.lit(scale) * F.cos(phi) / (w * w)


def moles(concentration: ColumnLike, extent: ColumnLike) -> Column:
    """mmol per m3 (or m2) times volume (or area), in moles."""
    return as_column(concentration) * as_column(extent) / F.lit(1000.0)


def monthly_uptake(flux: ColumnLike, area: ColumnLike, seconds: ColumnLike) -> Column:
    """Flux in mmol per m2 and second over a cell and a month, in moles."""
    return as_column(flux) * as_column(area) * as_column(seconds) / F.lit(1000.0)


def to_mol_per_kg(concentration: ColumnLike) -> Column:
    return as_column(concentration) * F.lit(1e-6) / F.lit(SEAWATER_DENSITY)


def to_mmol_per_m3(concentration: ColumnLike) -> Column:
    return as_column(concentration) * F.lit(SEAWATER_DENSITY) * F.lit(1e6)


def pressure_bar(depth: ColumnLike) -> Column:
    """Hydrostatic pressure from a depth of either sign."""
    return F.abs(as_column(depth)) * F.lit(BAR_PER_METRE)


def block_number(index: ColumnLike, size: int) -> Column:
    """1-based number of the fixed block of ``size`` periods holding a 1-based index."""
    return (F.floor((as_column(index) - 1) / F.lit(size)) + 1).cast("int")


def wrap_longitude(lon: ColumnLike) -> Column:
    """Longitude in [-180, 180]."""
    column = as_column(lon)
    return F.when(column > 180, column - 360).otherwise(column)


def depth_class(depth: ColumnLike) -> Column:
    return F.when(as_column(depth) < 100, "Surface").when(
        as_column(depth).isNotNull(), "Subsurface"
    )


def depth_class_rank(depth: ColumnLike) -> Column:
    """Sort position of the class: Surface before Subsurface."""
    return F.when(as_column(depth) < 100, 1).when(as_column(depth).isNotNull(), 2)
