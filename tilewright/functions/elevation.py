"""Elevation encodings, quantisation and classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clamped

#: Contour bands, the first that divides the elevation wins, else 10.
CONTOUR_BANDS = (1000, 500, 250, 200, 100, 50, 20)


def decode_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def decode_mapbox(r: Column, g: Column, b: Column) -> Column:
    return -10000.0 + (r * 65536.0 + g * 256.0 + b) * 0.1


def snap(elevation: Column, step: Column) -> Column:
    """Nearest multiple of the step; halves go away from zero."""
    return F.round(elevation / step) * step


def encode_terrarium(elevation: Column, step: Column) -> tuple[Column, Column, Column]:
    """(r, g, b); the blue part is clamped, it does not carry."""
    v = clamped(snap(elevation, step) + 32768.0, 0.0, 65535.999)
    whole = F.floor(v)
    return F.floor(whole / 256).cast("int"), (whole % 256).cast("int"), clamped(F.round((v - whole) * 256.0), None, 255.0).cast("int")


def encode_mapbox(elevation: Column, step: Column) -> tuple[Column, Column, Column]:
    v = clamped(F.round((snap(elevation, step) + 10000.0) * 10.0), 0.0, float((1 << 24) - 1)).cast("long")
    return F.floor(v / 65536).cast("int"), (F.floor(v / 256) % 256).cast("int"), (v % 256).cast("int")


def quantisation_digits(zoom: Column, max_zoom: Column, digits: Column, most: Column) -> Column:
    """One digit more for each zoom below the highest, up to ``most`` (or ``digits``, if that is more)."""
    return F.least(digits + max_zoom - zoom, F.greatest(most, digits))


def quantisation_step(digits: Column, encoding: str) -> Column:
    return F.pow(F.lit(2.0), digits) * (0.1 if encoding == "mapbox" else 1 / 256)


def contour_band(elevation: Column) -> Column:
    out = F.lit(10)
    for band in reversed(CONTOUR_BANDS):
        out = F.when(elevation % band == 0, band).otherwise(out)
    return out


def step_for_resolution(metres: Column, ratio: Column) -> Column:
    """The power of two nearest to metres / ratio (halves to even, in the exponent)."""
    return F.pow(F.lit(2.0), F.rint(F.log2(metres / ratio)))


def refine_factor(source: Column, target: Column) -> Column:
    return clamped(F.ceil(source / target), F.lit(1).cast("long"), None)


def clamp_min(elevation: Column, least: Column) -> Column:
    """At least ``least`` where that is given; no elevation stays none."""
    return F.when(elevation.isNotNull(), F.when(least.isNull(), elevation).otherwise(F.greatest(elevation, least)))


def bilinear(v00: Column, v10: Column, v01: Column, v11: Column, fx: Column, fy: Column) -> Column:
    """Weighted mean of four neighbours; null without the first, voids among the others borrow from it."""
    b10, b01 = F.coalesce(v10, v00), F.coalesce(v01, v00)
    b11 = F.coalesce(v11, b10)
    top, low = v00 * (1 - fx) + b10 * fx, b01 * (1 - fx) + b11 * fx
    return top * (1 - fy) + low * fy


def cross_fade(a: Column, b: Column, weight: Column, least: float = -10.0) -> Column:
    return clamped(a * (1 - weight) + b * weight, least, None)


def contour_shown(elevation: Column, zoom: Column) -> Column:
    """Whether a contour belongs to a zoom: from 8 every 200 metres but no band of 500, from 10 every 100, from 12 every 20."""
    least = F.when(zoom >= 12, 20).when(zoom >= 10, 100).otherwise(200)
    return (elevation % least == 0) & ~((zoom < 10) & (elevation % 500 == 0) & (elevation % 1000 != 0))
