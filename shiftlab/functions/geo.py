"""Coordinates on the Earth and the sphere, and HEALPix indices (RING order), as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid's semi-axes in km.
SEMI_MAJOR, SEMI_MINOR = 6378.137, 6356.752


def geodetic_to_cartesian(lat: Column, lon: Column, height: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """WGS84 (x, y, z) in km of degrees and a height in km."""
    ratio = SEMI_MINOR**2 / SEMI_MAJOR**2
    phi, lam = F.radians(lat), F.radians(lon)
    normal = F.lit(SEMI_MAJOR) / F.sqrt(1 - F.lit(1 - ratio) * F.sin(phi) * F.sin(phi))
    h = height if isinstance(height, Column) else F.lit(float(height))
    return (normal + h) * F.cos(phi) * F.cos(lam), (normal + h) * F.cos(phi) * F.sin(lam), (F.lit(ratio) * normal + h) * F.sin(phi)


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def auto_nside(n: int) -> int:
    """The power of two whose pixels are at least about as many as `n` points; at least 4 points are needed."""
    power = math.ceil(0.5 * math.log2(n / 12)) if n > 0 else -1
    if power < 0:
        raise ValueError("a HEALPix grid needs at least 4 points to choose its resolution from")
    return 1 << power


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` of a struct of values, each computed once however often the body names it."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), 1)


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def ang2pix(nside: int, lat: Column, lon: Column) -> Column:
    """The pixel of a point in degrees."""
    n = nside
    place = {"z": F.sin(F.radians(lat)), "tt": F.pmod(F.radians(lon), F.lit(2 * math.pi)) / (math.pi / 2)}

    def belt(s: Column) -> Column:
        def pixel(j: Column) -> Column:
            ring = n + 1 + j["up"] - j["down"]
            odd = 1 - F.pmod(ring, F.lit(2))
            return 2 * n * (n - 1) + (ring - 1) * (4 * n) + F.pmod(_whole((j["up"] + j["down"] - n + odd + 1) / 2), F.lit(4 * n))

        return _let({"up": _whole(n * (0.5 + s["tt"]) - 0.75 * n * s["z"]), "down": _whole(n * (0.5 + s["tt"]) + 0.75 * n * s["z"])}, pixel)

    def cap(s: Column) -> Column:
        part, edge = s["tt"] - F.floor(s["tt"]), n * F.sqrt(3 * (1 - F.abs(s["z"])))

        def pixel(c: Column) -> Column:
            i, along = c["ring"], F.pmod(_whole(s["tt"] * c["ring"]), 4 * c["ring"])
            return F.when(s["z"] > 0, 2 * i * (i - 1) + along).otherwise(12 * n * n - 2 * i * (i + 1) + along)

        return _let({"ring": _whole(part * edge) + _whole((1 - part) * edge) + 1}, pixel)

    return _let(place, lambda s: F.when(F.abs(s["z"]) <= 2 / 3, belt(s)).otherwise(cap(s)).cast("long"))


def pix2ang(nside: int, pixel: Column) -> tuple[Column, Column]:
    """(lat, lon) of a pixel's centre in degrees, lon from 0 to 360."""
    n = nside
    ncap, total = 2 * n * (n - 1), 12 * n * n
    root = lambda c: _whole(F.sqrt(c.cast("double")))

    def north(p: Column) -> Column:
        return _let({"i": _whole((1 + root(1 + 2 * p)) / 2)}, lambda s: F.struct((1 - s["i"] * s["i"] / (3.0 * n * n)).alias("z"), ((p + 1 - 2 * s["i"] * (s["i"] - 1) - 0.5) * math.pi / (2 * s["i"])).alias("phi")))

    def belt(p: Column) -> Column:
        q = p - ncap

        def place(s: Column) -> Column:
            offset = F.when(F.pmod(s["i"] + n, F.lit(2)) == 1, 1.0).otherwise(0.5)
            return F.struct(((2 * n - s["i"]) * 2 / (3.0 * n)).alias("z"), ((F.pmod(q, F.lit(4 * n)) + 1 - offset) * math.pi / (2 * n)).alias("phi"))

        return _let({"i": _whole(q / (4 * n)) + n}, place)

    def south(p: Column) -> Column:
        q = total - p
        return _let({"i": _whole((1 + root(2 * q - 1)) / 2)}, lambda s: F.struct((-1 + s["i"] * s["i"] / (3.0 * n * n)).alias("z"), ((4 * s["i"] + 1 - (q - 2 * s["i"] * (s["i"] - 1)) - 0.5) * math.pi / (2 * s["i"])).alias("phi")))

    at = _let({"p": pixel}, lambda s: F.when(s["p"] < ncap, north(s["p"])).when(s["p"] < total - ncap, belt(s["p"])).otherwise(south(s["p"])))
    return F.degrees(F.asin(at["z"])), F.degrees(at["phi"])
