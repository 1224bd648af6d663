"""Transverse Mercator on the WGS84 ellipsoid, Krueger series of order six (Karney 2011).

Accurate to nanometres within a zone. Plain column arithmetic, so it runs inside codegen and can
be applied to columns or, through ``transform``, to ring vertices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charscape.functions.staging import stage

# WGS84 and the UTM grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
DEFAULT_ZONE = 11

_N = FLATTENING / (2 - FLATTENING)
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))


def _poly(*terms: tuple[int, float]) -> float:
    return sum(c * _N**p for p, c in terms)


# Series coefficients in the third flattening.
RECTIFYING_RADIUS = (
    SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
)
ALPHA = (
    _poly((1, 1 / 2), (2, -2 / 3), (3, 5 / 16), (4, 41 / 180), (5, -127 / 288), (6, 7891 / 37800)),
    _poly((2, 13 / 48), (3, -3 / 5), (4, 557 / 1440), (5, 281 / 630), (6, -1983433 / 1935360)),
    _poly((3, 61 / 240), (4, -103 / 140), (5, 15061 / 26880), (6, 167603 / 181440)),
    _poly((4, 49561 / 161280), (5, -179 / 168), (6, 6601661 / 7257600)),
    _poly((5, 34729 / 80640), (6, -3418889 / 1995840)),
    _poly((6, 212378941 / 319334400)),
)
BETA = (
    _poly((1, 1 / 2), (2, -2 / 3), (3, 37 / 96), (4, -1 / 360), (5, -81 / 512), (6, 96199 / 604800)),
    _poly((2, 1 / 48), (3, 1 / 15), (4, -437 / 1440), (5, 46 / 105), (6, -1118711 / 3870720)),
    _poly((3, 17 / 480), (4, -37 / 840), (5, -209 / 4480), (6, 5569 / 90720)),
    _poly((4, 4397 / 161280), (5, -11 / 504), (6, -830251 / 7257600)),
    _poly((5, 4583 / 161280), (6, -108847 / 3991680)),
    _poly((6, 20648693 / 638668800)),
)
# Conformal to geodetic latitude, in sines of even multiples.
DELTA = (
    _poly((1, 2), (2, -2 / 3), (3, -2), (4, 116 / 45), (5, 26 / 45), (6, -2854 / 675)),
    _poly((2, 7 / 3), (3, -8 / 5), (4, -227 / 45), (5, 2704 / 315), (6, 2323 / 945)),
    _poly((3, 56 / 15), (4, -136 / 35), (5, -1262 / 105), (6, 73814 / 2835)),
    _poly((4, 4279 / 630), (5, -332 / 35), (6, -399572 / 14175)),
    _poly((5, 4174 / 315), (6, -144838 / 6237)),
    _poly((6, 601676 / 22275)),
)


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def utm_forward(lon: Column, lat: Column, zone: int = DEFAULT_ZONE) -> tuple[Column, Column]:
    """Easting and northing in metres of longitude and latitude in degrees (north hemisphere)."""
    lam = F.radians(lon - F.lit(central_meridian(zone)))
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * sin_lat))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    north = _sum(
        [xi]
        + [
            F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
            for j, a in enumerate(ALPHA, 1)
        ]
    )
    east = _sum(
        [eta]
        + [
            F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
            for j, a in enumerate(ALPHA, 1)
        ]
    )
    k = F.lit(SCALE * RECTIFYING_RADIUS)
    return F.lit(FALSE_EASTING) + k * east, k * north


def with_utm_inverse(
    df: DataFrame, x: Column, y: Column, lon: str, lat: str, zone: int = DEFAULT_ZONE
) -> DataFrame:
    """Adds longitude and latitude in degrees of easting and northing in metres.

    Each stage of the series feeds many terms of the next, so the stages are columns.
    """
    k = F.lit(SCALE * RECTIFYING_RADIUS)
    xi, eta = F.col("_xi"), F.col("_eta")
    xi0 = xi - _sum(
        [
            F.lit(b) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
            for j, b in enumerate(BETA, 1)
        ]
    )
    eta0 = eta - _sum(
        [
            F.lit(b) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
            for j, b in enumerate(BETA, 1)
        ]
    )
    chi = F.col("_chi")
    geodetic = chi + _sum([F.lit(d) * F.sin(chi * (2.0 * j)) for j, d in enumerate(DELTA, 1)])
    out = stage(df, {"_xi": y / k, "_eta": (x - F.lit(FALSE_EASTING)) / k})
    out = stage(out, {"_xi0": xi0, "_eta0": eta0})
    out = stage(
        out,
        {
            "_chi": F.asin(F.sin("_xi0") / F.cosh("_eta0")),
            lon: F.degrees(F.atan2(F.sinh("_eta0"), F.cos("_xi0")))
            + F.lit(central_meridian(zone)),
        },
    )
    return stage(out, {lat: F.degrees(geodetic)}).drop("_xi", "_eta", "_xi0", "_eta0", "_chi")


def project_ring(ring: Column, zone: int = DEFAULT_ZONE) -> Column:
    def vertex(p: Column) -> Column:
        x, y = utm_forward(p["x"], p["y"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, vertex)
