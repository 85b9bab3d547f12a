"""WGS84 longitude/latitude to UTM zone 9 (NAD83, metres) as plain Column arithmetic.

Krueger's transverse Mercator series to the fourth order of the third flattening; its error
is far below a millimetre within the zone. WGS84 and NAD83 are taken as the same datum.
"""

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: GRS80 ellipsoid and UTM zone 9
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
CENTRAL_MERIDIAN = -129.0
SCALE = 0.9996
FALSE_EASTING = 500000.0

_n = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = sqrt(FLATTENING * (2 - FLATTENING))
RECTIFYING_RADIUS = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
SERIES = (
    _n / 2 - 2 / 3 * _n**2 + 5 / 16 * _n**3 + 41 / 180 * _n**4,
    13 / 48 * _n**2 - 3 / 5 * _n**3 + 557 / 1440 * _n**4,
    61 / 240 * _n**3 - 103 / 140 * _n**4,
    49561 / 161280 * _n**4,
)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def utm_steps(long, lat) -> list[dict[str, Column]]:
    """Easting ``x`` and northing ``y`` of a position in steps, each from the columns of those
    before. NULL for a latitude beyond 90 degrees, a longitude beyond 360, or a value that is
    not finite."""
    valid = (F.abs(_col(lat)) <= 90) & (F.abs(_col(long)) <= 360)
    sin_phi = F.sin(F.radians(F.when(valid, _col(lat))))
    lam = F.radians(_col(long) - CENTRAL_MERIDIAN)
    # tangent of the conformal latitude
    tau = F.sinh(F.atanh("_utm_sin") - ECCENTRICITY * F.atanh(ECCENTRICITY * F.col("_utm_sin")))
    t, e, n = F.col("_utm_tau"), F.col("_utm_east"), F.col("_utm_north")
    north = F.atan2(t, F.cos("_utm_lam"))
    east = F.asinh(F.sin("_utm_lam") / F.sqrt(t * t + F.cos("_utm_lam") * F.cos("_utm_lam")))
    x, y = e, n
    for j, a in enumerate(SERIES, start=1):
        x = x + a * F.cos(2 * j * n) * F.sinh(2 * j * e)
        y = y + a * F.sin(2 * j * n) * F.cosh(2 * j * e)
    k = SCALE * RECTIFYING_RADIUS
    return [
        {"_utm_sin": sin_phi, "_utm_lam": lam},
        {"_utm_tau": tau},
        {"_utm_north": north, "_utm_east": east},
        {"x": FALSE_EASTING + k * x, "y": k * y},
    ]
