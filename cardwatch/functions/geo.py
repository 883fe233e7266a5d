"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardwatch.functions.cleaning import as_column

EARTH_RADIUS_KM = 6371.0


def known_degrees(value: str | Column) -> Column:
    """A coordinate as a double, NULL where it is not a number: NaN is larger than all else in Spark."""
    return F.nanvl(as_column(value).cast("double"), F.lit(None))


def haversine_km(
    lat_from: str | Column, lon_from: str | Column, lat_to: str | Column, lon_to: str | Column
) -> Column:
    """Kilometres between two points given in degrees; NULL if any coordinate is NULL or not a number."""
    phi_from, phi_to = F.radians(known_degrees(lat_from)), F.radians(known_degrees(lat_to))
    half_dphi = (phi_to - phi_from) / 2
    half_dlambda = (F.radians(known_degrees(lon_to)) - F.radians(known_degrees(lon_from))) / 2
    chord = F.pow(F.sin(half_dphi), 2) + F.cos(phi_from) * F.cos(phi_to) * F.pow(F.sin(half_dlambda), 2)
    # least() skips NULLs, so the clamp against rounding must not turn a missing point into 1.
    clamped = F.when(chord > 1.0, 1.0).otherwise(chord)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(clamped))
