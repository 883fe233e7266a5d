from cardwatch.functions.cleaning import (
    CHANNEL_NAMES,
    clean_zip,
    decade,
    epoch_seconds,
    income_tier,
    mask_pan,
    parse_currency,
    recode,
)
from cardwatch.functions.geo import EARTH_RADIUS_KM, haversine_km
from cardwatch.functions.scoring import with_risk_columns

__all__ = [
    "CHANNEL_NAMES",
    "EARTH_RADIUS_KM",
    "clean_zip",
    "decade",
    "epoch_seconds",
    "haversine_km",
    "income_tier",
    "mask_pan",
    "parse_currency",
    "recode",
    "with_risk_columns",
]
