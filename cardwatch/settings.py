"""Tunables. They are handed to the operators as an argument, never read from a global."""

from __future__ import annotations

from dataclasses import dataclass

# Names of the four rule columns, in the order used by reasons and scores.
RULE_FLAGS = (
    "flag_amount_threshold",
    "flag_velocity",
    "flag_geo_jump",
    "flag_spending_deviation",
)


@dataclass(frozen=True)
class RuleSettings:
    amount_threshold: float = 2000.0
    velocity_count: int = 3
    velocity_window_seconds: int = 300
    max_speed_kmh: float = 900.0
    # Compare with the last row that has a place, instead of with the row before.
    geo_ignore_unknown_places: bool = False
    # How long a place is remembered; for ever by default.
    geo_lookback_seconds: int | None = None
    deviation_multiplier: float = 3.0
    deviation_window_days: int = 30
    points_per_rule: int = 25

    @property
    def deviation_window_seconds(self) -> int:
        return self.deviation_window_days * 86400


DEFAULTS = RuleSettings()
