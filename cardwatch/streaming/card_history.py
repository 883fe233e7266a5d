"""The per-card state behind the velocity and geo-jump rules on a stream.

State per card is one small typed value: the last place, and how many rows fell into each second of
the last window (at most one entry per second). It is read once and written once per micro-batch,
which also bounds the rows of a card handled at a time. Cards have few rows each, so rows are taken
as they are; building a pandas frame per card costs many times the rules themselves.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cardwatch.functions.geo import EARTH_RADIUS_KM
from cardwatch.operators.history import NO_TIME
from cardwatch.settings import RuleSettings

# The time of a row in microseconds. No leading underscore: rows are named tuples.
MICROS = "at_micros"
STATE = "sec bigint, lat double, lon double, seconds array<bigint>, counts array<bigint>"


def distance_km(lat_from: float, lon_from: float, lat_to: float, lon_to: float) -> float:
    lat_from, lon_from, lat_to, lon_to = map(math.radians, (lat_from, lon_from, lat_to, lon_to))
    chord = (
        math.sin((lat_to - lat_from) / 2) ** 2
        + math.cos(lat_from) * math.cos(lat_to) * math.sin((lon_to - lon_from) / 2) ** 2
    )
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(chord, 1.0)))


def _known(degrees: float | None) -> float | None:
    return None if degrees is None or math.isnan(degrees) else degrees


def second_of(row: Row) -> int:
    return NO_TIME if row[MICROS] is None else row[MICROS] // 1_000_000


class CardHistory(StatefulProcessor):
    def __init__(self, settings: RuleSettings, columns: list[str], ttl_ms: int | None):
        self._settings = settings
        self._columns = columns
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("card", STATE, self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda row: (second_of(row), row[MICROS] or 0, row["id"]))
        before = self._state.get()
        ticks = Counter(dict(zip(before[3], before[4]))) if before else Counter()
        seconds = [second_of(row) for row in batch]
        ticks.update(seconds)
        counts, kept = self._count(seconds, ticks)
        moves, last = self._judge_moves(seconds, batch, before)
        self._state.update((*last, *kept))
        scored = Row(*self._columns, "flag_velocity", "flag_geo_jump")
        for row, count, jumped in zip(batch, counts, moves):
            fast = count >= self._settings.velocity_count
            yield scored(*[row[name] for name in self._columns], fast, jumped)

    def close(self) -> None:
        pass

    def _count(self, seconds: list[int], ticks: Counter) -> tuple[list[int], tuple[list[int], list[int]]]:
        """Rows of the last window per row, peers of the same second included; the ticks to keep."""
        width = self._settings.velocity_window_seconds
        known = sorted(ticks)
        running = [0, *accumulate(ticks[sec] for sec in known)]
        counts = [
            running[bisect_right(known, sec)] - running[bisect_left(known, sec - width)] for sec in seconds
        ]
        recent = known[bisect_left(known, known[-1] - width) :]
        return counts, (recent, [ticks[sec] for sec in recent])

    def _judge_moves(
        self, seconds: list[int], batch: list[Row], before: tuple | None
    ) -> tuple[list[bool | None], tuple]:
        """True or False, or None where the place before is known but no speed can be told; and the
        card's last place."""
        places = (map(_known, (row["merchant_latitude"], row["merchant_longitude"])) for row in batch)
        points = [(sec, *place) for sec, place in zip(seconds, places)]
        late = 0
        if before:
            # Rows older than the last place go before it: they arrived late.
            late = bisect_left(seconds, before[0])
            points.insert(late, tuple(before[:3]))
        flags, previous = [], None
        for k, point in enumerate(points):
            # The card's very first row has nothing before it; a late first row had, but it is forgotten.
            first = None if k < late else False
            flags.append(first if previous is None else self._judge(previous, point))
            if not (self._settings.geo_ignore_unknown_places and None in point):
                previous = point
        if before:
            del flags[late]
        return flags, previous or (points[-1][0], None, None)

    def _judge(self, previous: tuple, present: tuple) -> bool | None:
        elapsed = present[0] - previous[0]
        if previous[1] is None or self._forgotten(previous[0], present[0]):
            return False
        if elapsed <= 0 or previous[0] == NO_TIME or None in (*previous, *present):
            return None
        return distance_km(*previous[1:], *present[1:]) / (elapsed / 3600.0) > self._settings.max_speed_kmh

    def _forgotten(self, then: int, now: int) -> bool:
        """Too long ago by the rows' own times; where no time can be told, nothing is."""
        limit = self._settings.geo_lookback_seconds
        return limit is not None and NO_TIME not in (then, now) and now - then > limit
