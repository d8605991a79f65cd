"""Every threshold of the library in one immutable object; durations are seconds."""

from __future__ import annotations

from dataclasses import dataclass, replace


# Every default below.
@dataclass(frozen=True)
class Params:
    # geofence
    dwell_seconds: int = 180
    exit_ratio: float = 1.25
    fence_accuracy_ratio: float = 0.25
    # arrival estimates
    publish_seconds: int = 120
    half_life_seconds: float = 300.0
    nominal_kph: float = 60.0
    circuity: float = 1.30
    moving_kph: float = 5.0
    warm_seconds: int = 900
    cold_warmth: float = 0.2
    freshness_seconds: float = 900.0
    stillness_seconds: float = 1800.0
    accuracy_floor_m: float = 500.0
    min_confidence: float = 0.05
    # rules
    excursion_seconds: int = 1200
    setpoint_tolerance_c: float = 3.0
    unplanned_stop_seconds: int = 1200
    stop_margin_ratio: float = 2.0
    rule_accuracy_m: float = 150.0
    corridor_km: float = 12.0
    deviation_seconds: int = 900
    late_grace_seconds: int = 900
    silence_seconds: int = 1800
    # read models
    stale_seconds: int = 600
    recent_positions: int = 500
    track_points: int = 300
    trail_points: int = 60
    incident_limit: int = 200
    gate_millis: int = 500
    # width of the time slices a long track is cut into (see operators.slices)
    slice_seconds: int = 3600
    slice_rows: int = 200_000  # a slice with more rows is cut at seconds of its own

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULT = Params()
MICROS = 1_000_000
