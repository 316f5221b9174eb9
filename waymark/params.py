"""Rule sets. The maintained and the historical rules differ, so every rule is a parameter."""

from dataclasses import dataclass, replace

LOCAL_TIMEZONE = "Asia/Seoul"
WINDOW_SECONDS = 20


@dataclass(frozen=True)
class CleaningParams:
    rssi_min: int = -80
    rssi_max: int = -30
    exclude_subtypes: tuple = ("beacon", "probe-response")
    session_gap_seconds: int = 300
    stationary_seconds: int = 7200
    # maintained: a session must exceed the limit; historical: reaching it is enough
    stationary_inclusive: bool = False
    # historical only: identifiers with fewer rows are dropped (0 keeps all)
    min_detections: int = 0


@dataclass(frozen=True)
class MetricParams:
    track_gap_seconds: int = 1800
    visit_gap_seconds: int = 7200
    revisit_min_windows: int = 2
    activity_min_windows: int = 3
    activity_min_sensors: int = 1
    activity_min_seconds: int = 0
    activity_max_seconds: int = 7200
    activity_distance_metres: float = 75.0
    activity_continuity_gap_seconds: int = 600
    activity_min_duration_seconds: int = 300
    local_timezone: str = LOCAL_TIMEZONE


MAINTAINED_CLEANING = CleaningParams()
HISTORICAL_CLEANING = CleaningParams(stationary_inclusive=True, min_detections=5)

MAINTAINED = MetricParams()
CAMPUS = replace(MAINTAINED, visit_gap_seconds=1800, activity_distance_metres=150.0)
DISTRICT = replace(
    MAINTAINED, activity_min_windows=1, activity_min_sensors=2, activity_min_seconds=60
)
