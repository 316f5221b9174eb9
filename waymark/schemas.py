"""Table contracts: column names, order and physical types."""

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# A landed capture file: timestamps are still RFC 3339 text.
PACKETS_RAW = _schema(
    timestamp=_S, type=_S, subtype=_S, strength=_I, source_address=_S,
    source_address_randomized=_I, channel=_I, sensor_name=_S,
)
PACKETS = _schema(
    timestamp=_TS, type=_S, subtype=_S, strength=_I, source_address=_S,
    source_address_randomized=_I, channel=_I, sensor_name=_S,
)
CAPTURE_METADATA = _schema(key=_S, value=_S)
CAPTURE_INTERFACE_SUMMARY = _schema(
    interface=_S, packets_received=_L, packets_dropped=_L, packets_interface_dropped=_L,
)
ONE_SECOND = _schema(
    timestamp=_TS, source_address=_S, sensor_name=_S,
    source_address_randomized=_I, rssi_median=_D, packet_count=_L,
)
TWENTY_SECOND = _schema(
    timestamp=_TS, source_address=_S, sensor_name=_S,
    rssi_median=_D, rssi_sum=_D, detections=_L, strength_sum=_D,
)
TWENTY_SECOND_PUBLIC = T.StructType(TWENTY_SECOND.fields[:-1])
SENSORS = _schema(sensor_name=_S, x=_D, y=_D, coordinate_system=_S, is_synthetic=_I)
SENSORS_DISTRICT = _schema(id_last=_S, id_sensor=_S, street_type=_S, x=_D, y=_D)
SENSOR_COORDINATES = _schema(
    dataset_id=_S, site=_S, sensor_name=_S, longitude=_D, latitude=_D, crs_epsg=_I,
)
RAW_DETECTIONS = _schema(timestamp=_TS, source_address=_S, sensor_name=_S, rssi=_I)
GPS = _schema(source_address=_S, timestamp=_TS, x=_D, y=_D)

LOCATION_COLUMNS = [
    "timestamp_utc", "source_address", "sensor_name", "x", "y", "strength_sum", "detections",
]
COUNT_COLUMNS = ["timestamp_utc", "sensor_name", "n_retained_identifiers"]
TRACK_COLUMNS = [
    "source_address", "trajectory_id", "start_utc", "end_utc", "duration_seconds",
    "n_windows", "origin", "destination", "is_od",
]
OD_COLUMNS = ["origin", "destination", "n_trajectories", "n_retained_identifiers"]
REVISIT_COLUMNS = [
    "source_address", "n_qualifying_trajectories", "n_observed_local_dates",
    "observed_local_dates", "first_local_date", "last_local_date", "revisit_class",
]
ACTIVITY_COLUMNS = [
    "source_address", "trajectory_id", "cluster_id", "episode_id", "start_utc", "end_utc",
    "duration_seconds", "n_windows", "primary_sensor", "n_sensors", "is_stay", "activity_type",
]
CHECK_COLUMNS = ["check_id", "passed", "evidence"]
