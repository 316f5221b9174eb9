"""The stages from packets to the five metrics, as one lazy DataFrame each."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions.timefn import utc_text
from waymark.operators import activities as act
from waymark.operators import aggregate, cleaning, count, location, revisits, track
from waymark.operators.quality import require, unknown_sensors
from waymark.params import MAINTAINED, MAINTAINED_CLEANING, CleaningParams, MetricParams


def cleaned_one_second(packets: DataFrame, rules: CleaningParams = MAINTAINED_CLEANING) -> DataFrame:
    return cleaning.clean(aggregate.one_second(packets, rules), rules, deduplicate=False)


def twenty_second(packets: DataFrame, rules: CleaningParams = MAINTAINED_CLEANING) -> DataFrame:
    return aggregate.twenty_second(cleaned_one_second(packets, rules))


def five_metrics(
    t20: DataFrame, sensors: DataFrame, p: MetricParams = MAINTAINED, stage=lambda df, name: df
) -> dict:
    """The six metric tables with their contract columns.

    ``stage(df, name)`` may write and re-read the Location table, which feeds all others
    (see ``sources.tables.stager``); without it every table is computed from ``t20``. Rows of a
    sensor that is not in the dimension would vanish from Location, so they are refused at once.
    """
    require(unknown_sensors(t20, sensors), "unknown sensor")
    located = stage(location.locate_proximity(t20, sensors), "located")
    trips = track.trajectory_summary(located, p.track_gap_seconds)
    return {
        "location": location_table(located),
        "count": count_table(count.count_sensor_window(located)),
        "track_trajectories": track_table(trips),
        "track_od": track.od_matrix(trips).select(*schemas.OD_COLUMNS),
        "revisits": revisits.revisits(
            located, p.visit_gap_seconds, p.revisit_min_windows, p.local_timezone
        ).select(*schemas.REVISIT_COLUMNS),
        "activities": activity_table(act.activities(located, p)),
    }


def location_table(located: DataFrame) -> DataFrame:
    return located.withColumn("timestamp_utc", utc_text("timestamp")).select(*schemas.LOCATION_COLUMNS)


def count_table(counts: DataFrame) -> DataFrame:
    return counts.withColumn("timestamp_utc", utc_text("timestamp")).select(*schemas.COUNT_COLUMNS)


def _with_utc(df: DataFrame) -> DataFrame:
    return df.withColumn("start_utc", utc_text(F.timestamp_seconds("start_epoch"))).withColumn(
        "end_utc", utc_text(F.timestamp_seconds("end_epoch"))
    )


def track_table(trajectories: DataFrame) -> DataFrame:
    return _with_utc(trajectories).select(*schemas.TRACK_COLUMNS)


def activity_table(episodes: DataFrame) -> DataFrame:
    return _with_utc(episodes).select(*schemas.ACTIVITY_COLUMNS)
