"""Session-based removal of stationary sources and the two cleaning procedures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.identifiers import legacy_identifier
from waymark.functions.islands import cells, session_spans
from waymark.operators import aggregate, filters
from waymark.params import HISTORICAL_CLEANING, MAINTAINED_CLEANING, CleaningParams

SESSION_KEY = ["source_address", "sensor_name"]


def sessions(rows: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Sessions of an identifier at one sensor: number, first and last time, duration."""
    spans = session_spans(cells(rows, SESSION_KEY, gap_seconds), SESSION_KEY, gap_seconds, {"n": F.sum("n")})
    return (
        spans.groupBy(*SESSION_KEY, "session_id")
        .agg(
            F.min("start_epoch").alias("start_epoch"),
            F.max("end_epoch").alias("end_epoch"),
            F.sum("n").alias("n_rows"),
        )
        .withColumn("duration_seconds", F.col("end_epoch") - F.col("start_epoch"))
    )


def stationary_identifiers(rows: DataFrame, rules: CleaningParams = MAINTAINED_CLEANING) -> DataFrame:
    """Identifiers with one long session at any sensor."""
    length = F.col("duration_seconds")
    limit = rules.stationary_seconds
    long = length >= limit if rules.stationary_inclusive else length > limit
    return sessions(rows, rules.session_gap_seconds).filter(long).select("source_address").distinct()


def remove_stationary(rows: DataFrame, rules: CleaningParams = MAINTAINED_CLEANING) -> DataFrame:
    """A stationary identifier goes everywhere, not only at the sensor that saw it stay."""
    return filters.without_identifiers(rows, stationary_identifiers(rows, rules))


def clean(
    one_second: DataFrame, rules: CleaningParams = MAINTAINED_CLEANING, deduplicate: bool = True
) -> DataFrame:
    """Maintained cleaning: unique seconds, unflagged identifiers, no stationary sources. The result of
    ``aggregate.one_second`` is unique already and needs no second aggregation."""
    unique = aggregate.deduplicate_one_second(one_second) if deduplicate else one_second
    return remove_stationary(filters.keep_unflagged(unique), rules)


def clean_historical(raw: DataFrame, rules: CleaningParams = HISTORICAL_CLEANING) -> DataFrame:
    """Historical cleaning of hardware-address rows, identifiers replaced by their legacy hash."""
    valid = filters.drop_rssi_sentinels(filters.drop_invalid_addresses(raw))
    stable = valid.filter(~filters.locally_administered("source_address"))
    kept = filters.drop_rare(remove_stationary(stable, rules), rules.min_detections)
    return kept.withColumn("source_address", legacy_identifier("source_address"))


def cleaning_funnel(raw: DataFrame, rules: CleaningParams = HISTORICAL_CLEANING) -> DataFrame:
    """Rows and identifiers left after each historical step.

    Every step keeps or drops whole identifiers once invalid rows are gone, so one
    aggregation per identifier carries the counts.
    """
    valid = filters.drop_rssi_sentinels(filters.drop_invalid_addresses(raw))
    stable = valid.filter(~filters.locally_administered("source_address"))
    fixed = stationary_identifiers(stable, rules).withColumn("_fixed", F.lit(True))
    per_id = (
        valid.groupBy("source_address").agg(F.count("*").alias("n"))
        .join(fixed, "source_address", "left")
        .withColumn(
            "reached",
            F.when(filters.locally_administered("source_address"), 0)
            .when(F.col("_fixed"), 1)
            .when(F.col("n") < rules.min_detections, 2)
            .otherwise(3),
        )
    )
    steps = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name")) for i, name in enumerate(
            ["initial", "after_random", "after_stationary", "after_rare"])
    ])
    return (
        per_id.withColumn("s", F.explode(steps))
        .groupBy(F.col("s.step").alias("step"), F.col("s.name").alias("name"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("reached") >= F.col("s.step"), F.col("n"))), F.lit(0))
            .alias("n_rows"),
            F.count_if(F.col("reached") >= F.col("s.step")).alias("n_identifiers"),
        )
    )
