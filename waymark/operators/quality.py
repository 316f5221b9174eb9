"""Data-quality checks. Each returns its violations; ``require`` turns them into an error."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import schemas
from waymark.functions.islands import UTC_DAY
from waymark.operators.aggregate import KEY, key_of, twenty_second
from waymark.operators.location import strongest_sensor, tied_windows
from waymark.operators.release import MEASURES, TOLERANCE

IDENTIFIER = "^[0-9a-f]{32}$"
SENSOR = "^[A-Za-z0-9_-]{1,32}$"
UTC_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z$"


class ContractError(ValueError):
    """A table breaks its contract."""


def require(violations: DataFrame, label: str) -> None:
    """Raise if there is any violation; shows the first one."""
    bad = violations.take(1)
    if bad:
        raise ContractError(f"{label}: {bad[0].asDict()}")


def require_columns(df: DataFrame, columns: list, label: str = "table") -> DataFrame:
    """Exact names in exact order."""
    if df.columns != list(columns):
        raise ContractError(f"{label} must have columns {list(columns)}; found {df.columns}")
    return df


def require_types(df: DataFrame, schema: T.StructType, label: str = "table") -> DataFrame:
    found = [(f.name, f.dataType) for f in df.schema.fields]
    if found != [(f.name, f.dataType) for f in schema.fields]:
        raise ContractError(f"{label} must have types {schema.simpleString()}; found "
                            f"{df.schema.simpleString()}")
    return df


def schema_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per expected column: its position and type here, and whether both are right.

    ``bool_and`` over a filter keeps the table itself in the job: the row count is real.
    """
    found = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)}
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(found.get(f.name, (None, "missing"))[1]).alias("found_type"),
            F.lit(found.get(f.name) == (i, f.dataType.simpleString())).alias("passed"),
        )
        for i, f in enumerate(schema.fields)
    ])
    return df.agg(F.count("*").alias("n_rows")).select(
        F.explode(rows).alias("r"), "n_rows").select("r.*", "n_rows")


def invalid_identifier(name: str = "source_address") -> Column:
    return F.col(name).isNull() | ~F.col(name).rlike(IDENTIFIER)


def invalid_flag(name: str = "source_address_randomized") -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(0, 1)


def invalid_count(name: str) -> Column:
    """Not a positive 64-bit integer (text and doubles are accepted if they hold one)."""
    number = F.col(name).try_cast("decimal(38,9)")
    return number.isNull() | (number != F.floor(number)) | (number < 1) | (
        number > F.lit(9223372036854775807).cast("decimal(38,9)"))


def invalid_double(name: str, low: float = None, high: float = None) -> Column:
    number = F.col(name).cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    if low is not None:
        bad = bad | (number < low)
    if high is not None:
        bad = bad | (number > high)
    return bad


def invalid_utc_text(name: str = "timestamp", whole_second: bool = False) -> Column:
    """Not an ISO-8601 ``Z`` time, or not a real calendar date (bad days fail, not roll). The cast is strict about the
    calendar and costs a fraction of a parse by pattern; the form is settled by its own rule."""
    text = F.col(name)
    parsed = F.substring(text, 1, 19).try_cast("timestamp")
    bad = text.isNull() | ~text.rlike(UTC_TEXT) | parsed.isNull()
    if whole_second:
        fraction = F.regexp_extract(text, r"\.([0-9]{1,9})Z$", 1)
        bad = bad | F.regexp_like(fraction, F.lit("[1-9]"))
    return bad


def invalid_sensor(name: str = "sensor_name") -> Column:
    return F.col(name).isNull() | ~F.col(name).rlike(SENSOR)


def duplicate_keys(rows: DataFrame, keys: list = KEY) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def _named(rules: dict) -> Column:
    """Array of the names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def packet_rules() -> dict:
    return {
        "timestamp": invalid_utc_text("timestamp"),
        "type": F.col("type").isNull() | ~F.col("type").isin("management", "data"),
        "subtype": F.col("subtype").isNull() | (F.col("subtype") == ""),
        "strength": invalid_double("strength", -127, 0),
        "source_address": invalid_identifier(),
        "source_address_randomized": invalid_flag(),
        "channel": F.col("channel").isNull() | ~F.col("channel").between(1, 14),
        "sensor_name": invalid_sensor(),
    }


def _broken(rows: DataFrame, rules: dict) -> DataFrame:
    """Rows that break a rule. The names are generated, one array a row, so that they are made once: a filter on a plain column
    goes below the projections it is made of and evaluates them anew, for each rule and each column a rule reads."""
    return rows.select("*", F.explode(F.array(_named(rules))).alias("violations")).filter(F.size("violations") > 0)


def packet_violations(packets_text: DataFrame) -> DataFrame:
    """Rows that break the packet contract, with the names of the broken rules."""
    return _broken(packets_text, packet_rules())


def twenty_second_rules() -> dict:
    identity = F.abs(F.col("strength_sum") - (F.col("detections") * 100 + F.col("rssi_sum")))
    return {
        "timestamp_alignment": F.pmod(F.unix_micros("timestamp"), F.lit(20000000)) != 0,
        "source_address": invalid_identifier(),
        "sensor_name": invalid_sensor(),
        "rssi_median": invalid_double("rssi_median", -127, 0),
        "rssi_sum": invalid_double("rssi_sum"),
        "detections": F.col("detections").isNull() | ~F.col("detections").between(1, 20),
        "strength_identity": F.col("strength_sum").isNull() | (identity > TOLERANCE),
    }


def twenty_second_violations(t20: DataFrame) -> DataFrame:
    return _broken(t20, twenty_second_rules())


def count_by_rule(violations: DataFrame) -> DataFrame:
    return violations.select(F.explode("violations").alias("rule")).groupBy("rule").agg(
        F.count("*").alias("n_rows")
    )


def flag_conflicts(rows: DataFrame, keys: list = ("source_address",)) -> DataFrame:
    """Keys that carry both randomized flags."""
    flag = "source_address_randomized"
    return rows.groupBy(*keys).agg(F.min(flag).alias("low"), F.max(flag).alias("high")).filter(
        F.col("low") != F.col("high")
    )


def unknown_sensors(rows: DataFrame, sensors: DataFrame) -> DataFrame:
    return rows.groupBy("sensor_name").agg(F.count("*").alias("n_rows")).join(
        sensors.select("sensor_name"), "sensor_name", "left_anti"
    )


def table_differences(left: DataFrame, right: DataFrame, keys: list, numeric: list, text: list = ()):
    """Keys missing on one side or with values apart by more than the tolerance."""
    values = [*numeric, *text]

    def side(df, name):
        return df.select(*keys, F.lit(True).alias(f"in_{name}"),
                         *[F.col(v).alias(f"{name}_{v}") for v in values])

    def differs(v):
        a, b = F.col(f"l_{v}"), F.col(f"r_{v}")
        if v in numeric:
            return F.coalesce(F.abs(a - b) > TOLERANCE, ~a.eqNullSafe(b))
        return ~a.eqNullSafe(b)

    apart = reduce(lambda x, y: x | y, [differs(v) for v in values], F.lit(False))
    missing = F.col("in_l").isNull() | F.col("in_r").isNull()
    return side(left, "l").join(side(right, "r"), keys, "full_outer").filter(missing | apart).select(
        *keys,
        F.when(F.col("in_l").isNull(), "right_only").when(F.col("in_r").isNull(), "left_only")
        .otherwise("changed").alias("difference"),
    )


def rebuild_differences(cleaned: DataFrame, t20: DataFrame) -> DataFrame:
    """The 20 s table against a rebuild from the cleaned seconds."""
    rebuilt = twenty_second(cleaned)
    keys = key_of(t20) if UTC_DAY in rebuilt.columns else KEY
    return table_differences(rebuilt, t20, keys, MEASURES)


def hash_collisions(raw: DataFrame, address: Column, hashed: Column) -> DataFrame:
    ids = raw.select(address.alias("raw"), hashed.alias("hashed")).distinct()
    return ids.agg(
        F.count("*").alias("raw_devices"), F.countDistinct("hashed").alias("hashed_devices"),
        (F.count("*") - F.countDistinct("hashed")).alias("collisions"),
    )


def identifier_overlap(a: DataFrame, b: DataFrame, column: str = "source_address") -> DataFrame:
    """Identifiers that occur in both tables; must be none across releases."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi")


def identifier_bijection(internal: DataFrame, public: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct counts that must agree when identifiers map one to one."""
    counts = mapping.agg(
        F.count("*").alias("mapped_ids"), F.countDistinct("public").alias("mapped_public_ids"))
    a = internal.agg(F.countDistinct("source_address")).scalar()
    b = public.agg(F.countDistinct("source_address")).scalar()
    return counts.withColumn("internal_ids", a).withColumn("public_ids", b).withColumn(
        "passed",
        (F.col("internal_ids") == F.col("public_ids")) & (F.col("internal_ids") == F.col("mapped_ids"))
        & (F.col("mapped_ids") == F.col("mapped_public_ids")),
    )


def location_agreement(expected: DataFrame, other: DataFrame) -> DataFrame:
    """Windows whose Location differs between two 20 s tables, and windows decided by a tie."""
    laid = UTC_DAY in expected.columns and UTC_DAY in other.columns
    key = ["source_address", *([UTC_DAY] if laid else []), "timestamp"]
    e = strongest_sensor(expected).select(*key, F.col("sensor_name").alias("e"))
    o = strongest_sensor(other).select(*key, F.col("sensor_name").alias("o"))
    ties = tied_windows(expected).agg(F.count("*")).scalar()
    return (
        e.join(o, key, "full_outer")
        .agg(F.count_if(~F.col("e").eqNullSafe(F.col("o"))).alias("location_mismatches"),
             F.count("*").alias("total_device_windows"))
        .withColumn("tied_device_windows", ties)
    )


def sensor_coverage(rows: DataFrame, sensors: DataFrame) -> DataFrame:
    """Sensors of the facts missing from the dimension and the other way round."""
    seen, known = rows.select("sensor_name").distinct(), sensors.select("sensor_name").distinct()
    return seen.exceptAll(known).withColumn("side", F.lit("facts_only")).unionByName(
        known.exceptAll(seen).withColumn("side", F.lit("dimension_only"))
    )


def invalid_coordinates(coordinates: DataFrame) -> DataFrame:
    return coordinates.filter(
        invalid_double("longitude", -180, 180) | invalid_double("latitude", -90, 90)
    )


def data_counters(t20: DataFrame) -> DataFrame:
    """Null, malformed, duplicate, out-of-range and misaligned rows from one pass per key."""
    rules = twenty_second_rules()
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in schemas.TWENTY_SECOND.names])

    def n(condition):
        return F.count_if(condition)

    per_key = t20.groupBy(*KEY).agg(
        F.count("*").alias("n"), n(nulls).alias("nulls"),
        n(invalid_identifier()).alias("ids"), n(rules["detections"]).alias("detections"),
        n(rules["strength_identity"]).alias("formula"),
        n(rules["timestamp_alignment"]).alias("misaligned"),
    )
    return per_key.agg(
        F.sum("nulls").alias("null_rows"), F.sum("ids").alias("invalid_id_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_keys"),
        F.sum("detections").alias("invalid_detection_rows"),
        F.sum("formula").alias("invalid_formula_rows"),
        F.sum("misaligned").alias("misaligned_timestamp_rows"),
    )


def check(check_id: str, one_row: DataFrame, passed: Column, evidence: Column) -> DataFrame:
    """A one-row result as a line of the check table."""
    return one_row.select(F.lit(check_id).alias("check_id"), passed.alias("passed"),
                          evidence.alias("evidence"))


def counter_checks(counters: DataFrame) -> DataFrame:
    """Counters that must be zero, one check line each."""
    lines = F.explode(F.array(*[
        F.struct(F.lit(c).alias("check_id"), (F.col(c) == 0).alias("passed"),
                 F.col(c).cast("string").alias("evidence")) for c in counters.columns
    ])).alias("l")
    return counters.select(lines).select("l.*")


def overall(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"),
                      F.bool_and("passed").alias("all_passed"))


def metric_checks(located: DataFrame, counts: DataFrame, trips: DataFrame) -> DataFrame:
    """Cross-checks between metric tables."""
    rows = located.agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n_retained_identifiers").alias("n"))
    located_rows = rows.withColumn("counted", total.scalar())
    bad_od = trips.filter(F.col("is_od") == 1).agg(
        F.count_if((F.col("n_windows") < 2) | (F.col("origin") == F.col("destination"))).alias("bad"),
        F.count("*").alias("n"),
    )
    return check(
        "count_total_equals_location_rows", located_rows, F.col("n") == F.col("counted"),
        F.concat_ws("/", "counted", "n"),
    ).unionByName(check(
        "od_rows_have_two_windows_and_two_ends", bad_od, F.col("bad") == 0,
        F.concat_ws("/", "bad", "n"),
    ))
