"""Pseudonyms for release, and differences between two versions of a release table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import bitmaps, identifiers
from waymark.functions.islands import UTC_DAY
from waymark.functions.timefn import local
from waymark.operators.location import strongest_sensor
from waymark.params import LOCAL_TIMEZONE

KEY = ["timestamp", "source_address", "sensor_name"]
MEASURES = ["rssi_median", "rssi_sum", "detections", "strength_sum"]
TOLERANCE = 1e-9
INTERNAL_FORM, PUBLIC_FORM = "^[0-9a-f]{16,64}$", "^[0-9a-f]{32}$"

# Column names that hold identifiers.
IDENTIFIER_COLUMNS = (
    "source_address", "destination_address", "access_point_address", "device_address", "mac_address",
)


def canonical_address(address):
    """Lower case, colon separated."""
    return F.translate(F.lower(F.trim(address)), "-", ":")


def unicast(address):
    """Six octets, not all zero, and no group bit (which also excludes broadcast)."""
    text = canonical_address(address)
    return (
        text.rlike("^([0-9a-f]{2}:){5}[0-9a-f]{2}$")
        & (text != "00:00:00:00:00:00")
        & F.substring(text, 2, 1).isin("0", "2", "4", "6", "8", "a", "c", "e")
    )


def capture_pseudonyms(
    rows: DataFrame, deployment: str, key: bytes, domain: bytes, address: str = "source_address"
) -> DataFrame:
    """Distinct usable addresses with pseudonym and the locally-administered flag, which is
    read before hashing destroys it."""
    canonical = canonical_address(address)
    hashed = identifiers.keyed_hash(identifiers.capture_prefix(domain, deployment), key)
    return (
        rows.filter(unicast(address)).select(canonical.alias("address")).distinct()
        .withColumn("randomized", F.substring("address", 2, 1).isin("2", "6", "a", "e").cast("int"))
        .withColumn("identifier", hashed("address"))
    )


def _or_fail(good, value, message: str):
    """The value, or an error that stops the job, and with it any write, and names no identifier."""
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)))


def _injective(mapping: DataFrame, internal: str, public: str) -> DataFrame:
    """A mapping of distinct identifiers; reading it fails where two of them share a pseudonym."""
    one = mapping.groupBy(public).agg(F.max(internal).alias(internal), F.count("*").alias("_n"))
    return one.select(internal, _or_fail(
        F.col("_n") == 1, F.col(public), "two identifiers share a pseudonym").alias(public))


def build_mapping(
    rows: DataFrame, dataset: str, key: bytes, domain: bytes, column: str = "source_address"
) -> DataFrame:
    """Distinct internal identifiers and their public pseudonyms. A missing or malformed identifier and a collision
    fail the job that reads the mapping."""
    hashed = identifiers.keyed_hash(identifiers.release_prefix(domain, dataset), key)
    name = F.col("internal")
    checked = _or_fail(name.isNotNull() & name.rlike(INTERNAL_FORM), name, "identifier outside the accepted form")
    ids = rows.select(F.col(column).alias("internal")).distinct()
    return _injective(ids.withColumn("public", hashed(checked)), "internal", "public")


def invalid_internal(rows: DataFrame, column: str = "source_address") -> DataFrame:
    """Identifiers outside the accepted form; a release must have none."""
    return rows.filter(F.col(column).isNull() | ~F.col(column).rlike(INTERNAL_FORM))


def mapping_collisions(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("public").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def rewrite_ids(table: DataFrame, mapping: DataFrame, column: str = "source_address") -> DataFrame:
    """Replace identifiers by joining the distinct-identifier mapping. The mapping can be as
    long as the data has identifiers, so its side is left to Spark's runtime sizes. A row whose
    identifier has no pseudonym, NULL included, fails the job."""
    m = mapping.select(F.col("internal").alias(column), F.col("public").alias("_public"))
    public = _or_fail(F.col("_public").isNotNull(), F.col("_public"), "identifier without a pseudonym")
    return table.join(m, column, "left").withColumn(column, public).select(*table.columns)


def rekey(table: DataFrame, scope: str, key: bytes, domain: bytes) -> DataFrame:
    """Re-pseudonymise every identifier column of a table. Blank values stay blank; a value that is a
    pseudonym already and a collision fail the job."""
    names = [c for c in table.columns if c.lower() in IDENTIFIER_COLUMNS]
    if not names:
        return table
    hashed = identifiers.keyed_hash(identifiers.scope_prefix(domain, scope), key)
    # the columns share one mapping, so the table is read once for the identifiers of all; each set of values is small first
    values = table.groupBy([identifiers.canonical_address(name).alias(f"_id_{i}") for i, name in enumerate(names)]).agg(F.lit(1))
    ids = values.select(F.explode(F.array(*[f"_id_{i}" for i in range(len(names))])).alias("_id")).filter(F.col("_id") != "").distinct()
    checked = _or_fail(~F.col("_id").rlike(PUBLIC_FORM), F.col("_id"), "input holds pseudonyms already")
    mapping = _injective(ids.withColumn("_new", hashed(checked)), "_id", "_new")
    result = table
    for name in names:
        result = (
            result.withColumn("_id", identifiers.canonical_address(name)).join(mapping, "_id", "left")
            .withColumn(name, F.coalesce("_new", "_id", F.lit(""))).select(*table.columns)
        )
    return result


def already_public(table: DataFrame) -> DataFrame:
    """Identifier values that are 32 hex digits already: input that must not be keyed again."""
    names = [c for c in table.columns if c.lower() in IDENTIFIER_COLUMNS]
    values = F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names
    ]))
    return table.select(values.alias("v")).select("v.*").filter(
        F.col("value").rlike(PUBLIC_FORM)
    ).groupBy("column").agg(F.countDistinct("value").alias("n_identifiers"))


def legacy_pseudonyms(rows: DataFrame, column: str = "source_address") -> DataFrame:
    return rows.withColumn(column, identifiers.legacy_identifier(column))


def values_preserved(internal: DataFrame, public: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows without a public counterpart, and rows whose values changed, under a mapping."""
    expected = rewrite_ids(internal, mapping)
    p = public.select(*KEY, F.lit(True).alias("_there"), *[F.col(c).alias(f"p_{c}") for c in MEASURES])
    changed = F.lit(False)
    for c in MEASURES:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return expected.join(p, KEY, "left").agg(
        F.count_if(F.col("_there").isNull()).alias("missing_rows"),
        F.count_if(F.col("_there") & changed).alias("changed_value_rows"),
    )


def _paired(current: DataFrame, candidate: DataFrame, key: list, values: list) -> DataFrame:
    def side(df, name):
        return df.select(*key, F.lit(True).alias(f"in_{name}"),
                         *[F.col(v).alias(f"{name}_{v}") for v in values])

    return side(current, "cur").join(side(candidate, "cand"), key, "full_outer")


def row_impact(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Matched, one-sided and changed keys, changes counted by column."""
    paired = _paired(current, candidate, KEY, MEASURES)
    both = F.col("in_cur").isNotNull() & F.col("in_cand").isNotNull()

    def changed(c):
        old, new = F.col(f"cur_{c}"), F.col(f"cand_{c}")
        return both & (~old.eqNullSafe(new) if c == "detections" else F.abs(old - new) > TOLERANCE)

    any_changed = changed(MEASURES[0])
    for c in MEASURES[1:]:
        any_changed = any_changed | changed(c)
    return paired.agg(
        F.count("in_cur").alias("current_rows"),
        F.count("in_cand").alias("candidate_rows"),
        F.count_if(both).alias("matched_keys"),
        F.count_if(F.col("in_cur").isNull()).alias("candidate_only_keys"),
        F.count_if(F.col("in_cand").isNull()).alias("current_only_keys"),
        F.count_if(any_changed).alias("matched_rows_with_changed_values"),
        *[F.count_if(changed(c)).alias(f"rows_changed_{c}") for c in MEASURES],
        F.count_if(both & ~any_changed).alias("fully_unchanged_rows"),
        F.count_if(~both | any_changed).alias("changed_union_rows"),
    )


def location_impact(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Identifier-windows whose assigned sensor is the same, changed or one-sided."""
    laid = UTC_DAY in current.columns and UTC_DAY in candidate.columns
    paired = _paired(strongest_sensor(current), strongest_sensor(candidate),
                     ["source_address", *([UTC_DAY] if laid else []), "timestamp"], ["sensor_name"])
    same = F.col("cur_sensor_name") == F.col("cand_sensor_name")
    return paired.agg(
        F.count("in_cur").alias("current_device_windows"),
        F.count("in_cand").alias("candidate_device_windows"),
        F.count_if(F.col("in_cur").isNull()).alias("candidate_only_device_windows"),
        F.count_if(F.col("in_cand").isNull()).alias("current_only_device_windows"),
        F.count_if(same).alias("same_location_assignments"),
        F.count_if(~same).alias("changed_location_assignments"),
    )


PERIOD_MEASURES = {
    "sensor_window_rows": "sensor_window_row_difference",
    "device_windows": "device_window_difference",
    "devices": "device_difference",
    "detections": "detection_difference",
}


def period_totals(t20: DataFrame, grain: str, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Rows, identifier-windows, identifiers and detections per local day or hour. Rows laid out by identifier and ``utc_day`` are
    counted where they lie; a period of two UTC days is put together from its parts."""
    day = [UTC_DAY] if UTC_DAY in t20.columns else []
    here = F.date_trunc(grain, local("timestamp", tz))
    # one identifier-window lies in one period, so counting it never needs its own distinct
    windows = t20.groupBy("source_address", *day, "timestamp").agg(
        F.count("*").alias("rows"), F.sum("detections").alias("detections")
    )
    per_id = windows.groupBy(here.alias("period"), "source_address", *day).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("windows"),
        F.sum("detections").alias("detections"),
    )
    if day:
        per_id = per_id.groupBy("period", "source_address").agg(
            *[F.sum(c).alias(c) for c in ("rows", "windows", "detections")])
    return per_id.groupBy("period").agg(
        F.sum("rows").alias("sensor_window_rows"), F.sum("windows").alias("device_windows"),
        F.count("*").alias("devices"), F.sum("detections").alias("detections"),
    )


def period_diff(current: DataFrame, candidate: DataFrame, grain: str = "day") -> DataFrame:
    paired = _paired(period_totals(current, grain), period_totals(candidate, grain),
                     ["period"], list(PERIOD_MEASURES))
    columns = [F.unix_seconds("period").alias("local_period_epoch")]
    for c, difference in PERIOD_MEASURES.items():
        columns += [F.col(f"cur_{c}").alias(f"current_{c}"), F.col(f"cand_{c}").alias(f"candidate_{c}"),
                    (F.col(f"cand_{c}") - F.col(f"cur_{c}")).alias(difference)]
    return paired.select(*columns)


def period_diff_summary(differences: DataFrame, grain: str) -> DataFrame:
    """Periods with a difference and the largest absolute difference, by measure."""
    return differences.agg(
        F.lit(grain).alias("grain"), F.count("*").alias("periods"),
        *[F.count_if(F.col(d) != 0).alias(f"periods_with_{d}") for d in PERIOD_MEASURES.values()],
        *[F.max(F.abs(F.col(d))).alias(f"max_abs_{d}") for d in PERIOD_MEASURES.values()],
    )


def dataset_overview(t20: DataFrame) -> DataFrame:
    """Counters of a table in one pass: rows become device windows, those become devices, and nothing is counted as distinct
    over rows. The sensors are the union of the devices' sensor sets."""
    sensors = bitmaps.small_dictionary(t20.select("sensor_name"))
    words = bitmaps.words_of(sensors.count())
    numbers = sensors.select(F.col("value").alias("sensor_name"), "number")
    windows = t20.join(numbers, "sensor_name", "left").groupBy("source_address", "timestamp").agg(
        F.count("*").alias("n"), F.sum("detections").alias("sum"), F.min("detections").alias("min"), F.max("detections").alias("max"),
        F.count_if(~F.col("detections").between(1, 20)).alias("outside"), *bitmaps.word_sets(F.col("number"), words, "sensors"))
    devices = windows.groupBy("source_address").agg(
        F.sum("n").alias("n"), F.count("*").alias("windows"), F.sum("sum").alias("sum"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.sum("outside").alias("outside"), *bitmaps.word_unions(words, "sensors"))
    whole = devices.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("source_address").alias("devices"),
        F.sum("sum").alias("total_detections"), F.min("min").alias("minimum_detections"), F.max("max").alias("maximum_detections"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("rows_outside_one_to_twenty"),
        F.coalesce(F.sum("windows"), F.lit(0)).alias("device_windows"), *bitmaps.word_unions(words, "sensors"))
    return whole.select("records", "devices", F.coalesce(bitmaps.word_count(words, "sensors"), F.lit(0).cast("long")).alias("sensors"),
                        "total_detections", "minimum_detections", "maximum_detections", "rows_outside_one_to_twenty", "device_windows")
