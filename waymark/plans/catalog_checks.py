"""Queries for the data-quality checks (V). Inputs with known defects are derived from the tables."""

from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions.identifiers import legacy_identifier
from waymark.functions.islands import UTC_DAY
from waymark.functions.timefn import epoch
from waymark.operators import aggregate, filters, joins, quality, release
from waymark.operators.count import count_sensor_window
from waymark.plans.catalog_relational import NARROW
from waymark.plans.context import Context, query
from waymark.plans.oracle import PLANTED, RAW, TRIPS, with_base


def _schema_sql(schema, table):
    rows = ", ".join(f"({i}, '{f.name}', '{f.dataType.simpleString()}')" for i, f in enumerate(schema.fields))
    return with_base(f"""SELECT position, "column", found_type, TRUE AS passed, (SELECT count(*) FROM {table}) AS n_rows
        FROM (VALUES {rows}) v(position, "column", found_type)""")


@query("check_v1_columns", _schema_sql(schemas.PACKETS, "packets"))
def _(c: Context):
    return quality.schema_report(quality.require_columns(c.packets, schemas.PACKETS.names), schemas.PACKETS)


@query("check_v2_identifiers", with_base(
    """SELECT address AS source_address, count(*) AS n FROM raw
       WHERE NOT regexp_full_match(address, '[0-9a-f]{32}') GROUP BY 1""", RAW))
def _(c: Context):
    return c.raw.filter(quality.invalid_identifier()).groupBy("source_address").agg(F.count("*").alias("n"))


@query("check_v3_flags", with_base("SELECT n % 3 AS flag, count(*) AS n FROM sec1 WHERE n % 3 NOT IN (0, 1) GROUP BY 1"))
def _(c: Context):
    rows = c.sec1.withColumn("flag", F.col("packet_count") % 3)
    return rows.filter(quality.invalid_flag("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("check_v4_positive_counts", with_base(
    """SELECT value, count(*) AS n FROM (SELECT CASE t % 5 WHEN 0 THEN '0' WHEN 1 THEN '1.5' WHEN 2 THEN 'x'
         WHEN 3 THEN CAST(n AS VARCHAR) ELSE '-1' END AS value, t FROM sec1) WHERE t % 5 <> 3 GROUP BY 1"""))
def _(c: Context):
    s = epoch("timestamp") % 5
    value = (F.when(s == 0, "0").when(s == 1, "1.5").when(s == 2, "x")
             .when(s == 3, F.col("packet_count").cast("string")).otherwise("-1"))
    rows = c.sec1.withColumn("value", value)
    return rows.filter(quality.invalid_count("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("check_v5_finite_doubles", with_base(
    "SELECT sensor AS sensor_name, count(*) AS n FROM sec1 WHERE t % 7 IN (0, 1) OR m < -75 OR m > -40 GROUP BY 1"))
def _(c: Context):
    s = epoch("timestamp") % 7
    value = F.when(s == 0, float("nan")).when(s == 1, float("inf")).otherwise(F.col("rssi_median"))
    rows = c.sec1.withColumn("value", value)
    return rows.filter(quality.invalid_double("value", -75, -40)).groupBy("sensor_name").agg(
        F.count("*").alias("n"))


@query("check_v6_utc_text", with_base(
    """SELECT defect, count(*) AS n FROM (SELECT CASE t % 6 WHEN 0 THEN 'no zone' WHEN 1 THEN 'bad day'
         WHEN 2 THEN 'offset' WHEN 3 THEN 'ten digits' ELSE 'none' END AS defect FROM sec1)
       WHERE defect <> 'none' GROUP BY 1"""))
def _(c: Context):
    s = epoch("timestamp") % 6
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    defect = (F.when(s == 0, "no zone").when(s == 1, "bad day").when(s == 2, "offset")
              .when(s == 3, "ten digits").otherwise("none"))
    broken = (
        F.when(s == 0, text).when(s == 1, F.concat(F.lit("2024-02-30T"), F.substring(text, 12, 8), F.lit("Z")))
        .when(s == 2, F.concat(text, F.lit("+00:00"))).when(s == 3, F.concat(text, F.lit(".0123456789Z")))
        .when(s == 4, F.concat(text, F.lit(".012345678Z"))).otherwise(F.concat(text, F.lit("Z")))
    )
    rows = c.sec1.select(broken.alias("timestamp"), defect.alias("defect"))
    return rows.filter(quality.invalid_utc_text()).groupBy("defect").agg(F.count("*").alias("n"))


@query("check_v6_whole_seconds", with_base(
    "SELECT sensor AS sensor_name, count(*) AS n FROM packets WHERE us // 1000 % 1000 <> 0 GROUP BY 1"))
def _(c: Context):
    bad = quality.invalid_utc_text(whole_second=True)
    return c.packets_text.filter(bad).groupBy("sensor_name").agg(F.count("*").alias("n"))


@query("check_v7_unique_key", with_base(
    "SELECT t AS timestamp, id AS source_address, sensor AS sensor_name, count(*) AS n FROM packets "
    "GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def _(c: Context):
    rows = c.packets_by_day.withColumn("timestamp", F.date_trunc("second", "timestamp"))
    return quality.duplicate_keys(rows, aggregate.key_of(rows)).drop(UTC_DAY)


@query("check_v8_packet_domain", with_base(
    """SELECT rule, count(*) AS n_rows FROM (
       SELECT unnest([CASE WHEN us % 2 = 0 AND t % 11 = 0 THEN 'timestamp' END,
                      CASE WHEN t % 13 = 0 THEN 'type' END, CASE WHEN t % 17 = 0 THEN 'subtype' END,
                      CASE WHEN t % 19 = 0 THEN 'strength' END, CASE WHEN t % 23 = 0 THEN 'source_address' END,
                      CASE WHEN t % 29 = 0 THEN 'source_address_randomized' END,
                      CASE WHEN t % 31 = 0 THEN 'channel' END, CASE WHEN t % 37 = 0 THEN 'sensor_name' END]) AS rule
       FROM (SELECT t, 0 AS us FROM packets)) WHERE rule IS NOT NULL GROUP BY 1"""))
def _(c: Context):
    """Each rule is broken on the seconds divisible by one small prime."""
    t = F.unix_seconds(F.to_timestamp("timestamp"))
    p = c.packets_text.withColumn("t", t)

    def spoil(column, prime, value):
        return F.when(F.col("t") % prime == 0, F.lit(value)).otherwise(F.col(column)).alias(column)

    rows = p.select(
        spoil("timestamp", 11, "2024-01-01 00:00:00"), spoil("type", 13, "control"),
        spoil("subtype", 17, ""), spoil("strength", 19, 5), spoil("source_address", 23, "ABC"),
        spoil("source_address_randomized", 29, 2), spoil("channel", 31, 15), spoil("sensor_name", 37, "a b"))
    return quality.count_by_rule(quality.packet_violations(rows))


@query("check_v9_flag_conflicts", with_base(
    """SELECT id AS source_address, min(f) AS low, max(f) AS high FROM (
       SELECT id, CASE WHEN t % 1009 = 0 THEN 1 - flag ELSE flag END AS f FROM packets)
       GROUP BY 1 HAVING min(f) <> max(f)"""))
def _(c: Context):
    flag = F.col("source_address_randomized")
    mixed = c.packets.withColumn(
        "source_address_randomized", F.when(epoch("timestamp") % 1009 == 0, 1 - flag).otherwise(flag))
    return quality.flag_conflicts(mixed)


@query("check_v10_twenty_second_invariants", with_base(
    """SELECT rule, count(*) AS n_rows FROM (
       SELECT unnest([CASE WHEN u % 7 = 0 THEN 'timestamp_alignment' END, CASE WHEN u % 11 = 0 THEN 'detections' END,
                      CASE WHEN u % 11 = 0 OR u % 13 = 0 THEN 'strength_identity' END,
                      CASE WHEN u % 17 = 0 THEN 'rssi_median' END]) AS rule
       FROM (SELECT w // 20 AS u FROM t20)) WHERE rule IS NOT NULL GROUP BY 1"""))
def _(c: Context):
    u = F.floor(epoch("timestamp") / 20)
    rows = c.t20.withColumn("u", u).select(
        F.when(F.col("u") % 7 == 0, F.timestamp_seconds(epoch("timestamp") + 1))
        .otherwise(F.col("timestamp")).alias("timestamp"),
        "source_address", "sensor_name",
        F.when(F.col("u") % 17 == 0, 1.0).otherwise(F.col("rssi_median")).alias("rssi_median"), "rssi_sum",
        F.when(F.col("u") % 11 == 0, 21).otherwise(F.col("detections")).cast("long").alias("detections"),
        F.when(F.col("u") % 13 == 0, F.col("strength_sum") + 0.5).otherwise(F.col("strength_sum"))
        .alias("strength_sum"))
    return quality.count_by_rule(quality.twenty_second_violations(rows))


@query("check_v11_unknown_sensors", with_base(
    "SELECT sensor AS sensor_name, count(*) AS n_rows FROM t20 WHERE sensor IN ('s04', 's09') GROUP BY 1"))
def _(c: Context):
    return quality.unknown_sensors(c.t20, filters.without_sensors(c.sensors, ["s04", "s09"]))


@query("check_v12_table_equality", with_base(
    """SELECT difference, sensor_name, count(*) AS n FROM (
       SELECT coalesce(a.sensor, b.sensor) AS sensor_name,
              CASE WHEN a.id IS NULL THEN 'right_only' WHEN b.id IS NULL THEN 'left_only' ELSE 'changed' END AS difference
       FROM t20 a FULL OUTER JOIN n20 b ON a.id = b.id AND a.w = b.w AND a.sensor = b.sensor
       WHERE a.id IS NULL OR b.id IS NULL OR abs(a.rssi_median - b.rssi_median) > 1e-9
          OR abs(a.rssi_sum - b.rssi_sum) > 1e-9 OR a.detections <> b.detections) GROUP BY 1, 2""", NARROW))
def _(c: Context):
    apart = quality.table_differences(
        c.t20_by_day, c.t20_narrow_by_day, aggregate.key_of(c.t20_by_day),
        ["rssi_median", "rssi_sum", "detections", "strength_sum"])
    return c.in_place(apart.groupBy("difference", "sensor_name").agg(F.count("*").alias("n")), "differences")


@query("check_v13_multiset_difference", with_base(
    """SELECT side, source_address, n FROM (
       SELECT 'left_only' AS side, id AS source_address, count(*) AS n FROM
         (SELECT w, id, sensor FROM t20 EXCEPT ALL SELECT w, id, sensor FROM n20) GROUP BY 2
       UNION ALL SELECT 'right_only', id, count(*) FROM
         (SELECT w, id, sensor FROM n20 EXCEPT ALL SELECT w, id, sensor FROM t20) GROUP BY 2)""", NARROW))
def _(c: Context):
    return joins.multiset_difference(
        c.t20.select(*aggregate.KEY), c.t20_narrow.select(*aggregate.KEY)
    ).groupBy("side", "source_address").agg(F.count("*").alias("n"))


@query("check_v14_rebuild", with_base(
    "SELECT (SELECT count(*) FROM t20) AS n_windows, 0 AS n_differences"))
def _(c: Context):
    written = c.landed_by_day(c.t20_by_day, "t20_written")
    differences = quality.rebuild_differences(c.cleaned_by_day, written).agg(F.count("*")).scalar()
    return c.in_place(written.agg(F.count("*").alias("n_windows")).withColumn("n_differences", differences), "rebuild")


@query("check_v15_physical_types", _schema_sql(schemas.TWENTY_SECOND, "t20"))
def _(c: Context):
    written = c.spark.read.parquet(c.landed(c.t20, "t20"))
    return quality.schema_report(quality.require_types(written, schemas.TWENTY_SECOND), schemas.TWENTY_SECOND)


@query("check_v16_hash_collisions", with_base(
    """SELECT count(*) AS raw_devices, count(DISTINCT h) AS hashed_devices, count(*) - count(DISTINCT h) AS collisions
       FROM (SELECT DISTINCT lower(trim(address)) AS a, substr(sha256(lower(trim(address))), 1, 16) AS h FROM raw)""",
    RAW))
def _(c: Context):
    return quality.hash_collisions(
        c.raw, F.lower(F.trim("source_address")), legacy_identifier("source_address"))


@query("check_v17_identifier_bijection", with_base(
    """SELECT count(DISTINCT id) AS mapped_ids, count(DISTINCT id) AS mapped_public_ids,
       count(DISTINCT id) AS internal_ids, count(DISTINCT id) AS public_ids, TRUE AS passed FROM t20"""))
def _(c: Context):
    mapping = _hash_mapping(c.t20)
    return quality.identifier_bijection(c.t20, release.rewrite_ids(c.t20, mapping), mapping)


def _hash_mapping(rows):
    ids = rows.select(F.col("source_address").alias("internal")).distinct()
    return ids.withColumn("public", F.substring(F.sha2(F.col("internal").cast("binary"), 256), 1, 32))


@query("check_v17_identifier_overlap", with_base(
    "SELECT DISTINCT id AS source_address FROM sec1 WHERE id IN (SELECT id FROM t20)"))
def _(c: Context):
    return quality.identifier_overlap(c.sec1, c.t20)


@query("check_v18_location_agreement", with_base(
    """SELECT count(*) FILTER (WHERE a.sensor IS DISTINCT FROM b.sensor) AS location_mismatches,
       count(*) AS total_device_windows,
       (SELECT count(*) FROM (SELECT id, w FROM (
          SELECT id, w, strength_sum, max(strength_sum) OVER (PARTITION BY id, w) AS mx FROM t20)
          WHERE strength_sum = mx GROUP BY id, w HAVING count(*) > 1)) AS tied_device_windows
       FROM loc a FULL OUTER JOIN nloc b ON a.id = b.id AND a.w = b.w""", NARROW))
def _(c: Context):
    return c.in_place(quality.location_agreement(c.t20_by_day, c.t20_narrow_by_day), "agreement")


@query("check_v19_sensor_coverage", with_base(
    """SELECT 'dimension_only' AS side, sensor AS sensor_name FROM sensors WHERE sensor IN ('s02', 's11')
       UNION ALL SELECT DISTINCT 'facts_only', sensor FROM t20 WHERE sensor = 's00'"""))
def _(c: Context):
    facts = filters.without_sensors(c.t20, ["s02", "s11"])
    return quality.sensor_coverage(facts, filters.without_sensors(c.sensors, ["s00"]))


@query("check_v19_coordinates", with_base(
    """SELECT sensor AS sensor_name, count(*) AS n FROM t20 WHERE CAST(substr(sensor, 2) AS INT) >= 15 GROUP BY 1"""))
def _(c: Context):
    """Degrees per sensor seen in the facts; the highest rows of the grid fall off the globe."""
    index = F.substring("sensor_name", 2, 2).cast("int")
    seen = c.t20.groupBy("sensor_name").agg(F.count("*").alias("n")).withColumn(
        "longitude", index.cast("double")).withColumn("latitude", F.floor(index / 5) * 31.0)
    return quality.invalid_coordinates(seen).select("sensor_name", "n")


_COUNTS = {
    "null_rows": "u % 17 = 0", "invalid_id_rows": "u % 19 = 0",
    "invalid_detection_rows": "detections NOT BETWEEN 1 AND 20",
    "invalid_formula_rows": "abs(strength_sum - (100.0 * detections + rssi_sum)) > 1e-9",
    "misaligned_timestamp_rows": "u % 7 = 0",
}
_COUNTERS = "SELECT " + "".join(
    f"CAST(coalesce(sum(copies) FILTER (WHERE {rule}), 0) AS BIGINT) AS {name}, " for name, rule in _COUNTS.items()
) + "count(*) FILTER (WHERE copies = 2) AS duplicate_keys FROM planted"


@query("check_v20_data_counters", with_base(_COUNTERS, PLANTED))
def _(c: Context):
    return quality.data_counters(c.t20_planted)


_NAMES = [*_COUNTS, "duplicate_keys"]
_LINES = f"""SELECT check_id, n = 0 AS passed, CAST(n AS VARCHAR) AS evidence FROM (
    SELECT unnest({_NAMES}) AS check_id, unnest([{', '.join(_NAMES)}]) AS n FROM ({_COUNTERS}))"""


@query("check_v21_check_table", with_base(_LINES, PLANTED))
def _(c: Context):
    return quality.counter_checks(quality.data_counters(c.t20_planted))


@query("check_v21_overall", with_base(
    f"""SELECT count(*) AS n_checks, count(*) FILTER (WHERE passed) AS n_passed, bool_and(passed) AS all_passed FROM (
        SELECT passed FROM ({_LINES})
        UNION ALL SELECT (SELECT sum(n) FROM (SELECT count(*) AS n FROM loc GROUP BY w, sensor)) = (SELECT count(*) FROM loc)
        UNION ALL SELECT count(*) = 0 FROM trips WHERE is_od = 1 AND (n < 2 OR origin = destination))""",
    PLANTED, TRIPS))
def _(c: Context):
    checks = quality.counter_checks(quality.data_counters(c.t20_planted))
    return quality.overall(checks.unionByName(_metric_checks(c)))


def _metric_checks(c):
    return quality.metric_checks(c.located, count_sensor_window(c.located), c.trips)


@query("check_v22_metric_checks", with_base(
    """SELECT 'count_total_equals_location_rows' AS check_id, TRUE AS passed,
       count(*) || '/' || count(*) AS evidence FROM loc
       UNION ALL SELECT 'od_rows_have_two_windows_and_two_ends', TRUE, '0/' || count(*) FROM trips WHERE is_od = 1""",
    TRIPS))
def _(c: Context):
    return _metric_checks(c)
