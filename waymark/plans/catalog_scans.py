"""Queries for sources, sinks, filters and projections (S, F)."""

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions import bitmaps
from waymark.functions.timefn import local_date
from waymark.operators import aggregate, count, filters, joins, location
from waymark.operators.quality import ContractError
from waymark.params import MAINTAINED
from waymark.plans import stages
from waymark.plans.context import Context, query
from waymark.plans.oracle import (
    GPS, KST, PLANTED, RAW, RAW_PLANTED, big, day, day_type, hour, r6, utc_text as sql_utc, with_base,
)
from waymark.sources import published, tables
from waymark.streaming import flows, ledger

_PACKET_COUNTS = """
SELECT id AS source_address, sensor AS sensor_name, subtype, count(*) AS n_packets,
       {sum} AS strength_total FROM {rows} GROUP BY 1, 2, 3"""


def _packet_counts(rows):
    return rows.groupBy("source_address", "sensor_name", "subtype").agg(
        F.count("*").alias("n_packets"), F.sum("strength").alias("strength_total"))


def _packet_sql(rows="packets"):
    return with_base(_PACKET_COUNTS.format(sum=big("sum(strength)"), rows=rows))


@query("scan_s1_read_packets", with_base(
    f"""SELECT id AS source_address, sensor AS sensor_name, channel, type, count(*) AS n_packets,
        {big('sum(strength)')} AS strength_total, min(us // 1000) AS first_ms, max(us // 1000) AS last_ms
        FROM packets GROUP BY 1, 2, 3, 4"""))
def _(c: Context):
    p = tables.read_packets(c.spark, c.landed(c.packets_text, "packets"))
    return p.groupBy("source_address", "sensor_name", "channel", "type").agg(
        F.count("*").alias("n_packets"), F.sum("strength").alias("strength_total"),
        F.min(F.unix_millis("timestamp")).alias("first_ms"),
        F.max(F.unix_millis("timestamp")).alias("last_ms"))


@query("scan_s2_many_capture_files", with_base(
    "SELECT sensor AS run, count(*) AS n_packets, count(DISTINCT id) AS n_ids FROM packets GROUP BY 1"))
def _(c: Context):
    """One folder a service run, read together; the file path tells the run."""
    path = c.new_path("runs")
    runs = c.packets_text.withColumn("run", F.col("sensor_name"))
    runs.write.partitionBy("run").parquet(path)
    files = c.spark.read.schema(schemas.PACKETS_RAW).option("recursiveFileLookup", True).parquet(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), "run=([^/]+)", 1)
    return files.groupBy(run.alias("run")).agg(
        F.count("*").alias("n_packets"), F.countDistinct("source_address").alias("n_ids"))


_T20_SUMMARY = with_base(
    f"""SELECT sensor AS sensor_name, count(*) AS n_rows, {big('sum(detections)')} AS detections,
        {r6('sum(rssi_sum)')} AS rssi_sum, {r6('sum(strength_sum)')} AS strength_sum,
        min(w) AS first, max(w) AS last FROM t20 GROUP BY 1""")


def _t20_summary(t20):
    return t20.groupBy("sensor_name").agg(
        F.count("*").alias("n_rows"), F.sum("detections").alias("detections"),
        F.sum("rssi_sum").alias("rssi_sum"), F.sum("strength_sum").alias("strength_sum"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("scan_s3_read_csv_table", _T20_SUMMARY)
def _(c: Context):
    path = c.landed(c.t20, "t20-csv", "csv")
    return _t20_summary(tables.read_table(c.spark, path, schemas.TWENTY_SECOND, "csv"))


@query("scan_s3_read_parquet_table", _T20_SUMMARY)
def _(c: Context):
    return _t20_summary(tables.read_table(c.spark, c.landed(c.t20, "t20"), schemas.TWENTY_SECOND))


@query("sink_s4_write_twenty_second", with_base(
    f"""SELECT w AS timestamp, id AS source_address, sensor AS sensor_name, {r6('rssi_median')} AS rssi_median,
        {r6('rssi_sum')} AS rssi_sum, detections, {r6('strength_sum')} AS strength_sum FROM t20"""))
def _(c: Context):
    return c.spark.read.parquet(c.landed(c.t20, "t20"))


@query("sink_s4_write_by_local_date", with_base(
    f"SELECT {day('w')} AS local_date, count(*) AS n_rows FROM t20 GROUP BY 1"))
def _(c: Context):
    path = c.new_path("t20-by-date")
    tables.write_by_date(c.t20.withColumn("local_date", local_date("timestamp")), path)
    return c.spark.read.parquet(path).groupBy("local_date").agg(F.count("*").alias("n_rows"))


@query("scan_s5_projection_pushdown", """
    SELECT user_id, count(*) AS n, min(epoch_us(ts)) AS first_us FROM events
    WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND user_id <> 3 GROUP BY 1""")
def _(c: Context):
    """Two of six columns and the filter reach the Parquet scan."""
    e = c.table("events").select("ts", "user_id").filter(
        (F.col("ts") >= F.expr("timestamp_ntz'2024-01-08 00:00:00'")) & (F.col("user_id") != 3))
    return tables.attach_utc(e, "ts").groupBy("user_id").agg(
        F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"))


@query("scan_s6_resumable_extraction", _packet_sql("accepted"))
def _(c: Context):
    """Two runs over a growing folder: the second one reads only the files it has not seen."""
    source, out, done = c.new_path("captures"), c.new_path("extracted"), c.new_path("progress")
    early = F.col("timestamp") < "2024-01-16T00:00:00.000Z"
    for part in (c.packets_text.filter(early), c.packets_text.filter(~early)):
        part.write.mode("append").parquet(source)
        stream = flows.read_packets_stream(c.spark, source, schemas.PACKETS_RAW)
        kept = filters.exclude_subtypes(filters.rssi_between(stream))
        flows.run_available(kept, out, done)
    return _packet_counts(c.spark.read.parquet(out))


@query("scan_s6_file_ledger", with_base(
    """SELECT sensor AS run, 1 AS n_files, count(*) AS n_rows, count(*) FILTER (WHERE strength BETWEEN -80 AND -30
         AND lower(subtype) NOT IN ('beacon', 'probe-response')) AS n_kept FROM packets GROUP BY 1"""))
def _(c: Context):
    """The ledger of an extraction whose first run was killed in its second batch, after that batch had written its rows."""
    source, out, done, book = c.new_path("captures"), c.new_path("extracted"), c.new_path("progress"), c.new_path("ledger")
    c.packets_text_by_run.write.partitionBy("run").parquet(source)

    def keep(rows):
        return filters.exclude_subtypes(filters.rssi_between(rows))

    def killed(rows):
        if c.spark.read.parquet(book).count() if published.Files(c.spark, book).exists(book) else 0:
            keep(rows).write.mode("overwrite").parquet(f"{out}/batch=1")
            raise RuntimeError("killed")
        return keep(rows)

    stream = ledger.captures(c.spark, source, schemas.PACKETS_RAW, files_per_batch=6)
    try:
        ledger.extract(stream, killed, out, book, done)
    except StreamingQueryException:
        pass
    ledger.extract(stream, keep, out, book, done)
    run = F.regexp_extract("file", "run=([^/]+)", 1)
    kept = ledger.extracted(c.spark, out, book).groupBy(F.regexp_extract("input_file", "run=([^/]+)", 1).alias("run")).agg(
        F.count("*").alias("n_kept"))
    files = ledger.entries(c.spark, book).groupBy(run.alias("run")).agg(F.count("*").alias("n_files"), F.sum("rows").alias("n_rows"))
    return files.join(kept, "run")


@query("scan_s1_refused_packets", with_base(
    """SELECT rule, count(*) AS n_rows FROM (
         SELECT CASE WHEN t % 97 = 0 THEN 'strength' WHEN t % 89 = 0 THEN 'sensor_name' WHEN t % 83 = 0 THEN 'timestamp'
                     WHEN t % 79 = 0 THEN 'subtype' WHEN t % 73 = 0 THEN 'channel' END AS rule FROM packets)
       WHERE rule IS NOT NULL GROUP BY 1"""))
def _(c: Context):
    """Planted NULLs in required columns stop the publication of the one-second table, in the pass that aggregates it. The NULL
    strengths would fail the range filter, and still are seen."""
    t = F.unix_seconds(F.to_timestamp("timestamp"))
    plants = (("strength", 97), ("sensor_name", 89), ("timestamp", 83), ("subtype", 79), ("channel", 73))
    free, columns = F.lit(True), {}
    for name, n in plants:
        columns[name] = F.when(free & (t % n == 0), None).otherwise(F.col(name))
        free = free & (t % n != 0)
    path, target = c.landed(c.packets_text.withColumns(columns), "packets-nulls"), c.new_path("one-second")
    packets, watch = published.read_checked_packets(c.spark, path)
    try:
        published.publish(aggregate.one_second(packets), target, watches=[watch])
    except ContractError:
        pass
    if published.Files(c.spark, target).exists(f"{target}/{published.CURRENT}"):
        raise AssertionError("a table with refused rows was published")
    return c.spark.createDataFrame(sorted(published.broken(watch).items()), "rule string, n_rows long")


@query("sink_s4_published_versions", _T20_SUMMARY)
def _(c: Context):
    """Published twice; then a third write fails in mid-job, and a fourth is refused by a rule: the second version stays."""
    path = c.new_path("t20-published")
    published.publish(c.t20.filter("detections > 3"), path)
    published.publish(c.t20, path, published.required(c.t20.columns))
    failing = c.t20.withColumn("detections", F.when(F.col("sensor_name") == "s05", F.raise_error(F.lit("lost"))).otherwise(F.col("detections")))
    empty = c.t20.withColumn("rssi_sum", F.when(F.col("sensor_name") != "s05", F.col("rssi_sum")))
    for rows in (failing, empty):
        try:
            published.publish(rows, path, published.required(c.t20.columns))
        except (ContractError, PySparkException):
            continue
        raise AssertionError("a broken version was published")
    return _t20_summary(published.read_published(c.spark, path))


@query("scan_s7_attach_utc", "SELECT event_id, epoch_us(ts) AS us FROM events")
def _(c: Context):
    return tables.attach_utc(c.table("events"), "ts").select("event_id", F.unix_micros("ts").alias("us"))


@query("scan_s8_sensor_dimension", with_base(
    f"""SELECT s.sensor AS sensor_name, x, y, count(t.id) AS n_rows, 0 AS n_invalid
        FROM sensors s LEFT JOIN t20 t ON s.sensor = t.sensor GROUP BY 1, 2, 3"""))
def _(c: Context):
    path = c.landed(c.sensors, "sensors", "csv")
    dim = tables.read_table(c.spark, path, schemas.SENSORS, "csv")
    invalid = tables.checked_sensors(dim).agg(F.count("*")).scalar()
    rows = c.t20.groupBy("sensor_name").agg(F.count("*").alias("n_rows"))
    return dim.select("sensor_name", "x", "y").join(rows, "sensor_name", "left").fillna(
        0, ["n_rows"]).withColumn("n_invalid", invalid)


@query("scan_s9_read_gps", with_base(
    f"""SELECT id AS source_address, count(*) AS n, min(t) AS first, max(t) AS last,
        {r6('sum(x)')} AS sum_x, {r6('sum(y)')} AS sum_y FROM gps GROUP BY 1""", GPS))
def _(c: Context):
    fixes = tables.read_gps(c.spark, c.landed(c.gps.select(*schemas.GPS.names), "gps", "csv"))
    return fixes.groupBy("source_address").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("scan_s10_restore_strength", _T20_SUMMARY)
def _(c: Context):
    return _t20_summary(location.restore_strength(tables.slim(c.t20)))


@query("scan_s11_slim_report", with_base(
    f"""SELECT {big('sum(copies)')} AS n_rows,
        {r6('max(abs(strength_sum - (100 * detections + rssi_sum)))')} AS max_deviation,
        {big("""sum(CASE WHEN u % 7 = 0 OR u % 11 = 0 OR u % 17 = 0 OR u % 19 = 0 THEN copies + 1
                    ELSE copies - 1 END)""")} AS n_differences FROM planted""", PLANTED))
def _(c: Context):
    """A table with planted defects against the slim form of the sound one."""
    public = c.landed_by_day(tables.slim(c.t20_by_day), "slim")
    apart = joins.multiset_difference(tables.slim(c.t20_planted_by_day), public).agg(F.count("*")).scalar()
    return tables.slim_report(c.t20_planted).withColumn("n_differences", apart)


@query("scan_s12_local_week", with_base(
    f"""SELECT id AS source_address, count(*) AS n_rows, min(w) AS first, max(w) AS last FROM t20
        WHERE w + {KST} >= epoch(TIMESTAMP '2024-01-08 00:00:00')
          AND w + {KST} < epoch(TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1"""))
def _(c: Context):
    week = filters.local_period(c.t20, "2024-01-08 00:00:00", "2024-01-15 00:00:00")
    return week.groupBy("source_address").agg(
        F.count("*").alias("n_rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("sink_s13_metric_csv", with_base(
    f"""SELECT {sql_utc('w')} AS timestamp_utc, id AS source_address, sensor AS sensor_name, {r6('x')} AS x,
        {r6('y')} AS y, {r6('strength_sum')} AS strength_sum, detections FROM loc"""))
def _(c: Context):
    path = c.landed(stages.location_table(c.located), "location", "csv")
    kinds = "timestamp_utc string, source_address string, sensor_name string, x double, y double, " \
            "strength_sum double, detections long"
    return c.spark.read.option("header", True).schema(kinds).csv(path)


def _manifest_sql(site, where):
    return f"""SELECT '{site}' AS site, count(*) AS n_records, count(DISTINCT id) AS n_devices,
        count(DISTINCT sensor) AS n_sensors, {sql_utc('min(w)')} AS start_utc,
        {sql_utc('max(w)')} AS end_utc, {big('sum(detections)')} AS total_detections,
        count(*) FILTER (WHERE detections NOT BETWEEN 1 AND 20) AS invalid_detections,
        count(*) FILTER (WHERE abs(strength_sum - (100 * detections + rssi_sum)) > 1e-9) AS invalid_strength
        FROM t20 WHERE {where}"""


@query("scan_s14_dataset_manifest", with_base(
    _manifest_sql("full", "TRUE") + " UNION ALL " + _manifest_sql("without_s00", "sensor <> 's00'")))
def _(c: Context):
    """The second dataset comes in two runs: the parts and devices of later days are added to those of the first."""
    rows, stage = filters.without_sensors(c.t20, ["s00"]), c.stage()
    early = F.col("timestamp") < "2024-01-11T00:00:00.000Z"
    sensors = stage(bitmaps.small_dictionary(rows.select("sensor_name")), "sensors")
    devices = stage(bitmaps.numbered(rows.filter(early).select("source_address")), "devices-0")
    counters, maps = (stage(df, f"{name}-0") for df, name in zip(
        tables.manifest_parts(rows.filter(early), devices, sensors), ("counters", "bitmaps")))
    later = rows.filter(~early)
    devices = devices.unionByName(stage(bitmaps.numbered(bitmaps.unknown(later.select("source_address"), devices), run=1), "devices-1"))
    more = tables.manifest_parts(later, devices, sensors)
    return tables.dataset_manifest(c.t20, "full", c.stage()).unionByName(tables.manifest_of_parts(
        counters.unionByName(more[0]), maps.unionByName(more[1]), "without_s00"))


@query("scan_s15_run_manifest", with_base(
    """SELECT 'location' AS "table", count(*) AS n_rows, '{"track_gap_seconds": 1800}' AS parameters FROM loc
       UNION ALL SELECT 'count', count(*), '{"track_gap_seconds": 1800}' FROM
         (SELECT DISTINCT w, sensor FROM loc)"""))
def _(c: Context):
    return tables.run_manifest(
        {"location": c.located, "count": count.count_sensor_window(c.located)},
        {"track_gap_seconds": MAINTAINED.track_gap_seconds})


# Filters ---------------------------------------------------------------------------------

@query("filter_f1_rssi_range", with_base(_PACKET_COUNTS.format(
    sum=big("sum(strength)"), rows="(SELECT * FROM packets WHERE strength >= -80 AND strength <= -30)")))
def _(c: Context):
    return _packet_counts(filters.rssi_between(c.packets))


@query("filter_f2_exclude_subtypes", with_base(_PACKET_COUNTS.format(
    sum=big("sum(strength)"),
    rows="(SELECT * FROM packets WHERE subtype NOT IN ('beacon', 'probe-response'))")))
def _(c: Context):
    return _packet_counts(filters.exclude_subtypes(c.packets, (" Beacon", "PROBE-response")))


@query("filter_f3_period_half_open", with_base(_PACKET_COUNTS.format(
    sum=big("sum(strength)"), rows="""(SELECT * FROM packets WHERE
        us >= epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND us < epoch_us(TIMESTAMP '2024-01-12 00:00:00'))""")))
def _(c: Context):
    return _packet_counts(filters.period(c.packets, "2024-01-05 00:00:00", "2024-01-12 00:00:00"))


@query("filter_f3_period_closed", with_base(
    """SELECT sensor AS sensor_name, count(*) AS n FROM t20 WHERE
       w BETWEEN epoch(TIMESTAMP '2024-01-05 00:00:00') AND epoch(TIMESTAMP '2024-01-12 00:00:00') GROUP BY 1"""))
def _(c: Context):
    rows = filters.period(c.t20, "2024-01-05 00:00:00", "2024-01-12 00:00:00", closed=True)
    return rows.groupBy("sensor_name").agg(F.count("*").alias("n"))


def _raw_counts(rows):
    return rows.groupBy("source_address", "site").agg(
        F.count("*").alias("n"), F.sum("rssi").alias("rssi_total"))


def _raw_sql(rows, raw=RAW):
    return with_base(f"""SELECT address AS source_address, site, count(*) AS n,
        {big('sum(rssi)')} AS rssi_total FROM {rows} GROUP BY 1, 2""", raw)


@query("filter_f4_invalid_addresses", _raw_sql("valid"))
def _(c: Context):
    return _raw_counts(filters.drop_invalid_addresses(c.raw))


@query("filter_f5_rssi_sentinels", _raw_sql("(SELECT * FROM raw WHERE rssi > -100 AND rssi < 0)"))
def _(c: Context):
    return _raw_counts(filters.drop_rssi_sentinels(c.raw))


@query("filter_f6_locally_administered", with_base(
    "SELECT DISTINCT address AS source_address, rnd AS is_random FROM valid", RAW))
def _(c: Context):
    ids = filters.drop_invalid_addresses(c.raw).select("source_address").distinct()
    return ids.withColumn("is_random", filters.locally_administered("source_address"))


@query("filter_f7_unflagged", with_base(
    "SELECT id AS source_address, count(*) AS n FROM sec1 WHERE flag = 0 GROUP BY 1"))
def _(c: Context):
    return filters.keep_unflagged(c.sec1).groupBy("source_address").agg(F.count("*").alias("n"))


@query("filter_f8_rare_identifiers", _raw_sql(
    """(SELECT * FROM valid WHERE address IN
        (SELECT address FROM valid GROUP BY 1 HAVING count(*) >= 5))""", RAW_PLANTED))
def _(c: Context):
    return _raw_counts(filters.drop_rare(filters.drop_invalid_addresses(c.raw_planted)))


@query("filter_f9_sensors", with_base(
    """SELECT sensor AS sensor_name, count(*) AS n FROM t20
       WHERE sensor IN ('s01', 's02', 's03', 's05') AND sensor <> 's05' GROUP BY 1"""))
def _(c: Context):
    rows = filters.without_sensors(filters.only_sensors(c.t20, ["s01", "s02", "s03", "s05"]), ["s05"])
    return rows.groupBy("sensor_name").agg(F.count("*").alias("n"))


# For the list of identifiers, nights are thinned to a few for each, so that the default tells them apart.
_FEW = f"(SELECT * FROM loc WHERE {hour('w')} > 4 OR ((w + {KST}) // 86400 * 7 + ascii(substr(id, 1, 1))) % 5 = 0)"


def _night(rows: str) -> str:
    return f"""(SELECT id, count(DISTINCT (w + {KST}) // 86400) AS night_days FROM {rows}
              WHERE {hour('w')} <= 4 GROUP BY id HAVING count(DISTINCT (w + {KST}) // 86400) >= 3)"""


def _few_nights(c):
    here = F.unix_seconds("timestamp") + KST
    few = (F.floor(here / 86400) * 7 + F.ascii(F.substring("source_address", 1, 1))) % 5 == 0
    return c.located.filter((F.floor(here / 3600) % 24 > 4) | few)


@query("filter_f10_night_persistence", with_base(
    f"""SELECT id AS source_address, count(*) AS n FROM loc
        WHERE id NOT IN (SELECT id FROM {_night('loc')}) GROUP BY 1"""))
def _(c: Context):
    kept = filters.drop_night_persistent(c.located)
    return kept.groupBy("source_address").agg(F.count("*").alias("n"))


@query("filter_f10_night_persistent_ids", with_base(
    f"SELECT id AS source_address, night_days FROM {_night(_FEW)}"))
def _(c: Context):
    return filters.night_persistent(_few_nights(c))


UPTIME_SQL = f""",
slots AS (SELECT sensor, (w + {KST}) // 86400 AS d, count(DISTINCT w // 1800) AS n_slots FROM loc GROUP BY 1, 2),
uptime AS (
  SELECT g.sensor, g.d, coalesce(n_slots, 0) AS n_slots,
         round_even(coalesce(n_slots, 0) / (SELECT CAST(max(n_slots) AS DOUBLE) FROM slots), 2) AS coverage
  FROM (SELECT sensor, d FROM sensors, (SELECT DISTINCT d FROM slots)) g
  LEFT JOIN slots USING (sensor, d)),
valid_days AS (
  SELECT d, count(*) AS n_sensors, count(*) FILTER (WHERE coverage >= 0.5) AS n_healthy,
         round_even(count(*) FILTER (WHERE coverage >= 0.5) * 100.0 / count(*), 1) AS pct_healthy
  FROM uptime GROUP BY d)"""


# Some sensors are silent on every fourth day: five of 17 on the second, three of 17 on the fourth of four.
_SILENT = f""",
heard AS (
  SELECT * FROM loc WHERE NOT (((w + {KST}) // 86400 % 4 = 1 AND CAST(substr(sensor, 2) AS INT) % 4 = 0)
                               OR ((w + {KST}) // 86400 % 4 = 3 AND CAST(substr(sensor, 2) AS INT) % 8 = 0)))"""


def _heard(c):
    day, number = F.floor((F.unix_seconds("timestamp") + KST) / 86400) % 4, F.substring("sensor_name", 2, 2).cast("int")
    return c.located.filter(~(((day == 1) & (number % 4 == 0)) | ((day == 3) & (number % 8 == 0))))


_VALID_ROWS = f"""SELECT id AS source_address, count(*) AS n FROM loc
        WHERE (w + {KST}) // 86400 IN (SELECT d FROM valid_days WHERE pct_healthy >= 80) GROUP BY 1"""


@query("filter_f11_valid_days", with_base(_VALID_ROWS, UPTIME_SQL))
def _(c: Context):
    dates = count.valid_dates(count.sensor_uptime(c.located, c.sensors))
    kept = filters.keep_dates(c.located, dates)
    return kept.groupBy("source_address").agg(F.count("*").alias("n"))


@query("filter_f11_pruned_dates", with_base(
    _VALID_ROWS.replace("FROM loc", "FROM heard"), _SILENT, UPTIME_SQL.replace("FROM loc GROUP BY", "FROM heard GROUP BY")))
def _(c: Context):
    """The same with silent sensors, from a table written by local date: the valid dates prune its folders while the query runs."""
    path = c.new_path("located-by-date")
    tables.write_by_date(_heard(c).withColumn("local_date", local_date("timestamp")), path)
    days = tables.day_table(c.spark, c.new_path("days"), count.valid_days(count.sensor_uptime(_heard(c), c.sensors)))
    kept = filters.keep_folders(c.spark.read.parquet(path), days.filter("pct_healthy >= 80"))
    return kept.groupBy("source_address").agg(F.count("*").alias("n"))


def _case(names):
    return " ".join(f"WHEN {n} THEN '{text}'" for n, text in names.items())


@query("filter_f12_frames", f"""
    WITH f AS (
      SELECT event_id, epoch_us(ts) // 1000000 AS t, event_id % 3 AS ft, event_id % 16 AS fs,
             event_id // 3 % 3 AS to_ds, event_id // 7 % 2 AS from_ds,
             CASE WHEN event_id % 29 = 0 THEN NULL ELSE -(event_id % 140) END AS strength FROM events)
    SELECT event_id, t AS timestamp, strength, CASE WHEN ft = 0 THEN 'management' ELSE 'data' END AS type,
           CASE WHEN ft = 0 THEN CASE fs {_case(filters.MANAGEMENT_SUBTYPES)} ELSE 'unknown-' || fs END
                ELSE CASE fs {_case(filters.DATA_SUBTYPES)} ELSE 'unknown-' || fs END END AS subtype
    FROM f WHERE strength BETWEEN -127 AND 0
      AND ((ft = 0 AND fs <> 8) OR (ft = 2 AND from_ds = 0 AND to_ds IN (0, 1)))""")
def _(c: Context):
    return filters.accept_frames(c.frames)


@query("filter_f13_sensor_labels", with_base(
    "SELECT sensor AS sensor_name, count(*) AS n FROM packets GROUP BY 1"))
def _(c: Context):
    labelled = c.packets.withColumn(
        "label", F.concat("sensor_name", F.lit(" (floor "), F.col("channel").cast("string"), F.lit(")")))
    return labelled.groupBy(filters.plain_sensor_label("label").alias("sensor_name")).agg(
        F.count("*").alias("n"))


@query("filter_f14_wall_clock_to_utc", f"SELECT event_id, epoch_us(ts) - CAST({KST} AS BIGINT) * 1000000 AS us FROM events")
def _(c: Context):
    wall = tables.attach_utc(c.table("events"), "ts")
    return filters.to_utc(wall, "ts").select("event_id", F.unix_micros("ts").alias("us"))


@query("filter_f15_calendar", with_base(
    f"""SELECT {day('w')} AS local_date, {hour('w')} AS local_hour,
        (w + {KST}) // 3600 * 3600 AS hour_start, {day_type('w')} AS day_type, count(*) AS n
        FROM t20 GROUP BY 1, 2, 3, 4"""))
def _(c: Context):
    return filters.calendar(c.t20).groupBy("local_date", "local_hour", "hour_start", "day_type").agg(
        F.count("*").alias("n"))
