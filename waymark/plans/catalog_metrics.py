"""Queries for Location, Count, Track, Revisits, Activities and cleaning (L, N, T, R, A, C)."""

import uuid

from pyspark.sql import functions as F

from waymark.functions.islands import UTC_DAY
from waymark.operators import activities as act
from waymark.operators import cleaning, count, filters, joins, location, revisits, track
from waymark.params import CAMPUS, DISTRICT, MAINTAINED
from waymark.plans import stages
from waymark.plans.catalog_scans import UPTIME_SQL
from waymark.plans.context import Context, query
from waymark.plans.oracle import (
    BANDS, EPISODES, GPS, KST, PLANTED_BANDS, RAW_PLANTED, TRIPS, VISITS, WHOLE_BANDS, big, day, day_type, episodes, hour,
    r6, utc_text, with_base,
)
from waymark.sources import tables

# Location --------------------------------------------------------------------------------


@query("location_l1_proximity", with_base(
    f"""SELECT w AS timestamp, id AS source_address, sensor AS sensor_name, {r6('x')} AS x, {r6('y')} AS y,
        {r6('strength_sum')} AS strength_sum, detections FROM loc"""))
def _(c: Context):
    return location.locate_proximity(c.t20_by_day, c.sensors).drop(UTC_DAY)


GT_SQL = GPS + """,
gt AS (SELECT t, id, sensor, strength AS rssi FROM packets
       WHERE id IN (SELECT id FROM gps) AND strength > -100 AND strength < 0),
ws AS (SELECT id, width, t // width * width AS w0, sensor, CAST(sum(100 + rssi) AS BIGINT) AS s
       FROM gt, (SELECT unnest([1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120]) AS width)
       GROUP BY 1, 2, 3, 4),
est AS (
  SELECT id, width, w0, w0 + width / 2.0 AS mid, first(x ORDER BY s DESC, a.sensor) AS px,
         first(y ORDER BY s DESC, a.sensor) AS py, avg(x) AS cx, avg(y) AS cy,
         sum(x * s) / sum(s) AS wx, sum(y * s) / sum(s) AS wy
  FROM ws a JOIN sensors b ON a.sensor = b.sensor GROUP BY id, width, w0),
fix AS (SELECT id, t, min({'x': x, 'y': y}) AS p FROM gps GROUP BY id, t),
matched AS (
  SELECT id, width, w0, mid, px, py, cx, cy, wx, wy, arg_min(t, (abs(t - mid), t)) AS ft,
         arg_min(p, (abs(t - mid), t)) AS p
  FROM (SELECT e.*, f.t, f.p FROM est e JOIN (
          SELECT id, t, p, unnest([t // 60 - 1, t // 60, t // 60 + 1]) AS bucket FROM fix) f
        ON e.id = f.id AND CAST(floor(e.mid / 60) AS BIGINT) = f.bucket
        WHERE abs(f.t - e.mid) <= e.width / 2.0)
  GROUP BY id, width, w0, mid, px, py, cx, cy, wx, wy),
err AS (
  SELECT id, width, w0, 'Proximity' AS method, px AS ex, py AS ey, ft, p FROM matched
  UNION ALL SELECT id, width, w0, 'Centroid', cx, cy, ft, p FROM matched
  UNION ALL SELECT id, width, w0, 'Wcentroid', wx, wy, ft, p FROM matched),
errors AS (SELECT *, sqrt((ex - p.x) * (ex - p.x) + (ey - p.y) * (ey - p.y)) AS error FROM err)"""


@query("location_l2_window_strength", with_base(
    "SELECT id AS source_address, width, w0 AS window_start, sensor AS sensor_name, s AS strength_sum "
    "FROM ws WHERE width IN (20, 60)", GT_SQL))
def _(c: Context):
    return location.window_strength(c.located_raw, (20, 60)).drop("midpoint", UTC_DAY)


def _estimates(c, widths):
    return location.estimates(location.window_strength(c.located_raw, widths), c.sensors)


@query("location_l3_centroid", with_base(
    f"SELECT id AS source_address, w0 AS window_start, {r6('cx')} AS x_est, {r6('cy')} AS y_est "
    "FROM est WHERE width = 20", GT_SQL))
def _(c: Context):
    return _estimates(c, (20,)).select(
        "source_address", "window_start", F.col("cx").alias("x_est"), F.col("cy").alias("y_est"))


@query("location_l4_weighted_centroid", with_base(
    f"SELECT id AS source_address, w0 AS window_start, {r6('wx')} AS x_est, {r6('wy')} AS y_est "
    "FROM est WHERE width = 20", GT_SQL))
def _(c: Context):
    return _estimates(c, (20,)).select(
        "source_address", "window_start", F.col("wx").alias("x_est"), F.col("wy").alias("y_est"))


@query("location_l5_error", with_base(
    f"""SELECT id AS source_address, width, w0 AS window_start, method, {r6('ex')} AS x_est, {r6('ey')} AS y_est,
        {r6('ft')} AS matched_time, {r6('error')} AS error FROM errors WHERE width = 20""", GT_SQL))
def _(c: Context):
    errors = location.location_error(_estimates(c, (20,)), c.gps, 20)
    return errors.select("source_address", "width", "window_start", "method", "x_est", "y_est",
                         "matched_time", "error")


_SUMMARY = f"""SELECT method, width, {r6('median(error)')} AS median_error,
    {r6('quantile_cont(error, 0.25)')} AS q25, {r6('quantile_cont(error, 0.75)')} AS q75,
    {r6('avg(error)')} AS mean_error, count(*) AS n FROM errors {{}} GROUP BY 1, 2"""


@query("location_l6_error_summary", with_base(_SUMMARY.format("WHERE width = 20"), GT_SQL))
def _(c: Context):
    return location.error_summary(location.location_error(_estimates(c, (20,)), c.gps, 20))


@query("location_l7_error_sweep", with_base(_SUMMARY.format(""), GT_SQL))
def _(c: Context):
    return location.error_summary(
        location.location_error(_estimates(c, location.SWEEP_WIDTHS), c.gps))


@query("location_l8_ground_truth", with_base(
    """SELECT id AS source_address, count(*) AS n,
       CAST(id = (SELECT id FROM packets WHERE id IN (SELECT id FROM gps) GROUP BY id
                  ORDER BY count(*) DESC, id LIMIT 1) AS BIGINT) AS is_best
       FROM packets WHERE id IN (SELECT id FROM gps) GROUP BY 1""", GPS))
def _(c: Context):
    best = location.best_covered_identifier(c.located_raw).select("source_address", F.lit(1).alias("b"))
    return c.located_raw.groupBy("source_address").agg(F.count("*").alias("n")).join(
        best, "source_address", "left").select(
        "source_address", "n", F.coalesce("b", F.lit(0)).alias("is_best"))


# Count -----------------------------------------------------------------------------------

@query("count_n1_sensor_window", with_base(
    f"""SELECT {utc_text('w')} AS timestamp_utc, sensor AS sensor_name,
        count(DISTINCT id) AS n_retained_identifiers FROM loc GROUP BY 1, 2"""))
def _(c: Context):
    return stages.count_table(count.count_sensor_window(c.located))


HOURLY = f""",
hourly AS (SELECT (w + {KST}) // 3600 * 3600 AS h, {day_type('w')} AS day_type,
                  count(DISTINCT id) AS n FROM t20 GROUP BY 1, 2),
pattern AS (SELECT h // 3600 % 24 AS hour_of_day, day_type, avg(n) AS mean_devices,
                   stddev_samp(n) AS sd_devices FROM hourly GROUP BY 1, 2)"""


@query("count_n2_hourly_counts", with_base(
    "SELECT h AS hour_start, day_type, n AS n_devices FROM hourly", HOURLY))
def _(c: Context):
    return count.hourly_counts(c.t20)


@query("count_n3_hourly_pattern", with_base(
    f"SELECT hour_of_day, day_type, {r6('mean_devices')} AS mean_devices, {r6('sd_devices')} AS sd_devices "
    "FROM pattern", HOURLY))
def _(c: Context):
    return count.hourly_pattern(c.t20)


@query("count_n4_daily_hourly", with_base(
    f"""SELECT {day('w')} AS local_date, {hour('w')} AS hour_of_day, count(DISTINCT id) AS n_devices
        FROM t20 GROUP BY 1, 2"""))
def _(c: Context):
    return count.daily_hourly_counts(c.t20)


@query("count_n5_midday_sensor_counts", with_base(
    f"""SELECT t.sensor AS sensor_name, {day_type('w')} AS day_type, count(DISTINCT id) AS n_devices,
        any_value({r6('x')}) AS x, any_value({r6('y')}) AS y FROM t20 t JOIN sensors s ON t.sensor = s.sensor
        WHERE {hour('w')} BETWEEN 11 AND 14 GROUP BY 1, 2"""))
def _(c: Context):
    return count.sensor_counts(c.t20, c.sensors)


@query("count_n6_peak_hour", with_base(
    f"""SELECT day_type, hour_of_day AS peak_hour, {r6('mean_devices')} AS peak_devices FROM (
        SELECT *, row_number() OVER (PARTITION BY day_type ORDER BY mean_devices DESC, hour_of_day) AS rn
        FROM pattern) WHERE rn = 1""", HOURLY))
def _(c: Context):
    return count.peak_hour(count.hourly_pattern(c.t20))


@query("count_n7_weekend_weekday_ratio", with_base(
    f"""SELECT sensor AS sensor_name, any_value(total) AS total,
        {r6("max(m) FILTER (WHERE day_type = 'Weekday')")} AS weekday,
        {r6("max(m) FILTER (WHERE day_type = 'Weekend')")} AS weekend,
        {r6("max(m) FILTER (WHERE day_type = 'Weekend') / max(m) FILTER (WHERE day_type = 'Weekday')")} AS ratio
        FROM (SELECT sensor, day_type, avg(n) AS m FROM (
                SELECT sensor, {day_type('w', 0)} AS day_type, w // 86400 AS d, count(DISTINCT id) AS n
                FROM t20 WHERE w // 3600 % 24 BETWEEN 11 AND 14 GROUP BY 1, 2, 3) GROUP BY 1, 2)
        JOIN (SELECT sensor, count(DISTINCT id) AS total FROM t20
              WHERE w // 3600 % 24 BETWEEN 11 AND 14 GROUP BY 1) USING (sensor) GROUP BY 1"""))
def _(c: Context):
    return count.weekend_weekday_ratio(c.t20)


@query("count_n8_trips_per_day", with_base(
    f"""SELECT day_type, n_trips, n_days, {r6('n_trips / n_days')} AS trips_per_day FROM
        (SELECT {day_type('t0', 0)} AS day_type, count(*) AS n_trips FROM trips WHERE is_od = 1 GROUP BY 1)
        JOIN (SELECT {day_type('w', 0)} AS day_type, count(DISTINCT w // 86400) AS n_days FROM loc GROUP BY 1)
        USING (day_type)""", TRIPS))
def _(c: Context):
    return count.trips_per_day(c.od_trips, c.located)


DAILY = """,
daily AS (SELECT sensor, t // 86400 AS d, count(*) AS n FROM sec1 GROUP BY 1, 2)"""


@query("count_n9_availability_daily", with_base(
    "SELECT sensor AS sensor_name, strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS date, "
    "n AS detections FROM daily", DAILY))
def _(c: Context):
    return count.sensor_daily(c.sec1)


@query("count_n9_availability_4h", with_base(
    "SELECT sensor AS sensor_name, t // 14400 * 14400 AS bin_epoch, count(*) AS detections FROM sec1 GROUP BY 1, 2"))
def _(c: Context):
    return count.sensor_four_hourly(c.sec1)


@query("count_n9_availability_summary", with_base(
    f"""SELECT sensor AS sensor_name, count(*) AS days_active,
        strftime(make_timestamp(min(d) * 86400000000), '%Y-%m-%d') AS first_date,
        strftime(make_timestamp(max(d) * 86400000000), '%Y-%m-%d') AS last_date,
        {big('sum(n)')} AS total_detections, {r6('avg(n)')} AS avg_daily FROM daily GROUP BY 1""", DAILY))
def _(c: Context):
    return count.sensor_summary(count.sensor_daily(c.sec1))


@query("count_n10_sensor_uptime", with_base(
    f"""SELECT sensor AS sensor_name, {day(f'(d * 86400 - {KST})')} AS local_date, n_slots,
        {r6('coverage')} AS coverage, CASE WHEN coverage >= 0.5 THEN 1 ELSE 0 END AS healthy FROM uptime""",
    UPTIME_SQL))
def _(c: Context):
    return count.sensor_uptime(c.located, c.sensors)


@query("count_n11_valid_days", with_base(
    f"""SELECT {day(f'(d * 86400 - {KST})')} AS local_date, n_sensors, n_healthy,
        {r6('pct_healthy')} AS pct_healthy FROM valid_days""", UPTIME_SQL))
def _(c: Context):
    return count.valid_days(count.sensor_uptime(c.located, c.sensors))


# Track -----------------------------------------------------------------------------------

@query("track_t1_split_trajectories", with_base(
    f"""SELECT w AS timestamp, id AS source_address, sensor AS sensor_name, {big('tid')} AS trajectory_id
        FROM trips_rows""", TRIPS))
def _(c: Context):
    return track.split_trajectories(c.located_by_day, 1800).select(
        "timestamp", "source_address", "sensor_name", "trajectory_id")


@query("track_t1_from_buckets", with_base(
    f"""SELECT w AS timestamp, id AS source_address, sensor AS sensor_name, {big('tid')} AS trajectory_id
        FROM trips_rows""", TRIPS))
def _(c: Context):
    """From the table laid out by identifier and day: only day summaries are exchanged."""
    return track.split_trajectories(c.located_by_day, 1800).select(
        "timestamp", "source_address", "sensor_name", "trajectory_id")


_TRACK = f"""SELECT id AS source_address, tid AS trajectory_id, {utc_text('t0')} AS start_utc,
    {utc_text('t1')} AS end_utc, dur AS duration_seconds, n AS n_windows, origin, destination, is_od FROM """


@query("track_t2_trajectory_summary", with_base(_TRACK + "trips", TRIPS))
def _(c: Context):
    return stages.track_table(c.trips)


@query("track_t2_visit_summary", with_base(_TRACK + "visits", VISITS))
def _(c: Context):
    return stages.track_table(c.visits)


OD = ",\nod AS (SELECT * FROM trips WHERE is_od = 1)"


@query("track_t3_od_matrix", with_base(
    """SELECT origin, destination, count(*) AS n_trajectories,
       count(DISTINCT id) AS n_retained_identifiers FROM od GROUP BY 1, 2""", TRIPS, OD))
def _(c: Context):
    return track.od_matrix(c.trips)


FLOWS = OD + """,
flows AS (SELECT origin, destination, count(*) AS n_segments FROM od GROUP BY 1, 2)"""


@query("track_t4_od_probability", with_base(
    f"""SELECT *, {r6('n_segments / total_from')} AS prob FROM (
        SELECT *, {big('sum(n_segments) OVER (PARTITION BY origin)')} AS total_from FROM flows)""", TRIPS, FLOWS))
def _(c: Context):
    return track.od_probability(c.od_trips)


@query("track_t5_od_by_day_type", with_base(
    f"""SELECT origin, destination, {day_type('t0')} AS day_type, count(*) AS n_segments
        FROM od GROUP BY 1, 2, 3""", TRIPS, OD))
def _(c: Context):
    return track.od_by_day_type(c.od_trips)


PERIODS = OD + f""",
periods AS (SELECT origin, destination, time_period, count(*) AS n_segments FROM (
  SELECT *, CASE WHEN {hour('t0')} BETWEEN 7 AND 9 THEN 'Morning (7-10)'
                 WHEN {hour('t0')} BETWEEN 17 AND 19 THEN 'Evening (17-20)' END AS time_period
  FROM od WHERE {day_type('t0')} = 'Weekday') WHERE time_period IS NOT NULL GROUP BY 1, 2, 3)"""


@query("track_t6_od_by_period", with_base("SELECT * FROM periods", TRIPS, PERIODS))
def _(c: Context):
    return track.od_by_period(c.od_trips)


@query("track_t7_od_top", with_base(
    """SELECT origin, destination, n_segments FROM (
       SELECT *, rank() OVER (ORDER BY n_segments DESC) AS r FROM flows) WHERE r <= 5""", TRIPS, FLOWS))
def _(c: Context):
    flows = c.od_trips.groupBy("origin", "destination").agg(F.count("*").alias("n_segments"))
    return track.od_top(flows, 5)


@query("track_t7_od_top_by_period", with_base(
    """SELECT origin, destination, time_period, n_segments FROM (
       SELECT *, rank() OVER (PARTITION BY time_period ORDER BY n_segments DESC) AS r FROM periods)
       WHERE r <= 7""", TRIPS, PERIODS))
def _(c: Context):
    return track.od_top(track.od_by_period(c.od_trips), 7, ["time_period"])


@query("track_t8_od_edges", with_base(
    f"""SELECT origin, destination, n_segments, {r6('o.x')} AS x_origin, {r6('o.y')} AS y_origin,
        {r6('d.x')} AS x_destination, {r6('d.y')} AS y_destination
        FROM flows JOIN sensors o ON o.sensor = origin JOIN sensors d ON d.sensor = destination""",
    TRIPS, FLOWS))
def _(c: Context):
    flows = c.od_trips.groupBy("origin", "destination").agg(F.count("*").alias("n_segments"))
    return joins.with_coordinates(flows, c.sensors)


@query("track_t9_od_by_band", with_base(
    """SELECT observed_day_band, origin, destination, n_segments, origin || ' -> ' || destination AS route FROM (
       SELECT band AS observed_day_band, origin, destination, count(*) AS n_segments,
              rank() OVER (PARTITION BY band ORDER BY count(*) DESC) AS r
       FROM od JOIN bands USING (id) GROUP BY 1, 2, 3) WHERE r <= 7""", TRIPS, OD, BANDS))
def _(c: Context):
    return track.od_by_band(c.located, c.bands)


# Revisits --------------------------------------------------------------------------------

def _revisits_sql(date: str) -> str:
    return with_base(
        f"""SELECT source_address, n_qualifying_trajectories, len(ds) AS n_observed_local_dates,
            array_to_string(ds, ';') AS observed_local_dates, ds[1] AS first_local_date,
            ds[len(ds)] AS last_local_date,
            CASE WHEN len(ds) = 1 THEN 'Single-day observed' ELSE 'Multi-day observed' END AS revisit_class
            FROM (SELECT r.id AS source_address, count(DISTINCT r.tid) AS n_qualifying_trajectories,
                  list_sort(list(DISTINCT {date})) AS ds FROM visits_rows r
                  JOIN (SELECT id, tid FROM visits WHERE n >= 2) v ON r.id = v.id AND r.tid = v.tid GROUP BY r.id)""",
        VISITS)


@query("revisit_r1_revisits", _revisits_sql(day("w")))
def _(c: Context):
    return revisits.revisits(c.located)


# all events lie in January, when New York is five hours behind
@query("revisit_r1_new_york", _revisits_sql("strftime(make_timestamp((w - 18000) * 1000000), '%Y-%m-%d')"))
def _(c: Context):
    return revisits.revisits(c.located_by_day, tz="America/New_York")


@query("revisit_r2_observed_day_bands", with_base(
    "SELECT id AS source_address, n_days, band AS observed_day_band FROM bands", WHOLE_BANDS))
def _(c: Context):
    return c.whole_bands


@query("revisit_r3_day_distribution", with_base(
    "SELECT n_days, band AS observed_day_band, count(*) AS n FROM bands GROUP BY 1, 2", WHOLE_BANDS))
def _(c: Context):
    return revisits.day_distribution(c.whole_bands)


@query("revisit_r3_band_summary", with_base(
    f"""SELECT band AS observed_day_band, {big('sum(n)')} AS total, min(n_days) AS x_min, max(n_days) AS x_max,
        {r6('median(n_days)')} AS x_mid, max(n) AS y_top,
        {r6('sum(n) * 100.0 / (SELECT count(*) FROM bands)')} AS pct
        FROM (SELECT n_days, band, count(*) AS n FROM bands GROUP BY 1, 2) GROUP BY 1""", WHOLE_BANDS))
def _(c: Context):
    return revisits.band_summary(revisits.day_distribution(c.whole_bands))


_XB = ",\nxb AS (SELECT * FROM bands WHERE band IN ('1 day', '5–7 days'))"
EXTREME, WHOLE_EXTREME = BANDS + _XB, WHOLE_BANDS + _XB


@query("revisit_r4_band_hourly_profile", with_base(
    f"""SELECT band AS observed_day_band, hour, n, {r6('n * 100.0 / sum(n) OVER (PARTITION BY band)')} AS pct
        FROM (SELECT band, {hour('w')} AS hour, count(DISTINCT id) AS n FROM week JOIN xb USING (id)
              GROUP BY 1, 2)""", WHOLE_EXTREME))
def _(c: Context):
    return revisits.band_hourly_profile(c.t20, c.whole_bands)


DIFF = WHOLE_EXTREME + """,
shares AS (SELECT band, sensor, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY band) AS pct
           FROM week JOIN xb USING (id) GROUP BY 1, 2),
diffs AS (SELECT sensor, coalesce(max(pct) FILTER (WHERE band = '1 day'), 0) AS p1,
                 coalesce(max(pct) FILTER (WHERE band = '5–7 days'), 0) AS p5 FROM shares GROUP BY 1)"""
_DIFF = f"""SELECT sensor AS sensor_name, {r6('p1')} AS pct_one_day, {r6('p5')} AS pct_five_to_seven_days,
    {r6('p1 - p5')} AS diff, {r6('abs(p1 - p5)')} AS abs_diff,
    CASE WHEN p1 > p5 THEN '1 day' ELSE '5–7 days' END AS dominant FROM """


@query("revisit_r5_band_sensor_difference", with_base(_DIFF + "diffs", DIFF))
def _(c: Context):
    return revisits.band_sensor_difference(c.t20, c.whole_bands)


@query("revisit_r6_top_differences", with_base(
    _DIFF + "(SELECT *, rank() OVER (ORDER BY abs(p1 - p5) DESC) AS r FROM diffs) WHERE r <= 10", DIFF))
def _(c: Context):
    return revisits.top_differences(revisits.band_sensor_difference(c.t20, c.whole_bands))


DAYSTATS = WHOLE_EXTREME + f""",
daystats AS (SELECT id, band, (w + {KST}) // 86400 AS d, count(*) AS n, count(DISTINCT sensor) AS s,
                    (max(w) - min(w)) / 60.0 AS m FROM week JOIN xb USING (id) GROUP BY 1, 2, 3)"""


@query("revisit_r7_identifier_day_stats", with_base(
    f"""SELECT id AS source_address, {day(f'(d * 86400 - {KST})')} AS local_date, n AS n_detections,
        s AS n_sensors, {r6('m')} AS duration_mins, band AS observed_day_band FROM daystats""", DAYSTATS))
def _(c: Context):
    return revisits.identifier_day_stats(c.t20, c.whole_bands)


@query("revisit_r7_identifier_day_summary", with_base(
    f"""SELECT band AS observed_day_band, count(*) AS n_identifier_days,
        {r6('median(n)')} AS median_detections, {r6('avg(n)')} AS mean_detections,
        {r6('median(s)')} AS median_sensors, {r6('avg(s)')} AS mean_sensors,
        {r6('median(m)')} AS median_duration, {r6('avg(m)')} AS mean_duration
        FROM daystats GROUP BY 1""", DAYSTATS))
def _(c: Context):
    return revisits.identifier_day_summary(revisits.identifier_day_stats(c.t20, c.whole_bands))


VDAYS = VISITS + f""",
vdays AS (SELECT id, count(DISTINCT (t0 + {KST}) // 86400) AS n_days FROM visits
          WHERE n >= 1 AND n_sensors >= 2 AND dur BETWEEN 60 AND 7200 GROUP BY id),
vtypes AS (SELECT *, CASE WHEN n_days = 1 THEN 'Single-day' ELSE 'Multi-day' END AS visit_type FROM vdays)"""


def _visit_days(c):
    return revisits.visit_days(act.quality_filter(c.visits, DISTRICT))


@query("revisit_r8_visit_days", with_base(
    "SELECT id AS source_address, n_days, visit_type FROM vtypes", VDAYS))
def _(c: Context):
    return _visit_days(c)


@query("revisit_r8_visit_type_summary", with_base(
    f"""SELECT visit_type, count(*) AS n_identifiers, {r6('median(n_days)')} AS median_days,
        {r6('avg(n_days)')} AS mean_days, {r6('count(*) * 100.0 / (SELECT count(*) FROM vtypes)')} AS pct
        FROM vtypes GROUP BY 1""", VDAYS))
def _(c: Context):
    return revisits.visit_type_summary(_visit_days(c))


@query("revisit_r8_visit_day_distribution", with_base(
    f"""SELECT n_days, visit_type, count(*) AS n_identifiers,
        {r6('count(*) * 100.0 / (SELECT count(*) FROM vtypes)')} AS pct FROM vtypes GROUP BY 1, 2""", VDAYS))
def _(c: Context):
    return revisits.visit_day_distribution(_visit_days(c))


# Activities ------------------------------------------------------------------------------

_KEPT = "SELECT id AS source_address, tid AS trajectory_id, dur AS duration_seconds, n AS n_windows, n_sensors " \
        "FROM visits WHERE "


def _kept(c, p):
    return act.quality_filter(c.visits, p).select(
        "source_address", "trajectory_id", "duration_seconds", "n_windows", "n_sensors")


@query("activity_a1_quality_filter", with_base(_KEPT + "n >= 3 AND dur <= 7200", VISITS))
def _(c: Context):
    return _kept(c, MAINTAINED)


@query("activity_a1_quality_filter_district", with_base(
    _KEPT + "n_sensors >= 2 AND dur BETWEEN 60 AND 7200", VISITS))
def _(c: Context):
    return _kept(c, DISTRICT)


@query("activity_a2_sensor_distances", with_base(
    f"""SELECT a.sensor AS origin, b.sensor AS destination,
        {r6('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} AS distance, n_segments
        FROM flows JOIN sensors a ON origin = a.sensor JOIN sensors b ON destination = b.sensor""", TRIPS, FLOWS))
def _(c: Context):
    """Distance of every observed flow."""
    flows = c.od_trips.groupBy("origin", "destination").agg(F.count("*").alias("n_segments"))
    a = c.sensors.select(F.col("sensor_name").alias("origin"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = c.sensors.select(F.col("sensor_name").alias("destination"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return flows.join(a, "origin").join(b, "destination").select(
        "origin", "destination", F.sqrt(dx * dx + dy * dy).alias("distance"), "n_segments")


@query("activity_a3_anchor_clusters", with_base(
    f"""SELECT id AS source_address, tid AS trajectory_id, {big('cl')} AS cluster_id, w AS timestamp,
        sensor AS sensor_name FROM ep_rows""", EPISODES))
def _(c: Context):
    return act.anchor_clusters(c.accepted("maintained")).drop("x", "y")


@query("activity_a4_split_episodes", with_base(
    f"""SELECT id AS source_address, tid AS trajectory_id, {big('cl')} AS cluster_id, {big('ep')} AS episode_id,
        count(*) AS n, min(w) AS first, max(w) AS last FROM ep_rows GROUP BY 1, 2, 3, 4""", EPISODES))
def _(c: Context):
    rows = act.split_episodes(act.anchor_clusters(c.accepted("maintained")))
    return rows.groupBy(*act.EPISODE).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


_EP_KEY = f"id AS source_address, tid AS trajectory_id, {big('cl')} AS cluster_id, {big('ep')} AS episode_id"


@query("activity_a5_episode_summary", with_base(
    f"SELECT {_EP_KEY}, t0 AS start_epoch, t1 AS end_epoch, dur AS duration_seconds, n AS n_windows, n_sensors "
    "FROM ep", EPISODES))
def _(c: Context):
    return c.episodes.select(*act.EPISODE, "start_epoch", "end_epoch", "duration_seconds", "n_windows",
                             "n_sensors")


@query("activity_a6_primary_sensor", with_base(
    """SELECT id AS source_address, tid AS trajectory_id, sensor AS primary_sensor FROM (
       SELECT id, tid, sensor, row_number() OVER (PARTITION BY id, tid ORDER BY count(*) DESC, sensor) AS rn
       FROM visits_rows GROUP BY id, tid, sensor) WHERE rn = 1""", VISITS))
def _(c: Context):
    return act.primary_sensor(track.split_trajectories(c.located_by_day, 7200), act.TRAJECTORY)


_ACT = f"""SELECT {_EP_KEY}, {utc_text('t0')} AS start_utc, {utc_text('t1')} AS end_utc, dur AS duration_seconds,
    n AS n_windows, primary_sensor, n_sensors, is_stay, activity_type FROM ep"""


@query("activity_a7_activities", with_base(_ACT, EPISODES))
def _(c: Context):
    return stages.activity_table(c.episodes)


@query("activity_a7_activities_campus", with_base(
    _ACT, TRIPS, episodes("trips", "n >= 3 AND dur <= 7200", 150)))
def _(c: Context):
    return stages.activity_table(act.episodes_of(c.accepted("campus"), CAMPUS))


DISTRICT_EP = VISITS + episodes("visits", "n_sensors >= 2 AND dur BETWEEN 60 AND 7200", 75)


@query("activity_a7_activities_district", with_base(_ACT, DISTRICT_EP))
def _(c: Context):
    return stages.activity_table(act.episodes_of(c.accepted("district"), DISTRICT))


@query("activity_a8_stay_summary", with_base(
    f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT id, tid, cl FROM ep)) AS total_spatial_clusters,
        count(*) AS total_episodes, {big('sum(is_stay)')} AS n_stays, {r6('avg(is_stay) * 100')} AS pct_stays,
        {r6('median(dur / 60.0) FILTER (WHERE is_stay = 1)')} AS median_duration,
        {r6('avg(dur / 60.0) FILTER (WHERE is_stay = 1)')} AS mean_duration FROM ep""", EPISODES))
def _(c: Context):
    return act.stay_summary(c.episodes)


@query("activity_a9_type_distribution", with_base(
    f"""SELECT activity_type, count(*) AS n, {r6('count(*) * 100.0 / (SELECT count(*) FROM ep)')} AS pct
        FROM ep GROUP BY 1""", EPISODES))
def _(c: Context):
    return act.type_distribution(c.episodes)


@query("activity_a10_duration_bins", with_base(
    f"""SELECT duration_bin, count(*) AS n, {r6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM (
        SELECT CASE WHEN dur < 600 THEN '5-10' WHEN dur < 900 THEN '10-15' WHEN dur < 1800 THEN '15-30'
                    WHEN dur < 3600 THEN '30-60' WHEN dur < 7200 THEN '60-120' ELSE '120+' END AS duration_bin
        FROM ep WHERE is_stay = 1) GROUP BY 1""", EPISODES))
def _(c: Context):
    return act.duration_bins(c.episodes)


@query("activity_a11_hourly_stays", with_base(
    f"""SELECT {hour('t0')} AS hour, count(*) AS n_total, {big('sum(is_stay)')} AS n_stays,
        {r6('avg(is_stay) * 100')} AS stay_rate FROM ep GROUP BY 1""", EPISODES))
def _(c: Context):
    return act.hourly_stays(c.episodes)


SENSOR_STAYS = """,
ss AS (SELECT primary_sensor, count(*) AS n_episodes, CAST(sum(is_stay) AS BIGINT) AS n_stays,
              avg(is_stay) * 100 AS stay_rate, avg(dur / 60.0) FILTER (WHERE is_stay = 1) AS avg_duration
       FROM ep GROUP BY 1)"""
_SS = f"""SELECT primary_sensor, n_episodes, n_stays, {r6('stay_rate')} AS stay_rate,
    {r6('avg_duration')} AS avg_duration, {r6('x')} AS x, {r6('y')} AS y
    FROM (SELECT *, rank() OVER (ORDER BY stay_rate DESC) AS r FROM ss WHERE n_episodes >= {{}})
    JOIN sensors ON sensor = primary_sensor WHERE r <= {{}}"""


@query("activity_a12_sensor_stays", with_base(_SS.format(0, 1000), EPISODES, SENSOR_STAYS))
def _(c: Context):
    return act.sensor_stays(c.episodes, c.sensors)


@query("activity_a13_top_stay_sensors", with_base(_SS.format(100, 10), EPISODES, SENSOR_STAYS))
def _(c: Context):
    return act.top_stay_sensors(act.sensor_stays(c.episodes, c.sensors))


@query("activity_a14_stays_by_band", with_base(
    f"""SELECT band AS observed_day_band, count(*) AS n_episodes, {big('sum(is_stay)')} AS n_stays,
        {r6('avg(is_stay) * 100')} AS stay_rate,
        {r6('median(dur / 60.0) FILTER (WHERE is_stay = 1)')} AS median_duration,
        {r6('avg(dur / 60.0) FILTER (WHERE is_stay = 1)')} AS mean_duration
        FROM ep JOIN xb USING (id) GROUP BY 1""", EPISODES, EXTREME.replace(BANDS, PLANTED_BANDS)))
def _(c: Context):
    return act.stays_by_band(c.episodes, revisits.observed_day_bands(c.planted_week))


@query("activity_a14_types_by_band", with_base(
    f"""SELECT band AS observed_day_band, activity_type, count(*) AS n,
        {r6('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY band)')} AS pct
        FROM ep JOIN xb USING (id) GROUP BY 1, 2""", EPISODES, EXTREME))
def _(c: Context):
    return act.types_by_band(c.episodes, c.bands)


PAIRS = DISTRICT_EP + VDAYS[len(VISITS):] + """,
pairs AS (
  SELECT p.id, p.tid, p.sensor, s.street_type, CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS is_stay
  FROM (SELECT DISTINCT id, tid, sensor FROM ep_rows) p JOIN sensors s ON s.sensor = p.sensor
  LEFT JOIN (SELECT DISTINCT id, tid, primary_sensor FROM ep WHERE is_stay = 1) f
    ON f.id = p.id AND f.tid = p.tid AND f.primary_sensor = p.sensor)"""


def _pairs(c):
    rows = c.accepted("district")
    return act.trajectory_sensor_pairs(rows, act.episodes_of(rows, DISTRICT), c.district)


@query("activity_a15_trajectory_sensor_pairs", with_base(
    """SELECT id AS source_address, tid AS trajectory_id, sensor AS sensor_name, street_type, is_stay,
       CASE WHEN is_stay = 1 THEN 'Stay' ELSE 'Pass-through' END AS activity_type FROM pairs""", PAIRS))
def _(c: Context):
    return _pairs(c)


def _ratio_sql(columns, source="pairs"):
    return with_base(f"""SELECT {columns}, count(*) AS n_traj, {big('sum(is_stay)')} AS n_stay,
        {big('sum(1 - is_stay)')} AS n_move, {r6('avg(is_stay) * 100')} AS stay_rate,
        count(DISTINCT id) AS n_identifiers FROM {source} GROUP BY ALL""", PAIRS)


@query("activity_a16_stay_ratio_sensor", _ratio_sql("sensor AS sensor_name, street_type"))
def _(c: Context):
    return act.stay_ratio(_pairs(c), ["sensor_name", "street_type"])


@query("activity_a16_stay_ratio_street", _ratio_sql("street_type"))
def _(c: Context):
    return act.stay_ratio(_pairs(c), ["street_type"])


def _pairs_by_visit(c):
    return _pairs(c).join(_visit_days(c).select("source_address", "visit_type"), "source_address")


@query("activity_a16_stay_ratio_visit_street",
       _ratio_sql("visit_type, street_type", "pairs JOIN vtypes USING (id)"))
def _(c: Context):
    return act.stay_ratio(_pairs_by_visit(c), ["visit_type", "street_type"])


@query("activity_a16_stay_ratio_sensor_visit",
       _ratio_sql("sensor AS sensor_name, street_type, visit_type", "pairs JOIN vtypes USING (id)"))
def _(c: Context):
    return act.stay_ratio(_pairs_by_visit(c), ["sensor_name", "street_type", "visit_type"])


@query("activity_a17_street_contrast", with_base(
    f"""SELECT visit_type, {r6('c')} AS conventional, {r6('p')} AS pedestrian, {r6('m')} AS mean_rate,
        {r6('p - c')} AS gap FROM (
        SELECT visit_type, avg(is_stay) FILTER (WHERE street_type = 'Regular') * 100 AS c,
               avg(is_stay) FILTER (WHERE street_type = 'Pedestrian') * 100 AS p, avg(is_stay) * 100 AS m
        FROM pairs JOIN vtypes USING (id) GROUP BY 1)""", PAIRS))
def _(c: Context):
    return act.street_contrast(act.stay_ratio(_pairs_by_visit(c), ["visit_type", "street_type"]))


# Cleaning --------------------------------------------------------------------------------

_SEC = f"""SELECT t AS timestamp, id AS source_address, sensor AS sensor_name,
    flag AS source_address_randomized, {r6('m')} AS rssi_median, n AS packet_count FROM """


@query("clean_c1_sessions", with_base(
    f"""SELECT id AS source_address, sensor AS sensor_name, {big('g')} AS session_id, t0 AS start_epoch,
        t1 AS end_epoch, n AS n_rows, t1 - t0 AS duration_seconds FROM sess"""))
def _(c: Context):
    return cleaning.sessions(filters.keep_unflagged(c.sec1_by_day))


@query("clean_c1_from_buckets", with_base(
    f"""SELECT id AS source_address, sensor AS sensor_name, {big('g')} AS session_id, t0 AS start_epoch,
        t1 AS end_epoch, n AS n_rows, t1 - t0 AS duration_seconds FROM sess"""))
def _(c: Context):
    name = f"waymark_seconds_{uuid.uuid4().hex}"
    rows = tables.write_by_identifier_day(filters.keep_unflagged(c.sec1), name, c.new_path(name), c.parts)
    return cleaning.sessions(rows)


@query("clean_c2_remove_stationary", with_base(
    "SELECT id AS source_address, sensor AS sensor_name, count(*) AS n FROM cleaned GROUP BY 1, 2"))
def _(c: Context):
    kept = cleaning.remove_stationary(filters.keep_unflagged(c.sec1_by_day))
    return kept.groupBy("source_address", "sensor_name").agg(F.count("*").alias("n"))


@query("clean_c3_cleaned_one_second", with_base(_SEC + "cleaned"))
def _(c: Context):
    return c.cleaned


HIST = """,
stable AS (SELECT * FROM valid WHERE rssi > -100 AND rssi < 0 AND NOT rnd),
hsess AS (
  SELECT address, sensor, g, max(t) - min(t) AS dur FROM (
    SELECT *, sum(brk) OVER (PARTITION BY address, sensor ORDER BY t, o) AS g FROM (
      SELECT address, sensor, t, row_number() OVER (PARTITION BY address, sensor ORDER BY t) AS o,
             CASE WHEN t - lag(t) OVER (PARTITION BY address, sensor ORDER BY t) <= 300 THEN 0 ELSE 1 END AS brk
      FROM stable)) GROUP BY 1, 2, 3),
moving AS (SELECT * FROM stable WHERE address NOT IN (SELECT address FROM hsess WHERE dur >= {limit})),
frequent AS (SELECT * FROM moving WHERE address IN
               (SELECT address FROM moving GROUP BY 1 HAVING count(*) >= {rare}))"""
HIST_SQL = RAW_PLANTED + HIST.format(limit=7200, rare=5)


@query("clean_c4_historical", with_base(
    f"""SELECT substr(sha256(lower(trim(address))), 1, 16) AS source_address, sensor AS sensor_name,
        count(*) AS n, {big('sum(rssi)')} AS rssi_total FROM frequent GROUP BY 1, 2""", HIST_SQL))
def _(c: Context):
    rows = cleaning.clean_historical(c.raw_planted)
    return rows.groupBy("source_address", "sensor_name").agg(
        F.count("*").alias("n"), F.sum("rssi").alias("rssi_total"))


@query("clean_c5_five_metrics_rows", with_base(
    """SELECT 'location' AS metric, count(*) AS n_rows FROM loc
       UNION ALL SELECT 'count', count(*) FROM (SELECT DISTINCT w, sensor FROM loc)
       UNION ALL SELECT 'track_trajectories', count(*) FROM trips
       UNION ALL SELECT 'track_od', count(*) FROM (SELECT DISTINCT origin, destination FROM trips WHERE is_od = 1)
       UNION ALL SELECT 'revisits', count(DISTINCT id) FROM visits WHERE n >= 2
       UNION ALL SELECT 'activities', count(*) FROM ep""", TRIPS, EPISODES))
def _(c: Context):
    """All metrics from one run; the Location table is written once, in the buckets of its windows, and read by the others."""
    metrics = stages.five_metrics(c.t20_by_day, c.sensors, stage=c.landed_by_day)
    lines = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("metric"), "n_rows")
             for name, df in metrics.items()]
    result = lines[0]
    for line in lines[1:]:
        result = result.unionByName(line)
    return result
