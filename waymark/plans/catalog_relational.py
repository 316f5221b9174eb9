"""Queries for aggregations, joins, windows and set operations (G, J, W, U)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions.islands import UTC_DAY, split_sessions, with_gaps
from waymark.functions.stats import average_rank, exact_quantiles, share, top_with_ties
from waymark.functions.timefn import epoch, local_date, local_hour
from waymark.operators import activities as act
from waymark.operators import (
    aggregate, cleaning, count, diagnostics, disclosure, filters, joins, location, release,
)
from waymark.params import CAMPUS
from waymark.plans.catalog_metrics import _SEC, GT_SQL, HIST_SQL, HOURLY
from waymark.plans.context import Context, query
from waymark.plans.oracle import (
    BANDS, GPS, KST, RAW, TRIPS, VISITS, big, day, day_type, hour, r6, with_base,
)

# Aggregations ----------------------------------------------------------------------------


@query("agg_g1_one_second", with_base(_SEC + "sec1"))
def _(c: Context):
    return aggregate.one_second(c.packets_by_day).drop(UTC_DAY)


DOUBLE = """,
twice AS (SELECT t, id, sensor, flag, m, n FROM sec1 UNION ALL
          SELECT t, id, sensor, flag, m - 2, n + 1 FROM sec1 WHERE t % 3 = 0)"""


@query("agg_g2_deduplicate", with_base(
    f"""SELECT t AS timestamp, id AS source_address, sensor AS sensor_name,
        min(flag) AS source_address_randomized, {r6('median(m)')} AS rssi_median,
        {big('sum(n)')} AS packet_count FROM twice GROUP BY 1, 2, 3""", DOUBLE))
def _(c: Context):
    """Every third second is delivered twice, the second time 2 dB weaker."""
    again = c.sec1_by_day.filter(epoch("timestamp") % 3 == 0).withColumn(
        "rssi_median", F.col("rssi_median") - 2).withColumn("packet_count", F.col("packet_count") + 1)
    return aggregate.deduplicate_one_second(c.sec1_by_day.unionByName(again)).drop(UTC_DAY)


@query("agg_g3_session_duration", with_base(
    """SELECT sensor AS sensor_name, t1 - t0 AS duration_seconds, count(*) AS n_sessions
       FROM sess GROUP BY 1, 2"""))
def _(c: Context):
    s = cleaning.sessions(filters.keep_unflagged(c.sec1_by_day))
    return s.groupBy("sensor_name", "duration_seconds").agg(F.count("*").alias("n_sessions"))


_T20 = f"""SELECT w AS timestamp, id AS source_address, sensor AS sensor_name, {r6('rssi_median')} AS rssi_median,
    {r6('rssi_sum')} AS rssi_sum, detections, {r6('strength_sum')} AS strength_sum FROM """


@query("agg_g4_twenty_second", with_base(_T20 + "t20"))
def _(c: Context):
    return aggregate.twenty_second(c.cleaned_by_day).drop(UTC_DAY)


@query("agg_g5_twenty_second_by_minute", with_base(
    _T20 + """(SELECT epoch(date_trunc('minute', ts)) + CAST(floor(date_part('second', ts) / 20) AS BIGINT) * 20 AS w,
                 id, sensor, median(m) AS rssi_median, sum(m) AS rssi_sum, count(*) AS detections,
                 sum(100 + m) AS strength_sum
          FROM (SELECT *, make_timestamp(t * 1000000) AS ts FROM sec1 WHERE flag = 0) GROUP BY 1, 2, 3)"""))
def _(c: Context):
    """Minute plus 20 s thirds in the SQL counterpart; the epoch floor gives the same windows."""
    return aggregate.twenty_second(filters.keep_unflagged(c.sec1_by_day)).drop(UTC_DAY)


RAW20 = RAW + """,
secs AS (SELECT t, lower(trim(address)) AS address, sensor, median(rssi) AS m, count(*) AS n
         FROM raw WHERE rssi > -100 AND rssi < 0 GROUP BY 1, 2, 3)"""


@query("agg_g6_twenty_second_from_raw", with_base(
    f"""SELECT t // 20 * 20 AS timestamp, address AS source_address, sensor AS sensor_name,
        {r6('median(m)')} AS rssi_median, {r6('sum(m)')} AS rssi_sum, count(*) AS detections,
        {r6('100 * count(*) + sum(m)')} AS strength_sum
        FROM secs GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 1 AND 20""", RAW20))
def _(c: Context):
    return aggregate.twenty_second_from_raw(c.raw_by_day, c.district).drop(UTC_DAY)


@query("agg_g7_source_audit", with_base(
    f"""SELECT {big('sum(mapped)')} AS mapped_rows, {big('sum(n)')} AS accepted_numeric_filter_rows,
        {big('sum(old)')} AS accepted_old_rounded_filter_rows, {big('sum(n) - sum(old)')} AS filter_row_difference,
        count(*) FILTER (WHERE n > 0) AS unique_one_second_keys,
        count(*) FILTER (WHERE n > 1) AS duplicated_one_second_keys,
        {big('sum(greatest(n - 1, 0))')} AS duplicate_excess_rows, max(n) AS maximum_rows_per_one_second_key,
        {big('sum(fractional)')} AS fractional_rssi_rows
        FROM (SELECT count(*) AS mapped, count(*) FILTER (WHERE r > -100 AND r < 0) AS n,
                     count(*) FILTER (WHERE whole > -100 AND whole < 0) AS old,
                     count(*) FILTER (WHERE r > -100 AND r < 0 AND r <> whole) AS fractional
              FROM (SELECT *, round_even(r, 0) AS whole FROM (
                      SELECT *, CAST(CASE WHEN t % 13 = 0 THEN rssi - 0.4 ELSE rssi END AS DOUBLE) AS r FROM raw))
              GROUP BY t, lower(trim(address)), sensor)""", RAW))
def _(c: Context):
    """Some strengths are given a fraction, so that the rounded range keeps other rows than the numeric one."""
    rssi = F.col("rssi").cast("double")
    rows = c.raw_by_day.withColumn("rssi", F.when(epoch("timestamp") % 13 == 0, rssi - 0.4).otherwise(rssi))
    return aggregate.source_audit(rows, c.district)


@query("agg_g8_cleaning_funnel", with_base(
    """SELECT 0 AS step, 'initial' AS name, count(*) AS n_rows, count(DISTINCT address) AS n_identifiers
         FROM valid WHERE rssi > -100 AND rssi < 0
       UNION ALL SELECT 1, 'after_random', count(*), count(DISTINCT address) FROM stable
       UNION ALL SELECT 2, 'after_stationary', count(*), count(DISTINCT address) FROM moving
       UNION ALL SELECT 3, 'after_rare', count(*), count(DISTINCT address) FROM frequent""", HIST_SQL))
def _(c: Context):
    return cleaning.cleaning_funnel(c.raw_planted)


@query("agg_g9_mean_sd", with_base(
    f"SELECT day_type, {r6('avg(n)')} AS mean_devices, {r6('stddev_samp(n)')} AS sd_devices FROM hourly GROUP BY 1",
    HOURLY))
def _(c: Context):
    return count.hourly_counts(c.t20).groupBy("day_type").agg(
        F.avg("n_devices").alias("mean_devices"), F.stddev_samp("n_devices").alias("sd_devices"))


@query("agg_g10_quartiles", with_base(
    f"""SELECT sensor AS sensor_name, {r6('median(strength_sum)')} AS q50, {r6('avg(strength_sum)')} AS mean,
        {r6('quantile_cont(strength_sum, 0.25)')} AS q25, {r6('quantile_cont(strength_sum, 0.75)')} AS q75,
        count(*) AS n FROM t20 GROUP BY 1"""))
def _(c: Context):
    return exact_quantiles(
        c.t20, ["sensor_name"], "strength_sum", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, 10.0)


@query("agg_g11_share_within_group", with_base(
    f"""SELECT sensor AS sensor_name, {hour('w')} AS hour, count(*) AS n,
        {r6('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY sensor)')} AS pct FROM t20 GROUP BY 1, 2"""))
def _(c: Context):
    counts = c.t20.groupBy("sensor_name", local_hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    return share(counts, "n", ["sensor_name"])


@query("agg_g12_pivot", with_base(
    f"""SELECT sensor AS sensor_name, count(*) FILTER (WHERE {day_type('w')} = 'Weekday') AS weekday,
        count(*) FILTER (WHERE {day_type('w')} = 'Weekend') AS weekend FROM t20 GROUP BY 1"""))
def _(c: Context):
    return filters.calendar(c.t20).groupBy("sensor_name").pivot("day_type", ["Weekday", "Weekend"]).agg(
        F.count("timestamp")).fillna(0).withColumnsRenamed({"Weekday": "weekday", "Weekend": "weekend"})


@query("agg_g13_mode", with_base(
    """SELECT id AS source_address, sensor AS modal_sensor FROM (
       SELECT id, sensor, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, sensor) AS rn
       FROM loc GROUP BY id, sensor) WHERE rn = 1"""))
def _(c: Context):
    return c.located.groupBy("source_address").agg(
        F.mode("sensor_name", deterministic=True).alias("modal_sensor"))


@query("agg_g14_conditional", with_base(
    f"""SELECT sensor AS sensor_name, count(*) FILTER (WHERE detections > 1) AS n_repeated,
        count(DISTINCT id) FILTER (WHERE {hour('w')} < 5) AS night_ids,
        {r6('median(rssi_median) FILTER (WHERE detections = 1)')} AS single_median FROM t20 GROUP BY 1"""))
def _(c: Context):
    t = c.t20
    return t.groupBy("sensor_name").agg(
        F.count_if(F.col("detections") > 1).alias("n_repeated"),
        F.countDistinct(F.when(local_hour("timestamp") < 5, F.col("source_address"))).alias("night_ids"),
        F.median(F.when(F.col("detections") == 1, F.col("rssi_median"))).alias("single_median"))


@query("agg_g15_distinct_tuple", with_base(
    f"SELECT {day('w')} AS local_date, count(DISTINCT (id, sensor)) AS n_pairs FROM t20 GROUP BY 1"))
def _(c: Context):
    return c.t20.groupBy(local_date("timestamp").alias("local_date")).agg(
        F.countDistinct("source_address", "sensor_name").alias("n_pairs"))


SEQ_SQL = f""",
seen AS (SELECT id, (w + {KST}) // 86400 AS d, sensor, min(w) AS f FROM t20 GROUP BY 1, 2, 3),
seqs AS (SELECT id, d, string_agg(sensor, '>' ORDER BY f, sensor) AS q, count(*) AS n FROM seen GROUP BY 1, 2)"""


@query("agg_g16_ordered_string", with_base(
    f"""SELECT id AS source_address, {day(f'(d * 86400 - {KST})')} AS local_date, q AS sensor_sequence,
        n AS sensors_visited FROM seqs""", SEQ_SQL))
def _(c: Context):
    return disclosure.daily_sequence(c.t20)


@query("agg_g17_first_last", with_base(
    """SELECT id AS source_address, first(sensor ORDER BY w, sensor) AS first_sensor,
       last(sensor ORDER BY w, sensor) AS last_sensor FROM t20 GROUP BY 1"""))
def _(c: Context):
    at = F.struct("timestamp", "sensor_name")
    return c.t20.groupBy("source_address").agg(F.min(at).alias("a"), F.max(at).alias("b")).select(
        "source_address", F.col("a.sensor_name").alias("first_sensor"),
        F.col("b.sensor_name").alias("last_sensor"))


STREAMS = RAW + """,
streams AS (SELECT site, t // 3600 * 3600 AS h, count(DISTINCT address) FILTER (WHERE rnd) AS a,
                   count(DISTINCT address) FILTER (WHERE NOT rnd) AS b FROM valid GROUP BY 1, 2),
ranks AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY a) + (count(*) OVER (PARTITION BY site, a) - 1) / 2.0 AS ra,
                 rank() OVER (PARTITION BY site ORDER BY b) + (count(*) OVER (PARTITION BY site, b) - 1) / 2.0 AS rb
          FROM streams)"""


@query("agg_g18_correlations", with_base(
    f"""SELECT site, {r6('corr(a, b)')} AS pearson_r, {r6('corr(ra, rb)')} AS spearman_rho,
        count(*) AS n_hours FROM ranks GROUP BY 1""", STREAMS))
def _(c: Context):
    return diagnostics.stream_correlation(diagnostics.hourly_streams(diagnostics.flagged(c.raw)))


@query("agg_g18_average_rank", with_base(
    f"SELECT site, h AS hour_epoch, a AS n_random, b AS n_nonrandom, {r6('ra')} AS rank_random FROM ranks", STREAMS))
def _(c: Context):
    hourly = diagnostics.hourly_streams(diagnostics.flagged(c.raw))
    return average_rank(hourly, "n_random", ["site"], "rank_random")


_FIT = f"""SELECT site, {r6('regr_slope(b, a)')} AS slope, {r6('regr_intercept(b, a)')} AS intercept,
    {r6('quantile_cont(a, 0.9)')} AS x_at,
    {r6('regr_slope(b, a) * quantile_cont(a, 0.9) + regr_intercept(b, a)')} AS y_at FROM streams GROUP BY 1"""


@query("agg_g19_linear_fit", with_base(_FIT, STREAMS))
def _(c: Context):
    return diagnostics.fit_line(diagnostics.hourly_streams(diagnostics.flagged(c.raw)))


# Joins -----------------------------------------------------------------------------------

@query("join_j1_sensor_dimension", with_base(
    f"""SELECT id AS source_address, {r6('sum(x * detections)')} AS sx, {r6('sum(y * detections)')} AS sy
        FROM t20 t JOIN sensors s ON t.sensor = s.sensor GROUP BY 1"""))
def _(c: Context):
    placed = c.t20.join(c.sensors.select("sensor_name", "x", "y"), "sensor_name")
    return placed.groupBy("source_address").agg(
        F.sum(F.col("x") * F.col("detections")).alias("sx"), F.sum(F.col("y") * F.col("detections")).alias("sy"))


@query("join_j2_sensor_codes", with_base(
    "SELECT sensor AS sensor_name, site, count(*) AS n FROM raw GROUP BY 1, 2", RAW))
def _(c: Context):
    return aggregate.map_sensor_codes(c.raw, c.district).groupBy("sensor_name", "site").agg(
        F.count("*").alias("n"))


@query("join_j3_enrich_bands", with_base(
    "SELECT sensor AS sensor_name, band AS observed_day_band, count(*) AS n FROM loc LEFT JOIN bands USING (id) "
    "GROUP BY 1, 2", BANDS))
def _(c: Context):
    rows = c.located.join(c.bands.select("source_address", "observed_day_band"), "source_address", "left")
    return rows.groupBy("sensor_name", "observed_day_band").agg(F.count("*").alias("n"))


@query("join_j4_origin_destination_sensors", with_base(
    f"""SELECT t.id AS source_address, tid AS trajectory_id, {r6('o.x')} AS x_origin, {r6('o.y')} AS y_origin,
        {r6('d.x')} AS x_destination, {r6('d.y')} AS y_destination FROM trips t
        JOIN sensors o ON o.sensor = origin JOIN sensors d ON d.sensor = destination WHERE is_od = 1""", TRIPS))
def _(c: Context):
    edges = joins.with_coordinates(c.od_trips, c.sensors)
    return edges.select("source_address", "trajectory_id", "x_origin", "y_origin", "x_destination", "y_destination")


@query("join_j5_semi_valid_trajectories", with_base(
    """SELECT id AS source_address, count(*) AS n FROM visits_rows JOIN
       (SELECT id, tid FROM visits WHERE n >= 3 AND dur <= 7200) USING (id, tid) GROUP BY 1""", VISITS))
def _(c: Context):
    return act.qualifying_rows(c.located_by_day).groupBy("source_address").agg(F.count("*").alias("n"))


@query("join_j6_anti_stationary", with_base(
    """SELECT id AS source_address, count(*) AS n FROM sec1 WHERE id NOT IN
       (SELECT id FROM sess WHERE t1 - t0 > 7200) GROUP BY 1"""))
def _(c: Context):
    fixed = cleaning.stationary_identifiers(filters.keep_unflagged(c.sec1_by_day))
    return filters.without_identifiers(c.sec1_by_day, fixed).groupBy("source_address").agg(
        F.count("*").alias("n"))


@query("join_j7_zero_filled_grid", with_base(
    f"""SELECT s.sensor AS sensor_name, {day(f'(g.d * 86400 - {KST})')} AS local_date, coalesce(n, 0) AS n
        FROM sensors s CROSS JOIN (SELECT DISTINCT (w + {KST}) // 86400 AS d FROM loc) g
        LEFT JOIN (SELECT sensor, (w + {KST}) // 86400 AS d, count(*) AS n FROM loc
                   GROUP BY 1, 2) a ON a.sensor = s.sensor AND a.d = g.d"""))
def _(c: Context):
    per_day = c.located.groupBy(
        "sensor_name", local_date("timestamp").alias("local_date")).agg(F.count("*").alias("n"))
    return joins.fill_sensor_days(per_day, c.sensors, per_day, "n")


NARROW = """,
nsec AS (SELECT t, id, sensor, min(flag) AS flag, median(strength) AS m FROM accepted
         WHERE strength >= -74 GROUP BY 1, 2, 3),
nsess AS (
  SELECT id, sensor, g, max(t) - min(t) AS dur FROM (
    SELECT *, sum(brk) OVER (PARTITION BY id, sensor ORDER BY t) AS g FROM (
      SELECT id, sensor, t,
             CASE WHEN t - lag(t) OVER (PARTITION BY id, sensor ORDER BY t) <= 300 THEN 0 ELSE 1 END AS brk
      FROM nsec WHERE flag = 0)) GROUP BY 1, 2, 3),
n20 AS (SELECT t // 20 * 20 AS w, id, sensor, median(m) AS rssi_median, sum(m) AS rssi_sum,
               count(*) AS detections, 100 * count(*) + sum(m) AS strength_sum
        FROM nsec WHERE flag = 0 AND id NOT IN (SELECT id FROM nsess WHERE dur > 7200) GROUP BY 1, 2, 3),
nloc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, w ORDER BY strength_sum DESC, sensor) AS rn
                        FROM n20) WHERE rn = 1)"""


@query("join_j8_full_outer_difference", with_base(
    f"""SELECT coalesce(a.sensor, b.sensor) AS sensor_name, count(*) FILTER (WHERE a.id IS NULL) AS right_only,
        count(*) FILTER (WHERE b.id IS NULL) AS left_only,
        count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL
                           AND a.detections IS DISTINCT FROM b.detections) AS changed
        FROM t20 a FULL OUTER JOIN n20 b ON a.id = b.id AND a.w = b.w AND a.sensor = b.sensor GROUP BY 1""",
    NARROW))
def _(c: Context):
    key = aggregate.key_of(c.t20_by_day)
    a = c.t20_by_day.select(*key, F.col("detections").alias("a"))
    b = c.t20_narrow_by_day.select(*key, F.col("detections").alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, key, "full_outer").groupBy("sensor_name").agg(
        F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if(F.col("b").isNull()).alias("left_only"),
        F.count_if(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@query("join_j9_nearest_asof", with_base(
    f"""SELECT id AS source_address, w0 AS window_start, width, {r6('ft')} AS matched_time, {r6('p.x')} AS x_gps,
        {r6('p.y')} AS y_gps FROM matched WHERE width = 60""", GT_SQL))
def _(c: Context):
    est = location.estimates(location.window_strength(c.located_raw, (60,)), c.sensors)
    fixes = c.gps.select("source_address", epoch("timestamp").alias("at"),
                         F.col("x").alias("x_gps"), F.col("y").alias("y_gps"))
    found = joins.nearest_asof(est, fixes, "source_address", "midpoint", "at", ["x_gps", "y_gps"], 30.0)
    return found.filter(F.col("matched_time").isNotNull()).select(
        "source_address", "window_start", "width", "matched_time", "x_gps", "y_gps")


@query("join_j10_sensor_pairs", with_base(
    f"""SELECT a.sensor AS origin, b.sensor AS destination,
        {r6('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} AS distance, n AS n_rows
        FROM sensors a JOIN sensors b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 22500
        JOIN (SELECT sensor, count(*) AS n FROM t20 GROUP BY 1) t ON t.sensor = a.sensor"""))
def _(c: Context):
    """Pairs within the activity distance of 150 m, with the rows at the origin."""
    rows = c.t20.groupBy(F.col("sensor_name").alias("origin")).agg(F.count("*").alias("n_rows"))
    return joins.pairs_within(c.sensors, CAMPUS.activity_distance_metres).join(rows, "origin")


@query("join_j11_scalar_counts", with_base(
    """SELECT (SELECT count(DISTINCT address) FROM raw) AS source_devices,
       (SELECT count(DISTINCT id) FROM t20) AS retained_devices,
       (SELECT count(DISTINCT address) FROM raw) - (SELECT count(DISTINCT id) FROM t20) AS difference""", RAW))
def _(c: Context):
    ids = c.t20.agg(F.countDistinct("source_address")).scalar()
    return c.raw.agg(F.countDistinct("source_address").alias("source_devices")).withColumn(
        "retained_devices", ids).withColumn("difference", F.col("source_devices") - F.col("retained_devices"))


@query("join_j12_mapping", with_base(
    """SELECT substr(sha256(id), 1, 16) AS source_address, sensor AS sensor_name, count(*) AS n
       FROM t20 GROUP BY 1, 2"""))
def _(c: Context):
    mapping = c.t20.select(F.col("source_address").alias("internal")).distinct().withColumn(
        "public", F.substring(F.sha2(F.col("internal").cast("binary"), 256), 1, 16))
    return release.rewrite_ids(c.t20, mapping).groupBy("source_address", "sensor_name").agg(
        F.count("*").alias("n"))


# Windows ---------------------------------------------------------------------------------

@query("window_w1_top_one", with_base(
    "SELECT w AS timestamp, id AS source_address, sensor AS sensor_name FROM loc"))
def _(c: Context):
    return location.strongest_sensor(c.t20_by_day).select("timestamp", "source_address", "sensor_name")


@query("window_w2_median", with_base(
    f"SELECT sensor AS sensor_name, channel, {r6('median(strength)')} AS median_strength FROM packets GROUP BY 1, 2"))
def _(c: Context):
    return c.packets.groupBy("sensor_name", "channel").agg(F.median("strength").alias("median_strength"))


@query("window_w3_gaps", with_base(
    """SELECT gap, count(*) AS n FROM (
       SELECT w - lag(w) OVER (PARTITION BY id ORDER BY w) AS gap, w FROM loc) GROUP BY 1"""))
def _(c: Context):
    rows = with_gaps(c.located_by_day, ["source_address"], into="gap")
    return rows.groupBy("gap").agg(F.count("*").alias("n"))


@query("window_w4_islands", with_base(
    f"""SELECT id AS source_address, sensor AS sensor_name, {big('g')} AS session_id, count(*) AS n FROM (
        SELECT *, sum(brk) OVER (PARTITION BY id, sensor ORDER BY w) AS g FROM (
          SELECT id, sensor, w, CASE WHEN w - lag(w) OVER (PARTITION BY id, sensor ORDER BY w) < 3600
                                THEN 0 ELSE 1 END AS brk FROM t20)) GROUP BY 1, 2, 3"""))
def _(c: Context):
    rows = split_sessions(c.t20_by_day, ["source_address", "sensor_name"], 3600, into="session_id", inclusive=True)
    return rows.groupBy("source_address", "sensor_name", "session_id").agg(F.count("*").alias("n"))


@query("window_w5_ties_at_max", with_base(
    f"""SELECT id AS source_address, w AS timestamp, {r6('mx')} AS strength_sum, count(*) AS n_tied FROM (
        SELECT *, max(strength_sum) OVER (PARTITION BY id, w) AS mx FROM t20)
        WHERE strength_sum = mx GROUP BY 1, 2, 3 HAVING count(*) > 1"""))
def _(c: Context):
    return location.tied_windows(c.t20)


@query("window_w6_share_of_origin", with_base(
    f"""SELECT origin, destination, n, {r6('n / sum(n) OVER (PARTITION BY origin)')} AS share FROM (
        SELECT origin, destination, count(*) AS n FROM trips GROUP BY 1, 2)""", TRIPS))
def _(c: Context):
    flows = c.trips.groupBy("origin", "destination").agg(F.count("*").alias("n"))
    return flows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("origin")))


@query("window_w7_top_with_ties", with_base(
    """SELECT sensor_name, source_address, n FROM (
       SELECT sensor AS sensor_name, id AS source_address, count(*) AS n,
              rank() OVER (PARTITION BY sensor ORDER BY count(*) DESC) AS r FROM t20 GROUP BY 1, 2)
       WHERE r <= 5"""))
def _(c: Context):
    counts = c.t20.groupBy("sensor_name", "source_address").agg(F.count("*").alias("n"))
    return top_with_ties(counts, "n", 5, ["sensor_name"])


@query("window_w8_peak_per_group", with_base(
    """SELECT sensor AS sensor_name, h AS peak_hour, n FROM (
       SELECT sensor, w // 3600 % 24 AS h, count(*) AS n,
              row_number() OVER (PARTITION BY sensor ORDER BY count(*) DESC, w // 3600 % 24) AS rn
       FROM t20 GROUP BY 1, 2) WHERE rn = 1"""))
def _(c: Context):
    counts = c.t20.groupBy("sensor_name", F.hour("timestamp").alias("h")).agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("h")).alias("neg"))).alias("top")
    return counts.groupBy("sensor_name").agg(top).select(
        "sensor_name", (-F.col("top.neg")).alias("peak_hour"), F.col("top.n").alias("n"))


@query("window_w9_sorted_output", with_base(
    "SELECT w AS timestamp, sensor AS sensor_name, count(*) AS n FROM loc GROUP BY 1, 2 ORDER BY 1, 2"))
def _(c: Context):
    return count.count_sensor_window(c.located).withColumnRenamed(
        "n_retained_identifiers", "n").orderBy("timestamp", "sensor_name")


@query("window_w10_best_identifier", with_base(
    """SELECT id AS source_address, count(*) AS n FROM packets WHERE id IN (SELECT id FROM gps)
       GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""", GPS))
def _(c: Context):
    return location.best_covered_identifier(c.located_raw)


# Set operations --------------------------------------------------------------------------

@query("set_u1_union_all", with_base(
    """SELECT site, count(*) AS n FROM (SELECT 'all' AS site FROM t20 UNION ALL SELECT 'narrow' FROM n20)
       GROUP BY 1""", NARROW))
def _(c: Context):
    both = c.t20.withColumn("site", F.lit("all")).unionByName(c.t20_narrow.withColumn("site", F.lit("narrow")))
    return both.groupBy("site").agg(F.count("*").alias("n"))


@query("set_u2_except_all", with_base(
    """SELECT side, sensor AS sensor_name, count(*) AS n FROM (
       SELECT 'left_only' AS side, * FROM (SELECT * FROM t20 EXCEPT ALL SELECT * FROM n20)
       UNION ALL SELECT 'right_only', * FROM (SELECT * FROM n20 EXCEPT ALL SELECT * FROM t20)) GROUP BY 1, 2""",
    NARROW))
def _(c: Context):
    return joins.multiset_difference(c.t20_by_day, c.t20_narrow_by_day).groupBy("side", "sensor_name").agg(
        F.count("*").alias("n"))


@query("set_u3_identifier_sets", with_base(
    """SELECT 'only_flagged' AS part, id AS source_address FROM
         (SELECT id FROM sec1 EXCEPT SELECT id FROM t20)
       UNION ALL SELECT 'both', id FROM (SELECT id FROM sec1 INTERSECT SELECT id FROM t20)"""))
def _(c: Context):
    a, b = c.sec1.select("source_address"), c.t20.select("source_address")
    return a.subtract(b).withColumn("part", F.lit("only_flagged")).unionByName(
        a.intersect(b).withColumn("part", F.lit("both")))


@query("set_u4_distinct", with_base(
    f"SELECT DISTINCT sensor AS sensor_name, id AS source_address, {day('w')} AS local_date FROM t20"))
def _(c: Context):
    return c.t20.select("sensor_name", "source_address", local_date("timestamp").alias("local_date")).distinct()
