"""Queries for randomization diagnostics, pseudonyms, release differences and disclosure (B, X).

The key of the registered queries is a public test key, so the counterparts spell out HMAC in SQL.
"""

from pyspark.sql import functions as F

from waymark.functions.identifiers import capture_prefix, legacy_identifier, release_prefix
from waymark.operators import diagnostics, disclosure, quality, release, scan
from waymark.plans.catalog_relational import _FIT, NARROW, SEQ_SQL, STREAMS
from waymark.plans.context import Context, query
from waymark.plans.oracle import KST, RAW, big, day, r6, with_base
from waymark.sources import tables

# Public test key and domains: the registered queries publish nothing.
TEST_KEY = bytes(range(32))
TEST_DOMAIN = b"waymark-test"

# Randomization ---------------------------------------------------------------------------


@query("random_b1_flagged_shares", with_base(
    f"""SELECT site, count(DISTINCT sensor) AS n_sensors, count(*) AS n_detections,
        {r6('avg(rnd::INT) * 100')} AS det_pct_laa_flagged, count(DISTINCT address) AS n_distinct_addresses,
        count(DISTINCT address) FILTER (WHERE rnd) AS n_laa_flagged_addresses,
        count(DISTINCT address) FILTER (WHERE NOT rnd) AS n_laa_unflagged_addresses,
        {r6('count(DISTINCT address) FILTER (WHERE rnd) * 100.0 / count(DISTINCT address)')} AS address_pct_laa_flagged,
        {r6('count(DISTINCT address) FILTER (WHERE rnd) * 100.0 / count(DISTINCT address) / (avg(rnd::INT) * 100)')}
          AS address_to_detection_share_ratio FROM valid GROUP BY 1""", RAW))
def _(c: Context):
    return diagnostics.flagged_shares(diagnostics.flagged(c.raw))


def _hourly(c, *by):
    return diagnostics.hourly_streams(diagnostics.flagged(c.raw), *by)


@query("random_b2_hourly_streams", with_base(
    "SELECT site, h AS hour_epoch, a AS n_random, b AS n_nonrandom FROM streams", STREAMS))
def _(c: Context):
    return _hourly(c)


@query("random_b3_stream_correlation", with_base(
    f"""SELECT site, {r6('corr(a, b)')} AS pearson_r, count(*) AS n_hours, {r6('corr(ra, rb)')} AS spearman_rho
        FROM ranks GROUP BY 1""", STREAMS))
def _(c: Context):
    return diagnostics.stream_correlation(_hourly(c))


SENSOR_STREAMS = RAW + """,
sstreams AS (SELECT site, sensor, t // 3600 AS h, count(DISTINCT address) FILTER (WHERE rnd) AS a,
                    count(DISTINCT address) FILTER (WHERE NOT rnd) AS b FROM valid {rows} GROUP BY 1, 2, 3),
sdiag AS (
  SELECT site, sensor, CASE WHEN count(*) FILTER (WHERE b > 0) >= 10 THEN corr(a, b) END AS pearson_r,
         count(*) AS n_hours, avg(a) AS mean_rand, median(a) AS median_rand,
         count(*) FILTER (WHERE a <= 2) * 100.0 / count(*) AS pct_zero_rand,
         stddev_samp(a) / nullif(avg(a), 0) AS cv_rand, avg(b) AS mean_nonrand, median(b) AS median_nonrand,
         count(*) FILTER (WHERE b <= 2) * 100.0 / count(*) AS pct_zero_nonrand,
         stddev_samp(b) / nullif(avg(b), 0) AS cv_nonrand FROM sstreams GROUP BY 1, 2)"""


@query("random_b4_sensor_correlation", with_base(
    f"SELECT site, sensor AS sensor_name, {r6('pearson_r')} AS pearson_r, n_hours FROM sdiag",
    SENSOR_STREAMS.replace("FROM valid {rows}", "FROM valid WHERE NOT (sensor IN ('s03', 's07') AND t // 3600 % 211 <> 0)")))
def _(c: Context):
    """Two sensors are heard in a few hours only, too few for the default."""
    scarce = F.col("sensor_name").isin("s03", "s07") & (F.floor(F.unix_seconds("timestamp") / 3600) % 211 != 0)
    return diagnostics.sensor_correlation(diagnostics.hourly_streams(diagnostics.flagged(c.raw.filter(~scarce)), "sensor_name"))


_DIAG = ", ".join(f"{r6(f'{v}_{n}')} AS {v}_{n}" for n in ("rand", "nonrand")
                  for v in ("mean", "median", "pct_zero", "cv"))


@query("random_b5_sensor_diagnostics", with_base(
    f"SELECT site, sensor AS sensor_name, {_DIAG} FROM sdiag", SENSOR_STREAMS.replace("{rows}", "")))
def _(c: Context):
    return diagnostics.sensor_diagnostics(_hourly(c, "sensor_name"))


@query("random_b5_sensor_detail", with_base(
    f"""SELECT d.site, d.sensor AS sensor_name, {r6('pearson_r')} AS pearson_r, n_hours, n_detections, {_DIAG}
        FROM (SELECT * REPLACE (CASE WHEN (SELECT count(*) FROM sstreams x WHERE x.site = s.site
                AND x.sensor = s.sensor AND x.b > 0) >= 10 THEN pearson_r END AS pearson_r) FROM sdiag s) d
        JOIN (SELECT site, sensor, count(*) AS n_detections FROM valid GROUP BY 1, 2) n
          ON n.site = d.site AND n.sensor = d.sensor""",
    SENSOR_STREAMS.replace("{rows}", "").replace(">= 10 THEN", ">= 0 THEN")))
def _(c: Context):
    rows = diagnostics.flagged(c.raw)
    return diagnostics.sensor_detail(rows, diagnostics.hourly_streams(rows, "sensor_name"))


@query("random_b6_site_summary", with_base(
    f"""SELECT site, count(*) AS n_sensors, {r6('median(pearson_r)')} AS r_median,
        {r6('quantile_cont(pearson_r, 0.25)')} AS r_q25, {r6('quantile_cont(pearson_r, 0.75)')} AS r_q75,
        count(*) FILTER (WHERE pearson_r > 0.9) AS n_above_09,
        {r6('count(*) FILTER (WHERE pearson_r > 0.9) * 100.0 / count(*)')} AS pct_above_09
        FROM sdiag WHERE pearson_r IS NOT NULL GROUP BY 1""", SENSOR_STREAMS.replace("{rows}", "")))
def _(c: Context):
    return diagnostics.site_correlation_summary(
        diagnostics.sensor_correlation(_hourly(c, "sensor_name")))


@query("random_b7_fit_line", with_base(_FIT, STREAMS))
def _(c: Context):
    return diagnostics.fit_line(_hourly(c))


# Pseudonyms ------------------------------------------------------------------------------

def _hmac(prefix: bytes, text: str) -> str:
    """HMAC-SHA-256 with the test key, as 32 hex digits, in SQL."""
    inner, outer = (bytes(k ^ pad for k in TEST_KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    first = f"unhex(sha256(unhex('{inner}') || unhex('{prefix.hex()}') || encode({text})))"
    return f"substr(sha256(unhex('{outer}') || {first}), 1, 32)"


@query("release_x1_capture_pseudonyms", with_base(
    f"""SELECT address, CAST(substr(address, 2, 1) IN ('2', '6', 'a', 'e') AS BIGINT) AS randomized,
        {_hmac(capture_prefix(TEST_DOMAIN, "test-site"), "address")} AS identifier
        FROM (SELECT DISTINCT lower(address) AS address FROM raw
              WHERE regexp_full_match(lower(address), '([0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}}')
                AND lower(address) <> '00:00:00:00:00:00'
                AND substr(lower(address), 2, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e'))""", RAW))
def _(c: Context):
    return release.capture_pseudonyms(c.raw, "test-site", TEST_KEY, TEST_DOMAIN)


@query("release_x1_usable_addresses", with_base(
    """SELECT DISTINCT lower(address) AS address,
       CAST(substr(lower(address), 2, 1) IN ('2', '6', 'a', 'e') AS BIGINT) AS randomized FROM raw
       WHERE regexp_full_match(lower(address), '([0-9a-f]{2}:){5}[0-9a-f]{2}')
         AND lower(address) <> '00:00:00:00:00:00'
         AND substr(lower(address), 2, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')""", RAW))
def _(c: Context):
    return release.capture_pseudonyms(c.raw, "test-site", TEST_KEY, TEST_DOMAIN).drop("identifier")


@query("release_x2_release_pseudonyms", with_base(
    f"""SELECT id AS internal, {_hmac(release_prefix(TEST_DOMAIN, "test"), "id")} AS public
        FROM (SELECT DISTINCT id FROM t20)"""))
def _(c: Context):
    return release.build_mapping(c.t20, "test", TEST_KEY, TEST_DOMAIN)


@query("release_x3_mapping_checks", with_base(
    """SELECT count(DISTINCT id) AS n_internal, count(DISTINCT id) AS n_public, count(DISTINCT id) AS n_well_formed,
       0 AS n_unchanged FROM t20"""))
def _(c: Context):
    m = release.build_mapping(c.t20, "test", TEST_KEY, TEST_DOMAIN)
    return m.agg(
        F.count("*").alias("n_internal"), F.countDistinct("public").alias("n_public"),
        F.count_if(F.col("public").rlike("^[0-9a-f]{32}$")).alias("n_well_formed"),
        F.count_if(F.col("public") == F.col("internal")).alias("n_unchanged"))


@query("release_x4_rewritten_ids", with_base(
    f"""SELECT sensor AS sensor_name, count(*) AS n_rows, count(DISTINCT id) AS n_ids,
        {big('sum(detections)')} AS detections FROM t20 GROUP BY 1"""))
def _(c: Context):
    public = release.rewrite_ids(c.t20, release.build_mapping(c.t20, "test", TEST_KEY, TEST_DOMAIN))
    return public.groupBy("sensor_name").agg(
        F.count("*").alias("n_rows"), F.countDistinct("source_address").alias("n_ids"),
        F.sum("detections").alias("detections"))


def _two_id_columns(c):
    return c.raw.select(
        "timestamp", "site", F.col("source_address"),
        F.when(F.col("sensor_name") == "s03", F.lit("  ")).otherwise(F.upper(F.concat(
            F.lit("AP-"), "sensor_name"))).alias("access_point_address"))


@query("release_x5_rekey", with_base(
    """SELECT site, count(DISTINCT lower(trim(address))) AS n_sources, count(DISTINCT sensor) AS n_access_points,
       count(*) FILTER (WHERE sensor = 's03') AS n_blank, count(*) AS n_rows FROM raw GROUP BY 1""", RAW))
def _(c: Context):
    keyed = release.rekey(_two_id_columns(c), "scope-a", TEST_KEY, TEST_DOMAIN)
    return keyed.groupBy("site").agg(
        F.countDistinct("source_address").alias("n_sources"),
        F.countDistinct("access_point_address").alias("n_access_points"),
        F.count_if(F.col("access_point_address") == "").alias("n_blank"), F.count("*").alias("n_rows"))


@query("release_x5_already_public", with_base(
    "SELECT 'source_address' AS \"column\", count(DISTINCT id) AS n_identifiers FROM t20"))
def _(c: Context):
    return release.already_public(c.t20)


@query("release_x5_scope_overlap", with_base(
    "SELECT count(DISTINCT lower(trim(address))) AS n_ids, 0 AS n_shared FROM raw", RAW))
def _(c: Context):
    """Two scopes with different keys must not share a pseudonym. All rows are read for their addresses, once."""
    other = bytes(reversed(TEST_KEY))
    ids = c.staged("raw_addresses", lambda: c.raw.select("source_address").distinct())
    a = release.rekey(ids, "scope-a", TEST_KEY, TEST_DOMAIN)
    b = release.rekey(ids, "scope-b", other, TEST_DOMAIN)
    shared = quality.identifier_overlap(a, b).agg(F.count("*")).scalar()
    return a.agg(F.countDistinct("source_address").alias("n_ids")).withColumn("n_shared", shared)


@query("release_x6_legacy_hash", with_base(
    "SELECT DISTINCT address AS source_address, substr(sha256(lower(trim(address))), 1, 16) AS hashed FROM raw", RAW))
def _(c: Context):
    return c.raw.select("source_address").distinct().withColumn("hashed", legacy_identifier("source_address"))


@query("release_x7_values_preserved", with_base(
    """SELECT count(*) FILTER (WHERE sensor = 's03') AS missing_rows,
       count(*) FILTER (WHERE sensor <> 's03' AND (w // 20 % 5 = 0 OR w // 20 % 7 = 0)) AS changed_value_rows FROM t20"""))
def _(c: Context):
    """A release that lost one sensor's rows and changed two measures in some windows."""
    mapping = release.build_mapping(c.t20, "test", TEST_KEY, TEST_DOMAIN)
    u = F.floor(F.unix_seconds("timestamp") / 20)
    spoilt = release.rewrite_ids(c.t20, mapping).filter(F.col("sensor_name") != "s03").withColumn(
        "detections", F.when(u % 5 == 0, F.col("detections") + 1).otherwise(F.col("detections"))).withColumn(
        "rssi_sum", F.when(u % 7 == 0, F.lit(None)).otherwise(F.col("rssi_sum")))
    public = c.spark.read.parquet(c.landed(spoilt, "public"))
    return release.values_preserved(c.t20, public, mapping)


# Release differences ---------------------------------------------------------------------

PAIRED = NARROW + """,
paired AS (
  SELECT a.id AS ca, b.id AS cb, abs(a.rssi_median - b.rssi_median) > 1e-9 AS d1,
         abs(a.rssi_sum - b.rssi_sum) > 1e-9 AS d2, a.detections IS DISTINCT FROM b.detections AS d3,
         abs(a.strength_sum - b.strength_sum) > 1e-9 AS d4
  FROM t20 a FULL OUTER JOIN n20 b ON a.id = b.id AND a.w = b.w AND a.sensor = b.sensor)"""


@query("release_x8_row_impact", with_base(
    """SELECT count(ca) AS current_rows, count(cb) AS candidate_rows,
       count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL) AS matched_keys,
       count(*) FILTER (WHERE ca IS NULL) AS candidate_only_keys,
       count(*) FILTER (WHERE cb IS NULL) AS current_only_keys,
       count(*) FILTER (WHERE both_in AND (d1 OR d2 OR d3 OR d4)) AS matched_rows_with_changed_values,
       count(*) FILTER (WHERE both_in AND d1) AS rows_changed_rssi_median,
       count(*) FILTER (WHERE both_in AND d2) AS rows_changed_rssi_sum,
       count(*) FILTER (WHERE both_in AND d3) AS rows_changed_detections,
       count(*) FILTER (WHERE both_in AND d4) AS rows_changed_strength_sum,
       count(*) FILTER (WHERE both_in AND NOT (d1 OR d2 OR d3 OR d4)) AS fully_unchanged_rows,
       count(*) FILTER (WHERE NOT both_in OR d1 OR d2 OR d3 OR d4) AS changed_union_rows
       FROM (SELECT *, ca IS NOT NULL AND cb IS NOT NULL AS both_in FROM paired)""", PAIRED))
def _(c: Context):
    return release.row_impact(c.t20, c.t20_narrow)


@query("release_x9_location_impact", with_base(
    """SELECT count(a.id) AS current_device_windows, count(b.id) AS candidate_device_windows,
       count(*) FILTER (WHERE a.id IS NULL) AS candidate_only_device_windows,
       count(*) FILTER (WHERE b.id IS NULL) AS current_only_device_windows,
       count(*) FILTER (WHERE a.sensor = b.sensor) AS same_location_assignments,
       count(*) FILTER (WHERE a.sensor <> b.sensor) AS changed_location_assignments
       FROM loc a FULL OUTER JOIN nloc b ON a.id = b.id AND a.w = b.w""", NARROW))
def _(c: Context):
    return c.in_place(release.location_impact(c.t20_by_day, c.t20_narrow_by_day), "impact")


def _period_sql(seconds):
    def side(table, name):
        return f"""{name} AS (SELECT (w + {KST}) // {seconds} * {seconds} AS p, count(*) AS r,
            count(DISTINCT (id, w)) AS dw, count(DISTINCT id) AS d, CAST(sum(detections) AS BIGINT) AS det
            FROM {table} GROUP BY 1)"""

    return NARROW + ",\n" + side("t20", "cur") + ",\n" + side("n20", "cand") + """,
periods AS (
  SELECT coalesce(a.p, b.p) AS local_period_epoch, a.r AS current_sensor_window_rows,
         b.r AS candidate_sensor_window_rows, b.r - a.r AS sensor_window_row_difference,
         a.dw AS current_device_windows, b.dw AS candidate_device_windows, b.dw - a.dw AS device_window_difference,
         a.d AS current_devices, b.d AS candidate_devices, b.d - a.d AS device_difference,
         a.det AS current_detections, b.det AS candidate_detections, b.det - a.det AS detection_difference
  FROM cur a FULL OUTER JOIN cand b ON a.p = b.p)"""


@query("release_x10_daily_difference", with_base("SELECT * FROM periods", _period_sql(86400)))
def _(c: Context):
    return release.period_diff(c.t20_by_day, c.t20_narrow_by_day, "day")


@query("release_x10_hourly_difference", with_base("SELECT * FROM periods", _period_sql(3600)))
def _(c: Context):
    return release.period_diff(c.t20, c.t20_narrow, "hour")


_DIFFERENCES = list(release.PERIOD_MEASURES.values())


@query("release_x10_difference_summary", with_base(
    "SELECT 'hour' AS grain, count(*) AS periods, "
    + ", ".join(f"count(*) FILTER (WHERE {d} <> 0) AS periods_with_{d}" for d in _DIFFERENCES) + ", "
    + ", ".join(f"max(abs({d})) AS max_abs_{d}" for d in _DIFFERENCES) + " FROM periods", _period_sql(3600)))
def _(c: Context):
    return release.period_diff_summary(release.period_diff(c.t20, c.t20_narrow, "hour"), "hour")


@query("release_x11_dataset_overview", with_base(
    f"""SELECT count(*) AS records, count(DISTINCT id) AS devices, count(DISTINCT sensor) AS sensors,
        {big('sum(detections)')} AS total_detections, min(detections) AS minimum_detections,
        max(detections) AS maximum_detections,
        count(*) FILTER (WHERE detections < 1 OR detections > 20) AS rows_outside_one_to_twenty,
        count(DISTINCT (id, w)) AS device_windows FROM t20"""))
def _(c: Context):
    return release.dataset_overview(c.t20)


# Disclosure ------------------------------------------------------------------------------

RESIDENTIAL = "s0[0-3]"
PROFILE = SEQ_SQL + f""",
prof AS (
  SELECT id, count(*) AS n_rows, count(DISTINCT sensor) AS n_sensors, count(DISTINCT l // 86400) AS n_days,
         max(l) - min(l) AS span_seconds, first(sensor ORDER BY l, sensor) AS first_sensor,
         last(sensor ORDER BY l, sensor) AS last_sensor, min(l) // 1800 AS first_half_hour,
         max(l) // 1800 AS last_half_hour, max(CASE WHEN l // 3600 % 24 <= 4 THEN 1 ELSE 0 END) AS has_night,
         max(CASE WHEN regexp_matches(sensor, '{RESIDENTIAL}') THEN 1 ELSE 0 END) AS has_residential,
         max(CASE WHEN regexp_matches(sensor, '{RESIDENTIAL}') AND l // 3600 % 24 <= 4 THEN 1 ELSE 0 END)
           AS has_residential_night
  FROM (SELECT *, w + {KST} AS l FROM t20) GROUP BY id),
coarse AS (
  SELECT concat_ws('|', first_sensor, first_half_hour, last_sensor, last_half_hour, n_days, n_sensors,
                   CAST(floor(log2(n_rows)) AS BIGINT), has_night) AS signature, count(*) AS group_size
  FROM prof GROUP BY 1),
routine AS (
  SELECT concat_ws('|', first_sensor, first_half_hour % 48, last_sensor, last_half_hour % 48,
                   CASE WHEN n_days = 1 THEN '1' WHEN n_days <= 3 THEN '2-3' WHEN n_days <= 7 THEN '4-7' ELSE '8+' END,
                   CASE WHEN n_sensors = 1 THEN '1' WHEN n_sensors <= 3 THEN '2-3' WHEN n_sensors <= 7 THEN '4-7'
                        ELSE '8+' END,
                   CAST(floor(log2(n_rows)) AS BIGINT), has_night) AS signature, count(*) AS group_size
  FROM prof GROUP BY 1),
sequences AS (SELECT d, q, n, count(*) AS group_size FROM seqs GROUP BY 1, 2, 3)"""


def _profile(c):
    return disclosure.identifier_profile(c.t20, RESIDENTIAL)


@query("disclosure_x12_identifier_profile", with_base("SELECT * RENAME (id AS source_address) FROM prof", PROFILE))
def _(c: Context):
    return _profile(c)


@query("disclosure_x13_coarse_signature", with_base("SELECT * FROM coarse", PROFILE))
def _(c: Context):
    return disclosure.coarse_signature(_profile(c))


@query("disclosure_x14_routine_signature", with_base("SELECT * FROM routine", PROFILE))
def _(c: Context):
    return disclosure.routine_signature(_profile(c))


@query("disclosure_x15_daily_sequence", with_base(
    f"""SELECT {day(f'(d * 86400 - {KST})')} AS local_date, q AS sensor_sequence, n AS sensors_visited, group_size
        FROM sequences""", PROFILE))
def _(c: Context):
    return disclosure.daily_sequence_sizes(disclosure.daily_sequence(c.t20_by_day))


def _sizes_sql(table, label):
    return f"""UNION ALL SELECT '{label}_unique', sum(CASE WHEN group_size = 1 THEN 1 ELSE 0 END) FROM {table}
        UNION ALL SELECT '{label}_in_groups_under_5', sum(CASE WHEN group_size < 5 THEN group_size ELSE 0 END) FROM {table}
        UNION ALL SELECT '{label}_largest_group', max(group_size) FROM {table} """


_OVERVIEW = {
    "identifiers": "count(*)", "one_row_identifiers": "count(*) FILTER (WHERE n_rows = 1)",
    "under_five_rows": "count(*) FILTER (WHERE n_rows < 5)",
    "under_ten_rows": "count(*) FILTER (WHERE n_rows < 10)",
    "one_sensor_identifiers": "count(*) FILTER (WHERE n_sensors = 1)",
    "one_day_identifiers": "count(*) FILTER (WHERE n_days = 1)",
    "multi_day_identifiers": "count(*) FILTER (WHERE n_days >= 2)",
    "span_at_least_7d": "count(*) FILTER (WHERE span_seconds >= 604800)",
    "identifiers_with_night_observation": "sum(has_night)",
    "identifiers_at_residential_sensor": "sum(has_residential)",
    "identifiers_at_residential_sensor_night": "sum(has_residential_night)",
}
INDICATORS = PROFILE + ",\nindicators AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {e} AS value FROM prof" for m, e in _OVERVIEW.items()) + " " + \
    _sizes_sql("coarse", "coarse_signature") + _sizes_sql("routine", "routine_signature") + \
    _sizes_sql("sequences", "daily_sequence") + \
    "UNION ALL SELECT 'identifier_days', sum(group_size) FROM sequences)"


@query("disclosure_x16_indicators", with_base(
    f"SELECT 'site' AS site, metric, {r6('value')} AS value FROM indicators", INDICATORS))
def _(c: Context):
    return disclosure.disclosure_indicators(c.t20_by_day, "site", RESIDENTIAL, c.stage())


@query("disclosure_x16_indicator_percent", with_base(
    f"""SELECT 'site' AS site, metric, {r6('value')} AS value,
        {r6('value * 100.0 / (SELECT count(*) FROM prof)')} AS percent FROM indicators""", INDICATORS))
def _(c: Context):
    return disclosure.as_percent(disclosure.disclosure_indicators(c.t20_by_day, "site", RESIDENTIAL, c.stage()))


# Fixed values, written out again for the counterpart: markers by class, and the patterns without look-around, which DuckDB's
# regular expressions lack.
_WORDS = {
    "private identifier-mapping field": "internal_source_address public_source_address mapping_file mapping_path",
    "release-key field or file marker": "key_file key_path key_hex secret_key private_key release.key",
    "raw capture field": "raw_mac_address destination_address frame_bytes packet_bytes bssid ssid",
}
_RE2 = {
    "MAC-like value": r"(?i)(^|[^0-9a-f])([0-9a-f]{2}[:-]){5}[0-9a-f]{2}([^0-9a-f]|$)",
    "private-key block": r"(?i)-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "AWS access token": r"(^|[^A-Z0-9])AKIA[0-9A-Z]{16}([^A-Z0-9]|$)",
    "GitHub access token": r"(?i)(github_pat_[a-z0-9_]{20}|gh[opusr]_[a-z0-9_]{20})",
    "Google API token": r"AIza[0-9A-Za-z_-]{35}",
    "Slack access token": r"xox[baprs]-[0-9A-Za-z-]{20}",
    "credential-bearing URL": r"(?i)https?://[^/\s:@]{1,64}:[^/\s@]{4,}@",
    "assigned credential or key material": (
        r"(?i)(^|[^a-z0-9_])(api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|"
        r"private[_-]?key|deployment[_-]?key|release[_-]?key)\s*[\"']?\s*[:=]\s*[\"']?"
        r"([0-9a-f]{32,}|[a-z0-9+/=_-]{24,})"),
}


def _scan_sql(table, key, text):
    classes = [f"CASE WHEN {' OR '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})' for w in words.split())} "
               f"THEN '{name}' END" for name, words in _WORDS.items()]
    classes += [f"CASE WHEN regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}' END"
                for name, p in _RE2.items()]
    return f"SELECT * FROM (SELECT {key}, unnest([{', '.join(classes)}]) AS finding FROM {table}) " \
           "WHERE finding IS NOT NULL"


# The tables name no class the scan looks for, so each class is planted in some of their rows:
# values come from the row's number, its hash and the tokens the texts do contain.

def _planted(c, table, key, column):
    h, n = F.md5(F.col(key).cast("string").cast("binary")), F.col(key) % 12
    address = F.concat_ws(":", *[F.substring(h, 2 * i + 1, 2) for i in range(6)])
    extra = (
        F.when(n == 0, address).when(n == 1, F.concat(F.lit("x"), address, F.lit("-")))
        .when(n == 2, F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))))
        .when(n == 3, F.concat(F.lit("ghp_"), h)).when(n == 4, F.concat(F.lit("AIza"), h, F.lit("abc")))
        .when(n == 5, F.concat(F.lit("xoxb-"), h)).when(n == 6, F.concat(F.lit("http://u:"), h, F.lit("@host")))
        .when(n == 7, F.lit("Mapping_File")).when(n == 8, F.lit("key_hex")).when(n == 9, F.lit("BSSID"))
        .when(n == 10, F.concat(F.lit("-----BEGIN "), F.lit("PRIVATE KEY-----"))).otherwise("")
    )
    text = F.replace(F.col(column), F.lit('token = "'), F.lit('access_token = "'))
    return c.table(table).select(key, F.concat(text, F.lit(" "), extra).alias(column))


def _planted_sql(table, key, column):
    return f"""(SELECT {key}, replace({column}, 'token = "', 'access_token = "') || ' ' || CASE {key} % 12
    WHEN 0 THEN a WHEN 1 THEN 'x' || a || '-' WHEN 2 THEN 'AKIA' || upper(substr(h, 1, 16)) WHEN 3 THEN 'ghp_' || h
    WHEN 4 THEN 'AIza' || h || 'abc' WHEN 5 THEN 'xoxb-' || h WHEN 6 THEN 'http://u:' || h || '@host'
    WHEN 7 THEN 'Mapping_File' WHEN 8 THEN 'key_hex' WHEN 9 THEN 'BSSID'
    WHEN 10 THEN '-----BEGIN ' || 'PRIVATE KEY-----' ELSE '' END AS {column}
  FROM (SELECT *, substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2)
               || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2) AS a
        FROM (SELECT *, md5(CAST({key} AS VARCHAR)) AS h FROM {table})))"""


_DOCUMENTS, _PAGES = ("documents", "doc_id", "text"), ("pages", "page_id", "html")


@query("disclosure_x17_document_findings", _scan_sql(_planted_sql(*_DOCUMENTS), "doc_id", "text"))
def _(c: Context):
    return scan.content_findings(_planted(c, *_DOCUMENTS), "doc_id", "text")


@query("disclosure_x17_page_scan",
       f"SELECT finding, count(*) AS n_texts FROM ({_scan_sql(_planted_sql(*_PAGES), 'page_id', 'html')}) GROUP BY 1")
def _(c: Context):
    return scan.content_scan(_planted(c, *_PAGES), "page_id", "html")


@query("disclosure_x17_document_scan",
       f"SELECT finding, count(*) AS n_texts FROM ({_scan_sql(_planted_sql(*_DOCUMENTS), 'doc_id', 'text')}) GROUP BY 1")
def _(c: Context):
    return scan.content_scan(_planted(c, *_DOCUMENTS), "doc_id", "text")
