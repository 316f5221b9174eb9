"""The tables of the queries as plain SQL (DuckDB), for side-by-side checks.

Written from the rules, not from the Spark plans: simple windows over whole identifiers.
Times are epoch seconds, identifiers ``id``, sensors ``sensor``.
"""

KST = 32400

BASE = """
sensors AS (
  SELECT i, 's' || lpad(CAST(i AS VARCHAR), 2, '0') AS sensor,
         CAST(i % 5 * 60 AS DOUBLE) AS x, CAST(i // 5 * 60 AS DOUBLE) AS y,
         CASE WHEN i % 3 = 0 THEN 'Pedestrian' ELSE 'Regular' END AS street_type
  FROM range(17) r(i)),
burst AS (
  SELECT event_id, user_id, k, b,
         epoch_us(ts) + k * (CASE WHEN event_id % 50 = 7 THEN 75 WHEN event_id % 2 = 0 THEN 9
                             ELSE 25 END) * 1000000 + (k % 3) * 137000 AS us,
         CASE WHEN event_id % 4 IN (0, 1) OR event_id % 50 = 7 THEN (event_id + b) % 17
              ELSE (event_id + k // 20 + 3 * b) % 17 END AS s,
         -(35 + (event_id * 31 + k * 7 + b * 23) % 60) AS strength
  FROM events, range(60) rk(k), range(2) rb(b) WHERE k <= event_id * 17 % 60),
packets AS (
  SELECT us, us // 1000000 AS t, 'management' AS type,
         CASE WHEN (event_id + k) % 11 = 0 THEN 'beacon'
              WHEN (event_id + k) % 13 = 0 THEN 'probe-response' ELSE 'probe-request' END AS subtype,
         strength, md5(CAST(user_id AS VARCHAR)) AS id,
         CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS flag, s % 14 + 1 AS channel,
         's' || lpad(CAST(s AS VARCHAR), 2, '0') AS sensor
  FROM burst
  UNION ALL
  SELECT us + j * 60000000, (us + j * 60000000) // 1000000, 'data', 'qos-data', -50,
         md5(CAST(user_id AS VARCHAR)), CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END, 1, 's00'
  FROM (SELECT user_id, min(epoch_us(ts)) AS us FROM events WHERE user_id % 7 = 3 GROUP BY user_id),
       range(181) r(j)),
accepted AS (
  SELECT * FROM packets WHERE strength BETWEEN -80 AND -30
    AND lower(subtype) NOT IN ('beacon', 'probe-response')),
sec1 AS MATERIALIZED (
  SELECT t, id, sensor, min(flag) AS flag, median(strength) AS m, count(*) AS n
  FROM accepted GROUP BY t, id, sensor),
sess AS (
  SELECT id, sensor, g, min(t) AS t0, max(t) AS t1, count(*) AS n FROM (
    SELECT *, sum(brk) OVER (PARTITION BY id, sensor ORDER BY t) AS g FROM (
      SELECT id, sensor, t,
             CASE WHEN t - lag(t) OVER (PARTITION BY id, sensor ORDER BY t) <= 300 THEN 0 ELSE 1 END AS brk
      FROM sec1 WHERE flag = 0)) GROUP BY id, sensor, g),
cleaned AS (
  SELECT * FROM sec1 a WHERE flag = 0
    AND NOT EXISTS (SELECT 1 FROM sess b WHERE b.id = a.id AND t1 - t0 > 7200)),
t20 AS (
  SELECT t // 20 * 20 AS w, id, sensor, median(m) AS rssi_median, sum(m) AS rssi_sum,
         count(*) AS detections, 100 * count(*) + sum(m) AS strength_sum
  FROM cleaned GROUP BY 1, 2, 3),
loc AS (
  SELECT w, id, a.sensor, x, y, strength_sum, detections FROM (
    SELECT *, row_number() OVER (PARTITION BY id, w ORDER BY strength_sum DESC, sensor) AS rn
    FROM t20) a JOIN sensors s ON a.sensor = s.sensor WHERE rn = 1)"""


PLANTED = """,
planted AS (
  SELECT u, CASE WHEN u % 23 = 0 THEN 2 ELSE 1 END AS copies, rssi_sum,
         CASE WHEN u % 11 = 0 THEN 21 ELSE detections END AS detections,
         CASE WHEN u % 13 = 0 THEN strength_sum + 0.5 ELSE strength_sum END AS strength_sum
  FROM (SELECT *, w // 20 AS u FROM t20))"""


def trajectories(gap: int, name: str) -> str:
    """Rows ``name_rows`` with trajectory number ``tid``, and their summary ``name``."""
    return f""",
{name}_rows AS (
  SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY w) AS tid FROM (
    SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY id ORDER BY w) <= {gap} THEN 0 ELSE 1 END AS brk
    FROM loc)),
{name} AS (
  SELECT id, CAST(tid AS BIGINT) AS tid, min(w) AS t0, max(w) AS t1, max(w) - min(w) AS dur,
         count(*) AS n, arg_min(sensor, w) AS origin, arg_max(sensor, w) AS destination,
         count(DISTINCT sensor) AS n_sensors,
         CASE WHEN count(*) >= 2 AND arg_min(sensor, w) <> arg_max(sensor, w) THEN 1 ELSE 0 END AS is_od
  FROM {name}_rows GROUP BY id, tid)"""


TRIPS = trajectories(1800, "trips")
VISITS = trajectories(7200, "visits")

BANDS = f""",
week AS (
  SELECT * FROM t20 WHERE w + {KST} >= epoch(TIMESTAMP '2024-01-08 00:00:00')
    AND w + {KST} < epoch(TIMESTAMP '2024-01-15 00:00:00')),
bands AS (
  SELECT id, n_days, CASE WHEN n_days = 1 THEN '1 day' WHEN n_days >= 5 THEN '5–7 days'
                     ELSE '2–4 days' END AS band
  FROM (SELECT id, count(DISTINCT (w + {KST}) // 86400) AS n_days FROM week GROUP BY id))"""


# The same from a week in which some identifiers are seen on one day only; ``Context.planted_week`` says the same.
PLANTED_BANDS = BANDS.replace("TIMESTAMP '2024-01-15 00:00:00')),", f"""TIMESTAMP '2024-01-15 00:00:00')
    AND (substr(id, 1, 1) > '3' OR (w + {KST}) // 86400 % 7 = ascii(substr(id, 2, 1)) % 7)),""", 1)

# The same from all days; ``Context.whole_bands`` says the same.
WHOLE_BANDS = BANDS.replace(f"""SELECT * FROM t20 WHERE w + {KST} >= epoch(TIMESTAMP '2024-01-08 00:00:00')
    AND w + {KST} < epoch(TIMESTAMP '2024-01-15 00:00:00')),""", "SELECT * FROM t20),", 1)


def episodes(visits: str, keep: str, metres: float, name: str = "ep") -> str:
    """Episodes of the kept trajectories: anchor clusters by recursion over row numbers."""
    return f""",
{name}_kept AS (SELECT id, tid FROM {visits} WHERE {keep}),
{name}_seq AS (
  SELECT r.id, r.tid, r.w, r.sensor, r.x, r.y,
         row_number() OVER (PARTITION BY r.id, r.tid ORDER BY r.w) AS rn
  FROM {visits}_rows r JOIN {name}_kept k ON r.id = k.id AND r.tid = k.tid),
{name}_walk(id, tid, rn, ax, ay, cl) AS (
  SELECT id, tid, rn, x, y, 1 FROM {name}_seq WHERE rn = 1
  UNION ALL
  SELECT s.id, s.tid, s.rn,
         CASE WHEN sqrt((s.x - ax) * (s.x - ax) + (s.y - ay) * (s.y - ay)) > {metres} THEN s.x ELSE ax END,
         CASE WHEN sqrt((s.x - ax) * (s.x - ax) + (s.y - ay) * (s.y - ay)) > {metres} THEN s.y ELSE ay END,
         CASE WHEN sqrt((s.x - ax) * (s.x - ax) + (s.y - ay) * (s.y - ay)) > {metres} THEN cl + 1 ELSE cl END
  FROM {name}_walk a JOIN {name}_seq s ON s.id = a.id AND s.tid = a.tid AND s.rn = a.rn + 1),
{name}_rows AS (
  SELECT *, sum(brk) OVER (PARTITION BY id, tid, cl ORDER BY w) AS ep FROM (
    SELECT s.*, a.cl, CASE WHEN s.w - lag(s.w) OVER (PARTITION BY s.id, s.tid, a.cl ORDER BY s.w) < 600
                      THEN 0 ELSE 1 END AS brk
    FROM {name}_seq s JOIN {name}_walk a ON s.id = a.id AND s.tid = a.tid AND s.rn = a.rn)),
{name}_mode AS (
  SELECT id, tid, cl, ep, sensor FROM (
    SELECT id, tid, cl, ep, sensor, row_number() OVER (
             PARTITION BY id, tid, cl, ep ORDER BY count(*) DESC, sensor) AS rn
    FROM {name}_rows GROUP BY id, tid, cl, ep, sensor) WHERE rn = 1),
{name} AS (
  SELECT e.*, m.sensor AS primary_sensor, CASE WHEN dur >= 300 THEN 1 ELSE 0 END AS is_stay,
         CASE WHEN dur < 300 THEN 'Pass-through' WHEN dur < 900 THEN 'Short stay'
              WHEN dur < 3600 THEN 'Medium stay' ELSE 'Long stay' END AS activity_type
  FROM (SELECT id, tid, cl, ep, min(w) AS t0, max(w) AS t1, max(w) - min(w) AS dur, count(*) AS n,
               count(DISTINCT sensor) AS n_sensors
        FROM {name}_rows GROUP BY id, tid, cl, ep) e
  JOIN {name}_mode m USING (id, tid, cl, ep))"""


EPISODES = VISITS + episodes("visits", "n >= 3 AND dur <= 7200", 75)

RAW = """
raw AS (
  SELECT us // 1000000 AS t,
         CASE WHEN user_id % 50 = 11 THEN '00:00:00:00:00:00' WHEN user_id % 50 = 12 THEN 'FF:FF:FF:FF:FF:FF'
              WHEN user_id % 50 = 13 THEN 'not-an-address'
              WHEN user_id % 2 = 0 THEN upper(a) ELSE a END AS address,
         's' || lpad(CAST(s AS VARCHAR), 2, '0') AS sensor, 'c' || CAST(s AS VARCHAR) AS code,
         CASE WHEN (event_id + k) % 97 = 0 THEN -255 WHEN (event_id + k) % 101 = 0 THEN 0
              ELSE strength END AS rssi,
         CASE WHEN user_id % 2 = 0 THEN 'campus' ELSE 'district' END AS site
  FROM (SELECT *, substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' ||
                  substr(h, 7, 2) || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2) AS a
        FROM (SELECT *, md5(CAST(user_id AS VARCHAR)) AS h FROM burst))),
valid AS (
  SELECT *, lower(substr(address, 2, 1)) IN ('2', '3', '6', '7', 'a', 'b', 'e', 'f') AS rnd FROM raw
  WHERE regexp_full_match(lower(address), '([0-9a-f]{2}:){5}[0-9a-f]{2}')
    AND lower(address) NOT IN ('00:00:00:00:00:00', 'ff:ff:ff:ff:ff:ff'))"""

# The raw table with rare identifiers, and with one long stay each for some: what the default thresholds tell apart.
# ``Context.raw_planted`` says the same.
RAW_PLANTED = RAW.replace("raw AS (", "raw0 AS (", 1).replace("""valid AS (""", """first AS (
  SELECT address, site, min(t) AS t0, substr(md5(lower(address)), 1, 1) AS d FROM raw0 GROUP BY address, site),
raw AS (
  SELECT t, address, sensor, code, rssi, site FROM raw0
  WHERE t % (CASE substr(md5(lower(address)), 1, 1) WHEN '0' THEN 97 WHEN '1' THEN 499 WHEN '2' THEN 997 WHEN '3' THEN 1999
             ELSE 1 END) = 0
  UNION ALL
  SELECT t0 + j * 240, address, 's02', 'c2', -50, site FROM first, range(31) r(j) WHERE d = 'a' OR d = 'b' AND j < 30),
valid AS (""", 1)

GPS = """
gps AS (
  SELECT md5(CAST(user_id AS VARCHAR)) AS id, us // 1000000 + 3 AS t,
         CAST(s % 5 * 60 + event_id * 7 % 41 - 20 AS DOUBLE) AS x,
         CAST(s // 5 * 60 + event_id * 13 % 37 - 18 AS DOUBLE) AS y
  FROM burst WHERE user_id % 3 = 1 AND b = 0 AND k % 2 = 0)"""


def with_base(body: str, *parts: str) -> str:
    return "WITH RECURSIVE" + BASE + "".join(
        p if p.lstrip().startswith(",") else "," + p for p in parts
    ) + "\n" + body


def day(expr: str) -> str:
    """Epoch seconds to the text of its local date."""
    return f"strftime(make_timestamp(({expr} + {KST}) * 1000000), '%Y-%m-%d')"


def utc_text(expr: str) -> str:
    return f"strftime(make_timestamp(({expr}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def hour(expr: str) -> str:
    return f"(({expr} + {KST}) // 3600 % 24)"


def day_type(expr: str, offset: int = KST) -> str:
    """1970-01-01 was a Thursday: days 2 and 3 of a seven-day count are the weekend."""
    return f"(CASE WHEN (({expr} + {offset}) // 86400) % 7 IN (2, 3) THEN 'Weekend' ELSE 'Weekday' END)"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
