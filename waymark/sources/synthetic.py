"""Sensor tables derived from the ``events`` table by plain arithmetic on its columns.

``events`` holds no detections, so every event is expanded to a burst of packets. The
ties, randomized identifiers and stationary sources at every scale.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions.identifiers import canonical_address
from waymark.functions.islands import DAY, UTC_DAY
from waymark.functions.timefn import ntz_as_utc

N_SENSORS = 17

# Events a task expands, to some 60 packets each: what a task sorts does not grow with the table.
EVENTS_A_TASK = 20_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")


def sensor_name(index: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(index.cast("string"), 2, "0"))


def sensor_x(index: Column) -> Column:
    return (index % 5 * 60).cast("double")


def sensor_y(index: Column) -> Column:
    return (F.floor(index / 5) * 60).cast("double")


def sensors(spark: SparkSession) -> DataFrame:
    """The sensor dimension: a 5-wide grid, 60 m apart, in local metres."""
    index = F.col("id")
    return spark.range(N_SENSORS).select(
        sensor_name(index).alias("sensor_name"),
        sensor_x(index).alias("x"),
        sensor_y(index).alias("y"),
        F.lit("local_cartesian_metres").alias("coordinate_system"),
        F.lit(1).alias("is_synthetic"),
    )


def district_sensors(spark: SparkSession) -> DataFrame:
    """Sensor codes as captured (``id_last``) and as published (``id_sensor``), with street type."""
    index = F.col("id")
    return spark.range(N_SENSORS).select(
        F.concat(F.lit("c"), index.cast("string")).alias("id_last"),
        sensor_name(index).alias("id_sensor"),
        F.when(index % 3 == 0, "Pedestrian").otherwise("Regular").alias("street_type"),
        sensor_x(index).alias("x"),
        sensor_y(index).alias("y"),
    )


def identifier(user_id: Column) -> Column:
    return F.md5(user_id.cast("string").cast("binary"))


def hardware_address(user_id: Column) -> Column:
    """Colon-separated addresses, some of them placeholders the cleaning must reject."""
    h = identifier(user_id)
    pairs = F.concat_ws(":", *[F.substring(h, 2 * i + 1, 2) for i in range(6)])
    return (
        F.when(user_id % 50 == 11, "00:00:00:00:00:00")
        .when(user_id % 50 == 12, "FF:FF:FF:FF:FF:FF")
        .when(user_id % 50 == 13, "not-an-address")
        .when(user_id % 2 == 0, F.upper(pairs))
        .otherwise(pairs)
    )


# Steps after which a burst on the move reaches its next sensor.
STEPS_A_SENSOR = 20


def _step_us():
    """The time of step ``k`` of a burst that starts at ``us``."""
    return F.col("us") + (F.col("k") * F.col("step")).cast("long") * 1000000 + F.when(
        F.col("event_id").isNull(), 0).otherwise(F.col("k") % 3 * 137000)


def _branches():
    return F.explode(F.when(F.col("event_id").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks over the expanded events: their number grows with the table."""
    wanted = -(-events(spark, sf_dir).count() // EVENTS_A_TASK)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)


def _laid_out(spark: SparkSession, sf_dir: str, starts: DataFrame) -> DataFrame:
    """Bursts (start ``us``, last step ``last``, ``step`` seconds) dealt by identifier and UTC day before they are expanded to
    packets. A burst that runs over midnight goes to both days, and each keeps the packets of its own. Events are far fewer than
    packets, and what follows by (identifier, day) needs no exchange of packets."""
    def day(us):
        return F.floor(F.floor(us / 1000000) / DAY)

    end = F.col("us") + (F.col("last") * F.col("step") + 1).cast("long") * 1000000
    dealt = starts.withColumn(UTC_DAY, F.explode_outer(F.sequence(day(F.col("us")), day(end)))).repartition(
        parts(spark, sf_dir), "source_address", UTC_DAY)
    return (
        dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("us", _step_us())
        .filter(day(F.col("us")).eqNullSafe(F.col(UTC_DAY)))
        .withColumn("b", _branches())
    )


def _moving(spark: SparkSession, sf_dir: str, address: Column) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).filter(e.isNotNull()).select(
        "event_id", "user_id", address.alias("source_address"), F.unix_micros(ntz_as_utc("ts")).alias("us"),
        (e * 17 % 60).cast("int").alias("last"),
        F.when(e % 50 == 7, 75).when(e % 2 == 0, 9).otherwise(25).alias("step"))


def _stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with user_id % 7 = 3 also own a device that never moves: one row a minute for 3 h."""
    first = (
        events(spark, sf_dir).filter(F.col("user_id") % 7 == 3)
        .groupBy("user_id").agg(F.min("ts").alias("ts"))
    )
    return first.select(
        F.lit(None).cast("long").alias("event_id"), "user_id", identifier(F.col("user_id")).alias("source_address"),
        F.unix_micros(ntz_as_utc("ts")).alias("us"), F.lit(180).alias("last"), F.lit(60).alias("step"))


def _sensor_and_strength(bursts: DataFrame) -> DataFrame:
    """Sensor and strength of every event, step k and sensor branch b."""
    e, k, b = F.col("event_id"), F.col("k"), F.col("b")
    dwells = (e % 4).isin(0, 1) | (e % 50 == 7)
    return (
        bursts.withColumn(
            "sensor",
            F.when(e.isNull(), 0).when(dwells, (e + b) % N_SENSORS)
            .otherwise((e + F.floor(k / STEPS_A_SENSOR) + 3 * b) % N_SENSORS),
        )
        .withColumn("strength", F.when(e.isNull(), -50).otherwise(-(35 + (e * 31 + k * 7 + b * 23) % 60)).cast("int"))
    )


def _bursts(spark: SparkSession, sf_dir: str, address: Column = None) -> DataFrame:
    """One row per event, step k and sensor branch b, before the packet columns are formed."""
    address = identifier(F.col("user_id")) if address is None else address
    return _sensor_and_strength(_laid_out(spark, sf_dir, _moving(spark, sf_dir, address)))


def packets_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture table, timestamps parsed, laid out by identifier and ``utc_day``."""
    return _packet_columns(_sensor_and_strength(_laid_out(spark, sf_dir, _starts(spark, sf_dir))), UTC_DAY)


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moving(spark, sf_dir, identifier(F.col("user_id"))).unionByName(_stationary(spark, sf_dir))


def _packet_columns(rows: DataFrame, *more: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    fixed = e.isNull()
    return rows.select(
        F.timestamp_micros("us").alias("timestamp"),
        F.when(fixed, "data").otherwise("management").alias("type"),
        F.when(fixed, "qos-data").when((e + k) % 11 == 0, "beacon").when((e + k) % 13 == 0, "probe-response")
        .otherwise("probe-request").alias("subtype"),
        "strength", "source_address", F.when(F.col("user_id") % 5 == 0, 1).otherwise(0).alias("source_address_randomized"),
        F.when(fixed, 1).otherwise(F.col("sensor") % 14 + 1).cast("int").alias("channel"),
        sensor_name(F.col("sensor")).alias("sensor_name"), *more,
    )


def packets_text_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture table as landed and its service run (one a sensor), each run in one task. Bursts are cut where their sensor
    may change and dealt by run before they are expanded, so a task reads pieces of events and sorts no packets."""
    pieces = _sensor_and_strength(
        _starts(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEPS_A_SENSOR)))).withColumn("b", _branches()))
    dealt = pieces.withColumn("last", F.least(F.col("k") + STEPS_A_SENSOR - 1, "last")).select(
        "event_id", "user_id", "source_address", "us", "step", "b", "k", "last", "sensor", sensor_name(F.col("sensor")).alias("run")
    ).repartitionById(N_SENSORS, F.col("sensor").cast("int")).sortWithinPartitions("run")
    rows = dealt.withColumn("k", F.explode(F.sequence("k", "last"))).withColumn("us", _step_us())
    return _as_text(_packet_columns(_sensor_and_strength(rows), "run"), "run")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture table, timestamps parsed."""
    return packets_by_day(spark, sf_dir).drop(UTC_DAY)


def packets_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture table as landed: RFC 3339 text timestamps with milliseconds."""
    return _as_text(packets(spark, sf_dir))


def _as_text(rows: DataFrame, *more: str) -> DataFrame:
    return rows.withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ).select(*schemas.PACKETS_RAW.names, *more)


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted historical capture: hardware addresses, sensor codes, RSSI with sentinels.

    ``site`` stands for two deployments; one row per packet, times truncated to seconds.
    """
    return _raw(spark, sf_dir, hardware_address(F.col("user_id"))).drop(UTC_DAY)


def raw_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with addresses already in their one form, laid out by address and ``utc_day``."""
    return _raw(spark, sf_dir, canonical_address(hardware_address(F.col("user_id"))))


def _raw(spark: SparkSession, sf_dir: str, address: Column) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    return _bursts(spark, sf_dir, address).select(
        F.timestamp_seconds(F.floor(F.col("us") / 1000000)).alias("timestamp"),
        "source_address",
        sensor_name(F.col("sensor")).alias("sensor_name"),
        F.concat(F.lit("c"), F.col("sensor").cast("string")).alias("sensor_code"),
        F.when((e + k) % 97 == 0, -255).when((e + k) % 101 == 0, 0)
        .otherwise(F.col("strength")).cast("int").alias("rssi"),
        F.when(F.col("user_id") % 2 == 0, "campus").otherwise("district").alias("site"), UTC_DAY,
    )


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth for users with user_id % 3 = 1: a fix near the sensor at every second step."""
    e = F.col("event_id")
    near = _bursts(spark, sf_dir).filter(
        (F.col("user_id") % 3 == 1) & (F.col("b") == 0) & (F.col("k") % 2 == 0)
    )
    return near.select(
        "source_address",
        F.timestamp_seconds(F.floor(F.col("us") / 1000000) + 3).alias("timestamp"),
        (sensor_x(F.col("sensor")) + e * 7 % 41 - 20).alias("x"),
        (sensor_y(F.col("sensor")) + e * 13 % 37 - 18).alias("y"),
    )


def decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded 802.11 frame rows, one per event: type and subtype numbers and the DS bits."""
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id",
        ntz_as_utc("ts").alias("timestamp"),
        (e % 3).cast("int").alias("frame_type"),
        (e % 16).cast("int").alias("frame_subtype"),
        F.floor(e / 3 % 3).cast("int").alias("to_ds"),
        F.floor(e / 7 % 2).cast("int").alias("from_ds"),
        F.when(e % 29 == 0, F.lit(None)).otherwise(-(e % 140)).cast("int").alias("strength"),
    )
