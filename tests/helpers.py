"""Small tables as literals. Times are seconds after 2024-01-15 00:00:00 UTC."""

from pyspark.sql import functions as F

BASE = 1705276800

STATIONARY = "c463ebe40642f502c23f466edb4dfde5"
MOVING = "20bb0f1ddb10c9b71fa916d5a7d078c6"
STAYING = "323545d4c59047e37c6d4955d7be420e"
RANDOM_A = "4a8c49fdc8f8854efc1cb92c05f2191f"
RANDOM_B = "ab65de5e3ba65aba108593f6e728d20d"


def located(spark, rows):
    """(seconds, identifier, sensor, x, y) rows of a Location table."""
    df = spark.createDataFrame(rows, "t long, source_address string, sensor_name string, x double, y double")
    return df.withColumn("timestamp", F.timestamp_seconds(F.col("t") + BASE)).drop("t").withColumn(
        "strength_sum", F.lit(50.0)).withColumn("detections", F.lit(1).cast("long"))


def seconds(spark, rows):
    """(seconds, identifier, sensor[, flag]) rows of a one-second table."""
    rows = [(*r, 0) if len(r) == 3 else r for r in rows]
    df = spark.createDataFrame(
        rows, "t long, source_address string, sensor_name string, source_address_randomized int")
    return df.select(
        F.timestamp_seconds(F.col("t") + BASE).alias("timestamp"), "source_address", "sensor_name",
        "source_address_randomized", F.lit(-50.0).alias("rssi_median"),
        F.lit(1).cast("long").alias("packet_count"))


def fixture_packets(spark):
    """The synthetic capture of FIXTURES.md section 3."""
    rows = []

    def add(second, micros, kind, subtype, strength, identifier, flag, sensor):
        rows.append((second * 1000000 + micros, kind, subtype, strength, identifier, flag,
                     1 if sensor == "A01" else 11, sensor))

    probe = ("management", "probe-request")
    for s in range(0, 7501, 20):
        add(s, 110000, "data", "qos-data", -46, STATIONARY, 0, "A01")
        add(s, 610000, "data", "qos-data", -48, STATIONARY, 0, "A01")
    for s in range(160):
        sensor, u = ("A01", s) if s < 80 else ("A02", s - 80)
        p = -66 + min(u, 35) // 7
        add(s, 120000, *probe, p, MOVING, 0, sensor)
        add(s, 720000, *probe, p - 2, MOVING, 0, sensor)
    for s in range(70, 90):
        other = "A02" if s < 80 else "A01"
        add(s, 240000, *probe, -73, MOVING, 0, other)
        add(s, 840000, *probe, -75, MOVING, 0, other)
    for s in range(86400, 86440):
        sensor = "A01" if s < 86420 else "A02"
        add(s, 140000, *probe, -62, MOVING, 0, sensor)
        add(s, 740000, *probe, -64, MOVING, 0, sensor)
    for s in range(600, 1021, 20):
        add(s, 160000, "data", "qos-data", -52, STAYING, 0, "A02")
        add(s, 760000, "data", "qos-data", -54, STAYING, 0, "A02")
    for identifier, start, sensor in ((RANDOM_A, 20, "A01"), (RANDOM_B, 80, "A02")):
        for s in range(start, start + 40):
            add(s, 330000, *probe, -58, identifier, 1, sensor)
            add(s, 930000, *probe, -61, identifier, 1, sensor)
    df = spark.createDataFrame(rows, "us long, type string, subtype string, strength int, "
                                     "source_address string, source_address_randomized int, "
                                     "channel int, sensor_name string")
    return df.select(F.timestamp_micros(F.col("us") + BASE * 1000000).alias("timestamp"), *df.columns[1:])


def fixture_sensors(spark):
    return spark.createDataFrame(
        [("A01", 0.0, 0.0, "local_cartesian_metres", 1), ("A02", 75.0, 0.0, "local_cartesian_metres", 1)],
        "sensor_name string, x double, y double, coordinate_system string, is_synthetic int")
