"""Reading and writing the contract tables."""

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import schemas
from waymark.functions import bitmaps
from waymark.functions.islands import UTC_DAY
from waymark.functions.timefn import ntz_as_utc, utc_text
from waymark.operators.quality import ContractError, require_columns
from waymark.sources import published

_scratch, _stages, _states = {}, {}, {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only where the
    session names none (tests on one machine) is a local temporary folder made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ContractError("set spark.checkpoint.dir to a folder all executors share")
    key = spark.sparkContext.applicationId
    if key not in _scratch:
        _scratch[key] = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, _scratch[key], ignore_errors=True)
    return _scratch[key]


def _state_of(spark: SparkSession, source: str) -> tuple:
    """Names, sizes and times of the files of a folder and of the folders in it: a memo of what was made from them must not
    outlive them."""
    files = published.Files(spark, source)
    found = []
    for s in files.fs.listStatus(files.path(source)) if files.exists(source) else []:
        inner = files.fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inner]
    return tuple(sorted(found))


def stager(spark: SparkSession, run: str):
    """``stage(df, name)``: write a stage once and go on from the written table, so later
    consumers neither recompute it nor depend on executors that may be lost."""
    def stage(df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(spark)}/{run}/{name}"
        write_table(df, path)
        return spark.read.schema(df.schema).parquet(path)

    return stage


def staged_once(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """A stage of a session: written to the shared folder by its first reader, and written
    anew if the folder has been cleared since."""
    key, state = (spark.sparkContext.applicationId, source, name), _state_of(spark, source)
    if key in _stages and _states[key] == state:
        path, schema = _stages[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            pass
    run = f"stages-{uuid.uuid4().hex}"
    staged = stager(spark, run)(build(), name)
    _stages[key], _states[key] = (f"{shared_dir(spark)}/{run}/{name}", staged.schema), state
    return staged


def staged_by_day(spark: SparkSession, source: str, name: str, build, buckets: int) -> DataFrame:
    """``staged_once`` for rows laid out by identifier and ``utc_day`` over ``buckets`` tasks: stored in as many buckets of the
    session's catalog, one file each, so what reads them by identifier and day exchanges no rows."""
    key, state = (spark.sparkContext.applicationId, source, name), (_state_of(spark, source), buckets)
    if key in _stages and _states[key] == state:
        path, table = _stages[key]
        if published.Files(spark, path).exists(path) and spark.catalog.tableExists(table):
            return spark.table(table)
    table = f"waymark_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    write_buckets(build(), table, path, buckets)
    _stages[key], _states[key] = (path, table), state
    return spark.table(table)


# Groups of sorted rows are aggregated as the rows come, in one step.
SORTED = {"spark.sql.execution.replaceHashWithSortAgg": "true"}
# Times as 64-bit microseconds: half the cost of the old 96-bit form, to write and to read.
MICROS = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict):
    """The session with these settings, which are put back at the end."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def write_buckets(laid: DataFrame, name: str, path: str, buckets: int) -> None:
    with settings(laid.sparkSession, SORTED | MICROS):
        laid.write.bucketBy(buckets, "source_address", UTC_DAY).sortBy("source_address", UTC_DAY, "timestamp").option(
            "path", path).option("compression", "zstd").mode("overwrite").saveAsTable(name)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Landed capture files (a file, a folder of service runs, or a glob), timestamps parsed.

    The text is parsed strictly by ``quality.packet_violations``; here it only becomes a time.
    """
    require_columns(spark.read.parquet(path), schemas.PACKETS_RAW.names, "packets")
    raw = spark.read.schema(schemas.PACKETS_RAW).parquet(path)
    return raw.withColumn("timestamp", F.to_timestamp("timestamp"))


def with_provenance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("input_file", F.col("_metadata.file_name"))


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A Parquet or headed CSV table with exactly the columns of its contract."""
    if fmt == "csv":
        found = spark.read.option("header", True).csv(path)
        require_columns(found, schema.names, path)
        return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    require_columns(spark.read.parquet(path), schema.names, path)
    return spark.read.schema(schema).parquet(path)


def _replaced(df: DataFrame, path: str, write) -> None:
    """Writes beside the target and swaps it in when complete: a job that fails leaves the old table as it was. Readers that must
    not see even the moment of the swap use ``published.publish``."""
    spark, new = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        write(new)
    except Exception:
        published.Files(spark, path).delete(new)
        raise
    published.swap_in(spark, new, path.rstrip("/"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet with zstd, or CSV with UTC ``Z`` text; an existing table is replaced as a whole or not at all."""
    if fmt == "csv":
        texts = [utc_text(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType)
                 else F.col(f.name) for f in df.schema.fields]
        _replaced(df, path, lambda new: df.select(*texts).write.option("header", True).csv(new))
    else:
        _replaced(df, path, lambda new: df.write.option("compression", "zstd").parquet(new))


def write_by_date(df: DataFrame, path: str, day: str = "local_date") -> None:
    """Large tables: one folder a local date, so a period filter prunes folders; replaced as ``write_table`` does."""
    _replaced(df, path, lambda new: df.repartition(day).write.partitionBy(day).option("compression", "zstd").parquet(new))


def write_by_identifier_day(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """A table laid out for the windows and joins on (identifier, day): bucketed by both, one file a bucket, so an identifier
    with a third of all rows lies in as many buckets as it has days. Returns the table ``name`` of the session's catalog, whose
    files are in ``path``; windows by identifier and UTC day read it without an exchange."""
    day = F.floor(F.unix_seconds("timestamp") / 86400).alias(UTC_DAY)
    laid = df.select("*", day).repartition(buckets, "source_address", UTC_DAY).sortWithinPartitions("source_address", UTC_DAY, "timestamp")
    write_buckets(laid, name, path, buckets)
    return df.sparkSession.table(name)


def day_table(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """A table of days with what is known of each (a few hundred rows a year), written so that a filter on it can prune others."""
    write_table(days.coalesce(1), path)
    return spark.read.schema(days.schema).parquet(path)


def attach_utc(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """A zone-less column declared to be UTC, epoch unchanged."""
    return df.withColumn(column, ntz_as_utc(column))


def checked_sensors(sensors: DataFrame) -> DataFrame:
    """Sensor rows that break the dimension's contract."""
    names = sensors.groupBy("sensor_name").agg(F.count("*").alias("_n"))
    bad = (
        F.col("sensor_name").isNull() | ~F.col("sensor_name").rlike("^[A-Za-z0-9_-]{1,32}$")
        | (F.col("_n") > 1) | F.col("x").isNull() | F.isnan("x") | F.col("y").isNull() | F.isnan("y")
        | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
        | (F.col("coordinate_system") != "local_cartesian_metres") | (F.col("is_synthetic") != 1)
    )
    return sensors.join(names, "sensor_name", "left").filter(bad).select(*sensors.columns)


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.GPS, "csv")


def slim(t20: DataFrame) -> DataFrame:
    """The public columns; ``slim_report`` must show an exact identity first. Rows laid out by identifier and ``utc_day`` keep the
    day, by which they stay where they lie."""
    return t20.select(*schemas.TWENTY_SECOND_PUBLIC.names, *[c for c in t20.columns if c == UTC_DAY])


def slim_report(t20: DataFrame) -> DataFrame:
    """Rows and the largest deviation from ``strength_sum = 100 * detections + rssi_sum``."""
    derived = F.col("detections") * 100.0 + F.col("rssi_sum")
    return t20.agg(F.count("*").alias("n_rows"),
                   F.max(F.abs(F.col("strength_sum") - derived)).alias("max_deviation"))


def manifest_parts(t20: DataFrame, devices: DataFrame, sensors: DataFrame) -> tuple:
    """What a dataset manifest needs of some days, in two small tables: counters a UTC day with the day's sensors as words,
    and the day's devices as bitmaps. ``devices`` and ``sensors`` are dictionaries (``functions.bitmaps``). Parts of
    further days are appended; the rows of the days before are not read again."""
    identity = F.abs(F.col("strength_sum") - (F.col("detections") * 100.0 + F.col("rssi_sum")))
    day = F.floor(F.unix_seconds("timestamp") / 86400).alias("day")
    words = bitmaps.words_of(sensors.count())
    names = sensors.select(F.col("value").alias("sensor_name"), "number")
    # One row for each device and day, from which both tables follow: the table's rows are shuffled as partial sums only.
    daily = t20.join(names, "sensor_name", "left").groupBy(day, "source_address").agg(
        F.count("*").alias("n_records"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.sum("detections").alias("total_detections"),
        F.count_if(~F.col("detections").between(1, 20)).alias("invalid_detections"),
        F.count_if(identity > 1e-9).alias("invalid_strength"), *bitmaps.word_sets(F.col("number"), words, "sensors"))
    counters = daily.groupBy("day").agg(
        F.sum("n_records").alias("n_records"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("total_detections").alias("total_detections"), F.sum("invalid_detections").alias("invalid_detections"),
        F.sum("invalid_strength").alias("invalid_strength"), *bitmaps.word_unions(words, "sensors"))
    return counters, bitmaps.bitmaps(daily, devices, ["day"], "source_address")


def manifest_of_parts(counters: DataFrame, maps: DataFrame, site: str) -> DataFrame:
    """Size, period and validity counters of one dataset, from the parts of its days."""
    words = sum(c.startswith("sensors_") for c in counters.columns)
    totals = counters.agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("total_detections").alias("total_detections"),
        F.coalesce(F.sum("invalid_detections"), F.lit(0)).alias("invalid_detections"),
        F.coalesce(F.sum("invalid_strength"), F.lit(0)).alias("invalid_strength"), *bitmaps.word_unions(words, "sensors"))
    return totals.select(
        F.lit(site).alias("site"), "n_records", bitmaps.counted(maps, [], "n_devices").scalar().alias("n_devices"),
        F.coalesce(bitmaps.word_count(words, "sensors"), F.lit(0).cast("long")).alias("n_sensors"),
        utc_text("first").alias("start_utc"), utc_text("last").alias("end_utc"),
        "total_detections", "invalid_detections", "invalid_strength")


def dataset_manifest(t20: DataFrame, site: str, stage=lambda df, name: df) -> DataFrame:
    """The manifest of a whole table at once. ``stage`` may write the dictionary and the parts (see ``stager``)."""
    devices = stage(bitmaps.numbered(t20.select("source_address")), "devices")
    sensors = stage(bitmaps.small_dictionary(t20.select("sensor_name")), "sensors")
    counters, maps = manifest_parts(t20, devices, sensors)
    return manifest_of_parts(stage(counters, "counters"), stage(maps, "bitmaps"), site)


def run_manifest(tables: dict, parameters: dict) -> DataFrame:
    """One line per output table: rows, and the run's parameters as JSON."""
    text = json.dumps(parameters, sort_keys=True)
    lines = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(text).alias("parameters"))
        for name, df in tables.items()
    ]
    result = lines[0]
    for line in lines[1:]:
        result = result.unionByName(line)
    return result
