"""Inputs of the registered queries: lazy DataFrames over the given tables, and the stages
(one second, 20 seconds, located), which the first query of a session writes and all read."""

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.islands import UTC_DAY
from waymark.functions.timefn import use_utc
from waymark.operators import activities, aggregate, cleaning, filters, location, revisits, track
from waymark.params import CAMPUS, DISTRICT, MAINTAINED, CleaningParams
from waymark.plans.oracle import KST
from waymark.sources import synthetic, tables

RULES = {"maintained": MAINTAINED, "campus": CAMPUS, "district": DISTRICT}


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = use_utc(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self):
        return synthetic.events(self.spark, self.dir)

    @cached_property
    def packets_by_day(self):
        return synthetic.packets_by_day(self.spark, self.dir)

    @cached_property
    def packets(self):
        return self.packets_by_day.drop(UTC_DAY)

    @cached_property
    def packets_text(self):
        return synthetic.packets_text(self.spark, self.dir)

    def staged(self, name: str, build) -> DataFrame:
        return tables.staged_once(self.spark, self.dir, name, build)

    @cached_property
    def parts(self):
        return synthetic.parts(self.spark, self.dir)

    def staged_by_day(self, name: str, build) -> DataFrame:
        """A stage whose rows stay laid out by identifier and ``utc_day``, as its packets were."""
        return tables.staged_by_day(self.spark, self.dir, name, build, self.parts)

    @cached_property
    def sec1_by_day(self):
        return self.staged_by_day("one_second", lambda: aggregate.one_second(self.packets_by_day))

    @cached_property
    def sec1(self):
        return self.sec1_by_day.drop(UTC_DAY)

    @cached_property
    def cleaned_by_day(self):
        return cleaning.clean(self.sec1_by_day, deduplicate=False)

    @cached_property
    def cleaned(self):
        return self.cleaned_by_day.drop(UTC_DAY)

    @cached_property
    def t20_by_day(self):
        return self.staged_by_day("twenty_second", lambda: aggregate.twenty_second(self.cleaned_by_day))

    @cached_property
    def t20(self):
        return self.t20_by_day.drop(UTC_DAY)

    @cached_property
    def t20_planted(self):
        return self._planted(self.t20)

    @cached_property
    def t20_planted_by_day(self):
        """The planted table laid out as the sound one is: some of its identifiers are others, so its rows move."""
        return self._planted(self.t20_by_day).repartition(self.parts, "source_address", UTC_DAY)

    def _planted(self, t20: DataFrame) -> DataFrame:
        """The 20-second table with planted defects, by the number u of the window; ``oracle.PLANTED`` says the same."""
        u = F.floor(F.unix_seconds("timestamp") / 20)

        def where(n, changed, column):
            return F.when(F.col("u") % n == 0, changed).otherwise(F.col(column)).alias(column)

        copies = F.explode(F.sequence(F.lit(1), F.when(u % 23 == 0, 2).otherwise(1)))
        return t20.withColumn("u", u).withColumn("copy", copies).select(
            where(7, F.timestamp_seconds(F.unix_seconds("timestamp") + 1), "timestamp"),
            where(19, F.concat(F.lit("X"), "source_address"), "source_address"), "sensor_name",
            where(17, F.lit(None), "rssi_median"), "rssi_sum", where(11, F.lit(21).cast("long"), "detections"),
            where(13, F.col("strength_sum") + 0.5, "strength_sum"), *[c for c in t20.columns if c == UTC_DAY])

    @cached_property
    def t20_narrow(self):
        """The same table from a narrower RSSI range: the "other version" of release checks."""
        return self.t20_narrow_by_day.drop(UTC_DAY)

    @cached_property
    def t20_narrow_by_day(self):
        def build():
            seconds = self.staged_by_day("one_second_narrow", lambda: aggregate.one_second(
                self.packets_by_day, CleaningParams(rssi_min=-74)))
            return aggregate.twenty_second(cleaning.clean(seconds, deduplicate=False))

        return self.staged_by_day("twenty_second_narrow", build)

    @cached_property
    def sensors(self):
        return synthetic.sensors(self.spark)

    @cached_property
    def district(self):
        return synthetic.district_sensors(self.spark)

    @cached_property
    def located(self):
        return self.located_by_day.drop(UTC_DAY)

    @cached_property
    def located_by_day(self):
        """The Location table in buckets of identifier and day; a table of the session's catalog over the shared folder."""
        return self.staged_by_day("located", lambda: location.locate_proximity(self.t20_by_day, self.sensors))

    @cached_property
    def trips(self):
        return track.trajectory_summary(self.located_by_day, 1800)

    @cached_property
    def od_trips(self):
        return self.trips.filter(F.col("is_od") == 1)

    @cached_property
    def visits(self):
        return self.staged("visits", lambda: track.trajectory_summary(self.located_by_day, 7200))

    def accepted(self, rules: str) -> DataFrame:
        """Located rows of the trajectories that a rule set accepts, numbered."""
        return self.staged(f"accepted_{rules}", lambda: activities.qualifying_rows(self.located_by_day, RULES[rules]).drop(UTC_DAY))

    @cached_property
    def week(self):
        """One local week at all sensors; ``oracle.BANDS`` says the same."""
        return filters.local_period(self.t20, "2024-01-08 00:00:00", "2024-01-15 00:00:00")

    @cached_property
    def planted_week(self):
        """The week with some identifiers on one day only; ``oracle.PLANTED_BANDS`` says the same."""
        rows = self.week
        day = F.floor((F.unix_seconds("timestamp") + KST) / 86400) % 7
        own = F.ascii(F.substring("source_address", 2, 1)) % 7
        return rows.filter((F.substring("source_address", 1, 1) > "3") | (day == own))

    @cached_property
    def bands(self):
        return revisits.observed_day_bands(self.week)

    @cached_property
    def whole_bands(self):
        """Bands of all days; ``oracle.WHOLE_BANDS`` says the same."""
        return revisits.observed_day_bands(self.t20)

    @cached_property
    def episodes(self):
        return activities.episodes_of(self.accepted("maintained"))

    @cached_property
    def raw(self):
        return synthetic.raw_detections(self.spark, self.dir)

    @cached_property
    def raw_by_day(self):
        return synthetic.raw_by_day(self.spark, self.dir)

    @cached_property
    def raw_planted(self):
        """The raw table with rare identifiers and some long stays; ``oracle.RAW_PLANTED`` says the same."""
        digit = F.substring(F.md5(F.lower("source_address")), 1, 1)
        every = F.when(digit == "0", 97).when(digit == "1", 499).when(digit == "2", 997).when(digit == "3", 1999).otherwise(1)
        first = self.raw.groupBy("source_address", "site").agg(F.min("timestamp").alias("t0"))
        times = F.when(digit == "a", 30).when(digit == "b", 29)
        stay = first.withColumn("j", F.explode(F.sequence(F.lit(0), times))).select(
            F.timestamp_seconds(F.unix_seconds("t0") + F.col("j") * 240).alias("timestamp"), "source_address",
            F.lit("s02").alias("sensor_name"), F.lit("c2").alias("sensor_code"), F.lit(-50).alias("rssi"), "site")
        return self.raw.filter(F.unix_seconds("timestamp") % every == 0).unionByName(stay)

    @cached_property
    def packets_text_by_run(self):
        return synthetic.packets_text_by_run(self.spark, self.dir)

    @cached_property
    def gps(self):
        return self.staged("gps", lambda: synthetic.gps(self.spark, self.dir))

    @cached_property
    def frames(self):
        return synthetic.decoded_frames(self.spark, self.dir)

    @cached_property
    def located_raw(self):
        """One-second-grade rows of the identifiers with ground truth."""
        def build():
            carriers = self.staged("carriers", lambda: self.gps.select("source_address").distinct())
            rows = self.packets_by_day.withColumnRenamed("strength", "rssi")
            return location.ground_truth_rows(rows, carriers)

        return self.staged_by_day("located_raw", build)

    def stage(self):
        """A ``stage(df, name)`` that writes below a folder of its own."""
        return tables.stager(self.spark, f"run-{uuid.uuid4().hex}")

    def in_place(self, result: DataFrame, name: str) -> DataFrame:
        """Writes a small ``result`` of joins between tables of one layout by identifier and day, on keys that hold both: their rows
        stay where they lie. By default Spark would exchange both sides by all keys, against a skew that the day rules out."""
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            return self.stage()(result, name)
        finally:
            self.spark.conf.set(key, before)

    def landed_by_day(self, df: DataFrame, name: str) -> DataFrame:
        """A written table that keeps the layout by identifier and ``utc_day``."""
        table = f"waymark_{name}_{uuid.uuid4().hex}"
        tables.write_buckets(df, table, f"{tables.shared_dir(self.spark)}/{table}", self.parts)
        return self.spark.table(table)

    def new_path(self, name: str) -> str:
        return f"{tables.shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    def landed(self, df: DataFrame, name: str, fmt: str = "parquet") -> str:
        path = self.new_path(name)
        tables.write_table(df, path, fmt)
        return path


def comparable(df: DataFrame) -> DataFrame:
    """Instants as epoch seconds, dates as text, integers as long, doubles at 6 decimals."""
    def form(field):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.TimestampType):
            c = F.unix_seconds(c)
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + F.lit(0.0)
        return c.alias(field.name)

    return df.select(*[form(f) for f in df.schema.fields])


_QUERIES, _ORACLES = {}, {}


def query(name: str, sql: str = None):
    """Register a query over a ``Context`` with its DuckDB counterpart."""
    def register(build):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: comparable(build(Context(spark, sf_dir)))
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return register


def registered() -> tuple:
    return _QUERIES, _ORACLES
