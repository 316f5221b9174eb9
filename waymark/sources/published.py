"""Tables that are replaced as a whole or not at all, and checked in the pass that writes them.

A published table is a folder of versions and a small manifest, ``_current``, that names the one to read. A write goes to a
new version folder; the manifest is written beside the old one and renamed over it last, by the file system's atomic rename. A
job that fails or is killed at any point leaves the old version readable. Object stores without an atomic rename need a
committer of their own for that last step.

Contracts are checked while the version is written: counters of broken rules ride along as observed metrics, no second scan, and
a version that breaks a rule is never published. The counters also keep filters from being pushed below them, so a row
cannot slip past its check because a later filter would have dropped it (a NULL fails every range filter).
"""

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import schemas
from waymark.operators import quality
from waymark.operators.quality import ContractError

CURRENT = "_current"


class Files:
    """The file system of a path, as Spark's own jobs see it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"cannot move {old} to {new}")

    def write_text(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, new: str, target: str) -> None:
        """Rename one file over another in one step."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(target).toUri(), self.conf) \
            if self.path(target).toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
        rename[0] = options.Rename.OVERWRITE
        context.rename(self.path(new), self.path(target), rename)


def swap_in(spark: SparkSession, written: str, target: str) -> None:
    """Puts a completely written folder in the place of a plain table folder, whose old content goes last."""
    files, old = Files(spark, target), None
    if files.exists(target):
        old = f"{target}.old-{uuid.uuid4().hex}"
        files.move(target, old)
    try:
        files.move(written, target)
    except Exception:
        if old:
            files.move(old, target)
        raise
    if old:
        files.delete(old)


def required(names) -> dict:
    """Rules that refuse NULL in the named columns."""
    return {f"{n} is null": F.col(n).isNull() for n in names}


def observed(df: DataFrame, rules: dict) -> tuple:
    """``df`` with counters of broken rules, and the observation that holds them after the job: rows, and a count for
    each rule that some row breaks."""
    watch = Observation(f"rules-{uuid.uuid4().hex}")
    counts = [F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *counts), watch


def broken(watch: Observation) -> dict:
    return {name: n for name, n in watch.get.items() if name != "rows" and n}


def refuse(watch: Observation, label: str) -> None:
    found = broken(watch)
    if found:
        raise ContractError(f"{label}: " + ", ".join(f"{n} rows break '{name}'" for name, n in sorted(found.items())))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    manifest = current(spark, path)
    return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{path}/{manifest['version']}")


def current(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark, path).read_text(f"{path}/{CURRENT}"))


def publish(df: DataFrame, path: str, rules: dict = None, watches: list = (), keep: int = 2) -> dict:
    """Writes a version, refuses it if a rule of its own or of ``watches`` (observations of its inputs) is broken, and makes it
    the table's content. The last ``keep`` versions stay, for readers that have begun. Returns the manifest."""
    spark = df.sparkSession
    files, version = Files(spark, path), f"v-{uuid.uuid4().hex}"
    rows, watch = observed(df, rules or {})
    try:
        rows.write.option("compression", "zstd").parquet(f"{path}/{version}")
        for w in (watch, *watches):
            refuse(w, path)
    except Exception:
        files.delete(f"{path}/{version}")
        raise
    past = current(spark, path)["history"] if files.exists(f"{path}/{CURRENT}") else []
    history = [*past, version][-keep:]
    manifest = {"version": version, "rows": watch.get["rows"], "history": history, "schema": df.schema.jsonValue()}
    new = f"{path}/{CURRENT}-{version}"
    files.write_text(new, json.dumps(manifest))
    files.replace(new, f"{path}/{CURRENT}")
    # Versions that no manifest names any more; also what a killed job has left behind before this one.
    for name in past:
        if name not in history:
            files.delete(f"{path}/{name}")
    return manifest


def read_checked_packets(spark: SparkSession, path: str) -> tuple:
    """Landed capture files as ``tables.read_packets`` gives them, and the observation of all packet rules over every row that is
    read: NULLs in required columns, texts that are no times, values beyond their domain. ``publish`` what is made of
    them with this observation among its ``watches``."""
    quality.require_columns(spark.read.parquet(path), schemas.PACKETS_RAW.names, "packets")
    raw = spark.read.schema(schemas.PACKETS_RAW).parquet(path)
    rows, watch = observed(raw, quality.packet_rules())
    return rows.withColumn("timestamp", F.to_timestamp("timestamp")), watch
