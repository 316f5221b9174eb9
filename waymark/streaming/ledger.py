"""Extraction that keeps a ledger: which files have been read, in which batch, with how many rows read and kept.

Each batch writes its rows to a folder of its own number and then its ledger entries, both by replacing what an earlier try of
the batch has left, so a killed run repeats a batch without doubling it. Rows count only once their batch is in the ledger.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType([T.StructField("file", T.StringType())] + [
    T.StructField(name, T.LongType()) for name in ("bytes", "rows", "kept", "batch")])


def captures(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream over a folder of capture files, with the file that each row came from."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option(
        "recursiveFileLookup", True).parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("input_file"), F.col("_metadata.file_size").alias("input_bytes"))


def extract(stream: DataFrame, keep, out: str, ledger: str, checkpoint: str) -> None:
    """Reads all files present: ``keep(rows)`` says which rows stay (it must keep ``input_file``). Resumes where the last
    run stopped, killed or not."""
    def each(batch: DataFrame, number: int) -> None:
        kept = keep(batch).withColumn("batch", F.lit(number).cast("long"))
        kept.drop("batch", "input_bytes").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")
        # Rows read follow from the files' footers, rows kept from what was written: the captures are decoded once.
        read = batch.groupBy(F.col("input_file").alias("file"), F.col("input_bytes").alias("bytes")).agg(F.count("*").alias("rows"))
        written = batch.sparkSession.read.schema("input_file string").parquet(f"{out}/batch={number}")
        counts = written.groupBy(F.col("input_file").alias("file")).agg(F.count("*").alias("kept"))
        entries = read.join(counts, "file", "left").select(
            "file", "bytes", "rows", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.lit(number).cast("long").alias("batch"))
        entries.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/entries={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """file, bytes, rows, kept, batch of every file that is done."""
    return spark.read.schema(LEDGER).parquet(ledger).select(*LEDGER.names)


def extracted(spark: SparkSession, out: str, ledger: str) -> DataFrame:
    """The rows of the batches in the ledger; a batch that was killed after its rows and before its entry is left out."""
    done = entries(spark, ledger).select("batch").distinct()
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(done), "batch", "left_semi").drop("batch")
