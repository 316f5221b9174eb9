"""Gap splitting ("islands") that no single identifier can overload.

A plain ``lag``/``cumsum`` window over an identifier puts all of its rows in one task.
Here rows are first split inside ``(identifier, time chunk)``, whose size the table key
bounds (one row per identifier and 20 s window: at most 4,320 a day). Only the chunk
summaries, a few rows per identifier and day, meet in the per-identifier window that
joins sessions across chunk borders.

A table written by (identifier, ``utc_day``) (``sources.tables.write_by_identifier_day``) already lies as the first step
needs it: its stored day is the chunk, and no row is exchanged.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.timefn import epoch

DAY = 86400
UTC_DAY = "utc_day"


def _chunk_of(rows: DataFrame, chunk_seconds: int) -> Column:
    stored = chunk_seconds == DAY and UTC_DAY in rows.columns
    return F.col(UTC_DAY) if stored else F.floor(epoch("timestamp") / chunk_seconds)


def _breaks(gap: Column, gap_seconds: int, inclusive: bool) -> Column:
    return gap >= gap_seconds if inclusive else gap > gap_seconds


def with_gaps(
    rows: DataFrame, keys: list, *, into: str, order: tuple = (), chunk_seconds: int = DAY
) -> DataFrame:
    """Seconds since the previous row of the same ``keys``; NULL on the first one.

    A chunk's first row takes the end of the previous chunk from the chunk summary.
    """
    chunked = rows.withColumn("_chunk", _chunk_of(rows, chunk_seconds))
    w = Window.partitionBy(*keys, "_chunk").orderBy("timestamp", *order)
    ends = chunked.groupBy(*keys, "_chunk").agg(F.max(epoch("timestamp")).alias("_last"))
    before = ends.withColumn(
        "_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    return (
        chunked.withColumn("_previous", F.lag(epoch("timestamp")).over(w))
        .join(before, [*keys, "_chunk"])
        .withColumn(into, epoch("timestamp") - F.coalesce("_previous", "_before"))
        .select(*rows.columns, into)
    )


def _split_in_chunks(rows, keys, gap_seconds, inclusive, order, chunk_seconds):
    chunked = rows.withColumn("_chunk", _chunk_of(rows, chunk_seconds))
    w = Window.partitionBy(*keys, "_chunk").orderBy("timestamp", *order)
    last = F.col("_last") if "_last" in rows.columns else epoch("timestamp")
    gap = epoch("timestamp") - F.lag(last).over(w)
    flagged = chunked.withColumn("_gap", gap)
    split = F.when(_breaks(F.col("_gap"), gap_seconds, inclusive), 1).otherwise(0)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("_local", F.sum(split).over(running)).drop("_gap")


def split_sessions(
    rows: DataFrame, keys: list, gap_seconds: int, *, into: str, inclusive: bool = False,
    order: tuple = (), chunk_seconds: int = DAY,
) -> DataFrame:
    """Rows plus a session number (1, 2, ...) that starts anew per ``keys`` after a gap.

    Exclusive rule: a new session where gap > limit; inclusive: gap >= limit. The join is
    on ``(keys, chunk)``, the partitioning the rows already have from the chunk window.
    """
    marked = _split_in_chunks(
        rows, keys, gap_seconds, inclusive, order, chunk_seconds
    )
    per_chunk = marked.groupBy(*keys, "_chunk").agg(
        F.min(epoch("timestamp")).alias("_first"),
        F.max(epoch("timestamp")).alias("_last"),
        F.max("_local").alias("_splits"),
    )
    w = Window.partitionBy(*keys).orderBy("_chunk")
    previous = F.lag("_last").over(w)
    opens = previous.isNull() | _breaks(F.col("_first") - previous, gap_seconds, inclusive)
    base = (
        per_chunk.withColumn(
            "_step", opens.cast("int") + F.coalesce(F.lag("_splits").over(w), F.lit(0))
        )
        .withColumn("_base", F.sum("_step").over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(*keys, "_chunk", "_base")
    )
    return (
        marked.join(base, [*keys, "_chunk"])
        .withColumn(into, (F.col("_base") + F.col("_local")).cast("long"))
        .select(*rows.columns, into)
    )


def cells(rows: DataFrame, keys: list, gap_seconds: int, *, chunk_seconds: int = DAY) -> DataFrame:
    """Rows counted (``n``) by ``keys``, chunk and cells of ``gap_seconds``, each with its first ``timestamp`` and ``_last`` one. No
    session is split inside a cell, whose seconds are less than a gap apart, so sessions follow from the far fewer cells."""
    stored = [UTC_DAY] if chunk_seconds == DAY and UTC_DAY in rows.columns else []
    seconds = epoch("timestamp")
    chunk = F.floor(seconds / chunk_seconds).alias("_of")
    cell = F.floor(seconds / gap_seconds).alias("_cell")
    return rows.groupBy(*keys, *(stored or [chunk]), cell).agg(
        F.min("timestamp").alias("timestamp"), F.max(seconds).alias("_last"), F.count("*").alias("n")
    ).select(*keys, *stored, "timestamp", "_last", "n")


def session_spans(
    rows: DataFrame, keys: list, gap_seconds: int, measures: dict, *,
    inclusive: bool = False, order: tuple = (), chunk_seconds: int = DAY,
) -> DataFrame:
    """Per chunk-local session: ``keys``, ``session_id``, ``start_epoch``, ``end_epoch`` and the
    given aggregate ``measures``. A session that crosses chunk borders has one row per chunk;
    callers merge them with a second, far smaller, ``groupBy(keys, session_id)``. ``rows`` may be ``cells`` of this gap.
    """
    marked = _split_in_chunks(
        rows, keys, gap_seconds, inclusive, order, chunk_seconds
    )
    last = F.col("_last") if "_last" in rows.columns else epoch("timestamp")
    spans = marked.groupBy(*keys, "_chunk", "_local").agg(
        F.min(epoch("timestamp")).alias("start_epoch"),
        F.max(last).alias("end_epoch"),
        *[measure.alias(name) for name, measure in measures.items()],
    )
    w = Window.partitionBy(*keys).orderBy("start_epoch")
    previous = F.lag("end_epoch").over(w)
    opens = previous.isNull() | _breaks(F.col("start_epoch") - previous, gap_seconds, inclusive)
    return (
        spans.withColumn("_opens", opens.cast("int"))
        .withColumn("session_id", F.sum("_opens").over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .drop("_opens")
        .withColumnsRenamed({"_chunk": "chunk", "_local": "piece"})
    )


def rows_of_sessions(
    rows: DataFrame, keys: list, gap_seconds: int, spans: DataFrame, *, into: str,
    inclusive: bool = False, order: tuple = (), chunk_seconds: int = DAY,
) -> DataFrame:
    """The rows of chosen ``session_spans``, numbered with the spans' ``into`` column.

    The few pieces of a chunk travel as one map, so the join is again on ``(keys, chunk)``,
    as the rows are partitioned. The rules must be those the spans were made with.
    """
    marked = _split_in_chunks(
        rows, keys, gap_seconds, inclusive, order, chunk_seconds
    )
    pieces = spans.groupBy(*keys, F.col("chunk").alias("_chunk")).agg(
        F.map_from_entries(F.collect_list(F.struct("piece", F.col(into).cast("long")))).alias("_ids")
    )
    return (
        marked.join(pieces, [*keys, "_chunk"])
        .withColumn(into, F.try_element_at("_ids", F.col("_local")))
        .filter(F.col(into).isNotNull())
        .select(*rows.columns, into)
    )
