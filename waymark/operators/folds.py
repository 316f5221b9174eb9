"""Order-dependent rules as folds over sorted rows: a row at a time, with a state of constant size.

Rows are sorted within (identifier, trajectory) by Spark, spilling where they must, and streamed through an iterator of Arrow
batches. What is carried from row to row, and from batch to batch, is one small state; a trajectory is never held, so its
length is not bounded by memory. ``advance`` is the rule itself and also drives the stream of ``streaming.stateful``.
"""

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.timefn import epoch

TRAJECTORY = ["source_address", "trajectory_id"]
EPISODES = ("source_address string, trajectory_id long, cluster_id long, episode_id long, start_epoch long, end_epoch long, "
            "n_windows long, primary_sensor string, n_sensors long, duration_seconds long")
BATCH = 4096    # episodes a batch handed on


class Walk:
    """What is known of a trajectory between two of its rows: the cluster's anchor and the open episode."""

    __slots__ = ("ax", "ay", "cluster", "episode", "start", "last", "n", "sensors")

    def __init__(self, x, y, t, cluster=1, episode=1):
        self.ax, self.ay, self.cluster, self.episode = x, y, cluster, episode
        self.start, self.last, self.n, self.sensors = t, t, 0, {}

    def closed(self) -> tuple:
        """cluster, episode, start, end, windows, the sensor seen most (lowest name on a tie), sensors, duration."""
        most = min(self.sensors.items(), key=lambda item: (-item[1], item[0]))[0] if self.sensors else None
        return (self.cluster, self.episode, self.start, self.last, self.n, most, len(self.sensors), self.last - self.start)


def advance(walk, rows, metres: float, gap_seconds: int, close) -> Walk:
    """The walk after ``rows`` (epoch, sensor, x, y) in order; ``close(walk)`` is called at the end of each episode.

    A row further than ``metres`` (strictly) from the anchor opens the next cluster; within a cluster a gap that reaches
    ``gap_seconds`` opens the next episode. A row or an anchor without a place is near everything.
    """
    for t, sensor, x, y in rows:
        if walk is None:
            walk = Walk(x, y, t)
        elif sqrt((x - walk.ax) * (x - walk.ax) + (y - walk.ay) * (y - walk.ay)) > metres:
            close(walk)
            walk = Walk(x, y, t, walk.cluster + 1)
        elif t - walk.last >= gap_seconds:
            close(walk)
            walk = Walk(walk.ax, walk.ay, t, walk.cluster, walk.episode + 1)
        walk.last = t
        walk.n += 1
        if sensor is not None:
            walk.sensors[sensor] = walk.sensors.get(sensor, 0) + 1
    return walk


def _sorted(rows: DataFrame, columns: list) -> DataFrame:
    """Each trajectory in one partition, in order; the trajectory's columns come first."""
    order = [*TRAJECTORY, "timestamp", "sensor_name", "x", "y"]
    return rows.repartition(*TRAJECTORY).sortWithinPartitions(*order).select(*TRAJECTORY, *columns)


def runs(batches):
    """(key, whether it goes on from the batch before, batch, begin, end) for each run of a trajectory's rows in a batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for i in (0, 1):
            codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            key = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            yield key, key == last, batch, a, z
            last = key


def _floats(column) -> list:
    """NaN for null: no distance from or to it exceeds the limit."""
    return column.to_numpy(zero_copy_only=False).astype(float).tolist()


def cluster_numbers(batches, metres: float):
    """Each batch (source_address, trajectory_id, …, x, y) with the cluster numbers of its rows in front of x and y."""
    numbers, current, ax, ay, cluster = [], None, 0.0, 0.0, 0
    for _, goes_on, batch, a, z in runs(batches):
        if batch is not current:
            if current is not None:
                yield current, numbers
            current, numbers = batch, []
            xs, ys = _floats(batch.column(batch.num_columns - 2)), _floats(batch.column(batch.num_columns - 1))
        if not goes_on:
            ax, ay, cluster = xs[a], ys[a], 1
        for x, y in zip(xs[a:z], ys[a:z]):
            if sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) > metres:
                ax, ay, cluster = x, y, cluster + 1
            numbers.append(cluster)
    if current is not None:
        yield current, numbers


def anchor_clusters(rows: DataFrame, metres: float) -> DataFrame:
    """source_address, trajectory_id, cluster_id, timestamp, sensor_name, x, y."""
    ordered = _sorted(rows, ["timestamp", "sensor_name", "x", "y"])
    ordered = ordered.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
    out = ordered.withColumn("cluster_id", F.lit(0).cast("long"))
    names = [*TRAJECTORY, "cluster_id", "timestamp", "sensor_name", "x", "y"]
    schema = out.select(*names).schema

    def read(batches):
        for batch, numbers in cluster_numbers(batches, metres):
            columns = [batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ordered.mapInArrow(read, schema)


def episode_rows(batches, metres: float, gap_seconds: int):
    """(trajectory, …, episode summary) tuples from batches of source_address, trajectory_id, epoch, sensor, x, y."""
    out, key, walk = [], None, None

    def close(w):
        out.append((*key, *w.closed()))

    for found, goes_on, batch, a, z in runs(batches):
        if not goes_on:
            if walk is not None:
                close(walk)
            key, walk = found, None
        part = batch.slice(a, z - a)
        walk = advance(walk, zip(part.column(2).to_pylist(), part.column(3).to_pylist(), _floats(part.column(4)), _floats(part.column(5))),
                       metres, gap_seconds, close)
        if len(out) >= BATCH:
            yield from out
            out.clear()
    if walk is not None:
        close(walk)
    yield from out


def episodes(rows: DataFrame, metres: float, gap_seconds: int) -> DataFrame:
    """Anchor clusters, episodes and their summaries in one pass: the rows are shuffled and sorted once, and only episodes
    come out of it."""
    ordered = _sorted(rows.select(*TRAJECTORY, "timestamp", "sensor_name", "x", "y"),
                      [epoch("timestamp").alias("t"), "sensor_name", "x", "y"])
    names = [c.split()[0] for c in EPISODES.split(", ")]
    text = {"source_address", "primary_sensor"}
    schema = pa.schema([(n, pa.string() if n in text else pa.int64()) for n in names])

    def read(batches):
        held = []
        for row in episode_rows(batches, metres, gap_seconds):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return ordered.mapInArrow(read, EPISODES)
