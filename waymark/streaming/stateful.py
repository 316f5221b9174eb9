"""Rules that need the order of an identifier's rows, on a stream: stationary identifiers (C2), anchor clusters and episodes (A3, A4).

Rows of one identifier arrive in any order within the allowed delay, so they wait in a list state until the watermark has
passed them; a timer then folds them in time order into a small value state and clears what time has settled:

* ``Stationary`` keeps the open session of each sensor. It tells an identifier once, as soon as a session exceeds the limit, and
  from then on holds nothing but a flag. Sessions that can no longer grow are dropped.
* ``Clusters`` keeps the open trajectory: its totals, its cluster's anchor and its episode. Whether a trajectory is accepted is
  known at its end, so its numbered rows wait until then; a trajectory that has become too long holds no rows.

Both are the batch rules: on a finished archive, what a stream has told and a batch pass over the keys still open make up the
batch result (``flows.open_sessions``, ``flows.still_open``). State lives in RocksDB, in the query's checkpoint, so a restart goes on
where the last run stopped.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from waymark.functions.timefn import epoch
from waymark.operators import folds
from waymark.params import MAINTAINED, MAINTAINED_CLEANING, CleaningParams, MetricParams
from waymark.streaming import flows

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Hands rows to ``fold`` in time order, once the watermark has passed them."""

    pending = "t long"

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.pending)

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(row) for frame in rows for row in frame[self.names].itertuples(index=False)]
        if new and self.wanted():
            self.waiting.appendList(new)
            # The first of them wakes the key; it then sees to the rest itself, whatever the last run's watermark leaves waiting.
            self.handle.registerTimer(min(row[0] for row in new) * 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        ready = [row for row in rows if row[0] * 1000 < mark]
        rest = rows[len(ready):]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
                self.handle.registerTimer(rest[0][0] * 1000 + 1)
        out = self.fold(key, ready, mark)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def wanted(self) -> bool:
        return True

    def close(self):
        pass


class Stationary(_Ordered):
    """source_address, since_epoch: the identifier and the time at which a session of it exceeded the limit."""

    pending = "t long, sensor string"
    names = ["t", "sensor_name"]
    out = ["source_address", "since_epoch"]

    def __init__(self, rules: CleaningParams):
        self.gap, self.limit, self.inclusive = rules.session_gap_seconds, rules.stationary_seconds, rules.stationary_inclusive

    def init(self, handle):
        super().init(handle)
        self.told = handle.getValueState("told", "since long")
        self.open = handle.getMapState("open", "sensor string", "start long, last long")

    def wanted(self):
        return not self.told.exists()

    def fold(self, key, rows, mark):
        if self.told.exists():
            return []
        open_ = {k[0]: tuple(v) for k, v in self.open.iterator()}
        for t, sensor in rows:
            start, last = open_.get(sensor, (t, t))
            start = t if t - last > self.gap else start
            open_[sensor] = start, t
            if t - start > self.limit or self.inclusive and t - start == self.limit:
                self.told.update((t,))
                self.open.clear()
                self.waiting.clear()
                return [(key[0], t)]
        # A session whose gap has passed can only be followed by another one.
        live = {s: v for s, v in open_.items() if (v[1] + self.gap) * 1000 >= mark}
        self.open.clear()
        for sensor, value in live.items():
            self.open.updateValue((sensor,), value)
        if live:
            self.handle.registerTimer((max(v[1] for v in live.values()) + self.gap) * 1000 + 1)
        return []


class Clusters(_Ordered):
    """source_address, trajectory_id, cluster_id, episode_id, t, sensor_name of the rows of accepted trajectories."""

    pending = "t long, sensor string, x double, y double"
    names = ["t", "sensor_name", "x", "y"]
    out = ["source_address", "trajectory_id", "cluster_id", "episode_id", "t", "sensor_name"]

    def __init__(self, p: MetricParams):
        self.p = p

    def init(self, handle):
        super().init(handle)
        self.trip = handle.getValueState("trip", "id long, open boolean, start long, last long, n long, sensors array<string>")
        self.walk = handle.getValueState("walk", "ax double, ay double, cluster long, episode long, last long")
        self.held = handle.getListState("held", "cluster long, episode long, t long, sensor string")

    def fold(self, key, rows, mark):
        p, out = self.p, []
        trip = self.trip.get() if self.trip.exists() else (0, False, 0, 0, 0, [])
        number, is_open, start, last, n = trip[:5]
        sensors, walk = set(trip[5]), None
        if self.walk.exists():
            ax, ay, cluster, episode, at = self.walk.get()
            walk = folds.Walk(ax, ay, at, cluster, episode)
        held, cleared = [], False

        def end():
            """The open trajectory is over: its rows go out if it is accepted."""
            nonlocal held, cleared
            if p.activity_min_windows <= n and p.activity_min_sensors <= len(sensors) and \
                    p.activity_min_seconds <= last - start <= p.activity_max_seconds:
                earlier = [] if cleared else list(self.held.get())
                out.extend((key[0], number, *row) for row in [*(tuple(r) for r in earlier), *held])
            held, cleared = [], True

        for t, sensor, x, y in rows:
            if is_open and t - last > p.visit_gap_seconds:
                end()
                is_open = False
            if not is_open:
                number, is_open, start, n, sensors, walk = number + 1, True, t, 0, set(), None
            last, n = t, n + 1
            sensors.add(sensor)
            if last - start > p.activity_max_seconds:
                held, cleared, walk = [], True, None      # too long for any use
                continue
            walk = folds.advance(walk, [(t, sensor, x, y)], p.activity_distance_metres, p.activity_continuity_gap_seconds,
                                 lambda w: None)
            held.append((walk.cluster, walk.episode, t, sensor))
        if is_open and (last + p.visit_gap_seconds) * 1000 < mark:
            end()
            is_open, walk, sensors = False, None, set()

        if cleared:
            self.held.clear()
        if held:
            self.held.appendList(held)
        self.trip.update((number, is_open, start, last, n, sorted(sensors)))
        if walk is None:
            self.walk.clear()
        else:
            self.walk.update((walk.ax, walk.ay, walk.cluster, walk.episode, walk.last))
        if is_open:
            self.handle.registerTimer((last + p.visit_gap_seconds) * 1000 + 1)
        return out


def _by_state(rows: DataFrame, processor: _Ordered, schema: str, late: str) -> DataFrame:
    own = rows.withWatermark("timestamp", late).withColumn("t", epoch("timestamp"))
    own = own.select("source_address", "timestamp", *processor.names)
    return own.groupBy("source_address").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def stationary(seconds: DataFrame, rules: CleaningParams = MAINTAINED_CLEANING, late: str = "10 minutes") -> DataFrame:
    """Identifiers of a stream of unflagged one-second rows as they turn out to be stationary, each once."""
    return _by_state(seconds, Stationary(rules), "source_address string, since_epoch long", late)


def clusters(located: DataFrame, p: MetricParams = MAINTAINED, late: str = "10 minutes") -> DataFrame:
    """Rows of a Location stream with trajectory, cluster and episode numbers, when their trajectory is over and accepted."""
    return _by_state(located, Clusters(p), "source_address string, trajectory_id long, cluster_id long, episode_id long, t long, "
                     "sensor_name string", late)


def run_available(stream: DataFrame, path: str, checkpoint: str):
    """``flows.run_available`` with the state store that these rules need; other streams of the session keep theirs."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return flows.run_available(stream, path, checkpoint)
    finally:
        spark.conf.set(STORE, before)


def stationary_of_archive(told: DataFrame, seconds: DataFrame, watermark, rules: CleaningParams = MAINTAINED_CLEANING) -> DataFrame:
    """All stationary identifiers of a finished archive: those told, and those of sessions still open when the stream ended."""
    from waymark.operators import cleaning
    rest = flows.open_sessions(seconds, cleaning.SESSION_KEY, watermark, rules.session_gap_seconds)
    return told.select("source_address").union(cleaning.stationary_identifiers(rest, rules)).distinct()


def clusters_of_archive(told: DataFrame, located: DataFrame, watermark, p: MetricParams = MAINTAINED) -> DataFrame:
    """All numbered rows of a finished archive: those told, and those of trajectories still open when the stream ended."""
    from waymark.operators import activities, track
    rest = flows.open_sessions(located, ["source_address"], watermark, p.visit_gap_seconds)
    trips = flows.still_open(track.trajectory_summary(rest, p.visit_gap_seconds), watermark, p.visit_gap_seconds)
    rows = activities.qualifying_rows(rest, p).join(trips.select(*folds.TRAJECTORY), folds.TRAJECTORY, "left_semi")
    numbered = activities.split_episodes(activities.anchor_clusters(rows, p.activity_distance_metres), p.activity_continuity_gap_seconds)
    return told.unionByName(numbered.select(*folds.TRAJECTORY, F.col("cluster_id").cast("long").alias("cluster_id"),
                                            F.col("episode_id").cast("long").alias("episode_id"), epoch("timestamp").alias("t"),
                                            "sensor_name"))
