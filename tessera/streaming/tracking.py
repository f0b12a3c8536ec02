"""The tracker over a live stream of observations: state and timers a stream, and the flush at its end."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.config import Config
from tessera.functions import scoring
from tessera.operators import tracking

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["obs_id", "ts_ms", "embedding", "is_rep", "rep_score", "sharpness"]
Row = namedtuple("Row", ["obs_id", "is_rep", "rep_score", "sharpness", "vec"])


ROW = "obs_id long, is_rep boolean, rep_score double, sharpness double, vec array<double>"
_LEAD = "struct<obs_id:bigint,is_rep:boolean,rep_score:double,sharpness:double>"
TRACK = f"track_id long, first_ms long, last_ms long, n long, best {_LEAD}, passing {_LEAD}, sharpest {_LEAD}, vec array<double>"

TRACK_NAMES = ["track_id", "first_ms", "last_ms", "n", "best", "passing", "sharpest", "vec"]


def _packed(t) -> tuple:
    lead = lambda r: None if r is None else (r.obs_id, r.is_rep, r.rep_score, r.sharpness)
    return (t.at, t.first, t.last, t.n, lead(t.best), lead(t.passing), lead(t.sharpest), t.best.vec.tolist())


def _unpacked(row) -> tracking._Track:
    t = tracking._Track(int(row[0]), int(row[1]))
    t.last, t.n = int(row[2]), int(row[3])
    leads = ([*r.values()] if isinstance(r, dict) else r for r in row[4:7])
    t.best, t.passing, t.sharpest = (None if r is None else Row(*r, np.asarray(row[7], float)) for r in leads)
    return t


class Tracker(StatefulProcessor):
    """Rows wait until the watermark has passed their frame, so frames are folded whole and in order of time.

    A timer a frame folds it; a timer at the end of a track's gap closes it. State is typed: a map of the rows that wait, by frame
    and observation, a list of open tracks, each in short (running best and peak, no rows), and the number of tracks so far. So it grows
    with what waits and with open tracks, not with the rows that tracks have had.
    """

    def __init__(self, cfg: Config):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts_ms long, obs_id long", ROW)
        self.tracks = handle.getListState("tracks", TRACK)
        self.opened = handle.getValueState("opened", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts in pdf["ts_ms"].unique():
                self.handle.registerTimer(int(ts))
            for r in pdf[COLUMNS].itertuples(index=False):
                self.waiting.updateValue((int(r.ts_ms), int(r.obs_id)), (int(r.obs_id), bool(r.is_rep), float(r.rep_score), float(r.sharpness), np.asarray(r.embedding, float).tolist()))
        yield pd.DataFrame([], columns=tracking.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, closed = int(expiredTimerInfo.getExpiryTimeInMs()), []
        active, opened = [_unpacked(t) for t in self.tracks.get()], int(self.opened.get()[0]) if self.opened.exists() else 0
        # timers of one batch may come in any order: fold all frames up to this one
        due: dict[int, list[Row]] = {}
        for (at, obs_id), r in self.waiting.iterator():
            if at <= ts:
                due.setdefault(int(at), []).append(Row(int(obs_id), bool(r[1]), float(r[2]), float(r[3]), np.asarray(r[4], float)))
        for at in sorted(due):
            active, done, new = tracking.step(active, at, sorted(due[at], key=lambda r: r.obs_id), self.cfg, opened)
            opened += len(new)
            closed += done
            self.handle.registerTimer(at + self.cfg.gap_ms + 1)
            for r in due[at]:
                self.waiting.removeKey((at, r.obs_id))
        active, done, _ = tracking.step(active, ts, [], self.cfg, opened)
        closed += done
        if active:
            self.tracks.put([_packed(t) for t in active])
        else:
            self.tracks.clear()
        self.opened.update((opened,))
        yield pd.DataFrame([tracking.segment(int(key[0]), 0, t) for t in closed], columns=tracking.NAMES)


def live_tracks(obs: DataFrame, cfg: Config, late: str) -> DataFrame:
    """Streaming observations -> segments as they close; scene_id is 0, track_id counts the stream's tracks.

    The state store must be the RocksDB one (``PROVIDER``). Rows later than ``late`` are dropped by the watermark.
    """
    good = obs.where(scoring.identity_gate(cfg)).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return good.select("stream_id", *COLUMNS, "at").groupBy("stream_id").transformWithStateInPandas(Tracker(cfg), tracking.SEGMENTS, "Append", "EventTime")


def open_state(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(open tracks, rows that wait) of a stopped query, from its state store: stream_id and the fields of TRACK; stream_id, ts_ms and the fields of ROW."""
    read = spark.read.format("statestore")
    tracks = read.option("stateVarName", "tracks").option("flattenCollectionTypes", True).load(checkpoint).select("key.stream_id", "list_element.*")
    waiting = read.option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(checkpoint).select("key.stream_id", F.col("user_map_key.ts_ms").alias("ts_ms"), "user_map_value.*")
    return tracks, waiting


def flush(spark: SparkSession, closed: DataFrame, checkpoint: str, cfg: Config) -> DataFrame:
    """End of stream: what the stopped query has given, then the tracks that are open in its state, after the rows that still wait. The input isn't read again."""
    tracks, waiting = open_state(spark, checkpoint)

    def close(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        active = [_unpacked([r[c] for c in TRACK_NAMES]) for r in left.sort_values("track_id").to_dict("records")]
        opened = 1 + max([t.at for t in active] + left["opened"].sub(1).tolist() + right["opened"].sub(1).tolist(), default=-1)
        done = []
        for at, frame in right.groupby("ts_ms", sort=True):
            rows = [Row(int(r.obs_id), bool(r.is_rep), float(r.rep_score), float(r.sharpness), np.asarray(r.vec, float)) for r in frame.sort_values("obs_id").itertuples()]
            active, gone, new = tracking.step(active, int(at), rows, cfg, int(opened))
            opened += len(new)
            done += gone
        return pd.DataFrame([tracking.segment(int(key[0]), 0, t) for t in done + active], columns=tracking.NAMES)

    counts = spark.read.format("statestore").option("stateVarName", "opened").load(checkpoint).select("key.stream_id", F.col("value.n").alias("opened"))
    some, rest = (side.join(counts, "stream_id", "left").fillna(0, ["opened"]) for side in (tracks, waiting))
    ended = some.groupBy("stream_id").cogroup(rest.groupBy("stream_id")).applyInPandas(close, tracking.SEGMENTS)
    return closed.unionByName(ended.select(*closed.columns))
