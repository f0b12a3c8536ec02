"""Tracks of several entities at once, and their identities.

Tracking is sequential only inside a scene: where two consecutive observation frames of a stream are
more than the gap apart every track has closed, so scenes are independent groups. Clustering is
sequential over a stream's segments in their closing order; streams too long for a task are clustered over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import scoring
from tessera.operators.clustering import leaders, merged
from tessera.operators.sessions import closing_frames, sessionize
from tessera.sources.tables import settled

LONGEST = 5000
SEGMENTS = "stream_id long, scene_id long, track_id long, start_ms long, last_ms long, n_obs long, best_obs long, best_score double, best_rep boolean, best_sharpness double, peak_obs long, peak_rep boolean, peak_value double, embedding array<double>"
ENTITIES = "stream_id long, entity_id long, n_segments long, n_obs long, best_obs long, peak_obs long, first_ms long, last_ms long, members array<long>"


def cos(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = float(a @ a), float(b @ b)
    return 0.0 if na <= 0 or nb <= 0 else max(-1.0, min(1.0, float(a @ b) / (na**0.5 * nb**0.5)))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of two sets of vectors; 0 where a norm is 0."""
    size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    return np.clip(np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size > 0), -1.0, 1.0)


class _Track:
    """A track in short: its times, how many rows it has, and the rows that lead by rank, among those that pass the gate, and in sharpness."""

    def __init__(self, at: int, ts: int):
        self.at, self.first, self.last, self.n = at, ts, ts, 0
        self.best = self.passing = self.sharpest = None

    def add(self, row, ts: int) -> None:
        self.last = ts
        self.n += 1
        if self.best is None or (bool(row.is_rep), row.rep_score) > (bool(self.best.is_rep), self.best.rep_score):
            self.best = row
        if row.is_rep and (self.passing is None or row.rep_score > self.passing.rep_score):
            self.passing = row
        if self.sharpest is None or row.sharpness > self.sharpest.sharpness:
            self.sharpest = row


def step(active: list[_Track], ts: int, rows: list, cfg: Config, opened: int) -> tuple[list[_Track], list[_Track], list[_Track]]:
    """One frame: close idle tracks, match, update, open. (still active, closed, new); ``opened``: tracks before."""
    closed = [t for t in active if ts - t.last > cfg.gap_ms]
    active = [t for t in active if ts - t.last <= cfg.gap_ms]
    sims = cosines(np.stack([r.vec for r in rows]), np.stack([t.best.vec for t in active])) if active and rows else np.empty((len(rows), 0))
    taken, used = {}, set()
    at_i, at_j = np.nonzero(sims >= cfg.similarity)
    for e in np.lexsort((at_j, at_i, -sims[at_i, at_j])):
        i, j = int(at_i[e]), int(at_j[e])
        if i not in taken and j not in used:
            taken[i] = active[j]
            used.add(j)
    new = []
    for i, r in enumerate(rows):
        if i in taken:
            taken[i].add(r, ts)
        else:
            new.append(_Track(opened + len(new), ts))
            new[-1].add(r, ts)
    return active + new, closed, new


def track_frames(frames: Iterator[tuple[int, list]], cfg: Config) -> list[_Track]:
    """Fold over (ts, observations) in time order; tracks in the order in which they opened."""
    tracks: list[_Track] = []
    active: list[_Track] = []
    for ts, rows in frames:
        active, _, new = step(active, ts, rows, cfg, len(tracks))
        tracks += new
    return tracks


def segment(stream: int, scene: int, t: _Track) -> tuple:
    """A track as a row of SEGMENTS: the first of equals is best; the peak is the best that passes, else the sharpest."""
    peak = t.passing if t.passing is not None else t.sharpest
    return (stream, scene, t.at + 1, t.first, t.last, t.n, t.best.obs_id, t.best.rep_score, bool(t.best.is_rep), t.best.sharpness, peak.obs_id, t.passing is not None, peak.sharpness if t.passing is None else peak.rep_score, t.best.vec.tolist())


NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def _fold(cfg: Config):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "obs_id"], kind="stable")
        pdf["vec"] = [np.asarray(v, float) for v in pdf["embedding"]]
        tracks = track_frames(((ts, list(g.itertuples())) for ts, g in pdf.groupby("ts_ms", sort=True)), cfg)
        return pd.DataFrame([segment(int(pdf["stream_id"].iloc[0]), int(pdf["session_index"].iloc[0]), t) for t in tracks], columns=NAMES)

    return fold


def track(obs: DataFrame, cfg: Config = Config(), score: Column | None = None, gate: Column | None = None) -> DataFrame:
    """Observations that pass the identity gate -> segments; track_id runs over the stream.

    score and gate rank a track's rows in place of rep_score and is_rep: what passes the gate comes first, then the higher score.
    """
    good = obs.where(scoring.identity_gate(cfg))
    if score is not None:
        good = good.withColumn("rep_score", F.coalesce(score.cast("double"), F.lit(0.0)))
    if gate is not None:
        good = good.withColumn("is_rep", F.coalesce(gate, F.lit(False)))
    scenes = sessionize(good, ["stream_id"], "ts_ms", cfg.gap_ms, "obs_id").select("stream_id", "session_index", "obs_id", "ts_ms", "embedding", "is_rep", "rep_score", "sharpness")
    local = scenes.groupBy("stream_id", "session_index").applyInPandas(_fold(cfg), SEGMENTS)
    return local.withColumn("track_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("scene_id", "track_id")).cast("long"))


def cluster_segments(rows: list[tuple[int, np.ndarray, float]], threshold: float, floor: float, merge: bool = True) -> list[list[int]]:
    """Ordered leader clustering of (id, vector, weight), then merging of the first close pair until none is left.

    A cluster's direction is its first vector until something joins it, from then on the weighted sum
    of its members; after a merge it is their plain sum.
    """
    if not rows:
        return []
    vectors = np.stack([v for _, v, _ in rows])
    groups: list[list[int]] = []
    sums = np.empty_like(vectors)
    for k, (_, v, w) in enumerate(rows):
        sims = cosines(v[None], sums[: len(groups)])[0]
        top = int(np.argmax(sims)) if len(sims) else -1
        if top >= 0 and sims[top] > -1 and sims[top] >= threshold:
            if len(groups[top]) == 1:
                first = rows[groups[top][0]]
                sums[top] = first[1] * max(floor, first[2])
            groups[top].append(k)
            sums[top] += v * max(floor, w)
        else:
            sums[len(groups)] = v
            groups.append([k])
    sums = sums[: len(groups)].copy()
    # a merge changes one row and column of the similarities; the scan for the first close pair starts over
    close = np.triu(cosines(sums, sums) >= threshold, 1) if merge else np.zeros((len(groups), len(groups)), bool)
    live = np.ones(len(groups), bool)
    while (left := np.flatnonzero(close.any(1))).size:
        i = int(left[0])
        j = int(np.flatnonzero(close[i])[0])
        groups[i] += groups[j]
        live[j] = False
        close[j], close[:, j] = False, False
        sums[i] = vectors[groups[i]].sum(0)
        now = (cosines(sums[i][None], sums)[0] >= threshold) & live
        close[i], close[:, i] = now & (np.arange(len(live)) > i), now & (np.arange(len(live)) < i)
    groups = [g for g, ok in zip(groups, live, strict=True) if ok]
    return [[rows[k][0] for k in g] for g in groups]


def _entities_by_tables(ranked: DataFrame, cfg: Config, merge: bool) -> DataFrame:
    """The same as the fold of a stream, where a stream is too long for one task."""
    rows = ranked.withColumnsRenamed({"close_rank": "rank", "embedding": "vec", "best_score": "weight"})
    found = leaders(rows, cfg.similarity, cfg.weight_floor)
    found = merged(found, cfg.similarity, cfg.weight_floor) if merge else found.withColumn("entity", F.col("cluster")).withColumn("place", F.col("rank"))
    best, peak = (F.struct(*(F.col(c) for c in key), -F.col("place")) for key in (("best_rep", "weight"), ("peak_rep", "peak_value")))
    return found.groupBy("stream_id", F.col("entity").alias("entity_id")).agg(
        F.count("*").alias("n_segments"), F.sum("n_obs").alias("n_obs"), F.max_by("best_obs", best).alias("best_obs"), F.max_by("peak_obs", peak).alias("peak_obs"),
        F.min("start_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.transform(F.array_sort(F.collect_list(F.struct("place", "track_id"))), lambda m: m["track_id"]).alias("members"),
    )


def entities(segments: DataFrame, frames: DataFrame, cfg: Config = Config(), merge: bool = True, longest: int = LONGEST) -> DataFrame:
    """Segments in closing order -> identities, with the tiered best row and the peak row of each.

    A stream of up to ``longest`` segments is one group; longer ones are clustered over tables, with the same result.
    """
    ranked = closing_frames(segments.withColumnRenamed("track_id", "segment_id"), frames, cfg.gap_ms).withColumnRenamed("segment_id", "track_id")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("close_rank").set_index("track_id", drop=False)
        rows = [(int(t), np.asarray(v, float), float(s)) for t, v, s in zip(pdf["track_id"], pdf["embedding"], pdf["best_score"], strict=True)]
        out = []
        for k, members in enumerate(cluster_segments(rows, cfg.similarity, cfg.weight_floor, merge), 1):
            own = pdf.loc[members]
            best = max(own.itertuples(), key=lambda r: (bool(r.best_rep), r.best_score))
            peak = max(own.itertuples(), key=lambda r: (bool(r.peak_rep), r.peak_value))
            out.append((int(pdf["stream_id"].iloc[0]), k, len(own), int(own["n_obs"].sum()), int(best.best_obs), int(peak.peak_obs), int(own["start_ms"].min()), int(own["last_ms"].max()), [int(m) for m in members]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ENTITIES.split(", ")])

    ranked = settled(ranked)
    long = ranked.groupBy("stream_id").count().where(F.col("count") > longest).select("stream_id")
    if long.isEmpty():
        return ranked.groupBy("stream_id").applyInPandas(fold, ENTITIES)
    short = ranked.join(long, "stream_id", "left_anti").groupBy("stream_id").applyInPandas(fold, ENTITIES)
    return short.unionByName(_entities_by_tables(ranked.join(long, "stream_id"), cfg, merge))
