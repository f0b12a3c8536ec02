"""Core queries against DuckDB, and the folds against the cases that they were specified by."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.config import Config
from tessera.functions import scoring
from tessera.functions import vectors as V
from tessera.operators import matching, sessions, tracking
from tessera.plans import pipeline
from tessera.sources import tables
from tessera.streaming import sessions as live

SF = "/root/testdata/sf0.001"
TEST = Config(similarity=0.65, dim=192)


def canon(df: pd.DataFrame) -> list:
    rows = [tuple(None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(float(v), 4) if isinstance(v, (float, np.floating)) else str(v) if isinstance(v, str) else float(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for a, b in zip(canon(ours), canon(theirs), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or x == pytest.approx(y, abs=2e-4)


def test_vectors(spark):
    df = spark.createDataFrame([([0.6, 0.8, 0.0], [0.6, 0.8, 0.0], 1.0), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [-2.0], -1.0)], "a array<double>, b array<double>, want double")
    assert all(abs(r.got - r.want) < 1e-4 for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("got"), "want").collect())
    with pytest.raises(Exception, match="equal length"):
        spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b"))).collect()
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(V.normalized(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]
    c = V.centroid(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, None)], "k int, v array<double>"), ["k"], "v", 2).first()["centroid"]
    assert c == pytest.approx([2**-0.5] * 2)
    bad = [[0.1] * 192, [0.1] * 128, [float("nan")] + [0.1] * 191, [0.0] * 192]
    assert [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(bad)], "i int, v array<double>").orderBy("i").select(V.valid(F.col("v"), 192)).collect()] == [True, False, False, False]


def observation(**over):
    row = {"obs_id": 1, "stream_id": 1, "ts_ms": 1000, "box_left": 100.0, "box_top": 100.0, "face_w": 100.0, "face_h": 100.0, "frame_w": 1080, "frame_h": 1920, "sharpness": 25.0, "left_eye": 1.0, "right_eye": 1.0, "pitch": 0.0, "yaw": 0.0, "roll": 0.0, "smile": 0.5, "is_clipped": False, "rep_score": 0.8, "is_rep": True, "embedding": [1.0] + [0.1] * 191} | over
    return row | {"box_right": row["box_left"] + row["face_w"], "box_bottom": row["box_top"] + row["face_h"]}


def test_gates(spark):
    cfg = Config(min_sharpness=15, motion_sharpness=10, dim=192)
    cases = [({}, True, True), ({"sharpness": 5.0}, True, False), ({"face_w": 20.0, "face_h": 20.0}, False, False), ({"is_clipped": True}, True, False), ({"left_eye": 0.05, "right_eye": 0.05}, True, False), ({"yaw": 60.0}, True, False)]
    rows = [observation(obs_id=i, **over) for i, (over, _, _) in enumerate(cases)]
    got = spark.createDataFrame(pd.DataFrame(rows)).orderBy("obs_id").select(scoring.identity_gate(cfg), scoring.representative_gate(cfg)).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def obs_frame(spark, items):
    rows = [observation(obs_id=i, ts_ms=ts, box_left=x, sharpness=30.0, embedding=v) for i, (ts, x, v) in enumerate(items)]
    return spark.createDataFrame(pd.DataFrame(rows))


def axis(k):
    return [float(i == k) for i in range(192)]


@pytest.mark.parametrize(("times", "want"), [(range(0, 1001, 200), [(0, 1000, 6)]), ([*range(0, 1001, 200), 4000, 4200, 4400], [(0, 1000, 6), (4000, 4400, 3)]), ([0, 1200], [(0, 1200, 2)]), ([0, 1201], [(0, 0, 1), (1201, 1201, 1)])])
def test_tracks(spark, times, want):
    got = tracking.track(obs_frame(spark, [(t, 100.0, axis(0)) for t in times]), TEST).orderBy("track_id").collect()
    assert [(r.start_ms, r.last_ms, r.n_obs) for r in got] == want


def test_two_entities(spark):
    got = tracking.track(obs_frame(spark, [(t, x, axis(k)) for t in (0, 200, 400) for k, x in ((0, 100.0), (1, 400.0))]), TEST).collect()
    assert sorted(r.n_obs for r in got) == [3, 3]


def test_clusters():
    a = [(1, np.array([1.0, 0]), 0.71), (2, np.array([0.99, 0.01]), 0.89), (3, np.array([0.98, 0.02]), 0.77)]
    assert tracking.cluster_segments(a, 0.65, 0.1) == [[1, 2, 3]]
    assert tracking.cluster_segments([(1, np.array([1.0, 0]), 1), (2, np.array([0, 1.0]), 1)], 0.65, 0.1) == [[1], [2]]
    assert tracking.cluster_segments([(1, np.array([1.0, 0]), 1), (2, np.array([-1.0, 0]), 1)], -1.0, 0.1, merge=False) == [[1], [2]]


def test_scene_split_equals_whole_fold(spark):
    obs = tables.observations(spark, SF, registry.CFG)
    got = sorted((r.stream_id, r.start_ms, r.last_ms, r.n_obs) for r in tracking.track(obs, registry.CFG).collect())
    pdf = obs.where(scoring.identity_gate(registry.CFG)).toPandas().sort_values(["ts_ms", "obs_id"])
    pdf["vec"] = [np.asarray(v, float) for v in pdf.embedding]
    want = []
    for sid, g in pdf.groupby("stream_id"):
        want += [(sid, t.first, t.last, t.n) for t in tracking.track_frames(((ts, list(f.itertuples())) for ts, f in g.groupby("ts_ms")), registry.CFG)]
    assert got == sorted(want)
    n = pipeline.cluster_entities(obs, registry.CFG).agg(F.sum("n_obs")).first()[0]
    assert n == len(pdf)


def test_live_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.run_available(live.live_sessions(stream, ["user_id"], "ts", "6 hours", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    closed = spark.read.schema("user_id long, start_ts timestamp, end_ts timestamp, n long").parquet(str(tmp_path / "out"))
    whole = live.flush(closed, str(tmp_path / "cp"), ["user_id"])
    got = whole.select("user_id", F.unix_micros("start_ts").alias("a"), F.unix_micros("end_ts").alias("b"), "n").collect()
    assert sorted(map(tuple, got)) == sorted((r.user_id, r.start_us, r.end_us, r.n) for r in registry.sessions_window(spark, SF).collect())
    assert 0 < closed.count() < whole.count()


def test_empty_and_literal_edges(spark):
    none = tables.observations(spark, SF, registry.CFG).limit(0)
    assert tracking.track(none, registry.CFG).count() == 0
    streams = spark.createDataFrame([(1, 0), (2, 400), (3, 399)], "stream_id int, duration_ms long")
    assert sorted((r.stream_id, r.ts_ms) for r in tables.sample_grid(streams).collect()) == [(2, 0), (2, 200), (2, 400), (3, 0), (3, 200)]
    rows = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "k int, score int, at int")
    assert rows.groupBy("k").agg(sessions.best(F.col("at"), F.col("score"), -F.col("at")).alias("x")).first().x == 2


def slow_cos(a, b):
    dot, na, nb = (sum(float(x) * float(y) for x, y in zip(p, q, strict=True)) for p, q in ((a, b), (a, a), (b, b)))
    return 0.0 if na <= 0 or nb <= 0 else dot / math.sqrt(na * nb)


def slow_tracks(rows, threshold, gap):
    """Observation by observation, as dictionaries: (first, last, ids) of each track."""
    tracks = []
    for ts in sorted({r["ts_ms"] for r in rows}):
        frame = sorted((r for r in rows if r["ts_ms"] == ts), key=lambda r: r["obs_id"])
        free = [t for t in tracks if ts - t["last"] <= gap]
        open_rows = list(frame)
        while True:
            best = None
            for r in open_rows:
                for t in free:
                    s = slow_cos(r["embedding"], t["best"]["embedding"])
                    if s >= threshold and (best is None or s > best[0]):
                        best = (s, r, t)
            if best is None:
                break
            _, r, t = best
            open_rows = [x for x in open_rows if x is not r]
            free = [x for x in free if x is not t]
            t["rows"].append(r)
            t["last"] = ts
            if (r["is_rep"], r["rep_score"]) > (t["best"]["is_rep"], t["best"]["rep_score"]):
                t["best"] = r
        for r in frame:
            if any(r is x for x in open_rows):
                tracks.append({"first": ts, "last": ts, "rows": [r], "best": r})
    return sorted((t["first"], t["last"], sorted(r["obs_id"] for r in t["rows"])[0], len(t["rows"]), t["best"]["obs_id"]) for t in tracks)


def test_tracks_equal_a_slow_version(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        v = np.eye(6)[k % 4] + rng.normal(0, 0.35, 6)
        rows.append(observation(obs_id=k, ts_ms=int(k // 3 * 200 + (k // 30) * 1100 + (k // 75) * 900), embedding=v.tolist(), rep_score=float(rng.integers(0, 5)) / 5, is_rep=bool(rng.integers(0, 2)), sharpness=30.0))
    cfg = Config(similarity=0.6, dim=6)
    got = tracking.track(spark.createDataFrame(pd.DataFrame(rows)), cfg).collect()
    want = slow_tracks(rows, 0.6, cfg.gap_ms)
    assert sorted((r.start_ms, r.last_ms, r.n_obs, r.best_obs) for r in got) == sorted((a, b, n, best) for a, b, _, n, best in want) and 8 < len(want) < 100


def slow_clusters(rows, threshold, floor):
    groups = []
    for k, (_, v, w) in enumerate(rows):
        best = None
        for g in groups:
            s = slow_cos(v, g["sum"])
            if s >= threshold and s > -1 and (best is None or s > best[0]):
                best = (s, g)
        if best is None:
            groups.append({"sum": list(v), "rows": [k]})
            continue
        g = best[1]
        if len(g["rows"]) == 1:
            first = rows[g["rows"][0]]
            g["sum"] = [x * max(floor, first[2]) for x in first[1]]
        g["sum"] = [x + y * max(floor, w) for x, y in zip(g["sum"], v, strict=True)]
        g["rows"].append(k)
    merges = 0
    while True:
        pair = next(((a, b) for i, a in enumerate(groups) for b in groups[i + 1 :] if slow_cos(a["sum"], b["sum"]) >= threshold), None)
        if pair is None:
            return [[rows[k][0] for k in g["rows"]] for g in groups], merges
        a, b = pair
        a["rows"] += b["rows"]
        a["sum"] = [sum(rows[k][1][d] for k in a["rows"]) for d in range(len(rows[0][1]))]
        groups = [g for g in groups if g is not b]
        merges += 1


def test_clusters_equal_a_slow_version():
    rng, merged = np.random.default_rng(9), 0
    for _ in range(60):
        rows = [(k + 1, np.eye(4)[k % 3] + rng.normal(0, 0.5, 4), float(rng.random())) for k in range(int(rng.integers(1, 25)))]
        want, merges = slow_clusters(rows, 0.6, 0.1)
        assert tracking.cluster_segments(rows, 0.6, 0.1) == want
        merged += merges
    assert merged > 10


def test_greedy_equals_repeated_best_edge(spark):
    """Many keys with ties, chains in which each edge waits for the one before, repeated edges and NULLs."""
    rng, rows = random.Random(2), []
    for key in range(40):
        rows += [(key, a, b, rng.randrange(6) / 5) for a in range(5) for b in range(4) if rng.random() < 0.7]
    rows += [(100, 0, 0, 0.9), (100, 0, 1, 0.5), (100, 1, 0, 0.8), (101, 0, 0, 0.5), (101, 0, 0, 0.5)]
    rows += [(102, k // 2, (k + 1) // 2, 1 - k / 50) for k in range(12)]
    want = []
    for key in {r[0] for r in rows}:
        left = [r for r in rows if r[0] == key]
        while left:
            top = min(left, key=lambda r: (-r[3], r[1], r[2]))
            want.append(top)
            left = [r for r in left if r[1] != top[1] and r[2] != top[2]]
    odd = [(None, 1, 1, 0.9), (0, None, 9, 0.9), (0, 9, 9, None)]
    edges = spark.createDataFrame(rows + odd, "k int, a int, b int, sim double")
    assert sorted(tuple(r) for r in matching.greedy_assignment(edges, ["k"], "a", "b").collect()) == sorted(want)
    assert matching.greedy_assignment(edges.limit(0), ["k"], "a", "b").count() == 0


@pytest.mark.parametrize("limit", [1 << 25, 50])
def test_nearest_centroid_keeps_equal_rows(spark, monkeypatch, limit):
    """1,100 centroids, by broadcast and by lists: five equal rows in, five out; the smaller id among equals; NULLs match none."""
    monkeypatch.setattr(matching, "MAX_BROADCAST_BYTES", limit)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1100, 5))
    m[900] = 2 * m[3]
    cents = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(2000, None), (None, [1.0] * 5)], "centroid_id int, centroid array<double>")
    rows = spark.createDataFrame([("x", m[3].tolist())] * 5 + [("y", (-m[7]).tolist()), ("z", [0.0] * 5), ("none", None)], "name string, vec array<double>")
    got = sorted((r.name, r.centroid_id, r.sim and round(r.sim, 9)) for r in matching.nearest_centroid(rows, cents, "vec").collect())
    sims = [[slow_cos(v, c) for c in m] for v in (-m[7], [0.0] * 5)]
    want = [(n, int(np.argmax(s)), round(max(s), 9)) for n, s in zip("yz", sims, strict=True)]
    assert got == [("none", None, None)] + [("x", 3, 1.0)] * 5 + want
    assert matching.nearest_centroid(rows, cents.limit(0), "vec").where("centroid_id is null").count() == 8


def test_many_rows_meet_many_centroids_as_lists(spark, monkeypatch):
    """Lists on both sides: what moves is a list for each pair of lists, not a list for each row."""
    monkeypatch.setattr(matching, "MAX_BROADCAST_BYTES", 1000)
    rng = np.random.default_rng(8)
    rows, cents = rng.normal(size=(5000, 8)), rng.normal(size=(2500, 8))
    a = spark.createDataFrame(pd.DataFrame({"name": range(5000), "vec": rows.tolist()}))
    b = spark.createDataFrame(pd.DataFrame({"centroid_id": range(2500), "centroid": cents.tolist()}))
    got = {r.name: r.centroid_id for r in matching.nearest_centroid(a, b, "vec").collect()}
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rows, cents)]
    assert [got[k] for k in range(5000)] == (unit[0] @ unit[1].T).argmax(1).tolist()


@pytest.mark.parametrize("threshold", [0.95, 0.7, 0.0, -0.3, -1.0])
def test_theta_join_equals_all_pairs(spark, threshold):
    """Clustered rows, copies, opposite and zero vectors, NULLs and NaN, in small blocks."""
    rng = np.random.default_rng(6)
    m = np.concatenate([np.eye(4)[k] + rng.normal(0, 0.2, (30, 4)) for k in range(3)] + [rng.normal(size=(20, 4)), np.ones((12, 4)), -np.ones((2, 4)), np.zeros((3, 4))])
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    df = spark.createDataFrame([*rows, (500, None), (None, [1.0] * 4), (501, [float("nan"), 1.0, 0.0, 0.0])], "id int, vec array<double>")
    sims = np.array([[slow_cos(a, b) for b in m] for a in m])
    safe = {(a, b) for a in range(len(m)) for b in range(len(m)) if sims[a, b] >= threshold + 1e-9}
    edge = {(a, b) for a in range(len(m)) for b in range(len(m)) if abs(sims[a, b] - threshold) < 1e-9}
    got = [(r.id_a, r.id_b) for r in matching.similar_pairs(df, threshold, block=20).collect()]
    assert len(got) == len(set(got)) and {p for p in safe if p[0] < p[1]} <= set(got) <= {p for p in safe | edge if p[0] < p[1]}
    other = spark.createDataFrame(rows[:40], "id int, vec array<double>")
    both = {(r.id_a, r.id_b) for r in matching.theta_join(other, df, threshold, block=20).collect()}
    assert {p for p in safe if p[0] < 40} <= both <= {p for p in safe | edge if p[0] < 40}
    assert matching.similar_pairs(df.limit(0), threshold).count() == 0


def _shuffled(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_theta_join_copies_a_row_once_a_list(spark):
    """Vectors without clusters reach every cell: 3,000 rows go to three lists each, not to 55 cells."""
    m = np.random.default_rng(9).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"id": range(3000), "vec": m.tolist()}), "id long, vec array<float>")
    before = _shuffled(spark)
    got = {(r.id_a, r.id_b): r.sim for r in matching.similar_pairs(df, 0.35).collect()}
    assert 3000 * 3 <= _shuffled(spark) - before <= 3000 * 4
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sims = np.triu(unit @ unit.T, 1)
    assert set(got) == {(int(a), int(b)) for a, b in zip(*np.nonzero(sims >= 0.35), strict=True)}
    assert max(abs(s - sims[p]) for p, s in got.items()) < 1e-12


@pytest.mark.parametrize("threshold", [0.9, 0.2, -0.2])
def test_theta_join_with_a_cell_of_many_lists(spark, threshold):
    """150 copies in lists of 20, ids below 0 and used twice, each pair of rows once: a table with itself and two tables, also in order."""
    rng = np.random.default_rng(2)
    m = np.concatenate([np.tile(rng.normal(size=8), (150, 1)), rng.normal(size=(60, 8)), np.zeros((2, 8))])
    ids = np.concatenate([np.arange(-100, 110), [108, 109]])
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, m, strict=True)], "id long, vec array<double>")
    sims = np.array([[slow_cos(a, b) for b in m] for a in m])
    assert not (abs(sims - threshold) < 1e-9).any()
    want = sorted((int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(sims >= threshold), strict=True))
    assert sorted((r.id_a, r.id_b) for r in matching.similar_pairs(df, threshold, block=20).collect()) == [p for p in want if p[0] < p[1]]
    other = df.select("*")
    assert sorted((r.id_a, r.id_b) for r in matching.theta_join(df, other, threshold, block=20).collect()) == want
    assert sorted((r.id_a, r.id_b) for r in matching.theta_join(df, other, threshold, True, block=20).collect()) == [p for p in want if p[0] < p[1]]


def test_similarity_join_without_keys(spark):
    a = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0]), ("p", [1.0, 0.0])], "x string, u array<double>")
    b = spark.createDataFrame([("r", [2.0, 0.1]), ("s", [-1.0, 0.0])], "y string, w array<double>")
    out = matching.similarity_join(a, b, [], 0.9, "u", "w")
    assert out.columns == ["x", "u", "y", "w", "sim"] and sorted((r.x, r.y) for r in out.collect()) == [("p", "r"), ("p", "r")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_run_report_counts_identities(spark):
    o = tables.observations(spark, SF, registry.CFG)
    found = pipeline.cluster_entities(o, registry.CFG)
    n = {r.stream_id: r["count"] for r in found.groupBy("stream_id").count().collect()}
    got = registry.QUERIES["run_report"](spark, SF).collect()
    assert {r.stream_id: r.n_identities for r in got} == n


def test_live_tracks_equal_batch(spark, tmp_path):
    """Frames in two files, the second with rows of the first's time: closed tracks and the flush give the batch's segments."""
    from tessera.streaming import tracking as live_tracking

    o = tables.observations(spark, SF, registry.CFG).where("obs_id < 260").withColumn("ts_ms", F.col("ts_ms") + 3_600_000)  # the first watermark is 0
    o.where("obs_id < 150 and obs_id % 7 <> 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_tracking.PROVIDER)

    def run_on():
        stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = live_tracking.live_tracks(stream, registry.CFG, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    try:
        run_on()
        tracks, waiting = live_tracking.open_state(spark, str(tmp_path / "cp"))
        assert tracks.count() + waiting.count() > 0 and set(live_tracking.TRACK_NAMES) < set(tracks.columns)
        o.where("obs_id >= 150 or obs_id % 7 = 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_on()  # a restart from the checkpoint
        quick = live_tracking.live_tracks(spark.readStream.schema(o.schema).parquet(str(tmp_path / "in")), registry.CFG, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        quick.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = sorted((r.stream_id, r.start_ms, r.last_ms, r.n_obs, r.best_obs, r.peak_obs) for r in tracking.track(o, registry.CFG).collect())
    for out, cp in (("out", "cp"), ("out2", "cp2")):
        closed = spark.read.schema(tracking.SEGMENTS).parquet(str(tmp_path / out))
        got = live_tracking.flush(spark, closed, str(tmp_path / cp), registry.CFG).collect()
        assert sorted((r.stream_id, r.start_ms, r.last_ms, r.n_obs, r.best_obs, r.peak_obs) for r in got) == want
    assert 0 < closed.count()
