"""Hot keys, two-phase publishing, runs that count and stop, and ranking columns as arguments."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.config import Config
from tessera.operators import sessions, tracking
from tessera.plans import pipeline, runs
from tessera.sources import tables

SF = "/root/testdata/sf0.001"


def test_a_hot_user_is_spread_over_tasks(spark):
    """One user holds 90 % of the rows; ties in time, a NULL user and users of one row."""
    rng, rows, t = random.Random(4), [], 0
    for k in range(2000):
        t += rng.choice([0, 1, 5, 30, 31, 100])
        rows.append((k, "hot" if k % 10 else rng.choice(["a", "b", None, f"u{k}"]), t))
    df = spark.createDataFrame(rows, "id long, u string, t long")
    got = {r.id: r.session_index for r in sessions.sessionize_spread(df, ["u"], "t", 30, "id").collect()}
    want = {r.id: r.session_index for r in sessions.sessionize(df, ["u"], "t", 30, "id").collect()}
    assert got == want and max(got.values()) > 100
    assert sessions._dealt(df, ["u"], ["t", "id"]).where("u = 'hot'").select("_part").distinct().count() >= 3
    ranks = {r.id: r["rank"] for r in sessions.ranked(df, ["u"], ["t", "id"], "rank").collect()}
    for u in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == u), key=lambda r: (r[2], r[0]))
        assert [ranks[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert sessions.sessionize_spread(df.limit(0), ["u"], "t", 30, "id").count() == 0


@pytest.mark.parametrize("spread", [False, True])
def test_closing_frames_equal_a_search(spark, spread):
    rng = random.Random(8)
    frames = [(s, rng.randrange(0, 4000)) for s in range(4) for _ in range(60)] + [(9, 10**9)]
    segments = [(s, k, rng.randrange(0, 5000), "x") for s in range(5) for k in range(25)] + [(9, 1, 5, "y")]
    f, g = spark.createDataFrame(frames, "stream_id long, ts_ms long"), spark.createDataFrame(segments, "stream_id long, segment_id long, last_ms long, note string")
    got = {(r.stream_id, r.segment_id): (r.close_ms, r.close_rank, r.note) for r in sessions.closing_frames(g, f, 120, 100, spread).collect()}
    close = {(s, k): min((t for q, t in frames if q == s and t > last + 120), default=None) for s, k, last, _ in segments}
    for s, k, _, note in segments:
        before = [x for x in close if x[0] == s and (close[x] is None, close[x] or 0, x[1]) < (close[s, k] is None, close[s, k] or 0, k)]
        assert got[s, k] == (close[s, k], len(before) + 1, note)


def test_publish_keeps_the_old_version_when_a_task_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="nothing has been published"):
        tables.published(spark, path)
    tables.publish(spark.range(5), path)
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.publish(bad, path)
    assert tables.published(spark, path).count() == 5
    reader = tables.published(spark, path)
    for n in (7, 8):
        tables.publish(spark.range(n), path)
        if n == 7:
            assert reader.count() == 5  # who reads the version before goes on
    assert tables.published(spark, path).count() == 8
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("version-")]) == 2 and not list((tmp_path / "out").glob("_pending*"))


def test_a_run_counts_and_a_cancelled_one_publishes_nothing(spark, tmp_path):
    cfg = registry.CFG
    from tessera.functions import scoring

    run = runs.Run(tables.observations(spark, SF, cfg), str(tmp_path / "a"), n=F.count("*"), n_pre=F.count_if(scoring.prefilter(cfg)), n_usable=F.count_if(scoring.identity_gate(cfg)), n_rep=F.count_if(F.col("is_rep")))
    counted = run.start().wait(120)
    want = registry.QUERIES["gate_funnel"](spark, SF).agg(*(F.sum(c).alias(c) for c in ("n", "n_pre", "n_usable", "n_rep"))).first().asDict()
    assert counted == want and run.progress() == 1.0 and tables.published(spark, str(tmp_path / "a")).count() == want["n"]

    slow = spark.range(0, 4, 1, 4).select(F.expr("reflect('java.lang.Thread', 'sleep', 60000L)").alias("x"), "id")
    run = runs.Run(slow, str(tmp_path / "b")).start()
    for _ in range(200):
        if spark.sparkContext.statusTracker().getActiveStageIds():
            break
        run.thread.join(0.1)
    run.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        run.wait(50)
    assert tables.current_version(spark, str(tmp_path / "b")) is None


def test_another_score_chooses_other_rows(spark):
    o = tables.observations(spark, SF, registry.CFG)
    plain = tracking.track(o, registry.CFG)
    other = tracking.track(o.withColumn("rep_score", -F.col("sharpness")).withColumn("is_rep", F.col("yaw") > 0), registry.CFG)
    hooked = tracking.track(o, registry.CFG, score=-F.col("sharpness"), gate=F.col("yaw") > 0)
    key = ["stream_id", "track_id"]
    assert hooked.drop("embedding").orderBy(key).collect() == other.drop("embedding").orderBy(key).collect()
    assert hooked.select("best_obs").orderBy(*key).collect() != plain.select("best_obs").orderBy(*key).collect()


def test_fallback_empty_and_invalid(spark, tmp_path):
    found = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (2, 1, 0), (2, 2, 0)], "stream_id long, entity_id long, n_obs long")
    assert sorted((r.stream_id, r.entity_id) for r in pipeline.shown(found).collect()) == [(1, 2), (2, 1), (2, 2)]
    report = spark.createDataFrame([(1, 2), (2, 0)], "stream_id long, n_identities long")
    assert pipeline.required(report.where("stream_id = 1")).first().n_identities == 2
    with pytest.raises(Exception, match="no identities in stream 2"):
        pipeline.required(report).collect()
    streams = spark.createDataFrame([(1, 400), (2, 0)], "stream_id long, duration_ms long")
    assert streams.where("stream_id = 1").select(tables.required_duration()).first()[0] == 400
    with pytest.raises(Exception, match="invalid source"):
        streams.select(tables.required_duration()).collect()
    (tmp_path / "a.mp4").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert [(r.length, bytes(r.content)) for r in tables.binary_files(spark, str(tmp_path), "*.mp4").collect()] == [(5, b"12345")]


def test_streams_are_of_bounded_length(spark, tmp_path):
    ids = spark.range(9000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(1).alias("label"))
    path = str(tmp_path)
    ids.write.parquet(f"{path}/embeddings.parquet")
    sizes = tables.observations(spark, path, Config(dim=1)).groupBy("stream_id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("end"))
    assert sizes.count() == 15 and sizes.agg(F.max("n"), F.countDistinct("end")).first()[0] == 600
