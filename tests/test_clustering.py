"""Leaders in epochs and merging over tables against the serial versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import clustering, tracking
from tessera.plans import pipeline
from tessera.sources import tables

SF = "/root/testdata/sf0.001"


def streams(seed, sizes, dim, noise, centres):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(sizes):
        for k in range(n):
            v = np.eye(dim)[k % centres % dim] + rng.normal(0, noise, dim)
            rows.append((s, k + 1, v.tolist() if rng.random() > 0.02 else [0.0] * dim, float(rng.random())))
    return rows


@pytest.mark.parametrize(("block", "keep", "threshold", "noise"), [(24, 2, 0.7, 0.45)])
def test_leaders_equal_the_serial_fold(spark, block, keep, threshold, noise):
    """Few candidates and noisy rows, so that replays stop and go on."""
    rows = streams(block, (40, 1, 20), 5, noise, 4)
    df = spark.createDataFrame(rows, "stream_id long, rank long, vec array<double>, weight double")
    got = {}
    for r in clustering.leaders(df, threshold, 0.1, block, keep).collect():
        got.setdefault((r.stream_id, r.cluster), []).append(r["rank"])
    want = {}
    for s in range(3):
        own = [(k, np.array(v), w) for t, k, v, w in rows if t == s]
        for c, members in enumerate(tracking.cluster_segments(own, threshold, 0.1, merge=False), 1):
            want[s, c] = members
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 8


def test_merging_over_tables_equals_the_serial_loop(spark):
    rows = streams(3, (40, 2, 30), 6, 0.45, 6)
    df = spark.createDataFrame(rows, "stream_id long, rank long, vec array<double>, weight double")
    found = clustering.merged(clustering.leaders(df, 0.6, 0.1), 0.6, 0.1)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault((r.stream_id, r.entity), []).append(r["rank"])
    want, merges = {}, 0
    for s in range(3):
        own = [(k, np.array(v), w) for t, k, v, w in rows if t == s]
        groups = tracking.cluster_segments(own, 0.6, 0.1)
        merges += len(tracking.cluster_segments(own, 0.6, 0.1, merge=False)) - len(groups)
        want |= {(s, c): members for c, members in enumerate(groups, 1)}
    assert got == want and merges > 1
    assert clustering.merged(clustering.leaders(df.limit(0), 0.6, 0.1), 0.6, 0.1).count() == 0


def test_long_streams_give_the_same_entities(spark):
    o = tables.observations(spark, SF, registry.CFG)
    segments, line = tracking.track(o, registry.CFG), pipeline.frame_line(o, registry.CFG)
    short = tracking.entities(segments, line, registry.CFG).orderBy("stream_id", "entity_id").collect()
    mixed = tracking.entities(segments, line, registry.CFG, longest=40).orderBy("stream_id", "entity_id").collect()
    assert [tuple(r) for r in mixed] == [tuple(r) for r in short]


def test_one_long_stream_is_no_single_task(spark):
    """A stream of 1,200 rows in epochs of 400: no task takes more than a block of it."""
    rng = np.random.default_rng(12)
    m = np.eye(24)[rng.integers(0, 24, 1200)] + rng.normal(0, 0.08, (1200, 24))
    df = spark.createDataFrame(pd.DataFrame({"stream_id": 1, "rank": range(1, 1201), "vec": m.tolist(), "weight": rng.random(1200)}))
    got = clustering.leaders(df, 0.7, 0.1, 400).groupBy("cluster").agg(F.array_sort(F.collect_list("rank")).alias("m")).orderBy("cluster").collect()
    want = tracking.cluster_segments([(k + 1, m[k], w) for k, w in enumerate(df.toPandas()["weight"])], 0.7, 0.1, merge=False)
    assert [list(r.m) for r in got] == want and len(want) >= 24
