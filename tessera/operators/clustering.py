"""Ordered clustering of streams of any length: leaders in optimistic epochs, merging as a loop over tables.

Ordered leader clustering is a serial fold: each row joins the most similar cluster so far, or opens one, and a cluster's
direction moves with each row that joins. What costs is comparing a row with all clusters, and that needs no order
while the clusters stand still. So a block of each stream is compared with the clusters as they were before it, in parallel, and
each row keeps its few best. A replay then takes the block's rows in order: clusters that changed within the block (its own rows
moved them) are compared anew, all others are as frozen. If a row's best are all changed, and none of them beats what the frozen
order leaves open, the replay stops there and the rest of the block has another round; the first row of a round can always be decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matching import _cosines, _meet, _unit_rows
from tessera.sources.tables import settled

BLOCK, BEST = 2048, 8
_REPLAY = "kind int, stream_id long, rank long, row long, cluster long, vec array<double>"


def _best_of(keep: int):
    """Of each row in a list its best clusters of another list, the smaller number among equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, numbers = batch.column(0)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                order = np.argsort(numbers)
                vecs = batch.column(3)[i].values.take(pa.array(order))
                sims = _cosines(_unit_rows(batch.column(1)[i].values), _unit_rows(vecs))
                first = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
                row = np.repeat(np.arange(len(ids)), first.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(sims[row, first.ravel()]), pa.array(numbers[order][first.ravel()]), vecs.take(pa.array(first.ravel()))], names=["row", "sim", "cluster", "vec"])

    return run


def _cos(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1)) * np.sqrt(v @ v)
    return np.clip(np.divide(m @ v, size, out=np.zeros(len(m)), where=size > 0), -1.0, 1.0)


def _replay(threshold: float, floor: float, keep: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stream, opened = int(rows["stream_id"].iloc[0]), int(rows["opened"].iloc[0])
        changed: dict[int, int] = {}  # cluster -> place in sums
        names: list[int] = []
        sums = np.empty((len(rows), len(rows["vec"].iloc[0])))
        out, stop = [], None
        for r in rows.sort_values("rank").itertuples():
            v, best = np.asarray(r.vec, float), [] if r.best is None else list(r.best)
            pick = None  # (similarity, -cluster, frozen vector)
            if names:
                sims = _cos(v, sums[: len(names)])
                top = min((k for k in np.flatnonzero(sims == sims.max())), key=lambda k: names[k])
                pick = (float(sims[top]), -names[top], None)
            still = next((b for b in best if b["cluster"] not in changed), None)
            if still is not None:
                pick = max(pick or (-2.0, 0, None), (still["sim"], -still["cluster"], still["vec"]), key=lambda p: p[:2])
            elif len(best) == keep:
                left = (best[-1]["sim"], -best[-1]["cluster"])  # all others come after this one
                if left[0] >= threshold and (pick is None or pick[:2] < left):
                    stop = r.rank
                    break
            weighted = v * max(floor, r.weight)
            if pick is not None and pick[0] > -1 and pick[0] >= threshold:
                cluster = -pick[1]
                if cluster not in changed:
                    changed[cluster] = len(names)
                    sums[len(names)] = np.asarray(pick[2], float)
                    names.append(cluster)
                sums[changed[cluster]] += weighted
            else:
                opened += 1
                cluster = opened
                changed[cluster] = len(names)
                sums[len(names)] = weighted
                names.append(cluster)
            out.append((0, stream, r.rank, r.row, cluster, None))
        out += [(1, stream, None, None, c, sums[k].tolist()) for c, k in changed.items()]
        out.append((2, stream, stop, None, opened, None))  # where the next round goes on, and the clusters so far
        return pd.DataFrame(out, columns=["kind", "stream_id", "rank", "row", "cluster", "vec"]).astype({"rank": "Int64", "row": "Int64"})

    return run


def leaders(rows: DataFrame, threshold: float, floor: float, block: int = BLOCK, keep: int = BEST) -> DataFrame:
    """rows(stream_id, rank from 1 without gaps, vec, weight) -> + cluster (from 1, in the order of opening), equal to the serial fold.

    A cluster's direction is the sum of its rows' vectors, each times its weight (``floor`` at least, which must be above 0). A task holds a block of one stream;
    there are as many epochs as the longest stream has blocks, and a further round wherever a replay stopped.
    """
    if floor <= 0:
        raise ValueError("the least weight must be above 0")
    base = rows.select(F.col("stream_id").cast("long"), F.col("rank").cast("long"), F.col("vec").cast("array<double>"), F.col("weight").cast("double"))
    base = settled(base.withColumn("row", F.monotonically_increasing_id()).withColumn("epoch", F.floor((F.col("rank") - 1) / block)))
    epochs = base.agg(F.max("epoch")).first()[0]
    done, clusters, opened = [], None, None
    for epoch in range(0 if epochs is None else epochs + 1):
        rest = base.where(F.col("epoch") == epoch)
        while True:
            now = rest
            if clusters is None:
                none = F.lit(None).cast("array<struct<sim:double,cluster:bigint,vec:array<double>>>")
                now = now.withColumn("best", none).withColumn("opened", F.lit(0).cast("long"))
            else:
                cell = F.col("stream_id").alias("cell")
                met = _meet(now.select(cell, F.col("row").alias("id"), "vec"), clusters.select(cell, F.col("cluster").alias("id"), "vec"), _best_of(keep), "row long, sim double, cluster long, vec array<double>")
                ordered = F.sort_array(F.collect_list(F.struct("sim", (-F.col("cluster")).alias("behind"), "cluster", "vec")), asc=False)
                best = met.groupBy("row").agg(F.transform(F.slice(ordered, 1, keep), lambda b: F.struct(b["sim"].alias("sim"), b["cluster"].alias("cluster"), b["vec"].alias("vec"))).alias("best"))
                now = now.join(best, "row", "left").join(opened, "stream_id", "left").withColumn("opened", F.coalesce("opened", F.lit(0).cast("long")))
            got = settled(now.select("stream_id", "rank", "row", "vec", "weight", "best", "opened").groupBy("stream_id").applyInPandas(_replay(threshold, floor, keep), _REPLAY))
            done.append(got.where("kind = 0").select("row", "cluster"))
            moved, news = got.where("kind = 1").select("stream_id", "cluster", "vec"), got.where("kind = 2")
            count = news.select("stream_id", F.col("cluster").alias("opened"))
            clusters = settled(moved if clusters is None else clusters.join(moved, ["stream_id", "cluster"], "left_anti").unionByName(moved))
            opened = settled(count if opened is None else opened.join(count, "stream_id", "left_anti").unionByName(count))
            stops = news.where("rank IS NOT NULL").select("stream_id", F.col("rank").alias("stop"))
            if stops.isEmpty():
                break
            rest = settled(rest.join(stops, "stream_id").where("rank >= stop").drop("stop"))
    if not done:
        return rows.withColumn("cluster", F.lit(None).cast("long")).limit(0)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    named = base.select("stream_id", "rank", "row").join(found, "row").select(F.col("stream_id").alias("_s"), F.col("rank").alias("_r"), "cluster")
    return rows.join(named, (F.col("stream_id") == F.col("_s")) & (F.col("rank") == F.col("_r"))).drop("_s", "_r")


def _added(a: str, b: str):
    return F.zip_with(a, b, lambda x, y: x + y)


def merged(rows: DataFrame, threshold: float, floor: float) -> DataFrame:
    """rows(stream_id, rank, vec, weight, cluster) -> + entity and place: in every stream the first pair of clusters that is close is merged, until none is.

    The loop goes over tables: cluster directions, and an index of close pairs by stream. A round merges the first pair of each
    stream that has one, so streams go on side by side; of the index only what the merged cluster takes part in is made anew.
    Clusters compare by their weighted sums until they are merged, then by the plain sum of their vectors. Entities count from 1 in the order of their clusters;
    place is a row's in its entity from 0: the rows of a cluster stay together, those of one that was merged come behind.
    """
    base = rows.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("cluster").cast("long").alias("cluster"), F.col("vec").cast("array<double>").alias("vec"), F.greatest(F.lit(floor), F.col("weight").cast("double")).alias("weight"))
    width = base.agg(F.max(F.size("vec"))).first()[0]
    if width is None:
        return rows.withColumn("entity", F.lit(None).cast("long")).withColumn("place", F.lit(None).cast("long"))
    sums = [F.sum(F.get("vec", F.lit(k))).alias(f"p{k}") for k in range(width)] + [F.sum(F.get("vec", F.lit(k)) * F.col("weight")).alias(f"w{k}") for k in range(width)]
    flat = base.groupBy("stream_id", "cluster").agg(F.count("*").alias("n"), *sums)
    state = settled(flat.select("stream_id", "cluster", "n", *(F.array(*(F.col(f"{x}{k}") for k in range(width))).alias(name) for x, name in (("p", "plain"), ("w", "vec")))))
    # one number for stream and cluster, so that one join finds the pairs of all streams; other streams' pairs are left out by the cell
    numbered = settled(state.withColumn("id", F.monotonically_increasing_id()))
    cell = F.col("stream_id").alias("cell")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                sims = _cosines(_unit_rows(batch.column(1)[i].values), _unit_rows(batch.column(3)[i].values))
                x, y = np.nonzero((sims >= threshold) & (a[:, None] != b[None]))
                yield pa.RecordBatch.from_arrays([pa.array(a[x]), pa.array(b[y])], names=["a", "b"])

    own = numbered.select(cell, "id", "vec")
    met, at = _meet(own, own, close, "a long, b long"), numbered.select("id", "stream_id", "cluster")
    pairs = met.join(at.toDF("a", "stream_id", "i"), "a").join(at.select(F.col("id").alias("b"), F.col("cluster").alias("j")), "b").where("i < j").select("stream_id", "i", "j")
    pairs, root = settled(pairs), numbered.select("stream_id", "cluster", F.col("cluster").alias("root"), F.lit(0).cast("long").alias("before"))
    while True:
        first = settled(pairs.groupBy("stream_id").agg(F.min(F.struct("i", "j")).alias("m")).select("stream_id", "m.i", "m.j"))
        if first.isEmpty():
            break
        i, j = (state.select("stream_id", F.col("cluster").alias(c), F.col("plain").alias(f"plain_{c}"), F.col("n").alias(f"n_{c}")) for c in "ij")
        joined = settled(first.join(i, ["stream_id", "i"]).join(j, ["stream_id", "j"]).select("stream_id", "i", "j", "n_i", (F.col("n_i") + F.col("n_j")).alias("n"), _added("plain_i", "plain_j").alias("plain")))
        behind = joined.select("stream_id", "i", "j", "n_i")
        moves = F.coalesce(F.col("root") == F.col("j"), F.lit(False))
        root = settled(root.join(behind, "stream_id", "left").select("stream_id", "cluster", F.when(moves, F.col("i")).otherwise(F.col("root")).alias("root"), F.when(moves, F.col("before") + F.col("n_i")).otherwise(F.col("before")).alias("before")))
        left = state.join(first, "stream_id", "left").where("i IS NULL OR (cluster <> i AND cluster <> j)").select("stream_id", "cluster", "n", "plain", "vec")
        state = settled(left.unionByName(joined.select("stream_id", F.col("i").alias("cluster"), "n", "plain", F.col("plain").alias("vec"))))
        near = state.join(joined.select("stream_id", F.col("i").alias("own"), F.col("plain").alias("new")), "stream_id").where("cluster <> own")
        dot = [F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z) for x, y in (("vec", "new"), ("vec", "vec"), ("new", "new"))]
        cosine = F.when((dot[1] <= 0) | (dot[2] <= 0), F.lit(0.0)).otherwise(dot[0] / (F.sqrt(dot[1]) * F.sqrt(dot[2])))
        fresh = near.where(cosine >= threshold).select("stream_id", F.least("cluster", "own").alias("i"), F.greatest("cluster", "own").alias("j"))
        ends = first.select("stream_id", F.col("i").alias("x"), F.col("j").alias("y"))
        old = pairs.join(ends, "stream_id", "left").where("x IS NULL OR (i <> x AND i <> y AND j <> x AND j <> y)").select("stream_id", "i", "j")
        pairs = settled(old.unionByName(fresh))
    entity = F.dense_rank().over(Window.partitionBy("stream_id").orderBy("root")).cast("long")
    names = root.select(F.col("stream_id").alias("_s"), F.col("cluster").alias("_c"), entity.alias("entity"), "before")
    own = F.row_number().over(Window.partitionBy("stream_id", "cluster").orderBy("rank")) - 1
    out = rows.join(names, (F.col("stream_id") == F.col("_s")) & (F.col("cluster") == F.col("_c")))
    return out.withColumn("place", F.col("before") + own).drop("_s", "_c", "before")
