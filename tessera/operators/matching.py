"""Similarity joins with and without keys, nearest centroid, and greedy one-to-one assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.sources.tables import settled

MAX_BROADCAST_BYTES, FEW, MAX_PIVOTS, BLOCK = 32 << 20, 500, 1024, 1000
LIST_BYTES, SPREAD, MAX_PARTS = 16 << 20, 6, 4096
_EDGE = 1e-6  # angles are compared with this much room, so rounding never hides a pair


def similarity_join(left: DataFrame, right: DataFrame, on: Sequence[str], threshold: float, left_vec: str, right_vec: str, extra=None) -> DataFrame:
    """Pairs that agree on ``on`` and whose cosine reaches the threshold. The sides' other columns must differ in name.

    Each vector is brought to unit length once, before it meets others. A key that holds much of a side is split by
    AQE's skew join, since nothing above the join needs its rows together. Without keys the pairs come from ``theta_join``.
    """
    if not on:
        a = settled(left.withColumn("_a", F.monotonically_increasing_id()))  # numbers must not change between reads
        b = settled(right.withColumn("_b", F.monotonically_increasing_id()))
        pairs = theta_join(a.select(F.col("_a").alias("id"), F.col(left_vec).alias("vec")), b.select(F.col("_b").alias("id"), F.col(right_vec).alias("vec")), threshold)
        both = a.join(pairs.withColumnRenamed("id_a", "_a"), "_a").join(b.withColumnRenamed("_b", "id_b"), "id_b").drop("_a", "id_b")
        both = both.select(*(c for c in both.columns if c != "sim"), "sim")
        return both if extra is None else both.where(extra)
    unit_l, unit_r = V.normalized_or_zero(F.col(left_vec)).alias("_l"), V.normalized_or_zero(F.col(right_vec)).alias("_r")
    both = left.select("*", unit_l).join(right.select("*", unit_r), list(on))
    both = both if extra is None else both.where(extra)
    return both.withColumn("sim", V.unit_dot(F.col("_l"), F.col("_r"))).drop("_l", "_r").where(F.col("sim") >= threshold)


def _unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without NULLs at unit length; zero vectors stay zero."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes.min() != sizes.max() or not sizes[0]):
        raise ValueError("vectors must be non-empty and of equal length")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), sizes[0] if len(sizes) else 1)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size != 0)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(x) and len(y) and x.shape[1] != y.shape[1]:
        raise ValueError("vectors must be non-empty and of equal length")
    return np.clip(x @ y.T, -1.0, 1.0) if len(x) and len(y) else np.zeros((len(x), len(y)))


def _over(x: np.ndarray, y: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of the products that reach the floor. Hits are few, so eight places are looked at in one."""
    sims = (x @ y.T).ravel()
    mask = np.zeros(-(-len(sims) // 8) * 8, bool)
    np.greater_equal(sims, floor, out=mask[: len(sims)])
    eights = np.flatnonzero(mask.view(np.uint64))
    eight, place = np.nonzero(mask.reshape(-1, 8).take(eights, axis=0))
    return np.divmod(eights[eight] * 8 + place, max(1, len(y)))


def _meet(left: DataFrame, right: DataFrame, run, schema: str, block: int = BLOCK) -> DataFrame:
    """left(cell, id, vec), right(cell, id, vec): all of a cell meet, as lists of about ``block`` rows, each pair of lists under a key of its own.

    run gets batches of (ids, vecs of a list on the left, ids, vecs of one on the right). However full a cell is, a task has two lists at a time.
    """
    n_left, n_right = (side.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name)) for side, name in ((left, "many"), (right, "other")))
    sizes = n_left.join(n_right, "cell")

    def lists(side: DataFrame, own: str, far: str, ids: str, vecs: str) -> DataFrame:
        cut = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        packed = side.join(sizes, "cell").groupBy("cell", far, cut.alias("at")).agg(F.collect_list(F.struct("id", "vec")).alias("m"))
        spread = packed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col(far) - 1)))
        a, b = ("at", "to") if own == "many" else ("to", "at")
        return spread.select("cell", F.col(a).alias("a"), F.col(b).alias("b"), F.col("m.id").alias(ids), F.col("m.vec").alias(vecs))

    both = lists(left, "many", "other", "ids_a", "vecs_a").join(lists(right, "other", "many", "ids_b", "vecs_b"), ["cell", "a", "b"])
    return both.select("ids_a", "vecs_a", "ids_b", "vecs_b").mapInArrow(run, schema)


def _pivots(rows: DataFrame) -> np.ndarray:
    """Some of the rows' unit vectors, by hash: about the square root of the rows, at most MAX_PIVOTS. They decide cost only."""
    count = rows.count()
    n = min(MAX_PIVOTS, math.isqrt(count) + 1)
    for share in (max(1, count // (8 * n)), 1):
        some = rows.where(F.pmod(F.xxhash64("vec"), F.lit(share)) == 0).select("vec").distinct().limit(n).toArrow().column("vec").combine_chunks()
        if len(some) * 2 >= n or share == 1:
            break
    units = _unit_rows(some)
    return units[(units != 0).any(1) & np.isfinite(units).all(1)] if len(units) else np.zeros((0, 1))


def _dealt(count: np.ndarray, apart: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells to groups of near cells with about ``rows`` rows each, and the number of lists a group is cut into: several only where one cell is larger."""
    group, cuts = np.full(len(count), -1), []
    for start in np.argsort(-count, kind="stable"):
        if count[start] and group[start] < 0:
            near = np.argsort(apart[start], kind="stable")
            free = np.append(start, near[(group[near] < 0) & (count[near] > 0) & (near != start)])
            total = np.cumsum(count[free])
            taken = min(len(free), int(np.searchsorted(total, rows)) + 1)
            group[free[:taken]] = len(cuts)
            cuts.append(max(1, round(total[taken - 1] / rows)))
    return group, np.array(cuts, np.int64)


def theta_join(left: DataFrame, right: DataFrame, threshold: float, ordered: bool = False, block: int = BLOCK) -> DataFrame:
    """left(id, vec), right(id, vec) -> id_a, id_b, sim: all pairs whose cosine reaches the threshold, without any key.

    Angles between vectors are a metric. Each vector lives in the cell of its nearest pivot (sampled rows); near cells are dealt into lists of at least
    ``block`` rows and at most LIST_BYTES, SPREAD lists where that gives more. A list is sent to every list of the other side that it can have a pair with,
    and two lists meet in one task: so a row is copied once a list, however many cells it can reach. There a vector is compared with the cells
    that can hold a vector within the angle of the threshold: by the triangle inequality, a cell whose pivot is no further than that angle
    plus the cell's radius, and no more than twice that angle further than the nearest pivot; a matrix product for each cell.
    ordered: only pairs of id_a < id_b; a table with itself meets every two lists once. NULL ids and vectors and those with NaN are in no pair; a zero vector's cosine is 0.
    """
    same, spark = ordered and left is right, left.sparkSession
    kind = "array<float>" if {dict(s.dtypes)["vec"] for s in (left, right)} == {"array<float>"} else "array<double>"
    clean = [s.select(F.col("id").cast("long"), F.col("vec").cast(kind)).where("id IS NOT NULL AND vec IS NOT NULL") for s in ((left,) if same else (left, right))]
    pivots = spark.sparkContext.broadcast(_pivots(clean[-1]))
    n, dim = pivots.value.shape
    wide, floor = math.acos(max(-1.0, min(1.0, threshold))), threshold if threshold > -1 else -math.inf
    prune = threshold > 0 and n > 0  # else zero vectors are in pairs with any

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit_rows(batch.column(1))
            good = np.flatnonzero(np.isfinite(x).all(1) & ((x != 0).any(1) | (threshold <= 0)))
            x = x[good]
            a = np.arccos(_cosines(x, pivots.value)) if n and len(x) else np.zeros((len(x), 1))
            cell = np.where((x != 0).any(1) & (n > 0), a.argmin(1) + 1, 0)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(good)).columns, pa.array(cell, pa.int32()), pa.array(a.min(1))], names=["id", "vec", "cell", "off"])

    housed = [settled(s.mapInArrow(home, f"id long, vec {kind}, cell int, off double")) for s in clean]
    apart = np.zeros((n + 1, n + 1))
    apart[1:, 1:] = np.arccos(_cosines(pivots.value, pivots.value))
    radius, groups, cuts = [], [], []
    most = max(1, LIST_BYTES // (dim * (4 if kind == "array<float>" else 8)))
    for side in housed:
        count, off = np.zeros(n + 1, np.int64), np.full(n + 1, -np.inf)
        for r in side.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("off")).collect():  # a row a pivot at most
            count[r["cell"]], off[r["cell"]] = r["n"], r["off"]
        group, cut = _dealt(count, apart, min(most, max(block, -(-int(count.sum()) // SPREAD))))
        radius, groups, cuts = [*radius, off], [*groups, group], [*cuts, cut]
    base = [np.cumsum(cut) - cut for cut in cuts]
    lists = [int(cut.sum()) for cut in cuts]
    meet = np.zeros((len(cuts[0]), len(cuts[-1])), bool)  # groups, a few cells each, so no more than pivots
    reach = (apart <= wide + radius[0][:, None] + radius[-1][None] + _EDGE) if prune else np.ones_like(apart, bool)
    here, there = np.nonzero(reach & (groups[0][:, None] >= 0) & (groups[-1][None] >= 0))
    meet[groups[0][here], groups[-1][there]] = True
    if same:
        meet |= meet.T

    def send(k: int, to: np.ndarray):
        far, near = (base[-1 - k], cuts[-1 - k]), (base[k], cuts[k])
        partners = [np.concatenate([np.arange(far[0][h], far[0][h] + far[1][h]) for h in np.flatnonzero(row)] or [np.zeros(0, np.int64)]) for row in to]
        shared = spark.sparkContext.broadcast((groups[k], near, np.array([len(p) for p in partners], np.int64), partners))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, (start, cut), size, lists_of = shared.value
            for batch in batches:
                g = group[batch.column(2).to_numpy()]
                at = ((batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % cut[g]
                ends = np.concatenate([[0], np.cumsum(size[g])]).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(lists_of[i] for i in g)])))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start[g] + at), others], names=["id", "vec", "cell", "mine", "others"])

        sent = housed[k].select("id", "vec", "cell").mapInArrow(run, f"id long, vec {kind}, cell int, mine long, others array<long>")
        return sent.select("id", "vec", "cell", "mine", F.explode("others").alias("other"))

    if same:  # lists a <= b meet once; side 2 is a list that meets itself
        a, b, side = F.least("mine", "other"), F.greatest("mine", "other"), F.expr("CASE WHEN mine < other THEN 0 WHEN mine > other THEN 1 ELSE 2 END")
        sent, pairs = send(0, meet).withColumns({"pair": a * lists[0] - F.expr("least(mine, other) * (least(mine, other) - 1) div 2") + b - a, "side": side}), lists[0] * (lists[0] + 1) // 2
    else:
        one = send(0, meet).withColumns({"pair": F.col("mine") * lists[1] + F.col("other"), "side": F.lit(0)})
        sent, pairs = one.unionByName(send(1, meet.T).withColumns({"pair": F.col("other") * lists[1] + F.col("mine"), "side": F.lit(1)})), lists[0] * lists[1]
    parts = max(1, min(pairs, MAX_PARTS))
    ranges = spark.sparkContext.broadcast(radius[-1])

    def products(x: np.ndarray, x_cells: np.ndarray, y: np.ndarray, y_cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of x and y, each in order of cells -> places in x and y and cosines of the pairs that reach the threshold."""
        first = np.flatnonzero(np.diff(y_cells, prepend=-1))
        if not prune:
            first = np.arange(0, len(y), BLOCK)
        last = np.append(first[1:], len(y))
        rough_x, rough_y, slack = x.astype(np.float32), y.astype(np.float32), 2 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
        for k in range(0, len(x), BLOCK):
            some = x[k : k + BLOCK]
            go = np.ones((len(some), len(first)), bool)
            if prune:
                cells = y_cells[first]
                a = np.arccos(_cosines(some, pivots.value[cells - 1]))
                near = np.arccos(np.clip((some * pivots.value[x_cells[k : k + BLOCK] - 1]).sum(1), -1.0, 1.0))
                go = (a <= wide + ranges.value[cells][None] + _EDGE) & (a - near[:, None] <= 2 * wide + _EDGE)
            whole, any_ = go.all(0), go.any(0)
            c = 0
            while c < len(first):
                d = c + 1
                if whole[c]:  # cells side by side that all rows go to are one product
                    while d < len(first) and whole[d] and last[d] - first[c] <= BLOCK:
                        d += 1
                if any_[c]:
                    mine = np.arange(len(some)) if whole[c] else np.flatnonzero(go[:, c])
                    for at in range(first[c], last[d - 1], BLOCK):
                        end = min(last[d - 1], at + BLOCK)
                        # single precision finds what can reach the threshold, double precision decides; where much can, as one product
                        i, j = _over(rough_x[k : k + BLOCK] if whole[c] else rough_x[k + mine], rough_y[at:end], floor - slack)
                        if len(i) > min(len(mine) * (end - at) // 50, 4_000_000 // x.shape[1]):
                            sims = (some[mine] @ y[at:end].T)[i, j]
                        else:
                            sims = np.einsum("ij,ij->i", some.take(mine[i], axis=0), y[at:end].take(j, axis=0))
                        hit = np.flatnonzero(sims >= floor)
                        yield k + mine[i[hit]], at + j[hit], np.clip(sims[hit], -1.0, 1.0)
                c = d

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, cell, side = (rows.column(name).to_numpy() for name in ("id", "cell", "side"))
        units = _unit_rows(rows.column("vec").combine_chunks())
        itself = side[0] == 2
        cut = 0 if itself else int(np.searchsorted(side, 1))
        end = len(ids) if itself else cut
        fresh, waiting = [], 0
        for i, j, sim in products(units[:end], cell[:end], units[cut:], cell[cut:]):
            a, b = ids[i], ids[cut + j]
            if ordered:
                keep = a != b if same and not itself else a < b
                a, b, sim = (np.minimum(a, b), np.maximum(a, b), sim) if same and not itself else (a, b, sim)
                a, b, sim = a[keep], b[keep], sim[keep]
            fresh.append((a, b, sim))
            waiting += len(a)
            if waiting >= 100_000:
                yield out(fresh)
                fresh, waiting = [], 0
        if waiting:
            yield out(fresh)

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["id_a", "id_b", "sim"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            pair = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            for at, end in zip(starts, [*starts[1:], len(pair)], strict=True):
                if held and pair[at] != now:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                now = pair[at]
                held.append(batch.slice(at, end - at))
        if held:
            yield from compare(pa.Table.from_batches(held))

    met = sent.select("pair", "side", "cell", "id", "vec").repartitionById(parts, F.pmod("pair", F.lit(parts)).cast("int")).sortWithinPartitions("pair", "side", "cell")
    return met.mapInArrow(close, "id_a long, id_b long, sim double")


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """vectors(id, vec) -> id_a < id_b, sim: all pairs whose cosine reaches the threshold. NULL ids or vectors are in no pair."""
    return theta_join(vectors, vectors, threshold, True, block)


def nearest_centroid(rows: DataFrame, centroids: DataFrame, vec: str, threshold: float | None = None) -> DataFrame:
    """Adds centroid_id and sim: the most similar centroid, the smaller id among equals; sims of -1 match none, NULL vectors neither.

    centroids(centroid_id, centroid) has one row an id; those with NULLs are left out. A few hundred are read at once; more are written and measured. Up to MAX_BROADCAST_BYTES they go to every task
    as a matrix, and a batch of rows is one matrix product, without a shuffle. Beyond that, lists of numbered rows meet lists of centroids, and each row
    keeps its best; equal rows stay apart by their number.
    """
    spark, kind = rows.sparkSession, dict(centroids.dtypes)["centroid_id"]
    known = centroids.select(F.col("centroid_id").cast("long").alias("id"), F.col("centroid").cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    few = known.limit(FEW + 1).toArrow()
    if few.num_rows > FEW:
        known = settled(known)
        few = None
    size = few.nbytes if few is not None else known.agg(F.sum(F.size("vec"))).first()[0] * 8
    floor = -1.0 if threshold is None else max(-1.0, float(np.nextafter(threshold, -2)))
    schema = T.StructType([*rows.schema.fields, T.StructField("_id", T.LongType()), T.StructField("_sim", T.DoubleType())])
    if size <= MAX_BROADCAST_BYTES:
        sorted_ = (known.toArrow() if few is None else few).sort_by("id")
        shared = spark.sparkContext.broadcast((sorted_.column("id").to_numpy(), _unit_rows(sorted_.column("vec").combine_chunks())))
        at = rows.columns.index(vec)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, units = shared.value
            for batch in batches:
                there = np.flatnonzero(batch.column(at).is_valid().to_numpy(zero_copy_only=False))
                sim, top = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, np.int64)
                if len(ids):
                    for k in range(0, len(there), 256):
                        part = there[k : k + 256]
                        sims = _cosines(_unit_rows(batch.column(at).take(pa.array(part))), units)
                        first = sims.argmax(1)  # ids ascend, so the smaller id wins among equals
                        sim[part], top[part] = sims[np.arange(len(part)), first], ids[first]
                none = np.isnan(sim)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top, mask=none), pa.array(sim, mask=none)], names=[f.name for f in schema.fields])

        found = rows.mapInArrow(best, schema)
    else:
        numbered = settled(rows.withColumn("_row", F.monotonically_increasing_id()))  # numbers must not change between reads

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, others = batch.column(0)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                    order = np.argsort(others)
                    sims = _cosines(_unit_rows(batch.column(1)[i].values), _unit_rows(batch.column(3)[i].values)[order])
                    first = sims.argmax(1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sims[np.arange(len(ids)), first]), pa.array(others[order][first])], names=["_row", "_sim", "_id"])

        one = F.lit(0).alias("cell")
        sent = numbered.select(one, F.col("_row").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
        met = _meet(sent, known.select(one, "id", "vec"), each, "_row long, _sim double, _id long")
        top = met.groupBy("_row").agg(F.max_by(F.struct("_sim", "_id"), F.struct(F.col("_sim"), -F.col("_id"))).alias("t"))
        found = numbered.join(top, "_row", "left").select(*rows.columns, F.col("t._id").alias("_id"), F.col("t._sim").alias("_sim"))
    ok = F.col("_sim") > floor
    return found.withColumn("centroid_id", F.when(ok, F.col("_id")).cast(kind)).withColumn("sim", F.when(ok, F.col("_sim"))).drop("_id", "_sim")


def greedy_assignment(edges: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """One-to-one matching inside each key: edges by falling sim (ties: left, then right), each taken if both its ends are free.

    In rounds of locally dominant edges: an edge that is first in this order at both its ends is one that greedy takes,
    whatever else there is; its ends then leave with all their edges. A round takes the first edge of every key at least,
    and of large keys many at once; a key may be of any size. Edges with a NULL key, end or sim are never taken.
    """
    first = [F.desc("sim"), F.col(left), F.col(right)]
    rest = settled(edges.dropna(subset=[*keys, left, right, "sim"]))
    taken = None
    while not rest.isEmpty():
        at_left = F.row_number().over(Window.partitionBy(*keys, left).orderBy(*first))
        at_right = F.row_number().over(Window.partitionBy(*keys, right).orderBy(*first))
        best = settled(rest.withColumn("_l", at_left).where("_l = 1").drop("_l").join(rest.withColumn("_r", at_right).where("_r = 1").select(*keys, left, right), [*keys, left, right])).select(*edges.columns)
        taken = best if taken is None else taken.unionByName(best)
        for end in (left, right):
            rest = rest.join(best.select(*keys, end), [*keys, end], "left_anti")
        rest = settled(rest.select(*edges.columns))
    return rest if taken is None else taken
