"""Nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector with ``hashes`` Gaussian projections cut into intervals of equal
probability; the directory of a table is the full grid of intervals, at most intervals^hashes
buckets. A query visits buckets in the order of their estimated success: the chance that a
neighbour lies in the bucket, a product of normal probabilities whose centre and spread were measured
on neighbours within the sample. It stops when the visited chance reaches ``success``. Candidates of all tables are
merged and ranked by their exact Euclidean distance in double precision, then by id; matrix products only
bound distances, and every candidate within their rounding error of the k-th is ranked exactly.

Interval borders and the law of neighbours come from a bounded sample of ``sample`` vectors; every
vector is indexed. Vectors of one bucket form blocks of at most about ``block`` rows, queries likewise, and
a pair of blocks is one matrix product; a task keeps the k best of its queries and hands on those
alone.

Defined results: vectors that are NULL, zero, of another length than most of the sample, or hold NULL or
non-finite components take no part, as query or candidate; ties go to the smaller id; a query with
fewer than k candidates in its buckets goes to all buckets, so it has k results or all there are; rows that
repeat both vec_id and vector count once, as candidate and as query; rows that repeat only vec_id are candidates of
their own, but never of a query with that id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

TABLES, HASHES, INTERVALS, SUCCESS, SAMPLE, BLOCK, K, SEED = 2, 6, 3, 0.86, 2000, 1024, 10, 23
HELD_QUERIES = 200_000


def usable(column: str):
    v = F.col(column)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


class Hashing:
    """Projections, interval borders and the law of neighbours' projections, fitted on a sample."""

    def __init__(self, sample: np.ndarray, total: int = 0, k: int = K, tables: int = TABLES, hashes: int = HASHES, intervals: int = INTERVALS, success: float = SUCCESS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.intervals, self.success = tables, hashes, intervals, success
        dim = sample.shape[1]
        self.planes = []
        for _ in range(tables):
            a = rng.standard_normal((dim, hashes))
            self.planes.append(np.linalg.qr(a)[0] * math.sqrt(dim) if dim >= hashes else a)
        self.cuts = [np.quantile(sample @ p, np.arange(1, intervals) / intervals, axis=0) for p in self.planes]
        self.grid = np.array(list(itertools.product(range(intervals), repeat=hashes)))
        # what a neighbour's projection is like, given the query's: mean pull * own, spread sigma
        q = sample[:: max(1, len(sample) // 500)]
        d = (q**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * q @ sample.T
        d[d <= 1e-12] = np.inf
        rank = min(max(1, round(k * len(sample) / max(total, 1))), sample.shape[0] - 1)
        near = sample[np.argsort(d, axis=1, kind="stable")[:, :rank]] if rank else q[:, None]
        self.pull, self.sigma = [], []
        for p in self.planes:
            own, other = np.repeat(q @ p, near.shape[1], 0), (near.reshape(-1, dim) @ p)
            pull = float((own * other).sum() / max((own**2).sum(), 1e-12))
            self.pull.append(pull)
            self.sigma.append(max(1e-9, float(np.sqrt(((other - pull * own) ** 2).mean()))))

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        where = (x @ self.planes[t])[:, :, None] >= self.cuts[t].T[None]
        return where.sum(2) @ (self.intervals ** np.arange(self.hashes)[::-1])

    def visits(self, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket ids by falling success, their cumulated success) per query."""
        z = (self.cuts[t].T[None] - self.pull[t] * (q @ self.planes[t])[:, :, None]) / self.sigma[t]
        cdf = 0.5 * (1 + _erf(z / math.sqrt(2)))
        p = np.diff(np.concatenate([np.zeros((*cdf.shape[:2], 1)), cdf, np.ones((*cdf.shape[:2], 1))], 2), axis=2)
        chance = np.ones((len(q), len(self.grid)))
        for j in range(self.hashes):
            chance *= p[:, j][:, self.grid[:, j]]
        order = np.argsort(-chance, axis=1, kind="stable")
        return order, np.cumsum(np.take_along_axis(chance, order, 1), 1)


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function, to 1.5e-7 (a rational approximation that is in every handbook)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - t * np.exp(-x * x) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * y


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that length, their matrix)."""
    sizes = np.diff(column.offsets.to_numpy())
    good = np.flatnonzero(sizes == dim)
    return good, column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_PACKED = "tbl int, bucket int, cut int, lists int, id long, vec binary"


def _spread(ids: np.ndarray, over) -> np.ndarray:
    return ((((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.asarray(over, np.uint64))).astype(np.int32)


def _sizes(h, dim: int):
    """Vectors of each bucket: at most tables x intervals^hashes rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((h.value.tables, len(h.value.grid)), np.int64)
        for batch in batches:
            _, x = _matrix(batch.column(1), dim)
            for t in range(h.value.tables):
                n[t] += np.bincount(h.value.buckets(x, t), minlength=n.shape[1])
        tbl, bucket = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"tbl": pa.array(tbl.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(n[tbl, bucket])})

    return run


def _index(h, dim: int, lists, dtype: str):
    """A vector goes to one of the lists of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _matrix(batch.column(1), dim)
            if not len(good):
                continue
            ids, raw = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[good], [r.tobytes() for r in x.astype(dtype)]
            for t in range(h.value.tables):
                at = h.value.buckets(x, t)
                n = lists.value[t][at]
                yield pa.RecordBatch.from_pydict({"tbl": pa.array(np.full(len(ids), t, np.int32)), "bucket": pa.array(at.astype(np.int32)), "cut": pa.array(_spread(ids, n)), "lists": pa.array(n), "id": pa.array(ids), "vec": pa.array(raw, pa.binary())})

    return run


def _queries(h, dim: int, cuts: int, lists, dtype: str):
    """A query goes to each bucket that it visits and that has vectors; ``cut`` spreads a bucket's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _matrix(batch.column(1), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(good), 64):
                q = x[a : a + 64]
                for t in range(h.value.tables):
                    order, reached = h.value.visits(q, t)
                    n = np.minimum((reached < h.value.success).sum(1) + 1, order.shape[1])
                    who = np.repeat(np.arange(len(q)), n)
                    bucket = np.concatenate([order[i, : n[i]] for i in range(len(q))])
                    there = lists.value[t][bucket] > 0
                    who, bucket = who[there], bucket[there]
                    mine = ids[good[a : a + 64]]
                    raw = np.array([r.tobytes() for r in q.astype(dtype)] + [None], dtype=object)
                    yield pa.RecordBatch.from_pydict({"tbl": pa.array(np.full(len(who), t, np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "cut": pa.array(_spread(mine, cuts)[who]), "lists": pa.array(lists.value[t][bucket]), "id": pa.array(mine[who]), "vec": pa.array(list(raw[who]), pa.binary())})

    return run


def _rank(k: int, dtype: str):
    """Block pairs -> (query_id, vec_id, score): the k best of each query in the task."""

    def best(q: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        q, v, d = q[fresh], v[fresh], d[fresh]
        first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
        return q[rank < k], v[rank < k], d[rank < k]

    def distinct(ids: np.ndarray, raw: list[bytes]) -> list[int]:
        """Of equal vectors, the k + 1 smallest ids, each once: no other can be among the k best of a query."""
        seen, some = {}, []
        for j in np.argsort(ids, kind="stable").tolist():
            mine = seen.setdefault(raw[j], [])
            if len(mine) <= k and (not mine or mine[-1] != ids[j]):
                mine.append(ids[j])
                some.append(j)
        return some

    def closest(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query in a block, ids ascending. The product only bounds the distances; they come from the difference."""
        size, twice = (q**2).sum(1)[:, None] + (v**2).sum(1)[None], 2 * q @ v.T
        # rounding moves product and difference by less than this part of q^2 + v^2
        slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps
        other = q_ids[:, None] != v_ids[None]
        upper = np.where(other, size * (1 + slack) - twice, np.inf)
        first = np.flatnonzero(np.concatenate([[True], v_ids[1:] != v_ids[:-1]]))
        if len(first) < len(v_ids):  # rows that repeat an id may collapse to one result
            upper = np.minimum.reduceat(upper, first, axis=1)
        keep = other
        if k < upper.shape[1]:
            keep = other & ~(size * (1 - slack) - twice > np.partition(upper, k - 1, axis=1)[:, k - 1 : k])
        at_q, at_v = np.nonzero(keep)
        step = max(1, 4_000_000 // q.shape[1])
        exact = [np.sqrt(((v[at_v[a : a + step]] - q[at_q[a : a + step]]) ** 2).sum(1)) for a in range(0, len(at_q), step)]
        return best(q_ids[at_q], v_ids[at_v], np.concatenate([np.empty(0), *exact]))

    def out(held):
        return pa.RecordBatch.from_pydict({"query_id": pa.array(held[0]), "vec_id": pa.array(held[1]), "score": pa.array(held[2])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        held, fresh, waiting = none, [none], 0
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qv, vi, vv = (batch.column(j)[i] for j in range(4))
                q_ids, v_ids = qi.values.to_numpy().astype(np.int64), vi.values.to_numpy().astype(np.int64)
                q = np.frombuffer(b"".join(qv.as_py()), dtype).astype(np.float64).reshape(len(q_ids), -1)
                raw = vv.as_py()
                some = distinct(v_ids, raw)
                v_ids, v = v_ids[some], np.frombuffer(b"".join([raw[j] for j in some]), dtype).astype(np.float64).reshape(len(some), -1)
                q_ids, v_ids, exact = closest(q_ids, q, v_ids, v)
                fresh.append((q_ids, v_ids, exact))
                waiting += len(fresh[-1][0])
                if waiting > 500_000:
                    held, fresh, waiting = best(*(np.concatenate(c) for c in zip(held, *fresh, strict=True))), [none], 0
                    if len(held[0]) > HELD_QUERIES * k:
                        yield out(held)
                        held = none
        held = best(*(np.concatenate(c) for c in zip(held, *fresh, strict=True)))
        if len(held[0]):
            yield out(held)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, block: int = BLOCK, **parameters) -> DataFrame:
    """vectors(id, vec), queries(id, vec) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).where(usable("vec") & F.col("id").isNotNull())
    asked = queries.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).where(usable("vec") & F.col("id").isNotNull())
    total = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, total // sample))) == 0).select("vec").limit(2 * sample).collect() if total else []
    if not chosen:
        chosen = rows.select("vec").limit(sample).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not chosen:
        return empty
    dim = Counter(len(r["vec"]) for r in chosen).most_common(1)[0][0]
    fitted = Hashing(np.array([r["vec"] for r in chosen if len(r["vec"]) == dim]), total, k, **parameters)
    h = spark.sparkContext.broadcast(fitted)
    dtype = "<f4" if vectors.select("vec").dtypes[0][1] == queries.select("vec").dtypes[0][1] == "array<float>" else "<f8"
    lists = [np.zeros(len(fitted.grid), np.int32) for _ in range(fitted.tables)]
    for tbl, bucket, n in rows.mapInArrow(_sizes(h, dim), "tbl int, bucket int, n long").groupBy("tbl", "bucket").agg(F.sum("n")).collect():  # the directory: its size is fixed
        lists[tbl][bucket] = math.ceil(n / block)
    shared = spark.sparkContext.broadcast(lists)
    right = rows.mapInArrow(_index(h, dim, shared, dtype), _PACKED)
    right = right.groupBy("tbl", "bucket", "cut").agg(F.collect_list(F.struct("id", "vec")).alias("m")).select("tbl", "bucket", "cut", F.col("m.id").alias("vi"), F.col("m.vec").alias("vv"))
    merged = F.array_sort(F.collect_list(F.struct("score", "vec_id")))

    def search(asked: DataFrame, visited) -> DataFrame:
        cuts = max(1, math.ceil(asked.count() / 256))
        left = asked.mapInArrow(_queries(visited, dim, cuts, shared, dtype), _PACKED)
        left = left.groupBy("tbl", "bucket", "cut").agg(F.collect_list(F.struct("id", "vec")).alias("m"), F.first("lists").alias("lists"))
        # each list of queries meets each list of the bucket under a key of its own, so a crowded bucket is many keys
        left = left.select("tbl", "bucket", F.col("m.id").alias("qi"), F.col("m.vec").alias("qv"), F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("cut"))
        # a query gives many probes, which size estimates do not see, so broadcasting is ruled out
        met = left.hint("merge").join(right.hint("merge"), ["tbl", "bucket", "cut"]).select("qi", "qv", "vi", "vv").mapInArrow(_rank(k, dtype), "query_id long, vec_id long, score double")
        return met.groupBy("query_id", "vec_id", "score").agg(F.count("*").alias("seen")).groupBy("query_id").agg(F.slice(merged, 1, k).alias("best"))

    found = stored(search(asked, h), "ann-found")
    if total > k:  # a query whose buckets gave fewer than k goes to all buckets of one table
        short = stored(asked.join(found.where(F.size("best") >= k).select(F.col("query_id").alias("id")), "id", "left_anti"), "ann-short")
        if not short.isEmpty():
            whole = copy.copy(fitted)
            whole.success, whole.tables = math.inf, 1
            found = found.where(F.size("best") >= k).unionByName(search(short, spark.sparkContext.broadcast(whole)))
    return found.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "ann-vectors")
    return nearest(rows, rows.where("id % 100 = 0"))
