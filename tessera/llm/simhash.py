"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is the bitwise majority of the XXH64 of a text's shingles. Two fingerprints within
``radius`` bits are linked, and components of links are the groups.

Search: the 64 bits are grouped so that correlated bits share a part. If the thresholds of the
``parts`` parts add up to radius - parts + 1, two fingerprints within the radius agree within the
threshold in at least one part (a threshold of -1 skips a part). Each fingerprint therefore probes
with thresholds of its own, chosen by dynamic programming over the expected candidates in each
part, which come from the exact counts of part values (a table of at most parts x 2^width
entries). Distinct fingerprints only are searched. Those with one part value form blocks of at most
``block`` members; a pair of blocks is compared bit for bit at once in numpy and gives a spanning
forest of its links, not its pairs, so a crowded value adds no more rows than it has members.

Components come from alternating large-star and small-star steps with a written table each.

Defined results: NULL text counts as empty; texts without words have fingerprint 0 and are linked
like any other; rows with equal doc_id or equal text all stay; NULL doc_ids get a component but
name none while another member has an id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table, tidy

RADIUS, PARTS, WIDER, BLOCK, SHINGLE, SEED = 3, 4, 30_000_000, 512, 3, 42
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SLICE = 1 << 17


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def fingerprint(text: str, shingle: int = SHINGLE, word: re.Pattern = _WORD) -> int:
    """Bitwise majority of the XXH64 of the shingles of one text, repeats included; 0 without words."""
    words = word.findall(lower_ascii(text))
    if not words:
        return 0
    n, ones, digest = max(1, len(words) - shingle + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, _SLICE):
        b = min(n, a + _SLICE)
        runs = zip(*(words[a + k : b + k] for k in range(shingle)), strict=True) if len(words) >= shingle else [words]
        hashes = np.fromiter((digest(" ".join(r).encode("utf-8", "surrogatepass"), SEED) for r in runs), np.uint64, b - a)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, word: str = _WORD.pattern) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    pattern = re.compile(word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t or "", shingle, pattern) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def bit_groups(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Parts of bit positions: each part grows by the bit most correlated with it. Reads 64 x 64 counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(raw), 65_536):
                bits = np.unpackbits(raw[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                both += bits.T @ bits
                n += len(bits)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(4097), pa.int32()), "n": pa.array([*both.ravel(), float(n)], pa.float64())})

    got = dict(fps.select("fp").mapInArrow(tidy(count), "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect())
    if not got:
        return [list(range(64 * i // parts, 64 * (i + 1) // parts)) for i in range(parts)]
    joint = np.array([got[i] for i in range(4096)]).reshape(64, 64) / got[4096]
    mean = np.diag(joint)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((joint - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(64)), []
    for i in range(parts):
        size = 64 * (i + 1) // parts - 64 * i // parts
        group = [max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: tie[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def part_value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _value_column(bits: list[int]) -> Column:
    out = F.lit(0).cast("int")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright("fp", b).bitwiseAND(F.lit(1)).cast("int"), k))
    return out


def _masks(width: int, radius: int) -> list[np.ndarray]:
    """By distance: the patterns that flip so many bits of a part."""
    out = [np.zeros(1, np.int64)]
    for _ in range(radius):
        wider = np.unique((out[-1][:, None] ^ (1 << np.arange(width))[None]).ravel())
        seen = np.concatenate(out)
        out.append(np.setdiff1d(wider, seen))
    return out


def allocations(counts: list[np.ndarray], radius: int) -> list[np.ndarray]:
    """Per part, a table threshold+1 x value of expected candidates; a threshold also costs its probes."""
    tables = []
    for freq in counts:
        width = int(np.log2(len(freq)))
        rows, total, probes = [np.zeros(len(freq))], np.zeros(len(freq)), 0
        at = np.arange(len(freq))
        for masks in _masks(width, min(2, radius)):
            for m in masks:
                total = total + freq[at ^ m]
            probes += len(masks)
            rows.append(total + 4.0 * probes)
        tables.append(np.stack(rows).astype(np.float32))
    return tables


def allocate(tables: list[np.ndarray], values: list[np.ndarray], radius: int) -> np.ndarray:
    """Thresholds (parts x n), at least -1 each, adding up to radius - parts + 1, of least expected cost."""
    parts, n = len(tables), len(values[0])
    budget = radius + 1  # spent in steps of threshold + 1, so they add up to this
    cost, picks = np.full((budget + 1, n), np.inf, np.float32), []
    cost[0] = 0
    for i in range(parts):
        step = [tables[i][t][values[i]] for t in range(len(tables[i]))]
        options = np.full((budget + 1, len(step), n), np.inf, np.float32)
        for spent in range(budget + 1):
            for t in range(min(spent, len(step) - 1) + 1):
                options[spent, t] = cost[spent - t] + step[t]
        picks.append(options.argmin(1))
        cost = options.min(1)
    out, left = np.empty((parts, n), np.int64), np.full(n, budget)
    for i in reversed(range(parts)):
        t = picks[i][left, np.arange(n)]
        out[i], left = t - 1, left - t
    return out


def _rows(groups: list[list[int]], counts, radius: int, block: int, probing: bool):
    """fp -> (fp, part, own, value, cut, lists): its own part values, or the values that it probes.

    cut spreads the fingerprints of one own value over lists of about ``block`` members; ``lists`` says
    how many of them the value has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = allocations(counts.value, radius) if probing else None
        lists = [np.ceil(c / block).astype(np.int32) for c in counts.value]
        masks = [_masks(len(g), 2) for g in groups]
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fps = raw.view(np.uint64)
            values = [part_value(fps, g) for g in groups]
            chosen = allocate(tables, values, radius) if probing else np.zeros((len(groups), len(raw)), np.int64)
            mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for i, at in enumerate(values):
                cut = (mixed % np.maximum(1, lists[i][at]).astype(np.uint64)).astype(np.int32)
                for t in range(3):
                    probing_at = np.flatnonzero(chosen[i] >= t)
                    for m in masks[i][t] if len(probing_at) else ():
                        who = probing_at[lists[i][at[probing_at] ^ m] > 0]  # a value that no fingerprint has needs no probe
                        if len(who):
                            yield pa.RecordBatch.from_pydict({"fp": pa.array(raw[who]), "part": pa.array(np.full(len(who), i, np.int32)), "own": pa.array(at[who].astype(np.int32)), "value": pa.array((at[who] ^ m).astype(np.int32)), "cut": pa.array(cut[who]), "lists": pa.array(lists[i][at[who] ^ m])})

    return run


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(accept: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(0), batch.column(1)
            sizes = [np.diff(c.offsets.to_numpy()) for c in (left, right)]
            flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (left, right)]
            starts = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
            pairs = sizes[0].astype(np.int64) * sizes[1]
            out_a, out_b, out_d, k = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)], 0
            while k < batch.num_rows:
                # rows k..end together give at most a few million comparisons
                end = k + max(1, int(np.searchsorted(np.cumsum(pairs[k:]), 1_500_000, side="right")))
                reps = np.repeat(sizes[1][k:end], sizes[0][k:end])
                a = np.repeat(flat[0][starts[0][k] : starts[0][end]], reps)
                first = np.repeat(np.repeat(starts[1][k:end], sizes[0][k:end]), reps)
                b = flat[1][first + np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps)]
                apart = np.bitwise_count((a ^ b).view(np.uint64))
                near = (apart <= accept) & (a != b)
                out_a.append(a[near])
                out_b.append(b[near])
                out_d.append(apart[near])
                k = end
            a, b, d = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_d)
            nearest = np.argsort(d, kind="stable")  # the forest keeps the closest links
            a, b, d = a[nearest], b[nearest], d[nearest]
            nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest = Forest(len(nodes))
            ids_a, ids_b = ids[: len(a)].tolist(), ids[len(a) :].tolist()
            kept = [i for i, (x, y) in enumerate(zip(ids_a, ids_b, strict=True)) if forest.join(x, y)]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[kept], pa.int64()), "b": pa.array(b[kept], pa.int64()), "apart": pa.array(d[kept].astype(np.int32))})

    return compare


def links(distinct: DataFrame, radius: int = RADIUS, parts: int | None = None, block: int = BLOCK, accept: int | None = None) -> DataFrame:
    """a < b, apart: links that connect everything within ``radius``, each once. ``distinct``: one row per fp.

    ``accept`` over ``radius`` also keeps wider pairs among the candidates; those are not guaranteed. Without
    ``parts`` there are four, of 16 bits, up to ``WIDER`` fingerprints, and beyond that three, of 21 or 22 bits.
    """
    spark = distinct.sparkSession
    if parts is None:
        parts = PARTS if distinct.count() <= WIDER else 3
    if radius > 3 * parts - 1:
        raise ValueError(f"{parts} parts with thresholds of at most 2 can't cover a radius of {radius}")
    groups = bit_groups(distinct, parts)
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _value_column(g).alias("value")) for i, g in enumerate(groups)])).alias("k")
    sized = distinct.select(own).select("k.part", "k.value").groupBy("part", "value").agg(F.count("*").alias("n"))
    counts = [np.zeros(1 << len(g), np.float32) for g in groups]
    for part, value, n in sized.toPandas().itertuples(index=False):  # at most parts x 2^(64 / parts) rows
        counts[part][value] = n
    bc = spark.sparkContext.broadcast(counts)

    spread = distinct.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")

    def blocks(name: str, probing: bool) -> DataFrame:
        rows = spread.mapInArrow(tidy(_rows(groups, bc, radius, block, probing)), "fp long, part int, own int, value int, cut int, lists int")
        return rows.groupBy("part", "value", "own", "cut").agg(F.collect_list("fp").alias(name), F.first("lists").alias("lists"))

    # each list of probes meets each list of the value under a key of its own, so a crowded value is many keys
    left = blocks("left", True).select("part", "value", "left", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("cut"))
    right = blocks("right", False).select("part", "value", "cut", "right")
    # a row gives many probes, which size estimates do not see, so broadcasting is ruled out
    met = left.hint("merge").join(right.hint("merge"), ["part", "value", "cut"])
    met = met.where((F.size("left") > 1) | (F.size("right") > 1) | (F.col("left")[0] != F.col("right")[0]))
    found = met.select("left", "right").mapInArrow(tidy(_links(radius if accept is None else accept)), "a long, b long, apart int")
    # a crowded part value meets in many block pairs, and each of them may give the same link either way round
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has an edge."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = stored(small, "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, parts: int | None = None, shingle: int = SHINGLE, word: str = _WORD.pattern, least: float | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row. With ``least``, links are all pairs of that Jaccard similarity, and fp stands for the shingle set."""
    if least is not None:
        from tessera.llm import jaccard

        named = jaccard.similar(docs, least, shingle, word, radius, parts)
        first = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return named.join(first, "root").select("doc_id", "fp", "component_id")
    fps = stored(fingerprints(docs, shingle, word), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    edges = stored(links(distinct.select("fp"), radius, parts).select("a", "b"), "simhash-links")
    member = components(edges)
    named = distinct.join(member, distinct.fp == member.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-roots")
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = named.select(F.col("fp").alias("of"), F.col("root").alias("r")).join(first, F.col("r") == F.col("root")).select("of", "component_id")
    return fps.join(ids, fps.fp == ids.of).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
