"""Near-duplicates by the similarity of shingle sets: SimHash groups most copies, an exact join finds the rest.

A 64-bit SimHash can't decide a Jaccard similarity of ``least`` = 0.8: such pairs differ by about 10 bits, with a
spread of 3, so no radius that is worth searching finds all of them. Two searches therefore follow each other,
and both hand their pairs to the same check of the sets:

1. SimHash by the generalised pigeonhole principle (``simhash.links``) over the distinct sets, with wide links kept.
   It joins copies and crowded families of near copies by few links each.
2. The pairs that are not in one group yet, by prefixes: two sets of similarity ``least`` share an element
   among the first n - ceil(least n) + 1 of each, in any order common to all sets. The order puts shingles that are
   frequent in a part of the rows last, so the prefixes hold rare ones; it decides cost only. Pairs that meet are cut
   by bounds that no similar pair breaks: sizes, positions, and the bits in which two parity sketches differ.
   Of what is left each set is first compared with its least partner, then all pairs of groups that still differ.

The second search is complete by itself, so what the first one misses or leaves out of its forest is not lost.
Shingles and sets are told apart by 64-bit hashes. NULL text counts as empty; texts without words share one set.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import discard, small_batches, stored, tidy
from tessera.llm.simhash import _WORD, components, lower_ascii

PART, FREQUENT, ORDERED, SLICE, CHUNK, WORDS_HELD, BATCH, ACCEPT = 16, 3, 1_000_000, 2048, 200_000, 150_000, 1000, 14
SKETCH_BITS, FILTER_BITS = 2048, 1 << 27
_SKETCH = ("s0", "s1", "s2", "s3")
_SETS = "doc_id long, th long, row long, fp long, sim long, n int, s0 long, s1 long, s2 long, s3 long, sketch binary, prefix binary"
_POSTINGS = "token long, fp long, n int, pos int"


class _Words(dict):
    """Word -> 64-bit hash, as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int, word: re.Pattern) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending. A shingle's hash chains those of its words."""
    words = word.findall(lower_ascii(text or ""))
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), len(words))], np.uint64)
    if len(_WORDS) > WORDS_HELD:
        _WORDS.clear()
    each = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    h = each[:n].copy()
    for k in range(1, shingle):
        h = _mix(h) + each[k : k + n]
    return np.unique(_mix(h))


def _majority(tokens: np.ndarray) -> np.uint64:
    """SimHash of a set: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(tokens), 1 << 16):
        ones += np.unpackbits(tokens[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(tokens), bitorder="little").view(np.uint64)[0]


def _parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` places get an odd number of tokens. Sketches differ in at most as many bits as sets in elements."""
    return np.packbits((np.bincount((tokens >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8))


def _sets(shingle: int, pattern: str, order, least: float):
    word = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [shingle_set(t, shingle, word) for t in part.column(3).to_pylist()]
                small = np.stack([_parity(s, 256).view(np.int64) for s in sets])
                fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                sims = np.array([_majority(s) for s in sets], np.uint64).view(np.int64)
                columns = [*part.columns[:3], pa.array(fps), pa.array(sims), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(np.ascontiguousarray(small[:, k])) for k in range(4))]
                columns += [pa.array([_parity(s, SKETCH_BITS).tobytes() for s in sets], pa.binary()), pa.array([_prefix(s.view(np.int64), order.value, least).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SETS.split(", ")])

    return run


def _prefix(tokens: np.ndarray, order: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first n - ceil(least n) + 1 tokens, in the order of their known frequency, then of their value."""
    known, freq = order
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        tokens = tokens[np.lexsort((tokens, np.where(known[at] == tokens, freq[at], 0)))]
    return tokens[: len(tokens) - math.ceil(least * len(tokens) - 1e-9) + 1]


def _counts(shingle: int, pattern: str):
    word = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle, word) for t in batch.column(0).to_pylist()]
            tokens, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens), "n": pa.array(n.astype(np.int64))})

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).to_pylist()
        sizes = np.array([len(r) // 8 for r in raw], np.int64)
        who = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fps, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(fps[who]), pa.array(n[who]), pa.array(pos.astype(np.int32))], names=["token", "fp", "n", "pos"])


def _tokens(shingle: int, pattern: str, wanted):
    """Rows (row, text) that pass the filter -> (fp, tokens)."""
    word = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & (64 * len(bits) - 1)
            some = np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            texts = batch.column(1).take(pa.array(some))
            for k in range(0, len(some), 500):
                raw = [shingle_set(t, shingle, word).tobytes() for t in texts.slice(k, 500).to_pylist()]
                yield pa.RecordBatch.from_pydict({"fp": pa.array(np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)), "tokens": pa.array(raw, pa.binary())})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by token and fp, each once, less those whose token has one set only."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if held is not None:
            now = [np.concatenate(c) for c in zip(held, now, strict=True)]
        tail = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
        held = [c[tail:] for c in now]
        if tail:
            yield _several([c[:tail] for c in now])
    if held is not None:
        yield _several(held)


def _several(rows: list[np.ndarray]) -> pa.RecordBatch:
    fresh = np.ones(len(rows[0]), bool)
    fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    rows = [c[fresh] for c in rows]
    same = rows[0][1:] == rows[0][:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], names=["token", "fp", "n", "pos"])


def _pairs(least: float):
    """Lists of sets that meet in a token -> a < b: all of different roots within the bounds of size, position and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = [], 0
        for batch in batches:
            lists = batch.column(0)
            at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))  # whose member a row is
            members, across = lists.flatten(), batch.column(1).to_numpy(zero_copy_only=False)[at]
            fp, n, pos, root, cut, *sketch = (members.field(k).to_numpy(zero_copy_only=False) for k in range(9))
            order = np.lexsort((fp, n, at))
            at, across, fp, root, cut = at[order], across[order], fp[order], root[order], cut[order]
            n, pos, sketch = n[order].astype(np.int64), pos[order].astype(np.int64), np.stack(sketch, 1)[order].view(np.uint64)
            # partners follow in the same list, up to the largest size that can be similar
            place = at.astype(np.int64) << 32
            reach = np.searchsorted(place + n, place + np.floor(n / least + 1e-9).astype(np.int64), side="right") - np.arange(len(fp)) - 1
            ends = np.cumsum(reach)
            a = 0
            while a < len(fp):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
                reps = reach[a:z]
                x = np.repeat(np.arange(a, z), reps)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(reps) - reps, reps)
                a = z
                good = (root[x] != root[y]) & (~across[x] | (cut[x] != cut[y]))
                x, y = x[good], y[good]
                both = n[x] + n[y]
                good = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least / (1 + least) * both - 1e-9
                good[good] = np.bitwise_count(sketch[x[good]] ^ sketch[y[good]]).sum(1, dtype=np.int64) <= (1 - least) / (1 + least) * both[good] + 1e-9
                x, y = fp[x[good]], fp[y[good]]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                waiting += len(x)
                if waiting > CHUNK:
                    yield table(out)
                    out, waiting = [], 0
        if waiting:
            yield table(out)

    def table(out: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(least: float):
    """Pairs with sizes and wide sketches -> those whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (3, 4))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            good = apart <= (1 - least) / (1 + least) * batch.column(2).to_numpy(zero_copy_only=False) + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return run


def _bits(rows: DataFrame) -> np.ndarray:
    """A filter of row keys, at most ``FILTER_BITS`` wide: beyond that it lets more rows through, never fewer."""
    size = 1 << 12
    while size < min(FILTER_BITS, 16 * rows.count()):
        size *= 2
    at = F.col("row").bitwiseAND(F.lit(size - 1))
    one = F.expr("shiftleft(1L, cast(row & 63 AS INT))")
    got = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


class _Check:
    """Decides candidate pairs of sets, first by sketches, then by the sets, which are cut anew from the texts of the pairs alone."""

    def __init__(self, docs: DataFrame, known: DataFrame, least: float, shingle: int, word: str):
        self.docs, self.known, self.least, self.shingle, self.word = docs, known, least, shingle, word

    def near(self, pairs: DataFrame) -> DataFrame:
        k = self.known.select("fp", "n", "sketch")
        both = pairs.distinct().join(k.toDF("a", "na", "x"), "a").join(k.toDF("b", "nb", "y"), "b")
        return stored(both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y").mapInArrow(tidy(_near(self.least)), "a long, b long"), "jaccard-near")

    def links(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        rows = stored(self.known.select("fp", "row").join(ends, "fp", "left_semi"), "jaccard-ends")
        wanted = self.docs.sparkSession.sparkContext.broadcast(_bits(rows))
        tokens = self.docs.select(_row_key(), "text").mapInArrow(tidy(_tokens(self.shingle, self.word, wanted)), "fp long, tokens binary")
        tokens = stored(tokens.join(rows.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "jaccard-tokens")
        links = stored(pairs.join(tokens.toDF("a", "x"), "a").join(tokens.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(tidy(_similar(self.least)), "a long, b long"), "jaccard-links")
        discard(rows, tokens)
        return links


def _row_key():
    return F.xxhash64("doc_id", "text").alias("row")


def similar(docs: DataFrame, least: float, shingle: int, word: str = _WORD.pattern, radius: int = simhash.RADIUS, parts: int | None = None, accept: int = ACCEPT) -> DataFrame:
    """doc_id, th (hash of the text), fp (hash of its shingle set), root (the group) for every row."""
    with small_batches(docs.sparkSession, BATCH):
        return _similar_rows(docs, least, shingle, word, radius, parts, accept)


def _similar_rows(docs: DataFrame, least: float, shingle: int, word: str, radius: int, parts: int | None, accept: int) -> DataFrame:
    spark = docs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).select("text").mapInArrow(tidy(_counts(shingle, word)), "token long, n long")
    often = part.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(ORDERED).toArrow()
    token, freq = (often.column(k).to_numpy() for k in ("token", "n"))
    by = np.argsort(token)
    order = spark.sparkContext.broadcast((token[by], freq[by]))
    sets = stored(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), _row_key(), "text").mapInArrow(tidy(_sets(shingle, word, order, least)), _SETS), "jaccard-sets")
    once = sets.groupBy("fp").agg(*[F.min(c).alias(c) for c in ("row", "sim", "n", *_SKETCH)])
    known = stored(once.join(sets.select("row", "sketch").dropDuplicates(["row"]), "row"), "jaccard-known")
    check = _Check(docs, known, least, shingle, word)

    # 1. SimHash: links of fingerprints, and of the sets that share one, stand for pairs of sets
    first = stored(known.groupBy("sim").agg(F.min("fp").alias("rep")), "jaccard-sims")
    met = simhash.links(first.select(F.col("sim").alias("fp")), radius, parts, accept=accept)
    apart = met.join(first.toDF("a", "ra"), "a").join(first.toDF("b", "rb"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    same = known.join(first, "sim").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    member = stored(components(check.links(check.near(apart.union(same)))), "jaccard-member")

    # 2. prefixes, for the pairs that these groups don't hold
    postings = sets.select("fp", "prefix", "n").mapInArrow(tidy(_postings), _POSTINGS)
    live = stored(postings.repartition(wide, "token").sortWithinPartitions("token", "fp").mapInArrow(tidy(_shared), _POSTINGS), "jaccard-postings")
    # a crowded token is dealt in blocks, and each pair of its blocks is a list of its own
    crowded = live.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > SLICE).select(F.col("token").alias("hot"), F.ceil(F.col("c") / SLICE).cast("int").alias("cuts"))
    rows = live.join(member, live.fp == member.node, "left").join(known.select(F.col("fp").alias("of"), *_SKETCH), F.col("fp") == F.col("of"))
    rows = rows.join(crowded, F.col("token") == F.col("hot"), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    lists = rows.groupBy("token", F.least("cut", "other").alias("low"), F.greatest("cut", "other").alias("high")).agg(F.collect_list(F.struct("fp", "n", "pos", F.coalesce("root", "fp").alias("root"), "cut", *_SKETCH)).alias("m"))
    lists = lists.where(F.size("m") > 1).select("m", (F.col("low") < F.col("high")).alias("across"))
    pairs = check.near(lists.mapInArrow(tidy(_pairs(least)), "a long, b long"))
    # each set with its least partner first: that joins most of a crowded family, and only pairs of different groups are left
    least_of = pairs.groupBy("a").agg(F.min("b").alias("b")).union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct()
    member = stored(components(check.links(stored(least_of, "jaccard-least")).union(member.toDF("a", "b"))), "jaccard-member")
    at = member.toDF("of", "root")
    rest = pairs.join(at.toDF("a", "ra"), "a", "left").join(at.toDF("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest = stored(rest, "jaccard-rest")
    if not rest.isEmpty():
        member = stored(components(check.links(rest).union(member.toDF("a", "b"))), "jaccard-member")
    out = stored(sets.select("doc_id", "th", "fp").join(member, F.col("fp") == F.col("node"), "left").select("doc_id", "th", "fp", F.coalesce("root", "fp").alias("root")), "jaccard-roots")
    discard(sets, known, first, live, pairs, rest)
    return out
