"""Collocations: phrases whose words stand together more often than their parts stand apart.

Counting goes by length. Words are counted first, then pairs of words that are each frequent, then runs of three and four
words whose pairs are all frequent: a phrase is never more frequent than what it holds. What is frequent reaches
the tasks as a bit filter of bounded size, which may let too much through, never too little; counts are exact sums and only they decide.

The frequent phrases of all lengths then form two streams of counts, one in prefix order (by first word, then second, ...) and one
in suffix order (by last word, then the one before, ...). In prefix order a phrase's beginnings are the last shorter
phrases before it, and its extensions by a word on the right come right after it; in suffix order the same holds for its
ends and extensions on the left. So one pass over each stream with a stack of open phrases reads all lengths in lockstep and gives
counts of left parts, right parts and extensions without a lookup. Streams are cut by range, also inside a word's phrases: a
part starts with the (at most three) beginnings of its first phrase, and what a part finds for a phrase of an earlier one is merged.

A longer candidate that holds a phrase holds a one-word extension of it, which is a candidate of at least its count; so
extensions by one word decide what is dropped.

Defined results: NULL and empty texts have no words; the NULL language is ``und``; equal rows count each; an empty table, or one
without frequent phrases, gives no rows; further columns are ignored. Whole texts are read, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, slices, stored, table, within

LONGEST, LEAST, KEPT, SCALE = 4, 30, 2000, 2_000_000
SLICE_BYTES = 8 << 20
# fixed values: bytes that end a piece, and those that part words
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACES)], _KIND[list(_BREAKS)] = 1, 2


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts: (code of each, the words by code, piece of each, text of each). Letters A-Z are lowered."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].tobytes().lower()  # of bytes, lower() changes A-Z only
    raw, offsets = np.frombuffer(data, np.uint8), offsets - offsets[0]
    kind = _KIND[raw]
    inside = kind == 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edge] = inside[edge]  # a word never goes on into the next text
    at = np.flatnonzero(start)
    ends = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, np.count_nonzero(inside)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    text = np.searchsorted(offsets, at, "right") - 1
    return coded.indices.to_numpy(), coded.dictionary, np.cumsum(kind == 2, dtype=np.int32)[at] + text, text


class _Slice:
    """The words of some texts, coded by language and word."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        code, self.words, self.piece, text = _words(batch.column(1))
        self.langs, wide = langs.dictionary, max(1, len(self.words))
        both = langs.indices.to_numpy()[text].astype(np.int64) * wide + code
        known, self.code, self.count = np.unique(both, return_inverse=True, return_counts=True)
        self.lang, self.word = known // wide, known % wide  # of each code

    def rows(self, lang: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(lang)), phrase.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    def hashes(self) -> np.ndarray:
        """xxhash64(lang, word) of each code, as Spark computes it."""
        seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs.to_pylist()]
        own = [xxhash.xxh64_intdigest(w, seeds[k]) for k, w in zip(self.lang.tolist(), self.words.take(pa.array(self.word)).to_pylist(), strict=True)]
        return np.array(own, np.uint64)


def _spelled(*words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of slices, and (lang, NULL, n) for all words of a language."""
    for batch in batches:
        for some in slices(batch, 1, SLICE_BYTES):
            s = _Slice(some)
            yield s.rows(s.lang, s.words.take(pa.array(s.word)), s.count)
            lang, all_of = np.unique(s.lang, return_inverse=True)
            total = np.bincount(all_of, s.count, len(lang)).astype(np.int64)
            yield s.rows(lang, pa.nulls(len(lang), pa.large_binary()), total)


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b >> np.uint64(1))


def _pairs(s: _Slice, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of a word that makes a pair of frequent words with the next, hashes of words, whether a word is frequent)."""
    own = s.hashes()
    good = within(often, own)[s.code]
    return np.flatnonzero(good[:-1] & good[1:] & (s.piece[:-1] == s.piece[1:])), own, good


def _count_pairs(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                s = _Slice(some)
                at, _, _ = _pairs(s, words.value)
                n = np.int64(len(s.lang))
                key, count = np.unique(s.code[at] * n + s.code[at + 1], return_counts=True)
                a, b = key // max(1, n), key % max(1, n)
                yield s.rows(s.lang[a], _spelled(s.words.take(pa.array(s.word[a])), s.words.take(pa.array(s.word[b]))), count)

    return run


def _count_longer(words, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                s = _Slice(some)
                at, own, _ = _pairs(s, words.value)
                at = at[within(pairs.value, _pair_key(own[s.code[at]], own[s.code[at + 1]]))]
                n = np.int64(max(1, len(s.lang)))
                ok = np.zeros(len(s.code) + 2, bool)
                ok[at] = True
                part = s.code[at] * n + s.code[at + 1]
                for k in range(2, LONGEST):  # runs of k + 1 words: k pairs in a row
                    long = ok[at + k - 1]
                    at, part = at[long], part[long]
                    known, part = np.unique(part, return_inverse=True)
                    whole, first, count = np.unique(part * n + s.code[at + k], return_index=True, return_counts=True)
                    if len(whole):
                        where = at[first]
                        yield s.rows(s.lang[s.code[where]], _spelled(*(s.words.take(pa.array(s.word[s.code[where + j]])) for j in range(k + 1))), count)
                    part = part * n + s.code[at + k]

    return run


def _summed(counts: DataFrame, least: int, label: str) -> DataFrame:
    return stored(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where((F.col("a") >= least) | F.col("phrase").isNull()), label)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a) of all phrases of 1 to 4 words that occur ``least`` times, and (lang, n): all words of each language."""
    share = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text <> ''")
    kind = "lang string, phrase string, n long"
    words = _summed(rows.mapInArrow(_count_words, kind), least, "phrase-words")
    one = words.where(F.col("phrase").isNotNull())
    often = share(bit_filter(one, F.xxhash64("lang", "phrase")))
    two = _summed(rows.mapInArrow(_count_pairs(often), kind), least, "phrase-pairs")
    cut = F.split("phrase", " ", -1)
    second = share(bit_filter(two, F.xxhash64("lang", cut[0]).bitwiseXOR(F.shiftrightunsigned(F.xxhash64("lang", cut[1]), 1))))
    more = _summed(rows.mapInArrow(_count_longer(often, second), kind), least, "phrase-longer")
    every = one.unionByName(two).unionByName(more)
    return every.select("lang", cut.alias("words"), "a"), words.where(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))


def _stream(counts: DataFrame, backwards: bool) -> DataFrame:
    """lang, words, part1..part3 (counts of its first 1 to 3 words, backwards of its last), more (the largest count of an extension by one word at the other side).

    A phrase can have several rows, to be merged by max: those of the parts that hold extensions of it.
    """
    spark = counts.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.reverse("words") if backwards else F.col("words")
    ranged = stored(counts.select("lang", key.alias("k"), "a").repartitionByRange(wide, "lang", "k").withColumn("part", F.spark_partition_id()), "phrase-stream")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("lang", "k")).alias("f")).select("part", "f.lang", "f.k")
    begin = firsts.select("part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.lit(LONGEST - 1)), lambda m: F.slice("k", 1, m))).alias("k"), F.size("k").alias("size")).where(F.size("k") < F.col("size"))
    seeds: dict[int, list] = {}
    for r in begin.drop("size").join(ranged.drop("part"), ["lang", "k"]).distinct().collect():  # three rows a part at most
        seeds.setdefault(r["part"], []).append((r["lang"], tuple(r["k"]), r["a"]))
    known = spark.sparkContext.broadcast({part: sorted(some, key=lambda r: len(r[1])) for part, some in seeds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[list] = []  # open phrases, each a beginning of the next: lang, words, count, largest extension
        part = None

        def close(depth: int) -> None:
            while len(stack) > depth:
                lang, words, a, more = stack.pop()
                out.append((lang, list(words[::-1] if backwards else words), *([s[2] for s in stack] + [None] * LONGEST)[: LONGEST - 1], more))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * (LONGEST + 2)
            out.clear()
            kinds = [pa.string(), pa.list_(pa.string()), *[pa.int64()] * LONGEST]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["lang", "words", "part1", "part2", "part3", "more"])

        for batch in batches:
            for here, lang, words, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != part:
                    close(0)
                    part = here
                    stack += [[*seed, 0] for seed in known.value.get(part, [])]
                words = tuple(words)
                while stack and not (stack[-1][0] == lang and len(stack[-1][1]) < len(words) and words[: len(stack[-1][1])] == stack[-1][1]):
                    close(len(stack) - 1)
                if stack and len(stack[-1][1]) + 1 == len(words):
                    stack[-1][3] = max(stack[-1][3], a)
                stack.append([lang, words, a, 0])
            yield rows()
        close(0)
        yield rows()

    ordered = ranged.select("part", "lang", "k", "a").repartition(wide, "part").sortWithinPartitions("part", "lang", "k")
    return ordered.mapInArrow(run, "lang string, words array<string>, part1 long, part2 long, part3 long, more long")


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first ``kept`` phrases by score."""
    counts, totals = phrase_counts(docs, least)
    left, right = _stream(counts, False), _stream(counts, True)
    parts = [f"part{k}" for k in range(1, LONGEST)]
    none = F.lit(None).cast("long")
    rows = counts.where(F.size("words") > 1).select("lang", "words", "a", *(none.alias(f"{side}{k}") for side in "lr" for k in range(1, LONGEST)), F.lit(0).cast("long").alias("more"))
    for side, stream in (("l", left), ("r", right)):
        own = [F.col(p).alias(f"{side}{k}") for k, p in enumerate(parts, 1)]
        other = [none.alias(f"{'r' if side == 'l' else 'l'}{k}") for k in range(1, LONGEST)]
        rows = rows.unionByName(stream.where(F.size("words") > 1).select("lang", "words", none.alias("a"), *own, *other, "more"))
    merged = rows.groupBy("lang", "words").agg(*(F.max(c).alias(c) for c in rows.columns if c not in ("lang", "words")))

    def cut(m: int, k: int):
        """The score of a phrase of m words cut after k, in integers of 38 digits; the least of structs is the lowest score, then the smallest k."""
        score = F.expr(f"CAST({SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l{k} AS DECIMAL(19, 0)) + CAST(r{m - k} AS DECIMAL(19, 0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{m - k}").alias("r"))

    lowest = {m: F.array_min(F.array(*(cut(m, k) for k in range(1, m)))) for m in range(2, LONGEST + 1)}
    chosen = F.when(F.size("words") == 2, lowest[2]).when(F.size("words") == 3, lowest[3]).otherwise(lowest[4])
    alive = F.expr("CAST(more AS DECIMAL(19, 0)) * 100 < CAST(a AS DECIMAL(19, 0)) * 80")
    scored = merged.where(alive).select("lang", F.array_join("words", " ").alias("phrase"), "a", chosen.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # first in 64 parts of a language, so that the last task of each sorts few rows however many phrases there are
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= kept)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= kept)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
