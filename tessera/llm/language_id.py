"""Language identification by prediction by partial matching.

Per language, a variable-order tree of byte contexts (order 0 to ``ORDER``) holds symbol counts.
Statistics are frozen after fitting. With escape method C and exclusion, a context that has seen
D symbols in N occurrences gives a seen symbol c / (N + D) and leaves D / (N + D) to the symbols it
has not seen, shared as its shorter context shares them; below order 0 all bytes are equal. A
text's code length under a language is the exact sum of -log2 over its UTF-8 bytes; the shortest
code wins, and the score is the winner's share of 2^-length (the posterior under equal priors).

Fitting reads a bounded, documented sample: about ``docs_per_lang`` whole documents a language,
chosen by a hash of id and text, so that a text with many copies is drawn as often as its share
and not all or nothing. Counting is distributed and inside texts, so it is the same under any partitioning.
The model keeps every context of the sample: the ``contexts`` most frequent ones of the longest order a language as full rows,
all others sparsely, by their seen symbols and what an unseen one adds to its shorter context. That number decides speed only.
Every document is scored whole.

Defined results: NULL text and text without a letter give ``und`` with score 0, as does everything
when nothing could be learned; rows of NULL doc_id are neither learned from nor held out; equal
code lengths go to the smaller language value; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, stored, table, unit_draw

ORDER, DOCS_PER_LANG, CONTEXTS, SEED = 3, 3000, 4096, 11
_LEAST = 1e-12  # probabilities are taken as this at least
PAD = b"\n" * ORDER
_STEP = 1 << 19


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of every run of ORDER + 1 bytes."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merge(lang: str, grams: np.ndarray, counts: np.ndarray) -> None:
        if lang in held:
            grams, counts = np.concatenate([held[lang][0], grams]), np.concatenate([held[lang][1], counts])
        at, inverse = np.unique(grams, return_inverse=True)
        held[lang] = at, np.bincount(inverse, weights=counts)

    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(PAD + text.encode("utf-8", "surrogatepass"))
        for lang, parts in texts.items():
            raw = np.frombuffer(b"".join(parts), np.uint8)
            coded = np.ones(len(raw), bool)  # the padding is context, never a symbol, so no run crosses two texts
            starts = np.cumsum([0, *map(len, parts[:-1])])
            for k in range(ORDER):
                coded[starts + k] = False
            for k in range(0, len(raw) - ORDER, _STEP):
                b = raw[k : k + _STEP + ORDER].astype(np.uint32)
                gram = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
                merge(lang, *np.unique(gram[coded[k + ORDER : k + ORDER + len(gram)]], return_counts=True))
    for lang, (grams, counts) in held.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": pa.array(grams.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})


def fit(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """labelled(lang, text, doc_id if there is one) -> language -> (grams, counts): the distinct runs of the bounded sample."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_lang / n)).otherwise(share)
    draw = unit_draw(labelled, SEED)
    grams = rows.where(draw < share).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = stored(grams, "ppm-grams")
    found = grams.orderBy("lang", "gram").toArrow().combine_chunks()
    langs = found.column("lang").to_numpy() if not found.num_rows else np.array(found.column("lang").to_pylist(), object)
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy().astype(np.float64)
    return {lang: (gram[langs == lang], n[langs == lang]) for lang in sorted(set(langs.tolist()))}


class Table:
    """One language's context tree as a table state x byte -> bits, over contexts that the language has."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, contexts: int = CONTEXTS):
        orders = self._orders(grams, n)
        every = [np.unique(ctx) for ctx, _, _ in orders]
        full = self._frequent(orders[ORDER], contexts)
        kept = [*every[:ORDER], full]
        starts = np.cumsum([0, *map(len, kept)])
        self.bits = np.empty((starts[-1], 256), np.float32)
        below = np.full((1, 256), 1 / 256)
        for k, (ctx, sym, count) in enumerate(orders):
            if k == ORDER:
                self._sparse(orders[k], every[k], full, below, every[k - 1])
                own = np.isin(ctx, full)
                ctx, sym, count = ctx[own], sym[own], count[own]
            parent = below[np.searchsorted(every[k - 1], kept[k] & (256 ** (k - 1) - 1))] if k > 1 else np.repeat(below, len(kept[k]), 0)
            seen = np.zeros((len(kept[k]), 256))
            seen[np.searchsorted(kept[k], ctx), sym] = count
            total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            free = np.where(seen > 0, 0, parent).sum(1, keepdims=True)
            rest = np.where(seen > 0, 0, parent) / np.maximum(free, 1e-300)
            escape = np.where(free > 0, kinds, 0)
            below = (seen + escape * rest) / (total + escape)
            self.bits[starts[k] : starts[k + 1]] = -np.log2(np.maximum(below, _LEAST))
        self.flat = self.bits.ravel()
        # the state of a position: its longest context; sparse ones are numbered from -2 down
        one = np.full(256, starts[0], np.int32)
        one[kept[1]] = starts[1] + np.arange(len(kept[1]))
        self.two = np.tile(one, 256)
        self.two[kept[2]] = starts[2] + np.arange(len(kept[2]))
        pairs = np.unique(every[3] >> 8)
        self.pair = np.zeros(65_536, np.int32)
        self.pair[pairs] = 1 + np.arange(len(pairs))
        self.three = np.full((len(pairs) + 1) * 256, -1, np.int32)
        for some, states in ((full, starts[3] + np.arange(len(full))), (self.others, -2 - np.arange(len(self.others)))):
            self.three[self.pair[some >> 8] * 256 + (some & 255)] = states

    @staticmethod
    def _orders(grams: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(context, symbol, count) of each order."""
        out = []
        for k in range(ORDER + 1):
            at, inverse = np.unique(grams & (256 ** (k + 1) - 1), return_inverse=True)
            out.append((at >> 8, at & 255, np.bincount(inverse, weights=n)))
        return out

    @staticmethod
    def _frequent(order: tuple[np.ndarray, np.ndarray, np.ndarray], contexts: int) -> np.ndarray:
        each, inverse = np.unique(order[0], return_inverse=True)
        weight = np.bincount(inverse, weights=order[2])
        return np.sort(each[np.argsort(-weight, kind="stable")[:contexts]])

    def _sparse(self, order: tuple[np.ndarray, np.ndarray, np.ndarray], every: np.ndarray, full: np.ndarray, shorter: np.ndarray, shorter_contexts: np.ndarray) -> None:
        """The contexts without a row of their own: bits of their seen symbols, and what an unseen symbol costs above its shorter context."""
        self.others = np.setdiff1d(every, full, assume_unique=True)
        own = np.isin(order[0], self.others)
        ctx, sym, count = (x[own] for x in order)
        at = np.searchsorted(self.others, ctx)
        total, kinds = np.bincount(at, count, len(self.others)), np.bincount(at, minlength=len(self.others))
        parent = shorter[np.searchsorted(shorter_contexts, ctx & 0xFFFF), sym]
        seen = np.bincount(at, parent, len(self.others))
        free = np.where(kinds < 256, np.maximum(1 - seen, 0), 0)
        escape = np.where(free > 0, kinds, 0)
        self.seen = at.astype(np.int64) << 8 | sym  # ascending, as contexts and symbols are
        self.seen_bits = -np.log2(np.maximum(count / (total + escape)[at], _LEAST)).astype(np.float32)
        self.unseen_bits = -np.log2(np.maximum(escape / (total + escape) / np.maximum(free, 1e-300), _LEAST)).astype(np.float32)

    def position_bits(self, far: np.ndarray, near: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
        state = self.three[self.pair[far] * 256 + d]
        sparse = np.flatnonzero(state < -1)
        which = (-2 - state[sparse]).astype(np.int64)
        short = state < 0
        state[short] = self.two[near[short]]
        out = self.flat[state * 256 + s]
        if len(sparse):
            key = which << 8 | s[sparse]
            at = np.minimum(np.searchsorted(self.seen, key), len(self.seen) - 1)
            out[sparse] = np.where(self.seen[at] == key, self.seen_bits[at], np.minimum(self.unseen_bits[which] + out[sparse], -np.log2(_LEAST)))
        return out


class Tree:
    """A table for each language; memory and time are linear in the languages."""

    def __init__(self, model: dict[str, tuple[np.ndarray, np.ndarray]], contexts: int = CONTEXTS):
        self.langs = sorted(model)
        self.tables = [Table(*model[lang], contexts) for lang in self.langs]

    def position_bits(self, raw: np.ndarray) -> np.ndarray:
        """raw: ORDER bytes of context, then the bytes to code. (n, languages) code lengths in bits."""
        b = raw.astype(np.int32)
        a, c, d, s = b[:-3], b[1:-2], b[2:-1], b[3:]
        far, near = a << 8 | c, c << 8 | d
        return np.stack([t.position_bits(far, near, d, s) for t in self.tables], 1)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each whole text, in slices of bounded size."""
        out, at = np.zeros((len(texts), len(self.langs))), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _STEP):
                size += len(texts[end])
                end += 1
            if end == at + 1:
                raw = np.frombuffer(PAD + texts[at], np.uint8)
                for k in range(0, len(raw) - ORDER, _STEP):
                    out[at] += self.position_bits(raw[k : k + _STEP + ORDER]).sum(0, dtype=np.float64)
            else:
                raw = np.frombuffer(b"".join(PAD + t for t in texts[at:end]), np.uint8)
                each = self.position_bits(raw).astype(np.float64)
                starts = np.cumsum([0] + [len(t) + ORDER for t in texts[at:end]])
                total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(each, axis=0)])
                # the row of the byte at place p of raw is p - ORDER; a text begins ORDER after its padding
                ends = np.array([s + len(t) for s, t in zip(starts[:-1], texts[at:end], strict=True)])
                out[at:end] = total[ends] - total[starts[:-1]]
            at = end
        return out


_TREES: dict[str, Tree] = {}


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, model = shared.value
        if key not in _TREES:
            _TREES.clear()
            _TREES[key] = Tree(model)
        tree = _TREES[key]
        for batch in batches:
            texts, letter = batch.column("text").to_pylist(), batch.column("letter").to_pylist()
            bits = tree.code_lengths([t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, letter, strict=True)])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            lang = [tree.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
            score = np.where(letter, share, 0.0) if batch.num_rows else share
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, id_column: str = "doc_id", held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if model else F.lit(False)
    rows = docs.select(F.col(id_column).alias("doc_id"), "text", has_letter.alias("letter"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    if not model:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scorer(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "lang", "text"))
    return identify(docs, model, held_out=held)
