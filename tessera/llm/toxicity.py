"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding lowers, maps homoglyphs to ASCII letters and digit substitutions to the letters that they
stand for, so disguised terms meet the lexicon. The lexicon is learned: a term's weight is the
log odds of its document rate in toxic over clean labelled documents; it needs enough toxic
documents, an excess that chance does not explain (a likelihood-ratio test at ``ERRORS`` over all words
tested, which holds for small samples too) and many different neighbours (copies of one text repeat the same
ones). Exception phrases, a term with the word before or after it that clean documents use as
much as toxic ones, cancel the term inside them. The score is a logistic function of the weight
found, plain and per word of the text.

Fitting reads at most about ``rows_per_class`` labelled documents of each class, chosen by a
hash of id and text; copies of a text in the sample count once, so a text with many copies neither
fills the sample nor hides a term. Every document is scored whole.

Defined results: NULL and empty texts score as texts without terms; documents without id are not
learned from and not held out; repeated label rows count once per distinct label; with no labels
of both classes every score is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, map_rows, slices, stored, table, unit_draw

ROWS_PER_CLASS, MIN_DOCS, MIN_ODDS, ERRORS, MIN_SPREAD, SEED = 6000, 5, 4.0, 0.05, 0.25, 5

# Look-alike characters and the digits and signs that replace letters.
HOMOGLYPHS = {"а": "a", "ɑ": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "κ": "k", "к": "k", "ӏ": "l", "м": "m", "ո": "n", "о": "o", "ο": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ᴢ": "z"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff", "")
_WIDE = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_FOLD = str.maketrans({**INVISIBLE, **HOMOGLYPHS, **DIGITS, **{w: DIGITS.get(c.lower(), c.lower()) for w, c in _WIDE.items()}})
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    return (text or "").lower().translate(_FOLD)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> per word: documents of each class; per (word, word before) of toxic documents: one row."""
    n, near = (Counter(), Counter()), set()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall(fold(text))
            n[toxic].update(set(words))
            if toxic:
                near.update(zip(words[1:], words, strict=False))
    words = [*n[0], *n[1], *(w for w, _ in near)]
    before = [None] * (len(n[0]) + len(n[1])) + [b for _, b in near]
    clean = [*n[0].values(), *([0] * (len(n[1]) + len(near)))]
    toxic = [*([0] * len(n[0])), *n[1].values(), *([0] * len(near))]
    for k in range(0, len(words), 50_000):
        s = slice(k, k + 50_000)
        yield pa.RecordBatch.from_pydict({"word": pa.array(words[s], pa.string()), "before": pa.array(before[s], pa.string()), "clean": pa.array(clean[s], pa.int64()), "toxic": pa.array(toxic[s], pa.int64())})


def _phrases(terms: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(fold(text))
                n[toxic].update({" ".join(p) for p in zip(words, words[1:], strict=False) if p[0] in terms or p[1] in terms})
        for toxic in (0, 1):
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([*n[toxic]], pa.string()), "toxic": pa.array([toxic] * len(n[toxic]), pa.int32()), "n": pa.array([*n[toxic].values()], pa.int64())})

    return run


class Lexicon:
    """Weights of terms, exception phrases, and the logistic coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients=(-3.0, 1.0, 0.0)):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self.matcher = None

    def __getstate__(self):
        return self.__dict__ | {"matcher": None}

    def _automaton(self):
        if self.matcher is None:
            self.matcher = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.matcher.add_word(phrase, (len(phrase), 0.0, True))
            for term, weight in self.weights.items():
                self.matcher.add_word(term, (len(term), weight, False))
            self.matcher.make_automaton()
        return self.matcher

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of the weight found, log of the weight per hundred words)."""
        if not self.weights:
            return 0.0, 0.0
        t = fold(text)
        hits, spared = [], []
        for end, (n, weight, exception) in self._automaton().iter(t):
            start = end - n + 1
            if (start and t[start - 1].isalnum()) or (end + 1 < len(t) and t[end + 1].isalnum()):
                continue
            (spared if exception else hits).append((start, end, weight))
        # the furthest end among the exceptions that begin at or before a hit decides whether one covers it
        spared.sort()
        begins, reach = [x for x, _, _ in spared], list(itertools.accumulate((y for _, y, _ in spared), max))
        total = sum(w for a, b, w in hits if not (k := bisect.bisect_right(begins, a)) or reach[k - 1] < b)
        return float(np.log1p(total)), float(np.log1p(100 * total / (20 + t.count(" "))))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        c = self.coefficients
        return float(1 / (1 + np.exp(-(c[0] + c[1] * a + c[2] * b)))) if self.weights else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (w * (y - p)) - penalty @ c
        c = c + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, grad)
    return tuple(float(v) for v in c)


def _log_share(n, docs: int, both, every: int):
    """What one class adds to the log likelihood ratio of its documents with a word against an equal rate in both."""
    rest, others = docs - n, every - both
    part = F.when(n > 0, n * F.log(n * every / (both * docs))).otherwise(0.0)
    return part + F.when(rest > 0, rest * F.log(rest * every / (others * docs))).otherwise(0.0)


def fit(labelled: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Lexicon:
    """labelled(text, toxic 0/1, and if there are: doc_id, weight) -> lexicon."""
    rows = labelled.where("toxic in (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    sizes = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(weight).alias("mass")).collect()}
    if len(sizes) < 2:
        return Lexicon({}, [])
    share = F.when(F.col("toxic") == 1, min(1.0, rows_per_class / sizes[1]["n"])).otherwise(min(1.0, rows_per_class / sizes[0]["n"]))
    drawn = rows.where(unit_draw(labelled, SEED) < share)
    sample = stored(drawn.select("text", "toxic").distinct(), "toxic-sample")
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = seen.get(1, 0), seen.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, [])
    counted = sample.mapInArrow(_terms, "word string, before string, clean long, toxic long").groupBy("word", "before").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    terms = counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("before").alias("near"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    both = F.col("toxic") + F.col("clean")
    ratio = sum(_log_share(F.col(k), n, both, n0 + n1) for k, n in (("toxic", n1), ("clean", n0)))
    tested = terms.where(F.col("toxic") >= MIN_DOCS).select("word", odds.alias("odds"), ratio.alias("ratio"), "near", "toxic")
    tested = stored(tested, "toxic-terms")
    # by chance a word reaches a log likelihood ratio of x with a probability of about exp(-x)
    enough = float(np.log(max(1, tested.count()) / ERRORS))
    good = tested.where((F.col("odds") >= float(np.log(MIN_ODDS))) & (F.col("ratio") >= enough) & (F.col("near") >= MIN_DOCS) & (F.col("near") >= MIN_SPREAD * F.col("toxic")))
    weights = {r["word"]: float(r["odds"]) for r in good.collect()}  # words of the bounded sample that stand out
    if not weights:
        return Lexicon({}, [])
    phrases = sample.mapInArrow(_phrases(frozenset(weights)), "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    exceptions = [r["phrase"] for r in phrases.where((F.col("c") >= MIN_DOCS) & (F.col("c") / n0 >= F.col("t") / n1)).collect()]
    lexicon = Lexicon(weights, exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

    got = sample.mapInArrow(features, "a double, b double, toxic int").toPandas()  # at most about 2 x rows_per_class rows
    y = got["toxic"].to_numpy(float)
    lexicon.coefficients = _logistic(got[["a", "b"]].to_numpy(float), y, np.where(y == 1, sizes[1]["mass"] / n1, sizes[0]["mass"] / n0))
    return lexicon


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            score = np.array([lexicon.score(t) for t in batch.column("text").to_pylist()], np.float64)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of docs with score and predicted. docs needs a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scorer(shared), f"{fields}, score double, predicted int")


def clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs, with the columns that they have, whose text scores under 0.5. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.rename_columns(names).filter(pa.array([shared.value.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, run, docs.schema)


def labelled(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, text, toxic, weight: texts with labels whose crc32(doc_id) mod 5 is not 0.

    Labels are drawn before they meet the texts, at most about ``rows_per_class`` of each class, so no
    text is shuffled; ``weight`` says for how many labels of its class a drawn one stands.
    """
    known = labels.where(crc_mod("doc_id", 5) != 0).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, rows_per_class / sizes.get(1, 1))).otherwise(min(1.0, rows_per_class / sizes.get(0, 1)))
    # the salt keeps this draw apart from the one in fit()
    drawn = known.where(unit_draw(known, SEED + 1) < share).select(F.col("doc_id").alias("label_id"), "toxic", (1 / share).alias("weight"))
    drawn = stored(drawn, "toxic-labels")
    return docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic", "weight")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(labelled(docs, table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return scored(rows, lexicon).drop("text")
