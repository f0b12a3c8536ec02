"""Benchmark decontamination by winnowing. DataFrame functions only.

Texts become words (A-Z lowered). Of every ``window`` consecutive k-grams, winnowing keeps the one
of least hash, so any shared span of k + window - 1 words shares a kept fingerprint: with k = 5 and
window = 6 that is every span of 10 words. Kept fingerprints of training texts are matched with
those of the test items; each match is extended: the windows of ``span`` words that cover the
matched k-gram are compared, as words, with the items' windows. Items of fewer words than ``span``
are one window; their lengths are few (1 to span - 1) and each length present is looked up whole.

The item side is the fixed test set: it is broadcast while it is under ``broadcast_rows`` rows (it
is counted first) and joined by shuffle beyond that.

Defined results: NULL or wordless texts have no words and no hits; NULL or wordless items never
occur; items with equal text count by their ids; equal item_ids of different texts count once;
documents with equal doc_id are told apart by their text, and equal rows all stay; a NULL item_id
hits words but is not listed among the items; extra columns are ignored; empty tables give
no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

K, WINDOW, SPAN, BROADCAST_ROWS = 5, 6, 10, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of words; empty for NULL."""
    cut = F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.filter(cut, lambda w: w != ""), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run(w: Column, at: Column, n: int) -> Column:
    """``n`` words from ``at`` on as one string (element access: slice() would copy the whole array)."""
    return F.concat_ws(" ", *[F.get(w, at + j) for j in range(n)])


def winnowed(text: Column, least: int, k: int = K, window: int = WINDOW) -> Column:
    """Array of (h, at): the least k-gram hash of each run of ``window`` k-grams, last of equals.

    NULL for texts of fewer than ``least`` words.
    """

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h"), (-i).alias("at")))

    def minima(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(g) - window)), lambda i: F.least(*[F.get(g, i + j) for j in range(window)]))

    def changes(m: Column) -> Column:
        """A gram is least in neighbouring windows only, so repeats stand together."""
        return F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["at"] != x["at"]))

    return let(words(text), lambda w: F.when(F.size(w) >= least, let(let(grams(w), minima), changes)))


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def item_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, n, key: every window of every item; key is its words joined by a space."""

    def cut(w: Column) -> Column:
        n = F.least(F.lit(span), F.size(w))
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: run(w, i, span))
        return F.when(F.size(w) > 0, F.struct(n.alias("n"), F.array_distinct(keys).alias("keys")))

    cuts = benchmark.select("item_id", let(words(F.col("text")), cut).alias("c"))
    return cuts.select("item_id", "c.n", F.explode("c.keys").alias("key"))


def _runs_of(lengths: list[int]) -> Callable[[Column], Column]:
    """All runs of these numbers of words as (at, n, key), cut in one pass."""

    def runs(w: Column, n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), run(w, i, n).alias("key"))))

    return lambda w: F.flatten(F.filter(F.array(*[runs(w, n) for n in lengths]), lambda x: x.isNotNull()))


def hits(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, span: int = SPAN, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(per document row key: n_words), (row key, at, n, item_id: an item's window that stands at word ``at``)."""
    if k + window - 1 > span:
        raise ValueError("k + window - 1 must not exceed the span that is to be found")
    tests = stored(item_windows(benchmark, span), "bench-windows")
    prints = benchmark.select(F.explode(winnowed(F.col("text"), span, k, window)).alias("p")).select(F.col("p.h").alias("h")).distinct()
    prints = _small(stored(prints, "bench-prints"), broadcast_rows)
    lengths = [r[0] for r in tests.where(F.col("n") < span).select("n").distinct().collect()]  # at most span - 1 of them
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("t"))
    spots = base.select("doc_id", "th", F.explode(winnowed(F.col("t"), span, k, window)).alias("p"))
    spots = spots.select("doc_id", "th", F.col("p.h").alias("h"), (-F.col("p.at")).alias("at")).join(prints, "h").select("doc_id", "th", "at").distinct()
    # the windows that cover a matched k-gram, cut from the documents that have one
    near = stored(spots.groupBy("doc_id", "th").agg(F.collect_set("at").alias("spots")).withColumnRenamed("doc_id", "d").withColumnRenamed("th", "h"), "bench-spots")
    found = base.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("h"))).dropDuplicates(["doc_id", "th"])

    def cut(w: Column) -> Column:
        reach = F.array_distinct(F.flatten(F.transform("spots", lambda p: F.sequence(F.greatest(F.lit(0), p + k - span), F.greatest(F.lit(0), F.least(p, F.size(w) - span))))))
        return F.transform(reach, lambda i: F.struct(i.alias("at"), run(w, i, span).alias("key")))

    pieces = found.select("doc_id", "th", F.explode(let(words(F.col("t")), cut)).alias("c")).select("doc_id", "th", "c.at", "c.key")
    tests_small = _small(tests, broadcast_rows)
    out = pieces.join(tests_small.where(F.col("n") == span), "key").select("doc_id", "th", "at", "n", "item_id")
    if lengths:
        every = base.select("doc_id", "th", F.explode(let(words(F.col("t")), _runs_of(sorted(lengths)))).alias("c")).select("doc_id", "th", "c.at", "c.n", "c.key")
        out = out.unionByName(every.join(tests_small.where(F.col("n") < span), ["key", "n"]).select("doc_id", "th", "at", "n", "item_id"))
    return base.select("doc_id", "th", F.size(words(F.col("t"))).cast("long").alias("n_words")), out


def contamination(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    counted, found = hits(docs, benchmark, **parameters)
    found = stored(found, "bench-hits")
    keys = ["doc_id", "th"]
    covered = found.select(*keys, "at", "n").distinct().select(*keys, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("word")).distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    listed = found.select(*keys, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*keys).agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    both = covered.alias("c").join(listed.alias("l"), F.col("c.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("c.th").eqNullSafe(F.col("l.th"))).select(F.col("c.doc_id").alias("d"), F.col("c.th").alias("h"), "n_hit", "n_items", "items_sha256")
    out = counted.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
