"""From raw documents to token files: the stages in order, each over all that its predecessor kept.

Defined results, for every stage: columns beside those it needs pass through, whatever their names; equal rows are
judged alike; an empty table gives no rows. toxicity: NULL and empty texts have no terms and stay while the lexicon
finds such texts clean. near_duplicates: NULL counts as empty, texts without words are one group, NULL ids come last in a group,
and of rows that repeat an id and a text one stays. decontamination: texts without words hold no passage. mixing: texts
without words are never taken, NULL is a source. token_binary: NULL and empty texts are the end id alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, mixing, token_binary, toxicity
from tessera.llm.common import bit_filter, discard, discard_path, scratch, stored, table, within

# all pairs of a similarity of 0.8 on sets of five-word shingles are links
NEAR = {"shingle": 5, "least": 0.8}


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects (score of 0.5 or more) go."""
    lexicon = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.clean(docs, lexicon)


def _key(doc_id: str, th) -> Column:
    return F.xxhash64(doc_id, th)


def _same(other: str) -> Column:
    """A row d of documents is meant by a row of (doc_id, hash of text)."""
    return F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.xxhash64("d.text") == F.col(f"{other}.th"))


def _named(docs: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are surely not among these (doc_id, hash of text), the others): told apart by a filter of bounded size, without a shuffle of texts."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(some, _key("doc_id", F.col("th"))))

    @F.pandas_udf("boolean")
    def may_be(key: pd.Series) -> pd.Series:
        return pd.Series(within(bits.value, key.to_numpy().view(np.uint64)))

    maybe = may_be(_key("doc_id", F.xxhash64("text")))
    return docs.where(~maybe), docs.where(maybe)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows of these (doc_id, hash of text). Only texts that pass the filter are shuffled."""
    clear, others = _named(docs, gone)
    return clear.unionByName(others.alias("d").join(gone.alias("g"), _same("g"), "left_anti"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of smallest doc_id (then hash of text) stays, once; NULL ids come last."""
    found = jaccard.similar(docs, **NEAR)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("m")).select(F.col("m.doc_id").alias("first_id"), F.col("m.th").alias("first_th"), F.lit(True).alias("stays"))
    rows = found.groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    decided = rows.join(first, F.col("first_id").eqNullSafe(F.col("doc_id")) & (F.col("first_th") == F.col("th")), "left")
    # what goes, and what stays but has rows that repeat it
    decided = stored(decided.select("doc_id", "th", F.coalesce("stays", F.lit(False)).alias("stays")).where(~F.col("stays") | (F.col("rows") > 1)), "near-decided")
    discard(found)
    repeated = decided.where("stays")
    if repeated.isEmpty():
        return _without(docs, decided)
    again = _named(docs, repeated)[1].alias("d").join(repeated.alias("r"), _same("r"), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = again.groupBy("doc_id", F.xxhash64("text").alias("th")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select("r.*")
    return _without(docs, decided).unionByName(one)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    _, found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select("doc_id", "th").distinct(), "leaks")
    return docs.alias("d").join(leaks.alias("g"), _same("g"), "left_anti")  # without _without: this stage runs no Python


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    plan = stored(mixing.mix(docs).where("copies > 0").select("doc_id", "source", "size", "copies").distinct(), "mix-plan")
    d, p = docs.alias("d"), plan.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (mixing.word_count(F.col("d.text")) == F.col("p.size"))
    row = F.struct(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
    return d.join(p, same).select(F.explode(F.array_repeat(row, F.col("p.copies").cast("int"))).alias("row")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_binary.encode_documents(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_near),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_binary", write_tokens),
]

ORACLE_SQL = None  # learning, drawing and tokenizing can't be put in SQL; tests/llm hold each stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard_path(spark, before)  # the next stage has read it
        before = path
    return docs
