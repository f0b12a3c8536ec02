"""Mix sources to target weights by pivotal dependent rounding. DataFrame functions only.

Each source gets a target in words; a document's fractional copies are target / source size, the
same for all documents of a source and at most ``max_copies``. The whole part is taken as is. The
fractional parts are rounded by the pivotal method: two open documents meet, the mass of one moves
to the other until one of them is 0 or 1, and the other stays open. Documents meet in small blocks
of like size, so a transfer hardly moves the words taken; the one left open of each block goes up
a reduction tree whose fan-in is bounded, first within its size class, then over the classes of
its source. Draws are hashes of the documents that meet, so reruns agree.

Defined results: NULL text has size 0; size-0 documents and sources take 0 words; NULL source is
a source and comes last; rows with equal doc_id, source and size share one decision; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

WEIGHTS, SHARE, MAX_COPIES, FAN_IN, SEED = (5, 2, 1), 1.5, 2.0, 48, 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> + target. One row a source, so its windows are over sources, not rows.

    Filling to a level: a source is full when its cap is under weight x level. Sources ordered by
    cap / weight fill first, and the level is what the others share of the rest by weight.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("full")) / F.col("left"))
    s = s.withColumn("open", F.col("weight") * F.col("level") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap"))).alias("target"))


def _unit(*columns: Column) -> Column:
    """A draw in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _meet(units: Column, seed: int, eps: float = 1e-12) -> Column:
    """Fold an ordered array of open units (id, ..., p): struct(done: array of decided, open: the one left)."""

    def step(state: Column, unit: Column) -> Column:
        a, b = state["open"], unit
        total = a["p"] + b["p"]
        draw = _unit(F.lit(seed), a["unit"], b["unit"])
        low = total < 1.0
        # below 1: one of them becomes 0; from 1 on: one becomes 1; the other keeps the rest
        a_goes = F.when(low, draw >= a["p"] / total).otherwise(draw < (1.0 - b["p"]) / (2.0 - total))
        gone, stays = F.when(a_goes, a).otherwise(b), F.when(a_goes, b).otherwise(a)
        rest = F.when(low, total).otherwise(total - 1.0)
        rest = F.when(F.abs(rest - F.round(rest)) < eps, F.round(rest)).otherwise(rest)
        met = F.struct(F.concat(state["done"], F.array(gone.withField("p", F.when(low, 0.0).otherwise(1.0)))).alias("done"), stays.withField("p", rest).alias("open"))
        # an open unit that is whole already is decided, and the newcomer takes its place
        whole = (a["p"] <= 0.0) | (a["p"] >= 1.0)
        return F.when(whole, F.struct(F.concat(state["done"], F.array(a)).alias("done"), b.alias("open"))).otherwise(met)

    start = F.struct(F.slice(units, 1, 0).alias("done"), units[0].alias("open"))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, step)


def pivotal(units: DataFrame, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """units(unit struct, grp, cls int, p double in (0,1)) -> (unit, extra 0/1), p kept in expectation.

    ``grp`` keeps its mass apart; ``cls`` says who should meet first. A level is a group-by into
    blocks of about ``fan_in``; levels shrink by that factor until one unit is left per class, then
    one per grp, whose own draw decides it.
    """
    counts = stored(units.groupBy("grp", "cls").agg(F.count("*").alias("n")), "pivot-counts")
    largest = counts.agg(F.max("n")).first()[0] or 0
    counts = counts.select(F.col("grp").alias("of_grp"), F.col("cls").alias("of_cls"), F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long").alias("blocks"))
    sized = units.join(counts, F.col("grp").eqNullSafe(F.col("of_grp")) & (F.col("cls") == F.col("of_cls"))).drop("of_grp", "of_cls")
    level = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.col("blocks")))
    decided: list[DataFrame] = []
    depth = max(1, math.ceil(math.log(max(largest, 2), fan_in)) + 1)
    for k in range(depth + 1):
        last = k == depth
        keys = ["grp"] if last else ["grp", "cls", "block"]
        one = F.struct(F.col("cls").alias("cls"), F.xxhash64(F.lit(seed + k), "unit").alias("at"), "unit", "p")
        met = level.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("units")).withColumn("met", _meet(F.col("units"), seed)).drop("units")
        met = stored(met, "pivot")  # later levels and the decided rows both read it
        decided.append(met.select(F.explode("met.done").alias("d")).select("d.unit", F.col("d.p").alias("extra")))
        rest = met.select(*keys, F.col("met.open").alias("o"))
        if last:
            p = F.col("o.p")
            extra = F.when((p <= 0.0) | (p >= 1.0), p).otherwise((_unit(F.lit(seed), F.lit("last"), F.col("o.unit")) < p).cast("double"))
            decided.append(rest.select(F.col("o.unit").alias("unit"), extra.alias("extra")))
        else:
            level = rest.select("grp", "cls", F.col("o.unit").alias("unit"), F.col("o.p").alias("p"), F.floor(F.col("block") / fan_in).alias("block"))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per input row."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    plan = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(F.col("source").alias("src"), "source_size", "target", ratio.alias("ratio")).withColumn("whole", F.floor(F.col("ratio") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    rows = sizes.join(plan, sizes.source.eqNullSafe(plan.src)).drop("src")
    open_rows = rows.where((F.col("part") > 1e-9) & (F.col("size") > 0)).groupBy("doc_id", "source", "size").agg(F.first("part").alias("part"), F.count("*").alias("times"))
    units = open_rows.select(F.struct("doc_id", "source", "size").alias("unit"), F.col("source").alias("grp"), F.floor(F.log2(F.col("size") * F.col("times")) * 6).cast("int").alias("cls"), F.col("part").alias("p"))
    extra = pivotal(units, seed=seed).select(F.col("unit.doc_id").alias("d"), F.col("unit.source").alias("s"), F.col("unit.size").alias("z"), "extra")
    out = rows.join(extra, rows.doc_id.eqNullSafe(extra.d) & rows.source.eqNullSafe(extra.s) & (rows.size == extra.z), "left")
    copies = (F.when(F.col("size") > 0, F.col("whole")).otherwise(0) + F.coalesce("extra", F.lit(0.0))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
