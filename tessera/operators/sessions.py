"""Sessions by time gap, and choosing a row per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import settled


def sessionize(df: DataFrame, keys: list[str], ts: str, gap, tie: str) -> DataFrame:
    """Adds session_index (from 1): a row more than ``gap`` after its predecessor starts a new one."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    before = F.lag(ts).over(w)
    starts = F.when(before.isNull() | (F.col(ts) - before > gap), 1).otherwise(0)
    return df.withColumn("_start", starts).withColumn("session_index", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df sorted by keys and order over all partitions, with its _part and _row in it: also a key that holds most rows lies in many parts."""
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(wide, *keys, *order).sortWithinPartitions(*keys, *order)
    return settled(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))


def _meet_runs(rows: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with what is known of its key's run in its part."""
    named = runs.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_part", "_p")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_part") == F.col("_p"))
    return rows.join(named, same).drop("_p", *(f"_k_{k}" for k in keys))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with a row number (from 1) in each key, without a window over a key: counts of its runs in sorted parts are summed up."""
    rows = _dealt(df, keys, order)
    runs = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*keys, "_part", (before + 1 - F.col("_first")).alias("_shift"))
    return _meet_runs(rows, runs, keys).withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def sessionize_spread(df: DataFrame, keys: list[str], ts: str, gap, tie: str) -> DataFrame:
    """``sessionize`` as a prefix scan in two levels, for keys of any size.

    Rows are sorted by key and time over all partitions, so a hot key is cut into time ranges in several tasks. Each range counts the
    session starts inside it; a short table of ranges (one row a key and range) carries the last time before a range and the starts of
    all earlier ranges of its key. Only that table has a window over a key.
    """
    rows = _dealt(df, keys, [ts, tie])
    inside = Window.partitionBy(*keys, "_part").orderBy("_row")
    gone = F.col(ts) - F.lag(ts).over(inside)
    rows = rows.withColumn("_starts", F.sum(F.when(gone > gap, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_part").agg(F.min_by(ts, "_row").alias("_from"), F.max_by(ts, "_row").alias("_to"), F.max("_starts").alias("_many"))
    line = Window.partitionBy(*keys).orderBy("_part")
    before = F.lag("_to").over(line)
    runs = runs.withColumn("_open", F.when(before.isNull() | (F.col("_from") - before > gap), 1).otherwise(0))
    runs = runs.withColumn("_sum", F.sum(F.col("_many") + F.col("_open")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_many"))
    return _meet_runs(rows, runs.select(*keys, "_part", "_sum"), keys).withColumn("session_index", F.col("_starts") + F.col("_sum")).drop("_part", "_row", "_starts", "_sum")


def session_windows(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """The same sessions by the built-in session window: it merges partial sessions before the shuffle ends."""
    return df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n"))


def best(row: Column, *rank: Column) -> Column:
    """Arg-max by a compound key; give the negated order last so that the first of equals wins."""
    return F.max_by(row, F.struct(*rank))


def tiered_key(gate: Column, score: Column, order: Column) -> Column:
    """Rows that pass the gate beat the others, then the score, then the earlier row."""
    return F.struct(gate.alias("gate"), score.alias("score"), (-order).alias("first"))


def peak_key(gate: Column, score: Column, fallback: Column, order: Column) -> Column:
    """Best score among rows that pass; where none does, the best fallback."""
    return F.struct(gate.alias("gate"), F.when(gate, score).otherwise(fallback).alias("value"), (-order).alias("first"))


def group_rows(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """Rows of a key as one ordered array."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def closing_frames(segments: DataFrame, frames: DataFrame, gap: int, bucket: int = 60_000, spread: bool = False) -> DataFrame:
    """segments(stream_id, segment_id, last_ms, and what else there is) -> + close_ms and close_rank.

    The closing frame is the first one later than last_ms + gap, by an as-of join on buckets of time: the first such frame of the
    segment's bucket, else the first frame of a later bucket, which a table of buckets carries back. A stream's frames are never
    in one window; its buckets are, and its segments for the rank unless ``spread``, which ranks in two levels.
    """
    more = [f for f in segments.schema.fields if f.name not in ("stream_id", "segment_id", "last_ms")]
    blank = [F.lit(None).cast("long").alias("segment_id"), F.lit(None).cast("long").alias("last_ms"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in more)]
    line = frames.select("stream_id", F.col("ts_ms").cast("long").alias("_at"), F.lit(1).alias("_frame"), *blank)
    line = line.unionByName(segments.select("stream_id", (F.col("last_ms") + gap).cast("long").alias("_at"), F.lit(0).alias("_frame"), "segment_id", "last_ms", *(f.name for f in more)))
    line = line.withColumn("_cell", F.floor(F.col("_at") / bucket))
    frame = F.when(F.col("_frame") == 1, F.col("_at"))
    # frames sort before segments of the same time, so only later ones count
    behind = Window.partitionBy("stream_id", "_cell").orderBy(F.col("_at").desc(), F.col("_frame").asc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = line.withColumn("_here", F.min(frame).over(behind)).where("_frame = 0")
    later = Window.partitionBy("stream_id").orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    cells = line.groupBy("stream_id", "_cell").agg(F.min(frame).alias("_first")).withColumn("_next", F.min("_first").over(later)).drop("_first")
    closed = inside.join(cells, ["stream_id", "_cell"], "left").withColumn("close_ms", F.coalesce("_here", "_next"))
    closed = closed.select("stream_id", "segment_id", "last_ms", "close_ms", *(f.name for f in more))
    if spread:
        closed = ranked(closed.withColumn("_never", F.col("close_ms").isNull()), ["stream_id"], ["_never", "close_ms", "segment_id"], "close_rank").drop("_never")
    else:
        closed = closed.withColumn("close_rank", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("close_ms").asc_nulls_last(), "segment_id")))
    return closed.select("stream_id", "segment_id", "last_ms", "close_ms", "close_rank", *(f.name for f in more))
