"""Whole plans: observations to identities and the summary of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import scoring
from tessera.operators.tracking import entities, track


def frame_line(obs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All frames of each stream: the sampling grid up to its end, and every observed time."""
    last = obs.groupBy("stream_id").agg(F.max("ts_ms").alias("end_ms"))
    grid = last.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end_ms").cast("long"), F.lit(cfg.step_ms).cast("long"))).alias("ts_ms"))
    return grid.unionByName(obs.select("stream_id", F.col("ts_ms").cast("long").alias("ts_ms"))).distinct()


def cluster_entities(obs: DataFrame, cfg: Config = Config(), frames: DataFrame | None = None) -> DataFrame:
    """Track, order by closing, cluster, merge: one row per identity."""
    return entities(track(obs, cfg), frame_line(obs, cfg) if frames is None else frames, cfg)


def run_summary(obs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per stream: frames, observations, those usable for identity, span in seconds."""
    return obs.groupBy("stream_id").agg(F.countDistinct("ts_ms").alias("n_frames"), F.count("*").alias("n_obs"), F.count_if(scoring.identity_gate(cfg)).alias("n_usable"), F.round((F.max("ts_ms") - F.min("ts_ms")) / 1000, 6).alias("duration_s"))


def run_report(obs: DataFrame, identities: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The summary of each stream with the number of its identities; 0 where none was found."""
    found = identities.groupBy("stream_id").agg(F.count("*").alias("n_identities"))
    return run_summary(obs, cfg).join(found, "stream_id", "left").withColumn("n_identities", F.coalesce("n_identities", F.lit(0)))


def shown(identities: DataFrame) -> DataFrame:
    """Identities with observations; where a stream has none such, all of its identities."""
    some = F.max((F.col("n_obs") > 0).cast("int")).over(Window.partitionBy("stream_id"))
    return identities.withColumn("_some", some).where((F.col("n_obs") > 0) | (F.col("_some") == 0)).drop("_some")


def required(report: DataFrame) -> DataFrame:
    """The report, or an error on a stream without identities."""
    return report.withColumn("n_identities", F.when(F.col("n_identities") > 0, F.col("n_identities")).otherwise(F.raise_error(F.concat(F.lit("no identities in stream "), F.col("stream_id").cast("string"))).cast("long")))
