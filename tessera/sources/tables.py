"""Sources: the given tables, observations derived from embeddings, and the sampling grid."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Media files as rows, picked by a glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def observations(spark: SparkSession, sf_dir: str, cfg: Config = Config()) -> DataFrame:
    """One observation per embedding, by integer arithmetic on its id. Streams hold 600 observations at most, so their number grows with the table."""
    v, at = "vec_id", "(vec_id % 3000)"
    e = table(spark, sf_dir, "embeddings").selectExpr(
        f"{v} AS obs_id", f"({v} div 3000) * 5 + {v} % 5 AS stream_id", f"{at} div 15 + 1 AS frame_index",
        f"({at} div 15) * 200 + ({at} div 105) * 1000 + ({at} div 315) * 1500 AS ts_ms",
        f"CAST(({v} * 37) % 950 AS DOUBLE) AS box_left", f"CAST(({v} * 53) % 1800 AS DOUBLE) AS box_top",
        f"CAST(20 + ({v} * 29) % 180 AS DOUBLE) AS face_w", f"CAST(20 + ({v} * 31) % 180 AS DOUBLE) AS face_h",
        "1080 AS frame_w", "1920 AS frame_h",
        f"CAST(({v} * 13) % 91 - 45 AS DOUBLE) AS pitch", f"CAST(({v} * 17) % 121 - 60 AS DOUBLE) AS yaw", f"CAST(({v} * 7) % 61 - 30 AS DOUBLE) AS roll",
        f"(({v} * 11) % 101) / 100D AS left_eye", f"(({v} * 23) % 101) / 100D AS right_eye",
        f"CASE WHEN {v} % 13 = 0 THEN -1D ELSE (({v} * 41) % 101) / 100D END AS smile",
        f"(({v} * 19) % 1000) / 10D AS sharpness", "embedding", "label",
    )
    e = e.withColumn("box_right", F.col("box_left") + F.col("face_w")).withColumn("box_bottom", F.col("box_top") + F.col("face_h"))
    e = e.withColumn("is_clipped", scoring.clipped(cfg))
    return e.withColumn("rep_score", scoring.representative_score(cfg)).withColumn("is_rep", scoring.representative_gate(cfg))


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in one process (tests) a fresh one will do."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: it is computed once, its lineage is cut, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def duration(text: Column) -> Column:
    """Milliseconds of a metadata string; 0 where it can't be read."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


def sample_grid(streams: DataFrame, cfg: Config = Config(), decoded: Column | None = None) -> DataFrame:
    """streams(stream_id, duration_ms) -> frames at 0, step, ... up to the duration; indexes count undecoded frames too."""
    at = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms"), F.lit(cfg.step_ms).cast("long"))).alias("pos", "ts_ms")
    frames = streams.where("duration_ms > 0").select("*", at).withColumn("frame_index", F.col("pos") + 1).drop("pos")
    return frames if decoded is None else frames.where(decoded)


def frame_estimate(cfg: Config = Config()) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.col("duration_ms") / cfg.step_ms) + 1)


def required_duration() -> Column:
    """The duration, or an error where the source is invalid."""
    return F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(F.raise_error(F.lit("invalid source: no duration")).cast("long"))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str) -> str:
    """Two-phase sink: the data are written as a new version in a pending folder of ``path``; once they are complete, one rename of a pointer file makes
    them the current version. Whatever fails before it leaves the last version as it was, and what was pending goes. Returns the version.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    jvm, _, fs = _files(spark, path)
    place = jvm.org.apache.hadoop.fs.Path
    before = current_version(spark, path)
    try:
        df.write.parquet(f"{path}/{version}")
        out = fs.create(place(f"{path}/_pending-{version}"), True)
        out.write(bytearray(version.encode()))
        out.close()
    except Exception:
        fs.delete(place(f"{path}/{version}"), True)
        raise
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(place(f"{path}/_pending-{version}")), fs.makeQualified(place(f"{path}/current.txt")), how)
    for status in fs.listStatus(place(path)):  # the version before stays for those that read it now
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(status.getPath(), True)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    _, at, fs = _files(spark, f"{path}/current.txt")
    if not fs.exists(at):
        return None
    return spark.read.text(f"{path}/current.txt").first()[0]


def published(spark: SparkSession, path: str) -> DataFrame:
    """What was published last."""
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"nothing has been published at {path}")
    return spark.read.parquet(f"{path}/{version}")
