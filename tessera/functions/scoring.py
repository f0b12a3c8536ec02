"""Scores and gates of an observation, as column expressions over the schema of sources.observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import vectors as V

c = F.col


def unit(x: Column) -> Column:
    return V.clamp(x, 0.0, 1.0)


def timestamp_seconds() -> Column:
    return c("ts_ms") / 1000


def visibility() -> Column:
    """Share of the box inside the frame; 1 where the frame's size is unknown."""
    width = F.least(c("box_right"), c("frame_w").cast("double")) - F.greatest(c("box_left"), F.lit(0.0))
    height = F.least(c("box_bottom"), c("frame_h").cast("double")) - F.greatest(c("box_top"), F.lit(0.0))
    inside = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    whole = F.greatest(F.lit(1.0), (c("box_right") - c("box_left")) * (c("box_bottom") - c("box_top")))
    return F.when((c("frame_w") <= 0) | (c("frame_h") <= 0), F.lit(1.0)).otherwise(unit(inside / whole))


def clipped(cfg: Config = Config()) -> Column:
    m = cfg.clip_margin
    edge = (c("box_left") <= m) | (c("box_top") <= m) | (c("box_right") >= c("frame_w") - m) | (c("box_bottom") >= c("frame_h") - m)
    return F.when((c("frame_w") <= 0) | (c("frame_h") <= 0), F.lit(True)).otherwise(edge)


def frontality() -> Column:
    return unit(1 - (0.4 * unit(F.abs(c("pitch")) / 30) + 0.4 * unit(F.abs(c("yaw")) / 35) + 0.2 * unit(F.abs(c("roll")) / 25)))


def eyes() -> Column:
    return unit((c("left_eye") + c("right_eye")) / 2)


def sharpness() -> Column:
    return unit(c("sharpness") / 80)


def expression() -> Column:
    return F.when(c("smile") >= 0, unit(c("smile"))).otherwise(0.5)


def size() -> Column:
    return V.clamp(c("face_w") / F.greatest(F.lit(1), c("frame_w")) / 0.35, 0.1, 1.0)


def whole() -> Column:
    return F.when(c("is_clipped"), 0.0).otherwise(1.0)


def filled(column: str, default: float) -> Column:
    return F.coalesce(c(column), F.lit(default))


def prefilter(cfg: Config = Config()) -> Column:
    return (c("face_w") >= cfg.min_side) & (c("face_h") >= cfg.min_side)


def identity_gate(cfg: Config = Config()) -> Column:
    return prefilter(cfg) & (c("sharpness") >= cfg.identity_sharpness) & V.valid(c("embedding"), cfg.dim)


def clearly_visible(cfg: Config = Config()) -> Column:
    return (c("face_w") >= cfg.rep_width) & ~c("is_clipped") & (c("sharpness") >= cfg.min_sharpness) & (F.abs(c("yaw")) <= cfg.max_yaw) & (F.abs(c("pitch")) <= cfg.max_pitch)


def representative_gate(cfg: Config = Config()) -> Column:
    sharp = c("sharpness") >= max(cfg.min_sharpness, cfg.motion_sharpness)
    shape = (c("face_w") >= cfg.rep_width) & (c("face_h") >= cfg.rep_height) & ~c("is_clipped") & (visibility() >= cfg.min_visibility)
    pose = (F.abs(c("yaw")) <= cfg.max_yaw) & (F.abs(c("pitch")) <= cfg.max_pitch) & ((c("left_eye") + c("right_eye")) / 2 >= cfg.min_eyes)
    return identity_gate(cfg) & sharp & shape & pose


def weighted(cfg: Config = Config()) -> Column:
    return unit(cfg.w_front * frontality() + cfg.w_sharp * sharpness() + cfg.w_eyes * eyes() + cfg.w_expression * expression() + cfg.w_size * size() + cfg.w_whole * whole())


def representative_score(cfg: Config = Config()) -> Column:
    return F.when(clearly_visible(cfg), weighted(cfg)).otherwise(0.0)


def representative_score_or_null(cfg: Config = Config()) -> Column:
    return F.when(clearly_visible(cfg), weighted(cfg))


def progress(index: Column, total: Column) -> Column:
    return V.clamp(0.05 + 0.80 * index / F.greatest(F.lit(1), total), 0.05, 0.85)
