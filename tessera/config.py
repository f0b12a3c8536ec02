"""Thresholds of the observation engine, all of them parameters."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults that results must agree on.
    similarity: float = 0.55
    target_fps: int = 5
    min_side: float = 38.0
    gap_ms: int = 1200
    rep_width: float = 48.0
    rep_height: float = 48.0
    min_visibility: float = 0.90
    max_yaw: float = 50.0
    max_pitch: float = 40.0
    min_sharpness: float = 5.0
    motion_sharpness: float = 2.0
    identity_sharpness: float = 1.5
    min_eyes: float = 0.20
    clip_margin: float = 4.0
    w_front: float = 0.25
    w_sharp: float = 0.25
    w_eyes: float = 0.20
    w_expression: float = 0.15
    w_size: float = 0.10
    w_whole: float = 0.05
    weight_floor: float = 0.1
    dim: int = 192

    @property
    def step_ms(self) -> int:
        return 1000 // self.target_fps
