"""Thresholds, with defaults; YAML below environment variables overrides them.

Variables are named ``TRAJECTA__SECTION__FIELD``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Association:
    min_cosine: float = 0.7
    max_gap: float = 3.0
    stationary_variance: float = 5.0
    stationary_iou: float = 0.3
    max_error: float = 2.5
    velocity_window: int = 3
    weights: tuple = (0.5, 0.3, 0.2)


@dataclass(frozen=True)
class Linking:
    min_cosine: float = 0.75
    max_gap: float = 5.0
    max_error: float = 3.0
    velocity_window: int = 3
    clip_distance: int = 1
    weights: tuple = (0.4, 0.3, 0.3)


@dataclass(frozen=True)
class Voting:
    min_margin: float = 0.15
    min_evidence: int = 3
    retry_weight: float = 0.6
    floor: float = 1e-6
    boost: float = 0.1
    penalty: float = 0.2


@dataclass(frozen=True)
class Crops:
    caption_size: float = 96.0
    shot_size: float = 128.0
    reference_sharpness: float = 200.0
    sharpness_cap: float = 500.0
    view_weight: float = 0.5
    front_aspect: float = 1.2
    side_aspect: float = 2.2


@dataclass(frozen=True)
class Events:
    stop_speed: float = 5.0
    stop_seconds: float = 2.0
    moving_speed: float = 8.0
    turn_degrees: float = 45.0
    turn_window: tuple = (0.5, 8.0)
    lane_pixels: float = 40.0
    lane_degrees: float = 20.0
    lane_window: tuple = (0.5, 6.0)
    overtake_degrees: float = 30.0
    overtake_pixels: float = 15.0
    overtake_seconds: float = 1.0
    evidence_frames: int = 5


@dataclass(frozen=True)
class Retrieval:
    k: int = 5
    candidates: int = 20
    graph_limit: int = 50
    widen: int = 2
    rrf_k: int = 60
    widen: int = 2
    weights: tuple = (0.5, 0.35, 0.15)
    context_objects: int = 8
    context_events: int = 5


@dataclass(frozen=True)
class Settings:
    association: Association = field(default_factory=Association)
    linking: Linking = field(default_factory=Linking)
    voting: Voting = field(default_factory=Voting)
    crops: Crops = field(default_factory=Crops)
    events: Events = field(default_factory=Events)
    retrieval: Retrieval = field(default_factory=Retrieval)


def _cast(old, new):
    if isinstance(old, tuple):
        parts = new if isinstance(new, list | tuple) else str(new).split(",")
        return tuple(type(o)(p) for o, p in zip(old, parts, strict=True))
    return type(old)(new)


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Defaults, then the YAML file, then the environment."""
    given: dict[str, dict] = {}
    if path:
        import yaml

        with open(path) as f:
            given = yaml.safe_load(f) or {}
    settings = Settings()
    for section in fields(Settings):
        part = getattr(settings, section.name)
        changes = {}
        for f in fields(part):
            name = f"TRAJECTA__{section.name}__{f.name}".upper()
            value = (os.environ if env is None else env).get(name, given.get(section.name, {}).get(f.name))
            if value is not None:
                changes[f.name] = _cast(getattr(part, f.name), value)
        settings = replace(settings, **{section.name: replace(part, **changes)})
    return settings
