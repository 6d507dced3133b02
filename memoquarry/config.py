"""Configuration: defaults, domain presets, files and environment overrides (IO17, IO28, IO29)."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Session:
    window_size: int = 8
    max_compressed_segments: int = 20


@dataclass(frozen=True)
class State:
    slot_count: int = 64
    slot_max_tokens: int = 300
    base_decay_rate: float = 0.95
    activation_boost: float = 1.5
    eviction_threshold: float = 0.05
    snapshot_interval: int = 50
    time_decay_enabled: bool = True
    time_decay_halflife: float = 3600.0
    weight_semantic: float = 0.6
    weight_activation: float = 0.15
    weight_recency: float = 0.15
    weight_importance: float = 0.1


@dataclass(frozen=True)
class Store:
    db_path: str = "memory"


@dataclass(frozen=True)
class Config:
    l1: Session = field(default_factory=Session)
    l2: State = field(default_factory=State)
    l3: Store = field(default_factory=Store)
    embedding_provider: str = "auto"
    compression_model: str = "auto"
    namespace: str = "default"


# Window, segments, slots, tokens, decay, eviction, snapshot interval, half-life and boost of each preset.
PRESETS = {
    "fiction": (10, 30, 128, 500, 0.995, 0.02, 20, 86400.0, 1.2),
    "finance": (8, 20, 128, 400, 0.99, 0.03, 15, 86400.0, 1.3),
    "legal": (8, 25, 128, 500, 0.995, 0.02, 15, 259200.0, 1.3),
    "medical": (10, 30, 256, 400, 0.999, 0.01, 10, 604800.0, 1.2),
    "sales": (6, 15, 64, 300, 0.95, 0.08, 30, 14400.0, 1.5),
}

#: Environment variable -> the field that it overrides.
ENVIRONMENT = {
    "MEMOQUARRY_DB": ("l3", "db_path"),
    "MEMOQUARRY_EMBEDDING": ("embedding_provider",),
    "MEMOQUARRY_COMPRESSION": ("compression_model",),
    "MEMOQUARRY_SLOTS": ("l2", "slot_count"),
    "MEMOQUARRY_DECAY_RATE": ("l2", "base_decay_rate"),
    "MEMOQUARRY_WINDOW_SIZE": ("l1", "window_size"),
}


def preset(name: str, db_path: str | None = None, **overrides) -> Config:
    """The configuration of a domain."""
    window, segments, slots, tokens, decay, eviction, interval, half, boost = PRESETS[name]
    state = State(slot_count=slots, slot_max_tokens=tokens, base_decay_rate=decay, eviction_threshold=eviction, snapshot_interval=interval, time_decay_halflife=half, activation_boost=boost)
    own = {"compression_model": "none", "namespace": name} | overrides
    return Config(Session(window, segments), state, Store(db_path or name), **own)


def from_dict(data: Mapping) -> Config:
    """Known keys only; the rest keep their defaults."""
    part = lambda kind, name: kind(**{f.name: data[name][f.name] for f in fields(kind) if f.name in data.get(name, {})})
    rest = {k: data[k] for k in ("embedding_provider", "compression_model", "namespace") if k in data}
    return Config(part(Session, "l1"), part(State, "l2"), part(Store, "l3"), **rest)


def to_dict(config: Config) -> dict:
    return asdict(config)


def with_environment(config: Config, environment: Mapping[str, str] | None = None) -> Config:
    environment = os.environ if environment is None else environment
    for variable, path in ENVIRONMENT.items():
        if (value := environment.get(variable)) is None:
            continue
        owner = config if len(path) == 1 else getattr(config, path[0])
        changed = replace(owner, **{path[-1]: type(getattr(owner, path[-1]))(value)})
        config = changed if len(path) == 1 else replace(config, **{path[0]: changed})
    return config


def load(path: str | Path | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """From a YAML file (JSON where YAML is not installed) and the environment; a file that is not there gives the defaults."""
    data = {}
    if path and Path(path).exists():
        text = Path(path).read_text(encoding="utf-8")
        try:
            import yaml

            data = yaml.safe_load(text) or {}
        except ImportError:
            data = json.loads(text)
    return with_environment(from_dict(data), environment)


def save(config: Config, path: str | Path) -> Path:
    """As JSON, which is YAML too."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(to_dict(config), ensure_ascii=False, indent=2), encoding="utf-8")
    return Path(path)
