"""Settings as validated records, read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Data:
    # The classes, in the order of their numbers.
    labels: tuple[str, ...] = ("feeding", "estrus", "panting", "scream", "grunt")
    segment_sec: float = 2.0
    sr: int = 16000

    @property
    def samples(self) -> int:
        return int(self.segment_sec * self.sr)


@dataclass(frozen=True)
class Preprocess:
    denoise: bool = True
    vad: bool = False
    noise_sec: float = 0.2
    alpha: float = 1.0
    crop: str = "center"


@dataclass(frozen=True)
class Features:
    n_mfcc: int = 26
    n_mels: int = 64
    n_gfcc: int = 32
    n_filters: int = 64
    fmin: float = 50
    fmax: float = 8000
    hop: int = 160
    win: int = 400
    n_fft: int = 2048
    delta: bool = True
    delta_delta: bool = False
    lpcc: bool = False
    lpc_order: int = 16
    n_lpcc: int = 20

    @property
    def coefficients(self) -> int:
        return self.n_mfcc + self.n_gfcc + (self.n_lpcc if self.lpcc else 0)

    @property
    def dim(self) -> int:
        return self.coefficients * (1 + self.delta + self.delta_delta)


@dataclass(frozen=True)
class Train:
    seed: int = 3407
    batch_size: int = 32
    workers: int = 2
    epochs: int = 20
    lr: float = 1e-3
    weight_decay: float = 1e-4
    grad_clip: float = 5.0
    #: When workers come together: after each epoch (means of their models) or each step (sums of their gradients).
    together: str = "epoch"


@dataclass(frozen=True)
class Model:
    hidden_size: int = 128
    num_layers: int = 2
    dropout: float = 0.2


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    preprocess: Preprocess = field(default_factory=Preprocess)
    features: Features = field(default_factory=Features)
    train: Train = field(default_factory=Train)
    model: Model = field(default_factory=Model)


def from_dict(raw: dict[str, Any] | None) -> Config:
    """A Config of nested sections; unknown sections and keys are errors, missing ones take defaults."""
    raw = raw or {}
    kinds = {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    if extra := set(raw) - set(kinds):
        raise ValueError(f"unknown sections: {sorted(extra)}")
    parts = {}
    for name, kind in kinds.items():
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in (raw.get(name) or {}).items()}
        if extra := set(own) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown settings in {name}: {sorted(extra)}")
        parts[name] = kind(**own)
    if parts["preprocess"].crop not in ("head", "center", "random"):
        raise ValueError("crop must be head, center or random")
    if parts["train"].together not in ("epoch", "step"):
        raise ValueError("together must be epoch or step")
    return Config(**parts)


def read_config(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f))


def load_config(spark: SparkSession, path: str) -> Config:
    """The same from any file system that Spark reads; a folder of one text file too."""
    import yaml

    return from_dict(yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]))
