"""Parameters of the engine: frozen dataclasses whose `validate` names the field that is out of range."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

EPSILON = 1e-9


class _Checked:
    #: field -> (least, most), both allowed
    RANGES: dict[str, tuple[float, float]] = {}

    def validate(self):
        for name, (least, most) in self.RANGES.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{type(self).__name__}.{name} must lie in {least}..{most}")
        for f in fields(self):
            if is_dataclass(getattr(self, f.name)):
                getattr(self, f.name).validate()
        return self


@dataclass(frozen=True)
class Pursuit(_Checked):
    alpha: float = 0.1
    gamma: float = 0.05
    theta: float = 0.001
    max_iterations: int = 10
    refit: bool = False
    gamma_global: float = 1e-3
    RANGES = {"alpha": (0, 100), "gamma": (0, 100), "theta": (0, 100), "max_iterations": (0, 1000)}


@dataclass(frozen=True)
class Noise(_Checked):
    min_block: int = 8
    max_block: int = 64
    scales: int = 3
    refine: int = 2
    fixed_sigma: float | None = None
    RANGES = {"min_block": (4, 1 << 20), "max_block": (4, 1 << 20), "scales": (1, 3), "refine": (0, 10)}


@dataclass(frozen=True)
class Frequency(_Checked):
    enable: bool = False
    points: int = 50
    refine: int = 5
    low: float = 0.01
    high: float = 0.49
    inertia: float = 0.5
    RANGES = {"points": (2, 100_000), "refine": (0, 100), "low": (0, 10), "high": (0, 10), "inertia": (0, 1)}


@dataclass(frozen=True)
class Learning(_Checked):
    enable: bool = False
    iterations: int = 100
    rate: float = 0.1
    decay: float = 0.001
    hop: int = 64
    atoms_per_frame: int = 10
    sigma: float = 1e-5
    tolerance: float = 1e-6
    sum_repeats: bool = True
    RANGES = {"iterations": (1, 100_000), "rate": (0, 10), "atoms_per_frame": (1, 1000), "hop": (1, 1 << 20)}


@dataclass(frozen=True)
class Basis(_Checked):
    enable: bool = True
    poly: int = 10
    harm: int = 10
    morlet: int = 10
    frequency: float = 1.0
    legendre: bool = False
    RANGES = {"poly": (0, 300), "harm": (0, 300), "morlet": (0, 300)}


@dataclass(frozen=True)
class Bars(_Checked):
    threshold: float = 5000.0
    dollar: bool = False
    max_bars: int = 0
    sanitizer: bool = True
    max_spike: float = 0.05
    adaptive: bool = True
    ewma: float = 0.005
    least: float = 100.0
    most: float = 100_000.0
    #: accepted for compatibility; it changes nothing
    min_tick: float = 0.0
    RANGES = {"threshold": (1e-300, 1e300), "max_spike": (0, 1e9), "ewma": (0, 1), "max_bars": (0, 1 << 40)}


@dataclass(frozen=True)
class Detrend(_Checked):
    enable: bool = False
    max_segments: int = 10
    min_length: int = 32
    bic: float = 2.0
    forgetting: float = 0.99
    max_order: int = 2
    huber_iterations: int = 5
    huber: float = 1.345
    stitch: float = 2.0
    causal: bool = False
    RANGES = {"max_segments": (1, 10_000), "min_length": (4, 1 << 20), "max_order": (0, 5), "forgetting": (1e-6, 1)}


@dataclass(frozen=True)
class Config(_Checked):
    frame_size: int = 1024
    hop: int = 512
    pursuit: Pursuit = field(default_factory=Pursuit)
    noise: Noise = field(default_factory=Noise)
    frequency: Frequency = field(default_factory=Frequency)
    learning: Learning = field(default_factory=Learning)
    basis: Basis = field(default_factory=Basis)
    bars: Bars = field(default_factory=Bars)
    detrend: Detrend = field(default_factory=Detrend)
    RANGES = {"frame_size": (2, 1 << 24), "hop": (1, 1 << 24)}
