"""Parameters of the jobs, with the checks that concern parameters alone."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CodeScheme:
    """Meaning of the digits A, B, C of a three-digit event code."""

    # fixed values: the code scheme that recordings use
    practice: tuple[int, ...] = (8, 9)
    full: tuple[int, ...] = (1, 2, 9)
    reduced: tuple[int, ...] = (3, 4, 8)
    first_is_standard: tuple[int, ...] = (1, 3)
    second_is_standard: tuple[int, ...] = (2, 4)
    true_digit: int = 1
    buffer_digit: int = 0
    standard_digit: int = 0
    deviant_digit: int = 1


@dataclass(frozen=True)
class Contrast:
    """Codes of the two conditions, and those kept at all."""

    standard: tuple[int, ...]
    deviant: tuple[int, ...]
    keep: tuple[int, ...] = ()

    def __post_init__(self):
        if not self.standard or not self.deviant:
            raise ValueError("both conditions need at least one code")
        if set(self.standard) & set(self.deviant):
            raise ValueError("a code can't be standard and deviant")
        if self.keep and not set(self.standard) | set(self.deviant) <= set(self.keep):
            raise ValueError("standard and deviant codes must be among the kept codes")


@dataclass(frozen=True)
class Window:
    """A measurement window in seconds, bounds included."""

    name: str = "MMN_150_250"
    tmin: float = 0.15
    tmax: float = 0.25

    def __post_init__(self):
        if not self.name or not self.tmin < self.tmax:
            raise ValueError("a window needs a name and tmin < tmax")


@dataclass(frozen=True)
class Rejection:
    """Artifact limits; ptp and voltages in microvolts, times in ms or s."""

    ptp: float = 75.0
    width_ms: float = 200.0
    step_ms: float = 10.0
    positive: float = 150.0
    negative: float = -150.0
    tmin: float = -0.2
    tmax: float = 0.3

    def __post_init__(self):
        if self.ptp <= 0 or self.width_ms <= 0 or self.step_ms <= 0 or self.tmin >= self.tmax:
            raise ValueError("limits and widths must be positive, tmin < tmax")


@dataclass(frozen=True)
class Tfr:
    """Time-frequency grid."""

    fmin: float = 1.0
    fmax: float = 30.0
    fstep: float = 1.0
    cycles_divisor: float = 10.0
    baseline: tuple[float, float] | None = (-0.1, 0.0)
    mode: str = "logratio"
    decim: int = 1
    method: str = "multitaper"

    def __post_init__(self):
        if self.method not in ("multitaper", "morlet"):
            raise ValueError(f"unknown method {self.method}")
        if not 0 < self.fmin <= self.fmax or self.fstep <= 0 or self.cycles_divisor <= 0:
            raise ValueError("0 < fmin <= fmax, and a positive step and divisor")
        if self.baseline is not None and len(self.baseline) != 2:
            raise ValueError("a baseline has two ends")
        if self.decim < 1:
            raise ValueError("every decim-th sample is kept, so decim is at least 1")
        if self.mode not in ("mean", "ratio", "logratio", "percent", "zscore", "zlogratio"):
            raise ValueError(f"unknown baseline mode {self.mode}")

    @property
    def freqs(self) -> list[float]:
        """fmin, fmin + fstep, ... up to fmax; counted in whole steps, so rounding never adds one."""
        return [self.fmin + i * self.fstep for i in range(int((self.fmax - self.fmin) / self.fstep + 1e-9) + 1)]


@dataclass(frozen=True)
class Ica:
    """Component fit and removal; ``components`` is a number of components, else ``variance`` decides."""

    mode: str = "auto"
    gate_per_min: float = 15.0
    high_pass: float = 1.0
    low_pass: float | None = None
    decimate: int = 3
    variance: float = 0.99
    iterations: int = 512
    seed: int = 97
    threshold: float = 0.30
    most: int = 3
    components: int | None = None
    tolerance: float = 1e-4
    outlier_z: float = 3.0
    outlier_rounds: int = 2
    eog_band: tuple[float, float] = (1.0, 10.0)

    def __post_init__(self):
        if not 0 < self.variance <= 1 or self.decimate < 1 or self.iterations < 1 or self.most < 0 or self.tolerance <= 0:
            raise ValueError("0 < variance <= 1, decimate and iterations from 1 on, a positive tolerance")
        if self.components is not None and self.components < 1:
            raise ValueError("at least one component is fitted")
        if self.mode not in ("off", "on", "auto"):
            raise ValueError("ica is off, on or auto")
