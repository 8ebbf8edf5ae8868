"""Filter and oscillator coefficients: closed forms on the driver, tiny tables of fixed size for Spark."""

from __future__ import annotations

import math
import warnings
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import NonstandardSamplingRateWarning, UnstableFilterError

STANDARD_RATE_HZ = 100.0


# -- causal intensity filters ----------------------------------------------------------


@dataclass(frozen=True)
class Filter2008:
    """The original causal filter."""

    f0_hz: float = 0.45
    f1_hz: float = 7.0
    f2_hz: float = 11.0
    damping: float = 0.9
    gain: float = 1.409


@dataclass(frozen=True)
class Filter2012:
    """The improved causal filter."""

    f0_hz: float = 0.45
    f1_hz: float = 7.0
    correction_hz: float = 0.5
    lowpass_1_hz: float = 12.0
    lowpass_2_hz: float = 20.0
    lowpass_3_hz: float = 30.0
    correction_numerator_damping: float = 1.0
    correction_denominator_damping: float = 0.75
    lowpass_1_damping: float = 0.9
    lowpass_2_damping: float = 0.6
    lowpass_3_damping: float = 0.6
    gain: float = 1.262


#: Gammas of (correction, low-pass 1, 2, 3) from the lower bound of a rate on.
GAMMA_STEPS = (
    (80.0, (1 / 12, 1 / 12, 1 / 12, 1 / 12)),
    (70.0, (1 / 12, 1 / 12, 1 / 12, 1 / 8)),
    (60.0, (1 / 12, 1 / 12, 1 / 12, 1 / 6)),
    (50.0, (1 / 12, 1 / 12, 1 / 10, 1 / 4)),
    (40.0, (1 / 12, 1 / 12, 1 / 6, 1 / 4)),
    (30.0, (1 / 12, 1 / 10, 1 / 4, 1 / 4)),
    (5.0, (1 / 12, 1 / 4, 1 / 4, 1 / 4)),
    (1.0, (1 / 6, 1 / 4, 1 / 4, 1 / 4)),
)
#: Corner frequencies that the steps are valid for.
GAMMA_HZ = (0.5, 12.0, 20.0, 30.0)
FILTER_NAMES = {
    "auto": "auto", "kunugi2008": "kunugi2008", "2008": "kunugi2008", "original": "kunugi2008", "kunugi2012": "kunugi2012", "2012": "kunugi2012",
    "improved": "kunugi2012", "jp7681907lowrate": "jp7681907-lowrate", "jp7681907": "jp7681907-lowrate", "lowrate": "jp7681907-lowrate",
}


@dataclass(frozen=True)
class Gammas:
    """Numerator and denominator gammas of (correction, low-pass 1, 2, 3)."""

    numerator: tuple[float, float, float, float]
    denominator: tuple[float, float, float, float]

    @classmethod
    def equal(cls, *values: float) -> Gammas:
        return cls(tuple(values), tuple(values))


@dataclass(frozen=True)
class Design:
    """sections: rows (b0, b1, b2, 1, a1, a2); stages: (name, corner Hz or None, section)."""

    name: str
    rate: float
    sections: tuple[tuple[float, ...], ...]
    parameters: dict[str, float] = field(default_factory=dict)
    stages: tuple[tuple[str, float | None, tuple[float, ...]], ...] = ()

    @property
    def sos(self) -> np.ndarray:
        return np.array(self.sections)

    @property
    def max_pole_radius(self) -> float:
        return max(float(np.abs(np.roots(s[3:])).max()) for s in self.sections)

    @property
    def stability_margin(self) -> float:
        return 1.0 - self.max_pole_radius

    @property
    def nyquist_hz(self) -> float:
        return self.rate / 2

    @property
    def characteristic_frequencies_hz(self) -> tuple[float, ...]:
        return tuple(sorted({v for k, v in self.parameters.items() if k.endswith("_hz")}))


def _section(numerator: tuple[float, ...], denominator: tuple[float, ...]) -> tuple[float, ...]:
    lead = denominator[0]
    if not math.isfinite(lead) or lead == 0:
        raise ValueError("a filter section has no leading denominator")
    return tuple(x / lead for x in (*numerator, *denominator))


def _real_pole(a: float, b: float, hz: float, dt: float) -> tuple[float, ...]:
    """(a w + s) / (w + b s) under s -> 2 (z - 1) / (dt (z + 1))."""
    w, s = 2 * math.pi * hz, 2 / dt
    return _section((a * w + s, a * w - s, 0.0), (w + b * s, w - b * s, 0.0))


def _pair(p: tuple[float, ...], q: tuple[float, ...]) -> tuple[float, ...]:
    return (*np.convolve(p[:2], q[:2]), *np.convolve(p[3:5], q[3:5]))


def _quadratic(hz: float, damping: float, gamma: float, dt: float) -> tuple[float, float, float]:
    """s^2 + damping w s + w^2, times dt^2, by the generalised second integrator."""
    x = 2 * math.pi * hz * dt
    return 1 + damping * x + gamma * x * x, -2 + x * x * (1 - 2 * gamma), 1 - damping * x + gamma * x * x


def _constant(hz: float, gamma: float, dt: float) -> tuple[float, float, float]:
    x2 = (2 * math.pi * hz * dt) ** 2
    return gamma * x2, x2 * (1 - 2 * gamma), gamma * x2


def _scaled(section: tuple[float, ...], gain: float) -> tuple[float, ...]:
    return (*(gain * b for b in section[:3]), *section[3:])


def _gain_stage(gain: float) -> tuple[str, None, tuple[float, ...]]:
    return "gain", None, (gain, 0.0, 0.0, 1.0, 0.0, 0.0)


def _leading(f0: float, f1: float, dt: float) -> list[tuple[str, float, tuple[float, ...]]]:
    shapes = (("slow tilt", 0.0, 1.0, f0), ("shelf a", 1.0, 2.0, f1), ("shelf b", 4.0, 8.0, f1), ("shelf c", 0.25, 0.5, f1))
    return [(name, hz, _real_pole(a, b, hz, dt)) for name, a, b, hz in shapes]


def published_gammas(rate: float, policy: str = "piecewise") -> Gammas:
    """Gammas for a rate of 1 Hz or more: by steps of the rate, or 1/12 or 1/4 throughout."""
    if not math.isfinite(rate) or rate < 1:
        raise ValueError("the low-rate filter needs a finite rate of at least 1 Hz")
    fixed = {"constant-accurate": 1 / 12, "constant-stable": 1 / 4}
    if policy in fixed:
        return Gammas.equal(*[fixed[policy]] * 4)
    if policy != "piecewise":
        raise ValueError(f"unknown gamma policy {policy!r}")
    return Gammas.equal(*next(values for least, values in GAMMA_STEPS if rate >= least))


def _corners(p: Filter2012) -> tuple[float, float, float, float]:
    return p.correction_hz, p.lowpass_1_hz, p.lowpass_2_hz, p.lowpass_3_hz


def stability_lower_bounds(rate: float, parameters: Filter2012 | None = None) -> tuple[float, ...]:
    """Least stable denominator gamma of each stage: 1/4 - 1 / (2 pi f dt)^2."""
    if not math.isfinite(rate) or rate <= 0:
        raise ValueError("the rate must be finite and greater than zero")
    return tuple(0.25 - 1 / (2 * math.pi * hz / rate) ** 2 for hz in _corners(parameters or Filter2012()))


def stability_margins(rate: float, gammas: Gammas, parameters: Filter2012 | None = None) -> tuple[float, ...]:
    return tuple(g - b for g, b in zip(gammas.denominator, stability_lower_bounds(rate, parameters), strict=True))


def design_realtime_filter(
    rate: float = STANDARD_RATE_HZ,
    filter_name: str = "auto",
    parameters: Filter2008 | Filter2012 | None = None,
    gamma_policy: str = "piecewise",
    gammas: Gammas | None = None,
    check_stability: bool = True,
    tolerance: float = 1e-12,
) -> Design:
    """The causal intensity filter of a rate: ``auto`` takes the 2012 design from 80 Hz on, else the low-rate one."""
    if not math.isfinite(rate) or rate <= 0:
        raise ValueError("the rate must be finite and greater than zero")
    name = FILTER_NAMES.get(filter_name.lower().replace("_", "").replace("-", "").replace(" ", ""))
    if name is None:
        raise ValueError(f"unknown filter {filter_name!r}")
    if name == "auto":
        name = "kunugi2012" if rate >= 80 else "jp7681907-lowrate"
    kind = Filter2008 if name == "kunugi2008" else Filter2012
    p = parameters or kind()
    if not isinstance(p, kind):
        raise TypeError(f"{name} takes {kind.__name__}")
    if gammas is not None and name != "jp7681907-lowrate":
        raise ValueError("gammas belong to the low-rate filter")
    for key, value in asdict(p).items():
        if not math.isfinite(value) or value <= 0:
            raise ValueError(f"{key} must be finite and greater than zero")
    dt = 1 / rate
    lead = _leading(p.f0_hz, p.f1_hz, dt)
    if isinstance(p, Filter2008):
        rest = [("high-cut", p.f2_hz, _section(_constant(p.f2_hz, 1 / 12, dt), _quadratic(p.f2_hz, p.damping, 1 / 12, dt)))]
    else:
        if name == "kunugi2012":
            g = Gammas.equal(*[1 / 12] * 4)
        elif gammas is not None:
            g = gammas
        else:
            if gamma_policy == "piecewise" and _corners(p) != GAMMA_HZ:
                raise ValueError("the piecewise gammas are for corner frequencies of 0.5, 12, 20 and 30 Hz; give gammas")
            g = published_gammas(rate, gamma_policy)
        if any(not math.isfinite(x) or x <= 0 for x in (*g.numerator, *g.denominator)):
            raise ValueError("gammas must be finite and greater than zero")
        (n0, *n), (d0, *d) = g.numerator, g.denominator
        fix = _section(_quadratic(p.correction_hz, p.correction_numerator_damping, n0, dt), _quadratic(p.correction_hz, p.correction_denominator_damping, d0, dt))
        rest = [("correction", p.correction_hz, fix)]
        lows = ((p.lowpass_1_hz, p.lowpass_1_damping), (p.lowpass_2_hz, p.lowpass_2_damping), (p.lowpass_3_hz, p.lowpass_3_damping))
        rest += [(f"low-pass {k + 1}", hz, _section(_constant(hz, n[k], dt), _quadratic(hz, h, d[k], dt))) for k, (hz, h) in enumerate(lows)]
    sections = [_scaled(_pair(lead[0][2], lead[1][2]), p.gain), _pair(lead[2][2], lead[3][2]), *(s for _, _, s in rest)]
    design = Design(name, float(rate), tuple(tuple(map(float, s)) for s in sections), asdict(p), (*lead, *rest, _gain_stage(p.gain)))
    if check_stability and design.max_pole_radius >= 1 - tolerance:
        raise UnstableFilterError(f"{name} at {rate:g} Hz has a pole of radius {design.max_pole_radius:.12g}")
    return design


def warn_corners(design: Design) -> None:
    above = [hz for hz in design.characteristic_frequencies_hz if hz >= design.nyquist_hz]
    if above:
        warnings.warn(f"corner frequencies {above} reach Nyquist ({design.nyquist_hz:g} Hz)", NonstandardSamplingRateWarning, stacklevel=3)


# -- long-period high-pass and seismometer filters -------------------------------------

#: The 20-second high-pass at 100 Hz, and the prototype behind it for other rates.
HIGH_PASS_NUMERATOR = (1.0, -2.0, 1.0)
HIGH_PASS_DENOMINATOR = (1.0, -1.995438545842, 0.995448925627)
HIGH_PASS_GAIN = 0.997721867867
HIGH_PASS_OMEGA = 0.322544346015
#: The published velocity and displacement filters, for 100 Hz only.
VELOCITY_FILTER = (tuple(0.004937561699 * c for c in (1.0, -1.0, -1.0, 1.0)), (1.0, -2.974867761716, 2.950050339269, -0.975180618018))
DISPLACEMENT_FILTER = ((0.00002485615736514583, 0.00004971231473029166, 0.00002485615736514583), (1.0, -1.988438073558305, 0.9885471048650272))


def design_high_pass(rate: float = STANDARD_RATE_HZ) -> tuple[tuple[float, ...], tuple[float, ...], float]:
    """Numerator, denominator and gain; rates other than 100 Hz take the matched-z image of the prototype, with gain one at Nyquist."""
    if not math.isfinite(rate) or rate <= 0:
        raise ValueError("the rate must be finite and greater than zero")
    if rate == STANDARD_RATE_HZ:
        return HIGH_PASS_NUMERATOR, HIGH_PASS_DENOMINATOR, HIGH_PASS_GAIN
    decay = HIGH_PASS_OMEGA / math.sqrt(2) / rate
    denominator = (1.0, -2 * math.exp(-decay) * math.cos(decay), math.exp(-2 * decay))
    return HIGH_PASS_NUMERATOR, denominator, (denominator[0] - denominator[1] + denominator[2]) / 4


# -- oscillators -----------------------------------------------------------------------

LONG_PERIODS_S = tuple(d / 10 for d in range(16, 79, 2))
LONG_DAMPING = 0.05
SI_LOWER_S, SI_UPPER_S, SI_WIDTH_S, SI_DAMPING, SI_COUNT = 0.1, 2.5, 2.4, 0.20, 121


def spectrum_periods(count: int = SI_COUNT) -> tuple[float, ...]:
    return tuple(np.linspace(SI_LOWER_S, SI_UPPER_S, count).tolist())


@dataclass(frozen=True)
class Bank:
    """x[n+1] = A x[n] + B0 u[n] + B1 u[n+1] for x = (displacement, velocity), exact for linear ground acceleration."""

    periods: np.ndarray
    damping: float
    rate: float
    a: np.ndarray  # (periods, 2, 2)
    b0: np.ndarray  # (periods, 2)
    b1: np.ndarray


def oscillator_bank(periods, damping: float, rate: float) -> Bank:
    """From the free response E(t): A = E(dt), and the step's particular solution for a linear input."""
    t = np.asarray(periods, float)
    if t.ndim != 1 or not t.size or not np.isfinite(t).all() or (t <= 0).any():
        raise ValueError("periods must be finite and greater than zero")
    if not 0 < damping < 1:
        raise ValueError("the damping ratio must lie between zero and one")
    dt, w = 1 / float(rate), 2 * np.pi / t
    wd, e = w * np.sqrt(1 - damping**2), np.exp(-damping * w * dt)
    c, s = e * np.cos(wd * dt), e * np.sin(wd * dt) / wd
    a = np.stack([np.stack([c + damping * w * s, s], -1), np.stack([-w * w * s, c - damping * w * s], -1)], -2)
    # Under u(t) = u0 + r t a particular motion is d = -(u0 + r t) / w^2 + 2 h r / w^3, v = -r / w^2.
    unit = np.zeros((len(t), 2, 2))
    for k, (u0, r) in enumerate(((1.0, -1 / dt), (0.0, 1 / dt))):
        start = np.stack([-u0 / w**2 + 2 * damping * r / w**3, -r / w**2 + 0 * w], -1)
        end = np.stack([-(u0 + r * dt) / w**2 + 2 * damping * r / w**3, -r / w**2 + 0 * w], -1)
        unit[:, :, k] = end - np.einsum("pij,pj->pi", a, start)
    return Bank(t, float(damping), float(rate), a, unit[:, :, 0], unit[:, :, 1])


def transfer_functions(bank: Bank) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numerators of velocity and displacement and the shared denominator of each period's recursion."""
    (a11, a12), (a21, a22) = np.moveaxis(bank.a, 0, -1)
    (b11, b21), (b12, b22) = bank.b0.T, bank.b1.T
    velocity = np.stack([b22, b21 - a11 * b22 + a21 * b12, a21 * b11 - a11 * b21], -1)
    displacement = np.stack([b12, b11 - a22 * b12 + a12 * b22, a12 * b21 - a22 * b11], -1)
    return velocity, displacement, np.stack([np.ones_like(a11), -(a11 + a22), a11 * a22 - a12 * a21], -1)


# -- tables ----------------------------------------------------------------------------


def section_table(spark: SparkSession, design: Design) -> DataFrame:
    rows = [(design.name, design.rate, k, *s) for k, s in enumerate(design.sections)]
    return spark.createDataFrame(rows, "design string, rate double, section int, b0 double, b1 double, b2 double, a0 double, a1 double, a2 double")


def stage_table(spark: SparkSession, design: Design) -> DataFrame:
    rows = [(design.name, k, n, hz, *s) for k, (n, hz, s) in enumerate(design.stages)]
    return spark.createDataFrame(rows, "design string, stage int, name string, frequency_hz double, b0 double, b1 double, b2 double, a0 double, a1 double, a2 double")


def oscillator_table(spark: SparkSession, bank: Bank) -> DataFrame:
    rows = [(float(t), bank.damping, bank.rate, *map(float, (*a.ravel(), *b0, *b1))) for t, a, b0, b1 in zip(bank.periods, bank.a, bank.b0, bank.b1, strict=True)]
    names = "a11 a12 a21 a22 b11 b21 b12 b22".split()
    return spark.createDataFrame(rows, "period_s double, damping double, rate double, " + ", ".join(f"{n} double" for n in names))
