"""Small numpy kernels for one record: recursive filters by blocks, rolling ranks, FFT, resampling.

A recursive filter runs in state-space form over blocks of samples: within a block its
output is a matrix times the block plus a matrix times the state, so that Python loops
over blocks, not samples, and over all channels and all periods of a bank at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from fractions import Fraction

import numpy as np

from ..functions.response import HIGH_CUT, LOW_CUT_HZ
from .design import Bank

BLOCK = 64


class BlockFilter:
    """s[n+1] = A s[n] + B u[n], y[n] = C s[n] + D u[n], for a leading axis of filters."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, block: int = BLOCK):
        filters, order = b.shape
        powers = np.empty((block + 1, filters, order, order))
        powers[0] = np.eye(order)
        for k in range(block):
            powers[k + 1] = powers[k] @ a
        self.block, self.powers, self.a, self.b, self.c, self.d = block, powers, a, b, c, d
        self.observe = np.einsum("fo,kfop->fkp", c, powers[:block])
        impulse = np.concatenate([d[:, None], np.einsum("fo,kfop,fp->fk", c, powers[: block - 1], b)], axis=1)
        lag = np.subtract.outer(np.arange(block), np.arange(block))
        self.toeplitz = np.where(lag >= 0, impulse[:, np.maximum(lag, 0)], 0.0)
        self.reach = np.einsum("kfop,fp->fok", powers[block - 1 :: -1], b) if block > 1 else b[:, :, None]

    def run(self, u: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first sample, outputs (filters, samples, channels)) by block; state (filters, order, channels) advances in place."""
        for at in range(0, len(u), self.block):
            x = u[at : at + self.block]
            n = len(x)
            yield at, self.observe[:, :n] @ state + self.toeplitz[:, :n, :n] @ x
            state[:] = self.powers[n] @ state + self.reach[:, :, self.block - n :] @ x


def direct_form(numerator, denominator) -> BlockFilter:
    """One filter of any order in transposed direct form II."""
    b, a = np.asarray(numerator, float) / denominator[0], np.asarray(denominator, float) / denominator[0]
    order = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, order + 1 - len(b))), np.pad(a, (0, order + 1 - len(a)))
    step = np.eye(order, k=1)
    step[:, 0] -= a[1:]
    return BlockFilter(step[None], (b[1:] - a[1:] * b[0])[None], np.eye(order)[:1], np.array([b[0]]))


def filter_series(filters: list[BlockFilter], x: np.ndarray, states: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """A cascade over (samples, channels); returns the output and the states to go on from."""
    states = [np.zeros((1, f.b.shape[1], x.shape[1])) for f in filters] if states is None else [s.copy() for s in states]
    y = np.ascontiguousarray(x, float)
    for f, state in zip(filters, states, strict=True):
        y = np.concatenate([part[0] for _, part in f.run(y, state)]) if len(y) else y
    return y, states


def cascade(sos: np.ndarray) -> list[BlockFilter]:
    return [direct_form(s[:3], s[3:]) for s in sos]


class BankFilter:
    """All oscillators of a bank at once; outputs (2, periods, samples, channels): displacement and velocity.

    With w[n] = x[n] - B1 u[n] the step becomes w[n+1] = A w[n] + (A B1 + B0) u[n].  The
    first sample has displacement 0 and velocity -u dt.
    """

    def __init__(self, bank: Bank):
        b = np.einsum("pij,pj->pi", bank.a, bank.b1) + bank.b0
        n = len(bank.periods)
        two = np.repeat(np.eye(2), n, axis=0)  # displacement for all periods, then velocity
        self.bank, self.count = bank, n
        self.filter = BlockFilter(np.tile(bank.a, (2, 1, 1)), np.tile(b, (2, 1)), two, np.concatenate([bank.b1[:, 0], bank.b1[:, 1]]))

    def start(self, first: np.ndarray) -> np.ndarray:
        x = np.zeros((self.count, 2, len(first)))
        x[:, 1] = -first / self.bank.rate
        return np.tile(x - self.bank.b1[:, :, None] * first, (2, 1, 1))

    def run(self, u: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at, y in self.filter.run(u, state):
            yield at, y.reshape(2, self.count, *y.shape[1:])


def measured_gain(f: np.ndarray) -> np.ndarray:
    """Gain of the intensity filter at frequencies in Hz, 0 at 0."""
    shape = np.polyval(HIGH_CUT[::-1], (f / 10) ** 2)
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.sqrt(-np.expm1(-((f / LOW_CUT_HZ) ** 3)) / np.where(f > 0, f, 1) / shape), 0.0)


def measured_filter(x: np.ndarray, rate: float) -> np.ndarray:
    """The intensity filter in the frequency domain, over the record as it is (no padding)."""
    n = len(x)
    gain = measured_gain(np.fft.rfftfreq(n, 1 / rate))
    return np.fft.irfft(np.fft.rfft(x, axis=0) * gain[:, None], n=n, axis=0)


class RollingRank:
    """The k-th largest of the latest ``window`` values, kept as a sorted list; undefined until k values came.

    NaN stands for a missing value: it takes a place in the window, but has no rank.
    """

    def __init__(self, window: int, k: int, latest: list[float] | None = None):
        if not 1 <= k <= window:
            raise ValueError("k must lie between one and the window")
        self.window, self.k = window, k
        self.latest: deque[float] = deque(latest or [], maxlen=None)
        self.ordered = sorted(v for v in self.latest if v == v)

    def update(self, value: float) -> float | None:
        if len(self.latest) == self.window:
            oldest = self.latest.popleft()
            if oldest == oldest:
                del self.ordered[bisect_left(self.ordered, oldest)]
        self.latest.append(value)
        if value == value:
            insort(self.ordered, value)
        return self.threshold

    @property
    def ready(self) -> bool:
        return len(self.ordered) >= self.k

    @property
    def threshold(self) -> float | None:
        return self.ordered[-self.k] if self.ready else None

    def clear(self) -> None:
        self.latest.clear()
        self.ordered.clear()

    def __len__(self) -> int:
        return len(self.latest)


def rolling_rank(values: np.ndarray, window: int, k: int) -> np.ndarray:
    """The k-th largest of the latest ``window`` values at each place, NaN until k came; a NaN takes a place, but has no rank.

    A wavelet matrix over the ranks of the values: each bit of a rank keeps, in the order of
    the bits above, how many zeros came before a place, and all windows descend together.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between one and the window")
    values = np.asarray(values, float)
    n = len(values)
    if not n:
        return np.zeros(0)
    known = ~np.isnan(values)
    order = np.argsort(np.where(known, values, -np.inf), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    if not known.all():  # missing values below all others
        order = np.concatenate([np.flatnonzero(~known), order[known[order]]])
        rank[order] = np.arange(n)
    right = np.arange(1, n + 1)
    left = np.maximum(right - window, 0)
    came = np.concatenate(([0], np.cumsum(known)))
    ready = came[right] - came[left] >= k
    left, right, want = left[ready], right[ready], np.full(int(ready.sum()), k - 1)
    found = np.zeros(len(left), np.int64)
    row = rank
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        one = (row >> bit) & 1
        ones = np.concatenate(([0], np.cumsum(one)))
        a, b = ones[left], ones[right]
        up = want < b - a  # the rank sought is among those with the bit set
        want = np.where(up, want, want - (b - a))
        zeros = n - ones[-1]
        left, right = np.where(up, zeros + a, left - a), np.where(up, zeros + b, right - b)
        found |= up.astype(np.int64) << bit
        row = np.concatenate([row[one == 0], row[one == 1]])
    out = np.full(n, np.nan)
    out[ready] = values[order[found]]
    return out


def resample_series(x: np.ndarray, original: float, target: float, max_denominator: int = 100_000, beta: float = 5.0) -> np.ndarray:
    """Rational resampling by a Kaiser-windowed sinc low-pass, zero-padded at the edges."""
    ratio = Fraction(target / original).limit_denominator(max_denominator)
    up, down = ratio.numerator, ratio.denominator
    if up == down:
        return x.astype(float)
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    count = -(-len(x) * up // down)
    centre = np.arange(count) * down  # output k is the convolution at this place of the up-sampled input
    first = -(-(centre - half) // up)  # input samples under the taps
    width = 2 * half // up + 1
    index = first[:, None] + np.arange(width)
    at = centre[:, None] - index * up + half
    weight = np.where((at >= 0) & (at <= 2 * half), taps[np.clip(at, 0, 2 * half)], 0.0)
    inside = (index >= 0) & (index < len(x))
    return np.einsum("kw,kwc->kc", np.where(inside, weight, 0.0), x[np.clip(index, 0, len(x) - 1)])
