"""Response spectra, spectrum intensity and long-period classes.

A record's samples run through all oscillators of a bank at once, block by block, and
leave only peaks (or, on request, series); what follows is aggregates over those rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidAccelerationError
from ..functions import scale
from . import batches, blocks, design, kernels
from .motion import check_rate, components_of, convert_waveform, integrate

TIE_DIGITS = 6


def oscillator_responses(df: DataFrame, periods: tuple[float, ...], damping: float, rate: float = 100.0, unit: str = "gal", series: bool = False, block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """(record_id, period_s, component, sd_cm, sv_cm_s): peaks of relative displacement and velocity, the first sample included.

    series: rows per sample instead, (record_id, i, period_s, component, d_cm, v_cm_s).
    Records longer than ``block`` samples run in blocks.
    """
    bank = kernels.BankFilter(design.oscillator_bank(periods, damping, check_rate(rate, warn=False)))
    names, t = components_of(df), np.asarray(periods, float)

    def outcome(pack: blocks.Pack) -> tuple[np.ndarray, list]:
        owner, component = np.repeat(np.arange(pack.blocks), len(pack.have)), np.tile([names.index(c) for c in pack.have], pack.blocks)
        peak, found = np.zeros((2, len(t), len(owner))), []
        for at, y in bank.run(pack.x, pack.state):
            if not series:
                peak = np.maximum(peak, np.abs(y).max(axis=2))
                continue
            p, place, channel = (g.ravel() for g in np.indices(y.shape[1:]))
            found.append((owner[channel], pack.i[at + place, owner[channel]], t[p], component[channel], y[0].ravel(), y[1].ravel()))
        if not series:
            p, channel = (g.ravel() for g in np.indices(peak.shape[1:]))
            found.append((owner[channel], t[p], component[channel], peak[0].ravel(), peak[1].ravel()))
        of, *values = map(np.concatenate, zip(*found, strict=True))
        values[-3] = values[-3].astype(np.int32)
        return of, values

    columns = "i long, period_s double, component int, d_cm double, v_cm_s double" if series else "period_s double, component int, sd_cm double, sv_cm_s double"
    rows = convert_waveform(df, unit).select("record_id", F.col("i").cast("long"), *names)
    if size := blocks.choose(rows, block):
        dealt = rows.withColumn("block", blocks.number(size))
        out = blocks.run_packs(dealt, names, bank.filter, columns, outcome, bank.start)
        return out if series else out.groupBy("record_id", "period_s", "component").agg(F.max("sd_cm").alias("sd_cm"), F.max("sv_cm_s").alias("sv_cm_s"))

    def run(records: batches.Records) -> tuple[np.ndarray, list]:
        found: list[tuple[np.ndarray, ...]] = []
        for members, x, rows in records.packed():
            flat, inside = x.reshape(len(x), -1), np.repeat(rows >= 0, len(names), axis=1)
            owner, component = np.repeat(members, len(names)), np.tile(np.arange(len(names)), len(members))
            own = records.have[owner, component]
            peak = np.zeros((2, len(t), flat.shape[1]))
            for at, y in bank.run(flat, bank.start(flat[0])):
                use = inside[at : at + y.shape[2]] & own
                if not series:
                    peak = np.maximum(peak, np.where(use, np.abs(y), 0.0).max(axis=2))
                    continue
                p, place, channel = np.nonzero(np.broadcast_to(use, y.shape[1:]))
                i = records.i[rows[at + place, channel // len(names)]]
                found.append((owner[channel], i, t[p], component[channel], y[0, p, place, channel], y[1, p, place, channel]))
            if not series:
                p, channel = np.nonzero(np.broadcast_to(own, peak.shape[1:]))
                found.append((owner[channel], t[p], component[channel], peak[0, p, channel], peak[1, p, channel]))
        of, *values = map(np.concatenate, zip(*found, strict=True))
        return of, values

    return batches.map_whole(rows, names, columns, run)


def response_spectrum(df: DataFrame, periods: tuple[float, ...], damping: float, rate: float = 100.0, unit: str = "gal", block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """Sd, Sv and the pseudo spectra omega Sd (cm/s) and omega^2 Sd (gal) of each period and component."""
    omega = F.lit(2 * math.pi) / F.col("period_s")
    out = oscillator_responses(df, periods, damping, rate, unit, block=block)
    return out.withColumn("psv_cm_s", omega * F.col("sd_cm")).withColumn("psa_gal", omega * omega * F.col("sd_cm"))


def spectrum_intensity(df: DataFrame, rate: float = 100.0, unit: str = "gal", damping: float = design.SI_DAMPING, periods: tuple[float, ...] | None = None, block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """(record_id, component, si_cm_s): trapezoid of Sv over the periods, over the fixed width of 2.4 s whatever the periods."""
    sv = oscillator_responses(df, periods or design.spectrum_periods(), damping, rate, unit, block=block)
    return integrate_spectrum(sv)


def integrate_spectrum(sv: DataFrame) -> DataFrame:
    order = Window.partitionBy("record_id", "component").orderBy("period_s")
    area = (F.col("sv_cm_s") + F.lag("sv_cm_s").over(order)) * (F.col("period_s") - F.lag("period_s").over(order)) / 2
    return sv.select("record_id", "component", area.alias("area")).groupBy("record_id", "component").agg((F.sum("area") / design.SI_WIDTH_S).alias("si_cm_s"))


# -- long-period class -----------------------------------------------------------------


class LongPeriodKernel:
    """High-pass, ground velocity by trapezoid from 0, absolute velocity of every oscillator, and its greatest horizontal size."""

    def __init__(self, periods: tuple[float, ...], damping: float, rate: float, high_pass: bool):
        self.bank = kernels.BankFilter(design.oscillator_bank(periods, damping, rate))
        numerator, denominator, self.gain = design.design_high_pass(rate)
        self.filters = [kernels.direct_form(numerator, denominator)] if high_pass else []
        self.rate = rate

    def fresh(self) -> dict:
        return {"filters": None, "state": None, "last": None, "ground": None, "max": np.zeros(self.bank.count)}

    def advance(self, x: np.ndarray, at: dict, series: bool = False) -> np.ndarray | None:
        """Takes (samples, 2) and moves the state on; series: the sizes as (periods, samples)."""
        if self.filters:
            x, at["filters"] = kernels.filter_series(self.filters, x, at["filters"])
            x = x * self.gain
        if at["state"] is None:
            at["state"], at["last"], at["ground"] = self.bank.start(x[0]), x[0].copy(), np.zeros(x.shape[1])
        steps = (x + np.concatenate([at["last"][None], x[:-1]])) / (2 * self.rate)
        if at.setdefault("begun", False) is False:
            steps[0], at["begun"] = 0, True
        ground = at["ground"] + np.cumsum(steps, axis=0)
        at["last"], at["ground"] = x[-1].copy(), ground[-1].copy()
        out = []
        for first, y in self.bank.run(x, at["state"]):
            size = np.sqrt(((y[1] + ground[first : first + y.shape[2]]) ** 2).sum(axis=2))
            at["max"] = np.maximum(at["max"], size.max(axis=1))
            if series:
                out.append(size)
        return np.concatenate(out, axis=1) if series else None

    def greatest(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """(records, periods) of whole records x (samples, records, 2) from rest; inside tells samples from what fills records up."""
        shape, x = x.shape, x.reshape(len(x), -1)
        if self.filters:
            x = kernels.filter_series(self.filters, x)[0] * self.gain
        steps = (x + np.concatenate([x[:1], x[:-1]])) / (2 * self.rate)
        steps[0] = 0
        ground, most = np.cumsum(steps, axis=0), np.zeros((self.bank.count, shape[1]))
        for at, y in self.bank.run(x, self.bank.start(x[0])):
            n = y.shape[2]
            both = (y[1] + ground[at : at + n]).reshape(self.bank.count, n, *shape[1:])
            size = np.sqrt((both**2).sum(axis=3))
            most = np.maximum(most, np.where(inside[at : at + n], size, 0.0).max(axis=1))
        return most.T


def _horizontal(df: DataFrame) -> list[str]:
    names = components_of(df)
    if len(names) != 2:
        raise InvalidAccelerationError(f"two horizontal components are needed, not {len(names)}")
    return names


def absolute_velocity_spectrum(df: DataFrame, rate: float = 100.0, unit: str = "gal", damping: float = design.LONG_DAMPING, periods: tuple[float, ...] | None = None, high_pass: bool = True, warn: bool = True, block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """(record_id, period_s, sva_cm_s, sample_count) of tables with exactly the columns c0 and c1.

    Records longer than ``block`` samples run in blocks: the high-pass, the ground velocity
    and the oscillators one after another.
    """
    names, periods = _horizontal(df), tuple(periods or design.LONG_PERIODS_S)
    kernel = LongPeriodKernel(periods, damping, check_rate(rate, warn), high_pass)
    if size := blocks.choose(df, block):
        return _long_in_blocks(convert_waveform(df, unit).select("record_id", F.col("i").cast("long"), *names), names, kernel, periods, size)

    def run(records: batches.Records) -> tuple[np.ndarray, list]:
        lacks = ~records.have.all(axis=1)
        if lacks.any():
            raise InvalidAccelerationError(f"record {records.name(int(np.argmax(lacks)))} lacks a horizontal component")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for members, x, rows in records.packed():
            found.append((members, kernel.greatest(x, rows >= 0)))
        of = np.concatenate([m for m, _ in found])
        most = np.concatenate([v for _, v in found])
        n = len(periods)
        return np.repeat(of, n), [np.tile(periods, len(of)), most.ravel(), np.repeat(records.sizes[of], n)]

    rows = convert_waveform(df, unit).select("record_id", F.col("i").cast("long"), *names)
    return batches.map_whole(rows, names, "period_s double, sva_cm_s double, sample_count long", run)


def _long_in_blocks(rows: DataFrame, names: list[str], kernel: LongPeriodKernel, periods: tuple[float, ...], block: int) -> DataFrame:
    if kernel.filters:
        rows = blocks.filtered(rows, names, kernel.filters, kernel.gain, block)
    rows = rows.withColumns({f"a{k}": F.col(c) for k, c in enumerate(names)})
    rows = integrate(rows, kernel.rate, block=block).withColumn("block", blocks.number(block))
    motion = ["a0", "a1"]

    def finish(pack: blocks.Pack) -> tuple[np.ndarray, list]:
        if len(pack.have) != 2:
            raise InvalidAccelerationError(f"record {pack.ids[0].as_py()} lacks a horizontal component")
        ground, most = np.stack([pack.column(c) for c in names], axis=2), np.zeros((len(periods), pack.blocks))
        for first, y in kernel.bank.run(pack.x, pack.state):
            moved = y[1].reshape(*y.shape[1:3], pack.blocks, 2) + ground[first : first + y.shape[2]]
            most = np.maximum(most, np.sqrt((moved**2).sum(axis=3)).max(axis=1))
        return np.tile(np.arange(pack.blocks), len(periods)), [np.repeat(periods, pack.blocks), most.ravel(), np.full(most.size, len(pack.i), np.int64)]

    out = blocks.run_packs(rows, motion, kernel.bank.filter, "period_s double, sva_cm_s double, sample_count long", finish, kernel.bank.start)
    return out.groupBy("record_id", "period_s").agg(F.max("sva_cm_s").alias("sva_cm_s"), F.sum("sample_count").alias("sample_count"))


def long_period_bands(sva: DataFrame) -> DataFrame:
    """(record_id, band, max_sva_cm_s, long_period_class): whole seconds of period, for spectra on the official periods."""
    band = scale.band_of(F.round(F.col("period_s") * 10).cast("int"))
    out = sva.groupBy("record_id", band.alias("band")).agg(F.max("sva_cm_s").alias("max_sva_cm_s"))
    return out.withColumn("long_period_class", scale.classify_long_period(F.col("max_sva_cm_s")))


def long_period_class(sva: DataFrame, rate: float = 100.0, damping: float = design.LONG_DAMPING, periods: tuple[float, ...] | None = None, high_pass: bool = True) -> DataFrame:
    """One row per record of an absolute velocity spectrum: its maximum, the period that reaches it, and the class.

    Of periods whose maxima agree to TIE_DIGITS decimals the shortest is the critical one:
    where all share the sample of the maximum, they differ by rounding errors alone.
    """
    reached = F.struct(F.round("sva_cm_s", TIE_DIGITS), -F.col("period_s"))
    out = sva.groupBy("record_id").agg(
        F.max("sva_cm_s").alias("max_sva_cm_s"), F.max_by("period_s", reached).alias("critical_period_s"), F.max("sample_count").alias("sample_count")
    )
    reference = float(rate) == 100.0 and damping == design.LONG_DAMPING and high_pass and tuple(periods or design.LONG_PERIODS_S) == design.LONG_PERIODS_S
    return out.withColumn("long_period_class", scale.classify_long_period(F.col("max_sva_cm_s"))).withColumn("reference_conditions_met", F.lit(reference))
