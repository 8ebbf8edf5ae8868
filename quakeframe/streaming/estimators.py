"""Running estimators as stateful Structured Streaming operators.

Input rows are (record_id, i, components) and optionally ``reset``.  State per record is
what the batch kernels carry from block to block, so any split into micro-batches gives the
batch answer.  Samples count in order of i: runs of samples ahead of a gap wait in a map of
the state store until the gap is filled, however many they are; a sample that was taken
before (late or repeated) is left out and counted.  A sample with ``reset`` starts its
record's estimator anew, and the numbering goes on.  A change of the components within a
record stops the query.

With ``idle_s`` a record's state goes once no sample came for so many seconds of processing
time; a sample that comes after that is the first of a new record and may have any number.

The state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scale
from ..functions.duration import duration_sample_count
from ..operators import design, kernels
from ..operators.motion import check_rate, components_of, convert_waveform
from ..operators.spectra import LongPeriodKernel, integrate_spectrum

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (state, i, samples) to arrays of the columns, or None; making a frame of each run of samples would cost more than the samples.
Advance = Callable[[dict, np.ndarray, np.ndarray], dict[str, np.ndarray] | None]


class Ordered(StatefulProcessor):
    """Gives ``advance`` each record's samples once, in order, without gaps, cut where a reset stands.

    build makes (fresh, advance) in the worker, so that what is shipped stays small.
    """

    def __init__(self, names: list[str], build: Callable[[], tuple[Callable[[], dict], Advance]], columns: list[str], idle_ms: int | None, anchored: bool):
        self.names, self.build, self.columns, self.idle_ms, self.anchored = names, build, columns, idle_ms, anchored
        self.built: tuple | None = None

    @property
    def fresh(self) -> Callable[[], dict]:
        self.built = self.built or self.build()
        return self.built[0]

    @property
    def advance(self) -> Advance:
        self.built = self.built or self.build()
        return self.built[1]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value for all that is read and written at every call, as each access is a round trip.
        self.head = handle.getValueState("head", "next long, names string, left_out long, waits long, first_waiting long, own binary")
        self.waiting = handle.getMapState("waiting", "start long", "samples binary, resets binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.head.get()
        *head, held = found if found is not None else (None if not self.anchored else 0, "", 0, 0, 0, None)
        own, out = pickle.loads(held) if held else self.fresh(), []
        for pdf in rows:
            self._take(key, pdf, head, own, out)
        if head[3] and head[4] <= head[0]:
            self._drain(head, own, out)
        self.head.update((*head, pickle.dumps(own, pickle.HIGHEST_PROTOCOL)))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        made = [x for x in out if x is not None and len(x[self.columns[0]])]
        if made:
            yield pd.DataFrame({"record_id": key[0]} | {c: np.concatenate([x[c] for x in made]) if len(made) > 1 else made[0][c] for c in self.columns})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.head, self.waiting):
            state.clear()
        yield pd.DataFrame({c: [] for c in ["record_id", *self.columns]})

    def _take(self, key: tuple, pdf: pd.DataFrame, head: list, own: dict, out: list) -> None:
        values = {c: np.asarray(pdf[c].to_numpy(), float) for c in self.names}
        have = [c for c in self.names if not np.isnan(values[c]).all()]
        head[1] = head[1] or ",".join(have)
        if ",".join(have) != head[1]:
            raise ValueError(f"record {key[0]} changed its components from {head[1]} to {','.join(have)}")
        i, reset = pdf["i"].to_numpy(), pdf["reset"].to_numpy()
        if reset.dtype != bool:
            reset = np.array([x is not None and x == x and bool(x) for x in reset], bool)
        x = np.stack([values[c] for c in have], axis=1) if have else np.zeros((len(i), 0))
        if (np.diff(i) < 0).any():
            order = np.argsort(i, kind="stable")
            i, x, reset = i[order], x[order], reset[order]
        if not np.isfinite(x).all():
            raise ValueError(f"record {key[0]} has a sample that isn't finite")
        if head[0] is None and len(i):
            head[0] = int(i[0])  # the first sample of a record that begins anywhere
        first = np.flatnonzero((np.diff(i, prepend=i[:1] - 1) != 0) & (i >= head[0]))
        head[2] += len(i) - len(first)
        i, x, reset = i[first], x[first], reset[first]
        cuts = [0, *(np.flatnonzero(np.diff(i) != 1) + 1).tolist(), len(i)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if i[a] == head[0]:
                self._run(head, own, x[a:b], reset[a:b], out)
                continue
            start, samples, resets = int(i[a]), x[a:b], reset[a:b]
            if self.waiting.containsKey((start,)):  # of two runs with one start the longer one stays
                held = self.waiting.getValue((start,))
                if len(held[1]) >= len(resets):
                    head[2] += len(resets)
                    continue
                head[2] += len(held[1])
                head[3] -= 1
            self.waiting.updateValue((start,), (samples.tobytes(), resets.tobytes()))
            head[4] = start if not head[3] else min(head[4], start)
            head[3] += 1

    def _run(self, head: list, own: dict, x: np.ndarray, reset: np.ndarray, out: list) -> None:
        edges = sorted({0, *np.flatnonzero(reset).tolist(), len(x)})
        for a, b in zip(edges, edges[1:], strict=False):
            if reset[a]:
                own.clear()
                own.update(self.fresh())
            out.append(self.advance(own, np.arange(head[0] + a, head[0] + b), x[a:b]))
        head[0] += len(x)

    def _drain(self, head: list, own: dict, out: list) -> None:
        """Runs that wait no more, in order of their starts; starts alone are listed, samples read as they are used."""
        width = len(head[1].split(","))
        for (start,) in sorted(self.waiting.keys()):
            if start > head[0]:
                head[4] = start
                return
            samples, resets = self.waiting.getValue((start,))
            x, reset = np.frombuffer(samples).reshape(-1, width), np.frombuffer(resets, bool)
            passed = min(head[0] - start, len(x))
            head[2] += passed
            if passed < len(x):
                self._run(head, own, x[passed:], reset[passed:], out)
            self.waiting.removeKey((start,))
            head[3] -= 1


def stateful(df: DataFrame, schema: str, build: Callable[[], tuple[Callable[[], dict], Advance]], mode: str, idle_s: float | None = None) -> DataFrame:
    """build gives a fresh state's maker and advance(state, i, samples), which returns the rows to emit; see Ordered."""
    if idle_s is not None and not idle_s > 0:
        raise ValueError("idle_s must be greater than zero")
    names = components_of(df)
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]
    processor = Ordered(names, build, columns, None if idle_s is None else round(idle_s * 1000), anchored=idle_s is None)
    kind = dict(df.dtypes)["record_id"]
    reset = F.col("reset").cast("boolean") if "reset" in df.columns else F.lit(False)
    rows = df.select("record_id", F.col("i").cast("long"), *names, reset.alias("reset"))
    return rows.groupBy("record_id").transformWithStateInPandas(processor, f"record_id {kind}, {schema}", mode, "ProcessingTime" if idle_s is not None else "None")


def realtime_intensity_stream(
    df: DataFrame, rate: float = 100.0, unit: str = "gal", filter_name: str = "auto", made: design.Design | None = None, window_s: float = 60.0, duration_s: float = 0.3,
    policy: str = "ceil", warn: bool = True, idle_s: float | None = None,
) -> DataFrame:
    """A row per sample, appended: resultant, rolling threshold, raw and reported intensity, running maximum."""
    rate = check_rate(rate, warn)
    made = made or design.design_realtime_filter(rate, filter_name)
    if made.rate != rate:
        raise ValueError("the filter was designed for another rate")
    count, window = duration_sample_count(duration_s, rate, policy), duration_sample_count(window_s, rate, "nearest")
    sections = made.sos

    def build() -> tuple[Callable[[], dict], Advance]:
        filters = kernels.cascade(sections)

        def advance(own: dict, i: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            y, own["filters"] = kernels.filter_series(filters, x, own["filters"])
            size = np.sqrt((y**2).sum(axis=1))
            both = np.concatenate([own["latest"], size])
            thresholds = kernels.rolling_rank(both, window, count)[len(own["latest"]) :]
            own["latest"] = both[max(len(both) - window + 1, 0) :] if window > 1 else both[:0]
            running = np.fmax.accumulate(np.concatenate([[own["max"]], thresholds]))
            own["max"] = running[-1]
            return {"i": i, "resultant_gal": size, "threshold_gal": thresholds, "max_threshold_gal": running[1:]}

        return lambda: {"filters": None, "latest": np.zeros(0), "max": np.nan}, advance

    schema = "i long, resultant_gal double, threshold_gal double, max_threshold_gal double"
    out = stateful(convert_waveform(df, unit), schema, build, "append", idle_s)
    for name in ("threshold_gal", "max_threshold_gal"):
        out = out.withColumn(name, F.nanvl(F.col(name), F.lit(None).cast("double")))
    raw, highest = scale.intensity_series(F.col("threshold_gal")), scale.intensity_series(F.col("max_threshold_gal"))
    out = out.withColumn("time_s", F.col("i") / F.lit(rate)).withColumn("intensity_raw", raw).withColumn("intensity", scale.report_intensity(F.col("intensity_raw")))
    return out.withColumn("record_max_intensity_raw", highest).drop("max_threshold_gal")


def long_period_stream(df: DataFrame, rate: float = 100.0, unit: str = "gal", damping: float = design.LONG_DAMPING, periods: tuple[float, ...] | None = None, high_pass: bool = True, warn: bool = True, idle_s: float | None = None) -> DataFrame:
    """A row per record and period at each update: the greatest absolute velocity since the record's begin or reset."""
    periods = tuple(periods or design.LONG_PERIODS_S)
    rate = check_rate(rate, warn)
    if len(components_of(df)) != 2:
        raise ValueError("two horizontal components are needed")

    def build() -> tuple[Callable[[], dict], Advance]:
        kernel = LongPeriodKernel(periods, damping, rate, high_pass)

        def advance(own: dict, i: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            kernel.advance(x, own)
            own["taken"] = own.get("taken", 0) + len(x)
            return {"period_s": np.asarray(periods, float), "sva_cm_s": own["max"].copy(), "sample_count": np.full(len(periods), own["taken"])}

        return kernel.fresh, advance

    return stateful(convert_waveform(df, unit), "period_s double, sva_cm_s double, sample_count long", build, "update", idle_s)


def spectrum_intensity_stream(df: DataFrame, rate: float = 100.0, unit: str = "gal", damping: float = design.SI_DAMPING, periods: tuple[float, ...] | None = None, idle_s: float | None = None) -> DataFrame:
    """A row per record and component at each update: the spectrum intensity since the record's begin or reset."""
    periods = tuple(periods or design.spectrum_periods())
    rate = check_rate(rate, warn=False)

    def build() -> tuple[Callable[[], dict], Advance]:
        bank = kernels.BankFilter(design.oscillator_bank(periods, damping, rate))

        def advance(own: dict, i: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            if own["state"] is None:
                own["state"], own["peak"] = bank.start(x[0]), np.zeros((len(periods), x.shape[1]))
            for _, y in bank.run(x, own["state"]):
                own["peak"] = np.maximum(own["peak"], np.abs(y[1]).max(axis=1))
            si = np.trapezoid(own["peak"], periods, axis=0) / design.SI_WIDTH_S
            own["taken"] += len(x)
            return {"component": np.arange(len(si)), "si_cm_s": si, "sample_count": np.full(len(si), own["taken"])}

        return lambda: {"state": None, "peak": None, "taken": 0}, advance

    return stateful(convert_waveform(df, unit), "component int, si_cm_s double, sample_count long", build, "update", idle_s)


__all__ = ["Ordered", "integrate_spectrum", "long_period_stream", "realtime_intensity_stream", "spectrum_intensity_stream", "stateful"]
