"""Long records in blocks of samples that run as tasks of their own.

Recursive filters and oscillators are linear: the state after a block is the block's own
end state from rest plus a matrix power times the state before it.  One pass gives the end
states, a scan over a record's few blocks combines them, and a second pass runs every block
from its true start.  Sums and maxima along a record are carried in the same two levels by
Columns.  Ranks over the latest samples take the block before along, as far as the window
reaches.  Blocks come to Python many at a time, in Arrow batches, and equally long ones run
side by side, so that short blocks cost no call each.

``choose`` tells from one aggregate whether any record is longer than a block; tables of
short records keep a single shuffle by record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidAccelerationError
from ..plans.storage import written
from . import batches, kernels

#: Samples of a block: eleven minutes at 100 Hz.
BLOCK_SAMPLES = 1 << 16


@dataclass(frozen=True)
class Lengths:
    """The greatest i of a table, and whether a record lacks samples between its first and last."""

    greatest: int
    gaps: bool


def lengths(df: DataFrame) -> Lengths:
    each = df.groupBy("record_id").agg(F.max("i").alias("last"), (F.max("i") - F.min("i") + 1 - F.count(F.lit(1))).alias("lacks"))
    found = each.agg(F.max("last"), F.max("lacks"), F.min("lacks")).first()
    return Lengths(found[0] or 0, bool(found[1]) or bool(found[2]))


def choose(df: DataFrame, block: int | None) -> int | None:
    """The block size if a record is longer than one, else None; None asks for whole records."""
    if block is not None and block < 1:
        raise ValueError("a block has one sample at least")
    return block if block is not None and lengths(df).greatest >= block else None


def number(block: int) -> Column:
    return F.floor(F.col("i") / block).cast("long")


def compose(filters: list[kernels.BlockFilter]) -> kernels.BlockFilter:
    """A cascade as one filter whose state holds all of theirs."""
    first, *rest = filters
    a, b, c, d = first.a, first.b, first.c, first.d
    for f in rest:
        n, m = a.shape[1], f.a.shape[1]
        top = np.concatenate([a, np.zeros((len(a), n, m))], axis=2)
        low = np.concatenate([f.b[:, :, None] * c[:, None, :], f.a], axis=2)
        a, b, c, d = np.concatenate([top, low], axis=1), np.concatenate([b, f.b * d[:, None]], axis=1), np.concatenate([f.d[:, None] * c, f.c], axis=1), f.d * d
    return kernels.BlockFilter(a, b, c, d)


def power(a: np.ndarray, n: int) -> np.ndarray:
    """Matrix powers in extended precision: companion forms of slow filters lose many digits."""
    out, square = np.broadcast_to(np.eye(a.shape[1], dtype=np.longdouble), a.shape), a.astype(np.longdouble)
    while n:
        if n & 1:
            out = out @ square
        square, n = square @ square, n >> 1
    return out


Start = Callable[[np.ndarray], np.ndarray]


@dataclass
class Pack:
    """Equally long blocks with the same components, side by side."""

    table: pa.Table
    rows: np.ndarray  # (samples, blocks): row numbers in the table
    i: np.ndarray  # (samples, blocks)
    x: np.ndarray  # (samples, blocks * components)
    have: list[str]
    state: np.ndarray  # (filters, order, blocks * components)

    @property
    def blocks(self) -> int:
        return self.rows.shape[1]

    @property
    def ids(self) -> pa.Array:
        return self.table.column("record_id").combine_chunks().take(pa.array(self.rows[0]))

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()[self.rows]


def packs(table: pa.Table, edges: np.ndarray, names: list[str], made: kernels.BlockFilter, start: Start | None) -> Iterator[Pack]:
    """The blocks between edges of a table; where it has a column state, that of a block's first row is all there is in that row."""
    filters, order = made.b.shape
    lead = int("state" in table.column_names)
    first, sizes = edges[:-1] + lead, np.diff(edges) - lead
    i = table.column("i").combine_chunks().fill_null(-1).to_numpy()
    x = np.stack([np.asarray(table.column(c).to_numpy(), float) for c in names], axis=1)
    have = ~np.logical_and.reduceat(np.isnan(x), edges[:-1], axis=0)
    wrong = (~np.isfinite(x) & np.repeat(have, np.diff(edges), axis=0)).any(axis=1)
    wrong[edges[:-1][: len(first) * lead]] = False
    bad = ~have.any(axis=1) | np.logical_or.reduceat(wrong, edges[:-1])
    if bad.any():
        name = table.column("record_id")[int(first[np.argmax(bad)])].as_py()
        raise InvalidAccelerationError(f"record {name} has no component, or a sample that is missing or not finite")
    kinds, kind = np.unique(np.column_stack([sizes, have]), axis=0, return_inverse=True)
    for k, (n, *_) in enumerate(kinds.tolist()):
        members = np.flatnonzero(kind.ravel() == k)
        own = np.flatnonzero(have[members[0]])
        rows = first[members] + np.arange(n)[:, None]
        block = np.ascontiguousarray(x[rows][:, :, own].reshape(n, -1))
        if lead:
            held = table.column("state").combine_chunks().take(pa.array(edges[:-1][members])).flatten().to_numpy()
            state = held.reshape(len(members), filters, order, len(own)).transpose(1, 2, 0, 3).reshape(filters, order, -1)
        else:
            state = np.zeros((filters, order, block.shape[1]))
        if start is not None:
            state = np.where(np.repeat(i[rows[0]] == 0, len(own)), start(block[0]), state)
        yield Pack(table, rows, i[rows], block, [names[c] for c in own], np.array(state))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("record_id", "block").sortWithinPartitions("record_id", "block", "i")


def starts(rows: DataFrame, names: list[str], made: kernels.BlockFilter, start: Start | None = None) -> DataFrame:
    """(record_id, block, state), written: the state at the first sample of each block of rows (record_id, i, block, names).

    start gives the state of a record's first block from its first sample; rest without it.
    """
    filters, order = made.b.shape
    kind = dict(rows.dtypes)["record_id"]

    def ends(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in batches.whole(found, ("record_id", "block")):
            for pack in packs(table, edges, names, made, start):
                for _ in made.run(pack.x, pack.state):
                    pass
                n, each = len(pack.rows), filters * order * len(pack.have)
                state = pack.state.reshape(filters, order, pack.blocks, -1).transpose(2, 0, 1, 3).ravel()
                states = pa.ListArray.from_arrays(pa.array(np.arange(pack.blocks + 1) * each, pa.int32()), pa.array(state))
                arrays = [pack.ids, pa.array(pack.column("block")[0]), pa.array(pack.i[0]), pa.array(np.full(pack.blocks, n, np.int64)), pa.array([",".join(pack.have)] * pack.blocks), states]
                yield pa.RecordBatch.from_arrays(arrays, ["record_id", "block", "first", "n", "have", "state"])

    powers: dict[int, np.ndarray] = {}

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        if pdf["have"].nunique() > 1:
            raise InvalidAccelerationError(f"record {pdf['record_id'].iloc[0]} has a component in a part of its samples only")
        if pdf["first"].iloc[0] != 0:
            raise InvalidAccelerationError(f"record {pdf['record_id'].iloc[0]} isn't numbered from 0")
        state, out = None, []
        for n, end in zip(pdf["n"].tolist(), pdf["state"], strict=True):
            end = np.asarray(end, float).reshape(filters, order, -1)
            out.append((np.zeros_like(end) if state is None else state).astype(float).ravel())
            if n not in powers:
                powers[n] = power(made.a, n)
            state = end if state is None else powers[n] @ state + end
        return pd.DataFrame({"record_id": pdf["record_id"], "block": pdf["block"], "state": out})

    schema = f"record_id {kind}, block long, first long, n long, have string, state array<double>"
    samples = rows.select("record_id", "block", "i", *[F.col(c).cast("double").alias(c) for c in names])
    found = _dealt(samples).mapInArrow(ends, schema)
    return written(found.groupBy("record_id").applyInPandas(scan, f"record_id {kind}, block long, state array<double>"))


def run_packs(rows: DataFrame, names: list[str], made: kernels.BlockFilter, schema: str, finish: Callable[[Pack], tuple[np.ndarray, list]], start: Start | None = None) -> DataFrame:
    """What finish makes of packs of blocks in their true start states, as block numbers of its rows in the pack and the arrays of schema."""
    kind = dict(rows.dtypes)["record_id"]
    at = starts(rows, names, made, start)
    # A block's state is a row before its samples.
    others = [c for c in rows.columns if c not in ("record_id", "block")]
    both = rows.withColumns({c: F.col(c).cast("double") for c in names}).withColumn("state", F.lit(None).cast("array<double>"))
    both = both.unionByName(at.select("record_id", "block", "state", *[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in others]))
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in batches.whole(found, ("record_id", "block")):
            for pack in packs(table, edges, names, made, start):
                of, values = finish(pack)
                yield pa.RecordBatch.from_arrays([pack.ids.take(pa.array(of)), *map(pa.array, values)], ["record_id", *columns])

    return _dealt(both).mapInArrow(run, f"record_id {kind}, {schema}")


def run_blocks(rows: DataFrame, names: list[str], made: kernels.BlockFilter, schema: str, finish: Callable, start: Start | None = None) -> DataFrame:
    """finish(pdf sorted by i, i, samples, state, components) of each block from its true start state, as rows of record_id and schema."""
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]

    def each(pack: Pack) -> tuple[np.ndarray, list]:
        width, made_of = len(pack.have), []
        for k in range(pack.blocks):
            own = slice(k * width, (k + 1) * width)
            pdf = pack.table.drop_columns(["state"]).take(pa.array(pack.rows[:, k])).to_pandas()
            made_of.append(finish(pdf, pack.i[:, k], pack.x[:, own], pack.state[:, :, own].copy(), pack.have))
        of = np.repeat(np.arange(pack.blocks), [len(m) for m in made_of])
        return of, [pd.concat([m[c] for m in made_of]).to_numpy() for c in columns]

    return run_packs(rows, names, made, schema, each, start)


def filtered(df: DataFrame, names: list[str], filters: list[kernels.BlockFilter], gain: float, block: int) -> DataFrame:
    """(record_id, i, names) of a cascade from rest."""
    made = compose(filters)
    rows = df.select("record_id", F.col("i").cast("long"), number(block).alias("block"), *names)

    def finish(pack: Pack) -> tuple[np.ndarray, list]:
        y = np.concatenate([part[0] for _, part in made.run(pack.x, pack.state)]) * gain
        y = y.reshape(pack.i.size, -1)
        values = [y[:, pack.have.index(c)] if c in pack.have else np.full(len(y), np.nan) for c in names]
        return np.tile(np.arange(pack.blocks), len(pack.i)), [pack.i.ravel(), *values]

    out = run_packs(rows, names, made, "i long, " + ", ".join(f"{c} double" for c in names), finish)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in names})


def running(df: DataFrame, names: list[str], block: int, kind: str) -> DataFrame:
    """df with names replaced by their running sum or max along each record, nulls skipped: within blocks, and over the blocks before."""
    total, both = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest)}[kind]
    rows = df.withColumn("_block", number(block))
    before = Window.partitionBy("record_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("record_id", "_block").agg(*[total(c).alias(c) for c in names])
    carried = sums.select("record_id", "_block", *[total(c).over(before).alias(f"_before_{c}") for c in names])
    within = Window.partitionBy("record_id", "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, ["record_id", "_block"])
    here = {c: total(c).over(within) for c in names}
    merged = {c: F.coalesce(both(here[c], F.col(f"_before_{c}")), here[c], F.col(f"_before_{c}")) for c in names}
    return out.withColumns(merged).select(*df.columns)


def previous(df: DataFrame, names: list[str], block: int) -> DataFrame:
    """df with columns _last_<name>: the value of the sample before in the record, over the edges of blocks too."""
    rows = df.withColumn("_block", number(block))
    within = Window.partitionBy("record_id", "_block").orderBy("i")
    ends = rows.groupBy("record_id", "_block").agg(F.max("i").alias("_i"), *[F.max_by(F.struct(c), "i").alias(f"_end_{c}") for c in names])
    order = Window.partitionBy("record_id").orderBy("_block")
    carried = ends.select("record_id", "_block", *[F.lag(f"_end_{c}").over(order)[c].alias(f"_end_{c}") for c in names])
    first = F.row_number().over(within) == 1
    out = rows.join(carried, ["record_id", "_block"])
    return out.withColumns({f"_last_{c}": F.when(first, F.col(f"_end_{c}")).otherwise(F.lag(c).over(within)) for c in names}).select(*df.columns, *[f"_last_{c}" for c in names])


def ranked(series: DataFrame, value: str, window: int, k: int, block: int) -> DataFrame:
    """Adds kth, the k-th largest of the latest window values; each block takes the end of the one before along.

    Samples of a record must be numbered without gaps.
    """
    block = max(block, window)
    own, later = number(block), (F.col("i") % block >= block - window + 1)
    parts = F.when(later, F.array(own, own + 1)).otherwise(F.array(own))
    rows = series.withColumn("_block", F.explode(parts))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in batches.whole(found, ("record_id", "_block")):
            x, i, at = (table.column(c).to_numpy() for c in (value, "i", "_block"))
            kth = np.concatenate([kernels.rolling_rank(np.asarray(x[a:b], float), window, k) for a, b in zip(edges, edges[1:])])  # noqa: B905
            yield from table.append_column("kth", pa.array(kth)).filter(pa.array(i // block == at)).combine_chunks().to_batches()

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    dealt = rows.repartition("record_id", "_block").sortWithinPartitions("record_id", "_block", "i")
    return dealt.mapInArrow(run, f"{kinds}, kth double").drop("_block")
