"""Many short records to a kernel call: a partition's records in order, whole, some thousand samples at a time.

Python's cost of a group (a table made and sent for each record) would outweigh the work on
records of a few dozen samples.  Rows are dealt by record and sorted; a task takes Arrow
batches and holds back the last record until it is complete, so it never holds more than a
batch and one record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidAccelerationError

#: Channels of equally long series that run together at most, and how much longer the longest may be.
MOST_CHANNELS, STRETCH = 192, 1.25


@dataclass
class Records:
    """Whole records one after another; x is zero where a record lacks a component."""

    ids: pa.Array
    i: np.ndarray
    x: np.ndarray  # (samples, components)
    starts: np.ndarray  # the first sample of each record, and the end
    have: np.ndarray  # (records, components)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def name(self, record: int) -> object:
        return self.ids[int(self.starts[record])].as_py()

    def packed(self, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(record numbers, x as (samples, records, components) with zeros behind a record's end, row numbers with -1 there) of about equally long records."""
        sizes = self.sizes
        order = np.arange(len(sizes)) if among is None else among
        order = order[np.argsort(sizes[order], kind="stable")]
        most, at = max(1, MOST_CHANNELS // self.x.shape[1]), 0
        while at < len(order):
            longest = np.searchsorted(sizes[order], max(sizes[order[at]] * STRETCH, sizes[order[at]] + 8), side="right")
            members = order[at : min(at + most, int(longest))]
            at += len(members)
            place = np.arange(sizes[members].max())[:, None]
            rows = np.where(place < sizes[members], self.starts[members] + place, -1)
            yield members, np.where((rows >= 0)[..., None], self.x[rows], 0.0), rows

    def by_length(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(record numbers, x as (samples, records, components)) of records of exactly one length."""
        sizes = self.sizes
        for n in np.unique(sizes):
            members = np.flatnonzero(sizes == n)
            yield members, self.x[self.starts[members] + np.arange(n)[:, None]]

    @property
    def record_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.have)), self.sizes)


Kernel = Callable[[Records], tuple[np.ndarray, list]]


def _records(table: pa.Table, names: list[str], starts: np.ndarray) -> Records:
    x = np.stack([np.asarray(table.column(c).to_numpy(), float) for c in names], axis=1)
    have = ~np.logical_and.reduceat(np.isnan(x), starts[:-1], axis=0)
    each = np.repeat(have, np.diff(starts), axis=0)
    found = Records(table.column("record_id").combine_chunks(), table.column("i").to_numpy(), np.where(each, x, 0.0), starts, have)
    bad = ~have.any(axis=1)
    bad |= np.logical_or.reduceat((~np.isfinite(x) & each).any(axis=1), starts[:-1])
    if bad.any():
        raise InvalidAccelerationError(f"record {found.name(int(np.argmax(bad)))} has no component, or a sample that is missing or not finite")
    return found


def whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("record_id",)) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end with a record (or what else has keys of its own), and where records start in them."""
    held: list[pa.Table] = []

    def cut(table: pa.Table) -> np.ndarray:
        codes = [table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy() for k in keys]
        return np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in codes])) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        before = held[-1].slice(held[-1].num_rows - 1) if held else new.slice(0, 0)
        inner = cut(pa.concat_tables([before, new])) - before.num_rows
        if not len(inner):  # one record goes on
            held.append(new)
            continue
        end = int(inner[-1])
        done = pa.concat_tables([*held, new.slice(0, end)])
        passed = done.num_rows - end
        edges = inner[:-1] + passed
        if done.num_rows:
            yield done, np.concatenate([[0], edges, [done.num_rows]])
        held = [new.slice(end)]
    if held:
        done = pa.concat_tables(held)
        yield done, np.array([0, done.num_rows])


def map_whole(df: DataFrame, names: list[str], columns: str, kernel: Kernel) -> DataFrame:
    """record_id and columns: what kernel makes of records, as record numbers of its rows and the columns' arrays."""
    kind = df.schema["record_id"].dataType
    schema = T.StructType([T.StructField("record_id", kind), *T.StructType.fromDDL(columns).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = None
        for table, starts in whole(batches):
            records = _records(table, names, starts)
            of, values = kernel(records)
            ids = records.ids.take(pa.array(records.starts[of]))
            if fields is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                fields = to_arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([ids, *[v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, list(fields)[1:], strict=True)]], schema=fields)

    rows = df.select("record_id", F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in names])
    return rows.repartition("record_id").sortWithinPartitions("record_id", "i").mapInArrow(run, schema)


def absent(values: np.ndarray, have: np.ndarray) -> pa.Array:
    """Values that are null where a record lacks the component."""
    return pa.array(values, pa.float64(), mask=~have)
