"""Rows dealt to many destinations in steps, as bundles.

Where every source has something for almost every destination, a row for each pair of them grows with the square of
the input. Here a source sends one bundle (an Arrow table) for each range of destinations, at most FAN of them; tasks
that hold the bundles of up to FAN sources for one range deal them on by narrower ranges, until a range is one
destination. A step has at most FAN bundles a source, a task of it about as many bytes as a source sends, and
there are log(destinations) / log(FAN) steps: one up to FAN destinations, three up to 16 million.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a bundle is dealt to in one step, and sources that meet in a task between steps.
FAN = 256
BUNDLE = "slot int, carrier int, held binary"
_WRITTEN = pa.schema([("slot", pa.int32()), ("carrier", pa.int32()), ("held", pa.binary())])


def widths(destinations: int, fan: int = FAN) -> list[int]:
    """Destinations of a range in each step, the last being 1."""
    found = [1]
    while found[0] * fan < destinations:
        found.insert(0, found[0] * fan)
    return found


def balanced(destinations: int, fan: int = FAN) -> int:
    """The smallest fan that takes no more steps: with it all steps have about as many ranges, so a task between
    two of them holds about as many bytes as a source sends, also a little beyond a power of ``fan``."""
    steps = len(widths(destinations, fan))
    low, high = 2, max(2, fan)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(widths(destinations, middle)) <= steps else (middle + 1, high)
    return low


def _differences(rows: pa.Table) -> pa.Table:
    """Unsigned 64-bit columns as differences from the row before, which compress where they ascend."""
    for i, field in enumerate(rows.schema):
        if field.type == pa.uint64() and not rows.column(i).null_count and len(rows):
            rows = rows.set_column(i, field, pa.array(np.diff(rows.column(i).to_numpy(), prepend=np.uint64(0))))
    return rows


def _sums(rows: pa.Table) -> pa.Table:
    for i, field in enumerate(rows.schema):
        if field.type == pa.uint64() and not rows.column(i).null_count and len(rows):
            rows = rows.set_column(i, field, pa.array(np.cumsum(rows.column(i).to_numpy(), dtype=np.uint64)))
    return rows


def bundle(rows: pa.Table, to: str, width: int, carrier: int) -> pa.Table:
    """``rows`` by ranges of ``width`` destinations, which column ``to`` names."""
    slot = rows.column(to).to_numpy() // width
    if (slot[1:] < slot[:-1]).any():
        order = np.argsort(slot, kind="stable")
        rows, slot = rows.take(order), slot[order]
    edges = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)] if len(slot) else [0]
    held = []
    for a, b in zip(edges, edges[1:], strict=False):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(_differences(rows.slice(a, b - a)))
        held.append(sink.getvalue().to_pybytes())
    slots = slot[edges[:-1]].tolist()
    return pa.table([slots, [carrier] * len(held), held], schema=_WRITTEN)


def unbundle(bundles: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of all bundles of a table, none of none."""
    return pa.concat_tables([schema.empty_table(), *(_sums(pa.ipc.open_stream(x.as_buffer()).read_all()) for x in bundles.column("held"))])


def hand_on(bundles: DataFrame, to: str, steps: list[int], schema: pa.Schema, fan: int = FAN) -> DataFrame:
    """Bundles of the first range of ``steps`` (see ``widths``), dealt on until slot is the destination."""

    def narrower(width: int) -> Callable[[tuple, pa.Table], pa.Table]:
        return lambda key, held: bundle(unbundle(held, schema), to, width, key[1].as_py())

    for width in steps[1:]:
        bundles = bundles.groupBy("slot", F.floor(F.col("carrier") / fan).cast("int").alias("group")).applyInArrow(narrower(width), BUNDLE)
    return bundles
