"""Counts of 64-bit hashes in a fixed number of buckets.

Whatever the input, the result is one array of 2**bits entries, so it may be
sent to every executor: its size is a parameter, not a function of the data.
Tasks count in one array of 2**bits small integers and send compressed slices
of a fixed width, which are added per slice in two steps, blob by blob into one
array of that width: no task holds more than that and the slices of a few tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm.textkernel import give_back

#: log2 of the buckets of a slice, and the fewest slices.
SLICE_BITS, SLICES = 17, 32
#: Tasks whose slices are added at once.
TOGETHER = 64
_SCHEMA = "slice int, part int, counts binary"


def slice_size(bits: int) -> int:
    return (1 << bits) // max(SLICES, 1 << max(0, bits - SLICE_BITS))


def _pack(slice_id: int, part: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Places of one slice and their counts, compressed."""
    raw = np.concatenate([np.diff(at, prepend=0), np.minimum(n, 2**32 - 1)]).astype("<u4").tobytes()
    return pa.RecordBatch.from_pydict(
        {"slice": pa.array([slice_id], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(raw, 1)], pa.binary())}
    )


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
    return np.cumsum(raw[: len(raw) // 2]), raw[len(raw) // 2 :]


def hash_counts(
    df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, code: Callable[[np.ndarray], np.ndarray] | None = None
) -> np.ndarray:
    """How often each bucket (the top ``bits`` of a hash) occurs over all rows of ``df``.

    With ``code``, which gives bytes for counts (0 for none), the bytes instead:
    then neither the counts nor anything of their size reach the driver.
    """
    size = slice_size(bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = None
        for batch in batches:
            for h in hashes(batch):
                if counts is None:
                    counts = np.zeros(1 << bits, dtype=np.uint32)
                at, n = np.unique((h >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                counts[at] += n.astype(np.uint32)
        if counts is not None:
            part = TaskContext.get().partitionId() // TOGETHER
            for i in range((1 << bits) // size):
                here = counts[i * size : (i + 1) * size]
                at = np.flatnonzero(here)
                if len(at):
                    yield _pack(i, part, at, here[at])
            del counts
        give_back()

    def total(table: pa.Table) -> np.ndarray:
        out = np.zeros(size, dtype=np.int64)
        for blob in table.column("counts"):
            at, n = _unpack(blob.as_py())
            out[at] += n
        return out

    def add(table: pa.Table) -> pa.Table:
        out = total(table)
        at = np.flatnonzero(out)
        return pa.Table.from_batches([_pack(table.column("slice")[0].as_py(), 0, at, out[at])])

    def coded(table: pa.Table) -> pa.Table:
        raw = zlib.compress(code(total(table)).astype(np.uint8).tobytes(), 1)
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([raw], pa.binary())})

    once = df.mapInArrow(local, _SCHEMA).groupBy("slice", "part").applyInArrow(add, _SCHEMA)
    rows = once.groupBy("slice").applyInArrow(add if code is None else coded, _SCHEMA).select("slice", "counts")
    out = np.zeros(1 << bits, dtype=np.int64 if code is None else np.uint8)
    for row in rows.toLocalIterator():  # a task's slices at a time, 8 (with ``code`` 1) * 2**bits bytes in all at most
        start = row["slice"] * size
        if code is None:
            at, n = _unpack(row["counts"])
            out[start + at] = n
        else:
            out[start : start + size] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out
