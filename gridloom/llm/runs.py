"""What Arrow functions share: slices of text batches, and runs of equal keys in sorted streams."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")

#: Text that a function takes up at a time. Spark itself bounds the bytes of the batches that it hands over.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches to about ``most`` bytes of text; one longer text stands alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).tolist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def uncollected(batches: Iterable[T]) -> Iterator[T]:
    """The same stream, with the search for reference cycles paused until it ends: over caches of many small values it finds none and costs a fifth."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


def sorted_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of the keys of a stream sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in columns])))  # where the last, maybe unfinished run starts
        if cut or (held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns))):
            whole = [*held, b.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(whole)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of the keys start, and the end."""
    return np.append(np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))), len(keys[0]))


def fresh(name: str, columns: list[str]) -> str:
    """The name, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
