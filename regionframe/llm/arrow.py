"""Arrow batches of plain Python rows, for mapInArrow functions."""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def batched(rows, schema: pa.Schema, size: int = 2000):
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    part = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield batch(part, schema)
            part = []
    if part:
        yield batch(part, schema)


def batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches, rows: int, size: int = 1 << 20, column: int = 1):
    """The same rows in record batches of at most ``rows`` rows and, but for single rows, ``size`` bytes of text.

    A worker's memory then follows neither the length of texts nor Spark's batch size.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = max(at + 1, min(at + rows, fits))
            yield b.slice(at, end - at)
            at = end


def tidy(run, tokenizer: bool = False):
    """``run`` for mapInArrow, after which its worker gives memory it no longer uses back to the system.

    Workers live on from task to task; without this each keeps the most that any operator took in it.
    A tokenizer that an earlier task left for the next ones goes first, unless ``tokenizer`` says that this one uses it.
    """

    def wrapped(batches):
        tokens = sys.modules.get("regionframe.llm.tokens")
        if tokens and not tokenizer:
            tokens._coder.cache_clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
