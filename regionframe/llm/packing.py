"""Best-fit packing of texts into sequences of several permitted lengths.

A text's length is its number of tokens; one longer than the largest capacity
is cut into pieces of that capacity and a rest.  Pieces are dealt evenly to
groups of about ``group_items`` and each group is packed alone, longest first:
a piece goes to the open bin that it leaves fullest, else a new bin is opened.
The sizes are optimised jointly: a new bin gets the size that costs least for
each token it can be expected to hold, by what is still to be packed; at the end
every bin is downsized to the least capacity that holds its contents.  As a size
that is good for one bin takes pieces from others, this is done for each set of
sizes that may be opened at all, and the packing of least cost is kept.  A bin of
capacity c costs ``c * (overhead + c)``: attention grows with the square.

Cases: null and empty texts have no tokens and take no room: bin, capacity and
offset are null.  Equal lengths keep their order of (doc_id, piece).  Repeated
rows and ids are items of their own.  No row is dropped.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.llm import tokens
from regionframe.llm.arrow import batched, slices, tidy
from regionframe.llm.store import written

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 8192
NULL_ID = -(1 << 63)
_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("bin", pa.int64()), ("capacity", pa.int32()), ("offset", pa.int32())])
_ITEMS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("deal", pa.int64())])


def cost(capacity: int) -> int:
    return capacity * (OVERHEAD + capacity)


def _least(sizes: list[int], n: int) -> int:
    return next(c for c in sizes if c >= n)


def packed(lengths: list[int], capacities: tuple[int, ...], opened: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (longest first), and the final capacity of each bin.

    A new bin gets the size among ``opened`` that costs least for each token it can be expected to hold:
    the piece, then from the longest on what is left to pack and still fits, downsized after that.
    Ties go to the smaller size; a piece longer than all of ``opened`` gets the least size that holds it.
    """
    sizes = sorted(capacities)
    choice = sorted(opened)
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    open_mask = 0  # bit r: a bin with r tokens left is open
    to_come = Counter(lengths)
    coming = 0  # bit n: a piece of n tokens is to come
    for n in to_come:
        coming |= 1 << n
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        to_come[n] -= 1
        if not to_come[n]:
            coming ^= 1 << n
        fits = open_mask >> n
        if fits:
            left = n + ((fits & -fits).bit_length() - 1)
            b = room[left].pop()
            if not room[left]:
                open_mask ^= 1 << left
        else:
            b = len(used)
            able = [c for c in choice if c >= n] or [_least(sizes, n)]
            left = able[0]
            if len(able) > 1:
                best_cost, best_held = 1, 0  # infinitely dear
                for c in able:
                    rest, m = c - n, coming
                    while m := m & ((2 << rest) - 1):
                        longest = m.bit_length() - 1
                        rest -= longest * min(to_come[longest], rest // longest)
                        m ^= 1 << longest
                    held = c - rest
                    price = cost(_least(sizes, held))
                    if price * best_held < best_cost * held:
                        best_cost, best_held, left = price, held, c
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        if left:
            room[left].append(b)
            open_mask |= 1 << left
    return bins, offsets, [_least(sizes, u) for u in used]


def best(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest packing over all sets of sizes that may be opened; ties go to the smaller set, then to smaller sizes."""
    sizes = sorted(capacities)
    sets = [s for k in range(1, len(sizes) + 1) for s in combinations(sizes, k)]
    return min((packed(lengths, capacities, s) for s in sets), key=lambda p: sum(map(cost, p[2])))


def items(docs: DataFrame, largest: int, ranks_path: str, id_col: str, text_col: str) -> DataFrame:
    held = tokens.ranks(docs.sparkSession, ranks_path)

    def run(batches):
        from pyspark import TaskContext

        bpe = tokens.Bpe(held.value)
        at = TaskContext.get().partitionId() * 7919

        def rows():
            k = at
            for b in slices(batches, 1000):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n = bpe.count(text)
                    for piece in range(max(1, -(-n // largest))):
                        yield doc, piece, min(largest, n - piece * largest), k
                        k += 1

        yield from batched(rows(), _ITEMS)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tidy(run, tokenizer=True), "doc_id long, piece int, n_tokens int, deal long")


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_items: int = 20_000, ranks_path: str = tokens.RANKS_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, n_tokens, bin, capacity, offset: one row for each piece of each text."""
    largest = max(capacities)
    all_items = written(items(docs, largest, ranks_path, id_col, text_col), "items")
    groups = max(1, -(-all_items.count() // group_items))

    def run(table):
        doc, piece, n = (table[c].to_numpy() for c in ("doc_id", "piece", "n_tokens"))
        order = np.lexsort((piece, doc, -n))  # stable, the last key first; what takes no room comes last
        doc, piece, n = doc[order], piece[order], n[order]
        bins, offsets, sizes = best(n[n > 0].tolist(), capacities)
        none = [None] * int((n == 0).sum())
        group = table["grp"][0].as_py()
        placed = [[group * (1 << 32) + b for b in bins], [sizes[b] for b in bins], offsets]
        columns = [doc, piece, n, *[c + none for c in placed]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)

    # ids without nulls are read as integers
    whole = all_items.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    grouped = whole.withColumn("grp", F.pmod("deal", F.lit(groups))).groupBy("grp")
    return grouped.applyInArrow(run, "doc_id long, piece int, n_tokens int, bin long, capacity int, offset int").select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "piece", (F.col("piece").cast("long") * largest).alias("start"), "n_tokens", "bin", "capacity", "offset"
    )
