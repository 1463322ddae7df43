"""Training-order materialisation of token sequences as fixed-stride binary shards.

Every text becomes sequences of ``length`` token ids, the last one padded.  A
first pass counts the sequences of each input partition, so that a second pass
can number them 0 .. n-1 without a shuffle; a keyed Feistel permutation of the
next power of four, walked until it falls below n, gives each its slot in
training order.  Sequences are dealt to partitions by range of slots, one shard
each, without sampling (the ranges are known), sorted, and written by Spark's own
committed text writer, so a lost executor leaves no half-written shard and any
file system will do.  A shard of PER_SHARD records takes 70 MB.  A record is

    slot int64 | doc_id int64 | number in the text int32 | tokens used int32 | ids | 0x0A

little-endian, always ``stride`` bytes: slot s lies in shard s // per_shard at
byte (s % per_shard) * stride, so reading resumes at any slot.  Spark's reader of
fixed-length records splits shards between records and streams them, so that no
task holds a shard; a shard that ends within a record is an error.

Both passes read the same partitions: the input has to be a scan of files
(``stable=True``) or is written to the shared folder first.  The second pass
compares its counts with the first one's and fails rather than misnumber.

Cases: null and empty texts have no sequence; a null id is written as -2**63;
repeated rows get sequences of their own.  An empty input writes no shard, and
none is read from it.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.llm import tokens
from regionframe.llm.arrow import slices
from regionframe.llm.store import modest_batches, new_path, written

NULL_ID = -(1 << 63)
_HEAD = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("seq", "<i4"), ("used", "<i4")])
ROUNDS = 6
PER_SHARD = 1 << 17


def stride(length: int, width: int = 2) -> int:
    return _HEAD.itemsize + length * width + 1


def _keys(key: str) -> list[int]:
    return [struct.unpack("<Q", hashlib.sha256(f"{key}|{r}".encode()).digest()[:8])[0] for r in range(ROUNDS)]


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slot of each number below ``n``: a keyed bijection of 0 .. n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(k) for k in _keys(key)]
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            h = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        x[todo] = (left << shift) | right
        todo = x >= np.uint64(max(n, 1))
    return x.astype(np.int64)


def materialise(docs: DataFrame, path: str | None = None, key: str = "order", length: int = 256, per_shard: int = PER_SHARD, ranks_path: str = tokens.RANKS_PATH, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> tuple[str, int]:
    """Write the shards; returns their folder and the number of sequences."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src if stable else written(src, "order")
    held = tokens.ranks(spark, ranks_path)

    def count(batches):
        from pyspark import TaskContext

        bpe, n = tokens.Bpe(held.value), 0
        for b in slices(batches, 1000):
            n += sum(-(-bpe.count(t) // length) for t in b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    counts = {r["part"]: r["n"] for r in src.mapInArrow(count, "part int, n long").collect()}
    total, first = 0, {}
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    size = stride(length)

    def cut(batches):
        from pyspark import TaskContext

        bpe, part = tokens.Bpe(held.value), TaskContext.get().partitionId()
        at, end = first.get(part, 0), first.get(part, 0) + counts.get(part, 0)
        for b in slices(batches, 500):
            block = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text)
                used = len(ids) // bpe.width
                n = -(-used // length)
                body = np.zeros((n, size), np.uint8)
                head = np.zeros(n, _HEAD)
                head["doc_id"], head["seq"] = NULL_ID if doc is None else doc, np.arange(n)
                head["used"] = np.minimum(length, used - length * np.arange(n))
                body[:, : _HEAD.itemsize] = head.view(np.uint8).reshape(n, _HEAD.itemsize)
                body[:, _HEAD.itemsize : -1] = np.frombuffer(ids.ljust(n * length * bpe.width, b"\0"), np.uint8).reshape(n, length * bpe.width)
                block.append(body)
            body = np.concatenate(block)
            if at + len(body) > end:
                raise RuntimeError("the input changed between the two passes")
            slot = permuted(np.arange(at, at + len(body)), total, key)
            body[:, :8] = slot.astype("<i8").view(np.uint8).reshape(-1, 8)
            at += len(body)
            payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size - 1), len(body), [None, pa.py_buffer(np.ascontiguousarray(body[:, :-1]))])
            yield pa.RecordBatch.from_arrays([pa.array(slot), payload.cast(pa.binary())], names=["slot", "payload"])
        if at != end:
            raise RuntimeError("the input changed between the two passes")

    path = path or new_path(spark, "shards")
    rows = src.mapInArrow(cut, "slot long, payload binary").withColumn("shard", F.expr(f"slot DIV {per_shard}"))
    shards = max(1, -(-total // per_shard))
    rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot").select(F.col("payload").cast("string").alias("value"), "shard").write.partitionBy("shard").text(path)
    return path, total


def _at_least(number: int) -> str:
    """A glob of the whole numbers from ``number`` on, of up to 19 digits."""
    digits = str(number)
    larger = [f"{digits[:k]}[{int(d) + 1}-9]{'[0-9]' * (len(digits) - k - 1)}" for k, d in enumerate(digits) if d != "9"]
    longer = [f"[1-9]{'[0-9]' * k}" for k in range(len(digits), 19)]
    return "{" + ",".join([digits, *larger, *longer]) + "}"


def records(spark, path: str, length: int = 256, per_shard: int = PER_SHARD, first_slot: int = 0) -> DataFrame:
    """slot, doc_id, seq, n_tokens, ids of every record from ``first_slot`` on, read back from the shards; earlier shards are not opened."""
    size = stride(length)

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            fixed = b.column(0).cast(pa.binary(size))
            body = np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * size :][: len(fixed) * size].reshape(-1, size)
            head = np.ascontiguousarray(body[:, : _HEAD.itemsize]).view(_HEAD).ravel()
            ids = np.ascontiguousarray(body[:, _HEAD.itemsize : -1]).view("<u2").astype(np.int32)
            keep = np.arange(length) < head["used"][:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(head["used"])].astype(np.int32)), pa.array(ids[keep]))
            doc = pa.array(head["doc_id"], pa.int64())
            doc = pc.if_else(pc.equal(doc, NULL_ID), pa.scalar(None, pa.int64()), doc)
            yield pa.RecordBatch.from_arrays([pa.array(head["slot"]), doc, pa.array(head["seq"]), pa.array(head["used"]), lists], names=["slot", "doc_id", "seq", "n_tokens", "ids"])

    modest_batches(spark)
    schema, jvm = "slot long, doc_id long, seq int, n_tokens int, ids array<int>", spark.sparkContext._jvm
    shards = f"{path}/shard={_at_least(first_slot // per_shard)}"
    glob = jvm.org.apache.hadoop.fs.Path(shards)
    if not glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob):
        return spark.createDataFrame([], schema)
    raw = spark.sparkContext._jsc.binaryRecords(f"{shards}/part-*", size).rdd()
    frame = DataFrame(spark._jsparkSession.createDataset(raw, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    return frame.mapInArrow(run, schema).filter(F.col("slot") >= first_slot)
