"""Byte-level BPE of whole texts."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

from regionframe.llm.store import modest_batches

#: Where the vocabulary lies on the driver; a parameter of every operator that uses it.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own pre-tokenizer (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(spark: SparkSession, path: str = RANKS_PATH):
    """The vocabulary file, sent to the executors; it is read on the driver only."""
    modest_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def _coder(table: bytes):
    """The tokenizer of a vocabulary file and its largest id; a worker builds it once for all its tasks."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}), max(merges.values())


class Bpe:
    """Token ids as little-endian bytes, ``width`` bytes each."""

    def __init__(self, table: bytes, width: int = 2):
        self.coder, largest = _coder(table)
        if width == 2 and largest > 65535:
            raise ValueError("two bytes don't hold this vocabulary's ids")
        self.kind, self.width = np.dtype(f"<u{width}"), width

    def encode(self, text: str | None) -> bytes:
        return np.array(self.coder.encode_ordinary(text), self.kind).tobytes() if text else b""

    def count(self, text: str | None) -> int:
        return len(self.coder.encode_ordinary(text)) if text else 0
