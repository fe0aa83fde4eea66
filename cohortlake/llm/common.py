"""Shared pieces of the corpus operators: work tables, word rules, word hashing, tolerant column access.

Conventions that hold for every operator of this subpackage

* a *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` (which is what ``bytes.split()`` yields);
* input tables may have extra columns; operators address columns by name and put their own intermediate
  columns under names that start with ``_cl_`` so that extra columns cannot clash with them;
* intermediate results that are read more than once are written as Parquet below ``spark.checkpoint.dir``
  (shared storage), so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_path, drop_work_table, release, stored_bytes, work_path, work_table  # noqa: F401

SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --------------------------------------------------------------------------- tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch for the session (plans run later than they are made): texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- native expressions
def words_of(text: Column) -> Column:
    """array<string> of the words of a text; null and empty texts give an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE, -1))


def n_words_of(text: Column) -> Column:
    """Number of words: white-space runs of the trimmed text plus one."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, SPACE_RE, -1))).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --------------------------------------------------------------------------- hashing in Python workers
def hash_words(words: list[bytes]) -> np.ndarray:
    """Stable 64-bit hashes (hashing anew is faster than a dictionary of the words seen)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter non-empty text gives its whole sequence as the only one."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(width, n)
    with np.errstate(over="ignore"):
        h = mix64(word_hashes[: n - k + 1] + np.uint64(k) * GOLDEN)
        for j in range(1, k):
            h = mix64(h * np.uint64(3) + word_hashes[j : n - k + 1 + j])
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting is many times faster than np.unique without an index)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Overlaps:
    """How many values each of many sets shares with another one, from one sorted list of all their values."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.n = values[order], owner[order], len(sets)

    def with_set(self, own: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=self.n)


# --------------------------------------------------------------------------- packing
def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, compressed byte by byte; high bytes that are all 0 are left out."""
    c = np.array(columns, dtype="<i8")
    most = int(c.max(initial=0)) if c.min(initial=0) >= 0 else -1
    width = 8 if most < 0 else max(1, (most.bit_length() + 7) // 8)
    planes = c.view(np.uint8).reshape(len(columns), -1, 8)[:, :, :width]
    return bytes([width]) + squeeze(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes())


def unpack_ints(packed: bytes, columns: int) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(expand(packed[1:]), dtype=np.uint8).reshape(columns, width, -1)
    out = np.zeros((columns, planes.shape[2], 8), dtype=np.uint8)
    out[:, :, :width] = planes.transpose(0, 2, 1)
    return out.view("<i8").reshape(columns, -1).astype(np.int64, copy=False)
