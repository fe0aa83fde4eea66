"""Sharding by sampled splitters.

Records are ordered by the key (content hash, row id).  A size-weighted sample of keys gives quantile boundaries
(*splitters*) that cut the key order into many fine ranges; exact sizes of the fine ranges are then summed, ranges
that came out overfull are subdivided with splitters sampled inside them, and consecutive fine ranges are packed
into shards at the exact quantiles of the total size.

Equal contents are neighbours in the key order and a splitter is placed in front of a whole content group, so copies
stay in one shard; only a group that is larger than a shard's share is cut, by row id.  Large groups that stay whole are
dealt out first, the largest to the shard that has least; the other ranges fill, in key order, what is left of each shard.
The row id is a hash of the id columns, so no group can pile up in one task.

Only the sample, the splitters and one size per fine range reach the driver: 8 keys and one sum for each of at most
65,536 ranges, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, work_table

N_SHARDS = 16
RANGES = 1024
RANGE_BYTES = 512 << 20  # beyond 1024 of these the number of ranges grows with the input, so that a range fits in a task
MOST_RANGES = 1 << 16
SAMPLE_PER_RANGE = 8


class Splitters:
    """Sorted (hash, id) pairs; range i holds the keys k with splitters[i-1] <= k < splitters[i]."""

    def __init__(self, pairs: list[tuple[int, int]]) -> None:
        pairs = sorted(set(pairs))
        self.pairs = pairs
        self.h = np.array([p[0] for p in pairs], dtype=np.int64)
        self.d = np.array([p[1] for p in pairs], dtype=np.int64)

    def locate(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.h, h, side="left")
        hi = np.searchsorted(self.h, h, side="right")
        out = hi.copy()
        for i in np.unique(lo[hi > lo]):  # hashes that are themselves splitters
            rows = np.flatnonzero((lo == i) & (hi > lo))
            j = hi[rows[0]]
            out[rows] = i + np.searchsorted(self.d[i:j], d[rows], side="right")
        return out


LEAST = -(1 << 63)


def _splitters(sample: list[tuple[int, int, float]], n: int, old: list[tuple[int, int]] = (), cut: bool = False) -> Splitters:
    """Weighted quantiles of the sample; a hash chosen once cuts in front of its whole group, one chosen more often is a range of its own, cut by id if told so."""
    sample = sorted(sample)
    if not sample:
        return Splitters(list(old))
    w = np.cumsum([s[2] for s in sample])
    at = np.searchsorted(w, w[-1] * np.arange(1, n) / n, side="right").clip(max=len(sample) - 1)
    chosen: dict[int, list[int]] = {}
    for i in np.unique(at):
        chosen.setdefault(sample[i][0], []).append(sample[i][1])
    pairs = list(old)
    for h, ids in chosen.items():
        pairs.append((h, LEAST))
        if cut:
            pairs += [(h, d) for d in ids]
        if len(ids) > 1 and h < (1 << 63) - 1:
            pairs.append((h + 1, LEAST))
    return Splitters(pairs)


def _packed(sums: dict[int, tuple], n_shards: int, large: float) -> tuple[dict[int, int], dict[int, int]]:
    """The shard of each range and the first slot of it there; sums: size, rows, least and greatest hash of each range."""
    total = sum(v[0] for v in sums.values())
    load, of = [0] * n_shards, {}
    for i in sorted((i for i, (s, n, lo, hi) in sums.items() if s > large and lo == hi), key=lambda i: (-sums[i][0], i)):
        of[i] = min(range(n_shards), key=lambda k: (load[k], k))
        load[of[i]] += sums[i][0]
    rest = [i for i in sorted(sums) if i not in of]
    room = np.cumsum([max(0.0, total / n_shards - x) for x in load])
    room = room * (sum(sums[i][0] for i in rest) / room[-1]) if room[-1] > 0 else np.arange(1, n_shards + 1.0)
    done = 0
    for i in rest:
        of[i] = min(n_shards - 1, int(np.searchsorted(room, done + sums[i][0] / 2, side="right")))
        done += sums[i][0]
    first, row = {}, [0] * n_shards
    for i in sorted(sums):
        first[i] = row[of[i]]
        row[of[i]] += sums[i][1]
    return of, first


def _weighted_sample(keys: DataFrame, total: int, n: int, where: Column | None = None) -> list[tuple[int, int, float]]:
    """About ``n`` keys, each drawn with probability min(1, n * size / total); the weight restores its share.

    The draw depends on the key alone, so it is repeated identically after a lost executor."""
    rate = n / max(total, 1)
    u = (F.pmod(F.xxhash64("_cl_h", "_cl_d", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    p = F.least(F.lit(1.0), F.col("_cl_size") * F.lit(rate))
    rows = keys if where is None else keys.where(where)
    rows = rows.where(u < p).select("_cl_h", "_cl_d", (F.col("_cl_size") / p).alias("w"))
    return [(r[0], r[1], r[2]) for r in rows.collect()]


def _ranges_of(keys: DataFrame, splitters: Splitters) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(splitters)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            i, j = b.schema.get_field_index("_cl_h"), b.schema.get_field_index("_cl_d")
            r = s.locate(b.column(i).to_numpy(zero_copy_only=False), b.column(j).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int64))], names=[*b.schema.names, "_cl_range"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    return keys.mapInArrow(locate, f"{kept}, _cl_range bigint")


def shard(df: DataFrame, size: Column, content: Column, row_id: Column, n_shards: int = N_SHARDS, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``shard`` (0 .. n_shards-1) and ``slot`` (gapless from 0 within its shard).

    ``size`` is a positive bigint weight, ``content`` decides which rows should stay neighbours, ``row_id`` tells rows
    of one content apart.  Nulls in any of them are allowed (a null size counts 1).  Ties: rows with equal content and
    id are interchangeable and get distinct slots.  An empty table gives an empty result.  Columns of ``df`` named
    shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    keyed = df.withColumns({
        "_cl_size": F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)),
        "_cl_h": F.xxhash64(content, F.lit("content")),
        "_cl_d": F.xxhash64(row_id, F.lit("row")),
    })
    keyed = work_table(keyed, "keyed")
    slim = keyed.select("_cl_h", "_cl_d", "_cl_size")
    total, rows = slim.agg(F.sum("_cl_size"), F.count("*")).first()
    if not rows:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranges = min(MOST_RANGES, max(ranges, 16 * n_shards, total // RANGE_BYTES))
    splitters = _splitters(_weighted_sample(slim, total, ranges * SAMPLE_PER_RANGE), ranges)
    share, large = total / n_shards, 6 * total / ranges
    while True:  # each round adds splitters, of which there are no more than keys
        ends = (F.sum("_cl_size"), F.count("*"), F.min("_cl_h"), F.max("_cl_h"))
        sums = {r[0]: tuple(r[1:]) for r in _ranges_of(slim, splitters).groupBy("_cl_range").agg(*ends).collect()}
        full = {i: s for i, (s, n, lo, hi) in sums.items() if s > large and n > 1 and (lo != hi or s > share)}
        if not full:
            break
        found: list[tuple[int, int]] = list(splitters.pairs)
        within = F.col("_cl_range").isin(sorted(full))
        drawn = _weighted_sample(_ranges_of(slim, splitters), sum(full.values()), SAMPLE_PER_RANGE * 8 * len(full), within)
        by: dict[int, list] = {}
        for s in drawn:
            by.setdefault(int(splitters.locate(np.array([s[0]]), np.array([s[1]]))[0]), []).append(s)
        for i, sample in by.items():
            found = _splitters(sample, max(2, int(full[i] * ranges / total) + 1), found, sums[i][2] == sums[i][3]).pairs
        if len(set(found)) == len(splitters.pairs):
            break  # nothing left to cut: single keys
        splitters = Splitters(found)
    shard_of, slot_of = _packed(sums, n_shards, large)
    spark = df.sparkSession
    plan = spark.createDataFrame([(i, shard_of[i], slot_of[i]) for i in shard_of], "_cl_range bigint, _cl_shard int, _cl_first bigint")
    out = _ranges_of(keyed, splitters).join(F.broadcast(plan), "_cl_range")  # one row a range: bounded by the parameter
    order = Window.partitionBy("_cl_range").orderBy("_cl_h", "_cl_d", "_cl_size")
    out = out.withColumn("_cl_slot", F.col("_cl_first") + F.row_number().over(order) - 1)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_cl_shard").alias("shard"), F.col("_cl_slot").cast("long").alias("slot"))


def document_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """All columns of ``documents`` with shard and slot, shards near equal in bytes."""
    return shard(docs, document_size(), F.col("text"), F.struct("doc_id"), n_shards)


def op5_sampled_splitter_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", document_size().alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64(F.md5("text"), "text").alias("_content"))
    out = shard(slim, F.col("size"), F.col("_content"), F.col("doc_id"))
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
