"""Line dedup with two Bloom filters.

Pass 1   every task streams its documents, hashes the line keys (once a document) and sends distinct hashes, with a
         flag for those it saw in two documents, to the segment of the hash space that owns them (8 bytes a key).
         The owner feeds them to a *once-seen* filter; a hash that is in it already enters the *twice-seen* filter.
Pass 2   the twice-seen filters (1 bit in 8 of the once-seen ones) are probed while the documents stream by again:
         only suspected repeats are shuffled, as 128-bit digests of their keys.
         Filters of more than ``BROADCAST_BYTES`` in total are not sent to every task: there both passes are one.  A task
         keeps what it saw twice itself, and sends the other keys, with their documents, to the owners, which probe them
         with their own twice-seen filter as soon as it is filled; a segment is bounded, so its keys are held meanwhile.
Confirm  suspects are counted exactly by (digest, document); keys in at least ``min_docs`` documents name the largest
         document id as the one that keeps them.  The confirmed keys are broadcast while they are few, else joined by
         salted keys, so that a line of every document meets its verdict in many tasks.
Rebuild  each document gets the digests it must drop and its remaining lines are joined again.

A filter's false positives only mean that more rows are confirmed; results do not depend on them.  No step collects the
documents of a line in one place: a line's documents meet only in pre-aggregated counts and maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import n_shuffle, small_batches, stored_bytes, table, work_table

MIN_CHARS, MIN_DOCS = 40, 5
ONCE_BITS, TWICE_BITS = 1 << 23, 1 << 20  # of a segment
SEGMENT_BYTES = 16 << 20  # of stored input that a segment stands for
BROADCAST_BYTES = 64 << 20
BROADCAST_KEYS, SALTS = 500_000, 32  # confirmed keys of 24 bytes; parts of a key's documents beyond it
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() changes A-Z only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or sum((c & 0xC0) != 0x80 for c in key) >= least)


def _keys(text: bytes | None, least: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if long_enough(k, least)} if text else set()


class Bloom:
    """A Bloom filter of 4 probes over a power-of-two number of bits; one byte a bit while it is being filled."""

    def __init__(self, bits: int) -> None:
        self.mask, self.flags = np.uint64(bits - 1), np.zeros(bits, dtype=bool)

    @staticmethod
    def probes(h: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            step = (h >> np.uint64(33)) | np.uint64(1)
            for i in range(4):
                yield ((h + np.uint64(i) * step) & mask).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for p in self.probes(h, self.mask):
            self.flags[p] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for p in self.probes(h, self.mask):
            out &= self.flags[p]
        return out

    def packed(self) -> bytes:
        return np.packbits(self.flags, bitorder="little").tobytes()


def packed_holds(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask, out = np.uint64(len(packed) * 8 - 1), np.ones(len(h), dtype=bool)
    for p in Bloom.probes(h, mask):
        out &= (packed[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def twice_seen(docs: DataFrame, min_chars: int, segments: int) -> DataFrame:
    """(segment, bits): the twice-seen filter of every segment of the hash space."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            h = np.fromiter(seen.keys(), dtype=np.uint64, count=len(seen))
            many = np.fromiter(seen.values(), dtype=np.int64, count=len(seen)) > 1
            seg = segment_of(h, segments)
            out = [(s, np.sort(h[(seg == s) & ~many]).tobytes(), np.sort(h[(seg == s) & many]).tobytes()) for s in np.unique(seg)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(o[0]) for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["segment", "once", "more"])

        for b in batches:
            for text in _texts(b):
                for k in _keys(text, min_chars):
                    h = xxhash.xxh3_64_intdigest(k)
                    seen[h] = seen.get(h, 0) + 1
            if len(seen) > 500_000:
                yield flush()
        if seen:
            yield flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[Bloom, Bloom]] = {}
        for b in batches:
            for s, once, more in zip(*(b.column(i).to_pylist() for i in range(3))):
                first, second = filters.setdefault(s, (Bloom(ONCE_BITS), Bloom(TWICE_BITS)))
                one, many = np.frombuffer(once, dtype=np.uint64), np.frombuffer(more, dtype=np.uint64)
                second.add(one[first.holds(one)])
                second.add(many)
                first.add(one)
                first.add(many)
        for s, (_, second) in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([second.packed()], pa.binary())], names=["segment", "bits"])

    sent = docs.select("text").mapInArrow(emit, "segment int, once binary, more binary")
    return sent.repartition(min(segments, 4 * n_shuffle(docs.sparkSession)), "segment").mapInArrow(own, "segment int, bits binary")


def _probed_by_owners(docs: DataFrame, min_chars: int, segments: int) -> DataFrame:
    """(doc_id, key) of suspects, found by the owners of the segments."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}  # digest -> documents

        def flush() -> pa.RecordBatch:
            rows = []
            for digest, found in seen.items():
                segment = int.from_bytes(digest[:4], "little") % segments
                many = len(found) > 1
                rows.append((segment, digest, None if many else found[0], many))
                if many:
                    rows += [(-1, digest, i, True) for i in found]
            seen.clear()
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), id_type, pa.bool_()))], names=["segment", "key", "doc_id", "many"])

        held = 0
        for b in batches:
            for i, text in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), _texts(b)):
                for k in _keys(text, min_chars):
                    seen.setdefault(xxhash.xxh3_128_digest(k), []).append(i)
                    held += 1
            if held > 300_000:
                yield flush()
                held = 0
        yield flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, held, now = Bloom(ONCE_BITS), Bloom(TWICE_BITS), [], None

        def suspected() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            single = rows.filter(pa.compute.invert(rows.column("many")))
            hit = second.holds(_low(single.column("key").to_pylist()))
            return single.filter(pa.array(hit)).select(["doc_id", "key"])

        for b in batches:
            segment = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if now is not None and segment[lo] != now:
                    yield from suspected().to_batches()
                    first, second, held = Bloom(ONCE_BITS), Bloom(TWICE_BITS), []
                part, now = b.slice(lo, hi - lo), segment[lo]
                h = _low(part.column(1).to_pylist())
                many = part.column(3).to_numpy(zero_copy_only=False)
                again = first.holds(h)
                _, index, count = np.unique(h, return_index=True, return_counts=True)
                twice = np.zeros(len(h), dtype=bool)
                twice[index[count > 1]] = True
                second.add(h[again | many | twice])
                first.add(h)
                held.append(part)
        if held:
            yield from suspected().to_batches()

    sent = work_table(docs.select("doc_id", "text").mapInArrow(emit, f"segment int, key binary, doc_id {kind}, many boolean"), "keys")
    owned = sent.where("segment >= 0").repartition(min(segments, 4 * n_shuffle(docs.sparkSession)), "segment").sortWithinPartitions("segment")
    return sent.where("segment < 0").select("doc_id", "key").unionByName(owned.mapInArrow(own, f"doc_id {kind}, key binary"))


def _low(digests: list[bytes]) -> np.ndarray:
    """64 bits of 128-bit digests."""
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)[:, 1].copy() if digests else np.empty(0, np.uint64)


def suspects(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): digests of a document's keys that may occur in a second document."""
    spark = docs.sparkSession
    segments = min(1 << 20, max(8, -(-stored_bytes(docs.select("text"), "text") // SEGMENT_BYTES)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if segments * TWICE_BITS // 8 > BROADCAST_BYTES:
        return _probed_by_owners(docs, min_chars, segments)
    filters = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in twice_seen(docs, min_chars, segments).collect()})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {s: np.frombuffer(x, dtype=np.uint8) for s, x in filters.value.items()}
        for b in batches:
            ids, rows, keys, hashes = b.column(b.schema.get_field_index("doc_id")), [], [], []
            for i, text in enumerate(_texts(b)):
                own = _keys(text, min_chars)
                rows += [i] * len(own)
                keys += own
                hashes += [xxhash.xxh3_64_intdigest(k) for k in own]
            if not keys:
                continue
            h, at = np.array(hashes, dtype=np.uint64), np.array(rows, dtype=np.int64)
            seg, ok = segment_of(h, segments), np.zeros(len(h), dtype=bool)
            for s in np.unique(seg):
                own = np.flatnonzero(seg == s)
                ok[own] = packed_holds(bits[int(s)], h[own]) if int(s) in bits else False
            hit = np.flatnonzero(ok)
            if len(hit):
                digests = pa.array([xxhash.xxh3_128_digest(keys[i]) for i in hit], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[hit])), digests], names=["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(emit, f"doc_id {kind}, key binary")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, ``n_lines`` (before dropping) and ``n_dropped``.

    Keys (lines stripped of ASCII white space, A-Z lowered) of at least ``min_chars`` code points that occur in at least
    ``min_docs`` documents stay in the document with the largest id only; there all their lines stay.  A null or empty
    text is one empty line (a null text becomes empty).  Rows that repeat a doc_id count as one document.  A null
    doc_id counts as one document that never keeps a key which another document holds.  Columns of ``docs`` named like
    a result are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_lines", "n_dropped")
    seen = work_table(suspects(docs, min_chars), "suspects")
    once = seen.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    confirmed = once.groupBy("key").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper")
    confirmed = work_table(confirmed, "confirmed")
    if confirmed.count() <= BROADCAST_KEYS:
        drops = seen.join(F.broadcast(confirmed), "key")
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        drops = seen.withColumn("salt", salt).join(confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])
    drops = drops.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("_cl_drop")).withColumnRenamed("doc_id", "_cl_id")
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("_cl_id")), "left").drop("_cl_id")
    names = docs.columns

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, lost = [], [], []
            for text, drop in zip(_texts(b), b.column(b.schema.get_field_index("_cl_drop")).to_pylist()):
                text = text or b""
                lines = text.split(b"\n")
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if not (long_enough(k := line_key(x), min_chars) and xxhash.xxh3_128_digest(k) in gone)]
                else:
                    kept = lines
                texts.append(b"\n".join(kept))
                counts.append(len(lines))
                lost.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(lost, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(rebuild, f"{schema}, n_lines bigint, n_dropped bigint")


def op4_bloom_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_LINES = """
lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
)"""

OP4_SQL = f"""
WITH {_LINES},
keyed AS (SELECT k, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT l.doc_id, l.pos, l.line, (d.k IS NOT NULL AND l.doc_id <> d.keeper) AS gone FROM lines l LEFT JOIN keyed d ON l.k = d.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
