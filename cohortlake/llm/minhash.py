"""Near-duplicate documents by circulant MinHash.

Shingles (runs of words) are hashed to 64 bits.  A first permutation scatters them over Z_2^32; a second one, circularly
shifted by k, gives coordinate k of the signature: sig[k] = min over shingles of pi(sigma(s) + k).  Two permutations
thus make all 112 coordinates.  28 bands of 4 coordinates are the candidate buckets; sets with a Jaccard similarity of
0.8 miss every one of them with a probability of 4e-7.

Only distinct sets take part (exact copies are one node).  Links are confirmed on full sets and never enumerated within
a bucket: every member is compared with two centres of its bucket first and linked sets are joined into components; only
pairs of a bucket whose components still differ are compared after that (in large buckets block by block, returning
links and no pairs), which leaves out all pairs inside a group of near copies and still tests every pair that could join
two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, Overlaps, distinct, hash_words, mix64, shingle_hashes, small_batches, table, work_table
from .components import components

BANDS, ROWS = 28, 4
COORDINATES = BANDS * ROWS
WIDTH, SIMILARITY = 5, 80  # words a shingle; percent
CHUNK = 512
PAIRS_PER_BUCKET = 512  # beyond it a bucket's last comparisons are made block by block
BLOCK_BYTES = 2 << 20


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; empty without words."""
    words = text.lower().split() if text else []
    return distinct(shingle_hashes(hash_words(words), width)) if words else np.empty(0, dtype=np.uint64)


def node_id(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash: two permutations, the second shifted circularly once for every coordinate."""
    sigma = (mix64(shingles + GOLDEN) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(COORDINATES, dtype=np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(sigma), CHUNK):
        x = sigma[i : i + CHUNK, None] + shifts  # wraps around: a circular shift of Z_2^32
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(best, x.min(axis=0), out=best)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) signed 64-bit keys."""
    s = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = mix64(np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, s.shape[:2]))
    for r in range(ROWS):
        h = mix64(h + s[:, :, r] * GOLDEN)
    return h.view(np.int64)


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """docs with _cl_node (null for empty sets), n_shingles and _cl_sig instead of their text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, counts, sigs = [], [], []
            for text in _column(b, "text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, width)
                counts.append(len(s))
                nodes.append(node_id(s) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            out = [_column(b, f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*out, pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], names=[*(f.name for f in kept), "_cl_node", "n_shingles", "_cl_sig"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(sign, f"{schema}, _cl_node bigint, n_shingles bigint, _cl_sig binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of all bands."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(_column(b, "sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            ids = np.repeat(_column(b, "node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).reshape(-1)), pa.array(ids)], names=["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(cut, "bucket bigint, node bigint")


class Verifier:
    """Confirms candidate pairs of nodes on the full sets of their representatives' texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> None:
        self.docs, self.nodes, self.width, self.percent = docs.select("doc_id", "text"), nodes.select("node", "rep"), width, percent

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes: their representatives' texts, read again."""
        width = self.width
        near = wanted.join(self.nodes, "node").select(F.col("rep").alias("_cl_rep"), F.col("node").alias("_cl_node"))
        rows = self.docs.join(near, F.col("doc_id").eqNullSafe(F.col("_cl_rep"))).select("_cl_node", "text")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                nodes, sets = [], []
                for node, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                    s = shingle_set(text, width)
                    if len(s) and node_id(s) == node:  # a repeated doc_id may have other texts
                        nodes.append(node)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

        return rows.mapInArrow(make, "node bigint, shingles binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity."""
        percent = self.percent
        pairs = work_table(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        sets = work_table(self.sets(wanted).dropDuplicates(["node"]), "sets")
        left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for i, (s, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    s, t = np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64)
                    if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                        inter = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * inter >= percent * (len(s) + len(t) - inter):
                            keep.append(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

        return work_table(both.mapInArrow(compare, "a bigint, b bigint"), "confirmed")

    def links_in_zones(self, zones: DataFrame) -> DataFrame:
        """Links between components inside large zones (zone, node, comp), without a row for each pair.

        Sets are packed into blocks of about ``BLOCK_BYTES``; the nodes outside a zone's main component, in blocks of
        their own, meet every block of the zone, and a task that compares two blocks returns at most one link for each
        of its nodes and components.  No comparison is left out.
        """
        percent = self.percent
        zones = work_table(zones, "zones")
        sets = work_table(self.sets(zones.select("node").distinct()).dropDuplicates(["node"]), "zone_sets")
        rows = zones.join(sets, "node")
        total = rows.groupBy("zone").agg(F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES).cast("int").alias("blocks"))
        rows = rows.join(total, "zone").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        every = rows.select("zone", F.col("block").alias("right"), other.alias("left"), "node", "comp", "shingles")
        odd = rows.where("comp != zone").select(F.col("zone").alias("zone_"), F.col("block").alias("left_"), other.alias("right_"), F.col("node").alias("node_"), F.col("comp").alias("comp_"), F.col("shingles").alias("set_"))

        def compare(odd_: pa.Table, all_: pa.Table) -> pa.Table:
            found: dict[tuple[int, int], tuple[int, int]] = {}
            if odd_.num_rows and all_.num_rows:
                flat = [np.frombuffer(y, dtype=np.uint64) for y in all_.column("shingles").to_pylist()]
                names, comps = all_.column("node").to_pylist(), all_.column("comp").to_pylist()
                size = np.array([len(y) for y in flat])
                overlaps = Overlaps(flat)
                for node, comp, own in zip(*(odd_.column(c).to_pylist() for c in ("node_", "comp_", "set_"))):
                    s = np.frombuffer(own, dtype=np.uint64)
                    inter = overlaps.with_set(s)
                    for i in np.flatnonzero(100 * inter >= percent * (len(s) + size - inter)):
                        if comps[i] != comp:
                            found.setdefault((node, comps[i]), (node, names[i]))
            pairs = list(found.values())
            return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        key = ["zone", "left", "right"]
        return work_table(odd.groupBy(*[k + "_" for k in key]).cogroup(every.groupBy(*key)).applyInArrow(compare, "a bigint, b bigint"), "zone_links")


def _placed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, node, comp): the component that each member of a bucket belongs to so far."""
    return members.select("bucket", "node").join(comp, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))


def _pairs(x: DataFrame) -> DataFrame:
    return x.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY) -> DataFrame:
    """Columns of ``docs`` but text, with n_shingles, component_id and kept.

    Texts are lower-cased (A-Z) and cut into words; a text with fewer than ``width`` words is one shingle, a null text or
    one without words has an empty set, is linked with nothing and is its own component.  Sets are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable, kept says that it is the
    row's own.  Rows that repeat a doc_id are kept together.  Extra columns pass through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_shingles", "component_id", "kept")
    signed = work_table(_signed(docs, width), "signed")
    nodes = signed.where(F.col("_cl_node").isNotNull()).groupBy(F.col("_cl_node").alias("node")).agg(F.min("doc_id").alias("rep"), F.first("_cl_sig").alias("sig"))
    nodes = work_table(nodes, "nodes")
    members = _buckets(nodes)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = work_table(members.join(sizes, "bucket"), "members")
    # a node whose buckets are crowded lies in the middle of its group: the best centre
    score = members.groupBy("node").agg((F.sum("n") + F.pmod(F.col("node"), F.lit(1_000_003)) / F.lit(2_000_006.0)).alias("score"))
    centres = members.join(score, "node").groupBy("bucket").agg(F.max_by("node", "score").alias("middle"), F.max("node").alias("high"))
    verify = Verifier(docs, nodes, width, percent)
    stars = members.join(centres, "bucket").select(F.col("node").alias("x"), F.explode(F.array("middle", "high")).alias("y"))
    links = verify.links(_pairs(stars))
    # large buckets that are still mixed: one more centre each, a different one in each bucket
    comp = components(links)
    placed = _placed(members, comp)
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.col("node").bitwiseXOR(F.col("bucket"))).alias("other"), F.count("*").alias("n")).where("lo != hi and n > 64")
    more = placed.join(mixed.select("bucket", "other"), "bucket").select(F.col("node").alias("x"), F.col("other").bitwiseXOR(F.col("bucket")).alias("y"))
    comp = components(verify.links(_pairs(more)), comp)
    # what is still apart: members outside their bucket's main component against the rest of the bucket
    placed = work_table(_placed(members, comp), "placed")
    count = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    main = count.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("n")).where("m.c < n")
    main = main.select("bucket", F.col("m.comp").alias("main"), (F.col("n") * (F.col("n") - F.col("m.c"))).alias("work"))
    apart = work_table(placed.join(main, "bucket"), "apart")
    few = apart.where(F.col("work") <= PAIRS_PER_BUCKET)
    outside = few.where("comp != main").select("bucket", F.col("node").alias("x"), F.col("comp").alias("cx"))
    fresh = _pairs(outside.join(few.select("bucket", F.col("node").alias("y"), F.col("comp").alias("cy")), "bucket").where("cx != cy").select("x", "y"))
    links = verify.links(fresh)
    zones = apart.where(F.col("work") > PAIRS_PER_BUCKET).select(F.col("main").alias("zone"), "node", "comp").distinct()
    comp = components(links.unionByName(verify.links_in_zones(zones)), comp)
    whole = nodes.select("node", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = whole.join(least, "comp").select(F.col("node").alias("_cl_node"), "component_id")
    out = signed.drop("_cl_sig").join(of_node, "_cl_node", "left")
    out = out.withColumn("component_id", F.when(F.col("_cl_node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    names = [c for c in docs.columns if c != "text"]
    return out.select(*[F.col(f"`{c}`") for c in names], "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=2)


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
l AS (SELECT doc_id, string_split_regex(t, '[\x20\x09-\x0D]+') AS parts FROM t WHERE length(t) > 0),
w AS (SELECT doc_id, unnest(parts) AS w, generate_subscripts(parts, 1) AS i FROM l),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM w) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, parts[1] FROM l WHERE len(parts) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n ON s.doc_id = n.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS c FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2, 3),
e AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (total - c)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_.y FROM reach JOIN both_ ON reach.r = both_.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.c AS component_id, d.doc_id = d.c AS kept FROM (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) d LEFT JOIN n ON n.doc_id = d.doc_id
"""
