"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source's size is summed; targets share the total by weight, stop at ``max_epochs`` times a source's size and
   the excess is shared again by weight until no target is above its stop.
2. The rows of a source fall by a seeded hash into at most ``BLOCKS`` blocks.  Block ids are a random permutation of
   the rows by construction, so whole passes take every block and the partial pass takes blocks 0, 1, 2, ... until
   the target is met; the one block that crosses the target is cut into smaller ones in the same way until one that
   crosses has few rows, of which those are taken, in permuted order, that fit.
3. The taken (source, pass, block) units are exact block quotas.  A binary tree over the output shards splits them:
   at each node the left half gets a multivariate-hypergeometric draw of the quotas, so shards differ in how many
   blocks of a source they get just as under a global shuffle, and the quotas add up exactly.
4. Each shard draws its share of a source's units as disjoint runs of a permutation and is shuffled locally by a hash.

One row a source (at most ``MOST_SOURCES``) and, of all sources together, ``UNITS`` block sums reach the driver: both are
bounded whatever the rows; with many sources each has fewer blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, table, work_table

MAX_EPOCHS = 3
BLOCK_ROWS = 64
BLOCKS = 4096
UNITS = 1 << 18  # blocks of all sources together
FILL_ROWS = 4096  # of a crossing block that is cut no further
MOST_SOURCES = 1 << 18
N_SHARDS = 16
SHARD_WORDS, MOST_SHARDS = 1 << 26, 1 << 14  # a shard's words, so that a task can sort it
WEIGHTS = (1, 2, 3)


def water_fill(sizes: Sequence[int], weights: Sequence[int], cap: int = MAX_EPOCHS) -> list[Fraction]:
    """Targets that share sum(sizes) by weight, none above cap times its size; exact rational arithmetic."""
    target = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(sum(sizes)), [i for i in range(len(sizes))]
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > w * cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = Fraction(cap * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def splitting_tree(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """quotas: units of each source.  Returns (n_shards, n_sources) counts that add up to the quotas."""
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * 1_000_003 + hi]))
        n = int(have.sum())
        draw = n * (mid - lo) // (hi - lo)
        left, rest, want = np.zeros_like(have), n, draw
        for i, h in enumerate(have):  # marginals: exact for any number of sources and units
            rest -= int(h)
            left[i] = rng.hypergeometric(int(h), rest, want) if want and h else 0  # UNITS keeps the total where the draw is exact
            want -= int(left[i])
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(np.asarray(quotas, dtype=np.int64), 0, n_shards)
    return out


def plan_mix(df: DataFrame, source: str, size: Column, row_id: Column, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, n_shards: int = N_SHARDS, seed: int = 17) -> DataFrame:
    """``df`` with source_size, target and ``copies``, an array of (pass int, mix_shard int, mix_order bigint).

    A row's size times size(copies) is what the mix takes of it.  Sources are ordered by code point, null last, and get
    ``weights`` in turn.  Rows of size 0 (null or empty texts) are taken once for each whole pass and in the partial
    pass wherever they fall in its blocks; a source of size 0 has target 0 and is not taken.  Equal rows are
    interchangeable.  An empty table gives an empty result.  Columns of ``df`` named like a result are replaced.
    """
    spark = df.sparkSession
    df = df.drop("source_size", "target", "copies")
    keyed = df.withColumns({"_cl_size": F.coalesce(size.cast("long"), F.lit(0)), "_cl_src": F.col(f"`{source}`"), "_cl_h": F.xxhash64(row_id, F.lit(seed))})
    keyed = work_table(keyed, "sized")
    found = keyed.groupBy("_cl_src").agg(F.sum("_cl_size").alias("s"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))  # Python orders strings by code point
    if not found:
        return df.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "copies": F.array().cast("array<struct<pass:int,mix_shard:int,mix_order:bigint>>")})
    sizes = [r[1] for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], max_epochs)
    if len(found) > MOST_SOURCES:
        raise ValueError(f"{len(found)} sources; targets by weight are planned for at most {MOST_SOURCES}")
    n_blocks = [max(1, min(BLOCKS, UNITS // len(found), -(-r[2] // BLOCK_ROWS))) for r in found]
    whole = [int(t // s) if s else 0 for t, s in zip(targets, sizes)]
    part = [round(t - w * s) for t, w, s in zip(targets, whole, sizes)]
    plan = spark.createDataFrame(
        [(r[0], i, sizes[i], float(targets[i]), n_blocks[i], whole[i], part[i]) for i, r in enumerate(found)],
        "_cl_name string, _cl_k int, source_size bigint, target double, _cl_blocks int, _cl_whole int, _cl_part bigint",
    )
    rows = keyed.join(F.broadcast(plan), F.col("_cl_src").eqNullSafe(F.col("_cl_name")))  # one row a source
    rows = rows.withColumn("_cl_block", F.pmod("_cl_h", "_cl_blocks").cast("int"))
    sums = rows.groupBy("_cl_k", "_cl_block").agg(F.sum("_cl_size"), F.count("*")).collect()  # at most UNITS
    blocks: list[dict[int, tuple[int, int]]] = [{} for _ in found]
    for k, b, size_, n in sums:
        blocks[k][b] = (size_, n)
    # the block of each source that crosses the rest of its target, and what it may still give
    cross, full = [], {}
    for k in range(len(found)):
        at, left, n = _crossing(blocks[k], n_blocks[k], part[k])
        cross.append((k, at if part[k] > 0 else 0, left if at < n_blocks[k] and part[k] > 0 else 0))
        if cross[-1][2] > 0 and n > FILL_ROWS:
            full[k] = left
    units = [[(e, b) for e in range(whole[k]) for b in range(n_blocks[k])] + [(whole[k], b) for b in range(cross[k][1] + (cross[k][2] > 0))] for k in range(len(found))]
    shares = splitting_tree(np.array([len(u) for u in units]), n_shards, seed)
    placed = []
    for k, own in enumerate(units):
        own.sort(key=lambda u: xxhash.xxh3_64_intdigest(f"{seed},{k},{u[0]},{u[1]}"))
        i = 0
        for shard in range(n_shards):
            for e, b in own[i : i + shares[shard][k]]:
                placed.append((k, b, e, shard))
            i += shares[shard][k]
    by_block: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, b, e, s in placed:
        by_block.setdefault((k, b), []).append((e, s))
    unit_rows = [(k, b, sorted(v), b == cross[k][1] and cross[k][2] > 0, cross[k][2]) for (k, b), v in by_block.items()]
    unit_plan = spark.createDataFrame(unit_rows, "_cl_k int, _cl_block int, _cl_units array<struct<pass:int,mix_shard:int>>, _cl_cross boolean, _cl_left bigint")
    # rows of crossing blocks: a block of many rows is cut by further bits of the hash, level by level
    crossing = spark.createDataFrame([c for c in cross if c[2] > 0], "_cl_k int, _cl_block int, _cl_left bigint")
    inside = rows.join(F.broadcast(crossing), ["_cl_k", "_cl_block"]).groupBy("_cl_k", "_cl_block", "_cl_left", "_cl_h", "_cl_size").agg(F.count("*").alias("_cl_n"))
    inside = work_table(inside, "crossing")  # equal rows are one
    taken = inside.limit(0).select("_cl_k", "_cl_block", "_cl_h", F.col("_cl_n").cast("int").alias("_cl_fit"))
    level = 0
    while full:
        level += 1
        sub = F.pmod(F.xxhash64("_cl_h", F.lit(level), F.lit(seed)), F.lit(BLOCKS)).cast("int")
        open_ = inside.where(F.col("_cl_k").isin(sorted(full))).withColumn("_cl_sub", sub)
        pieces: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in full}
        for k, b, size_, n, keys in open_.groupBy("_cl_k", "_cl_sub").agg(F.sum(F.col("_cl_size") * F.col("_cl_n")), F.sum("_cl_n"), F.count("*")).collect():
            pieces[k][b] = (size_, keys)
        cuts, again = [], {}
        for k, left in full.items():
            at, rest, n = _crossing(pieces[k], BLOCKS, left)
            cuts.append((k, at, rest))
            if n > FILL_ROWS:
                again[k] = rest
        plan_ = F.broadcast(spark.createDataFrame(cuts, "_cl_k int, _cl_at int, _cl_rest bigint"))
        open_ = open_.join(plan_, "_cl_k")
        whole_ = open_.where("_cl_sub < _cl_at").select("_cl_k", "_cl_block", "_cl_h", F.col("_cl_n").cast("int").alias("_cl_fit"))
        taken = work_table(taken.unionByName(whole_), "taken")
        rest_ = open_.where("_cl_sub = _cl_at").withColumn("_cl_left", F.col("_cl_rest")).drop("_cl_sub", "_cl_at", "_cl_rest")
        inside = work_table(inside.where(~F.col("_cl_k").isin(sorted(full))).unionByName(rest_), "crossing")
        full = again if level < 4 else {}  # hashes of 64 bits: four levels leave single ones
    fits = inside.groupBy("_cl_k", "_cl_block").applyInPandas(_fill, "_cl_k int, _cl_block int, _cl_h bigint, _cl_fit int")
    fits = work_table(fits.unionByName(taken), "fits")
    placed_rows = rows.join(F.broadcast(unit_plan), ["_cl_k", "_cl_block"], "left")  # at most BLOCKS rows a source
    # copies of one row share a hash: number them, so that the fill's verdict on each is taken up once
    dup = Window.partitionBy("_cl_k", "_cl_h").orderBy("_cl_size")
    edge = placed_rows.where(F.col("_cl_cross")).withColumn("_cl_no", F.row_number().over(dup)).join(fits, ["_cl_k", "_cl_block", "_cl_h"], "left")
    last = F.element_at("_cl_units", -1)
    edge = edge.withColumn("_cl_units", F.when(F.col("_cl_no") <= F.coalesce("_cl_fit", F.lit(0)), F.col("_cl_units")).otherwise(F.filter("_cl_units", lambda u: u["pass"] < last["pass"])))
    common = [f"`{c}`" for c in df.columns] + ["source_size", "target", "_cl_h", "_cl_units"]
    done = placed_rows.where(~F.coalesce("_cl_cross", F.lit(False))).select(*common).unionByName(edge.select(*common))
    order = F.transform(
        F.coalesce("_cl_units", F.array().cast("array<struct<pass:int,mix_shard:int>>")),
        lambda u: F.struct(u["pass"].alias("pass"), u["mix_shard"].alias("mix_shard"), F.xxhash64(F.col("_cl_h"), u["pass"], F.lit(seed)).alias("mix_order")),
    )
    return done.select(*[F.col(f"`{c}`") for c in df.columns], "source_size", "target", order.alias("copies"))


def _crossing(sums: dict[int, tuple[int, int]], n: int, left: int) -> tuple[int, int, int]:
    """The first of n blocks that does not fit whole in what is left (n if all do), what is left before it, its rows."""
    for b in range(n):
        size, rows = sums.get(b, (0, 0))
        if size > left:
            return b, left, rows
        left -= size
    return n, left, 0


def _fill(pdf):
    """Of the rest of a crossing block: how many of the rows of each hash fit into what is left, in permuted order."""
    pdf = pdf.sort_values(["_cl_h", "_cl_size"])
    left, out = int(pdf["_cl_left"].iloc[0]), {}
    for h, s, n in zip(pdf["_cl_h"], pdf["_cl_size"], pdf["_cl_n"]):
        k = int(n) if not s else min(int(n), left // int(s))
        if k:
            left -= k * int(s)
            out[h] = out.get(h, 0) + k
    import pandas as pd

    return pd.DataFrame({"_cl_k": pdf["_cl_k"].iloc[0], "_cl_block": pdf["_cl_block"].iloc[0], "_cl_h": list(out), "_cl_fit": list(out.values())}).astype({"_cl_k": "int32", "_cl_block": "int32", "_cl_h": "int64", "_cl_fit": "int32"})


def mix(df: DataFrame, source: str, size: Column, row_id: Column, **options) -> DataFrame:
    """The mixed rows: every taken copy once, with pass, mix_shard and mix_order (sort by it within a mix_shard).

    Columns of ``df`` of these names are replaced.
    """
    df = df.drop("pass", "mix_shard", "mix_order")
    planned = plan_mix(df, source, size, row_id, **options)
    copies = planned.select(*[F.col(f"`{c}`") for c in df.columns], F.explode("copies").alias("_cl_copy"))
    return copies.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_cl_copy.pass").alias("pass"), F.col("_cl_copy.mix_shard").alias("mix_shard"), F.col("_cl_copy.mix_order").alias("mix_order"))


def mix_documents(docs: DataFrame, words_per_shard: int = SHARD_WORDS) -> DataFrame:
    """Documents as the mix takes them, with their own columns only; repeated passes repeat rows.

    Rows come shard by shard of the splitting tree, each shuffled locally: a file written from them holds the mix in order.
    """
    rows = docs.select(F.struct("*").alias("_cl_row"), F.col("source").alias("_cl_source"), n_words_of(F.col("text")).alias("_cl_words"), F.xxhash64("doc_id", F.md5("text")).alias("_cl_row_id"))
    rough = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    shards = max(N_SHARDS, min(MOST_SHARDS, rough // words_per_shard))
    mixed = mix(rows, "_cl_source", F.col("_cl_words"), F.col("_cl_row_id"), n_shards=shards)
    return mixed.repartitionByRange(shards, "mix_shard").sortWithinPartitions("mix_shard", "mix_order").select("_cl_row.*")


def op7_hypergeometric_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), F.md5("text").alias("_md5"))
    out = plan_mix(slim, "source", F.col("size"), F.struct("doc_id", "_md5"))
    return out.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), F.size("copies").alias("n_copies"), F.transform("copies", lambda c: c["mix_shard"]).alias("mix_shards"))
