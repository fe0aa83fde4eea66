"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

Tokens.  Words, by a hash of 64 bits; n-grams by one of 48.  A word that repeats the one before it is the token REPEAT,
and RUN if that one did so too, where it is predicted, on top of its own probability, and stays itself in the history: a
run is then as surprising at its tenth word as at its third, even if the trusted text has a few.  Words that the trusted text does not have share
what its own distribution leaves by their shape (script, case, digits, symbols, length).

Model.  Tables of counts, which grow with the trusted text: of trigrams (all trusted documents, labelled good), of the
continuations of bigrams and words, and of what follows every history.  The distinct trigrams of a piece of text go,
packed, to the shard that owns their last two words; there trigram counts and continuation counts are exact, and sums
of histories and words, pre-aggregated, go on to the shards that own these.  Each order has its three discounts from
its counts of counts.  The table is stored in buckets of shards.

Scoring.  Texts are kept in blocks of about ``BLOCK_BYTES``.  A block asks every shard for its distinct n-grams and
histories there, packed; the counts that the shard has of them come back, packed, and each block works out the
probabilities of its documents' words.  What is shuffled is the text once and the requests: linear in the input; rows
per document and n-gram are never made.  Trusted text is counted in ``COUNT_PASSES`` parts of the n-gram space and
documents are scored in ``SCORE_PASSES`` parts, one after another, so that the disk holds the shuffle of one part.

Verdict.  One in ``HOLD_OUT`` trusted documents is not counted but calibrates: the bound of a language is a high quantile
of the perplexities of these, which the model has not seen, drawn towards the one of all languages the less the more
of them there are, times a margin.  A
document is kept if its perplexity is within the bound, or if all its tokens together exceed it by at most ``SLACK``
nats, so that a few rare words do not decide over a short text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, SPACE_CHARS, distinct, drop_path, drop_work_table, expand, mix64, n_shuffle, n_words_of, pack_ints, release, small_batches, squeeze, stored_bytes, table, unpack_ints, work_path, work_table

ID_BITS = 48  # of an n-gram's hash
RUN, REPEAT, START, END = 0, 1, 2, 3
MARKS = np.arange(1, 5, dtype=np.uint64)  # stand for hashes of these four
SEEDS = np.arange(4, dtype=np.uint64) * GOLDEN
FIRST_CLASS, CLASSES = 4, 512
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20  # of stored text that a shard stands for at most
ASKED_BYTES = 256 << 20  # of text that asks one group of a shard; beyond it a shard has several groups
COUNT_PASSES, ADD_PASSES, SCORE_PASSES = 2, 2, 6
HIGH, MARGIN, SLACK = 0.995, 1.25, 12.0
BROADCAST_IDS = 4_000_000  # 32 MB of ids; more are joined by a shuffle
HOLD_OUT = 5
POOLED = 30  # held-out documents that the quantile of all languages counts as beside a language's own
TRIGRAM, PAIR, WORD = range(3)  # kinds of rows of the model's table


def shape_class(word: bytes) -> int:
    """A number from FIRST_CLASS on for a word that has not been seen."""
    body = word if word.isalpha() else word[:-1] if word[-1:] in b",.;:!?" and word[:-1].isalpha() else b""
    if body.islower():  # the most common shapes, by the same rules
        end = 0 if body is word else {44: 1, 46: 2, 59: 2, 58: 2}.get(word[-1], 3)
        return FIRST_CLASS + 12 + end * 6 + min(5, (len(body) - 1) // 3)
    w = word.decode("utf-8", "replace")
    letters = sum(c.isalpha() for c in w)
    tail = w[-1:]
    if letters == 0:
        kind = 0 if any(c.isdigit() for c in w) else 1
        return FIRST_CLASS + kind * 4 + min(3, len(w) - 1)
    odd = len(w) - letters - (not tail.isalnum())
    if odd > 1 or any(c in "#$%&*<>|{}[]\\^~=+@" for c in w):
        return FIRST_CLASS + 8 + min(3, odd)
    case = 1 if w[0].isupper() and not w[1:].isupper() else 2 if letters > 1 and w.isupper() else 0
    end = 0 if tail.isalpha() else 1 if tail == "," else 2 if tail in ".;:" else 3 if tail in "!?" else 4
    length = min(5, (letters - 1) // 3)
    foreign = 90 if case == 0 and not w.isascii() else 0
    return FIRST_CLASS + 12 + foreign + (case * 5 + end) * 6 + length


def ids(kind: int, *words: np.ndarray) -> np.ndarray:
    """Hashes of ID_BITS bits of n-grams of ``kind`` words."""
    h = mix64(words[0] + SEEDS[kind])
    for w in words[1:]:
        h = mix64(h * np.uint64(3) + w)
    return (h >> np.uint64(64 - ID_BITS)).astype(np.int64)


def shard_of(found: np.ndarray, shards: int) -> np.ndarray:
    """The shard that owns an id; rises with the id."""
    return (found >> 16) * shards >> ID_BITS - 16


@dataclass
class Tokens:
    """Texts laid end to end, each with its words and the end: z is predicted after x y; word is the word itself.

    ``starts`` has the first token of every text, and then the total; first are those of the texts with words, which are
    the ones that have any; ends are the ends, and same the tokens where z is not the word.
    """

    raw: list[bytes]
    x: np.ndarray
    y: np.ndarray
    z: np.ndarray
    word: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    same: np.ndarray

    def singles(self) -> np.ndarray:
        """Ids of the words; those before them are the histories of one word."""
        return ids(1, self.word)

    def pairs(self) -> np.ndarray:
        """Ids of the words after the one before; those before them are the histories of two words."""
        return ids(2, self.y, self.word)

    def trigrams(self) -> np.ndarray:
        return ids(3, self.x, self.y, self.z)

    def shapes(self, some: np.ndarray) -> np.ndarray:
        """The shapes of the words at these tokens, which are no ends."""
        _, first, back = np.unique(self.word[some], return_index=True, return_inverse=True)
        at = some[first]
        at = at - np.searchsorted(self.ends, at)  # an end for every text before
        return np.fromiter((shape_class(self.raw[i]) for i in at.tolist()), np.int64, len(at))[back]


START_ID, STARTS_ID = (ids(k, *[MARKS[[START]]] * k) for k in (1, 2))  # histories of the first word


def tokens(texts: list[bytes | None]) -> Tokens:
    words = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n + (n > 0))])
    first, total = starts[:-1][n > 0], int(starts[-1])
    if not total:
        none, nil = np.empty(0, np.uint64), np.empty(0, np.int64)
        return Tokens([], none, none, none, none, starts, first, nil, nil)
    raw = [x for w in words for x in w]
    same = np.ones(total, dtype=bool)
    ends = first + n[n > 0]
    same[ends] = False
    word = np.full(total, MARKS[END])
    word[same] = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    y, x = np.empty_like(word), np.empty_like(word)
    y[1:], x[2:] = word[:-1], word[:-2]
    y[first] = x[first] = x[first + 1] = MARKS[START]
    same[1:] &= word[1:] == word[:-1]
    same[first] = False
    run = same.copy()
    run[1:] &= same[:-1]
    z = word.copy()
    z[same] = MARKS[REPEAT]
    z[run] = MARKS[RUN]
    return Tokens(raw, x, y, z, word, starts, first, ends, np.flatnonzero(same))


# --------------------------------------------------------------------------- packing
def pack_ids(found: np.ndarray) -> bytes:
    """Sorted ids as compressed differences, byte by byte."""
    return pack_ints(np.diff(found, prepend=0))


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(packed, 1)[0])


def _binary(b: pa.RecordBatch, name: str) -> list[bytes | None]:
    return b.column(b.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


# --------------------------------------------------------------------------- model
@dataclass
class KneserNey:
    """An interpolated modified Kneser-Ney trigram model: a table of counts in shards, and the few numbers of all.

    ``discount`` has three values an order (1, 2, 3); ``weight`` is what the words leave to ``base``, the probability before any
    count by shape; ``total`` the distinct bigrams.
    """

    rows: DataFrame
    shards: int
    discount: dict[int, list[float]]
    weight: float
    total: int
    base: np.ndarray
    name: str = ""  # of the table

    def probabilities(self, n1: np.ndarray, shape: np.ndarray, *higher: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
        """Of words with these counts; ``higher`` has, for bigrams and trigrams, their counts and what follows their histories."""
        p = self.left(1, n1) / max(self.total, 1) + self.weight * self.base[shape]
        for k, (n, (total, *of)) in enumerate(higher, 2):
            kept_back = sum(d * c for d, c in zip(self.discount[k], of))
            p = np.where(total > 0, (self.left(k, n) + kept_back * p) / np.maximum(total, 1), p)
        return p

    def left(self, order: int, n: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return n - np.array([0.0, *self.discount[order]])[np.minimum(n, 3)]


MODEL = "kind int, at int, ids binary, counts binary, types bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, shapes array<struct<shape:int,fresh:bigint,every:bigint>>"


def _model_rows(rows: list[tuple]) -> pa.Table:
    """rows: (kind, at, ids, counts, shapes); the first row of the matrix counts has the counts of n-grams, which are counted by value."""
    out = [(k, a, pack_ids(i), pack_ints(*c), int((c[0] > 0).sum()), int(c[0].sum()), *(int((c[0] == v).sum()) for v in (1, 2, 3, 4)), s) for k, a, i, c, s in rows]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.list_(pa.struct([("shape", pa.int32()), ("fresh", pa.int64()), ("every", pa.int64())]))]
    names = ["kind", "at", "ids", "counts", "types", "total", "n1", "n2", "n3", "n4", "shapes"]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, sorted, and the sums of values."""
    found, of = np.unique(keys, return_inverse=True)
    return found, [np.bincount(of, v, len(found)).astype(np.int64) for v in values]


def _following(history: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct histories with what follows them: the sum of counts, and how many are 1, 2 and more."""
    return _sums(history, n, n == 1, n == 2, n > 2)


def _trigrams(texts: DataFrame, shards: int, passes: int, now: int) -> DataFrame:
    """(at, words, codes): the distinct trigrams of every piece of text by the shard of their last two words, of the shards of a pass."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = tokens(held)
            if not len(t.z):
                return pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int32(), pa.binary(), pa.binary())], names=["at", "words", "codes"])
            words, seen, code = np.unique(t.word, return_index=True, return_inverse=True)
            plain = words != MARKS[END]
            shapes = np.full(len(words) + 3, END, np.int64)
            shapes[:3] = (RUN, REPEAT, START)
            shapes[3:][plain] = t.shapes(seen[plain])
            words, code = np.concatenate([MARKS[:3], words]), code + 3  # marks are smaller than hashes
            y, x, z = np.empty_like(code), np.empty_like(code), code.copy()
            y[1:], x[2:] = code[:-1], code[:-2]
            y[t.first] = x[t.first] = x[t.first + 1] = START
            z[t.same] = (t.z[t.same] - MARKS[0]).astype(np.int64)
            at = shard_of(ids(2, t.y, t.z), shards)
            own = np.flatnonzero(at % passes == now)
            _, first, count = np.unique(ids(3, t.x[own], t.y[own], t.z[own]), return_index=True, return_counts=True)
            own = own[first]
            x, y, z, at = x[own], y[own], z[own], at[own]
            order = np.lexsort((z, y, at))
            codes, at, count = np.stack([x[order], y[order], z[order]]), at[order], count[order]
            found, cuts = np.unique(at, return_index=True)
            rows = []
            for a, lo, hi in zip(found.tolist(), cuts, [*cuts[1:], len(at)]):
                part = codes[:, lo:hi]
                used = np.zeros(len(words), dtype=bool)
                used[part.ravel()] = True
                mine = (np.cumsum(used) - 1)[part]
                rows.append((a, pack_ints(np.diff(words[used], prepend=np.uint64(0)).view(np.int64)), pack_ints(*mine, shapes[part[2]], count[lo:hi])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["at", "words", "codes"])

        for b in batches:
            for t in _binary(b, "text"):
                held.append(t)
                n += len(t or b"")
                if n > BLOCK_BYTES:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(emit, "at int, words binary, codes binary")


def _counted(parts: DataFrame, shards: int) -> DataFrame:
    """Rows of the model from the trigrams of every shard: its own trigrams and bigrams, and its share of histories and words."""

    def count(t: pa.Table) -> pa.Table:
        grams = []
        for w, c in zip(t.column("words").to_pylist(), t.column("codes").to_pylist()):
            words, code = np.cumsum(unpack_ints(w, 1)[0].view(np.uint64)), unpack_ints(c, 5)
            grams.append((*(words[code[i]] for i in range(3)), code[3], code[4]))
        x, y, z, shape, n = (np.concatenate(c) for c in zip(*grams))
        g3, first, of = np.unique(ids(3, x, y, z), return_index=True, return_inverse=True)
        n3 = np.bincount(of, n, len(g3)).astype(np.int64)
        x, y, z, shape = x[first], y[first], z[first], shape[first]
        g2, second, n2 = np.unique(ids(2, y, z), return_index=True, return_counts=True)
        a = int(t.column("at")[0].as_py())
        rows = [(TRIGRAM, a, g3, [n3], None)]
        g1, z1, of = np.unique(ids(1, z), return_index=True, return_inverse=True)
        n1 = np.bincount(np.searchsorted(g1, ids(1, z[second])), minlength=len(g1))
        none, nil = np.zeros(len(g1), np.int64), np.zeros(len(g2), np.int64)
        h3, follow3 = _following(ids(2, x, y), n3)
        h2, follow2 = _following(ids(1, y[second]), n2)
        no3, no2 = np.zeros(len(h3), np.int64), np.zeros(len(h2), np.int64)
        parts = [
            (PAIR, g2, [n2, nil, nil, nil, nil]), (PAIR, h3, [no3, *follow3]),
            (WORD, g1, [n1, none, none, none, none, np.bincount(of, n3, len(g1)).astype(np.int64), shape[z1]]), (WORD, h2, [no2, *follow2, no2, no2]),
        ]
        for kind, found, counts in parts:
            owner, cuts = np.unique(shard_of(found, shards), return_index=True)
            rows += [(kind, int(o), found[lo:hi], [c[lo:hi] for c in counts], None) for o, lo, hi in zip(owner, cuts, [*cuts[1:], len(found)])]
        return _model_rows(rows)

    return parts.groupBy("at").applyInArrow(count, MODEL)


def _added(rows: DataFrame) -> DataFrame:
    """Pairs or words of every shard with their shares added up; words also tell how often a shape is new."""

    def add(t: pa.Table) -> pa.Table:
        kind, at = t.column("kind")[0].as_py(), t.column("at")[0].as_py()
        found = np.concatenate([unpack_ids(x) for x in t.column("ids").to_pylist()])
        c = np.concatenate([unpack_ints(x, 7 if kind == WORD else 5) for x in t.column("counts").to_pylist()], axis=1)
        g, sums = _sums(found, *c[:6])
        if kind == PAIR:
            return _model_rows([(kind, at, g, sums, None)])
        every, shape = sums[5], np.zeros(len(g), np.int64)
        np.maximum.at(shape, np.searchsorted(g, found), c[6])  # every share that saw the word predicted has its shape, others 0
        have = np.unique(shape[every > 0])
        shapes = [{"shape": int(k), "fresh": int(((every == 1) & (shape == k)).sum()), "every": int(((every > 0) & (shape == k)).sum())} for k in have]
        return _model_rows([(kind, at, g, [*sums[:5], shape], shapes)])

    return rows.groupBy("kind", "at").applyInArrow(add, MODEL)


def train(texts: DataFrame, passes: int = COUNT_PASSES) -> KneserNey:
    """The model of all rows of ``texts`` (text)."""
    spark = texts.sparkSession
    size = stored_bytes(texts.select("text"), "text")
    shards = max(32, n_shuffle(spark), size // SHARD_BYTES)
    passes = min(passes, 1 + size // BLOCK_BYTES)
    parts = []
    for now in range(passes):
        path = work_path(spark, "counts")
        _counted(_trigrams(texts, shards, passes, now), shards).write.option("compression", "zstd").partitionBy("kind").parquet(path)
        parts.append(path)
        release(spark)

    def of(kind: int) -> DataFrame:
        paths = [f"{p}/kind={kind}" for p in parts]
        return spark.read.schema(MODEL).parquet(*paths).withColumn("kind", F.lit(kind))

    rows = [of(TRIGRAM)]
    for kind, steps in ((WORD, 1), (PAIR, min(ADD_PASSES, passes))):
        for k in range(steps):
            rows.append(work_table(_added(of(kind).where(F.col("at") % steps == k)), f"kind{kind}"))
            release(spark)
        for p in parts:
            drop_path(spark, f"{p}/kind={kind}")
        release(spark)
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r.select(*every.columns))
    path, name = work_path(spark, "model"), f"kneser_ney_{uuid.uuid4().hex}"
    every.write.option("path", path).option("compression", "zstd").bucketBy(shards, "at").saveAsTable(name)  # a pass of scoring shuffles none of it
    for p in parts:
        drop_path(spark, p)
    for r in rows[1:]:
        drop_work_table(r)
    release(spark)
    model = spark.table(name)
    sums = {r["kind"]: r for r in model.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("types", "total", "n1", "n2", "n3", "n4"))).collect()}
    discount = {}
    for order, kind in ((1, WORD), (2, PAIR), (3, TRIGRAM)):
        c = [sums[kind][f"n{i}"] for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else 0.5
        d = [i - (i + 1) * y * c[i] / c[i - 1] if c[i - 1] else i * 0.5 for i in (1, 2, 3)]
        discount[order] = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)]
    w, (d1, d2, d3) = sums[WORD], discount[1]
    weight = (d1 * w["n1"] + d2 * w["n2"] + d3 * (w["types"] - w["n1"] - w["n2"])) / w["total"]
    # the words seen once tell how often each shape is new
    fresh, distinct = np.full(CLASSES, 0.5), 1
    for r in model.where(F.col("kind") == WORD).select(F.explode("shapes").alias("s")).groupBy("s.shape").agg(F.sum("s.fresh").alias("fresh"), F.sum("s.every").alias("every")).collect():
        fresh[r["shape"]] += r["fresh"]
        distinct += r["every"]
    return KneserNey(model, shards, discount, weight, w["total"], fresh / fresh.sum() / distinct, name)


def forget(model: KneserNey) -> None:
    """Remove the model's table and its files."""
    drop_work_table(model.rows)
    model.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {model.name}")


# --------------------------------------------------------------------------- scoring
def _code(docs: DataFrame) -> DataFrame:
    """Documents with _cl_text, their compressed text, in its place and the block that their task gave them."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            coded, blocks = [], []
            for t in _binary(b, "text"):
                coded.append(squeeze(t or b""))
                blocks.append(part << 24 | chunk)
                held += len(t or b"")
                if held >= BLOCK_BYTES:
                    chunk, held = chunk + 1, 0
            out = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(coded, pa.binary()), pa.array(blocks, pa.int64())], names=[*names, "_cl_text", "_cl_block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(code, f"{schema}, _cl_text binary, _cl_block bigint")


def _requests(coded: DataFrame, shards: int) -> DataFrame:
    """(block, shard, low, high): a block's distinct words, bigrams and histories (low) and trigrams (high), packed, by the shard that owns them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = 0, []

        def out() -> pa.RecordBatch:
            rows = []
            t = tokens(held)
            if len(t.z):
                pairs, g3 = t.pairs(), t.trigrams()
                marked = t.same
                g2 = pairs.copy()
                g2[marked] = ids(2, t.y[marked], t.z[marked])
                low = distinct(np.concatenate([distinct(t.singles()), distinct(pairs), ids(1, t.z[marked]), g2[marked], START_ID, STARTS_ID]))
                of = shard_of(g2, shards)
                order = np.lexsort((g3, of)) if shards > 1 << 15 else None
                if order is None:  # shard and id in one number: sorted at once
                    both = distinct(of << ID_BITS | g3)
                    of, high = both >> ID_BITS, both & ((1 << ID_BITS) - 1)
                else:
                    of, high = of[order], g3[order]
                    fresh = np.concatenate([[True], (high[1:] != high[:-1]) | (of[1:] != of[:-1])])
                    of, high = of[fresh], high[fresh]
                every = np.arange(shards + 1)
                lows, highs = np.searchsorted(shard_of(low, shards), every), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=shards))])
                rows = [(now, s, pack_ids(low[lows[s] : lows[s + 1]]), pack_ids(high[highs[s] : highs[s + 1]])) for s in range(shards) if lows[s] < lows[s + 1] or highs[s] < highs[s + 1]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "shard", "low", "high"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:  # a block's rows follow one another; one that a split cuts asks twice
                    yield out()
                    now, held = k, []
                held.append(expand(t))
        yield out()

    return coded.select("_cl_block", "_cl_text").mapInArrow(ask, "block bigint, shard int, low binary, high binary")


def _held(t: pa.Table, columns: dict[int, int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of a shard's rows of these kinds (with so many columns) and their counts, as ``width`` columns."""
    found, counts = [np.empty(0, np.int64)], [np.empty((width, 0), np.int64)]
    for k, i, c in zip(*(t.column(x).to_pylist() for x in ("kind", "ids", "counts"))):
        if k in columns:
            found.append(unpack_ids(i))
            c = unpack_ints(c, columns[k])
            counts.append(np.concatenate([c, np.zeros((width - len(c), c.shape[1]), np.int64)]))
    g, c = np.concatenate(found), np.concatenate(counts, axis=1)
    order = np.argsort(g, kind="stable")
    return g[order], c[:, order]


def _positions(x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted x has g, and whether it has."""
    if not len(x):
        return np.zeros(len(g), np.int64), np.zeros(len(g), bool)
    at = np.minimum(np.searchsorted(x, g), len(x) - 1)
    return at, x[at] == g


def _score(coded: DataFrame, model: KneserNey, groups: int) -> DataFrame:
    """The rows of ``coded`` without text, with n_tokens and perplexity; a shard is asked by ``groups`` groups of blocks."""
    shards, plain = model.shards, KneserNey(None, model.shards, model.discount, model.weight, model.total, model.base)

    def answer(asks: pa.Table, rows: pa.Table) -> pa.Table:
        g, c = _held(rows, {PAIR: 5, WORD: 6}, 6)
        g3, (n3,) = _held(rows, {TRIGRAM: 1}, 1)
        out: list[tuple] = []
        for block, low, high in zip(*(asks.column(x).to_pylist() for x in ("block", "low", "high"))):
            at, has = _positions(g, unpack_ids(low))
            at = at[has]
            up, has = _positions(g3, unpack_ids(high))
            up = up[has]
            if len(at) or len(up):
                out.append((block, pack_ids(g[at]), pack_ints(*c[:, at]), pack_ids(g3[up]), pack_ints(n3[up])))
        kinds = (pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], names=["block", "low", "counts", "high", "n"])

    rows, asks = model.rows.select("kind", "at", "ids", "counts"), _requests(coded, shards)
    mine, theirs = ["at"], ["shard"]
    if groups > 1:
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        asks = asks.withColumn("part_", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
        mine, theirs = ["at", "part"], ["shard", "part_"]
    answered = asks.groupBy(*theirs).cogroup(rows.groupBy(*mine)).applyInArrow(answer, "block bigint, low binary, counts binary, high binary, n binary")
    kept = [f for f in coded.schema.fields if f.name not in ("_cl_text", "_cl_block")]
    names = [f.name for f in kept]

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        low, high = (_joined([unpack_ids(x) for x in found.column(c).to_pylist()]) for c in ("low", "high"))
        c = np.concatenate([np.empty((6, 0), np.int64), *(unpack_ints(x, 6) for x in found.column("counts").to_pylist())], axis=1)
        n3 = _joined([unpack_ints(x, 1)[0] for x in found.column("n").to_pylist()])
        order = np.argsort(low, kind="stable")  # of sorted runs
        low, (n, *follow, shape) = low[order], c[:, order]
        order = np.argsort(high, kind="stable")
        high, n3 = high[order], n3[order]

        def find(x: np.ndarray, g: np.ndarray, *of: np.ndarray) -> list[np.ndarray]:
            if not len(x):
                return [np.zeros(len(g), v.dtype) for v in of]
            g, back = np.unique(g, return_inverse=True)  # sorted ones are found faster
            at, has = _positions(x, g)
            return [np.where(has, v[at], 0)[back] for v in of]

        def within(some: np.ndarray, x: np.ndarray, g: np.ndarray, *of: np.ndarray) -> list[np.ndarray]:
            """The same for some of g; 0 for the others."""
            out = [np.zeros(len(g), v.dtype) for v in of]
            for o, v in zip(out, find(x, g[some], *of)):
                o[some] = v
            return out

        def before(t: Tokens, after: list[np.ndarray], at_start: np.ndarray) -> list[np.ndarray]:
            """What follows the history of each token: what follows the n-gram that ends before it."""
            out = []
            for v, begin in zip(after, find(low, at_start, *follow)):
                v = np.concatenate([[0], v[:-1]])
                v[t.first] = begin[0]
                out.append(v)
            return out

        counts, values, part, held = [], [], [], 0

        def flush() -> None:
            t = tokens(part)
            if len(t.z):
                s, y, z = t.same, t.y, t.z
                n1, own, *after = find(low, t.singles(), n, shape, *follow)
                h2 = before(t, after, START_ID)
                own[t.ends] = END
                new = np.flatnonzero(n1 == 0)
                new = new[~np.isin(new, t.ends)]
                own[new] = t.shapes(new)
                word, kind = n1[s], own[s]
                # a bigram or history has words that were seen, a trigram a bigram and a history
                known = n1 > 0
                some = known.copy()
                some[1:] &= known[:-1]
                some[t.first] = known[t.first]
                n2, *after = within(some, low, t.pairs(), n, *follow)
                h3 = before(t, after, STARTS_ID)
                # where a word is repeated the mark is predicted, and the word comes on top
                n1[s], n2[s] = (find(low, g, n)[0] for g in (ids(1, z[s]), ids(2, y[s], z[s])))
                own[s] = (z[s] - MARKS[0]).astype(np.int64)
                lp = np.log(plain.probabilities(n1, own, (n2, h2), (within((n2 > 0) & (h3[0] > 0), high, t.trigrams(), n3)[0], h3)))
                lp[s] += np.log(plain.probabilities(word, kind))
            for lo, hi in zip(t.starts[:-1].tolist(), t.starts[1:].tolist()):
                counts.append(max(0, hi - lo - 1))
                values.append(float(np.exp(-lp[lo:hi].mean())) if hi > lo else None)

        for t in docs.column("_cl_text").to_pylist():
            part.append(expand(t))
            held += len(part[-1])
            if held > BLOCK_BYTES:
                flush()
                part, held = [], 0
        flush()
        return pa.table([*(docs.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(values, pa.float64())], names=[*names, "n_tokens", "perplexity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return coded.groupBy("_cl_block").cogroup(answered.groupBy("block")).applyInArrow(score, f"{schema}, n_tokens bigint, perplexity double")


def perplexities(docs: DataFrame, model: KneserNey, passes: int = SCORE_PASSES, groups: int | None = None) -> DataFrame:
    """The rows of ``docs`` without text, with n_tokens and perplexity (null for a text without words), in a work table."""
    spark = docs.sparkSession
    size = stored_bytes(docs.select("text"), "text")
    passes = min(passes, 1 + size // BLOCK_BYTES)
    groups = groups or max(1, size // passes // model.shards // ASKED_BYTES)
    done = None
    for now in range(passes):
        part = docs.where(F.pmod(F.xxhash64("text", F.lit("pass")), F.lit(passes)) == now) if passes > 1 else docs
        coded = work_table(_code(part), "coded", "none")
        scored = work_table(_score(coded, model, groups), "scored")
        drop_work_table(coded)
        release(spark)
        done = scored if done is None else done.unionByName(scored)
    return done


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without text, with n_tokens, perplexity, high (the bound of its language) and kept.

    A text without words (or null) has no perplexity and is not kept.  A null language is a language of its own.  Labels
    may repeat a doc_id; trusted are the documents with a label of quality 1.  Without trusted documents there is no
    model, perplexities are null and every text with words is kept; without held-out ones there is no bound.  Rows that repeat a doc_id
    are judged each; an empty table gives an empty result.  Columns of ``docs`` named like a result are replaced, others pass through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    clash = {"n_tokens", "perplexity", "high", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("_cl_id")).distinct()
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HOLD_OUT)) == 0
    texts = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_cl_id"), "left_semi").where(~held & (F.octet_length(F.btrim("text", F.lit(SPACE_CHARS))) > 0))
    if not texts.limit(1).count():
        out = docs.select(*rest, n_words_of(F.col("text")).alias("n_tokens"), *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "high")])
        return out.withColumn("kept", F.col("n_tokens") > 0)
    model = train(texts)
    scored = perplexities(docs, model)
    forget(model)
    good = scored.where(held & F.col("perplexity").isNotNull()).join(trusted, F.col("doc_id") == F.col("_cl_id"), "left_semi")
    per = good.groupBy("lang").agg(F.percentile_approx("perplexity", HIGH, 10_000).alias("q"), F.count("*").alias("n"))
    every = good.agg(F.percentile_approx("perplexity", HIGH, 10_000)).first()[0] or float("inf")
    bounds = work_table(per.select(F.col("lang").alias("_cl_lang"), (F.exp((F.col("n") * F.ln("q") + POOLED * math.log(every)) / (F.col("n") + POOLED)) * MARGIN).alias("high")), "bounds")
    bounds = F.broadcast(bounds) if bounds.count() <= 10_000 else bounds
    out = scored.join(bounds, F.col("lang").eqNullSafe(F.col("_cl_lang")), "left")
    high = F.coalesce("high", F.lit(every * MARGIN))
    excess = (F.col("n_tokens") + 1) * (F.ln("perplexity") - F.ln(high))
    return out.select(*rest, "n_tokens", "perplexity", high.alias("high"), F.coalesce(excess <= SLACK, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns.  Rows are told apart by doc_id and text."""
    key = F.xxhash64("text", F.lit("model"))
    slim = docs.select("doc_id", "lang", "text").withColumn("_cl_key", key)
    good = classify(slim, labels).where("kept").select(F.col("doc_id").alias("_cl_id"), "_cl_key").distinct()
    on = F.col("doc_id").eqNullSafe(F.col("_cl_id")) & (key == F.col("_cl_key"))
    return docs.join(good, on, "left_semi")


def op2_kneser_ney_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    out = classify(docs, labels)
    return out.select("doc_id", "lang", "n_tokens", F.round("perplexity", 6).alias("perplexity"), "kept")
