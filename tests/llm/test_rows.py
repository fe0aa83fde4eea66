"""Line dedup, sharding, mixing, WARC and chat formatting against brute force."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import chat, line_dedup, mixing, registry, sharding, warc
from cohortlake.llm.common import n_words_of, work_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, compare):
    mine, theirs = compare(name, registry.QUERIES[name], registry.SQL[name])
    assert mine == theirs and mine


def test_line_dedup(docs, empty):
    rows = docs.collect()
    holds = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            k = line_dedup.line_key(x.encode())
            if len(k.decode()) >= 40:
                holds[k].add(r.doc_id)
    drop = {k: max(x for x in v if x is not None) for k, v in holds.items() if len(v) >= 5}
    want = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if drop.get(line_dedup.line_key(x.encode()), r.doc_id) == r.doc_id]
        want[r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    out = line_dedup.dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out) == want and any(r.n_dropped for r in out)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_without_broadcast(docs, monkeypatch):
    a = line_dedup.dedup_lines(docs).collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    key = lambda r: (r.doc_id is None, r.doc_id, r.text)
    assert sorted(a, key=key) == sorted(line_dedup.dedup_lines(docs).collect(), key=key)


def test_owners_hold_back_what_occurs_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    line = "a line of forty characters and more, number {}"
    df = spark.createDataFrame([(i, line.format(i) + "\n" + line.format(f"shared {i // 2}")) for i in range(2000)], "doc_id bigint, text string").repartition(7)
    found = line_dedup.suspects(df, 40).distinct().count()
    assert 2000 <= found < 2000 + 200


def test_bloom_has_no_false_negatives():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    b = line_dedup.Bloom(1 << 16)
    b.add(h)
    assert b.holds(h).all() and line_dedup.packed_holds(np.frombuffer(b.packed(), np.uint8), h).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert b.holds(other).mean() < 0.1


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs, 4).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    by, size = defaultdict(list), Counter()
    for r in out:
        by[r.shard].append(r.slot)
        size[r.shard] += len((r.text or "").encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(4))
    assert max(size.values()) < 1.2 * sum(size.values()) / 4
    copies = defaultdict(set)
    for r in out:
        copies[r.text].add(r.shard)
    assert all(len(v) == 1 for v in copies.values())
    assert sharding.shard_documents(empty).count() == 0
    again = sharding.shard_documents(docs.repartition(2), 4).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in out) == Counter((r.doc_id, r.text, r.shard) for r in again)


def test_sharding_splits_an_overfull_group(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id bigint, text string")
    out = sharding.shard_documents(df, 8).collect()
    sizes = Counter(r.shard for r in out)
    assert min(sizes.values()) > 250 and max(sizes.values()) < 500


def test_sharding_keeps_groups_whole(spark):
    """Groups of up to a shard's share stay in one shard, and shards stay near equal."""
    text = lambda i: f"group {i % 40} " + "x" * 200 if i < 6000 else "big " * 60 if i < 6600 else f"lone {i} " + "y" * 190
    df = spark.createDataFrame([(i, text(i)) for i in range(12000)], "doc_id bigint, text string")
    where, size = defaultdict(set), Counter()
    for r in sharding.shard_documents(df).collect():
        where[r.text].add(r.shard)
        size[r.shard] += len(r.text) + 1
    assert all(len(v) == 1 for v in where.values()) and max(size.values()) < 1.05 * min(size.values())


def test_water_fill():
    t = mixing.water_fill([10, 10, 100, 0], [1, 2, 3, 1])
    assert sum(t) == 120 and all(x <= 3 * s for x, s in zip(t, [10, 10, 100, 0])) and t[3] == 0 and t[0] == Fraction(22.5) and t[1] == 30
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0], [1]) == [0]


def test_splitting_tree():
    q = np.array([100, 7, 0, 33])
    s = mixing.splitting_tree(q, 5, 3)
    assert (s.sum(axis=0) == q).all() and s.sum(axis=1).max() - s.sum(axis=1).min() <= 3 and (s == mixing.splitting_tree(q, 5, 3)).all()


def test_mixing(docs, empty):
    planned = mixing.plan_mix(docs.drop("copies"), "source", n_words_of(docs["text"]), docs["doc_id"]).collect()
    assert len(planned) == docs.count()
    taken, target = Counter(), {}
    for r in planned:
        n = len((r.text or "").encode().split())
        assert len(r.copies) <= 3
        taken[r.source] += n * len(r.copies)
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 30 + 0.05 * t for s, t in target.items()), (taken, target)
    again = mixing.plan_mix(docs.drop("copies").repartition(3), "source", n_words_of(docs["text"]), docs["doc_id"]).collect()
    assert Counter(map(str, planned)) == Counter(map(str, again))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and max(Counter((r.doc_id, r.text) for r in mixed.where('doc_id between 20 and 59').collect()).values()) <= 3
    assert mixing.mix_documents(empty).count() == 0


def test_mixing_cuts_crossing_blocks(spark, monkeypatch):
    """Blocks of many rows are cut until few are left; repeated rows count each; the target is met to the last words."""
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "FILL_ROWS", 20)
    rows = [(i, "ab"[i % 5 == 0], 1 + i % 7) for i in range(4000)] + [(1, "a", 2)] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n int").withColumn("mix_shard", F.lit("x"))
    out = mixing.plan_mix(df, "source", F.col("n"), F.col("doc_id")).collect()
    taken = Counter()
    for r in out:
        taken[r.source] += r.n * len(r.copies)
    assert len(out) == len(rows) and all(abs(taken[r.source] - r.target) <= 8 for r in out)
    mixed = mixing.mix(df, "source", F.col("n"), F.col("doc_id"))
    assert sorted(mixed.columns) == ["doc_id", "mix_order", "mix_shard", "n", "pass", "source"] and mixed.count() == sum(len(r.copies) for r in out)


def test_mixed_rows_come_in_the_order_of_the_mix(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], f"text {i}") for i in range(500)], "doc_id bigint, source string, text string")
    plan = mixing.mix_documents(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [mix_shard" in plan and "RepartitionByExpression [mix_shard" in plan


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü x", "same"), (2, None, "same"), (3, "http://c", ""), (4, "http://d", None), (5, "http://e", "é\r\n\r\nWARC/1.1"), (None, "http://n", "same"), (5, "http://e", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id bigint, url string, html string, digest int")
    index = warc.write_warc(pages, work_path(spark, "test-archives"))
    out = {(r.page_id, r.record_type): r for r in warc.read_warc(index).collect()}
    assert warc.read_warc(index).count() == 7
    assert out[2, "response"].payload == b"same" and out[1, "revisit"].refers_to == 2 and out[None, "revisit"].refers_to == 2
    assert out[1, "revisit"].payload_bytes == 4 and out[1, "revisit"].digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert out[4, "response"].payload == b"" and out[3, "revisit"].refers_to == 4
    some = warc.read_warc(index.where("page_id in (2, 5)")).collect()
    assert Counter(r.page_id for r in some) == {2: 1, 5: 2}
    assert warc.read_warc(warc.write_warc(pages.limit(0), work_path(spark, "none"))).count() == 0
    wide = warc.write_warc(pages, work_path(spark, "wide"), min_payload=5)
    assert warc.read_warc(wide).where("record_type = 'revisit'").count() == 0
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None, False)[:-6])
    for r in index.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert warc.parse(zlib.decompress(f.read(r.length), 31))


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, None, None), (4, 0, "user", "hi"), (4, 1, "bot", "no <|end|>"), (5, 1, "bot", "no <|end|>"), (5, 0, "user", "hi"), (None, None, "user", "alone"), (None, 3, "user", "alone"), (None, 1, "user", "hi"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]
    df = spark.createDataFrame([(*t, "z", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, k string, h1 int")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(out) == {3, 4, None, 6} and out[4].n_logged == 2 and out[3].n_turns == 3 and out[6].n_turns == 2
    assert out[3].rendered.startswith("<|user|>\nhi\n<|end|>\n<|bot|>\nyo") and out[4].rendered.count("<|end|>") == 2
    assert out[None].n_logged == 2 and out[None].rendered == "<|user|>\nalone\n<|end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word " * 200_000), (1, 1, "bot", None)], "conv_id bigint, turn bigint, role string, text string")
    assert len(chat.format_chats(long).first().rendered) > 1_000_000


def test_chat_collapses_snapshots(spark):
    rows = [(c, t, "user", f"text {c // 50} {t}") for c in range(200) for t in range(1 + c % 50)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted(r.conv_id for r in out) == [49, 99, 149, 199]


def test_shards_cut_to_the_end(spark, monkeypatch):
    """Samples that cut one row off a full range in each round: more than four rounds, no row lost."""
    draw = sharding._weighted_sample

    def slow(keys, total, n, where=None):
        if where is None:
            return draw(keys, total, n)[:1]
        by = {}
        for r in sorted(keys.where(where).select("_cl_range", "_cl_h", "_cl_d").collect()):
            by.setdefault(r[0], []).append((r[1], r[2], 1.0))
        return [x[1] for x in by.values() if len(x) > 1]

    monkeypatch.setattr(sharding, "_weighted_sample", slow)
    df = spark.range(24).withColumnRenamed("id", "k")
    out = sharding.shard(df, F.lit(1), F.col("k"), F.col("k"), 1, 16).collect()
    assert sorted(r.k for r in out) == list(range(24)) and sorted(r.slot for r in out) == list(range(24))
