from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from cohortlake.llm import registry
from cohortlake.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    ids, names = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*names, "shard", "slot"]
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= ids and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    """The small documents with two planted items, as tables."""
    top = str(tmp_path_factory.mktemp("tables"))
    item = "Anna had 12 green pears in the old basket and gave 3 of them to Paul before she went home by train"
    first = [r.text for r in docs.where("doc_id between 8 and 11").collect()]
    planted = [(900 + i, f"{t} {item if i % 2 else item.replace('Anna', 'Maria').replace('12', '40')}", "en", "s0", 1, "x", "y", 7) for i, t in enumerate(first)]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in [*range(90), *range(900, 904)]] + [(93, 0), (None, 1)], "doc_id bigint, quality int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def _rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(folder, spark):
    steps, docs = {}, table(spark, folder, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        steps[name] = _rows(docs)
        assert sorted(docs.columns) == sorted(names if name != "sharding" else {*names, "slot"})
    quality, near, clean, mixed, _ = steps.values()
    assert quality and not {i for i, _ in quality} & {90, 91, 92}
    # near copies: 5-word shingles, similarity 0.8
    lower = lambda t: t.translate({x: x + 32 for x in range(65, 91)}).encode().split()
    sets = {(i, t): {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in quality if (w := lower(t))}
    comp = {k: k for k in sets}

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    order = sorted(sets, key=lambda k: (k[0] is not None, k[0]))  # null first
    for n, a in enumerate(order):
        for b in order[:n]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and top(a) != top(b):
                lo, hi = sorted((top(a), top(b)), key=order.index)
                comp[hi] = lo
    ids = [i for i, _ in order if i is not None]
    least = defaultdict(list)
    for k in order:
        least[top(k)].append(k[0])
    keep = {min((i for i in v if i is not None), default=None) for v in least.values()}
    assert Counter(near) == Counter(r for r in quality if r[0] in keep) and len(ids) > len(keep)
    # leaks: the planted ones
    assert {i for i, _ in near} & set(range(900, 904)) and Counter(clean) == Counter(r for r in near if (r[0] or 0) < 900)
    taken = Counter(mixed)
    assert set(taken) <= set(clean) and all(taken[r] <= 3 * n for r, n in Counter(clean).items())
    assert Counter(steps["sharding"]) == taken
    by = defaultdict(list)
    for r in docs.collect():
        by[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stages_of_an_empty_table(empty, folder, spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
