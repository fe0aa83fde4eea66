"""Quality, near-duplicate, passage and leak operators against brute force and held-out labels."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import decontaminate, language_model, minhash, quality_rules, substring_dedup
from cohortlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({x: x + 32 for x in range(65, 91)})


def stats(t):
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, covered, seen, dup = Counter(g), set(), set(), 0
    for i, x in enumerate(g):
        if c[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_statistics(docs, spark):
    extra = spark.createDataFrame([(1000, "a b c a b c a b c x"), (1001, "a a a a"), (1002, "# | x\n# | x\n\n\nx"), (1003, "a b")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    out = quality_rules.with_statistics(rows.withColumn("raw", F.col("text"))).collect()
    assert len(out) == rows.count()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(r.raw), r.doc_id


def test_statistics_replace_columns_of_the_same_name(docs, empty):
    named = docs.withColumns({c.upper(): F.lit("x") for c in quality_rules.COUNTS})
    out = quality_rules.with_statistics(named)
    assert [c for c in out.columns if c.lower() == "n_words"] == ["n_words"] and out.where("n_words is null").count() == 0
    assert quality_rules.with_statistics(empty).count() == 0
    kept, _ = quality_rules.classify(named.withColumns({"quality": F.lit("y"), "base_failed": F.lit(1)}), docs.select("doc_id").distinct().withColumn("quality", F.lit(1)))
    assert kept.count() == docs.count()


def test_rules_separate_and_keep_good(spark):
    rows = [(i, " ".join(["word%d" % (j * i % 97) for j in range(80)]) + (" ###" * 30 if i % 5 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 300, 2)] + [(9999, 0), (4, None)], "doc_id bigint, quality int")
    out, rules = quality_rules.classify(df, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert rules and all(got[i].kept == (i % 5 != 0) for i in got if not got[i].base_failed)
    none, no_rules = quality_rules.classify(df, labels.limit(0))
    assert no_rules == [] and none.where("kept = base_failed").count() == 0


def test_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    out, _ = quality_rules.classify(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), train)
    rows = [r for r in out.collect() if r.doc_id in test and not r.base_failed]
    assert np.mean([r.kept == (test[r.doc_id] == 1) for r in rows]) > 0.97


def test_rules_edges(docs, empty, spark):
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (None, 1)], "doc_id bigint, quality int")
    assert quality_rules.classify(docs.drop("kept"), labels)[0].count() == docs.count()
    assert quality_rules.classify(empty.drop("kept"), labels)[0].count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    out = language_model.classify(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), train).collect()
    good = [r.kept for r in out if test.get(r.doc_id) == 1]
    bad = [r.kept for r in out if test.get(r.doc_id) == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_classifier_knows_words(spark):
    """Letter-only gibberish and shuffled clean words, in shapes of the clean text, are not kept."""
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    words = [make() for _ in range(2000)]
    follow = {w: rng.sample(words, 4) for w in words}

    def text(n=80):
        w = [rng.choice(words)]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return w

    clean = [" ".join(text()) for _ in range(900)]
    junk = [" ".join(make() for _ in range(80)) for _ in range(50)]
    mixed = [" ".join(rng.sample(w, len(w))) for w in (text() for _ in range(50))]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(clean + junk + mixed)], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(800)], "doc_id bigint, quality int")
    kept = {r.doc_id for r in language_model.classify(docs, labels).where("kept").collect()}
    print("kept", [sum(i in kept for i in r) for r in (range(800, 900), range(900, 950), range(950, 1000))])
    assert len(kept & set(range(800, 900))) >= 95 and not kept & set(range(900, 1000))


def test_small_language_has_a_bound_of_its_own(spark):
    rng = random.Random(5)
    text = lambda tag, n: " ".join(f"{tag}{int(rng.random() ** 3 * n)}" for _ in range(60))
    rows = [(i, "en", text("e", 300)) for i in range(600)] + [(600 + i, "xx", text("x", 30)) for i in range(60)] + [(660, "yy", text("e", 300))]
    labels = spark.createDataFrame([(i, 1) for i in range(660)], "doc_id bigint, quality int")
    high = {r.lang: r.high for r in language_model.classify(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), labels).collect()}
    assert high["xx"] < 0.9 * high["yy"]


def test_classifier_edges(docs, empty, spark):
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(3, 1)], "doc_id bigint, quality int")
    out = language_model.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(r.perplexity is None and not r.kept for r in out if r.doc_id in (90, 91, 92))
    assert language_model.keep_good(docs, labels).columns == docs.columns
    assert language_model.classify(docs, labels.limit(0)).where("kept").count() == docs.count() - 3
    assert language_model.classify(empty, labels).count() == 0


def plain_kneser_ney(trusted):
    """An interpolated modified Kneser-Ney trigram model in dictionaries: a function of a text's perplexity, and probabilities."""
    lm = language_model

    def events(text):
        words = text.encode().split()
        out, x, y = [], "<s>", "<s>"
        for i, w in enumerate([*words, None]):
            same = 0 < i < len(words) and words[i] == words[i - 1]
            run = same and i > 1 and words[i - 1] == words[i - 2]
            z = "</s>" if w is None else "<run>" if run else "<repeat>" if same else w
            own = lm.END if w is None else lm.shape_class(w)
            shape = lm.RUN if run else lm.REPEAT if same else own
            out.append((x, y, z, w, shape, own))
            x, y = y, w
        return out

    c3 = Counter((x, y, z) for t in trusted for x, y, z, *_ in events(t))
    c2 = Counter((y, z) for x, y, z in c3)
    c1 = Counter(z for y, z in c2)
    tokens, shape_of = Counter(), {}
    for t in trusted:
        for _, _, z, _, shape, _ in events(t):
            tokens[z] += 1
            shape_of[z] = shape

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * 0.5, 0.05), i - 0.05) for i in (1, 2, 3)]

    d = {3: discounts(c3), 2: discounts(c2), 1: discounts(c1)}
    h3, h2 = {}, {}
    for (x, y, _), n in c3.items():
        h3.setdefault((x, y), []).append(n)
    for (y, _), n in c2.items():
        h2.setdefault(y, []).append(n)
    fresh = [0.5] * lm.CLASSES
    for z, n in tokens.items():
        fresh[shape_of[z]] += n == 1
    base = [v / sum(fresh) / (1 + len(tokens)) for v in fresh]
    one = sum(c1.values())
    rest = sum(d[1][min(n, 3)] for n in c1.values()) / one

    def word(z, shape):
        n = c1.get(z, 0)
        return (n - d[1][min(n, 3)]) / one + rest * base[shape]

    def probability(x, y, z, shape):
        p = word(z, shape)
        for k, n, have in ((2, c2.get((y, z), 0), h2.get(y)), (3, c3.get((x, y, z), 0), h3.get((x, y)))):
            if have:
                p = (n - d[k][min(n, 3)]) / sum(have) + sum(d[k][min(v, 3)] for v in have) / sum(have) * p
        return p

    def perplexity(text):
        total = 0.0
        for x, y, z, w, shape, own in (e := events(text)):
            total += math.log(probability(x, y, z, shape))
            if shape <= lm.REPEAT:
                total += math.log(word(w, own))
        return math.exp(-total / len(e))

    return perplexity, probability, c1, shape_of


def test_perplexity_is_that_of_a_plain_model(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["A1,", "42", "Ää!", "##"]
    text = lambda n: " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(n))
    trusted = [text(rng.randint(1, 60)) for _ in range(80)] + ["so so so so so it is", "a"]
    others = [text(30) for _ in range(30)] + ["never seen words HERE 17 x#y", "it it it it", "a", "\t so  so\n it is ", " ".join(words * 5)]
    perplexity, probability, c1, shape_of = plain_kneser_ney(trusted)
    model = language_model.train(spark.createDataFrame([(t,) for t in trusted], "text string"), passes=2)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(trusted + others)], "doc_id bigint, text string").repartition(3)
    for options in ({}, {"groups": 3}):
        got = {r.doc_id: r.perplexity for r in language_model.perplexities(rows, model, **options).collect()}
        for i, t in enumerate(trusted + others):
            assert got[i] == pytest.approx(perplexity(t), rel=1e-9), t
    seen = sum(probability("<s>", "<s>", z, shape_of[z]) for z in c1)
    assert 0.5 < seen < 1
    language_model.forget(model)


def test_packing():
    g = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 1000))
    assert (language_model.unpack_ids(language_model.pack_ids(g)) == g).all()
    c = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (3, 50))
    assert (language_model.unpack_ints(language_model.pack_ints(*c), 3) == c).all()
    s = language_model.shard_of(g, 70_000)
    assert s.min() >= 0 and s.max() < 70_000 and (np.diff(s) >= 0).all()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, empty, width):
    rows, sets = docs.collect(), {}
    for k, r in enumerate(rows):
        w = WORD.findall(lower(r.text or ""))
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()
    parent = {k: k for k in sets}
    for a in sets:
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
                parent[find(parent, a)] = find(parent, b)
    least = {}
    for k, r in enumerate(rows):
        g = find(parent, k)
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, len(sets[k]), least.get(find(parent, k))) for k, r in enumerate(rows))
    out = minhash.near_duplicates(docs, width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_block_by_block(docs, monkeypatch):
    a = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 2).collect())
    monkeypatch.setattr(minhash, "PAIRS_PER_BUCKET", 0)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2000)
    assert a == Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 2).collect())


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    y = np.concatenate([x[:800], rng.integers(0, 1 << 62, 200).astype(np.uint64)])
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - 800 / 1200) < 0.15


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {x: x for e in links for x in e}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    half = spark.createDataFrame(links[:120], "a bigint, b bigint")
    rest = spark.createDataFrame(links[120:], "a bigint, b bigint")
    got = {r.node: r.comp for r in components(rest, components(half)).collect()}
    groups = defaultdict(set)
    for x in parent:
        groups[find(parent, x)].add(x)
    assert len(set(got.values())) == len(groups) and all(len({got[x] for x in g}) == 1 for g in groups.values())
    assert components(half.limit(0)).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = [int(x) for x in rng.integers(1, 60, 5)]
        h, starts, t = rng.integers(1, 1 << 30, sum(sizes)).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)]), 7
        want = []
        for d in range(5):
            for c in range(starts[d], starts[d + 1]):
                left = right = c
                while left > starts[d] and h[left - 1] > h[c]:
                    left -= 1
                while right < starts[d + 1] - 1 and h[right + 1] > h[c]:
                    right += 1
                if right - left + 1 >= t:
                    want.append((c, left, right))
        assert sorted(zip(*[x.tolist() for x in substring_dedup.compact_windows(h, starts, t)])) == want


def test_passages(docs, empty):
    rows = docs.collect()
    windows = defaultdict(set)
    for k, r in enumerate(rows):
        w = lower(r.text or "").split()
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(k)
    repeats = {rows[k].doc_id for v in windows.values() if len(v) > 1 for k in v}
    out = substring_dedup.repeated_passages(docs).collect()
    got = {r.doc_id: r for r in out}
    assert repeats <= set(got)
    assert len({got[i].class_id for i in range(0, 60, 6)}) == 1 and all(got[i].n_repeated >= 50 for i in range(0, 60, 6))
    assert all(s.end - s.start >= 50 for r in out for s in r.spans)
    assert not set(got) & {90, 91, 92, 93, 94, 95, 96, 97} and substring_dedup.repeated_passages(empty).count() == 0


def test_passages_of_repeated_ids(spark):
    """Texts that share a doc_id are each found, whatever body is fetched first."""
    word = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(None if i % 2 else 7, f"{word(f'own{i}x', 20)} {word(f'shared{i}x', 60)}") for i in range(12)]
    rows += [(100 + i, f"{word(f'shared{i}x', 60)} {word(f'rest{i}x', 20)}") for i in range(12)]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("per_group", [512, 0])
def test_passages_of_many_variants(spark, monkeypatch, per_group):
    """A passage and its variants, each with another word changed: all similar to the passage, few to one another."""
    monkeypatch.setattr(substring_dedup, "PAIRS_PER_GROUP", per_group)
    rows = []
    for p in range(12):
        base = [f"p{p}w{i}" for i in range(60)]
        rows.append((1000 * p, " ".join(base + [f"p{p}tail{i}" for i in range(200)])))
        for k in range(40):
            w = list(base)
            w[10 + k] = f"p{p}edit{k}"
            rows.append((1000 * p + 1 + k, " ".join(w + [f"p{p}k{k}end"])))
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    print("missing", len(rows) - len(got), "of", len(rows))
    assert len(got) >= 0.99 * len(rows) and all(r.class_id == i // 1000 * 1000 for i, r in got.items())


def test_edited_passages_are_found(spark):
    """Lone pairs of a 50-word passage with one changed word (similarity 0.8): recall, and no passage where there is none."""
    rng = np.random.default_rng(11)
    rows = []
    for p in range(600):
        w = [f"p{p}w{i}" for i in range(50)]
        v = list(w)
        v[int(rng.integers(5, 45))] = f"p{p}edit"
        for k, x in enumerate((w, v)):
            rows.append((2 * p + k, " ".join([f"p{p}a{k}b{i}" for i in range(80)] + x + [f"p{p}c{k}d{i}" for i in range(80)])))
    rows += [(5000 + i, " ".join([f"x{i}y{j}" for j in range(60)] + [f"line{j}" for j in range(30)] + [f"z{i}y{j}" for j in range(60)])) for i in range(100)]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = [p for p in range(600) if 2 * p in got and 2 * p + 1 in got and got[2 * p].class_id == got[2 * p + 1].class_id == 2 * p]
    assert len(found) >= 597 and all(80 <= s.start + 3 and s.end <= 133 for p in found for s in got[2 * p].spans)
    assert not [i for i in got if i >= 5000]  # a common line of 30 words is no passage


def test_passages_do_not_depend_on_sizes(spark, monkeypatch):
    """Every column of every row: what is frequent, how many texts a task joins and how many shards there are change nothing."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    base, line, rows = [text(120) for _ in range(3)], text(14), []
    for i in range(90):
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"]) + str(i)
        w = w[: rng.randint(60, 120)]
        rows.append((i, " ".join((text(30) if i % 4 else []) + w + (line if i % 2 else []) + text(rng.randint(0, 40)))))
    rows += [(100 + i, " ".join(text(40) + line + text(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lambda parts: sorted(substring_dedup.repeated_passages(docs.repartition(parts)).collect())
    want = got(2)
    for k, v in {"PAIRS_PER_GROUP": 0, "CHUNK_BYTES": 1 << 10, "SHARD_BYTES": 1 << 10}.items():
        monkeypatch.setattr(substring_dedup, k, v)
    assert got(7) == want and len(want) > 30 and not {r.doc_id for r in want} & set(range(100, 160))


def test_texts_of_a_family_are_fetched_by_group(spark):
    """All pairs of 300 texts, one text with 1000 others, and lone pairs: each pair once, far fewer copies of texts than pairs, no large group."""
    pairs = [(a, b) for a in range(300) for b in range(a)] + [(1000 + i, 999) for i in range(1000)] + [(5001 + 2 * i, 5000 + 2 * i) for i in range(50)]
    df = spark.createDataFrame([(a, b, None) for a, b in pairs], "a bigint, b bigint, at array<struct<c_a:int,c_b:int>>")
    got = substring_dedup._dealt(df).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(pairs)
    texts = defaultdict(set)
    for r in got:
        texts[r.group] |= {r.a, r.b}
    assert sum(map(len, texts.values())) < 300 * 12 + 1100 + 100 and max(map(len, texts.values())) < 4 * substring_dedup.BLOCK


def test_anchors_against_all_pairs_of_windows():
    """Pairs of texts with no, few and very many windows: each meets every other one that it overlaps with, however many lie between them."""
    rng = np.random.default_rng(5)
    texts = []
    for n in (0, 1, 60, 1800, 1800):
        c = np.sort(rng.integers(0, 3 * n + 1, n))
        key = np.sort(rng.choice(20_000 if n < 100 else 2500, n, replace=False) * 8 + rng.integers(0, 6, n)) if n else c
        out = rng.choice([3, 30, 9000], n), rng.choice([3, 30, 9000], n)
        texts.append(np.stack([key, rng.permutation(c), *[c] * 2]).astype(np.int64))
        texts[-1][2:] = texts[-1][1] - out[0], texts[-1][1] + out[1]
        texts[-1][2] = np.maximum(texts[-1][2], 0)
    pairs = np.array([(a, b) for a in range(5) for b in range(5)]).T
    some = 0
    for (a, b), got in zip(pairs.T, substring_dedup._anchors(texts, pairs, 46)):
        _, i, j = np.intersect1d(texts[a][0], texts[b][0], return_indices=True)
        x, y = texts[a][:, i], texts[b][:, j]
        good = (x[0] % 8)[:, None] != x[0] % 8
        for _, c, lo, hi in (x, y):
            left, right = np.maximum(lo[:, None], lo), np.minimum(hi[:, None], hi)
            good &= (left <= np.minimum(c[:, None], c)) & (np.maximum(c[:, None], c) <= right) & (right - left + 1 >= 46)
        good = good.any(axis=1)
        assert got == sorted(set(zip(x[1][good].tolist(), y[1][good].tolist())))
        some += len(got)
    assert some > 1000


def test_near_duplicate_passages_against_brute_force(spark):
    """All pairs of texts: a 50-word passage of one at similarity 0.8 or more to one of the other."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared, rows = [text(70) for _ in range(8)], []
    for i in range(120):
        body = text(rng.randint(20, 90))
        if i % 2:
            p = list(shared[rng.randrange(8)])
            for _ in range(rng.randint(0, 3)):
                p[rng.randrange(len(p))] = rng.choice(words)
            body += p
        rows.append((i, " ".join(body + text(rng.randint(5, 60)))))

    def shingles(t):
        w = t.split()
        return [hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)]

    def similar(a, b):  # runs of 46 shingles
        for i in range(len(a) - 45):
            x = set(a[i : i + 46])
            if len(x & b[1]) >= 40:
                for j in range(len(b[0]) - 45):
                    y = b[0][j : j + 46]
                    if 100 * len(x.intersection(y)) >= 80 * len(x.union(y)):
                        return True
        return False

    sets = [(s := shingles(t), set(s)) for _, t in rows]
    want = {i for i in range(120) for j in range(120) if i < j and similar(sets[i][0], sets[j]) for i in (i, j)}
    got = {r.doc_id for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want and len(got & want) >= 0.97 * len(want) and got <= {i for i in range(120) if i % 2}


def test_leaks(spark):
    q = "In May Tom Miller had 31 red apples in 4 large boxes and sold 12 of them to Ann for 25 dollars before Tom Miller went home with 7 euros"
    other = q.replace("Tom Miller", "Eva Stone").replace("31", "48").replace("Ann", "Kim").replace("dollars", "cents")
    mixed = "In May Tom Miller had 31 red apples in 4 large boxes and sold 12 of them to Ann for 25 dollars before Eva Stone went home with 7 euros"
    rows = [(1, f"some words before {q} and after it"), (2, f"Other words, {other}."), (3, "nothing of the kind is told in here at all"), (4, q[:60]), (5, None), (6, ""), (7, mixed), (1, f"x {q}"), (None, q)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, q, 1), (11, "too short", 1), (12, None, 1), (13, q, 2)], "item_id bigint, text string, doc_id int")
    out = decontaminate.find_leaks(df, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in out) == {(1, 10): 2, (1, 13): 2, (2, 10): 1, (2, 13): 1, (None, 10): 1, (None, 13): 1, (7, 10): 1, (7, 13): 1}
    assert {(r.n_slots, r.n_same) for r in out if r.doc_id == 7} == {(10, 9)}  # one of the ten slots in windows of three literals differs: still consistent enough
    left = decontaminate.decontaminate(df, items)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {3, 4, 5, 6}
    assert decontaminate.find_leaks(df.limit(0), items).count() == 0 and decontaminate.find_leaks(df, items.limit(0)).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    q = "Tom gives Ann one pear then Tom gives Ann two figs then Tom gives Ann six nuts then Tom gives Ann ten plums"
    names = iter("Abe Bea Cid Dan Eve Flo Gil Hal".split())
    mixed = re.sub("Tom|Ann", lambda _: next(names), q)
    df = spark.createDataFrame([(1, q), (2, q.replace("Tom", "Kim").replace("Ann", "Bob")), (3, mixed)], "doc_id bigint, text string")
    out = decontaminate.find_leaks(df, spark.createDataFrame([(1, q)], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in out} == {1, 2}


def test_an_inserted_word_does_not_reset_consistency(spark):
    item = "Tom Miller gave some bread to all of the birds near the river and then Tom Miller walked home along the old road with an empty basket and a happy heart under the evening sky that was red and gold over the hills"
    other = item.replace("Tom Miller gave", "Eve Stone gave").replace("Tom Miller walked", "Kim Young walked")
    same = item.replace("Tom Miller", "Eve Stone")
    wide = lambda t: t.replace("near the river", "near the wide river")
    rows = [(1, item), (2, wide(item)), (3, wide(same)), (4, wide(other)), (5, other), (6, f"{item} {same}"), (7, "word " * 30_000 + wide(same))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = decontaminate.find_leaks(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 6, 7}


def test_leaks_without_broadcast(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.item_id, r.n_matched) for r in df.collect())
    a = key(decontaminate.find_leaks(d, b))
    norm = lambda t: " ".join(t.split())
    items = [(r.item_id, norm(r.text)) for r in b.collect()]
    assert {x[:2] for x in a} == {(r.doc_id, i) for r in d.collect() for i, t in items if t in norm(r.text)}
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert a == key(decontaminate.find_leaks(d, b))
