import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, kept string, copies int"


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with nulls, empty and long texts, ties, repeated rows, near copies and clashing column names."""
    rng = random.Random(4)
    words = ["".join(rng.choice(["an", "the", "or", "in", "éa", "sch", "on"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, passage = [], text(60)
    for i in range(60):
        t = text(rng.randint(1, 200))
        if i % 6 == 0:
            t = t + "\n" + passage + "\n" + text(20)
        if i % 5 == 0:
            t += "\nThis very line stands in many documents of the table.\n  this very LINE stands in many documents of the table. "
        rows.append((i, t))
    base = text(150).split()
    for i in range(60, 80):  # near copies
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, rows[3][1]) for i in range(80, 90)]  # exact copies
    rows += [(90, None), (91, ""), (92, " \t\n "), (93, "one"), (94, "one"), (95, text(5000)), (96, "A b"), (97, "a B"), (None, text(70)), (98, rows[5][1].upper())]
    rows += [rows[1], rows[1]]
    full = [(i, t, ["en", "de", None][(i or 0) % 3], ["s1", "s2", None, "s0"][min(3, (i or 0) % 9)], 1, "x", "y", 7) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
