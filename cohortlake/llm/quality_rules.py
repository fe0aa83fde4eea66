"""Quality rules: a learned decision list over text statistics (DataFrame functions only).

Statistics of every document are computed once, in one pass over the texts without a shuffle, and stored as a slim
table.  Sequential covering then learns rules for *bad* documents from the labelled ones: a conjunction grows by the
threshold literal with the best information gain on the growing rows (two thirds, by a hash of doc_id), is pruned to
the prefix that does best on the pruning rows, and is kept if it is precise enough on all of them; the rows it covers
are set aside and the next rule is grown.  Each growing step is one aggregation of all open labelled rows into a
(feature, bin) histogram, so learning takes any number of labelled rows and brings a fixed number of counts to the
driver.  The list is emitted as one ordered conditional expression (CASE WHEN rule 1 THEN false WHEN rule 2 ...).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, table, words_of, work_table

BASE_MIN_WORDS, BASE_MAX_REPEAT = 50, 50
CUTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "bang_ratio")
MAX_RULES, MAX_LITERALS, MIN_PRECISION, MIN_COVER = 16, 4, 0.9, 5


# --------------------------------------------------------------------------- statistics
def _trigrams(words: str) -> Column:
    """array<bigint>: a hash of the three words from each position."""
    n = F.size(words)
    w = F.col(words)
    three = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= 3, three).otherwise(F.array().cast("array<bigint>"))


def _sorted_with_positions() -> Column:
    """array<bigint>: the high bits of every window's hash with its position in the low ones, sorted as plain numbers."""
    return F.sort_array(F.transform("_cl_g", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_cl_low"))).bitwiseOR(i.cast("long"))))


def _repeat_positions() -> Column:
    """array<bigint>: the positions, in order, of the windows whose hash occurs twice or more.

    Equal hashes are neighbours in the sorted numbers; the whole hashes of neighbours that look equal are compared.  (A
    position would be missed only if another hash with the same high bits, at least 33 of them, stood between the two.)
    """
    s, low, g = F.col("_cl_s"), F.col("_cl_low"), F.col("_cl_g")

    def same(x: Column, y: Column) -> Column:
        at = lambda v: F.get(g, v.bitwiseAND(low).cast("int"))
        return F.coalesce((x.bitwiseXOR(y) <= low) & (x.bitwiseXOR(y) >= 0) & (at(x) == at(y)), F.lit(False))

    marked = F.filter(s, lambda v, i: same(v, F.get(s, i + 1)) | same(v, F.get(s, i - 1)))
    return F.sort_array(F.transform(marked, lambda v: v.bitwiseAND(low)))


def _union_length(at: str) -> Column:
    a, n = F.col(at), F.size(at)
    gaps = F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.least(F.lit(3), y - x))
    return F.when(n > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_bang", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words")
MARKED = r"[^#*$%&|<>!?\p{Lu}]+"  # all but the characters that are counted


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other counts.

    A null or empty text has all counts 0.  Columns of ``docs`` named like a count are replaced, whatever their case.
    """
    clash = {x.lower() for x in COUNTS}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    step = docs.select(*rest, words_of(t).alias("_cl_w"), lines.alias("_cl_l"), F.regexp_replace(t, MARKED, "").alias("_cl_m"))
    count = lambda c: c.cast("long")
    step = step.select(
        *rest, "_cl_w",
        count(F.size("_cl_w")).alias("n_words"),
        count(F.length(F.array_join("_cl_w", ""))).alias("word_chars"),
        count(F.length(F.regexp_replace("_cl_m", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        count(F.length(F.regexp_replace("_cl_m", r"[^\p{Lu}]+", ""))).alias("n_upper"),
        count(F.length(F.regexp_replace("_cl_m", r"[^!?]+", ""))).alias("n_bang"),
        count(F.size("_cl_l")).alias("n_lines"),
        count(F.size("_cl_l") - F.size(F.array_distinct("_cl_l"))).alias("n_dup_lines"),
        count(F.size(F.array_distinct("_cl_w"))).alias("n_distinct"),
    )
    step = step.select(*rest, *COUNTS[:-1], _trigrams("_cl_w").alias("_cl_g"))
    low = F.expr("shiftleft(1L, length(bin(size(_cl_g)))) - 1")
    step = step.select(*rest, *COUNTS[:-1], "_cl_g", low.alias("_cl_low"), (F.size(F.array_distinct("_cl_g")) < F.size("_cl_g")).alias("_cl_some"))
    step = step.withColumn("_cl_s", F.when(F.col("_cl_some"), _sorted_with_positions()).otherwise(F.array().cast("array<bigint>")))
    step = step.select(*rest, *COUNTS[:-1], _repeat_positions().alias("_cl_at"))
    return step.select(*rest, *COUNTS[:-1], _union_length("_cl_at").alias("n_repeat_words"))


def feature(name: str) -> Column:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "distinct_ratio": F.col("n_distinct") / n,
        "upper_ratio": F.col("n_upper") / n,
        "bang_ratio": F.col("n_bang") / n,
    }[name]


def base_failed() -> Column:
    return (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT * F.col("n_words"))


# --------------------------------------------------------------------------- learning
@dataclass(frozen=True)
class Literal:
    """feature > cut (above) or feature <= cut."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return feature(self.feature) > F.lit(self.cut) if self.above else feature(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Literal, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column()
    return out


def rejected(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true for what a rule rejects."""
    out = None
    for r in rules:
        out = F.when(_all(r), F.lit(True)) if out is None else out.when(_all(r), F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def _cuts(labelled: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: approximate quantiles of each feature over all and over the bad labelled rows."""
    q = F.array(*[F.lit(c) for c in CUTS])
    row = labelled.agg(
        *[F.percentile_approx(feature(f), q, 1000).alias(f"a_{f}") for f in FEATURES],
        *[F.percentile_approx(F.when(F.col("quality") == 0, feature(f)), q, 1000).alias(f"b_{f}") for f in FEATURES],
    ).first()
    return {f: sorted(set(row[f"a_{f}"] or []) | set(row[f"b_{f}"] or [])) for f in FEATURES}


def _histogram(open_rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each feature and bin: bad and good rows of the growing part, bad and good of the pruning part."""
    bins = []
    for f in FEATURES:
        value = feature(f)
        at = F.size(F.filter(F.lit(cuts[f]), lambda c: c < value)) if cuts[f] else F.lit(0)  # noqa: B023
        bins.append(F.struct(F.lit(f).alias("f"), at.alias("b")))
    long = open_rows.select("quality", "_cl_grow", F.explode(F.array(*bins)).alias("x"))
    bad, good, grow = F.col("quality") == 0, F.col("quality") != 0, F.col("_cl_grow")
    found = long.groupBy("x.f", "x.b").agg(*[F.count(F.when(c, 1)) for c in (grow & bad, grow & good, ~grow & bad, ~grow & good)]).collect()
    out = {f: [[0, 0, 0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
    for r in found:
        out[r[0]][r[1]] = list(r[2:])
    return out


def _best_literal(hist: dict[str, list[list[int]]], cuts: dict[str, list[float]], have: list[int]) -> tuple[float, Literal | None, list[int]]:
    """The literal with the best FOIL gain and the four counts that it leaves."""
    p0, n0 = have[0], have[1]
    best: tuple[float, Literal | None, list[int]] = (0.0, None, have)
    info0 = math.log2(p0 / (p0 + n0)) if p0 else 0.0
    for f in FEATURES:
        upto = [0, 0, 0, 0]
        for i, cut in enumerate(cuts[f]):
            upto = [a + b for a, b in zip(upto, hist[f][i])]
            for above, c in ((False, upto), (True, [h - u for h, u in zip(have, upto)])):
                if c[0] >= MIN_COVER and c[:2] != have[:2]:
                    gain = c[0] * (math.log2(c[0] / (c[0] + c[1])) - info0)
                    if gain > best[0] + 1e-9:
                        best = (gain, Literal(f, above, cut), list(c))
    return best


def _between(rows: DataFrame, x: Literal) -> Literal:
    """The literal with its cut half way between the labelled values on both sides: the same rows, the widest margin."""
    v = feature(x.feature)
    lo, hi = rows.agg(F.max(F.when(v <= x.cut, v)), F.min(F.when(v > x.cut, v))).first()
    return x if lo is None or hi is None else Literal(x.feature, x.above, (lo + hi) / 2)


def learn(labelled: DataFrame) -> list[Rule]:
    """Sequential covering over rows with the statistics and ``quality`` (0 bad, else good; null rows are left out).

    No labelled row, or none that is bad, gives an empty list.
    The list ends at the first rule that is not precise enough, or with ``MAX_RULES`` rules: a model of bounded size.
    """
    rows = labelled.where(F.col("quality").isNotNull()).withColumn("_cl_grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2)
    cuts = _cuts(rows)
    rules: list[Rule] = []
    if not any(cuts.values()):
        return rules
    while len(rules) < MAX_RULES:
        open_rows = rows.where(~rejected(rules))
        rule: list[Literal] = []
        steps: list[tuple[float, list[int]]] = []
        while len(rule) < MAX_LITERALS:
            hist = _histogram(open_rows.where(_all(tuple(rule))), cuts)
            have = [sum(h[i] for h in hist[FEATURES[0]]) for i in range(4)]
            if have[0] < MIN_COVER or (rule and have[1] == 0):
                break
            gain, literal, left = _best_literal(hist, cuts, have)
            if literal is None:
                break
            rule.append(_between(open_rows.where(_all(tuple(rule))), literal))
            steps.append(((left[2] - left[3]) / (left[2] + left[3]) if left[2] + left[3] else -1.0, left))
        if not rule:
            break
        keep = max(range(len(rule)), key=lambda i: (steps[i][0], -i)) + 1  # prune: the prefix that does best on the other rows
        c = steps[keep - 1][1]
        bad, good = c[0] + c[2], c[1] + c[3]
        if bad < MIN_COVER or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(tuple(rule[:keep]))
    return rules


def classify(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(documents without text but with the statistics, base_failed and kept; the rules).

    Labels may repeat a doc_id or name none of the documents; a null quality is no label.
    """
    stats = work_table(with_statistics(docs), "statistics")
    marks = labels.select(F.col("doc_id").alias("_cl_id"), F.col("quality").alias("quality"))
    labelled = stats.drop("quality").join(marks, F.col("doc_id") == F.col("_cl_id")).drop("_cl_id").where(~base_failed())
    rules = learn(work_table(labelled, "labelled"))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(rules)), rules


def op1_learned_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out, _ = classify(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
