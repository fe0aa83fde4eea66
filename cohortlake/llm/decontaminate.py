"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

A text becomes canonical tokens: characters other than letters, digits and white space go; a token that starts with a
digit is the slot NUM, one that starts with an upper-case letter the slot NAME, a unit word the slot UNIT, and any
other token stays itself.  Windows of ``WIDTH`` canonical tokens of the benchmark items (those with at least
``MIN_LITERALS`` tokens that are not slots) are hash-joined with the windows of all documents.  Matches of a document
and an item fall into places of the document: an alignment (document position minus item position) is a place, and so
are all alignments of which neighbours differ by less than the item's length, so that inserted words don't part a copy.
A place is consistent if every value that the item has in its slots stands for one value all over it ("Ann has 3 apples,
Ann eats 1" matches "Bob has 7 apples, Bob eats 2", not "Bob has 7 apples, Eve eats 2").  A document leaks an item if one consistent
place covers at least ``SIMILARITY`` of the item's windows.

The documents' windows are never shuffled while the benchmark's fit in a broadcast of ``BROADCAST_WINDOWS`` rows (16
bytes each); beyond it both sides are shuffled by hash.  The texts of matched documents are fetched once more for the
slots.  A window is keyed by its document, so a passage that a third of the documents share makes no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_RE, table, work_table

WIDTH, SIMILARITY, MIN_LITERALS, CONSISTENCY = 5, 0.8, 3, 0.8
BROADCAST_WINDOWS = 1_000_000
NUM, NAME, UNIT = 1, 2, 3  # canonical values of the slots
UNITS = (
    "km", "kilometers", "kilometres", "cm", "mm", "meters", "metres", "miles", "mile", "feet", "inches", "yards",
    "kg", "kilograms", "grams", "mg", "pounds", "ounces", "tons", "liters", "litres", "ml", "gallons",
    "seconds", "minutes", "minute", "hours", "hour", "days", "weeks", "months", "years", "mph", "kmh",
    "percent", "dollars", "dollar", "euros", "euro", "cents", "degrees",
    "kilomètres", "mètres", "grammes", "heures", "heure", "jours", "semaines", "mois", "ans", "degrés",
    "kilómetros", "metros", "kilogramos", "gramos", "litros", "horas", "hora", "minutos", "segundos", "días", "semanas", "meses", "años", "grados",
)


def tokens_of(text: Column) -> Column:
    """array<string>: the text's tokens with punctuation and symbols taken out."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    t = F.btrim(t, F.lit(SPACE_CHARS))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE, -1))


def canonical(tokens: str, units: tuple[str, ...] = UNITS) -> Column:
    """array<bigint>: slots as 1, 2, 3, other tokens as hashes.  The first code point tells digits and capitals.

    Every capitalised word is a NAME, whatever it names, in documents and items alike: in a language that writes nouns
    with capitals more tokens are slots, and more windows fall short of ``MIN_LITERALS``.
    """

    def one(w: Column) -> Column:
        c = F.ascii(w)
        capital = c.between(65, 90) | ((c > 127) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)))
        return F.when(c.between(48, 57), F.lit(NUM)).when(capital, F.lit(NAME)).when(w.isin(*units), F.lit(UNIT)).otherwise(F.xxhash64(w))

    return F.transform(tokens, one)


def _windows(codes: str, width: int) -> Column:
    c, n = F.col(codes), F.size(codes)
    h = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(width)]))
    return F.when(n >= width, h).otherwise(F.array().cast("array<bigint>"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, units: tuple[str, ...] = UNITS) -> DataFrame:
    """(doc_id, _cl_text, item_id, n_windows, n_matched, n_slots, n_same): one row a document text and item that it leaks.

    n_matched of the item's n_windows are in the place with the most of them; n_same of its n_slots slots there agree.
    ``_cl_text`` is a hash of the text, so rows that repeat a doc_id with other texts are judged apart.  Items and
    documents with fewer than ``width`` tokens have no windows and neither leak nor are leaked; so are null texts.
    Items with equal texts are all reported.
    """
    items = benchmark.select("item_id", tokens_of(F.col("text")).alias("w")).withColumn("c", canonical("w", units))
    literal = F.aggregate(F.slice(F.col("c"), F.col("q") + 1, width), F.lit(0), lambda s, x: s + F.when((x >= NUM) & (x <= UNIT), 0).otherwise(1))
    slots = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct(j.alias("j"), F.get(F.col("c"), F.col("q") + j).alias("kind"), F.get(F.col("w"), F.col("q") + j).alias("value"))),
        lambda s: (s["kind"] >= NUM) & (s["kind"] <= UNIT),
    )
    windows = items.select("item_id", "w", "c", F.posexplode_outer(_windows("c", width)).alias("q", "h")).where(F.col("h").isNotNull() & (literal >= MIN_LITERALS))
    windows = work_table(windows.select("item_id", "q", "h", slots.alias("slots"), F.size("c").alias("length")), "benchmark")
    counts = windows.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    n = windows.count()
    small = (lambda d: F.broadcast(d)) if n <= BROADCAST_WINDOWS else (lambda d: d)

    rows = docs.select("doc_id", F.xxhash64("text", F.lit("leak")).alias("_cl_text"), F.col("text").alias("_cl_raw"))
    codes = rows.select("doc_id", "_cl_text", tokens_of(F.col("_cl_raw")).alias("w")).select("doc_id", "_cl_text", canonical("w", units).alias("c"))
    # the outer form: for the inner one a filter on the array's size would be pushed below and recompute it for each window
    long = codes.select("doc_id", "_cl_text", _windows("c", width).alias("hs")).select("doc_id", "_cl_text", F.posexplode_outer("hs").alias("p", "h"))
    hits = long.join(small(windows.select("h", "item_id", "q")), "h").select("doc_id", "_cl_text", "item_id", "q", "p").distinct()
    hits = work_table(hits, "hits")
    # only pairs that can reach the similarity go on
    seen = hits.select("doc_id", "_cl_text", "item_id", "q").distinct().groupBy("doc_id", "_cl_text", "item_id").agg(F.count("*").alias("m"))
    likely = seen.join(small(counts), "item_id").where(F.col("m") >= F.lit(similarity) * F.col("n_windows"))
    likely = work_table(likely.select("doc_id", "_cl_text", "item_id", "n_windows"), "likely")

    # the slots of the matches: tokens of the likely documents are fetched again
    l1, h1 = likely.alias("l"), hits.alias("h")
    pairs = h1.join(l1, F.col("h.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("h._cl_text") == F.col("l._cl_text")) & (F.col("h.item_id").eqNullSafe(F.col("l.item_id")))).select("h.*", "l.n_windows")
    pairs = pairs.join(small(windows.select("item_id", "q", "slots", "length")), ["item_id", "q"])
    wanted = likely.select(F.col("doc_id").alias("_cl_id"), F.col("_cl_text").alias("_cl_key")).distinct()
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_cl_id")) & (F.col("_cl_text") == F.col("_cl_key"))).dropDuplicates(["doc_id", "_cl_text"])
    found = found.select("doc_id", "_cl_text", tokens_of(F.col("_cl_raw")).alias("w"))
    p, d = pairs.alias("p"), found.alias("d")
    both = p.join(d, F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("p._cl_text") == F.col("d._cl_text")))
    at = F.transform("slots", lambda s: F.struct((F.col("q") + s["j"]).alias("at"), s["kind"].alias("kind"), s["value"].alias("mine"), F.get(F.col("w"), F.col("p") + s["j"]).alias("theirs")))
    pair = ["doc_id", "_cl_text", "item_id", "n_windows"]
    lined = both.select(*[F.col(f"p.{c}") if c in ("doc_id", "_cl_text") else F.col(c) for c in pair], "length", "q", (F.col("p") - F.col("q")).alias("shift"), at.alias("at"))
    along = Window.partitionBy("doc_id", "_cl_text", "item_id").orderBy("shift")
    lined = lined.withColumn("_new", (F.col("shift") - F.lag("shift").over(along) >= F.col("length")).cast("int"))
    near = F.coalesce(F.sum("_new").over(along.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))
    places = F.array(F.struct(F.lit(0).alias("kind"), F.col("shift").cast("long").alias("at")), F.struct(F.lit(1).alias("kind"), near.cast("long").alias("at")))
    lined = work_table(lined.withColumn("place", places).select(*pair, "q", "at", F.explode("place").alias("place")), "lined")
    key = [*pair, "place"]
    covered = lined.groupBy(*key).agg(F.count_distinct("q").alias("m")).where(F.col("m") >= F.lit(similarity) * F.col("n_windows"))
    # each slot position counts once in a place for each value found there, in however many windows it stands
    slot = lined.select(*key, F.explode("at").alias("s")).select(*key, "s.*").distinct()
    pick = slot.groupBy(*key, F.col("kind"), "mine", "theirs").agg(F.count("*").alias("n")).groupBy(*key, "kind", "mine").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    agree = pick.groupBy(*key).agg(F.sum("n").alias("n_slots"), F.sum("top").alias("n_same"))
    a, c = covered.alias("a"), agree.alias("c")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}"))
    good = a.join(c, on, "left").select("a.*", F.coalesce("c.n_slots", F.lit(0)).alias("n_slots"), F.coalesce("c.n_same", F.lit(0)).alias("n_same"))
    good = good.where(F.col("n_same") >= F.lit(CONSISTENCY) * F.col("n_slots"))
    out = good.groupBy(*pair).agg(F.max(F.struct("m", "n_slots", "n_same")).alias("best")).select(*pair, "best.*")
    return out.select("doc_id", "_cl_text", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("m").cast("long").alias("n_matched"), F.col("n_slots").cast("long").alias("n_slots"), F.col("n_same").cast("long").alias("n_same"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_cl_id"), F.col("_cl_text").alias("_cl_key")).distinct()
    keyed = docs.withColumn("_cl_text", F.xxhash64("text", F.lit("leak")))
    return keyed.join(leaks, F.col("doc_id").eqNullSafe(F.col("_cl_id")) & (F.col("_cl_text") == F.col("_cl_key")), "left_anti").drop("_cl_text")


def op9_template_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return find_leaks(docs, items).drop("_cl_text")


_IN = ", ".join(f"'{u}'" for u in UNITS)
_CODE = f"""CASE WHEN unicode(w) BETWEEN 48 AND 57 THEN '#1' WHEN unicode(w) BETWEEN 65 AND 90 OR (unicode(w) > 127 AND lower(substr(w, 1, 1)) <> substr(w, 1, 1)) THEN '#2' WHEN w IN ({_IN}) THEN '#3' ELSE w END"""


def _token_sql(name: str, source: str, key: str) -> str:
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""{name}_t AS (SELECT {key}, trim(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'), {space}) AS t FROM {source}),
{name}_l AS (SELECT {key}, string_split_regex(t, '[\\x20\\x09-\\x0D]+') AS parts FROM {name}_t WHERE length(t) > 0),
{name}_w AS (SELECT {key}, unnest(parts) AS w, generate_subscripts(parts, 1) - 1 AS i FROM {name}_l),
{name}_c AS (SELECT {key}, i, w, {_CODE} AS c FROM {name}_w),
{name}_x AS (SELECT {key}, i AS p, c || ' ' || lead(c, 1) OVER o || ' ' || lead(c, 2) OVER o || ' ' || lead(c, 3) OVER o || ' ' || lead(c, 4) OVER o AS win,
  CAST(c NOT LIKE '#%' AS INTEGER) + CAST(lead(c, 1) OVER o NOT LIKE '#%' AS INTEGER) + CAST(lead(c, 2) OVER o NOT LIKE '#%' AS INTEGER) + CAST(lead(c, 3) OVER o NOT LIKE '#%' AS INTEGER) + CAST(lead(c, 4) OVER o NOT LIKE '#%' AS INTEGER) AS literals
  FROM {name}_c WINDOW o AS (PARTITION BY {key} ORDER BY i))"""


OP9_SQL = f"""
WITH {_token_sql("d", "documents", "doc_id")},
{_token_sql("b", "benchmark", "item_id")},
bw AS (SELECT item_id, p AS q, win FROM b_x WHERE win IS NOT NULL AND literals >= {MIN_LITERALS}),
n AS (SELECT item_id, count(*) AS n_windows FROM bw GROUP BY item_id), sizes AS (SELECT item_id, count(*) AS length FROM b_c GROUP BY item_id),
hits AS (SELECT DISTINCT d_x.doc_id, bw.item_id, bw.q, d_x.p FROM d_x JOIN bw ON d_x.win = bw.win),
likely AS (SELECT m.doc_id, m.item_id, n.n_windows FROM (SELECT doc_id, item_id, count(DISTINCT q) AS m FROM hits GROUP BY 1, 2) m JOIN n ON m.item_id = n.item_id WHERE m.m >= {SIMILARITY} * n.n_windows),
pairs AS (SELECT h.*, l.n_windows, s.length, h.p - h.q AS shift FROM hits h JOIN likely l ON h.doc_id = l.doc_id AND h.item_id = l.item_id JOIN sizes s ON s.item_id = h.item_id),
steps AS (SELECT *, CAST(shift - lag(shift) OVER (PARTITION BY doc_id, item_id ORDER BY shift) >= length AS INTEGER) AS new FROM pairs),
near AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY shift RANGE UNBOUNDED PRECEDING), 0) AS island FROM steps),
lined AS (SELECT doc_id, item_id, n_windows, q, p, 'a' AS sort, shift AS place FROM near UNION ALL SELECT doc_id, item_id, n_windows, q, p, 'b', island FROM near),
covered AS (SELECT doc_id, item_id, n_windows, sort, place, count(DISTINCT q) AS m FROM lined GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT q) >= {SIMILARITY} * n_windows),
slot AS (SELECT DISTINCT x.doc_id, x.item_id, x.sort, x.place, b_c.i AS at_, b_c.c AS kind, b_c.w AS mine, d_c.w AS theirs
  FROM (SELECT lined.*, j FROM lined CROSS JOIN range(0, {WIDTH}) t(j)) x JOIN b_c ON b_c.item_id = x.item_id AND b_c.i = x.q + x.j JOIN d_c ON d_c.doc_id = x.doc_id AND d_c.i = x.p + x.j WHERE b_c.c LIKE '#%'),
pick AS (SELECT doc_id, item_id, sort, place, kind, mine, sum(k) AS k, max(k) AS top FROM (SELECT doc_id, item_id, sort, place, kind, mine, theirs, count(*) AS k FROM slot GROUP BY 1, 2, 3, 4, 5, 6, 7) GROUP BY 1, 2, 3, 4, 5, 6),
same AS (SELECT doc_id, item_id, sort, place, sum(k) AS n_slots, sum(top) AS n_same FROM pick GROUP BY 1, 2, 3, 4),
good AS (SELECT c.*, coalesce(s.n_slots, 0) AS n_slots, coalesce(s.n_same, 0) AS n_same FROM covered c LEFT JOIN same s ON c.doc_id = s.doc_id AND c.item_id = s.item_id AND c.sort = s.sort AND c.place = s.place),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, n_slots DESC, n_same DESC) AS k FROM good WHERE n_same >= {CONSISTENCY} * n_slots)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(m AS BIGINT) AS n_matched, CAST(n_slots AS BIGINT) AS n_slots, CAST(n_same AS BIGINT) AS n_same FROM best WHERE k = 1
"""
