"""Operator 3, benchmark decontamination by template canonicalisation.

Numbers, names and units of a text are replaced by typed placeholders (a
number; a capitalised word inside a sentence; a unit word after a number), the
rest is lower-cased, and windows of ``WINDOW`` template tokens are hashed.  A
document that holds ``SIMILARITY`` or more of the windows of a benchmark item
is a candidate; along the alignment with most windows the fillers of the slots
are compared: the question counts as re-used if at least ``SIMILARITY`` of the
item's fillers are replaced consistently (one filler by one filler
everywhere).  So a copy is caught, and also a copy with other numbers or names.

Which words are names hangs on capitals, so each text also has windows of a
second, plain form: lower-cased, with placeholders for numbers and units only.
A copy in other letter case is found by these.  Both forms first collapse white
space and drop quotes around words; a run of names is one slot.

Scale: the benchmark's windows are broadcast below a counted bound
(``MAX_BENCHMARK_WINDOWS``), so documents are exploded and probed where they
lie; beyond it the windows are joined by a shuffle on their hash, which AQE
splits.  Only matched windows are grouped, and only candidates are read again
for their slots.

Defined results: null or empty texts, and items of fewer than ``WINDOW`` tokens
(or without a window of two literal words), match nothing; repeated rows of
documents or items give one verdict; other columns pass through
:func:`remove_contaminated` whatever their names; an empty table of documents or
items gives no verdict.  Ties between alignments go to the larger shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import cut, packed, text_of

WINDOW = 5
SIMILARITY = 0.8
MAX_BENCHMARK_WINDOWS = 500_000          # 16 bytes each and a hash table: some 30 MB

# Unit words; characters that mark the placeholders.  They are ASCII, so that texts in
# ASCII stay so: other texts are much slower to match and to lower-case.
UNITS = ["percent", "kg", "g", "mg", "km", "m", "cm", "mm", "miles?", "feet", "foot", "inch(?:es)?", "pounds?", "lbs?",
         "litres?", "liters?", "ml", "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?", "years?",
         "dollars?", "euros?", "cents?", "usd", "eur", "degrees?", "celsius", "fahrenheit", "mph", "kmh", "volts?",
         "watts?", "joules?", "newtons?", "hz", "mb", "gb"]
NAME, NUMBER, UNIT, POINT = MARKS = "\x01\x02\x03\x04"
OTHER = "\x05"                           # in a text's own control characters' stead
GIVEN = "\ue001\ue002\ue003\ue004"      # placeholders if a text has them itself
QUOTES = "[\"'`«»‘-‟‹›]"
# Every pattern begins with the rare characters it is about and looks back from there: a
# look-behind in front would be tried at every character of a text.
QUOTE_AT = f"{QUOTES}(?:(?<![\\p{{L}}\\p{{N}}]{QUOTES})|(?![\\p{{L}}\\p{{N}}]))"
SPACE_AT = "[\\s\\x{A0}](?:(?<! )[\\s\\x{A0}]*|[\\s\\x{A0}]+)"      # but not a single space
POINT_AT = "[.,](?<=[0-9][.,])(?=[0-9])"
NAME_AT = "\\p{Lu}(?<=[\\p{L}\\p{N},;:] \\p{Lu})\\p{Ll}+(?![\\p{L}])"
# the rest of a run of names: the literal comes first, so that the look-behind is tried at names only
RUN_AT = f" {NAME}(?<={NAME}\\p{{L}}{{0,200}} {NAME})"
NUMBER_AT = f"[0-9](?<![\\p{{L}}\\p{{N}}{POINT}][0-9])[0-9{POINT}]*(?![\\p{{L}}])"
UNIT_AT = f" (?<=[0-9{NUMBER}] )((?i:{'|'.join(UNITS)}))(?![\\p{{L}}\\p{{N}}])"


def folded(text: Column) -> Column:
    """A text without quotes around words, with single spaces, and with a mark
    for the points inside numbers: what both forms begin with."""
    freed = text
    for mark in MARKS:
        freed = F.replace(freed, F.lit(mark), F.lit(OTHER))
    for given, mark in zip(GIVEN, MARKS):
        freed = F.replace(freed, F.lit(given), F.lit(mark))
    text = F.when(text.rlike(f"[{MARKS}{GIVEN}]"), freed).otherwise(text)
    x = F.regexp_replace(F.regexp_replace(text, QUOTE_AT, ""), SPACE_AT, " ")
    return F.regexp_replace(x, POINT_AT, POINT)


def template_tokens(x: Column, fillers: bool = False, plain: bool = False) -> Column:
    """Template tokens of a folded text in order; with ``fillers`` a placeholder
    is followed by what it stands for (the places are the same); ``plain`` keeps
    names as words."""
    keep = "$0" if fillers else ""
    if not plain:
        x = F.regexp_replace(x, NAME_AT, NAME + keep)
        x = F.regexp_replace(x, RUN_AT, POINT if fillers else "")
    x = F.regexp_replace(x, UNIT_AT, f" {UNIT}" + ("$1" if fillers else ""))
    x = F.regexp_replace(x, NUMBER_AT, NUMBER + keep)
    return F.array_remove(F.split(F.lower(x), f"[^a-z0-9\\p{{L}}\\p{{N}}{NAME}-{POINT}]+"), "")


def both_forms(x: Column) -> Column:
    """(form, k) of a folded text: 0 with names replaced, 1 plain."""
    return F.array(*[F.struct(F.lit(form).alias("form"), template_tokens(x, plain=form == 1).alias("k"))
                     for form in (0, 1)])


def with_windows(rows: DataFrame, hashes: str, at: str, n: int = WINDOW) -> DataFrame:
    """One row for each window of ``n`` tokens (none below ``n``), with its place
    ``at`` and hash ``h``, from the hashes of a form's tokens: a token's letters
    are read once, not once a window.  The window's tokens are zipped and hashed
    after they are exploded, in compiled code."""
    kh = F.col(hashes)
    size = F.greatest(F.size(kh) - n + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice(kh, k + 1, size).alias(f"t{k}") for k in range(n)])
    keep = [c for c in rows.columns if c != hashes]
    return rows.select(*keep, F.posexplode(zipped).alias(at, "_w")).select(
        *keep, at, F.xxhash64("form", *[f"_w.t{k}" for k in range(n)]).alias("h"))


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, ith, form, j, h, need): the windows of at least two literal words, and
    how many of an item's distinct windows a document must hold."""
    b = bench.select(F.col(item_col).alias("item_id"), text_of(text_col).alias("_t")).distinct()
    b = b.select("item_id", F.xxhash64("_t").alias("ith"), folded(F.col("_t")).alias("_x"))
    b = b.select("item_id", "ith", F.inline(both_forms(F.col("_x"))))
    b = b.withColumnRenamed("k", "_k").withColumn("_kh", token_hashes(F.col("_k")))
    w = with_windows(b, "_kh", "j")
    literal = F.size(F.filter(F.slice("_k", F.col("j") + 1, WINDOW),
                              lambda x: ~x.rlike(f"^[{NAME}-{POINT}]"))) >= 2
    w = w.filter(literal).select("item_id", "ith", "form", "j", "h")
    need = w.groupBy("item_id", "ith", "form").agg(F.ceil(F.count_distinct("h") * SIMILARITY).alias("need"))
    return w.join(need, ["item_id", "ith", "form"])


def candidates(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, ith, form, n_matched, need, shift): documents that hold
    enough of an item's windows, and the alignment that most of them have.
    ``docs`` has doc_id, text; ``bench`` item_id, text."""
    b = cut(benchmark_windows(bench), "benchmark-windows")
    if b.count() <= MAX_BENCHMARK_WINDOWS:
        b = F.broadcast(b)
    d = docs.select("doc_id", text_of().alias("_t")).select(
        "doc_id", F.xxhash64("_t").alias("th"), folded(F.col("_t")).alias("_x"))
    d = d.select("doc_id", "th", F.inline(both_forms(F.col("_x"))))
    d = d.select("doc_id", "th", "form", token_hashes(F.col("k")).alias("kh"))
    d = with_windows(d, "kh", "i")
    hits = d.drop("form").join(b, "h").groupBy("doc_id", "th", "item_id", "ith", "form", "need",
                                  (F.col("i") - F.col("j")).alias("shift")).agg(
        F.collect_set("h").alias("hs"))
    # at most one entry for each distinct window of the item: bounded by the item
    per = hits.groupBy("doc_id", "th", "item_id", "ith", "form", "need").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).alias("n_matched"),
        F.max(F.struct(F.size("hs").alias("n"), F.col("shift"))).alias("best"))
    return per.filter(F.col("n_matched") >= F.col("need")).select(
        "doc_id", "th", "item_id", "ith", "form", "n_matched", "need", F.col("best.shift").alias("shift"))


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that it re-uses: ``doc_id, item_id,
    n_windows (needed), n_matched, n_slots, n_consistent`` and the key ``th``
    (hash of the text) of the document's row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    b = bench.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    c = cut(candidates(d, b), "benchmark-candidates")
    texts = d.select("doc_id", text_of().alias("_t")).distinct().withColumn("th", F.xxhash64("_t"))
    keys = c.select("doc_id", "th").distinct()
    texts = texts.join(keys, texts.doc_id.eqNullSafe(keys.doc_id) & (texts.th == keys.th), "left_semi").select(
        "doc_id", "th", template_tokens(folded(F.col("_t")), True).alias("dk0"), template_tokens(folded(F.col("_t")), True, True).alias("dk1"))
    items = b.select("item_id", text_of().alias("_t")).distinct().select(
        "item_id", F.xxhash64("_t").alias("ith"), template_tokens(folded(F.col("_t")), True).alias("ik0"),
        template_tokens(folded(F.col("_t")), True, True).alias("ik1"))
    c = c.join(items.withColumnRenamed("item_id", "_i"),
               F.col("item_id").eqNullSafe(F.col("_i")) & (c.ith == items.ith)).drop("_i").drop(items.ith)
    c = c.join(texts.withColumnRenamed("doc_id", "_d"),
               F.col("doc_id").eqNullSafe(F.col("_d")) & (c.th == texts.th)).drop("_d").drop(texts.th)
    c = c.withColumns({x: F.when(F.col("form") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1")) for x in ("ik", "dk")}).drop(
        "ik0", "ik1", "dk0", "dk1")
    mark = f"^[{NAME}-{UNIT}]"
    slots = F.filter(
        F.transform("ik", lambda x, j: F.struct(x.alias("item"), F.get("dk", j + F.col("shift")).alias("doc"))),
        lambda s: s["item"].rlike(mark) & (F.substring(s["item"], 1, 1) == F.substring(s["doc"], 1, 1)))
    c = c.withColumn("_s", F.array_distinct(slots)).drop("ik", "dk")
    fillers = F.array_distinct(F.transform("_s", lambda s: s["item"]))
    c = c.withColumn("_f", fillers)
    one = F.size(F.filter("_f", lambda f: F.size(F.filter("_s", lambda s: s["item"] == f)) == 1))
    c = c.select("doc_id", "th", "item_id", c.ith, "form", F.col("need").cast("long").alias("n_windows"),
                 F.col("n_matched").cast("long").alias("n_matched"), F.size("_f").cast("long").alias("n_slots"),
                 one.cast("long").alias("n_consistent"))
    c = c.filter(F.col("n_consistent") >= F.col("n_slots") * SIMILARITY)
    # one verdict: of the form with names, if both hold
    names = ["n_windows", "n_matched", "n_slots", "n_consistent"]
    return c.groupBy("doc_id", "th", "item_id", "ith").agg(F.min(F.struct("form", *names)).alias("_v")).select(
        "doc_id", "th", "item_id", *[F.col(f"_v.{n}").alias(n) for n in names])


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that re-use no item, with their columns as they are."""
    bad = cut(contaminated(docs, bench, id_col, text_col).select("doc_id", "th").distinct(), "contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_th"))
    rows = packed(docs, id_col, text_col)
    return rows.join(bad, (F.xxhash64(text_of()) == F.col("_bad_th"))
                     & F.col("doc_id").eqNullSafe(F.col("_bad_id")), "left_anti").select("_row.*")
