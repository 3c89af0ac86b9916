"""Benchmark decontamination by template windows with consistent slots (DataFrame functions only).

Texts are put in template form: numbers, units after them and names (a
capitalised word inside a sentence, not one in capitals throughout) become
typed placeholders, case and outer punctuation go, and every word stays at its place.  Windows of ``width``
template words of a benchmark item are hash-joined with the words of the
documents: first the five words a window starts with, then the hash of the
whole window.  Both are also taken in a form without case in which names stay
words, so a copy in another case is found.  A re-parameterised question matches although its numbers and
names differ; it counts only if the slots agree, that is if each value of the
item is replaced by one value throughout an occurrence: the matches that lie at
one distance between the places in document and item.  One such occurrence is
enough, whatever else the document holds.  A window without slots, or with the
item's own values in all of them, is a literal match and always counts.  A
window of which less than half are words is compared with its numbers (and
names) as they are.

The distinct hashes of window starts (8 bytes each) are broadcast only while
there are at most ``max_broadcast``; beyond, the same join is shuffled.

No row holds a text's words once per place: what is needed of a place is cut
out before the places become rows.  Texts are matched, and the ids that share
one are joined at the end, so repeated items cost no more than their rows.

Defined cases: a null or empty text matches nothing; items with fewer than
``min_words`` words are not searched, items shorter than a window are one
window; every distinct (item_id, text) is an item, with ``item_hash`` to tell
the texts of one id or of none apart (a text without an id that also has one is
no further item); rows with one (doc_id, text) are one document; null doc ids
are kept apart by their texts; extra columns are ignored by ``matches`` and kept by
``remove_contaminated``.  Empty tables match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WORD_GAP, Scratch, unused

NUM, UNIT, NAME = "\ue001", "\ue002", "\ue003"  # private-use characters stand for the slots
SLOT = f"[{NUM}{UNIT}{NAME}]"
START = 5  # words that the first, cheap join compares
#: Units of measure that may follow a number (fixed list).
UNITS = ("mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l gal s sec secs second seconds min mins minute minutes h hr "
         "hrs hour hours day days week weeks month months year years mph kmh km/h hz khz mhz ghz w kw mwh kwh v a j kj "
         "cal kcal n pa kpa bar k c f b kb mb gb tb meter meters metre metres kilometer kilometers kilometre kilometres "
         "mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter "
         "liters litre litres dollar dollars euro euros cent cents percent % degrees").split()
_END = "[.,;:!?\"')\\]}]"


def slotted(text: Column) -> Column:
    """The text with numbers and their units as placeholders.

    Each pattern starts with the character class it looks for and looks behind
    only there, so a text is passed over once per pattern.
    """
    t = F.regexp_replace(text, r"[0-9](?<![\p{L}0-9_].)[0-9]*+(?:[.,:/][0-9]+)*+", NUM)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    return F.regexp_replace(t, rf"({NUM}[ -]?)(?i:{units})(?![\p{{L}}0-9_])", f"$1{UNIT}")


def named(text: Column) -> Column:
    """A slotted text with names as placeholders, too."""
    # a word in capitals throughout is no name: whole texts are written so
    return F.regexp_replace(text, rf"\p{{Lu}}(?<=[\p{{L}}\p{{N}},;{NUM}{UNIT}{NAME}] .)(?:(?=\p{{L}}*\p{{Ll}})\p{{L}}++|(?!\p{{L}}))", NAME)


def folded(text: Column) -> Column:
    """The text without case and outer punctuation, with the same number of words."""
    t = F.regexp_replace(F.lower(text), rf"{_END}(?<=[^\x20\x09-\x0D].){_END}*+(?![^\x20\x09-\x0D])", "")
    return F.regexp_replace(t, r"[(\[{\"'](?<![^\x20\x09-\x0D].)(?=[^\x20\x09-\x0D])", "")


def words(text: Column) -> Column:
    """Words of a text; one empty word for a text without any."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), WORD_GAP)


#: Forms of a text, word by word: with all placeholders, with names as words (for texts in another case), without placeholders.
FORMS = ("tpl", "low", "lit")


def with_words(df: DataFrame) -> DataFrame:
    """``raw``, and a column per form of FORMS: the words of ``text``, place by place."""
    return (df.withColumn("raw", words(F.col("text"))).withColumn("_t", slotted(F.col("text")))
            .withColumn("tpl", words(folded(named(F.col("_t"))))).withColumn("low", words(folded(F.col("_t"))))
            .withColumn("lit", words(folded(F.col("text")))).drop("_t"))


def starts() -> Column:
    """The START words of every form from every place where as many follow, as structs tpl0 .. lit4."""
    n = F.greatest(F.size("tpl") - (START - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(f, k + 1, n).alias(f"{f}{k}") for f in FORMS for k in range(START)])


def start_hashes(s: str) -> Column:
    """The distinct hashes of the START words of the forms at a place."""
    return F.array_distinct(F.array(*[F.xxhash64(*[F.col(f"{s}.{f}{k}") for k in range(START)]) for f in FORMS]))


def window(text_words: Column, p: Column, n: Column) -> Column:
    """The n words from place p on; within a function over arrays ``slice`` would copy all words each time."""
    return F.transform(F.sequence(p, p + n - 1), lambda i: F.get(text_words, i))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_hash, text): the distinct items."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    # a text that also has an id is not another item without one
    known = rows.where("item_id is not null").select("text").distinct()
    rows = rows.where("item_id is not null").union(rows.where("item_id is null").join(known, "text", "left_anti").select("item_id", "text"))
    return rows.withColumn("item_hash", F.xxhash64("text"))


def benchmark_windows(items: DataFrame, width: int, min_words: int) -> DataFrame:
    """(start, len, whash, item_hash, ipos, ivals, part): the windows of every item's text in the forms that suit them.

    A form suits if at least half of its words are no placeholders; without
    placeholders it is taken where the case-folded one does not suit.
    """
    size = F.size("tpl")
    item = with_words(items.select("item_hash", "text").distinct())
    item = item.where(size >= F.lit(max(START, min_words))).withColumn("len", F.least(size, F.lit(width)))

    def suits(part: Column) -> Column:
        return 2 * F.size(F.filter(part, lambda w: ~w.rlike(SLOT))) >= F.col("len")

    def at(ipos: Column) -> Column:
        tpl, low, lit, raw = (window(F.col(f), ipos, F.col("len")) for f in (*FORMS, "raw"))
        parts = F.array_distinct(F.array_compact(F.array(F.when(suits(tpl), tpl), F.when(suits(low), low).otherwise(lit))))
        return F.struct(ipos.alias("ipos"), raw.alias("ivals"), parts.alias("parts"))

    return (item.select("len", "item_hash", F.explode(F.transform(F.sequence(F.lit(0), size - F.col("len")), at)).alias("w"))
            .select("len", "item_hash", "w.ipos", "w.ivals", F.explode("w.parts").alias("part"))
            .select(F.xxhash64(*[F.col("part")[k] for k in range(START)]).alias("start"), "len", F.xxhash64("part").alias("whash"),
                    "item_hash", "ipos", "ivals", "part"))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, min_words: int = START,
            max_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, item_id, item_hash, n_windows, n_slots, exact) of the contaminated documents.

    ``n_windows``: item places found in counted occurrences; ``n_slots``: most
    values in one of them; ``exact``: all slots of one hold the item's own values.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.write(benchmark_items(benchmark), "items")
    windows = scratch.write(benchmark_windows(items, width, min_words), "windows")
    heads = windows.select("start").distinct()
    small = heads.limit(max_broadcast + 1).count() <= max_broadcast  # 8 bytes each
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # the words are a column of their own: inside the generator they would be made once per slice
    at = (with_words(doc).select("doc_id", "text_hash", *FORMS)
          .select("doc_id", "text_hash", F.posexplode(starts()).alias("p", "s"))
          .select("doc_id", "text_hash", "p", F.explode(start_hashes("s")).alias("start")))
    place = scratch.write(at.join(F.broadcast(heads) if small else heads, "start"), "places")
    spots = (place.join(windows.select("start", "len").distinct(), "start")
             .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
             .agg(F.collect_set(F.struct("p", "len")).alias("spots")))
    both = doc.join(spots, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")))

    def hits(spot: Column) -> Column:
        """A struct for each hash that the forms of the window at a place have."""
        cut = [window(F.col(f), spot["p"], spot["len"]) for f in (*FORMS, "raw")]
        return F.transform(F.array_distinct(F.array(*[F.xxhash64(part) for part in cut[:-1]])), lambda w: F.struct(
            spot["p"].alias("p"), spot["len"].alias("len"), w.alias("whash"), cut[-1].alias("dvals")))

    # inside the generator: rows that hold the words would be kept once per place, for all places of a text at a time
    hit = (with_words(both).select("doc_id", "text_hash", F.explode(F.flatten(F.transform("spots", hits))).alias("h"))
           .select("doc_id", "text_hash", "h.*"))
    slots = F.filter(F.arrays_zip("part", "ivals", "dvals"), lambda z: z["part"].rlike(SLOT))
    found = scratch.write(hit.join(windows.drop("start"), ["len", "whash"])
                          .select("doc_id", "text_hash", "item_hash", "ipos", (F.col("p") - F.col("ipos")).alias("at"),
                                  F.transform(slots, lambda z: F.struct(
                                      trim_word(z["ivals"]).alias("i"), trim_word(z["dvals"]).alias("d"))).alias("slots")), "found")
    pair = ["doc_id", "text_hash", "item_hash"]
    own = F.forall("slots", lambda z: z["i"] == z["d"])
    # a window without slots stays, as one row without a value
    values = (found.select(*pair, "at", "ipos", own.alias("own"), F.explode_outer("slots").alias("s"))
              .groupBy(*pair, "at", F.col("s.i").alias("i"))
              .agg(F.min("s.d").alias("lo"), F.max("s.d").alias("hi"), F.max("own").alias("own"), F.collect_set("ipos").alias("w")))
    occurrence = values.groupBy(*pair, "at").agg(
        F.count("i").alias("n_slots"), F.coalesce(F.max(F.col("lo") != F.col("hi")), F.lit(False)).alias("clash"),
        F.coalesce(F.min((F.col("lo") == F.col("i")) & (F.col("hi") == F.col("i"))), F.lit(True)).alias("same"),
        F.max("own").alias("own"), F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
    texts = (occurrence.where(F.col("own") | ~F.col("clash")).groupBy(*pair)
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("w")))).cast("long").alias("n_windows"),
                  F.max("n_slots").alias("n_slots"), F.max("same").alias("exact")))
    return (texts.join(items.select("item_id", "item_hash"), "item_hash")
            .select("doc_id", "text_hash", "item_id", "item_hash", "n_windows", "n_slots", "exact"))


def trim_word(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, r"^[(\[{\"']+|[.,;:!?\"')\]}]+$", ""))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    names = docs.columns
    own, th, bad_id, bad_th = unused(docs, "_id", "_th", "_bad", "_bad_th")
    bad = (matches(docs, benchmark, **options)
           .select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_th)).distinct())
    keyed = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(th, F.xxhash64("text"))
    return keyed.join(bad, F.col(own).eqNullSafe(F.col(bad_id)) & (F.col(th) == F.col(bad_th)), "left_anti").select(*names)
