"""Line deduplication by a segment-partition edit join (DataFrame functions only).

Two lines within ``edits`` edits share one of ``edits + 1`` segments of the
shorter line unchanged.  Every line indexes its segments by (its length,
segment number) and probes, for each length it may be close to, the
substrings that could be such a segment there; for equal places the probe
starts vary by what the lengths and the other edits allow.  Lines that meet in
an index are verified with the banded bit-parallel edit distance: the band of
``2 * edits + 1`` diagonals is one machine word and each character updates it
with a dozen bit operations (an ``aggregate`` expression over the characters).

Only segments that different lines share get past the first, partially
aggregated shuffle, which holds hashes alone.  With one edit, a segment that
more than ``hot`` lines share is not joined: its lines are compared through
the substrings with one character left out, and lines equal in one of those
are within one edit, so a link to the smallest of them is enough.  No pairs
are made there, and none are lost.

Lines are compared without outer white space.  Lines of at least ``min_chars``
characters join; shorter ones repeat only if equal; lines without a word stay.
The first occurrence (smallest doc_id, then place) of each class of linked
lines stays, the others go.

Defined cases: a null text stays null, an empty one empty; rows with one
(doc_id, text) are one document and are all cut alike; a null ``doc_id`` comes
after all others; extra columns pass through.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, components, unused

LAST = 2**63 - 1


def trimmed(line: str) -> str:
    return f"btrim({line}, ' \\t\\r' || chr(11) || chr(12))"


def edit_distance_sql(a: str, b: str, edits: int) -> str:
    """SQL for whether the arrays of characters ``a`` and ``b`` are within ``edits`` edits (``a`` not longer).

    Bit d of the word stands for row ``j - edits + d`` of column j; the word
    moves down a row with each character of ``b``.  The distance is followed
    along the diagonal that ends in the last cell.
    """
    k, mask = edits, (1 << (2 * edits + 1)) - 1
    same = " | ".join(f"if(get({a}, j - {k} + {d} - 1) <=> get({b}, j - 1) and j - {k} + {d} between 1 and size({a}), "
                      f"{1 << d}L, 0L)" for d in range(2 * k + 1))
    # vp: rows from 1 on go up by one in column 0; row of bit d in column 1 is 1 - k + d
    vp0 = sum(1 << d for d in range(2 * k + 1) if 1 - k + d >= 1)
    step = f"""aggregate(sequence(1, size({b})),
      named_struct('vp', {vp0}L, 'vn', 0L, 'dist', cast(size({b}) - size({a}) as bigint)),
      (s, j) -> transform(transform(array(named_struct('x', {same}, 's', s)),
        y -> named_struct('d0', (((((y.x & y.s.vp) + y.s.vp) ^ y.s.vp) | y.x | y.s.vn) & {mask}L), 's', y.s)),
        z -> named_struct(
          'vp', ((z.d0 & z.s.vp) | (~(shiftright(z.d0, 1) | (z.s.vn | (~(z.d0 | z.s.vp) & {mask}L))) & {mask}L)),
          'vn', (shiftright(z.d0, 1) & (z.s.vn | (~(z.d0 | z.s.vp) & {mask}L))),
          'dist', z.s.dist + if(j > size({b}) - size({a})
                               and (shiftright(z.d0, cast({k} - (size({b}) - size({a})) as int)) & 1L) = 0L, 1L, 0L)))[0],
      s -> s.dist)"""
    return f"size({b}) - size({a}) between 0 and {k} and {step} <= {k}"


def lines_within(x: str, y: str, edits: int) -> Column:
    """Whether two lines are within ``edits`` edits; the characters are split once, as a lambda's variable."""
    return F.expr(
        f"exists(array(named_struct('x', split({x}, ''), 'y', split({y}, ''))), p -> {edit_distance_sql('p.x', 'p.y', edits)})")


def segment(length: str, i: int, parts: int) -> tuple[str, str]:
    """(start, length) of segment i of a line of that length, as SQL; starts count from 1."""
    start = f"(({length}) * {i} div {parts} + 1)"
    return start, f"(({length}) * {i + 1} div {parts} - ({length}) * {i} div {parts})"


def index_keys(line: str, edits: int) -> str:
    """SQL array: a hash of (length, segment number, segment) for every segment of a line."""
    out = []
    for i in range(edits + 1):
        start, size = segment(f"length({line})", i, edits + 1)
        out.append(f"xxhash64(length({line}), {i}, substring({line}, cast({start} as int), cast({size} as int)))")
    return f"array({', '.join(out)})"


def probe_keys(line: str, edits: int) -> str:
    """SQL array: the same hash for every substring that may be a segment of another, not longer line; null: none.

    A shift s puts s more characters before the segment.  At most i edits lie
    before segment i and edits - i after it, for some i.  The unshifted
    segments of equal length are the index keys themselves.
    """
    n, out = f"length({line})", []
    for less in range(edits + 1):
        for i in range(edits + 1):
            start, size = segment(f"{n} - {less}", i, edits + 1)
            for s in range(-i, i + 1):
                if abs(less - s) <= edits - i and (less or s):
                    out.append(f"if({start} + {s} between 1 and {n} - {size} + 1, xxhash64({n} - {less}, {i}, "
                               f"substring({line}, cast({start} + {s} as int), cast({size} as int))), null)")
    return f"array({', '.join(out)})"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, th, pos, line, lk): the lines with a word; lk is the hash of the trimmed line."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    return (keyed.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
            .select("doc", "th", "pos", F.expr(trimmed("raw")).alias("line")).where("line <> ''")
            .select("*", F.xxhash64("line", F.length("line")).alias("lk")))


def line_links(docs: DataFrame, lines: DataFrame, scratch: Scratch, edits: int, hot: int, max_broadcast: int) -> DataFrame:
    """(a, b) of line hashes: links that connect all lines within ``edits`` edits."""
    index = lines.select(F.explode("ik").alias("k"), "lk")
    probe = lines.select(F.explode("pk").alias("k"), "lk").where("k is not null")
    flat = index.withColumn("probe", F.lit(0)).union(probe.withColumn("probe", F.lit(1)))
    shared = scratch.write(flat.groupBy("k").agg(F.min("lk").alias("lo"), F.max("lk").alias("hi"), F.min("probe").alias("p"))
                           .where("lo <> hi and p = 0").select("k"), "shared")
    # from here on only what different lines share
    entry = scratch.write(flat.join(shared, "k").distinct(), "entries")
    index, probe = entry.where("probe = 0").drop("probe"), entry.where("probe = 1").drop("probe")
    if edits == 1:
        many = scratch.write(index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("k"), "hot")
        hot_lines = scratch.write(entry.join(many, "k").select("lk").distinct(), "hot-lines")
        index = index.join(many, "k", "left_anti")
    left, right = index.withColumnRenamed("lk", "a"), index.withColumnRenamed("lk", "b")
    pairs = left.join(right, "k").where("a < b").select("a", "b").union(
        left.join(probe.withColumnRenamed("lk", "b"), "k").where("a <> b").select("a", "b"))
    pairs = scratch.write(pairs.distinct(), "pairs")
    need = pairs.select(F.col("a").alias("lk")).union(pairs.select(F.col("b").alias("lk")))
    need = scratch.write((need.union(hot_lines) if edits == 1 else need).distinct(), "need")
    small = need.count() <= max_broadcast  # 8 bytes each
    texts = scratch.write(line_rows(docs).select("lk", "line").join(F.broadcast(need) if small else need, "lk")
                          .groupBy("lk").agg(F.min("line").alias("line")), "texts")
    both = (pairs.join(texts.select(F.col("lk").alias("a"), F.col("line").alias("v")), "a")
            .join(texts.select(F.col("lk").alias("b"), F.col("line").alias("w")), "b"))
    turn = F.length("v") > F.length("w")
    both = both.select("a", "b", F.when(turn, F.col("w")).otherwise(F.col("v")).alias("x"),
                       F.when(turn, F.col("v")).otherwise(F.col("w")).alias("y"))
    both = both.where(f"length(y) - length(x) <= {edits}").where(cheap_filter(edits))
    links = both.where(lines_within("x", "y", edits)).select("a", "b")
    return links.union(left_out_links(texts.join(hot_lines, "lk"))) if edits == 1 else links


def cheap_filter(edits: int) -> Column:
    """A necessary condition: of 2 * (edits + 1) pieces of x all but ``edits`` are in y, shifted by at most ``edits``."""
    parts = 2 * (edits + 1)
    tests = []
    for i in range(parts):
        start, size = segment("length(x)", i, parts)
        same = " or ".join(f"substring(y, cast({start} + {s} as int), cast({size} as int)) = "
                           f"substring(x, cast({start} as int), cast({size} as int))" for s in range(-edits, edits + 1))
        tests.append(f"if({same}, 1, 0)")
    return F.expr(f"{' + '.join(tests)} >= {parts - edits}")


def left_out_links(texts: DataFrame) -> DataFrame:
    """Links of lines within one edit through their substrings with one character left out.

    Two lines of one length differ in place p alone iff they are equal without
    it; a longer line is one insertion away iff it equals the other without a
    character.  The lines of a group are all within one edit of the smallest.
    """
    n = "length(line)"
    variants = texts.select("lk", "line", F.explode(F.expr(f"sequence(1, {n})")).alias("p")).select(
        "lk", "p", F.expr(f"xxhash64({n}, p, substring(line, 1, p - 1), substring(line, p + 1))").alias("v"),
        F.expr("xxhash64(concat(substring(line, 1, p - 1), substring(line, p + 1)))").alias("w"))
    first = variants.groupBy("v").agg(F.min("lk").alias("a"), F.max("lk").alias("z")).where("a <> z")
    equal = variants.join(first, "v").where("a <> lk").select("a", F.col("lk").alias("b"))
    whole = texts.select(F.col("lk").alias("a"), F.xxhash64("line").alias("w"))
    longer = variants.join(whole, "w").select("a", F.col("lk").alias("b"))
    return equal.union(longer).distinct()


def dedup_lines(docs: DataFrame, edits: int = 1, min_chars: int = 20, hot: int = 64,
                max_broadcast: int = 2_000_000) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and n_lines, n_removed_lines (long) added.

    Columns of ``docs`` with these two names are replaced.
    """
    out, n_lines, n_removed = cut_lines(docs, edits, min_chars, hot, max_broadcast)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed_lines")]
    return out.select(*names, F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed_lines"))


def cut_lines(docs: DataFrame, edits: int = 1, min_chars: int = 20, hot: int = 64,
              max_broadcast: int = 2_000_000) -> tuple[DataFrame, str, str]:
    """``docs`` with its lines cut and two more columns, and the names of these: lines before, lines removed."""
    if edits < 1:
        raise ValueError("edits must be at least 1")
    scratch = Scratch(docs.sparkSession, "lines")
    long_enough = F.length("line") >= min_chars
    lines = scratch.write(line_rows(docs).select(
        "doc", "th", "pos", "lk", F.when(long_enough, F.expr(index_keys("line", edits))).alias("ik"),
        F.when(long_enough, F.expr(probe_keys("line", edits))).alias("pk")), "lines")
    first = scratch.write(lines.groupBy("lk").agg(F.min(F.struct("doc", "th", "pos")).alias("at")), "first")
    links = scratch.write(line_links(docs, lines, scratch, edits, hot, max_broadcast), "links")
    near = first.join(components(links, scratch, "classes"), F.col("lk") == F.col("node"))
    best = near.groupBy("component").agg(F.min("at").alias("best"))
    moved = near.join(best, "component").select(F.col("lk").alias("_lk"), "best")
    stays = first.join(moved, F.col("lk") == F.col("_lk"), "left").select("lk", F.coalesce("best", "at").alias("at"))
    doc, th, doc_gone, th_gone, gone_at, n_lines, n_removed = unused(
        docs, "_doc", "_th", "_d", "_t", "_gone", "n_lines", "n_removed_lines")
    gone = scratch.write(lines.select("doc", "th", "pos", "lk").join(stays, "lk")
                         .where(F.struct("doc", "th", "pos") != F.col("at"))
                         .groupBy(F.col("doc").alias(doc_gone), F.col("th").alias(th_gone))
                         .agg(F.collect_set("pos").alias(gone_at)), "gone")
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(th, F.xxhash64("text"))
    out = keyed.join(gone, (F.col(doc) == F.col(doc_gone)) & (F.col(th) == F.col(th_gone)), "left")
    parts = F.split("text", "\n")
    left = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone_at, i)), "\n"))
    out = out.select(*[left.alias("text") if c == "text" else F.col(c) for c in docs.columns],
                     F.coalesce(F.size(parts), F.lit(0)).cast("long").alias(n_lines),
                     F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias(n_removed))
    return out, n_lines, n_removed


def keep_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` after line deduplication; a document that loses all its lines with words goes."""
    out, _, n_removed = cut_lines(docs, **options)
    empty = (F.col(n_removed) > 0) & (F.expr(trimmed("replace(text, chr(10), '')")) == "")
    return out.where(~F.coalesce(empty, F.lit(False))).select(*docs.columns)
