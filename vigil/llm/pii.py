"""Personal data spans: fixed base rules, plus candidates chosen by gradient-boosted trees.

Base spans (email, ip, card, phone) follow exact patterns and always stay.
High-recall generators propose further, possibly overlapping, spans: spelled
out mail addresses, bracketed dots, digit runs with other separators, phone
numbers without a plus.  Boosted trees (MLlib) see format and context
features of every candidate.  They learn what personal data looks like in
other spellings from the corpus itself: every base span is re-spelled in its
place (positive), and its digits and words are put into shapes that pass the
hard rules but are something else: decimals, dates, section numbers, the end of
a sentence (negative).  A threshold per kind, set on held-out spans for a wanted
precision, selects the additions, among candidates that keep the hard rules of
their kind and lie on no base span.  All of it follows from the texts alone, not
from how the rows are laid out in files or partitions.

Defined cases: a null text counts as empty; rows are handled one by one, so
repeated rows and ties in ``doc_id`` give one result row each; a null
``doc_id`` is carried through; further columns of the input are ignored.  An
empty table gives an empty result; a very long text is scanned in linear time.
Without both classes among the examples nothing is added, and of a kind without
examples nothing either.  Counts and ``base_sha256`` are those of the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a digit run starts: an inner start continues the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Generators: looser forms, lengths bounded by what an address or number can have.
_GEN_AT = re.compile(r" ?(?:@|[(\[{] ?at ?[)\]}]) ?")
_GEN_AT_MARK = re.compile(r"@|[(\[{] ?at")  # part of every match of _GEN_AT
_GEN_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_GEN_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]| dot ) ?[A-Za-z0-9-]{1,63}){1,8}")
_GEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,4}(?: ?(?:\.|[(\[{]\.[)\]}]) ?[0-9]{1,4}){3}(?![0-9])")
_GEN_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){11,19}(?![0-9])")
_GEN_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9][0-9 ()./-]{5,22}[0-9](?![0-9A-Za-z])")

_CONTEXT = {
    "email": ("mail", "contact", "write", "courriel", "correo", "kontakt"),
    "ip": (" ip", "host", "server", "addr", "client", "ssh"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
}

_YEARS = frozenset(str(y) for y in range(1900, 2100))

CANDIDATE = "array<struct<kind:int,start:int,end:int,f:array<float>>>"
STAGE = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         f"base array<struct<kind:int,start:int,end:int>>, cands {CANDIDATE}, "
         "seeds array<struct<kind:int,key:long,left:string,span:string,right:string>>")
EXAMPLE = "kind int, label int, key long, n long, f array<float>"
SEED_CHARS = 80  # longest base span that is re-spelled
SEED_ROWS = 5_000  # base spans whose shapes one task makes
FIT_ROWS = 200_000  # distinct examples that one task of the fit holds


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping mail addresses, found from each '@' outwards in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed rules, by kind, then start."""
    out = [(0, a, b) for a, b in email_spans(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    if _GEN_AT_MARK.search(text):
        for m in _GEN_AT.finditer(text):
            left = _GEN_LOCAL_END.search(text, max(0, m.start() - 64), m.start())
            right = _GEN_DOMAIN.match(text, m.end())
            if left and right:
                yield 0, left.start(), right.end()
    if _DIGIT.search(text):
        for kind, pattern in ((1, _GEN_IP), (2, _GEN_CARD), (3, _GEN_PHONE)):
            for m in pattern.finditer(text):
                yield kind, *m.span()


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    left = text[max(0, start - 24):start].lower()
    before, after = text[start - 1:start], text[end:end + 1]
    tail = re.search(r"[A-Za-z]*\Z", span)[0]
    return [float(x) for x in (
        *(kind == k for k in range(4)), len(span), len(digits), len(groups), max(map(len, groups), default=0),
        13 <= len(digits) <= 19, 9 <= len(digits) <= 15, bool(digits) and luhn(digits),
        max((int(g) for g in groups if len(g) < 10), default=0) <= 255, len(set(digits)),
        span[:1] == "+", span[:2] == "00", "@" in span, span.count(" "), span.count("."), span.count("-"),
        span.count("/") + span.count("_"), span.count("(") + span.count("["), len(tail), span[:-len(tail) or None][-2:] == ". ",
        tail[:1].isupper(), len(set(re.findall(r"[^0-9A-Za-z]+", span))), min(map(len, groups), default=0),
        sum(len(g) == 1 for g in groups), len(groups[0]) if groups else 0, span[:1] == "0", span[:2] in ("(0", "(+"),
        span[:2] == "0.", sum(g in _YEARS for g in groups), sum(len(g) == 4 for g in groups),
        before.isalnum(), after.isalnum(), before in ("", " ", "\n"), after in ("", " ", "\n"),
        any(w in left for w in _CONTEXT[KINDS[kind]]),
        any(w in left for k in KINDS if k != KINDS[kind] for w in _CONTEXT[k]))]


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts of the spans in order, and how far those up to each reach."""
    order = sorted((a, b) for _, a, b in spans)
    return [a for a, _ in order], list(accumulate((b for _, b in order), max))


def is_open(text: str, kind: int, start: int, end: int, base: tuple[list[int], list[int]]) -> bool:
    """Whether a candidate lies on no base span and keeps the hard rules of its kind."""
    before = bisect_left(base[0], end)
    if before and base[1][before - 1] > start:
        return False
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        return re.search(r"[A-Za-z]{2,24}\Z", span) is not None
    if kind == 1:
        return all(int(g) <= 255 for g in re.findall(r"[0-9]+", span))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and span[0] in "+0("


def spellings(kind: int, span: str) -> tuple[list[str], list[str]]:
    """A base span in other spellings, and its parts in shapes that pass the hard rules but are no personal data."""
    d = _NOT_DIGIT.sub("", span)
    if kind == 0:
        user, domain = span.split("@")
        parts = domain.split(".")
        dots = [f" {a}dot{b} ".join(parts) for a, b in ("()", "[]", "{}")] + ["[dot]".join(parts), " dot ".join(parts)]
        ats = [" @ ", " (at) ", "(at)", " [at] ", "[at]", " [ at ] "]
        users = (user, re.split(r"[._%+-]", user)[-1] or user)
        good = [u + at + domain for u in users for at in ats] + [u + at + x for u in users for at, x in zip(ats[1:], dots)]
        word = re.sub(r"[^A-Za-z]", "", parts[0]) or "home"
        return good, [f"{u}{at}{word}. {end}" for u in users for at in ats[:3] for end in ("The", "And", "Then", "We")]
    if kind == 1:
        parts = span.split(".")
        few = [str(int(p) % 10) for p in parts]
        good = [x.join(parts) for x in ("[.]", "(.)", "{.}", " . ", ". ", " [.] ")]
        return good, [x.join(few) for x in (" . ", ". ", " .")] + [". ".join(few[:3] + parts[3:])]
    if kind == 2:
        fours = [d[k:k + 4] for k in range(0, len(d), 4)]
        good = [x.join(fours) for x in ("/", ".", "_", "  ", "--", " /", ". ")]
        twos = [d[k:k + 2] for k in range(0, len(d), 2)]
        dates = [f"{d[k:k + 2]}.{d[k + 2:k + 4]}.{d[k + 4:k + 8]}" for k in range(0, len(d), 8)]
        return good, [f"{d[0]}.{d[1:]}", f"{d[:2]}.{d[2:]}", "  ".join(dates), ". ".join(twos), ". ".join(d), "/".join(twos)]
    rest = d[-9:] if len(d) > 9 else d[-8:]  # without the country's digits
    area, own = rest[:-7] or rest[:2], rest[-7:]
    pairs = " ".join((own[:3], own[3:5], own[5:]))
    good = ["00" + span[1:], f"00 {d[:2]} {d[2:4]} {d[4:]}", f"00{d}", f"(0{area}) {own}", f"(0{area}) {pairs}", f"0{area}-{own}", f"0{area}/{own}",
            f"0{area} {own}", f"0{area} {pairs}", f"0{area}.{own[:3]}.{own[3:]}", f"({rest[:3]}) {rest[3:6]}-{rest[6:]}9"]
    day, month, clock = f"0{int(d[0]) % 9 + 1}", f"0{int(d[1]) % 9 + 1}", f"{int(d[2:4]) % 24:02d}{int(d[4:6]) % 60:02d}"
    year = f"20{d[-2:]}"
    bad = [f"0.{d}", f"0.{d[:9]}", " ".join("0" + d[:9]), f"{day}.{month}.{year} {clock}", f"{day}/{month}/{year} {clock}", f"{day}-{month}-{year} {clock}",
           f"({year}) {d[:5]}", f"({year}-{year}) {d[:3]}", f"{day}.{month}.{year} - {day}.{month}.{year}"]
    return good, bad


def seeds(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The base spans with what stands around them."""
    return [{"kind": kind, "key": xxhash.xxh3_64_intdigest(text[a:b].encode()) - 2**63, "left": text[max(0, a - 24):a],
             "span": text[a:b], "right": text[b:b + 1]} for kind, a, b in spans if b - a <= SEED_CHARS]


def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of the shapes of base spans, each in the place of its span."""
    for pdf in batches:
        out = []
        for kind, key, n, left, span, right in zip(*(pdf[c] for c in ("kind", "key", "n", "left", "span", "right"))):
            for label, forms in zip((1, 0), spellings(kind, span)):
                for form in dict.fromkeys(forms):
                    whole, a, b = left + form + right, len(left), len(left) + len(form)
                    if is_open(whole, kind, a, b, ([], [])):  # as those that are scored
                        out.append((kind, label, key, n, features(whole, kind, a, b)))
        yield pd.DataFrame(out, columns=["kind", "label", "key", "n", "f"])


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            text = text if isinstance(text, str) else ""
            spans = base_spans(text)
            cands, base = [], covered(spans)
            for kind, a, b in dict.fromkeys(proposals(text)):
                if is_open(text, kind, a, b, base):
                    cands.append({"kind": kind, "start": a, "end": b, "f": features(text, kind, a, b)})
            digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            count = [sum(k == j for k, _, _ in spans) for j in range(4)]
            rows.append((doc_id, *count, digest, [{"kind": k, "start": a, "end": b} for k, a, b in spans], cands, seeds(text, spans)))
        out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "cands",
                                          "seeds"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def thresholds(scored: pd.DataFrame, precision: float, floor: float) -> list[float]:
    """Per kind a cut for the wanted precision on the held-out examples (kind, p, how many, how many positive); over 1: none.

    The cut lies half way between the lowest score that still reaches the precision and the next one below.
    """
    out = []
    for kind in range(len(KINDS)):
        own = scored[scored["kind"] == kind].groupby("p")[["positive", "n"]].sum().sort_index(ascending=False).cumsum()
        good = np.flatnonzero((own["positive"] >= precision * own["n"]).to_numpy())
        p = own.index.to_numpy()
        if not len(good):
            out.append(2.0)
            continue
        below = p[good[-1] + 1] if good[-1] + 1 < len(p) else 0.0
        out.append(max(float(p[good[-1]] + below) / 2, floor))
    return out


def find_pii(docs: DataFrame, precision: float = 0.995, floor: float = 0.5,
             trees: int = 10, depth: int = 4) -> DataFrame:
    """doc_id, base counts, base_sha256 and ``spans`` (base and added) per row of ``docs``.

    The trees and thresholds are fitted on the shapes (less than 50 each) of all
    base spans: equal examples are one row with their number as its weight, and
    those rows grow far slower than the texts.  Every candidate of every text is
    scored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    found = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(scan, STAGE)
                          .withColumn("rid", F.monotonically_increasing_id()), "found")
    cands = found.select("rid", F.explode("cands").alias("c")).select("rid", "c.*")
    spans = found.select(F.explode("seeds").alias("s")).select("s.*").groupBy("kind", "key", "left", "span", "right").agg(
        F.count(F.lit(1)).alias("n"))
    spans = scratch.write(spans, "seeds")
    tasks = max(spark.sparkContext.defaultParallelism, -(-spans.count() // SEED_ROWS))
    sample = scratch.write(spans.repartition(tasks, "kind", "key", "left").mapInPandas(examples, EXAMPLE).withColumn("held", F.xxhash64("kind", "key") % 5 == 0)
                           .groupBy("held", "kind", "label", "f").agg(F.sum("n").cast("double").alias("n")), "examples")
    fit = sample.where(~F.col("held")).select(array_to_vector(F.col("f").cast("array<double>")).alias("features"), "label", "n", "kind", "f")
    added = None
    if fit.agg(F.countDistinct("label")).first()[0] == 2:
        parts = -(-fit.count() // FIT_ROWS)  # dealt by their values and in order, which decides the sums
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, weightCol="n", maxBins=1024).fit(
            fit.repartition(parts, "kind", "label", "f").sortWithinPartitions("kind", "label", "f").select("features", "label", "n"))

        def score(df: DataFrame) -> DataFrame:
            return model.transform(df.withColumn("features", array_to_vector(F.col("f").cast("array<double>")))) \
                .withColumn("p", vector_to_array("probability")[1])

        held = (score(sample.where("held")).groupBy("kind", F.round("p", 4).alias("p"))  # at most 10,001 rows a kind
                .agg(F.sum(F.col("label") * F.col("n")).alias("positive"), F.sum("n").alias("n")).toPandas())
        limit = F.array(*[F.lit(x) for x in thresholds(held, precision, floor)])
        chosen = score(cands).where(F.col("p") >= F.element_at(limit, F.col("kind") + 1))
        added = chosen.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = found.drop("cands", "seeds")
    if added is not None:
        out = out.join(added, "rid", "left")
        every = F.concat("base", F.coalesce("added", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    else:
        every = F.col("base")
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(F.array_distinct(every)), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
                      F.array_join(text, ",").alias("spans"))


def redact(text: str, spans: str) -> str:
    """The text with every span of a ``spans`` string replaced by its kind in brackets (overlaps as one)."""
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            out.append(text[at:a] + f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]
