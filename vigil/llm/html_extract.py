"""Main text of web pages by removing the element subtrees that a site repeats.

A page is parsed once, in time linear in its length, into blocks (runs of text
between block-level tags) and block-level elements.  Every element has the
hash of its subtree, made bottom-up from its tag, its texts and the hashes of
its children, and the range of blocks it spans.  Spark counts the hashes per
host over distinct pages (copies of a page count once) and deletes the subtrees
that recur on many pages of the host.

Inside ``<article>`` or ``<main>`` a quoted passage recurs as well, so there
a subtree goes only if it occurs in more than ``main_share`` of the host's
pages, and mirrored articles count once.  A page with such an element has no
other main text.

What never holds main text goes even if it occurs once, as counting cannot
find it: navigation, footers, scripts and the like by tag or role, and elements
one of whose class names or ids says nothing else (``ad-box``, ``comments``).
Where such a word is only part of a name (``related-work``), it lowers the
count that is needed.  A form goes unless the page stands in it: unless, outside
of the main element, it holds a navigation, header, footer, main element or h1.

Defined cases: a null or empty html gives the empty text; a null url is a
host of its own; rows are handled one by one, so repeated rows give a row
each and null ids are carried through; other columns are ignored; unclosed
and crossing tags are closed as the element around them ends.  An empty table
gives an empty result; a very long page is one row, parsed in linear time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = frozenset("""nav footer aside form button select option input label textarea script style noscript template iframe
object embed svg math canvas audio video map menu dialog head title search""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice
notices pagination popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored
subscribe toolbar widget""".split())
#: Words that leave a name what HINTS makes it.
PLAIN = frozenset("""area bar block body bottom box btn button buttons card container form group head icons inner item items left
link links list main outer panel post posts right section site text title top wrap wrapper""".split())
#: Outside of the main element, a form that holds one of these is no form of the page but around it.
PAGE_PARTS = frozenset("nav header footer article main h1".split())
#: Elements whose own header belongs to the article, and which a class name does not remove.
SECTIONS = frozenset("article main".split())
CLOSES_P = BLOCKS - {"html", "head", "body"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|"
                  r"<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^<>]*>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[^a-z0-9]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)
STAGE = ("page_id long, url string, host string, page long, main_page long, n_gone long, "
         "blocks array<struct<text:string,main:boolean>>, "
         "parts array<struct<h:long,first:int,last:int,main:boolean,hint:boolean>>")


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower().removeprefix("www.") if m else None


def _unwanted(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element never holds main text (inside the main element its header does), and whether its names hint at it."""
    if tag in NEVER and tag != "form" or tag == "header" and not in_main:
        return True, False
    if not attrs or tag in SECTIONS or tag in ("body", "html"):
        found = [v for v in _ATTR.findall(attrs) if v[0].lower() in ("class", "id")] if tag == "article" and attrs else []
        return any("comment" in _TOKEN.split("".join(v[1:]).lower()) for v in found), False
    hint = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name in ("class", "id"):
            for one in value.split():
                tokens = {t for t in _TOKEN.split(one) if t}
                if not HINTS.isdisjoint(tokens):
                    if tokens <= HINTS | PLAIN:
                        return True, False
                    hint = True
    return False, hint


class _Element:
    __slots__ = ("tag", "main", "gone", "hint", "first", "hash", "around")

    def __init__(self, tag, main, gone, hint, first):
        self.tag, self.main, self.gone, self.hint, self.first = tag, main, gone, hint, first
        self.hash = xxhash.xxh3_64(f"{tag}{int(hint)}".encode("utf-8", "surrogatepass")) if tag in BLOCKS else None
        self.around = False  # a form around the page


def parse(html: str) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int, bool, bool]], int]:
    """Blocks (text, inside the main element), subtrees (hash, first block, one past the last, inside
    the main element, hinted) in the order in which they end, and the number of unwanted elements."""
    out: list[tuple[str, bool] | None] = []
    subtrees: list[tuple[int, int, int, bool, bool]] = []
    stack: list[_Element] = []
    blocks: list[_Element] = []  # the block-level elements of the stack
    where: dict[str, list[int]] = {}  # places of a tag in the stack
    parts: list[str] = []
    n_gone = 0

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append((text, stack[-1].main if stack else False))
            if blocks:
                blocks[-1].hash.update(b"\0" + text.encode("utf-8", "surrogatepass") + b"\0")

    def close(k: int) -> None:
        nonlocal n_gone
        while len(stack) > k:
            if stack[-1].tag in BLOCKS:
                flush()
            e = stack.pop()
            where[e.tag].pop()
            if e.tag not in BLOCKS:
                continue
            blocks.pop()
            if e.tag == "form" and not e.gone and not e.around:
                n_gone += 1
                del out[e.first:]
                while subtrees and subtrees[-1][2] > e.first:
                    subtrees.pop()
            if len(out) > e.first:
                digest = e.hash.digest()
                if blocks:
                    blocks[-1].hash.update(digest)
                # of elements around the same blocks the innermost stands for all, unless an outer one is hinted
                if e.hint or not subtrees or subtrees[-1][1:3] != (e.first, len(out)):
                    subtrees.append((int.from_bytes(digest, "big") - 2**63, e.first, len(out), e.main, e.hint))

    def put(text: str | None) -> None:
        if text and not (stack and stack[-1].gone):
            parts.append(text)

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at:m.start()])
        at = m.end()
        put(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            k = last(tag)
            if k >= 0:
                close(k)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
            open_p = last("p")
            if tag in CLOSES_P and open_p >= 0 and open_p > last("button", *SECTIONS):
                close(open_p)
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                stop = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}.get(tag, ("table", "select"))
                same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"),
                        "tr": ("tr", "td", "th")}.get(tag, (tag,))
                while (k := last(*same)) > last(*stop):
                    close(k)
                    if tag != "tr":
                        break
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if m[4].endswith("/") and tag not in BLOCKS:
            continue
        top = stack[-1] if stack else None
        inside = top.main if top else False
        main = inside or tag in SECTIONS or bool(m[4]) and re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I) is not None
        gone, hint = _unwanted(tag, m[4], main)
        above = bool(top and top.gone)
        n_gone += gone and not above
        if tag in PAGE_PARTS and where.get("form"):
            form = stack[where["form"][-1]]
            form.around = form.around or not form.main
        where.setdefault(tag, []).append(len(stack))
        stack.append(_Element(tag, main, gone or above, hint, len(out)))
        if tag in BLOCKS:
            blocks.append(stack[-1])
    close(0)
    flush()
    return out, subtrees, n_gone


def blocks_of(html: str) -> list[tuple[str, bool]]:
    """(text, inside the main element) of the blocks of a page, in order, without the unwanted ones."""
    return parse(html)[0]


def _hash(texts: Iterator[str]) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(texts).encode("utf-8", "surrogatepass")) - 2**63


def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            html = html if isinstance(html, str) else ""
            url = url if isinstance(url, str) else None
            blocks, subtrees, n_gone = parse(html)
            rows.append((page_id, url, host_of(url), _hash(t for t, _ in blocks), _hash(t for t, main in blocks if main),
                         n_gone, [{"text": t, "main": main} for t, main in blocks],
                         [{"h": h, "first": a, "last": b, "main": main, "hint": hint} for h, a, b, main, hint in subtrees]))
        frame = pd.DataFrame(rows, columns=["page_id", "url", "host", "page", "main_page", "n_gone", "blocks", "parts"])
        frame["page_id"] = frame["page_id"].astype("Int64")
        yield frame


def extract_text(pages: DataFrame, min_pages: int = 3, min_share: float = 0.05, main_pages: int = 5,
                 main_share: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars and the number of deleted blocks and unwanted elements per row of ``pages``.

    A subtree is template if it occurs on at least ``min_pages`` distinct pages
    and ``min_share`` of the distinct pages of its host; inside the main element
    on at least ``main_pages`` and more than ``main_share``.  A hinted element
    inside needs what others need outside, one outside two pages and that share.
    """
    scratch = Scratch(pages.sparkSession, "html")
    cuts = scratch.write(pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(cut, STAGE)
                         .withColumn("host", F.xxhash64(F.coalesce("host", F.lit(""))))
                         .withColumn("main", F.exists("blocks", lambda b: b["main"]))
                         .withColumn("rid", F.monotonically_increasing_id()), "blocks")
    # copies of a page count once, inside the main element mirrored articles, too
    page = F.when(F.col("s.main"), F.col("main_page")).otherwise(F.col("page"))
    parts = (cuts.select("rid", "host", "page", "main_page", F.col("main").alias("page_main"), F.explode("parts").alias("s"))
             .select("rid", "host", "page_main", page.alias("page"), "s.*"))
    sizes = cuts.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    key = ["host", "h", "main", "hint"]
    counts = (parts.select(*key, "page").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min(2, min_pages)))
    share = F.col("n") >= min_share * F.col("n_pages")
    inside = F.when(F.col("hint"), (F.col("n") >= min_pages) & share).otherwise(
        (F.col("n") >= main_pages) & (F.col("n") > main_share * F.col("n_pages")))
    template = scratch.write(counts.join(sizes, "host").where(F.when(F.col("main"), inside).otherwise(
        share & (F.col("n") >= F.when(F.col("hint"), F.lit(min(2, min_pages))).otherwise(F.lit(min_pages))))).select(*key), "template")
    # on a page with a main element only the subtrees inside it matter
    hits = scratch.write(parts.where("main or not page_main").join(template, key).groupBy(F.col("rid").alias("_rid"))
                         .agg(F.collect_set(F.struct("first", "last")).alias("gone")), "hits")
    text = cuts.join(hits, F.col("rid") == F.col("_rid"), "left")

    def stays(b, i):
        gone = F.exists("gone", lambda g: (i >= g["first"]) & (i < g["last"]))
        return (b["main"] | ~F.col("main")) & F.coalesce(~gone, F.lit(True))

    return (text.withColumn("kept", F.filter("blocks", stays))
            .withColumn("text", F.array_join(F.transform("kept", lambda b: b["text"]), "\n"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"),
                    (F.size("blocks") - F.size("kept")).cast("long").alias("n_deleted"), "n_gone"))
