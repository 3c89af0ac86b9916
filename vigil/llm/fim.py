"""Fill-in-the-middle transformation over seekable compressed texts.

A text is kept as independent zstandard frames of whole units (lines, or single
characters) with the cumulative counts of units and characters before each
frame.  Choosing the cuts needs the counts and the two frames that hold a cut,
nothing else is decompressed for it.  The output is then streamed: frame by
frame in the order of its parts, with the sentinels between them, into the
digest and into the output's own frames.  So no step holds a whole text
besides the one that splits it, and none holds it in several copies.

Cuts and form come from the SHA-256 of ``seed:doc_id`` and do not depend on the
layout of the table.

Defined cases: a null text is an empty one; an empty text, or one that holds a
sentinel, stays plain (``prefix_chars`` and ``middle_chars`` null); a null
``doc_id`` counts as the empty word in the hash; repeated rows give a row each;
a unit longer than a frame is a frame by itself; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters that a frame holds at least, the last one excepted.
FRAME_CHARS = 1 << 16
STORE = "doc_id long, units array<long>, chars array<long>, frames array<binary>, marked boolean"


@dataclass
class Stored:
    """A text as frames; ``units[k]`` and ``chars[k]`` stand before frame k, one more entry for the whole text."""
    units: list[int]
    chars: list[int]
    frames: list[bytes]
    marked: bool = False

    @property
    def n(self) -> int:
        return self.units[-1]


def split_frames(text: str, level: str, size: int) -> Iterator[tuple[bytes, int, int]]:
    """(UTF-8 bytes, units, characters) of each frame's text."""
    at, total = 0, len(text)
    while at < total:
        end = min(at + size, total)
        if level == "line" and end < total and text[end - 1] != "\n":
            end = text.find("\n", end) + 1 or total  # whole lines only
        part = text[at:end]
        n = len(part) if level == "char" else part.count("\n") + (not part.endswith("\n"))
        yield part.encode("utf-8", "surrogatepass"), n, len(part)
        at = end


def pack(text: str, compressor, level: str = "line", size: int = FRAME_CHARS) -> Stored:
    out = Stored([0], [0], [], any(m in text for m in (PREFIX, SUFFIX, MIDDLE)))
    for raw, n, chars in split_frames(text, level, size):
        out.frames.append(compressor.compress(raw))
        out.units.append(out.units[-1] + n)
        out.chars.append(out.chars[-1] + chars)
    return out


def char_of_unit(s: Stored, unit: int, read, level: str = "line") -> int:
    """Characters before ``unit``; decompresses the frame that holds the cut, if it is inside one."""
    k = bisect_right(s.units, unit) - 1
    inside = unit - s.units[k]
    if not inside:
        return s.chars[k]
    if level == "char":
        return s.chars[k] + inside
    text, at = read(k), 0
    for _ in range(inside):
        at = text.index("\n", at) + 1
    return s.chars[k] + at


def stream(s: Stored, start: int, end: int, read) -> Iterator[str]:
    """The text between two character places, frame by frame."""
    k = max(bisect_right(s.chars, start) - 1, 0)
    while start < end:
        text = read(k)
        stop = min(end, s.chars[k + 1])
        yield text if stop - start == len(text) else text[start - s.chars[k]:stop - s.chars[k]]
        start, k = stop, k + 1


def draw(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the row's hash."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in range(0, 32, 8)]


def plan(s: Stored, doc_id: int | None, seed: int, percent: int, spm_percent: int) -> tuple[str, int, int]:
    """(form, units before the first cut, units before the second)."""
    h1, h2, h3, h4 = draw(doc_id, seed)
    if not s.n or s.marked or h3 % 100 >= percent:
        return "plain", 0, s.n
    a, b = sorted((h1 % (s.n + 1), h2 % (s.n + 1)))
    return "spm" if h4 % 100 < spm_percent else "psm", a, b


def ordered(s: Stored, form: str, a: int, b: int, read) -> Iterator[str]:
    """The output text, piece by piece; a and b: characters before the cuts."""
    whole = s.chars[-1]
    if form == "plain":
        yield from stream(s, 0, whole, read)
        return
    parts = {PREFIX: (0, a), SUFFIX: (b, whole), MIDDLE: (a, b)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield mark
        yield from stream(s, *parts[mark], read)


def store(docs: DataFrame, level: str = "line", size: int = FRAME_CHARS, strength: int = 3) -> DataFrame:
    """The texts of ``docs`` as frames; ``strength``: of the compression."""
    if level not in ("line", "char"):
        raise ValueError("a unit is a line or a char")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        compressor = zstandard.ZstdCompressor(level=strength)
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.bool_()]
        names = ["doc_id", "units", "chars", "frames", "marked"]
        for batch in batches:
            texts, rows, held = batch.column(1), [], 0
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                s = pack(texts[k].as_py() or "", compressor, level, size)
                rows.append((doc_id, s.units, s.chars, s.frames, s.marked))
                held += sum(map(len, s.frames))
                if held > 1 << 24 or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STORE)


def transform(stored: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, level: str = "line") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output and output_sha256 per stored text.

    ``percent`` of the texts are rearranged, ``spm_percent`` of those with the suffix first.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        decompressor = zstandard.ZstdDecompressor()
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                doc_id, units, chars, frames, marked = (batch.column(c)[k] for c in range(5))
                s = Stored(units.as_py(), chars.as_py(), frames.values, marked.as_py())

                last: dict[int, str] = {}  # the frame read last; both cuts and the parts around them often share it

                def read(i, frames=s.frames, last=last):
                    if i not in last:
                        last.clear()
                        last[i] = decompressor.decompress(frames[i].as_py()).decode("utf-8", "surrogatepass")
                    return last[i]

                form, a, b = plan(s, doc_id.as_py(), seed, percent, spm_percent)
                a, b = (char_of_unit(s, u, read, level) for u in (a, b))
                digest, pieces = hashlib.sha256(), []
                for piece in ordered(s, form, a, b, read):
                    raw = utf8(piece)
                    digest.update(raw)
                    pieces.append(raw)
                cut = (None, None) if form == "plain" else (a, b - a)
                rows.append((doc_id.as_py(), s.n, form, *cut, b"".join(pieces), digest.hexdigest()))
                held += len(rows[-1][5])
                if held > 1 << 24 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.binary()).cast(t) if n == "output" else pa.array(c, t) for c, t, n in zip(zip(*rows), types, names)], names=names)
                    rows, held = [], 0

    return stored.select("doc_id", "units", "chars", "frames", "marked").mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form"):
    """The text that an output of ``transform`` was made from, as a column of the output and its form."""
    o, f = F.col(output), F.col(form)
    cut = {m: F.locate(m, o) for m in (PREFIX, SUFFIX, MIDDLE)}  # a rearranged text holds no sentinel of its own
    width = len(PREFIX)

    def between(a: str, b: str | None):
        start = cut[a] + width
        return F.substr(o, start, (cut[b] if b else F.length(o) + 1) - start)
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, level: str = "line") -> DataFrame:
    """``transform`` over the frames of ``docs``, written to the shared folder first."""
    scratch = Scratch(docs.sparkSession, "fim")
    return transform(scratch.write(store(docs, level), "frames"), seed, percent, spm_percent, level)
