"""Token-id files: ids one after the other, document boundaries in Elias-Fano form.

A file holds the ids of consecutive documents (ascending ``doc_id``) as 2- or
4-byte numbers.  The ends of the documents, and their ids, are non-decreasing
numbers below some u; n of them take about 2 + log2(u / n) bits each: the low
bits side by side, the high parts as a bit vector in which value k with high
part h sets bit h + k.  ``select`` of the k-th one gives the high part back:
the place of every 256th one is kept in 4 bytes, the rest is counted from there.  So any
document's offset is found without a table of 64-bit offsets.

Layout (little endian): HEADER, ids, then for ends and doc_ids the low bits,
the high bits and the places.  One line feed follows each file's content, the
record end of the Spark writer: files are written by Spark's text sink, one per
record, so a lost executor leaves no half file and any file system of Spark
will do.  ``part`` and ``number`` in the header order the files.

Texts are dealt by ranges of ``doc_id`` and encoded there.  If the tokenizer
never lets a token span white space (``splits_at_space`` reads that from its
definition), the distinct words of the texts are encoded once per task and
texts put together from them (``Encoder``); else whole texts are encoded.  Both give the ids of the whole text.

Defined cases: a null or empty text has the end id alone; rows without an id
come first; rows that share an id stand in the order of their texts' hashes
(places of equal rows are interchangeable); extra columns are ignored; an empty
table writes no file and reads back as an empty table.  A text is encoded in
pieces cut at white space, so its length does not matter.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import Scratch
from vigil.operators.prefix import running_totals

#: magic, bytes an id, part, number, documents, documents without an id, ids, first doc_id, then for ends and for
#: doc_ids: low bits a value, bytes of the low bits, bytes of the high bits
HEADER = struct.Struct("<8sIIIIIQq" + "IQQ" * 2)
MAGIC = b"VGLTOKE1"
SAMPLE = 256
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of numbers (uint64) in nearly the least space, with random access."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, places: np.ndarray):
        self.n, self.width, self.low, self.high, self.places = n, width, low, high, places

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", np.empty(0, np.uint32))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        shift = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shift) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def select(self, k: int) -> int:
        """The place of the k-th one of the high bits."""
        place = int(self.places[k // SAMPLE])
        left = k % SAMPLE
        at = place >> 3
        byte = self.high[at] >> (place & 7)  # the bits from the sampled one on
        base = place
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            base, byte = at << 3, self.high[at]
        for _ in range(left):
            byte &= byte - 1
        return base + (byte & -byte).bit_length() - 1

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        first = k * self.width
        raw = int.from_bytes(self.low[first >> 3:(first + self.width + 7) >> 3], "little")
        return ((self.select(k) - k) << self.width) | ((raw >> (first & 7)) & ((1 << self.width) - 1))

    def all(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.width].reshape(self.n, self.width)
            for k in range(self.width):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def find(self, value: int) -> int:
        """The first place whose number is ``value`` or more."""
        a, b = 0, self.n
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self[mid] < value else (a, mid)
        return a

    @property
    def n_bytes(self) -> int:
        return len(self.low) + len(self.high) + self.places.nbytes


class TokenFile:
    """One file's content: documents by place or by id."""

    def __init__(self, raw: bytes):
        (magic, self.id_bytes, self.part, self.number, self.n_docs, self.n_null, self.n_ids, self.first,
         *shapes) = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.ids = np.frombuffer(raw, f"<u{self.id_bytes}", self.n_ids, at)
        at += self.n_ids * self.id_bytes
        sequences = []
        for n, (width, low, high) in ((self.n_docs, shapes[:3]), (self.n_docs - self.n_null, shapes[3:])):
            end = at + low + high
            places = np.frombuffer(raw, "<u4", -(-n // SAMPLE), end)
            sequences.append(EliasFano(n, width, raw[at:at + low], raw[at + low:end], places))
            at = end + places.nbytes
        self.ends, self.doc_ids = sequences

    @staticmethod
    def content(part: int, number: int, doc_ids: list[int | None], tokens: list[bytes], id_bytes: int) -> bytes:
        known = [d for d in doc_ids if d is not None]
        first = known[0] if known else 0
        ends = EliasFano.build(np.cumsum([len(t) // id_bytes for t in tokens]).astype(np.uint64))
        docs = EliasFano.build(np.array([d - first for d in known], np.uint64))
        shapes = [x for s in (ends, docs) for x in (s.width, len(s.low), len(s.high))]
        return b"".join([HEADER.pack(MAGIC, id_bytes, part, number, len(doc_ids), len(doc_ids) - len(known), sum(map(len, tokens)) // id_bytes, first, *shapes),
                         *tokens, *[x for s in (ends, docs) for x in (s.low, s.high, s.places.astype("<u4").tobytes())]])

    def span(self, k: int) -> tuple[int, int]:
        """(start, end) of the k-th document's ids, from the select structure."""
        return (self.ends[k - 1] if k else 0), self.ends[k]

    def places_of(self, doc_id: int) -> range:
        """The places of the documents with this id."""
        a = self.doc_ids.find(doc_id - self.first) if doc_id >= self.first else 0
        b = self.doc_ids.find(doc_id - self.first + 1) if doc_id >= self.first else 0
        return range(self.n_null + a, self.n_null + b)


def splits_at_space(definition: str) -> bool:
    """Whether no token and no rule of this tokenizer reaches over ASCII white space.

    So it is if texts are only composed, white space replaced and letters made
    small one by one, and the first split keeps matches of a pattern, no part of which takes white space.
    """
    t = json.loads(definition)
    normalizer = t.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ")
                for s in steps)
    pre = t.get("pre_tokenizer") or {}
    pre = pre.get("pretokenizers", [pre])
    first = pre[0] if pre else {}
    parts = (first.get("pattern") or {}).get("Regex", " ").split("|")
    spaceless = all(p in (r"[\p{L}]+", r"[\p{N}]", r"[\p{N}]+", r"[^\s\p{L}\p{N}]+") or (p[:1] == "'" and p[1:].isalpha()) for p in parts)
    byte_level = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    added = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not a["normalized"] and not any(c.isspace() for c in a["content"])
                for a in t.get("added_tokens", []))
    return (plain and spaceless and byte_level and added and first.get("type") == "Split" and first.get("behavior") == "Removed"
            and first.get("invert") is True and not t.get("post_processor"))


PIECE = 1 << 18


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A UTF-8 text cut at white space, in pieces of about ``size`` bytes."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end]
        at = end


#: Words that the normaliser leaves as they are but for capitals, without the first character of an added token:
#: of printable ASCII and letters from À to ſ (İ becomes two characters).
_LATIN = "^[!-;=-~À-ÖØ-öø-įı-ſ]+$"
#: Their parts, in small letters.
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-zß-öø-ſ0-9]+"
#: The split that _PARTS stands for, and the mark of a part's last token.
SPLIT, LAST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"


def _strings(raws: list[bytes]) -> pa.Array:
    """Texts as Arrow strings, taken as they are."""
    whole = pa.array(raws, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(whole), whole.buffers())


class Encoder:
    """The ids of UTF-8 texts as bytes; ``code``: H for two bytes an id, I for four.

    Words are encoded once and kept, up to ``cached`` of at most ``longest``
    bytes; texts are put together from their distinct words as arrays.  New
    words of Latin letters are in turn put together from the parts, in small
    letters, that the first split makes of them.  Parts are kept likewise, a
    quarter as many; new ones go to the library many at a time, as one text
    past the normaliser, those of ASCII past the byte alphabet too; the tokens
    that end a part say where its ids end.
    """

    def __init__(self, definition: str, code: str, cached: int = 1_200_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.code, self.cached, self.longest = code, cached, longest
        self.whole = Tokenizer.from_str(definition)
        self.by_word = splits_at_space(definition)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        t = json.loads(definition)
        self.together = (self.by_word and t["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == SPLIT
                         and t["model"]["end_of_word_suffix"] == LAST)
        if self.together:
            # parts come one by one, at spaces, and each once: the model's own cache would only be filled
            bytewise = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *t["pre_tokenizer"]["pretokenizers"][1:]]}
            bare = t | {"normalizer": None, "added_tokens": []}
            self.latin = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": bytewise}))
            self.ascii = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
            for tokenizer in (self.latin, self.ascii):
                tokenizer.model._resize_cache(0)
            self.ends = np.zeros(max(t["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for word, i in t["model"]["vocab"].items() if word.endswith(LAST)]] = True

    def _each(self, words: list[bytes]) -> Iterator[bytes]:
        for e in self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False):
            yield array(self.code, e.ids).tobytes()

    def _new_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of parts, many at a time if each has one last token."""
        out = []
        for tokenizer, own in ((self.ascii, [p for p in parts if p.isascii()]), (self.latin, [p for p in parts if not p.isascii()])):
            texts = [b" ".join(own[k:k + 500]).decode() for k in range(0, len(own), 500)]
            ids = np.array(list(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))), np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(own):
                cut = [0, *((last + 1) * array(self.code).itemsize).tolist()]
                raw = ids.astype(self.code).tobytes()
                out += zip(own, [raw[a:b] for a, b in zip(cut, cut[1:])])
            else:
                out += zip(own, self._each(own))
        of = dict(out)
        return [of[p] for p in parts]

    def _new_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, those of Latin letters from their parts."""
        if not self.together:
            return list(self._each(words))
        text = _strings(words)
        latin = pc.match_substring_regex(text, _LATIN)
        parted = pc.replace_substring_regex(pc.utf8_lower(text.filter(latin)), _PARTS, r"\0 ")
        of_latin = iter(self._put_together(parted, self.parts, self.cached // 4, self._new_parts))
        of_other = self._each([w for w, l in zip(words, latin.to_pylist()) if not l])
        return [next(of_latin if l else of_other) for l in latin.to_pylist()]

    def _put_together(self, texts: pa.Array, known: dict[bytes, bytes], most: int, learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids of each text from those of its words: a distinct word is looked up once, what is not known is learnt."""
        if len(known) > most:
            known.clear()
        split = pc.ascii_split_whitespace(texts)
        dealt = split.values.dictionary_encode()
        _, offsets, content = dealt.dictionary.buffers()
        content, at = content.to_pybytes() if content else b"", np.frombuffer(offsets, np.int32, len(dealt.dictionary) + 1).tolist()
        words = [content[a:b] for a, b in zip(at, at[1:])]
        ids = list(map(known.get, words))
        new = [k for k, i in enumerate(ids) if i is None]
        if new:
            for k, i in zip(new, learn([words[k] for k in new])):
                ids[k] = i
                if len(words[k]) <= self.longest:
                    known[words[k]] = i
        size = array(self.code).itemsize
        sizes, word = np.fromiter(map(len, ids), np.int64, len(ids)) // size, dealt.indices.to_numpy()
        n = sizes[word]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - ends[:-1], n)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(ids), self.code)[at].tobytes()
        cut = (ends[split.offsets.to_numpy()] * size).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _texts(self, raws: list[bytes]) -> list[bytes]:
        return self._put_together(_strings(raws), self.known, self.cached, self._new_words)

    def __call__(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each text; all but the longest texts are taken together."""
        if not self.by_word:
            return list(self._each(raws))
        short = iter(self._texts([raw for raw in raws if len(raw) <= PIECE]))
        return [next(short) if len(raw) <= PIECE else b"".join([self._texts([piece])[0] for piece in pieces(raw)]) for raw in raws]


def grouped(ids: list, raws: list[bytes], size: int = 1 << 21) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of documents of about ``size`` bytes."""
    at = held = 0
    for k, raw in enumerate(raws):
        held += len(raw)
        if held >= size or k == len(raws) - 1:
            yield ids[at:k + 1], raws[at:k + 1]
            at, held = k + 1, 0


@functools.lru_cache(2)
def worker_encoder(definition: str, code: str) -> Encoder:
    """One encoder per Python worker, whatever number of tasks it runs."""
    return Encoder(definition, code)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_ids: int = 1 << 21, file_docs: int = 1 << 16) -> None:
    """Write the ids of ``docs`` (doc_id, text), ``end_id`` after each document, as token files under ``path``.

    ``tokenizer``: path of a definition of the tokenizers library, read on the
    driver.  A file ends with the document that fills ``file_ids`` or ``file_docs``.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    largest = max([end_id, *json.loads(definition)["model"]["vocab"].values(), *[a["id"] for a in json.loads(definition)["added_tokens"]]])
    id_bytes = 2 if largest < 1 << 16 else 4
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one tokenizer, a fixed size
    order = ["doc_id", "_h", "_u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = "H" if id_bytes == 2 else "I"
        encode, end = worker_encoder(shared.value, code), array(code, [end_id]).tobytes()
        part, number, doc_ids, tokens, held = TaskContext.get().partitionId(), 0, [], [], 0

        def full() -> pa.RecordBatch:
            nonlocal number, doc_ids, tokens, held
            content = TokenFile.content(part, number, doc_ids, tokens, id_bytes)
            number, doc_ids, tokens, held = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["value"])

        for batch in batches:
            buffers = [t.as_buffer() for t in batch.column(1)]
            for ids, raws in grouped(batch.column(0).to_pylist(), [b.to_pybytes() if b else b"" for b in buffers]):
                for doc_id, own in zip(ids, encode(raws)):
                    tokens.append(own + end)
                    doc_ids.append(doc_id)
                    held += len(tokens[-1]) // id_bytes
                    if held >= file_ids or len(doc_ids) >= file_docs:
                        yield full()
        if doc_ids:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"),
                       F.monotonically_increasing_id().alias("_u"))
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "value binary")
     .select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: _part and number of its file, place in it, doc_id, its start there, n_tokens, ids_crc32.

    ``with_ids``: also ``ids`` (array of long).
    """
    schema = "_part int, number int, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                f = TokenFile(raw.as_py())
                ends = f.ends.all().astype(np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                known = f.doc_ids.all().view(np.int64) + np.int64(f.first)
                ids = f.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                arrays = [pa.array(np.full(f.n_docs, f.part, np.int32)), pa.array(np.full(f.n_docs, f.number, np.int32)),
                          pa.array(np.arange(f.n_docs)), pa.array([None] * f.n_null + known.tolist(), pa.int64()),
                          pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_tokens`` (written) with ``start``: the ids of all documents before.

    One row per file gets its base: what earlier files of its part hold and what earlier parts hold.
    """
    files = rows.groupBy("_part", "number").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("_part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    base = (files.join(running_totals(files, F.sum("n"), "_before"), "_part")
            .select("_part", "number", (F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base")))
    return rows.join(base, ["_part", "number"]).withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = f"{scratch.root}/files"
    write_tokens(docs, path, tokenizer, end_id)
    rows = scratch.write(read_tokens(docs.sparkSession, path), "rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
