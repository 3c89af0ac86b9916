"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (wire format only, no protobuf package).
From its pieces and scores a ``tokenizers`` pipeline is rebuilt: normaliser
(character map, dummy prefix, metaspace marker), unigram scores or, for a BPE
model, merges ranked by piece score, byte fallback and decoder.  Texts are
encoded in batches by the library's threads, small enough to bound memory.
``parity`` compares ids with the sentencepiece library.

If no piece holds the marker after another character, words never merge with
each other; then texts are pre-split before each run of markers, which gives
the same ids and lets the library cache words.

Defined cases: a null or empty text has no ids and decodes to the empty text;
rows are handled one by one (repeated rows alike); a null ``doc_id`` is
carried through; other columns are ignored; an empty table gives an empty
result.  Bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model kinds of the model format.
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_marker: bool = False
    pieces: list[tuple[str, float, int]] = field(default_factory=list)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            if key & 7 != 2:
                raise ValueError("not a model protobuf")
            size = varint()
        yield key >> 3, raw[at:at + size]
        at += size


def parse_model(raw: bytes) -> Model:
    """The parts of a SentencePiece model that encoding and decoding need."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    model.kind = v
                elif k == 24:
                    model.suffix_marker = bool(v)
                elif k == 35:
                    model.byte_fallback = bool(v)
                elif k == 44:
                    model.unknown_surface = v.decode()
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    model.charsmap = v
                elif k == 3:
                    model.dummy_prefix = bool(v)
                elif k == 4:
                    model.squeeze = bool(v)
                elif k == 5:
                    model.escape = bool(v)
    if model.kind not in (UNIGRAM, BPE) or model.suffix_marker or not model.escape:
        raise ValueError("only unigram and BPE models with a leading marker are supported")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; on a tie the earlier piece, then the longer left part."""
    rank = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    score = {p: s for p, s, _ in model.pieces}
    found = [(-score[p], k, -i, p[:i], p[i:]) for p, k in rank.items() for i in range(1, len(p))
             if p[:i] in rank and p[i:] in rank]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(raw: bytes, prepared: bool = False):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does.

    ``prepared``: texts come through ``prepare``, if the model is plain enough for that.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    model = parse_model(raw)
    unknown = next((k for k, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: k for k, (p, _, _) in enumerate(model.pieces)}, merges_of(model),
                          unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True,
                          byte_fallback=model.byte_fallback, cache_capacity=3000)
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if not (prepared and plain(model)):
        tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                     *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER and p.strip(MARK)]
    if own:
        tok.add_tokens(own)
    return tok


def plain(model: Model) -> bool:
    """Whether the normaliser is the marker alone, which two string operations do faster than the library."""
    return not model.charsmap and not model.squeeze


def prepare(text: str, model: Model) -> str:
    if not text or not plain(model):
        return text
    return (MARK if model.dummy_prefix else "") + text.replace(" ", MARK)


def _chunks(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters in all, so that one call's objects stay small."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > chars:
            yield texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def surfaces(model: Model) -> list[bytes]:
    """The bytes that each id stands for."""
    return [p.replace(MARK, " ").encode() if kind in (NORMAL, USER, UNUSED) else bytes([int(p[1:-1], 16)]) if kind == BYTE else
            model.unknown_surface.encode() if kind == UNKNOWN else b"" for p, _, kind in model.pieces]


def decode_ids(ids: list[int], surface: list[bytes], dummy_prefix: bool) -> str:
    raw = b"".join([surface[k] for k in ids])
    return (raw[1:] if dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model: bytes, chunk_chars: int = 200_000, threads: int = 2, with_text: bool = False) -> DataFrame:
    """doc_id and ``ids`` (array of int) per row of ``docs``.

    ``with_text``: also ``text``, what the ids decode to, and ``same``, whether
    that is the text of the row; made in the same Python worker, so that ids
    need not pass through a second one.  ``threads`` of the library per task:
    as many as a task's cores; each costs its own memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one model file, a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        tok, parsed = build_tokenizer(shared.value, prepared=True), parse_model(shared.value)
        surface = surfaces(parsed)
        for pdf in batches:
            doc_ids, texts, at = pdf["doc_id"].astype("Int64"), [t if isinstance(t, str) else "" for t in pdf["text"]], 0
            for part in _chunks(texts, chunk_chars):
                ids = [e.ids for e in tok.encode_batch_fast([prepare(t, parsed) for t in part], add_special_tokens=False)]
                out = pd.DataFrame({"doc_id": doc_ids.iloc[at:at + len(part)].array, "ids": [np.asarray(k, np.int32) for k in ids]})
                if with_text:
                    out["text"] = [decode_ids(k, surface, parsed.dummy_prefix) for k in ids]
                    out["same"] = [a == b for a, b in zip(out["text"], part)]
                yield out
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "doc_id long, ids array<int>" + ", text string, same boolean" * with_text)


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` that they stand for."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = parse_model(shared.value)
        surface = surfaces(parsed)
        for pdf in batches:
            texts = [decode_ids(ids.tolist() if ids is not None else [], surface, parsed.dummy_prefix) for ids in pdf["ids"]]
            yield pdf.assign(text=texts).astype({"doc_id": "Int64"})

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids array<int>, text string")


def parity(docs: DataFrame, model: bytes) -> DataFrame:
    """(n_docs, n_equal): how many texts get the same ids from the sentencepiece library."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece
        os.environ["RAYON_NUM_THREADS"] = "2"
        own, model = build_tokenizer(shared.value, prepared=True), parse_model(shared.value)
        theirs = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            same = 0
            for part in _chunks(texts, 200_000):
                a = own.encode_batch_fast([prepare(t, model) for t in part], add_special_tokens=False)
                same += sum(x.ids == y for x, y in zip(a, theirs.encode(part)))
            yield pd.DataFrame({"n_docs": [len(texts)], "n_equal": [same]})

    out = docs.select("text").mapInPandas(run, "n_docs long, n_equal long")
    return out.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_equal"), F.lit(0)).alias("n_equal"))
