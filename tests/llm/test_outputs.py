"""Merkle manifest, token files and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import DOC_SCHEMA
from vigil.llm import fim, merkle, token_files
from vigil.llm.common import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ENCODE = token_files.Encoder(open(TOKENIZER).read(), "H", cached=10, longest=3)
WHOLE = Tokenizer.from_file(TOKENIZER)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest ---------------------------------------------------------------------------

def leaf_of(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def climb_of(levels, place, own):
    proof = ""
    for row in levels[:-1]:
        k = place - place % 3
        left, right = row[k:place], row[place + 1:k + 3]
        own, proof, place = H("".join([*left, own, *right])), proof + "".join(left + right), place // 3
    return own, proof


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree_of([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for place, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            own = leaf_of(r, r[1] and r[1].replace("\n", "")) if bent else leaf
            mid, low = climb_of(trees[s], place, own)
            end, high = climb_of(top, g, mid)
            out.append((r[0], s, place, leaf, trees[s][-1][0], top[-1][0], H(low + high), end, end == top[-1][0]))
    return out


def manifest_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_manifest_against_brute_force(spark, rows):
    """Ids that repeat, are null, negative or far apart; a null group, an empty one, one of two passes."""
    rng = random.Random(3)
    data = [(i, t, rng.choice(["en", None]), rng.choice([None, "", "a", "é", "z"]), rng.choice([None, 5])) for i, t in rows]
    data += [(k, f"x\n{k}", "en", "big", 3) for k in range(merkle.BLOCK + 40)]
    data += [(k, "far\n", "en", "far", 1) for k in (-2**63, -5, 2**63 - 1, 2**44, 2**44 + 63, 2**30, 0)]
    data += [(7, f"tie {k}", "en", "ties", 1) for k in range(5)] + [(7, "same\nrow", "en", "ties", 1)] * 4 + [(8, "b", "en", "ties", 1)]
    data += [(None, f"null {k}", "en", "ties", 1) for k in range(4)] + [(71, "c\n", "en", "ties", 1), (64, None, None, "ties", None)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in data], DOC_SCHEMA).withColumnRenamed("node", "place").repartition(5)
    assert manifest_rows(merkle.manifest(docs)) == sorted(brute_manifest(data), key=str)


def test_manifest_of_one_row_and_of_none(spark, empty):
    one = [(4, "a\nb", "en", "s", 3)]
    got = manifest_rows(merkle.manifest(spark.createDataFrame([(*one[0], 1, "n")], DOC_SCHEMA)))
    assert got == brute_manifest(one) and got[0][6] == H("")
    assert merkle.manifest(empty).collect() == []


def test_directory_is_a_running_sum(spark):
    rng = random.Random(5)
    data = sorted({(rng.randrange(3), rng.choice([1, -1]) * rng.randrange(2 ** rng.randrange(1, 58))) for _ in range(400)})
    counts = spark.createDataFrame([(g, p, 1 + abs(p) % 5) for g, p in data], "g long, p long, n long")
    got = {(r.g, r.p): r.start for r in merkle.starts(counts).collect()}
    assert got == {(g, p): sum(1 + abs(q) % 5 for h, q in data if h == g and q < p) for g, p in data}


# --- token files -------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=700), st.sampled_from([0, 1, 7, 40, 63]))
def test_elias_fano(values, shift):
    values = np.sort(np.array([v >> shift for v in values], np.uint64))
    ef = token_files.EliasFano.build(values)
    assert ef.all().tolist() == values.tolist() == [ef[k] for k in range(len(values))]
    for v in values[:5].tolist():
        assert ef.find(v) == np.searchsorted(values, np.uint64(v))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000)).astype(np.uint64)
    ef = token_files.EliasFano.build(ends)
    assert ef.n_bytes * 8 / len(ends) < 2.3 + np.log2(float(ends[-1]) / len(ends))


def brute_tokens(rows):
    tok = Tokenizer.from_file(TOKENIZER)
    out = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    return [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in out]


def check_starts(got):
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


ODD = [(900, "a b c\x1cd\x85e"), (901, "<|endoftext|> x<|startoftext|>y < |endoftext|>"), (902, "ΑΣ ΣΑΣ Σ İ ǅ"),
       (903, "é ́a 가 ᄀ ᅡ"), (904, "it's I'LL 'S we'd 12 ½ Ⅷ ١٢"), (905, "x" * 5000 + " " + "é" * 3000),
       (908, "".join(map(chr, range(0xC0, 0x250))) + " " + " ".join(map(chr, range(0x21, 0x250)))), (909, "A&B it's 'T'll-d'Re !'s é's 9'é"),
       (910, "long text é " * 40_000 + "x" * 300_000), (906, "😀 ‍👩‍🚀 ﻿bom"), (907, " line　wide\x0bvt\x0cff\rcr")]


def test_token_files_round_trip(spark, docs, rows):
    more = spark.createDataFrame([(i, t, "en", "s", 1, 1, "x") for i, t in ODD], DOC_SCHEMA)
    got = token_files.token_files(docs.unionByName(more), TOKENIZER).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(brute_tokens(rows + ODD), key=str)
    check_starts(got)


def test_token_files_of_other_shapes(spark, docs, rows, empty, tmp_path):
    """Many small files, four-byte ids, whole texts (another tokenizer); documents by place and by id."""
    scratch = Scratch(spark, "test")
    path = f"{scratch.root}/small"
    token_files.write_tokens(docs, path, TOKENIZER, end_id=70_000, file_ids=900, file_docs=7)
    got = token_files.with_starts(scratch.write(token_files.read_tokens(spark, path, with_ids=True), "r")).collect()
    assert len({(r._part, r.number) for r in got}) > 10
    check_starts(got)
    tok = Tokenizer.from_file(TOKENIZER)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 70_000] for i, t in rows if i not in (None, 208)}
    assert {r.doc_id: r.ids for r in got if r.doc_id in want} == want
    files = [token_files.TokenFile(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    seen = {}
    for f in files:
        assert f.id_bytes == 4
        for k in range(f.n_docs):
            a, b = f.span(k)
            if k >= f.n_null:
                seen.setdefault(f.doc_ids[k - f.n_null] + f.first, []).append(f.ids[a:b].tolist())
                assert k in f.places_of(f.doc_ids[k - f.n_null] + f.first)
    assert {i: v[0] for i, v in seen.items() if i in want} == want
    assert token_files.token_files(empty, TOKENIZER).collect() == []
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.splits_at_space(open(other).read()) and token_files.splits_at_space(open(TOKENIZER).read())
    whole, t2 = token_files.token_files(docs.limit(30), other).collect(), Tokenizer.from_file(other)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == 1 + len(t2.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in whole if r.doc_id not in (None, 208))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé \n\t\x0b\x1c\xa0'sLl19½ΣσςİǺ가‍<|>😀"), max_size=60))
def test_words_encode_as_the_whole_text(text):
    assert np.frombuffer(ENCODE([text.encode()])[0], "<u2").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


# --- fill in the middle ------------------------------------------------------------------------

def brute_fim(doc_id, text, percent=100, spm_percent=50, units=None):
    text = text or ""
    u = units(text) if units else text.splitlines(keepends=True) if set(text) <= set("abc \n") else [
        x for x in text.replace("\n", "\n\0").split("\0") if x]
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return (doc_id, len(u), "plain", None, None, text)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, len(u), form, len(p), len(m), out)


FIM_ROWS = [(300, "a <P> b\nc"), (301, "\n\n\n"), (302, "<S\nP>"), (303, "x<\n<\n>y>"), (304, "no break"), (305, "end\n"), (306, "\r\n é\n😀"),
            (307, "".join(f"line {k} é😀\n" * (1 + k % 3) for k in range(30_000))), (308, "w" * 200_000 + "\n" + "v" * 10)]


@pytest.mark.parametrize("level", ["line", "char"])
def test_fill_in_middle(spark, docs, rows, empty, level):
    more = spark.createDataFrame([(i, t, "en", "s", 1, 1, "x") for i, t in FIM_ROWS], DOC_SCHEMA)
    out = fim.fill_in_middle(docs.unionByName(more), level=level).withColumn("restored", fim.restored())
    got = out.collect()
    units = list if level == "char" else None
    want = [brute_fim(i, t, units=units) for i, t in rows + FIM_ROWS]
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=str) == sorted(want, key=str)
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows + FIM_ROWS)
    assert all(r.output_sha256 == H(r.output) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).collect() == []


def test_cuts_read_only_their_frames():
    text = "".join(f"line {k}\n" for k in range(5000))
    s = fim.pack(text, zstandard.ZstdCompressor(), size=500)
    read, d = [], zstandard.ZstdDecompressor()

    def frame(k):
        read.append(k)
        return d.decompress(s.frames[k]).decode()
    assert s.n == 5000 and len(s.frames) > 50
    at = fim.char_of_unit(s, 3000, frame)
    assert text[:at] == "".join(f"line {k}\n" for k in range(3000)) and len(read) <= 1
    assert "".join(fim.stream(s, at, at + 40, frame)) == text[at:at + 40] and len(read) <= 4


def test_a_task_learns_the_words_of_100_mb_once():
    encode = token_files.Encoder(open(TOKENIZER).read(), "H")
    for first in range(0, 1_000_000, 25_000):
        encode([" ".join(f"{k:x}" for k in range(first, first + 25_000)).encode()])
    assert len(encode.known) == 1_000_000


def test_forms_of_a_word_go_to_the_library_as_one_part():
    encode, given = token_files.Encoder(open(TOKENIZER).read(), "H"), []

    class Heard:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    encode.ascii = Heard(encode.ascii)
    text = "Zebra zebra. ZEBRA, (zebra) zebra!!"
    assert encode([text.encode()]) == list(encode._each([text.encode()]))
    encode(["zebra? zebra;".encode()])
    assert " ".join(given).count("zebra") == 1
