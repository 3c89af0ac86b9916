"""Deduplication operators against brute force."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from vigil.llm import line_dedup, minmax_dedup, substring_dedup
from vigil.llm.common import Scratch, components

LAST = 2**63 - 1


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def ascii_words(text):
    return (text or "").encode().split()


def brute_near(rows, width, percent):
    def shingles(text):
        w = [x.lower() for x in ascii_words(text)]
        k = min(width, len(w))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    sets = [(i, shingles(t)) for i, t in rows]
    real = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(real, 2) if 100 * len(s & t) >= percent * len(s | t)]
    comp = union_find({i for i, _ in real}, links)
    return sorted(((i, len(s), comp[i] if i is not None and s else i, i is None or not s or comp[i] == i)
                   for i, s in sets), key=str)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 499)], "a long, b long")
    got = {r.node: r.component for r in components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 499: 499, 500: 499}


def test_components_in_any_order_of_the_ids(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000, 20_000), 600)
    links = [(0, 90)] + [(k, k - 1) for k in range(90, 1, -1)] + list(zip(ids, ids[1:]))  # falling ids, shuffled ids
    links += [(30_000, 29_000 + k) for k in range(50)] + [(25_000 + rng.randrange(60), 25_000 + rng.randrange(60)) for _ in range(45)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == union_find({x for link in real for x in link}, real)


def test_near_duplicates(spark, rows, docs, empty):
    for width, percent in ((2, 80), (5, 80)):
        got = minmax_dedup.near_duplicates(docs, width=width, percent=percent).collect()
        assert sorted(map(tuple, got), key=str) == brute_near(rows, width, percent)
    assert minmax_dedup.near_duplicates(empty).count() == 0
    kept = minmax_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 2


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(60)] = rng.choice(words)
        rows.append((1000 - k, " ".join(w)))
    whole = minmax_dedup.block_links
    monkeypatch.setattr(minmax_dedup, "block_links", lambda *a: whole(*a, block=20))
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(rows, 2, 80)


def brute_substrings(rows, width):
    first = {}
    for i, t in rows:
        w, i = ascii_words(t), LAST if i is None else i
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, d = ascii_words(t), LAST if i is None else i
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < d:
                gone[p:p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_removal(spark, rows, docs, empty):
    for sample, max_hot in ((1, 3), (64, 1000), (1, 100_000)):
        got = substring_dedup.remove_repeats(docs, sample=sample, max_hot=max_hot)
        got = got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("h")).collect()
        assert sorted(map(tuple, got), key=str) == brute_substrings(rows, 13)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_cover_finds_a_shift_for_any_two_places():
    for i, j in itertools.product(range(7), repeat=2):
        assert any((i + s) % 7 in substring_dedup.COVER and (j + s) % 7 in substring_dedup.COVER for s in range(7))


def brute_lines(rows, edits, min_chars):
    trim = lambda s: s.strip(" \t\r\x0b\x0c")
    places, docs = {}, {(LAST if i is None else i, t) for i, t in rows if t is not None}
    for i, t in docs:
        for p, raw in enumerate(t.split("\n")):
            if trim(raw):
                places.setdefault(trim(raw), []).append((i, t, p))
    lines = sorted(places)
    links = [(a, b) for a, b in itertools.combinations(lines, 2) if min(len(a), len(b)) >= min_chars
             and abs(len(a) - len(b)) <= edits and levenshtein(a, b) <= edits]
    comp = union_find(lines, links)
    return comp, places


def check_lines(rows, got, edits, min_chars):
    """Each class keeps its first place; ties between texts of one id are open, so only its count is checked there."""
    comp, places = brute_lines(rows, edits, min_chars)
    best = {}
    for line, c in comp.items():
        best[c] = min(best.get(c, (LAST + 1,)), min((i,) for i, _, _ in places[line]))
    kept = {}
    for r in got:
        for raw in set((r.text or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if line:
                kept.setdefault(comp[line], set()).add(LAST if r.doc_id is None else r.doc_id)
    assert {c: min(ids) for c, ids in kept.items()} == {c: b[0] for c, b in best.items()}
    assert all(len(ids) == 1 for ids in kept.values())


def test_line_dedup(spark, rows, docs, empty):
    for edits, hot in ((1, 64), (1, 0), (2, 64)):
        out = line_dedup.dedup_lines(docs, edits=edits, min_chars=10, hot=hot)
        got = out.collect()
        assert [c for c in out.columns if c not in ("n_lines", "n_removed_lines")] == docs.columns
        assert len(got) == len(rows)
        check_lines(rows, got, edits, 10)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.keep_lines(docs).columns == docs.columns


def test_edit_distance_expression(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab𝒳é") for _ in range(rng.randint(1, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "b"])
        b = "".join(b) or "a"
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "x string, y string")
    for k in (1, 2, 3):
        for r in df.select("x", "y", line_dedup.lines_within("x", "y", k).alias("near")).collect():
            assert r.near == (levenshtein(r.x, r.y) <= k), (r.x, r.y, k)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def adversarial_words():
    """Words that agree in letters, sums or polynomial hashes."""
    words = [thue_morse(n) for n in (64, 512, 1024, 4096)] + [thue_morse(n, "b", "a") for n in (64, 512, 1024, 4096)]
    words += ["a", "a\0", "a\0\0", "\0a", "abcdefgh", "abcdefgh\0", "bacdefgh", "abcdefghabcdefgz", "abcdefgzabcdefgh", "é", "e\u0301"]
    words += ["x" * n for n in range(1, 40)] + ["x" * n + "y" + "x" * (39 - n) for n in range(40)]
    return words


def test_word_ids_of_adversarial_words():
    from vigil.llm.common import word_ids
    words = adversarial_words()
    ids = word_ids("  ".join(words).encode())
    assert len(ids) == len(words) == len(set(ids.tolist()))
    assert word_ids(("\n" + words[3] + "\t").encode())[0] == ids[3]  # whatever stands around a word
    assert len(word_ids(b"")) == len(word_ids(b" \n")) == 0


def test_documents_of_adversarial_words_are_not_linked(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, f"{a} foo"), (2, f"{b} foo"), (3, f"{a} foo bar"), (4, f"{a}  FOO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs, width=2, percent=80).collect())
    assert got == brute_near(rows, 2, 80)
