import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, node string"


def vocabulary(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with exact copies, near copies, shared passages, repeated lines, short, empty and null texts."""
    rng, words = random.Random(seed), vocabulary(seed)
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [sentence(30) for _ in range(3)]
    line = sentence(8)
    docs: list[tuple[int | None, str | None]] = []
    for k in range(n):
        parts = [sentence(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        if k % 4 == 0:
            parts.append(line)
        docs.append((k, "\n".join(parts)))
    for k in range(n, n + 25):
        text = docs[rng.randrange(12)][1] or ""
        if k % 2:
            w = text.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        if k % 5 == 0:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + rng.randint(0, 1):]
        docs.append((k, text))
    docs += [(200, ""), (201, None), (202, "  \n\t "), (203, "one"), (204, "two words"), (205, "Two Words"), (206, "one"),
             (None, "a row without an id " * 4), (None, None), (207, "It " * 3000), (208, "  nbsp em \U0001d4b3"), (208, "x y z"),
             (209, docs[0][1])]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 5, "x") for i, t in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
