import random

import pytest

EXTRA = ["row", "uid", "kept", "size", "key", "digest", "_uid", "a.b", "ballot", "copies", "spans", "cls"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with every awkward case: (doc_id, text, source)."""
    rng = random.Random(5)
    base, long = words(rng, 120), words(rng, 30_000, 5000)
    passage = words(rng, 110, 9000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "a"),
        (2, base, "a"),
        (2, base, "a"),  # a repeated row
        (3, base.upper().replace("W", "w"), "b"),
        (4, " ".join(near), None),
        (5, "", "a"),
        (6, None, "b"),
        (None, "no id here at all", "a"),
        (None, None, None),
        (7, long, "c"),
        (8, words(rng, 200) + " " + passage + " " + words(rng, 50), "c"),
        (9, passage + "\n" + words(rng, 90), "c"),
        (10, "ÄÖÜ é ß İ   x", "d"),
        (11, "one two", "d"),
        (12, "one two", "d"),
        (13, "the same words " * 200, "d"),
        (14, "aaaa" * 400, "d"),
        (15, " \t\n\x0b ", "d"),
    ]
    rows += [(100 + i, words(rng, rng.randrange(1, 300)) + ".", rng.choice("abcd")) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with nulls in other columns and extra columns whose names clash with the operators' own."""
    rows = [(i, t, None if k % 3 else "en", s, None, *["x"] * len(EXTRA)) for k, (i, t, s) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)
