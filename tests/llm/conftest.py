"""Rows that every operator has to take: nulls, empty and long texts, repeats, clashing names."""

import random

import pytest

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, "
    "fingerprint string, spans string, row int, hash int, held_out string"
)


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def edge_rows():
    own = [
        (1, "Plain words, a few of them. token = \"0123456789abcdef0123456789abcdef01\"", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "fr"),
        (5, words(5, 30_000), "en"),
        (6, "Été à l'école 漢字 😀 naïve <|endoftext|> x   y", "fr"),
        (6, "Été à l'école 漢字 😀 naïve <|endoftext|> x   y", "fr"),
        (None, "a row without a key", "en"),
        (8, "x" * 50_000, None),
        (9, words(9, 40), "en"),
        (10, words(9, 40), "en"),
        (11, words(9, 40).upper(), "en"),
        (12, "1 2 3 !!", "de"),
    ]
    return [(i, t, l, None if i == 9 else "s1", len(t or ""), 0.5, "x", "y", "z", 1, 2, "w") for i, t, l in own]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def many_docs(n: int = 300, seed: int = 1):
    """Texts in two made-up languages with copies and near copies; every tenth is abusive, every
    seventh is junk."""
    rng = random.Random(seed)
    vocab = {
        "aa": ["lorem", "ipsum", "dolor", "amet", "magna", "tempor", "aliqua", "veniam", "nostrud"],
        "bb": ["zwick", "krauz", "schwor", "blitzk", "wurzt", "knarz", "pfrund", "stolz", "grutz"],
    }
    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        text = [rng.choice(vocab[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(20, 80))]
        toxic = i % 10 == 0
        junk = i % 7 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "vilewretch", "lowlife"]))
        if junk:
            text = [w + rng.choice(["%%%", "$$$", "###"]) for w in text]
        rows.append((i, " ".join(text), lang, f"s{i % 4}", int(not junk), int(toxic)))
    return rows


@pytest.fixture(scope="session")
def corpus(spark):
    rows = many_docs()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(
        [(r[0], r[4], r[5]) for r in rows], "doc_id long, quality int, toxic int"
    )
    return docs, labels
