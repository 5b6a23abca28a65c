import random

import pytest

CLASHING = ("part", "size", "shard", "slot", "rank", "length", "key", "rep", "component", "score", "predicted", "n_lines", "label", "_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "an", "des", "ür", "ño", "que", "sh"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


ODD = [
    (1, "hello world"), (2, None), (3, ""), (None, "no id at all"), (None, None), (5, "same row"), (5, "same row"), (5, "other text"),
    (7, prose(7, 20_000)), (8, "Line\r\n\r\n \tx\n" + "y" * 50 + "\n"), (9, "\n\n\n"), (10, "🙂 é <|endoftext|>  "), (-4, prose(4, 300)),
    (11, prose(4, 300)), (12, prose(4, 299) + " end"), (2**62, "far id"),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src", len(t or ""), *["clash"] * len(CLASHING)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD).repartition(3)
