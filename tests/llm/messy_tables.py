import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, q int, ids string, score int"


def messy_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies near and exact."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = prose(120).split()
    texts = [None, "", " \t\n\x0b", "one", "One TWO three", "a b c d e f", "é ü 日本", prose(30), prose(4000)]
    for k in range(0, 40, 2):
        near = list(base)
        near[k * 3: k * 3 + k // 4] = ["zz"] * (k // 4)
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 4 + [" ".join(base).upper()]
    shared = "  Shared LINE of many documents \r"
    texts += [f"{prose(8)}\n{shared}\n\n{prose(5)}\n{shared.lower()}" for _ in range(12)]
    texts += ["\n".join([shared] * 3), "x\n" * 2000, "the and of " * 60, "# * $ | " * 80, "WOW! " * 90]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", None, "s1")[i % 3] if i % 5 else "s0", None, "r", 1, "x", 2) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (7, "another text under seven", None, None, 3, None, None, None, None), (None, texts[9], *[None] * 7), (None, None, *[None] * 7)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
