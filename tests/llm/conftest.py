from __future__ import annotations

import pytest

WORDS = "the of tion ander hethe reand onthe ingly stion era nter woulde".split()


def passage(seed: int, n: int) -> str:
    """Sentences of words that depend on the seed."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        word = WORDS[x >> 8 & 7] + WORDS[x >> 16 & 7] * (x >> 20 & 1) + chr(97 + (x >> 12) % 26)
        out.append(word + ("." if k % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null and empty values, blank, very long and repeated texts, equal rows, and columns with clashing names."""
    long_text = passage(99, 20_000)
    base = passage(1, 200)
    near = base.split(" ")
    near[100] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (None, "a text without an id"), (7, long_text),
        (8, "one"), (9, "two words"), (10, "ÀÉÎ ünï 日本語 😀 <|endoftext|> don't"), (11, passage(2, 150)), (11, passage(2, 150)), (12, passage(3, 90)),
        (13, "x" * 5000), (14, passage(4, 60) + "\n" + passage(5, 70)), (15, passage(6, 30) + ".\n" + passage(5, 70)),
    ]
    table = [(i, t, "n", 1, "m", 2, 3, 4, 5.0) for i, t in rows]
    return spark.createDataFrame(
        table, "doc_id bigint, text string, lang string, row int, mark string, n int, n_tokens int, size int, score double"
    )


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("doc_id < -5")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
