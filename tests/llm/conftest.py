from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, th long, bucket long, score double"


def prose(rng: random.Random, words: int) -> str:
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    out = []
    for k in range(words):
        out.append("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + (".\n" if k % 23 == 22 else "." if k % 9 == 8 else ""))
    return " ".join(out)


def odd_texts() -> list[str | None]:
    """Null, empty, blank, short, very long, repeated, near-equal and strange texts."""
    rng = random.Random(5)
    base, passage = prose(rng, 160), prose(rng, 60)
    near = base.replace(base.split()[40], "changed", 1)
    long = prose(rng, 30_000)
    return [
        None, "", " ", "\n\n", "word", "one two three four five", base, base, near, base + " tail end", passage + "\n" + prose(rng, 90), prose(rng, 90) + "\n" + passage,
        long, long[:40_000] + prose(rng, 20), "é" * 300, "日本語 " * 120, "x" * 450, "ab" * 200, "a\tb\r\nc  d   e 'tis we've", "<|endoftext|> mark <s> ▁ ", "\0 nul \x0b", "THE!! SAME!! WORD!! " * 30, "i d i o t and st.upid",
        "A b C d E f", "a B c D e F",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """A table of odd texts, with repeated rows, nulls in every column and extra columns with clashing names."""
    texts = odd_texts()
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", None, None, None, None, None, None) for k, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "s", 1, 1, 1, 1, 1, 1.0), (50, texts[12], "en", "s", 1, 1, 1, 1, 1, 1.0), (-3, "negative id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
