"""Small tables for the tests of the training-data operators."""
from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, part long, kept string, words string, text_key string, key string"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("the ea in ti on er or th é ü".split()) for _ in range(rng.randint(1, 4))) for _ in range(words))


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, blank and long texts, repeated rows, ids out of order and below zero."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 80), sentence(rng, 9)
    texts: list[tuple] = []
    for i in range(60):
        body = [sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            body.append(line)
        if i % 5 == 0:
            body.insert(0, passage)
        texts.append((1000 - i, "\n".join(body)))
    for i in range(12):  # near copies
        words = texts[7][1].split(" ")
        words[i % len(words)] = f"edit{i}"
        texts.append((2000 + i, " ".join(words)))
    texts += [(3000 + i, texts[5][1]) for i in range(5)]
    texts += [(50, None), (51, ""), (52, " \n\t "), (53, "One"), (54, "one"), (-7, texts[9][1]), (None, texts[9][1]), (None, None), (55, "é" * 70), (56, "é" * 71)]
    texts += [(57, "x" * 3000), (58, "ab " * 5000), (59, passage.upper()), (60, passage + " " + passage)]
    texts += [texts[3], texts[3]]
    return [(d, t, "en", "s", 0, 1, 2, "k", "w", "t", "y") for d, t in texts]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS).repartition(3)


def pairs(rows: list[tuple] | None = None) -> list[tuple]:
    return [(r[0], r[1]) for r in (corpus() if rows is None else rows)]
