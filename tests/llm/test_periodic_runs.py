"""Runs of words against a walk over all periods."""
import random

import numpy as np
from texts import corpus, frame, pairs

from logbraid.llm.periodic_runs import RangeSuccessor, periodic_runs, runs_of_words
from logbraid.llm.registered import with_periodic_tails


def brute(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] == words[i + p]:
                j = i
                while j + p < len(words) and words[j] == words[j + p]:
                    j += 1
                if j - i + p >= max(least, 2 * p):
                    found.setdefault((i, j - i + p), p)
                i = j
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def words(text):
    return [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]


def collapsed(text, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words(text)) if i not in gone)


def test_random_words_equal_a_walk_over_periods():
    rng = random.Random(1)
    for _ in range(600):
        letters, docs = rng.choice([1, 2, 3, 5]), []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(0, 90)
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.7:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                if rng.random() < 0.3:
                    w[rng.randrange(n)] = 9
            docs.append(w)
        least = rng.choice([12, 12, 2, 5, 30])
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        symbols = np.array([x for d in docs for x in d], np.uint64) * np.uint64(7919)
        got = zip(*(c.tolist() for c in runs_of_words(symbols, at, least)), strict=True)
        want = sorted((s + int(at[i]), n, p) for i, d in enumerate(docs) for s, n, p in brute(d, least))
        assert sorted(got) == want


def test_fibonacci_and_thue_morse_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") & 1 for i in range(2048)]
    for w in ([ord(c) for c in fib[-1]], thue, [0] * 700 + [1] + [0] * 650, [0, 1] * 300 + [2] + [0, 1] * 300 + [2] + [0, 1] * 301):
        got = runs_of_words(np.array(w, np.uint64), np.array([0, len(w)]))
        assert sorted(zip(*(c.tolist() for c in got), strict=True)) == brute(w)


def test_range_successor():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        tree = RangeSuccessor(values, n)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(0, n + 1, 200))
        x = rng.integers(0, n + 5, 200)
        below = tree.below(low, high, x)
        for a, b, v, k in zip(low, high, x, below):
            inside = np.sort(values[a:b])
            assert k == (inside < v).sum()
            if k < b - a:
                assert tree.kth(np.array([a]), np.array([b]), np.array([k]))[0] == inside[k]


def check(got, rows):
    want = []
    for doc_id, text in rows:
        runs = brute(words(text))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want.append((doc_id, len(words(text)), len(runs), *best, runs, collapsed(text, runs)))
    found = [(r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_odd_texts(spark):
    rows = [r for r in corpus() if r[0] != 58]
    more = [(500, "a b c " * 9 + "d"), (501, "x\t\n" * 40), (502, "é ü " * 12), (503, " " * 1000), (None, "q " * 30), (504, "w " * 11), (505, "w " * 12)]
    rows += [(i, t, "en", "s", 0, 1, 2, "k", "w", "t", "y") for i, t in more]
    check(periodic_runs(frame(spark, rows)), pairs(rows))
    assert periodic_runs(frame(spark).limit(0)).count() == 0


def test_long_texts(spark):
    rng = random.Random(4)
    phrase = " ".join(str(rng.randrange(10**6)) for _ in range(9000))
    text = phrase + " " + phrase + " tail " + "ab " * 400_000
    got = periodic_runs(frame(spark, [(1, text, "en", "s", 0, 1, 2, "k", "w", "t", "y")])).collect()[0]
    assert [tuple(r) for r in got.runs] == [(0, 18000, 9000), (18001, 400_000, 1)]
    assert got.collapsed == phrase + " tail ab" and (got.length, got.period) == (400_000, 1)


def test_tails_of_the_contract(spark):
    import zlib

    rows = [(i, " ".join(str(j) for j in range(i % 37)) + ("\n" if i % 2 else ""), *"abcdefghi") for i in range(300)] + [(None, "a b", *"abcdefghi")]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    want = []
    for i, text, *_ in rows:
        w, h = words(text), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        want.append((i, w))
    got = [(r.doc_id, words(r.text)) for r in with_periodic_tails(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
