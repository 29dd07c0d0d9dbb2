import math
import random
import zlib
from collections import Counter

import pytest

from leadloom.llm import lm_scoring

PRIOR = (1.0, 100.0, 10.0)


def brute_force(rows, order=3, prior=PRIOR):
    """Scores by the recursive formula of the smoothed model, without states or arcs."""
    tokens = {i: [*(w.decode() for w in (t or "").encode().lower().split()), "END"] for i, (_, t) in enumerate(rows)}
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    grams = Counter()
    for i, ws in tokens.items():
        if not held[i]:
            s = ["START", *ws]
            grams.update(tuple(s[j : j + k]) for k in range(1, order + 1) for j in range(len(s) - k + 1))
    n = sum(len(ws) for i, ws in tokens.items() if not held[i])
    v = sum(len(g) == 1 for g in grams) - (grams[("START",)] > 0)

    def p(history, w):
        if history is None:
            return 1 / (v + 1)
        shorter = p(history[1:] if history else None, w)
        k, of = len(history), grams[history] if history else n
        return (grams[(*history, w)] + prior[k] * shorter) / (of + prior[k])

    out = []
    for i, ws in tokens.items():
        s = ["START", *ws]
        score = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
        base = sum(math.log10((grams[(w,)] + 1) / (n + v + 1)) for w in ws)
        out.append((rows[i][0], held[i], len(ws), sum(grams[(w,)] > 0 for w in ws), n, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-12)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "b", "c", "dd", "É", "é", "x\x00y", "·"]
    texts = [rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choices(words, [9, 5, 4, 3, 2, 1, 1, 1, 1], k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(n)]
    return [(i if i % 13 else i // 2, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, None), (3, "never heard words"), (9, texts[5]), (9, texts[5])]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_formula(spark, order):
    rows = random_rows(order)
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "doc_id long, text string, block string, held_out boolean").repartition(5)
    close(lm_scoring.score(df, order=order).collect(), brute_force(rows, order))


def test_long_texts_are_read_in_segments(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefg", k=700))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    for segment in (1, 2, 7, 5000):
        close(lm_scoring.score(df, segment=segment).collect(), want)


def test_nothing_learned_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(df, held=F.lit(True)).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score == 0
    assert lm_scoring.score(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        lm_scoring.score(df, order=4)
