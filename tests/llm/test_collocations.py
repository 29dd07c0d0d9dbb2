import random
import re
from collections import Counter

import pytest

from leadloom.llm import collocations


def brute_force(rows, least, within=80, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cands = {(lang, g): a for (lang, g), a in f.items() if len(g) > 1 and a >= least}
    inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
    out = []
    for (lang, g), a in cands.items():
        if any(x == lang and len(h) > len(g) and inside(g, h) and 100 * b >= within * a for (x, h), b in cands.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, -score, -a, " ".join(g), left, right))
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out, key=lambda r: (r[0], r[1], r[2], r[3].encode())):
        rank[lang] += 1
        if rank[lang] <= first:
            rows.append((lang, rank[lang], phrase, -a, left, right, n[lang], -score))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, block int, words string").repartition(5)


def random_rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "the", "of", "New", "york", "x\x00", "中文", "·"]
    copied = " ".join(rng.choices(words, k=14)) + " one two three four five six seven eight nine ten"
    rows = []
    for _ in range(70):
        pieces = [rng.choice([" ", "\t", "  "]).join(rng.choices(words, [9, 5, 4, 3, 2, 6, 6, 3, 3, 1, 1, 1], k=rng.choice([0, 1, 2, 3, 4, 9]))) for _ in range(6)]
        rows.append((rng.choice(["en", "en", "de", None, "und", "", "x\ny"]), rng.choice([".", ", ", "\n", "?!", "\r"]).join([*pieces, rng.choice(["", copied])])))
    return [*rows, ("en", None), (None, ""), ("en", "..."), rows[0], rows[0], ("long", "ab cd ef " * 3000)]


@pytest.mark.parametrize("seed, least", [(1, 5), (2, 2), (3, 12)])
def test_phrases_equal_brute_force(spark, seed, least):
    rows = random_rows(seed)
    got = [tuple(r) for r in collocations.mine(frame(spark, rows), least=least).collect()]
    assert sorted(got) == sorted(brute_force(rows, least)) and len(got) > 5


def test_first_phrases_and_empty_tables(spark):
    rows = random_rows(5)
    got = [tuple(r) for r in collocations.mine(frame(spark, rows), least=3, first=4, within=50).collect()]
    assert sorted(got) == sorted(brute_force(rows, 3, 50, 4))
    assert collocations.mine(frame(spark, rows).limit(0)).collect() == []
    assert collocations.mine(frame(spark, [("en", None)])).collect() == []


def test_copies_become_one_path(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("en", text)] * 3 + [("en", "w10 w11 w12 q"), ("en", "w40 w41 w42 w43")] * 3
    phrases = collocations.counts_by_flow(collocations.edges_and_ends(frame(spark, rows), least=2), 2)
    paths = {" ".join(r.words): r.weight for r in collocations.compact_paths(phrases).collect()}
    # w10 w11 w12 goes two ways, w40 w41 w42 w43 begins and ends pieces, so paths break there
    words = text.split()
    assert paths == {" ".join(words[:13]): 3, " ".join(words[10:43]): 3, "w40 w41 w42 w43": 6, " ".join(words[41:]): 3, "w10 w11 w12 q": 3}
