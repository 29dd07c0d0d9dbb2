import random
import re
from collections import Counter, defaultdict

import pytest

from leadloom.llm import divergence


def brute_force(rows, least_docs=3, first=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = lambda c: (lambda size: {t: 1 + 10**9 * (c[t] + 1) // size for t in kept})(sum(c[t] for t in kept) + len(kept))
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:first])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


def random_rows(seed, n=150):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "aBcdÉé中" for b in "xyzß"] + ["the", "THE", "don't", "a1b", "x\x7fy", "~"]
    rows = [(rng.choice(["en", "en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "é"]), " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.choice([0, 1, 9, 80])))) for _ in range(n)]
    return [*rows, ("fr", "only", "un deux"), ("it", "a", None), ("it", "b", ""), ("en", "empty", "12 34"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, item string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df, first=7).collect())
    assert got == brute_force(rows, first=7)
    assert divergence.audit(df.limit(0)).collect() == []


def test_small_blocks_and_tiles_give_the_same_tables(spark):
    rows = random_rows(3)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    kept, langs = divergence.levels(divergence.term_counts(df))
    form = lambda t: sorted(map(tuple, t.collect()))
    want = form(divergence.joint_tables(kept, langs))
    assert want and form(divergence.joint_tables(kept, langs, block=5, tile=3)) == want
    v = {r.lang: r.v for r in langs.collect()}
    assert sum(r[5] for r in want if r[0] == "en" and r[1:3] == (0, 1)) == v["en"]  # each table holds every term once
