import hashlib
import os
import re
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import pii_bootstrap, simhash_dedup
from leadloom.llm.byte_bpe import load_ranks

from .test_documents import components, slow_fingerprint, slow_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_are_those_of_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "pii_bootstrap", "mixing", "byte_bpe"]


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    readable = sorted(i for i, t in docs.items() if any(c.isalpha() for c in t or ""))
    fps = [slow_fingerprint(docs[i]) for i in readable]
    kept = {i for i, c in zip(readable, components(fps, readable), strict=True) if i == c}
    assert set(got) == kept
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    plain = [i for i in got if not re.search("[0-9@]", docs[i])]
    assert len(plain) > 100
    for i in plain:
        ids = encoding.encode_ordinary(docs[i])
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(docs[i].encode()).hexdigest()


def test_decisions_take_effect_and_columns_stay(spark):
    rows = [(1, "der Hund und die Katze sind nicht da", "de", "a", 36), (2, "the dog and the cat are not here", None, "b", 32), (3, "1234 !!", None, "a", 7), (4, None, "de", "a", 0), (5, "the dog and the cat are not here", "en", "c", 32), (6, "mail me: bob@x.org please, the dog is not here", "en", None, 46)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _ in range(2):
        docs = docs.unionByName(docs.limit(0))
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after[name] = {r.doc_id: r for r in docs.collect()}
    assert set(after["language_id"]) == {1, 2, 5, 6} and after["language_id"][2].lang in ("de", "en")
    assert set(after["simhash_dedup"]) == {1, 2, 6}
    assert after["pii_bootstrap"][6].text == "mail me: <email> please, the dog is not here" and after["pii_bootstrap"][6].n_chars == 44
    assert set(after["mixing"]) == {1, 2, 6}
    assert Counter(r.n_tokens > 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == {True: 3}


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = "the dog and the cat are not here", "a bird sang in the old tree by the lake", "we went up the hill to see the sun", "nobody knows what the answer could be"
    rows = [(1, a), (1, a), (2, b), (2, a), (None, c), (None, c), (None, d), (7, d), (7, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (2, b), (None, c), (7, d)])


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_stages_on_the_table_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = spark.createDataFrame(stages["simhash_dedup"](spark, stages["language_id"](spark, table, SF), SF).collect(), table.select(*corpus_pipeline.COLUMNS).schema)
    rows = {r.doc_id: r for r in kept.collect()}

    redacted = {r.doc_id: r for r in stages["pii_bootstrap"](spark, kept, SF).collect()}
    spans = {r.doc_id: r.s for r in pii_bootstrap.find(kept).select("doc_id", pii_bootstrap.written(F.col("spans")).alias("s")).collect()}
    assert set(redacted) == set(rows) and any(spans.values())
    for i, r in rows.items():
        base = slow_spans(r.text)
        assert set(filter(None, base.split(","))) <= set(spans[i].split(","))
        out, at = "", 0
        for kind, a, b in (x.split(":") for x in spans[i].split(",") if x):
            if int(a) >= at:
                out, at = f"{out}{r.text[at : int(a)]}<{kind}>", int(b)
        assert redacted[i].text == out + r.text[at:] and redacted[i].n_chars == len(redacted[i].text)
        assert not slow_spans(redacted[i].text)

    # every source's blocks of 16, in the order of hashed ids, go to the slots that earliest deadline first gives them
    mixed = [r.doc_id for r in stages["mixing"](spark, kept, SF).collect()]
    sources = sorted({r.source for r in rows.values()}, key=lambda s: (s is not None, s))
    queues = {s: sorted((i for i in rows if rows[i].source == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)) for s in sources}
    total = sum(len(q) ** 0.5 for q in queues.values())
    parts = {s: max(1, int(len(q) ** 0.5 / total * 1000 + 0.5)) for s, q in queues.items()}
    period = sum(parts.values())
    want, done, slot = [], dict.fromkeys(sources, 0), 0
    while any(done[s] * 16 < len(queues[s]) for s in sources):
        free = [(-(-(done[s] + 1) * period // parts[s]), n, s) for n, s in enumerate(sources) if done[s] * period // parts[s] <= slot]
        if free:
            s = min(free)[2]
            want += queues[s][16 * done[s] : 16 * done[s] + 16]
            done[s] += 1
        slot += 1
    assert mixed == want


def test_junk_and_unseen_scripts_go_and_short_texts_stay(spark):
    good = [("en", "the dog and the cat are not here"), ("de", "der Hund und die Katze sind nicht da")] * 10
    rows = [(i, f"{t} {i % 3}", lang, "s", len(t)) for i, (lang, t) in enumerate(good)]
    rows += [(100, "the cat", None, "s", 7), (101, "\u4e2d\u6587\u6587\u672c \u6ca1\u6709", None, "s", 8), (102, "1234 !!", None, "s", 7), (103, None, "en", "s", 0), (104, "", "en", "s", 0), (None, "die Katze", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert left == {*range(20), 100, None}


def test_workers_keep_nothing_of_an_earlier_stage(spark):
    table = spark.createDataFrame([(i, f"a text of its own {i}") for i in range(64)], "doc_id long, text string").repartition(16)
    stages = dict(corpus_pipeline.STAGES)

    def kept(batches):
        import gc

        from leadloom.llm.byte_bpe import Encoder

        gc.unfreeze()
        n = sum(isinstance(x, Encoder) for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch), pa.int64())], names=["n"])

    assert stages["byte_bpe"](spark, table, SF).count() == 64
    assert table.mapInArrow(kept, "n long").agg({"n": "max"}).first()[0] == 1
    simhash_dedup.near_duplicates(table).collect()
    assert table.mapInArrow(kept, "n long").agg({"n": "max"}).first()[0] == 0
