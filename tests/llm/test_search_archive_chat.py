import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import chat_format, topk_search, warc_archive


def search(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in topk_search.topk_search(df, F.col("vec_id") % 2 == 0, k=2, candidates=3, queries=2, **more).collect())


def test_ties_repeats_nulls_and_zeros(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 5.0], 1), (2, [0.0, 0.0], 1), (3, [1.0, -5.0], 1), (4, None, 1), (6, [1.0, None], 1), (8, [nan, 1.0], 1), (10, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (0, [1.0, 0.0], 2), (5, [1.0], 1), (5, [1.0], 1)]
    assert search(spark, rows) == [(0, 1, 1, 65536), (0, 2, 3, 65536), (2, 1, 0, 0), (2, 2, 0, 0)]
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0], 1)]) == []


def test_sums_beyond_64_bits_keep_their_order(spark):
    rows = [(0, [3e30, 1.0], 1), (1, [2e30, 0.0], 1), (3, [3e30, 0.0], 1), (5, [-1e30, 0.0], 1)]
    assert search(spark, rows) == [(0, 1, 3, 2**63 - 1), (0, 2, 1, 2**63 - 1)]


def test_random_sparse_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((40, 7)) < 0.6, 0, rng.integers(-3, 4, (40, 7))) / 256
    want = []
    v = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    for q in range(0, 40, 2):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(40) if i != q)[:2]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert search(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)]) == sorted(want)


def test_archive_round_trip(spark):
    big = "ü" * 60
    rows = [(5, "u\r\n5", big, 1), (3, None, big, 1), (4, "u4", "", 1), (6, "u6", None, 1), (7, "u7", "x" * 99, 1), (8, "u8", "x" * 99, 1), (None, "n", big, 1), (3, None, big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc_archive.archive(df).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "response", None), (8, "response", None)]
    by_id = {r.page_id: r for r in got}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert bytes(by_id[i].payload) == data and by_id[i].payload_digest == hashlib.sha256(data).hexdigest()
    record = bytes(by_id[7].record)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: u7\r\n") and record.endswith(b"Content-Length: 99\r\n\r\n" + b"x" * 99 + b"\r\n\r\n")
    assert by_id[5].url == "u%0D%0A5" and b"Content-Length: 0\r\n\r\n\r\n\r\n" in bytes(by_id[5].record)
    assert warc_archive.archive(df.limit(0)).collect() == []


def test_payloads_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "same" * 50) for i in range(20)], "page_id long, url string, html string")
    warc_archive.write_archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 1 and spark.read.parquet(str(tmp_path / "a/records")).count() == 20


@pytest.mark.parametrize("text", ["", "a", "b<", "<|im_end|>", "\\", "\\\\<|x", "<\\|", "a\nb", "|im_end|>", "aaa", "bbb"])
def test_texts_survive_the_template(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    span, start, end = chat_format.turn_spans([("user", text)], ("assi\nst\\nant", text), chat_format.chatml)
    assert chat_format.parse_turn(span) == ("assi\nst\\nant", text)
    assert chat_format.unescape(span[start:end]) == text


def test_templates_that_rewrite_history_are_seen(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string")

    def counted(turns):
        return f"{len(turns)}:" + chat_format.chatml(turns)

    got = {(r.conv_id, r.position): (r.rewrites, r.formatted) for r in chat_format.format_turns(rows, counted).collect()}
    assert got == {(1, 0): (True, None), (1, 1): (True, None), (2, 0): (True, None)}
    headed = lambda turns: "<s>" + chat_format.chatml(turns) if turns else ""
    got = {(r.conv_id, r.position): r.formatted for r in chat_format.format_turns(rows, headed).collect()}
    assert got[1, 0].startswith("<s><|im_start|>user") and got[1, 1].startswith("<|im_start|>assistant")


def test_long_conversations_of_templates_that_look_back(spark):
    rows = [(c, i, "user", f"t{i}") for c in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    templates = {
        "numbered": lambda turns: "".join(f"{i}.{r}:{t}\n" for i, (r, t) in enumerate(turns)),
        "first": lambda turns: "".join(f"{turns[0][1] if i else ''}>{t};" for i, (_, t) in enumerate(turns)),
        "drops": lambda turns: "".join(f"{t};" for _, t in turns[-20:]),
        "once": lambda turns: ("!" if len(turns) == 25 else "") + "".join(f"{t};" for _, t in turns),
    }
    rewritten = {"numbered": set(), "first": set(), "drops": set(range(20, 40)), "once": {24, 25}}
    for name, template in templates.items():
        got = sorted(chat_format.format_turns(df, template).collect(), key=lambda r: (r.conv_id, r.position))
        for c in (1, 2):
            mine = [r for r in got if r.conv_id == c]
            assert {r.position for r in mine if r.rewrites} == rewritten[name]
            assert all(r.formatted is None if r.rewrites else r.formatted[r.text_start : r.text_end] == f"t{r.position}" for r in mine)
            if not rewritten[name]:
                assert "".join(r.formatted for r in mine) == template([("user", f"t{i}") for i in range(40)])


def test_conversations_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(40)]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "x<|y", "é\n"]), 7) for _ in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_turns(df, context=3)).collect()}
    for conv in (None, 1, 2, 3):
        turns = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.rewrites) == (len(turns), len(said), False)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == len(chat_format.chatml([t[1:] for t in turns]))
    assert chat_format.digest_conversations(chat_format.format_turns(df.limit(0))).collect() == []


def test_records_are_dated_and_parsed_from_their_bytes(spark):
    html = "<p>ü\r\n\r\nContent-Length: 3\r\n\r\n</p>" * 5
    df = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", html), (3, "http://c/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc_archive.archive(df, at="2024-05-06T07:08:09Z").collect()}
    payload = html.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    record = bytes(got[1].record)
    header, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:])
    assert header.startswith(b"WARC/1.1\r\n") and fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["Content-Type"] == "application/http;msgtype=response"
    assert rest == head + payload + b"\r\n\r\n" and int(fields["Content-Length"]) == len(head + payload)
    assert bytes(got[1].payload) == bytes(got[2].payload) == payload and got[2].record_type == "revisit" and b"Content-Length: 0" in bytes(got[2].record)
    assert bytes(got[3].payload) == b"" and got[3].date == "2024-05-06T07:08:09Z"
    again = warc_archive.parse_record(spark.createDataFrame([(bytearray(record),)], "record binary")).first()
    assert (again.page_id, again.url, again.record_type, bytes(again.body)) == (1, "http://a/", "response", payload)
    now = warc_archive.archive(df).first().date
    assert len(now) == 20 and now.endswith("Z")


def test_small_blocks_and_large_ones_find_the_same(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.integers(-9, 9, (90, 5)) / 256.0)], "vec_id long, embedding array<double>")
    every = [sorted(tuple(r) for r in topk_search.topk_search(df, F.col("vec_id") % 3 == 0, k=4, **more).collect()) for more in ({}, {"candidates": 7, "queries": 5})]
    assert every[0] == every[1] and len(every[0]) == 120


def test_digests_without_a_second_shuffle(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", f"t{i}") for c in range(30) for i in range(9)]
    turns = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plans = [chat_format.digest_conversations(turns, arranged=a) for a in (False, True)]
    assert [p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for p in plans] == [2, 1]
    assert sorted(map(str, plans[0].collect())) == sorted(map(str, plans[1].collect()))


def test_a_wrong_mark_is_not_trusted(spark):
    numbered = chat_format.turn_local(lambda turns: "".join(f"{i}:{role}:{text};" for i, (role, text) in enumerate(turns)))
    forgetful = chat_format.turn_local(lambda turns: "".join(f"{role}:{text};" for role, text in turns[-20:]))
    rows = [(c, i, "user" if i % 2 else "assistant", f"t{i}") for c in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat_format.format_turns(df, numbered).where("conv_id = 2").orderBy("position").collect()
    assert [r.formatted for r in got] == [f"{i}:{'user' if i % 2 else 'assistant'}:t{i};" for i in range(40)] and not any(r.rewrites for r in got)
    got = chat_format.format_turns(df, forgetful).where("conv_id = 1").orderBy("position").collect()
    assert [r.rewrites for r in got] == [i >= 20 for i in range(40)] and got[39].formatted is None
    calls = []
    counted = chat_format.turn_local(lambda turns: calls.append(len(turns)) or chat_format.chatml(turns))
    turns = [("user", f"t{i}") for i in range(3000)]
    assert "".join(x[0] for x in chat_format.conversation_spans(turns, counted)) == chat_format.chatml(turns) and sum(calls) < (4 * 17 + 4) * len(turns)  # four renders of the context and a turn, and the proofs
