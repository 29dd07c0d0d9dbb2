import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from leadloom.llm.byte_bpe import Decoder, Encoder, MergeTransducer, Utf8Stream, decode, encode, load_ranks, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=3000):
    rng = random.Random(4)
    marks = [chr(c) for c in (*range(0x250), 0x3000, 0x2028, 0x4E2D, 0x1F600, 0x200D, 0x20AC, 0x410, 0x5D0)]
    for _ in range(n):
        yield "".join(rng.choice(marks) if rng.random() < 0.4 else rng.choice(" the'sll're  \n\tingation12") for _ in range(rng.randint(0, 60)))


def test_ids_are_those_of_the_library(ranks, reference):
    enc, dec = Encoder(ranks, P.PATTERN), Decoder(ranks)
    for text in texts():
        ids = enc.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert dec.decode(ids) == (text.encode(), True)


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 3000, " " * 3000 + "x", "!" * 3000, "é" * 2000, "x y " * 700_000])
def test_long_pieces_and_parts(ranks, reference, text):
    assert Encoder(ranks, P.PATTERN).encode(text).tolist() == reference.encode_ordinary(text)


def test_long_random_piece_with_a_small_table(ranks, reference):
    rng = random.Random(1)
    t = MergeTransducer(ranks, max_states=50)
    for _ in range(3):
        word = "".join(rng.choice("abcdefgh") for _ in range(4000))
        assert list(t.encode(word.encode())) == reference.encode_ordinary(word)


def test_transitions_are_made_and_used(ranks, reference):
    enc = Encoder(ranks, P.PATTERN)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(9)) for _ in range(400)]
    for _ in range(2):
        enc.pieces.clear()
        for w in words:
            assert enc.encode(w).tolist() == reference.encode_ordinary(w)
    assert len(enc.pieces.transducer.states) > 10


def test_ranks_that_are_not_in_order_of_making():
    # "abc" has a lower rank than the "bc" it is made of
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"cd": 258, b"ab": 260, b"abcd": 259}
    enc = tiktoken.Encoding("odd", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    t = MergeTransducer(ranks)
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        if word.encode() in ranks:
            continue
        assert b"".join(t.vocab[i] for i in t.encode(word.encode())) == word.encode()
        assert len(t.merge(word.encode())) == len(enc.encode_ordinary(word))


def test_broken_characters_are_seen(ranks):
    d = Decoder(ranks)
    euro = [ranks[bytes([b])] for b in "€".encode()]
    assert d.decode(np.array(euro, np.int32)) == ("€".encode(), True)
    assert d.decode(np.array(euro[:2], np.int32)) == ("€".encode()[:2], False)
    assert d.decode(np.array([euro[1]], np.int32))[1] is False
    assert d.decode(np.zeros(0, np.int32)) == (b"", True)


def test_on_rows(spark, reference):
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello wörld", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(df, PATH, P.PATTERN), PATH).collect()
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded), r.whole_utf8) for r in out) == sorted((i or 0, reference.encode_ordinary(t or ""), (t or "").encode(), True) for i, t, _ in rows)
    assert sorted(map(str, round_trip(df, PATH, P.PATTERN).collect())) == sorted(map(str, out))
    assert encode(df.limit(0), PATH, P.PATTERN).collect() == round_trip(df.limit(0), PATH, P.PATTERN).collect() == []


def test_file_is_read_as_written(ranks):
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def test_tokens_come_from_transitions(ranks, reference):
    t = MergeTransducer(ranks)
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(5, 14))) for _ in range(500)]
    by_transitions = by_end = made = 0
    step = t._step

    def counted(state, byte):
        nonlocal made
        made += 1
        return step(state, byte)

    t._step = counted
    for w in words:
        if w.encode() in ranks:
            continue
        state, out = t.start, 0
        ids = t.encode(w.encode())
        for b in w.encode():
            step_made = t.next[state << 8 | b]  # every byte of every piece goes through a transition
            out += len(t.emissions[step_made >> 32])
            state = step_made & 0xFFFFFFFF
        by_transitions, by_end = by_transitions + out, by_end + len(t.final[state])
        assert out + len(t.final[state]) == len(ids) and list(ids) == reference.encode_ordinary(w)
    assert by_transitions > 0 and made < sum(map(len, words))
    long = "".join(rng.choice("aeinrst") for _ in range(3000)).encode()
    assert list(t.encode(long)) == reference.encode_ordinary(long.decode())
    assert max(len(x[0]) for state in t.open for x in state) < max(map(len, ranks))  # the lookahead is bounded


def test_characters_are_streamed_whole(ranks):
    d = Decoder(ranks)
    text = "a€é😀z" * 3
    ids = [ranks[bytes([b])] for b in text.encode()]
    parts = list(d.stream(ids, Utf8Stream()))
    assert b"".join(parts) == text.encode() and [p.decode() for p in parts if p] == list(text)
    rng = random.Random(7)
    for _ in range(300):
        data = b"".join(rng.choice([b"a", "€".encode(), "😀".encode(), b"\xe2", b"\x82", b"\xf0\x9f", b"\xff", b"\xc3"]) for _ in range(8))
        utf8 = Utf8Stream()
        got = b"".join(utf8.feed(data[i : i + 1]) for i in range(len(data))) + utf8.finish()
        assert got == data and utf8.whole == (data.decode("utf-8", "replace").encode() == data)
        ids = np.array([ranks[bytes([b])] for b in data], np.int32)
        assert d.decode(ids) == (data, utf8.whole)


@pytest.mark.parametrize("build", [encode, round_trip])
def test_batches_are_small_beside_the_tables(spark, build):
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    found = build(docs, PATH, P.PATTERN)
    rows = docs.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) <= 1 << 20
    assert found.selectExpr("count(*)", "count(DISTINCT doc_id)", "count(DISTINCT ids)").first() == (3000, 3000, 1)
