import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeweave.llm import packing, tokens

RANKS = tokens.read_ranks(open(tokens.vocabulary_path(), "rb").read())


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encode(text):
    return [i for p in tokens.Encoder(RANKS).pieces(text) for i in p]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_as_reference(text):
    text = text.encode("utf-8", "replace").decode()
    assert encode(text) == reference().encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "ab" * 2000, "aaa" * 7 + "b", "\u200b\ufeff\u00e9" * 40, " " * 900, "<|endoftext|>"])
def test_long_and_odd(text):
    assert encode(text) == reference().encode_ordinary(text)


def test_queue_gives_least_rank_leftmost():
    q, r = tokens.RankQueue(), random.Random(1)
    items = [(r.randrange(60_000), r.randrange(1000)) for _ in range(3000)]
    for rank, at in items:
        q.push(rank, at)
    assert [q.pop() for _ in items] == sorted(items) and q.pop() is None


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode(df).collect())
    assert got == [(1, encode("Hello world"))] * 2 + [(2, []), (3, [])]
    assert tokens.encode(df.limit(0)).count() == 0
    assert sorted((r["doc_id"], bytes(r["content"]).decode()) for r in tokens.decode(tokens.encode(df)).collect()) == [(1, "Hello world")] * 2 + [(2, ""), (3, "")]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_place_holds_everything(hist):
    patterns = packing.place(hist, 50)
    got = Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 50
        for x in lengths:
            got[x] += n
    assert got == Counter(hist)
    if hist:
        assert sum(n for n, _ in patterns) <= 2 * -(-sum(k * v for k, v in hist.items()) // 50)


@pytest.mark.parametrize("hist, capacity, want", [({100: 1000}, 2048, 50), ({1: 3}, 50, 1), ({26: 10}, 50, 10), ({7: 7}, 50, 1), ({30: 5, 20: 5}, 50, 5), ({2048: 3}, 2048, 3), ({}, 50, 0)])
def test_place_opens_no_pack_too_many(hist, capacity, want):
    assert sum(n for n, _ in packing.place(hist, capacity)) == want


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    docs = [(i, "word " * (i % 7), "en") for i in range(60)] + [(100, None, "en"), (101, " ".join(["cat"] * 95), "en")]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string, pack_id string"), capacity=20).collect()
    assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
    fill, spans = Counter(), {}
    for r in rows:
        if r["n_tokens"]:
            fill[r["pack_id"]] += r["n_tokens"]
            spans.setdefault(r["pack_id"], []).append((r["pack_offset"], r["pack_offset"] + r["n_tokens"]))
        else:
            assert r["pack_id"] is None and r["pack_offset"] is None
    assert max(fill.values()) <= 20
    for s in spans.values():
        s.sort()
        assert all(a[1] == b[0] for a, b in zip(s, s[1:])) and s[0][0] == 0
    long = sorted((r["piece_no"], r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == 101)
    assert [x[2] for x in long][:-1] == [20] * (len(long) - 1) and sum(x[2] for x in long) == len(encode(docs[-1][1]))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), capacity=20).count() == 0
