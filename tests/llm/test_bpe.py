"""Ids against a public library, round trips, and constant memory."""

import base64
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import bpe
from chronoloom.llm.corpus_ids import encode_corpus
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def ours():
    return bpe.encoder()


@pytest.fixture(scope="module")
def theirs():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=300), st.text("ab' \n\t\r.s1'ré日<|endoftext|>", max_size=300)))
def test_same_ids_and_round_trip(ours, theirs, text):
    ids = ours.encode(text)
    assert ids.tolist() == theirs.encode_ordinary(text)
    assert bpe.Decoder(ours.vocabulary).feed(ids, True) == text


@pytest.mark.parametrize("alphabet", ["ab", "aeiourst", "0123456789", " \n", "é日a", "!?-", "x"])
@pytest.mark.parametrize("n", [65, 1000, 20_000])
def test_long_words(ours, theirs, alphabet, n):
    rng = random.Random(n)
    text = "".join(rng.choice(alphabet) for _ in range(n))
    assert ours.encode(text).tolist() == theirs.encode_ordinary(text)


PIECES = ["don't  stop -- we'll   see\n\n  what 'll' it's 12345 \r\n" * 40, "a" * 300 + " " * 200 + "b" * 100 + "1" * 90 + "!" * 80 + " \n" * 50, " " * 100, "x " + "日" * 200 + "\u00a0" * 60 + "'s", "'" * 70 + "re" * 60, "\t" * 90 + "end"]


@pytest.mark.parametrize("text", PIECES)
@pytest.mark.parametrize("size", [1, 2, 7, 16, 100])
@pytest.mark.parametrize("limit", [4, 20, 1_000])
def test_pieces_do_not_show(ours, theirs, monkeypatch, text, size, limit):
    """However a text comes, and wherever its words are opened, its ids are the same."""
    monkeypatch.setattr(bpe, "OPEN", limit)
    pieces = [text[k : k + size] for k in range(0, len(text), size)]
    got = np.frombuffer(b"".join(ours.stream(pieces)), "<i4")
    assert got.tolist() == theirs.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text("ab' \n\t1é日\x1c\x85.", max_size=200), size=st.integers(1, 9), limit=st.integers(3, 30))
def test_any_pieces(ours, theirs, text, size, limit):
    kept, bpe.OPEN = bpe.OPEN, limit
    try:
        got = np.frombuffer(b"".join(ours.stream(text[k : k + size] for k in range(0, len(text), size))), "<i4")
    finally:
        bpe.OPEN = kept
    assert got.tolist() == theirs.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["ab", "aeiourst", "=-", " ", "日本", "0123456789"])
def test_lookahead_suffices(ours, theirs, alphabet):
    """What left the transducer is a prefix of the ids of every continuation, and nothing later reaches back further."""
    v = ours.vocabulary
    rng = random.Random(7)
    for n in (50, 400, 1_500):
        word = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        t = bpe.Transducer(v)
        out = []
        for k in range(0, len(word), 10):
            out += t.feed(word[k : k + 10])
            assert len(t.kept) <= 3 * v.lookahead
            done = len(b"".join(out))
            for more in (b"", alphabet.encode() * 60, b"".join(rng.choice(alphabet).encode() for _ in range(100))):
                whole = bpe.Transducer(v)
                tokens = whole.feed(word[: k + 10] + more) + whole.finish()
                assert tokens[: len(out)] == out
        assert done <= len(word)
        text = word.decode()
        if alphabet != " ":
            assert [v.ranks[x] for x in out + t.finish()] == theirs.encode_ordinary(text)


def test_the_longest_token_bounds_the_lookahead(ours):
    v = ours.vocabulary
    assert v.lookahead == max(len(t) for t in v.ranks if v.merge(t) == [t]) and set(v.made) == {t for t in v.ranks if len(t) < 4 and v.merge(t) == [t]} | {t for t in v.made if len(t) >= 4}


def test_constant_memory(ours):
    """Ids leave as the text comes, in words of usual and of any length, and what is held doesn't grow."""
    import tracemalloc

    for unit in ("the quick brown fox, 12 times. ", "internationalization"):
        held = []
        for n in (20, 200):
            for _ in ours.stream(unit for _ in range(100)):  # fills the tables
                pass
            tracemalloc.start()
            count = sum(len(x) for x in ours.stream(unit * 100 for _ in range(n)))
            held.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert count // 4 == len(ours.encode(unit * (100 * n)))
        assert held[1] < 1.5 * held[0] + 200_000


def test_every_token_comes_from_the_transducer(theirs, monkeypatch):
    """The table holds nothing that didn't go through it: without the transducer there is no id."""
    made = []
    finish, feed = bpe.Transducer.finish, bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "finish", lambda self: made.append(finish(self)) or made[-1])
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, data: made.append(feed(self, data)) or made[-1])
    fresh = bpe.Encoder(bpe.encoder().vocabulary)
    docs = ["one two three", "x" * 5_000, "naïve 日本語"]
    ids = {i for d in docs for i in fresh.encode(d).tolist()}
    assert ids == {fresh.vocabulary.ranks[t] for tokens in made for t in tokens}


def test_incremental_decoding(ours):
    text = "naïve 日本語 ∮ text"
    d = bpe.Decoder(ours.vocabulary)
    assert "".join(d.feed([i]) for i in ours.encode(text)) + d.feed([], True) == text


def test_corpus(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "c", "x"), (4, "y" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, len(r.ids)) for r in encode_corpus(df).collect()), key=repr)
    assert got == sorted([(1, 2), (2, 0), (3, 0), (3, 0), (None, 1), (4, len(bpe.encoder().encode("y" * 300_000)))], key=repr)
    assert encode_corpus(df.limit(0)).count() == 0


def test_whole_table(spark, theirs):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = {r.doc_id: theirs.encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in encode_corpus(docs).collect()} == want
    assert np.sum([len(v) for v in want.values()]) > 10_000
