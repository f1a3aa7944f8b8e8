import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokenize as T


@pytest.fixture(scope="module")
def pieces():
    with open(T.VOCABULARY, "rb") as f:
        return T.PieceEncoder.from_bytes(f.read())


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def split(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_ranks_are_read(pieces):
    assert T.PieceEncoder.from_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)) + b"\n").ranks[b"!"] == 33
    assert len(pieces.ranks) == 50_256


def test_pieces_of_all_lengths_equal_the_plain_algorithm(pieces):
    rng = random.Random(1)
    whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=pieces.ranks, special_tokens={})
    texts = ["".join(rng.choice("aeth ilns1é你x=_-\n") for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 17, 33, 64, 400]))) for _ in range(800)]
    want = [whole.encode_ordinary(t) for t in texts]
    assert pieces.many([t.encode() for t in texts]) == want
    assert [pieces.one(t.encode()) for t in texts] == want
    assert pieces.one(b"") == [] and pieces.many([]) == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sStreve1½x_  ́‍\x1c\x1f")), max_size=40))
def test_texts_equal_the_public_tokenizer(pieces, public, text):
    assert split(T.TextEncoder(pieces), [text]) == [public(text)]


def test_texts_of_a_batch(pieces, public):
    encoder = T.TextEncoder(pieces)
    texts = [None, "", "a", None, "<|endoftext|>", "it's  \n\n x", "é" * 50, "  "]
    for _ in range(2):
        assert split(encoder, texts) == [public(t or "") for t in texts]
    assert split(encoder, []) == [] and split(encoder, [None]) == [[]]


def test_what_is_remembered_changes_nothing(pieces, public, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    encoder = T.TextEncoder(pieces)
    for text in ("one two three four five six seven", "alpha beta gamma", "one two three", "x y z " * 9):
        assert split(encoder, [text, text]) == [public(text)] * 2


def test_a_very_long_piece(pieces):
    data = b"abcx1" * 40_000
    tokens = {r: t for t, r in pieces.ranks.items()}
    assert b"".join(tokens[i] for i in pieces.one(data)) == data


def test_frames(spark, public, monkeypatch):
    monkeypatch.setattr(T, "AT_ONCE", 10)
    rows = [(1, "hello world", 3), (1, "hello world", 3), (2, None, 4), (3, "", 5), (None, "Grüße\r\n", 6), (4, "long " * 20_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in T.encode(df, "doc_id").collect()), key=repr)
    assert got == sorted(((k, public(t or "")) for k, t, _ in rows), key=repr)
    assert T.encode(df.limit(0), "doc_id").collect() == []
    with open(T.VOCABULARY, "rb") as f:
        ranks = T.PieceEncoder.from_bytes(f.read()).ranks
    assert T.decode(public("Grüße\r\n 你"), ranks) == "Grüße\r\n 你"
