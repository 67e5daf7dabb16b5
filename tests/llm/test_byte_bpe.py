"""Byte-level BPE against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.llm.byte_bpe import BytePairCoder, Prefixes, encode_and_decode
from textwarden.llm.queries import QUERIES

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CODER = BytePairCoder(FILE, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})
#: The last three are letters only in some versions of Unicode.
ALPHABET = [*"aaabt  \n\n\t\r're'stll'19.,é中🙂", "　", "\x1c", "\x85", "𲺧", "𝽧", "𘶧"]


def _ids(text):
    return np.frombuffer(next(CODER.encode([text])), dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60))
def test_encoding_matches_library(text):
    assert _ids(text) == LIBRARY.encode_ordinary(text)
    assert CODER.decode(_ids(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_encoding_of_any_text_matches_library(text):
    assert _ids(text) == LIBRARY.encode_ordinary(text)


def test_every_prefix_ends_in_the_last_token_of_its_encoding():
    draw = random.Random(3)
    tokens = list(CODER.ranks)
    for _ in range(300):
        data = b"".join(draw.choice(tokens) for _ in range(4))
        table = CODER.extend(data, [])
        for end in range(1, len(data) + 1):
            assert table[end] == LIBRARY._encode_single_piece(data[:end])[-1]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_appends_and_edits_match_encoding_anew(data):
    prefixes = Prefixes(CODER, data.draw(st.text(st.sampled_from(ALPHABET), max_size=60)))
    for _ in range(5):
        start = data.draw(st.integers(0, len(prefixes.text)))
        stop = data.draw(st.integers(start, min(len(prefixes.text), start + 5)))
        new = data.draw(st.text(st.sampled_from(ALPHABET), max_size=6))
        expected = prefixes.text[:start] + new + prefixes.text[stop:]
        prefixes.replace(start, stop, new)
        assert prefixes.text == expected and prefixes.ids() == LIBRARY.encode_ordinary(expected)
        prefixes.append(new)
        assert prefixes.ids() == LIBRARY.encode_ordinary(expected + new)


def test_an_edit_in_a_long_word_stops_where_tokens_are_as_before(monkeypatch):
    draw = random.Random(4)
    prefixes = Prefixes(CODER, "".join(draw.choice("abcdefgh") for _ in range(50_000)))
    asked = []
    follows = CODER.follows
    monkeypatch.setattr(CODER, "follows", lambda a, b: asked.append(a) or follows(a, b))
    prefixes.replace(25_000, 25_002, "xyz")
    assert len(asked) < 1000
    prefixes.append("abc")
    assert len(asked) < 2000
    assert prefixes.ids() == LIBRARY.encode_ordinary(prefixes.text)


def test_tokens_that_merging_never_makes(tmp_path):
    """A whole word that equals such a token has its id; inside other words it is never used."""
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"bcd": 259, b"abcd": 260, b"xyz": 261}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    code = BytePairCoder(str(path), PATTERN)
    library = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert code.odd == {b"xyz": 261}
    draw = random.Random(5)
    for _ in range(2000):
        word = bytes(draw.choice(b"abcdxyz") for _ in range(draw.randrange(1, 9)))
        assert code.encode_word(word) == library._encode_single_piece(word)


def test_small_table_starts_anew():
    code = BytePairCoder(FILE, PATTERN, table_size=5)
    texts = ["one two three four five six seven", "eight nine ten", "one two"] * 3
    assert [np.frombuffer(r, dtype="<u4").tolist() for r in code.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def _expected(doc_id, text):
    ids = LIBRARY.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op12_byte_bpe"](spark, sf_dir).collect())
    assert got == sorted(_expected(*d) for d in docs)


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "<|endoftext|> \u0000 x"), (3, "other"), (4, "same"), (4, "same"), (5, "a" * 100_000 + " b" * 100_000)]
    docs = spark.createDataFrame([(i, t, 1, "own") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = encode_and_decode(docs, FILE, PATTERN, keep_ids=True)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == sorted((_expected(*r) for r in rows), key=repr)
    for r in got.collect():
        assert CODER.decode(r["ids"]) == bytes(r["decoded"])
    assert encode_and_decode(docs.limit(0), FILE, PATTERN).collect() == []
