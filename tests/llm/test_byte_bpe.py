import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import byte_bpe
from tabloom.llm.byte_bpe import Codec, decode_ids, digests, encode, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab' ", max_size=60), st.text("aeé\n", max_size=30)), max_size=8))
def test_any_texts_encode_as_the_library_does_and_decode_back(texts):
    c, p = Codec(read_ranks(PATH), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    for text, parts in zip(texts, c.encode_all(texts), strict=True):
        ids = sum(parts, [])
        assert ids == p.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_long_texts_in_parts_and_blocks(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 40)
    monkeypatch.setattr(byte_bpe, "RUN", 3)
    c = Codec(read_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["", "one two", "three four five six seven eight nine ten eleven", None, "ten " * 30, "twelve"]
    assert [sum(parts, []) for parts in c.encode_all(texts, 8)] == [plain.encode_ordinary(t or "") for t in texts]
    for text in texts:
        n, ids, decoded = byte_bpe._digest(c, next(c.encode_all([text])))
        want = plain.encode_ordinary(text or "")
        assert (n, ids, decoded) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_digests_decode_the_ids_of_each_document(codec):
    """With a token's bytes replaced, what is decoded changes though the texts don't."""
    other = Codec.__new__(Codec)
    other.__setstate__(codec.__getstate__())
    ids = sum(next(other.encode_all([" the end"])), [])
    other.tokens = list(other.tokens)
    other.tokens[ids[0]] = b"?"
    assert byte_bpe._digest(other, iter([ids]))[2] == hashlib.sha256(b"? end").hexdigest()


def test_one_by_one_and_all_at_once_agree(codec, plain, monkeypatch):
    words = ["a" * 501, "abab" * 50, "antidisestablishmentarianism", "<|endoftext|>", "zzzz", "überraschung", " the", "\n\n"]
    want = [plain.encode_ordinary(w) for w in words]
    for few in (0, 10**9):
        monkeypatch.setattr(byte_bpe, "FEW", few)
        assert [sum((codec.replay([m.encode()])[0] for m in codec.split(w)), []) for w in words] == want
    assert [codec.merge_alone(w.encode()) for w in words] == codec.replay([w.encode() for w in words])


def test_generations_of_remembered_words(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    c = Codec(read_ranks(PATH), public_tokenizers.PATTERN)
    for text in ["one two three four", "two five", "six seven eight nine", "one two"] * 2:
        assert sum(next(c.encode_all([text])), []) == plain.encode_ordinary(text)


def check(docs, plain):
    want = {}
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        want.setdefault(r.doc_id, set()).add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = digests(docs).collect()
    assert len(got) == docs.count()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] for r in got)


def test_tables(documents, awkward, nothing, plain):
    check(documents, plain)
    check(awkward, plain)
    assert digests(nothing).collect() == []


def test_ids_and_texts(awkward):
    out = decode_ids(encode(awkward, PATH, public_tokenizers.PATTERN, ["doc_id", "row"]).withColumnRenamed("decoded", "first"), PATH)
    assert all(r.first == r.decoded and r.row == "c" for r in out.collect())
