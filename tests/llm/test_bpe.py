from __future__ import annotations

import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiquarry.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    with open(path, "rb") as f:
        return bpe.Vocabulary(f.read()), Tokenizer.from_file(path)


def same(both, text):
    own, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    got = own.encode([text])[0]
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want, text
    assert own.decode(got) == theirs.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a" * 3000, "aaa aa a aaaa", "Hello, WORLD! it's we'll", "ΣΑΣ Σ", "x<|endoftext|>y<|ENDOFTEXT|> <|startoftext|>", "日本語 🎉🎉", "é Å Å", "tab\tnew\nline\x0b\x1c\x85 end", "12345 ５６", "\0\0<|endoftext|>", "......!!!???"])
def test_fixed_texts(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, text.encode("utf-8", "ignore").decode())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB '.<|>the1\n", max_size=60))
def test_few_letters(both, text):
    same(both, text)


def test_kept_words_are_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    own, theirs = both
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    got = [x for t in texts for x in own.encode([t])]
    assert [len(x) // 4 for x in got] == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert len(own.found) <= 50


def test_query(spark, docs, both):
    rows = [(1, "Some text, here."), (2, None), (3, "")]
    got = {r.doc_id: r for r in bpe.digests(bpe.round_trip(docs(rows).select("doc_id", "text"), bpe.default_vocabulary())).collect()}
    for i, text in rows:
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
