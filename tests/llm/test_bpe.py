import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushlake.llm.bpe import LATIN, Codec, Generations, codec, digests, encode_decode
from hushlake.llm.token_ids import TOKENIZER
from tests.llm.test_packing import TEXTS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@settings(deadline=None, max_examples=400)
@given(TEXTS)
def test_equals_the_public_library(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec(TOKENIZER).encode(text)
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert codec(TOKENIZER).decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


@settings(deadline=None, max_examples=300)
@given(TEXTS | st.text(st.characters(max_codepoint=0x17F), max_size=30))
def test_written_pieces_are_what_is_encoded_and_decoded(tokenizer, text):
    for piece in text.encode("utf-8", "ignore").split():
        encoded = tokenizer.encode(piece.decode(), add_special_tokens=False)
        decoded = tokenizer.decode(encoded.ids, skip_special_tokens=False)
        n, ids, strings = codec(TOKENIZER).written(piece)
        assert (n, ids, strings) == (len(encoded.ids), "".join(f"{i} " for i in encoded.ids).encode(), f"{decoded} ".encode() if n else b"")


def test_latin_letters_are_cut_as_by_the_library(tokenizer):
    own, odd = Codec(TOKENIZER), [chr(c) for c in range(0x20, 0x180)]
    own._library = None  # not asked for these
    for letter in filter(LATIN.fullmatch, odd):
        for text in (f"a{letter}a", f"{letter}{letter} {letter}", f"l'{letter}'s 1{letter},", f"!{letter}!'{letter}"):
            assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_is_merged_once_whatever_stands_beside_it(monkeypatch):
    merged, merge = [], Codec._merge
    monkeypatch.setattr(Codec, "_merge", lambda self, word: merged.append(word) or merge(self, word))
    own = Codec(TOKENIZER)
    for piece in (b"stra\xc3\x9fe", b"stra\xc3\x9fe,", b"(stra\xc3\x9fe", b"Stra\xc3\x9fe,stra\xc3\x9fe", b"word", b"word,", b"word(word"):
        own.written(piece)
    assert sorted(merged) == sorted({*merged}) == [b"(", b",", b"stra\xc3\x9fe", b"word"]


def test_long_words(tokenizer):
    for word in ("ab" * 5000, "x" * 3000, "antidisestablishmentarianism" * 40):
        assert codec(TOKENIZER).encode(word) == tokenizer.encode(word, add_special_tokens=False).ids


def test_odd_documents(tokenizer, monkeypatch, odd_documents, odd_rows, no_documents):
    def want(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        shown, read = " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (shown, read))

    expected = sorted((str(i), *want(t)) for i, t, *_ in odd_rows)
    assert sorted((str(r[0]), *r[1:]) for r in digests(odd_documents).collect()) == expected
    full = encode_decode(odd_documents).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((str(r.doc_id), len(r.ids), digest(" ".join(map(str, r.ids))), digest(r.decoded)) for r in full) == expected
    assert digests(no_documents).count() == encode_decode(no_documents).count() == 0


def test_generations_keep_what_is_asked_for():
    held = Generations(3)
    for n in range(20):
        held.put(n, (n,))
        assert held.get(0) == (0,)  # asked for again and again
        assert held.get(n) == (n,)
    assert held.get(1) is None and len(held._new) + len(held._old) <= 6
