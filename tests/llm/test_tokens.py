"""The quick encoders give the ids of the tokenizers library."""

from __future__ import annotations

import functools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm.tokens import MemoEncoder, encoder, public_path

_library = functools.cache(lambda path: MemoEncoder(path).whole)
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "a\n\n b  c\t", "Hé's IT'S <|endoftext|> x", "x\x1cy\x85z\xa0 w", "ΑΣ İı ſ", "¼²³ ½a ª", "éa", "漢字 kana", "don't 'll  ", "\x0b\x0c  \r\n x", "a\x00b\x00 c", "\x7f\x80\x9f\xad", "  'tis  ' s", "a" * 500, "The&&& THE*** 12 345", "''s 's'r'e've 'l'll 'dd -'s x'", "'", "''", "5's '5 a'5'm", "I'VE we'Re", "'re'", "r'e"]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    path = public_path(name)
    whole = _library(path)
    for text, ids in zip(ODD, encoder(path).encode(ODD), strict=True):
        assert np.array_equal(ids, whole(text)), text
    assert len(encoder(path).encode([None])[0]) == 0


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x180), max_size=60), max_size=5))
def test_any_latin_text(name, texts):
    path = public_path(name)
    whole = _library(path)
    assert all(np.array_equal(a, whole(t)) for a, t in zip(encoder(path).encode(texts), texts, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("'srtvemld A1.- \n\xa0é", max_size=25), max_size=4))
def test_apostrophes_and_suffixes(texts):
    path = public_path("word_bpe_49k.json")
    whole = _library(path)
    assert all(np.array_equal(a, whole(t)) for a, t in zip(encoder(path).encode(texts), texts, strict=True))


def test_a_small_memo_forgets_and_goes_on():
    path = public_path("word_bpe_49k.json")
    small = MemoEncoder(path, 10)
    texts = [f"word{i} other{i * 7} the" for i in range(50)]
    assert all(np.array_equal(small.encode_one(t), small.whole(t)) for t in texts)
