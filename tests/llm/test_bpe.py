import hashlib
import struct
import sys
import unicodedata

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorescape.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize(
    "text",
    ["", "Hello, world's 42 don't", "x<|endoftext|>Y <|startoftext|>", "ΑΣ ΣΑΣ İ", "a" * 3000, "\x1c a\x1fb　c", "é é", "<|x", "🦜🦜 ¡hola!", "0" * 500],
)
def test_equals_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    ours = bpe.load(PATH).encode(text)
    assert ours == packed(ids)
    assert bpe.load(PATH).decode(ours).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_equals_library_on_any_text(text):
    t = Tokenizer.from_file(PATH)
    assert bpe.load(PATH).encode(text) == packed(t.encode(text, add_special_tokens=False).ids)


def test_equals_library_on_all_letters_that_python_does_not_know(library):
    """And on every 40th of all other code points, each between letters, a number and a mark."""
    unknown = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and regex.match(r"[\p{L}\p{N}]", chr(c))]
    ours = bpe.load(PATH)
    assert len(unknown) > 1000
    for c in {*unknown, *range(0, 0xD800, 40), *range(0xE000, sys.maxunicode, 400)}:
        text = f"ab{chr(c)}{chr(c)}c1{chr(c)}!"
        assert ours.encode(text) == packed(library.encode(text, add_special_tokens=False).ids), hex(c)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    fresh = bpe.WordBpe(PATH)
    assert fresh.encode("one two three one two three") == bpe.load(PATH).encode("one two three one two three")


def test_odd_documents(library, odd_docs, odd_texts, no_docs):
    rows = bpe.encode_documents(odd_docs, PATH).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        ids = library.encode(odd_texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_ids_and_back(spark, odd_docs):
    ids = bpe.token_ids(odd_docs, PATH)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_ids(ids, PATH).collect()}
    assert texts[4] == "" and texts[6] == "x</w>"
