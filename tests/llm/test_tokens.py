"""Ids against the public library, round trips, and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import tokens as tk
from tallyforge.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TABLE = tk.load_merges(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def own(texts):
    ids, counts = tk.encode_texts([x if x is None else x.encode() for x in texts], TABLE)
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


HARD = ["don't  we'll 's \n's 'tis I'm  he'd've ''s !'s x'lly x'rest 'r", "aaaaaaa aaa  bbb\t\tc", "<|endoftext|> a", "", " ", "\n\n x", "a\xa0b　c  ´é", "𝒳𝒴 𝟙𝟚 🙂🙂 ½²", "\r\n\r\n  \tx", "'", "ends with ", "\x1c\x1d x\x85y", "'S 'LL", "\x00\x01"]


def test_against_the_library(library):
    assert own(HARD) == library(HARD)


@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"])), max_size=5))
@settings(max_examples=200, deadline=None)
def test_random_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH) if not hasattr(test_random_text, "t") else test_random_text.t
    test_random_text.t = t
    t.encode_special_tokens = True
    assert own(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equal_hashes_don_t_mix_words(monkeypatch, library):
    monkeypatch.setattr(tk.np, "unique", lambda v, return_index, return_inverse: (v[:1], np.array([0]), np.zeros(len(v), np.int64)))
    assert own(["one two three"]) == library(["one two three"])


def test_long_text_is_cut_where_words_begin(monkeypatch, library):
    monkeypatch.setattr(tk, "CHUNK", 64)
    texts = ["word " * 100, "  x  y" * 60, "x" * 1000, None, ""]
    assert own(texts) == library([t or "" for t in texts])


def test_table(spark, library):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (None, "c", None), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in tk.encode_corpus(df, "text", TABLE, ["doc_id"]).collect()), key=repr)
    assert got == sorted([(1, library(["a b"])[0]), (1, library(["a b"])[0]), (2, []), (3, []), (0, library(["c"])[0])], key=repr)
    assert tk.encode_corpus(df.limit(0), "text", TABLE, ["doc_id"]).count() == 0
