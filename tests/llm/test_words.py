"""Words, hashes and token ids against plain Python."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sunloom.llm.queries import vocabulary
from sunloom.llm.words import Tokens, batches, hash_words, split_words

TEXTS = ["  a b\tc\n d  ", "", None, "x\x0by\x1cz é  q", "end", "next one", " ", "a", "a b", "ß ẞ 漢字 \U0001f600"]


def expected(texts):
    return [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@pytest.mark.parametrize("column", [pa.array(TEXTS), pa.array(TEXTS).slice(3, 4), pa.array([""]), pa.array([], pa.string()), pa.array([None, None], pa.string())])
def test_words_and_hashes(column):
    want = expected(column.to_pylist())
    split, hashed = split_words(column), hash_words(column)
    words = [split.distinct[int(c)].as_py() for c in split.codes]
    assert words == [w for ws in want for w in ws]
    assert split.counts.tolist() == hashed.counts.tolist() == [len(ws) for ws in want]
    assert [bytes(hashed.raw[a:b]).decode() for a, b in zip(hashed.first, hashed.last, strict=True)] == words
    assert len(set(zip(words, hashed.hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashed.hashes.tolist()))


def test_batches_keep_all_rows():
    column = pa.array(["x" * n for n in (1, 5_000, 3, 20_000, 0, 7)])
    batch = pa.RecordBatch.from_arrays([column], names=["t"])
    parts = list(batches(iter([batch]), rows=4, size=6_000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == column.to_pylist()
    assert max(len(p) for p in parts) <= 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB'sté́.,!1 \n İΣ<|漢", max_size=25), max_size=6))
def test_token_ids_are_those_of_the_tokenizer(texts):
    model = Tokens(vocabulary(), remember=40)
    texts = [*texts, "it's <|endoftext|> Fine", "A <|STARTOFTEXT|> b"]
    ids, bounds = model.encode(pa.array(texts, pa.string()), 1)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*model.model.encode(t, add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB'sté́.,!~^1\x01 \n\x0b\x1c İΣ<>漢“", max_size=25), max_size=6))
def test_token_ids_where_punctuation_is_set_apart(texts):
    model = Tokens(vocabulary(), remember=40)
    texts = [*texts, "it's, 'so'. a!", "! b?", ".", "3.\t≮ x", "", "q\x01. \x01 r,"]
    ids, bounds = model.encode(pa.array(texts, pa.string()), 1)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*model.model.encode(t, add_special_tokens=False).ids, 1]


def test_words_before_punctuation_are_encoded_once_and_many_together():
    model = Tokens(vocabulary())
    sizes, ids = [], model._ids
    model._ids = lambda texts: sizes.append(len(texts)) or ids(texts)
    words = [f"w{i}" for i in range(50)]
    model.encode(pa.array([" ".join(f"{w} {w}, {w}. ({w}" for w in words)]), 1)
    assert len(model.known) == 2 * 50 + 2  # before: four chunks a word
    assert sizes == [1]  # before: as many texts as chunks
