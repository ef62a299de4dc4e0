from __future__ import annotations

import hashlib
import random

import pytest

from tallybook.llm import piece_bpe
from tallybook.llm.queries import vocabulary


@pytest.fixture(scope="module")
def file():
    pytest.importorskip("public_tokenizers")
    return vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(file):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=file)


def test_ids_and_texts_are_those_of_the_library(documents, nasty, file, library):
    found = piece_bpe.encoded(documents, file).collect()
    assert len(found) == len(nasty)
    expected = []
    for doc_id, text in nasty:
        ids = library.encode(text or "") + [2]
        joined, decoded = " ".join(map(str, ids)), library.decode(ids)
        expected.append((doc_id, len(ids), joined, decoded, hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded, r.decoded_sha256) for r in found), key=key) == sorted(
        expected, key=key
    )


def test_random_strings(file, library):
    model = piece_bpe.encoder(file).model
    draw = random.Random(8)
    letters = ["a", "b", "aa", "th", "the", " ", "  ", "\n", "é", "ß", "1", "▁", ".", "中", "\t", "\U0001f600", "ing", "x" * 9]
    for _ in range(600):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_decoding_any_ids(file, library):
    model = piece_bpe.encoder(file).model
    draw = random.Random(2)
    for _ in range(200):
        ids = [draw.randrange(3, 32000) for _ in range(draw.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_the_table_agrees_with_merging(file):
    model = piece_bpe.encoder(file).model
    for text in ["▁international", "▁▁▁▁▁spaces", "aaaaaaaaaaaaaaaaaaaaaaa", "thethethe", "▁electroencephalography"]:
        assert [model._entries[n] for n in model._split(text)] == model.merge(text)


def test_empty_and_clashing(empty, clashing, file):
    assert piece_bpe.encoded(empty, file).count() == 0
    assert piece_bpe.encoded(clashing, file, texts=False).count() == 6
