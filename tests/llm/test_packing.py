from __future__ import annotations

import zlib

import numpy as np
import pytest

from tallybook.llm import packing
from tallybook.llm.queries import vocabulary


@pytest.fixture(scope="module")
def file():
    pytest.importorskip("public_tokenizers")
    return vocabulary("byte_bpe_50k.json")


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("size, windows", [(1024, 64), (16, 2), (7, 1)])
def test_every_id_lies_in_one_piece_and_sequences_are_full(documents, nasty, file, size, windows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    rows = packing.pack(documents, file, size, windows).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    wanted: dict = {}
    for doc_id, text in nasty:
        found = ids(tokenizer, text)
        wanted.setdefault((doc_id, len(found)), []).append(found)
    assert pieces.keys() == wanted.keys()
    for key, own in pieces.items():
        assert sum(r.length for r in own) == key[1] * len(wanted[key])
        for r in own:
            sums = {zlib.crc32(w[r.start : r.start + r.length].tobytes()) for w in wanted[key]}
            assert r.ids_crc32 in sums and r.length > 0
    fills = []
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(r.length for r in own[:n]) for n in range(len(own))]
        fills.append(sum(r.length for r in own))
    assert max(fills) <= size and sum(f < size for f in fills) <= 1


def test_merging_level_by_level(documents, nasty, file, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = packing.pack(documents.repartition(9), file).collect()
    fills: dict = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert sum(f < 1024 for f in fills.values()) <= 1
    assert len({r.doc_id for r in rows}) == len({i for i, _ in nasty})


def test_each_level_merges_fan_in_tasks(documents, file, monkeypatch):
    """9, 5, 3, 2 tasks are left: four levels, and the last sequence is numbered after them."""
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = packing.pack(documents.repartition(9), file).collect()
    assert max(r.sequence_id for r in rows) >> 56 == 5


def test_best_fit_and_the_fullest_window():
    packer = packing.Packer(0, size=10, open_windows=2)
    one = np.zeros(1, "<u4").tobytes()
    packer.add(1, 0, one * 6, 6)
    packer.add(2, 0, one * 7, 7)
    packer.add(3, 0, one * 3, 3)  # fits the second exactly
    assert [(r[0], r[2]) for r in packer.flush()] == [(2, 7), (3, 3)]
    packer.add(4, 0, one * 9, 9)
    packer.add(5, 0, one * 5, 5)  # fits none: tops up the fullest, the rest goes on
    assert [(r[0], r[2]) for r in packer.flush()] == [(4, 9), (5, 1), (1, 6), (5, 4)]


def test_plain_texts_get_the_ids_of_the_library(file):
    from tokenizers import Tokenizer

    find, tokenizer = packing.ids_of(file), Tokenizer.from_file(file)
    for text in ["", " ", "a  b\n\n c", "don't we'll 12 3.5", "é è ñ ß", "x<|endoftext|>y", "中文 \U0001f600", "\x00\x1c\x85 q"]:
        expected = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert find(text) == expected


def test_empty_and_clashing(empty, clashing, file):
    assert packing.pack(empty, file).count() == 0
    assert {r.doc_id for r in packing.pack(clashing, file).collect()} == set(range(6))


def test_a_file_that_splits_otherwise_goes_to_the_library(file, tmp_path):
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    given = json.loads(Path(file).read_text())
    assert packing.splits_alike(given)
    other = given | {"pre_tokenizer": given["pre_tokenizer"] | {"add_prefix_space": True}}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    assert not packing.splits_alike(other)
    found = np.frombuffer(packing.Ids(str(path))("plain words"), "<u4").tolist()
    assert found == Tokenizer.from_file(str(path)).encode("plain words", add_special_tokens=False).ids
    swapped = given["model"] | {"merges": given["model"]["merges"][:2][::-1]}
    assert not packing.splits_alike(given | {"model": swapped})
