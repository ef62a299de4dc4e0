"""Encoding and decoding with a sentencepiece BPE model by a table over prefixes.

A sequence of pieces is the model's encoding exactly if each piece is the encoding of its
own characters and each two neighbours are the encoding of theirs: merges never cross the
border of a final piece, so a border inside the pair would have been crossed in the whole
as well. Hence every prefix has one encoding and one last piece. An automaton over the
pieces gives, for each position, the pieces that end there; the one that is compatible with
the last piece of the prefix before it is entered in the table. Reading the table from the
end backwards gives the pieces. The work grows with the text, not with its square.

No piece holds a space mark after another character, so a run of marks and the
characters up to the next is encoded on its own and remembered; characters that no piece holds
separate as well. A model without that property is encoded whole.

A missing text is empty and has the end id alone. Repeated rows are encoded each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm.common import identified, small

MARK = "▁"
#: Entries of each memory of a task; a full one starts anew.
REMEMBERED = 300_000


class PieceModel:
    """What is needed of a model file, read by the sentencepiece library."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.end = model.eos_id()
        self.unknown = model.unk_id()
        numbers = range(model.vocab_size())
        self.pieces = [model.id_to_piece(number) for number in numbers]
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for number in numbers:
            piece = self.pieces[number]
            if model.is_byte(number):
                self.bytes[int(piece[3:-1], 16)] = number
            elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
                self.ids[piece] = number
                self.scores[piece] = model.get_score(number)
        self._surface = {number: piece.encode() for piece, number in self.ids.items()}
        self._surface |= {number: bytes([value]) for value, number in self.bytes.items()}
        # The table holds places in this list: pieces, and characters that are none.
        characters = set().union(*self.ids)
        self._entries = [*self.ids, *sorted(characters - self.ids.keys())]
        self._entry_ids = [self._ids_of(entry) for entry in self._entries]
        automaton = ahocorasick.Automaton()
        for place, entry in enumerate(self._entries):
            if self.merge(entry) == [entry]:  # others are never the end of a prefix
                automaton.add_word(entry, (len(entry), place))
        automaton.make_automaton()
        self._ending = automaton.iter
        self._pairs: dict[int, bool] = {}
        known = "".join(re.escape(c) for c in sorted(characters - {MARK}))
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            self._cut = re.compile(f"[{known}{MARK}]+|[^{known}{MARK}]")
        else:
            self._cut = re.compile(f"{MARK}*[{known}]+|{MARK}+|[^{known}{MARK}]")

    def _ids_of(self, piece: str) -> list[int]:
        if (number := self.ids.get(piece)) is not None:
            return [number]
        return [self.bytes.get(byte, self.unknown) for byte in piece.encode()]

    def merge(self, text: str) -> list[str]:
        """The model's merges, one by one: the best score first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for place in range(len(parts) - 1):
                score = self.scores.get(parts[place] + parts[place + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, place
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        """Whether the merges of two entries' characters stop at the border between them."""
        if len(self._pairs) > 2 * REMEMBERED:
            self._pairs.clear()
        left, right = (self._entries[place] for place in divmod(pair, len(self._entries)))
        found = self._pairs[pair] = self.merge(left + right) == [left, right]
        return found

    def _split(self, text: str) -> list[int]:
        """Entries of a text of known characters, spaces as marks."""
        count, pairs, compatible = len(self._entries), self._pairs, self._compatible
        last = [-1] * (len(text) + 1)  # the last entry of each prefix
        lengths = [0] * (len(text) + 1)
        for end, (length, place) in self._ending(text):
            end += 1
            if lengths[end]:
                continue
            if start := end - length:
                if (before := last[start]) < 0:
                    continue
                pair = before * count + place
                found = pairs.get(pair)
                if not (compatible(pair) if found is None else found):
                    continue
            last[end] = place
            lengths[end] = length
        entries, end = [], len(text)
        while end:
            entries.append(last[end])
            end -= lengths[end]
        return entries[::-1]

    def cut(self, text: str) -> list[str]:
        """Parts of a text that are encoded on their own, spaces as marks, one mark in front."""
        return self._cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_part(self, part: str) -> list[int]:
        if len(part) == 1:
            return self._ids_of(part)
        return [number for entry in self._split(part) for number in self._entry_ids[entry]]

    def encode(self, text: str) -> list[int]:
        """All ids of a text, without an end id."""
        return [number for part in self.cut(text) for number in self.encode_part(part)]

    def surface(self, ids: list[int]) -> bytes:
        """What the ids stand for, with marks as they are; control ids stand for nothing."""
        return b"".join(self._surface.get(number, b"") for number in ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks as spaces, without the one put in front."""
        return self.readable(self.surface(ids))

    @staticmethod
    def readable(surface: bytes) -> str:
        text = surface.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """A model and the parts met before: number of ids, ids as text, what they stand for.

    Parts are remembered in two generations, so those met often outlast those met once.
    """

    def __init__(self, model_file: str) -> None:
        self.model = PieceModel(model_file)
        self._young: dict[str, tuple[int, str, bytes]] = {}
        self._old: dict[str, tuple[int, str, bytes]] = {}

    def _part(self, part: str) -> tuple[int, str, bytes]:
        if (found := self._old.get(part)) is None:
            ids = self.model.encode_part(part)
            found = len(ids), " ".join(map(str, ids)), self.model.surface(ids)
        if len(part) < 100:
            if len(self._young) >= REMEMBERED:
                self._young, self._old = {}, self._young
            self._young[part] = found
        return found

    def __call__(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, the ids as text, the decoded text."""
        new = self._part
        found = [self._young.get(part) or new(part) for part in self.model.cut(text)]
        counts, ids, surfaces = zip(*found) if found else ((), (), ())
        return (
            sum(counts) + 1,
            " ".join((*ids, str(self.model.end))),
            self.model.readable(b"".join(surfaces)),
        )


@lru_cache(maxsize=1)
def encoder(model_file: str) -> Encoder:
    """One per Python worker, which outlives its tasks."""
    return Encoder(model_file)


FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.string()),
        ("decoded", pa.string()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
)


def encoded(documents: DataFrame, model_file: str, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text, and SHA-256 of both.

    ``texts=False`` leaves ids and decoded text out. ``model_file`` is a path that every
    executor has.
    """
    names = [name for name in FIELDS.names if texts or name not in ("ids", "decoded")]
    fields = pa.schema([FIELDS.field(name) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_file)
        for batch in small(batches):
            rows: dict[str, list] = {name: [] for name in FIELDS.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count, ids, decoded = encode(text)
                rows["doc_id"].append(doc_id)
                rows["n_tokens"].append(count)
                rows["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if texts:
                    rows["ids"].append(ids)
                    rows["decoded"].append(decoded)
            yield pa.RecordBatch.from_pydict({name: rows[name] for name in names}, schema=fields)

    schema = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in fields)
    return identified(documents).select("doc_id", "text").mapInArrow(run, schema)
