"""Sequences of a fixed size by bounded-space online packing.

Each task reads its documents in order and keeps OPEN windows open. Whole windows of a long
document are emitted as they come. What remains goes, uncut, to the open window it fits
best. When none fits, the fullest one is topped up with the head of the piece and emitted.
What is still open at the end of a task is merged with that of other tasks, FAN_IN at a
time, level by level; merging runs the pieces together and cuts where a sequence is full,
so at most one sequence of the whole table is not.

Memory of a task is OPEN windows and one batch; a merge holds FAN_IN * OPEN windows.

The ids of a document are those of its text and one end id. A missing text is empty and
has the end id alone. Repeated rows are packed each. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import identified, written

SIZE = 1024
END = 0
OPEN = 64
FAN_IN = 64
#: Fixed value: how a byte-level vocabulary of this kind splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters alone are split alike by every version of Unicode.
_PLAIN = re.compile("[\x00-\u024f\u2010-\u2027]*")

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)
ARROW = pa.schema(
    [
        *((name, pa.int64()) for name in (
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
        )),
        ("ids", pa.binary()),
    ]
)


class Ids:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file.

    The ids of plain texts are found several times faster by tiktoken, with the ranks of the same
    file, if that splits texts by SPLIT and lists its merges in the order of their ids. Texts with
    other characters or with a special token in them, and all texts of another kind of file, go to
    the tokenizers library itself.
    """

    def __init__(self, vocabulary: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._same = splits_alike(json.loads(Path(vocabulary).read_text(encoding="utf-8")))
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        if not self._same:
            return
        letters = byte_letters()
        ranks = {
            bytes(map(letters.__getitem__, token)): number
            for token, number in self._tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in self._special
        }
        self._fast = tiktoken.Encoding(
            "byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self._same and _PLAIN.fullmatch(text) and not any(token in text for token in self._special):
            return array("I", self._fast(text)).tobytes()
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def splits_alike(file: dict) -> bool:
    """Whether a tokenizer's file splits by SPLIT, changes nothing before, and merges by id."""
    before, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    numbers = model.get("vocab") or {}
    merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model.get("merges") or ()]
    made = [numbers.get("".join(pair), -1) for pair in merges]
    return (
        file.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and model.get("type") == "BPE"
        and not any(model.get(name) for name in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
        and not any(model.get(name) for name in ("continuing_subword_prefix", "end_of_word_suffix"))
        and all(one < other for one, other in zip([-1, *made], made))
    )


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others in order for the letters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {chr(byte): byte for byte in shown} | {
        chr(256 + place): byte for place, byte in enumerate(hidden)
    }


@lru_cache(maxsize=1)
def ids_of(vocabulary: str) -> Ids:
    """One per Python worker, which outlives its tasks."""
    return Ids(vocabulary)


class Packer:
    """Windows filled online; ``emitted`` takes finished pieces as rows of SCHEMA."""

    def __init__(self, first_sequence: int, size: int = SIZE, open_windows: int = OPEN) -> None:
        self.size = size
        self.open_windows = open_windows
        self.sequence = first_sequence
        self.emitted: list[tuple] = []
        # (room, number, pieces) by room: the first with enough room fits best.
        self.windows: list[tuple[int, int, list[tuple]]] = []
        self._opened = 0

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // 4
            self.emitted.append(
                (doc_id, start, length, zlib.crc32(ids), doc_tokens, self.sequence, offset, None)
            )
            offset += length
        self.sequence += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        """Place ids ``start`` and on of a document."""
        while len(ids) >= 4 * self.size:
            self._emit([(doc_id, start, ids[: 4 * self.size], doc_tokens)])
            ids, start = ids[4 * self.size :], start + self.size
        while ids:
            length = len(ids) // 4
            at = bisect.bisect_left(self.windows, (length,))
            if at < len(self.windows):
                room, number, pieces = self.windows.pop(at)
            elif len(self.windows) < self.open_windows:
                self._opened += 1
                room, number, pieces = self.size, self._opened, []
            else:
                room, number, pieces = self.windows.pop(0)
            taken = min(room, length)
            pieces.append((doc_id, start, ids[: 4 * taken], doc_tokens))
            ids, start = ids[4 * taken :], start + taken
            if room == taken:
                self._emit(pieces)
            else:
                bisect.insort(self.windows, (room - taken, number, pieces))

    def left(self) -> Iterator[tuple]:
        """Pieces of windows still open, fullest first, with their ids."""
        for _, number, pieces in self.windows:
            offset = 0
            for doc_id, start, ids, doc_tokens in pieces:
                length = len(ids) // 4
                yield (doc_id, start, length, zlib.crc32(ids), doc_tokens, number, offset, ids)
                offset += length

    def flush(self) -> list[tuple]:
        rows, self.emitted = self.emitted, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, ARROW)], schema=ARROW
    )


def _sequences_of(task: int, level: int) -> int:
    """The first of a task's own range of sequence numbers: 2**32 for each task of a level."""
    return (level << 56) | (task << 32)


def _pack(vocabulary: str, size: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(vocabulary)
        packer = Packer(_sequences_of(TaskContext.get().partitionId(), 0), size, open_windows)
        end = array("I", [END]).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = encode(text.as_py()) + end
                packer.add(doc_id.as_py(), 0, found, len(found) // 4)
                if len(packer.emitted) > 10_000:
                    yield _batch(packer.flush())
        yield _batch(packer.flush() + list(packer.left()))

    return run


def _merge(size: int, level: int):
    def run(keys, table):
        """Run the pieces of a group together, in a fixed order, and cut where full."""
        table = table.sort_by([(name, "ascending") for name in ("task", "sequence_id", "place")])
        packer = Packer(_sequences_of(keys[0].as_py(), level), size, 1)
        for row in table.to_pylist():
            packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
        merged = pa.Table.from_batches([_batch(packer.flush() + list(packer.left()))])
        return merged.append_column("task", pa.repeat(keys[0], merged.num_rows))

    return run


def pack(
    documents: DataFrame, vocabulary: str, size: int = SIZE, open_windows: int = OPEN
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is a file of the tokenizers library that every executor has.
    """
    rows = (
        identified(documents)
        .select("doc_id", "text")
        .mapInArrow(_pack(vocabulary, size, open_windows), SCHEMA)
        .withColumn("task", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id())
    )
    rows = written(rows, "pieces")
    done = [rows.where("ids is null")]
    left = rows.where("ids is not null")
    level = 0
    while (last := left.agg(F.max("task")).first()[0]) is not None:
        level += 1
        merged = (
            left.withColumn("into", F.floor(F.col("task") / FAN_IN).cast("int"))
            .groupBy("into")
            .applyInArrow(_merge(size, level), f"{SCHEMA}, task int")
        )
        merged = written(merged.withColumn("place", F.monotonically_increasing_id()), "merged")
        done.append(merged.where("ids is null"))
        left = merged.where("ids is not null")
        if last < FAN_IN:
            break
    if level:
        # One window is still open: the last sequence, the only one that may not be full.
        done.append(left.withColumn("sequence_id", F.lit(_sequences_of(0, level + 1))))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("ids", "task", "place")
