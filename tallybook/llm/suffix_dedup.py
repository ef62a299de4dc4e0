"""Removal of repeated byte strings, by deep-shallow sorting of the suffixes at anchors.

A byte goes if a 100-byte string covering it also starts earlier: in a document with a
smaller doc_id, or earlier in the same one. Strings are judged on the input.

Sorting every suffix of a corpus is not needed to find strings of 100 bytes:

1. A document that equals an earlier one goes as a whole and takes no part in the rest.
2. Every 100-byte window has an anchor, its k-gram with the least hash. Windows next to each
   other mostly share it, so a document is a list of runs: an anchor and the windows it
   serves. Equal windows have equal anchors at equal offsets, so only runs with the same
   anchor can hold equal windows. Runs equal as a whole keep one member, the earliest; the
   others are repeats and need no text. This is done within each batch before anything is
   shuffled, so a passage found everywhere crosses the network once per batch.
3. What is left are different runs with one anchor. The suffixes at the anchor, and the
   reversed prefixes before it, are sorted by deep-shallow sorting: multikey quicksort, all
   segments of a task partitioned side by side, to SHALLOW bytes; the groups still
   tied are ordered by blind tries. Common prefixes of neighbours in both orders tell
   for each offset which runs hold the same window; all but the earliest are repeats.
4. The repeats of a document are merged, and the text between them is kept.

An anchor with more than HOT different runs is not brought into one task: its windows are
hashed to 128 bits each and grouped by an ordinary, pre-aggregated shuffle instead. Nor are its runs
told apart in one task: anchors that seem that common in one document of SAMPLED have theirs
dealt by run and all passed on. The sample steers where rows go, not what becomes of them.

A missing text is empty. Texts shorter than 100 bytes are kept whole. Rows that
repeat both doc_id and text are one document and share its result. Rows that repeat a
doc_id with other text are ordered by a hash of the text; missing ids come last. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallybook.llm.common import (
    NO_ID,
    identified,
    if_small,
    in_batches,
    small,
    texts_as_bytes,
    written,
)
from tallybook.llm.hashing import pieces, prefix_sums

#: Bytes of a string that may not repeat, and of the k-grams that anchor it.
LENGTH = 100
GRAM = 32
#: Bytes on either side of an anchor that a window can reach.
REACH = LENGTH - GRAM
#: Depth of the multikey quicksort, in bytes after the anchor.
SHALLOW = 16
#: Most different runs of one anchor that one task compares.
HOT = 20_000
#: One document in so many is looked at for common anchors; pieces that the runs of one are dealt to.
SAMPLED, PIECES = 64, 1024
#: Positions of a document that are anchored at once.
STRETCH = 1 << 22

_PLACE = np.uint64(0xFFFFFF)


# ---- runs of windows -------------------------------------------------------------------


def runs(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the whole run, anchor position, first and last window of each run."""
    found = []
    for first in range(0, max(0, len(text) - LENGTH + 1), STRETCH):
        part = text[first : first + STRETCH + LENGTH - 1]
        found.append([first if k > 1 else 0 for k in range(5)] + list(_runs(part)))
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64,) * 5)
    moved = [[shift + values for shift, values in zip(part[:5], part[5:])] for part in found]
    return tuple(np.concatenate(values) for values in zip(*moved))


def _runs(text: bytes) -> list[np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    hashed = pieces(sums, at, at + GRAM)
    windows, width = len(data) - LENGTH + 1, REACH + 1
    # The least hash of each window, the leftmost of equal ones, by minima of blocks.
    keys = (hashed & ~_PLACE) | at.astype(np.uint64)
    blocks = np.pad(keys, (0, -len(keys) % width), constant_values=~np.uint64(0)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    anchors = (least & _PLACE).astype(np.int64)
    firsts = np.flatnonzero(np.diff(anchors, prepend=-1))
    lasts = np.append(firsts[1:], windows) - 1
    anchors = anchors[firsts]
    whole = pieces(sums, firsts, lasts + LENGTH) + (anchors - firsts).astype(np.uint64)
    return [hashed[anchors].view(np.int64), whole.view(np.int64), anchors, firsts, lasts]


RUN = pa.schema(
    [(name, pa.int64()) for name in ("anchor", "whole", "ord", "at", "first", "last")]
    + [("repeat", pa.bool_())]
)
RUN_SQL = "anchor bigint, whole bigint, ord bigint, at bigint, first bigint, last bigint, repeat boolean"


def _batch_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs of a batch of documents; those equal to an earlier one of the batch are repeats."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for number, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
        anchor, whole, at, first, last = runs(text)
        values = (anchor, whole, np.full(len(anchor), number), at, first, last)
        for column, value in zip(columns, values):
            column.append(value)
    anchor, whole, number, at, first, last = (
        np.concatenate(column) if column else np.zeros(0, np.int64) for column in columns
    )
    order = np.lexsort((first, number, whole, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    repeat = np.zeros(len(anchor), bool)
    repeat[order[1:][same]] = True
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (anchor, whole, number, at, first, last, repeat)], schema=RUN
    )


# ---- deep-shallow sorting --------------------------------------------------------------


def blind_trie(strings: list[int], size: int) -> tuple[list[int], list[int]]:
    """The order of byte strings of one size, given as numbers, and common prefixes.

    A node holds the depth at which its strings first differ and a child per byte there; the
    bytes between are skipped. A string goes down blindly, is compared once with the leaf
    it ends at, and is inserted where they part. Equal strings share a leaf.
    """
    bits = 8 * (size - 1)
    root: list = [None, [0]]  # leaf: [None, members]; node: [depth, children, a member]
    for number in range(1, len(strings)):
        string, node = strings[number], root
        while node[0] is not None:
            byte = string >> (bits - 8 * node[0]) & 255
            node = node[1].get(byte) or next(iter(node[1].values()))
        apart = string ^ strings[node[1][0]]
        if not apart:
            node[1].append(number)
            continue
        depth = size - (apart.bit_length() + 7) // 8
        parent, node = None, root
        while node[0] is not None and node[0] < depth:
            parent, node = node, node[1][string >> (bits - 8 * node[0]) & 255]
        byte = string >> (bits - 8 * depth) & 255
        if node[0] == depth:
            node[1][byte] = [None, [number]]
            continue
        member = node
        while member[0] is not None:
            member = next(iter(member[1].values()))
        other = strings[member[1][0]] >> (bits - 8 * depth) & 255
        inner = [depth, {other: node, byte: [None, [number]]}]
        if parent is None:
            root = inner
        else:
            parent[1][string >> (bits - 8 * parent[0]) & 255] = inner
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple[list, int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if node[0] is None:
            common.append(shared)
            common.extend([size] * (len(node[1]) - 1))
            order.extend(node[1])
        else:
            children = sorted(node[1].items(), reverse=True)
            stack.extend((child, node[0]) for _, child in children[:-1])
            stack.append((children[-1][1], shared))
    return order, common


def deep_shallow(groups: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by group and string, and the common prefix of each with the row before.

    ``strings`` is a matrix of bytes, its width a multiple of eight. A common prefix across
    groups is -1.
    """
    count, size = strings.shape
    words = np.ascontiguousarray(strings).view(">u8")
    order = np.argsort(groups, kind="stable")
    segments = groups[order]
    starts = np.flatnonzero(np.diff(segments, prepend=segments[:1] - 1)) if count else np.zeros(0, int)
    common = np.zeros(count, np.int64)
    common[starts] = -1
    bounds = np.append(starts, count)
    sizes = np.diff(bounds)
    for word in range(SHALLOW // 8):
        # One multikey step: every segment of several rows is partitioned by its next word.
        tied = np.repeat(sizes > 1, sizes)
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        segment = np.repeat(np.arange(len(sizes)), sizes)[rows]
        value = words[order[rows], word].astype(np.uint64)
        step = np.lexsort((value, segment))
        order[rows] = order[rows][step]
        value, segment = value[step], segment[step]
        inside = segment[1:] == segment[:-1]
        apart = value[1:] ^ value[:-1]
        parted = rows[1:][inside & (apart != 0)]
        common[parted] = 8 * word + _leading(apart[inside & (apart != 0)])
        bounds = np.unique(np.concatenate((bounds, parted)))
        sizes = np.diff(bounds)
    for start, length in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        rows = order[start : start + length]
        deep, shared = blind_trie([int.from_bytes(strings[r].tobytes()) for r in rows], size)
        order[start : start + length] = rows[deep]
        common[start + 1 : start + length] = shared[1:]
    return order, common


def _leading(values: np.ndarray) -> np.ndarray:
    """Whole bytes that are zero at the head of each word."""
    raw = np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)
    return (raw != 0).argmax(axis=1)


def _names(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row, a number that rows with the same first ``depth`` bytes share."""
    place = np.arange(len(order))
    names = np.empty(len(order), np.int64)
    names[order] = np.maximum.accumulate(np.where(common < depth, place, 0))
    return names


def repeats(
    anchor: np.ndarray, near: np.ndarray, far: np.ndarray, after: np.ndarray, before: np.ndarray
) -> np.ndarray:
    """A matrix: whether the window of row and offset also occurs in an earlier row.

    Rows are in the order of their documents and positions. ``near`` and ``far`` are
    the least and greatest offset of the anchor in the windows of a row; ``after`` and
    ``before`` the bytes after the anchor, and before it from right to left.
    """
    right, left = deep_shallow(anchor, after), deep_shallow(anchor, before)
    found = np.zeros((len(anchor), REACH + 1), bool)
    for offset in range(REACH + 1):
        rows = np.flatnonzero((near <= offset) & (offset <= far))
        if len(rows) < 2:
            continue
        name = _names(*right, REACH - offset)[rows] * len(anchor) + _names(*left, offset)[rows]
        _, first = np.unique(name, return_index=True)
        repeated = np.ones(len(rows), bool)
        repeated[first] = False
        found[rows[repeated], offset] = True
    return found


# ---- the Spark job ---------------------------------------------------------------------


def _measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = texts_as_bytes(batch.column(1))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            batch.column(2),
            pa.array([len(text) for text in texts], pa.int64()),
            pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary()),
        ],
        names=["doc_id", "text_hash", "n_bytes", "digest"],
    )


def numbered(documents: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as ``ord``, ``text`` and rows with ``ord``; ord follows the order of documents.

    That is the doc_id itself where ids are there and differ. Otherwise documents are
    numbered in order, range by range.
    """
    texts = identified(documents)
    clashes = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if clashes.isEmpty():
        return texts.select(F.col("doc_id").alias("ord"), "text"), rows.withColumn("ord", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    keys = rows.select("doc_id", "text_hash").distinct().repartitionByRange(*order)
    keys = written(keys.withColumn("part", F.spark_partition_id()), "ranges")
    before = keys.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    keys = written(
        keys.withColumn("place", place).join(F.broadcast(before), "part").select(
            F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), "text_hash",
            (F.col("before") + F.col("place")).alias("ord"),
        ),
        "numbers",
    )
    own = F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key")
    single = texts.select("text", "text_hash", own).join(keys, ["id_key", "text_hash"])
    single = single.groupBy("ord").agg(F.first("text").alias("text"))
    return single, rows.withColumn("id_key", own).join(keys, ["id_key", "text_hash"]).drop("id_key")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted run of a document."""
    for batch in small(batches):
        rows: list[tuple] = []
        wanted = batch.column(2).to_pylist()
        for number, text, entries in zip(
            batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), wanted
        ):
            for e in entries:
                piece = text[e["first"] : e["last"] + LENGTH]
                rows.append((e["anchor"], number, e["at"], e["first"], e["last"], piece))
                if len(rows) >= 20_000:
                    yield _sliced(rows)
                    rows = []
        yield _sliced(rows)


SLICE_SQL = "anchor bigint, ord bigint, at bigint, first bigint, last bigint, piece binary"


def _sliced(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, kinds)],
        names=["anchor", "ord", "at", "first", "last", "piece"],
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among runs that come sorted by anchor, document and position."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        anchor = table.column("anchor").to_numpy()
        if not len(anchor):
            continue
        # The last anchor may go on in the next batch.
        cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
        if cut >= 8192:
            yield _repeats_of(table.slice(0, cut))
            table = table.slice(cut)
        rest = table
    if rest is not None and rest.num_rows:
        yield _repeats_of(rest)


def _repeats_of(table: pa.Table) -> pa.RecordBatch:
    anchor, number, at, first, last = (
        table.column(name).to_numpy() for name in ("anchor", "ord", "at", "first", "last")
    )
    width = REACH + -REACH % 8
    after, before = (np.zeros((len(anchor), width), np.uint8) for _ in range(2))
    for row, piece in enumerate(table.column("piece").to_pylist()):
        middle = int(at[row] - first[row])
        data = np.frombuffer(piece, np.uint8)
        right = data[middle + GRAM :]
        after[row, : len(right)] = right
        before[row, :middle] = data[:middle][::-1]
    order = np.lexsort((first, number, anchor))
    found = repeats(*(values[order] for values in (anchor, at - last, at - first, after, before)))
    # Stretches of offsets; a greater offset is an earlier window.
    edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    at, number = at[order][rows], number[order][rows]
    return pa.RecordBatch.from_arrays(
        [pa.array(number), pa.array(at - (high - 1)), pa.array(at - low)], names=["ord", "first", "last"]
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window of a run with a hot anchor."""
    for batch in small(batches):
        rows = []
        for row in batch.to_pylist():
            for start in range(row["first"], row["last"] + 1):
                piece = row["piece"][start - row["first"] : start - row["first"] + LENGTH]
                rows.append((hashlib.blake2b(piece, digest_size=16).digest(), row["ord"], start))
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["window", "ord", "start"],
        )


def common_anchors(texts: DataFrame) -> DataFrame:
    """``anchor``: those that seem to have more than HOT runs, from one document of SAMPLED."""
    some = texts.where(F.octet_length("text") >= LENGTH).where(
        F.pmod(F.xxhash64("ord"), F.lit(SAMPLED)) == 0
    )
    runs_of = some.mapInArrow(in_batches(_batch_runs), RUN_SQL).where("not repeat")
    counts = runs_of.groupBy("anchor").count().where(F.col("count") > HOT // SAMPLED)
    return written(counts.select("anchor"), "common")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """``ord``, ``first``, ``last``: stretches of windows that also start earlier."""
    found = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(
        in_batches(_batch_runs), RUN_SQL
    )
    common = common_anchors(texts).withColumn("common", F.lit(True))
    dealt = found.where("not repeat").join(if_small(common), "anchor", "left").withColumn(
        "piece", F.when(F.col("common"), F.pmod("whole", F.lit(PIECES))).otherwise(0)
    )
    group = Window.partitionBy("anchor", "piece")
    live = (
        dealt.withColumn(
            "place",
            F.row_number().over(Window.partitionBy("anchor", "piece", "whole").orderBy("ord", "first")),
        )
        .withColumn("several", F.coalesce("common", F.min("whole").over(group) < F.max("whole").over(group)))
        .where("several or place > 1")
    )
    known = found.where("repeat")
    judged = written(
        live.select(
            "anchor", "ord", "at", "first", "last", (F.col("place") > 1).alias("repeat")
        ).unionByName(known.select("anchor", "ord", "at", "first", "last", "repeat")),
        "runs",
    )
    open_runs = judged.where("not repeat")
    hot = open_runs.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor")
    wanted = open_runs.groupBy("ord").agg(
        F.collect_list(F.struct("anchor", "at", "first", "last")).alias("wanted")
    )
    slices = written(
        texts.join(wanted, "ord").select("ord", "text", "wanted").mapInArrow(_slices, SLICE_SQL),
        "slices",
    )
    hot = written(hot, "hot")
    compared = (
        slices.join(if_small(hot), "anchor", "left_anti")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "ord", "first")
        .mapInArrow(_compared, "ord bigint, first bigint, last bigint")
    )
    result = judged.where("repeat").select("ord", "first", "last").unionByName(compared)
    if not hot.isEmpty():
        windows = written(
            slices.join(if_small(hot), "anchor")
            .select("ord", "first", "last", "piece")
            .mapInArrow(_windows, "window binary, ord bigint, start bigint"),
            "windows",
        )
        earliest = windows.groupBy("window").agg(F.min(F.struct("ord", "start")).alias("earliest"))
        result = result.unionByName(
            windows.join(earliest, "window")
            .where(F.struct("ord", "start") != F.col("earliest"))
            .select("ord", F.col("start").alias("first"), F.col("start").alias("last"))
        )
    return result


def kept_bytes(text: bytes, stretches: list[dict]) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes go, in how many spans."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, [s["first"] for s in stretches], 1)
    np.add.at(change, [s["last"] + LENGTH for s in stretches], -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [
            kept_bytes(text, stretches)
            for text, stretches in zip(texts_as_bytes(batch.column(1)), batch.column(2).to_pylist())
        ]
        kept, removed, spans = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            names=["ord", "n_removed", "n_spans", "kept"],
        )


def judged(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts by ``ord``; rows with ``ord`` and whether they are copies; repeats by ``ord``."""
    rows = identified(documents).mapInArrow(
        in_batches(_measured), "doc_id bigint, text_hash bigint, n_bytes bigint, digest binary"
    )
    bodies, rows = numbered(documents, written(rows, "measured"))
    earliest = rows.groupBy("digest").agg(F.min("ord").alias("earliest"))
    rows = written(
        rows.join(earliest, "digest").withColumn(
            "copy", (F.col("ord") != F.col("earliest")) & (F.col("n_bytes") >= LENGTH)
        ),
        "rows",
    )
    copies = rows.where("copy").select("ord").distinct()
    bodies = bodies.join(if_small(copies), "ord", "left_anti")
    stretches = written(
        repeated_windows(bodies)
        .groupBy("ord")
        .agg(F.collect_list(F.struct("first", "last")).alias("stretches")),
        "stretches",
    )
    return bodies, rows, stretches


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``documents``."""
    bodies, rows, stretches = judged(documents)
    changed = (
        bodies.join(stretches, "ord")
        .select("ord", "text", "stretches")
        .mapInArrow(_kept, "ord bigint, n_removed bigint, n_spans bigint, kept binary")
        .select("ord", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    )
    copied = F.col("copy")
    return rows.join(changed, "ord", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(b""), 256))
        .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
        .alias("kept_sha256"),
    )


def _rewritten(names: list[str]):
    """Rows with what is left of their text; the last two columns are copy and stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns = batch.columns[:-2]
            place = names.index("text")
            texts = columns[place].to_pylist()
            keep = [not copy for copy in batch.columns[-2].to_pylist()]
            for row, stretches in enumerate(batch.columns[-1].to_pylist()):
                if keep[row] and stretches:
                    left = kept_bytes((texts[row] or "").encode(), stretches)[0]
                    keep[row] = bool(left)
                    texts[row] = left.decode("utf-8", "ignore")
            columns[place] = pa.array(texts, columns[place].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                counts = columns[at].to_pylist()
                for row, stretches in enumerate(batch.columns[-1].to_pylist()):
                    if stretches:
                        counts[row] = len(texts[row])
                columns[at] = pa.array(counts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-2])).filter(
                pa.array(keep, pa.bool_())
            )

    return run


def drop_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with what is left of each text; those of which nothing is left go.

    A character cut in the middle goes as a whole. ``n_chars``, if there is one, is counted anew.
    """
    _, rows, stretches = judged(documents)
    found = (
        rows.join(stretches, "ord", "left")
        .where("copy or stretches is not null")
        .groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "text_hash")
        .agg(F.first("copy").alias("_copy"), F.first("stretches").alias("_stretches"))
    )
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    joined = documents.join(
        found,
        (F.coalesce(documents["doc_id"].cast("bigint"), F.lit(NO_ID)) == found["_id"])
        & (F.xxhash64(text) == found["text_hash"]),
        "left",
    )
    return joined.select(
        *(documents[name] for name in documents.columns),
        F.coalesce("_copy", F.lit(False)).alias("_copy"),
        "_stretches",
    ).mapInArrow(_rewritten(documents.columns), documents.schema)
