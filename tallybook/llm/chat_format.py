"""Conversations brought to a legal order of turns at least cost, then rendered.

An automaton says which roles may follow each other: an optional system turn first, then user and
assistant in turn, a user first, an assistant last. Each turn of the input takes one step
through it, and each step has a price:

* keep a turn in its role: nothing;
* relabel it: RELABEL;
* merge it with the turn before, of the same role in the output: MERGE if its own role is that
  one, MERGE + RELABEL else;
* insert an empty turn before it or at the end, where a role is missing: INSERT.

Dynamic programming finds the cheapest path. A step is a matrix of prices between states,
and a block of turns is the (min, +) product of its steps, so a long conversation is cut into
blocks of BLOCK turns that are worked out apart: first each block's matrix, then one walk
over the blocks' matrices, then each block's own path between known ends. All three work on many
blocks or conversations at once: rows come sorted, a batch of whole groups is one array, and a step is
taken in all groups of the batch that have a turn at that place. A batch holds BATCH rows and what is left of
its last group; the walk holds a matrix of a few numbers per BLOCK turns of a conversation.

Among equally cheap steps a turn is kept or relabelled rather than merged, without an
insertion rather than with one, towards the first state in order.

Roles other than system, user and assistant count as wrong everywhere and are relabelled
or merged; a missing role is such a one; a missing text is empty. Turns are ordered by
turn, missing ones last, then role and text, so repeated turns are turns
of their own. Rows without a conv_id form one conversation. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallybook.llm.common import written

RELABEL, MERGE, INSERT = 3, 1, 2
BLOCK = 512
#: Rows worked on at a time, at least.
BATCH = 8192
#: States: the role of the turn last put out, or start. A system turn is allowed at the start only.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
#: Where each state may go without and with an empty turn in between.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"


def steps(role: int | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """Every step of a turn: from, to, price, action, roles of empty turns inserted before."""
    found = []
    for state in range(4):
        paths: list[tuple[int, tuple[int, ...]]] = [(to, ()) for to in LEGAL[state]]
        paths += [
            (to, (between,)) for between in LEGAL[state] for to in LEGAL[between] if between != SYSTEM
        ]
        for to, inserted in paths:
            price = INSERT * len(inserted) + (0 if role == to else RELABEL)
            found.append((state, to, price, "keep" if role == to else "relabel", inserted))
        if state != START:
            price = MERGE + (0 if role == state else RELABEL)
            found.append((state, state, price, "merge", ()))
    return found


STEPS = {role: steps(role) for role in (None, SYSTEM, USER, ASSISTANT)}
#: Price of stopping in a state: an answer is missing after a user, both after a system turn.
ENDS = {
    START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)),
    USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ()),
}


#: Numbers of the roles that a turn may come with; the first stands for all wrong ones.
_CODES = {None: 0, SYSTEM: SYSTEM, USER: USER, ASSISTANT: ASSISTANT}
_MOST = max(len(found) for found in STEPS.values())


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By role the least price between two states, and of its steps, in order, from where and the price to each state."""
    prices = np.full((4, 4, 4), FAR)
    origin = np.zeros((4, _MOST), np.int64)
    to = np.full((4, _MOST, 4), FAR)
    for role, code in _CODES.items():
        for number, (state, after, price, _, _) in enumerate(STEPS[role]):
            prices[code, state, after] = min(prices[code, state, after], price)
            origin[code, number] = state
            to[code, number, after] = price
    return prices, origin, to


_PRICES, _FROM, _TO = _tables()
_END = np.array([ENDS[state][0] for state in range(4)])


class Groups:
    """Rows of many groups, one after another, taken place by place."""

    def __init__(self, first: np.ndarray):
        """``first`` tells for each row whether a group begins there."""
        self.starts = np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.starts, len(first)))
        self.order = np.argsort(-self.sizes, kind="stable")  # so the groups that go on stand in front
        self.longest = int(self.sizes.max(initial=0))
        self._falling = -self.sizes[self.order]

    def at(self, place: int) -> np.ndarray:
        """The rows at a place of all groups that have one, in ``order``."""
        return self.starts[self.order[: np.searchsorted(self._falling, -place)]] + place


def matrices(codes: np.ndarray, groups: Groups) -> np.ndarray:
    """For each group the least price from every state to every state over its turns."""
    total = np.full((len(groups.starts), 4, 4), FAR)
    total[:, range(4), range(4)] = 0
    for place in range(groups.longest):
        rows = groups.at(place)
        own = total[: len(rows)]
        total[: len(rows)] = np.minimum((own[:, :, :, None] + _PRICES[codes[rows]][:, None]).min(axis=2), FAR)
    found = np.empty_like(total)
    found[groups.order] = total
    return found


def walk(prices: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """The states each block, a row of prices, starts and ends in on its conversation's cheapest path."""
    best = np.full((len(groups.starts), 4), FAR)
    best[:, START] = 0
    before = np.zeros((len(prices), 4), np.int64)
    for place in range(groups.longest):
        rows = groups.at(place)
        before[rows] = best[: len(rows)]
        best[: len(rows)] = (best[: len(rows), :, None] + prices[rows]).min(axis=1)
    state = np.argmin(best + _END, axis=1)
    starts, ends = np.zeros(len(prices), np.int64), np.zeros(len(prices), np.int64)
    for place in range(groups.longest - 1, -1, -1):
        rows = groups.at(place)
        ends[rows] = state[: len(rows)]
        reached = prices[rows, :, ends[rows]]
        starts[rows] = state[: len(rows)] = np.argmin(before[rows] + reached, axis=1)
    return starts, ends


def paths(codes: np.ndarray, groups: Groups, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each turn's step on the cheapest path of its block between two states."""
    best = np.full((len(groups.starts), 4), FAR)
    best[range(len(best)), starts[groups.order]] = 0
    came = np.zeros((len(codes), 4), np.int8)
    for place in range(groups.longest):
        rows = groups.at(place)
        role = codes[rows]
        origin = np.take_along_axis(best[: len(rows)], _FROM[role], axis=1)
        reached = origin[:, :, None] + _TO[role]
        came[rows] = np.argmin(reached, axis=1)  # of equal ones the first step
        best[: len(rows)] = np.minimum(reached.min(axis=1), FAR)
    state = ends[groups.order]
    found = np.zeros(len(codes), np.int64)
    for place in range(groups.longest - 1, -1, -1):
        rows = groups.at(place)
        found[rows] = came[rows, state[: len(rows)]]
        state[: len(rows)] = _FROM[codes[rows], found[rows]]
    return found


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([ROLES.get(role, 0) for role in column.to_pylist()], np.int64)


def in_groups(work: Callable[[pa.Table, Groups], pa.RecordBatch], *names: str):
    """A function of whole groups of rows, which come sorted by ``names``, for ``mapInArrow``."""

    def changes(table: pa.Table) -> np.ndarray:
        first = np.zeros(table.num_rows, bool)
        first[:1] = True
        for name in names:
            values = table.column(name).to_numpy()
            first[1:] |= values[1:] != values[:-1]
        return first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            first = changes(table)
            last = int(np.flatnonzero(first)[-1])  # the last group may go on
            if last:
                yield work(table.slice(0, last), Groups(first[:last]))
            held = table.slice(last).to_batches()
            # A long group is looked at again only when it has grown by half.
            size = min(table.num_rows - last, BATCH - max(1, (table.num_rows - last) // 2))
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                yield work(table, Groups(changes(table)))

    return run


def _block_matrices(table: pa.Table, groups: Groups) -> pa.RecordBatch:
    found = matrices(_codes(table.column("role")), groups)
    rows = table.select(["key", "block"]).take(pa.array(groups.starts))
    return pa.RecordBatch.from_arrays(
        [*(column.combine_chunks() for column in rows.columns), pa.array(found.reshape(-1, 16).tolist(), pa.list_(pa.int64()))],
        names=["key", "block", "prices"],
    )


def _walk(table: pa.Table, groups: Groups) -> pa.RecordBatch:
    prices = np.array(table.column("prices").to_pylist(), np.int64).reshape(-1, 4, 4)
    starts, ends = walk(prices, groups)
    last = np.zeros(len(prices), bool)
    last[groups.starts + groups.sizes - 1] = True
    return pa.RecordBatch.from_arrays(
        [
            *(table.column(name).combine_chunks() for name in ("key", "block")),
            pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(last),
        ],
        names=["key", "block", "start", "end", "last"],
    )


RESULT = (
    "conv_id bigint, place bigint, turn bigint, role string, new_role string, action string, "
    "inserted int, cost bigint, rendered string"
)


def _opening(step: tuple, first: bool) -> str:
    """What a step puts before the turn's text."""
    _, to, _, action, inserted = step
    # A turn that is not merged closes the one before it, so no turn looks ahead.
    text = "\n" if action == "merge" else "" if first else TAIL
    text += "".join(HEAD.format(role=NAMES[r]) + TAIL for r in inserted)
    return text if action == "merge" else text + HEAD.format(role=NAMES[to])


_BY_CODE = [STEPS[role] for role in _CODES]
_OPENINGS = [[[_opening(step, first) for step in found] for found in _BY_CODE] for first in (False, True)]


def _rendered(table: pa.Table, groups: Groups) -> pa.RecordBatch:
    """Each turn with its share of the rendered conversation; a block's first row has its states."""
    states = table.take(pa.array(groups.starts))
    turn = np.ones(table.num_rows, bool)
    turn[groups.starts] = False
    first = np.zeros(table.num_rows, bool)
    first[groups.starts + 1] = True
    table, groups = table.filter(pa.array(turn)).combine_chunks(), Groups(first[turn])
    codes = _codes(table.column("role"))
    starts, ends = (states.column(name).to_numpy() for name in ("start", "end"))
    chosen = paths(codes, groups, starts, ends).tolist()
    closing = np.zeros(len(codes), bool)
    closing[groups.starts + groups.sizes - 1] = states.column("last").to_numpy()
    taken = [_BY_CODE[code][number] for code, number in zip(codes.tolist(), chosen)]
    places = table.column("place").to_pylist()
    texts = [
        _OPENINGS[place == 0][code][number] + text
        for place, code, number, text in zip(places, codes.tolist(), chosen, table.column("text").to_pylist())
    ]
    counts, prices = [len(step[4]) for step in taken], [step[2] for step in taken]
    for row in np.flatnonzero(closing).tolist():
        missing = ENDS[taken[row][1]][1]
        texts[row] += TAIL + "".join(HEAD.format(role=NAMES[r]) + TAIL for r in missing)
        counts[row] += len(missing)
        prices[row] += INSERT * len(missing)
    return pa.RecordBatch.from_arrays(
        [
            *(table.column(name).combine_chunks() for name in ("conv_id", "place", "turn", "role")),
            pa.array([NAMES[step[1]] for step in taken], pa.string()),
            pa.array([step[3] for step in taken], pa.string()),
            pa.array(counts, pa.int32()),
            pa.array(prices, pa.int64()),
            pa.array(texts, pa.string()),
        ],
        names=[entry.split()[0] for entry in RESULT.split(", ")],
    )


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, found without bringing it into one task.

    Turns are ordered by ranges of (conv_id, turn); a range numbers its own, and the ranges'
    counts per conversation, one row each, are summed up before them.
    """
    order = [
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(),
        F.xxhash64("text").asc(), F.col("text").asc(),
    ]
    ranged = written(
        turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    same = F.coalesce(F.col("conv_id"), F.lit(-(2**63))).alias("key")
    ranged = ranged.withColumn("key", same)
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "key",
        "part",
        (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order[1:]))
    return (
        ranged.withColumn("own", own)
        .join(before, ["key", "part"])
        .withColumn("place", F.col("before") + F.col("own") - 1)
        .drop("own", "before", "part")
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """A row per turn: its new role, what was done, at what price, and its part of the text.

    The parts of a conversation, run together by ``place``, are the rendered conversation.
    """
    turns = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"),
        conversations["turn"].cast("bigint").alias("turn"),
        conversations["role"].cast("string").alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
    )
    turns = written(
        _numbered(turns).withColumn("block", F.floor(F.col("place") / BLOCK)), "turns"
    )
    slim = turns.select("key", "block", "place", "role").repartition("key", "block")
    prices = slim.sortWithinPartitions("key", "block", "place").mapInArrow(
        in_groups(_block_matrices, "key", "block"), "key bigint, block bigint, prices array<bigint>"
    )
    known = written(
        prices.repartition("key")
        .sortWithinPartitions("key", "block")
        .mapInArrow(in_groups(_walk, "key"), "key bigint, block bigint, start int, end int, last boolean"),
        "walk",
    )
    # A block's states come as a row before its turns, so blocks are not joined.
    both = turns.unionByName(known.withColumn("place", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    return (
        both.repartition("key", "block")
        .sortWithinPartitions("key", "block", "place")
        .mapInArrow(in_groups(_rendered, "key", "block"), RESULT)
    )
