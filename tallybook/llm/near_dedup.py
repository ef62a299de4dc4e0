"""Near duplicates by min-max hashing, banded, with links confirmed on full sets.

A document's set holds its distinct shingles of five words; with fewer words, the whole
sequence is one; without words it is empty and linked with nothing. A-Z count as a-z.
Documents are linked when 100 * intersection >= 75 * union.

1. Documents with equal sets form a node, so copies cost one row per task and set.
2. Each of PERMUTATIONS hash functions gives two values of a node's signature, its minimum
   and its maximum over the set. Bands of four values (both of two functions) give
   BANDS keys; a pair with similarity 0.75 shares none with a probability of at most 9e-6
   (5e-6 for large sets; minimum and maximum of a small set are not independent), any closer pair with
   less. Sets of up to TINY shingles get keys besides that miss nothing: in the order of the
   hashes, two linked sets share one of their first n - ceil(3 n / 4) + 1 shingles, so each of these is a key.
3. Nodes of one key form a bucket. Its centre is the node that meets most nodes in all of its
   buckets, which is the original among edited copies. Every node elects one centre, that of most of
   its buckets, and is compared with it alone. Confirmed pairs are linked and components built.
4. In ROUNDS rounds, each node outside its bucket's largest component is compared with one node of the
   component that is the largest in most of its buckets, which gathers groups without an original.
   So far each node costs one pair a round, however large its buckets are.
5. What is left outside the largest component of a bucket is compared with all nodes of other components
   in it, by a wider signature first, which lets few pairs through that do not link. A bucket with many such
   comparisons is cut into a grid of cells of about PAIRS each, so no task takes all of it. After that no
   two nodes of a bucket in different components are left uncompared.
6. A pair is dropped early if sizes or two bits of each signature value rule it out (at
   0.75 the bits do so wrongly with a probability below 1e-6; tiny sets are not judged by bits). Otherwise the full
   sets of 64-bit shingle hashes are compared. The set of a node that many others are compared with is
   joined last, in as many copies as it has HUB_PAIRS pairs.

The result is a row per row: rows of equal text share it. ``component_id`` is the smallest
doc_id reachable, missing ones aside. Rows that repeat a doc_id with other text are
compared on their own; they are kept or not by that id like any row. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import (
    NO_ID,
    identified,
    if_small,
    in_batches,
    texts_as_bytes,
    with_keys,
    written,
)
from tallybook.llm.components import components
from tallybook.llm.hashing import mixed, pieces, prefix_sums

WORDS = 5
PERMUTATIONS = 64
BANDS = 32
#: Most differing values, of 128 cut to two bits, of a pair that is looked at further:
#: at 0.75 their number has mean 24 and deviation 4.4.
DIFFERING = 48
#: Rounds in which a node that its buckets' main components have not taken in meets one node of them.
ROUNDS = 2
#: Sets of up to so many shingles are found by single shingles. A set of 12 is linked with none larger.
TINY = 16
#: Comparisons of a cell of a bucket; pairs of a node that one copy of its set serves.
PAIRS, HUB_PAIRS = 1 << 20, 512
#: Functions of the wider signature of nodes that no component has taken in, and most differing
#: values of it, of 2048 cut to two bits: at 0.75 their number has mean 384 and deviation 17.7.
WIDE = 1024
WIDE_DIFFERING = 472
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.random.default_rng(72).integers(1, 2**64, WIDE, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a lower-cased text."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = pieces(prefix_sums(data), starts, ends)
    count = min(WORDS, len(words))
    found = np.full(len(words) - count + 1, np.uint64(count))
    for place in range(count):
        found = found * _STEP + words[place : place + len(found)]
    return np.unique(mixed(found))


def signature(found: np.ndarray, functions: int = PERMUTATIONS) -> np.ndarray:
    """Minima, then maxima, of all hash functions over a set that is not empty."""
    low = np.full(functions, np.uint64(2**64 - 1))
    high = np.zeros(functions, np.uint64)
    for first in range(0, len(found), 512):
        hashed = found[None, first : first + 512] * _ODD[:functions, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per band: both values of two functions each."""
    pairs = values.reshape(2, BANDS, -1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for side in pairs:
        for column in side.T:
            keys = mixed(keys * _STEP + column)
    return keys.view(np.int64)


def tiny_keys(found: np.ndarray) -> np.ndarray:
    """Keys of which any two linked sets of up to TINY shingles share one."""
    if len(found) > TINY:
        return np.zeros(0, np.int64)
    first = found[: len(found) + 3 * len(found) // -4 + 1]
    return mixed(first * _STEP + np.uint64(BANDS)).view(np.int64)


def two_bits(values: np.ndarray) -> np.ndarray:
    """Two bits of each value, 32 values to a 64-bit number."""
    bits = (mixed(values) & np.uint64(3)).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(
        axis=1, dtype=np.uint64
    ).view(np.int64)


SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_digest", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("bits", pa.list_(pa.int64())),
    ]
)


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows: list[tuple] = []
    for text in texts_as_bytes(batch.column(1)):
        found = shingles(text.lower())
        if len(found):
            values = signature(found)
            digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            keys = np.concatenate((band_keys(values), tiny_keys(found)))
            rows.append((len(found), digest, keys, two_bits(values)))
        else:
            rows.append((0, None, None, None))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2)]
        + [pa.array(values, field.type) for values, field in zip(columns, list(SKETCH)[2:])],
        schema=SKETCH,
    )


def sketches(documents: DataFrame) -> DataFrame:
    """A row per document with its node-making digest, band keys and signature bits."""
    rows = identified(documents).mapInArrow(
        in_batches(_sketch),
        "doc_id bigint, text_hash bigint, n_shingles bigint, set_digest binary, "
        "bands array<bigint>, bits array<bigint>",
    )
    return written(rows.withColumn("row_id", F.monotonically_increasing_id()), "sketches")


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [shingles(text.lower()).tobytes() for text in texts_as_bytes(batch.column(1))]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"]
    )


def _wide_bits(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [
        two_bits(signature(shingles(text.lower()), WIDE)).tolist()
        for text in texts_as_bytes(batch.column(1))
    ]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "wide"]
    )


def _similar(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        small, large = (np.frombuffer(found, np.uint64) for found in sorted((one, other), key=len))
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        shared = int((large[at] == small).sum())
        keep.append(100 * shared >= 75 * (len(small) + len(large) - shared))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1)], names=["u", "v"]
    ).filter(pa.array(keep, pa.bool_()))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs u, v those whose sizes and signature bits allow a link."""
    slim = nodes.select("node", "n_shingles", "bits")
    for side in ("u", "v"):
        pairs = pairs.join(
            slim.select(
                F.col("node").alias(side),
                F.col("n_shingles").alias(f"n_{side}"),
                F.col("bits").alias(f"bits_{side}"),
            ),
            side,
        )

    return pairs.where(_possible("n_u", "n_v", "bits_u", "bits_v")).select("u", "v")


def _differing(one: Column, other: Column) -> Column:
    """How many of 32 two-bit values differ."""
    x = one.bitwiseXOR(other)
    either = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(either.bitwiseAND(F.lit(0x5555555555555555)))


def _tiny(size: str, other_size: str) -> Column:
    return F.greatest(size, other_size) <= TINY


def _possible(size: str, other_size: str, bits: str, other_bits: str) -> Column:
    """Whether sizes and signature bits allow a link."""

    apart = sum(
        (_differing(F.col(bits)[place], F.col(other_bits)[place]) for place in range(1, 4)),
        _differing(F.col(bits)[0], F.col(other_bits)[0]),
    )
    fits = 100 * F.least(size, other_size) >= 75 * F.greatest(size, other_size)
    return fits & (_tiny(size, other_size) | (apart <= DIFFERING))


def _with_texts(documents: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the wanted nodes."""
    wanted = written(
        nodes.join(wanted, "node").select(
            "node", F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), "text_hash"
        ),
        "wanted",
    )
    rows = identified(documents).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), "text_hash", "text"
    )
    return rows.join(if_small(wanted), ["id_key", "text_hash"]).select("node", "text")


def _confirmed(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs u, v those linked, by their full sets."""
    pairs = written(_likely(pairs, nodes), "pairs")
    ends = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u")))
    degrees = written(ends.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree")), "degrees")
    texts = _with_texts(documents, nodes, degrees.select("node"))
    sets = written(texts.mapInArrow(in_batches(_sets), "node bigint, shingles binary"), "sets")
    if sets.count() > degrees.count():  # rows that repeat doc_id and text
        sets = sets.dropDuplicates(["node"])
    # The end with more pairs is the hub. Sets of the other ends meet copies of the hub's set.
    for side in ("u", "v"):
        pairs = pairs.join(degrees.withColumnsRenamed({"node": side, "degree": f"degree_{side}"}), side)
    u_is_hub = F.col("degree_u") >= F.col("degree_v")
    copies = F.ceil(F.greatest("degree_u", "degree_v") / F.lit(HUB_PAIRS)).cast("int")
    turned = written(
        pairs.select(
            F.when(u_is_hub, F.col("v")).otherwise(F.col("u")).alias("leaf"),
            F.when(u_is_hub, F.col("u")).otherwise(F.col("v")).alias("hub"),
            F.pmod(F.xxhash64("u", "v"), copies).alias("copy"),
        ),
        "turned",
    )
    hubs = turned.select("hub", "copy").distinct()
    return (
        sets.select(F.col("node").alias("leaf"), F.col("shingles").alias("one"))
        .join(if_small(turned), "leaf")
        .join(
            sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other")).join(hubs, "hub"),
            ["hub", "copy"],
        )
        .select(F.least("leaf", "hub").alias("u"), F.greatest("leaf", "hub").alias("v"), "one", "other")
        .mapInArrow(in_batches(_similar), "u bigint, v bigint")
    )


def _elected(votes: DataFrame) -> DataFrame:
    """Pairs u, v of each node with the choice of most of its buckets; ``votes`` has node, choice, weight."""
    counted = votes.groupBy("node", "choice").agg(F.count("*").alias("votes"), F.max("weight").alias("weight"))
    best = F.max(F.struct("votes", "weight", (-F.col("choice")).alias("least"))).alias("best")
    chosen = -F.col("best.least")
    return (
        counted.groupBy("node")
        .agg(best)
        .select(F.least("node", chosen).alias("u"), F.greatest("node", chosen).alias("v"))
        .distinct()
    )


def _joined(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Components, as u and root, after those of the pairs that link are added."""
    links = written(_confirmed(documents, nodes, pairs), "links")
    if joined is None:
        return components(links)
    if links.isEmpty():
        return joined
    # Only roots are joined anew.
    for side in ("u", "v"):
        roots = joined.select(F.col("u").alias(side), F.col("root").alias(f"root_{side}"))
        links = links.join(roots, side, "left")
    one, other = (F.coalesce(f"root_{side}", side) for side in ("u", "v"))
    anew = components(links.select(one.alias("u"), other.alias("v")).where("u <> v").distinct())
    later = anew.select(F.col("u").alias("root"), F.col("root").alias("later"))
    moved = joined.join(later, "root", "left").select("u", F.coalesce("later", "root").alias("root"))
    return written(moved.unionByName(anew), "joined")


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their own and the largest one.

    n_all and n_out are the numbers of the bucket's members and of those outside its largest component.
    """
    placed = written(
        members.join(joined, members["node"] == joined["u"], "left").select(
            "band", "node", F.coalesce("root", "node").alias("root")
        ),
        "placed",
    )
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = (
        sizes.groupBy("band")
        .agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n_all"))
        .where("parts > 1")
        .select("band", F.col("main.root").alias("main"), "n_all", (F.col("n_all") - F.col("main.n")).alias("n_out"))
    )
    return written(placed.join(main, "band"), "open")


def _remaining(documents: DataFrame, nodes: DataFrame, opened: DataFrame) -> DataFrame:
    """Pairs of nodes of different components in one bucket, as far as the wider signature allows a link."""
    wide = _with_texts(documents, nodes, opened.select("node").distinct()).mapInArrow(
        in_batches(_wide_bits), "node bigint, wide array<bigint>"
    )
    wide = written(wide.dropDuplicates(["node"]), "wide")
    opened = opened.join(nodes.select("node", "n_shingles", "bits", "bands"), "node").join(wide, "node")
    # Both sides of a bucket are cut alike, and each piece meets each of the other side in a cell.
    side = F.ceil(F.sqrt(F.col("n_out") * F.col("n_all") / F.lit(PAIRS))).cast("int")
    piece, others = F.pmod(F.xxhash64("node"), side), F.explode(F.sequence(F.lit(0), side - 1))
    one = opened.where("root <> main").withColumn("row", piece).withColumn("column", others).alias("one")
    other = opened.withColumn("column", piece).withColumn("row", others).alias("other")
    # A pair that shares several bands is taken in one of them, and once.
    once = (
        F.array_min(F.array_intersect("one.bands", "other.bands")) == F.col("one.band")
    ) & ((F.col("other.root") == F.col("other.main")) | (F.col("one.node") < F.col("other.node")))
    apart = F.aggregate(
        F.zip_with("one.wide", "other.wide", _differing), F.lit(0), lambda sum_, n: sum_ + n
    )
    return (
        one.join(
            other,
            (F.col("one.band") == F.col("other.band"))
            & (F.col("one.row") == F.col("other.row"))
            & (F.col("one.column") == F.col("other.column"))
            & (F.col("one.root") != F.col("other.root"))
            & _possible("one.n_shingles", "other.n_shingles", "one.bits", "other.bits")
            & once
            & (_tiny("one.n_shingles", "other.n_shingles") | (apart <= WIDE_DIFFERING)),
        )
        .select(
            F.least("one.node", "other.node").alias("u"), F.greatest("one.node", "other.node").alias("v")
        )
        .distinct()
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept; a row per row of ``documents``."""
    rows = sketches(documents)
    full = rows.where("set_digest is not null")
    nodes = full.groupBy("set_digest").agg(
        F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_id", "text_hash")).alias("r"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.first("bits").alias("bits"),
    )
    nodes = written(
        nodes.select(
            F.col("r.row_id").alias("node"), "r.doc_id", "r.text_hash",
            "set_digest", "n_shingles", "bands", "bits",
        ),
        "nodes",
    )
    keys = nodes.select("node", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.count("*").alias("n"))
    shared = written(keys.join(buckets.where("n > 1"), "band"), "shared")
    # The original of many edited copies meets more nodes than any copy does.
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    centres = (
        shared.join(met, "node")
        .groupBy("band")
        .agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("centre"))
        .select("band", (-F.col("centre.least")).alias("choice"), F.col("centre.met").alias("weight"))
    )
    members = shared.select("band", "node")
    joined = _joined(documents, nodes, _elected(members.join(centres, "band").where("node <> choice")), None)
    # Members of one group need not be close to its centre. They meet another node of their buckets'
    # main component, drawn anew for each bucket and round.
    opened = _open(members, joined)
    for turn in range(ROUNDS):
        drawn = (
            opened.where("root = main")
            .groupBy("band")
            .agg(F.max(F.struct(F.xxhash64("node", "band", F.lit(turn)), "node")).alias("drawn"))
            .select("band", F.col("drawn.node").alias("drawn"))
        )
        # Buckets vote for a component, whose nodes are drawn by any of them.
        votes = opened.where("root <> main").join(drawn, "band")
        asked = votes.groupBy("node", "main").agg(F.count("*").alias("weight"), F.max("drawn").alias("choice"))
        before, joined = joined, _joined(documents, nodes, _elected(asked), joined)
        if joined is before:
            break
        opened = _open(members, joined)
    joined = _joined(documents, nodes, _remaining(documents, nodes, opened), joined)

    named = nodes.join(joined, nodes["node"] == joined["u"], "left").select(
        "set_digest", "doc_id", F.coalesce("root", "node").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "root").select("set_digest", "component_id")
    found = rows.select("doc_id", "text_hash", "n_shingles", "set_digest").join(
        named, "set_digest", "left"
    )
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """All columns of the rows that are kept, one document of each group of linked ones."""
    dropped = near_duplicates(documents).where("not kept").select("doc_id", "text_hash")
    return with_keys(documents, dropped, "left_anti")
