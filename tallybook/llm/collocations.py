"""Collocations: frequent phrases scored by how far their parts stand alone.

A-Z count as a-z. Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and those into words
``[^\\x20\\x09]+``. Everything is per lang, a missing one is ``und``. A candidate is a phrase of 2 to
LONGEST words found at least ``least`` times inside pieces, overlaps included. Cut after its first
k words, with l and r the counts of both sides, it scores floor(POINTS * a / (l + r)); the cut
with the lowest score counts, of equal ones that with the smallest k. A candidate is dropped if its
words lie inside a longer candidate with at least COVER percent of its count.

1. Tasks count chunks of texts by sorting and send each distinct phrase of a chunk once. Single
   words and pairs are counted in one pass; longer phrases in a second, where all of
   their pairs are frequent, which a bitmap of at most FILTER_BITS tells. Its false hits cost work, never a
   phrase, because a phrase is never more frequent than its pairs.
2. Frequent phrases form two streams of counts: in prefix order, by words, and in suffix order, by words
   from the last to the first. Both are range-partitioned, hence cut anywhere, also between the phrases of one
   word. In prefix order a phrase follows its own first words and is followed by what extends it to the right, so one
   walk with a stack of at most LONGEST counts tells the counts of all its beginnings and its
   most frequent extension. The same walk in suffix order tells those of its ends.
   What a partition's first phrases owe to earlier partitions, and its last to later ones, is
   at most LONGEST counts a partition, which the driver hands over.
3. The suffix stream is put into prefix order again and merged with the prefix stream in lockstep, row by
   row: both hold the same phrases. A phrase within a longer one is found by its extensions of one
   word alone, since those lie between the two in count and are candidates too.
4. Each partition keeps the best of each lang, these are ranked by lang in two steps.

A missing text is empty and holds no words. Repeated rows count as often as they stand
there. Words are as long as they are; a text beyond CHUNK_BYTES is counted in sections that know the words
after them. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import if_small, text_of, texts_as_bytes, written

LONGEST = 4
LEAST, COVER, POINTS, TOP = 30, 80, 2_000_000, 2000
#: Bytes of text counted at a time.
CHUNK_BYTES = 4 << 20
#: Most bits of the bitmap of frequent pairs (32 MiB), and bits of it for each pair.
FILTER_BITS, BITS_EACH = 1 << 28, 16
BUCKET_BITS = 1 << 15  # of one of Spark's bitmaps
#: Phrases of one partition of a stream.
PART_ROWS = 100_000
#: Ends a piece; no word holds it, as pieces are cut there.
STOP = b"."
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)

COUNTED = "lang string, phrase string, n bigint"


# ---- counts ----------------------------------------------------------------------------


def _sections(data: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words and stops of cut text, and how many of them are not just what follows the section."""
    while len(data) > 2 * CHUNK_BYTES:
        end = data.find(b" ", CHUNK_BYTES)
        if end < 0:
            break
        own, data = data[:end].split(), data[end:]
        yield own + data.split(None, LONGEST - 1)[: LONGEST - 1], len(own)
    own = data.split()
    yield own, len(own)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """lang, words and stops of many texts of one lang, number of those to start phrases at."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def cut() -> Iterator[tuple[str, list[bytes], int]]:
        for lang in sorted(held):
            data = b"\n".join(held.pop(lang)).lower().translate(_CUT).replace(b"\n", b" " + STOP + b" ")
            for words, count in _sections(data):
                yield lang, words, count

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield from cut()
                size = 0
    yield from cut()


class _Phrases:
    """Phrases of a chunk as numbers that are built up word by word."""

    def __init__(self, words: list[bytes], count: int):
        encoded = pa.array(words, pa.binary()).dictionary_encode()
        self.ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words, self.count = encoded.dictionary, count
        self.stop = pc.index(self.words, pa.scalar(STOP, pa.binary())).as_py()

    def single(self) -> tuple[pa.Array, np.ndarray]:
        counts = np.bincount(self.ids[: self.count], minlength=len(self.words))
        if self.stop >= 0:
            counts[self.stop] = 0
        found = np.flatnonzero(counts)
        return self.words.take(pa.array(found)), counts[found]

    def starts(self) -> np.ndarray:
        """Where pairs start."""
        word = self.ids != self.stop
        pairs = np.flatnonzero(word[:-1] & word[1:])
        return pairs

    def extended(self, starts: np.ndarray, heads: np.ndarray, length: int):
        """Phrases of ``length`` words at ``starts``, whose words but the last have the numbers ``heads``.

        Distinct numbers of the phrases, for each start its own, a start of each, counts.
        """
        keys = heads * len(self.words) + self.ids[starts + length - 1]
        _, first, own = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(own[starts < self.count], minlength=len(first))
        return own, starts[first], counts

    def texts(self, starts: np.ndarray, length: int) -> pa.Array:
        words = [self.words.take(pa.array(self.ids[starts + place])) for place in range(length)]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    own = pa.array(counts > 0)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang), len(counts)), phrases.cast(pa.string()), pa.array(counts, pa.int64())],
        names=["lang", "phrase", "n"],
    ).filter(own)


def _count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs; the empty phrase has the number of words."""
    for lang, words, count in _chunks(batches):
        chunk = _Phrases(words, count)
        found, counts = chunk.single()
        yield _rows(lang, found, counts)
        yield _rows(lang, pa.array([b""], pa.binary()), np.array([counts.sum()]))
        starts = chunk.starts()
        _, first, counts = chunk.extended(starts, chunk.ids[starts], 2)
        yield _rows(lang, chunk.texts(first, 2), counts)


def _count_long(bitmap):
    """Counts of longer phrases whose pairs are all in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = bitmap.value
        for lang, words, count in _chunks(batches):
            chunk = _Phrases(words, count)
            starts = chunk.starts()
            own, first, _ = chunk.extended(starts, chunk.ids[starts], 2)
            seed = zlib.crc32(lang.encode() + b"\n")
            hashes = [zlib.crc32(pair, seed) for pair in chunk.texts(first, 2).to_pylist()]
            at = np.array(hashes, np.int64) & (8 * len(bits) - 1)
            likely = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            numbers = np.full(len(chunk.ids) + LONGEST, -1)  # of the phrase at each start
            kept = likely[own] if len(own) else np.zeros(0, bool)
            numbers[starts[kept]] = own[kept]
            starts = starts[kept]
            follows = numbers >= 0  # a frequent pair starts here
            for length in range(3, LONGEST + 1):
                starts = starts[follows[starts + length - 2]]
                own, first, counts = chunk.extended(starts, numbers[starts], length)
                yield _rows(lang, chunk.texts(first, length), counts)
                numbers = np.full(len(numbers), -1)
                numbers[starts] = own

    return run


def _hash(column: Column | str, phrase: str) -> Column:
    return F.crc32(F.concat(column, F.lit("\n"), F.col(phrase)).cast("binary"))


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """A bitmap of hashes of the pairs, of bounded size."""
    wanted = max(pairs.count(), 1) * BITS_EACH
    size = min(FILTER_BITS, max(BUCKET_BITS, 1 << (wanted - 1).bit_length()))
    at = F.pmod(_hash("lang", "phrase"), F.lit(size))
    found = (
        pairs.select(F.floor(at / BUCKET_BITS).alias("bucket"), (at % BUCKET_BITS).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(size // 8, np.uint8)
    for bucket, own in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist()):
        bits[bucket * BUCKET_BITS // 8 : (bucket + 1) * BUCKET_BITS // 8] = np.frombuffer(own, np.uint8)
    return bits


def frequent_phrases(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of all frequent phrases of 1 to LONGEST words; lang, n of all words."""
    texts = documents.select(
        F.coalesce(documents["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(documents).alias("text")
    )

    def often(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        return written(sums.where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")

    short = often(texts.mapInArrow(_count_short, COUNTED))
    totals, short = short.where("phrase = ''").select("lang", "n"), short.where("phrase <> ''")
    bitmap = documents.sparkSession.sparkContext.broadcast(_bitmap(short.where("instr(phrase, ' ') > 0")))
    long = often(texts.mapInArrow(_count_long(bitmap), COUNTED)).where("phrase <> ''")
    return short.unionByName(long), totals


# ---- streams ---------------------------------------------------------------------------


def _ordered(table: pa.Table, backwards: bool) -> list[tuple[bytes, list[bytes], int, int]]:
    """lang, words (from the last if backwards), count and home partition, in the stream's order."""
    langs = table.column("lang").cast(pa.binary()).to_pylist()
    phrases = table.column("phrase").cast(pa.binary()).to_pylist()
    step = -1 if backwards else 1
    rows = zip(langs, (p.split(b" ")[::step] for p in phrases), table.column("n").to_pylist(), table.column("home").to_pylist())
    return sorted(rows)


def _common(one: list[bytes], other: list[bytes]) -> int:
    same = 0
    for a, b in zip(one, other):
        if a != b:
            break
        same += 1
    return same


def walk(rows: list, carried: list[int]):
    """One walk over a stream's partition.

    ``carried`` holds the counts of what the first row begins with and earlier partitions
    hold. Returns for each row the counts of all its beginnings, for each row its largest extension, the same of
    what was carried, and the counts of the last row's beginnings and itself; None is
    what is not here.
    """
    beginnings: list[list[int | None]] = []
    extended = [0] * len(rows)
    before = [0] * LONGEST
    opened: list[tuple[int | None, int | None]] = []  # count and row of each beginning
    last_lang, last = None, []
    for number, (lang, words, count, *_) in enumerate(rows):
        if number:
            opened = opened[: min(_common(last, words) if lang == last_lang else 0, len(words) - 1)]
        else:
            opened = [(carried[k] if k < len(carried) else None, None) for k in range(len(words) - 1)]
        beginnings.append([own for own, _ in opened])
        if opened:
            parent = opened[-1][1]
            if parent is None:
                before[len(opened) - 1] = max(before[len(opened) - 1], count)
            else:
                extended[parent] = max(extended[parent], count)
        opened.append((count, number))
        last_lang, last = lang, words
    return beginnings, extended, before, [own if row is not None else None for own, row in opened]


SUMMARY = (
    "part bigint, first_lang binary, first array<binary>, last_lang binary, last array<binary>, "
    "open array<bigint>, before array<bigint>"
)


def _summary(backwards: bool):
    def run(keys, table):
        rows = _ordered(table, backwards)
        _, _, before, opened = walk(rows, [])
        return pa.table(
            {
                "part": [keys[0].as_py()],
                "first_lang": pa.array([rows[0][0]], pa.binary()),
                "first": pa.array([rows[0][1]], pa.list_(pa.binary())),
                "last_lang": pa.array([rows[-1][0]], pa.binary()),
                "last": pa.array([rows[-1][1]], pa.list_(pa.binary())),
                "open": pa.array([opened], pa.list_(pa.int64())),
                "before": pa.array([before], pa.list_(pa.int64())),
            }
        )

    return run


def hand_over(summaries: list) -> dict[int, tuple[list[int], list[int]]]:
    """For each partition the counts carried into it, and the extensions of its last row's beginnings that
    later partitions hold."""
    handed: dict[int, tuple[list[int], list[int]]] = {}
    opened: list[tuple[int, int]] = []  # count and partition of the beginnings of the last row so far
    lang, last = None, []
    for row in sorted(summaries, key=lambda row: row["part"]):
        first = list(row["first"])
        same = min(_common(last, first) if row["first_lang"] == lang else 0, len(first) - 1)
        opened = opened[:same]
        handed[row["part"]] = [count for count, _ in opened], [0] * LONGEST
        for depth, most in enumerate(row["before"]):
            if most:
                later = handed[opened[depth][1]][1]
                later[depth] = max(later[depth], most)
        own = [(count, row["part"]) if count is not None else None for count in row["open"]]
        opened = [mine or opened[depth] for depth, mine in enumerate(own)]
        lang, last = row["last_lang"], list(row["last"])
    return handed


WALKED = "home bigint, lang string, phrase string, n bigint, sides array<bigint>, extended bigint"


def _walk(handed: dict, backwards: bool):
    def run(keys, table):
        carried, later = handed[keys[0].as_py()]
        rows = _ordered(table, backwards)
        sides, extended, _, _ = walk(rows, carried)
        # The last row's beginnings, itself included, may go on in later partitions.
        lang, words = rows[-1][:2]
        for depth, most in enumerate(later):
            if most:
                row = next(n for n in range(len(rows) - 1, -1, -1) if rows[n][0] == lang and rows[n][1] == words[: depth + 1])
                extended[row] = max(extended[row], most)
        step = -1 if backwards else 1
        kept = [n for n, row in enumerate(rows) if len(row[1]) > 1]
        return pa.table(
            {
                "home": pa.array([rows[n][3] for n in kept], pa.int64()),
                "lang": pa.array([rows[n][0] for n in kept], pa.binary()).cast(pa.string()),
                "phrase": pa.array([b" ".join(rows[n][1][::step]) for n in kept], pa.binary()).cast(pa.string()),
                "n": pa.array([rows[n][2] for n in kept], pa.int64()),
                "sides": pa.array([sides[n] for n in kept], pa.list_(pa.int64())),
                "extended": pa.array([extended[n] for n in kept], pa.int64()),
            }
        )

    return run


def _stream(counts: DataFrame, parts: int, order: Column, name: str) -> DataFrame:
    """Counts in so many ranges of an order, each row with its range's number."""
    placed = counts.withColumn("_words", order).repartitionByRange(parts, "lang", "_words").drop("_words")
    return written(placed.withColumn(name, F.spark_partition_id().cast("bigint")), name)


def _walked(stream: DataFrame, part: str, backwards: bool) -> DataFrame:
    grouped = stream.groupBy(part)
    handed = hand_over(grouped.applyInArrow(_summary(backwards), SUMMARY).collect())
    return grouped.applyInArrow(_walk(handed, backwards), WALKED)


# ---- scores ----------------------------------------------------------------------------

SCORED = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"


def scored(count: int, lefts: list[int], rights: list[int]) -> tuple[int, int, int]:
    """Score, l and r of the cut that counts; ``rights`` are those of the ends from the shortest on."""
    cuts = zip(lefts, reversed(rights))
    score, _, left, right = min((POINTS * count // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
    return score, left, right


def _merge(top: int):
    """Both streams, in the same order, row by row; the best of each lang of the partition."""

    def by_words(table):
        columns = [table.column(name).to_pylist() for name in ("lang", "phrase", "n", "sides", "extended")]
        rows = zip(*columns)
        return sorted(((lang.encode(), phrase.encode().split(b" "), *rest) for lang, phrase, *rest in rows))

    def run(prefixes, suffixes):
        found: dict[bytes, list] = {}
        for one, other in zip(by_words(prefixes), by_words(suffixes), strict=True):
            lang, words, count, lefts, right = one
            if other[:3] != one[:3]:
                raise ValueError("the streams are not the same")
            if 100 * max(right, other[4]) < COVER * count:
                score, l, r = scored(count, lefts, other[3])
                found.setdefault(lang, []).append((-score, -count, b" ".join(words), l, r))
        rows = [(lang, *row) for lang, own in found.items() for row in sorted(own)[:top]]
        langs, scores, counts, phrases, lefts, rights = list(zip(*rows)) or [()] * 6
        return pa.table(
            {
                "lang": pa.array(langs, pa.binary()).cast(pa.string()),
                "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                "a": pa.array([-count for count in counts], pa.int64()),
                "l": pa.array(lefts, pa.int64()),
                "r": pa.array(rights, pa.int64()),
                "score": pa.array([-score for score in scores], pa.int64()),
            }
        )

    return run


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` of each lang."""
    counts, totals = frequent_phrases(documents, least)
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // PART_ROWS))
    words = F.split("phrase", " ")
    prefixes = _stream(counts, parts, words, "home")
    suffixes = _stream(prefixes, parts, F.reverse(words), "part")
    forward = _walked(prefixes.withColumn("part", F.col("home")), "part", False)
    backward = _walked(suffixes, "part", True)
    best = written(
        forward.groupBy("home").cogroup(backward.groupBy("home")).applyInArrow(_merge(top), SCORED), "best"
    )

    def first(rows: DataFrame, *keys: Column | str) -> DataFrame:
        order = Window.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)

    salt = F.pmod(F.xxhash64("phrase"), F.lit(math.isqrt(parts) + 1))
    ranked = first(first(best, salt))
    return ranked.join(if_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
