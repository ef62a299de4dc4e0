"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A text is a set of shingles of five words (with fewer words, the whole sequence is one).
Its fingerprint holds the 64-bit hash of every shingle that lies below a fixed fraction of
all hashes, ascending, and nothing else. It is an unbiased sample of the set
whatever its size, so the containment of one document in another can be estimated between
a note and a book. Fingerprints merge: the hashes of both are the fingerprint of the union.

Likeness is the larger containment of either in the other, from the two fingerprints alone. With m
hashes in the smaller, its standard error is at most 1 / (2 sqrt(m)); ``interval`` gives the
bounds in which the containment lies with a probability of 95 % (Wilson's). A text of n shingles has no
hash below the fraction with a probability of (1 - 1 / SCALE)^n; its bounds are 0 and 1.

A missing text is empty. An empty fingerprint, which texts without words have, is likened 1 to another
empty one and 0 to any other. Equal texts have equal fingerprints. Rows that repeat both
doc_id and text are one document more than once and get equal results; ids that repeat with
other texts are ordered by a hash of the text, missing ids come last. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import NO_ID, SPACE, id_key, identified, written

WORDS = 5
#: One shingle in this many is retained.
SCALE = 2
#: Standard errors on either side of an estimate within its bounds.
ERRORS = 1.96
#: Signed 64-bit hashes below this are retained.
THRESHOLD = -(2**63) + 2**64 // SCALE


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column) -> Column:
    """The different hashes of all shingles of a text, as an array."""

    def of_words(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashed) - (WORDS - 1), F.lit(1)))
        found = F.transform(starts, lambda at: F.xxhash64(F.slice(hashed, at, WORDS)))
        return F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).otherwise(
            F.array_distinct(found)
        )

    words = F.filter(F.split(text, f"{SPACE}+"), lambda word: word != F.lit(""))
    return once(F.transform(words, lambda word: F.xxhash64(word)), of_words)


def retained(hashes: Column) -> Column:
    """Of different hashes those a sketch keeps, ascending."""
    return F.array_sort(F.filter(hashes, lambda h: h < F.lit(THRESHOLD)))


def sketch(text: Column) -> Column:
    """The retained hashes of a text, ascending, as an array."""
    return retained(shingles(text))


def merged(one: Column, other: Column) -> Column:
    """The sketch of the union of two documents."""
    return F.array_sort(F.array_union(one, other))


def containment(shared: Column, one: Column, other: Column) -> Column:
    """Estimated share of the shingles of ``one`` that are shared."""
    return F.when(F.size(one) == 0, (F.size(other) == 0).cast("double")).otherwise(
        shared / F.size(one)
    )


def likeness(one: Column, other: Column) -> Column:
    """The larger containment of either in the other: 1 if one document holds the other."""
    return once(
        F.size(F.array_intersect(one, other)),
        lambda shared: F.greatest(containment(shared, one, other), containment(shared, other, one)),
    )


def interval(estimate: Column, one: Column, other: Column) -> Column:
    """Bounds, as low and high, of a containment estimated from two sketches."""
    hashes = F.least(F.size(one), F.size(other)).cast("double")

    def bounds(weight: Column) -> Column:
        # weight: the square of ERRORS for each hash
        centre = (estimate + weight / 2) / (1 + weight)
        half = F.sqrt(weight * (estimate * (1 - estimate) + weight / 4)) / (1 + weight)
        return F.struct(
            F.greatest(centre - half, F.lit(0.0)).alias("low"), F.least(centre + half, F.lit(1.0)).alias("high")
        )

    unknown = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.when(hashes == 0, unknown).otherwise(once(F.lit(ERRORS**2) / F.nullif(hashes, F.lit(0.0)), bounds))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def neighbours(keys: DataFrame) -> DataFrame:
    """Each document with the next one in descending order of doc_id; after the last the first.

    Ordered by ranges, each numbered by one task; what joins the ranges is one row per range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash").asc()]
    ranged = written(
        keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    own = F.struct("id_key", "text_hash")
    in_part = Window.partitionBy("part").orderBy(*order)
    ranked = ranged.withColumn("following", F.lead(own).over(in_part)).withColumn(
        "place", F.row_number().over(in_part)
    )
    # One row per range: an un-keyed window over as many rows as there are partitions.
    heads = ranked.where("place = 1").select("part", own.alias("head"))
    ends = heads.select(
        "part",
        F.coalesce(
            F.lead("head").over(Window.orderBy("part")),
            F.min_by("head", "part").over(Window.partitionBy(F.lit(1))),
        ).alias("beyond"),
    )
    return ranked.join(F.broadcast(ends), "part").select(
        "id_key", "text_hash", "n_chars", F.coalesce("following", "beyond").alias("next")
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, sketches of the text and of its edited text, likenesses and their bounds.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many,
    or all, of the next document's.
    """
    base = identified(documents).select("doc_id", id_key().alias("id_key"), "text_hash", "text")
    keys = written(
        base.select("doc_id", "id_key", "text_hash", F.length("text").alias("n_chars")).distinct(),
        "keys",
    )
    pairs = written(neighbours(keys), "neighbours")
    wanted = pairs.select(
        F.col("next.id_key").alias("id_key"),
        F.col("next.text_hash").alias("text_hash"),
        F.col("id_key").alias("owner"),
        F.col("text_hash").alias("owner_hash"),
    )
    key = ["id_key", "text_hash"]
    # Both joins read one and the same shuffle of the texts, so both take the same columns.
    # Sketches are made after the joins: hashes would take more room in a shuffle than the texts.
    rows = base.select(*key, "text")
    given = rows.join(wanted, key).groupBy("owner", "owner_hash").agg(F.first("text").alias("next"))
    joined = rows.join(
        given.withColumnsRenamed({"owner": "id_key", "owner_hash": "text_hash"}), key
    )
    n_chars, taken = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), n_chars - taken), F.col("next").substr(F.lit(1), taken)
    )
    texts = {"own": F.col("text"), "next": F.col("next"), "edited": F.col("edited")}
    return (
        joined.withColumn("edited", edited)
        .select(
            F.nullif("id_key", F.lit(NO_ID)).alias("doc_id"),
            n_chars.cast("bigint").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            *(sketch(text).alias(f"{name}_sketch") for name, text in texts.items()),
        )
        .withColumn("near_edited", likeness(F.col("own_sketch"), F.col("edited_sketch")))
        .withColumn("near_next", likeness(F.col("own_sketch"), F.col("next_sketch")))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.col("own_sketch").alias("sketch"),
            "edited_sketch",
            "near_edited",
            "near_next",
            interval(F.col("near_edited"), F.col("own_sketch"), F.col("edited_sketch")).alias("edited_bounds"),
            interval(F.col("near_next"), F.col("own_sketch"), F.col("next_sketch")).alias("next_bounds"),
        )
    )
