"""The queries of these operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybook.llm import (
    chat_format,
    collocations,
    exact_dedup,
    fingerprints,
    line_dedup,
    maxent_lm,
    near_dedup,
    packing,
    piece_bpe,
    sharding,
    suffix_dedup,
    toxicity,
    vector_codes,
)
from tallybook.llm.common import documents


def vocabulary(name: str) -> str:
    """A file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.col("edited_bounds.low").alias("near_edited_low"),
        F.col("edited_bounds.high").alias("near_edited_high"),
        F.col("next_bounds.low").alias("near_next_low"),
        F.col("next_bounds.high").alias("near_next_high"),
    )


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the fingerprints' edited texts."""
    found = fingerprints.fingerprints(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256")


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scored(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir), labels).drop("text_hash")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoded(
        documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), texts=False
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, codebooks = vector_codes.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_counts(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_exact_dedup,
        op2_fingerprints,
        op3_maxent_lm,
        op4_toxicity,
        op5_packing,
        op6_sharding,
        op7_minhash_near_dedup,
        op8_suffix_dedup,
        op9_chat_format,
        op10_piece_bpe,
        op11_vector_codes,
        op12_collocations,
        op13_line_dedup,
        edited_texts,
    )
}



def _vector_codes_sql(rounds: int = 6) -> str:
    """Rounds of integer k-means as one common table expression each."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
        chosen{turn} AS MATERIALIZED (
            SELECT row, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
            FROM (
                SELECT p.row, p.part, b.entry, CAST(list_sum(list_transform(
                           list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d
                FROM parts p JOIN book{turn} b ON p.part = b.part
            ) GROUP BY row, part
        )""")
        if turn < rounds:
            steps.append(f"""
        sums{turn} AS (
            SELECT part, entry, place, sum(c.v) AS s, count(*) AS n
            FROM (SELECT row, part, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM parts) c
            JOIN chosen{turn} USING (row, part)
            GROUP BY part, entry, place
        ), means{turn} AS (
            SELECT part, entry,
                   list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x
            FROM sums{turn} GROUP BY part, entry
        ), book{turn + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
            FROM book{turn} b LEFT JOIN means{turn} m ON b.part = m.part AND b.entry = m.entry
        )""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row,
                   list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), parts AS MATERIALIZED (
            SELECT row, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS x
            FROM kept, unnest(range(0, 8)) AS p(part)
        ), book0 AS (
            SELECT part, row - 1 AS entry, x FROM parts WHERE row <= 16
        ), {", ".join(steps)}, digest AS (
            SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
            FROM book{rounds}
        ), coded AS (
            SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
                   CAST(sum(d) AS BIGINT) AS error
            FROM chosen{rounds} GROUP BY row
        )
        SELECT vec_id, code, error,
               CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (row), digest
    """


ORACLE_SQL = {
    "op11_vector_codes": _vector_codes_sql(),
    "op1_exact_dedup": """
        WITH texts AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS lowered
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(lowered) AS text_sha256
        FROM texts
        WINDOW same AS (PARTITION BY lowered)
    """,
    "edited_texts": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC),
                            first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next
            FROM documents
        )
        SELECT doc_id, length(text) AS n_chars,
               sha256(substr(text, 1, length(text) - length(text) // 2)
                      || substr(next, 1, length(text) // 2)) AS edited_sha256
        FROM texts
    """,
    "op7_minhash_near_dedup": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
                lambda w: w <> '') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id,
                   md5(array_to_string(w[place : place + 4], ' ')) AS shingle
            FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS places(place)
            WHERE len(w) > 0
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT a, b FROM shared
            JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
            WHERE 100 * shared.n >= 75 * (sa.n + sb.n - shared.n)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
        ), smallest AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id,
               doc_id = component_id AS kept
        FROM smallest LEFT JOIN sizes USING (doc_id)
    """,
    "op8_suffix_dedup": """
        WITH texts AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), windows AS (
            SELECT doc_id, place, md5_number(substr(h, 2 * place + 1, 200)) AS piece
            FROM texts, unnest(range(0, length(h) // 2 - 99)) AS places(place)
            WHERE length(h) >= 200
        ), repeats AS (
            SELECT doc_id, place FROM windows
            QUALIFY row_number() OVER (PARTITION BY piece ORDER BY doc_id, place) > 1
        ), opened AS (
            SELECT doc_id, place,
                   coalesce(place > lag(place) OVER runs + 100, true) AS opens
            FROM repeats WINDOW runs AS (PARTITION BY doc_id ORDER BY place)
        ), spans AS (
            SELECT doc_id, span, min(place) AS a, max(place) + 100 AS b
            FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END)
                         OVER (PARTITION BY doc_id ORDER BY place) AS span FROM opened)
            GROUP BY doc_id, span
        ), gaps AS (
            SELECT doc_id, a, b,
                   coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS gap
            FROM spans
        ), cut AS (
            SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
                   string_agg(substr(h, 2 * gap + 1, 2 * (a - gap)), '' ORDER BY a) AS head
            FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes,
               CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1)))
                   AS kept_sha256
        FROM texts LEFT JOIN cut USING (doc_id)
    """,
    "op12_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w
            FROM pieces
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
        ), counts AS MATERIALIZED (
            SELECT lang, array_to_string(w[place : place + size - 1], ' ') AS phrase, size, count(*) AS f
            FROM words, unnest(range(1, 5)) AS sizes(size), unnest(range(1, len(w) - size + 2)) AS places(place)
            GROUP BY ALL HAVING f >= 30
        ), candidates AS (
            SELECT lang, phrase, string_split(phrase, ' ') AS w, size, f AS a FROM counts WHERE size > 1
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, k, one.f AS l, rest.f AS r,
                   CAST(2000000 AS HUGEINT) * c.a // (one.f + rest.f) AS score
            FROM candidates c, unnest(range(1, c.size)) AS ks(k)
            JOIN counts one ON one.lang = c.lang AND one.phrase = array_to_string(w[1 : k], ' ')
            JOIN counts rest ON rest.lang = c.lang AND rest.phrase = array_to_string(w[k + 1 : c.size], ' ')
        ), scored AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, array_to_string(w[place : place + part - 1], ' ') AS phrase, max(a) AS most
            FROM candidates, unnest(range(2, size)) AS parts(part),
                 unnest(range(1, size - part + 2)) AS places(place)
            GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
               phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM scored LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
        WHERE coalesce(100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT), true)
        QUALIFY rank <= 2000
    """,
    "op13_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
                               FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (key)
        GROUP BY doc_id
    """,
}
