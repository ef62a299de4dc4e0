"""Session settings."""

from __future__ import annotations

from tallybook.session import MIB, session, shuffle_partitions


def test_settings_the_jobs_rely_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_the_session_sizes_its_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        own = session(shuffled_bytes=10 * 1024 * MIB, cores=8)
        assert own.conf.get("spark.sql.shuffle.partitions") == "80"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffle_partitions():
    assert shuffle_partitions(0, 8) == 8
    assert shuffle_partitions(10 * 1024 * MIB, 8) == 80
    assert shuffle_partitions(10 * 1024 * MIB + 1, 8) == 81
    assert shuffle_partitions(20 * 1024 * 1024 * MIB, 8000) == 163_840
