"""The daily counts as a stream: whole tables, late rows, restarts, repeats."""

from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import pytest

from tallybook.streaming import daily

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def source(spark, tmp_path):
    """Adds a file of (day, hour, type) rows to a table that streams read."""

    class Source:
        root = str(tmp_path)

        def add(self, *rows):
            data = [
                (i, datetime(2024, 1, day, hour), 1, kind, 0.0, "{}")
                for i, (day, hour, kind) in enumerate(rows)
            ]
            spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(
                f"{self.root}/events.parquet"
            )

        def run(self, folder, **options):
            stream = daily.daily_counts(daily.stream_events(spark, self.root, **options))
            daily.write_counts(stream, folder).awaitTermination()
            return sorted(tuple(row) for row in daily.read_counts(spark, folder).collect())

    return Source()


def test_last_days_are_counted_too(source, tmp_path):
    source.add((1, 0, "a"), (1, 23, "a"), (2, 0, "b"))
    assert source.run(f"{tmp_path}/run") == [(date(2024, 1, 1), "a", 2), (date(2024, 1, 2), "b", 1)]


def test_an_empty_table_gives_no_counts(source, tmp_path):
    source.add()
    assert source.run(f"{tmp_path}/run") == []


def test_a_restart_goes_on_where_it_stopped(source, tmp_path):
    folder = f"{tmp_path}/run"
    source.add((1, 1, "a"), (2, 1, "a"))
    source.run(folder)
    source.add((2, 2, "a"), (3, 0, "a"))
    expected = [(date(2024, 1, 1), "a", 1), (date(2024, 1, 2), "a", 2), (date(2024, 1, 3), "a", 1)]
    assert source.run(folder) == expected
    assert source.run(folder) == expected


def test_late_rows_count_within_the_lateness_only(source, tmp_path):
    folder = f"{tmp_path}/run"
    source.add((10, 12, "a"))
    source.run(folder)
    # The watermark is 9 January noon: that day is still open, the 8th is closed.
    source.add((9, 1, "a"), (8, 23, "a"), (10, 1, "a"))
    assert source.run(folder) == [(date(2024, 1, 9), "a", 1), (date(2024, 1, 10), "a", 2)]


def test_a_trigger_written_again_replaces_its_folder(spark, source, tmp_path):
    """What repeating a trigger does to the counts; the engine's own repeat is not staged here."""
    folder = f"{tmp_path}/run"
    source.add((1, 1, "a"))
    expected = source.run(folder)
    again = spark.read.parquet(f"{folder}/counts/trigger=0").collect()
    spark.createDataFrame(again).write.mode("overwrite").parquet(f"{folder}/counts/trigger=0")
    assert sorted(tuple(row) for row in daily.read_counts(spark, folder).collect()) == expected


def test_state_has_the_partitions_of_the_session(spark, source, tmp_path):
    source.add((1, 1, "a"))
    folder = f"{tmp_path}/run"
    source.run(folder)
    stores = [p for p in Path(f"{folder}/checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert len(stores) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_days_are_those_of_the_stored_clock_in_any_zone(spark, source, tmp_path):
    source.add((1, 0, "a"), (1, 23, "a"), (2, 2, "a"))
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        found = source.run(f"{tmp_path}/run")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [(date(2024, 1, 1), "a", 2), (date(2024, 1, 2), "a", 1)]


def test_one_file_per_trigger_gives_the_same(source, tmp_path):
    for hour in range(3):
        source.add((1, hour, "a"), (2, hour, "b"))
    expected = [(date(2024, 1, 1), "a", 3), (date(2024, 1, 2), "b", 3)]
    assert source.run(f"{tmp_path}/all") == expected
    assert source.run(f"{tmp_path}/single", files_per_trigger=1) == expected


def test_a_history_in_any_order_goes_through_several_triggers(spark, source, tmp_path, monkeypatch):
    """Files whose times overlap lose nothing; each trigger reads one file in time order."""
    rows = [(1 + n % 20, n % 24, "ab"[n % 2]) for n in range(400)]
    for first in range(0, 400, 100):
        source.add(*rows[first : first + 100][::-1])
    folders = []
    monkeypatch.setattr(daily, "run_folder", lambda *_: folders.append(f"{tmp_path}/run") or folders[0])
    found = sorted(tuple(row) for row in daily.streamed_daily_counts(spark, source.root).collect())
    expected: dict = {}
    for day, _, kind in rows:
        expected[date(2024, 1, day), kind] = expected.get((date(2024, 1, day), kind), 0) + 1
    assert found == sorted((*key, n) for key, n in expected.items())
    triggers = sorted(int(p.name.split("=")[1]) for p in Path(f"{folders[0]}/counts").glob("trigger=*"))
    triggers = triggers[: daily.LEAST_FILES]  # a trigger without rows may follow
    assert triggers == list(range(daily.LEAST_FILES))
    days = [
        spark.read.parquet(f"{folders[0]}/counts/trigger={n}").agg({"day": "min"}).first()[0] for n in triggers
    ]
    assert days == sorted(days) and days[0] < days[-1]


def test_a_file_system_without_times_takes_all_files_at_once(spark, source, tmp_path, monkeypatch):
    source.add((3, 1, "a"), (1, 1, "a"), (2, 1, "a"))
    monkeypatch.setattr(daily, "write_in_time_order", lambda events, folder, files: events.write.parquet(f"{folder}/events.parquet"))
    monkeypatch.setattr(daily, "run_folder", lambda *_: f"{tmp_path}/run")
    assert daily.streamed_daily_counts(spark, source.root).count() == 3
