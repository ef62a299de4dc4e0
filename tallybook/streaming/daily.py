"""Daily event counts as a stream.

A history is first written as files of ascending time, of a bounded number of rows each. The stream reads
one file a trigger, so no trigger and no repeat of one holds more than a file, and no row comes
later than rows of earlier files: none is behind the watermark, whatever the lateness.

The stream writes each trigger's changed days under the trigger's own number, and
``read_counts`` takes the newest version of each. Nothing is collected, repeating a
trigger after a failure overwrites its own folder, and the last days show up although
the watermark has not closed them.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampType

from tallybook.sources import SCHEMAS, read_table, run_folder

DAY = 86_400_000_000  # microseconds
#: Rows of a file in time order, and how many files there are at least.
FILE_ROWS, LEAST_FILES = 10_000_000, 2


def stream_events(
    spark: SparkSession, root: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The events table, ``{root}/events.parquet``, as a stream of its files.

    The path is written as a pattern because a streaming source refuses a single file's.
    Watermarks need a zoned timestamp. Declaring the column as one takes the stored
    microseconds as they are, so a day of the stream is a day of the stored clock in
    any session time zone.
    """
    schema = StructType(
        [
            StructField("ts", TimestampType()) if field.name == "ts" else field
            for field in SCHEMAS["events"]
        ]
    )
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{root}/event[s].parquet")


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """``day, event_type, n_events``.

    Rows more than ``lateness`` behind the newest of earlier triggers may be dropped.
    """
    stored_day = F.expr(f"unix_micros(span.start) div {DAY}").cast("int")
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("span"), "event_type")
        .agg(F.count("*").alias("n_events"))
        .select(F.date_from_unix_date(stored_day).alias("day"), "event_type", "n_events")
    )


def write_counts(counts: DataFrame, folder: str) -> StreamingQuery:
    """Start a stream over what is there now; it ends by itself."""

    def write(changed: DataFrame, trigger: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/counts/trigger={trigger}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's newest count.

    Triggers leave a folder each, so a stream that never ends needs them merged now and then.
    """
    return (
        spark.read.parquet(f"{folder}/counts")
        .groupBy("day", "event_type")
        .agg(F.max_by("n_events", "trigger").alias("n_events"))
    )


def write_in_time_order(events: DataFrame, folder: str, files: int) -> bool:
    """Write ``{folder}/events.parquet`` as files of ascending ``ts`` and of ascending age.

    A stream takes its files by their modification time. Where the file system does not keep the
    times given, this is false, and a stream must take all files at once.
    """
    path = f"{folder}/events.parquet"
    events.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(path)
    spark = events.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    written = [status.getPath() for status in system.listStatus(hadoop)]
    written = sorted((path for path in written if path.getName().startswith("part-")), key=lambda path: path.getName())
    oldest = min((system.getFileStatus(path).getModificationTime() for path in written), default=0)
    try:
        for place, path in enumerate(written):
            system.setTimes(path, oldest + 1000 * (place - len(written)), -1)
    except Py4JJavaError:  # not every file system can
        return False
    times = [system.getFileStatus(path).getModificationTime() for path in written]
    return all(one < other for one, other in zip(times, times[1:]))


def streamed_daily_counts(spark: SparkSession, root: str) -> DataFrame:
    """Run the stream over the table's history to its end and return the counts it wrote.

    The session sets the number of state partitions; the checkpoint keeps it.
    """
    folder = run_folder(spark, "daily-counts")
    events = read_table(spark, root, "events")
    files = max(LEAST_FILES, -(-events.count() // FILE_ROWS))
    ordered = write_in_time_order(events, folder, files)
    stream = stream_events(spark, folder, files_per_trigger=1 if ordered else None)
    write_counts(daily_counts(stream), folder).awaitTermination()
    return read_counts(spark, folder)
