"""Writing tables: checked ingestion with counters, partition overwrites, snapshots, streams of upserts, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lithic.operators.tables import one_per_key, upserted, with_errors
from lithic.sources.staging import staged, unstage
from lithic.sources.tableset import Put, TableSet

#: Rows of a file that an append writes at most.
ROWS_PER_FILE = 1_000_000


@dataclass
class Counts:
    """What an ingestion saw; filled by Spark while it writes, without another pass."""

    seen: int
    invalid: int


def ingest(rows: DataFrame, checks: dict[str, Column], keys: list[str], order: list[Column], path: str, partition: list[str] = ()) -> Counts:
    """Append the valid rows, the first of each key in the given order, and count the rows seen and refused."""
    watch = Observation("ingest")
    checked = with_errors(rows, checks, "__errors")
    bad = F.size("__errors") > 0
    watched = checked.observe(watch, F.count("*").alias("seen"), F.count_if(bad).alias("invalid"))
    kept = one_per_key(watched.where(~bad), keys, order).drop("__errors")
    writer = kept.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return Counts(watch.get["seen"], watch.get["invalid"])


def refused(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that a check refuses, with the names of the checks."""
    return with_errors(rows, checks).where(F.size("errors") > 0)


def replaced(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Overwrite only the partitions that `rows` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def rebuilt(rows: DataFrame, path: str, dry_run: bool = False) -> int:
    """Write `rows` in place of the table in `path` and return how many they are; a dry run only counts them."""
    if dry_run:
        return rows.count()
    watch = Observation("rebuilt")
    rows.observe(watch, F.count("*").alias("n")).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return watch.get["n"]


def snapshot(files: DataFrame, version: str, stage: str, path: str) -> None:
    """Store a stage's file hashes under its version; keyed by path, so that new file ids do not matter."""
    rows = files.select("path", "content_hash").withColumns({"analysis_version": F.lit(version), "stage": F.lit(stage)})
    replaced(rows, path, ["analysis_version", "stage"])


def snapshot_of(spark: SparkSession, path: str, version: str, stage: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("analysis_version") == version) & (F.col("stage") == stage)).select("path", "content_hash")


def upsert_stream(stream: DataFrame, spark: SparkSession, path: str, keys: list[str], at: str, checkpoint: str):
    """Keep a table of the latest row per key from a stream: each batch rewrites the table beside it and then takes its place.

    Versions are numbered by batch, so a batch that runs again gives the same table.
    """

    def put(batch: DataFrame, number: int) -> None:
        before = number - 1
        old = spark.read.parquet(f"{path}/v={before}") if before >= 0 else batch.limit(0)
        upserted(old.select(batch.columns), batch, keys, at).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_parts(stream: DataFrame, spark: SparkSession, path: str, keys: list[str], at: str, checkpoint: str, parts: int = 64):
    """Keep a table of the latest row per key from a stream, in parts by hash of the key: a batch rewrites the parts it touches and no other.

    A key's row gives way to one of the same or a later `at`, within a batch and between batches, so late rows do not
    undo newer ones. A batch is one commit that carries its number, so one that runs again after a crash changes
    nothing. Read with TableSet(spark, path).read("rows").
    """
    tables = TableSet(spark, path)
    key = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")

    def put(batch: DataFrame, number: int) -> None:
        if tables.manifest()["note"].get("batch", -1) >= number:
            return
        newest = staged(one_per_key(batch, keys, [F.desc(at)]))
        touched = [r.part for r in newest.select(key.alias("part")).distinct().collect()]  # at most `parts`
        old = tables.read("rows", touched) if tables.has("rows") else newest.limit(0)
        both = one_per_key(old.select(newest.columns).withColumn("__new", F.lit(0)).unionByName(newest.withColumn("__new", F.lit(1))), keys, [F.desc(at), F.desc("__new")]).drop("__new")
        tables.commit([Put("rows", both, key, "parts", touched, keys)], {"batch": number})
        tables.vacuum(2)
        unstage(newest)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REPORTERS: dict[str, Callable[[DataFrame, str], None]] = {
    "json": lambda report, path: report.coalesce(1).write.mode("overwrite").json(path),
    "history": lambda report, path: report.withColumn("at", F.current_timestamp()).write.mode("append").json(path),
    "console": lambda report, _: report.show(100, truncate=False),
}


def report(rows: DataFrame, to: str, path: str = "") -> None:
    """Hand a small report to a reporter by name."""
    REPORTERS[to](rows, path)
