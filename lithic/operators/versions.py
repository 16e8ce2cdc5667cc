"""Analysis versions: their points, records and status maps in one set of tables, each change one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators.graphs import FULL_RATIO, change_summary, changes, preserved
from lithic.sources.tableset import Put, TableSet

#: A record: the version it grew from, and for each category its status, attempts, points and when that was.
RECORDS = "version string, parent string, status string, created_at timestamp, agent_status map<string, struct<status: string, attempts: int, points: long, at: timestamp>>"
STATUSES = ("running", "completed", "failed", "cancelled")


class Versions:
    """points (version, category, id, files array<string>, ...) in a part per version, files (path, content_hash) likewise, and records.

    Records are a row per version and few. Whatever is said to happen to points, files and a record happens in one
    commit: a step that dies leaves all three as they were.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = spark, TableSet(spark, folder)

    def records(self) -> DataFrame:
        """All versions, newest first."""
        if not self.tables.has("records"):
            return self.spark.createDataFrame([], RECORDS)
        return self.tables.read("records").orderBy(F.desc("created_at"), F.desc("version"))

    def record(self, version: str):
        """A version's record, None if there is none."""
        return self.records().where(F.col("version") == version).first()

    def latest_completed(self):
        return self.records().where("status = 'completed'").first()

    def current(self) -> str | None:
        """The version that is shown: the one switched to, else the latest completed one."""
        chosen = self.tables.manifest()["note"].get("current")
        if chosen:
            return chosen
        last = self.latest_completed()
        return last["version"] if last else None

    def points(self, version: str) -> DataFrame:
        return self.tables.read("points", [version])

    def files(self, version: str) -> DataFrame:
        return self.tables.read("files", [version])

    def _with_record(self, row: DataFrame) -> Put:
        """Records with one row put in, in place of the one of its version."""
        rows = row.select(*(F.col(c) for c in ("version", "parent", "status", "created_at", "agent_status")))
        if self.tables.has("records"):
            rows = self.tables.read("records").join(rows.select("version"), "version", "left_anti").select(rows.columns).unionByName(rows)
        return Put("records", rows, F.lit("0"))

    def _row(self, version: str, parent: str | None, status: str, at: Column, agents: Column) -> DataFrame:
        types = {f.name: f.dataType for f in self.spark.createDataFrame([], RECORDS).schema}
        made = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(parent).alias("parent"), F.lit(status).alias("status"), at.alias("created_at"), agents.alias("agent_status"))
        return made.select(*(F.col(n).cast(kind).alias(n) for n, kind in types.items()))

    def create(self, version: str, at, parent: str | None = None) -> int:
        """A running version without points."""
        if self.record(version) is not None:
            raise ValueError(f"{version} exists")
        return self.tables.commit([self._with_record(self._row(version, parent, "running", F.lit(at), F.lit(None)))])

    def complete(self, version: str, points: DataFrame, files: DataFrame, at) -> int:
        """Store a version's points and file hashes, count its categories, and mark it completed."""
        before = self.record(version)
        if before is None:
            raise ValueError(f"there is no {version}")
        own = points.withColumn("version", F.lit(version))
        counted = own.groupBy("category").agg(F.count("*").alias("n"))
        entry = F.struct(F.lit("success").alias("status"), F.lit(1).alias("attempts"), F.col("n").alias("points"), F.lit(at).cast("timestamp").alias("at"))
        agents = counted.agg(F.map_from_entries(F.collect_list(F.struct("category", entry.alias("s")))).alias("m"))  # a row per category
        row = self._row(version, before["parent"], "completed", F.lit(before["created_at"]), F.lit(None)).drop("agent_status").crossJoin(agents.withColumnRenamed("m", "agent_status"))
        part = F.lit(version)
        return self.tables.commit([Put("points", own, part, "parts", [version]), Put("files", files.select("path", "content_hash"), part, "parts", [version]), self._with_record(row)])

    def mark(self, version: str, category: str, status: str) -> int:
        """Set the status of one category of a version, as a run does that failed or succeeded later."""
        marked = F.transform_values("agent_status", lambda k, v: v.withField("status", F.when(k == category, status).otherwise(v["status"])))
        return self.tables.commit([self._with_record(self.records().where(F.col("version") == version).withColumn("agent_status", marked))])

    def end(self, version: str, status: str) -> int:
        """Mark a version failed or cancelled and drop its points and files, all at once."""
        if status not in ("failed", "cancelled"):
            raise ValueError(f"a version does not end as {status}")
        return self._drop(version, self._with_record(self.records().where(F.col("version") == version).withColumn("status", F.lit(status))))

    def delete(self, version: str) -> int:
        """Delete a version's record, points and files. The version that is shown cannot go."""
        if self.current() == version:
            raise ValueError(f"{version} is shown")
        return self._drop(version, Put("records", self.tables.read("records").where(F.col("version") != version), F.lit("0")))

    def _drop(self, version: str, records: Put) -> int:
        known = self.tables.manifest()["tables"]
        return self.tables.commit([records], drop={t: [version] for t in ("points", "files") if t in known})

    def switch(self, version: str) -> int:
        """Show a version; only a completed one can be."""
        row = self.record(version)
        if row is None or row["status"] != "completed":
            raise ValueError(f"{version} is not completed")
        return self.tables.commit([], {"current": version})

    def retry(self, category: str, files: DataFrame, analyse: Callable[[DataFrame], DataFrame], at, reach: Callable[[DataFrame], DataFrame] | None = None, force: bool = False) -> dict:
        """Analyse one category again where files changed, as a version that grows from the latest completed one.

        files (path, content_hash, ...) as they are now; those added or modified since that version, and what `reach`
        adds to the changed paths (path), go to `analyse`, which gives points like the version's. More than FULL_RATIO
        of the files changed: all go. Points of the category whose files are untouched stay, others of it are replaced,
        other categories' points are carried over. A category that succeeded is skipped unless `force`; a forced one, and one
        that the version has no status for, is analysed over all files. No points found
        counts as failed: the points stay as they were, and only the status says so. Everything is one commit, after
        the analysis; if that dies, the old version is as it was. Without a completed version: an error.
        """
        last = self.latest_completed()
        if last is None:
            raise ValueError("no version is completed")
        known = (last["agent_status"] or {}).get(category)
        if known and known["status"] == "success" and not force:
            return {"status": "skipped", "version": last["version"], "points": known["points"]}
        version = f"{last['version']}-retry-{category}"
        diff = changes(files.select("path", "content_hash"), self.files(last["version"]), "path", "content_hash")
        touched = diff.select("path")
        if reach is not None:
            touched = touched.union(reach(touched).select("path")).distinct()
        full = change_summary(diff, files).first()["full"]
        asked = files if full or known is None or force else files.join(touched, "path", "left_semi")
        affected = files.select("path").union(touched).distinct() if full or known is None or force else touched
        before = self.points(last["version"])
        fresh = analyse(asked).withColumns({"version": F.lit(version), "category": F.lit(category)}).select(before.columns)
        found = fresh.count()
        others = before.where(~F.col("category").eqNullSafe(category))
        own = before.where(F.col("category") == category)
        stay = preserved(own, affected, "files", version) if found else own
        rows = others.unionByName(stay).withColumn("version", F.lit(version)).select(before.columns)
        if found:
            rows = rows.unionByName(fresh)
        attempts = (known["attempts"] if known else 0) + 1
        entry = F.struct(F.lit("success" if found else "failed").alias("status"), F.lit(attempts).alias("attempts"), F.lit(found).cast("long").alias("points"), F.lit(at).cast("timestamp").alias("at"))
        record = self.tables.read("records").where(F.col("version") == last["version"])
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<status: string, attempts: int, points: long, at: timestamp>>"))
        rest = F.map_filter(F.coalesce("agent_status", none), lambda k, _: k != category)
        record = record.select(F.lit(version).alias("version"), F.lit(last["version"]).alias("parent"), F.lit("completed").alias("status"), F.lit(at).cast("timestamp").alias("created_at"), F.map_concat(rest, F.create_map(F.lit(category), entry)).alias("agent_status"))
        part = F.lit(version)
        self.tables.commit([Put("points", rows, part, "parts", [version]), Put("files", files.select("path", "content_hash"), part, "parts", [version]), self._with_record(record)])
        return {"status": "success" if found else "failed", "version": version, "points": found, "full": bool(full)}
