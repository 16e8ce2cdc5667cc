"""What a change of files asks for: files that it reaches over calls and imports, and a node table kept up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators.graphs import FULL_RATIO, changes
from lithic.sources.parsers import nodes
from lithic.sources.staging import staged
from lithic.sources.tableset import Put, TableSet, bucket

#: Kinds of steps between files: to those that the file calls, that call it, that it imports, that import it.
KINDS = ("callee", "caller", "importee", "importer")
DEPTH = 3


def file_steps(nodes: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(a, b, kind): steps from file a to file b that nodes (id, file_id), calls and imports allow, each once.

    Calls without a callee, calls of nodes that are not there, and imports from outside lead nowhere.
    """
    of = nodes.select("id", "file_id").where("file_id is not null")
    ends = calls.select("caller_node_id", "callee_node_id").distinct()
    joined = ends.join(of.withColumnsRenamed({"id": "caller_node_id", "file_id": "a"}), "caller_node_id").join(of.withColumnsRenamed({"id": "callee_node_id", "file_id": "b"}), "callee_node_id")
    named = imports.select(F.col("importer_file_id").alias("a"), F.col("imported_file_id").alias("b")).where("a is not null and b is not null")
    step = lambda a, b, kind: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(kind).alias("kind"))
    ways = lambda df, there, back: df.where("a <> b").distinct().select(F.explode(F.array(step("a", "b", there), step("b", "a", back))).alias("s")).select("s.*")
    return ways(joined.select("a", "b"), "callee", "caller").union(ways(named, "importee", "importer"))


def propagated(files: DataFrame, nodes: DataFrame, calls: DataFrame, imports: DataFrame, changed: DataFrame, depth: int = DEPTH, depths: dict[str, int] | None = None) -> DataFrame:
    """(file_id, depth, kinds): files that a change reaches within `depth` steps, without the changed ones themselves.

    changed (file_id, change): what was deleted starts nothing. A file that is not among `files` (file_id) any more may
    be reached over its nodes, but leads no further. depths: the step up to which a kind is followed, where that is
    less than `depth`. kinds: those by which a file is reached in the fewest steps, in order. Steps are staged once;
    a round joins the files found last with them, so its work is what they touch, and rounds end when nothing is found.
    """
    steps = staged(file_steps(nodes, calls, imports))
    alive = files.select("file_id").distinct()
    front = staged(changed.where("change <> 'deleted'").select("file_id").distinct())
    known, found = front, None
    for step in range(1, depth + 1):
        kinds = [k for k in KINDS if step <= (depths or {}).get(k, depth)]
        leads = front.join(alive, "file_id", "left_semi")
        near = leads.join(steps.where(F.col("kind").isin(kinds)), leads.file_id == steps.a).groupBy(F.col("b").alias("file_id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
        fresh = staged(near.join(known, "file_id", "left_anti").select("file_id", F.lit(step).alias("depth"), "kinds"))
        found = fresh if found is None else found.union(fresh)
        if fresh.isEmpty():
            break
        front = fresh.select("file_id")
        known = known.union(front)
    return found if found is not None else front.select("file_id", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kinds")).limit(0)


@dataclass
class Update:
    """What an update did: the version committed (or left), files by change, parts rewritten of the parts there are, and whether all was parsed anew."""

    version: int
    added: int
    modified: int
    deleted: int
    parts: int
    of_parts: int
    full: bool


class NodeTable:
    """Nodes of parsed files, in parts by hash of the path, with the hashes of the files they were parsed from.

    `update` takes the files as they are now (path, language, content; paths unique, null content an error row as in a
    parse). It parses those whose hash is new, drops the nodes of those that changed or went, and rewrites the parts
    that these are in; nodes of other files in such parts are carried over, other parts are not read. Nodes and hashes
    are one commit, so an update that dies leaves nodes and hashes of before, and running it again does all its work.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 256):
        self.tables, self.n = TableSet(spark, folder), parts

    def nodes(self, version: int | None = None) -> DataFrame:
        return self.tables.read("nodes", version=version)

    def _part(self, path: str):
        return bucket(path, self.n)

    def update(self, files: DataFrame, full_ratio: float = FULL_RATIO) -> Update:
        """Bring the table to `files`; more than `full_ratio` of them changed, or no table yet: everything is parsed."""
        digest = F.sha2(F.concat_ws("\0", "language", F.coalesce("content", F.lit("\0"))), 256)
        hashes = staged(files.select("path", digest.alias("content_hash")))
        put_hashes = Put("files", hashes, F.lit("0"))
        if not self.tables.has("files"):
            version = self.tables.commit([put_hashes, Put("nodes", nodes(files), self._part("file_path"), order=["file_path"])])
            return Update(version, hashes.count(), 0, 0, len(self.tables.manifest()["tables"]["nodes"]["parts"]), self.n, True)
        diff = staged(changes(hashes, self.tables.read("files"), "path", "content_hash"))
        counted = {r.change: r["count"] for r in diff.groupBy("change").count().collect()}
        sizes = [counted.get(k, 0) for k in ("added", "modified", "deleted")]
        if not any(sizes):
            return Update(self.tables.manifest()["version"], 0, 0, 0, 0, self.n, False)
        if sum(sizes) > full_ratio * max(1, hashes.count()):
            version = self.tables.commit([put_hashes, Put("nodes", nodes(files), self._part("file_path"), order=["file_path"])])
            return Update(version, *sizes, self.n, self.n, True)
        # as many names as there are parts at most
        touched = [r.part for r in diff.select(self._part("path").alias("part")).distinct().collect()]
        fresh = nodes(files.join(diff.where("change <> 'deleted'").select("path"), "path", "left_semi"))
        carried = self.tables.read("nodes", touched).join(diff.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        rows = carried.select(fresh.columns).unionByName(fresh)
        version = self.tables.commit([put_hashes, Put("nodes", rows, self._part("file_path"), "parts", touched, ["file_path"])])
        return Update(version, *sizes, len(touched), self.n, False)
