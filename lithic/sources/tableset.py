"""Tables of Parquet parts whose contents numbered manifests list, so that a commit is seen as a whole or not at all.

A part is a folder of files with one value of an expression: a hash bucket, a version. A commit writes new folders,
then a manifest that names, for every table, the folders of each part: those it keeps from the manifest before and the
new ones. Parts that a commit leaves alone are neither read nor written. Whatever dies before the manifest is in place
leaves the manifest before as it was; folders that no kept manifest names go with `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.sources.staging import file_system, shuffles_cleaned

_PART = "_part"
ROWS_PER_FILE, SPREAD = 1_000_000, 8


def bucket(column: str, n: int) -> Column:
    """The hash bucket of a column's value, as a part's name."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n)).cast("string")


@dataclass
class Put:
    """Rows for a table: in place of all its parts, of the parts named, or (append) beside what the parts hold.

    part: a string, never null, for every row. order: columns that files are sorted by.
    """

    table: str
    rows: DataFrame
    part: Column
    mode: str = "all"
    parts: Iterable[str] = ()
    order: list[str] = field(default_factory=list)


class TableSet:
    """Tables in `folder`. One writer at a time: of two that commit onto the same manifest the second gets an error."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.folder}/manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version: {"tables": {name: {"schema", "parts"}}, "note"}."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "note": {}}
        number = known[-1] if version is None else version
        fs, at = file_system(self.spark, f"{self.folder}/manifests/{number:08d}.json")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def read(self, table: str, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """A table, or only its parts of the names given: other folders are not even listed."""
        known = self.manifest(version)["tables"][table]
        wanted = known["parts"] if parts is None else {p: known["parts"][p] for p in dict.fromkeys(parts) if p in known["parts"]}
        schema = T.StructType.fromJson(known["schema"])
        folders = [f"{self.folder}/{f}" for own in wanted.values() for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def has(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def commit(self, puts: list[Put], note: dict | None = None, drop: dict[str, Iterable[str]] | None = None) -> int:
        """Write the puts and drop the parts of tables named, as one new version; `note` is merged into the note before."""
        before = self.manifest()
        tables = {name: {"schema": t["schema"], "parts": dict(t["parts"])} for name, t in before["tables"].items()}
        for put in puts:
            made = self._write(put)
            known = tables.setdefault(put.table, {"schema": None, "parts": {}})
            known["schema"] = json.loads(put.rows.schema.json())
            if put.mode == "all":
                known["parts"] = {}
            elif put.mode == "parts":
                named = set(put.parts)
                if strange := set(made) - named:
                    raise ValueError(f"rows of parts that are not replaced: {sorted(strange)[:5]}")
                known["parts"] = {p: f for p, f in known["parts"].items() if p not in named}
            elif put.mode != "append":
                raise ValueError(f"unknown mode {put.mode}")
            for part, folder in made.items():
                known["parts"][part] = [*known["parts"].get(part, []), folder]
        for name, parts in (drop or {}).items():
            for part in parts:
                tables[name]["parts"].pop(part, None)
        after = {"version": before["version"] + 1, "tables": tables, "note": before["note"] | (note or {})}
        self._publish(after)
        return after["version"]

    def _write(self, put: Put) -> dict[str, str]:
        """{part: folder} of what a put writes. Rows of a part go to SPREAD tasks at most, so a part may hold very many."""
        at = f"data/{uuid.uuid4().hex}"
        plain = [f.name for f in put.rows.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
        salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.lit(SPREAD)) if plain else F.lit(0)
        # parts are named after the shuffle, which then carries the rows alone
        rows = put.rows.repartition(put.part, salt).withColumn(_PART, put.part).sortWithinPartitions(_PART, *put.order)
        with shuffles_cleaned(self.spark):
            rows.write.partitionBy(_PART).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.folder}/{at}")
        fs, root = file_system(self.spark, f"{self.folder}/{at}")
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n.split("=", 1)[1]): f"{at}/{n}" for n in names if n.startswith(f"{_PART}=")}

    def _publish(self, manifest: dict) -> None:
        folder = f"{self.folder}/manifests"
        fs, at = file_system(self.spark, f"{folder}/{manifest['version']:08d}.json")
        _, beside = file_system(self.spark, f"{folder}/.{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(at) or not fs.rename(beside, at):
            fs.delete(beside, False)
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    def rollback(self, version: int) -> int:
        """Make an earlier version the newest one again, as a version of its own."""
        wanted = self.manifest(version)
        wanted["version"] = self.manifest()["version"] + 1
        self._publish(wanted)
        return wanted["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest `keep` manifests and every data folder that none of these names; returns folders deleted."""
        known = self.versions()
        for old in known[:-keep]:
            fs, at = file_system(self.spark, f"{self.folder}/manifests/{old:08d}.json")
            fs.delete(at, False)
        live = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for own in t["parts"].values() for f in own}
        gone = 0
        fs, data = file_system(self.spark, f"{self.folder}/data")
        for commit in fs.listStatus(data) if fs.exists(data) else []:
            parts = fs.listStatus(commit.getPath())
            own = [(f"data/{commit.getPath().getName()}/{p.getPath().getName()}", p) for p in parts if p.isDirectory()]
            if not any(name in live for name, _ in own):
                fs.delete(commit.getPath(), True)
                gone += max(1, len(own))
                continue
            for name, p in own:
                if name not in live:
                    fs.delete(p.getPath(), True)
                    gone += 1
        return gone
