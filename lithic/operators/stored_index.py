"""A full-text index that is kept: postings by word, document frequencies, words by document; updates add, searches read a part per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions.text import words
from lithic.sources.staging import staged, unstage
from lithic.sources.tableset import Put, TableSet, bucket

PARTS = 64


class StoredIndex:
    """Four tables in one folder, changed by one commit each time.

    postings (word, id, v) and frequencies (word, n) lie in parts by hash of the word, documents (id, v, words) by hash
    of the id, gone (id, v) in one part. v is the number of the update that wrote a row. An update writes the postings
    of its documents and marks what earlier updates wrote for them, and for deleted ids, as gone; it rewrites no
    posting. `compact` writes what is live anew. Null ids are left out; of rows that share an id all words count.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.tables, self.n = spark, TableSet(spark, folder), parts

    def _known(self) -> int:
        return self.tables.manifest()["note"].get("update", 0)

    def parts_of(self, texts: list[str]) -> list[str]:
        """Names of the parts that hold words; one row per word is hashed, by Spark's own function."""
        if not texts:
            return []
        rows = self.spark.createDataFrame([(t,) for t in texts], "word string").select(bucket("word", self.n).alias("part"))
        return sorted({r.part for r in rows.collect()})

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, v, ...) that no later update replaced or deleted."""
        gone = self.tables.read("gone").groupBy("id").agg(F.max("v").alias("gone_v"))
        return rows.join(gone, "id", "left").where("gone_v is null or v > gone_v").drop("gone_v")

    def update(self, changed: DataFrame | None, deleted: DataFrame | None, id_col: str, columns: list[str]) -> int:
        """Take in documents that are new or rewritten, and ids that are deleted; an id in both is rewritten. Returns the version."""
        number = self._known() + 1
        empty = self.spark.createDataFrame([], "id long, words array<string>")
        if changed is not None:
            listed = changed.select(F.col(id_col).alias("id"), words(F.concat_ws(" ", *columns)).alias("words")).where("id is not null")
            documents = staged(listed.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")))
        else:
            documents = empty
        fresh = documents.select(F.explode("words").alias("word"), "id")
        v = F.lit(number).alias("v")
        stale = documents.select("id")
        if deleted is not None:
            stale = stale.union(deleted.select(F.col(id_col).alias("id")).where("id is not null")).distinct()
        counts = fresh.select("word", F.lit(1).alias("n"))
        puts = [
            Put("postings", fresh.select("word", "id", v), bucket("word", self.n), "append", order=["word", "id"]),
            Put("documents", documents.select("id", v, "words"), bucket("id", self.n), "append", order=["id"]),
        ]
        if number > 1:
            stale = staged(stale)
            touched = [r.part for r in stale.select(bucket("id", self.n).alias("part")).distinct().collect()]  # at most as many as parts
            old = self._live(self.tables.read("documents", touched)).join(stale, "id", "left_semi")
            counts = counts.union(old.select(F.explode("words"), F.lit(-1)))
            puts.append(Put("gone", stale.select("id", F.lit(number - 1).alias("v")), F.lit("0"), "append"))
        else:
            puts.append(Put("gone", self.spark.createDataFrame([], documents.select("id", v).schema), F.lit("0")))
        frequencies = counts.groupBy("word").agg(F.sum("n").alias("n")).where("n <> 0")
        puts.append(Put("frequencies", frequencies, bucket("word", self.n), "append", order=["word"]))
        version = self.tables.commit(puts, {"update": number})
        unstage(documents)
        return version

    def compact(self) -> int:
        """Write live rows anew, without what is gone, as one version."""
        gone = self.tables.read("gone")
        frequencies = self.tables.read("frequencies").groupBy("word").agg(F.sum("n").alias("n")).where("n <> 0")
        return self.tables.commit([
            Put("postings", self._live(self.tables.read("postings")).select("word", "id", "v"), bucket("word", self.n), order=["word", "id"]),
            Put("documents", self._live(self.tables.read("documents")).select("id", "v", "words"), bucket("id", self.n), order=["id"]),
            Put("frequencies", frequencies, bucket("word", self.n), order=["word"]),
            Put("gone", gone.limit(0), F.lit("0")),
        ])

    def postings(self, asked: list[str] | None = None) -> DataFrame:
        """(word, id) of the words asked for, from their parts alone; of all words if none is named."""
        if asked is None:
            return self._live(self.tables.read("postings")).select("word", "id")
        found = self.tables.read("postings", self.parts_of(asked)).where(F.col("word").isin(asked))
        return self._live(found).select("word", "id")

    def frequency(self, asked: list[str]) -> DataFrame:
        """(word, n): documents that hold each word asked for; a word that none holds does not appear."""
        found = self.tables.read("frequencies", self.parts_of(asked)).where(F.col("word").isin(asked))
        return found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")

    def search(self, query: list[str], every: bool = False) -> DataFrame:
        """(id, hits): documents with any of the words, or with every one."""
        asked = sorted({w.lower() for w in query if w})
        found = self.postings(asked).groupBy("id").agg(F.count("*").alias("hits"))
        return found.where(F.col("hits") == len(asked)) if every else found

    def ranked(self, query: list[str]) -> DataFrame:
        """(id, hits, weight): hits and the sum of the words' inverse document frequencies, ln((N + 1) / n)."""
        asked = sorted({w.lower() for w in query if w})
        total = self._live(self.tables.read("documents").select("id", "v")).count()
        weight: Column = F.ln(F.lit(float(total + 1)) / F.col("n"))
        weights = F.broadcast(self.frequency(asked).select("word", weight.alias("w")))  # a row per word asked for
        return self.postings(asked).join(weights, "word").groupBy("id").agg(F.count("*").alias("hits"), F.sum("w").alias("weight"))
