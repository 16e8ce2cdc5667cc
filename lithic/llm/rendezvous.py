"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number for every key, exponentially distributed with the shard's weight as its rate; the smallest
draw gets the record. A draw depends on key and shard alone, so a shard that is added takes records only into itself, a
shard that is removed or grows lighter gives up its own only, and a shard gets records in proportion to its weight.
Placing needs no shuffle and no state: it is one expression per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import shuffle_width, staged, text_or_empty, unused

#: Equal rows that one row of a table stands for at a time when their slots are numbered.
CHUNK = 4096
#: Hexadecimal digits of a digest that make a draw: 52 bits, exact as a double.
_DIGITS = 13


def key_text(column: str) -> Column:
    """The key as text; null is the text 'null'."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null"))


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def draws(key: Column, weights: Mapping[int, float]) -> Column:
    """array<struct<draw double, shard int>>: what each shard of positive weight draws for the key."""
    shards = F.array(*(F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items()) if w > 0))
    uniform = lambda s: (_number(F.md5(F.concat(key, F.lit(":"), s.cast("string")).cast("binary")), _DIGITS) + 1) / F.lit(float(16**_DIGITS))
    return F.transform(shards, lambda x: F.struct((-F.ln(uniform(x["shard"])) / x["weight"]).alias("draw"), x["shard"].alias("shard")))


def _winner(drawn: Column) -> Column:
    return F.array_min(drawn)["shard"]


def equal_weights(n: int) -> dict[int, float]:
    return dict.fromkeys(range(n), 1.0)


def assigned(docs: DataFrame, weights: Mapping[int, float], after: Mapping[int, float] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Every row of `docs` with `shard`, and with `grown_shard` under the weights `after` if given, in place of columns of those names.

    Rows that share a key share a shard. Null keys count as the text 'null'. Weights of 0 or less take part in nothing;
    without a positive weight: an error. An empty table gives no rows.
    """
    if not any(w > 0 for w in weights.values()) or (after is not None and not any(w > 0 for w in after.values())):
        raise ValueError("a shard of positive weight is needed")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "shard" and not (after is not None and c == "grown_shard")]
    if after is None:
        return docs.select(*keep, _winner(draws(key_text(id_col), weights)).alias("shard"))
    drawn = unused("drawn", docs)
    same = [s for s, w in weights.items() if w > 0]
    if all(after.get(s) == weights[s] for s in same):  # shards are only added: one set of draws serves both
        both = docs.select(*keep, draws(key_text(id_col), after).alias(drawn))
        old, new = F.filter(drawn, lambda x: x["shard"].isin(*same)), F.col(drawn)
        return both.select(*keep, _winner(old).alias("shard"), _winner(new).alias("grown_shard"))
    return docs.select(*keep, _winner(draws(key_text(id_col), weights)).alias("shard"), _winner(draws(key_text(id_col), after)).alias("grown_shard"))


def placed(docs: DataFrame, weights: Mapping[int, float], after: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, size, text_crc32, shard, slot[, grown_shard]); slots of a shard count from 0 without gaps.

    size is the UTF-8 bytes of the text and one; null has none, and the checksum 0 of no bytes. Slots go by the MD5 of
    (key, size, checksum), which spreads a shard, or a key that very many rows share, over buckets: a bucket's rows are
    numbered and shifted by the counts of the buckets before. Rows alike in all three are one row with a count until
    then, so repeated rows never meet in one task.
    """
    text = text_or_empty(text_col)
    rows = assigned(docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")), weights, after, "id")
    grown = ["grown_shard"] if after is not None else []
    digest = F.md5(F.concat_ws(":", key_text("id"), "size", "crc").cast("binary"))
    width = shuffle_width(docs.sparkSession)
    counted = rows.groupBy("id", "size", "crc", "shard", *grown).agg(F.count("*").alias("many")).withColumn("order", digest)
    counted = staged(counted.withColumn("bucket", (_number(F.col("order"), 7) * width / F.lit(16.0**7)).cast("int")))
    sizes = counted.groupBy("shard", "bucket").agg(F.sum("many").alias("many"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("shard", "bucket", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("shift"))
    within = Window.partitionBy("shard", "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("first", F.coalesce(F.sum("many").over(within), F.lit(0))).join(shifts, ["shard", "bucket"])
    # a row that stands for very many is dealt out before it is repeated
    chunks = first.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("many") - 1, F.lit(CHUNK)))).repartition(width, "order", "chunk")
    each = chunks.withColumn("k", F.explode(F.sequence("chunk", F.least(F.col("many") - 1, F.col("chunk") + CHUNK - 1))))
    return each.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("shift") + F.col("first") + F.col("k")).alias("slot"), *grown)


def moved(docs: DataFrame, before: Mapping[int, float], after: Mapping[int, float], id_col: str = "doc_id") -> DataFrame:
    """(shard, grown_shard, n): rows by where they are and where they go, for judging a change of weights."""
    return assigned(docs, before, after, id_col).groupBy("shard", "grown_shard").agg(F.count("*").alias("n"))


def write(docs: DataFrame, folder: str, weights: Mapping[int, float], id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write `docs` as Parquet under folder/shard=N, at most `rows_per_file` rows a file; tasks write what they read, so no shard passes one task."""
    assigned(docs, weights, id_col=id_col).write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(folder)
