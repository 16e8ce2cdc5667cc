"""What the training-data operators share: staged tables, connected components, column access."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STAGED: list[tuple[SparkSession, str]] = []


def ship(module: str) -> None:
    """Send a module's functions to executors by value, so that executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: Setting by which Spark deletes an execution's shuffle files as soon as it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none: a temporary folder if driver and executors are one process (tests), else an error,
    since executors elsewhere would write to disks that nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lithic-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives the loss of any executor.

    The shuffle files of the write go with it. The folder goes when `unstage` is called or the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append((spark, path))
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later step reads; other tables are left alone."""
    path = getattr(df, "staged_at", None) if "staged_at" not in df.columns else None
    if path and (df.sparkSession, path) in _STAGED:
        _STAGED.remove((df.sparkSession, path))
        delete(df.sparkSession, path)


def _drop_staged() -> None:
    for spark, path in _STAGED:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """`name`, longer by underscores if `df` has such a column."""
    while name in df.columns:
        name += "_"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Rows kept from training: crc32 of the id as text, by remainder. A null id counts as the text 'null'."""
    as_text = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    return (F.crc32(as_text.cast("binary")) % modulus) == remainder


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): one row (node, root), root the smallest node reachable.

    Alternating large-star and small-star passes. Each pass is two aggregations with map-side combine and a join of
    the edges with one row per node, so a node with very many edges is split like any skewed join side. Every round
    is a staged table; rounds end when count and hash sums of the pairs stay. Nodes without an edge to another node do
    not appear. The last table stays for the result to read.
    """

    def stars(now: DataFrame) -> DataFrame:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        return large.join(low, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()

    def mark(now: DataFrame) -> tuple:
        hashed = F.xxhash64("u", "v")
        row = now.agg(F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(F.shiftright(hashed, 20)).alias("s")).first()
        return row["n"], row["x"], row["s"]

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = mark(now)
    while seen[0]:
        after = staged(stars(now))
        unstage(now)
        now, before = after, seen
        seen = mark(now)
        if seen == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def with_columns_of_text(df: DataFrame, text_col: str, make, fields: list[tuple[str, str]], slice_chars: int = 8_000_000) -> DataFrame:
    """Append `fields` (name, type) to every row: `make` maps a list of texts (null as "") to one Arrow array per field.

    `make` sees at most `slice_chars` characters at a time, or one text if that is longer.
    """
    at_column = df.columns.index(text_col)
    added = spark_schema(fields)
    names = [*df.columns, *(name for name, _ in fields)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in text_slices(batch, at_column, slice_chars):
                made = make(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return numbered(df).mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def numbered(df: DataFrame) -> DataFrame:
    """`df` with plain column names, since mapInArrow does not take names with dots."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def text_slices(batch, column: int, slice_chars: int):
    """(rows, texts) of a batch in slices of at most `slice_chars` characters or one row; null texts are ""."""
    import pyarrow.compute as pc

    chars = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    start = 0
    while start < len(chars):
        end, total = start, 0
        while end < len(chars) and (end == start or total + chars[end] <= slice_chars):
            total += chars[end]
            end += 1
        part = batch.slice(start, end - start)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        start = end


def spark_schema(fields: list[tuple[str, str]]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{name}` {kind}" for name, kind in fields))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most `most` labelled documents outside the held-out fold, those of the smallest hash.

    The ids are few by construction (`most`), so they are broadcast and the documents are read without a shuffle.
    Labels that are null and ids that are null teach nothing.
    """
    usable = labels.where(~held_out(id_col, modulus, remainder) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id")


ship(__name__)
