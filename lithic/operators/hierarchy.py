"""Trees of nodes from their spans or their parents, numbered so that descendants are a range of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators.frameworks import tagged

# Joins here have hints: sizes are estimated from files that nodes may be exploded from, and a broadcast of them fills the driver.

#: Share of nodes without a parent from which on a file's parents are taken from spans.
ORPHANS = 0.5
_TREE = "file string, id string, parent_id string, depth int, entry long, exit long"
_LAST = (1 << 31) - 1


class _Spans:
    """The sweep: rows come by start, then end (last first), then id; open spans lie on a stack, each inside the one below.

    A span that ends before the one that comes is done: whatever comes later and lies inside both lies inside the
    newer one. So a row costs a push and a pop, and only open spans are kept.
    """

    def __init__(self, out: list):
        self.open: list[tuple] = []
        self.next, self.out = 0, out

    def add(self, file: str, ident: str, parent: str | None, end: tuple) -> None:
        while self.open and self.open[-1][-1] < end:
            self._close()
        above = self.open[-1][1] if self.open else None
        self.open.append((file, ident, above, len(self.open), self.next, end))
        self.next += 1

    def _close(self) -> None:
        *row, _ = self.open.pop()
        self.out.append((*row, self.next - 1))

    def finish(self) -> None:
        while self.open:
            self._close()


class _Parents:
    """A file's rows with parents that are given: kept until the file ends, then walked from the roots, children in order."""

    def __init__(self, out: list):
        self.rows: list[tuple] = []
        self.out = out

    def add(self, file: str, ident: str, parent: str | None, end: tuple) -> None:
        self.rows.append((file, ident, parent))

    def finish(self) -> None:
        known = {r[1] for r in self.rows}
        children: dict[str | None, list[tuple]] = {}
        for r in self.rows:
            children.setdefault(r[2] if r[2] in known else None, []).append(r)
        number, seen = 0, set()
        todo = [(r, 0, False, 0) for r in reversed(children.get(None, ()))]
        while todo:
            r, depth, leaving, entry = todo.pop()
            if leaving:
                self.out.append((r[0], r[1], r[2] if r[2] in known else None, depth, entry, number - 1))
                continue
            if r[1] in seen:
                continue
            seen.add(r[1])
            todo.append((r, depth, True, number))
            number += 1
            todo.extend((c, depth + 1, False, 0) for c in reversed(children.get(r[1], ())) if c[1] != r[1])
        self.out.extend((r[0], r[1], r[2], None, None, None) for r in self.rows if r[1] not in seen)


def tree(nodes: DataFrame, orphans: float = ORPHANS) -> DataFrame:
    """(file_id, id, parent_id, depth, entry, exit) of nodes (file_id, id, parent_id, start_line, start_column, end_line, end_column).

    A file's given parents hold if less than `orphans` of its nodes have none; else all its parents are the innermost
    spans that hold them (of equal spans the one of the next smaller id). entry numbers a file's nodes from 0, parents
    first and siblings by start; descendants of a node have the entries after its own up to its exit. A parent that is
    not in the file makes a root; nodes whose given parents go in a circle keep them and have no depth, entry or exit.
    Null columns are the line's begin and end, null ids and files are left out, of a repeated id in a file with given
    parents the first row counts. A file is read in one task: by spans only its open ones are kept, by given parents
    its ids.
    """
    whole = nodes.where("file_id is not null and id is not null")
    share = whole.groupBy("file_id").agg((F.count_if(F.col("parent_id").isNull()) < F.count("*") * orphans).alias("given"))
    kept = whole.join(share.hint("merge"), "file_id").select(
        F.col("file_id").cast("string").alias("file"), F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), "given",
        F.col("start_line").alias("a"), F.coalesce("start_column", F.lit(0)).alias("b"), F.col("end_line").cast("long").alias("y"), F.coalesce(F.col("end_column").cast("long"), F.lit(_LAST)).alias("z"), F.col("id").alias("tie"),
    )
    dealt = kept.repartition("file").sortWithinPartitions("file", "a", "b", F.desc("y"), F.desc("z"), "tie").drop("a", "b", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("file", "id", "parent_id", "depth", "entry", "exit")
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
        out: list[tuple] = []
        file, sweep = None, None
        for batch in batches:
            for f, ident, parent, given, y, z in zip(*(batch.column(c).to_pylist() for c in ("file", "id", "parent_id", "given", "y", "z"))):
                if f != file:
                    if sweep:
                        sweep.finish()
                    file, sweep = f, (_Parents if given else _Spans)(out)
                sweep.add(f, ident, parent, (y, z))
            yield frame(out)
            out.clear()
        if sweep:
            sweep.finish()
        yield frame(out)

    made = dealt.mapInArrow(run, _TREE)
    of = lambda column, like: F.col(column).cast(nodes.schema[like].dataType).alias(like)
    return made.select(of("file", "file_id"), of("id", "id"), of("parent_id", "parent_id"), "depth", "entry", "exit")


def with_descendant(numbered: DataFrame, wanted: str, out: str) -> DataFrame:
    """`numbered` (file_id, entry, exit, ...) with whether a node has a descendant for which the column `wanted` holds.

    Wanted nodes are counted up to every entry; the count at a node's exit, found by an equi-join, less that at its own
    entry is the number of its descendants. Nodes without an entry have none.
    """
    order = Window.partitionBy("file_id").orderBy("entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = numbered.withColumn("__n", F.sum(F.coalesce(F.col(wanted).cast("int"), F.lit(0))).over(order))
    ends = counted.where("entry is not null").select(F.col("file_id").alias("__file"), F.col("entry").alias("__entry"), F.col("__n").alias("__end"))
    joined = counted.join(ends.hint("merge"), (F.col("file_id") == F.col("__file")) & (F.col("exit") == F.col("__entry")), "left")
    return joined.withColumn(out, F.coalesce(F.col("__end") > F.col("__n"), F.lit(False))).drop("__n", "__file", "__entry", "__end")


def tagged_in_tree(nodes: DataFrame) -> DataFrame:
    """`nodes` tagged as by name, but react-component only for functions that hold a JSX element or an import of React, however deep.

    nodes: as for `tree`, with language, node_type, name, annotations, tags, signature. A call of createContext is a
    react-context. Tags that a node brings along stay.
    """
    script = F.col("language").isin("typescript", "javascript")
    seen = (F.col("node_type") == "jsx_element") | ((F.col("node_type") == "import") & F.lower("name").contains("react"))
    numbered = tree(nodes).drop("parent_id").join(nodes.hint("merge"), ["file_id", "id"]).withColumn("__react", seen)
    marked = with_descendant(numbered, "__react", "__holds").drop("__react", "entry", "exit", "depth")
    own = F.coalesce("__own", F.array().cast("array<string>"))
    named = tagged(marked.withColumn("__own", F.col("tags")))
    kept = F.filter("tags", lambda t: (t != "react-component") | F.array_contains(own, t) | (F.col("__holds") & (F.col("node_type") == "function")) | ~script)
    context = F.when(script & (F.col("node_type") == "call") & (F.trim(F.substring_index("name", "(", 1)) == "createContext"), F.array(F.lit("react-context"))).otherwise(F.array().cast("array<string>"))
    return named.withColumn("tags", F.array_union(kept, context)).select(nodes.columns)
