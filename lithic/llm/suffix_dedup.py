"""Exact removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes covers it that also starts earlier. Windows of `length` bytes are grouped so
that equal windows meet: each window is filed under the gram with the smallest hash among those it holds (its anchor),
which depends on its bytes alone. Grams that anchor only once cannot belong to a repeat and their windows are dropped
before any text moves. What is left moves as slices (the windows that share an anchor, overlapping text once); equal
slices collapse to the earliest. Windows of different slices of one gram are compared by a `SuffixFamily`: batches in
document order get a suffix array, are merge-scanned against the existing levels, and levels of equal size merge.
`StoredFamily` does the same for batches of documents that come one after the other, with levels kept in a folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import delete, numbered, ship, staged, text_or_empty, text_slices, unstage, unused

ship(__name__)

LENGTH = 100
GRAM = 24
#: Windows of a document that are hashed at a time (their number must fit the 20 low bits of a packed hash).
_CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
#: Characters of text whose slices are compared before they leave a task.
_GO = 8_000_000
#: Grams in more documents than these, or with four times as many places, are dealt out instead: windows whose starts lie
#: in one STRIDE before the gram go where the bytes that all of them hold send them; beyond HOTTER, each window by itself.
HOT, HOTTER, STRIDE = 1 << 14, 1 << 20, 19
#: Slices of complete grams that are compared together, and those in one batch of the family.
GROUP, BATCH = 1 << 13, 1 << 11
_BASE = 0x5BD1E995_9E3779B1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixFamily:
    """Suffix arrays of batches of text seen so far, in levels that at least halve in size.

    A level is a text and the starts of its distinct windows of `length` bytes, in the order of the windows. `add` takes
    a batch and tells which of its windows occur earlier, in the batch or before. A new batch is scanned along each
    level in order, and levels of like size merge in one pass; both see `block` windows of a level at a time.
    """

    def __init__(self, length: int = LENGTH, block: int = 1 << 16):
        self.length, self.block = length, block
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _windows(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=f"S{self.length}")
        windows = np.lib.stride_tricks.sliding_window_view(text, self.length)[starts]
        return np.ascontiguousarray(windows).view(f"S{self.length}").ravel()

    def _places(self, level: tuple[np.ndarray, np.ndarray], ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows in order: how many of the level's come before each, and whether it is one of them."""
        text, order = level
        before, there = np.full(len(ranked), len(order)), np.zeros(len(ranked), dtype=bool)
        done = 0
        for at in range(0, len(order), self.block):
            part = self._windows(text, order[at : at + self.block])
            end = int(np.searchsorted(ranked, part[-1], "right"))
            place = np.searchsorted(part, ranked[done:end])
            before[done:end] = at + place
            there[done:end] = part[place] == ranked[done:end]
            done = end
        return before, there

    def add(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """text: the batch's bytes; starts: of its windows, in document order. True for windows that occur earlier."""
        windows = self._windows(text, starts)
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        seen = np.zeros(len(ranked), dtype=bool)
        seen[1:] = ranked[1:] == ranked[:-1]
        for level in self.levels:
            seen |= self._places(level, ranked)[1]
        if not seen.all():
            self.levels.append((text, starts[order[~seen]]))
        while len(self.levels) > 1 and len(self.levels[-2][1]) < 2 * len(self.levels[-1][1]):
            self.levels.append(self._merged(*(self.levels.pop() for _ in range(2))))
        out = np.zeros(len(ranked), dtype=bool)
        out[order] = seen
        return out

    def _merged(self, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        small, large = sorted((one, other), key=lambda level: len(level[1]))
        places = [self._places(large, self._windows(small[0], small[1][at : at + self.block]))[0] for at in range(0, len(small[1]), self.block)]
        return np.concatenate((large[0], small[0])), np.insert(large[1], np.concatenate(places), small[1] + len(large[0]))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on: sums of 8 and 16 bytes by doubling, then mixed."""
    powers = [np.uint64(pow(_BASE, 1 << k, 1 << 64)) for k in range(4)]
    sums, eight = data.astype(np.uint64) + np.uint64(1), None
    for k, power in enumerate(powers):
        if k == 3:
            eight = sums
        sums = sums[: -(1 << k)] * power + sums[1 << k :]
    n = len(data) - GRAM + 1
    out = sums[:n] * powers[3] + eight[16 : 16 + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def anchors(raw: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, gram, place) per run of windows with one anchor: the window starts of the run, the anchor's hash and start."""
    data, span = np.frombuffer(raw, dtype=np.uint8), length - GRAM + 1
    for at in range(0, len(data) - length + 1, _CHUNK):
        end = min(at + _CHUNK, len(data) - length + 1)
        grams = _gram_hashes(data[at : end + length - 1])
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        n = 1
        while 2 * n <= span:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        least = np.minimum(least[: end - at], least[span - n : span - n + end - at])
        place = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        yield first + at, last + at, grams[place[first]].view(np.int64), place[first] + at


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per gram and part of a batch: (gram, id, places, more); more: packed ids of the other texts that have it, not null if it came more than once."""
    for batch in batches:
        for part, texts in text_slices(batch, 1, _GO):
            ids = part.column(0).to_numpy()
            grams, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, text in enumerate(texts):
                for _, _, gram, _ in anchors(text.encode("utf-8", "replace")):
                    grams.append(gram)
                    owners.append(np.full(len(gram), ids[k]))
            gram, owner = np.concatenate(grams), np.concatenate(owners)
            order = np.lexsort((owner, gram))
            gram, owner = gram[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(gram))
            more: list[bytes | None] = [None] * len(first)
            for k in np.flatnonzero(ends - first > 1).tolist():
                own = owner[first[k] : ends[k]]
                more[k] = np.unique(own)[1:].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(owner[first]), pa.array(ends - first), pa.array(more, pa.binary())], names=["gram", "id", "places", "more"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gram, heat) for grams that came more than once; heat 1 beyond HOT, 2 beyond HOTTER. Rows come sorted by gram."""
    open_gram, held, many, spots, flowing = None, [], 0, 0, False
    beyond = lambda bound: many > bound or spots > 4 * bound

    def out(parts: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        sizes = [len(x[1]) for x in parts]
        columns = (
            np.concatenate([np.zeros(0, np.int64), *(x[1] for x in parts)]), np.repeat(np.array([x[0] for x in parts], dtype=np.int64), sizes),
            np.repeat(np.array([x[2] for x in parts], dtype=np.int32), sizes),
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "gram", "heat"])

    for batch in batches:
        gram, ids, places = (batch.column(k).to_numpy() for k in range(3))
        more = batch.column(3)
        has = more.is_valid().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(gram))
        single = (ends - first == 1) & ~has[first]
        single[-1:] = single[:1] = False  # may go on in the batches beside this one
        parts = []
        for k in np.flatnonzero(~single).tolist():
            a, b = int(first[k]), int(ends[k])
            if gram[a] != open_gram:
                if spots > 1:
                    parts += [(open_gram, x, int(beyond(HOT))) for x in held]
                open_gram, held, many, spots, flowing = int(gram[a]), [], 0, 0, False
            own = [ids[a:b], *(np.frombuffer(more[i].as_py(), dtype=np.int64) for i in range(a, b) if has[i])]
            held += own
            many += sum(map(len, own))
            spots += int(places[a:b].sum())
            flowing = flowing or beyond(HOTTER)
            if flowing:
                parts += [(open_gram, x, 2) for x in held]
                held = []
        if parts:
            yield out(parts)
    if spots > 1 and held:
        yield out([(open_gram, x, int(beyond(HOT))) for x in held])


def _dealt(raw: bytes, first: int, last: int, place: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, key): windows first..last of an anchor at `place`, `width` at a time counted back from it.

    Equal windows start equally far before their anchor and hold the same bytes, so they have the same key.
    """
    for latest in range(place - (place - last) // width * width, first - 1, -width):
        common = raw[latest : latest - width + 1 + LENGTH]
        key = hashlib.blake2b(common, digest_size=8, salt=(place - latest).to_bytes(2, "little")).digest()
        yield max(first, latest - width + 1), min(last, latest), int.from_bytes(key, "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
    """(key, slice, id, tie, lo, n) of windows with a repeated anchor; without slice where an equal one of the same part comes earlier.

    every: of all windows, whatever their anchors.
    """
    for batch in batches:
        for part, texts in text_slices(batch, 0, _GO):
            ids, ties = part.column(1).to_numpy(), part.column(2).to_numpy()
            least: dict[bytes, tuple[int, int, int, int]] = {}
            rows: list[tuple[int, bytes | None, int, int, int, int]] = []
            for k, text in enumerate(texts):
                raw, id_, tie = text.encode("utf-8", "replace"), int(ids[k]), int(ties[k])
                lists = () if every else [np.sort(np.array(part.column(c)[k].as_py() or [], dtype=np.int64)) for c in (3, 4, 5)]
                for first, last, gram, place in anchors(raw):
                    found = [(a, b, g, 0, 0) for a, b, g in zip(first.tolist(), last.tolist(), gram.tolist())] if every else []
                    for of, width in zip(lists, (0, STRIDE, 1)):
                        if len(of):
                            at = np.flatnonzero(of[np.minimum(np.searchsorted(of, gram), len(of) - 1)] == gram)
                            found += [(a, b, g, p, width) for a, b, g, p in zip(first[at].tolist(), last[at].tolist(), gram[at].tolist(), place[at].tolist())]
                    for a, b, g, p, width in found:
                        for lo, hi, key in _dealt(raw, a, b, p, width) if width else ((a, b, g),):
                            piece = raw[lo : hi + LENGTH]
                            now = (id_, tie, lo, key)
                            before = least.get(piece)
                            if before is None:
                                least[piece] = now
                            elif before != now:  # equal only for rows of one document
                                late = max(before, now)
                                least[piece] = min(before, now)
                                # needs no comparison any more: goes where its place sends it, not to the hot key
                                rows.append((hash(late[:3]), None, *late[:3], len(piece)))
            rows += [(v[3], piece, *v[:3], len(piece)) for piece, v in least.items()]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "slice", "id", "tie", "lo", "n"])


def _family_cuts(slices: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int, int, int]]:
    """(age, id, tie, lo, n) of the repeated parts of slices (age, id, tie, lo, bytes)."""
    family, out = SuffixFamily(), []
    slices = sorted(slices, key=lambda s: s[:4])
    for at in range(0, len(slices), BATCH):
        part = slices[at : at + BATCH]
        text = np.frombuffer(b"".join(s[4] for s in part), dtype=np.uint8)
        sizes = np.array([len(s[4]) for s in part])
        count = sizes - LENGTH + 1
        begins = np.cumsum(sizes) - sizes
        before = np.cumsum(count) - count
        place = np.arange(count.sum()) - np.repeat(before - begins, count)
        seen = family.add(text, place)
        owner = np.repeat(np.arange(len(part)), count)
        new = np.concatenate(([True], (seen[1:] != seen[:-1]) | (owner[1:] != owner[:-1])))
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], len(seen))
        for a, b in zip(runs[seen[runs]].tolist(), ends[seen[runs]].tolist()):
            age, id_, tie, lo, _ = part[owner[a]]
            out.append((age, id_, tie, lo + a - int(before[owner[a]]), b - a + LENGTH - 1))
    return out


def _cuts(newest: int = 0):
    """(id, tie, lo, n): bytes to remove from documents of the newest age. Rows come sorted by key, slice, age, id, tie, lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, group, key, last, place = [], [], None, None, None

        def batch_of(rows):
            columns = list(zip(*(r[1:] for r in rows if r[0] == newest))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "tie", "lo", "n"])

        for batch in batches:
            rows = []
            for k, piece, age, id_, tie, lo, n in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None:
                    rows.append((age, id_, tie, lo, n))
                    continue
                if k != key:
                    if len(group) > 1:
                        waiting += group
                    if len(waiting) >= GROUP:
                        rows += _family_cuts(waiting)
                        waiting = []
                    key, group, last = k, [], None
                if piece != last:
                    group.append((age, id_, tie, lo, piece))
                    last = piece
                elif place != (age, id_, tie, lo):  # equal only for rows of one document
                    rows.append((age, id_, tie, lo, n))
                place = (age, id_, tie, lo)
            yield batch_of(rows)
        if len(group) > 1:
            waiting += group
        if waiting:
            yield batch_of(_family_cuts(waiting))

    return run


def _kept(raw: bytes, cuts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(removed runs, kept runs) of a text, in order."""
    removed: list[tuple[int, int]] = []
    for a, b in sorted((lo, lo + n) for lo, n in cuts):
        if removed and a <= removed[-1][1]:
            removed[-1] = (removed[-1][0], max(removed[-1][1], b))
        else:
            removed.append((a, b))
    edges = [0, *(x for run in removed for x in run), len(raw)]
    return removed, list(zip(edges[::2], edges[1::2]))


def _whole_characters(raw: bytes, removed: list[tuple[int, int]]) -> str:
    """The text without removed runs, which give up the bytes of characters that they hold in part."""
    out, at = [], 0
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    for a, b in removed:
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def _with_cuts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with a last column __cuts, array of (lo, n) or null.

    The order of documents is by (id, hash of the text): rows that share an id are separate documents unless their
    texts are equal too; then they count as one. Documents without an id come last.
    """
    key, tie = _keys(id_col, text_col)
    keyed = docs.select(key.alias("id"), text_or_empty(text_col).alias("text"), tie.alias("tie"))
    long_enough = keyed.where(F.octet_length("text") >= LENGTH)
    grams = long_enough.select("id", "text").mapInArrow(_anchored, "gram long, id long, places long, more binary")
    flagged = grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(_repeated, "id long, gram long, heat int")
    lists = [F.collect_list(F.when(F.col("heat") == h, F.col("gram"))).alias(n) for h, n in enumerate(("grams", "hot", "hotter"))]
    per_doc = staged(flagged.groupBy("id").agg(*lists))
    slices = long_enough.join(per_doc, "id").select("text", "id", "tie", "grams", "hot", "hotter").mapInArrow(_slices, "key long, slice binary, id long, tie long, lo long, n long")
    cuts = _joined_cuts(slices.withColumn("age", F.lit(0).cast("long")), 0)
    unstage(per_doc)
    return _marked(docs, cuts, id_col, text_col)


def _keys(id_col: str, text_col: str):
    """Order of a document and hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.xxhash64(text_or_empty(text_col))


def _joined_cuts(slices: DataFrame, newest: int) -> DataFrame:
    """(id, tie, cuts) staged, from rows (key, slice, age, id, tie, lo, n)."""
    ordered = slices.repartition("key").sortWithinPartitions("key", "slice", "age", "id", "tie", "lo").select("key", "slice", "age", "id", "tie", "lo", "n")
    cuts = ordered.mapInArrow(_cuts(newest), "id long, tie long, lo long, n long")
    return staged(cuts.groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("cuts")))


def _marked(docs: DataFrame, cuts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with a last column of cuts, whatever its other columns are called."""
    key, tie = _keys(id_col, text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"), tie.alias("hash"))
    found = rows.join(cuts, (F.col("key") == F.col("id")) & (F.col("hash") == F.col("tie")), "left")
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("cuts").alias(unused("__cuts", docs)))


def _level_of(name: str) -> tuple[int, int, int | None]:
    """(first batch, last batch, rows) of a level by its name; rows are None for what is no complete level."""
    parts = name.split("-")
    whole = len(parts) == 4 and parts[0] == "level" and all(p.isdigit() for p in parts[1:])
    return (int(parts[1]), int(parts[2]), int(parts[3])) if whole else (-1, -1, None)


def _level_order(name: str) -> tuple[int, int]:
    """Oldest first; of levels that begin with the same batch the one that holds most."""
    first, last, _ = _level_of(name)
    return first, -last


class StoredFamily:
    """A logarithmic family of batches of documents, kept in a folder: what `add` takes is compared with all before it.

    A level is a table of slices (the windows that share an anchor), in anchor order, of one batch or of several merged
    ones. A new batch meets the slices of every level under its own anchors, where a `SuffixFamily` scans them in order
    of age; then it becomes a level, and levels of like size merge. A batch is compared with its distinct anchors'
    slices only; slices that stand in an older level are not stored again.

    A level's folder is named after the batches it holds and its rows, and gets that name when it is complete, so the
    folder alone tells the family's state: another object, after a restart too, goes on with it. What a step that died
    left behind, unnamed levels and ones that a merged level has taken in, is deleted on opening. One writer at a time.
    """

    COLUMNS = ("key", "slice", "age", "id", "tie", "lo", "n")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: (path, rows) of the levels, oldest first, and the number of the next batch.
        self.levels: list[tuple[str, int]] = []
        self.age = 0
        fs, at = self._at(self.folder)
        names = sorted((s.getPath().getName() for s in fs.listStatus(at)), key=_level_order) if fs.exists(at) else []
        for name in names:
            first, last, rows = _level_of(name)
            if rows is None or last < self.age:
                if name.startswith("level-"):
                    delete(spark, f"{self.folder}/{name}")
                continue
            self.levels.append((f"{self.folder}/{name}", rows))
            self.age = last + 1

    def _at(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _write(self, slices: DataFrame, first: int, last: int) -> tuple[str, int]:
        made = f"{self.folder}/level-new-{uuid.uuid4().hex}"
        slices.repartition("key").sortWithinPartitions("key").select(*self.COLUMNS).write.parquet(made)
        rows = self.spark.read.parquet(made).count()
        path = f"{self.folder}/level-{first}-{last}-{rows}"
        fs, at = self._at(made)
        if not fs.rename(at, self._at(path)[1]):
            raise OSError(f"{path} could not be put in place")
        return path, rows

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As `repeats`, for a new batch: bytes go that a window covers which starts earlier in it or in any batch before.

        The batch is in the family when this returns; what it returns is still to be read.
        """
        key, tie = _keys(id_col, text_col)
        texts = docs.select(text_or_empty(text_col).alias("text"), key.alias("id"), tie.alias("tie")).where(F.octet_length("text") >= LENGTH)
        made = texts.mapInArrow(lambda batches: _slices(batches, every=True), "key long, slice binary, id long, tie long, lo long, n long")
        new = staged(made.withColumn("age", F.lit(self.age).cast("long")).select(*self.COLUMNS))
        met = new
        for path, _ in self.levels:
            met = met.union(self.spark.read.parquet(path).join(new.where("slice is not null").select("key").distinct(), "key", "left_semi").select(*self.COLUMNS))
        cuts = _joined_cuts(met, self.age)
        fresh = new.where("slice is not null").dropDuplicates(["key", "slice"])
        for path, _ in self.levels:
            fresh = fresh.join(self.spark.read.parquet(path).select("key", "slice"), ["key", "slice"], "left_anti")
        self.levels.append(self._write(fresh, self.age, self.age))
        unstage(new)
        while len(self.levels) > 1 and self.levels[-2][1] < 2 * self.levels[-1][1]:
            pair = [self.levels.pop()[0] for _ in range(2)]
            spans = [_level_of(path.rsplit("/", 1)[-1]) for path in pair]
            self.levels.append(self._write(self.spark.read.parquet(*pair), spans[1][0], spans[0][1]))
            for path in pair:
                delete(self.spark, path)
        self.age += 1
        return _repeats(docs, lambda lean, name: _marked(lean, cuts, id_col, name), id_col, text_col)


def _finish(marked: DataFrame, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    """`make(raw, cuts)` per row as new columns in place of __cuts."""
    at, last = marked.columns.index(text_col), len(marked.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make((text or "").encode("utf-8", "replace"), [(c["lo"], c["n"]) for c in cuts or []]) for text, cuts in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist())]
            made = [pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(list(zip(*rows)) or [()] * len(fields), fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *made], names=names)

    names = [*marked.columns[:last], *(f.name for f in fields)]
    return numbered(marked).mapInArrow(run, T.StructType([*marked.schema.fields[:last], *fields]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row: what a removal of repeats takes and leaves.

    Texts are UTF-8 bytes; null texts are empty; texts shorter than LENGTH lose nothing. A row with a repeated id is a
    document of its own unless its text is equal too: such rows count as one document and get the same result. Other
    columns are ignored; an empty table gives no rows.
    """
    return _repeats(docs, lambda lean, name: _with_cuts(lean, id_col, name), id_col, text_col)


def _repeats(docs: DataFrame, marked, id_col: str, text_col: str) -> DataFrame:
    def make(raw, cuts):
        removed, kept = _kept(raw, cuts)
        return len(raw), sum(b - a for a, b in removed), len(removed), hashlib.sha256(b"".join(raw[a:b] for a, b in kept)).hexdigest()

    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    lean = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("__text"))
    return _finish(marked(lean, "__text"), "__text", fields, make).drop("__text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """`docs` with repeats taken out of the texts, whole characters only; null texts stay null. chars_col is kept true."""
    kept = unused("__kept", docs)
    field = T.StructField(kept, T.StringType())
    made = _finish(_with_cuts(docs, id_col, text_col), text_col, [field], lambda raw, cuts: (_whole_characters(raw, _kept(raw, cuts)[0]),))
    there = F.col(text_col).isNotNull()
    changed = {text_col: F.when(there, F.col(kept))}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(there, F.length(kept).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return made.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
