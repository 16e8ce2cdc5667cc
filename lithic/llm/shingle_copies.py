"""What fingerprints miss: pairs that share 4/5 of their five-word shingles, found exactly by prefix filtering.

`simhash_golay.alike` links most copies by their fingerprints and uses this module for the rest.

Two sets of which `NEAR` (4/5) of the union is shared have a shingle in common among the first |x| - ceil(4/5 |x|) + 1
of each, in any order that holds for all sets. Documents meet in the shingles of these prefixes; sizes and places rule
out pairs that cannot reach 4/5, the rest is settled on the whole sets. The order puts shingles last that are common in
a sample of the documents, which changes how many meet in a shingle but not what is found. Shingles and sets are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import ship, staged, unstage

ship(__name__)

SHINGLE = 5
SEED = 42
_COLUMNS, _KINDS = ["key", "fp", "size", "place", "sim"], "key long, fp long, size int, place int, sim long"
#: Documents whose shingles are counted, how many of them must share one, and how many such shingles are kept at most.
SAMPLE, SHARED, COMMON = 8192, 3, 65536
#: Bits in which the fingerprints of probable copies differ at most; those that share 4/5 differ in ten on average.
NEAR_BITS = 14
#: Members of a shingle that are compared at a time with all that follow.
_BLOCK = 256


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of all words together if there are fewer than SHINGLE."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(SHINGLE, len(words))
    raw = b"".join([xxhash.xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[span:])])
    return np.unique(np.frombuffer(raw, dtype=np.int64))


def digest(own: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def simhash(own: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles; 0 for the empty set."""
    if not len(own):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own)).view(np.int64)[0])


def close(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b, of the pairs of different groups in one shingle (set, size, place, fingerprint, group, parities: sorted by size) that may share 4/5."""
    fp, size, place, _, group, *odd = rows
    a, b = [], []
    for at in range(0, len(fp), _BLOCK):
        # a set is followed by larger ones: up to 5/4 of its size
        end = int(np.searchsorted(4 * size, 5 * size[min(at + _BLOCK, len(fp)) - 1], "right"))
        mine, others = slice(at, min(at + _BLOCK, len(fp))), slice(at, end)
        small, large = size[mine, None], size[None, others]
        most = np.minimum(small - place[mine, None], large - place[None, others])
        later = (np.arange(at, end)[None, :] > np.arange(at, mine.stop)[:, None]) & (group[mine, None] != group[None, others])
        i, j = np.nonzero(later & (5 * small >= 4 * large) & (9 * most >= 4 * (small + large)))
        apart = sum((np.bitwise_count((o[mine][i] ^ o[others][j]).view(np.uint64)).astype(np.int64) for o in odd), np.zeros(len(i), dtype=np.int64))
        near = 9 * apart <= size[mine][i].astype(np.int64) + size[others][j]
        x, y = fp[mine][i[near]], fp[others][j[near]]
        a.append(np.minimum(x, y))
        b.append(np.maximum(x, y))
    return np.concatenate(a), np.concatenate(b)


def around(rows: list[np.ndarray], pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b, of one set in a shingle and the others that probably share 4/5 with it (columns as in `close`)."""
    fp, size, place, sim = rows[:4]
    small, large = np.minimum(size, size[pivot]), np.maximum(size, size[pivot])
    most = np.minimum(size - place, size[pivot] - place[pivot])
    found = (5 * small >= 4 * large) & (9 * most >= 4 * (small + large)) & (fp != fp[pivot])
    found &= np.bitwise_count((sim ^ sim[pivot]).view(np.uint64)) <= NEAR_BITS
    return np.minimum(fp[found], fp[pivot]), np.maximum(fp[found], fp[pivot])


def middle(sims: np.ndarray) -> int:
    """The fingerprint nearest to the bitwise majority: of copies of one text, this is the text that they were made from."""
    ones = np.unpackbits(np.ascontiguousarray(sims).view(np.uint8)).reshape(len(sims), 64).sum(axis=0, dtype=np.int64)
    major = np.packbits(2 * ones > len(sims)).view(np.int64)[0]
    return int(np.argmin(np.bitwise_count((sims ^ major).view(np.uint64))))


def parities(own: np.ndarray) -> np.ndarray:
    """1,024 bits: whether an odd number of shingles falls to each. Two sets differ in at least as many shingles as bits."""
    odd = np.bincount(own & 1023, minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            own = [shingles(t.as_py()) for t in part.column(1)]
            columns = [pa.array([make(s) for s in own], pa.int64()) for make in (digest, simhash, len)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([parities(s) for s in own], pa.list_(pa.int64()))], names=["id", "fp", "sim", "n", "odd"])


def _sets(chosen=None):
    """Rows (fp, n, own) of the sets whose digest `chosen` holds (all by default): low halves of the hashes, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                fp, n, own = [], [], []
                for text in batch.column(0).slice(at, 512):
                    one = shingles(text.as_py())
                    name = digest(one)
                    if name not in seen and (chosen is None or name in chosen):
                        seen.add(name)
                        fp.append(name)
                        n.append(len(one))
                        own.append(np.unique(one.view("<i4")[::2]))
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["fp", "n", "own"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(shingles(t.as_py()) for t in batch.column(0).slice(at, 512))]))], names=["key"])


class Bits:
    """Which 64-bit hashes may be in a column: a bitmap of fixed size over their low bits, to be sent to every task at any scale.

    It holds at most 8 MB. The fuller it is the more it lets through; what it stops is not in the column.
    """

    LOW = (1 << 26) - 1

    def __init__(self, rows: DataFrame, column: str):
        spot = F.col(column).bitwiseAND(F.lit(self.LOW)) + 1
        parts = rows.groupBy(F.bitmap_bucket_number(spot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
        self.parts = {r["part"] - 1: bytes(r["bits"]) for r in parts.collect()}

    def __contains__(self, value: int) -> bool:
        part, at = divmod(value & self.LOW, 1 << 15)
        return part in self.parts and bool(self.parts[part][at >> 3] >> (at & 7) & 1)


def _prefixes(common: np.ndarray):
    """Rows (key, fp, size, place, sim) of the prefix of each set; `common` is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                key, fp, size, place, sim = [], [], [], [], []
                for text in batch.column(0).slice(at, 512):
                    own = shingles(text.as_py())
                    if not len(own) or (one := digest(own)) in seen:
                        continue
                    seen.add(one)
                    n = len(own) - (4 * len(own) + 4) // 5 + 1
                    often = common[np.searchsorted(common, own) % len(common)] == own if len(common) else np.zeros(len(own), dtype=bool)
                    key.append(np.concatenate((own[~often], own[often]))[:n])
                    fp.append(np.full(n, one))
                    size.append(np.full(n, len(own), dtype=np.int32))
                    place.append(np.arange(n, dtype=np.int32))
                    sim.append(np.full(n, simhash(own)))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, fp, size, place, sim)], names=_COLUMNS)

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by key, cut between keys: the rows of the last key of a batch wait for the next one."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if part[0][-1] == part[0][0] and held and held[0][0][0] == part[0][0]:
            held.append(part)
            continue
        whole = [np.concatenate(x) for x in zip(*held, part)]
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        if cut:
            yield [x[:cut] for x in whole]
        held = [[x[cut:] for x in whole]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, once each, of shingles that two sets or more have. Rows come sorted by key and set."""
    for columns in _by_key(batches):
        key, fp = columns[:2]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
        columns = [x[fresh] for x in columns]
        key = columns[0]
        same = np.concatenate(([False], key[1:] == key[:-1]))
        shared = same | np.append(same[1:], False)
        yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in columns], names=_COLUMNS)


def _paired(stars: bool):
    """Pairs of sets of different groups, or per key only those of two of its sets: the middle one, and one by chance.

    Rows (key, fp, size, place, sim, group) come sorted by key, size and set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *rest in _by_key(batches):
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends, found, n = np.append(starts[1:], len(key)), [], 0
            apart = np.minimum.reduceat(rest[4], starts) != np.maximum.reduceat(rest[4], starts)
            for s, e in zip(starts[apart].tolist(), ends[apart].tolist()):
                rows = [x[s:e] for x in rest]
                if stars:
                    made = [around(rows, p) for p in {middle(rows[3]), int(key[s]) % (e - s)}]
                else:
                    made = [close(rows)]
                found += made
                n += sum(len(x[0]) for x in made)
                if n > 1 << 17:
                    yield _pairs_of(found)
                    found, n = [], 0
            if n:
                yield _pairs_of(found)

    return run


def _pairs_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that SHARED or more of a bounded sample of `texts` (id, text) have, at most COMMON, sorted."""
    chosen = texts.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    counted = texts.join(F.broadcast(chosen.distinct()), "id").select("text").mapInArrow(_counted, "key long").groupBy("key").agg(F.count("*").alias("n"))
    return np.sort(np.array([r.key for r in counted.where(F.col("n") >= SHARED).orderBy(F.desc("n"), "key").limit(COMMON).collect()], dtype=np.int64))


def described(texts: DataFrame) -> DataFrame:
    """(id, fp, sim, n, odd) of every row of `texts` (id, text): digest, fingerprint, size and parities of its set of shingles."""
    return texts.mapInArrow(_described, f"id {texts.schema['id'].dataType.simpleString()}, fp long, sim long, n long, odd array<long>")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests whose sets share 4/5 of their union; nodes: (fp, n, odd) of each.

    Pairs whose parities show that more than a ninth of their shingles differ are out. The others are compared by the
    whole sets, made again from `texts`; only sets that may be in such pairs leave their task. Sets are compared by 32
    bits of each hash, counted so that no pair is lost; a pair one shingle short of 4/5 passes once in 100,000.
    """
    of = lambda k: nodes.select(F.col("fp").alias(k), F.struct("n", "odd").alias(f"of_{k}"))
    apart = F.aggregate(F.zip_with("of_a.odd", "of_b.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    pairs = staged(pairs.join(of("a"), "a").join(of("b"), "b").where(9 * apart <= F.col("of_a.n") + F.col("of_b.n")).select("a", "b"))
    ends = staged(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    sets = staged(texts.select("text").mapInArrow(_sets(Bits(ends, "fp")), "fp long, n int, own array<int>").join(ends, "fp", "left_semi").dropDuplicates(["fp"]))
    unstage(ends)
    x, y = (sets.select(F.col("fp").alias(k), F.struct("n", "own").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    lost = lambda s: F.col(f"{s}.n") - F.size(f"{s}.own")
    shared = F.size(F.array_intersect("x.own", "y.own")) + lost("x") + lost("y")
    out = staged(pairs.join(x, "a").join(y, "b").where(9 * shared >= 4 * (F.col("x.n") + F.col("y.n"))).select("a", "b"))
    unstage(sets)
    unstage(pairs)
    return out


def meeting(texts: DataFrame) -> DataFrame:
    """(key, fp, size, place, sim) of the prefixes of all sets, of keys that two sets or more have."""
    keyed = texts.select("text").mapInArrow(_prefixes(common_shingles(texts)), _KINDS)
    return keyed.repartition("key").sortWithinPartitions("key", "fp").select(*_COLUMNS).mapInArrow(_met, _KINDS)


def _grouped(met: DataFrame, stars: bool) -> DataFrame:
    more = [c for c in met.columns if c not in _COLUMNS]
    dealt = met.repartition("key").sortWithinPartitions("key", "size", "fp").select(*_COLUMNS, *more)
    return dealt.mapInArrow(_paired(stars), "a long, b long").distinct()


def few_candidates(met: DataFrame) -> DataFrame:
    """(a, b): pairs that probably share 4/5, for each key only those of two of its sets; twice as many as rows at most."""
    return _grouped(met.withColumn("group", F.col("fp")), True)


def candidates(met: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): all pairs that meet in a key and may share 4/5, but for those that `roots` (node, root) has linked already.

    The parities of nodes (fp, odd) go along, folded to 512 bits, so that most pairs that cannot share 4/5 are not made.
    """
    folded = [reduce(Column.bitwiseXOR, (F.element_at("odd", k + 8 * j + 1) for j in range(2))).alias(f"odd{k}") for k in range(8)]
    marked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), *folded)
    return _grouped(met.join(marked, "fp"), False)
