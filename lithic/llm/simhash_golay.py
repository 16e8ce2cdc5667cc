"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a 23-bit word. The perfect (23, 12)
Golay code puts every word within three errors of exactly one codeword, so a word and its one-error neighbours decode
to few codewords: `near_codewords` lists them (about five). If two fingerprints differ in at most three bits, then

* some segment agrees and another has at most one error: key = (which two, the equal segment, codeword of the other);
* or each segment has exactly one error: key = the three codewords.

One side of a match offers the codeword it decodes to and the other side the codewords of its neighbourhood, which is
enough for both to meet in a key. Meeting pairs are verified on all 64 bits.

`near_duplicates` links fingerprints of three-word shingles at three bits. `alike` links texts that share 4/5 of their
five-word shingles: such texts are some ten bits apart on average, beyond what keys of any use can bridge, so the
codes find the closer copies, `shingle_copies` a few more per shingle and then all that is left between groups; links
are checked on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm import shingle_copies
from lithic.llm.common import components, ship, staged, text_or_empty, unstage

ship(__name__)

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(SHINGLE, len(words))
    n = len(words) - span + 1
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        raw = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:end], starts[at + span : end + span])])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _leaders() -> np.ndarray:
    """For each syndrome the error pattern of weight three or less that has it."""
    bits = [1 << b for b in range(23)]
    errors = [0, *bits]
    errors += [x | y for i, x in enumerate(bits) for y in bits[:i]]
    errors += [x | y | z for i, x in enumerate(bits) for j, y in enumerate(bits[:i]) for z in bits[:j]]
    table = np.zeros(2048, dtype=np.int64)
    table[_syndromes(np.array(errors))] = errors
    return table


def codewords(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _leaders()[_syndromes(words)]) >> 11


def near_codewords(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index), distinct: what each word and its neighbours at one flipped bit (of `bits`) decode to."""
    flips = np.array([0, *(1 << b for b in range(bits))], dtype=np.int64)
    found = np.sort(codewords((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of `prints`, asks): keys that each fingerprint is filed under (asks False) and looks up (True)."""
    unsigned = prints.view(np.uint64)
    parts = [((unsigned >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [codewords(p) for p in parts]
    near = [near_codewords(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    rows, out, who, ask = np.arange(len(prints)), [], [], []

    def put(key, row, asks):
        out.append(key)
        who.append(row)
        ask.append(np.full(len(row), asks))

    for i in range(3):
        for j in range(3):
            if i != j:
                family = (np.int64(3 * i + j) << 34) | (parts[i] << 12)
                put(family | own[j], rows, False)
                at, word = near[j]
                put(family[at] | word, at, True)
    triple = np.int64(15) << 36
    at, word = near[0]
    put(triple | (word << 24) | (own[1][at] << 12) | own[2][at], at, False)
    (at1, word1), (at2, word2) = near[1], near[2]
    first = np.searchsorted(at2, at1, "left")
    many = np.searchsorted(at2, at1, "right") - first
    left = np.repeat(np.arange(len(at1)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    row = at1[left]
    put(triple | (own[0][row] << 24) | (word1[left] << 12) | word2[right], row, True)
    return np.concatenate(out), np.concatenate(who), np.concatenate(ask)


def spanning_links(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (differing in MAX_BITS or fewer) that connect all that any such links among `prints` connect."""
    left, (a, b) = np.unique(prints), ([], [])
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            close = np.bitwise_count((left ^ at).view(np.uint64)) <= MAX_BITS
            if close.any():
                found = left[close]
                left = left[~close]
                a.extend([int(at)] * len(found))
                b.extend(found.tolist())
                todo.extend(found)
    return a, b


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            key, row, asks = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(asks)], names=["key", "fp", "asks"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. The rows of the last key of a batch wait for the next one."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(key, fp, asks):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        differ = np.minimum.reduceat(fp, starts) != np.maximum.reduceat(fp, starts)
        asked = np.add.reduceat(asks.astype(np.int64), starts)
        a, b = [], []
        for k in np.flatnonzero(differ & (asked > 0) & (asked < ends - starts)):
            x, y = spanning_links(fp[starts[k] : ends[k]])
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if part[0][-1] == part[0][0] and held and held[0][0][0] == part[0][0]:
            held.append(part)
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held, part))
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        if cut:
            yield links(*(x[:cut] for x in whole))
        held = [tuple(x[cut:] for x in whole)]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints `prints` (fp) at MAX_BITS or fewer that connect all such pairs connect."""
    keyed = prints.select("fp").mapInArrow(_keyed, "key long, fp long, asks boolean")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")


def _component_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id) of nodes (fp, first): the smallest first id of the component that `roots` (node, root) gives."""
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return staged(placed.join(least, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, fingerprint long, component_id), component_id the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a repeated id all stay, each with its
    own fingerprint. A null id gets the component of its text and is never a component's id, unless no other is there
    (then null). Columns other than the two named are ignored. An empty table gives no rows.

    Equal fingerprints collapse to one row by an aggregation before anything is matched, so copies cost one row each.
    Within a key only links that span it are emitted, at most one per member.
    """
    prints = staged(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_fingerprints, f"id {docs.schema[id_col].dataType.simpleString()}, fp long"))
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("first")))
    of_print = _component_ids(nodes, components(links(nodes)))
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, component_id), component_id the smallest id reachable over pairs that share 4/5.

    Shingles are five lower-cased words; a text of fewer words is one shingle. No pair is lost: see `shingle_copies`.
    Null and empty texts are alike. Rows with a repeated id all stay, each with its own text. A null id gets the
    component of its text and is never a component's id, unless no other is there (then null). Equal sets are one
    from the start. Columns other than the two named are ignored. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = staged(shingle_copies.described(texts))
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("first"), *(F.any_value(c).alias(c) for c in ("sim", "n", "odd"))))
    first = staged(nodes.groupBy("sim").agg(F.min("fp").alias("fp")))
    equal = nodes.join(first.withColumnRenamed("fp", "a"), "sim").select("a", F.col("fp").alias("b")).where("a <> b")
    apart = links(first.select(F.col("sim").alias("fp"))).distinct()
    of = lambda name: first.select(F.col("sim").alias(name), F.col("fp").alias(f"{name}_fp"))
    near = apart.join(of("a"), "a").join(of("b"), "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    met = staged(shingle_copies.meeting(texts))
    edges = shingle_copies.verified(staged(equal.union(near).union(shingle_copies.few_candidates(met)).distinct()), nodes, texts)
    roots = staged(components(edges))
    rest = shingle_copies.verified(staged(shingle_copies.candidates(met, nodes, roots)), nodes, texts)
    unstage(met)
    of_set = _component_ids(nodes, components(edges.union(rest)))
    return rows.join(of_set, "fp").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of their group of `alike` texts; rows without an id stay.

    Of rows with equal id and text one stays; of those that share an id only, each whose group it heads.
    """
    found = staged(alike(docs, id_col, text_col))
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    repeated = staged(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    kept = docs.join(gone, id_col, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, id_col, "left_anti").select(docs.columns).union(once.select(docs.columns))
