"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenised once into pieces of at most `size` tokens. Only the histogram of piece lengths (at most `size`
rows, whatever the corpus) reaches the driver, which places lengths longest first, each into the least filled packs
that still have room, and counts equal packs as one pattern. Patterns are then joined back to pieces by each piece's
rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import ship, shuffle_width, staged, text_or_empty, unused, with_columns_of_text

ship(__name__)

SIZE = 4096
END_ID = 2
#: Entries that a task's cache of tokenised words may hold before it starts anew (about 200 MB).
CACHE = 1_000_000
#: Characters of text that are tokenised in one go.
GO = 8_000_000


class WordEncoder:
    """Ids of texts, word by word: the tokenizer drops white space, so ASCII-separated words are independent.

    Words are cut and numbered by Arrow; only distinct words that the cache lacks go through the tokenizer. It cuts
    letters from punctuation and ends each such part with a token that closes a word, so letters before a run of TAIL
    marks are encoded apart from it, many in one go.
    """

    #: ASCII marks that may follow letters; no apostrophe (contractions) and none that special tokens contain.
    TAIL = ".,!?*#$%&;:"
    #: How special tokens begin; texts with it are encoded whole.
    SPECIAL = "<|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: all at once, cut after the tokens that close a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.closing[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._each(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + 2 * len(new) > CACHE:
            known.clear()
            new = words
        split, other = [], []
        for word in new:
            head = word.rstrip(self.TAIL)
            # U+0130 has a lower case with a mark that is no letter
            if head.isalpha() and "\u0130" not in head:
                split.append((word, head, word[len(head) :]))
            else:
                other.append(word)
        heads = [h for h in {h for _, h, _ in split} if h not in known]
        other += [t for t in {t for _, _, t in split} if t not in known]
        for group, encode in ((heads, self._letters), (other, self._each)):
            for at in range(0, len(group), 10_000):
                part = group[at : at + 10_000]
                known.update(zip(part, encode(part)))
        for word, head, tail in split:
            if tail:
                known[word] = known[head] + known[tail]
        return [known[w] for w in words]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end)."""
        whole = [k for k, t in enumerate(texts) if self.SPECIAL in t]
        plain = pa.array(["" if self.SPECIAL in t else t for t in texts], pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = lists.flatten().dictionary_encode()
        each = self._of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        begins = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy(zero_copy_only=False)
        many = sizes[word]
        ends = np.concatenate(([0], np.cumsum(many)))
        at = np.repeat(begins[word] - ends[:-1], many) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(each), dtype="<u4")[at]
        offsets = lists.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        if whole:
            special = dict(zip(whole, self._each([texts[k] for k in whole])))
            parts = [np.frombuffer(special[k], dtype="<u4") if k in special else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, bounds


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `size` tokens of every document: (id, start, length, ids_crc32, doc_tokens)."""
    encoder: list[WordEncoder] = []

    def make(texts: list[str]) -> list[pa.Array]:
        if not encoder:
            encoder.append(WordEncoder(tokenizer_path))
        ids, bounds = encoder[0](texts)
        raw, last, out = memoryview(ids.tobytes()), np.array([END_ID], dtype="<u4").tobytes(), []
        for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            total, own = end - first + 1, []
            for start in range(0, total, size):
                part = zlib.crc32(raw[4 * (first + start) : 4 * min(end, first + start + size)])
                own.append((start, min(size, total - start), zlib.crc32(last, part) if start + size >= total else part, total))
            out.append(own)
        names = ("start", "length", "ids_crc32", "doc_tokens")
        return [pa.array([[dict(zip(names, p)) for p in own] for own in out], pa.list_(pa.struct([(n, pa.int64()) for n in names])))]

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    made = with_columns_of_text(texts, "text", make, [("pieces", "array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long>>")], GO)
    return made.select("id", F.explode("pieces").alias("piece")).select("id", "piece.*")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths in order): shortest-pack-first over {length: pieces}. Work depends on the lengths, not the counts."""
    groups: dict[tuple[int, tuple[int, ...]], int] = {}
    order: list[tuple[int, tuple[int, ...]]] = []

    def add(filled: int, lengths: tuple[int, ...], n: int) -> None:
        if (filled, lengths) in groups:
            groups[filled, lengths] += n
        else:
            groups[filled, lengths] = n
            heapq.heappush(order, (filled, lengths))

    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], {}
        while left:
            if order and order[0][0] + length <= size:
                filled, lengths = order[0]
                n = min(left, groups[order[0]])
                groups[order[0]] -= n
                if not groups[order[0]]:
                    del groups[heapq.heappop(order)]
                add(filled + length, (*lengths, length), n)
            else:
                n = left
                add(length, (length,), n)
            left -= n
    return sorted(((n, lengths) for (_, lengths), n in groups.items()), key=lambda x: (-sum(x[1]), x[1]))


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset, in place of columns of those names, to pieces (id, start, length, ...) whose lengths are between 1 and `size`.

    Pieces of one length are interchangeable: those of the smallest rank go to the first slots. Ranks are counted
    within (length, bucket), buckets by hash, and shifted by the sizes of the buckets before, so a length that holds
    most pieces is dealt over all buckets.
    """
    cut = cut.drop("sequence_id", "offset")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for n, lengths in patterns(histogram, size):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((n, sequence, offset))
            offset += length
        sequence += n
    at_length = cut.columns.index("length")
    places = {length: (np.cumsum([0, *(x[0] for x in s)])[:-1], np.array([x[1] for x in s]), np.array([x[2] for x in s])) for length, s in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (at_length, len(batch.columns) - 1))
            sequence_id, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for value in np.unique(length):
                own = np.flatnonzero(length == value)
                first, base, at = places[int(value)]
                slot = np.searchsorted(first, rank[own], "right") - 1
                sequence_id[own] = base[slot] + rank[own] - first[slot]
                offset[own] = at[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence_id), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    row = F.struct(*(F.col(f"`{c}`") for c in cut.columns)).alias("row")
    bucketed = cut.select(row, "id", "start", "length", F.pmod(F.xxhash64("id", "start"), F.lit(shuffle_width(cut.sparkSession))).alias("bucket"))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "start")
    placed = bucketed.withColumn("at", F.row_number().over(within) - 1).join(shifts, ["length", "bucket"])
    ranked = placed.select(*(F.col("row").getField(c).alias(c) for c in cut.columns), (F.col("at") + F.col("shift")).alias(unused("rank", cut)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: one row per piece (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids and a final END_ID, cut every `size` tokens. A null or empty text is the END_ID alone.
    Rows with a repeated or null id are packed like others. Ties between pieces of one length are settled by hash
    bucket, then id, then start. An empty table gives no rows. Columns other than the two named are ignored.
    """
    return pack(staged(pieces(docs, tokenizer_path, size, id_col, text_col)), size).withColumnRenamed("id", id_col)
