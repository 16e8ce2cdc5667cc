"""SentencePiece encoding and decoding with the N best segmentations.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces with their scores (or a character's
bytes, where no piece holds it). No piece crosses from a letter to the space mark before the next word, so the lattice
is a chain of small lattices, one per word. In each, Viterbi scores from the front are the exact heuristic of a
backward A* search, which yields paths best first. The front pass also keeps the second-best score at each place and so
the gap between a word's two best paths. The N best of a text change only the words with the N-1 smallest gaps; their
A* lists are combined. The front pass runs over sorted distinct words and resumes where a word leaves the one before.

Texts are taken as they are: a vocabulary's own normalisation rules (such as NFKC) are not applied, so that every
segmentation decodes to its text. Memory is in proportion to the longest word, not to its square: places keep where
their best path comes from, and paths of the search share their ends.

Order of paths: score, highest first; then, read from the end, the longer last piece where two differ. Between texts'
segmentations of equal score, the one that changes words nearer the beginning comes first.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import ship, text_or_empty, with_columns_of_text

ship(__name__)

BEST = 3
#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: A character without a piece scores this much below the lowest piece.
UNKNOWN = 10.0
#: Words and their characters whose results a task remembers, and characters handled in one go.
CACHE, CACHE_CHARS, GO = 500_000, 24_000_000, 12_000_000
_SPACED = re.compile(" +[^ ]*")


class Pieces:
    """A SentencePiece vocabulary: surfaces, scores, bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: dict[str, tuple[bytes, float]] = {}
        self.byte_ids: dict[int, bytes] = {}
        self.surfaces: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            packed = np.array([i], dtype="<u4").tobytes()
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = packed
                self.surfaces.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.surfaces.append(b"")
            else:
                self.table[piece] = (packed, model.get_score(i))
                self.surfaces.append(piece.replace(MARK, " ").encode())
        crossing = [p for p in self.table if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces go on after a space, so words are not independent: {crossing[:3]}")
        self.unknown = min(s for _, s in self.table.values()) - UNKNOWN
        self.longest = max(map(len, self.table))
        self.starts = {p[:n] for p in self.table for n in range(1, len(p) + 1)}
        #: For the ends of pieces: ids and score, or None for an end that is no piece itself.
        self.tails: dict[str, tuple[bytes, float] | None] = {p[n:]: None for p in self.table for n in range(1, len(p))}
        self.tails.update(self.table)
        self.sizes = np.array([len(x) for x in self.surfaces])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.surfaces), dtype=np.uint8)

    def edges(self, word: str) -> list[list[tuple[int, float, bytes]]]:
        """Per end: (start, score, ids) of the edges that end there, by start."""
        n, table, starts = len(word), self.table, self.starts
        into: list[list[tuple[int, float, bytes]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            alone = False
            for end in range(start + 1, min(n, start + self.longest) + 1):
                part = word[start:end]
                if part not in starts:
                    break
                hit = table.get(part)
                if hit:
                    into[end].append((start, hit[1], hit[0]))
                    alone |= end == start + 1
            if not alone:
                ids = b"".join(self.byte_ids[c] for c in word[start].encode("utf-8", "replace"))
                into[start + 1].append((start, self.unknown, ids))
        return into

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for, without the space put before it."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(total)].tobytes().removeprefix(b" ")


def front(into) -> list[float]:
    """Viterbi scores: best from the beginning to each place."""
    best = [0.0]
    for edges in into[1:]:
        best.append(max(best[s] + score for s, score, _ in edges))
    return best


def fronts(pieces: Pieces, words: list[str]) -> Iterator[tuple[str, float, bytes, float]]:
    """(word, score, ids, gap) per word, for sorted words: best path and how much less the second best scores.

    The gap is infinite where there is one path only.
    """
    tails, unknown, byte_ids, low = pieces.tails, pieces.unknown, pieces.byte_ids, -np.inf
    get = tails.get
    best, second = [0.0], [-np.inf]
    came: list[tuple[int, bytes]] = [(0, b"")]
    before = ""
    for word in words:
        same, most = 0, min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        before = word
        del best[same + 1 :], second[same + 1 :], came[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            first = next_best = low
            own, start = None, end - 1
            alone = get(word[start], 0)
            if not alone:
                first, next_best = best[start] + unknown, second[start] + unknown
                own = start, b"".join([byte_ids[c] for c in word[start].encode("utf-8", "replace")])
                tail = 0 if alone == 0 else None
            else:
                tail = alone
            while tail != 0:
                if tail:
                    score = best[start] + tail[1]
                    if score >= first:
                        next_best = second[start] + tail[1]
                        if first > next_best:
                            next_best = first
                        first, own = score, (start, tail[0])
                    elif score > next_best:
                        next_best = score
                start -= 1
                if start < 0:
                    break
                tail = get(word[start:end], 0)
            best.append(first)
            second.append(next_best)
            came.append(own)
        ids, at = [], len(word)
        while at:
            at, piece = came[at]
            ids.append(piece)
        ids.reverse()
        yield word, best[-1], b"".join(ids), best[-1] - second[-1]


class _Path:
    """The end of a path, from `at` on. Paths share their ends: `parent` is the same without the first edge.

    `jump` leads to an ancestor whose depth depends on this one's depth alone, so two paths of equal depth are compared
    in steps that are logarithmic in their length.
    """

    __slots__ = ("at", "score", "ids", "parent", "jump", "depth")

    def __init__(self, at: int, score: float, ids: bytes, parent: _Path | None):
        self.at, self.score, self.ids, self.parent = at, score, ids, parent
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = parent.depth + 1, parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def __lt__(self, other: _Path) -> bool:
        """Read from the end, the longer piece where two differ; a path before those that go on from it."""
        x, y = self, other
        while x.depth > y.depth:
            x = x.jump if x.jump.depth >= y.depth else x.parent
        while y.depth > x.depth:
            y = y.jump if y.jump.depth >= x.depth else y.parent
        if x is y:
            return self.depth < other.depth
        while x.parent is not y.parent:
            x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.parent, y.parent)
        return x.at < y.at

    def all_ids(self) -> bytes:
        out, one = [], self
        while one.parent is not None:
            out.append(one.ids)
            one = one.parent
        return b"".join(out)


def n_best(into, most: int) -> list[tuple[float, bytes]]:
    """(score, ids) of the `most` best paths: A* from the end, with the front scores as exact heuristic."""
    n, best, out = len(into) - 1, front(into), []
    heap = [(-best[n], _Path(n, 0.0, b"", None))]
    while heap and len(out) < most:
        _, path = heapq.heappop(heap)
        if not path.at:
            out.append((path.score, path.all_ids()))
            continue
        for start, gain, own in into[path.at]:
            score = path.score + gain
            heapq.heappush(heap, (-(score + best[start]), _Path(start, score, own, path)))
    return out


class Encoder:
    def __init__(self, path: str, most: int = BEST):
        self.pieces, self.most = Pieces(path), most
        self.known: dict[str, tuple[float, bytes, float]] = {}
        self.lists: dict[str, list[tuple[float, bytes]]] = {}
        self.chars = self.list_chars = 0

    def _learn(self, tokens: list[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > CACHE or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars, new = 0, tokens
        self.chars += sum(map(len, new))
        for word, score, ids, gap in fronts(self.pieces, sorted(MARK + t for t in new)):
            self.known[word[1:]] = (score, ids, gap)

    def _list(self, token: str) -> list[tuple[float, bytes]]:
        found = self.lists.get(token)
        if found is None:
            if len(self.lists) >= CACHE or self.list_chars > CACHE_CHARS:
                self.lists.clear()
                self.list_chars = 0
            self.list_chars += self.most * len(token)
            found = self.lists[token] = n_best(self.pieces.edges(MARK + token), self.most)
        return found

    @staticmethod
    def _tokens(text: str) -> list[str]:
        """Words without the one mark before each; further spaces stay as marks in front."""
        return [w[1:].replace(" ", MARK) for w in _SPACED.findall(" " + text)] if text else []

    def __call__(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """Per text its best segmentations, best first: (score, ids). An empty text has one, without ids."""
        plain = [t.replace(MARK, " ") for t in texts]
        odd = [k for k, t in enumerate(plain) if not t or "  " in t or t[0] == " " or t[-1] == " "]
        apart = [self._tokens(plain[k]) for k in odd]
        for k in odd:
            plain[k] = ""
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy()
        ranges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        more = len(flat)
        for k, tokens in zip(odd, apart):
            ranges[k] = (more, more + len(tokens))
            more += len(tokens)
        coded = pa.concat_arrays([flat, pa.array([t for tokens in apart for t in tokens], pa.large_string())]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        found = [self.known[w] for w in words]
        scores = np.array([f[0] for f in found], dtype=np.float64)
        gaps = np.array([f[2] for f in found], dtype=np.float64)
        sizes = np.fromiter((len(f[1]) // 4 for f in found), dtype=np.int64, count=len(found))
        begins, blob = np.cumsum(sizes) - sizes, np.frombuffer(b"".join([f[1] for f in found]), dtype="<u4")
        word, out = coded.indices.to_numpy(zero_copy_only=False), []
        for a, b in ranges:
            own = word[a:b]
            many = sizes[own]
            ends = np.concatenate(([0], np.cumsum(many)))
            ids = blob[np.repeat(begins[own] - ends[:-1], many) + np.arange(ends[-1])]
            total = float(scores[own].sum())
            out.append([(total, ids), *self._others(words, own, gaps[own], total, ids, ends)])
        return out

    def _others(self, words, word, gaps, total, own, ends):
        n = self.most - 1
        if len(gaps) > 4 * n:
            reach = np.partition(gaps, n - 1)[n - 1] if n else -1.0
            near = np.flatnonzero(gaps <= reach)
        else:
            near = np.arange(len(gaps))
        near = near[np.isfinite(gaps[near])]
        chosen = np.sort(near[np.lexsort((near, gaps[near]))][:n]).tolist()
        lists = [self._list(words[word[k]]) for k in chosen]
        out = []
        for loss, ranks in _least_sums([[x[0][0] - y[0] for y in x] for x in lists], n + 1)[1:]:
            parts, at = [], 0
            for k, x, r in zip(chosen, lists, ranks[::-1]):
                parts += [own[at : ends[k]], np.frombuffer(x[r][1], dtype="<u4")]
                at = ends[k + 1]
            out.append((total - loss, np.concatenate([*parts, own[at:]])))
        return out


def _least_sums(losses: list[list[float]], most: int) -> list[tuple[float, tuple[int, ...]]]:
    """The `most` least sums of one entry per list, each list in rising order: (sum, places of the entries, last list first), ties by places.

    Best first: a choice is followed by those that go one place on in one list, so the heap holds lists * most choices.
    """
    start = (0,) * len(losses)
    loss_of = lambda ranks: sum(x[r] for x, r in zip(losses, ranks[::-1]))
    heap, seen, out = [(loss_of(start), start)], {start}, []
    while heap and len(out) < most:
        loss, ranks = heapq.heappop(heap)
        out.append((loss, ranks))
        for k, x in enumerate(reversed(losses)):
            after = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
            if after[k] < len(x) and after not in seen:
                seen.add(after)
                heapq.heappush(heap, (loss_of(after), after))
    return out


def segmentations(docs: DataFrame, model_path: str, most: int = BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, n_pieces, ids_crc32, decoded) of the `most` best segmentations of every text, rank from 1.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers; decoded tells whether they decode to the text.
    The mark in a text stands for a space. A null or empty text has one segmentation, without pieces. Fewer paths than
    `most`: all of them. Repeated rows are treated alike; other columns are ignored; an empty table gives no rows.
    """
    encoder: list[Encoder] = []

    def make(texts: list[str]) -> list[pa.Array]:
        if not encoder:
            encoder.append(Encoder(model_path, most))
        out = []
        for text, found in zip(texts, encoder[0](texts)):
            wanted = text.replace(MARK, " ").encode("utf-8", "replace")
            out.append([{"rank": k + 1, "score": score, "n_pieces": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "decoded": encoder[0].pieces.decode_bytes(ids) == wanted} for k, (score, ids) in enumerate(found)])
        kind = pa.struct([("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded", pa.bool_())])
        return [pa.array(out, pa.list_(kind))]

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    made = with_columns_of_text(texts, "text", make, [("found", "array<struct<rank:int,score:double,n_pieces:long,ids_crc32:long,decoded:boolean>>")], GO)
    return made.select("id", F.explode("found").alias("found")).select(F.col("id").alias(id_col), "found.*")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the best segmentation of every text."""
    encoder: list[Encoder] = []

    def make(texts: list[str]) -> list[pa.Array]:
        if not encoder:
            encoder.append(Encoder(model_path, 1))
        return [pa.array([found[0][1].astype(np.int32) for found in encoder[0](texts)], pa.list_(pa.int32()))]

    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return with_columns_of_text(texts, "__text", make, [("ids", "array<int>")], GO).drop("__text")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """`rows` with a last column decoded_text, in place of one of that name; null ids decode to null."""
    rows = rows.drop("decoded_text")
    pieces: list[Pieces] = []
    at = rows.columns.index(ids_col)

    def run(batches):
        if not pieces:
            pieces.append(Pieces(model_path))
        for batch in batches:
            texts = [None if ids is None else pieces[0].decode(np.array(ids, dtype=np.int64)) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded_text"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded_text", T.StringType())]))
