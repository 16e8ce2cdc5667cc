"""Fill-in-the-middle transformation over a run-length encoding of character classes.

A text's UTF-8 bytes are stored as maximal runs of one character class, each with the number of units that are complete
at its end. The end of unit u is found by binary search for the run that completes it, and its place inside the run by
arithmetic: every `width` bytes of a run complete one unit, or (width 0) the run's end completes it. What is left
unfinished at the end of the text is a unit too. Units never split a character.

| unit | classes | complete a unit |
|---|---|---|
| line | newline, other | every newline |
| word | blank (space, tab to carriage return), other | the end of a run of others; blanks belong to the word that follows |
| char | characters of one, two, three, four bytes | every character |
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import numbered, ship, spark_schema, text_slices

ship(__name__)

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of the texts that can be cut, how many in a hundred are; of those, how many in a hundred put the suffix first.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7


class Runs(NamedTuple):
    """Runs of one text: first bytes, ends, units complete at their ends, bytes per unit within (0: one unit at the end or none)."""

    begins: np.ndarray
    ends: np.ndarray
    units: np.ndarray
    widths: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def end_of(self, unit: int) -> int:
        """Byte offset at which `unit` units are complete."""
        if unit == 0:
            return 0
        k = int(np.searchsorted(self.units, unit))
        before = int(self.units[k - 1]) if k else 0
        width = int(self.widths[k])
        return int(self.begins[k]) + (unit - before) * width if width and unit - before <= (self.ends[k] - self.begins[k]) // width else int(self.ends[k])


def _line_class(raw: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
    return (raw == 10).view(np.uint8), (0, 1), (0, 0)


def _word_class(raw: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return (~blank).view(np.uint8), (0, 0), (0, 1)


def _char_class(raw: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
    wide = (raw >= 0xC0).astype(np.uint8) + (raw >= 0xE0) + (raw >= 0xF0)
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.repeat(wide[first], np.diff(first, append=len(raw))), (1, 2, 3, 4), (0, 0, 0, 0)


#: Class of every byte; bytes per unit in a run of each class (0: none); units at the end of such a run.
UNITS = {"line": _line_class, "word": _word_class, "char": _char_class}


def runs(raw: bytes, unit: str = "line") -> Runs:
    """The runs of a UTF-8 text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return Runs(*(np.zeros(0, dtype=np.int64) for _ in range(4)))
    kinds, width_of, at_end_of = UNITS[unit](data)
    ends = np.append(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, len(data))
    begins = np.append(0, ends[:-1])
    kind = kinds[begins]
    widths = np.array(width_of, dtype=np.int64)[kind]
    whole = np.where(widths > 0, (ends - begins) // np.maximum(widths, 1), 0) + np.array(at_end_of, dtype=np.int64)[kind]
    if not whole[-1]:  # what is unfinished at the end is a unit
        whole[-1] = 1
    return Runs(begins, ends, np.cumsum(whole), widths)


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four unsigned integers of 32 bits that depend on seed and key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cut(raw: bytes, key: str, unit: str = "line", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n units, form, characters of the prefix, of the middle, output bytes) of one text."""
    found = runs(raw, unit)
    n, (a, b, cuts, order) = found.n, draws(seed, key)
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    if not raw or any(m in raw for m in marks) or cuts % 100 >= rate:
        return n, "plain", None, None, raw
    first, second = (found.end_of(u) for u in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = raw[:first], raw[first:second], raw[second:]
    data = np.frombuffer(raw, dtype=np.uint8)
    if order % 100 < suffix_first:
        form, parts = "spm", (marks[1], suffix, marks[0], prefix, marks[2], middle)
    else:
        form, parts = "psm", (marks[0], prefix, marks[1], suffix, marks[2], middle)
    return n, form, _chars(data[:first]), _chars(data[first:second]), b"".join(parts)


FIELDS = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with n, form, prefix_chars, middle_chars, output, in place of columns of those names.

    The text is cut at two unit boundaries that depend on seed and id alone, so repeated rows are cut alike, and a null
    id is cut as the text 'null' would be. A null text counts as empty. Empty texts and texts that hold a marker stay
    plain (the output is the text, character counts are null), so every output can be taken back. Nothing is shuffled;
    texts of any length are cut whole. An empty table gives no rows. Other columns are kept whatever their names.
    """
    import pyarrow as pa

    kept = docs.drop(*(name for name, _ in FIELDS if name not in (id_col, text_col)))
    at_id, at_text = kept.columns.index(id_col), kept.columns.index(text_col)
    added = spark_schema(FIELDS)
    out_names = [*(f"c{k}" for k in range(len(kept.columns))), *(f"a{k}" for k in range(len(FIELDS)))]

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for part, texts in text_slices(batch, at_text, 8_000_000):
                ids = part.column(at_id).to_pylist()
                made = [cut(t.encode(), "null" if i is None else str(i), unit, seed, rate, suffix_first) for i, t in zip(ids, texts)]
                columns = [pa.array([m[k] for m in made], kinds[k]) for k in range(4)]
                columns.append(pa.array([m[4] for m in made], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=out_names)

    fields = [*numbered(kept).schema.fields, *(type(f)(f"a{k}", f.dataType) for k, f in enumerate(added.fields))]
    return numbered(kept).mapInArrow(run, type(added)(fields)).toDF(*kept.columns, *(name for name, _ in FIELDS))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. Markers occur nowhere else in it, so it splits into four parts."""
    part = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    prefix, suffix = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))
