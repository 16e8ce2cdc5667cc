"""Personal data by weak supervision.

Patterns propose spans. Labelers (pattern, gazetteer, context words, checksum, borders) vote for or against each span
or abstain. Spans with equal kind, votes and shape are one row of a histogram over the whole corpus, which is bounded
by the number of such combinations and is all that reaches the driver. There expectation-maximisation estimates how
reliable each labeler is per kind, and a logistic span classifier is trained on the resulting probabilities. Spans of
the strict base patterns always stay; the classifier decides on the others.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import ship, text_or_empty, unused, with_columns_of_text

ship(__name__)

#: Kinds in output order; the first four have strict base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE = 4
LABELERS = 5
FOR, AGAINST, ABSTAIN = 1, 2, 0
MARGIN = 48
EM_ROUNDS, FIT_ROUNDS = 60, 300

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<=[\"'=: ])[A-Za-z0-9_+/-]{20,}(?![A-Za-z0-9])")
_HIDDEN_AT = re.compile(r" ?[\[(]at[\])] ?")
_HIDDEN_HOST = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{2,})+")
_HIDDEN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")

#: Words that speak for a kind nearby, and words that speak against any.
CONTEXT = {
    "email": {"mail", "email", "contact", "write", "reach"},
    "ip": {"ip", "host", "server", "address", "addr", "from"},
    "card": {"card", "visa", "credit", "payment", "pay"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "contact"},
    "secret": {"token", "key", "secret", "password", "api", "auth", "bearer", "credential"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank", "transfer"},
}
AGAINST_WORDS = {"version", "isbn", "page", "order", "sha", "commit", "checksum", "hash", "figure", "chapter"}
#: Common last labels of host names.
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"}
_WORDS = re.compile(r"[a-z]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches of local part, @ and domain, found from each @ since only it can follow a local part."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return found


def _loose(text: str):
    if "[at]" in text or "(at)" in text:
        end = 0
        for mark in _HIDDEN_AT.finditer(text):
            start = mark.start()
            while start > end and text[start - 1] in _HIDDEN_LOCAL:
                start -= 1
            host = _HIDDEN_HOST.match(text, mark.end()) if start < mark.start() else None
            if host:
                end = host.end()
                yield 0, start, end
    if _DIGIT.search(text):
        yield from ((3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text))
        yield from ((5, m.start(), m.end()) for m in _SSN.finditer(text))
        yield from ((6, m.start(), m.end()) for m in _IBAN.finditer(text))
        yield from ((4, m.start(), m.end()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit())


def _votes(text: str, kind: int, start: int, end: int, strict: bool) -> list[int]:
    span = text[start:end]
    digits = _digits(span)
    around = set(_WORDS.findall((text[max(0, start - MARGIN) : start] + " " + text[end : end + MARGIN // 2]).lower()))
    gazetteer = checksum = ABSTAIN
    if kind == 0:
        gazetteer = FOR if re.split(r"[^a-z]", span.lower())[-1] in DOMAINS else AGAINST
    elif kind == 1:
        gazetteer = AGAINST if span.startswith("0.") else FOR if span.startswith(("10.", "192.168.", "127.")) else ABSTAIN
    elif kind == 2:
        gazetteer = FOR if digits[0] in "3456" else AGAINST
    elif kind == 3:
        gazetteer = FOR if span.startswith("+") or "555" in digits else ABSTAIN
    elif kind == 5:
        gazetteer = AGAINST if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else FOR
    if kind == 2:
        checksum = FOR if _luhn(digits) else AGAINST
    elif kind == 6:
        moved = span.replace(" ", "")
        checksum = FOR if int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 else AGAINST
    elif kind == 4:
        checksum = FOR if len(set(span)) >= 10 else AGAINST
    elif kind == 3:
        checksum = FOR if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else AGAINST
    context = FOR if around & CONTEXT[KINDS[kind]] else AGAINST if around & AGAINST_WORDS else ABSTAIN
    before, after = text[start - 1 : start], text[end : end + 1]
    borders = AGAINST if (before.isalnum() or after.isalnum()) else FOR
    return [FOR if strict else ABSTAIN, gazetteer, context, checksum, borders]


def _shape(span: str) -> int:
    digits = len(_digits(span))
    return 16 * min(3, len(span) // 12) + 4 * min(3, 4 * digits // len(span)) + min(3, sum(c in " -.()" for c in span))


def candidates(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, shape), base spans first; others only where no base span overlaps them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    found = [(k, a, b, True) for k, a, b in base]
    last, at, reach = -1, 0, -1
    for k, a, b in sorted(_loose(text), key=lambda x: (x[1], -x[2], x[0])):
        while at < len(taken) and taken[at][0] <= a:
            reach = max(reach, taken[at][1])
            at += 1
        if a >= last and a >= reach and not (at < len(taken) and taken[at][0] < b):
            found.append((k, a, b, False))
            last = b
    code = lambda votes: sum(v * 3**i for i, v in enumerate(votes))
    return [(k, a, b, s, code(_votes(text, k, a, b, s)), _shape(text[a:b])) for k, a, b, s in found]


def _vote_list(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(LABELERS)]


def _inputs(kind: int, votes: int, shape: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 3 * LABELERS + 12)
    x[0] = x[1 + kind] = 1
    at = 1 + len(KINDS)
    for i, v in enumerate(_vote_list(votes)):
        x[at + 3 * i + v] = 1
    at += 3 * LABELERS
    for i, part in enumerate((shape // 16, shape // 4 % 4, shape % 4)):
        x[at + 4 * i + part] = 1
    return x


@dataclass
class SpanModel:
    """reliability[kind, labeler]: estimated share of its votes that are right. weights: of the span classifier."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def probability(self, kind: int, votes: int, shape: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(_inputs(kind, votes, shape) @ self.weights, -30, 30))))


def train(histogram: list[tuple[int, int, int, int]]) -> SpanModel:
    """From rows (kind, votes, shape, how often). Without rows: every labeler right in 7 of 10 votes."""
    reliability, prior = np.full((len(KINDS), LABELERS), 0.7), np.full(len(KINDS), 0.5)
    rows = sorted(histogram)
    size = len(_inputs(0, 0, 0))
    if not rows:
        weights = np.zeros(size)
        for i in range(LABELERS):
            weights[1 + len(KINDS) + 3 * i + FOR], weights[1 + len(KINDS) + 3 * i + AGAINST] = 1, -1
        return SpanModel(reliability, prior, weights)
    kind = np.array([r[0] for r in rows])
    votes = np.array([_vote_list(r[1]) for r in rows])
    many = np.array([r[3] for r in rows], dtype=np.float64)
    for _ in range(EM_ROUNDS):
        sure = np.log(reliability / (1 - reliability))[kind]
        logit = np.log(prior / (1 - prior))[kind] + (sure * ((votes == FOR) * 1.0 - (votes == AGAINST))).sum(axis=1)
        p = 1 / (1 + np.exp(-logit))
        for k in range(len(KINDS)):
            own = kind == k
            n = many[own]
            prior[k] = ((n * p[own]).sum() + 1) / (n.sum() + 2)
            right = (n[:, None] * np.where(votes[own] == FOR, p[own, None], np.where(votes[own] == AGAINST, 1 - p[own, None], 0))).sum(axis=0)
            voted = (n[:, None] * (votes[own] != ABSTAIN)).sum(axis=0)
            # seven right votes and three wrong ones beforehand: labelers are better than chance
            reliability[k] = np.clip((right + 7) / (voted + 10), 0.5, 0.99)
    x = np.array([_inputs(*r[:3]) for r in rows])
    scale, weights = many / many.sum(), np.zeros(size)
    scale = np.sqrt(scale) / np.sqrt(scale).sum()
    step = np.zeros(size)
    for _ in range(FIT_ROUNDS):
        slope = x.T @ (scale * (1 / (1 + np.exp(-x @ weights)) - p)) + 1e-4 * weights
        step += slope**2
        weights -= 0.5 * slope / np.sqrt(step + 1e-12)
    return SpanModel(reliability, prior, weights)


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Estimate from the spans of all of `docs`."""

    def make(texts):
        kind = pa.list_(pa.int32())
        return [pa.array([[c[0] + len(KINDS) * (c[4] + 3**LABELERS * c[5]) for c in candidates(t)] for t in texts], kind)]

    coded = with_columns_of_text(docs.select(text_or_empty(text_col).alias("text")), "text", make, [("codes", "array<int>")])
    rows = coded.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    split = lambda c: (c % len(KINDS), c // len(KINDS) % 3**LABELERS, c // len(KINDS) // 3**LABELERS)
    return train([(*split(r["code"]), r["count"]) for r in rows])


def spans_of(text: str, model: SpanModel) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base): all base spans and the others that the classifier accepts, by kind, then start."""
    return sorted(c[:4] for c in candidates(text) if c[3] or model.probability(c[0], c[4], c[5]) >= 0.5)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    Counts and base_sha256 (of kind:start:end, comma-joined) are of base spans; spans lists base and added ones. Null
    and empty texts have none. Repeated rows are treated alike; other columns are ignored; an empty table gives no rows.
    """
    fields = [*((f"n_{k}", "long") for k in KINDS[:BASE]), ("base_sha256", "string"), ("spans", "string"), ("n_added", "long")]

    def make(texts):
        found = [spans_of(t, model) for t in texts]
        base = [[s for s in spans if s[3]] for spans in found]
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(BASE)]
        digests = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
        return [*counts, pa.array(digests, pa.string()), pa.array([_joined(s) for s in found], pa.string()), pa.array([len(s) - len(b) for s, b in zip(found, base)], pa.int64())]

    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return with_columns_of_text(texts, "__text", make, fields).drop("__text")


def redacted(text: str, model: SpanModel) -> str:
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b, _ in spans_of(text, model)):
        if b > at:
            out += [text[at : max(a, at)], f"<{KINDS[k].upper()}>"]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every found span replaced by its kind in angle brackets; null texts stay null. chars_col is kept true."""
    hidden = unused("__clean", docs)
    made = with_columns_of_text(docs, text_col, lambda texts: [pa.array([redacted(t, model) for t in texts], pa.string())], [(hidden, "string")])
    there, changed = F.col(text_col).isNotNull(), {text_col: F.when(F.col(text_col).isNotNull(), F.col(hidden))}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(there, F.length(hidden).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return made.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
