"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import slices

Span = tuple[str, int, int]

# Kinds in the order in which spans with the same start are listed.
KINDS = ["email", "ip", "card", "phone"]
# Fixed patterns. Possessive repeats keep long runs of digits linear; matches are the same as with greedy ones.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9][0-9]*+(?:(?:\.[0-9]++){3})?+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


# --- patterns -----------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost first, found from each @ outwards."""
    low, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at)
        if found:
            begin = at
            while begin > low and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at:
                yield "email", begin, found.end()
                low = found.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost, not overlapping per kind; matches that fail their check are dropped."""
    out = list(emails(text))
    for found in NUMBERS.finditer(text):
        parts = found[0].split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append(("ip", *found.span()))
    for found in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", found[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *found.span()))
    for found in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", found[0])) <= 15:
            out.append(("phone", *found.span()))
    return in_order(out)


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spelled(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# --- labelled table -----------------------------------------------------------------------------------------

# Labelled sentences are made of these frames and values: in the place of {} stands a value of the kind, or none.
FRAMES = [
    "call {} today",
    "my number is {} or ask at the desk",
    "{}",
    "please write to {} and wait for an answer",
    "the server at {} was down",
    "paid with {} in the shop",
    "reach me on {} , thanks",
    "de la {} en que",
    "und der {} ist das",
    "sent ( {} ) by them .",
]
VALUES = {
    "email": [
        "ann.lee@mail.example.com",
        "bob7@example.org",
        "josé.díaz@correo.example.es",
        "müller@firma.example.de",
        "x_y-z@sub.example.co.uk",
        "sales@example.com,",
    ],
    "ip": ["10.20.30.40", "192.168.0.1", "8.8.8.8", "172.16.254.3", "10.0.0.7:8080", "82.15.53.133."],
    "card": ["4111111111111111", "4804 4175 3006 9042", "5500-0055-5555-5559", "4111.1111.1111.1111", "378282246310005"],
    "phone": [
        "+1 (917) 555-2670",
        "(917) 555-2670",
        "917-555-2670",
        "917.555.2670",
        "+44 20 7946 0958",
        "+33 1 99 00 12 34",
        "1-800-555-0199",
        "+49 30 5550 1234",
    ],
    "": [
        "2024-01-31",
        "12:30",
        "$1,234.56",
        "3.14159",
        "version 1.2.3",
        "1.2.3",
        "pages 10-20",
        "1999",
        "(1999)",
        "10,000 people",
        "7c529a94f5d1c3f6",
        '"7c529a94f5d1c3f6a960243406caaaf8e6185747"',
        "978-3-16-148410-0",
        "100%",
        "room 12",
        "@home",
        "C3PO",
        "x = 42;",
        "12345678",
        "1234567890123",
        "no. 555",
        "it was.",
        "heute, als",
        "***",
        "|",
        "word$$$",
        "the (small) house - old",
        "http://example.com/a/b?c=1",
        "01/02/2003",
        "12.5 kg",
        "1 2 3 4 5",
        "555 1234 items",
    ],
}


def labelled_table() -> list[tuple[str, list[Span]]]:
    """The labelled sentences: every frame with every value, and each phone and mail value behind another one."""
    out = []
    for frame in FRAMES:
        before, after = frame.split("{}")
        for kind, values in VALUES.items():
            for value in values:
                spans = [(kind, len(before), len(before) + len(value.rstrip(".,")))] if kind else []
                out.append((before + value + after, spans))
    return out


# --- word shapes --------------------------------------------------------------------------------------------

# Classes of characters: white space, digits, letters, and the marks that personal data are made of.
SPACE, DIGIT, LETTER, AT, DOT, DASH, PLUS, PAREN, OTHER = range(9)
_CLASS = np.full(256, LETTER, np.uint8)
_CLASS[:128] = OTHER
for _chars, _kind in (("0123456789", DIGIT), ("@", AT), (".", DOT), ("-", DASH), ("+", PLUS), ("()", PAREN)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
# Digits of a word by size class: 0, 1, 2, 3, 4, 5-7, 8-9, 10, 11, 12-13, 14-19, more.
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 7, 8, 9, 9, *[10] * 6, 11], np.int64)
SHAPES = 12 * 2 * 2 * 4 * 4 * 2 * 2 * 2
# One label for other words, and for each kind one for its first word and one for those that follow.
LABELS = 1 + 2 * len(KINDS)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (between the six ASCII spaces, in code points) and the number of each word's shape."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(points, 255)]
    solid = np.concatenate([[False], kind != SPACE, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, starts
    counts = {}
    for c in (DIGIT, LETTER, AT, DOT, DASH, PLUS, PAREN, OTHER):
        at = np.flatnonzero(kind == c)
        counts[c] = np.searchsorted(at, ends) - np.searchsorted(at, starts) if len(at) < len(starts) else _count(kind == c, starts, ends)
    shape = _DIGITS[np.minimum(counts[DIGIT], 20)]
    for c, top in ((LETTER, 1), (AT, 1), (DOT, 3), (DASH, 3), (PLUS, 1), (PAREN, 1), (OTHER, 1)):
        shape = shape * (top + 1) + np.minimum(counts[c], top)
    return starts, ends, shape


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])
    return upto[ends] - upto[starts]


# --- conditional random field -------------------------------------------------------------------------------


class Field:
    """A linear-chain field: scores of (shape, label) for a word, its left and its right neighbour, and of label pairs."""

    def __init__(self) -> None:
        self.own = np.zeros((SHAPES + 1, LABELS))  # the last row stands for the place beyond either end
        self.left = np.zeros((SHAPES + 1, LABELS))
        self.right = np.zeros((SHAPES + 1, LABELS))
        self.pair = np.zeros((LABELS, LABELS))
        for label in range(LABELS):
            for after in range(2, LABELS, 2):  # a following word comes only behind a word of its kind
                if label not in (after - 1, after):
                    self.pair[label, after] = -1e4
        self.first = np.zeros(LABELS)
        self.first[2::2] = -1e4

    def weights(self) -> list[np.ndarray]:
        return [self.own, self.left, self.right, self.pair, self.first]

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        """(rows, words, labels) for rows of shapes."""
        edge = np.full((len(shapes), 1), SHAPES)
        before = np.concatenate([edge, shapes[:, :-1]], axis=1)
        after = np.concatenate([shapes[:, 1:], edge], axis=1)
        return self.own[shapes] + self.left[before] + self.right[after]

    def viterbi(self, shapes: np.ndarray) -> np.ndarray:
        """The best labels of each row. Scores are made a place at a time: those of all places would be most of a worker's memory."""
        pair = self.pair.astype(np.float32)
        n, size = shapes.shape
        edge = np.full(n, SHAPES)
        steps = [edge, *np.ascontiguousarray(shapes.T), edge]
        back = np.zeros((size, n, LABELS), np.int8)
        best = self._emitted(*steps[:3]) + self.first.astype(np.float32)
        for t in range(1, size):
            high, came = best[:, 0, None] + pair[0], np.zeros((n, LABELS), np.int8)
            for label in range(1, LABELS):
                other = best[:, label, None] + pair[label]
                better = other > high
                high = np.where(better, other, high)
                came[better] = label
            back[t] = came
            best = high + self._emitted(*steps[t : t + 3])
        out = np.empty((n, size), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def _emitted(self, before: np.ndarray, own: np.ndarray, after: np.ndarray) -> np.ndarray:
        """`scores` of one place of each row."""
        return (self.own[own] + self.left[before] + self.right[after]).astype(np.float32)

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, penalty: float = 1e-4) -> Field:
        """Maximum likelihood by Adam; gradients from the forward and backward sums, sequences of a length side by side."""
        groups: dict[int, list] = {}
        for shapes, labels in sequences:
            groups.setdefault(len(shapes), []).append((shapes, labels))
        data = [(np.array([s for s, _ in g]), np.array([y for _, y in g])) for size, g in sorted(groups.items()) if size]
        first = [np.zeros_like(w) for w in self.weights()]
        second = [np.zeros_like(w) for w in self.weights()]
        open_ = [np.abs(w) < 1e3 for w in self.weights()]
        for step in range(1, rounds + 1):
            grads = [penalty * np.where(m, w, 0) for w, m in zip(self.weights(), open_, strict=True)]
            for shapes, labels in data:
                self._add_gradient(grads, shapes, labels, len(sequences))
            for w, g, a, b, m in zip(self.weights(), grads, first, second, open_, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= np.where(m, 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8), 0)
        return self

    def _add_gradient(self, grads: list[np.ndarray], shapes: np.ndarray, labels: np.ndarray, total: int) -> None:
        emit = self.scores(shapes)
        n, size, _ = emit.shape
        forth, back = np.empty_like(emit), np.zeros_like(emit)
        forth[:, 0] = emit[:, 0] + self.first
        for t in range(1, size):
            forth[:, t] = emit[:, t] + _log_sum(forth[:, t - 1, :, None] + self.pair, 1)
        for t in range(size - 2, -1, -1):
            back[:, t] = _log_sum(self.pair + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        norm = _log_sum(forth[:, -1], 1)
        share = np.exp(forth + back - norm[:, None, None])
        delta = share.copy()
        np.put_along_axis(delta, labels[:, :, None], np.take_along_axis(delta, labels[:, :, None], 2) - 1, 2)
        delta /= total
        edge = np.full((n, 1), SHAPES)
        before = np.concatenate([edge, shapes[:, :-1]], axis=1)
        after = np.concatenate([shapes[:, 1:], edge], axis=1)
        for grad, at in zip(grads, (shapes, before, after), strict=False):
            np.add.at(grad, at, delta)
        for t in range(1, size):
            joint = forth[:, t - 1, :, None] + self.pair + (emit[:, t] + back[:, t])[:, None, :] - norm[:, None, None]
            grads[3] += np.exp(joint).sum(axis=0) / total
            np.add.at(grads[3], (labels[:, t - 1], labels[:, t]), -1 / total)
        grads[4] += delta[:, 0].sum(axis=0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(table: list[tuple[str, list[Span]]] | None = None) -> Field:
    sequences = []
    for text, spans in labelled_table() if table is None else table:
        starts, ends, shapes = words_of(text)
        labels = np.zeros(len(starts), np.int64)
        for kind, begin, end in spans:
            inside = np.flatnonzero((starts < end) & (ends > begin))
            labels[inside] = 2 * KINDS.index(kind) + 2
            labels[inside[:1]] -= 1
        sequences.append((shapes, labels))
    return Field().fit(sequences)


# Words decoded at a time, and words of context on either side whose labels are not used.
CHUNK = 48
CONTEXT = 8


def decode(field: Field, texts: list[str], rows: int = 4_096) -> list[list[Span]]:
    """Spans of the field in each text. All words of all texts are decoded, in chunks with context, side by side."""
    found = [words_of(t) for t in texts]
    sizes = np.array([len(s) for s, _, _ in found], np.int64)
    chunks = -(-sizes // CHUNK)
    shapes = np.full(int(sizes.sum()) + 1, SHAPES)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for (_, _, own), at in zip(found, begin, strict=False):
        shapes[at : at + len(own)] = own
    owner = np.repeat(np.arange(len(texts)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    labels = np.zeros(int(sizes.sum()), np.int8)
    for at in range(0, len(owner), rows):
        own, k = owner[at : at + rows], number[at : at + rows]
        local = k[:, None] * CHUNK + np.arange(-CONTEXT, CHUNK + CONTEXT)
        inside = (local >= 0) & (local < sizes[own][:, None])
        place = np.where(inside, begin[own][:, None] + local, len(shapes) - 1)
        best = field.viterbi(shapes[place])[:, CONTEXT:-CONTEXT]
        use = inside[:, CONTEXT:-CONTEXT]
        labels[place[:, CONTEXT:-CONTEXT][use]] = best[use]
    out = []
    for text, (starts, ends, _), at, size in zip(texts, found, begin, sizes, strict=False):
        own = labels[at : at + size]
        spans = []
        for k in np.flatnonzero(own % 2):
            last = k
            while last + 1 < size and own[last + 1] == own[k] + 1:
                last += 1
            spans.append(trimmed(text, KINDS[own[k] // 2], int(starts[k]), int(ends[last])))
        out.append([s for s in spans if plausible(text, s)])
    return out


_OUTSIDE = " \t\n\r\x0b\x0c.,;:!?\"'*|$%&#<>[]{}"


def trimmed(text: str, kind: str, start: int, end: int) -> Span:
    while end > start and text[end - 1] in _OUTSIDE:
        end -= 1
    while start < end and text[start] in _OUTSIDE:
        start += 1
    return kind, start, end


def plausible(text: str, span: Span) -> bool:
    """Checks on what the field proposes: enough of what makes its kind, so that clean text is left alone."""
    kind, start, end = span
    own = text[start:end]
    digits = sum(c in "0123456789" for c in own)
    if kind == "email":
        name, _, domain = own.partition("@")
        return bool(name) and "." in domain.strip(".") and "@" not in domain
    if kind == "ip":
        parts = own.partition(":")[0].split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= digits <= 19 and luhn(NOT_DIGIT.sub("", own)) and not any(c.isalpha() for c in own)
    marks = sum(c in "+().- " for c in own)
    return 10 <= digits <= 15 and marks >= 2 and not any(c.isalpha() for c in own)


def all_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base spans with those that the field adds: such as overlap no base span."""
    out = []
    for text, more in zip(texts, decode(field, texts), strict=True):
        base = base_spans(text)
        out.append((base, in_order([*base, *apart_from(base, more)])))
    return out


def apart_from(base: list[Span], more: list[Span]) -> list[Span]:
    """Those of `more` that overlap none of `base`: no span that starts before their end reaches beyond their start."""
    by_start = sorted(base, key=lambda b: b[1])
    starts, reach = [b[1] for b in by_start], list(accumulate((b[2] for b in by_start), max))
    before = [bisect_left(starts, s[2]) for s in more]
    return [s for s, k in zip(more, before, strict=True) if not k or reach[k - 1] <= s[1]]


# --- operators ----------------------------------------------------------------------------------------------

SPANS = "array<struct<kind: string, start: int, end: int>>"


def _per_text(docs: DataFrame, extra: str, make) -> DataFrame:
    """`make(text, base, spans)` gives the columns of `extra` for each row; equal texts of a slice are read once."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    kept = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), extra])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            texts = batch.column("text").to_pylist()
            distinct = sorted({t or "" for t in texts})
            found = {t: make(t, *s) for t, s in zip(distinct, all_spans(shared.value, distinct), strict=True)}
            rows = [found[t or ""] for t in texts]
            names = list(rows[0])
            own = [batch.column(c) for c in kept if c != "text"]
            yield pa.record_batch([*own, *(pa.array([r[n] for r in rows]) for n in names)], names=[*(c for c in kept if c != "text"), *names])

    return docs.mapInArrow(run, schema)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of `docs` (doc_id, text; no other columns are read).

    The counts and `base_sha256` are those of the fixed patterns; `spans` has these and what the field adds, as
    kind:start:end in code points, end exclusive, by start and then by kind. The field, trained from the labelled table, decodes
    every word; it adds spans only where no base span is. Null texts count as empty; rows come out as they go in.
    """

    def make(_text: str, base: list[Span], spans: list[Span]) -> dict:
        counts = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
        return counts | {"base_sha256": hashlib.sha256(spelled(base).encode()).hexdigest(), "spans": spelled(spans)}

    extra = ", ".join([*(f"n_{k} bigint" for k in KINDS), "base_sha256 string", "spans string"])
    return _per_text(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), extra, make)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) with personal data in `text` replaced and `n_chars` counted anew; null texts stay null."""

    def make(text: str, _base: list[Span], spans: list[Span]) -> dict:
        return {"redacted": redacted(text, spans)}

    known = docs.select("doc_id", "lang", "source", "n_chars", "text", F.col("text").isNull().alias("no_text"))
    found = _per_text(known, "redacted string", make)
    text = F.when(~F.col("no_text"), F.col("redacted"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text), "n_chars").cast("bigint").alias("n_chars"))
