"""Removal of repeated strings: sparse suffix arrays in a logarithmic index family, merge-scanned for long matches.

Every string of LENGTH bytes has an anchor: the K bytes in it with the smallest hash. Equal strings have equal anchors, so it is
enough to look for them among strings with the same anchor. Documents are dealt into slices, anchors into parts:

1. each slice sends the hashes of its anchors to their parts, which answer with those that occur in more than one document;
2. of these, each slice sends the pieces of text around them, each distinct piece once, with its smallest doc_id;
3. each part feeds the pieces, batch by batch in ascending order of doc_id, to an index family: a batch gets the suffix array of its
   strings, is merge-scanned against the existing levels, becomes a level itself, and levels of like size are merged. Every
   string so learns the smallest doc_id in which it starts, by comparing whole strings;
4. the answers meet the slices again, where documents lose the bytes of strings that start in a smaller doc_id.

A string that stands in a third of all documents is sent once per slice only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import tidied

LENGTH = 50
# Strings that share an anchor at most (a power of two), and the anchor's length.
SPAN = 32
K = LENGTH - SPAN + 1
# Text bytes of a slice, and text bytes for which there is a part of the anchors.
SLICE = 8 << 20
PART = 8 << 20
# Strings of a piece at most; strings of a batch.
PIECE = 64
BATCH = 1 << 16
# Positions hashed at a time.
CHUNK = 1 << 17

_rng = np.random.default_rng(20)
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


# --- anchors ------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` bytes: runs of 1, 2, 4... bytes are put together as the binary digits of `size` say."""
    n = len(data) - size + 1
    level, width, done, out = _LETTER[data], 1, 0, np.zeros(n, np.uint64)
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            out = out * _ODD[bit] + level[done : done + n]
            done += width
        if size >> (bit + 1):
            level = level[:-width] * _ODD[7 - bit] + level[width:]
            width *= 2
    return _mix(out)


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers and anchor keys of runs of neighbouring strings that have the same anchor hash."""
    span = SPAN
    found = []
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        low = _hashes(part, length - span + 1)
        width = 1
        while width < span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(head, len(low)))
        more = (size - 1) // PIECE + 1
        if (more > 1).any():
            key, begin, step = np.repeat(low[head], more), np.repeat(head, more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            size = np.minimum(np.repeat(size, more) - step * PIECE, PIECE)
            found.append((begin + step * PIECE + at, size, key))
        else:
            found.append((head + at, size, low[head]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, sizes, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, sizes, _mix(keys)


class Slice:
    """The runs of all documents of a slice, in one text."""

    def __init__(self, rows: pa.Table, length: int):
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
        self.ids = rows.column("doc_id").to_pylist()
        self.length = length
        found = []
        for k, (doc_id, text) in enumerate(zip(self.ids, self.texts, strict=True)):
            if doc_id is not None and len(text) >= length:
                starts, sizes, keys = runs(np.frombuffer(text, np.uint8), length)
                found.append((np.full(len(starts), k), starts, sizes, keys))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.doc, self.start, self.size, self.key = (np.concatenate(x) for x in zip(empty, *found, strict=True))

    def pieces(self, at: np.ndarray) -> list[bytes]:
        more = self.length - 1
        rows = zip(self.doc[at].tolist(), self.start[at].tolist(), self.size[at].tolist(), strict=True)
        return [self.texts[d][s : s + n + more] for d, s, n in rows]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


# --- messages -----------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed message; numbers of more bytes by byte plane."""
    out = []
    for x in arrays:
        raw = np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x
        body = np.ascontiguousarray(raw).view(np.uint8).reshape(-1, raw.dtype.itemsize).T.tobytes()
        out += [len(body).to_bytes(8, "little"), body]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n, at + 8).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 8 + n
    return out


MESSAGE = "slice bigint, part bigint, body binary"


def _messages(found: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[]] * 3
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["slice", "part", "body"])


def _to_five(keys: np.ndarray) -> np.ndarray:
    """The low 40 bits of keys; the bits above choose the part."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).ravel()


def _from_five(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view("<u8").ravel()


LOW = np.uint64((1 << 40) - 1)


# --- steps --------------------------------------------------------------------------------------------------


def _send_anchors(parts: int, length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = Slice(rows, length)
        order = np.lexsort((own.doc, own.key))
        keys, docs = own.key[order], own.doc[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        last = np.append(head[1:], len(keys)) - 1
        several = docs[head] != docs[last] if len(keys) else np.zeros(0, bool)
        keys = keys[head]
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p in np.unique(part).tolist():
            at = order[cuts[p] : cuts[p + 1]]
            out.append((key[0].as_py(), p, pack(_to_five(keys[at]), np.packbits(several[at]))))
        return _messages(out)

    return run


def _repeated(_key: tuple, rows: pa.Table) -> pa.Table:
    """The anchors of a part that occur in more than one document, for each slice."""
    slices, bodies = rows.column("slice").to_pylist(), rows.column("body").to_pylist()
    part = rows.column("part")[0].as_py()
    keys, several = [], []
    for body in bodies:
        five, flags = unpack(body, "u1", "u1")
        keys.append(_from_five(five))
        several.append(np.unpackbits(flags)[: len(keys[-1])].astype(bool))
    every, many = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    same = ordered[1:] == ordered[:-1]
    hit = many.copy()
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out, at = [], 0
    for name, own in zip(slices, keys, strict=True):
        some = own[hit[at : at + len(own)]]
        at += len(own)
        if len(some):
            out.append((name, part, pack(_to_five(some))))
    return _messages(out)


def _wanted(own: Slice, answers: list[tuple[int, np.ndarray]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs whose anchor is among the low bits of its part, and their parts, by part."""
    part = part_of(own.key, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    low = own.key & LOW
    found = []
    for p, keys in answers:
        at = order[cuts[p] : cuts[p + 1]]
        if len(keys) and len(at):
            keys = np.sort(keys)
            place = np.minimum(np.searchsorted(keys, low[at]), len(keys) - 1)
            found.append(at[keys[place] == low[at]])
    at = np.concatenate([np.zeros(0, np.int64), *found])
    return at, part[at]


def _send_pieces(parts: int, length: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not rows.num_rows:
            return _messages([])
        own = Slice(rows, length)
        got = zip(answers.column("part").to_pylist(), answers.column("body").to_pylist(), strict=True)
        at, part = _wanted(own, [(p, _from_five(unpack(b, "u1")[0])) for p, b in got], parts)
        out = []
        for p in np.unique(part).tolist():
            some = at[part == p]
            known: dict[tuple[int, bytes], int] = {}
            low = (own.key[some] & LOW).tolist()
            for anchor, piece, k in zip(low, own.pieces(some), own.doc[some].tolist(), strict=True):
                doc_id = own.ids[k]
                if known.setdefault((anchor, piece), doc_id) > doc_id:
                    known[anchor, piece] = doc_id
            pieces = sorted(known)
            anchors, each = np.unique(np.fromiter((a for a, _ in pieces), np.uint64, len(pieces)), return_counts=True)
            size = np.fromiter((len(x) for _, x in pieces), np.uint16, len(pieces))
            docs = np.fromiter((known[x] for x in pieces), np.int64, len(pieces))
            body = pack(_to_five(anchors), each.astype(np.uint32), size, docs, b"".join([x for _, x in pieces]))
            out.append((key[0].as_py(), p, body))
        return _messages(out)

    return run


class Family:
    """Levels of sorted strings, each with the smallest doc_id in which it starts. Levels at least double in size."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes in a batch whose documents are not smaller than those before, in ascending order; the smallest document of each string."""
        array = np.argsort(strings, kind="stable")  # the batch's suffix array
        ordered = strings[array]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(head) - 1
        distinct, least = ordered[head], docs[array][head]
        new = np.ones(len(distinct), bool)
        for level, first in self.levels:  # merge scan
            place = np.minimum(np.searchsorted(level, distinct), len(level) - 1)
            known = level[place] == distinct
            least = np.where(known, np.minimum(least, first[place]), least)
            new &= ~known
        out = np.empty(len(strings), np.int64)
        out[array] = least[group]
        self._insert(distinct[new], least[new])
        return out

    def _insert(self, strings: np.ndarray, docs: np.ndarray) -> None:
        if not len(strings):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(strings):
            older, first = self.levels.pop()
            strings, docs = np.concatenate([older, strings]), np.concatenate([first, docs])
            order = np.argsort(strings, kind="stable")
            strings, docs = strings[order], docs[order]
        self.levels.append((strings, docs))


def _smallest(length: int):
    def run(_key: tuple, rows: pa.Table) -> pa.Table:
        """For each piece of a part, the smallest document of each of its strings.

        Equal strings have the same anchor. So if all pieces around an anchor are equal, their strings start nowhere else, and
        only pieces around anchors with different pieces go through the index family.
        """
        slices, bodies = rows.column("slice").to_pylist(), rows.column("body").to_pylist()
        part = rows.column("part")[0].as_py()
        index: dict[bytes, int] = {}
        docs: list[int] = []
        around: list[int] = []
        sent = []
        for body in bodies:
            anchors, each, size, least, raw = unpack(body, "u1", "<u4", "<u2", "<i8", "u1")
            raw, ends, own = raw.tobytes(), np.cumsum(size, dtype=np.int64).tolist(), []
            anchor_of = np.repeat(_from_five(anchors), each).tolist()
            for start, end, doc_id, anchor in zip([0, *ends[:-1]], ends, least.tolist(), anchor_of, strict=True):
                at = index.setdefault(raw[start:end], len(docs))
                if at == len(docs):
                    docs.append(doc_id)
                    around.append(anchor)
                elif doc_id < docs[at]:
                    docs[at] = doc_id
                own.append(at)
            sent.append((anchors, own))
        pieces, least = list(index), np.array(docs, np.int64)
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) - (length - 1)
        answers = np.split(np.repeat(least, counts), np.cumsum(counts)[:-1])
        _, place, different = np.unique(np.array(around, np.uint64), return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(different[place] > 1)
        family = Family()
        order = mixed[np.argsort(least[mixed], kind="stable")]
        cuts = np.flatnonzero(np.diff(np.cumsum(counts[order]) // BATCH, prepend=-1))
        for start, end in zip(cuts, [*cuts[1:], len(order)], strict=False):
            some = order[start:end]
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(pieces[k], np.uint8), length) for k in some])
            found = family.add(windows.view(f"S{length}").ravel(), np.repeat(least[some], counts[some]))
            for k, own in zip(some, np.split(found, np.cumsum(counts[some])[:-1]), strict=True):
                answers[k] = own
        out = []
        for name, (anchors, own) in zip(slices, sent, strict=True):
            out.append((name, part, pack(anchors, np.concatenate([answers[k] for k in own]))))
        return _messages(out)

    return run


def _remove(parts: int, length: int, names: list[str], texts: bool):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = Slice(rows, length)
        marks: dict[int, np.ndarray] = {}
        got = {p: unpack(b, "u1", "<i8") for p, b in zip(answers.column("part").to_pylist(), answers.column("body").to_pylist(), strict=True)}
        at, part = _wanted(own, [(p, _from_five(x[0])) for p, x in got.items()], parts)
        for p in np.unique(part).tolist():
            some = at[part == p]
            pieces = list(zip((own.key[some] & LOW).tolist(), own.pieces(some), strict=True))
            ordered = sorted(set(pieces))
            begin = np.concatenate([[0], np.cumsum([len(x) - length + 1 for _, x in ordered])])
            place = {x: k for k, x in enumerate(ordered)}
            where = begin[np.fromiter((place[x] for x in pieces), np.int64, len(pieces))]
            size, smallest = own.size[some], got[p][1]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            ids = np.array([own.ids[k] for k in own.doc[some]], np.int64)
            hit = smallest[np.repeat(where, size) + step] < np.repeat(ids, size)
            docs, starts = np.repeat(own.doc[some], size)[hit], (np.repeat(own.start[some], size) + step)[hit]
            cuts = np.flatnonzero(np.diff(docs, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=False):
                k = int(docs[a])
                if k not in marks:
                    marks[k] = np.zeros(len(own.texts[k]) + 1, np.int32)
                np.add.at(marks[k], starts[a:b], 1)
                np.add.at(marks[k], starts[a:b] + length, -1)
        out = []
        for k, text in enumerate(own.texts):
            removed, spans, kept = 0, 0, text
            if k in marks:
                gone = np.cumsum(marks[k][:-1]) > 0
                removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.table([*(rows.column(n) for n in names), *made], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


# --- operator -----------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, *carry, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of `docs` (doc_id, text, and the columns `carry`).

    Texts are their UTF-8 bytes. A document loses each byte that lies in a string of `length` bytes which also starts in a document
    with a smaller doc_id; overlaps count, and all is judged on the input. `n_spans` counts the maximal removed runs. With `texts`,
    `kept` is what is left as a string, without characters of which a part was removed; otherwise it is null.

    Null texts are empty. Rows with a null doc_id lose nothing and take nothing away. Rows with the same doc_id take nothing away
    from each other. Texts shorter than `length` are kept whole. An empty table gives no rows.
    """
    if length <= SPAN:
        raise ValueError(f"strings must be longer than {SPAN} bytes")
    names = ["doc_id", *(carry or [])]
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(carry or []), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, parts = -(-total // SLICE) or 1, -(-total // PART) or 1
    sliced = docs.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices).cast("bigint")))
    anchors = sliced.groupBy("slice").applyInArrow(tidied(_send_anchors(parts, length)), MESSAGE)
    repeated = anchors.groupBy("part").applyInArrow(tidied(_repeated), MESSAGE)
    pieces = sliced.groupBy("slice").cogroup(repeated.groupBy("slice")).applyInArrow(tidied(_send_pieces(parts, length)), MESSAGE)
    smallest = pieces.groupBy("part").applyInArrow(tidied(_smallest(length)), MESSAGE)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    schema = ", ".join([*kinds, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"])
    met = sliced.groupBy("slice").cogroup(smallest.groupBy("slice"))
    return met.applyInArrow(tidied(_remove(parts, length, names, texts)), schema)
