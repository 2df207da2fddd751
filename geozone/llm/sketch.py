"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, subtracted and peeled."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import slices

# Cells of a stored fingerprint, and the factor by which a sketch grows when it cannot be peeled.
CELLS = 18
GROW = 4
# A digest goes into one cell of each of so many parts of the table.
PARTS = 3
# A line is cut at sentence ends; what is longer than this is cut again every so many words or characters.
LONG = 240
WORDS = 24
# Documents of a run of neighbours, and the number of runs at most: they decide how work is dealt, not the result.
RUN_DOCS = 2_000
RUNS = 8_192

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- digests ------------------------------------------------------------------------------------------------


def mixed(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A well mixed 64-bit function of each number, another for each salt."""
    x = x + np.asarray(salt, np.uint64).reshape(-1) * _STEP + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def paragraphs(text: str) -> list[str]:
    """Lines cut at sentence ends. Longer ones, as in texts without any, are cut into runs of words or of characters."""
    out = []
    for part in text.replace(". ", ".\n").split("\n"):
        if len(part) <= LONG:
            if part:
                out.append(part)
            continue
        words = part.split(" ")
        if len(words) > WORDS:
            out += [" ".join(words[k : k + WORDS]) for k in range(0, len(words), WORDS)]
        else:
            out += [part[k : k + LONG] for k in range(0, len(part), LONG)]
    return out


def digests(text: str) -> np.ndarray:
    """Sorted digests of the paragraphs; the second of equal paragraphs has another digest than the first, and so on."""
    found = [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in paragraphs(text)]
    raw = np.sort(np.array(found, np.uint64))
    if len(raw) < 2:
        return raw
    head = np.concatenate([[True], raw[1:] != raw[:-1]])
    if head.all():
        return raw
    place = np.arange(len(raw))
    copy = (place - np.maximum.accumulate(np.where(head, place, 0))).astype(np.uint64)
    return np.where(copy > 0, mixed(raw ^ mixed(copy, 7), 8), raw)


# --- tables -------------------------------------------------------------------------------------------------


class Sketches:
    """Many sketches side by side in one table. A cell has a count, the sum (exclusive or) of its digests and of their check values.

    Sketch i has cells[i] cells; a digest goes into one cell of each of its PARTS parts.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = np.asarray(cells, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.cells)])
        self.count = np.zeros(self.start[-1], np.int64)
        self.key = np.zeros(self.start[-1], np.uint64)
        self.check = np.zeros(self.start[-1], np.uint32)

    def places(self, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The cells of each digest of a sketch, a row for each part."""
        size = self.cells[owner] // PARTS
        spread = mixed(keys, self.cells[owner])
        parts = [(mixed(spread, k) % size.astype(np.uint64)).astype(np.int64) + k * size for k in range(PARTS)]
        return self.start[owner] + np.stack(parts)

    def add(self, owner: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        for at in self.places(owner, keys):
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, mixed(keys, 3).astype(np.uint32))

    def minus(self, other: Sketches, mine: np.ndarray, theirs: np.ndarray) -> Sketches:
        """Differences of pairs of sketches of one size."""
        size = int(self.cells[0]) if len(mine) else PARTS
        out = Sketches(np.full(len(mine), size))
        rows = lambda x, at: x.reshape(-1, size)[at].ravel()
        out.count = rows(self.count, mine) - rows(other.count, theirs)
        out.key = rows(self.key, mine) ^ rows(other.key, theirs)
        out.check = rows(self.check, mine) ^ rows(other.check, theirs)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of subtracted sketches: owner, digest and sign (1: only in the first) of what was recovered, and for each sketch whether that
        was all.

        A cell with a count of 1 or -1 and a matching check value holds one digest, which is taken out of all its cells; in each
        round all such cells of all sketches.
        """
        owner_of = np.repeat(np.arange(len(self.cells)), self.cells)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[mixed(self.key[pure], 3).astype(np.uint32) == self.check[pure]]
            if not len(pure):
                break
            owner, keys = owner_of[pure], self.key[pure]
            # A digest that is alone in several cells is taken from the first of them.
            single = np.zeros(len(self.count), bool)
            single[pure] = True
            first = np.full(len(pure), len(self.count))
            for at in self.places(owner, keys):
                first = np.where(single[at] & (self.key[at] == keys), np.minimum(first, at), first)
            own = first == pure
            owner, keys, signs = owner[own], keys[own], self.count[pure[own]]
            if not len(keys):
                break
            found.append((owner, keys, signs))
            self.add(owner, keys, -signs)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = np.bincount(owner_of[left], minlength=len(self.cells)) == 0
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return (*(np.concatenate(x) for x in zip(empty, *found, strict=True)), whole)

    def text(self, i: int, n: int) -> str:
        """A fingerprint: the number of paragraphs and the cells."""
        at = slice(self.start[i], self.start[i + 1])
        raw = self.count[at].astype("<i4").tobytes() + self.key[at].astype("<u8").tobytes() + self.check[at].astype("<u4").tobytes()
        return f"{n}:{base64.b64encode(raw).decode()}"


def sketches(versions: list[np.ndarray], cells: int | np.ndarray = CELLS) -> Sketches:
    """A sketch of each list of digests."""
    out = Sketches(np.broadcast_to(cells, len(versions)))
    owner = np.repeat(np.arange(len(versions)), [len(v) for v in versions])
    keys = np.concatenate([np.zeros(0, np.uint64), *versions])
    out.add(owner, keys, np.ones(len(keys), np.int64))
    return out


def read_fingerprint(text: str) -> tuple[int, Sketches]:
    """The number of paragraphs and the sketch of a fingerprint."""
    n, _, body = text.partition(":")
    raw = base64.b64decode(body)
    out = Sketches(np.array([len(raw) // 16]))
    c = len(raw) // 16
    out.count = np.frombuffer(raw, "<i4", c).astype(np.int64)
    out.key = np.frombuffer(raw, "<u8", c, 4 * c).astype(np.uint64)
    out.check = np.frombuffer(raw, "<u4", c, 12 * c).astype(np.uint32)
    return int(n), out


def differing(
    versions: list[np.ndarray], one: np.ndarray, other: np.ndarray, small: Sketches | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pairs of versions (by place in the list): the digests only in the first and only in the second.

    The small sketches are subtracted and peeled first; pairs that cannot be peeled get sketches of GROW times the cells, and so on until
    every pair has been. All pairs are peeled side by side.
    """
    small = small or sketches(versions)
    diff = small.minus(small, one, other)
    todo, cells = np.arange(len(one)), CELLS
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2] * len(one)
    while len(todo):
        owner, keys, signs, whole = diff.peel()
        order = np.argsort(owner, kind="stable")
        owner, keys, signs = owner[order], keys[order], signs[order]
        cuts = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k in np.flatnonzero(whole).tolist():
            at = slice(cuts[k], cuts[k + 1])
            out[todo[k]] = keys[at][signs[at] > 0], keys[at][signs[at] < 0]
        todo, cells = todo[~whole], cells * GROW
        if len(todo):
            mine = sketches([versions[k] for k in one[todo]], cells)
            diff = mine.minus(sketches([versions[k] for k in other[todo]], cells), np.arange(len(todo)), np.arange(len(todo)))
    return out


def likenesses(versions: list[np.ndarray], one: np.ndarray, other: np.ndarray, small: Sketches | None = None) -> list[float]:
    """Twice the number of common paragraphs over the number in both, 1 for two texts without any."""
    out = []
    for a, b, (only, rest) in zip(one.tolist(), other.tolist(), differing(versions, one, other, small), strict=True):
        total = len(versions[a]) + len(versions[b])
        out.append(round((total - len(only) - len(rest)) / total, 9) if total else 1.0)
    return out


# --- neighbours ---------------------------------------------------------------------------------------------


def with_next(docs: DataFrame) -> DataFrame:
    """(run, tail, doc_id, text): the documents in runs of neighbouring ids, each run followed by the first document of the next
    run (`tail` true), the last run by the first document of all. Sorted within partitions; no run is split.

    Runs are cut at approximate quantiles of the ids, so they are of like size whatever the ids are. Only quantiles and the first
    id of each run pass through the driver: RUNS numbers at most.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    parts = min(RUNS, max(1, -(-n // RUN_DOCS)))
    cuts = [k / parts for k in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", cuts, 20_000)).first()[0] if cuts else []
    bounds = np.unique(np.array([x for x in found or [] if x is not None], np.int64))

    def run_of(column: pa.Array) -> np.ndarray:
        known = column.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(column.is_null().to_numpy(zero_copy_only=False), -1, np.searchsorted(bounds, known, "right"))

    def first_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            yield pa.record_batch([pa.array(run_of(column), pa.int64()), column], names=["run", "doc_id"])

    first = ids.mapInArrow(first_of, "run bigint, doc_id bigint").groupBy("run").agg(F.min("doc_id").alias("doc_id"))
    heads = sorted((r.run, r.doc_id) for r in first.collect())
    before = {doc_id: heads[k - 1][0] for k, (_, doc_id) in enumerate(heads)}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, ids, text = run_of(batch.column("doc_id")), batch.column("doc_id"), batch.column("text")
            flags = np.zeros(len(own), bool)
            yield pa.record_batch([pa.array(own, pa.int64()), pa.array(flags), ids, text], names=["run", "tail", "doc_id", "text"])
            again = [k for k, x in enumerate(ids.to_pylist()) if x in before]
            if again:
                at = pa.array(again)
                runs = pa.array([before[x] for x in ids.take(at).to_pylist()], pa.int64())
                yield pa.record_batch([runs, pa.array([True] * len(again)), ids.take(at), text.take(at)], names=["run", "tail", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "run bigint, tail boolean, doc_id bigint, text string")
    return dealt.repartition("run").sortWithinPartitions("run", "tail", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    held: tuple | None = None  # the document that waits for the next one: run, id, text, digests
    for batch in slices(batches, limit=4 << 20):
        versions: list[np.ndarray] = []
        rows: list[tuple] = []  # id, text, edited text, and where the digests of the text, the edited and the next text are
        if held is not None:
            versions.append(held[3])
        for run, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("run", "tail", "doc_id", "text")), strict=True):
            versions.append(digests(text))
            if held is not None and held[0] == run:
                edited = edited_text(held[2], text)
                versions.append(digests(edited))
                rows.append((held[1], held[2], edited, held[4], len(versions) - 1, len(versions) - 2))
                at = len(versions) - 2
            else:
                at = len(versions) - 1
            held = None if tail else (run, doc_id, text, versions[at], at)
        if rows:
            own, new, following = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
            small = sketches(versions)
            near = likenesses(versions, np.concatenate([own, own]), np.concatenate([new, following]), small)
            columns = [
                [r[0] for r in rows],
                [len(r[1]) for r in rows],
                [hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest() for r in rows],
                [small.text(k, len(versions[k])) for k in own.tolist()],
                [small.text(k, len(versions[k])) for k in new.tolist()],
                near[: len(rows)],
                near[len(rows) :],
            ]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if held is not None:
            held = (*held[:4], 0)


def compare_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of `docs` (doc_id,
    text; other columns are not read).

    A fingerprint is the number of paragraphs and a small sketch of their digests, the same for equal texts. Two are compared by
    subtracting sketches and peeling off the differing digests; where the small ones do not suffice, larger ones are made.
    Likeness is exact: twice the number of common paragraphs over all of both.

    The next document is the one with the next doc_id; null ids come first, rows with the same id by their texts, and the last is
    followed by the first (a single row by itself). Null texts count as empty. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_next(docs).mapInArrow(_results, RESULT)
