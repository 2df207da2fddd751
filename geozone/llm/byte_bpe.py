"""Byte-level BPE by a segment tree of pair ranks, and decoding through the rank table."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import slices

# Words and bytes of words whose ids a Python worker remembers before it starts anew. Longer words are not kept, and merged one by one.
WORDS = 300_000
KEPT_BYTES = 24 << 20
LONG = 128
# Text bytes that are split at a time, words that are merged side by side, and ids that are decoded at a time.
TEXT_BYTES = 2 << 20
SIDE_BY_SIDE = 20_000
IDS = 500_000
# A rank beyond all others: no such pair.
NONE = 1 << 62
# White space of the regular expressions that the rank files' library uses: the Unicode property, spelled out, since the
# class of other engines also holds the four separators U+001C to U+001F (fixed values).
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> bytes:
    """The text of a rank file: a line per token, its bytes in base64 and its rank, which is its id."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(text: bytes) -> dict[bytes, int]:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}
    missing = [i for i in range(256) if bytes([i]) not in ranks]
    if missing or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("a rank file needs every byte as a token, and ranks from 0 without gaps")
    return ranks


def compiled(pattern: str) -> regex.Pattern:
    """The pre-token pattern, with white space as the rank files' library has it."""
    spelled = pattern.replace(r"[^\s", "[^" + WHITE_SPACE).replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(spelled)


class PairTree:
    """A segment tree over the byte positions of one word. Leaf i holds the rank of the pair that begins with the token at position
    i, and a node the least (rank, position) of its leaves, as one number; so the root is the leftmost pair of least rank."""

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        tree = [NONE] * size + keys + [NONE] * (size - len(keys))
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        self.size, self.tree = size, tree

    def set(self, pos: int, key: int) -> None:
        """A point update: up from the leaf, until a node keeps its value."""
        tree, node = self.tree, self.size + pos
        tree[node] = key
        while node > 1:
            other = tree[node ^ 1]
            least = key if key < other else other
            node >>= 1
            if tree[node] == least:
                return
            tree[node] = key = least

    def least(self) -> int:
        return self.tree[1]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word. Each merge takes the tree's root, joins two live neighbours and updates the three leaves it touches."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    shift = n.bit_length()
    get, mask = ranks.get, (1 << shift) - 1

    def key(start: int, end: int) -> int:
        rank = get(word[start:end])
        return NONE if rank is None else rank << shift | start

    tree = PairTree([key(i, i + 2) for i in range(n - 1)] + [NONE])
    # Where the token of a live position ends, and the live position before it.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree.least()) != NONE:
        pos = least & mask
        gone = end[pos]
        after = end[pos] = end[gone]
        tree.set(gone, NONE)
        if after < n:
            before[after] = pos
            tree.set(pos, key(pos, end[after]))
        else:
            tree.set(pos, NONE)
        if pos:
            tree.set(before[pos], key(before[pos], after))
    ids, pos = [], 0
    while pos < n:
        ids.append(ranks[word[pos : end[pos]]])
        pos = end[pos]
    return ids


class Forest:
    """The same trees for many words side by side, a row each: leaves and nodes are columns, a merge of every word is one step."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.rank_of = np.array([pairs[k] for k in self.pairs.tolist()] or [0], np.int64)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def key(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Rank and position of pairs as one number; NONE where the two tokens make no token."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == wanted if len(self.pairs) else np.zeros(len(wanted), bool)
        return np.where(known, self.rank_of[at] << 8 | pos, NONE)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most LONG bytes in a row, and how many each word has."""
        n = np.array([len(w) for w in words], np.int64)
        size = 1 << max(int(n.max()) - 1, 1).bit_length()
        rows, places = np.arange(len(words)), np.arange(size)
        live = places < n[:, None]
        token = np.zeros((len(words), size), np.int64)
        token[live] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(places + 1, token.shape).astype(np.int16)
        before = np.broadcast_to(places - 1, token.shape).astype(np.int16)
        tree = np.full((len(words), 2 * size), NONE, np.int64)
        row, pos = np.nonzero(live[:, 1:])
        tree[row, size + pos] = self.key(token[row, pos], token[row, pos + 1], pos)
        for first in (size >> k for k in range(1, size.bit_length())):
            below = tree[:, 2 * first : 4 * first]
            tree[:, first : 2 * first] = np.minimum(below[:, ::2], below[:, 1::2])
        while len(rows := rows[tree[rows, 1] != NONE]):
            least = tree[rows, 1]
            pos = least & 255
            gone = after[rows, pos].astype(np.int64)
            follow = after[rows, gone].astype(np.int64)
            previous = before[rows, pos].astype(np.int64)
            token[rows, pos] = least >> 8
            live[rows, gone] = False
            after[rows, pos] = follow
            inner, front = follow < n[rows], previous >= 0
            before[rows[inner], follow[inner]] = pos[inner]
            tree[rows, size + gone] = NONE
            tree[rows, size + pos] = NONE
            r, p = rows[inner], pos[inner]
            tree[r, size + p] = self.key(token[r, p], token[r, follow[inner]], p)
            r, p = rows[front], previous[front]
            tree[r, size + p] = self.key(token[r, p], token[r, pos[front]], p)
            # Up from the three leaves, level by level.
            nodes = [size + gone, size + pos, size + np.maximum(previous, 0)]
            for _ in range(size.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        return token[live], live.sum(axis=1)


class Encoder:
    """Ids of texts; the ids of a word are found once for as long as it is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.forest, self.find = ranks, Forest(ranks), compiled(pattern).findall
        self.start()

    def start(self) -> None:
        self.known: dict[str, int] = {}
        self.kept = 0
        # The ids of all known words in a row, and where each word's begin.
        self.ids = array("i")
        self.starts = array("q", [0])

    def learn(self, words: set[str]) -> dict[str, int]:
        """Finds the ids of new words; gives the places of those that are too long to be kept, which come last."""
        by_height: dict[int, list[str]] = {}
        long: list[str] = []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                long.append(word)
                continue
            if raw in self.ranks:
                self.known[word] = len(self.starts) - 1
                self._add([self.ranks[raw]])
            else:
                by_height.setdefault((len(raw) - 1).bit_length(), []).append(word)
            self.kept += len(raw) + 64
        for alike in by_height.values():
            for at in range(0, len(alike), SIDE_BY_SIDE):
                some = alike[at : at + SIDE_BY_SIDE]
                ids, sizes = self.forest.merged([w.encode("utf-8", "surrogatepass") for w in some])
                first = len(self.starts) - 1
                self.known.update(zip(some, range(first, first + len(some)), strict=True))
                self.starts.frombytes((len(self.ids) + np.cumsum(sizes)).astype(np.int64).tobytes())
                self.ids.frombytes(ids.astype(np.int32).tobytes())
        places = {}
        for word in long:
            places[word] = len(self.starts) - 1
            self._add(merged(word.encode("utf-8", "surrogatepass"), self.ranks))
        return places

    def _add(self, ids: list[int]) -> None:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        found = [self.find(t) if t else [] for t in texts]
        if len(self.known) > WORDS or self.kept > KEPT_BYTES:
            self.start()
        known = self.known
        long = self.learn({w for words in found for w in words if w not in known})
        look = known.__getitem__ if not long else (known | long).__getitem__
        codes = np.fromiter((c for words in found for c in map(look, words)), np.int64)
        starts, ids = np.array(self.starts), np.array(self.ids)
        sizes = starts[codes + 1] - starts[codes]
        # Place k of a word's ids is its start plus k; all of them in a row without a loop.
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + sizes, sizes)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(words) for words in found], dtype=np.int64)])]
        if long:
            first = min(long.values())
            del self.ids[self.starts[first] :], self.starts[first + 1 :]
        return ids[at], np.diff(edges)


_kept: dict[tuple[bytes, str], Encoder] = {}


def _encoder(text: bytes, pattern: str) -> Encoder:
    """The encoder of an earlier task with the same ranks on this Python worker, if there was one."""
    key = (hashlib.sha256(text).digest(), pattern)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(parse_ranks(text), pattern)
    return _kept[key]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of `docs` (doc_id, text; other columns are not read), ids as a list of int.

    `ranks` is a broadcast rank file, from `read_ranks`. Each match of `pattern` is merged separately, pairs of least rank first and
    leftmost among equals, without special tokens; a word that is a token itself is that token. Tasks need nothing from
    each other, so there is no shuffle. What a Python worker remembers is bounded by WORDS and KEPT_BYTES; words beyond LONG bytes
    are merged anew each time, by the same tree: its work is the number of bytes times the tree's height, so a very long word is no
    worse than many short ones. Null and empty texts have no ids. Rows with null or repeated ids come out as they go in.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, sizes = encoder.encode(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), _lists(ids, sizes)], names=["doc_id", "ids"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, ids array<int>")


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each has about IDS ids."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // IDS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)


_pieces: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _piece_table(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens by rank, in a row, and where each begins."""
    key = hashlib.sha256(text).digest()
    if key not in _pieces:
        _pieces.clear()
        by_rank = sorted(parse_ranks(text).items(), key=lambda item: item[1])
        starts = np.concatenate([[0], np.cumsum([len(piece) for piece, _ in by_rank])])
        _pieces[key] = np.frombuffer(b"".join(piece for piece, _ in by_rank), np.uint8), starts
    return _pieces[key]


def decode(encoded: DataFrame, ranks: Broadcast) -> DataFrame:
    """`encoded` (doc_id, ids) with `decoded`, the bytes of the tokens put together. An id that is no rank fails the query.

    Null ids decode to null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, starts = _piece_table(ranks.value)
        for batch in _cut(batches):
            column = batch.column("ids")
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(starts) - 1):
                raise ValueError("an id is no rank of the vocabulary")
            sizes = starts[ids + 1] - starts[ids]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], sizes)
            raw = pieces[at].tobytes()
            counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
            edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
            null = column.is_null().to_pylist()
            texts = [None if gone else raw[a:b] for gone, a, b in zip(null, edges, edges[1:], strict=False)]
            yield pa.record_batch([batch.column("doc_id"), column, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encode`, then `decode` of the ids, in digests.

    Edge cases as in `encode`; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    found = decode(encode(docs, shared, pattern), shared)
    numbers = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
