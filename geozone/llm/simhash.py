"""Near duplicates by SimHash: bit-sliced comparison inside candidate buckets, groups by connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import fixed_words, gathered, slices, tidied
from geozone.llm.components import components
from geozone.session import written

SEED = 42
# Fingerprints of one bucket that are compared in one tile; larger buckets are dealt over several tiles.
TILE = 4096
# Bits of a set's parity; counters of shingles, and the parts in which they are added up.
PARITY = 1024
COUNTERS = 1 << 20
PARTS = 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BELOW = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)


# --- fingerprints -------------------------------------------------------------------------------------------


def runs_of(text: str | None, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of `text`, joined by spaces, with the starts and ends of all runs of `words` words; a shorter text is one run,
    one without words has none. Only A-Z are lower-cased; words are parted by the six ASCII space characters."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    if len(found) <= words:
        return joined, np.zeros(min(1, len(found)), np.int64), ends[-1:]
    starts = ends - size
    return joined, starts[: len(found) - words + 1], ends[words - 1 :]


def shingles(text: str | None, words: int) -> list[bytes]:
    """All runs of `words` words, repeats included; see `runs_of`."""
    joined, starts, ends = runs_of(text, words)
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def set_hashes(text: str | None, words: int, lanes: int = 1) -> list[np.ndarray]:
    """Hashes of the distinct shingles in each lane, in the order of the first lane's. Shingles are distinct if their hashes are;
    no more than a slice of them stands beside the text."""
    joined, starts, ends = runs_of(text, words)
    out = []
    for lane in range(lanes):
        own = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), 16384):
            part = zip(starts[at : at + 16384].tolist(), ends[at : at + 16384].tolist(), strict=True)
            own[at : at + 16384] = hashed([joined[a:b] for a, b in part], lane)
        if not lane:
            own, first = np.unique(own, return_index=True)
            starts, ends = starts[first], ends[first]
        out.append(own)
    return out


def fingerprint(text: str | None, words: int, lanes: int = 1) -> bytes:
    """`lanes` x 64 bits, little-endian; bit k of a lane is set if it is set in over half of the shingles' hashes.

    Lane i hashes with XXH64 and seed 42 + i. A text without words has the fingerprint zero.
    """
    runs = shingles(text, words)
    return b"".join(majority(hashed(runs, lane)) for lane in range(lanes))


def hashed(runs: list[bytes], lane: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED + lane) for s in runs), np.uint64, len(runs))


def majority(hashes: np.ndarray) -> bytes:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, words: int = 5, lanes: int = 1) -> DataFrame:
    """(doc_id, fp binary) for every row of `docs` (doc_id, text). Null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[str | None, bytes] = {}
            out = []
            for text in batch.column("text").to_pylist():
                if text not in known:
                    known[text] = fingerprint(text, words, lanes)
                out.append(known[text])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp binary")


# --- bit-sliced comparison ----------------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical layout: row b holds bit b of all fingerprints, 64 of them in a word."""
    n, width = fps.shape
    padded = np.zeros((-(-n // 64) * 64, width), np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _over(counter: list[np.ndarray], full: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above `radius`, or has overflowed."""
    above, level = full.copy(), np.full_like(full, _ALL)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            level &= counter[k]
        else:
            above |= level & counter[k]
            level &= ~counter[k]
    return above


def near_pairs(
    fps: np.ndarray, ends: np.ndarray, radius: int, chunk: int = 8192, step: int = 8
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j < ends[i] whose fingerprints differ in at most `radius` bits; rows of a bucket stand together.

    Each row is held against words of 64 other rows at once. Bit planes are added in pairs by carry-save adders
    into bit-sliced counters; after every `step` planes, words whose lanes all exceed the radius are abandoned.
    """
    planes = planes_of(fps)
    rows = np.arange(len(fps))
    row_bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    first, last = rows // 64, np.where(ends > rows + 1, (ends - 1) // 64, -1)
    for off in range(int((last - first).max(initial=-1)) + 1):
        todo = np.flatnonzero(first + off <= last)
        for at in range(0, len(todo), chunk):
            row = todo[at : at + chunk]
            word = first[row] + off
            base = word * 64
            valid = _BELOW[np.clip(ends[row] - base, 0, 64)] & ~_BELOW[np.clip(row + 1 - base, 0, 64)]
            full = ~valid
            counter = [np.zeros(len(row), np.uint64) for _ in range(max(2, (radius + 1).bit_length()))]
            for bit in range(0, len(planes), 2):
                d1 = planes[bit][word] ^ (np.uint64(0) - row_bits[row, bit].astype(np.uint64))
                d2 = planes[bit + 1][word] ^ (np.uint64(0) - row_bits[row, bit + 1].astype(np.uint64))
                part = counter[0] ^ d1
                carry = (counter[0] & d1) | (part & d2)
                counter[0] = part ^ d2
                for k in range(1, len(counter)):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                full |= carry
                if (bit + 2) % step == 0:
                    alive = _over(counter, full, radius) != _ALL
                    if not alive.all():
                        row, word, full = row[alive], word[alive], full[alive]
                        counter = [c[alive] for c in counter]
                        if not len(row):
                            break
            if len(row):
                hit = ~_over(counter, full, radius)
                a, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                if len(a):
                    yield row[a], word[a] * 64 + lane


class Forest:
    """Union of pairs of local positions, smallest position as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                return up
            up = higher

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


Compare = Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def _bucket_links(batches: Iterable[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """Links inside buckets; the input is sorted by bucket. A bucket has at most about two tiles of rows.

    `compare` gets whole buckets and, for each row, the end of its bucket.
    """
    rest: pa.Table | None = None
    stream = gathered(batches, 200_000)
    held = next(stream, None)
    while held is not None:
        upcoming = next(stream, None)
        held = held if rest is None else pa.concat_tables([rest, held])
        bucket = np.stack([held.column(c).to_numpy() for c in ("key", "lo", "hi")])
        change = np.flatnonzero((bucket[:, 1:] != bucket[:, :-1]).any(axis=0)) + 1
        cut = held.num_rows if upcoming is None else int(change[-1]) if len(change) else 0
        rest, part = held.slice(cut), held.slice(0, cut)
        held = upcoming
        if cut:
            bounds = np.append(change[change < cut], cut)
            yield from compare(part, np.repeat(bounds, np.diff(bounds, prepend=0)))


def _compare(part: pa.Table, ends: np.ndarray, radius: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    node, fps = part.column("node").to_numpy(), fixed_words(part.column("fp"))
    if nearest:
        # Each row keeps the link to the closest row with a smaller node.
        best = np.full(len(fps), 1 << 30)
        other = np.full(len(fps), -1)
        for i, j in near_pairs(fps, ends, radius):
            apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)
            older = node[i] < node[j]
            late, early = np.where(older, j, i), np.where(older, i, j)
            order = np.lexsort((node[early], apart, late))
            late, early, apart = late[order], early[order], apart[order]
            head = np.flatnonzero(np.diff(late, prepend=-1))
            late, early, apart = late[head], early[head], apart[head]
            better = (apart < best[late]) | ((apart == best[late]) & (node[early] < node[other[late]]))
            best[late[better]], other[late[better]] = apart[better], early[better]
        own = np.flatnonzero(other >= 0)
        a, b = node[own], node[other[own]]
    else:
        forest = Forest(len(fps))
        for i, j in near_pairs(fps, ends, radius):
            forest.join(i, j)
        root = forest.roots(np.arange(len(fps)))
        own = np.flatnonzero(root != np.arange(len(fps)))
        a, b = node[own], node[root[own]]
    if len(a):
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


# --- candidate buckets --------------------------------------------------------------------------------------


def block_tables(radius: int, bits: int = 64, spare: int = 2) -> list[list[int]]:
    """Bit positions of each table: of radius + `spare` blocks, every choice of `spare`.

    Fingerprints within the radius agree on at least `spare` whole blocks, so they meet in some table: no link is
    lost. More spare blocks give longer keys and smaller buckets for very large inputs, at the price of more tables.
    """
    cuts = np.linspace(0, bits, radius + spare + 1).astype(int)
    blocks = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen, []) for chosen in combinations(blocks, spare)]


def sampled_tables(tables: int, key_bits: int, bits: int, seed: int = SEED) -> list[list[int]]:
    """Bit positions of each table, drawn at random: two fingerprints that differ in a part p of their bits meet in
    a table with probability about (1 - p) ** key_bits."""
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, key_bits, replace=False).tolist()) for _ in range(tables)]


def bucketed(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(key, node, fp): a row for each table, `key` made of the table's number and its bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.unpackbits(fixed_words(batch.column("fp")).view(np.uint8), axis=1, bitorder="little")
            for number, positions in enumerate(tables):
                weight = np.int64(1) << np.arange(len(positions), dtype=np.int64)
                key = bits[:, positions].astype(np.int64) @ weight + (np.int64(number) << np.int64(len(positions)))
                yield pa.record_batch([pa.array(key), batch.column("node"), batch.column("fp")], names=["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key bigint, node bigint, fp binary")


def candidate_links(
    nodes: DataFrame, radius: int, tables: list[list[int]], nearest: bool = False, tile: int = TILE
) -> DataFrame:
    """(a, b) between nodes (node bigint, fp binary; distinct) that share a bucket and differ in `radius` bits at most.

    Not all pairs: per bucket a forest that connects what is linked, or with `nearest` each node's link to its
    closest smaller node. A bucket of more than `tile` rows is dealt over tiles of pairs of parts, each of which a
    task compares alone, so no bucket has to fit into a task and none is cut short.
    """
    keyed = bucketed(nodes, tables)
    # Few keys at most: written, they are known to be small, and the rows are dealt once.
    large = written(keyed.groupBy("key").count().filter(F.col("count") > tile), "bucket-sizes")
    together = _dealt(keyed.join(large, "key", "left"), "fp", tile, ["node", "fp"], ["node"])
    run = lambda batches: _bucket_links(batches, lambda part, ends: _compare(part, ends, radius, nearest))
    return together.mapInArrow(run, "a bigint, b bigint").distinct()


def _dealt(keyed: DataFrame, by: str, tile: int, columns: list[str], order: list[str]) -> DataFrame:
    """`keyed` (key, count, columns) as tiles (key, lo, hi) of pairs of parts: any two rows of a key share a tile."""
    parts = F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
    dealt = (
        keyed.withColumn("parts", parts)
        .withColumn("own", F.when(F.col("parts") > 1, own).otherwise(0))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *columns)
    )
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", *order)


# --- sets of shingles ---------------------------------------------------------------------------------------


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) % COUNTERS


def rare_part(hashes: np.ndarray, least: float, counts: np.ndarray) -> np.ndarray:
    """The first of a set's distinct hashes, in an order that all sets share: rare before common by `counts` (see
    `shingle_counts`), then by value.

    Two sets with a similarity of `least` or more share one of these: if all that they share came later, the set whose
    first part ends earlier could share no more than ceil(least * size) - 1. The empty set has the single hash 0.
    """
    if not len(hashes):
        return np.zeros(1, np.uint64)
    keep = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, counts[counter_of(hashes)]))[:keep]]


def parity(hashes: np.ndarray, bits: int = PARITY) -> bytes:
    """`bits` bits of a set: bit k tells if an odd number of hashes is k modulo `bits`. Two sets that are not the same
    in d hashes differ in d bits at most."""
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_bits(size: int) -> int:
    """Bits of a set's wide parity: a power of two, at least four for each hash, so that few differences cancel out."""
    return max(PARITY, 1 << (4 * size - 1).bit_length()) if size else PARITY


def differing(one: bytes, other: bytes) -> int:
    """Bits in which two parities differ, the wider one folded to the width of the other: a lower bound on the hashes that
    only one of the two sets has."""
    a, b = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all `texts` (text) fall to each of COUNTERS counters, each distinct shingle of a text once. A counter is
    never below the number of texts with one of its shingles. The order of `rare_part` is made from them, so they change how
    many candidates there are, not which pairs are found. A task adds up its own texts; the sums, of a size that does not
    follow the input, go through the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTERS, np.int32)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                np.add.at(own, counter_of(set_hashes(text, words)[0]), 1)
        parts = [x.tobytes() for x in own.reshape(PARTS, -1)]
        yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(_key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // PARTS, np.int64)
        for own in rows.column("counts"):
            total += np.frombuffer(own.as_py(), np.int32)
        return pa.table([rows.column("part")[:1], pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    added = texts.select("text").mapInArrow(run, schema).groupBy("part").applyInArrow(tidied(add), schema)
    counts = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for row in added.collect():
        counts[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return counts.ravel()


def set_prints(texts: DataFrame, words: int, lanes: int, least: float) -> DataFrame:
    """(node, fp, size, parity, wide, rare) of the set of shingles of each of `texts` (node, text)."""
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, sizes, odd, wide, rare = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = set_hashes(text, words, lanes)
                fps.append(b"".join(map(majority, own)))
                first = own[0]
                sizes.append(len(first))
                odd.append(parity(first))
                wide.append(parity(first, wide_bits(len(first))))
                rare.append(rare_part(first, least, counts.value).view(np.int64))
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            made = [pa.array(c, kind) for c, kind in zip([fps, sizes, odd, wide, rare], kinds, strict=True)]
            yield pa.record_batch([batch.column("node"), *made], names=["node", "fp", "size", "parity", "wide", "rare"])

    schema = "node bigint, fp binary, size bigint, parity binary, wide binary, rare array<bigint>"
    return texts.select("node", "text").mapInArrow(run, schema)


def _sharing(part: pa.Table, ends: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket that sizes and parities leave open; the rows of a bucket are sorted by group, and pairs inside a
    group need no link."""
    node, group, size = (part.column(c).to_numpy() for c in ("node", "grp", "size"))
    odd = fixed_words(part.column("parity"))
    last = np.append(np.flatnonzero((np.diff(group) != 0) | (np.diff(ends) != 0)) + 1, len(group))
    beyond = np.repeat(last, np.diff(last, prepend=0))
    row, off, held, n = np.arange(len(node)), 0, [], 0
    while True:
        row = row[beyond[row] + off < ends[row]]
        if not len(row):
            break
        for at in range(0, len(row), 65_536):
            i = row[at : at + 65_536]
            j = beyond[i] + off
            open_ = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[open_], j[open_]
            apart = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            open_ = (1 + least) * apart <= (1 - least) * (size[i] + size[j]) + 1e-6
            held.append((node[i[open_]], node[j[open_]]))
            n += len(held[-1][0])
            if n > 100_000 or len(held) > 10_000:
                yield _link_rows(held)
                held, n = [], 0
        off += 1
    if n:
        yield _link_rows(held)


def _link_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(c) for c in zip(*held, strict=True))
    return pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def sharing_links(prints: DataFrame, roots: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(a, b): all pairs of `prints` (see `set_prints`) that may have a similarity of `least` and are in different groups of
    `roots` (node, root), and others besides.

    Pairs meet in the buckets of the hashes of `rare_part`, so none is lost. Buckets of a single group are left out before
    any row is moved, and large ones are dealt over tiles.
    """
    grouped = prints.select("node", "rare").join(roots, "node", "left")
    marks = grouped.select("node", F.coalesce("root", "node").alias("grp"), F.explode("rare").alias("key"))
    met = marks.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count(F.lit(1)).alias("count"))
    met = written(met.filter("low < high").select("key", "count"), "near-shared")
    rows = marks.join(met, "key").join(prints.select("node", "size", "parity"), "node")
    together = _dealt(rows, "node", tile, ["node", "grp", "size", "parity"], ["grp", "node"])
    run = lambda batches: _bucket_links(batches, lambda part, ends: _sharing(part, ends, least))
    return together.mapInArrow(run, "a bigint, b bigint").distinct()


# --- operators ----------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, spare: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text; other columns are not read).

    Documents link where their 64-bit fingerprints differ in at most `radius` bits; `component_id` is the smallest
    doc_id that can be reached over links, its own included. Equal fingerprints are one node, so copies cost no
    comparisons; different ones are compared in the buckets of `block_tables`, which lose no link.

    Null and empty texts, and those of white space only, have the fingerprint zero and link like any other. Rows with
    a null doc_id take part and have the smallest doc_id of the others as component, null if there is none. Repeated
    rows come out as often as they go in. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, words), "simhash")
    return grouped(prints, radius, spare)


def grouped(prints: DataFrame, radius: int, spare: int = 2) -> DataFrame:
    """Components of written fingerprints (doc_id, fp)."""
    numbered = prints.withColumn("node", F.conv(hex_digits(), 16, -10).cast("bigint"))
    nodes = numbered.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least"))
    nodes = written(nodes, "simhash-nodes")
    roots = components(candidate_links(nodes, radius, block_tables(radius, spare=spare)), "simhash-links")
    placed = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("node", "component_id")
    return numbered.join(named, "node").select("doc_id", hex_digits().alias("fingerprint"), "component_id")


def hex_digits():
    """The fingerprint as a number's 16 hexadecimal digits: the bytes are little-endian, so they are turned round."""
    digits = [F.substring(F.lower(F.hex("fp")), 15 - 2 * k, 2) for k in range(8)]
    return F.concat(*digits)


def similarity(one: str | None, other: str | None, words: int) -> float:
    """Jaccard similarity of the two sets of shingles; 1 for two texts without words, which are copies of nothing else."""
    a, b = set(shingles(one, words)), set(shingles(other, words))
    return len(a & b) / len(a | b) if a or b else 1.0


def text_digest():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def near_copies(
    docs: DataFrame,
    words: int = 5,
    least: float = 0.8,
    lanes: int = 4,
    radius: int = 52,
    tables: int = 48,
    key_bits: int = 16,
) -> DataFrame:
    """(doc_id, text_digest, component_id, first) for every distinct (doc_id, text) of `docs`.

    Documents are one group where a chain of pairs with a Jaccard similarity of `least` or more over shingles of
    `words` words joins them; no such pair is lost. Equal texts are one node. Groups are first drawn together by wide
    fingerprints (`lanes` x 64 bits) of the distinct shingles, so a line repeated in one of two copies weighs no more there
    than in the similarity: each node is linked to its closest smaller one within `radius` in every bucket of the
    sampled `tables`. That finds most pairs, not all. Then all pairs of different groups that share one of their rare
    shingles (`sharing_links`) and whose sizes and parities allow `least` are candidates, whatever their fingerprints.
    Every link that joins is checked on the whole texts, so nothing below `least` is ever joined; links between documents that
    others join already are not. Very long texts are one text like others, with a parity as wide as they need.

    `component_id` is the smallest doc_id of the group, null if none of its rows has one; `first` is true for one row of each
    group, that with the smallest doc_id, then the smallest digest. Null and empty texts are equal texts. Rows with a
    null doc_id take part, and so does each text of rows with the same doc_id. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_digest().alias("text_digest"))
    ids = written(docs.select("doc_id", "text_digest").distinct(), "near-ids")
    # Written, so that a text keeps its number.
    whole = docs.select("text_digest", "text").dropDuplicates(["text_digest"]).withColumn("node", F.monotonically_increasing_id())
    whole = written(whole, "near-texts")
    prints = written(set_prints(whole, words, lanes, least), "near-prints")
    found = candidate_links(prints.select("node", "fp"), radius, sampled_tables(tables, key_bits, 64 * lanes), nearest=True)
    roots = components(_verified(whole, prints, written(found, "near-links"), words, least), "near-groups")
    more = written(sharing_links(prints, roots, least), "near-more")
    links = roots.toDF("a", "b").unionByName(_verified(whole, prints, more, words, least))
    roots = components(links, "near-groups")
    grouped = whole.select("node", "text_digest").join(roots, "node", "left").select("text_digest", F.coalesce("root", "node").alias("grp"))
    placed = written(ids.join(grouped, "text_digest"), "near-placed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_digest")
    least_row = placed.groupBy("grp").agg(F.min(order).alias("least_row"))
    first = order.eqNullSafe(F.col("least_row"))
    return placed.join(least_row, "grp").select("doc_id", "text_digest", F.col("least_row.doc_id").alias("component_id"), first.alias("first"))


def _verified(whole: DataFrame, prints: DataFrame, links: DataFrame, words: int, least: float) -> DataFrame:
    """Links whose texts have a similarity of `least` or more: not all such of `links`, but enough to join the same documents.

    Wide parities leave out nearly all links below `least` before a text is moved. Of the others each document's most alike partner
    comes first; what these join needs no further look, and all other links between different groups follow.
    """
    left = written(_possible(prints, links, least), "near-possible")
    best = left.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "best.b")
    best = written(_alike(whole, written(best, "near-best"), words, least), "near-alike")
    roots = components(best, "near-joined")
    grp = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rest = left.join(grp("a"), "a", "left").join(grp("b"), "b", "left")
    rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    rest = written(_alike(whole, written(rest, "near-rest"), words, least), "near-alike")
    return best.unionByName(rest)


def _possible(prints: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """(a, b, apart) of the links that sizes and wide parities allow; `apart` is the bound on the hashes that only one has,
    as a part of both sizes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "wide_a"):
            odd = zip(batch.column("wide_a").to_pylist(), batch.column("wide_b").to_pylist(), strict=True)
            apart = np.fromiter((differing(one, other) for one, other in odd), np.int64, batch.num_rows)
            a, b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            open_ = ((1 + least) * apart <= (1 - least) * (a + b) + 1e-6) & (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9)
            out = [batch.column("a"), batch.column("b"), pa.array(apart / np.maximum(a + b, 1))]
            yield pa.record_batch(out, names=["a", "b", "apart"]).filter(pa.array(open_))

    own = prints.select("node", "size", "wide")
    pairs = links.join(own.toDF("a", "size_a", "wide_a"), "a").join(own.toDF("b", "size_b", "wide_b"), "b")
    return pairs.mapInArrow(run, "a bigint, b bigint, apart double")


def _alike(whole: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The `pairs` (a, b; distinct) whose whole texts have a similarity of `least` or more. Each text goes once to each of its pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches):
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                if held and held[:2] == row[:2]:
                    if similarity(held[2], row[2], words) >= least:
                        found.append(row[:2])
                    held = None
                else:
                    held = row
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    met = ends.join(whole.select("node", "text"), "node").select("a", "b", "text")
    return met.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a bigint, b bigint")
