"""Importance resampling towards a target by hashed word runs, with checksums composed from an Aho-Corasick dictionary's payloads."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import slices
from geozone.operators.ordinal import ordinal
from geozone.session import written

# Buckets that features are counted in, and the longest run of words that is a feature (fixed values).
BUCKETS = 10_000
LONGEST_RUN = 3
# Documents with fewer words are not drawn; so many of a hundred others are (fixed values).
LEAST_WORDS = 20
DRAWN = 5
SEED = 42
# Text bytes whose distinct words make one dictionary, and the length from which a word is no entry of it: an entry takes memory
# for each of its bytes.
CHUNK_BYTES = 4 << 20
LONG = 1 << 16
# The checksum's polynomial, bits reversed (fixed value).
POLYNOMIAL = 0xEDB88320

_DELIMITER = b" "
_LENGTH_SHIFT = 32


def _letters() -> bytes:
    """What each byte of UTF-8 becomes: A-Z lower case, other letters, digits and all bytes beyond ASCII themselves, the rest a delimiter."""
    table = bytearray(_DELIMITER * 256)
    for byte in [*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]:
        table[byte] = byte
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    return bytes(table)


LETTERS = _letters()


class Shift:
    """Checksums moved on by zero bytes: what a checksum becomes in front of so many bytes is a linear map of its bits."""

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
        # By one byte: the low byte goes through the table, the others move down. Tables of the four bytes' images.
        first = np.stack([one, *[np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]])
        self.steps = [first]

    def _apply(self, k: int, crc: np.ndarray) -> np.ndarray:
        """On by 2 ** k bytes."""
        while len(self.steps) <= k:
            last = len(self.steps) - 1
            self.steps.append(self._apply(last, self.steps[last].ravel()).reshape(4, 256))
        step = self.steps[k]
        return step[0][crc & 255] ^ step[1][(crc >> 8) & 255] ^ step[2][(crc >> 16) & 255] ^ step[3][crc >> 24]

    def __call__(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = crc.copy()
        for k in range(int(by.max()).bit_length() if len(by) else 0):
            some = np.flatnonzero((by >> k) & 1)
            out[some] = self._apply(k, out[some])
        return out


SHIFT = Shift()


def _payload(word: bytes) -> int:
    """A word's length and checksum in one number."""
    return len(word) << _LENGTH_SHIFT | zlib.crc32(word)


def _scan(chunk: bytes) -> np.ndarray:
    """Rows (end, payload) of the words of a delimited chunk, in order, as an automaton over its distinct words emits them.

    Every entry has its delimiters at both ends, so only whole words match; neighbours share the delimiter between them.
    """
    dictionary = ahocorasick.Automaton()
    for word in set(chunk.split()):
        if len(word) < LONG:
            dictionary.add_word((_DELIMITER + word + _DELIMITER).decode("latin-1"), _payload(word))
    dictionary.make_automaton()
    emitted = chain.from_iterable(dictionary.iter(chunk.decode("latin-1"))) if len(dictionary) else ()
    found = np.fromiter(emitted, np.int64).reshape(-1, 2)
    long = [(m.end(), _payload(m.group())) for m in re.finditer(rb"[^ ]{%d,}" % LONG, chunk)]
    if long:
        found = np.concatenate([found, np.array(long, np.int64)])
        found = found[np.argsort(found[:, 0], kind="stable")]
    return found


def _chunks(body: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a delimited text that begin and end with a delimiter, and where they start; no word is cut."""
    start = 0
    while start < len(body) - 1:
        end = start + CHUNK_BYTES
        end = len(body) - 1 if end >= len(body) else body.rfind(_DELIMITER, start + 1, end + 1)
        if end <= start:
            end = body.find(_DELIMITER, start + CHUNK_BYTES)
        yield start, body[start : end + 1]
        start = end


def features(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text, and for runs of 1, 2 and 3 words their checksums and the texts they are in."""
    bodies = [(t or "").encode("utf-8", "surrogatepass").translate(LETTERS) for t in texts]
    ends = np.cumsum([len(b) + 1 for b in bodies])
    body = _DELIMITER + _DELIMITER.join(bodies) + _DELIMITER
    parts = [_scan(chunk) + np.array([start, 0]) for start, chunk in _chunks(body)]
    found = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    # A word ends at the delimiter behind it, at the latest at that of its own text.
    owner = np.searchsorted(ends, found[:, 0], side="left")
    crc = (found[:, 1] & 0xFFFFFFFF).astype(np.uint32)
    size = found[:, 1] >> _LENGTH_SHIFT
    space = np.uint32(zlib.crc32(_DELIMITER))
    # `runs` has the checksum of every run of so many words, over the ends of texts too; `whole` are those inside one text.
    runs, crcs, owners = crc, [crc], [owner]
    for more in range(1, LONGEST_RUN):
        before, size_of_next, next_word = runs[: max(len(crc) - more, 0)], size[more:], crc[more:]
        # A delimiter, then the next word: each moves all in front of it on by its own length.
        head = SHIFT(before, np.ones(len(before), np.int64)) ^ space
        runs = SHIFT(head, size_of_next) ^ next_word
        whole = owner[more:] == owner[: len(runs)]
        crcs.append(runs[whole])
        owners.append(owner[more:][whole])
    return np.bincount(owner, minlength=len(texts)), crcs, owners


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any.

    A task adds up its own texts and hands on a row per bucket at most, so the shuffle does not grow with the texts' length.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for crc in features(batch.column("text").to_pylist())[1]:
                counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Whole-number log ratio of target and source frequency per bucket, in thousandths, each bucket counted once more than found.

    Takes `bucket_counts` of both; only a number per bucket comes to the driver, whatever the size of the tables.
    """
    counts = []
    for found in (source, target):
        counts.append([0] * buckets)
        for row in found.collect():
            counts[-1][row.bucket] = row.n
    all_source, all_target = map(sum, counts)
    ratio = [(t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets)) for s, t in zip(*counts, strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row: the sum of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in slices(batches):
            words, crcs, owners = features(batch.column("text").to_pylist())
            n, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for crc, owner in zip(crcs, owners, strict=True):
                sums = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                edges = np.searchsorted(owner, np.arange(len(words) + 1))
                n, total = n + np.diff(edges), total + np.diff(sums[edges])
            columns = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (words, n, total)]]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_features", "weight"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> Column:
    """A draw from the Gumbel distribution in thousandths, rounded down, from the seed and doc_id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    drawn: int = DRAWN,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of `docs` (doc_id, text): which to draw to look like `target` (text).

    Words are runs of ASCII letters and digits, lower case, and of all characters beyond ASCII. Features are all runs of one to three words,
    joined by a space; each counts in the bucket of its CRC-32. A document's weight is the sum of its features' gains (see
    `gains`), its score the weight and a seeded draw. Of the documents with `least_words` words, `drawn` in a hundred (rounded down)
    with the highest scores are ranked from 1, ties by smaller doc_id, then by weight and number of features; `rank` is null for the
    others.

    The texts are scanned twice, once to count and once to score, chunk by chunk: the distinct words of a chunk, between
    delimiters, are the entries of an automaton, which emits each word's checksum and length; checksums of runs are
    composed from their neighbours'. Words of 64 KiB and more are no entries; their checksums are taken where they stand. Memory
    follows the chunk, whatever the corpus or a text's length. The gains are `buckets` numbers, broadcast.

    Null and empty texts have no features, weight 0. Rows with null ids share one draw; repeated ids are rows of their own. An empty
    table gives no rows; with an empty target all its counts are 0. Runs jobs: both counts, the scores (a table in the shared
    folder), and those of `ordinal`.
    """
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets), buckets)
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + noise(seed))
    scored = written(scored, "resample")
    able = scored.filter(F.col("n_words") >= least_words)
    others = scored.filter(F.col("n_words") < least_words)
    order = able.withColumn("__down", -F.col("score"))
    ranked = ordinal(order, [], ["__down", "doc_id", "weight", "n_features"], out="__ord")
    n_drawn = able.count() * drawn // 100
    rank = F.when(F.col("__ord") < n_drawn, F.col("__ord") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(others.select(*columns, F.lit(None).cast("bigint").alias("rank")))
