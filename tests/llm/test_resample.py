"""Importance resampling against plain counting of every feature."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from geozone.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def runs_of(text):
    words = words_of(text)
    return [[" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in (1, 2, 3)]


def buckets_of(text):
    return [zlib.crc32(f.encode()) % 10_000 for runs in runs_of(text) for f in runs]


def want(rows, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for b in buckets_of(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out, able = [], []
    for doc_id, text in rows:
        found = buckets_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        row = [doc_id, len(found), weight, score, None]
        out.append(row)
        if len(words_of(text)) >= 20:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def got(docs, target):
    out = resample.resample(docs, target)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def target_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


EDGES = [
    None,
    "",
    " .,;- ",
    "One",
    "two words",
    "É Ab-c_d'e 1٣x y z",
    "the same words again " * 8,
    "the same words again " * 8,
    "w" * 70_000 + " b " + "c" * 66_000,
    "very long text of many words " * 20_000,
    *[f"document {i} is about topic {i % 7} and " + " ".join(f"word{(i * k) % 53}" for k in range(25)) for i in range(80)],
]


def test_like_plain_counting(spark, docs_of):
    rows = [*enumerate(EDGES), (None, "no id " * 10), (3, "again 3"), (12, EDGES[12]), (13, EDGES[12])]
    target = ["Topic 3 is what the questions ask about", None, "", "same words"]
    assert got(docs_of(rows), target_of(spark, target)) == want(rows, target)


def test_many_small_chunks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK_BYTES", 64)
    monkeypatch.setattr(resample, "LONG", 40)
    texts = [t for t in EDGES if t is None or len(t) < 5_000] + ["z" * 50 + " a " + "y" * 39 + "  " + "x" * 200]
    words, crcs, owners = resample.features(texts)
    assert words.tolist() == [len(words_of(t)) for t in texts]
    for n in range(3):
        assert crcs[n].tolist() == [zlib.crc32(f.encode()) for t in texts for f in runs_of(t)[n]]
        assert owners[n].tolist() == [i for i, t in enumerate(texts) for _ in runs_of(t)[n]]


def test_empty_tables(spark, docs_of):
    rows = list(enumerate(EDGES[:7]))
    assert got(docs_of([]), target_of(spark, ["a"])) == []
    assert got(docs_of(rows), target_of(spark, [])) == want(rows, [])


@pytest.mark.parametrize("size", [0, 1, 2, 7, 64, 1000, 100_001])
def test_checksums_compose(size):
    """A checksum moved on by a text's length, and the text's own, give that of both together."""
    head, tail = b"some text in front", bytes(i * 7 % 256 for i in range(size))
    moved = resample.SHIFT(np.array([zlib.crc32(head)], np.uint32), np.array([size]))[0]
    assert int(moved) ^ zlib.crc32(tail) == zlib.crc32(head + tail)
