from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from geozone.llm import packing as P


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(60, rng.integers(1, 9), replace=False) + 1
    histogram = {int(n): int(rng.integers(1, 50)) for n in lengths}
    k = int(rng.integers(1, 5))
    bounds = P.best_boundaries(histogram, k)
    top = max(histogram)
    choices = [c for n in range(min(k, len(histogram))) for c in combinations(sorted(histogram)[:-1], n)]
    assert bounds[-1] == top and len(bounds) <= k and bounds == sorted(set(bounds))
    assert P.padding_of(histogram, bounds) == min(P.padding_of(histogram, [*c, top]) for c in choices)


def test_every_token_in_one_batch(spark, monkeypatch):
    monkeypatch.setattr(P, "SALTS", 7)
    rng = np.random.default_rng(0)
    rows = [(k, int(n)) for k, n in enumerate(rng.integers(0, 300, 400))]
    rows += [(None, 12), (None, None), (3, 40), (3, 40), (9999, 100_001), (9998, 128), (9997, 129)]
    lengths = spark.createDataFrame([(i, n, "x", 1) for i, n in rows], "doc_id bigint, n_tokens bigint, bucket string, salt int")
    got = P.pack(lengths, longest=128, buckets=4, budget=600).collect()
    want = Counter()
    for doc_id, n in rows:
        for start in range(0, n or 0, 128):
            want[doc_id, start // 128, start, min(128, n - start)] += 1
    assert Counter((r.doc_id, r.part, r.start, r.n_tokens) for r in got) == want
    bounds = P.best_boundaries(Counter(r.n_tokens for r in got), 4)
    batches = {}
    for r in got:
        assert r.bucket == min(b for b in bounds if b >= r.n_tokens)
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    last = {}
    for bucket, batch in batches:
        last[bucket] = max(batch, last.get(bucket, 0))
    for (bucket, batch), slots in batches.items():
        room = max(1, 600 // bucket)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= room
        assert batch == last[bucket] or len(slots) == room
    assert set(range(last[max(bounds)] + 1)) == {b for k, b in batches if k == max(bounds)}


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).collect() == []
