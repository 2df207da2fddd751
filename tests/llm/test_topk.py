import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geozone.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim int, body string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA)


def brute(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * float(np.float32(x))) for x in v]
            good.append((i, whole))
    found = {}
    for q, x in good:
        if q % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(x) == len(y)]
            found.setdefault(q, []).extend(scored)
    return sorted((q, r, i, -s) for q, scored in found.items() for r, (s, i) in enumerate(sorted(scored)[:k], 1))


def run(spark, rows, k=5):
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("tiles", [(32_768, 8_192), (100, 3)])
def test_matches_brute_force(spark, monkeypatch, tiles):
    monkeypatch.setattr(topk, "CANDIDATES", tiles[0])
    monkeypatch.setattr(topk, "QUERIES", tiles[1])
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(500, 40)) * rng.choice([0.1, 1, 3], (500, 1))).round(1).tolist()
    rows = list(enumerate(vectors))
    rows += [(1000 + i, vectors[0]) for i in range(12)]  # ties
    rows += [(7, vectors[7]), (7, vectors[8]), (50, vectors[51])]  # repeated ids
    rows += [(None, vectors[1]), (600, None), (650, [1.0, None]), (700, [float("nan")] * 40), (750, [float("inf")] * 40)]
    rows += [(800, [1.0, 2.0]), (801, [3.0, 4.0]), (850, []), (851, []), (900, [5.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_components_beyond_exact_doubles(spark):
    rows = [(i, [float(i * 2**17), 3.0e6 + i, -1.0]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5)


def test_rows_with_one_id_all_count(spark):
    rows = [(0, [1.0]), (1, [0.5]), (1, [0.9]), (2, [0.5])]
    assert run(spark, rows) == brute(rows, 5) == [(0, 1, 1, 58_880), (0, 2, 1, 32_768), (0, 3, 2, 32_768)]


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 256 * 128)]
