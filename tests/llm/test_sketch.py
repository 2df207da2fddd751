import hashlib

import numpy as np
import pytest

from geozone.llm import sketch as K


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited), like(text, following)))
    return sorted(out)


def like(one, other):
    a, b = (sorted(K.paragraphs(t)) for t in (one, other))
    common, rest = 0, list(b)
    for p in a:
        if p in rest:
            rest.remove(p)
            common += 1
    return round(2 * common / (len(a) + len(b)), 9) if a or b else 1.0


@pytest.mark.parametrize("run_docs", [1, 7, 2_000])
def test_like_brute_force(spark, docs_of, monkeypatch, run_docs):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "Überall", "漢字", "delta."]
    rows = []
    for k in range(60):
        lines = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(rng.integers(0, 40))]
        rows.append((int(k * k - 50), "\n".join(lines)))
    rows += [(5_000, rows[3][1]), (5_001, rows[3][1]), (5_001, rows[4][1]), (None, "no id"), (None, None), (9_000, None), (9_001, "")]
    rows += [(9_002, "same line\n" * 500), (9_003, "x" * 70_001), (9_004, "word " * 9_000)]
    monkeypatch.setattr(K, "RUN_DOCS", run_docs)
    got = K.compare_versions(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == brute(rows)
    prints = {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in got:
        if len(texts[r.doc_id]) == 1:
            prints.setdefault(next(iter(texts[r.doc_id])), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_few_rows(spark, docs_of):
    assert K.compare_versions(docs_of([])).collect() == []
    (row,) = K.compare_versions(docs_of(["ab. cd"])).collect()
    assert (row.n_chars, row.near_edited, row.near_next) == (6, like("ab. cd", "ab.ab."), 1.0)


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(0)
    versions, wanted = [], []
    for size in (0, 1, 5, 50, 3_000):
        both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        one, other = (rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(2))
        versions += [np.concatenate([both, one]), np.concatenate([other, both])]
        wanted.append((set(one), set(other)))
    versions.append(np.zeros(0, np.uint64))
    at = np.arange(5)
    got = K.differing(versions, np.append(2 * at, [0, 10]), np.append(2 * at + 1, [10, 10]))
    assert [(set(a), set(b)) for a, b in got[:5]] == wanted
    assert (set(got[5][0]), len(got[5][1]), len(got[6][0])) == (set(versions[0]), 0, 0)


def test_fingerprints_can_be_read_back():
    keys = K.digests("one line\nanother line\none line")
    n, sketch = K.read_fingerprint(K.sketches([keys]).text(0, len(keys)))
    assert n == 3
    other = K.sketches([keys[:2]])
    owner, found, signs, whole = sketch.minus(other, np.array([0]), np.array([0])).peel()
    assert set(found) == set(keys[2:]) and set(signs) == {1} and whole.all()
