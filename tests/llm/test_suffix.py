import hashlib

import numpy as np
import pytest

from geozone.llm import suffix as X


def brute(rows, length=50):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        if doc_id is not None:
            for k in range(len(raw) - length + 1):
                s = raw[k : k + length]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc_id is not None:
            for k in range(len(raw) - length + 1):
                if first[raw[k : k + length]] < doc_id:
                    gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((str(doc_id), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample(seed):
    rng = np.random.default_rng(seed)
    words = ["ab", "the", "né", "漢", "x", "longer", "word", "\x00", "tail."]
    make = lambda n: " ".join(rng.choice(words, n))
    shared = [make(n) for n in (8, 15, 30, 80, 400)]
    rows = []
    for k in range(70):
        parts = [make(rng.integers(0, 60))]
        for _ in range(rng.integers(0, 4)):
            parts += [shared[rng.integers(len(shared))], make(rng.integers(0, 20))]
        rows.append((int(rng.integers(0, 1000)) * 7 - 300, "".join(parts)))
    rows += [(9000, rows[5][1]), (9000, rows[6][1]), (9001, rows[5][1]), (None, rows[5][1]), (None, None), (9002, None), (9003, "")]
    rows += [(9004, "a" * 3000), (9005, "a" * 2000 + "b" * 500), (9006, "b" * 49), (9007, "b" * 50), (9008, "ab" * 2000)]
    rows += [(9009, "ba" * 30), (9010, shared[4] * 20), (9011, "q" + shared[4] * 3)]
    return rows


@pytest.mark.parametrize("sizes", [(X.SLICE, X.PART, X.BATCH, X.CHUNK), (3000, 2000, 40, 700), (500, 100_000, 7, 64)])
def test_matches_brute_force(spark, docs_of, monkeypatch, sizes):
    for name, size in zip(("SLICE", "PART", "BATCH", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(X, name, size)
    rows = sample(sizes[0])
    got = X.remove_repeats(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_kept_texts_and_carried_columns(spark, docs_of):
    text = "".join(chr(200 + k % 50) for k in range(60))
    rows = [(1, text + "!"), (2, "<" + text[3:] + ">"), (3, None)]
    got = {r.doc_id: r for r in X.remove_repeats(docs_of(rows), carry=["lang", "node"], texts=True).collect()}
    assert (got[1].kept, got[2].kept, got[3].kept) == (text + "!", "<>", "")
    assert (got[2].lang, got[2].node) == ("en", "x")


def test_other_lengths_and_empty_table(spark, docs_of):
    rows = sample(1)[:30]
    got = X.remove_repeats(docs_of(rows), length=70).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 70)
    assert X.remove_repeats(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        X.remove_repeats(docs_of([]), length=20)


def test_family_levels_double():
    rng = np.random.default_rng(0)
    family, first = X.Family(), {}
    for doc in range(40):
        strings = np.array([b"%05d" % x for x in rng.integers(0, 3000, 50)], "S5")
        got = family.add(strings, np.full(50, doc))
        for s, least in zip(strings.tolist(), got.tolist(), strict=True):
            assert least == first.setdefault(s, doc)
    sizes = [len(level) for level, _ in family.levels]
    assert sum(sizes) == len(first) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
