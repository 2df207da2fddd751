import zlib

import numpy as np
import pytest

from geozone.llm import langid as L


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in L.start(3, hidden=4).items()}
    rows = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    sizes, labels = np.array([7, 7, 3, 1, 5]), np.array([0, 1, 2, 1, 0])
    for row, size in zip(rows, sizes, strict=True):
        row[size:] = 0
    monkey = np.float32
    try:
        np.float32 = np.float64
        _, grads = L.loss_and_gradients(p, rows, sizes, labels)
        for name in p:
            seen = 0
            for at in np.ndindex(p[name].shape):
                if abs(grads[name][at]) < 1e-4:
                    continue
                old, eps = p[name][at], 1e-5
                p[name][at] = old + eps
                up, _ = L.loss_and_gradients(p, rows, sizes, labels)
                p[name][at] = old - eps
                down, _ = L.loss_and_gradients(p, rows, sizes, labels)
                p[name][at] = old
                assert (up - down) / (2 * eps) == pytest.approx(grads[name][at], rel=1e-3, abs=1e-6)
                seen += 1
                if seen == 5:
                    break
            assert seen
    finally:
        np.float32 = monkey


def texts(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark):
    docs = texts(spark)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.identify(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and 0 <= r.agreeing <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_position_labels_follow_the_text(spark):
    docs = texts(spark).toPandas()
    p, languages = L.train(texts(spark))
    by = {lang: docs[docs.lang == lang].text.iloc[0].encode()[:128] for lang in languages}
    rows = np.stack([L.windows(by[x])[0] for x in languages])
    probs = L.position_probabilities(p, rows)
    assert probs.shape == (len(languages), L.WINDOW, len(languages))
    assert np.allclose(probs.sum(axis=0), 1, atol=1e-5)
    assert (probs.argmax(axis=0) == np.arange(len(languages))).mean() > 0.8


def test_edges(spark):
    some = texts(spark).limit(200).collect()
    rows = [(r.doc_id, r.text, r.lang, 1) for r in some]
    long = some[1].text * 60
    rows += [(5001, None, "en", 1), (5002, "", "en", 1), (5003, "12 34 -- !!", None, 1), (None, some[1].text, None, 1), (None, some[1].text, "fr", 1)]
    rows += [(5004, long, None, 1), (5005, some[1].text, None, 1), (5005, some[1].text, "xx", 1), (5006, "​́", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, rank int")
    got = L.identify(frame).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i in (5001, 5002, 5003, 5006):
        assert (by[i][0].lang_pred, by[i][0].score) == ("und", 0.0)
    same = {(r.lang_pred, r.score) for r in by[None] + by[5005] + by[some[1].doc_id]}
    assert len(same) == 1 and not any(r.held_out for r in by[None])
    assert by[5004][0].lang_pred == by[some[1].doc_id][0].lang_pred
    none = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(none).collect()] == [("und", 0.0)]
    assert L.identify(none.limit(0)).collect() == []
