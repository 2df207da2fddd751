"""The stages on planted cases, each on its own input, and the whole run on the smallest tables."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from geozone.llm import simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "n_chars bigint, doc_id bigint, text string, lang string, source string, text_digest string, kept string, slice int"


def docs_of(spark, rows):
    """Documents with columns in another order and more of them, named as the operators name theirs."""
    full = [(len(t or ""), i, t, lang, "src", "x", "y", 1) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 50_000, n))


EDGES = [(None, "no id at all", "en"), (None, None, None), (900, None, "en"), (901, "", None), (902, "x" * 60_000, "en"), (903, "short", "en"), (903, "short", "en")]


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES[:-1]])
def test_stages_return_the_columns_of_documents(spark, stage):
    for rows in (EDGES, EDGES[:2], []):
        got = stage(spark, docs_of(spark, rows), SF)
        assert sorted(got.columns) == sorted(C.COLUMNS)
        got.collect()


def test_language_rejects_only_texts_without_letters(spark):
    rows = [(1, "some words of text", "en"), (2, "12345 -- 678", "en"), (3, None, "en"), (4, "les mots du texte", "fr"), (5, "und noch mehr", None)]
    got = {r.doc_id: r.lang for r in C.language(spark, docs_of(spark, rows), SF).collect()}
    assert got.keys() == {1, 4, 5} and got[1] == "en" and got[4] == "fr" and got[5] in ("en", "fr")


def test_language_rejects_letter_noise_and_keeps_clean_texts(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    rng = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"))
    label = lambda i: "en" if zlib.crc32(str(i).encode()) % 3 == 1 else None  # held out: noise is labelled, but not learned from
    noise = [(i, "".join(rng.choice(letters[: 26 if i % 2 else 64], 8000)), label(i)) for i in range(100_000, 100_040)]
    got = {r.doc_id for r in C.language(spark, docs_of(spark, [tuple(r) for r in clean] + noise), SF).collect()}
    assert got == {r.doc_id for r in clean}


def test_language_rejects_nothing_for_want_of_labels(spark):
    rows = [(k, f"some words of text {k}", None) for k in range(30)] + [(40, "12345", None), (41, None, None), (42, "\u0434\u0430", None)]
    got = {r.doc_id: r.lang for r in C.language(spark, docs_of(spark, rows), SF).collect()}
    assert got == dict.fromkeys([*range(30), 42], "und")


def test_near_duplicates_keeps_one_of_each_group(spark):
    base = prose(1, 400)
    near = base.replace(base.split()[200], "edit")
    rows = [(7, base, "en"), (3, near, "en"), (9, base, "fr"), (5, prose(2, 400), "en"), (6, prose(3, 5), "en"), (None, base, "en"), (5, prose(2, 400), "en"), (5, base, "en")]
    rows += [(None, prose(7, 90), "en"), (None, prose(7, 90), "en"), (None, prose(7, 90) + " more", "en")]
    got = C.near_duplicates(spark, docs_of(spark, rows), SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "5", "6", "None"]
    assert {r.text for r in got if r.doc_id == 3} == {near}
    assert simhash.similarity(base, near, 5) >= 0.8


def test_repeated_passages_go_and_documents_stay(spark):
    passage = prose(4, 60)
    rows = [(1, prose(5, 50) + " " + passage, "en"), (2, "start " + passage + " end", "en"), (3, prose(6, 50), "en"), (4, None, "en")]
    got = {r.doc_id: r for r in C.repeated_strings(spark, docs_of(spark, rows), SF).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text is None
    assert len(got[2].text) < 20 and got[2].n_chars == len(got[2].text)


def test_personal_data_goes_and_clean_text_stays(spark):
    clean = "A clean line of 12 words, from 2024, with nothing to hide: 3.14 and (so) on."
    rows = [(1, "write to a.b@c.example.org or +1 (917) 555-2670", "en"), (2, clean, "en")]
    got = {r.doc_id: r.text for r in C.personal_data(spark, docs_of(spark, rows), SF).collect()}
    assert got == {1: "write to [EMAIL] or [PHONE]", 2: clean}


def test_packing_has_every_token(spark):
    rows = [(k, prose(k, 30 * k), "en") for k in range(1, 12)] + EDGES
    got = C.packed(spark, docs_of(spark, rows), SF).collect()
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        assert r.n_tokens <= r.bucket
    assert {k for k in range(1, 12)} <= have.keys() and 901 not in have
    assert C.packed(spark, docs_of(spark, []), SF).collect() == []


def test_whole_run(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = C.run(spark, SF).collect()
    assert got and len({r.doc_id for r in got}) <= n
    assert [name for name, _ in C.STAGES] == ["language", "near_duplicates", "repeated_strings", "personal_data", "packing"]
