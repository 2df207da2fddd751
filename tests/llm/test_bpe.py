import hashlib
import json
import sys
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from geozone.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(texts):
    library = Tokenizer.from_str(json.dumps(json.load(open(PATH, encoding="utf-8")) | {"truncation": None, "padding": None}))
    out = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((str(doc_id), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_like_the_library(spark, docs_of):
    rows = [
        "Hello, world! It's the dogs' day; we'll see 12345 things.",
        None,
        "",
        " \t\r\n\x0b\x0c ",
        "NBSP between em line\u0085next   alone \x1c\x1d\x1e\x1f units",
        "é a ́combining İSTANBUL ΣΑΣ ΑΣ. ß ǅ",
        "<|endoftext|> a<|startoftext|>b <|endoftext|><|endoftext|>",
        "emoji 👩‍👩‍👧 𝒳 漢字 한국어 ไทย ​ zero",
        "x" * 40_000 + " " + "word " * 20_000,
        "null\x00byte",
        "same words same words",
        "same words same words",
    ]
    rows = [*enumerate(rows), (None, "no id"), (3, "again 3")]
    got = bpe.encode_decode(docs_of(rows), bpe.read_model(PATH)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want(rows)


def test_many_batches(spark, docs_of, monkeypatch):
    rows = list(enumerate(f"batch {k % 7} word{k} shared text" for k in range(300)))
    monkeypatch.setattr(bpe, "BATCH_BYTES", 500)
    got = bpe.encode_decode(docs_of(rows).repartition(3), bpe.read_model(PATH)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want(rows)


def test_empty_table(spark, docs_of):
    assert bpe.encode_decode(docs_of([]), bpe.read_model(PATH)).collect() == []


def test_words_of_a_batch_are_not_handled_one_by_one():
    # Round 3, op8_bpe: a call or two of Python for each word of each batch took most of the time.
    model = bpe.read_model(PATH)
    digests = bpe._digests(SimpleNamespace(value=model))
    n = 5_000
    codes = np.concatenate([[n, n], np.arange(n), np.arange(n)[::-1]])
    positions = pa.table({"ids": pa.array([[7, 8]], pa.list_(pa.int64())), "body": [bpe._planes(codes)]})
    sizes = np.arange(n) % 3
    ids = np.arange(sizes.sum()) % 40_000
    encoded = pa.table({"part": pa.array([0], pa.int32()), "body": [bpe._planes(np.concatenate([[n], sizes, ids]))]})
    digests(positions, encoded)  # reads the model
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = digests(positions, encoded).to_pylist()
    finally:
        sys.setprofile(None)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    texts = [" ".join(str(i) for w in words for i in w) for words in (own, own[::-1])]
    assert [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got] == [(7, len(ids), sha(texts[0])), (8, len(ids), sha(texts[1]))]
    assert calls < n


def test_white_space_around_words(spark, docs_of):
    texts = ["  both  sides ", "\n", None, "\t\tbegin", "end\x0c", "é ", " \x85 a", "end begin sides é", "a" * 9_000]
    rows = [*enumerate(texts), (None, " no id ")]
    got = bpe.encode_decode(docs_of(rows).coalesce(1), bpe.read_model(PATH)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want(rows)
