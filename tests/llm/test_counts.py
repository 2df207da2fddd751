import tracemalloc
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa

from geozone.llm import common, counts


def brute(word, scores):
    """Best (score, -tokens) over all ways to cut a word."""
    byte = min(scores.values()) - 1

    @cache
    def best(end):
        if end == 0:
            return 0, 0
        found = []
        for start in range(end):
            piece = word[start:end]
            score, count = best(start)
            if piece in scores:
                found.append((score + scores[piece], count - 1))
            elif end - start == 1:
                size = len(piece.encode())
                found.append((score + size * byte, count - size))
        return max(found)

    return -best(len(word))[1]


def test_counts_match_brute_force(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = ["▁", *"abc", "▁a", "ab", "bc", "abc", "ca", "▁ab", "cab", "bb", "aabb"]
    scores = counts.zipf_scores(vocabulary)
    rows = [" ".join("".join(rng.choice(list("abcdé漢"), rng.integers(1, 14))) for _ in range(rng.integers(1, 40))) for _ in range(50)]
    rows += [None, "", " \n ", "abc" * 200, "a", "a"]
    rows = [*enumerate(rows), (None, "abc abc"), (0, "bb")]
    monkeypatch.setattr(counts, "NODES", 50)
    got = counts.token_counts(docs_of(rows), scores).collect()
    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        want.append((str(doc_id), len(words), sum(brute("▁" + w, scores) for w in words)))
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got) == sorted(want)


def test_prefixes_are_scored_once():
    forward = counts.Forward(counts.zipf_scores(["a", "b", "ab"]))
    for word in ("abab", "abaa", "abab", "ab"):
        forward.count(word)
    assert len(forward.children) == 1 + 5


def test_very_long_word():
    forward = counts.Forward(counts.zipf_scores(["a", "aa", "aaa"]))
    assert forward.count("a" * 30_001) == forward.plain("a" * 30_001)
    assert len(forward.children) == 1


def test_real_vocabulary_and_empty_table(spark, docs_of):
    scores = counts.zipf_scores(counts.model_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["the cat sat on the mat.", "Überraschung, señor 漢字", "x" * 100]
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(docs_of(texts), scores).collect()}
    assert got == {i: sum(brute("▁" + w, scores) for w in t.split()) for i, t in enumerate(texts)}
    assert counts.token_counts(docs_of([]), scores).collect() == []


def test_only_the_first_letters_are_nodes():
    scores = counts.zipf_scores(["a", "b", "ab", "aba", "bab", "bbbbbbb"])
    rng = np.random.default_rng(6)
    words = ["ab" * 20, *("".join(rng.choice(list("abc\u00e9"), n)) for n in range(1, 60)), "b" * 127, "b" * 128, "b" * 129, "b" * 400]
    forward = counts.Forward(scores)
    assert forward.count(words[0]) and len(forward.children) == 1 + counts.HEAD
    assert [forward.count(w) for w in words * 2] == [brute(w, scores) for w in words * 2]


def test_words_met_in_one_text_do_not_fill_the_memory():
    forward = counts.Forward(counts.zipf_scores([*"0123456789", "12"]))
    tracemalloc.start()
    for k in range(0, 800_000, 400):
        forward.total([str(n) for n in range(k, k + 400)] + ["1212", "712"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 << 20  # over 80 with a table of all 800,000
    assert {"1212", "712"} <= forward.known.keys()


def test_totals_do_not_depend_on_what_is_remembered(monkeypatch):
    rng = np.random.default_rng(8)
    scores = counts.zipf_scores(["\u2581", *"abc", "\u2581a", "ab", "bca", "cc"])
    texts = [["".join(rng.choice(list("abcd"), n)) for n in rng.integers(1, 6, 40)] for _ in range(60)]
    want = [sum(brute("\u2581" + w, scores) for w in words) for words in texts]
    for words, once in ((300_000, 100_000), (30, 100_000), (300_000, 20), (5, 5), (0, 0)):
        monkeypatch.setattr(counts, "WORDS", words)
        monkeypatch.setattr(counts, "ONCE", once)
        forward = counts.Forward(scores)
        assert [forward.total(t) for t in texts] == want
        assert len(forward.known) <= words + 40 and len(forward.once) <= once + 40


def test_a_worker_keeps_only_what_its_own_query_left():
    made = []
    forward = lambda name: common.kept(name, lambda: made.append(name) or name)
    batch = pa.record_batch([pa.array(["a"])], names=["text"])
    for owner in ("one", "one", None, "one", "two", "one"):
        if owner:
            forward(owner)
        assert sum(b.num_rows for b in common.slices([batch], owner=owner)) == 1
    assert made == ["one", "one", "two", "one"]
    common.tidied(lambda key, rows: rows)((), None)
    forward("one")
    assert made[-2:] == ["one", "one"]
    common.forget()
