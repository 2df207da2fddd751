"""Byte-level BPE against the library of the rank files, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from geozone.llm import byte_bpe

TEXT = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
RANKS = byte_bpe.parse_ranks(TEXT)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def want(rows):
    out = []
    for doc_id, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()))
    return sorted(out, key=repr)


def got(docs):
    out = byte_bpe.encode_decode(docs, TEXT, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


EDGES = [
    "Hello, world! It's the dogs' day; we'll see 12345 things.",
    None,
    "",
    " ",
    " \t\r\n\x0b\x0c  end",
    "a\x1cb \x1d\x1e\x1f c\x85d\xa0e\u180ef\u200bg\u3000h\u2028i",
    "é a\u0301combining İSTANBUL ΣΑΣ ß ǅ",
    "<|endoftext|> is plain text",
    "emoji 👩‍👩‍👧 𝒳 漢字 한국어 ไทย null\x00byte",
    "x" * 20_000 + " " + "word " * 20_000,
    "".join(random.Random(3).choice("abcd") for _ in range(30_000)),
    "漢字" * 3_000 + " " * 5_000,
    "same words same words",
    "same words same words",
]


def test_like_the_library(spark, docs_of):
    rows = [*enumerate(EDGES), (None, "no id"), (3, "again 3")]
    assert got(docs_of(rows)) == want(rows)


def test_empty_table(spark, docs_of):
    assert got(docs_of([])) == []


def test_every_character_is_split_alike():
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in points]
    ids, sizes = encoder.encode(texts)
    at = 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + size].tolist() == LIBRARY.encode_ordinary(text), repr(text)
        at += size


def test_words_are_forgotten_in_time(monkeypatch):
    """A worker that remembers few words gives the same ids; long words are never kept."""
    monkeypatch.setattr(byte_bpe, "WORDS", 5)
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(3):
        for text in ("one two three four five six seven", "y" * 1_000 + " two", None, "eight nine ten eleven twelve"):
            ids, sizes = encoder.encode([text])
            assert ids.tolist() == LIBRARY.encode_ordinary(text or "") and sizes.tolist() == [len(ids)]
            assert not any(len(w) > byte_bpe.LONG for w in encoder.known)


@pytest.mark.parametrize("seed", range(20))
def test_merges_like_a_plain_search(seed):
    """The tree's root against a search through all pairs after each merge, on ranks that make ties and chains."""
    rng = random.Random(seed)
    ranks = {bytes([i]): i for i in range(256)}
    pieces = [bytes([a]) for a in b"ab"]
    while len(ranks) < 290:
        new = rng.choice(pieces) + rng.choice(pieces)
        if new not in ranks:
            ranks[new] = len(ranks)
            pieces.append(new)
    for _ in range(50):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        parts = [bytes([b]) for b in word]
        while word not in ranks:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merged(word, ranks) == ([ranks[word]] if word in ranks else [ranks[p] for p in parts])
        if word not in ranks:
            ids, sizes = byte_bpe.Forest(ranks).merged([word, b"ab", word])
            want = [ranks[p] for p in parts]
            assert ids.tolist()[: sizes[0]] == want == ids.tolist()[-sizes[2] :]


def test_decoding(spark):
    shared = spark.sparkContext.broadcast(TEXT)
    rows = spark.createDataFrame([(1, LIBRARY.encode_ordinary("Ünï 漢")), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    out = {r.doc_id: r.decoded for r in byte_bpe.decode(rows, shared).collect()}
    assert out == {1: "Ünï 漢".encode(), 2: b"", 3: None}
    with pytest.raises(Exception, match="no rank"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id bigint, ids array<int>"), shared).collect()


def test_bad_rank_files_are_refused():
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.parse_ranks(b"YQ== 0\n")
