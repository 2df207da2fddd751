"""BPE encoding over a table of distinct words, ids joined back by position, and decoding through the id-to-piece table."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import shuffle_partitions, slices

# White space on which every tokenizer of this kind splits; words never hold it.
SEPARATOR = b"\n"
# Text bytes whose words share one list of distinct words.
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=2)
def tokenizer(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


@lru_cache(maxsize=2)
def pieces(model: str) -> list[bytes]:
    """The id-to-piece table."""
    found = tokenizer(model)
    top = max(found.get_vocab(with_added_tokens=True).values())
    return [(found.id_to_token(i) or "").encode() for i in range(top + 1)]


def read_model(path: str) -> str:
    """A tokenizer file without truncation and padding. Words must be parted by white space that the model drops."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    kinds = json.dumps([model.get("normalizer"), model.get("pre_tokenizer")])
    if '"Removed"' not in kinds or model.get("decoder"):
        raise ValueError("only models that drop white space between words and have no decoder can be encoded by words")
    return json.dumps(model | {"truncation": None, "padding": None})


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32 by byte plane, compressed."""
    return _pack(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _ends(sizes: np.ndarray) -> np.ndarray:
    """Where each of the pieces with these sizes ends, after a zero."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _coded(texts: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """How many words each text has, the words' places in the list of distinct words, that list, by part and then as met, and where
    each part ends in it, after a zero. The words stay in Arrow's buffers, without an object for each."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    hashes = map(xxhash.xxh32_intdigest, distinct.to_numpy(zero_copy_only=False))
    part = np.fromiter(hashes, np.int64, len(distinct)) % parts
    blank = pc.index(distinct, "").as_py()  # met where a text begins or ends with white space, or is empty
    if blank >= 0:
        part[blank] = parts
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    filled = codes != blank
    sizes = np.diff(_ends(filled)[_ends(pc.list_value_length(split).to_numpy())])
    return sizes, place[codes[filled]], distinct.take(pa.array(order[: cuts[-1]])), cuts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ..., sizes[0] of them, then those from starts[1], and so on."""
    return np.repeat(starts - _ends(sizes)[:-1], sizes) + np.arange(sizes.sum())


def word_lists(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (batch, part, ids, body): per batch of documents its positions (part -1: doc_ids, word counts, places in the batch's
    list of distinct words) and its distinct words, by part and then as they are met."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, limit=BATCH_BYTES)):
            sizes, codes, distinct, cuts = _coded(batch.column("text"), parts)
            lists = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), distinct), pa.scalar(SEPARATOR.decode(), distinct.type))
            filled = np.flatnonzero(np.diff(cuts))
            bodies = [_pack(lists[p].as_buffer()) for p in filled.tolist()]
            yield pa.record_batch(
                [
                    pa.array([first + number] * (1 + len(filled)), pa.int64()),
                    pa.array(np.concatenate([[-1], filled]), pa.int32()),
                    pa.array([batch.column("doc_id").to_pylist(), *[None] * len(filled)], pa.list_(pa.int64())),
                    pa.array([_planes(np.concatenate([sizes, codes])), *bodies], pa.binary()),
                ],
                names=["batch", "part", "ids", "body"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "batch bigint, part int, ids array<bigint>, body binary")


def encode_words(lists: DataFrame, model: str) -> DataFrame:
    """(batch, part, body): for each list of words of a part, the ids of its words. Each distinct word is encoded once."""
    shared = lists.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.Table) -> pa.Table:
        bodies = pa.array(map(_unpack, part.column("body").to_pylist()), pa.large_binary())
        lists = pc.split_pattern(bodies, SEPARATOR)
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        encode = tokenizer(shared.value)
        found: list[np.ndarray] = []
        counts: list[int] = []
        for at in range(0, len(distinct), 8192):
            texts = distinct.slice(at, 8192).cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
            ids = [e.ids for e in encode.encode_batch_fast(texts, add_special_tokens=False)]
            counts += map(len, ids)
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        size_of = np.array(counts, np.int64)
        start_of = _ends(size_of)[:-1]
        all_ids = np.concatenate([np.zeros(0, np.uint32), *found])
        out = []
        for own in np.split(codes, _ends(pc.list_value_length(lists).to_numpy())[1:-1]):
            sizes = size_of[own]
            out.append(_planes(np.concatenate([[len(own)], sizes, all_ids[_ranges(start_of[own], sizes)]])))
        return pa.table({"batch": part.column("batch"), "part": part.column("part"), "body": pa.array(out, pa.binary())})

    return lists.filter("part >= 0").groupBy("part").applyInArrow(run, "batch bigint, part int, body binary")


@lru_cache(maxsize=2)
def _id_texts(model: str) -> list[pa.Array]:
    """Per id its decimal digits, and its piece, each with a space after it."""
    found = pieces(model)
    digits = [b"%d " % i for i in range(len(found))]
    return [pa.array(texts, pa.large_binary()) for texts in (digits, [p + b" " for p in found])]


def _joined(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Of the values, the first sizes[0] as one, then the next sizes[1], and so on."""
    offsets = _ends(pc.binary_length(values).to_numpy())[_ends(sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), values.buffers()[2] or pa.py_buffer(b"")])


def _digests(model: str):
    def run(positions: pa.Table, encoded: pa.Table) -> pa.Table:
        order = np.argsort(encoded.column("part").to_numpy(), kind="stable")
        bodies = encoded.column("body").to_pylist()
        numbers = [_numbers(bodies[k]) for k in order]
        none = np.zeros(0, np.uint32)
        counts = np.concatenate([none, *(x[1 : 1 + x[0]] for x in numbers)]).astype(np.int64)
        ids = pa.array(np.concatenate([none, *(x[1 + x[0] :] for x in numbers)]))
        words = [_joined(text_of.take(ids), counts) for text_of in _id_texts(model.value)]
        tokens: list[int] = []
        digests: list[list[str]] = [[], []]
        for doc_ids, body in zip(positions.column("ids").to_pylist(), positions.column("body").to_pylist(), strict=True):
            numbers = _numbers(body)
            sizes, codes = numbers[: len(doc_ids)].astype(np.int64), numbers[len(doc_ids) :]
            tokens += np.diff(_ends(counts[codes])[_ends(sizes)]).tolist()
            for found, text_of in zip(digests, words, strict=True):
                texts = _joined(text_of.take(pa.array(codes)), sizes)
                # what follows the last token is no part of the text
                found += [hashlib.sha256(memoryview(t.as_buffer() or b"")[:-1]).hexdigest() for t in texts]
        doc_ids = pc.list_flatten(positions.column("ids")).cast(pa.int64())
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.table([doc_ids, pa.array(tokens, pa.int64()), *(pa.array(d, pa.string()) for d in digests)], names=names)

    return run


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of `docs` (doc_id, text; other columns are not read).

    `model` is the text of a tokenizer file, from `read_model`. Documents are split into words in batches; a batch's
    distinct words go, in compressed lists, to the task of their part, where each distinct word of the corpus is encoded once;
    the ids come back to the batch, where they meet the positions. Decoding looks the ids up in the id-to-piece table and
    joins the pieces with spaces, as the library does for a model without decoder.

    Null and empty texts have no tokens. Rows with null or repeated doc_ids come out as they go in. An empty table gives no rows.
    """
    spark = docs.sparkSession
    lists = word_lists(docs, 4 * shuffle_partitions(spark))
    positions = lists.filter("part = -1").select("batch", "ids", "body")
    encoded = encode_words(lists.select("batch", "part", "body"), model)
    met = positions.groupBy("batch").cogroup(encoded.groupBy("batch"))
    kinds = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return met.applyInArrow(_digests(spark.sparkContext.broadcast(model)), kinds)
