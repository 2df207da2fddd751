"""Token counts under a unigram model: forward scores shared over a trie of the distinct pre-tokens."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.llm.common import kept, slices

# Nodes of a trie, words met in several texts and words met in one, whose counts are remembered, before a task starts anew.
NODES = 100_000
WORDS = 400_000
ONCE = 200_000
# Text bytes that are words at a time: as Python strings they take several times that.
SLICE_BYTES = 1 << 20
# Words longer than this share no prefixes worth keeping; they are counted without nodes.
LONG = 128
# A millionth of a nat beside tokens: more than the tokens of any word.
UNIT = 1 << 40
# Letters of a word that are nodes of the trie. Few words share more, and what follows costs less than a node.
HEAD = 5
# The mark of a word's start, as in the vocabulary.
START = "▁"


def zipf_scores(pieces: Iterable[str]) -> dict[str, int]:
    """Whole-number scores of vocabulary pieces in order of rank: Zipf's law, in millionths of a nat."""
    scores: dict[str, int] = {}
    for rank, piece in enumerate(pieces):
        scores.setdefault(piece, -round(1e6 * math.log(rank + 2)))
    return scores


def model_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary file, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Forward:
    """Best score and token count of each prefix. A prefix's state depends only on those of its own prefixes; prefixes of up to HEAD
    letters are nodes of a trie, from whose states the words that begin with them go on.

    A character that is no piece is taken byte by byte, each byte scored as if it were the last rank but one. Of segmentations with
    equal scores the one with fewer tokens counts. A state is one number, score * UNIT - tokens, so the largest is the best.
    """

    def __init__(self, scores: dict[str, int]):
        self.weights = {piece: score * UNIT - 1 for piece, score in scores.items()}
        self.longest = max(map(len, scores), default=1)
        self.byte = (min(scores.values(), default=0) - 1) * UNIT - 1
        self.beginnings = {piece[:k] for piece in scores for k in range(1, len(piece) + 1)}
        self.known: dict[str, int] = {}
        self.once: dict[str, int] = {}
        self.start()

    def start(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.state: list[int] = [0]
        self.tail: list[str] = [""]
        self.heads: dict[str, tuple[str, list[int]]] = {}
        self.met: dict[str, tuple[str, int, list[tuple[int, int]]]] = {}

    def ending(self, tail: str) -> tuple[str, int, list[tuple[int, int]]]:
        """The longest end of `tail` with which a piece begins, the weight of its last letter alone, and (-size, weight) of the longer
        pieces that end there. With the tail of the prefix before it and a letter, these are all pieces that end with that letter."""
        found = self.met.get(tail)
        if found is None:
            if len(self.met) > NODES:
                self.met.clear()
            end = tail
            while end and end not in self.beginnings:
                end = end[1:]
            single = self.weights.get(tail[-1])
            if single is None:
                single = len(tail[-1].encode("utf-8", "surrogatepass")) * self.byte
            longer = [(-size, self.weights[end[-size:]]) for size in range(2, len(end) + 1) if end[-size:] in self.weights]
            found = self.met[tail] = end, single, longer
        return found

    def extend(self, tail: str, letters: str, before: list[int]) -> str:
        """Appends the states of the prefixes that `letters` make to `before`, which ends with those of the `longest` prefixes before
        them; `tail` is that of the last of these, and the last one's is given back."""
        met = self.met
        for letter in letters:
            tail, single, longer = met.get(tail + letter) or self.ending(tail + letter)
            best = before[-1] + single
            for back, weight in longer:
                found = before[back] + weight
                if found > best:
                    best = found
            before.append(best)
        return tail

    def total(self, words: list[str]) -> int:
        """Tokens of all the words, each behind a start mark. Words that were counted before are looked up.

        Most words are met in one text only. They wait in `once`, and only those met again go to `known`, which so stays small.
        """
        known, once, own = self.known, self.once, {}
        if len(known) > WORDS:
            known.clear()
        if len(once) > ONCE:
            once.clear()
        for word in set(words).difference(known):
            found = once.pop(word, None)
            if found is None:
                own[word] = self.count(START + word)
            else:
                known[word] = found
        known.update(own)
        total = sum(map(known.__getitem__, words))
        for word in own:
            del known[word]
        once.update(own)
        return total

    def count(self, word: str) -> int:
        if len(word) > LONG:
            return self.plain(word)
        if len(self.children) > NODES:
            self.start()
        tail, before = self.heads.get(word[:HEAD]) or self.head(word[:HEAD])
        if len(word) > HEAD:
            before = before.copy()
            self.extend(tail, word[HEAD:], before)
        return -before[-1] % UNIT

    def head(self, start: str) -> tuple[str, list[int]]:
        """Tail of a word's first letters and the states of all their prefixes, which are nodes of the trie."""
        node, before = 0, [0]
        for letter in start:
            following = self.children[node].get(letter)
            if following is None:
                following = self.children[node][letter] = len(self.children)
                self.children.append({})
                self.tail.append(self.extend(self.tail[node], letter, before))
                self.state.append(before.pop())
            node = following
            before.append(self.state[node])
        self.heads[start] = self.tail[node], before
        return self.heads[start]

    def plain(self, word: str) -> int:
        tail, before = "", [0]
        for at in range(0, len(word), LONG):
            tail = self.extend(tail, word[at : at + LONG], before)
            del before[: -self.longest - 1]
        return -before[-1] % UNIT


def token_counts(docs: DataFrame, scores: dict[str, int]) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of `docs` (doc_id, text; other columns are not read).

    Pre-tokens are the runs between white space with a start mark; each is cut into the pieces with the highest sum of
    `scores`. Within a Python worker the distinct pre-tokens go into a trie, whose nodes hold the state of their first HEAD letters, so
    these are scored once however many words begin with them, and a repeated word is looked up. No shuffle; memory is bounded
    by NODES, WORDS, ONCE and SLICE_BYTES, or the longest text. Null and empty texts count 0. Nothing is cut short: long words only skip the trie.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(scores), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = kept(name, lambda: Forward(shared.value))
        for batch in slices(batches, limit=SLICE_BYTES, owner=name):
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                found = (text or "").split()
                words.append(len(found))
                tokens.append(forward.total(found))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
