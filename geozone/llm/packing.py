"""Packing into token-budget batches inside length buckets that minimise padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geozone.session import written

# Tokens of a sequence at most, buckets at most, and padded tokens of a batch at most.
LONGEST = 2_048
BUCKETS = 8
BUDGET = 32_768
# Groups over which a bucket's rows are numbered.
SALTS = 4_096


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets, the last the largest length, with the least padding in all.

    Exact dynamic programming over the lengths that occur: with k buckets up to a length, the last one begins behind the length that
    makes its padding and that of k - 1 buckets before it least. Of equally good choices, the one with smaller bounds.
    """
    lengths = np.array(sorted(n for n, count in histogram.items() if count > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    size = len(lengths)
    unset = np.iinfo(np.int64).max // 2
    best = np.full(size + 1, unset)
    best[0] = 0
    came = []
    for _ in range(min(buckets, size)):
        following, before = best.copy(), np.full(size + 1, -1)
        for end in range(1, size + 1):
            padding = lengths[end - 1] * (rows[end] - rows[:end]) - (tokens[end] - tokens[:end])
            total = np.where(best[:end] < unset, best[:end] + padding, unset)
            at = int(total.argmin())
            if total[at] < following[end]:
                following[end], before[end] = total[at], at
        best = following
        came.append(before)
    out, end = [], size
    for before in reversed(came):
        if end and before[end] >= 0:
            out.append(int(lengths[end - 1]))
            end = int(before[end])
    return out[::-1]


def padding_of(histogram: dict[int, int], bounds: list[int]) -> int:
    return sum(count * (min(b for b in bounds if b >= n) - n) for n, count in histogram.items())


def sequences(lengths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(doc_id, part, start, n_tokens): documents (doc_id, n_tokens) cut into sequences of at most `longest` tokens."""
    parts = F.expr(f"sequence(0L, (n_tokens - 1) div {longest})")
    cut = lengths.filter("n_tokens > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_tokens", F.explode(parts).alias("part"))
    start = F.col("part") * longest
    return cut.select("doc_id", "part", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(longest)).cast("int").alias("n_tokens"))


def pack(lengths: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, part, start, n_tokens, bucket, batch, slot): every token of `lengths` (doc_id, n_tokens) in one sequence of one batch.

    The histogram of sequence lengths (at most `longest` numbers) is all that passes through the driver; it gives the bounds with the
    least padding. A batch holds budget // bucket sequences of its bucket (one at least), padded to the bucket's bound. Rows of a
    bucket are numbered in SALTS groups and the groups' sizes added up, so no task sees a whole bucket; all batches of a
    bucket but its last are full. The numbering depends on the rows only.

    Documents without tokens (null or no n_tokens) have no sequence. Null doc_ids are packed like others; repeated rows are packed
    as often as they come. An empty table gives no rows.
    """
    rows = written(sequences(lengths, longest), "sequences")
    histogram = {r.n_tokens: r["count"] for r in rows.groupBy("n_tokens").count().collect()}
    bounds = best_boundaries(histogram, buckets) or [longest]
    bucket = F.expr(" ".join(["CASE", *(f"WHEN n_tokens <= {b} THEN {b}" for b in bounds), "END"]))
    salt = F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS))
    placed = rows.withColumn("bucket", bucket).withColumn("salt", salt)
    groups = placed.groupBy("bucket", "salt").count()
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("bucket", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "salt").orderBy("doc_id", "part", "n_tokens")
    numbered = placed.withColumn("k", F.row_number().over(inside)).join(offsets, ["bucket", "salt"])
    position = F.col("offset") + F.col("k") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    numbered = numbered.withColumn("position", position).withColumn("capacity", capacity)
    batch = F.floor(F.col("position") / F.col("capacity")).cast("bigint")
    slot = F.pmod("position", "capacity").cast("int")
    return numbered.select("doc_id", "part", "start", "n_tokens", "bucket", batch.alias("batch"), slot.alias("slot"))
