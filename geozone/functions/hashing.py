"""Hashes that give the same number on every retry and in every engine with md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the key text: what stands for null, and what separates the keys.
NULL_MARK = "\u0000"
KEY_SEPARATOR = "\u0001"

HASHES = ("md5", "xxhash64")


def key_text(keys: Sequence[Column]) -> Column:
    """The keys as one text; null has its own mark, so it also has a stable hash."""
    if not keys:
        return F.lit("")
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(k.cast("string"), F.lit(NULL_MARK)) for k in keys])


def stable_hash(keys: Sequence[Column], hash: str = "md5") -> Column:
    """A non-negative BIGINT from the keys.

    `md5` takes the first 32 bits of the digest, which other engines can repeat; `xxhash64` is faster.
    """
    if hash == "md5":
        return F.conv(F.substring(F.md5(key_text(keys)), 1, 8), 16, 10).cast("bigint")
    if hash == "xxhash64":
        return F.xxhash64(key_text(keys)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    raise ValueError(f"hash is one of {HASHES}, not {hash!r}")
