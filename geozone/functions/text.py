"""Column helpers for the text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_fields(text: Column, separator: str) -> Column:
    """Split `text` and drop trailing empty fields.

    The empty text has one empty field; a text of separators only has none.
    """
    pattern = re.escape(separator)
    kept = F.regexp_replace(text, f"(?:{pattern})+$", "")
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(kept == "", F.array().cast("array<string>"))
        .otherwise(F.split(kept, pattern))
    )


def check_on_error(on_error: str) -> None:
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error is 'fail' or 'skip', not {on_error!r}")
