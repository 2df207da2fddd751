"""Settings of members, held as JSON objects in a text column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and defaults of the standard settings (fixed values).
GROUP_KEY = "group-name"
PER_ZONE_KEY = "TaskPerCloud"
PER_ZONE_DEFAULT = 1

_PARSED = "__settings"
_BROKEN = "__broken"


def settings_from_json(
    df: DataFrame, json_col: str, settings: Mapping[str, tuple[str, Any]], required: Sequence[str] = ()
) -> DataFrame:
    """Add one column per setting `{name: (type, default)}`, read from the JSON object in `json_col`.

    A setting that is absent, null or not of its type gets the default. Rows with broken JSON, or without a
    value for a `required` setting, are left out.
    """
    fields = [T.StructField(name, T.StringType()) for name in settings]
    schema = T.StructType([*fields, T.StructField(_BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    parsed = df.withColumn(_PARSED, F.from_json(json_col, schema, options))
    parsed = parsed.filter(F.col(_PARSED).isNotNull() & F.col(f"{_PARSED}.{_BROKEN}").isNull())
    columns = []
    for name, (kind, default) in settings.items():
        value = F.col(_PARSED)[name].try_cast(kind)
        columns.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    out = parsed.select(*df.columns, *columns)
    for name in required:
        out = out.filter(F.col(f"`{name}`").isNotNull())
    return out


def member_settings(df: DataFrame, json_col: str) -> DataFrame:
    """Add `grp` and `per_zone` from the standard settings; rows without a group are left out."""
    standard = {GROUP_KEY: ("string", None), PER_ZONE_KEY: ("int", PER_ZONE_DEFAULT)}
    return settings_from_json(df, json_col, standard, [GROUP_KEY]).select(
        *df.columns, F.col(f"`{GROUP_KEY}`").alias("grp"), F.col(PER_ZONE_KEY).alias("per_zone")
    )
