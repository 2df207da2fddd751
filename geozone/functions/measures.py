"""Mergeable aggregates: partial per zone, merged globally, finished at the end.

A measure list maps an output name to `(function, input)`, or `(function, input, parameter)`, for example

    {"n": ("count", "*"), "total": ("sum", "value"), "mean": ("avg", "value"), "users": ("distinct", "user_id"),
     "spread": ("stddev", "value"), "p90": ("quantile", "value", 0.9)}

Partial rows hold what can be merged, so merging local results gives the figure of the raw rows:

- `avg`: sum and count.
- `variance`, `stddev` (of the whole population): count, sum and sum of squares for whole numbers and decimals, which are exact; for
  doubles the sum of squared distances from the local mean, so that digits are lost between the parts' means only.
- `distinct`: a HyperLogLog sketch with 2 ** DISTINCT_BITS registers. Merged sketches have the registers of the whole, bit for bit; the
  estimate is taken from the registers alone, so it is the same for any merging. Relative standard error DISTINCT_ERROR.
- `quantile`: a KLL sketch of size QUANTILE_SIZE; the parameter is the rank, from 0 to 1. The rank of the result is off by at
  most QUANTILE_ERROR of the rows in 99 of 100 cases, merged or not; the sketch draws lots, so it is not repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Measures = Mapping[str, "tuple[str, str | Column] | tuple[str, str | Column, float]"]

DISTINCT_BITS = 12
# Of an estimate from the registers alone: 1.04 over the root of their number.
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_BITS / 2)
QUANTILE_SIZE = 400
# Published for sketches of this size: 2.296 / size ** 0.9021.
QUANTILE_ERROR = 2.296 / QUANTILE_SIZE**0.9021


class _Function(NamedTuple):
    """Columns of a partial row (their suffixes), and how they come from raw rows, from partial rows, and give the result."""

    parts: Sequence[str]
    partial: Callable[..., list[Column]]
    merge: Callable[..., list[Column]]
    finish: Callable[..., Column]


def _plain(function: Callable, merge: Callable) -> _Function:
    return _Function([""], lambda x: [function(x)], lambda c: [merge(c)], lambda c: F.col(c))


def _mean(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.col(total).cast("double") / F.col(count))


def _exact_variance(count: str, total: str, squares: str) -> Column:
    n, s, sq = F.col(count), F.col(total), F.col(squares)
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), sq), F.try_multiply(s, s)).cast("double") / (n.cast("double") * n)
    # Beyond 38 digits.
    rough = F.greatest(sq.cast("double") / n - (s.cast("double") / n) * (s.cast("double") / n), F.lit(0.0))
    return F.when(n > 0, F.coalesce(exact, rough))


def _float_variance(count: str, total: str, apart: str) -> Column:
    return F.when(F.col(count) > 0, F.greatest(F.col(apart) / F.col(count), F.lit(0.0)))


def _square(x: Column) -> Column:
    return x * x


def _merged_apart(count: str, total: str, apart: str) -> Column:
    """Squared distances inside the parts, and of the parts' means from the mean of all."""
    n, s = F.col(count), F.col(total)
    between = F.sum(F.when(n > 0, _square(s) / n)) - _square(F.sum(s)) / F.nullif(F.sum(n), F.lit(0))
    return F.sum(apart) + F.greatest(F.coalesce(between, F.lit(0.0)), F.lit(0.0))


def _sums(*columns: str) -> list[Column]:
    return [F.sum(c) for c in columns]


_MOMENTS = _Function(["__count", "__sum", "__squares"], lambda x: [F.count(x), F.sum(x), F.sum(_square(x))], _sums, _exact_variance)
_FLOAT_MOMENTS = _Function(
    ["__count", "__sum", "__apart"],
    lambda x: [F.count(x), F.sum(x).cast("double"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))],
    lambda n, s, a: [F.sum(n), F.sum(s), _merged_apart(n, s, a)],
    _float_variance,
)
# A sketch merged with itself has the same registers, and an estimate that depends on them alone.
_DISTINCT = _Function(
    ["__sketch"],
    lambda x: [F.hll_sketch_agg(x, DISTINCT_BITS)],
    lambda c: [F.hll_union_agg(c)],
    lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union(c, c)), F.lit(0).cast("bigint")),
)
_QUANTILE = _Function(
    ["__sketch"],
    lambda x: [F.kll_sketch_agg_double(x.cast("double"), QUANTILE_SIZE)],
    lambda c: [F.kll_merge_agg_double(c)],
    lambda c, rank: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(rank))),
)

_FUNCTIONS: dict[str, _Function] = {
    "count": _plain(F.count, F.sum),
    "sum": _plain(F.sum, F.sum),
    "min": _plain(F.min, F.min),
    "max": _plain(F.max, F.max),
    "avg": _Function(["__sum", "__count"], lambda x: [F.sum(x), F.count(x)], _sums, _mean),
    "variance": _MOMENTS,
    "stddev": _MOMENTS,
    "distinct": _DISTINCT,
    "quantile": _QUANTILE,
}
FUNCTIONS = tuple(_FUNCTIONS)


def check_measures(measures: Measures) -> None:
    if not measures:
        raise ValueError("at least one measure is needed")
    for name, (function, _, *parameters) in measures.items():
        if function not in FUNCTIONS:
            raise ValueError(f"measure {name!r}: function is one of {FUNCTIONS}, not {function!r}")
        if len(parameters) != (function == "quantile") or not all(0 <= p <= 1 for p in parameters):
            raise ValueError(f"measure {name!r}: quantile takes a rank from 0 to 1, other functions take none")


def partials(measures: Measures, df: DataFrame) -> list[Column]:
    """Aggregates of the raw rows `df`."""
    check_measures(measures)
    out: list[Column] = []
    for name, (function, source, *_) in measures.items():
        value = F.lit(1) if isinstance(source, str) and source == "*" else F.col(source) if isinstance(source, str) else source
        found = _FUNCTIONS[function]
        if found is _MOMENTS:
            kind = df.select(value).schema[0].dataType
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                found = _FLOAT_MOMENTS
            elif not isinstance(kind, T.DecimalType):
                value = value.cast("decimal(19,0)")
        out += [c.alias(name + part) for c, part in zip(found.partial(value), found.parts, strict=True)]
    return out


def _function(name: str, function: str, columns: Sequence[str]) -> _Function:
    """The function, in the form that partial rows with these columns are in."""
    found = _FUNCTIONS[function]
    return _FLOAT_MOMENTS if found is _MOMENTS and f"{name}__apart" in columns else found


def merges(measures: Measures, columns: Sequence[str]) -> list[Column]:
    """Aggregates of partial rows with these columns; they keep the partial column names."""
    out: list[Column] = []
    for name, (function, *_) in measures.items():
        found = _function(name, function, columns)
        names = [name + part for part in found.parts]
        out += [c.alias(n) for c, n in zip(found.merge(*names), names, strict=True)]
    return out


def finished(measures: Measures, columns: Sequence[str]) -> list[Column]:
    """The result columns of partial rows with these columns."""
    out: list[Column] = []
    for name, (function, _, *parameters) in measures.items():
        found = _function(name, function, columns)
        value = found.finish(*[name + part for part in found.parts], *parameters)
        out.append((F.sqrt(value) if function == "stddev" else value).alias(name))
    return out


def partial_names(measures: Measures, columns: Sequence[str] = ()) -> list[str]:
    return [name + part for name, (function, *_) in measures.items() for part in _function(name, function, columns).parts]
