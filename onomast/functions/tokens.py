"""Token sets, n-grams, windows and stop words as column expressions over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def common(a: Column, b: Column) -> Column:
    """Distinct tokens of both, sorted."""
    return F.sort_array(F.array_intersect(a, b))


def different(a: Column, b: Column) -> Column:
    """Distinct tokens of the first that the second lacks, sorted: one-sided."""
    return F.sort_array(F.array_except(a, b))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common tokens against the longer list, repeated tokens counted there."""
    return F.size(common(a, b)) / F.greatest(F.size(a), F.size(b))


def ngrams(parts: Column, n: int, between: str = " ") -> Column:
    """Every n tokens in a row, joined; none if there are fewer."""
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, F.lit(n)), between))


def char_ngrams(text: Column, n: int) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def without(parts: Column, stop: Sequence[str]) -> Column:
    return F.filter(parts, lambda t: ~t.isin(list(stop)))


def new_types(stems: Column, text: Column) -> Column:
    """Of a context's stems those that aren't part of its text as they are, each once, in the order of first use."""
    return F.filter(F.array_distinct(stems), lambda s: ~F.contains(text, s))


def window_around(parts: Column, position: Column, width: int = 50) -> Column:
    """``width`` tokens from half of it before the one at ``position`` (from 1) on."""
    return F.slice(parts, F.greatest(position - width // 2, F.lit(1)), F.lit(width))


def char_window(text: Column, begin: Column, width: int = 50) -> Column:
    """The stretch of 5 x ``width`` characters around ``begin`` (from 0), for texts that aren't cut into tokens."""
    size = 5 * width
    return F.substring(text, F.greatest(begin - size // 2, F.lit(0)) + 1, F.lit(size))


def counts(parts: Column) -> Column:
    """Tokens with their numbers, as a map."""
    own = lambda p: F.transform(F.array_distinct(p), lambda k: F.struct(k, F.size(F.filter(p, lambda t: t == k))))
    return F.map_from_entries(F.get(F.transform(F.array(parts), own), F.lit(0)))


def common_size(a: Column, b: Column) -> Column:
    """How many tokens two lists share, a repeated one as often as both have it."""
    each = F.transform(F.array_intersect(a, b), lambda k: F.least(F.size(F.filter(a, lambda t: t == k)), F.size(F.filter(b, lambda t: t == k))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def covered(text: Column, begin: Column, end: Column) -> Column:
    """The text from ``begin`` to before ``end``, counted from 0."""
    return F.substring(text, begin + 1, end - begin)
