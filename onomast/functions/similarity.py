"""Similarity of two names: native where Spark can, Arrow functions for the Jaro family."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from onomast.functions.normalize import tokens

PERFECT = 9999.0


def is_perfect(a: Column, b: Column) -> Column:
    """Equal but for blanks at the ends and repeated white space."""
    same = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    return same(a) == same(b)


def simple(a: Column, b: Column) -> Column:
    """Share of common tokens in either name, multiplied; PERFECT for equal names."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(is_perfect(a, b), PERFECT).otherwise(both / F.size(x) * (both / F.size(y)))


def most_left(a: Column, b: Column) -> Column:
    """Distinct tokens that aren't common, in the name that has more of them; 1 for equal names."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.size(x) - both, F.size(y) - both).cast("double"))


def levenshtein(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer; PERFECT for equal names."""
    return F.when(is_perfect(a, b), PERFECT).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _common(s: str, t: str, half: int) -> str:
    left, out = list(t), []
    for i, c in enumerate(s):
        for j in range(max(0, i - half), min(i + half, len(t))):
            if left[j] == c:
                out.append(c)
                left[j] = "*"
                break
    return "".join(out)


def _parts(s: str, t: str) -> tuple[str, str]:
    half = min(len(s), len(t)) // 2 + 1
    return _common(s, t, half), _common(t, s, half)


def _moved(x: str, y: str) -> int:
    return sum(a != b for a, b in zip(x, y)) // 2


def jaro(s: str, t: str) -> float:
    s, t = s.lower(), t.lower()
    x, y = _parts(s, t)
    if len(x) != len(y) or not x:
        return 0.0
    return (len(x) / len(s) + len(y) / len(t) + (len(x) - _moved(x, y)) / len(x)) / 3


def jaro_winkler(s: str, t: str) -> float:
    """Jaro, raised by up to four equal characters at the start."""
    base, n = jaro(s, t), 0
    s, t = s.lower(), t.lower()
    while n < min(4, len(s), len(t)) and s[n] == t[n]:
        n += 1
    return base + n * 0.1 * (1 - base)


def _digits(a: str, b: str) -> tuple[str, str]:
    """Two names as strings of their tokens' numbers, counted from 2 on in the order of first use; of ten and more the digits mingle."""
    number: dict[str, int] = {}
    return tuple("0" + "".join(str(number.setdefault(t, len(number) + 2)) for t in x.rstrip(" ").split(" ")) for x in (a, b))


def token_jaro(a: str, b: str) -> float:
    return jaro(*_digits(a, b))


def transpositions(a: str, b: str) -> int:
    """Tokens out of order, by pairs; -1 for names with nothing in common."""
    s, t = _digits(a, b)
    moved = _moved(*_parts(s, t))
    return -1 if not moved and jaro(s, t) == 0.0 else moved


def _of_pairs(kind: str, of: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(kind)
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([None if x is None or y is None else of(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64() if kind == "double" else pa.int32())

    return each


def token_jaro_score(a: Column, b: Column) -> Column:
    """Jaro over tokens; PERFECT for equal names."""
    return F.when(is_perfect(a, b), PERFECT).otherwise(_of_pairs("double", token_jaro)(a, b))


def token_transpositions(a: Column, b: Column) -> Column:
    return _of_pairs("int", transpositions)(a, b)


def jaro_winkler_score(a: Column, b: Column) -> Column:
    return _of_pairs("double", jaro_winkler)(a, b)


def index_score(a: Column, b: Column, score: Column) -> Column:
    """PERFECT for equal normalized names, else the index's own score."""
    return F.when(a == b, PERFECT).otherwise(score)


#: Scorers by the code that configurations use.
SCORERS: dict[int, Callable[..., Column]] = {0: simple, 1: token_jaro_score, 3: jaro_winkler_score, 4: levenshtein, 10: index_score}


def scorer(code: int) -> Callable[..., Column]:
    """The scorer with a code; 2, the learned one, needs a model (:mod:`onomast.operators.learn`), and 5 was given up."""
    if code not in SCORERS:
        raise ValueError(f"no scorer has the code {code}")
    return SCORERS[code]
