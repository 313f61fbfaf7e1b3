"""Pair rules as boolean columns: whether two normalized names can mean the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from onomast.functions import tokens as T
from onomast.functions import words
from onomast.functions.normalize import let, tokens

NUMBER, SYMBOL = "^[0-9]+$", f"^(?:[a-zA-Z]|[0-9]+|{words.GREEK_REGEX})$"
SPECIAL = f"^(?:{words.GREEK_REGEX}|{words.MODIFIER_REGEX}|{words.NON_DESCRIPTIVE_REGEX}|)$"
#: A number but 1.
OTHER_NUMBER = "([02-9]|[1-9]{2,})"


def _all(parts: Column, pattern: str) -> Column:
    return F.forall(parts, lambda t: t.rlike(pattern))


def only_numbers_common(a: Column, b: Column) -> Column:
    """All common tokens are numbers; true also if there are none."""
    return _all(F.array_intersect(tokens(a), tokens(b)), "^[0-9]*$")


def only_single_common(a: Column, b: Column) -> Column:
    """All common tokens are single letters or digits."""
    return _all(F.array_intersect(tokens(a), tokens(b)), "^[a-z0-9]$")


def only_special_common(a: Column, b: Column) -> Column:
    """All common tokens are Greek letters, modifiers, non-descriptive or empty."""
    return _all(F.array_intersect(tokens(a), tokens(b)), SPECIAL)


def differ_in_one(a: Column, b: Column, kind: str) -> Column:
    """Both have one token of a kind, a different one, and are equal before and after it."""
    pattern = f"^([a-z0-9 ]*?) ?{kind} ?([a-z0-9 ]*?)$"
    group = lambda c, i: F.regexp_extract(c, pattern, i)
    one = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda t: t.rlike(f"^{kind}$"))) == 1
    return one(a) & one(b) & a.rlike(pattern) & b.rlike(pattern) & (group(a, 2) != group(b, 2)) & (group(a, 1) == group(b, 1)) & (group(a, 3) == group(b, 3))


def one_more(a: Column, b: Column, kind: str) -> Column:
    """The first has just one token more than the second, of a kind.  The second's isn't looked for: the rule is one-sided."""
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    more = F.array_except(x, y)
    return (a != b) & (F.size(x) == F.size(y) + 1) & (F.size(more) == 1) & F.coalesce(F.get(more, F.lit(0)).rlike(f"^(?:{kind})$"), F.lit(False))


def filter_out(search: Column, found: Column) -> Column:
    """Whether a candidate is to be dropped for a search term by any of the rules above."""
    return (
        only_numbers_common(search, found) | only_single_common(search, found) | only_special_common(search, found)
        | differ_in_one(search, found, "([0-9]+)") | differ_in_one(search, found, words.GREEK_REGEX)
        | one_more(search, found, OTHER_NUMBER) | one_more(search, found, words.SUB_GREEK_REGEX) | one_more(search, found, words.MODIFIER_REGEX)
    )


def numbers(name: Column) -> Column:
    """The number tokens, sorted, repeated ones kept."""
    return F.sort_array(F.filter(F.split(name, r"\s"), lambda t: t.rlike(NUMBER)))


def number_compatible(a: Column, b: Column) -> Column:
    """The same numbers, each as often."""
    return numbers(a) == numbers(b)


def single_symbols(name: Column) -> Column:
    """Single letters, numbers and Greek letters, sorted, repeated ones kept."""
    return F.sort_array(F.filter(F.split(name, r"\s"), lambda t: t.rlike(SYMBOL)))


def content_tokens(name: Column) -> Column:
    """All other tokens, sorted, repeated ones kept."""
    return F.sort_array(F.filter(F.split(name, r"\s"), lambda t: ~t.rlike(SYMBOL)))


def common_tokens(a: Column, b: Column) -> Column:
    """How many tokens are common, a repeated one as often as both have it."""
    return T.common_size(F.split(a, r"\s"), F.split(b, r"\s"))


def overlaps(a: Column, b: Column) -> Column:
    """Different names with a token in common."""
    return (a != b) & (F.size(F.array_intersect(tokens(a), tokens(b))) >= 1)


def overlaps_enough(a: Column, b: Column, ratio: float = 0.5, longest: int = 5) -> Column:
    x, y = tokens(a), tokens(b)
    return (T.overlap_ratio(x, y) >= ratio) & (F.size(x) <= longest) & (F.size(y) <= longest)


def overlaps_with_meaning(a: Column, b: Column, ratio: float = 0.5) -> Column:
    """Enough common tokens, not all of them, nor all that only the first has, numbers or single letters."""
    x, y = tokens(a), tokens(b)
    slight = "^([0-9]+|[a-z])$"
    return (T.overlap_ratio(x, y) >= ratio) & ~_all(F.array_intersect(x, y), slight) & ~_all(F.array_except(x, y), slight)


# Candidates: ``entries`` is array<struct<id, priority, tax>>

PERFECT = 9999.0


def is_exact(score: Column) -> Column:
    return score == PERFECT


def is_disambiguated(chosen: Column) -> Column:
    """An id has been chosen."""
    return chosen.isNotNull()


def is_ambiguous(entries: Column) -> Column:
    """More than one id."""
    return F.size(F.array_distinct(F.transform(entries, lambda e: e["id"]))) > 1


def is_ambiguous_within(entries: Column) -> Column:
    """More than one id in one taxon."""
    taxa = F.array_distinct(F.transform(entries, lambda e: e["tax"]))
    return F.exists(taxa, lambda t: F.size(ids_of(entries, t)) > 1)


def is_ambiguous_between(entries: Column) -> Column:
    """Ids in more than one taxon."""
    return F.size(F.array_distinct(F.transform(entries, lambda e: e["tax"]))) > 1


def has_tax(entries: Column, tax: Column) -> Column:
    return F.exists(entries, lambda e: e["tax"] == tax)


def ids_of(entries: Column, tax: Column) -> Column:
    """Distinct ids of a taxon."""
    return F.array_distinct(F.transform(F.filter(entries, lambda e: e["tax"] == tax), lambda e: e["id"]))


def priorities_of(entries: Column, ids: Column) -> Column:
    """Priorities of the ids given."""
    return let(ids, lambda known: F.transform(F.filter(entries, lambda e: F.array_contains(known, e["id"])), lambda e: e["priority"]))


def restrict_to_tax(entries: Column, tax: Column) -> Column:
    """The last entry's id of a taxon; null if it has none."""
    return let(F.filter(entries, lambda e: e["tax"] == tax), lambda own: F.when(F.size(own) > 0, F.element_at(own, -1)["id"]))


def id_in_tax(entries: Column, tax: Column) -> Column:
    """The id of a taxon if it is the only one."""
    return let(ids_of(entries, tax), lambda own: F.when(F.size(own) == 1, F.get(own, F.lit(0))))
