"""Name normalization as column expressions.

Everything but the splitting of compounds at Greek letters is native, inside
code generation; regular expressions are Java's.  Null in gives null out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from onomast.functions import words
from onomast.functions.automaton import Automaton

#: Where letters and digits, and cases, change within a token.
BOUNDARY = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])|(?<=[A-Z][A-Z])(?=[a-z])"
_ROMAN = "|".join(words.ROMAN)
#: A token cut into numerals and other characters from the left, that ends in a numeral and doesn't start with it.
_ENDS_ROMAN = rf"^((?:(?>{_ROMAN})|(?!{_ROMAN}).)+)((?>{_ROMAN}))$"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def tokens(name: Column, pattern: str = " ") -> Column:
    """The parts between blanks; trailing empty ones are left out."""
    return let(F.regexp_replace(name, f"(?:{pattern})+$", ""), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, pattern)))


def drop_stop_words(parts: Column, stop: Sequence[str] = tuple(words.STOP)) -> Column:
    """Tokens but the stop words, by case; a single token stays whatever it is."""
    return let(parts, lambda p: F.when(F.size(p) == 1, p).otherwise(F.filter(p, lambda t: ~t.isin(list(stop)))))


def plain_token(token: Column) -> Column:
    """Special characters as blanks, but dots; then a blank for the last dot between a letter and a letter or digit."""
    token = F.regexp_replace(token, r"[\W_&&[^\.]]", " ")
    return F.regexp_replace(token, r"^(.*)([a-zA-Z])\.([a-zA-Z0-9])(.*)$", "$1$2 $3$4")


def squeeze(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, " +", " "))


def split_changes(name: Column) -> Column:
    """A blank wherever letters and digits, or cases, change."""
    return F.regexp_replace(name, BOUNDARY, " ")


def small_romans(parts: Column) -> Column:
    """I to IV as digits, where there is more than one token."""
    digit = lambda t: F.when(t == "I", "1").when(t == "II", "2").when(t == "III", "3").when(t == "IV", "4").otherwise(t)
    return let(parts, lambda p: F.when(F.size(p) > 1, F.transform(p, digit)).otherwise(p))


@cache
def _letters() -> Automaton:
    return Automaton([*words.GREEK, *words.LEVELS])


def greek_split(parts: list[str], strict: bool = False) -> list[str]:
    """Tokens cut before and after the names of Greek letters, ``high`` and ``low`` inside them.

    Cut tokens are in lower case.  As it has always been (both sides of a
    lookup are treated alike), the token after one that ends in such a word
    isn't looked at, and a single character left after one is dropped; not so
    with ``strict``.
    """
    out, i = [], 0
    while i < len(parts):
        part = parts[i].lower()
        found = _letters().longest(part)
        if not found or (len(found) == 1 and found[0][2] == part):
            out.append(parts[i])
            i += 1
            continue
        at = 0
        for a, b, word in found:
            if a > at:
                out.append(part[at:a])
            out.append(word)
            at = b + 1
        rest = part[at:]
        if len(rest) > 1 or (strict and rest):
            out.append(rest)
        elif not strict and i + 1 < len(parts):
            i += 1
            out.append(parts[i])
        i += 1
    return out


def split_greek(name: Column, strict: bool = False) -> Column:
    """:func:`greek_split` of the tokens between blanks, each distinct name once a batch."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names in batches:
            coded = names.dictionary_encode()
            done = [" ".join(greek_split([t for t in x.split(" ") if t], strict)) for x in coded.dictionary.to_pylist()]
            yield pa.array(done, pa.string()).take(coded.indices)

    return of(name)


def _before_greek(name: Column) -> Column:
    plain = F.array_join(F.transform(drop_stop_words(tokens(name)), plain_token), " ")
    return squeeze(split_changes(squeeze(plain)))


def _after_greek(name: Column) -> Column:
    return F.trim(F.lower(F.array_join(small_romans(tokens(name)), " ")))


def normalize_basic(name: Column) -> Column:
    """Normal form without splitting at Greek letters: native throughout."""
    return _after_greek(_before_greek(name))


def normalize(name: Column, strict: bool = False) -> Column:
    """Normal form of a name: stop words, special characters, changes within tokens, Greek letters, numerals I to IV, lower case."""
    return _after_greek(split_greek(_before_greek(name), strict))


def split_romans(name: Column) -> Column:
    """A numeral from I to XX at a token's end as a token of its own."""
    return F.array_join(F.transform(F.split(name, r"\s+"), lambda t: F.regexp_replace(t, _ENDS_ROMAN, "$1 $2")), " ")


def variants(name: Column) -> Column:
    """Four ways to write a name: joined at hyphens, numerals split off, Greek letters short, and short without the blank before."""
    short, close = name, name
    for letter in ("alpha", "beta", "gamma", "delta"):
        short = F.regexp_replace(short, letter, letter[0])
        close = F.regexp_replace(close, rf"\s?{letter}", letter[0])
    return F.array(F.regexp_replace(name, "([^-0-9])-([^0-9])", "$1$2"), split_romans(name), short, close)


def drop_non_descriptive(name: Column, listed: Sequence[str] = tuple(words.NON_DESCRIPTIVES)) -> Column:
    """A name without its non-descriptive tokens."""
    return F.array_join(F.filter(tokens(name), lambda t: ~t.isin(list(listed))), " ")


def short_forms(name: Column) -> Column:
    """L and R after a name as ligand and receptor; ``il`` as interleukin; listed plurals as singulars; hyphens as blanks."""
    parts = tokens(F.regexp_replace(name, "-", " "))

    def long(t: Column) -> Column:
        spelt = F.when(t.rlike("^(?:.*[0-9a-z])?L$|^(?:.*[0-9])?l$"), F.concat(F.regexp_replace(t, "[lL]$", ""), F.lit(" ligand")))
        spelt = spelt.when(t.rlike("^(?:.*[0-9a-z])?R$|^(?:.*[0-9])?r$"), F.concat(F.regexp_replace(t, "[rR]$", ""), F.lit(" receptor")))
        spelt = spelt.when(t == "il", "interleukin").when(t.rlike("^(receptor|protein|factor|ligand|chain|antigen|gene|transcript)s$"), F.regexp_replace(t, "s$", ""))
        return spelt.otherwise(t)

    return squeeze(F.array_join(F.transform(parts, long), " "))


def _one_of(listed: Sequence[str]) -> str:
    return "(?:" + "|".join(listed) + ")"


def is_unspecified(name: Column, listed: Sequence[str] = tuple(words.UNSPECIFIED)) -> Column:
    """Whether a name is one of the listed ones, or that with e, s or es after it: a look-up of four stems, whatever the list's length."""
    known = F.array(*[F.lit(x) for x in sorted(set(listed))])
    stems = lambda n: F.array(n, *[F.when(n.endswith(e), F.substring(n, F.lit(1), F.length(n) - len(e))) for e in ("e", "s", "es")])
    return F.exists(F.array(name), lambda n: F.exists(stems(n), lambda s: F.array_contains(known, F.coalesce(s, F.lit("\0")))))


def is_family(name: Column) -> Column:
    return name.rlike(words.FAMILY_REGEX + "$")


def is_trailing_non_descriptive(name: Column) -> Column:
    return name.rlike(rf"^.* {words.TRAILING_REGEX}$")


def remove_unspecified(name: Column, listed: Sequence[str] = tuple(words.UNSPECIFIED)) -> Column:
    return let(name, lambda n: F.when(is_unspecified(n, listed), "").otherwise(F.trim(n)))


def remove_family(name: Column) -> Column:
    """A family's name is removed whole."""
    return F.trim(F.regexp_replace(name, words.FAMILY_REGEX + "$", ""))


def remove_premodifier(name: Column, listed: Sequence[str] = tuple(words.PREMODIFIERS)) -> Column:
    return F.trim(F.regexp_replace(name, f"^{_one_of(listed)} ", ""))


def remove_trailing(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, rf"^(?=.* {words.TRAILING_REGEX}$)(.*?){words.TRAILING_REGEX}$", "$1"))


def remove_modifiers(name: Column, unspecified: Sequence[str] = tuple(words.UNSPECIFIED), premodifiers: Sequence[str] = tuple(words.PREMODIFIERS)) -> Column:
    """A normalized name without what doesn't tell names apart; "" if nothing else is in it."""
    return remove_trailing(remove_premodifier(remove_family(remove_unspecified(name, unspecified)), premodifiers))


def expand_greek(name: Column, keep_tail: bool = False) -> Column:
    """Single lower-case letters as the Greek ones they stand for; a last single character after one is lost, unless ``keep_tail``."""

    def spelt(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for letter, word in words.GREEK_OF.items():
            out = F.when(t == letter, word).otherwise(out)
        return F.coalesce(out, t)

    # tokens and what is between them, one after the other
    parts = F.regexp_extract_all(name, F.lit(r"(?s)(\b[a-zA-Z]\b|(?:(?!\b[a-zA-Z]\b).)+)"), 1)
    whole = F.array_join(F.transform(parts, spelt), "")
    lost = F.lit(False) if keep_tail else name.rlike(r"(?s)\b[a-zA-Z]\b.$")
    return F.when(lost, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)


def is_ec_number(name: Column) -> Column:
    """Whether it is an enzyme's number, as in EC 1.1.99.1."""
    return name.rlike(r"^(?:[Ee][Cc] ?)?[0-9]+\.[0-9-]+\.[0-9-]+\.[0-9n-]+$")


def is_locus(name: Column) -> Column:
    """Whether it is a place on a chromosome, as in 17q21.3 or Xp22."""
    return name.rlike(r"^(?:[0-9]{1,2}|[XY])[pq][0-9]+(?:\.[0-9]+)?(?:-?[pq]?[0-9]+(?:\.[0-9]+)?)?$")
