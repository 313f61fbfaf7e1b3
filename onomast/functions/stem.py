"""English stemming (Porter's second algorithm, as published at snowballstem.org) as an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "[aeiouy]"
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
          ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else (x.end() if (x := re.search(f"{_V}[^aeiouy]", w)) else len(w))
    x = re.search(f"{_V}[^aeiouy]", w[r1:])
    return r1, r1 + x.end() if x else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(100_000)
def stem(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _SAME:
        return w
    w = w.lstrip("'") if w.startswith("'") else w
    w = re.sub(r"^y", "Y", w)
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if w.endswith(("eedly", "eed")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif m := re.search(r"(ingly|edly|ing|ed)$", w):
        if re.search(_V, w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    if re.search(r".[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(words: pa.Array) -> pa.Array:
    """Every word's stem; Python sees each different word of a batch once, so its objects are as many as these."""
    coded = words.dictionary_encode()
    return pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def stemmed_lists(lists: pa.Array) -> pa.Array:
    """Lists of words, each stemmed; nulls stay."""
    lists = lists.cast(pa.list_(pa.string()))
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))
    starts = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(starts, _stems(lists.flatten()), mask=lists.is_null())


def stemmed_tokens(name: Column) -> Column:
    """A name's tokens stemmed, joined again."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names in batches:
            coded = names.dictionary_encode()
            done = [" ".join(stem(t) for t in x.split()) for x in coded.dictionary.to_pylist()]
            yield pa.array(done, pa.string()).take(coded.indices)

    return run(name)


def stemmed(parts: Column) -> Column:
    """An array of tokens, each stemmed."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield stemmed_lists(lists)

    return run(parts)
