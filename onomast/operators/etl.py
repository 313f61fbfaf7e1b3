"""Dictionary building: filters, unpivoting, mapping joins, unions and deduplication of (name, id, priority) tables.

Every function takes and gives DataFrames and leaves the choice of joins to
the optimizer, which broadcasts a side only if its size is known to be small.
An input row with a null in a column that a predicate reads is treated as the
predicate's docstring says; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions import normalize as N
from onomast.functions import words

#: Priority of names that no cleaner may drop: the official symbols.
OFFICIAL = -1


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Filters


def accepted_status(status: str | Column) -> Column:
    """Not greater than 0: as a number if it is one, else as text.  Null is accepted."""
    text = _col(status).cast("string")
    number = text.try_cast("double")
    return ~F.coalesce(F.when(number.isNotNull(), number > 0).otherwise(text > "0"), F.lit(False))


def with_status(table: DataFrame, status: str) -> DataFrame:
    return table.where(accepted_status(status))


def _tagged(table: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """``table`` with a column that says whether its key is among the ids (their first column)."""
    known = ids.select(F.col(ids.columns[0]).alias("_known")).where("_known IS NOT NULL").distinct()
    return table.join(known, table[key].eqNullSafe(F.col("_known")), "left").withColumn(name, F.col("_known").isNotNull()).drop("_known")


def eligible(
    table: DataFrame, organisms: DataFrame, accepted: DataFrame, forced: DataFrame, *, key: str = "gene_id", tax: str = "tax_id", symbol: str = "symbol", description: str = "description",
    uncertain: str = "^putative.*protein$", hypothetical: str = "hypothetical protein", placeholder: str = "NEWENTRY",
) -> DataFrame:
    """Rows whose key is forced, or that are neither uncertain nor hypothetical nor a placeholder, of a wanted organism and of accepted status.

    Null texts count as empty; a null key or taxon is in no list.
    """
    tagged = _tagged(_tagged(_tagged(table, organisms, tax, "_org"), accepted, key, "_acc"), forced, key, "_forced")
    said = F.coalesce(F.col(description), F.lit(""))
    good = ~said.rlike(uncertain) & (said != hypothetical) & (F.coalesce(F.col(symbol), F.lit("")) != placeholder) & F.col("_org") & F.col("_acc")
    return tagged.where(F.col("_forced") | good).select(*table.columns)


def restrict(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the first column of ``ids``: a semi-join."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def exclude(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the first column of ``ids``: an anti-join.  A null key is in no list."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def clean_patterns(table: DataFrame, listed: Sequence[str] | DataFrame = (), name: str = "name", priority: str = "priority", uncertain: Sequence[str] = tuple(words.UNCERTAIN)) -> DataFrame:
    """Drop names that are listed (whatever their case), uncertain, made of digits and punctuation, contain ``rik``, are one letter or a weight; official ones stay.

    A null name is dropped unless official.
    """
    n = F.coalesce(F.col(name), F.lit(""))
    unsure = "|".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in uncertain)
    odd = n.rlike(unsure) | n.rlike(r"^[\p{Punct}0-9\s]*$") | n.rlike("(?i)rik") | n.rlike("^[A-Za-z]$") | n.rlike(r"[0-9]+\.?[0-9]*\s?kDa")
    official = F.coalesce(F.col(priority) == OFFICIAL, F.lit(False))
    if isinstance(listed, DataFrame):
        known = listed.select(F.lower(F.col(listed.columns[0])).alias("_listed")).distinct()
        tagged = table.join(known, F.lower(n) == F.col("_listed"), "left")
        return tagged.where(official | ~(odd | F.col("_listed").isNotNull())).select(*table.columns)
    return table.where(official | ~(odd | F.lower(n).isin([x.lower() for x in listed])))


def _generic_token(t: Column, listed: Sequence[str]) -> Column:
    return t.isin(list(listed)) | t.rlike("^[0-9]+$") | t.rlike(f"^{words.GREEK_REGEX}$") | t.rlike(f"^(?:{'|'.join(words.ROMAN)})$")


def drop_generic(table: DataFrame, name: str = "name", priority: str = "priority", listed: Sequence[str] = tuple(words.NON_DESCRIPTIVES)) -> DataFrame:
    """Drop normalized names whose every token is non-descriptive, a number, a Greek letter or a numeral; official ones stay."""
    some = F.exists(N.tokens(F.col(name)), lambda t: ~_generic_token(t, listed))
    return table.where(F.coalesce(F.col(priority) == OFFICIAL, F.lit(False)) | some)


def drop_families(table: DataFrame, name: str = "name", priority: str = "priority", listed: Sequence[str] = tuple(words.UNSPECIFIED), longest: int = 8) -> DataFrame:
    """Drop names of more than ``longest`` tokens, of one character, of families and of unspecified things; official ones stay."""
    n, parts = F.col(name), N.tokens(F.col(name))
    odd = (F.size(parts) > longest) | ((F.size(parts) < 2) & (F.length(n) < 2)) | N.is_family(n) | N.is_unspecified(n, listed)
    return table.where(F.coalesce(F.col(priority) == OFFICIAL, F.lit(False)) | ~F.coalesce(odd, F.lit(True)))


def drop_containing(table: DataFrame, text: str, phrases: Sequence[str], start: str = "in vi") -> DataFrame:
    """Drop rows whose text has one of the phrases, starts with ``start``, is ``-``, blank or null."""
    t = F.col(text)
    hit = t.rlike(r"^\s*-?\s*$") | t.startswith(start)
    for p in phrases:
        hit = hit | t.contains(p)
    return table.where(~F.coalesce(hit, F.lit(True)))


def drop_dashes(table: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with ``-``, which stands for null, or null in any of the columns."""
    out = table
    for c in columns:
        out = out.where(F.col(c) != "-")
    return out


def clean_designations(table: DataFrame, text: str, listed: Sequence[str] = tuple(words.UNSPECIFIED)) -> DataFrame:
    """Drop rows whose raw text is that of a family or unspecified."""
    return table.where(~F.coalesce(N.is_family(F.col(text)) | N.is_unspecified(F.col(text), listed), F.lit(True)))


# Columns


def swapped(table: DataFrame, a: str, b: str) -> DataFrame:
    return table.select(b, a)


def with_priority(table: DataFrame, priority: int, column: str = "priority") -> DataFrame:
    return table.withColumn(column, F.lit(priority))


def ec_names(table: DataFrame, codes: str, between: str = ";") -> DataFrame:
    """A row for each code of a list, named ``EC`` and the code, in the place of the list."""
    return exploded(table, codes, between).withColumn(codes, F.concat(F.lit("EC "), F.col(codes)))


def unpivoted(table: DataFrame, key: str, sources: Mapping[str, int]) -> DataFrame:
    """(name, id, priority): a row for each source column that isn't null, empty or ``-``, with that column's priority."""
    each = F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("name"), F.lit(p).alias("priority")) for c, p in sources.items()]))
    return table.select(F.col(key).alias("id"), each.alias("_e")).where("_e.name IS NOT NULL AND _e.name NOT IN ('-', '')").select("_e.name", "id", "_e.priority")


def exploded(table: DataFrame, lists: str, between: str = "|") -> DataFrame:
    """A row for each part of a list, without blanks around it and without empty parts; other columns repeat."""
    cut = F.explode(F.split(F.col(lists), "[" + between.replace("\\", "\\\\").replace("]", "\\]") + "]"))
    rest = [c for c in table.columns if c != lists]
    return table.select(*rest, cut.alias(lists)).withColumn(lists, F.trim(lists)).where(F.col(lists) != "").select(*table.columns)


def paired(table: DataFrame, a: str, b: str, between: str = ";") -> DataFrame:
    """Every part of one list with every part of another of the same row."""
    return exploded(exploded(table, a, between), b, between)


# Joins


def replace_ids(table: DataFrame, mapping: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """The key replaced by all that the mapping gives for it; rows without any vanish, and so do null keys."""
    pairs = mapping.select(F.col(old).alias(key), F.col(new).alias("_new"))
    return table.join(pairs, key).withColumn(key, F.col("_new")).select(*table.columns)


def enriched(table: DataFrame, other: DataFrame, key: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Columns of another table by key, null where it has none.  Of several rows with a key the one greatest in ``order`` (or else in the columns) is taken."""
    rank = F.struct(*([order] if order else []), *columns)
    one = other.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("_one"))
    return table.join(one, key, "left").select(*[table[c] for c in table.columns], *[F.col("_one")[c].alias(c) for c in columns])


def looked_up(table: DataFrame, mapping: DataFrame, key: str, value: str, missing: str = "") -> DataFrame:
    """A value by key, ``missing`` where there is none."""
    found = enriched(table, mapping, key, [value])
    return found.withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(missing)))


# Groups and sets


def united(*tables: DataFrame) -> DataFrame:
    """All rows of all tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def united_set(*tables: DataFrame) -> DataFrame:
    """Each different row once."""
    return united(*tables).distinct()


def missing_from(table: DataFrame, other: DataFrame) -> DataFrame:
    """Different rows of the first that the second lacks."""
    return table.subtract(other)


def best_priority(dictionary: DataFrame) -> DataFrame:
    """One row for each name and id, with the least priority."""
    return dictionary.groupBy("name", "id").agg(F.min("priority").alias("priority"))


def listed(table: DataFrame, key: str, value: str, different: bool = True) -> DataFrame:
    """The values of each key, sorted: different ones, or all."""
    return table.groupBy(key).agg(F.sort_array((F.collect_set if different else F.collect_list)(value)).alias(value))


def concatenated(table: DataFrame, key: str, text: str, order: str, newest_first: bool = True, between: str = " ") -> DataFrame:
    """The texts of each key, joined in an order."""
    rows = F.sort_array(F.collect_list(F.struct(order, text)), asc=not newest_first)
    return table.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[text]), between).alias(text))


def normalized(dictionary: DataFrame, basic: bool = False) -> DataFrame:
    """(name, id, priority): every name in its normal form and in those of its variants, each once; names that normalize to nothing are left out."""
    form = N.normalize_basic if basic else N.normalize
    own = dictionary.withColumn("_n", form(F.col("name"))).where("_n <> ''")
    raw = own.select("_n", "id", "priority", F.explode(F.concat(F.array(F.lit(None).cast("string")), N.variants(F.col("name")))).alias("_v"))
    return raw.select(F.coalesce(form(F.col("_v")), F.col("_n")).alias("name"), "id", "priority").distinct()


def ordered(dictionary: DataFrame, *columns: str) -> DataFrame:
    """Sorted by columns, text by its bytes."""
    return dictionary.orderBy(*columns)


def dictionary(sources: Sequence[DataFrame], listed_names: Sequence[str] | DataFrame = ()) -> DataFrame:
    """The dictionary from (name, id, priority) tables: united, normalized with variants, the least priority kept, cleaned."""
    all_names = best_priority(normalized(united_set(*sources)))
    return drop_families(drop_generic(clean_patterns(all_names, listed_names)))
