"""The token index of a dictionary, as ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions import normalize as N
from onomast.functions.stem import stemmed_tokens


def synonyms(dictionary: DataFrame) -> DataFrame:
    """(synonym, tokens, n_tokens, entries): each name once with the (id, priority, tax) that it stands for, sorted."""
    entries = F.sort_array(F.collect_set(F.struct("id", "priority", "tax")))
    out = dictionary.where("name <> ''").groupBy(F.col("name").alias("synonym")).agg(entries.alias("entries"))
    parts = N.tokens(F.col("synonym"))
    return out.select("synonym", parts.alias("tokens"), F.size(parts).alias("n_tokens"), "entries")


def entries(dictionary: DataFrame) -> DataFrame:
    """(synonym, id, priority, tax), each once: the form in which the operators join, as no name's entries need to be in one row."""
    return dictionary.where("name <> ''").select(F.col("name").alias("synonym"), "id", "priority", "tax").distinct()


def postings(names: DataFrame, name: str = "name") -> DataFrame:
    """(token, synonym, tf, n_tokens) of each different name."""
    different = names.where(F.col(name) != "").select(F.col(name).alias("synonym")).distinct()
    parts = N.tokens(F.col("synonym"))
    each = different.select("synonym", F.size(parts).alias("n_tokens"), parts.alias("_parts"), F.explode(F.array_distinct(parts)).alias("token"))
    return each.select("token", "synonym", F.size(F.filter("_parts", lambda t: t == F.col("token"))).alias("tf"), "n_tokens")


def token_weights(postings_: DataFrame) -> DataFrame:
    """(token, df, idf): names that have a token, and 1 + ln((N + 1) / (df + 1)) with N names in all."""
    total = postings_.select("synonym").distinct().agg(F.count("*").alias("_n"))
    df = postings_.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(total).select("token", "df", (1 + F.log((F.col("_n") + 1) / (F.col("df") + 1))).alias("idf"))  # with one row


def id_centric(dictionary: DataFrame) -> DataFrame:
    """A row for each name and id: original, normalized, variants, stemmed forms, priority."""
    n = N.normalize(F.col("name"))
    rows = dictionary.select("id", "tax", "priority", F.col("name").alias("original_name"), n.alias("synonym"), F.transform(N.variants(F.col("name")), lambda v: N.normalize_basic(v)).alias("variants"))
    return rows.where("synonym <> ''").withColumn("stemmed", stemmed_tokens(F.col("synonym")))


def context_items(*sources: tuple[str, DataFrame]) -> DataFrame:
    """(id, field, item): the different items of all (field, table of id and item) sources, normalized."""
    out = None
    for field, table in sources:
        rows = table.select("id", F.lit(field).alias("field"), N.normalize(F.col("item")).alias("item")).where("item <> ''").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def concatenated_context(ids: DataFrame, *parts: DataFrame) -> DataFrame:
    """(id, context): the texts that tables of (id, text) have for each id, one after the other in the order of the tables; missing ones are skipped."""
    out = ids.select("id").distinct()
    for i, part in enumerate(parts):
        out = out.join(part.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias(f"_{i}")), "id", "left")
    return out.select("id", F.trim(F.concat_ws(" ", *[F.trim(f"_{i}") for i in range(len(parts))])).alias("context"))


def go_context(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, text): the names of each id's codes (id, item) in a table of (go, names as ``|`` list); unknown codes add nothing."""
    each = terms.select(F.col("go").alias("item"), F.regexp_replace("names", r"\|", " ").alias("text"))
    return items.join(each, "item").select("id", "text")


def spelling(postings_: DataFrame) -> DataFrame:
    """(gram, token): the tokens of the index by their character trigrams."""
    tokens = postings_.select("token").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("token") - 2, F.lit(1)))
    return tokens.select("token", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("token"), i, F.lit(3))))).alias("gram"))


def corrected(tokens: DataFrame, postings_: DataFrame, token: str = "token") -> DataFrame:
    """(token, correction) of the plural-looking tokens that the index lacks: the indexed token with most trigrams in common, then fewest edits, then first."""
    wanted = tokens.select(F.col(token).alias("token")).where(F.col("token").rlike("^..+s$")).distinct().join(postings_.select("token").distinct(), "token", "left_anti")
    grams = spelling(wanted.withColumnRenamed("token", "token")).withColumnRenamed("token", "wrong")
    near = grams.join(spelling(postings_), "gram").groupBy("wrong", "token").agg(F.count("*").alias("n"))
    rank: Column = F.struct((-F.col("n")).alias("n"), F.levenshtein("wrong", "token").alias("d"), "token")
    return near.groupBy(F.col("wrong").alias("token")).agg(F.min(rank)["token"].alias("correction"))
