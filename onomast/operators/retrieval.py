"""Candidates for mentions: token joins, relevance, choice by taxon, and decision by context.

Mentions are reduced to their different normalized forms before anything is
joined, and results are joined back, so a name that is mentioned very often
costs as much as one mentioned once.  Top lists are cut in windows for which
the optimizer limits groups before it shuffles them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions import normalize as N
from onomast.functions import rules
from onomast.operators.index import token_weights
from onomast.operators.tables import cut

PERFECT = 9999.0
TOP = 20
EXACT, APPROX = "EXACT", "APPROX"


def query_tokens(forms: DataFrame, form: str = "form") -> DataFrame:
    """(form, token, times) of each different normalized form."""
    parts = N.tokens(F.col(form))
    each = forms.where(F.col(form) != "").select(F.col(form).alias("form")).distinct().withColumn("_parts", parts if form == "form" else N.tokens(F.col("form")))
    return each.select("form", "_parts", F.explode(F.array_distinct("_parts")).alias("token")).select("form", "token", F.size(F.filter("_parts", lambda t: t == F.col("token"))).alias("times"))


def or_query(forms: DataFrame, postings: DataFrame) -> DataFrame:
    """(form, synonym, shared): names that share a token with a form, and how many different ones."""
    return query_tokens(forms).join(postings, "token").groupBy("form", "synonym").agg(F.count("*").alias("shared"))


def and_query(forms: DataFrame, postings: DataFrame) -> DataFrame:
    """(form, synonym): names that have all tokens of a form."""
    want = query_tokens(forms).withColumn("n", F.count("*").over(Window.partitionBy("form")))
    found = want.join(postings, "token").groupBy("form", "synonym", "n").agg(F.count("*").alias("shared"))
    return found.where("shared = n").select("form", "synonym")


def scored(forms: DataFrame, postings: DataFrame) -> DataFrame:
    """(form, synonym, score) of all names that share a token: sum over the form's tokens of sqrt(tf) idf^2 / sqrt(length), rounded to 6 places."""
    weighed = postings.join(token_weights(postings).select("token", "idf"), "token")
    part = F.col("times") * F.sqrt("tf") * F.col("idf") * F.col("idf") / F.sqrt("n_tokens")
    return query_tokens(forms).join(weighed, "token").groupBy("form", "synonym").agg(F.round(F.sum(part), 6).alias("score"))


def best_of_fields(*clauses: DataFrame) -> DataFrame:
    """(form, synonym, score): of the scores of several clauses the greatest, as in a disjunction without tie breaker."""
    out = clauses[0]
    for c in clauses[1:]:
        out = out.unionByName(c)
    return out.groupBy("form", "synonym").agg(F.max("score").alias("score"))


def top_hits(forms: DataFrame, postings: DataFrame, top: int = TOP, entries: DataFrame | None = None, taxa: Sequence[str] | None = None) -> DataFrame:
    """(form, synonym, score, rank) of the ``top`` names of greatest score; a name equal to the form scores PERFECT afterwards.

    With ``taxa`` only names that stand for an id of one of them are searched,
    without bearing on scores.  Equal scores are ordered by name.
    """
    all_hits = scored(forms, postings)
    if taxa is not None:
        all_hits = all_hits.join(entries.where(F.col("tax").isin(list(taxa))).select("synonym").distinct(), "synonym", "left_semi")
    order = Window.partitionBy("form").orderBy(F.desc("score"), "synonym")
    cut = all_hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    found = cut.select("form", "synonym", F.when(F.col("form") == F.col("synonym"), PERFECT).otherwise(F.col("score")).alias("score"))
    return found.withColumn("rank", F.row_number().over(order))


def candidates(forms: DataFrame, postings: DataFrame, entries: DataFrame, taxa: Sequence[str] | None = None, top: int = TOP) -> DataFrame:
    """(form, synonym, score, entries): hits with what they stand for; with ``taxa`` one search for each, put together."""
    if taxa is None:
        hits = top_hits(forms, postings, top)
    else:
        hits = None
        for t in taxa:
            one = top_hits(forms, postings, top, entries, [t])
            hits = one if hits is None else hits.unionByName(one)
    of = hits.select("synonym").distinct().join(entries, "synonym").groupBy("synonym").agg(F.sort_array(F.collect_set(F.struct("id", "priority", "tax"))).alias("entries"))
    return hits.join(of, "synonym").select("form", "synonym", "score", "entries")


def best_synonyms(hits: DataFrame, entries: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """(form, synonym, score, tax): of each form's hits those with the best score of all that stand for an id of a wanted taxon; the first such taxon in the order given.

    If only names of other taxa have the best score, none is left.
    """
    best = hits.withColumn("_best", F.max("score").over(Window.partitionBy("form"))).where("score = _best").drop("_best")
    order = F.create_map(*[F.lit(x) for i, t in enumerate(dict.fromkeys(taxa)) for x in (t, i)])
    own = entries.where(F.col("tax").isin(list(taxa))).groupBy("synonym").agg(F.min(F.struct(order[F.col("tax")].alias("o"), "tax"))["tax"].alias("tax"))
    return best.join(own, "synonym").select("form", "synonym", "score", "tax")


def phrase_scores(pairs: DataFrame, items: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(synonym, id, score) for pairs of a name and an id: how relevant the name, as a phrase, is in the id's items (id, item); 0 where it isn't found.

    The phrase must be within one item.  BM25: an id's items are one document.
    """
    parts = N.tokens(F.col("item"))
    size = items.groupBy("id").agg(F.sum(F.size(parts)).alias("dl"))
    total = size.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    wanted = pairs.select("synonym", "id").distinct()
    tokens = wanted.select("synonym").distinct().select("synonym", F.explode(N.tokens(F.col("synonym"))).alias("token"))
    df = items.select("id", F.explode(parts).alias("token")).join(tokens.select("token").distinct(), "token", "left_semi").distinct().groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = tokens.join(df, "token").crossJoin(total.select("n_docs")).groupBy("synonym").agg(F.sum(idf).alias("idf"))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    # counts may overlap at a blank that two occurrences share, so blanks are doubled
    doubled = F.concat(F.lit(" "), F.regexp_replace("item", " ", "  "), F.lit(" "))
    times = F.size(F.split(doubled, F.concat(F.lit("\\Q"), F.regexp_replace(spaced("synonym"), "(?<=[^ ]) (?=[^ ])", "  "), F.lit("\\E")), -1)) - 1
    found = wanted.join(items, "id").where(F.contains(spaced("item"), spaced("synonym"))).groupBy("synonym", "id").agg(F.sum(times).alias("tf"))
    value = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    known = found.join(weights, "synonym").join(size, "id").crossJoin(total.select("avg_dl")).select("synonym", "id", F.round(value, 6).alias("score"))
    return wanted.join(known, ["synonym", "id"], "left").select("synonym", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def disambiguated(best: DataFrame, entries: DataFrame, items: DataFrame) -> DataFrame:
    """(form, synonym, score, tax, id, semantic_score, match_type): the first best name of each form, and of its ids in the taxon the one whose context speaks most for it.

    Equal contexts: least priority, then least id.  A single id needs no context.
    """
    first = best.groupBy("form").agg(F.min(F.struct("synonym", "score", "tax")).alias("s")).select("form", "s.*")
    own = entries.groupBy("synonym", "tax", "id").agg(F.min("priority").alias("priority"))
    ids = cut(first.join(own, ["synonym", "tax"]).withColumn("_n", F.count("*").over(Window.partitionBy("form"))))
    context = phrase_scores(ids.where("_n > 1"), items).withColumnRenamed("score", "semantic_score")
    ranked = ids.join(context, ["synonym", "id"], "left")
    order = F.struct((-F.coalesce("semantic_score", F.lit(0.0))).alias("s"), "priority", "id")
    chosen = ranked.groupBy("form", "synonym", "score", "tax").agg(F.min(F.struct(order.alias("o"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"))).alias("c"))
    return chosen.select("form", "synonym", "score", "tax", F.col("c.o.id").alias("id"), "c.semantic_score", F.when(F.col("score") == PERFECT, EXACT).otherwise(APPROX).alias("match_type"))


def map_mentions(mentions: DataFrame, postings: DataFrame, entries: DataFrame, items: DataFrame, taxa: Sequence[str], mention: str = "mention", basic: bool = False) -> DataFrame:
    """All rows of ``mentions`` with form, synonym, score, tax, id, semantic_score and match_type; these are null for a mention that is rejected.

    A mention that normalizes to nothing, or is null, is rejected.
    """
    named = mentions.withColumn("form", (N.normalize_basic if basic else N.normalize)(F.col(mention)))
    forms = named.select("form").where("form <> ''").distinct()
    found = disambiguated(best_synonyms(top_hits(forms, postings), entries, taxa), entries, items)
    return named.join(found, "form", "left").select(*mentions.columns, "form", "synonym", "score", "tax", "id", "semantic_score", "match_type")


def map_top_n(terms: DataFrame, postings: DataFrame, n: int, term: str = "term", basic: bool = False) -> DataFrame:
    """(term, form, synonym, score, rank): of the ``n`` best names of each term without its modifiers those that no pair rule drops; so there may be fewer."""
    form = N.remove_modifiers((N.normalize_basic if basic else N.normalize)(F.col(term)))
    named = terms.select(F.col(term).alias("term"), form.alias("form")).where("form <> ''").distinct()
    hits = top_hits(named, postings, n)
    return named.join(hits, "form").where(~rules.filter_out(F.col("form"), F.col("synonym"))).select("term", "form", "synonym", "score", "rank")


# Context as a bag of words


def context_or(queries: DataFrame, documents: DataFrame, least: float = 0.0, allowed: DataFrame | None = None, top: int | None = 1) -> DataFrame:
    """(query_id, id, score): the documents (id, tokens) most relevant to queries (query_id, tokens), any shared token counting; those of at least ``least``.

    ``allowed`` (query_id, id) restricts which are considered without bearing on scores; without ``top`` all are given.

    Documents are shuffled once, by id, and scored where they are: every task
    holds the queries' tokens with their weights.
    """
    want = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    by_id = documents.select("id", F.size("tokens").alias("n"), "tokens").repartition("id")
    tf = by_id.select("id", "n", F.explode("tokens").alias("token")).join(F.broadcast(want.select("token").distinct()), "token", "left_semi").groupBy("id", "n", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    total = documents.agg(F.count("*").alias("_n"))
    weights = df.crossJoin(total).select("token", F.pow(1 + F.log((F.col("_n") + 1) / (F.col("df") + 1)), 2).alias("w"))  # with one row
    part = F.sqrt("tf") * F.col("w") / F.sqrt("n")
    found = tf.join(F.broadcast(want.join(weights, "token")), "token")
    sums = found.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where(F.col("score") >= least)
    if allowed is not None:
        sums = sums.join(allowed, ["query_id", "id"], "left_semi")
    if top is None:
        return sums.select("query_id", "id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return sums.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).select("query_id", "id", "score")


def contexts_of(ids: DataFrame, items: DataFrame, field: str | None = None) -> DataFrame:
    """(id, items): the stored items of ids, of one field or all, sorted."""
    rows = items if field is None else items.where(F.col("field") == field)
    return rows.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"))


def best_contexts(queries: DataFrame, hits: DataFrame, documents: DataFrame, least: float = 0.0, separate: bool = False) -> DataFrame:
    """(query_id, synonym, id, score): of the candidates (query_id, synonym, id) of each query the one whose context is most relevant; with ``separate`` the best for each synonym."""
    scores = context_or(queries, documents, least, hits.select("query_id", "id").distinct(), top=None)
    order = Window.partitionBy("query_id", *(["synonym"] if separate else [])).orderBy(F.desc("score"), "id", "synonym")
    found = hits.select("query_id", "synonym", "id").distinct().join(scores, ["query_id", "id"])
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "synonym", "id", "score")


def ordered_hits(hits: DataFrame, by: str = "score", seed: int = 0) -> DataFrame:
    """Hits of each form with their place: by score, by semantic_score, both descending, or at random but repeatably; then by synonym."""
    if by not in ("score", "semantic_score", "random"):
        raise ValueError("by must be score, semantic_score or random")
    first = F.xxhash64(F.lit(seed), "form", "synonym") if by == "random" else F.desc_nulls_last(by)
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("form").orderBy(first, "synonym")))


#: Ways to map mentions, by the name that a configuration gives.
CORES = {"default": map_mentions}


def mapping_core(name: str = "default"):
    """A way to map mentions by its name; add to CORES to configure others."""
    if name not in CORES:
        raise ValueError(f"no mapping core is called {name}")
    return CORES[name]


# Look-ups


def id_to_tax(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tax) from the official name of each id; null where it has none."""
    own = entries.where(F.col("priority") == -1).groupBy("id").agg(F.min("tax").alias("tax"))
    return ids.select("id").distinct().join(own, "id", "left")


def synonyms_of(entries: DataFrame, ids: DataFrame, most: int = 200) -> DataFrame:
    """(id, synonym): at most ``most`` names of each id, the first in their order."""
    rows = entries.join(ids.select("id").distinct(), "id", "left_semi").select("id", "synonym").distinct()
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("synonym"))).where(F.col("_r") <= most).select("id", "synonym")


def priority_names(entries: DataFrame, ids: DataFrame, priority: int = -1) -> DataFrame:
    """(id, name): the first name of each id with a priority; ids without one are left out."""
    return entries.where(F.col("priority") == priority).join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("synonym").alias("name"))


def index_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, synonym, priority, tax): all that the index has of ids."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi").select("id", "synonym", "priority", "tax")


def ambiguity(entries: DataFrame, tax: str) -> DataFrame:
    """(synonym, ambiguous, within, between_taxa, has_tax, ids, last_id, only_id, n_priorities) of all names in different entries (synonym, id, priority, tax).

    As the rules for arrays of entries say, but by aggregates, as a name may
    stand for very many ids: only those of the taxon asked for come into one row.
    """
    own = F.coalesce(F.col("tax") == tax, F.lit(False))
    ids = entries.groupBy("synonym", "id").agg(F.count("*").alias("_n"), F.bool_or(own).alias("_own"))
    mine = F.when(F.col("_own"), F.col("id"))
    n_own = F.count_if("_own")
    of_ids = ids.groupBy("synonym").agg(
        (F.count("*") > 1).alias("ambiguous"), (n_own > 0).alias("has_tax"), F.sort_array(F.collect_list(mine)).alias("ids"), F.max(mine).alias("last_id"), F.when(n_own == 1, F.max(mine)).alias("only_id"),
        F.coalesce(F.sum(F.when(mine.isNotNull(), F.col("_n"))), F.lit(0)).alias("n_priorities"),
    )
    # least and greatest tell whether ids differ; a null is one more
    some = (F.min("id") != F.max("id")) | (F.count("id").between(1, F.count("*") - 1))
    taxa = entries.groupBy("synonym", "tax").agg((F.coalesce(some, F.lit(False)) & F.col("tax").isNotNull()).alias("_some"))
    of_taxa = taxa.groupBy("synonym").agg(F.bool_or("_some").alias("within"), (F.count("*") > 1).alias("between_taxa"))
    return of_ids.join(of_taxa, "synonym").select("synonym", "ambiguous", "within", "between_taxa", "has_tax", "ids", "last_id", "only_id", "n_priorities")


def highest_tax(candidates_: DataFrame, key: str, default: str) -> DataFrame:
    """(key, tax): the taxon of greatest score (key, tax, score) of each key, else the default; equal scores: the first."""
    return candidates_.groupBy(key).agg(F.min_by("tax", F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), "tax")).alias("tax")).withColumn("tax", F.coalesce("tax", F.lit(default)))
