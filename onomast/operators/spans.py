"""Spans of a document (doc_id, begin, end): overlap, containment, neighbours, evidence, selection and coreference.

Ends are as the caller has them; both ends belong to a span, so spans that
touch overlap.  Overlap joins are equi-joins on the document and on stretches
of WIDTH positions that a span covers, so a long document with very many spans
doesn't compare all with all in one task.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.operators.tables import cut

#: Positions of a stretch.
WIDTH = 256


def _stretches(spans: DataFrame, name: str, width: int) -> DataFrame:
    return spans.withColumn(name, F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.greatest("begin", "end") / width))))


def overlapping(left: DataFrame, right: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """Every pair of a left and a right span of one document that have a position in common: all columns, the right's as ``r_`` + name.

    A pair is made in the stretch where the later of the two begins, so once.
    """
    other = _stretches(right, "_s", width).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("_s"))
    mine = _stretches(left, "_s", width)
    pairs = mine.join(other, (mine[key] == other[f"r_{key}"]) & (mine["_s"] == other["_s"]))
    meet = (F.col("begin") <= F.col("r_end")) & (F.col("r_begin") <= F.col("end")) & (F.floor(F.greatest("begin", "r_begin") / width) == mine["_s"])
    return pairs.where(meet).select(*left.columns, *[f"r_{c}" for c in right.columns])


def containing(inner: DataFrame, outer: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """Pairs in which the right span contains the left one."""
    return overlapping(inner, outer, width, key).where("begin >= r_begin AND end <= r_end")


def enclosing(spans: DataFrame, sentences: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """Each span with the first sentence that it overlaps (sentence_begin, sentence_end), or nulls."""
    found = overlapping(spans.select(key, "begin", "end").distinct(), sentences.select(key, "begin", "end"), width, key)
    one = found.groupBy(key, "begin", "end").agg(F.min(F.struct("r_begin", "r_end")).alias("_s"))
    return spans.join(one, [key, "begin", "end"], "left").select(*spans.columns, F.col("_s.r_begin").alias("sentence_begin"), F.col("_s.r_end").alias("sentence_end"))


def nearest(spans: DataFrame, marks: DataFrame, tax: str = "tax", key: str = "doc_id") -> DataFrame:
    """Each span (doc_id, begin, tax, ...) with the begin of the nearest mark of its taxon before it, and after it: by a window over both, in order of position.

    A mark at the same position is neither.
    """
    rows = spans.select(key, tax, "begin", F.struct(*spans.columns).alias("_row"), F.lit(None).cast("bigint").alias("_mark"))
    both = rows.unionByName(marks.select(key, tax, "begin", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("begin").cast("bigint").alias("_mark")))
    w = Window.partitionBy(key, tax).orderBy("begin")
    before, after = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(1, Window.unboundedFollowing)
    found = both.select("_row", F.max("_mark").over(before).alias("previous"), F.min("_mark").over(after).alias("next"))
    return found.where("_row IS NOT NULL").select("_row.*", "previous", "next")


def heading_taxa(headings: DataFrame, descriptors: DataFrame, heading: str = "heading") -> DataFrame:
    """(doc_id, part, tax): the taxa of each part of headings, which are cut at commas and blanks, by a table of (descriptor, tax).

    Both sides are made different before the join, whose rows then are so, as
    it makes many of each part.  Headings are sent by document first, or else
    a task would look for equal ones among all that it reads.
    """
    parts = headings.select("doc_id", heading).repartition("doc_id").select("doc_id", F.explode(F.array_distinct(F.split(F.col(heading), r",\s+"))).alias("part")).distinct()
    return parts.join(descriptors.select(F.col("descriptor").alias("part"), "tax").distinct(), "part").select("doc_id", "part", "tax")


def in_title(species: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Species mentions within the title (doc_id, title_begin, title_end)."""
    t = titles.select(F.col(key).alias("_k"), "title_begin", "title_end")
    return species.join(t, (F.col(key) == F.col("_k")) & (F.col("begin") >= F.col("title_begin")) & (F.col("end") <= F.col("title_end"))).select(*species.columns)


EVIDENCE = ["COMPOUND_PRECEED", "COMPOUND_SUCCEED", "PHRASE", "SENTENCE", "TITLE", "FIRST", "ANYWHERE", "MESH", "SPECIES_PREFIX", "DEFAULT"]


def evidence(mentions: DataFrame, species: DataFrame, sentences: DataFrame, chunks: DataFrame, titles: DataFrame, headings: DataFrame, prefixes: dict[str, str] | None = None, default: str | None = None) -> DataFrame:
    """(doc_id, begin, end, tax, evidence): what speaks for each taxon of each mention, sorted names of EVIDENCE.

    mentions (doc_id, begin, end, text); species (doc_id, begin, end, tax);
    sentences and noun chunks (doc_id, begin, end); titles (doc_id,
    title_begin, title_end); headings (doc_id, tax).

    COMPOUND_PRECEED: a species in the mention or before it in its chunk.
    COMPOUND_SUCCEED: one from the mention's begin to its chunk's end.
    PHRASE: one in the run of chunks up to the mention, chunk after chunk.
    SENTENCE: others before it in the sentence; any in the sentence where none
    is before.  TITLE, ANYWHERE: in the title, in the text.  FIRST: in the
    first sentence after the title.  MESH: of a heading.  SPECIES_PREFIX: the
    first letter stands for a species and an upper-case one follows.  DEFAULT:
    only where nothing else is.
    """
    k = ["doc_id", "begin", "end"]
    m = mentions.select(*k, "text").distinct()
    where = enclosing(m.select(*k), sentences)
    near = overlapping(where.select("doc_id", F.col("sentence_begin").alias("begin"), F.col("sentence_end").alias("end"), F.col("begin").alias("m_begin"), F.col("end").alias("m_end")).where("begin IS NOT NULL"), species)
    near = near.select("doc_id", F.col("m_begin").alias("begin"), F.col("m_end").alias("end"), F.col("r_begin").alias("s_begin"), F.col("r_end").alias("s_end"), F.col("r_tax").alias("tax"))
    own = overlapping(m.select(*k), chunks).groupBy(*k).agg(F.min(F.struct("r_begin", "r_end")).alias("c")).select(*k, F.col("c.r_begin").alias("c_begin"), F.col("c.r_end").alias("c_end"))
    # a run of chunks with nothing but a blank between them starts where one isn't next to another
    w = Window.partitionBy("doc_id").orderBy("begin", "end")
    runs = chunks.withColumn("_new", (F.col("begin") > F.coalesce(F.lag("end").over(w), F.lit(-10)) + 1).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("run_begin", F.min("begin").over(Window.partitionBy("doc_id", "_run"))).select("doc_id", F.col("begin").alias("c_begin"), F.col("end").alias("c_end"), "run_begin").distinct()
    near = near.join(own, k, "left").join(runs, ["doc_id", "c_begin", "c_end"], "left")
    before = F.col("s_begin") <= F.col("begin")
    some_before = F.max(before.cast("int")).over(Window.partitionBy(*k)) == 1
    inside = (F.col("s_begin") >= F.col("begin")) & (F.col("s_end") <= F.col("end"))
    preceed = inside | ((F.col("s_begin") >= F.col("c_begin")) & (F.col("s_end") <= F.col("end")))
    succeed = (F.col("s_begin") >= F.col("begin")) & (F.col("s_end") <= F.col("c_end"))
    phrase = some_before & (F.col("s_begin") >= F.col("run_begin")) & (F.col("s_end") <= F.col("end"))
    tagged = near.withColumn("e", F.when(preceed, "COMPOUND_PRECEED").when(phrase, "PHRASE").when(before | ~some_before, "SENTENCE"))
    local = tagged.where("e IS NOT NULL").select(*k, "tax", "e").unionByName(near.where(succeed).select(*k, "tax", F.lit("COMPOUND_SUCCEED").alias("e")))
    rank = F.create_map(*[F.lit(x) for i, e in enumerate(("COMPOUND_PRECEED", "COMPOUND_SUCCEED", "PHRASE", "SENTENCE")) for x in (e, i)])
    # PHRASE and SENTENCE only for a taxon that nothing nearer has named
    least = F.min(rank[F.col("e")]).over(Window.partitionBy(*k, "tax"))
    local = local.withColumn("_least", least).where((rank[F.col("e")] < 2) | (rank[F.col("e")] == F.col("_least"))).drop("_least").distinct()
    docs = m.select(*k)
    title = in_title(species, titles).select("doc_id", "tax", F.lit("TITLE").alias("e")).distinct()
    first = sentences.join(titles.select("doc_id", "title_end"), "doc_id").where("begin >= title_end").groupBy("doc_id").agg(F.min(F.struct("begin", "end")).alias("s")).select("doc_id", "s.begin", "s.end")
    first = containing(species, first).select("doc_id", "tax", F.lit("FIRST").alias("e")).distinct()
    anywhere = species.select("doc_id", "tax", F.lit("ANYWHERE").alias("e")).distinct()
    mesh = headings.select("doc_id", "tax", F.lit("MESH").alias("e")).distinct()
    wide = docs.join(title.unionByName(first).unionByName(anywhere).unionByName(mesh), "doc_id").select(*k, "tax", "e")
    found = local.unionByName(wide)
    if prefixes:
        tax = F.create_map(*[F.lit(x) for p in prefixes.items() for x in p])[F.substring("text", 1, 1)]
        found = found.unionByName(m.where((F.length("text") > 2) & F.col("text").rlike("^.[A-Z]") & tax.isNotNull()).select(*k, tax.alias("tax"), F.lit("SPECIES_PREFIX").alias("e")))
    if default is not None:
        found = found.unionByName(docs.join(found.select(*k).distinct(), k, "left_anti").select(*k, F.lit(default).alias("tax"), F.lit("DEFAULT").alias("e")))
    return found.groupBy(*k, "tax").agg(F.array_join(F.sort_array(F.collect_set("e")), " ").alias("evidence"))


# Selection


def selected(mentions: DataFrame, taggers: Sequence[str] | None = None, pattern: str | None = None, kind: str | None = None) -> DataFrame:
    """Mentions of the taggers given whose text, and whose specific type, match a pattern as a whole; a null type never matches."""
    out = mentions
    if taggers is not None:
        out = out.where(F.col("tagger").isin(list(taggers)))
    if pattern is not None:
        out = out.where(F.col("text").rlike(f"^(?:{pattern})$"))
    if kind is not None:
        out = out.where(F.coalesce(F.col("specific_type").rlike(f"^(?:{kind})$"), F.lit(False)))
    return out


def one_per_place(mentions: DataFrame, taggers: Sequence[str], tie: str = "text") -> DataFrame:
    """Of mentions with equal ends the one of the first tagger in the order given."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(taggers) for x in (t, i)])
    w = Window.partitionBy("doc_id", "begin", "end").orderBy(F.coalesce(order[F.col("tagger")], F.lit(len(taggers))), tie)
    return mentions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def longest_first(mentions: DataFrame, order: str) -> DataFrame:
    """Mentions left when they are taken one after the other and of overlapping ones the longer stays.

    In the order of ``order`` each is compared with the kept one that begins
    last at or before it, else with the first kept one after it; on overlap
    the strictly longer one stays.  So, as is known of this rule, overlaps may
    be left.  It depends on the order, hence runs document by document, in
    memory: some 100 bytes for each mention of the longest.
    """

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        spans: list[tuple[int, int]] = []  # kept, sorted
        index: dict[tuple[int, int], int] = {}
        for i, span in enumerate(zip(rows["begin"].tolist(), rows["end"].tolist())):
            if span in index:
                continue
            at = bisect.bisect_right(spans, (span[0], math.inf))
            other = spans[at - 1] if at else spans[0] if spans else None
            if other is not None and other[1] >= span[0] and other[0] <= span[1]:
                if span[1] - span[0] <= other[1] - other[0]:
                    continue
                del index[other]
                spans.remove(other)
            bisect.insort(spans, span)
            index[span] = i
        return rows.iloc[sorted(index.values())]

    return mentions.groupBy("doc_id").applyInPandas(greedy, mentions.schema)


def without_tagger_overlaps(mentions: DataFrame, tagger: str) -> DataFrame:
    """All mentions of a tagger, and those of others that overlap none of them.

    A span overlaps one of the tagger if of those that begin up to its end the
    last to end does so at its begin or after it: one window over each
    document, whatever the spans' lengths.
    """
    mine = F.coalesce(F.col("tagger") == tagger, F.lit(False))
    w = Window.partitionBy("doc_id").orderBy(F.when(mine, F.col("begin")).otherwise(F.col("end"))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(mine & F.col("begin").isNotNull() & F.col("doc_id").isNotNull(), F.col("end"))).over(w)
    return mentions.withColumn("_last", last).where(mine | ~F.coalesce(F.col("_last") >= F.col("begin"), F.lit(False))).drop("_last")


def with_candidates(mentions: DataFrame, found: DataFrame, mention: str = "mention") -> DataFrame:
    """Mentions for which there are candidates."""
    return mentions.join(found.select(mention).distinct(), mention, "left_semi")


def plural_tag(tag: Column, text: Column) -> Column:
    """NNS where a noun's tag is NN but its text is capitals with an s."""
    return F.when((tag == "NN") & text.rlike("^[A-Z]+s$"), "NNS").otherwise(tag)


def without_species_prefix(mentions: DataFrame, species: str) -> DataFrame:
    """Mentions without the species (a pattern) with which their text starts; ``begin`` moves along."""
    found = F.regexp_extract("text", f"^(?:{species})[ -]?", 0)
    size = F.when(F.length(found) < F.length("text"), F.length(found)).otherwise(0)
    return mentions.withColumn("_n", size).withColumn("begin", F.col("begin") + F.col("_n")).withColumn("text", F.expr("substring(text, _n + 1)")).drop("_n")


# Coreference


def same_name(mentions: DataFrame) -> DataFrame:
    """Mentions with set_id: those of a document with the same text, singular and plural apart; the least begin of each."""
    w = Window.partitionBy("doc_id", "text", "plural")
    return mentions.withColumn("set_id", F.min("begin").over(w))


def acronym_links(mentions: DataFrame, acronyms: DataFrame) -> DataFrame:
    """(doc_id, a, b): begins of mentions that an acronym (doc_id, begin, end, text, long_begin, long_end) links to its long form.

    The long form must cover a mention exactly; the acronym's mention ends
    with the acronym and has at most two characters more, the first of them in
    lower case; a plural is never linked to a singular.
    """
    short = overlapping(mentions.select("doc_id", "begin", "end", "text", "plural"), acronyms.select("doc_id", "begin", "end", "text", "long_begin", "long_end"))
    short = short.where(F.col("text").endswith(F.col("r_text")) & (F.length("text") <= F.length("r_text") + 2) & ((F.length("text") == F.length("r_text")) | F.col("text").rlike("^[a-z]")))
    long = mentions.select("doc_id", F.col("begin").alias("l_begin"), F.col("end").alias("l_end"), F.col("plural").alias("l_plural"))
    pairs = short.join(long, (short.doc_id == long.doc_id) & (short.r_long_begin == long.l_begin) & (short.r_long_end == long.l_end) & (short.plural == long.l_plural))
    return pairs.select(short.doc_id, F.col("begin").alias("a"), F.col("l_begin").alias("b")).distinct()


def components(edges: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(key, node, component) of all nodes of (key, a, b): the least node that is connected.

    Labels pass along edges and jump to their labels' labels, each round from
    a checkpoint, until none changes: some log2 of the longest path.  Labels are
    never broadcast, however small the optimizer takes them to be, as all of
    them would go through the driver in every round.
    """
    k = list(key)
    both = cut(edges.select(*k, "a", "b").where("a IS NOT NULL AND b IS NOT NULL").unionByName(edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")).distinct())
    labels = cut(both.groupBy(*k, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        of = labels.select(*k, F.col("node").alias("b"), F.col("component").alias("_c"))
        near = both.join(of.hint("merge"), [*k, "b"]).groupBy(*k, F.col("a").alias("node")).agg(F.min("_c").alias("_near"))
        jump = labels.select(*k, F.col("node").alias("component"), F.col("component").alias("_jump"))
        new = cut(labels.join(near.hint("merge"), [*k, "node"]).join(jump.hint("merge"), [*k, "component"], "left").select(*k, "node", "component", F.least("component", "_near", "_jump").alias("new")))
        labels = new.select(*k, "node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return labels


def coreferent(mentions: DataFrame, acronyms: DataFrame) -> DataFrame:
    """Mentions with set_id: connected by equal text or through acronyms."""
    named = same_name(mentions)
    links = acronym_links(mentions, acronyms).unionByName(named.select("doc_id", F.col("begin").alias("a"), F.col("set_id").alias("b")))
    sets = components(links)
    return mentions.join(sets.select("doc_id", F.col("node").alias("begin"), F.col("component").alias("set_id")), ["doc_id", "begin"], "left").select(*mentions.columns, "set_id")
