"""Queries of span operators and of learning over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from onomast.operators import learn, spans
from onomast.plans.views import PAIR, dictionary, name_pairs, table


def _events(spark, sf_dir, grain: int = 1):
    """Events as spans of a user's time, in seconds; ``grain`` makes more of them begin and end together."""
    begin = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / grain) * grain).cast("bigint")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), begin.alias("begin"), F.col("event_type").alias("tagger"), "event_id", "value")
    return rows.withColumn("end", (F.col("begin") + (F.floor(F.col("value") * 100 / grain) * grain)).cast("bigint")).withColumn("tax", F.when(F.col("value") > 10, "high").otherwise("low"))


def _ev(grain: int = 1) -> str:
    b = f"CAST(floor(floor(epoch(ts)) / {grain}) * {grain} AS BIGINT)"
    return f"ev AS (SELECT user_id AS doc_id, {b} AS b, {b} + CAST(floor(value * 100 / {grain}) * {grain} AS BIGINT) AS e, event_type AS tagger, event_id, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS tax FROM events)"


def span_overlap(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return spans.overlapping(ev.where("tagger = 'click'").select("doc_id", "begin", "end", "event_id"), ev.where("tagger = 'error'").select("doc_id", "begin", "end", "event_id"), 4096).select("event_id", "r_event_id")


def span_contains(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return spans.containing(ev.where("tagger = 'click'").select("doc_id", "begin", "end", "event_id"), ev.where("tagger <> 'click'").select("doc_id", "begin", "end", "event_id"), 4096).select("event_id", "r_event_id")


def span_enclosing(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return spans.enclosing(ev.where("tagger = 'view'").select("doc_id", "begin", "end", "event_id"), ev.where("tagger = 'click'"), 4096).select("event_id", "sentence_begin", "sentence_end")


def span_nearest_prev_next(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return spans.nearest(ev.where("tagger <> 'error'").select("doc_id", "tax", "begin", "event_id"), ev.where("tagger = 'error'")).select("event_id", "previous", "next")


def span_in_title(spark, sf_dir):
    ev = _events(spark, sf_dir)
    titles = ev.groupBy("doc_id").agg(F.min("begin").alias("title_begin"), (F.min("begin") + 100_000).alias("title_end"))
    return spans.in_title(ev, titles).select("event_id")


def mesh_split_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    headings = part.select(F.col("p_partkey").alias("doc_id"), F.regexp_replace("p_name", " ", ", ").alias("heading"))
    return spans.heading_taxa(headings, part.where("p_size < 5").select(F.split("p_name", " ")[0].alias("descriptor"), F.col("p_brand").alias("tax")).distinct())


SQL_MESH = "WITH d AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS part, p_brand AS tax FROM part WHERE p_size < 5) SELECT DISTINCT doc_id, part, tax FROM (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS part FROM part) JOIN d USING (part)"


def span_equal_offsets(spark, sf_dir):
    ev = _events(spark, sf_dir, 3600)
    return spans.one_per_place(ev, ["error", "view", "click"], "event_id").select("doc_id", "begin", "end", "event_id", "tagger")


SQL_EQUAL = f"WITH {_ev(3600)} SELECT doc_id, b AS \"begin\", e AS \"end\", event_id, tagger FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, b, e ORDER BY coalesce(list_position(['error', 'view', 'click'], tagger), 4), event_id) AS r FROM ev) WHERE r = 1"


def span_longest_first(spark, sf_dir):
    return spans.longest_first(_events(spark, sf_dir).select("doc_id", "begin", "end", "event_id"), "event_id")


def span_without_overlaps(spark, sf_dir):
    return spans.without_tagger_overlaps(_events(spark, sf_dir).select("doc_id", "begin", "end", "tagger", "event_id"), "error").select("event_id")


def span_selected(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("text", F.col("event_id").cast("string")).withColumn("specific_type", F.when(F.col("tax") == "high", F.concat("tagger", F.lit("/x"))))
    return spans.selected(ev, ["click", "view"], "[0-9]*[02468]", "click.*|view/.").select("event_id")


def span_plural_and_prefix(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("begin"), F.concat(F.col("p_name"), F.when(F.col("p_size") > 25, "").otherwise("s")).alias("text"))
    cut = spans.without_species_prefix(part, "red|old|new ring")
    return cut.select("p_partkey", "begin", "text", spans.plural_tag(F.lit("NN"), F.upper(F.substring("text", 1, 3))).alias("plain_tag"), spans.plural_tag(F.lit("NN"), F.concat(F.upper(F.substring("text", 1, 3)), F.lit("s"))).alias("plural_tag"))


SQL_PLURAL = """
WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN '' ELSE 's' END AS text FROM part), p AS (SELECT p_partkey, text, length(regexp_extract(text, '^(?:red|old|new ring)[ -]?')) AS n FROM t),
c AS (SELECT p_partkey, CAST(CASE WHEN n < length(text) THEN n ELSE 0 END AS INTEGER) AS "begin", substring(text, CASE WHEN n < length(text) THEN n ELSE 0 END + 1) AS text FROM p)
SELECT p_partkey, "begin", text, 'NN' AS plain_tag, CASE WHEN regexp_full_match(upper(substring(text, 1, 3)) || 's', '[A-Z]+s') THEN 'NNS' ELSE 'NN' END AS plural_tag FROM c
"""


def span_evidence(spark, sf_dir):
    """Words of conversations by position: those in capitals are mentions, listed ones species, sentences end at a full stop."""
    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(F.split("text", r"\s+")).alias("i", "w"))
    at = words.select("doc_id", F.col("i").alias("begin"), F.col("i").alias("end"), F.col("w").alias("text"))
    species = at.where(F.col("text").isin("the", "le", "la", "und", "el", "en")).withColumn("tax", F.col("text")).select("doc_id", "begin", "end", "tax")
    closed = F.sum(F.coalesce(F.lag(F.col("text").endswith(".").cast("int")).over(Window.partitionBy("doc_id").orderBy("begin")), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0))
    sentences = at.withColumn("s", closed).groupBy("doc_id", "s").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("doc_id", "begin", "end")
    chunks = at.withColumn("c", F.floor(F.col("begin") / 3)).groupBy("doc_id", "c").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("doc_id", "begin", "end")
    titles = sentences.groupBy("doc_id").agg(F.min("begin").alias("title_begin"), F.min("end").alias("title_end"))
    headings = titles.select("doc_id", F.lit("und").alias("tax")).where("doc_id < 0")
    return spans.evidence(at.where(F.col("text").rlike("^[A-Z]")), species, sentences, chunks, titles, headings, {"h": "human"}, "none")


def coref_by_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("begin"), F.col("role").alias("text"), (F.length("text") > 200).alias("plural"))
    return spans.same_name(rows)


def coref_components(spark, sf_dir):
    before = F.lag("p_partkey").over(Window.partitionBy("p_size", "p_brand").orderBy("p_partkey"))
    edges = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("a"), before.alias("b"))
    return spans.components(edges)


SQL_COMPONENTS = "SELECT p_size AS doc_id, p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_size, p_brand) AS component FROM part QUALIFY count(*) OVER (PARTITION BY p_size, p_brand) > 1"


def ml_confusion(spark, sf_dir):
    return learn.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


def ml_accuracy(spark, sf_dir):
    return learn.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("accuracy", 9).alias("accuracy"))


def ml_features(spark, sf_dir):
    pairs = name_pairs(spark, sf_dir).withColumnsRenamed({"a": "term1", "b": "term2"})
    return learn.with_features(pairs).select("term1", "term2", F.array_join(F.sort_array("features"), " | ").alias("features"))


SQL_FEATURES = f"""
WITH {PAIR} SELECT a AS term1, b AS term2, 'DIFF_ALPHA=2 | LENGTHDIFF=0 | NUM_OF_DIFFS=2 | NUM_OF_SAMES=1 | ONLY_DIFF_ALPHA | ONLY_SAME_ALPHA | RELLENGTHDIFF=0 | SAME_ALPHA=1 | SIMPLE=2 | ' || CASE WHEN contains(a, b) OR contains(b, a) THEN 'SUBSTRING | ' ELSE '' END || 'TRANSPOSITIONS=0' AS features FROM pair
"""


def ml_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_size") % 7).alias("id")).where("p_type = 'PROMO'")
    return learn.positive_pairs(names).unionByName(learn.negative_pairs(names))


SQL_PAIRS = """
WITH n AS (SELECT DISTINCT p_name AS name, p_size % 7 AS id FROM part WHERE p_type = 'PROMO'), t AS (SELECT name, id, string_split(name, ' ') AS w FROM n),
same AS (SELECT DISTINCT a.name AS term1, b.name AS term2 FROM n a JOIN n b USING (id)),
far AS (SELECT DISTINCT a.name AS term1, b.name AS term2 FROM t a JOIN t b ON a.name <> b.name AND list_has_any(a.w, b.w)), f AS (SELECT *, row_number() OVER (PARTITION BY term1 ORDER BY term2) AS r FROM far ANTI JOIN same USING (term1, term2))
SELECT DISTINCT a.name AS term1, b.name AS term2, 'TRUE' AS label FROM t a JOIN t b ON a.id = b.id AND a.name < b.name AND list_has_any(a.w, b.w) UNION ALL SELECT term1, term2, 'FALSE' FROM f WHERE r <= 10
"""


def ml_scores(spark, sf_dir):
    pairs = ml_pairs(spark, sf_dir)
    return learn.scored(learn.train(pairs), pairs)


QUERIES = {
    f.__name__: f
    for f in (
        span_overlap, span_contains, span_enclosing, span_nearest_prev_next, span_in_title, mesh_split_lookup, span_equal_offsets, span_longest_first, span_without_overlaps, span_selected, span_plural_and_prefix, span_evidence,
        coref_by_text, coref_components, ml_confusion, ml_accuracy, ml_features, ml_pairs, ml_scores,
    )
}

SQL = {
    "span_overlap": f"WITH {_ev()} SELECT a.event_id, b.event_id AS r_event_id FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.tagger = 'click' AND b.tagger = 'error' AND a.b <= b.e AND b.b <= a.e",
    "span_contains": f"WITH {_ev()} SELECT a.event_id, b.event_id AS r_event_id FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.tagger = 'click' AND b.tagger <> 'click' AND a.b >= b.b AND a.e <= b.e",
    "span_enclosing": f"WITH {_ev()}, x AS (SELECT a.event_id, (SELECT min((b.b, b.e)) FROM ev b WHERE a.doc_id = b.doc_id AND b.tagger = 'click' AND a.b <= b.e AND b.b <= a.e) AS s FROM ev a WHERE tagger = 'view') SELECT event_id, s[1] AS sentence_begin, s[2] AS sentence_end FROM x",
    "span_nearest_prev_next": f"WITH {_ev()}, m AS (SELECT * FROM ev WHERE tagger = 'error') SELECT event_id, (SELECT max(m.b) FROM m WHERE m.doc_id = a.doc_id AND m.tax = a.tax AND m.b < a.b) AS previous, (SELECT min(m.b) FROM m WHERE m.doc_id = a.doc_id AND m.tax = a.tax AND m.b > a.b) AS next FROM ev a WHERE tagger <> 'error'",
    "span_in_title": f"WITH {_ev()} SELECT event_id FROM ev JOIN (SELECT doc_id, min(b) AS tb FROM ev GROUP BY doc_id) USING (doc_id) WHERE b >= tb AND e <= tb + 100000", "mesh_split_lookup": SQL_MESH, "span_equal_offsets": SQL_EQUAL,
    "span_without_overlaps": f"WITH {_ev()} SELECT event_id FROM ev a WHERE tagger = 'error' OR NOT EXISTS (SELECT 1 FROM ev b WHERE b.tagger = 'error' AND a.doc_id = b.doc_id AND a.b <= b.e AND b.b <= a.e)",
    "span_selected": f"WITH {_ev()} SELECT event_id FROM ev WHERE tagger IN ('click', 'view') AND event_id % 2 = 0 AND tax = 'high'", "span_plural_and_prefix": SQL_PLURAL,
    "coref_by_text": "SELECT conv_id AS doc_id, turn AS \"begin\", role AS text, length(text) > 200 AS plural, min(turn) OVER (PARTITION BY conv_id, role, length(text) > 200) AS set_id FROM conversations", "coref_components": SQL_COMPONENTS,
    "ml_confusion": "SELECT CAST(quality AS VARCHAR) AS actual, CAST(toxic AS VARCHAR) AS predicted, count(*) AS n FROM labels GROUP BY ALL", "ml_accuracy": "SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM labels",
    "ml_features": SQL_FEATURES, "ml_pairs": SQL_PAIRS,
}
