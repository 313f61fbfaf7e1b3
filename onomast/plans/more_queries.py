"""Queries of the operators that the other modules don't show, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from onomast.functions import normalize as N
from onomast.functions import tokens as T
from onomast.functions.stem import stemmed
from onomast.operators import etl, index, learn, retrieval, spans
from onomast.plans import retrieval_queries as R
from onomast.plans.views import DICT, dictionary, table
from onomast.sources import readers


def etl_listed(spark, sf_dir):
    rows = etl.listed(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag")
    return rows.select("l_suppkey", F.array_join("l_returnflag", "").alias("flags"))


def etl_designations(spark, sf_dir):
    names = dictionary(spark, sf_dir).withColumn("name", F.when(F.col("priority") == 3, F.concat("name", F.lit(" family"))).otherwise(F.col("name")))
    return etl.with_priority(etl.clean_designations(names, "name", ["old gizmo", "hot rod"]), 7).select("name", "id", "priority")


SQL_DESIGNATIONS = f"WITH {DICT} SELECT name, id, CAST(7 AS INTEGER) AS priority FROM dict WHERE priority <> 3 AND name NOT IN ('old gizmo', 'hot rod')"


def etl_dictionary(spark, sf_dir):
    """The whole way from raw names to the cleaned dictionary; without SQL."""
    part = table(spark, sf_dir, "part")
    names = etl.unpivoted(part, "p_partkey", {"p_name": -1, "p_type": 3})
    return etl.dictionary([names, names.withColumn("name", F.concat(F.col("name"), F.lit(" alpha"))).withColumn("priority", F.lit(2))], ["promo", "small"])


def idx_id_centric(spark, sf_dir):
    """Names with their variants and stems for each id; without SQL, as they have been cut at Greek letters."""
    rows = index.id_centric(dictionary(spark, sf_dir).withColumn("name", F.concat("name", F.lit("s alpha"))))
    return rows.select("id", "original_name", "synonym", F.array_join("variants", "|").alias("variants"), "stemmed", "priority")


def idx_context_items(spark, sf_dir):
    items = R._items(spark, sf_dir)
    return index.context_items(("line", items), ("kind", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("item"))))


SQL_CONTEXT_ITEMS = f"WITH {R.ITEMS} SELECT DISTINCT id, 'line' AS field, item FROM items UNION ALL SELECT DISTINCT p_partkey, 'kind', lower(p_type) FROM part"


def idx_go_context(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.where("p_size < 30").groupBy(F.col("p_brand").alias("go")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("names"))
    return index.go_context(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("item")), terms)


SQL_GO = "SELECT p_partkey AS id, n AS text FROM part JOIN (SELECT p_brand, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS n FROM part WHERE p_size < 30 GROUP BY p_brand) USING (p_brand)"


def norm_short_forms(spark, sf_dir):
    last = F.element_at(F.array(*[F.lit(x) for x in ("2L", "xR", " receptors", "-il", " genes", "", " r")]), (F.col("p_size") % 7 + 1).cast("int"))
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", last).alias("name"))
    return names.select("p_partkey", N.short_forms(F.col("name")).alias("long"), N.drop_non_descriptive(F.concat("name", F.lit(" product x"))).alias("told"), N.is_ec_number(F.concat(F.lit("1.2.3."), "p_partkey")).alias("ec"), N.is_locus(F.concat("p_partkey", F.lit("q21"))).alias("locus"), T.covered(F.col("name"), F.lit(2), F.lit(5)).alias("covered"))


SQL_SHORT = """
WITH n AS (SELECT p_partkey, p_name, p_size % 7 AS k, p_name || ['2L', 'xR', ' receptors', '-il', ' genes', '', ' r'][p_size % 7 + 1] AS name FROM part)
SELECT p_partkey, p_name || ['2 ligand', 'x receptor', ' receptor', ' interleukin', ' gene', '', ' receptor'][k + 1] AS long, name || ' x' AS told, true AS ec, regexp_full_match(CAST(p_partkey AS VARCHAR), '[0-9]{1,2}') AS locus, substring(name, 3, 3) AS covered FROM n
"""


def text_context_types(spark, sf_dir):
    """Stems that a text hasn't as they are; without SQL, for the stemmer."""
    w = T.words_of(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("text"), T.without(w, R.STOP).alias("w"))
    return rows.select("conv_id", "turn", "text", stemmed("w").alias("s")).select("conv_id", "turn", F.array_join(T.new_types(F.col("s"), F.col("text")), " ").alias("types"))


def ret_ordered_hits(spark, sf_dir):
    hits = retrieval.top_hits(R._forms(spark, sf_dir), R._postings(spark, sf_dir)).withColumn("semantic_score", F.length("synonym").cast("double"))
    return retrieval.ordered_hits(hits, "semantic_score").select("form", "synonym", "place")


SQL_ORDERED = f"WITH {R.SCORED}, {R.top('scored')} SELECT form, synonym, CAST(row_number() OVER (PARTITION BY form ORDER BY length(synonym) DESC, synonym) AS INTEGER) AS place FROM top"


def ret_best_contexts(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.without(T.words_of(F.col("text")), R.STOP).alias("tokens"))
    docs = table(spark, sf_dir, "documents")
    documents = docs.select(F.col("doc_id").alias("id"), T.without(T.words_of(F.col("text")), R.STOP).alias("tokens"))
    hits = queries.select("query_id").join(docs.where("n_chars > 200").select(F.col("doc_id").alias("id"), F.col("lang").alias("synonym"), (F.col("doc_id") % 50).alias("m")), F.col("query_id") % 50 == F.col("m"))
    return retrieval.best_contexts(queries, hits, documents, 0.001, separate=True)


SQL_BEST_CONTEXTS = f"""
WITH d AS (SELECT doc_id AS id, list_filter({R._WORDS}, lambda t: t NOT IN ({R._STOP})) AS w FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter({R._WORDS}, lambda t: t NOT IN ({R._STOP}))) AS token FROM benchmark),
e AS (SELECT id, len(w) AS n, unnest(w) AS token FROM d), tf AS (SELECT id, n, token, count(*) AS tf FROM e GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
h AS (SELECT item_id AS query_id, doc_id AS id, lang AS synonym FROM benchmark JOIN documents ON item_id % 50 = doc_id % 50 AND n_chars > 200),
s AS (SELECT query_id, synonym, id, round(sum(sqrt(tf) * (1 + ln(((SELECT count(*) FROM d) + 1) / (df + 1))) ** 2 / sqrt(n)), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token) JOIN h USING (query_id, id) GROUP BY query_id, synonym, id)
SELECT query_id, synonym, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, synonym ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.001) WHERE r = 1
"""


def tag_species(spark, sf_dir):
    words = {"the": "1", "le": "2", "und": "3", "la": "4"}
    return readers.tagged(table(spark, sf_dir, "conversations"), ["role", "text"], words).select("conv_id", "turn", F.array_join(F.sort_array(F.split("tags", ";")), ";").alias("tags"))


SQL_TAG = """
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations), i AS (SELECT DISTINCT conv_id, turn, CASE w WHEN 'the' THEN '1' WHEN 'le' THEN '2' WHEN 'und' THEN '3' WHEN 'la' THEN '4' END AS i FROM w)
SELECT conv_id, turn, string_agg(i, ';' ORDER BY i) AS tags FROM i WHERE i IS NOT NULL GROUP BY conv_id, turn
"""


def coref_acronyms(spark, sf_dir):
    """Parts as mentions of a document of their size: every name's short form is linked to the part before it."""
    part = table(spark, sf_dir, "part")
    m = part.select(F.col("p_size").alias("doc_id"), (F.col("p_partkey") * 10).alias("begin"), (F.col("p_partkey") * 10 + 3).alias("end"), F.col("p_name").alias("text"), F.lit(False).alias("plural"))
    acronyms = part.where("p_type = 'PROMO'").select(F.col("p_size").alias("doc_id"), (F.col("p_partkey") * 10).alias("begin"), (F.col("p_partkey") * 10 + 3).alias("end"), F.col("p_name").alias("text"), F.lit(0).cast("bigint").alias("long_begin"), F.lit(3).cast("bigint").alias("long_end"))
    first = part.groupBy(F.col("p_size").alias("doc_id")).agg(F.lit(0).cast("bigint").alias("begin"), F.lit(3).cast("bigint").alias("end"), F.lit("long form").alias("text"), F.lit(False).alias("plural"))
    return spans.coreferent(m.where("begin > 0").unionByName(first), acronyms).select("doc_id", "begin", "set_id")


SQL_ACRONYMS = """
WITH m AS (SELECT p_size AS doc_id, p_partkey * 10 AS b, p_name, p_type FROM part WHERE p_partkey > 0), n AS (SELECT doc_id, p_name, min(b) AS first, bool_or(p_type = 'PROMO') AS linked FROM m GROUP BY ALL)
SELECT doc_id, b AS "begin", CASE WHEN linked THEN 0 ELSE first END AS set_id FROM m JOIN n USING (doc_id, p_name) UNION ALL SELECT DISTINCT p_size, 0, 0 FROM part
"""


def ml_cross_validation(spark, sf_dir):
    from onomast.plans.span_queries import ml_pairs

    return learn.cross_validated(ml_pairs(spark, sf_dir), 3).select("fold", "n")


QUERIES = {
    f.__name__: f
    for f in (etl_listed, etl_designations, etl_dictionary, idx_id_centric, idx_context_items, idx_go_context, norm_short_forms, text_context_types, ret_ordered_hits, ret_best_contexts, tag_species, coref_acronyms, ml_cross_validation)
}

SQL = {
    "etl_listed": "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey", "etl_designations": SQL_DESIGNATIONS, "idx_context_items": SQL_CONTEXT_ITEMS, "idx_go_context": SQL_GO,
    "norm_short_forms": SQL_SHORT, "ret_ordered_hits": SQL_ORDERED, "ret_best_contexts": SQL_BEST_CONTEXTS, "tag_species": SQL_TAG, "coref_acronyms": SQL_ACRONYMS,
}
