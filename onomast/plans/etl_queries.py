"""Queries of the dictionary operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from onomast.functions import words
from onomast.operators import etl, index
from onomast.plans.views import DICT, dictionary, table

LISTED = ["red bolt", "Blue Gear", "hot rod"]


def etl_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("status", (F.col("p_size") % 3 - 1).cast("string"))
    organisms = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), "s_suppkey").alias("tax"))
    accepted = etl.with_status(part, "status").select("p_partkey")
    forced = part.where("p_retailprice < 905").select("p_partkey")
    good = etl.eligible(part, organisms, accepted, forced, key="p_partkey", tax="p_brand", symbol="p_type", description="p_name", uncertain="^small.*g$", hypothetical="red widget", placeholder="PROMO")
    wanted = table(spark, sf_dir, "lineitem").select("l_partkey")
    return etl.restrict(good, wanted, "p_partkey").select("p_partkey", "p_name", "p_brand")


SQL_FILTER = """
SELECT p_partkey, p_name, p_brand FROM part
WHERE (p_retailprice < 905 OR (NOT regexp_matches(p_name, '^small.*g$') AND p_name <> 'red widget' AND p_type <> 'PROMO'
  AND p_brand IN (SELECT 'Brand#' || CAST(s_suppkey AS VARCHAR) FROM supplier) AND NOT (p_size % 3 - 1 > 0)))
  AND p_partkey IN (SELECT l_partkey FROM lineitem)
"""


def etl_pattern_clean(spark, sf_dir):
    names = etl.drop_dashes(dictionary(spark, sf_dir).withColumn("name", F.when(F.col("priority") == 4, "-").when(F.col("priority") == 5, F.concat(F.lit("Probable "), "name")).when(F.col("priority") == 6, F.concat("name", F.lit(" 12.5 kDa"))).otherwise(F.col("name"))), "name")
    return etl.clean_patterns(names, LISTED).select("name", "id", "priority")


SQL_PATTERN_CLEAN = f"""
WITH {DICT}, n AS (SELECT CASE priority WHEN 4 THEN '-' WHEN 5 THEN 'Probable ' || name WHEN 6 THEN name || ' 12.5 kDa' ELSE name END AS name, id, priority FROM dict)
SELECT name, id, priority FROM n WHERE name <> '-' AND (priority = -1 OR NOT (lower(name) IN ('red bolt', 'blue gear', 'hot rod')
  OR regexp_matches(name, '[Pp]robable|[Pp]redicted|[Pp]utative|[Hh]ypothetical|[Uu]nknown|[Nn]ovel|[Uu]ncharacterized') OR regexp_matches(name, '^[[:punct:]0-9\\s]*$')
  OR regexp_matches(name, '(?i)rik') OR regexp_matches(name, '^[A-Za-z]$') OR regexp_matches(name, '[0-9]+\\.?[0-9]*\\s?kDa')))
"""
_GREEK = ", ".join(f"'{g}'" for g in words.GREEK)


def etl_all_tokens_generic(spark, sf_dir):
    return etl.drop_generic(dictionary(spark, sf_dir), listed=["red", "blue", "gear", "ring", "bolt"]).select("name", "id", "priority")


SQL_GENERIC = f"""
WITH {DICT} SELECT name, id, priority FROM dict
WHERE priority = -1 OR len(list_filter(string_split(name, ' '), lambda t: NOT (t IN ('red', 'blue', 'gear', 'ring', 'bolt') OR regexp_full_match(t, '[0-9]+') OR t IN ({_GREEK})))) > 0
"""


def etl_family_filter(spark, sf_dir):
    names = dictionary(spark, sf_dir).withColumn("name", F.when(F.col("priority") == 3, F.concat("name", F.lit(" family"))).otherwise(F.col("name")))
    return etl.drop_families(names, listed=["old gizmo", "cold plat", "hot rod"]).select("name", "id", "priority")


SQL_FAMILY = f"""
WITH {DICT}, n AS (SELECT CASE priority WHEN 3 THEN name || ' family' ELSE name END AS name, id, priority FROM dict)
SELECT name, id, priority FROM n
WHERE priority = -1 OR NOT (len(string_split(name, ' ')) > 8 OR (len(string_split(name, ' ')) < 2 AND length(name) < 2) OR regexp_full_match(name, '.*{words._any(words._FAMILY)}e?s?')
  OR regexp_full_match(name, '(old gizmo|cold plat|hot rod)e?s?'))
"""


def etl_unpivot(spark, sf_dir):
    return etl.unpivoted(table(spark, sf_dir, "part"), "p_partkey", {"p_name": -1, "p_brand": 2, "p_type": 3})


SQL_UNPIVOT = """
SELECT p_name AS name, p_partkey AS id, CAST(-1 AS INTEGER) AS priority FROM part WHERE p_name NOT IN ('-', '')
UNION ALL SELECT p_brand, p_partkey, CAST(2 AS INTEGER) FROM part WHERE p_brand NOT IN ('-', '')
UNION ALL SELECT p_type, p_partkey, CAST(3 AS INTEGER) FROM part WHERE p_type NOT IN ('-', '')
"""


def etl_explode_list(spark, sf_dir):
    lists = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[ \n]", ";").alias("words"))
    return etl.exploded(lists, "words", ";").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.countDistinct("words").alias("n_different"), F.max("words").alias("last_word"))


SQL_EXPLODE = """
SELECT doc_id, count(*) AS n_words, count(DISTINCT w) AS n_different, max(w) AS last_word
FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '[ \\n]', ';', 'g'), ';'))) AS w FROM documents) WHERE w <> '' GROUP BY doc_id
"""


def etl_pair_explode(spark, sf_dir):
    lists = table(spark, sf_dir, "part").select(F.concat_ws(";", "p_partkey", F.col("p_partkey") + 1).alias("ids"), F.regexp_replace("p_name", " ", " ; ").alias("names"))
    return etl.paired(lists, "ids", "names").select(F.col("ids").cast("bigint").alias("id"), F.col("names").alias("name"))


SQL_PAIR_EXPLODE = "SELECT i AS id, n AS name FROM (SELECT unnest([p_partkey, p_partkey + 1]) AS i, p_name FROM part), unnest(string_split(p_name, ' ')) AS u(n)"


def etl_semi_join(spark, sf_dir):
    buyers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return etl.restrict(table(spark, sf_dir, "orders"), buyers, "o_custkey").select("o_orderkey", "o_custkey")


def etl_anti_join(spark, sf_dir):
    return etl.exclude(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"), "c_custkey").select("c_custkey", "c_name")


def etl_set_difference(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return etl.missing_from(nations, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


def _mapping(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


def etl_id_replace(spark, sf_dir):
    return etl.replace_ids(dictionary(spark, sf_dir).select("name", "id", "priority"), _mapping(spark, sf_dir), "id", "l_partkey", "l_suppkey")


SQL_ID_REPLACE = f"WITH {DICT} SELECT name, l_suppkey AS id, priority FROM dict JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON id = l_partkey"


def etl_left_enrich(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return etl.looked_up(etl.enriched(suppliers, nations, "n_nationkey", ["n_name", "n_regionkey"]), table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "r_name").select("s_suppkey", "n_name", "r_name")


SQL_LEFT_ENRICH = """
SELECT s_suppkey, n_name, coalesce(r_name, '') AS r_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
"""


def etl_union_distinct(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.substring("c_name", -6, 6).alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.substring("s_name", -6, 6).alias("name"))
    return etl.ordered(etl.united_set(customers, suppliers), "name")


SQL_UNION_DISTINCT = "SELECT right(c_name, 6) AS name FROM customer UNION SELECT right(s_name, 6) FROM supplier"


def etl_dedupe_priority(spark, sf_dir):
    names = dictionary(spark, sf_dir).select("name", F.col("tax").alias("id"), "priority")
    return etl.best_priority(names)


SQL_DEDUPE = f"WITH {DICT} SELECT name, tax AS id, min(priority) AS priority FROM dict GROUP BY name, tax"


def etl_ec_names(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(";", F.concat(F.col("p_size").cast("string"), F.lit(".1.2.3")), F.lit(""), F.lit(" 1.1.1.1 ")).alias("ec"))
    return etl.ec_names(codes, "ec")


SQL_EC = "SELECT p_partkey, 'EC ' || CAST(p_size AS VARCHAR) || '.1.2.3' AS ec FROM part UNION ALL SELECT p_partkey, 'EC 1.1.1.1' FROM part"


def etl_interactions(spark, sf_dir):
    return etl.swapped(etl.drop_containing(table(spark, sf_dir, "documents"), "text", [" the ", " de la "], "Th"), "text", "doc_id").select("doc_id", F.length("text").alias("n"))


SQL_INTERACTIONS = "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE NOT (regexp_full_match(text, '\\s*-?\\s*') OR starts_with(text, 'Th') OR contains(text, ' the ') OR contains(text, ' de la '))"


def idx_synonyms(spark, sf_dir):
    rows = index.synonyms(dictionary(spark, sf_dir))
    return rows.select("synonym", "n_tokens", F.array_join(F.transform("entries", lambda e: F.concat_ws("__", e["id"].cast("string"), e["priority"].cast("string"), e["tax"])), " ").alias("entries"))


SQL_SYNONYMS = f"""
WITH {DICT} SELECT name AS synonym, CAST(len(string_split(name, ' ')) AS INTEGER) AS n_tokens,
  string_agg(CAST(id AS VARCHAR) || '__' || CAST(priority AS VARCHAR) || '__' || tax, ' ' ORDER BY id, priority, tax) AS entries FROM (SELECT DISTINCT * FROM dict) GROUP BY name
"""


def idx_postings(spark, sf_dir):
    names = dictionary(spark, sf_dir).select(F.concat_ws(" ", "name", F.lower("tax"), F.split("name", " ")[0]).alias("name"))
    return index.postings(names)


SQL_POSTINGS = f"""
WITH {DICT}, n AS (SELECT DISTINCT name || ' ' || lower(tax) || ' ' || string_split(name, ' ')[1] AS name FROM dict)
SELECT token, name AS synonym, CAST(len(list_filter(string_split(name, ' '), lambda t: t = token)) AS INTEGER) AS tf, CAST(len(string_split(name, ' ')) AS INTEGER) AS n_tokens
FROM (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS token FROM n)
"""


def idx_weights(spark, sf_dir):
    return index.token_weights(index.postings(dictionary(spark, sf_dir).select(F.concat_ws(" ", "name", F.lower("tax")).alias("name")))).select("token", "df", F.round("idf", 6).alias("idf"))


SQL_WEIGHTS = f"""
WITH {DICT}, n AS (SELECT DISTINCT name || ' ' || lower(tax) AS name FROM dict), t AS (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS token FROM n)
SELECT token, count(*) AS df, round(1 + ln(((SELECT count(*) FROM n) + 1) / (count(*) + 1)), 6) AS idf FROM t GROUP BY token
"""


def idx_group_concat(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = etl.concatenated(docs.select(F.col("source").alias("id"), "doc_id", F.md5("text").alias("text")), "id", "text", "doc_id")
    ids = docs.select(F.col("source").alias("id"))
    return index.concatenated_context(ids, first, docs.where("lang = 'fr'").groupBy(F.col("source").alias("id")).agg(F.max("lang").alias("text")))


SQL_GROUP_CONCAT = """
SELECT source AS id, trim(string_agg(md5(text), ' ' ORDER BY doc_id DESC) || CASE WHEN bool_or(lang = 'fr') THEN ' fr' ELSE '' END) AS context FROM documents GROUP BY source
"""


def idx_spelling(spark, sf_dir):
    postings = index.postings(dictionary(spark, sf_dir))
    wrong = postings.select(F.concat(F.col("token"), F.lit("s")).alias("token"))
    return index.corrected(wrong, postings)


SQL_SPELLING = f"""
WITH {DICT}, p AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS token FROM dict), w AS (SELECT token || 's' AS wrong FROM p WHERE regexp_full_match(token || 's', '..+s') AND token || 's' NOT IN (SELECT token FROM p)),
pg AS (SELECT DISTINCT token, substring(token, i, 3) AS gram FROM p, range(1, 40) r(i) WHERE i <= greatest(length(token) - 2, 1)),
wg AS (SELECT DISTINCT wrong, substring(wrong, i, 3) AS gram FROM w, range(1, 40) r(i) WHERE i <= greatest(length(wrong) - 2, 1)),
m AS (SELECT wrong, token, count(*) AS n FROM wg JOIN pg USING (gram) GROUP BY wrong, token)
SELECT wrong AS token, token AS correction FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY n DESC, levenshtein(wrong, token), token) AS r FROM m) WHERE r = 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        etl_filter, etl_pattern_clean, etl_all_tokens_generic, etl_family_filter, etl_unpivot, etl_explode_list, etl_pair_explode, etl_semi_join, etl_anti_join, etl_set_difference, etl_id_replace, etl_left_enrich,
        etl_union_distinct, etl_dedupe_priority, etl_ec_names, etl_interactions, idx_synonyms, idx_postings, idx_weights, idx_group_concat, idx_spelling,
    )
}

SQL = {
    "etl_filter": SQL_FILTER, "etl_pattern_clean": SQL_PATTERN_CLEAN, "etl_all_tokens_generic": SQL_GENERIC, "etl_family_filter": SQL_FAMILY, "etl_unpivot": SQL_UNPIVOT, "etl_explode_list": SQL_EXPLODE,
    "etl_pair_explode": SQL_PAIR_EXPLODE, "etl_id_replace": SQL_ID_REPLACE, "etl_left_enrich": SQL_LEFT_ENRICH, "etl_union_distinct": SQL_UNION_DISTINCT, "etl_dedupe_priority": SQL_DEDUPE, "etl_ec_names": SQL_EC,
    "etl_interactions": SQL_INTERACTIONS, "idx_synonyms": SQL_SYNONYMS, "idx_postings": SQL_POSTINGS, "idx_weights": SQL_WEIGHTS, "idx_group_concat": SQL_GROUP_CONCAT, "idx_spelling": SQL_SPELLING,
    "etl_semi_join": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "etl_anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "etl_set_difference": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
}
