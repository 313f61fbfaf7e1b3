"""Queries of normalization, rules, similarity, retrieval and mapping over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from onomast.functions import normalize as N
from onomast.functions import rules, similarity, words
from onomast.functions import tokens as T
from onomast.operators import etl, index, retrieval
from onomast.plans.views import DICT, MENTION, PAIR, dictionary, mentions, name_pairs, table

TAXA = ["Brand#7", "Brand#3", "Brand#11"]
_TAXA = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TAXA)) + ") taxa(o, tax)"
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "le", "la", "de", "und", "der", "die", "el", "en"]
_STOP = ", ".join(f"'{s}'" for s in STOP)
#: Normal form of the mentions in SQL: their special characters, and the changes within their tokens.
_SPLIT = "c"
for _p in ("([A-Z][A-Z])([a-z])", "([a-z])([A-Z0-9])", "([A-Z])([0-9])", "([0-9])([a-zA-Z])"):
    _SPLIT = f"regexp_replace(regexp_replace({_SPLIT}, '{_p}', '\\1 \\2', 'g'), '{_p}', '\\1 \\2', 'g')"
_NORM = f"lower(trim(regexp_replace({_SPLIT.replace('(c,', '(' + chr(123) + 'c' + chr(125) + ',')}, ' +', ' ', 'g')))"


def norm(column: str) -> str:
    """SQL of :func:`normalize_basic` for names without dots, stop words and numerals."""
    return _NORM.replace("{c}", f"regexp_replace({column}, '[^A-Za-z0-9.]', ' ', 'g')")


FORMS = f"{MENTION}, form AS (SELECT mention, {norm('mention')} AS form FROM mention)"
POSTINGS = f"{DICT}, syn AS (SELECT DISTINCT name AS synonym FROM dict), post AS (SELECT synonym, unnest(string_split(synonym, ' ')) AS token, len(string_split(synonym, ' ')) AS n FROM syn)"
SCORED = f"""
{FORMS}, {POSTINGS}, idf AS (SELECT token, 1 + ln(((SELECT count(*) FROM syn) + 1) / (count(*) + 1)) AS idf FROM post GROUP BY token),
q AS (SELECT form, unnest(string_split(form, ' ')) AS token FROM (SELECT DISTINCT form FROM form)),
scored AS (SELECT form, synonym, round(sum(idf * idf / sqrt(n)), 6) AS score FROM q JOIN post USING (token) JOIN idf USING (token) GROUP BY form, synonym)"""


def top(source: str, n: int = 20) -> str:
    return f"""cut AS (SELECT form, synonym, CASE WHEN form = synonym THEN 9999.0::DOUBLE ELSE score END AS score FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, synonym) AS r FROM {source}) WHERE r <= {n}),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY form ORDER BY score DESC, synonym) AS INTEGER) AS rank FROM cut)"""


def _forms(spark, sf_dir):
    return mentions(spark, sf_dir).select("mention", N.normalize_basic(F.col("mention")).alias("form"))


def _postings(spark, sf_dir):
    return index.postings(dictionary(spark, sf_dir))


def norm_basic(spark, sf_dir):
    return _forms(spark, sf_dir)


def norm_greek(spark, sf_dir):
    greek = F.element_at(F.array(*[F.lit(x) for x in words.GREEK]), (F.col("p_size") % len(words.GREEK) + 1).cast("int"))
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_name", " ")[1], greek, F.lit(" II")).alias("name"))
    return names.select("p_partkey", "name", N.normalize(F.col("name")).alias("form"), N.expand_greek(F.substring("name", 1, 1)).alias("letter"))


def norm_variants(spark, sf_dir):
    names = dictionary(spark, sf_dir).select(F.concat(F.translate("name", " ", "-"), F.lit(" alpha")).alias("name"), "id", "priority")
    return etl.normalized(names, basic=True)


SQL_VARIANTS = f"""
WITH {DICT}, n AS (SELECT replace(name, ' ', '-') || ' alpha' AS name, id, priority FROM dict),
v AS (SELECT unnest([replace(name, '-', ' '), replace(name, '-', ''), replace(replace(name, '-', ' '), 'alpha', 'a'), replace(replace(name, '-', ' '), ' alpha', 'a')]) AS name, id, priority FROM n) SELECT DISTINCT * FROM v
"""


def norm_remove_modifiers(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("human gear protein", "old ring domain", "kinases", "blue rod gene", "mutant bolt", "receptors", "plain name")]), (F.col("p_size") % 7 + 1).cast("int"))
    names = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(kind).alias("name"))
    return names.select("p_partkey", N.remove_modifiers(F.col("name")).alias("left"), N.is_trailing_non_descriptive(F.col("name")).alias("trailing"))


SQL_REMOVE_MODIFIERS = f"""
WITH n AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_name ELSE ['human gear protein', 'old ring domain', 'kinases', 'blue rod gene', 'mutant bolt', 'receptors', 'plain name'][p_size % 7 + 1] END AS name FROM part),
u AS (SELECT *, CASE WHEN regexp_full_match(name, '({"|".join(words.UNSPECIFIED)})e?s?') THEN '' ELSE name END AS a FROM n),
f AS (SELECT *, CASE WHEN regexp_full_match(a, '.*{words._any(words._FAMILY)}e?s?') THEN '' ELSE a END AS b FROM u),
p AS (SELECT *, trim(regexp_replace(b, '^({"|".join(words.PREMODIFIERS)}) ', '')) AS c FROM f)
SELECT p_partkey, trim(CASE WHEN regexp_full_match(c, '.* {words.TRAILING_REGEX}') THEN regexp_replace(c, '{words.TRAILING_REGEX}$', '') ELSE c END) AS "left", regexp_full_match(name, '.* {words.TRAILING_REGEX}') AS trailing FROM p
"""


def text_ngrams(spark, sf_dir):
    w = T.words_of(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"))
    return rows.select("conv_id", "turn", F.size(T.ngrams(F.col("w"), 3)).cast("bigint").alias("trigrams"), F.array_max(T.ngrams(F.col("w"), 2, "_")).alias("last_bigram"), F.get(T.char_ngrams(F.get("w", F.lit(0)), 3), F.lit(0)).alias("first_chars"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
SQL_NGRAMS = f"""
WITH r AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations)
SELECT conv_id, turn, greatest(0, len(w) - 2)::BIGINT AS trigrams, list_max(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS last_bigram,
  CASE WHEN length(w[1]) >= 3 THEN substring(w[1], 1, 3) END AS first_chars FROM r
"""


def text_stopwords(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.without(T.words_of(F.col("text")), STOP).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


SQL_STOPWORDS = f"WITH r AS (SELECT doc_id, list_filter({_WORDS}, lambda t: t NOT IN ({_STOP})) AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n, md5(coalesce(array_to_string(w, ' '), '')) AS digest FROM r"


def text_stemmed(spark, sf_dir):
    """Without SQL, as DuckDB's stemmer is another release of the algorithm."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.without(T.words_of(F.col("text")), STOP).alias("w"))
    from onomast.functions.stem import stemmed

    return rows.select("doc_id", F.array_join(stemmed("w"), " ").alias("stems"))


def text_window(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", T.words_of(F.col("text")).alias("w"))
    middle = (F.size("w") / 2).cast("int") + 1
    return rows.where(F.size("w") > 0).select("conv_id", "turn", F.array_join(T.window_around(F.col("w"), middle, 10), " ").alias("around"), T.char_window(F.col("text"), F.length("text") / 2 - F.length("text") / 2 + 40, 10).alias("chars"))


SQL_WINDOW = f"""
WITH r AS (SELECT conv_id, turn, text, {_WORDS} AS w FROM conversations), m AS (SELECT *, len(w) // 2 + 1 AS p FROM r WHERE len(w) > 0)
SELECT conv_id, turn, array_to_string(list_slice(w, greatest(p - 5, 1), greatest(p - 5, 1) + 9), ' ') AS around, substring(text, 16, 50) AS chars FROM m
"""


def pair_overlap(spark, sf_dir):
    p = name_pairs(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    x, y = N.tokens(a), N.tokens(b)
    return p.select("a", "b", rules.overlaps(a, b).alias("shares"), rules.overlaps_enough(a, b).alias("enough"), rules.overlaps_with_meaning(a, b).alias("with_meaning"), T.overlap_ratio(x, y).alias("ratio"), F.array_join(T.common(x, y), " ").alias("common"), F.array_join(T.different(x, y), " ").alias("different"))


SQL_PAIR_OVERLAP = f"""
WITH {PAIR}, t AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pair),
c AS (SELECT *, list_sort(list_distinct(list_filter(x, lambda e: list_contains(y, e)))) AS shared, list_sort(list_distinct(list_filter(x, lambda e: NOT list_contains(y, e)))) AS own FROM t)
SELECT a, b, len(shared) >= 1 AS shares, len(shared) / greatest(len(x), len(y)) >= 0.5 AND len(x) <= 5 AND len(y) <= 5 AS enough,
  len(shared) / greatest(len(x), len(y)) >= 0.5 AND len(list_filter(shared, lambda e: NOT regexp_full_match(e, '[0-9]+|[a-z]'))) > 0 AND len(list_filter(own, lambda e: NOT regexp_full_match(e, '[0-9]+|[a-z]'))) > 0 AS with_meaning,
  len(shared) / greatest(len(x), len(y)) AS ratio, array_to_string(shared, ' ') AS common, array_to_string(own, ' ') AS different FROM c
"""


def _numbered(spark, sf_dir):
    """Pairs of forms: names with numbers, Greek letters and modifiers after them, that share a token."""
    last = F.element_at(F.array(*[F.lit(x) for x in ("", " 1", " 2", " alpha", " beta", " receptor", " 12 2")]), (F.col("p_size") % 7 + 1).cast("int"))
    names = table(spark, sf_dir, "part").select(F.concat("p_name", last).alias("name")).distinct()
    tokens = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("token"))
    left, right = (tokens.select("token", F.col("name").alias(c)) for c in "ab")
    return left.join(right, "token").select("a", "b").distinct()


_NUMBERED = f"""
names AS (SELECT DISTINCT p_name || ['', ' 1', ' 2', ' alpha', ' beta', ' receptor', ' 12 2'][p_size % 7 + 1] AS name FROM part), tok AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS token FROM names),
pair AS (SELECT DISTINCT x.name AS a, y.name AS b FROM tok x JOIN tok y USING (token))"""


def sql_filter_out(a: str = "a", b: str = "b") -> str:
    """SQL of the pair rules."""
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    common = f"list_filter({x}, lambda e: list_contains({y}, e))"
    every = lambda p: f"len(list_filter({common}, lambda e: NOT regexp_full_match(e, '{p}'))) = 0"
    one = lambda c, k: f"len(list_filter(string_split({c}, ' '), lambda e: regexp_full_match(e, '{k}'))) = 1"

    def differ(kind: str) -> str:
        g = lambda c, i: f"regexp_extract({c}, '^([a-z0-9 ]*?) ?{kind} ?([a-z0-9 ]*?)$', {i})"
        return f"({one(a, kind)} AND {one(b, kind)} AND {g(a, 2)} <> {g(b, 2)} AND {g(a, 1)} = {g(b, 1)} AND {g(a, 3)} = {g(b, 3)})"

    def more(kind: str) -> str:
        rest = f"list_filter(list_distinct({x}), lambda e: NOT list_contains({y}, e))"
        return f"({a} <> {b} AND len(list_distinct({x})) = len(list_distinct({y})) + 1 AND len({rest}) = 1 AND regexp_full_match({rest}[1], '{kind}'))"

    special = f"{words.GREEK_REGEX}|{words.MODIFIER_REGEX}|{words.NON_DESCRIPTIVE_REGEX}|"
    return f"({every('[0-9]*')} OR {every('[a-z0-9]')} OR {every(special)} OR {differ('([0-9]+)')} OR {differ(words.GREEK_REGEX)} OR {more(rules.OTHER_NUMBER)} OR {more(words.SUB_GREEK_REGEX)} OR {more(words.MODIFIER_REGEX)})"


def pair_filter_out(spark, sf_dir):
    return _numbered(spark, sf_dir).select("a", "b", rules.filter_out(F.col("a"), F.col("b")).alias("dropped"))


def pair_number_compat(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _numbered(spark, sf_dir).select("a", "b", rules.number_compatible(a, b).alias("compatible"), F.array_join(rules.single_symbols(a), " ").alias("symbols"), F.array_join(rules.content_tokens(a), " ").alias("content"), rules.common_tokens(a, b).alias("common"))


SQL_NUMBER_COMPAT = f"""
WITH {_NUMBERED}, t AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pair)
SELECT a, b, list_sort(list_filter(x, lambda e: regexp_full_match(e, '[0-9]+'))) = list_sort(list_filter(y, lambda e: regexp_full_match(e, '[0-9]+'))) AS compatible,
  coalesce(array_to_string(list_sort(list_filter(x, lambda e: regexp_full_match(e, '[a-zA-Z]|[0-9]+|{words.GREEK_REGEX}'))), ' '), '') AS symbols,
  coalesce(array_to_string(list_sort(list_filter(x, lambda e: NOT regexp_full_match(e, '[a-zA-Z]|[0-9]+|{words.GREEK_REGEX}'))), ' '), '') AS content,
  CAST(len(list_filter(list_distinct(x), lambda e: list_contains(y, e))) AS INTEGER) AS common FROM t
"""


def sim_simple(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf_dir).select("a", "b", F.round(similarity.simple(a, b), 6).alias("score"), similarity.simple(a, a).alias("self"), similarity.most_left(a, b).alias("most_left"))


SQL_SIMPLE = f"""
WITH {PAIR}, t AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM pair), c AS (SELECT *, len(list_filter(x, lambda e: list_contains(y, e))) AS n FROM t)
SELECT a, b, round(n / len(x) * (n / len(y)), 6) AS score, 9999.0::DOUBLE AS self, greatest(len(x) - n, len(y) - n)::DOUBLE AS most_left FROM c
"""


def sim_levenshtein(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf_dir).select("a", "b", F.round(similarity.levenshtein(a, b), 6).alias("score"))


def sim_token_jaro(spark, sf_dir):
    return _numbered(spark, sf_dir).select("a", "b", similarity.token_jaro_score(F.col("a"), F.col("b")).alias("score"))


def sim_transpositions(spark, sf_dir):
    return _numbered(spark, sf_dir).select("a", "b", similarity.token_transpositions(F.col("a"), F.col("b")).alias("moved"))


def sim_jaro_winkler(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("a", "b", similarity.jaro_winkler_score(F.col("a"), F.col("b")).alias("score"))


def ret_or_query(spark, sf_dir):
    return retrieval.or_query(_forms(spark, sf_dir), _postings(spark, sf_dir))


def ret_and_query(spark, sf_dir):
    forms = _forms(spark, sf_dir).select(F.regexp_replace("form", " [0-9]$", "").alias("form"))
    return retrieval.and_query(forms, _postings(spark, sf_dir))


SQL_OR = f"WITH {FORMS}, {POSTINGS}, q AS (SELECT DISTINCT form, unnest(string_split(form, ' ')) AS token FROM form) SELECT form, synonym, count(DISTINCT token) AS shared FROM q JOIN post USING (token) GROUP BY form, synonym"
SQL_AND = f"""
WITH {FORMS}, {POSTINGS}, f AS (SELECT DISTINCT regexp_replace(form, ' [0-9]$', '') AS form FROM form), q AS (SELECT DISTINCT form, unnest(string_split(form, ' ')) AS token FROM f)
SELECT form, synonym FROM q JOIN post USING (token) GROUP BY form, synonym HAVING count(DISTINCT token) = len(list_distinct(string_split(form, ' ')))
"""


def ret_tfidf_top20(spark, sf_dir):
    forms = _forms(spark, sf_dir)
    return retrieval.top_hits(forms, _postings(spark, sf_dir))


def _entries(spark, sf_dir):
    return index.entries(dictionary(spark, sf_dir))


def ret_tax_filtered(spark, sf_dir):
    return retrieval.top_hits(_forms(spark, sf_dir), _postings(spark, sf_dir), 5, _entries(spark, sf_dir), TAXA[:1])


SQL_TAX_FILTERED = f"WITH {SCORED}, own AS (SELECT * FROM scored WHERE synonym IN (SELECT name FROM dict WHERE tax = '{TAXA[0]}')), {top('own', 5)} SELECT form, synonym, score, rank FROM top"


def ret_best_of_fields(spark, sf_dir):
    postings = _postings(spark, sf_dir)
    forms = _forms(spark, sf_dir)
    return retrieval.best_of_fields(retrieval.scored(forms, postings), retrieval.scored(forms.select(F.regexp_replace("form", " [0-9]$", "").alias("form")), postings))


SQL_BEST_OF_FIELDS = f"""
WITH {SCORED}, s AS (SELECT DISTINCT regexp_replace(form, ' [0-9]$', '') AS form FROM form), q2 AS (SELECT form, unnest(string_split(form, ' ')) AS token FROM s),
two AS (SELECT form, synonym, round(sum(idf * idf / sqrt(n)), 6) AS score FROM q2 JOIN post USING (token) JOIN idf USING (token) GROUP BY form, synonym)
SELECT form, synonym, max(score) AS score FROM (SELECT * FROM scored UNION ALL SELECT * FROM two) GROUP BY form, synonym
"""


def ret_candidates(spark, sf_dir):
    found = retrieval.candidates(_forms(spark, sf_dir), _postings(spark, sf_dir), _entries(spark, sf_dir), TAXA[:2], 5)
    return found.select("form", "synonym", "score", F.size("entries").cast("bigint").alias("n_entries"), F.get("entries", F.lit(0))["id"].alias("first_id"))


SQL_CANDIDATES = f"""
WITH {SCORED}, own AS (SELECT s.*, t.tax FROM scored s JOIN (SELECT DISTINCT name, tax FROM dict WHERE tax IN ('{TAXA[0]}', '{TAXA[1]}')) t ON s.synonym = t.name),
cut AS (SELECT *, row_number() OVER (PARTITION BY form, tax ORDER BY score DESC, synonym) AS r FROM own), e AS (SELECT name, count(*) AS n_entries, min(id) AS first_id FROM (SELECT DISTINCT * FROM dict) GROUP BY name)
SELECT form, synonym, CASE WHEN form = synonym THEN 9999.0::DOUBLE ELSE score END AS score, n_entries, first_id FROM cut JOIN e ON e.name = synonym WHERE r <= 5
"""


def ret_best_synonyms(spark, sf_dir):
    hits = retrieval.top_hits(_forms(spark, sf_dir), _postings(spark, sf_dir))
    return retrieval.best_synonyms(hits, _entries(spark, sf_dir), TAXA)


BEST = f"""own AS (SELECT name, min(o) AS o FROM dict JOIN {_TAXA} USING (tax) GROUP BY name), best AS (SELECT t.form, t.synonym, t.score, x.tax FROM (SELECT *, max(score) OVER (PARTITION BY form) AS m FROM top) t
JOIN own ON own.name = t.synonym JOIN {_TAXA.replace(" taxa", " x")} ON x.o = own.o WHERE t.score = t.m)"""


def ret_map_top_n(spark, sf_dir):
    return retrieval.map_top_n(mentions(spark, sf_dir), _postings(spark, sf_dir), 5, "mention", basic=True)


SQL_MAP_TOP_N = f"WITH {SCORED}, {top('scored', 5)} SELECT mention AS term, form.form, synonym, score, rank FROM form JOIN top USING (form) WHERE NOT {sql_filter_out('form.form', 'synonym')}"


def _items(spark, sf_dir):
    """(id, item): for each part a sentence of each of its returned line items."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_partkey").alias("id"), F.concat_ws(" ", F.lower("l_linestatus"), "p_name", "p_name", F.when(F.col("l_linenumber") > 3, "sold")).alias("item"))


ITEMS = "items AS (SELECT l_partkey AS id, concat_ws(' ', lower(l_linestatus), p_name, p_name, CASE WHEN l_linenumber > 3 THEN 'sold' END) AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')"
PHRASES = """dl AS (SELECT id, sum(len(string_split(item, ' '))) AS dl FROM items GROUP BY id), tot AS (SELECT count(*) AS n, avg(dl) AS av FROM dl), it AS (SELECT DISTINCT id, unnest(string_split(item, ' ')) AS token FROM items),
bdf AS (SELECT token, count(*) AS df FROM it GROUP BY token), bw AS (SELECT synonym, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT synonym, unnest(string_split(synonym, ' ')) AS token FROM (SELECT DISTINCT synonym FROM wanted)) JOIN bdf USING (token), tot GROUP BY synonym),
tf AS (SELECT synonym, id, sum((length(' ' || item || ' ') - length(replace(replace(' ' || item || ' ', ' ', '  '), ' ' || replace(synonym, ' ', '  ') || ' ', '')) + length(' ' || item || ' ') - length(replace(' ' || item || ' ', ' ', ''))) / (length(replace(synonym, ' ', '  ')) + 2)) AS tf
  FROM wanted JOIN items USING (id) WHERE contains(' ' || item || ' ', ' ' || synonym || ' ') GROUP BY synonym, id),
phrase AS (SELECT synonym, id, coalesce(round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6), 0) AS score FROM wanted LEFT JOIN (SELECT * FROM tf JOIN bw USING (synonym) JOIN dl USING (id), tot) USING (synonym, id))"""


def ret_phrase_score(spark, sf_dir):
    pairs = _entries(spark, sf_dir).select("synonym", "id").where("id < 500 OR synonym < 'h'")
    return retrieval.phrase_scores(pairs, _items(spark, sf_dir))


SQL_PHRASE = f"WITH {DICT}, wanted AS (SELECT DISTINCT name AS synonym, id FROM dict WHERE id < 500 OR name < 'h'), {ITEMS}, {PHRASES} SELECT synonym, id, score FROM phrase"


def pipeline_map_documents(spark, sf_dir):
    """The flagship: every spelling of a text resolved to an id of a wanted taxon, or rejected."""
    found = retrieval.map_mentions(mentions(spark, sf_dir), _postings(spark, sf_dir), _entries(spark, sf_dir), _items(spark, sf_dir), TAXA, basic=True)
    return found.select("mention", "form", "synonym", "score", "tax", "id", "semantic_score", "match_type")


MAPPED = f"""{SCORED}, {top('scored')}, {BEST}, first AS (SELECT form, synonym, score, tax FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY synonym) AS r FROM best) WHERE r = 1),
ids AS (SELECT f.form, f.synonym, f.score, f.tax, d.id, min(d.priority) AS priority FROM first f JOIN dict d ON d.name = f.synonym AND d.tax = f.tax GROUP BY ALL),
wanted AS (SELECT DISTINCT synonym, id FROM (SELECT *, count(*) OVER (PARTITION BY form) AS k FROM ids) WHERE k > 1), {ITEMS}, {PHRASES},
chosen AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY coalesce(s, 0) DESC, priority, id) AS r FROM (SELECT i.*, p.score AS s FROM ids i LEFT JOIN phrase p USING (synonym, id))),
mapped AS (SELECT mention, form.form, c.synonym, c.score, c.tax, c.id, CASE WHEN c.form IS NOT NULL THEN coalesce(c.s, 0) END AS semantic_score, CASE WHEN c.score = 9999 THEN 'EXACT' WHEN c.form IS NOT NULL THEN 'APPROX' END AS match_type
  FROM form LEFT JOIN (SELECT * FROM chosen WHERE r = 1) c ON c.form = form.form)"""


def pipeline_map_documents_greek(spark, sf_dir):
    """The same with names cut at Greek letters too; without SQL."""
    return retrieval.map_mentions(mentions(spark, sf_dir), _postings(spark, sf_dir), _entries(spark, sf_dir), _items(spark, sf_dir), TAXA)


def fmt_confidence(spark, sf_dir):
    from onomast.sources.writers import as_annotations

    return as_annotations(pipeline_map_documents(spark, sf_dir).withColumn("begin", F.lit(0)).withColumn("end", F.length("mention")))


SQL_FMT = f"WITH {MAPPED} SELECT 'part catalogue' AS source, CAST(id AS VARCHAR) AS entry_id, tax AS taxonomy_id, CAST(0 AS INTEGER) AS \"begin\", CAST(length(mention) AS INTEGER) AS \"end\", printf('%.3f / %.3f', score, semantic_score) AS confidence, form AS normalized, synonym FROM mapped WHERE id IS NOT NULL"


def ret_context_or(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.without(T.words_of(F.col("text")), STOP).alias("tokens"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.without(T.words_of(F.col("text")), STOP).alias("tokens"))
    return retrieval.context_or(queries, documents, least=0.001)


SQL_CONTEXT_OR = f"""
WITH d AS (SELECT doc_id AS id, list_filter({_WORDS}, lambda t: t NOT IN ({_STOP})) AS w FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter({_WORDS}, lambda t: t NOT IN ({_STOP}))) AS token FROM benchmark),
e AS (SELECT id, len(w) AS n, unnest(w) AS token FROM d), tf AS (SELECT id, n, token, count(*) AS tf FROM e GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query_id, id, round(sum(sqrt(tf) * (1 + ln(((SELECT count(*) FROM d) + 1) / (df + 1))) ** 2 / sqrt(n)), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token) GROUP BY query_id, id)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.001) WHERE r = 1
"""


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("id"))


def _many(spark, sf_dir):
    """Entries whose ids have several names: suppliers by what they sell."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    pairs = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = pairs.select(F.col("p_name").alias("synonym"), F.col("l_suppkey").alias("id"), (F.col("p_size") % 9 - 1).cast("int").alias("priority"), F.col("p_brand").alias("tax"))
    # few are equal, so they aren't looked for before the shuffle, where a task would hold all of its rows
    return rows.repartition("id").distinct()


MANY = "many AS (SELECT DISTINCT p_name AS synonym, l_suppkey AS id, CAST(p_size % 9 - 1 AS INTEGER) AS priority, p_brand AS tax FROM lineitem JOIN part ON l_partkey = p_partkey)"


def lk_id_to_tax(spark, sf_dir):
    return retrieval.id_to_tax(_entries(spark, sf_dir), _ids(spark, sf_dir))


def _sellers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))


def lk_synonyms(spark, sf_dir):
    return retrieval.synonyms_of(_many(spark, sf_dir), _sellers(spark, sf_dir), 10)


def lk_priority_names(spark, sf_dir):
    return retrieval.priority_names(_many(spark, sf_dir), _sellers(spark, sf_dir))


def lk_index_entries(spark, sf_dir):
    return retrieval.index_entries(_many(spark, sf_dir), _sellers(spark, sf_dir))


def lk_contexts(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("field", F.lit("line"))
    return retrieval.contexts_of(_ids(spark, sf_dir), items, "line").select("id", F.array_join("items", "|").alias("items"))


SQL_CONTEXTS = f"WITH {ITEMS} SELECT id, string_agg(item, '|' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM items WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)) GROUP BY id"


def lk_ambiguity(spark, sf_dir):
    found = retrieval.ambiguity(_many(spark, sf_dir), TAXA[0])
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), " "))


SQL_AMBIGUITY = f"""
WITH {MANY}, own AS (SELECT synonym, count(DISTINCT id) AS n, string_agg(DISTINCT CAST(id AS VARCHAR), ' ' ORDER BY CAST(id AS VARCHAR)) AS x, list_sort(list(DISTINCT id)) AS ids, max_by(id, (id, priority)) AS last FROM many WHERE tax = '{TAXA[0]}' GROUP BY synonym),
w AS (SELECT synonym, max(k) > 1 AS within FROM (SELECT synonym, tax, count(DISTINCT id) AS k FROM many GROUP BY synonym, tax) GROUP BY synonym), g AS (SELECT synonym, count(DISTINCT id) > 1 AS ambiguous, count(DISTINCT tax) > 1 AS between_taxa FROM many GROUP BY synonym),
p AS (SELECT m.synonym, count(*) AS n_priorities FROM many m JOIN own o ON m.synonym = o.synonym AND list_contains(o.ids, m.id) GROUP BY m.synonym)
SELECT g.synonym, ambiguous, within, between_taxa, own.n IS NOT NULL AS has_tax, coalesce(array_to_string(ids, ' '), '') AS ids, last AS last_id, CASE WHEN own.n = 1 THEN ids[1] END AS only_id, coalesce(n_priorities, 0) AS n_priorities
FROM g JOIN w USING (synonym) LEFT JOIN own USING (synonym) LEFT JOIN p USING (synonym)
"""


def lk_highest_tax(spark, sf_dir):
    rows = _many(spark, sf_dir).select(F.col("synonym").alias("key"), F.when(F.col("priority") > 6, F.col("tax")).alias("tax"), (-F.col("priority")).cast("double").alias("score"))
    return retrieval.highest_tax(rows.where("key LIKE '%g%'"), "key", "none")


SQL_HIGHEST_TAX = f"""
WITH {MANY} SELECT key, coalesce(tax, 'none') AS tax FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, tax NULLS FIRST) AS r FROM (SELECT synonym AS key, CASE WHEN priority > 6 THEN tax END AS tax, -priority AS score FROM many WHERE synonym LIKE '%g%')) WHERE r = 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        norm_basic, norm_greek, norm_variants, norm_remove_modifiers, text_ngrams, text_stopwords, text_stemmed, text_window, pair_overlap, pair_filter_out, pair_number_compat, sim_simple, sim_levenshtein, sim_token_jaro,
        sim_transpositions, sim_jaro_winkler, ret_or_query, ret_and_query, ret_tfidf_top20, ret_tax_filtered, ret_best_of_fields, ret_candidates, ret_best_synonyms, ret_map_top_n, ret_phrase_score, ret_context_or, lk_id_to_tax,
        lk_synonyms, lk_priority_names, lk_index_entries, lk_contexts, lk_ambiguity, lk_highest_tax, fmt_confidence, pipeline_map_documents, pipeline_map_documents_greek,
    )
}

SQL = {
    "norm_basic": f"WITH {FORMS} SELECT mention, form FROM form", "norm_variants": SQL_VARIANTS, "norm_remove_modifiers": SQL_REMOVE_MODIFIERS, "text_ngrams": SQL_NGRAMS, "text_stopwords": SQL_STOPWORDS, "text_window": SQL_WINDOW,
    "pair_overlap": SQL_PAIR_OVERLAP, "pair_filter_out": f"WITH {_NUMBERED} SELECT a, b, {sql_filter_out()} AS dropped FROM pair", "pair_number_compat": SQL_NUMBER_COMPAT, "sim_simple": SQL_SIMPLE,
    "sim_levenshtein": f"WITH {PAIR} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS score FROM pair", "ret_or_query": SQL_OR, "ret_and_query": SQL_AND,
    "ret_tfidf_top20": f"WITH {SCORED}, {top('scored')} SELECT form, synonym, score, rank FROM top", "ret_tax_filtered": SQL_TAX_FILTERED, "ret_best_of_fields": SQL_BEST_OF_FIELDS, "ret_candidates": SQL_CANDIDATES,
    "ret_best_synonyms": f"WITH {SCORED}, {top('scored')}, {BEST} SELECT form, synonym, score, tax FROM best", "ret_map_top_n": SQL_MAP_TOP_N, "ret_phrase_score": SQL_PHRASE, "ret_context_or": SQL_CONTEXT_OR,
    "lk_id_to_tax": f"WITH {DICT} SELECT i.id, min(tax) AS tax FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 10) i LEFT JOIN (SELECT * FROM dict WHERE priority = -1) d ON d.id = i.id GROUP BY i.id",
    "lk_synonyms": f"WITH {MANY} SELECT id, synonym FROM (SELECT id, synonym, row_number() OVER (PARTITION BY id ORDER BY synonym) AS r FROM (SELECT DISTINCT id, synonym FROM many WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))) WHERE r <= 10",
    "lk_priority_names": f"WITH {MANY} SELECT id, min(synonym) AS name FROM many WHERE priority = -1 AND id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY id",
    "lk_index_entries": f"WITH {MANY} SELECT id, synonym, priority, tax FROM many WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", "lk_contexts": SQL_CONTEXTS, "lk_ambiguity": SQL_AMBIGUITY, "lk_highest_tax": SQL_HIGHEST_TAX,
    "fmt_confidence": SQL_FMT, "pipeline_map_documents": f"WITH {MAPPED} SELECT * FROM mapped",
}
