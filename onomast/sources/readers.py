"""Sources: delimited files, XML and OBO dumps, small files, configuration."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions.automaton import Automaton


def read_tsv(spark: SparkSession, path: str, columns: Mapping[str, int] | Sequence[str], bad: str = "drop", arity: int | None = None, between: str = "\t", comment: str | None = None) -> DataFrame:
    """Delimited lines, compressed or not, as text columns: all by name, or some by (name, place from 1).

    Lines that don't have ``arity`` fields (by default as many as named, or as
    the greatest place) are dropped, kept with nulls ("keep"), or an error
    ("fail").  Lines that start with ``comment`` are skipped.  An empty field
    is an empty text.  ``between`` may be more than one character.
    """
    places = {c: i + 1 for i, c in enumerate(columns)} if not isinstance(columns, Mapping) else dict(columns)
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    parts = F.split("value", re.escape(between), -1)
    want = arity or max(places.values())
    fits = F.size(parts) == want if arity or not isinstance(columns, Mapping) else F.size(parts) >= want
    if bad == "drop":
        lines = lines.where(fits)
    elif bad == "fail":
        lines = lines.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))).cast("boolean")))
    elif bad != "keep":
        raise ValueError("bad must be drop, keep or fail")
    return lines.select(*[F.get(parts, F.lit(i - 1)).alias(c) for c, i in places.items()])


def read_records(spark: SparkSession, path: str, row_tag: str, fields: Mapping[str, str], lists: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each element ``row_tag`` of XML files: the text at an XPath for each of ``fields``, and the texts at one for each of ``lists``.

    An absent field is null, an absent list empty.  Files are cut at the
    closing tags, so a large one is read in parallel.
    """
    raw = _elements(spark, path, row_tag)
    exprs = [F.nullif(F.xpath_string("element", F.lit(x)), F.lit("")).alias(c) for c, x in fields.items()]
    exprs += [F.xpath("element", F.lit(x)).alias(c) for c, x in (lists or {}).items()]
    return raw.select(*exprs)


def _elements(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """(element) of each ``row_tag``, from lines that end in its closing tag."""
    lines = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    found = F.regexp_extract("value", rf"(?s)(<{row_tag}(?:\s[^>]*)?>.*)$", 1)
    return lines.select(found.alias("element")).where("element <> ''").select(F.concat(F.regexp_replace("element", r'\sxmlns(:\w+)?="[^"]*"', ""), F.lit(f"</{row_tag}>")).alias("element"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, tax_id, summary, prot_desc, prot_names, refseq_status, track_status, track_status_value) of each Entrezgene element."""
    return read_records(
        spark, path, "Entrezgene",
        {
            "gene_id": "Entrezgene/Entrezgene_track-info//Gene-track_geneid", "tax_id": "Entrezgene/Entrezgene_source//Dbtag[Dbtag_db='taxon']/Dbtag_tag//Object-id_id", "summary": "Entrezgene/Entrezgene_summary",
            "prot_desc": "Entrezgene/Entrezgene_prot//Prot-ref_desc", "refseq_status": "Entrezgene//Gene-commentary[Gene-commentary_heading='RefSeq Status']/Gene-commentary_label",
            "track_status": "Entrezgene/Entrezgene_track-info//Gene-track_status", "track_status_value": "Entrezgene/Entrezgene_track-info//Gene-track_status/@value",
        },
        {"prot_names": "Entrezgene/Entrezgene_prot//Prot-ref_name_E/text()"},
    )


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(name, id, priority): the recommended names and the primary gene name of each protein entry, by its first accession, with priority 5."""
    rows = read_records(spark, path, "entry", {"id": "entry/accession[1]"}, {"names": "entry/protein/recommendedName/*[contains(name(), 'Name')]/text()", "genes": "entry/gene/name[@type='primary']/text()"})
    return rows.select(F.explode(F.concat("names", "genes")).alias("name"), "id", F.lit(5).alias("priority"))


def read_protein_comments(spark: SparkSession, path: str, mapping: DataFrame | None = None, skip: Sequence[str] = ("online information",)) -> DataFrame:
    """(id, kind, text): the free text of each protein's comments by kind, and its keywords in one; with a mapping of (up, eg) also those of the mapped ids."""
    rows = read_records(spark, path, "entry", {"id": "entry/accession[1]"}, {"kinds": "entry/comment[text]/@type", "texts": "entry/comment/text[1]/text()", "keywords": "entry/keyword/text()"})
    comments = rows.select("id", F.explode(F.arrays_zip("kinds", "texts")).alias("c")).select("id", F.col("c.kinds").alias("kind"), F.col("c.texts").alias("text")).where(~F.col("kind").isin(list(skip)))
    words = rows.where(F.size("keywords") > 0).select("id", F.lit("keyword").alias("kind"), F.array_join("keywords", " ").alias("text"))
    own = comments.unionByName(words).groupBy("id", "kind").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    if mapping is None:
        return own
    return own.unionByName(own.join(mapping.select(F.col("up").alias("id"), "eg"), "id").select(F.col("eg").alias("id"), "kind", "text"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, synonyms) of each term of an OBO file; a molecular function's names without a last "activity"."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike(r"(?m)^\[Term\]"))
    one = lambda key: F.regexp_extract("value", rf"(?m)^{key}: (.*?)\s*$", 1)
    rows = stanzas.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), F.regexp_extract_all("value", F.lit(r'(?m)^synonym: "((?:[^"\\]|\\.)*)"'), 1).alias("synonyms"))
    short = lambda c: F.when(F.col("namespace") == "molecular_function", F.regexp_replace(c, " activity$", "")).otherwise(c)
    return rows.select("id", short(F.col("name")).alias("name"), "namespace", F.transform("synonyms", lambda s: F.when(F.col("namespace") == "molecular_function", F.regexp_replace(s, " activity$", "")).otherwise(s)).alias("synonyms"))


def go_names(terms: DataFrame) -> DataFrame:
    """(go, names): each term's name and synonyms as a ``|`` list."""
    return terms.select(F.col("id").alias("go"), F.array_join(F.concat(F.array("name"), "synonyms"), "|").alias("names"))


def read_mentions(annotations: DataFrame, kinds: Mapping[str, str | None]) -> DataFrame:
    """Annotations (doc_id, begin, end, text, type, specific_type) of the types given; where a pattern is given the specific type must match it as a whole, and a null one never does."""
    keep = F.lit(False)
    for kind, pattern in kinds.items():
        own = F.col("type") == kind
        keep = keep | (own if pattern is None else own & F.coalesce(F.col("specific_type").rlike(f"^(?:{pattern})$"), F.lit(False)))
    return annotations.where(keep)


def parse_kinds(texts: Sequence[str]) -> dict[str, str | None]:
    """``Type`` or ``Type=pattern`` settings as a mapping."""
    return {t.partition("=")[0].strip(): t.partition("=")[2].strip() or None for t in texts}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): small files whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_settings(text: str) -> dict[str, str]:
    """key = value or key: value lines; # and ! start comments, a backslash at the end joins lines."""
    out = {}
    for line in re.sub(r"\\\r?\n\s*", "", text).splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            m = re.match(r"([^=:\s]+)\s*[=:\s]\s*(.*)", line)
            if m:
                out[m[1]] = m[2].strip()
    return out


def tagged(table: DataFrame, columns: Sequence[str], dictionary: Mapping[str, str], name: str = "tags") -> DataFrame:
    """The ids of dictionary words (word: id) that occur in some columns as whole words, whatever their case, joined with ``;``; rows without any are dropped.

    The dictionary goes with the function to every task, so it is for lists
    such as species names; each text is searched once for all words.
    """
    ids = {w.lower(): i for w, i in dictionary.items()}

    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = Automaton(ids)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                t = (text or "").lower()
                whole = [m for m in search.longest(t) if not t[max(0, m[0] - 1) : m[0]].isalnum() and not t[m[1] + 1 : m[1] + 2].isalnum()]
                out.append(";".join(dict.fromkeys(ids[w] for _, _, w in whole)) or None)
            yield pa.array(out, pa.string())

    text: Column = F.concat_ws("\n", *columns)
    return table.withColumn(name, found(text)).where(F.col(name).isNotNull())
