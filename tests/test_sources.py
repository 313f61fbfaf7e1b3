import gzip

import pytest
from onomast.operators import etl, index, learn, retrieval
from onomast.sources import readers, writers
from onomast.streaming import mapping
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("#c\nx\t1\t-1\ny\t\t2\nbad\t3\n")
    path = str(tmp_path / "a.gz")
    assert rows(readers.read_tsv(spark, path, ["name", "id", "priority"], comment="#")) == [("x", "1", "-1"), ("y", "", "2")]
    assert rows(readers.read_tsv(spark, path, {"id": 2, "name": 1}, comment="#")) == [("", "y"), ("1", "x"), ("3", "bad")]
    assert ("bad", "3", None) in rows(readers.read_tsv(spark, path, ["a", "b", "c"], "keep", comment="#"))
    with pytest.raises(Exception, match="wrong number of fields"):
        readers.read_tsv(spark, path, ["a", "b", "c"], "fail", comment="#").collect()
    (tmp_path / "b").write_text("A0~|~n 1~|~q\nB~|~n\n")
    assert rows(readers.read_tsv(spark, str(tmp_path / "b"), {"acc": 1, "name": 2}, between="~|~")) == [("A0", "n 1"), ("B", "n")]
    df = spark.createDataFrame([("a", None), ("b", 'q"x')], "x string, y string")
    writers.write_tsv(df, str(tmp_path / "out"))
    assert rows(readers.read_tsv(spark, str(tmp_path / "out"), ["x", "y"])) == [("a", ""), ("b", 'q"x')]


GENES = """<?xml version="1.0"?><Entrezgene-Set>
<Entrezgene><Entrezgene_track-info><Gene-track><Gene-track_geneid>7</Gene-track_geneid><Gene-track_status value="live">0</Gene-track_status></Gene-track></Entrezgene_track-info>
<Entrezgene_source><BioSource><Dbtag><Dbtag_db>taxon</Dbtag_db><Dbtag_tag><Object-id><Object-id_id>9606</Object-id_id></Object-id></Dbtag_tag></Dbtag></BioSource></Entrezgene_source>
<Entrezgene_prot><Prot-ref><Prot-ref_name><Prot-ref_name_E>a b</Prot-ref_name_E><Prot-ref_name_E>c</Prot-ref_name_E></Prot-ref_name><Prot-ref_desc>d</Prot-ref_desc></Prot-ref></Entrezgene_prot><Entrezgene_summary>s</Entrezgene_summary></Entrezgene>
<Entrezgene><Entrezgene_track-info><Gene-track><Gene-track_geneid>8</Gene-track_geneid></Gene-track></Entrezgene_track-info></Entrezgene></Entrezgene-Set>"""
PROTEINS = """<uniprot xmlns="http://x.org/u"><entry dataset="S"><accession>P1</accession><accession>P2</accession><protein><recommendedName><fullName>Full one</fullName><shortName>F1</shortName></recommendedName></protein>
<gene><name type="primary">G</name><name type="synonym">H</name></gene><comment type="function"><text>does x</text></comment><comment type="online information"><text>no</text></comment><keyword>k1</keyword><keyword>k2</keyword></entry>
<entry><accession>P3</accession></entry></uniprot>"""
OBO = 'format: 1\n\n[Term]\nid: GO:1\nname: x activity\nnamespace: molecular_function\nsynonym: "y activity" EXACT []\n\n[Typedef]\nid: t\n\n[Term]\nid: GO:2\nname: z activity\nnamespace: biological_process\n'


def test_xml_and_obo(spark, tmp_path):
    (tmp_path / "g.xml").write_text(GENES)
    got = {r.gene_id: r for r in readers.read_genes(spark, str(tmp_path / "g.xml")).collect()}
    assert (got["7"].tax_id, got["7"].summary, got["7"].prot_names, got["7"].prot_desc, got["7"].track_status, got["7"].track_status_value) == ("9606", "s", ["a b", "c"], "d", "0", "live")
    assert got["8"].summary is None and got["8"].prot_names == []
    (tmp_path / "u.xml").write_text(PROTEINS)
    assert rows(readers.read_proteins(spark, str(tmp_path / "u.xml"))) == [("F1", "P1", 5), ("Full one", "P1", 5), ("G", "P1", 5)]
    mapping_ = spark.createDataFrame([("P1", "77")], "up string, eg string")
    assert rows(readers.read_protein_comments(spark, str(tmp_path / "u.xml"), mapping_)) == [("77", "function", "does x"), ("77", "keyword", "k1 k2"), ("P1", "function", "does x"), ("P1", "keyword", "k1 k2")]
    (tmp_path / "go.obo").write_text(OBO)
    terms = readers.read_obo(spark, str(tmp_path / "go.obo"))
    assert rows(terms) == [("GO:1", "x", "molecular_function", ["y"]), ("GO:2", "z activity", "biological_process", [])]
    assert rows(index.go_context(spark.createDataFrame([("7", "GO:1"), ("7", "GO:9")], "id string, item string"), readers.go_names(terms))) == [("7", "x y")]


def test_small_readers(spark, tmp_path):
    (tmp_path / "t").write_text("a\nb\n")
    assert rows(readers.read_lines(spark, str(tmp_path / "t"))) == [("a",), ("b",)]
    assert readers.read_whole(spark, str(tmp_path / "t")).first().text == "a\nb\n"
    assert readers.read_settings("# c\na = 1\nb: x \\\n  y\n") == {"a": "1", "b": "x y"}
    kinds = readers.parse_kinds(["Gene", "Protein=prot.*"])
    df = spark.createDataFrame([(1, "Gene", None), (2, "Protein", "protein"), (3, "Protein", None), (4, "Other", "prot")], "doc_id int, type string, specific_type string")
    assert [r.doc_id for r in readers.read_mentions(df, kinds).orderBy("doc_id").collect()] == [1, 2]
    texts = spark.createDataFrame([(1, "Mouse and human-like", None), (2, "mousetrap", "x"), (3, None, "in a house mouse")], "i int, a string, b string")
    assert rows(readers.tagged(texts, ["a", "b"], {"mouse": "10090", "human": "9606", "house mouse": "10092"}).select("i", "tags")) == [(1, "10090;9606"), (3, "10092")]


def corpus(spark):
    dictionary = spark.createDataFrame([("il 2", "1", -1, "9606"), ("interleukin 2", "1", 2, "9606"), ("il 2", "2", -1, "10090"), ("tnf alpha", "3", -1, "9606"), ("collagen 4", "4", 0, "9606"), ("collagen 4", "5", 2, "9606")], "name string, id string, priority int, tax string")
    items = spark.createDataFrame([("5", "role of collagen 4 in basement membrane")], "id string, item string")
    mentions = spark.createDataFrame([("IL-2",), ("TNFalpha",), ("collagen IV",), ("BRCA1",), (None,), ("",), ("IL-2",)], "mention string")
    return mentions, index.postings(dictionary), index.entries(dictionary), items


def test_mini_corpus(spark):
    mentions, postings, entries, items = corpus(spark)
    got = rows(retrieval.map_mentions(mentions, postings, entries, items, ["9606"]).select("mention", "id", "match_type"))
    assert got == sorted([("IL-2", "1", "EXACT"), ("IL-2", "1", "EXACT"), ("TNFalpha", "3", "EXACT"), ("collagen IV", "5", "EXACT"), ("BRCA1", None, None), (None, None, None), ("", None, None)], key=str)
    assert {r.id for r in retrieval.map_mentions(mentions, postings, entries, items, ["10116"]).collect()} == {None}
    shown = writers.readable(retrieval.candidates(mentions.select(F.lit("il 2").alias("form")).distinct(), postings, entries))
    assert ("il 2", "il 2 (9999.000): 1/9606/-1, 2/10090/-1") in rows(shown)


def test_stream_as_batch(spark, tmp_path):
    mentions, postings, entries, items = corpus(spark)
    mentions.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mention string").parquet(str(tmp_path / "in"))
    mapping.start(stream, postings, entries, items, ["9606"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = retrieval.map_mentions(mentions, postings, entries, items, ["9606"])
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == rows(batch)
    known = retrieval.disambiguated(retrieval.best_synonyms(retrieval.top_hits(spark.createDataFrame([("il 2",)], "form string"), postings), entries, ["9606"]), entries, items)
    out = mapping.resolved(mapping.normalized_stream(stream), known)
    out.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert [r.id for r in spark.table("seen").where("form = 'il 2'").collect()] == ["1", "1"]


def test_dictionary_from_sources(spark):
    a = spark.createDataFrame([("IL-2", "1", -1), ("TNF-alpha", "3", 2), ("Putative protein", "4", 2), ("receptors", "6", 3), ("x", "7", 3)], "name string, id string, priority int")
    b = spark.createDataFrame([("IL2", "1", 2), ("alpha 2", "8", 2)], "name string, id string, priority int")
    got = rows(etl.dictionary([a, b]))
    assert ("il 2", "1", -1) in got and ("tnf alpha", "3", 2) in got and ("tnf a", "3", 2) in got
    assert not {"4", "6", "7"} & {i for _, i, _ in got} and ("alpha 2", "8", 2) not in got


def test_annotations_replace(spark):
    old = spark.createDataFrame([("d", 0, 3, "x"), ("d", 5, 9, "y")], "doc_id string, begin int, end int, id string")
    new = spark.createDataFrame([("d", 0, 3, "z")], "doc_id string, begin int, end int, id string")
    assert rows(writers.replace_annotations(old, new)) == [("d", 0, 3, "z"), ("d", 5, 9, "y")]


def test_learning(spark, tmp_path):
    names = spark.createDataFrame([(f"{w} {k}", i) for i, w in enumerate(["actin", "myosin", "kinase", "ligase", "tubulin"]) for k in ("alpha", "beta 2", "x")] + [("alpha actin", 0), ("beta myosin", 1)], "name string, id int")
    pairs = learn.positive_pairs(names).unionByName(learn.negative_pairs(names))
    model = learn.train(pairs)
    learn.save(model, str(tmp_path / "m"))
    judged = learn.scored(learn.load(str(tmp_path / "m")), pairs.unionByName(spark.createDataFrame([("a b", "a  b", "TRUE"), (None, "x", "TRUE")], "term1 string, term2 string, label string")))
    got = {(r.term1, r.term2): r.score for r in judged.collect()}
    assert got["a b", "a  b"] == 9999.0 and got[None, "x"] == 0.0
    right = [(s > 0.5) == (label == "TRUE") for (a, b), s in got.items() for label in [r.label for r in pairs.where((F.col("term1") == a) & (F.col("term2") == b)).collect()]] if len(got) < 60 else []
    assert not right or sum(right) / len(right) > 0.7
    folds = learn.cross_validated(pairs, 2).collect()
    assert sum(r.n for r in folds) == pairs.count()
