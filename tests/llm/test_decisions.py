"""Decisions of the language-model operators, and of the pipeline, against versions by brute force."""

import random
from collections import Counter, defaultdict

import brute_models
import corpus_pipeline
import pytest
from onomast.llm import bpe, langid, quality, simhash, urls
from pyspark.sql import functions as F

KIND = "doc_id bigint, text string, lang string"


def some_docs(seed, n=60):
    rng = random.Random(seed)
    kinds = {"en": ["the", "an", "er", "on", "re", "st"], "fr": ["eau", "que", "ou", "le", "é", "ois"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else "fr"
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([3, 20, 90]))]
        rows.append((i, " ".join(words).capitalize() + rng.choice([".", " 12", "!"]), lang))
    return rows + [(500, rows[1][1], "en"), (501, rows[1][1], "fr"), (502, "zq xj kv " * 40, "en"), (503, None, "en"), (504, "", "fr"), (505, rows[0][1], None), (506, "12 !", "en")]


def hashes(spark, rows, column):
    return [r.h for r in spark.createDataFrame(list(enumerate(rows)), "i int, text string").select("i", column(F.col("text")).alias("h")).orderBy("i").collect()]


def test_languages(spark):
    docs = some_docs(1)
    texts = [(t or "").lower() for _, t, _ in docs]
    half = hashes(spark, [t and t.lower() for _, t, _ in docs], lambda c: F.pmod(F.xxhash64(c), F.lit(2)))
    train = defaultdict(list)
    for t, h, (_, text, lang) in zip(texts, half, docs):
        if text is not None and lang:
            train[h, lang].append(t)
    models = {k: brute_models.model(v, langid.ORDER, "kn") for k, v in train.items()}
    scored = {}
    for t, h in zip(texts, half):
        if t:
            found = sorted((brute_models.entropy(models[1 - h, x], t, langid.ORDER), x) for x in ("en", "fr"))
            p = models[1 - h, found[0][1]]
            scored[t] = f"{h}{found[0][1]}", found[0][0], found[1][0] - found[0][0], sum(brute_models.entropy(p, t, langid.ORDER, k) for k in range(1, langid.LOW + 1)), len(t)
    letters = {t for t in scored if any(c.isalpha() for c in t)}
    z = brute_models.deviations([(scored[t][0], scored[t][1], scored[t][4]) for t in letters])
    z_low = brute_models.deviations([(scored[t][0], scored[t][3], scored[t][4]) for t in letters])
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, KIND), ["doc_id"]).collect()}
    assert len(got) == len(docs)
    for (i, _, _), t in zip(docs, texts):
        if t not in letters:
            assert got[i].pred_lang is None and not got[i].accepted
            continue
        group, score, margin, low, n = scored[t]
        assert got[i].pred_lang == group[1:] and got[i].cross_entropy == pytest.approx(score, rel=1e-5) and got[i].margin == pytest.approx(margin, rel=1e-3, abs=1e-5)
        assert got[i].accepted == (abs(z(group, score, n)) <= langid.MAX_DEVIATIONS and z_low(group, low, n) <= langid.MAX_DEVIATIONS)


@pytest.mark.parametrize("labelled", [True, False])
def test_perplexities(spark, labelled):
    docs = some_docs(2, 120)
    marks = {i: int(i % 7 != 0) for i in range(100)} if labelled else {}
    clean = ["".join("0" if c.isdigit() else c for c in t) if t else t for _, t, _ in docs]
    half = hashes(spark, clean, lambda c: F.pmod(F.xxhash64(c), F.lit(2)))
    use = lambda i: marks.get(i) == 1 if labelled else marks.get(i, 1) == 1
    train = defaultdict(list)
    for t, h, (i, _, lang) in zip(clean, half, docs):
        if t and t.strip() and lang and use(i):
            train[h, lang].append(t)
    models = {k: brute_models.model(v, quality.ORDER, "mkn") for k, v in train.items()}
    score = {(t, lang): brute_models.entropy(models[1 - h, lang], t, quality.ORDER) for t, h, (_, _, lang) in zip(clean, half, docs) if t and t.strip() and lang}
    once = {(lang, t) for t, (i, _, lang) in zip(clean, docs) if (t, lang) in score and use(i)}
    z = brute_models.deviations([(lang, score[t, lang], len(t)) for lang, t in once])
    labels = spark.createDataFrame(list(marks.items()), "doc_id bigint, quality int") if labelled else None
    got = {r.doc_id: r for r in quality.perplexities(spark.createDataFrame(docs, KIND), ["doc_id"], labels=labels).collect()}
    for t, (i, _, lang) in zip(clean, docs):
        if not t or not t.strip():
            assert got[i].reason == "empty" and not got[i].kept
        elif lang is None:
            assert got[i].kept and got[i].perplexity is None
        else:
            d = z(lang, score[t, lang], len(t))
            assert got[i].perplexity == pytest.approx(2.718281828459045 ** score[t, lang], rel=1e-4) and got[i].deviations == pytest.approx(d, rel=1e-3, abs=1e-3)
            assert got[i].reason == ("low" if d < -quality.BAND[0] else "high" if d > quality.BAND[1] else None) and got[i].kept == (got[i].reason is None)


def test_urls(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{rng.choice(['www', 'm'])}.{rng.choice(['casino', 'news', 'blog', 'pills', 'shop'])}{i % 9}.example.org/{i}") for i in range(80)] + [(90, None), (91, "http://X.news1.example.org/A")]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    plain = [r.t for r in df.select("page_id", urls.plain(F.col("url")).alias("t")).orderBy("page_id").collect()]
    side = [(r.h, r.s) for r in df.select("page_id", F.pmod(F.xxhash64(urls.host(F.col("url"))), F.lit(2)).alias("h"), urls.host(F.col("url")).rlike(urls.SEEDS).alias("s")).orderBy("page_id").collect()]
    train = defaultdict(list)
    for t, (h, s) in zip(plain, side):
        if t:
            train[h, bool(s)].append(t)
    models = {k: brute_models.model(v, urls.ORDER, "wb") for k, v in train.items()}
    score = {i: brute_models.entropy(models[1 - h, False], t, urls.ORDER) - brute_models.entropy(models[1 - h, True], t, urls.ORDER) for i, (t, (h, _)) in enumerate(zip(plain, side)) if t}
    histogram = Counter((int(score[i] // urls.STEP), bool(side[i][1])) for i in score)
    limit = urls.best_threshold([(b, s, n) for (b, s), n in histogram.items()])
    for i, r in enumerate(urls.filter_urls(df, ["page_id"]).orderBy("page_id").collect()):
        if i not in score:
            assert r.score is None and r.kept
            continue
        assert r.score == pytest.approx(score[i], rel=1e-4, abs=1e-5) and r.threshold == pytest.approx(limit) and r.seed == bool(side[i][1])
        if abs(score[i] - limit) > 1e-4:
            assert r.kept == (not r.seed and score[i] <= limit)


CLASHES = ["label", "score", "n", "half", "sig", "row", "digest", "route", "tokens", "n_tokens", "slot", "block", "kept", "hash", "group_id", "found"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_survive_anything(spark, name, stage, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeats, clashing names, empty tables."""
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rng = random.Random(4)
    prose = [" ".join(rng.choice(["the", "an", "house", "river", "on", "stone", "walks"]) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [(None, prose[0], "en", None, None), (None, None, None, None, None), (3, "", "en", "s0", 0), (3, " \n ", None, "s0", 3), (4, prose[4], "en", "s1", 1), (4, prose[4], "en", "s1", 1), (99, "word " * 60_000, "en", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(c))
    if name == "bpe_encode":
        docs = docs.drop("tokens", "n_tokens")
    out = stage(spark, docs, str(tmp_path))
    assert name == "bpe_encode" or out.columns == docs.columns
    got = out.collect()
    known = {(r[0], r[1]) for r in rows}
    if name != "bpe_encode":
        assert got and all((r.doc_id, r.text) in known and r.label == "label" for r in got)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_as_its_stages_say(spark, tmp_path):
    """The whole run on the small tables: what each stage's own rule, worked out on its input by other means, would keep."""
    sf = "/root/testdata/sf0.001"

    def written(df, k):
        df.write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = {r.doc_id for r in langid.identify(docs, ["doc_id"]).collect() if r.accepted}
    good = written(corpus_pipeline.STAGES[0][1](spark, docs, sf), 0)
    assert {r.doc_id for r in good.select("doc_id").collect()} == kept
    clear = written(corpus_pipeline.STAGES[1][1](spark, good, sf), 1)
    assert {r.doc_id for r in clear.select("doc_id").collect()} == {r.doc_id for r in quality.perplexities(good, ["doc_id"], labels=spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
    # near duplicates: components over all pairs of signatures
    rows = clear.select("doc_id", simhash.signature(F.col("text")).alias("s")).collect()
    sig = {r.doc_id: int.from_bytes(r.s, "little") for r in rows}
    group = {i: i for i in sig}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sig)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (sig[a] ^ sig[b]).bit_count() <= simhash.MAX_DISTANCE:
                group[max(root(a), root(b))] = min(root(a), root(b))
    single = written(corpus_pipeline.STAGES[2][1](spark, clear, sf), 2)
    assert {r.doc_id for r in single.select("doc_id").collect()} == {root(i) for i in ids}
    mixed = Counter(r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, single, sf).collect())
    done = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in done) == mixed
    v = bpe.vocabulary(bpe.VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip and v.bytes[bpe.spread(v.starts[r.tokens], v.lengths[r.tokens])].tobytes().decode() == texts[r.doc_id] for r in done)
