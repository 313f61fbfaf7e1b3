import random

import pytest
from onomast.llm import langid

KIND = "doc_id bigint, text string, lang string"


def words_of(rng, syllables, n):
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    en = words_of(rng, ["the", "an", "er", "on", "re", "st", "in", "ha", "wh", "ly"], 3000)
    fr = words_of(rng, ["eau", "que", "ais", "ou", "le", "ment", "é", "ois", "ré", "pa"], 3000)
    russian = words_of(rng, ["ко", "на", "ст", "ра", "пре", "во", "ни", "ть", "ло", "ша"], 100)
    polish = words_of(rng, ["szcz", "ow", "rzy", "ał", "dzi", "prze", "ny", "ch", "ło", "ię"], 100)
    texts = [(prose(rng, en, 200), "en") for _ in range(400)] + [(prose(rng, fr, 200), "fr") for _ in range(400)]
    texts += [(prose(rng, russian, 250), "en") for _ in range(20)] + [(prose(rng, polish, 250), "en") for _ in range(20)]
    texts += [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(800)), "en")] * 200
    rows = [(i, t, x) for i, (t, x) in enumerate(texts)]
    return rows + [(5000, texts[0][0], "fr"), (5001, texts[400][0], None), (5002, None, "en"), (5003, "12 34", "en")]


def test_foreign_texts_and_copied_junk_are_rejected(spark, docs):
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, KIND), ["doc_id"]).collect()}
    assert len(got) == len(docs)
    assert sum(got[i].accepted and got[i].pred_lang == ("en" if i < 400 else "fr") for i in range(800)) >= 790
    assert [i for i in range(800, 1040) if got[i].accepted] == []
    assert (got[5000].pred_lang, got[5001].pred_lang) == ("en", "fr")
    assert [(got[i].pred_lang, got[i].accepted) for i in (5002, 5003)] == [(None, False)] * 2


def test_no_labelled_rows(spark):
    got = langid.identify(spark.createDataFrame([(1, "some text", None)], KIND), ["doc_id"]).collect()
    assert [(r.pred_lang, r.accepted) for r in got] == [(None, False)]
