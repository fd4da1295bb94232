import itertools

import numpy as np

from plumbline.llm import language_crf as lc
from plumbline.llm.common import crc_mod, table


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    for n, k in ((1, 3), (2, 2), (5, 3), (7, 2)):
        e, t = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k))
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            score = sum(e[i, path[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(path, path[1:])) + np.log(np.exp(t).sum(axis=0))[path[0]]
            for i, y in enumerate(path):
                want[i, y] += np.exp(score)
        want /= want.sum(axis=1, keepdims=True)
        for chunk in (1, 2, 3, 32):
            assert np.allclose(lc.forward_backward(e, t, chunk), want)
    lengths = np.array([3, 90, 1, 64])
    e = rng.normal(size=(158, 3))
    t = rng.normal(size=(3, 3))
    ends = np.cumsum(lengths)
    alone = np.concatenate([lc.forward_backward(e[b - n : b], t) for b, n in zip(ends, lengths)])
    assert np.allclose(lc.forward_backward(e, t, 7, lengths), alone)


def test_held_out_accuracy_code_switching_and_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = lc.fit(docs.where(crc_mod("doc_id", 5) != 0))
    held = docs.where(crc_mod("doc_id", 5) == 0)
    pairs = lc.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(pairs) > 150 and np.mean([r.lang_pred == r.lang for r in pairs]) > 0.97
    assert all(0 <= r.score <= 1 for r in pairs)
    german = next(r.text for r in docs.where("lang = 'de'").collect())
    english = next(r.text for r in docs.where("lang = 'en'").collect())
    a, b = lc.words_of(german)[:15], lc.words_of(english)[:15]
    got = [x[1] for x in lc.Labeller(model).labels(" ".join(a + b))]
    assert np.mean([x == "de" for x in got[:15]]) > 0.8 and np.mean([x == "en" for x in got[15:]]) > 0.8
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, ""), (4, english), (4, english), (None, english * 40)], "doc_id long, text string").selectExpr("*", "1 as score")
    rows = lc.predict(odd, model).collect()
    assert sorted(str(r.doc_id) for r in rows if r.lang_pred == "und") == ["1", "2", "3"] and sum(r.lang_pred == "en" for r in rows) == 3
    none = lc.fit(docs.where("lang = 'xx'"))
    assert none is None and {r.lang_pred for r in lc.predict(odd, none).collect()} == {"und"}
    assert lc.predict(odd.limit(0), model).count() == 0


def test_numerals_are_no_letters():
    assert lc.words_of("½ ² Ⅷ ① 12") == [] and lc.words_of("x² Äb½c") == ["x", "äb", "c"]


def test_short_or_long_texts_only_and_many_languages(spark):
    short = spark.createDataFrame([(1, "ja", "de"), (2, "oh", "en"), (None, "si", "es")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in lc.predict(short, lc.fit(short)).collect()} == {1: "de", 2: "en", None: "es"}
    long = spark.createDataFrame([(1, "der hund und " * 9_000, "de"), (2, "the dog and " * 9_000, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in lc.predict(long, lc.fit(long)).collect()} == {1: "de", 2: "en"}
    wordless = spark.createDataFrame([(1, "1 2 3", "xx")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lc.predict(wordless, lc.fit(wordless)).collect()] == ["und"]
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q" for _ in range(5)), f"l{k:03}") for k in range(70)] * 3
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lc.fit(many)
    assert len(model.langs) == 70
    got = lc.predict(many, model).join(many.distinct(), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lc, "SAMPLE_DOCS", 9)
    rows = spark.createDataFrame([(1, f"wort {k}", "de") for k in range(900)] + [(2, "dog", "en")] * 900, "id string, text string, lang string")
    sample = lc._sample(rows, {"de": 900, "en": 1})
    assert sum(y == "de" for _, y in sample) == 9 and sum(y == "en" for _, y in sample) == 1


def test_sequential_and_chunked_agree():
    rng = np.random.default_rng(2)
    k, lengths = 20, np.array([3, 70, 1])
    e, t = rng.normal(size=(74, k)), rng.normal(size=(k, k))
    whole = lc.forward_backward(e, t, lengths=lengths)
    lc.CHUNKED_LANGUAGES, before = 99, lc.CHUNKED_LANGUAGES
    try:
        assert np.allclose(lc.forward_backward(e, t, lengths=lengths), whole)
    finally:
        lc.CHUNKED_LANGUAGES = before


def test_features_of_many_words_are_those_of_each():
    words = ["a", "ab", "straße", "x" * 300, "été", "ab"]

    def listed(found, k):
        return [sorted(b[own == k].tolist()) for own, b in found]

    every, buckets = lc.Words(words).features(lc.FEATURES), lc.Words(words).buckets(lc.LEXICON)
    for k, w in enumerate(words):
        alone = lc.Words([w])
        assert listed(every, k) == listed(alone.features(lc.FEATURES), 0) and buckets[k] == alone.buckets(lc.LEXICON)[0]
    assert [len(x) for x in listed(every, 0)] == [2, 1, 1, 1, 0, 0, 0, 0] and listed(every, 1) == listed(every, 5)
    assert len(lc.Words([]).buckets(8)) == 0 and all(len(own) == 0 for own, _ in lc.Words([]).features(8))
