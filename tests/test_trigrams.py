"""Trigrams as numbers."""

from collections import Counter

from plumbline.operators import languages as LA


def test_numbers_of_trigrams_are_in_their_order(spark):
    found = sorted({s[i : i + 3] for s in ("über alles 日本語だ", " a𝔸b ") for i in range(len(s) - 2)})
    keys = [int(LA.trigrams(g)[0]) for g in found]
    assert keys == sorted(keys) and len(LA.trigrams("ab")) == 0
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", LA.spelled("k").alias("g")).collect()
    assert {r.k: r.g for r in got} == dict(zip(keys, found))


def test_profile_counts_once_and_equals_plain(spark):
    rows = spark.createDataFrame([("en", "the cat, the hat"), ("de", "die Katze"), ("de", None), (None, "zzz zzz")], "lang string, text string")
    plain = Counter(s[i : i + 3] for s in (" the cat the hat ", " die katze ") for i in range(len(s) - 2))
    want = sorted(plain, key=lambda g: (-plain[g], g))[:5]
    made = LA.profiles(rows, grams=5)
    assert {r.gram for r in made.collect()} == set(want)
    assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
