import numpy as np

from plumbline.llm import toxicity as t
from plumbline.llm.common import crc_mod, table


def test_counts_and_ratios_equal_plain(spark):
    rows = [("you idiot you", 1), ("nice day", 0), ("idiot again", 1), ("a nice idea", 0), (None, 0), ("nice day", 0)]
    counts, totals = t.count_features(spark.createDataFrame(rows, "text string, label int").selectExpr("coalesce(text, '') text", "label"))
    want = np.zeros((2, t.BUCKETS))
    for text, label in rows:
        want[label][sorted(set(t.buckets_of(t.codes_of(text or "")).tolist()))] += 1
    assert (counts == want).all() and totals.tolist() == [4, 2]
    assert len(t.buckets_of(t.codes_of("abcd"))) == 4 + 3 + 2 + 1 and len(t.present("")) == 0


def test_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    learnt = crc_mod("doc_id", 4) != 2
    model = t.fit(docs.where(learnt), labels.where(learnt))
    held = t.predict(docs.where(~learnt), model).join(labels, "doc_id").collect()
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.02
    text = next(r.text for r in docs.join(labels, "doc_id").where("toxic = 1 AND text LIKE '%idiot%'").take(1))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, text), (3, text), (None, text * 30)], "doc_id long, text string").selectExpr("*", "7 as score")
    got = t.predict(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2)] == [1 / (1 + np.exp(-model.bias))] * 2
    assert all(r.predicted == 1 for r in got if r.doc_id == 3)
    assert t.predict(odd.limit(0), model).count() == 0


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    for marks, low, high in (([(1, 0), (2, None)], 0, 0.1), ([(1, 1)], 0.9, 1), ([], 0.4, 0.6)):
        model = t.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert all(low <= r.score <= high for r in t.predict(docs, model).collect())


def test_long_texts_in_slices_and_repeated_ids(spark, monkeypatch):
    text = " ".join(f"word{k} abc" for k in range(400))
    whole = t.present(text).tolist()
    monkeypatch.setattr(t, "CODES_AT_ONCE", 100)
    assert t.present(text).tolist() == whole
    monkeypatch.setattr(t, "SAMPLE_DOCS", 5)
    rows = [(1, f"you idiot {k}") for k in range(300)] + [(2 + k, f"nice day {k}") for k in range(60)]
    marks = [(1, 1)] + [(2 + k, 0) for k in range(60)]
    model = t.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert model.score("you idiot 7") > model.score("nice day 7")


def test_labels_of_documents_that_are_not_there(spark):
    """Labels may name far more ids than there are documents: those with documents are learned from all the same."""
    rows = [(k, f"you idiot {k} fool" if k % 2 else f"nice day {k} friend") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    others = spark.range(1000, 401_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    few, many = t.fit(docs, own), t.fit(docs, own.union(others))
    assert many.bias == few.bias and (many.weights == few.weights).all()
    assert [r.predicted for r in t.predict(docs, many).orderBy("doc_id").collect()] == [k % 2 for k in range(40)]
