"""What a task holds, whatever the tables' sizes."""

import numpy as np
import pandas as pd

from plumbline import registry
from plumbline.operators import clusters as C
from plumbline.operators import judgments as J
from plumbline.sources import reviews as R


def test_answers_are_put_in_a_row_where_they_are_made(spark, sf):
    df = registry.QUERIES["mock_answers_wide"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Aggregate" not in plan.split("MapInPandas")[0] and "text#" not in plan.split("Relation")[0]
    want = J.wide(J.judge(R.reviews(spark, sf)))
    assert df.schema.simpleString() == want.schema.simpleString()
    got = df.collect()
    assert len(got) == R.read(spark, sf, "events").count() and set(got) == set(want.collect())


def test_a_batch_of_odd_answers_equals_the_general_form(spark):
    rows = [
        (1, "topic", "choice", None, "joke_meme", {"off_topic": 0.25, "joke_meme": 0.5}, 0.5),
        (2, "topic", "choice", None, None, None, None),
        (2, "spam_promo", "noul", 0.25, None, None, None),
        (2, "spam_promo", "noul", 0.75, None, None, None),
        (3, "rating_support", "score", None, None, {"0": None, "1": 1.0}, 0.25),
        (4, "other", "noul", 1.0, None, None, None),
    ]
    names = ["id", "question", "type", "value", "choice", "probabilities", "confidence"]
    backend = lambda ids: pd.DataFrame([r for r in rows if r[0] in ids], columns=names)
    got = J.judge_wide(spark.range(1, 7).coalesce(1), backend)
    want = J.wide(spark.createDataFrame(rows, J.ANSWER))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4
    assert J.judge_wide(spark.range(0), backend).count() == 0


def test_texts_are_encoded_some_at_a_time(spark):
    texts = ["a" * 400_000] * 8 + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").coalesce(1)
    seen = C.embed(df, lambda some: np.full((len(some), 2), len(some))).collect()
    assert [r.text for r in seen] == texts and max(r.embedding[0] for r in seen) <= 4
    assert C.embed(df.limit(0)).count() == 0
    got = C.embed(spark.createDataFrame([("one two two",), (None,)], "text string")).collect()
    assert np.allclose([r.embedding for r in got], C.hash_embedder(["one two two", ""]))


def test_terms_are_not_brought_together_by_cluster(spark, monkeypatch):
    plans, landed = [], C.landed
    monkeypatch.setattr(C, "landed", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or landed(df, name))
    docs = spark.createDataFrame([("de" if k % 2 else None, f"wort{k % 7} wort{k % 5} fest") for k in range(400)], "lang string, text string")
    out = C.top_phrases(docs, "lang")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join [" in line and "_c#" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins) and out.count() == 12
