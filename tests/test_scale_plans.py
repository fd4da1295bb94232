"""Plans of queries over reviews: what passes which shuffle."""

import re

import pytest

from plumbline import registry
from plumbline.operators import attacks as A
from plumbline.sources import reviews as R
from plumbline.sources import sinks


def under(df, node):
    """Lines of the optimized plan that lie below the nodes of a name."""
    depth, out = None, []
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        at = len(re.match(r"[ :+-]*", line)[0])
        if depth is not None and at > depth:
            if "Relation [" not in line:  # all columns of a table, before those that are read
                out.append(line)
        else:
            depth = at if line[at:].startswith(node) else None
    return out


@pytest.mark.parametrize("name", ["export_decisions", "judge_states"])
def test_texts_join_after_the_numbering(spark, sf, name):
    assert not [x for x in under(registry.QUERIES[name](spark, sf), "Window") if "text#" in x]


@pytest.mark.parametrize("name", ["waves_by_heuristics", "identical_inputs", "question_sets", "preflight_tokens"])
def test_what_needs_no_ids_is_not_numbered(spark, sf, name):
    assert not under(registry.QUERIES[name](spark, sf), "Window")


@pytest.mark.parametrize("name", ["waves_by_heuristics"])
def test_texts_are_no_keys(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*text#", plan)


@pytest.mark.parametrize("name", ["review_page_unfiltered", "review_page_of_cluster", "tuning_set_shown", "changed_examples"])
def test_only_shown_texts_are_ordered(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert not [x for x in under(df, "GlobalLimit") if "text#" in x]


def test_sources_are_drawn_without_texts(spark, sf):
    assert not [x for x in under(registry.QUERIES["adversarial_sources"](spark, sf), "Window") if "Project" in x and "id#" in x and re.search(r", text#\d+", x)]


def test_runs_that_reuse_none_are_not_joined(spark):
    runs = spark.createDataFrame([(1, "model", None, 2.0), (2, "cached", 1, 0.5), (3, "cached", 9, 0.5), (4, "cached", None, 0.7), (5, None, 1, 0.9)], "id long, backend string, reuses long, cost double")
    out = A.charged(runs)
    assert {r.id: r.charged for r in out.collect()} == {1: 2.0, 2: 2.0, 3: 0.0, 4: 0.7, 5: 0.9}
    assert any("isnotnull(reuses" in x for x in under(out, "Join"))


def test_numbering_and_wanted_ids(spark, sf):
    every = {r.id: r.text for r in R.reviews(spark, sf).select("id", "text").collect()}
    assert sorted(every) == list(range(R.read(spark, sf, "events").count()))
    only = spark.createDataFrame([(3,), (17,)], "id long")
    assert {r.id: r.text for r in R.reviews(spark, sf, only=only).select("id", "text").collect()} == {k: every[k] for k in (3, 17)}


def test_chunks_move_a_text_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"me{i}@x.org") for i in range(25)], "id long, text string")
    decided = rows.where("id <> 7").select("id", (rows.id % 3).alias("code"))
    path = f"file://{tmp_path}/out"
    sinks.bundle(rows, path, 10, decided)
    got = {r.id: (r.chunk, r.text, r.code) for r in spark.read.json(path).collect()}
    assert got == {i: (i // 10, "[email]", None if i == 7 else i % 3) for i in range(25)}
    assert list(tmp_path.glob("out/chunk=2/*.json.gz"))
