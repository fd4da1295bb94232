"""Sketches travel with every pair that shares a band."""

from plumbline.operators import duplicates as D


def test_a_minimum_is_a_byte_and_equal_texts_stay_promising(spark):
    drawn = D.sketches(spark.createDataFrame([(1, "abcdefgh ijkl"), (2, "abcdefgh ijkl")], "rep long, norm string"))
    assert dict(drawn.dtypes)["signature"] == "array<tinyint>"
    side = lambda k, n: drawn.where(f"rep = {n}").selectExpr(f"size AS size_{k}", f"signature AS signature_{k}")
    assert side("x", 1).crossJoin(side("y", 2)).where(D.promising(D.Features())).count() == 1
