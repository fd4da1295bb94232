"""Values that are equal but for rounding."""

import datetime as dt

from plumbline.operators import clusters as C
from plumbline.operators import drilldown as I


def test_scales_of_equal_concentration_give_the_first(spark):
    start = dt.datetime(2024, 4, 1)
    members = spark.createDataFrame([(1, start + dt.timedelta(hours=h)) for h in (0, 0.1, 3, 6, 9, 12, 15, 18)], "cluster long, created_at timestamp_ntz")
    scales = C.Suspicion().scales_hours
    means = {0.25: 23 / 24, 24: 7 - 7 / 24}  # two of eight and all eight: one less a 24th of what is expected
    expected = spark.createDataFrame([(8, float(h), means.get(h, 100.0)) for h in scales], "size long, hours double, expected double")
    found = C.time_concentration(members, expected).first()
    assert abs(found["concentration"] - 1 / 24) < 1e-12 and (found["hours"], found["count"]) == (0.25, 2)


def test_halves_of_a_percent_follow_exact_means(spark):
    shares = [0.517, 0.121, 0.344, 0.03, 0.963]  # 39.5 %, but their plain sum is below
    assert sum(shares) / 5 * 100 < 39.5
    got = spark.createDataFrame([(x,) for x in shares], "x double").coalesce(1).agg(I.exact_mean(C.F.col("x")).alias("m")).first().m
    assert got * 100 == 39.5
