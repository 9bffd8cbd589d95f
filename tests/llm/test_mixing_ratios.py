import math

import pytest

from palimpsest.llm import mixing


@pytest.mark.parametrize("share", [2.5, 1.8, 0.4])
def test_dual_with_one_very_long_document(spark, share):
    sizes = {3: 100_000, 300: 100_000, 1_000_000: 1}  # the largest is over 300,000 times the smallest
    total = sum(k * n for k, n in sizes.items())
    counts = spark.createDataFrame([("s", k, n) for k, n in sizes.items()], "h_source string, size long, n long")
    wanted = spark.createDataFrame([("s", total, share * total, 1e6)], "source string, source_size long, target double, unit double")
    lam = mixing.solve(counts, wanted).first().lam
    assert sum(n * k * min(3, math.exp(min(lam * k / 1e6, 50))) for k, n in sizes.items()) == pytest.approx(share * total, rel=1e-6)


def test_targets_are_met_with_one_very_long_document(spark):
    rows = [(i, "a", "w " * 10) for i in range(40_000)] + [(40_000, "a", "w " * 110_000)] + [(50_000 + i, "b", "w " * 300) for i in range(4250)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, weights=(2.5, 1.0)).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 300, r
