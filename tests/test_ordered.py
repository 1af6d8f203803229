import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from connlens.operators.ordered import exact_percentile, running_totals
from connlens.operators.spread import hot_values, sized_join, spread_join
from helpers import rows


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("limit", [0, 10_000])
def test_running_totals_with_one_dominant_group(spark, descending, limit):
    # Two thirds of the rows are in group 'a'; one group is null.
    data = [("a" if i % 3 else ("b" if i % 2 else None), (i * 7919) % 1000, i) for i in range(600)]
    df = spark.createDataFrame(data, "g string, k int, v int").repartition(5)
    out = running_totals(df, ["k", "v"], {"total": "v", "n": F.lit(1)}, ["g"], descending, one_task_rows=limit)
    got = {(r["g"], r["k"], r["v"]): (r["total"], r["n"]) for r in out.collect()}
    want = {}
    for g in ("a", "b", None):
        total = 0
        for n, (_, k, v) in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1:], reverse=descending), 1):
            total += v
            want[(g, k, v)] = (total, n)
    assert got == want


def test_small_input_needs_no_distributed_steps(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "g string, k int")
    out = running_totals(df, ["k"], {"n": F.lit(1)}, ["g"], expect_small=True)
    assert rows(out) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([-1.5, 0.0, 0.25, 3.0, 7.5]) | st.floats(-5, 5), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.99, 1.0]))
def test_percentile_equals_numpy(spark, values, share):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
    assert exact_percentile(df, "x", share) == pytest.approx(float(np.percentile(values, share * 100)), abs=1e-12)


def test_percentile_with_a_value_holding_a_third_and_a_tight_limit(spark):
    values = [0.5] * 1000 + [((i * 2654435761) % 100003) / 100003 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    for share in (0.1, 0.4, 0.9):
        assert exact_percentile(df, "x", share, accuracy=50, keep=20) == pytest.approx(float(np.percentile(values, share * 100)), abs=1e-12)
    assert exact_percentile(df.limit(0), "x", 0.5) is None


@pytest.mark.parametrize("share", [0.3, 0.4949, 0.495, 0.4951, 0.5, 0.505, 0.5051, 0.7])
def test_percentile_between_two_heavy_ties(spark, share):
    values = [0.0] * 990 + [1 + i / 100 for i in range(20)] + [9.0] * 990
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    assert exact_percentile(df, "x", share, accuracy=20, keep=4) == pytest.approx(float(np.percentile(values, share * 100)), abs=1e-12)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "key string, v int").repartition(4)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "key string, w int")
    left = left.unionByName(spark.createDataFrame([(None, 1000 + i) for i in range(100)], left.schema))
    assert hot_values(left, "key") == ["hot", None]
    assert rows(spread_join(left, right, "key", how)) == rows(left.join(right, "key", how))
    assert rows(sized_join(left, right, "key", how)) == rows(left.join(right, "key", how))
    assert rows(sized_join(left, right, "key", how, limit=1)) == rows(left.join(right, "key", how))


def test_unsupported_join_type(spark):
    df = spark.createDataFrame([("a",)], "key string")
    with pytest.raises(ValueError):
        spread_join(df, df, "key", "full")
