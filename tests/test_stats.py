"""Golden numbers and properties of the statistical functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abspark.functions import stats


@pytest.fixture(scope="module")
def sql(spark):
    stats.register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS r").first().r


def near(a, b):
    return math.isclose(a, b, rel_tol=0, abs_tol=1e-9)


def test_two_proportions(sql):
    two = sql("ab_result(1000, 100, 1000, 130, 95, 'Two-sided')")
    assert near(two.z_val, 2.102740605622114)
    assert near(two.p_val, 0.03548845046647475)
    assert two.significance == "SIGNIFICANT"
    assert two.details == "Variant B is better than Variant A by 30%."
    one = sql("ab_result(1000, 100, 1000, 130, 95, 'One-sided')")
    assert near(one.p_val, 0.017744225233237376)


@pytest.mark.parametrize("converted", [0, 1000])
def test_nobody_or_everybody_converted(sql, converted):
    r = sql(f"ab_result(1000, {converted}, 1000, {converted}, 95, 'Two-sided')")
    assert r.z_val is None and r.p_val is None
    assert r.significance == "NOT_SIGNIFICANT"
    assert r.details == "No significant difference."


def test_confidence_is_a_percent_in_the_proportion_test(sql):
    # 0.95 reads as 0.95 percent, so alpha is about 0.99
    assert sql("ab_result(100, 10, 100, 11, 0.95, 'Two-sided')").significance == "SIGNIFICANT"
    assert sql("ab_result(100, 10, 100, 11, 95, 'Two-sided')").significance == "NOT_SIGNIFICANT"


def test_unknown_hypothesis_is_two_sided_there_and_one_sided_here(sql):
    odd = sql("p_value_proportion(1000, 100, 1000, 130, 'odd')")
    assert near(odd, 0.03548845046647475)
    rate = sql("ab_rate_test(1000, 1000, 1000, 1100, 95, 'odd')")
    assert near(rate.p_val, 0.014578600704599522)


def test_rate_test(sql):
    log_form = sql("ab_rate_test(1000, 1000, 1000, 1100, 95, 'Two-sided')")
    assert near(log_form.z_val, 2.1813531636693972)
    assert near(log_form.p_val, 0.029157201409199043)
    difference = sql("ab_rate_test(1000, 0, 1000, 5, 95, 'Two-sided')")
    assert near(difference.z_val, 2.2360679774997894)
    assert near(difference.p_val, 0.02534723473672485)
    assert difference.significance == "SIGNIFICANT" and difference.details is None
    nothing = sql("ab_rate_test(1000, 0, 1000, 0, 95, 'Two-sided')")
    assert nothing.significance == "NOT_EVALUATED"
    assert nothing.details == "Insufficient information to evaluate."


def test_five_plays_against_one(sql):
    r = sql("ab_rate_test(100, 100, 100, 500, 95, 'Two-sided')")
    assert r.details == "Variant B has 400% higher Event Rate per unit than A."


def test_welch(sql):
    r = sql("ab_count_welch(100, 50, 400, 120, 55, 625, 95, 'Two-sided')")
    assert near(r.stat, 1.6477051091432693)
    assert near(r.df, 217.65788765911665)
    assert near(r.p_value, 0.09941316614680178)
    one = sql("ab_count_welch(100, 50, 400, 120, 55, 625, 95, 'One-sided')")
    assert near(one.p_value, 0.04970658307340089)
    assert one.details == "Variant B is 10% better than Variant A."


def test_welch_with_unknown_variance_is_not_evaluated(sql):
    r = sql("ab_count_welch(1, 50, NULL, 120, 55, 625, 95, 'Two-sided')")
    assert r.stat is None and r.significance == "NOT_EVALUATED"


def test_distribution_function_against_erfc(spark):
    stats.register(spark)
    xs = [i / 8 for i in range(-80, 81)]
    rows = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select(
        "x", stats.normal_cdf(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("cdf")
    )
    for x, cdf in rows.collect():
        assert abs(cdf - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14


def test_both_tails_differ(sql):
    exact = sql("1 - normal_cdf(2.0, 0.0, 1.0)")
    polynomial = sql("normal_tail_poly(2.0)")
    assert 1e-10 < abs(exact - polynomial) < 1e-6


def test_normalizers(sql):
    assert sql("normalize_confidence(NULL)") == 0.95
    assert sql("normalize_confidence(95)") == 0.95
    assert sql("normalize_confidence(0.9)") == 0.9
    assert sql("normalize_confidence(1000)") == 0.999999999
    assert sql("normalize_confidence(-3)") == 1e-9
    assert sql("normalize_hypothesis(' Two_Sided ')") == "two-sided"
    assert sql("normalize_hypothesis(NULL)") == "one-sided"


counts = st.integers(min_value=1, max_value=5000)


@settings(max_examples=10, deadline=None)
@given(rows=st.lists(st.tuples(counts, counts, counts, counts), min_size=1, max_size=30))
def test_swapping_arms_negates_z_and_keeps_two_sided_p(spark, rows):
    stats.register(spark)
    rows = [tuple(map(float, (na + ca, ca, nb + cb, cb))) for na, ca, nb, cb in rows]
    df = spark.createDataFrame(rows, "na DOUBLE, ca DOUBLE, nb DOUBLE, cb DOUBLE")
    a, b = ("na", "ca"), ("nb", "cb")
    ahead = [F.col(c) for c in (*a, *b)]
    swapped = [F.col(c) for c in (*b, *a)]
    two = F.lit("Two-sided")
    got = df.select(
        stats.z_score_proportion(*ahead).alias("z"),
        stats.z_score_proportion(*swapped).alias("zs"),
        stats.p_value_proportion(*ahead, two).alias("p"),
        stats.p_value_proportion(*swapped, two).alias("ps"),
    )
    for z, zs, p, ps in got.collect():
        assert math.isclose(z, -zs, abs_tol=1e-9)
        assert math.isclose(p, ps, abs_tol=1e-9)
        assert 0 <= p <= 1
