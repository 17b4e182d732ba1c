"""Significance tests as Spark SQL functions.

Each test is a small SQL function built from smaller ones. Spark inlines them into the
calling plan, evaluating every argument once, so a test over a whole table of
experiments stays a projection in generated code: no Python worker, no join.
``register(spark)`` makes the names usable from SQL; the Python functions below wrap them
for the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Names and texts of the result columns.
SIGNIFICANT = "SIGNIFICANT"
NOT_SIGNIFICANT = "NOT_SIGNIFICANT"
NOT_EVALUATED = "NOT_EVALUATED"
NO_SIGNIFICANT_DIFFERENCE = "No significant difference."
NO_DIFFERENCE = "No difference."
WELCH_INSUFFICIENT = "Insufficient information."
RATE_INSUFFICIENT = "Insufficient information to evaluate."
ONE_SIDED = "One-sided"
TWO_SIDED_SPELLINGS = ["two-sided", "two sided", "two_sided"]

# Abramowitz & Stegun 26.2.17, upper tail of the normal distribution.
TAIL_SCALE = 0.2316419
TAIL_COEFFICIENTS = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
DENSITY_AT_ZERO = 0.3989422804014327

# Hart 1968 as given by West 2005, upper tail in double precision.
HART_NUMERATOR = [
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 3.52624965998911e-02,
]
HART_DENOMINATOR = [
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02,
]
HART_SWITCH = 7.07106781186547
HART_FAR = 37.0
SQRT_TWO_PI = 2.506628274631


def _polynomial(variable: str, coefficients: list[float]) -> str:
    """Horner form, constant term first."""
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({c!r}D + {variable} * {text})"
    return text


def _lift(winner: str, loser: str, digits: int) -> str:
    """Percent by which the winner lies above the loser, as text; NULL for loser 0."""
    return (
        f"float_text(round(100D * try_divide({winner} - {loser}, {loser}), {digits}))"
    )


_SPELLINGS = ", ".join(f"'{s}'" for s in TWO_SIDED_SPELLINGS)
_WIDEST = "0.999999999D"

# name -> (parameters, return type, body); later ones may use earlier ones.
DEFINITIONS: dict[str, tuple[str, str, str]] = {
    "float_text": (
        "x DOUBLE",
        "STRING",
        """CASE WHEN isnan(x) THEN 'nan'
            WHEN abs(x) = double('infinity') THEN IF(x > 0, 'inf', '-inf')
            WHEN contains(string(x), 'E') AND abs(x) BETWEEN 1e-4D AND 1e15D
            THEN regexp_replace(regexp_replace(
                string(try_cast(string(x) AS DECIMAL(38, 21))), '0+$', ''), '[.]$', '')
            ELSE regexp_replace(string(x), '[.]0$', '') END""",
    ),
    "at_least": (
        "x DOUBLE, bound DOUBLE",
        "DOUBLE",
        "CASE WHEN x IS NOT NULL AND bound IS NOT NULL THEN greatest(x, bound) END",
    ),
    "tail_series": ("t DOUBLE", "DOUBLE", f"t * {_polynomial('t', TAIL_COEFFICIENTS)}"),
    "normal_tail_poly": (
        "x DOUBLE",
        "DOUBLE",
        f"""{DENSITY_AT_ZERO!r}D * exp(-0.5D * x * x)
            * tail_series(1D / (1D + {TAIL_SCALE!r}D * abs(x)))""",
    ),
    "hart_tail": (
        "a DOUBLE",
        "DOUBLE",
        f"""CASE WHEN a > {HART_FAR!r}D THEN 0D
            WHEN a < {HART_SWITCH!r}D
            THEN exp(-0.5D * a * a) * {_polynomial('a', HART_NUMERATOR)}
                / {_polynomial('a', HART_DENOMINATOR)}
            WHEN a IS NOT NULL
            THEN exp(-0.5D * a * a) / {SQRT_TWO_PI!r}D
                / (a + 1D / (a + 2D / (a + 3D / (a + 4D / (a + 0.65D))))) END""",
    ),
    "std_normal_cdf": (
        "x DOUBLE",
        "DOUBLE",
        "CASE WHEN x > 0D THEN 1D - hart_tail(x) ELSE hart_tail(-x) END",
    ),
    "normal_cdf": (
        "x DOUBLE, mean DOUBLE, std DOUBLE",
        "DOUBLE",
        "std_normal_cdf(try_divide(x - mean, std))",
    ),
    "normalize_confidence": (
        "confidence DOUBLE",
        "DOUBLE",
        f"""CASE WHEN confidence IS NULL THEN 0.95D
            WHEN confidence > 1D THEN least(confidence / 100D, {_WIDEST})
            ELSE least(greatest(confidence, 1e-9D), {_WIDEST}) END""",
    ),
    "normalize_hypothesis": (
        "hypothesis STRING",
        "STRING",
        f"""CASE WHEN lower(trim(hypothesis)) IN ({_SPELLINGS})
            THEN 'two-sided' ELSE 'one-sided' END""",
    ),
    # -- two proportions, pooled z
    "pooled_z": (
        "na DOUBLE, nb DOUBLE, rate_a DOUBLE, rate_b DOUBLE, pooled DOUBLE",
        "DOUBLE",
        """CASE WHEN pooled > 0D AND pooled < 1D
            THEN (rate_b - rate_a) / sqrt(pooled * (1D - pooled) * (1D / na + 1D / nb))
            END""",
    ),
    "z_score_proportion": (
        "na DOUBLE, ca DOUBLE, nb DOUBLE, cb DOUBLE",
        "DOUBLE",
        """CASE WHEN na > 0D AND nb > 0D
            THEN pooled_z(na, nb, try_divide(ca, na), try_divide(cb, nb),
                          try_divide(ca + cb, na + nb)) END""",
    ),
    "p_from_z": (
        "z DOUBLE, hypothesis STRING",
        "DOUBLE",
        f"""CASE WHEN hypothesis = '{ONE_SIDED}' THEN 1D - std_normal_cdf(z)
            ELSE 2D * (1D - std_normal_cdf(abs(z))) END""",
    ),
    "p_value_proportion": (
        "na DOUBLE, ca DOUBLE, nb DOUBLE, cb DOUBLE, hypothesis STRING",
        "DOUBLE",
        "p_from_z(z_score_proportion(na, ca, nb, cb), hypothesis)",
    ),
    "proportion_verdict": (
        "rate_a DOUBLE, rate_b DOUBLE, z DOUBLE, p DOUBLE, alpha DOUBLE",
        """STRUCT<rate_a: DOUBLE, rate_b: DOUBLE, z_val: DOUBLE, p_val: DOUBLE,
            significance: STRING, details: STRING>""",
        f"""named_struct('rate_a', rate_a, 'rate_b', rate_b, 'z_val', z, 'p_val', p,
            'significance',
            CASE WHEN p < alpha THEN '{SIGNIFICANT}' ELSE '{NOT_SIGNIFICANT}' END,
            'details',
            CASE WHEN p < alpha AND rate_a > rate_b
                THEN 'Variant A is better than Variant B by '
                    || {_lift('rate_a', 'rate_b', 2)} || '%.'
                WHEN p < alpha AND rate_b > rate_a
                THEN 'Variant B is better than Variant A by '
                    || {_lift('rate_b', 'rate_a', 2)} || '%.'
                ELSE '{NO_SIGNIFICANT_DIFFERENCE}' END)""",
    ),
    "ab_result_from_z": (
        """rate_a DOUBLE, rate_b DOUBLE, z DOUBLE, confidence DOUBLE,
            hypothesis STRING""",
        """STRUCT<rate_a: DOUBLE, rate_b: DOUBLE, z_val: DOUBLE, p_val: DOUBLE,
            significance: STRING, details: STRING>""",
        """proportion_verdict(rate_a, rate_b, z, p_from_z(z, hypothesis),
                              1D - confidence / 100D)""",
    ),
    "ab_result": (
        """na DOUBLE, ca DOUBLE, nb DOUBLE, cb DOUBLE, confidence DOUBLE,
            hypothesis STRING""",
        """STRUCT<rate_a: DOUBLE, rate_b: DOUBLE, z_val: DOUBLE, p_val: DOUBLE,
            significance: STRING, details: STRING>""",
        """ab_result_from_z(try_divide(ca, na), try_divide(cb, nb),
                            z_score_proportion(na, ca, nb, cb), confidence, hypothesis)""",
    ),
    # -- means, normal p
    "t_ratio": (
        "difference DOUBLE, squared_error DOUBLE",
        "DOUBLE",
        "CASE WHEN squared_error > 0D THEN difference / sqrt(squared_error) END",
    ),
    "t_statistic_value": (
        "na DOUBLE, ma DOUBLE, va DOUBLE, nb DOUBLE, mb DOUBLE, vb DOUBLE",
        "DOUBLE",
        """CASE WHEN na <= 0D OR nb <= 0D THEN NULL
            ELSE t_ratio(mb - ma, coalesce(try_divide(va, na), 0D)
                                  + coalesce(try_divide(vb, nb), 0D)) END""",
    ),
    "p_value_value": (
        """na DOUBLE, ma DOUBLE, va DOUBLE, nb DOUBLE, mb DOUBLE, vb DOUBLE,
            hypothesis STRING""",
        "DOUBLE",
        "round(p_from_z(t_statistic_value(na, ma, va, nb, mb, vb), hypothesis), 4)",
    ),
    "rate_of_change": (
        "before DOUBLE, after DOUBLE",
        "DOUBLE",
        "(after - before) / before * 100D",
    ),
    # -- tests with the polynomial tail
    "poly_p": (
        "stat DOUBLE, tail DOUBLE, side STRING",
        "DOUBLE",
        """CASE WHEN side = 'two-sided' THEN 2D * tail
            WHEN stat >= 0D THEN tail
            WHEN stat < 0D THEN 1D - tail END""",
    ),
    "welch_df": (
        "na DOUBLE, ea DOUBLE, nb DOUBLE, eb DOUBLE",
        "DOUBLE",
        """try_divide((ea + eb) * (ea + eb),
            try_divide(ea * ea, na - 1D) + try_divide(eb * eb, nb - 1D))""",
    ),
    "welch_verdict": (
        "ma DOUBLE, mb DOUBLE, t DOUBLE, df DOUBLE, p DOUBLE, alpha DOUBLE",
        """STRUCT<metric_a: DOUBLE, metric_b: DOUBLE, stat: DOUBLE, df: DOUBLE,
            p_value: DOUBLE, significance: STRING, details: STRING>""",
        f"""named_struct('metric_a', ma, 'metric_b', mb, 'stat', t, 'df', df,
            'p_value', p,
            'significance', CASE WHEN t IS NULL THEN '{NOT_EVALUATED}'
                WHEN p < alpha THEN '{SIGNIFICANT}' ELSE '{NOT_SIGNIFICANT}' END,
            'details', CASE WHEN t IS NULL THEN '{WELCH_INSUFFICIENT}'
                WHEN p < alpha AND mb > ma THEN 'Variant B is '
                    || {_lift('mb', 'ma', 1)} || '% better than Variant A.'
                WHEN p < alpha AND ma > mb THEN 'Variant A is '
                    || {_lift('ma', 'mb', 1)} || '% better than Variant B.'
                WHEN p < alpha THEN '{NO_DIFFERENCE}'
                ELSE '{NO_SIGNIFICANT_DIFFERENCE}' END)""",
    ),
    "welch_from_t": (
        """ma DOUBLE, mb DOUBLE, t DOUBLE, df DOUBLE, confidence DOUBLE,
            hypothesis STRING""",
        """STRUCT<metric_a: DOUBLE, metric_b: DOUBLE, stat: DOUBLE, df: DOUBLE,
            p_value: DOUBLE, significance: STRING, details: STRING>""",
        """welch_verdict(ma, mb, t, df,
            poly_p(t, normal_tail_poly(t), normalize_hypothesis(hypothesis)),
            1D - normalize_confidence(confidence))""",
    ),
    "welch_from_errors": (
        """na DOUBLE, ma DOUBLE, ea DOUBLE, nb DOUBLE, mb DOUBLE, eb DOUBLE,
            confidence DOUBLE, hypothesis STRING""",
        """STRUCT<metric_a: DOUBLE, metric_b: DOUBLE, stat: DOUBLE, df: DOUBLE,
            p_value: DOUBLE, significance: STRING, details: STRING>""",
        """welch_from_t(ma, mb, t_ratio(mb - ma, ea + eb), welch_df(na, ea, nb, eb),
                        confidence, hypothesis)""",
    ),
    "ab_count_welch": (
        """na BIGINT, ma DOUBLE, va DOUBLE, nb BIGINT, mb DOUBLE, vb DOUBLE,
            confidence DOUBLE, hypothesis STRING""",
        """STRUCT<metric_a: DOUBLE, metric_b: DOUBLE, stat: DOUBLE, df: DOUBLE,
            p_value: DOUBLE, significance: STRING, details: STRING>""",
        """welch_from_errors(
            at_least(na, 1D), ma, at_least(va, 0D) / at_least(na, 1D),
            at_least(nb, 1D), mb, at_least(vb, 0D) / at_least(nb, 1D),
            confidence, hypothesis)""",
    ),
    "rate_z": (
        "na DOUBLE, xa DOUBLE, nb DOUBLE, xb DOUBLE, rate_a DOUBLE, rate_b DOUBLE",
        "DOUBLE",
        """CASE WHEN xa > 0D AND xb > 0D
            THEN ln(rate_b / rate_a) / sqrt(1D / xa + 1D / xb)
            ELSE t_ratio(rate_b - rate_a, rate_a / na + rate_b / nb) END""",
    ),
    "rate_verdict": (
        "rate_a DOUBLE, rate_b DOUBLE, z DOUBLE, p DOUBLE, alpha DOUBLE",
        """STRUCT<rate_a: DOUBLE, rate_b: DOUBLE, z_val: DOUBLE, p_val: DOUBLE,
            significance: STRING, details: STRING>""",
        f"""named_struct('rate_a', rate_a, 'rate_b', rate_b, 'z_val', z, 'p_val', p,
            'significance', CASE WHEN z IS NULL THEN '{NOT_EVALUATED}'
                WHEN p < alpha THEN '{SIGNIFICANT}' ELSE '{NOT_SIGNIFICANT}' END,
            'details', CASE WHEN z IS NULL THEN '{RATE_INSUFFICIENT}'
                WHEN p < alpha AND rate_b > rate_a THEN 'Variant B has '
                    || {_lift('rate_b', 'rate_a', 1)}
                    || '% higher Event Rate per unit than A.'
                WHEN p < alpha AND rate_a > rate_b THEN 'Variant A has '
                    || {_lift('rate_a', 'rate_b', 1)}
                    || '% higher Event Rate per unit than B.'
                WHEN p < alpha THEN '{NO_DIFFERENCE}'
                ELSE '{NO_SIGNIFICANT_DIFFERENCE}' END)""",
    ),
    "rate_from_z": (
        """rate_a DOUBLE, rate_b DOUBLE, z DOUBLE, confidence DOUBLE,
            hypothesis STRING""",
        """STRUCT<rate_a: DOUBLE, rate_b: DOUBLE, z_val: DOUBLE, p_val: DOUBLE,
            significance: STRING, details: STRING>""",
        """rate_verdict(rate_a, rate_b, z,
            poly_p(z, normal_tail_poly(z), normalize_hypothesis(hypothesis)),
            1D - normalize_confidence(confidence))""",
    ),
    "rate_from_counts": (
        """na DOUBLE, xa DOUBLE, nb DOUBLE, xb DOUBLE, confidence DOUBLE,
            hypothesis STRING""",
        """STRUCT<rate_a: DOUBLE, rate_b: DOUBLE, z_val: DOUBLE, p_val: DOUBLE,
            significance: STRING, details: STRING>""",
        """rate_from_z(xa / na, xb / nb, rate_z(na, xa, nb, xb, xa / na, xb / nb),
                       confidence, hypothesis)""",
    ),
    "ab_rate_test": (
        """na BIGINT, xa BIGINT, nb BIGINT, xb BIGINT, confidence DOUBLE,
            hypothesis STRING""",
        """STRUCT<rate_a: DOUBLE, rate_b: DOUBLE, z_val: DOUBLE, p_val: DOUBLE,
            significance: STRING, details: STRING>""",
        """rate_from_counts(at_least(na, 1D), at_least(xa, 0D),
                            at_least(nb, 1D), at_least(xb, 0D), confidence, hypothesis)""",
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session, once."""
    if spark.catalog.functionExists("ab_rate_test"):
        return
    for name, (parameters, returns, body) in DEFINITIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) "
            f"RETURNS {returns} RETURN {body}"
        )


def _call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def z_score_proportion(na, ca, nb, cb) -> Column:
    """Pooled two-proportion z, B minus A; NULL when nobody or everybody converted."""
    return _call("z_score_proportion", na, ca, nb, cb)


def normal_cdf(x, mean, std) -> Column:
    """Normal distribution function in double precision."""
    return _call("normal_cdf", x, mean, std)


def p_value_proportion(na, ca, nb, cb, hypothesis) -> Column:
    return _call("p_value_proportion", na, ca, nb, cb, hypothesis)


def t_statistic_value(na, ma, va, nb, mb, vb) -> Column:
    return _call("t_statistic_value", na, ma, va, nb, mb, vb)


def ab_result(na, ca, nb, cb, confidence, hypothesis) -> Column:
    """Two-proportion test as a struct; confidence is a percent."""
    return _call("ab_result", na, ca, nb, cb, confidence, hypothesis)


def p_value_value(na, ma, va, nb, mb, vb, hypothesis) -> Column:
    return _call("p_value_value", na, ma, va, nb, mb, vb, hypothesis)


def rate_of_change(before, after) -> Column:
    """Percent change; divides by ``before`` as it is."""
    return _call("rate_of_change", before, after)


def ab_count_welch(na, ma, va, nb, mb, vb, confidence, hypothesis) -> Column:
    """Welch test on means as a struct; p from the polynomial normal tail."""
    return _call("ab_count_welch", na, ma, va, nb, mb, vb, confidence, hypothesis)


def ab_rate_test(na, xa, nb, xb, confidence, hypothesis) -> Column:
    """Poisson-rate test: log rate ratio, or difference of rates when a count is 0."""
    return _call("ab_rate_test", na, xa, nb, xb, confidence, hypothesis)


def normalize_confidence(confidence) -> Column:
    return _call("normalize_confidence", confidence)


def normalize_hypothesis(hypothesis) -> Column:
    return _call("normalize_hypothesis", hypothesis)


def normal_tail_poly(x) -> Column:
    """Upper tail beyond |x|, five-term polynomial."""
    return _call("normal_tail_poly", x)
