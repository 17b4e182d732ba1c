"""The statistical functions over experiments derived from ``lineitem`` and ``part``.

Every part is one experiment: its open lines are arm A, its finished lines arm B; a
returned line is a conversion, the quantity its value. Quantities are whole numbers, so
sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from abspark.functions import stats
from catalog.registry import query
from catalog.views import table

# ---------------------------------------------------------------- formulas in SQL
# Fixed values, written out again so that a slip in the library shows: Abramowitz & Stegun
# 26.2.17, and Hart 1968 as given by West 2005.
TAIL_SCALE = 0.2316419
TAIL_COEFFICIENTS = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
DENSITY_AT_ZERO = 0.3989422804014327
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


def horner(x: str, coefficients: list[float]) -> str:
    text = f"{coefficients[-1]!r}"
    for c in reversed(coefficients[:-1]):
        text = f"({c!r} + {x} * {text})"
    return text


def hart_sql(a: str) -> str:
    """Upper tail beyond a >= 0."""
    ratio = f"{horner(a, HART_NUMERATOR)} / {horner(a, HART_DENOMINATOR)}"
    chain = f"({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65)))))"
    return f"""CASE WHEN {a} > {HART_FAR} THEN 0.0
        WHEN {a} < {HART_SWITCH} THEN exp(-0.5 * {a} * {a}) * {ratio}
        WHEN {a} IS NOT NULL THEN exp(-0.5 * {a} * {a}) / {SQRT_TWO_PI} / {chain} END"""


def phi_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1 - ({hart_sql(f'({x})')}) ELSE {hart_sql(f'(-({x}))')} END"


def poly_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + {TAIL_SCALE} * abs({x})))"
    return (
        f"({DENSITY_AT_ZERO} * exp(-0.5 * {x} * {x}) * {t} * {horner(t, TAIL_COEFFICIENTS)})"
    )


def p_sql(z: str) -> str:
    return f"""CASE WHEN hypothesis = 'One-sided' THEN 1 - ({phi_sql(z)})
        ELSE 2 * (1 - ({phi_sql(f'abs({z})')})) END"""


def lift_sql(winner: str, loser: str, digits: int) -> str:
    lift = f"round(100 * (({winner} - {loser}) / nullif({loser}, 0)), {digits})"
    return rf"regexp_replace(CAST({lift} AS VARCHAR), '\.0$', '')"


CONFIDENCE = "CASE id % 3 WHEN 0 THEN 50.0 WHEN 1 THEN 80.0 ELSE 95.0 END"
HYPOTHESIS = """CASE id % 5 WHEN 0 THEN 'Two-sided' WHEN 1 THEN 'One-sided'
    WHEN 2 THEN ' two_sided' WHEN 3 THEN 'Two Sided' END"""
SIDE = """CASE WHEN lower(trim(hypothesis)) IN ('two-sided', 'two sided', 'two_sided')
    THEN 'two' ELSE 'one' END"""
LEVEL = """CASE WHEN confidence IS NULL THEN 0.95
    WHEN confidence > 1 THEN least(confidence / 100, 0.999999999)
    ELSE least(greatest(confidence, 1e-9), 0.999999999) END"""

ARMS_SQL = f"""
arms AS (SELECT *, {CONFIDENCE}::DOUBLE AS confidence, {HYPOTHESIS} AS hypothesis,
    sa / nullif(na, 0) AS ma, (qa - sa * sa / nullif(na, 0)) / nullif(na - 1, 0) AS va,
    sb / nullif(nb, 0) AS mb, (qb - sb * sb / nullif(nb, 0)) / nullif(nb - 1, 0) AS vb
  FROM (SELECT l_partkey AS id,
    count(*) FILTER (l_linestatus = 'O') AS na, count(*) FILTER (l_linestatus = 'F') AS nb,
    count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS ca,
    count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R' AND l_quantity > 12) AS cb,
    CAST(sum(l_quantity) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS BIGINT) AS xa,
    CAST(sum(l_quantity) FILTER (l_linestatus = 'F' AND l_returnflag = 'R' AND l_quantity > 30)
      AS BIGINT) AS xb,
    sum(l_quantity) FILTER (l_linestatus = 'O') AS sa,
    sum(l_quantity * l_quantity) FILTER (l_linestatus = 'O') AS qa,
    sum(l_quantity + 4) FILTER (l_linestatus = 'F') AS sb,
    sum((l_quantity + 4) * (l_quantity + 4)) FILTER (l_linestatus = 'F') AS qb
  FROM lineitem GROUP BY l_partkey))
"""


def arms(spark, sf_dir):
    """One row per part with the counts, sums and moments of both arms."""
    stats.register(spark)
    lines = table(spark, sf_dir, "lineitem")
    open_, done = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    returned, q = F.col("l_returnflag") == "R", F.col("l_quantity")
    sums = lines.groupBy(F.col("l_partkey").alias("id")).agg(
        F.count_if(open_).alias("na"),
        F.count_if(done).alias("nb"),
        F.count_if(open_ & returned).alias("ca"),
        F.count_if(done & returned & (q > 12)).alias("cb"),
        F.sum(F.when(open_ & returned, q)).cast("bigint").alias("xa"),
        F.sum(F.when(done & returned & (q > 30), q)).cast("bigint").alias("xb"),
        F.sum(F.when(open_, q)).alias("sa"),
        F.sum(F.when(open_, q * q)).alias("qa"),
        F.sum(F.when(done, q + 4)).alias("sb"),
        F.sum(F.when(done, (q + 4) * (q + 4))).alias("qb"),
    )
    return sums.selectExpr(
        "*",
        "double(CASE id % 3 WHEN 0 THEN 50.0 WHEN 1 THEN 80.0 ELSE 95.0 END) AS confidence",
        f"{HYPOTHESIS} AS hypothesis",
        "try_divide(sa, na) AS ma",
        "try_divide(qa - try_divide(sa * sa, na), na - 1) AS va",
        "try_divide(sb, nb) AS mb",
        "try_divide(qb - try_divide(sb * sb, nb), nb - 1) AS vb",
    )


Z_SQL = f"""WITH {ARMS_SQL}, rates AS (
  SELECT *, ca / nullif(na, 0) AS ra, cb / nullif(nb, 0) AS rb,
    (ca + cb) / nullif(na + nb, 0) AS pooled FROM arms),
zs AS (SELECT *, CASE WHEN na > 0 AND nb > 0 AND ca + cb > 0 AND ca + cb < na + nb
    THEN (rb - ra) / sqrt(pooled * (1 - pooled) * (1.0 / na + 1.0 / nb)) END AS z FROM rates),
ps AS (SELECT *, {p_sql('z')} AS p FROM zs)
"""


def doubles(*names):
    return [F.col(n).cast("double") for n in names]


@query("z_score_proportion", f"{Z_SQL} SELECT id, round(z, 6) AS z FROM ps")
def _(spark, sf_dir):
    z = stats.z_score_proportion(*doubles("na", "ca", "nb", "cb"))
    return arms(spark, sf_dir).select("id", F.round(z, 6).alias("z"))


@query(
    "normal_cdf",
    f"""SELECT p_partkey, round({phi_sql('x')}, 9) AS cdf
    FROM (SELECT p_partkey, (p_size * 1.0 - 25.5) / 3.5 AS x FROM part)""",
)
def _(spark, sf_dir):
    stats.register(spark)
    cdf = stats.normal_cdf(F.col("p_size").cast("double"), F.lit(25.5), F.lit(3.5))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(cdf, 9).alias("cdf"))


@query("p_value_proportion", f"{Z_SQL} SELECT id, round(p, 6) AS p FROM ps")
def _(spark, sf_dir):
    p = stats.p_value_proportion(*doubles("na", "ca", "nb", "cb"), F.col("hypothesis"))
    return arms(spark, sf_dir).select("id", F.round(p, 6).alias("p"))


def rounded_struct(df, result, digits=6):
    """The fields of a test result as columns, numbers rounded."""
    flat = df.select("id", result.alias("r")).select("id", "r.*")
    return flat.select(
        *[
            F.round(c, digits).alias(c) if t == "double" else F.col(c)
            for c, t in flat.dtypes
        ]
    )


@query(
    "ab_result",
    f"""{Z_SQL} SELECT id, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b,
    round(z, 6) AS z_val, round(p, 6) AS p_val,
    CASE WHEN p < 1 - confidence / 100 THEN 'SIGNIFICANT' ELSE 'NOT_SIGNIFICANT' END
      AS significance,
    CASE WHEN p < 1 - confidence / 100 AND ra > rb THEN
        'Variant A is better than Variant B by ' || {lift_sql('ra', 'rb', 2)} || '%.'
      WHEN p < 1 - confidence / 100 AND rb > ra THEN
        'Variant B is better than Variant A by ' || {lift_sql('rb', 'ra', 2)} || '%.'
      ELSE 'No significant difference.' END AS details FROM ps""",
)
def _(spark, sf_dir):
    result = stats.ab_result(
        *doubles("na", "ca", "nb", "cb"), F.col("confidence"), F.col("hypothesis")
    )
    return rounded_struct(arms(spark, sf_dir), result)


T_SQL = f"""WITH {ARMS_SQL}, ts AS (SELECT *, CASE WHEN na <= 0 OR nb <= 0 THEN NULL
    WHEN coalesce(va / nullif(na, 0), 0) + coalesce(vb / nullif(nb, 0), 0) > 0 THEN
      (mb - ma) / sqrt(coalesce(va / nullif(na, 0), 0) + coalesce(vb / nullif(nb, 0), 0))
    END AS t FROM arms)
"""
MOMENTS = ("na", "ma", "va", "nb", "mb", "vb")


@query("t_statistic_value", f"{T_SQL} SELECT id, round(t, 6) AS t FROM ts")
def _(spark, sf_dir):
    t = stats.t_statistic_value(*doubles(*MOMENTS))
    return arms(spark, sf_dir).select("id", F.round(t, 6).alias("t"))


@query("p_value_value", f"{T_SQL} SELECT id, round({p_sql('t')}, 4) AS p FROM ts")
def _(spark, sf_dir):
    p = stats.p_value_value(*doubles(*MOMENTS), F.col("hypothesis"))
    return arms(spark, sf_dir).select("id", p.alias("p"))


@query(
    "rate_of_change",
    f"""WITH {ARMS_SQL} SELECT id, round((mb - ma) / nullif(ma, 0) * 100, 6) AS change
    FROM arms""",
)
def _(spark, sf_dir):
    change = stats.rate_of_change(F.col("ma"), F.col("mb"))
    return arms(spark, sf_dir).select("id", F.round(change, 6).alias("change"))


def side_p_sql(stat: str) -> str:
    return f"""CASE WHEN {stat} IS NULL THEN NULL WHEN {SIDE} = 'two' THEN 2 * {poly_sql(stat)}
        WHEN {stat} >= 0 THEN {poly_sql(stat)} ELSE 1 - {poly_sql(stat)} END"""


WELCH_SQL = f"""WITH {ARMS_SQL}, errors AS (SELECT *,
    CASE WHEN va IS NOT NULL THEN greatest(va, 0) END / greatest(na, 1) AS ea,
    CASE WHEN vb IS NOT NULL THEN greatest(vb, 0) END / greatest(nb, 1) AS eb FROM arms),
ts AS (SELECT *, CASE WHEN ea + eb > 0 THEN (mb - ma) / sqrt(ea + eb) END AS t,
    (ea + eb) * (ea + eb) / nullif(ea * ea / nullif(greatest(na, 1) - 1, 0)
      + eb * eb / nullif(greatest(nb, 1) - 1, 0), 0) AS df,
    1 - {LEVEL} AS alpha FROM errors),
ps AS (SELECT *, {side_p_sql('t')} AS p FROM ts)
SELECT id, round(ma, 6) AS metric_a, round(mb, 6) AS metric_b, round(t, 6) AS stat,
  round(df, 6) AS df, round(p, 6) AS p_value,
  CASE WHEN t IS NULL THEN 'NOT_EVALUATED' WHEN p < alpha THEN 'SIGNIFICANT'
    ELSE 'NOT_SIGNIFICANT' END AS significance,
  CASE WHEN t IS NULL THEN 'Insufficient information.'
    WHEN p < alpha AND mb > ma THEN 'Variant B is ' || {lift_sql('mb', 'ma', 1)}
      || '% better than Variant A.'
    WHEN p < alpha AND ma > mb THEN 'Variant A is ' || {lift_sql('ma', 'mb', 1)}
      || '% better than Variant B.'
    WHEN p < alpha THEN 'No difference.' ELSE 'No significant difference.' END AS details
FROM ps"""


@query("ab_count_welch", WELCH_SQL)
def _(spark, sf_dir):
    result = stats.ab_count_welch(
        *[F.col(c) for c in MOMENTS], F.col("confidence"), F.col("hypothesis")
    )
    return rounded_struct(arms(spark, sf_dir), result)


RATE_SQL = f"""WITH {ARMS_SQL}, counts AS (SELECT id, confidence, hypothesis,
    greatest(na, 1)::DOUBLE AS n1, greatest(nb, 1)::DOUBLE AS n2,
    CASE WHEN xa IS NOT NULL THEN greatest(xa, 0)::DOUBLE END AS x1,
    CASE WHEN xb IS NOT NULL THEN greatest(xb, 0)::DOUBLE END AS x2
    FROM (SELECT * REPLACE (CASE WHEN id % 4 > 0 THEN coalesce(xa, 0) ELSE xa END AS xa,
      CASE WHEN id % 4 > 0 THEN coalesce(xb, 0) ELSE xb END AS xb) FROM arms)),
rates AS (SELECT *, x1 / n1 AS ra, x2 / n2 AS rb, 1 - {LEVEL} AS alpha FROM counts),
zs AS (SELECT *, CASE WHEN x1 > 0 AND x2 > 0 THEN ln(rb / ra) / sqrt(1.0 / x1 + 1.0 / x2)
    WHEN ra / n1 + rb / n2 > 0 THEN (rb - ra) / sqrt(ra / n1 + rb / n2) END AS z FROM rates),
ps AS (SELECT *, {side_p_sql('z')} AS p FROM zs)
SELECT id, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(z, 6) AS z_val,
  round(p, 6) AS p_val,
  CASE WHEN z IS NULL THEN 'NOT_EVALUATED' WHEN p < alpha THEN 'SIGNIFICANT'
    ELSE 'NOT_SIGNIFICANT' END AS significance,
  CASE WHEN z IS NULL THEN 'Insufficient information to evaluate.'
    WHEN p < alpha AND rb > ra THEN 'Variant B has ' || {lift_sql('rb', 'ra', 1)}
      || '% higher Event Rate per unit than A.'
    WHEN p < alpha AND ra > rb THEN 'Variant A has ' || {lift_sql('ra', 'rb', 1)}
      || '% higher Event Rate per unit than B.'
    WHEN p < alpha THEN 'No difference.' ELSE 'No significant difference.' END AS details
FROM ps"""


@query("ab_rate_test", RATE_SQL)
def _(spark, sf_dir):
    def count(c):  # three quarters of the experiments read a missing sum as 0
        return F.when(F.col("id") % 4 > 0, F.coalesce(c, F.lit(0))).otherwise(F.col(c))

    result = stats.ab_rate_test(
        F.col("na"), count("xa"), F.col("nb"), count("xb"),
        F.col("confidence"), F.col("hypothesis"),
    )
    return rounded_struct(arms(spark, sf_dir), result)


PART_LEVEL = """CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size * 1.0
    WHEN 2 THEN p_size / 100.0 WHEN 3 THEN p_retailprice - 900 END"""


@query(
    "normalize_confidence",
    f"""SELECT p_partkey, round({LEVEL}, 9) AS level
    FROM (SELECT p_partkey, CAST({PART_LEVEL} AS DOUBLE) AS confidence FROM part)""",
)
def _(spark, sf_dir):
    stats.register(spark)
    level = stats.normalize_confidence(F.expr(f"CAST({PART_LEVEL} AS DOUBLE)"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(level, 9).alias("level"))


PART_HYPOTHESIS = """CASE p_size % 7 WHEN 0 THEN 'Two-sided' WHEN 1 THEN 'One-sided'
    WHEN 2 THEN ' TWO SIDED ' WHEN 3 THEN 'two_sided' WHEN 4 THEN 'twosided'
    WHEN 5 THEN '' END"""


@query(
    "normalize_hypothesis",
    f"""SELECT p_partkey, CASE {SIDE} WHEN 'two' THEN 'two-sided' ELSE 'one-sided' END
    AS hypothesis FROM (SELECT p_partkey, {PART_HYPOTHESIS} AS hypothesis FROM part)""",
)
def _(spark, sf_dir):
    stats.register(spark)
    side = stats.normalize_hypothesis(F.expr(PART_HYPOTHESIS))
    return table(spark, sf_dir, "part").select("p_partkey", side.alias("hypothesis"))


@query(
    "normal_tail_poly",
    f"""SELECT p_partkey, round({poly_sql('x')}, 9) AS tail
    FROM (SELECT p_partkey, (p_size - 25) / 4.0 AS x FROM part)""",
)
def _(spark, sf_dir):
    stats.register(spark)
    tail = stats.normal_tail_poly((F.col("p_size") - 25) / 4.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tail, 9).alias("tail"))
