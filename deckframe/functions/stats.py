"""Statistics on columns: intervals, tests and the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: Coefficients of Hart's rational approximation to the normal tail, highest power first.
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def tail_sql(x: str) -> str:
    """SQL for P(Z > |x|) in double precision, for either engine; ``x`` is a column name."""
    a = f"abs({x})"
    d = lambda v: v.replace("e-", "E-")
    small = d(f"exp(-{a} * {a} / 2) * {_horner(a, _TOP)} / {_horner(a, _LOW)}")
    b = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"
    large = f"exp(-{a} * {a} / 2) / {b} / 2.506628274631"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {small} ELSE {large} END"


def two_sided_p(x: str) -> Column:
    """Two-sided p-value of a standard normal column."""
    return F.least(F.lit(1.0), 2 * F.expr(tail_sql(x)).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(estimate, low, high) of a share; (0, 0, 1) without observations."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.struct(
        F.coalesce(p, F.lit(0.0)).alias("estimate"),
        F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)).alias("low"),
        F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0)).alias("high"),
    )


def balanced_accuracy(tp: Column, n_pos: Column, tn: Column, n_neg: Column) -> Column:
    """struct(estimate, low, high): the means of the two Wilson intervals."""
    a, b = wilson(tp, n_pos), wilson(tn, n_neg)
    return F.struct(*[((a[c] + b[c]) / 2).alias(c) for c in ("estimate", "low", "high")])


def kappa(both_yes: Column, both_no: Column, first_yes: Column, second_yes: Column, n: Column) -> Column:
    """Cohen's kappa of two raters from counts; 1 where chance alone agrees fully."""
    m = F.when(n > 0, n.cast("double"))
    seen = (both_yes + both_no) / m
    by_chance = (first_yes / m) * (second_yes / m) + (1 - first_yes / m) * (1 - second_yes / m)
    return F.when(by_chance == 1, F.lit(1.0)).otherwise((seen - by_chance) / F.when(by_chance != 1, 1 - by_chance))


def pearson(x: str, y: str) -> Column:
    """Aggregate: Pearson's r; 0 with fewer than two points or no variance."""
    n, sx, sy = F.count(F.lit(1)).cast("double"), F.sum(x), F.sum(y)
    cov = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - sx * sx, n * F.sum(F.col(y) * F.col(y)) - sy * sy
    return F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(F.lit(0.0), vx * vy))), F.lit(0.0))


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided binomial p of b and c discordant pairs; 1 without any."""
    n, k = b + c, F.least(b, c)
    start = F.struct((n * F.log(F.lit(0.5))).alias("term"), F.exp(n * F.log(F.lit(0.5))).alias("sum"))
    step = lambda a, i: F.struct((a["term"] + F.log((n - i + 1) / i)).alias("term"), (a["sum"] + F.exp(a["term"] + F.log((n - i + 1) / i))).alias("sum"))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))
