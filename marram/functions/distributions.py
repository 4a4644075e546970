"""Distribution functions as JVM columns: log-gamma, incomplete beta and gamma, normal, t, F and chi-square.

Continued fractions and series run as a fixed number of steps of ``aggregate``, so nothing leaves the JVM. Arguments
out of range, and nulls, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7, nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Coefficients of a rational start for the normal quantile (central region, then tails).
CENTRAL = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
STEPS = 300
TINY = 1e-300


def number(x: Column | float | int) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def let(body, **values: Column) -> Column:
    """body of a struct that holds the values, each computed once; expressions stay small however often it uses them."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def counts(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double"))


def ln_gamma(x: Column) -> Column:
    def body(s: Column) -> Column:
        series = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:]):
            series = series + F.lit(c) / (s["x"] + F.lit(float(i)))
        return let(lambda t: F.lit(0.9189385332046727) + (s["x"] - 0.5) * F.log(t["t"]) - t["t"] + F.log(series), t=s["x"] + 6.5)

    return let(body, x=number(x))


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction evaluated forwards."""

    def fraction(v: Column) -> Column:
        p, q, y = v["p"], v["q"], v["y"]

        def step(s: Column, m: Column) -> Column:
            first = lambda e: let(lambda w: F.struct(w["c"].alias("c"), w["d"].alias("d"), (s["h"] * e["d"] * e["c"] * w["d"] * w["c"]).alias("h")), d=1 / (1 + e["odd"] * e["d"] + TINY), c=1 + e["odd"] / e["c"] + TINY)
            both = lambda k: let(first, odd=k["odd"], d=1 / (1 + k["even"] * s["d"] + TINY), c=1 + k["even"] / s["c"] + TINY)
            return let(both, even=m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), odd=-(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)))

        run = lambda d: F.aggregate(counts(STEPS // 2), F.struct(F.lit(1.0).alias("c"), d["d"].alias("d"), d["d"].alias("h")), step, lambda s: s["h"])
        front = F.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * F.log(y) + q * F.log(1 - y))
        return let(lambda r: F.when(v["low"], r["r"]).otherwise(1 - r["r"]), r=front * let(run, d=1 / (1 - (p + q) * y / (p + 1) + TINY)) / p)

    def body(v: Column) -> Column:
        low = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        inner = let(fraction, low=low, p=F.when(low, v["a"]).otherwise(v["b"]), q=F.when(low, v["b"]).otherwise(v["a"]), y=F.when(low, v["x"]).otherwise(1 - v["x"]))
        return F.when((v["x"] < 0) | (v["x"] > 1), None).when(v["x"] == 0, F.lit(0.0)).when(v["x"] == 1, F.lit(1.0)).otherwise(inner)

    return let(body, a=number(a), b=number(b), x=number(x))


def gamma_inc_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""

    def body(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(-x + a * F.log(x) - ln_gamma(a))

        def add(s: Column, i: Column) -> Column:
            return let(lambda t: F.struct(t["t"].alias("term"), (s["sum"] + t["t"]).alias("sum")), t=s["term"] * x / (a + i))

        series = F.aggregate(counts(STEPS), F.struct((1 / a).alias("term"), (1 / a).alias("sum")), add, lambda s: s["sum"])

        def step(s: Column, i: Column) -> Column:
            made = lambda k: let(lambda w: F.struct(w["c"].alias("c"), w["d"].alias("d"), (s["h"] * w["d"] * w["c"]).alias("h")), d=1 / (k["n"] * s["d"] + k["b"] + TINY), c=k["b"] + k["n"] / s["c"] + TINY)
            return let(made, n=-i * (i - a), b=x + 1 - a + 2 * i)

        fraction = let(lambda d: F.aggregate(counts(STEPS), F.struct(F.lit(1 / TINY).alias("c"), d["d"].alias("d"), d["d"].alias("h")), step, lambda s: s["h"]), d=1 / (x + 1 - a + TINY))
        return F.when((a <= 0) | (x < 0), None).when(x == 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return let(body, a=number(a), x=number(x))


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    body = lambda v: let(lambda h: F.when(v["z"] > 0, h["h"]).otherwise(1 - h["h"]), h=gamma_inc_upper(F.lit(0.5), v["z"] * v["z"] / 2) / 2)
    return let(body, z=number(z))


def normal_cdf(z: Column) -> Column:
    return normal_sf(-number(z))


def normal_ppf(p: Column) -> Column:
    """The quantile of the standard normal distribution: a rational start and two Newton steps."""

    def rational(pair, x):
        out = []
        for coefficients in pair:
            y = F.lit(coefficients[0])
            for c in coefficients[1:]:
                y = y * x + F.lit(c)
            out.append(y)
        return out[0] / out[1]

    def start(p: Column) -> Column:
        low = let(lambda v: rational(TAIL, v["r"]), r=F.sqrt(-2 * F.log(p)))
        high = let(lambda v: -rational(TAIL, v["r"]), r=F.sqrt(-2 * F.log(1 - p)))
        middle = let(lambda v: v["q"] * rational(CENTRAL, v["q"] * v["q"]), q=p - 0.5)
        return F.when(p < 0.02425, low).when(p > 0.97575, high).otherwise(middle)

    def body(v: Column) -> Column:
        newton = lambda s, _: s - (normal_cdf(s) - v["p"]) / (F.exp(-s * s / 2) * F.lit(0.3989422804014327))
        return F.when((v["p"] > 0) & (v["p"] < 1), F.aggregate(F.array(F.lit(1), F.lit(2)), start(v["p"]), newton))

    return let(body, p=number(p))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""
    return let(lambda v: beta_inc(v["d"] / 2, F.lit(0.5), v["d"] / (v["d"] + v["t"] * v["t"])), t=number(t), d=number(df))


def t_cdf(t: Column, df: Column) -> Column:
    return let(lambda v: F.when(v["t"] > 0, 1 - v["half"]).otherwise(v["half"]), t=number(t), half=t_p(t, df) / 2)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f)."""
    body = lambda v: F.when(v["f"] <= 0, F.lit(1.0)).otherwise(beta_inc(v["b"] / 2, v["a"] / 2, v["b"] / (v["b"] + v["a"] * v["f"])))
    return let(body, f=number(f), a=number(d1), b=number(d2))


def chi2_p(x: Column, df: Column) -> Column:
    """P(X > x)."""
    return gamma_inc_upper(number(df) / 2, number(x) / 2)


def t_ppf(p: Column, df: Column) -> Column:
    """The quantile of t by sixty bisections between -1000 and 1000."""
    p, df = number(p), number(df)

    def halve(s: Column, _: Column) -> Column:
        made = lambda v: F.struct(F.when(v["below"], v["mid"]).otherwise(s["lo"]).alias("lo"), F.when(v["below"], s["hi"]).otherwise(v["mid"]).alias("hi"))
        return let(lambda m: let(made, mid=m["mid"], below=t_cdf(m["mid"], df) < p), mid=(s["lo"] + s["hi"]) / 2)

    start = F.struct(F.lit(-1000.0).alias("lo"), F.lit(1000.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def t_to_z(t: Column, df: Column) -> Column:
    """The normal quantile of a t statistic's upper tail, by sign, so that large values keep their digits."""
    return F.signum(number(t)) * F.abs(normal_ppf(t_p(t, df) / 2))


def p_to_z(p: Column) -> Column:
    return -normal_ppf(p)


def pooled_interval(mean: Column, sd: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Mean and its t interval's half width as (low, high)."""
    half = t_ppf(F.lit((1 + level) / 2), number(n) - 1) * sd / F.sqrt(number(n))
    return mean - half, mean + half
