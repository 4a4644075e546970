"""Design matrices: codes of labels, a small formula language, interactions, contrasts, and formulas by the dozen.

Formulas know ``+``, ``-``, ``:``, ``*``, ``1``, ``0`` and ``C(x)`` with treatment coding (the first level is the
reference). Levels are looked up in the data: their number must be small, as each becomes a column.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = 1000


def ordinal_codes(df: DataFrame, x: str, out: str) -> DataFrame:
    """The place of a value among the sorted distinct ones, from 0; coded once per value and joined back. Null has none."""
    codes = df.where(F.col(x).isNotNull()).select(F.col(x).alias("_v")).distinct().withColumn(out, F.row_number().over(Window.orderBy("_v")) - 1)
    return df.join(codes, F.col(x) == F.col("_v"), "left").drop("_v")


def factorize(df: DataFrame, x: str, out: str, order: str) -> DataFrame:
    """Codes by first appearance in the given order."""
    firsts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_v")).agg(F.min(order).alias("_f"))
    codes = firsts.select("_v", (F.row_number().over(Window.orderBy("_f")) - 1).alias(out))
    return df.join(codes, F.col(x) == F.col("_v"), "left").drop("_v")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose values all read as numbers become doubles, others ordinal codes (as doubles)."""
    bad = df.agg(*[F.count(F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(), 1)).alias(c) for c in columns]).first()
    for c in columns:
        if bad[c] == 0:
            df = df.withColumn(c, F.col(c).cast("string").try_cast("double"))
        else:
            df = ordinal_codes(df, c, "_code").withColumn(c, F.col("_code").cast("double")).drop("_code")
    return df


def parse(formula: str) -> tuple[list[str], list[tuple[str, ...]], bool]:
    """(outcomes, terms, intercept); a term is a tuple of factors, a factor a name or C(name)."""
    left, _, right = formula.rpartition("~")
    terms: list[tuple[str, ...]] = []
    intercept = True
    for sign, part in signed(right):
        part = part.strip()
        if part in ("0", "1"):
            intercept = (part == "1") == (sign > 0)
            continue
        factors = [tuple(f.strip() for f in side.split(":")) for side in part.split("*")]
        made = [tuple(dict.fromkeys(f for group in some for f in group)) for k in range(1, len(factors) + 1) for some in combinations(factors, k)]
        if sign > 0:
            terms += [t for t in made if t not in terms]
        else:
            terms = [t for t in terms if t not in made]
    return [o.strip() for o in left.split("+") if o.strip()], sorted(terms, key=len), intercept


def signed(text: str):
    """(sign, part) of a sum."""
    sign, part, depth = 1, "", 0
    for c in text + "+":
        depth += (c == "(") - (c == ")")
        if c in "+-" and depth == 0:
            if part.strip():
                yield sign, part
            sign, part = (1 if c == "+" else -1), ""
        else:
            part += c


def columns_of(df: DataFrame, formula: str) -> dict[str, Column]:
    """The columns of the design by name, in order."""
    _, terms, intercept = parse(formula)
    out: dict[str, Column] = {"Intercept": F.lit(1.0)} if intercept else {}
    coded: dict[str, list[tuple[str, Column]]] = {}
    for factor in dict.fromkeys(f for t in terms for f in t):
        if factor.startswith("C(") and factor.endswith(")"):
            name = factor[2:-1].strip()
            levels = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().limit(LEVELS + 1).collect()]
            if len(levels) > LEVELS:
                raise ValueError(f"{name} has more than {LEVELS} levels")
            coded[factor] = [(f"{name}[T.{v}]", (F.col(name) == F.lit(v)).cast("double")) for v in sorted(levels)[1:]]
        else:
            coded[factor] = [(factor, F.col(factor).cast("double"))]
    for term in terms:
        for some in product(*[coded[f] for f in term]):
            value = some[0][1]
            for _, c in some[1:]:
                value = value * c
            out[":".join(n for n, _ in some)] = value
    return out


def matrix(df: DataFrame, formula: str, keep: list[str]) -> DataFrame:
    """The kept columns, the outcomes, and the design; rows with a null in a term have nulls there."""
    outcomes, _, _ = parse(formula)
    return df.select(*keep, *outcomes, *[c.alias(n) for n, c in columns_of(df, formula).items()])


def interactions(df: DataFrame, names: list[str], order: int = 2) -> DataFrame:
    """df with the products of every ``order`` of the columns."""
    for some in combinations(names, order):
        value = F.col(some[0]).cast("double")
        for n in some[1:]:
            value = value * F.col(n)
        df = df.withColumn(":".join(some), value)
    return df


def contrasts(spark: SparkSession, names: list[str], against_intercept: bool = False) -> DataFrame:
    """(row, column, weight): the identity, with -1 in the intercept's column if asked."""
    cell = lambda i, j: 1.0 if i == j else -1.0 if against_intercept and j == 0 and i > 0 else 0.0
    return spark.createDataFrame([(i, j, cell(i, j)) for i in range(len(names)) for j in range(len(names))], "row int, column int, weight double")


def formulas(outcome: str, predictors: list[str], interacting: bool = True) -> list[str]:
    """Every subset of the predictors as a sum, and as a product where it has several."""
    out = []
    for k in range(1, len(predictors) + 1):
        for some in combinations(predictors, k):
            out.append(f"{outcome} ~ " + " + ".join(some))
            if k > 1 and interacting:
                out.append(f"{outcome} ~ " + " * ".join(some))
    return out
