"""Functions on names, paths, dates and lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the characters that become an underscore in column names.
UNACCEPTABLE = "!@#$%^&*()+={}[]|\\:;\"'<>,.?/~` -"


def digit_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))


def xyz(x: Column) -> list[Column]:
    """Three numbers with decimals between underscores; null without them."""
    pattern = r"_(-?\d+\.\d+)_(-?\d+\.\d+)_(-?\d+\.\d+)"
    return [F.when(F.rlike(x, F.lit(pattern)), F.regexp_extract(x, pattern, i).cast("double")) for i in (1, 2, 3)]


def between(x: Column, before: str, after: str) -> Column:
    """The shortest text between two literal marks; null if there is none."""
    pattern = re.escape(before) + "(.*?)" + re.escape(after)
    return F.when(F.rlike(x, F.lit(pattern)), F.regexp_extract(x, pattern, 1))


def path_part(x: Column, index: int) -> Column:
    """A part of a path, from 0 or, negative, from the end; null out of range."""
    return F.get(F.split(x, "/"), index if index >= 0 else F.size(F.split(x, "/")) + index)


def after(x: Column, mark: str) -> Column:
    """What follows the first occurrence of the mark; null without it."""
    return F.when(F.contains(x, F.lit(mark)), F.substring(x, F.instr(x, mark) + len(mark), 2**31 - 1 - len(mark)))


def basename(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def stem(x: Column) -> Column:
    """The base name without its extension; .gz and .nii count as one."""
    return F.regexp_replace(basename(x), r"(\.nii)?\.(gz|[A-Za-z0-9]+)$", "")


def tidy(x: Column) -> Column:
    return F.lower(F.btrim(x))


def side(x: Column) -> Column:
    """L or R, from a token of its own or in parentheses; null without."""
    found = F.regexp_extract(x, r"(?i)(?:^|[_\s(-])(left|right|lh|rh|l|r)(?:$|[_\s)-])", 1)
    return F.when(found != "", F.upper(F.substring(found, 1, 1)))


def without_side(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"(?i)(^|[_\s(-])(left|right|lh|rh|l|r)(?=$|[_\s)-])", ""), F.lit("_ ()-"))


def in_parentheses(x: Column) -> Column:
    return between(x, "(", ")")


def drop_last_token(x: Column, mark: str = "_") -> Column:
    m = re.escape(mark)
    return F.regexp_replace(x, f"{m}(?:(?!{m}).)*$", "")


def list_cell(x: Column, mark: str = ";") -> Column:
    """Trimmed, non-empty parts of a cell."""
    return F.filter(F.transform(F.split(x, re.escape(mark)), lambda p: F.btrim(p)), lambda p: p != "")


def triplets(x: Column) -> Column:
    """[[x,y,z],...] or [x,y,z] as an array of triplets; null if it is neither."""
    many, one = F.from_json(x, "array<array<double>>"), F.from_json(x, "array<double>")
    got = F.when(F.rlike(x, F.lit(r"^\s*\[\s*\[")), many).otherwise(F.array(one))
    return F.when(F.forall(got, lambda t: F.size(t) == 3), got)


def day_gap(a: Column, b: Column, pattern: str | None = None) -> Column:
    """Absolute difference in days of two texts or times; null where one is no date."""
    as_time = lambda c: F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)
    return F.abs(F.datediff(as_time(a), as_time(b)))


def json_number(x: Column, key: str) -> Column:
    return F.get_json_object(x, f"$.{key}").cast("double")


def natural_key(x: Column, width: int = 12) -> Column:
    """Text that sorts as its digit runs count: each run is padded with zeros."""
    parts = F.regexp_extract_all(x, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.lpad(p, width, "0")).otherwise(p)), "")


@F.pandas_udf(StringType())
def shared_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest common substring, the first in a on a tie; quadratic in the lengths, for names and not for texts."""

    def longest(x: str | None, y: str | None) -> str | None:
        if x is None or y is None:
            return None
        best, row = (0, 0), [0] * (len(y) + 1)
        for i, c in enumerate(x, 1):
            row = [0] + [row[j] + 1 if c == y[j] else 0 for j in range(len(y))]
            size = max(row)
            if size > best[0]:
                best = (size, i)
        return x[best[1] - best[0] : best[1]]

    return pd.Series([longest(x, y) for x, y in zip(a, b, strict=True)])


def vector(op: str, x: Column, y: Column | None = None) -> Column:
    """sum, mean, norm of an array; dot, cosine, mean2 (element-wise mean) of two. Null elements make null results."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    product = lambda a, b: add(F.zip_with(a, b, lambda p, q: p * q))
    norm = lambda a: F.sqrt(product(a, a))
    match op:
        case "sum":
            return add(x)
        case "mean":
            return F.when(F.size(x) > 0, add(x) / F.size(x))
        case "norm":
            return norm(x)
        case "dot":
            return product(x, y)
        case "cosine":
            bottom = norm(x) * norm(y)
            return F.when(bottom != 0, product(x, y) / bottom)
        case "mean2":
            return F.zip_with(x, y, lambda p, q: (p + q) / 2)
    raise ValueError(op)


def pick(x: Column, indices: list[int]) -> Column:
    """The elements at the indices that exist, in the order asked for."""
    return F.transform(F.filter(F.array(*map(F.lit, indices)), lambda i: (i >= 0) & (i < F.size(x))), lambda i: F.get(x, i))


# --- names of columns ----------------------------------------------------------------------------------------------


def clean_name(name: object) -> str:
    """A name for formulas: text, ``var_`` before a digit, an underscore for every unacceptable character."""
    text = str(name)
    text = "var_" + text if text[:1].isdigit() else text
    return "".join("_" if c in UNACCEPTABLE else c for c in text)


def splice(name: str, before: str, after_mark: str) -> str:
    """The text between two marks; the name itself without them."""
    start = name.find(before) + len(before) if before in name else -1
    end = name.find(after_mark, start) if start >= 0 and after_mark else -1
    return name[start:end] if start >= 0 and end >= 0 else name


def split_rename(name: str, rules: dict[str, int]) -> str:
    """For each mark that the name holds, keep that part of the split."""
    for mark, part in rules.items():
        if mark in name:
            name = name.split(mark)[part]
    return name


def unique_names(names: list[str]) -> list[str]:
    """Names after cleaning may clash; later ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if not k else f"{n}_{k}")
    return out


def renamed(df, rule):
    """df with rule applied to every column name, kept unique."""
    return df.toDF(*unique_names([rule(c) for c in df.columns]))


def tissue_subject(name: str) -> str:
    """The subject behind a tissue prefix such as mwp1."""
    return re.sub(r"^(mwp|wp|p|c)[123]", "", name)
