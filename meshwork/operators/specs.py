"""Declarative variables: specifications compiled to columns, jobs with seeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.scalar import positive_log, ratio


@dataclass(frozen=True)
class Variable:
    """A test variable: ``column`` under ``transform`` (none, log, share, per), with the expected ``sign``; "*" in the column stands for each of its parts."""

    test: str
    column: str
    transform: str = "none"
    by: str | None = None
    sign: int = 1


def expand(specs: list[Variable], parts: list[str]) -> list[Variable]:
    out = []
    for s in specs:
        names = [s.column.replace("*", p) for p in parts] if "*" in s.column else [s.column]
        out += [Variable(s.test, n, s.transform, s.by, s.sign) for n in names]
    return out


def column_of(spec: Variable) -> Column:
    c = F.col(spec.column).cast("double")
    if spec.transform == "log":
        c = positive_log(c)
    elif spec.transform in ("share", "per"):
        c = ratio(c, F.col(spec.by).cast("double"))
    elif spec.transform != "none":
        raise ValueError(f"unknown transform {spec.transform}")
    return c


def long_values(df: DataFrame, specs: list[Variable], keys: list[str], base_seed: int = 0) -> DataFrame:
    """(keys, test, variable, sign, seed, y): all variables in one pass over the rows."""
    rows = F.array(*[F.struct(F.lit(s.test).alias("test"), F.lit(s.column).alias("variable"), F.lit(s.sign).alias("sign"), F.lit(base_seed + i).alias("seed"), column_of(s).alias("y")) for i, s in enumerate(specs)])
    return df.select(*keys, F.inline(rows)).where("y is not null")
