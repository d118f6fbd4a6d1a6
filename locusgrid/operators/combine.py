"""Unions of loci and side-by-side samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import KEY, LocusFrame


def combine(a: LocusFrame, b: LocusFrame, by: str = "row", check: bool = True) -> LocusFrame:
    """by row: more loci of the same samples; by col: more samples at the same loci. Breaches of that are errors when checked."""
    if by == "row":
        if a.samples != b.samples:
            raise ValueError("different samples, or in another order")
        df = a.df.unionByName(b.df, allowMissingColumns=True)
        if check and df.groupBy(*KEY).count().where("count > 1").limit(1).count():
            raise ValueError("there are overlapping loci")
        return a.with_df(df)
    if by == "col":
        if set(a.samples) & set(b.samples):
            raise ValueError("sample names overlap")
        if check and (differing(a, b).limit(1).count() or differing(b, a).limit(1).count()):
            raise ValueError("different loci")
        right = b.df.select(*KEY, *[f"`{p}__{s}`" for p in ("beta", "cov") for s in b.samples])
        return a.with_df(a.df.join(right, KEY), samples=[*a.samples, *b.samples], coldata={**a.coldata, **b.coldata})
    raise ValueError("by must be row or col")


def differing(a: LocusFrame, b: LocusFrame) -> DataFrame:
    """Loci of a that b lacks."""
    return a.df.select(*KEY).join(b.df.select(*KEY), KEY, "left_anti")


def duplicated(m: LocusFrame) -> DataFrame:
    return m.df.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
