"""Region summaries: interval join, then one grouped aggregate with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X
from locusgrid.operators.intervals import cast_regions, interval_join


def region_summary(m: LocusFrame, regions: DataFrame, kind: str = "M", how: str = "mean", overlap: str = "within", na_rm: bool = True, extra: Sequence[str] = (), broadcast: bool | None = None, ordered: bool = False) -> DataFrame:
    """ordered: sorted by region id. chr, r_start, r_end, n_overlap, rid, extra columns, then a column per sample. Regions without loci have no row."""
    if not isinstance(m, LocusFrame):
        raise TypeError("a LocusFrame is needed")
    if kind not in ("M", "C"):
        raise ValueError("type must be M or C")
    value = m.beta if kind == "M" else m.cov
    need = m.df.select("chr", "start", *[value(s).alias(s) for s in m.samples], *extra)
    pairs = interval_join(need, cast_regions(regions), overlap, "inner", broadcast)
    cols = [X.agg_na(how, F.col(f"`{c}`"), na_rm).alias(c) for c in [*extra, *m.samples]]
    out = pairs.groupBy("rid", "chr", "r_start", "r_end").agg(F.count("*").alias("n_overlap"), *cols)
    return out.orderBy("rid") if ordered else out
