"""Row and column subsetting. All predicates are narrow; regions use interval semi and anti joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import KEY, LocusFrame
from locusgrid.functions import expr as X
from locusgrid.operators.intervals import cast_regions, interval_join


def _checked(m: LocusFrame, strict: bool, text: str) -> LocusFrame:
    if strict and m.df.limit(1).count() == 0:
        raise ValueError(text)
    return m


def subset(m: LocusFrame, regions: DataFrame | None = None, contigs: Sequence[str] | None = None, samples: Sequence[str] | None = None, overlap: str = "within", strict: bool = False, broadcast: bool | None = None) -> LocusFrame:
    """Loci that overlap a region AND lie on a contig, of the given samples. A locus in several regions stays once."""
    out = m.select_samples(samples) if samples is not None else m
    if samples is not None and not out.samples:
        raise ValueError("no samples left")
    df = out.df.where(F.col("chr").isin(list(contigs))) if contigs is not None else out.df
    if regions is not None:
        df = interval_join(df, cast_regions(regions), overlap, "left_semi", broadcast)
    return _checked(out.with_df(df), strict, "nothing left after subsetting")


def region_filter(m: LocusFrame, regions: DataFrame, overlap: str = "within", strict: bool = False, broadcast: bool | None = None) -> LocusFrame:
    """Drops loci that overlap a region; strict: an error if none does."""
    r = cast_regions(regions)
    if strict:
        _checked(m.with_df(interval_join(m.df, r, overlap, "left_semi", broadcast)), True, "no locus overlaps the regions")
    return m.with_df(interval_join(m.df, r, overlap, "left_anti", broadcast))


def coverage_filter(m: LocusFrame, cov_thr: int = 1, min_samples: int = 1, prop_samples: float = 0, group: str | None = None) -> LocusFrame:
    """Keeps loci where at least max(min_samples, ceil(prop * n)) samples have cov >= cov_thr; with `group`, in every group of that annotation."""
    if not isinstance(cov_thr, int) or not isinstance(min_samples, int):
        raise TypeError("cov_thr and min_samples must be integers")
    if not 0 <= prop_samples <= 1:
        raise ValueError("prop_samples must lie between 0 and 1")
    groups: dict[object, list[str]] = {}
    for s in m.samples:
        if group is not None and group not in m.coldata.get(s, {}):
            raise ValueError(f"{group} is not in the sample annotation")
        groups.setdefault(m.coldata[s][group] if group is not None else None, []).append(s)

    def enough(ss):
        return X.count_where([m.cov(s) >= cov_thr for s in ss]) >= max(min_samples, math.ceil(prop_samples * len(ss) - 1e-9))

    return m.with_df(m.df.where(reduce(lambda a, b: a & b, [enough(ss) for ss in groups.values()])))


def remove_uncovered(m: LocusFrame) -> LocusFrame:
    """Drops loci whose cov is NULL in all samples."""
    return m.with_df(m.df.where(F.coalesce(*m.covs).isNotNull()))


def complete_cases(m: LocusFrame) -> LocusFrame:
    """Keeps loci with beta in every sample."""
    return m.with_df(m.df.where(X.row_count(m.betas) == len(m.samples)))


def any_missing(m: LocusFrame) -> DataFrame:
    """Key and `any_na`: whether a sample lacks the locus."""
    return m.df.select(*KEY, (X.row_count(m.betas) < len(m.samples)).alias("any_na"))


def get_matrix(m: LocusFrame, kind: str = "M", add_loci: bool = False, ranges: bool = False) -> DataFrame:
    """One assay as a projection: M (beta) or C (cov), columns named by sample; ranges adds end_ = start + 1."""
    if kind not in ("M", "C"):
        raise ValueError("type must be M or C")
    if ranges and not add_loci:
        raise ValueError("ranges need add_loci")
    cols = [(m.beta(s) if kind == "M" else m.cov(s)).alias(s) for s in m.samples]
    lead = [*KEY, *([(F.col("start") + 1).alias("end_")] if ranges else [])] if add_loci else []
    return m.df.select(*lead, *cols)


def sample_rows(m: LocusFrame, k: int, seed: int = 0) -> LocusFrame:
    """k loci by the order of a seeded hash of the key: repeatable whatever the partitions, and a bounded top-k."""
    return m.with_df(m.df.orderBy(F.xxhash64(*KEY, F.lit(seed)), *KEY).limit(k))


def cap_values(long: DataFrame, value: str, lim: float) -> DataFrame:
    return long.where(F.col(value) <= lim)


def mask(m: LocusFrame, low_count: int | None = None, high_quantile: float | None = 0.99, error: float | None = None) -> tuple[LocusFrame, DataFrame]:
    """NULLs cells with cov < low_count, then cells over the sample's quantile of the cov that is left. Rows stay.

    The thresholds come from one aggregate over all samples, a single row that is joined back as a broadcast, so the plan
    stays lazy. error: thresholds by a sketch, see `quantile`. Also returns the counts (sample, n_low, n_high).
    """
    if low_count is not None and not isinstance(low_count, int):
        raise TypeError("low_count must be an integer")
    if high_quantile is not None and not 0 < high_quantile < 1:
        raise ValueError("high_quantile must lie between 0 and 1")
    low = {s: F.when(m.cov(s) >= low_count, m.cov(s)) if low_count is not None else m.cov(s) for s in m.samples}
    df = m.df
    if high_quantile is not None:
        tops = df.agg(*[X.quantile(low[s], high_quantile, error).alias(f"_q__{s}") for s in m.samples])
        df = df.crossJoin(F.broadcast(tops))  # one row
        keep = {s: low[s].isNotNull() & (low[s] <= F.col(f"`_q__{s}`")) for s in m.samples}
        high = {s: low[s] > F.col(f"`_q__{s}`") for s in m.samples}
    else:
        keep, high = {s: low[s].isNotNull() for s in m.samples}, {s: F.lit(False) for s in m.samples}
    counts = df.agg(*[F.count_if(m.cov(s).isNotNull() & low[s].isNull()).alias(f"l__{s}") for s in m.samples], *[F.count_if(high[s]).alias(f"h__{s}") for s in m.samples])
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`l__{s}`").alias("n_low"), F.col(f"`h__{s}`").alias("n_high")) for s in m.samples])).alias("x")).select("x.*")
    new = {f"beta__{s}": F.when(keep[s], m.beta(s)) for s in m.samples} | {f"cov__{s}": F.when(keep[s], m.cov(s)) for s in m.samples}
    return m.with_df(df.withColumns(new).select(*[f"`{c}`" for c in m.df.columns])), counts
