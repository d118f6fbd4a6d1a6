"""Descriptive statistics and the data behind the report and plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import KEY, LocusFrame
from locusgrid.functions import expr as X


def get_stats(m: LocusFrame, per_chr: bool = True, error: float | None = None) -> DataFrame:
    """mean, median and sd of beta and cov by (chr, sample) or by sample; NULL is left out of each on its own. error: medians by a sketch
    instead of all distinct values of a group, see `quantile`."""
    by = ["chr", "sample"] if per_chr else ["sample"]
    aggs = [f(c).alias(f"{n}_{name}") for c, name in (("beta", "meth"), ("cov", "cov")) for n, f in (("mean", F.avg), ("median", lambda x: X.quantile(F.col(x), 0.5, error)), ("sd", F.stddev_samp))]
    return m.to_long().groupBy(*by).agg(*aggs)


def column_stat(m: LocusFrame, how: str = "mean", kind: str = "M") -> DataFrame:
    """One aggregate over each sample's column."""
    return m.df.agg(*[X.agg_na(how, m.beta(s) if kind == "M" else m.cov(s)).alias(s) for s in m.samples])


def column_quantile(m: LocusFrame, p: float, kind: str = "C", error: float | None = None) -> DataFrame:
    """Type 7 quantile of each sample's column, or one by a sketch, see `quantile`."""
    return m.df.agg(*[X.quantile(m.beta(s) if kind == "M" else m.cov(s), p, error).alias(s) for s in m.samples])


def with_sd(m: LocusFrame, na_rm: bool = False) -> DataFrame:
    return m.df.withColumn("_sd", X.row_sd(m.betas, na_rm))


def order_by_sd(m: LocusFrame, digits: int | None = None) -> DataFrame:
    """Loci by falling row SD; a NULL sample makes the SD NULL, and these come last. Ties by locus; with digits, SDs tie that are equal to so
    many places."""
    sd = F.col("_sd") if digits is None else F.round("_sd", digits)
    return with_sd(m).orderBy(F.desc_nulls_last(sd), *KEY).drop("_sd")


def top_variable(m: LocusFrame, k: int | None, na_rm: bool = False) -> LocusFrame:
    """The k loci of highest SD: a bounded top-k per task, no global sort. None: all."""
    if k is None:
        return m
    return m.with_df(with_sd(m, na_rm).orderBy(F.desc_nulls_last("_sd"), *KEY).limit(k).drop("_sd"))


def n_covered(m: LocusFrame, ref_counts: DataFrame | None = None) -> DataFrame:
    """(chr, sample, n_covered[, total, fraction]): loci with beta."""
    wide = m.df.groupBy("chr").agg(*[F.count(m.beta(s)).alias(s) for s in m.samples])
    out = wide.unpivot(["chr"], [f"`{s}`" for s in m.samples], "sample", "n_covered")
    if ref_counts is None:
        return out
    return out.join(ref_counts.select("chr", F.col("n").alias("total")), "chr", "left").withColumn("fraction", X.ratio(F.col("n_covered"), F.col("total")))


def n_complete(m: LocusFrame, ref_counts: DataFrame) -> DataFrame:
    """(chr, n_complete, total, fraction): loci that all samples cover."""
    out = m.df.groupBy("chr").agg(F.count_if(X.row_count(m.betas) == len(m.samples)).alias("n_complete"))
    return out.join(ref_counts.select("chr", F.col("n").alias("total")), "chr").withColumn("fraction", X.ratio(F.col("n_complete"), F.col("total")))


def histogram(m: LocusFrame, lim: int = 100) -> DataFrame:
    """(sample, cov, n): counts of each depth up to lim."""
    return m.to_long().where(F.col("cov") <= lim).groupBy("sample", "cov").agg(F.count("*").alias("n"))


def coverage_data(m: LocusFrame, kind: str = "hist", pheno: str | None = None, per_group: bool = False, lim: int = 100, size_lim: int | None = None, seed: int = 0, **kw) -> DataFrame:
    """Depths up to lim by sample, or by a group of samples: (variable, cov, n) counts, or a density (variable, x, density). All cells count,
    as a group holds a row a depth; a caller's size_lim cuts more cells to that many by a seeded sample of loci."""
    if kind not in ("hist", "dens"):
        raise ValueError("kind must be hist or dens")
    if per_group and (pheno is None or any(pheno not in m.coldata.get(s, {}) for s in m.samples)):
        raise ValueError("per_group needs an annotation column that groups the samples")
    from locusgrid.operators.filters import cap_values, sample_rows

    if size_lim is not None:
        n_loci = size_lim // max(1, len(m.samples))
        if m.df.limit(n_loci + 1).count() > n_loci:
            m = sample_rows(m, n_loci, seed)
    long = cap_values(m.to_long(), "cov", lim)
    label = F.create_map(*[x for s in m.samples for x in (F.lit(s), F.lit(str(m.coldata[s][pheno])))])[F.col("sample")] if per_group else F.col("sample")
    long = long.select(label.alias("variable"), "cov")
    if kind == "hist":
        return long.groupBy("variable", "cov").agg(F.count("*").alias("n"))
    return density(long, "cov", "variable", **{"lo": 0.0, "hi": float(lim), "adjust": 1.5} | kw)


def five_numbers(df: DataFrame, by: str, value: str, error: float | None = None) -> DataFrame:
    """Box-plot summary: minimum, quartiles, maximum."""
    q = df.groupBy(by).agg(X.quantile(F.col(value), [0.0, 0.25, 0.5, 0.75, 1.0], error).alias("q"))
    return q.select(by, *[F.col("q")[i].alias(n) for i, n in enumerate(("lowest", "q1", "med", "q3", "highest"))])


def density(long: DataFrame, value: str = "beta", by: str = "sample", points: int = 512, lo: float = 0.0, hi: float = 1.0, adjust: float = 1.0, bw: float | None = None, decimals: int | None = None, error: float | None = None) -> DataFrame:
    """(by, x, density): Gaussian kernel density on an even grid, bandwidth 0.9 min(sd, IQR / 1.34) n^-0.2 unless given.

    Equal values are counted first, so the kernel sum works on distinct values. With `decimals` they are rounded before, which bounds them
    to 10^decimals + 1 of each unit of their range, at a cost in precision. error: quartiles by a sketch, see `quantile`.
    """
    v = long.where(F.col(value).isNotNull())
    stat = v.groupBy(by).agg(F.count("*").alias("_n"), F.stddev_samp(value).alias("_sd"), X.quantile(F.col(value), [0.25, 0.75], error).alias("_q"))
    spread = F.least(F.col("_sd"), F.nullif((F.col("_q")[1] - F.col("_q")[0]) / 1.34, F.lit(0.0)))
    h = F.lit(bw) if bw is not None else F.coalesce(spread, F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0)) * 0.9 * F.pow(F.col("_n"), -0.2) * adjust
    stat = stat.select(by, "_n", h.alias("_h"))
    at = F.col(value).cast("double") if decimals is None else F.round(F.col(value).cast("double"), decimals)
    bins = v.groupBy(by, at.alias("_v")).agg(F.count("*").alias("_w")).join(F.broadcast(stat), by)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    x = F.lit(lo) + F.col("_i") * ((hi - lo) / (points - 1))
    z = (F.col("x") - F.col("_v")) / F.col("_h")
    k = F.col("_w") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * 2.5066282746310002)
    return bins.withColumn("_i", grid).withColumn("x", x).groupBy(by, "x").agg(F.sum(k).alias("density"))


def violin(long: DataFrame, **kw) -> DataFrame:
    """Mirrored density."""
    return density(long, **kw).withColumn("mirror", -F.col("density"))


def plot_data(m: LocusFrame, n_loci: int | None = 25_000, regions: DataFrame | None = None, pheno: str | None = None, seed: int = 0) -> DataFrame:
    """(variable, meth): melted betas of n sampled loci, labelled by sample or by an annotation."""
    from locusgrid.operators.filters import sample_rows, subset

    out = subset(m, regions, overlap="within") if regions is not None else m
    out = sample_rows(out, n_loci, seed) if n_loci else out
    label = F.col("sample")
    if pheno:
        label = F.create_map(*[x for s in m.samples for x in (F.lit(s), F.lit(str(m.coldata[s][pheno])))])[F.col("sample")]
    return out.to_long().where("beta IS NOT NULL").select(label.alias("variable"), F.col("beta").alias("meth"))


def errorbars(stats: DataFrame, what: str = "meth", stat: str = "mean", ignore_chr: Sequence[str] = (), samples: Sequence[str] | None = None) -> DataFrame:
    """Statistic with stat - sd (not under 0) and stat + sd."""
    df = stats.where(~F.col("chr").isin(list(ignore_chr))) if ignore_chr and "chr" in stats.columns else stats
    df = df.where(F.col("sample").isin(list(samples))) if samples else df
    v, sd = F.col(f"{stat}_{what}"), F.col(f"sd_{what}")
    keys = [c for c in ("chr", "sample") if c in stats.columns]
    return df.select(*keys, v.alias("value"), F.greatest(v - sd, F.lit(0.0)).alias("sd_low"), (v + sd).alias("sd_high"))
