"""SNP removal and array probes: equi joins after exploding positions; bands use bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X


def snp_loci(snps: DataFrame, populations: Sequence[str], maf: float = 0.01) -> DataFrame:
    """(chr, start, low): loci that touch a SNP with any population's MAF >= maf at start or start + 1; low: any MAF <= 0.1."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(p) >= maf, F.lit(False)) for p in populations])
    low = reduce(lambda a, b: a | b, [F.coalesce(F.col(p) <= 0.1, F.lit(False)) for p in populations])
    at = F.explode(F.array(F.col("pos").cast("long"), F.col("pos").cast("long") - 1))
    return snps.where(hit).select("chr", at.alias("start"), low.alias("low")).groupBy("chr", "start").agg(F.max("low").alias("low"))


def remove_snps(m: LocusFrame, snps: DataFrame, populations: Sequence[str], maf: float = 0.01, reduce_filtering: bool = False, forced: bool = False, snp_genome: str | None = None, error: float | None = None) -> tuple[LocusFrame, LocusFrame]:
    """(loci without SNPs, loci with). snp_genome (hg19 or hg38): the build of the SNP table, which the frame's genome must be of. error: the
    quantile by a sketch, see `quantile`. With reduce_filtering, a hit that has any MAF <= 0.1 goes only if its row variance of beta
    is over the 25 % quantile of such variances; fewer than ten samples need `forced`."""
    if reduce_filtering and len(m.samples) < 10 and not forced:
        raise ValueError("reduce_filtering needs ten samples, or forced")
    if snp_genome is not None and detect_genome(m.genome) != snp_genome:
        raise ValueError(f"SNPs of {snp_genome} do not fit the reference {m.genome or 'unknown'}; hg19 and hg38 are known")
    bad = snp_loci(snps, populations, maf)
    if not reduce_filtering:
        key = bad.select("chr", "start")
        return m.with_df(m.df.join(key, ["chr", "start"], "left_anti")), m.with_df(m.df.join(key, ["chr", "start"], "left_semi"))
    var = X.row_var(m.betas)
    df = m.df.join(bad, ["chr", "start"], "left").withColumn("_var", var)
    q = df.where("low").agg(X.quantile(F.col("_var"), 0.25, error).alias("_q"))
    drop = F.col("low").isNotNull() & (~F.col("low") | F.coalesce(F.col("_var") > F.col("_q"), F.lit(False)))
    df = df.crossJoin(F.broadcast(q)).withColumn("_drop", drop)
    cols = [f"`{c}`" for c in m.df.columns]
    return m.with_df(df.where("NOT _drop").select(*cols)), m.with_df(df.where("_drop").select(*cols))


def removed_per_contig(hits: LocusFrame) -> DataFrame:
    return hits.df.groupBy("chr").agg(F.count("*").alias("n_removed"))


def array_probes(probes: DataFrame, array_type: str = "both") -> DataFrame:
    """One probe per (chr, pos): 450K wins over EPIC, then the smallest probe_id."""
    if array_type not in ("450K", "EPIC", "both"):
        raise ValueError("array_type must be 450K, EPIC or both")
    df = probes if array_type == "both" else probes.where(F.col("array_type") == array_type)
    best = F.min_by(F.struct("probe_id", "array_type"), F.struct(F.when(F.col("array_type") == "450K", 0).otherwise(1).alias("a"), F.col("probe_id").alias("b")))
    return df.groupBy("chr", F.col("pos").cast("long").alias("pos")).agg(best.alias("p")).select("chr", "pos", "p.*")


def probe_subset(m: LocusFrame, probes: DataFrame, tolerance: int = 0, array_type: str = "both") -> LocusFrame:
    """Loci at probe positions, with probe_id and array_type. With a tolerance, a locus takes the first probe, by position, with
    |pos - start| <= tolerance: the probe is exploded over the positions it reaches, so it stays an equi join."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    p = array_probes(probes, array_type)
    if tolerance:
        p = p.withColumn("start", F.explode(F.sequence(F.col("pos") - tolerance, F.col("pos") + tolerance)))
        p = p.groupBy("chr", "start").agg(F.min_by(F.struct("probe_id", "array_type"), "pos").alias("x")).select("chr", "start", "x.*")
    else:
        p = p.withColumnRenamed("pos", "start")
    return m.with_df(m.df.join(p, ["chr", "start"]), meta={**m.meta, "array_subset": {"type": array_type, "tolerance": tolerance}})


def probe_coverage(m: LocusFrame, probes: DataFrame, tolerance: int = 0, array_type: str = "both") -> DataFrame:
    """n_probes, n_loci, n_matched and the matched percentage of loci and probes, to two places (half to even)."""
    one = probe_subset(m, probes, tolerance, array_type).df.agg(F.count("*").alias("n_matched"), F.countDistinct("probe_id").alias("_used"))
    n = array_probes(probes, array_type).agg(F.count("*").alias("n_probes"))
    loci = m.df.agg(F.count("*").alias("n_loci"))
    df = one.crossJoin(n).crossJoin(loci)  # three single rows
    pct = lambda a, b: F.bround(X.ratio(F.col(a) * 100, F.col(b)), 2)
    return df.select("n_probes", "n_loci", "n_matched", pct("n_matched", "n_loci").alias("pct_loci"), pct("_used", "n_probes").alias("pct_probes"))


def detect_genome(name: str | None) -> str | None:
    """hg19 or hg38 from a build's name, else None."""
    text = (name or "").lower()
    return "hg19" if any(x in text for x in ("hg19", "grch37")) else "hg38" if any(x in text for x in ("hg38", "grch38")) else None
