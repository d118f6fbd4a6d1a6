"""Ingest: call files or raw records to a LocusFrame on the reference loci.

One lazy job for all files. The order of steps is: percent to fraction, derived columns,
0-based to 1-based, contig names, contig filter, strand synchronisation, first record of a
locus and sample wins, strand collapse, cov = 0 to NULL, pivot, left join from the reference.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X
from locusgrid.sources import reference as R
from locusgrid.sources.presets import Layout, derived

SAMPLE = r"^([^.]*)"


def sample_names(paths: Sequence[str]) -> list[str]:
    """Base name up to the first dot, made unique with a numeric suffix."""
    out: list[str] = []
    for p in paths:
        base = re.match(SAMPLE, os.path.basename(p))[1]
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def scan(spark: SparkSession, paths: Sequence[str], cols: Layout, names: Sequence[str] | None = None) -> DataFrame:
    """Raw records of tab-separated files (also .gz): the layout's fields, `sample`, and `ord`, the place in the file."""
    names = names or sample_names(paths)
    width = max(cols.idx.values())
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(1, width + 1)])
    parts = []
    by_name: dict[str, list[tuple[str, str]]] = {}
    for p, s in zip(paths, names, strict=True):
        by_name.setdefault(os.path.basename(p), []).append((p, s))
    distinct = all(len(v) == 1 for v in by_name.values())
    groups = [(list(paths), None)] if distinct else [([p], s) for p, s in zip(paths, names, strict=True)]
    lookup = F.create_map(*[x for p, s in zip(paths, names, strict=True) for x in (F.lit(os.path.basename(p)), F.lit(s))])
    for some, sample in groups:
        df = spark.read.csv(some, sep="\t", schema=schema, comment="#", mode="PERMISSIVE")
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)  # a path may also be a folder of part files
        name = F.lit(sample) if sample else F.coalesce(lookup[F.col("_metadata.file_name")], lookup[folder])
        parts.append(df.select(*[F.col(f"_c{i}").alias(k) for k, i in cols.idx.items()], name.alias("sample"), place.alias("ord")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("context") == "CG").drop("context") if "context" in cols.idx else out
    return out.where(~F.col("chr").startswith("track")).withColumns({c: X.no_nan(X.to_number(F.col(c))) for c in ("beta", "M", "U", "cov") if c in cols.idx} | {"start": X.to_number(F.col("start"), "long")})


def percent_to_fraction(df: DataFrame) -> DataFrame:
    """beta / 100 for each sample whose largest beta is over 1. One small aggregate by sample (a row a file) is joined back."""
    top = df.groupBy("sample").agg(F.max("beta").alias("_top"))
    return df.join(F.broadcast(top), "sample", "left").withColumn("beta", F.when(F.col("_top") > 1, F.col("beta") / 100).otherwise(F.col("beta"))).drop("_top")


def derive(df: DataFrame) -> DataFrame:
    """M, U, cov and beta from whichever of them the records have."""
    have = {c for c in ("M", "U", "cov", "beta") if c in df.columns}
    exprs = derived(have)
    return df.withColumns({c: F.lit(None).cast("double") for c in ("M", "U", "cov", "beta") if c not in have}).withColumns(exprs)


def first_record(df: DataFrame, order: Sequence[Column], key: Sequence[str] = ("chr", "start", "sample")) -> DataFrame:
    """The first record of each key under `order`, as an aggregate with map-side combine rather than a window."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, "_r.*")


def sync_strands(df: DataFrame) -> DataFrame:
    """`-` records sit one base further on."""
    return df.withColumn("start", F.col("start") + F.when(F.col("strand") == "-", 1).otherwise(0))


def collapse_strands(df: DataFrame) -> DataFrame:
    """`-` records move back by one; M and U are summed by locus and sample (NULL ignored), cov and beta follow."""
    at = F.col("start") - F.when(F.col("strand") == "-", 1).otherwise(0)
    out = df.withColumn("start", at).groupBy("chr", "start", "sample").agg(F.sum("M").alias("M"), F.sum("U").alias("U"))
    m, u = F.coalesce("M", F.lit(0.0)), F.coalesce("U", F.lit(0.0))
    return out.select("chr", "start", "sample", F.lit("*").alias("strand"), m.alias("M"), u.alias("U"), (m + u).alias("cov"), X.ratio(m, m + u).alias("beta"))


def one_based(df: DataFrame) -> DataFrame:
    """Starts counted from 0 move on by one."""
    return df.withColumn("start", F.col("start") + 1)


def zero_to_null(df: DataFrame) -> DataFrame:
    """Loci of no depth are not covered: beta and cov become NULL."""
    on = F.col("cov") > 0
    return df.withColumns({"beta": F.when(on, F.col("beta")), "cov": F.when(on, F.col("cov"))})


def match_contigs(df: DataFrame, prefixed: bool) -> DataFrame:
    """Contig names take the reference's style, row by row."""
    return df.withColumn("chr", X.add_chr(F.col("chr")) if prefixed else X.strip_chr(F.col("chr")))


def pivot_cells(df: DataFrame, samples: Sequence[str], key: Sequence[str] = ("chr", "start")) -> DataFrame:
    """One row per locus with beta__S and cov__S: a conditional aggregate, one shuffle with map-side combine."""
    one = lambda c, s: F.max(F.when(F.col("sample") == s, F.col(c)))
    aggs = [one("beta", s).alias(f"beta__{s}") for s in samples] + [one("cov", s).cast("int").alias(f"cov__{s}") for s in samples]
    return df.groupBy(*key).agg(*aggs)


def align(ref: DataFrame, cells: DataFrame, samples: Sequence[str], **more) -> LocusFrame:
    """Left join of the reference with the pivoted cells; loci off the reference fall away, missing ones stay NULL."""
    wide = pivot_cells(cells, samples)
    return LocusFrame(ref.select("chr", "start", "strand").join(wide, ["chr", "start"], "left"), list(samples), **more)


def outer(cells: DataFrame, samples: Sequence[str], **more) -> LocusFrame:
    """Without a reference: all loci that any sample has; a missing beta is NULL and a missing cov 0."""
    wide = pivot_cells(cells, samples).withColumn("strand", F.lit("*"))
    return LocusFrame(wide.withColumns({f"cov__{s}": F.coalesce(f"`cov__{s}`", F.lit(0)) for s in samples}), list(samples), **more)


def missing_loci(ref: DataFrame, cells: DataFrame) -> DataFrame:
    """Reference loci that no record covers (also the `_uncovered.bed` rows)."""
    return ref.join(cells.select("chr", "start"), ["chr", "start"], "left_anti")


def foreign_records(ref: DataFrame, cells: DataFrame) -> DataFrame:
    """Records at loci that the reference lacks."""
    return cells.join(ref.select("chr", "start"), ["chr", "start"], "left_anti")


def ingest_stats(m: LocusFrame, error: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genome_stat, chr_stat, n_covered): mean and median of beta and cov over covered loci, and covered loci by chr x sample.
    error: see `quantile`."""
    long = m.to_long().where("beta IS NOT NULL")
    aggs = [F.avg("beta").alias("mean_meth"), X.quantile(F.col("beta"), 0.5, error).alias("median_meth"), F.avg("cov").alias("mean_cov"), X.quantile(F.col("cov"), 0.5, error).alias("median_cov")]
    counts = m.df.groupBy("chr").agg(*[F.count(m.beta(s)).alias(s) for s in m.samples])
    return long.groupBy("sample").agg(*aggs), long.groupBy("chr", "sample").agg(*aggs), counts


def read_calls(spark: SparkSession, paths: Sequence[str], cols: Layout, ref, *, zero_based: bool = True, stranded: bool = False, collapse: bool = False, contigs: Sequence[str] | None = None, synced: bool = False, coldata: dict[str, dict] | None = None, genome: str | None = None, chrom_sizes: dict[str, int] | None = None, uncovered_dir: str | None = None) -> LocusFrame:
    """Files to a LocusFrame. `stranded` expands the reference to both strands, `collapse` then sums them per locus."""
    if not paths:
        raise ValueError("no input files")
    if collapse and not stranded:
        raise ValueError("collapse needs stranded")
    names = sample_names(paths)
    if coldata is not None and len(coldata) != len(names):
        raise ValueError("coldata must have a row for each file")
    if coldata is not None:
        names = X.make_names(list(coldata))  # rows name the samples, in the order of the files
        if names != list(coldata):
            warnings.warn("sample names were changed: " + ", ".join(f"{a} to {b}" for a, b in zip(coldata, names, strict=True) if a != b), stacklevel=2)
        coldata = dict(zip(names, coldata.values(), strict=True))
    loci = R.resolve(spark, ref)
    prefixed = bool(loci.select(F.max(F.col("chr").startswith("chr"))).first()[0])
    loci = loci.where(F.col("chr").isin(list(contigs))) if contigs is not None else loci
    df = scan(spark, paths, cols, names).where("chr IS NOT NULL AND start IS NOT NULL")
    df = percent_to_fraction(df) if "beta" in cols.idx else df
    df = derive(df)
    df = df if "strand" in cols.idx else df.withColumn("strand", F.lit("*"))
    df = one_based(df) if zero_based else df
    df = match_contigs(df, prefixed)
    df = df.where(F.col("chr").isin(list(contigs))) if contigs is not None else df
    df = sync_strands(df) if synced else df
    df = first_record(df.drop("end"), [F.col("ord.block"), F.col("ord.row")]).drop("ord")
    if stranded:
        both = R.expand_strands(loci)
        if collapse:
            df = collapse_strands(df.drop("strand").join(both, ["chr", "start"]))  # strand as the reference has it
            loci = loci.withColumn("strand", F.lit("*"))
        else:
            loci = both
    df = zero_to_null(df)
    if uncovered_dir:
        for s in names:
            missing_loci(loci, df.where(F.col("sample") == s)).select("chr", "start", (F.col("start") + 1).alias("end_")).write.mode("overwrite").csv(f"{uncovered_dir}/{s}_uncovered.bed", sep="\t")
    return align(loci, df, names, coldata=coldata or {s: {} for s in names}, genome=genome, chrom_sizes=chrom_sizes or {})
