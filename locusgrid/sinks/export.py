"""Exports: bedGraph, multi-sample BED, metilene, count tables, probe matrix, bigWig input."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X
from locusgrid.sources import store


def bedgraph_columns(m: LocusFrame, sample: str, add_coverage: bool = False, style: str = "UCSC", zero_based: bool = False) -> list[Column]:
    """chr, start, end_, beta[, cov] of one sample."""
    at = F.col("start") - 1 if zero_based else F.col("start")
    cols = [X.seq_style(F.col("chr"), style).alias("chr"), at.alias("start"), (at + 1).alias("end_"), m.beta(sample).alias("beta")]
    return [*cols, *([m.cov(sample).alias("cov")] if add_coverage else [])]


def bedgraph_rows(m: LocusFrame, sample: str, rm_na: bool = True, **kw) -> DataFrame:
    """The rows of `bedgraph_columns`; rm_na leaves out those without beta."""
    df = m.df.where(m.beta(sample).isNotNull()) if rm_na else m.df
    return df.select(*bedgraph_columns(m, sample, **kw))


def write_bedgraphs(m: LocusFrame, out: str, force: bool = False, compress: bool = True, header: bool = True, rm_na: bool = True, **kw) -> list[str]:
    """One folder of sorted text files per sample; the first row of the first file is the track line. Existing ones are kept unless forced.
    All samples are written by one job, which computes and sorts the frame once, and their folders then moved to their names."""
    spark = m.df.sparkSession
    path = lambda s: f"{out}/{s}.bedGraph"
    todo = [s for s in m.samples if force or not store.exists(spark, path(s))]
    if not todo:
        return [path(s) for s in m.samples]
    cells = []
    for i, s in enumerate(todo):
        cols = bedgraph_columns(m, s, **kw)
        line = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in cols])
        cell = F.struct(F.lit(i).alias("_s"), F.lit(1).alias("_o"), cols[0], cols[1], line.alias("value"))
        cells.append(F.when(m.beta(s).isNotNull(), cell) if rm_na else cell)
    text = m.df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
    if header:
        tracks = [(i, 0, "", 0, f'track type=bedGraph name="{s}"') for i, s in enumerate(todo)]
        text = spark.createDataFrame(tracks, "_s int, _o int, chr string, start long, value string").unionByName(text)
    new = f"{out}/_bedgraphs-{uuid.uuid4().hex[:12]}"
    # the partition column leads the sort, so that the writer keeps the order within each sample
    text = text.orderBy("_s", "_o", "chr", "start").select("_s", "value")
    text.write.partitionBy("_s").option("compression", "gzip" if compress else "none").text(new)
    for i, s in enumerate(todo):
        store.move(spark, f"{new}/_s={i}", path(s))
    store.delete(spark, new)
    return [path(s) for s in m.samples]


def multibed(m: LocusFrame, style: str = "UCSC", rm_na: bool = False) -> DataFrame:
    """seqnames, start, end_, strand, then beta by sample; rm_na keeps loci that all samples cover."""
    df = m.df.where(X.row_count(m.betas) == len(m.samples)) if rm_na else m.df
    return df.select(X.seq_style(F.col("chr"), style).alias("seqnames"), "start", (F.col("start") + 1).alias("end_"), "strand", *[m.beta(s).alias(s) for s in m.samples])


def metilene(m: LocusFrame, group: str, **kw) -> DataFrame:
    """chr, pos and a column <group>_<sample> per sample."""
    if any(group not in m.coldata.get(s, {}) for s in m.samples):
        raise ValueError("metilene needs an annotation column that groups the samples")
    df = multibed(m, **kw)
    return df.select(F.col("seqnames").alias("chr"), F.col("start").alias("pos"), *[F.col(f"`{s}`").alias(f"{m.coldata[s][group]}_{s}") for s in m.samples])


def write_multibed(df: DataFrame, path: str, force: bool = False) -> str:
    df.orderBy(df.columns[0], df.columns[1]).write.mode("overwrite" if force else "errorifexists").csv(path, sep="\t", header=True, nullValue=".")
    return path


def to_bsseq(m: LocusFrame) -> DataFrame:
    """chr, pos, annotation, M__S = beta * cov and Cov__S, NULL as 0."""
    cols = [F.coalesce(m.beta(s) * m.cov(s), F.lit(0.0)).alias(f"M__{s}") for s in m.samples]
    cols += [F.coalesce(m.cov(s), F.lit(0)).alias(f"Cov__{s}") for s in m.samples]
    return m.df.select("chr", F.col("start").alias("pos"), *m.annotation, *cols)


def expression_matrix(m: LocusFrame) -> DataFrame:
    """Betas by probe_id, after `probe_subset`."""
    if "probe_id" not in m.annotation:
        raise ValueError("no probe_id; subset to probes first")
    return m.df.select("probe_id", *[m.beta(s).alias(s) for s in m.samples])
