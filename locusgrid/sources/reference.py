"""Reference loci: motif scan over sequences, strand expansion, contig filter."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusgrid.functions import expr as X


def extract_loci(df: DataFrame, key: str, seq: str, motif: str = "CG", offset: str | None = None) -> DataFrame:
    """(key, start): the 1-based places of a motif in each row's sequence, overlapping ones too, after `offset` letters if a column is given.
    The sequence is split where the motif begins, so places are running sums of lengths: work in proportion to the text."""
    parts = F.split(seq, f"(?={re.escape(motif)})")
    before = F.col(offset) if offset else F.lit(0)
    # the first part begins with the motif only if the sequence does
    at = X.let(parts, lambda ps: F.slice(X.sums_before(F.transform(ps, F.length)), F.when(F.startswith(F.col(seq), F.lit(motif)), 1).otherwise(2), F.size(ps)))
    hits = df.where(F.contains(F.col(seq), F.lit(motif))).select(F.col(key), before.cast("long").alias("_o"), F.explode(at).alias("_p"))
    return hits.select(key, (F.col("_o") + F.col("_p") + 1).alias("start"))


def read_fasta(spark: SparkSession, path: str, over: int = 1) -> DataFrame:
    """(chr, offset, seq) of the lines of FASTA files: each line with the letters of its contig before it, in upper case, and the first
    `over` letters of the next line, so that what crosses a line end is seen once. A contig may span any number of tasks: lines are
    numbered within file blocks, and a table of blocks and contigs carries names and lengths from block to block. Lines that another
    of the same contig follows need `over` letters or more."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("v")).where("v <> ''")
    head = F.col("v").startswith(">")
    here = Window.partitionBy("file", "block").orderBy("row")
    lines = lines.withColumn("part", F.sum(F.when(head, 1).otherwise(0)).over(here)).withColumn("n", F.when(head, 0).otherwise(F.length("v")))
    name = F.when(head, F.split(F.substring("v", 2, 1 << 30), r"\s")[0])
    lines = lines.withColumn("before", F.sum("n").over(Window.partitionBy("file", "block", "part").orderBy("row")) - F.col("n"))
    lines = lines.withColumn("after", F.lead(F.substring("v", 1, over)).over(here))
    # a row a block and contig: names and lengths come from earlier blocks, a first line goes to the block before
    parts = lines.groupBy("file", "block", "part").agg(F.max(name).alias("name"), F.sum("n").alias("len"), F.min_by(F.substring("v", 1, over), "row").alias("first"))
    order = Window.partitionBy("file").orderBy("block", "part")
    parts = parts.withColumn("chr", F.last("name", True).over(order)).withColumn("next", F.lead("first").over(order))
    parts = parts.withColumn("base", F.sum("len").over(Window.partitionBy("file", "chr").orderBy("block", "part")) - F.col("len"))
    full = lines.where(~head).join(parts.select("file", "block", "part", "chr", "base", "next"), ["file", "block", "part"])
    tail = F.coalesce(F.when(F.col("after").isNotNull(), F.col("after")).otherwise(F.col("next")), F.lit(""))
    whole = F.when(tail.startswith(">"), F.col("v")).otherwise(F.concat("v", tail))
    return full.select("chr", (F.col("base") + F.col("before")).alias("offset"), F.upper(whole).alias("seq"), F.col("n").alias("letters"))


def extract_cpgs(spark: SparkSession, fasta: str) -> tuple[DataFrame, DataFrame]:
    """Reference loci (chr, start, strand, width 2) and contig lengths of a FASTA file."""
    seqs = read_fasta(spark, fasta)
    loci = extract_loci(seqs, "chr", "seq", offset="offset").select("chr", "start", (F.col("start") + 1).alias("end_"), F.lit(2).alias("width"), F.lit("+").alias("strand"))
    return loci, seqs.groupBy(F.col("chr").alias("contig")).agg(F.sum("letters").alias("length"))


def resolve(spark: SparkSession, ref, contigs: Sequence[str] | None = None) -> DataFrame:
    """(chr, start, strand) from a DataFrame, a Parquet path, or rows; distinct, and of the wanted contigs only."""
    if isinstance(ref, str):
        ref = spark.read.parquet(ref)
    elif not isinstance(ref, DataFrame):
        ref = spark.createDataFrame(ref, T.StructType([T.StructField("chr", T.StringType()), T.StructField("start", T.LongType())]))
    strand = F.col("strand") if "strand" in ref.columns else F.lit("*")
    out = ref.select("chr", F.col("start").cast("long").alias("start"), strand.alias("strand"))
    out = out.where(F.col("chr").isin(list(contigs))) if contigs is not None else out
    return out.where("chr IS NOT NULL AND start IS NOT NULL").dropDuplicates(["chr", "start"])


def expand_strands(ref: DataFrame) -> DataFrame:
    """`+` at start and `-` at start + 1, in one narrow pass."""
    both = F.array(F.struct(F.col("start").alias("start"), F.lit("+").alias("strand")), F.struct((F.col("start") + 1).alias("start"), F.lit("-").alias("strand")))
    return ref.select("chr", F.explode(both).alias("x")).select("chr", "x.start", "x.strand")


def loci_per_contig(ref: DataFrame) -> DataFrame:
    return ref.groupBy("chr").agg(F.count("*").alias("n"))
