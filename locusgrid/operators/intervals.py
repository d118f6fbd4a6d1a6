"""Interval joins of loci [s, s + 1] with closed regions [rs, re] on the same contig.

Loci get the bin of their start and regions are exploded over the bins they touch, so
that the join key is (chr, bin): a locus meets the regions of its bin, not of its contig,
and no contig becomes one hot key. Bins are wide enough that regions make five rows each
on average at most. Regions of a checked number are broadcast, more are shuffled. A pair
appears exactly once in either form.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("within", "any", "start", "end", "equal")
#: Regions up to this many rows are broadcast (about 64 bytes each).
BROADCAST_ROWS = 100_000
BIN = 1 << 14


def cast_regions(regions: DataFrame) -> DataFrame:
    """Regions as (rid, chr, r_start, r_end): by name if the names are there, else the first three columns, with a warning."""
    if not isinstance(regions, DataFrame):
        raise TypeError("regions must be a DataFrame")
    cols = regions.columns
    if len(cols) < 3:
        raise ValueError("regions need chr, start and end")
    named = next((n for n in (("chr", "r_start", "r_end"), ("chr", "start", "end")) if set(n) <= set(cols)), None)
    if named is None:
        warnings.warn(f"no columns chr, start and end: taking {', '.join(cols[:3])}", stacklevel=2)
    a, b, c = named or cols[:3]
    rid = F.col("rid").cast("long") if "rid" in cols else F.monotonically_increasing_id()
    return regions.select(rid.alias("rid"), F.col(a).alias("chr"), F.col(b).cast("long").alias("r_start"), F.col(c).cast("long").alias("r_end"))


def predicate(kind: str, s: Column, rs: Column, re: Column) -> Column:
    if kind not in KINDS:
        raise ValueError(f"overlap type must be one of {', '.join(KINDS)}")
    return {"within": (s >= rs) & (s + 1 <= re), "any": (s <= re) & (s + 1 >= rs), "start": s == rs, "end": s + 1 == re, "equal": (s == rs) & (s + 1 == re)}[kind]


def interval_join(loci: DataFrame, regions: DataFrame, kind: str = "within", how: str = "inner", broadcast: bool | None = None, width: int | None = None) -> DataFrame:
    """loci join cast_regions() by overlap; how: inner, left_semi or left_anti. What is not given follows from the regions' number and
    total length, one small aggregate."""
    length = F.greatest(F.col("r_end") - F.col("r_start"), F.lit(0))
    if broadcast is None or width is None:
        n, total = regions.agg(F.count("*"), F.sum(length)).first()
        broadcast = n <= BROADCAST_ROWS if broadcast is None else broadcast
        width = width or max(BIN, (total or 0) // max(1, 3 * n))
    # a pair of any kind has s in [rs - 1, re]: one bin for the locus, all touched bins for the region
    bins = F.explode(F.sequence(F.floor((F.col("r_start") - 1) / width), F.floor(F.col("r_end") / width)))
    r = regions.where("r_end >= r_start").withColumn("_bin", bins)
    r = (F.broadcast(r) if broadcast else r).alias("r")
    l = loci.withColumn("_bin", F.floor(F.col("start") / width)).alias("l")
    on = (F.col("l.chr") == F.col("r.chr")) & (F.col("l._bin") == F.col("r._bin")) & predicate(kind, F.col("l.start"), F.col("r.r_start"), F.col("r.r_end"))
    out = l.join(r, on, how)
    left = [F.col(f"l.`{c}`") for c in loci.columns]
    return out.select(*left) if how != "inner" else out.select(*left, F.col("r.rid"), F.col("r.r_start"), F.col("r.r_end"))
