"""Places of regular-expression matches as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusgrid.functions.expr import let, sums_before


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches comes from a split by the same pattern, so places are running sums of lengths; texts without a match cost
    one search.
    """
    kind = "array<struct<start:bigint,end:bigint,hit:string>>"

    def body(parts: Column, hits: Column) -> Column:
        gaps = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        make = lambda before: F.transform(hits, lambda h, i: F.struct((before[i] + F.length(parts[i])).cast("long").alias("start"), (before[i] + F.length(parts[i]) + F.length(h)).cast("long").alias("end"), h.alias("hit")))
        return let(sums_before(gaps), make)

    found = let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: body(parts, hits)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind)).cast(kind)


def written(spans: Column) -> Column:
    """kind:start:end of array<struct<.., kind, start, end>>, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
