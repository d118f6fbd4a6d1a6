"""LocusFrame: two aligned locus x sample matrices (beta, cov) over one lazy DataFrame.

Wide layout: `chr, start, strand`, optional annotation columns, then `beta__S` and
`cov__S` for each sample S. Choosing samples is column pruning, row predicates are
narrow expressions. Rows have no order; `ordered()` sorts by contig, start and strand at a sink.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["chr", "start", "strand"]


def column(prefix: str, sample: str) -> Column:
    return F.col(f"`{prefix}__{sample}`")


@dataclass(frozen=True)
class LocusFrame:
    df: DataFrame
    samples: list[str]
    coldata: dict[str, dict] = field(default_factory=dict)  # sample -> annotation
    genome: str | None = None
    chrom_sizes: dict[str, int] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        want = [*KEY, *(f"{p}__{s}" for p in ("beta", "cov") for s in self.samples)]
        if missing := [c for c in want if c not in self.df.columns]:
            raise ValueError(f"columns missing: {missing}")
        if len(set(self.samples)) != len(self.samples):
            raise ValueError("sample names repeat")

    def __repr__(self) -> str:
        return f"LocusFrame({len(self.samples)} samples, reference {self.genome or 'unknown'})"

    def beta(self, sample: str) -> Column:
        return column("beta", sample)

    def cov(self, sample: str) -> Column:
        return column("cov", sample)

    @property
    def betas(self) -> list[Column]:
        return [self.beta(s) for s in self.samples]

    @property
    def covs(self) -> list[Column]:
        return [self.cov(s) for s in self.samples]

    @property
    def annotation(self) -> list[str]:
        """Row annotation columns beside the key."""
        own = {*KEY, *(f"{p}__{s}" for p in ("beta", "cov") for s in self.samples)}
        return [c for c in self.df.columns if c not in own]

    def with_df(self, df: DataFrame, **changes) -> LocusFrame:
        return replace(self, df=df, **changes)

    def ordered(self) -> DataFrame:
        return self.df.orderBy("chr", "start", "strand")

    def select_samples(self, samples: Sequence[str]) -> LocusFrame:
        if unknown := [s for s in samples if s not in self.samples]:
            raise ValueError(f"unknown samples: {unknown}")
        keep = [s for s in self.samples if s in set(samples)]
        cols = [*KEY, *self.annotation, *(f"beta__{s}" for s in keep), *(f"cov__{s}" for s in keep)]
        return self.with_df(self.df.select(*[f"`{c}`" for c in cols]), samples=keep, coldata={s: self.coldata[s] for s in keep if s in self.coldata})

    def __getitem__(self, item) -> LocusFrame:
        """m[predicate, samples]: a Column condition (or slice(None)) and a list of names or positions."""
        rows, cols = item if isinstance(item, tuple) else (item, slice(None))
        out = self if isinstance(rows, slice) else self.with_df(self.df.where(rows))
        if isinstance(cols, slice):
            cols = self.samples[cols]
        return out.select_samples([self.samples[c] if isinstance(c, int) else c for c in cols])

    def to_long(self) -> DataFrame:
        """chr, start, strand, sample, beta, cov: one narrow pass, no shuffle."""
        cells = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), self.beta(s).cast("double").alias("beta"), self.cov(s).cast("long").alias("cov")) for s in self.samples]))
        return self.df.select(*KEY, cells.alias("cell")).select(*KEY, "cell.*")

    def to_arrays(self) -> DataFrame:
        """The layout for many samples: beta and cov as arrays in sample order, which keeps rows narrow enough for code generation."""
        return self.df.select(*KEY, *self.annotation, F.array(*[c.cast("double") for c in self.betas]).alias("beta"), F.array(*[c.cast("long") for c in self.covs]).alias("cov"))

    @classmethod
    def from_arrays(cls, df: DataFrame, samples: list[str], **more) -> LocusFrame:
        rest = [c for c in df.columns if c not in ("beta", "cov")]
        cols = [F.element_at("beta", i + 1).alias(f"beta__{s}") for i, s in enumerate(samples)]
        cols += [F.element_at("cov", i + 1).alias(f"cov__{s}") for i, s in enumerate(samples)]
        return cls(df.select(*rest, *cols), samples, **more)

    @classmethod
    def from_long(cls, df: DataFrame, samples: list[str], **more) -> LocusFrame:
        """From (chr, start, strand, sample, beta, cov), one row per cell: a pivot with named values, so one shuffle with map-side combine."""
        one = lambda c, s: F.max(F.when(F.col("sample") == s, F.col(c)))
        aggs = [one(p, s).alias(f"{p}__{s}") for p in ("beta", "cov") for s in samples]
        return cls(df.groupBy(*KEY).agg(*aggs), samples, **more)
