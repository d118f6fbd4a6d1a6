"""locusgrid: locus-by-sample methylation matrices as lazy Spark DataFrames."""

from locusgrid.frame import LocusFrame

__all__ = ["LocusFrame"]
