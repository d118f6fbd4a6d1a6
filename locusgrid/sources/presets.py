"""Column layouts of known call formats, and the planner for custom ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusgrid.functions.expr import ratio

#: 1-based columns of each call format.
PRESETS: dict[str, dict[str, int]] = {
    "Bismark_cov": {"chr": 1, "start": 2, "beta": 4, "M": 5, "U": 6},
    "MethylDackel": {"chr": 1, "start": 2, "M": 5, "U": 6},
    "MethylcTools": {"chr": 1, "start": 2, "M": 6, "U": 7},
    "BisSNP": {"chr": 1, "start": 2, "beta": 4, "cov": 5},
    "BSseeker2_CGmap": {"chr": 1, "start": 3, "context": 4, "beta": 6, "cov": 8},
}
FIELDS = ("chr", "start", "end", "strand", "beta", "M", "U", "cov", "context")


@dataclass(frozen=True)
class Layout:
    """Positions of the fields in a file; `derive` fills in what is missing."""

    idx: dict[str, int]

    def __post_init__(self):
        have = set(self.idx)
        if unknown := have - set(FIELDS):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if not {"chr", "start"} <= have:
            raise ValueError("chromosome and start positions are mandatory")
        if len(set(self.idx.values())) != len(self.idx):
            raise ValueError("column indices repeat")
        if not {"beta", "cov"} & have and not {"M", "U"} <= have:
            raise ValueError("without beta and cov, both M and U are needed")
        if "cov" in have and "beta" not in have and not {"M", "U"} & have:
            raise ValueError("with cov only, M or U is needed to get beta")
        if "beta" in have and "cov" not in have and not {"M", "U"} <= have:
            raise ValueError("with beta only, M and U are needed to get cov")


def layout(pipeline: str | None = None, **idx: int | None) -> Layout:
    """A preset by name, or a custom layout from 1-based column indices."""
    if pipeline is not None:
        if pipeline not in PRESETS:
            raise ValueError(f"pipeline must be one of {', '.join(PRESETS)}")
        return Layout(PRESETS[pipeline])
    return Layout({k: v for k, v in idx.items() if v is not None})


def derived(have: set[str]) -> dict[str, Column]:
    """Expressions for M, U, cov and beta from the fields at hand, in terms of the columns M, U, cov, beta."""
    m, u, cov, beta = (F.col(c).cast("double") for c in ("M", "U", "cov", "beta"))
    if {"M", "U"} <= have:
        out = {"M": m, "U": u}
    elif "cov" in have and "M" in have:
        out = {"M": m, "U": cov - m}
    elif "cov" in have and "U" in have:
        out = {"M": cov - u, "U": u}
    else:
        whole = (cov * beta).cast("long").cast("double")  # truncates toward 0
        out = {"M": whole, "U": cov - whole}
    out["cov"] = cov if "cov" in have else out["M"] + out["U"]
    if "beta" in have:
        out["beta"] = beta
    elif "M" in have and "U" in have and "cov" not in have:
        out["beta"] = ratio(m, m + u)
    elif "M" in have:
        out["beta"] = ratio(m, out["cov"])
    else:
        out["beta"] = 1 - ratio(u, out["cov"])
    return out
