"""PCA with samples as observations: the n x n Gram matrix is one aggregate, its eigenvectors are the driver's."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X
from locusgrid.operators.filters import complete_cases, sample_rows, subset
from locusgrid.operators.stats import top_variable


@dataclass(frozen=True)
class Pca:
    scores: DataFrame  # sample, PC1, PC2, ...
    variance: list[float]  # fractions, two places
    cumulative: list[float]


def gram(m: LocusFrame) -> DataFrame:
    """(i, j, value) for i <= j: sums over complete loci of centred products; a single pass with map-side combine."""
    mean = X.row_mean(m.betas)
    df = complete_cases(m).df.select(*[(b - mean).alias(f"c{i}") for i, b in enumerate(m.betas)])
    n = len(m.samples)
    sums = df.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)])
    cells = [F.struct(F.lit(m.samples[i]).alias("i"), F.lit(m.samples[j]).alias("j"), F.col(f"g{i}_{j}").alias("value")) for i in range(n) for j in range(i, n)]
    return sums.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def pca(m: LocusFrame, var: str = "top", top_var: int | None = 1000, regions: DataFrame | None = None, n_pc: int = 2, seed: int = 0) -> Pca:
    """Centred, unscaled PCA over loci of highest SD (top), random loci (rand), within regions if given. The driver gets n^2 numbers."""
    if var not in ("top", "rand"):
        raise ValueError("var must be top or rand")
    if n_pc < 2 or n_pc > len(m.samples):
        raise ValueError("n_pc must lie between 2 and the number of samples")
    m = complete_cases(subset(m, regions)) if regions is not None else complete_cases(m)
    if top_var is not None:
        m = top_variable(m, top_var) if var == "top" else sample_rows(m, top_var, seed)
    at = {s: i for i, s in enumerate(m.samples)}
    g = np.zeros((len(at), len(at)))
    for i, j, v in gram(m).collect():  # n (n + 1) / 2 rows
        g[at[i], at[j]] = g[at[j], at[i]] = v or 0.0
    lam, vec = np.linalg.eigh(g)
    lam, vec = np.clip(lam[::-1], 0, None), vec[:, ::-1]
    vec = vec * np.where(vec[np.abs(vec).argmax(0), np.arange(len(at))] < 0, -1.0, 1.0)  # sign: largest entry positive
    share = lam / lam.sum() if lam.sum() else lam
    rows = [(s, *map(float, vec[i, :n_pc] * np.sqrt(lam[:n_pc]))) for s, i in at.items()]
    scores = m.df.sparkSession.createDataFrame(rows, "sample string, " + ", ".join(f"PC{k + 1} double" for k in range(n_pc)))
    return Pca(scores, [round(float(x), 2) for x in share], [round(float(x), 2) for x in np.cumsum(share)])


def annotated(p: Pca, m: LocusFrame, columns: list[str]) -> DataFrame:
    """Scores with sample annotation, for a scatter plot."""
    rows = [(s, *[str(m.coldata.get(s, {}).get(c)) for c in columns]) for s in m.samples]
    ann = m.df.sparkSession.createDataFrame(rows, "sample string, " + ", ".join(f"`{c}` string" for c in columns))
    return p.scores.join(F.broadcast(ann), "sample", "left")  # one row a sample
