"""The QC report: tables as TSV, a density file for each sample, and one HTML page with inline SVG figures."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.operators import filters, stats


def report_tables(m: LocusFrame, ref_counts: DataFrame, n_density: int = 10_000, seed: int = 0) -> dict[str, DataFrame]:
    """The tables by file name. Density rows come from loci that all samples cover, at most n_density of them."""
    some = filters.sample_rows(filters.complete_cases(m), n_density, seed)
    out = {
        "MC_per_chr": stats.get_stats(m, True),
        "global_MC_per_samp": stats.get_stats(m, False),
        "n_covered_per_chr": stats.n_covered(m, ref_counts),
        "n_covered_by_all_samples": stats.n_complete(m, ref_counts),
        "density": stats.density(some.to_long()),
    }
    if m.chrom_sizes:
        out["contig_lens"] = m.df.sparkSession.createDataFrame(list(m.chrom_sizes.items()), "contig string, length long")
    return out


def read_tables(spark: SparkSession, folder: str, prefix: str = "") -> dict[str, DataFrame]:
    """The tables that write_report left in a folder, by name; `density` holds all samples."""
    name = lambda k: f"{folder}/{prefix + '_' if prefix else ''}{k}"
    read = lambda path: spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    out = {k: read(f"{name(k)}.tsv") for k in TABLES}
    return out | {"density": read(f"{name('density')}.tsv").select("sample", "x", "density")}


TABLES = ("MC_per_chr", "global_MC_per_samp", "n_covered_per_chr", "n_covered_by_all_samples")


def bars(rows: list[tuple[str, float]], title: str) -> str:
    """A bar chart as SVG text."""
    top = max([v for _, v in rows if v is not None], default=1) or 1
    body = "".join(f'<text x="0" y="{20 * i + 34}" font-size="12">{escape(str(k))}</text><rect x="120" y="{20 * i + 22}" width="{300 * (v or 0) / top:.1f}" height="14" fill="#4477aa"/><text x="430" y="{20 * i + 34}" font-size="12">{(v or 0):.4g}</text>' for i, (k, v) in enumerate(rows))
    return f'<svg width="520" height="{20 * len(rows) + 40}"><text x="0" y="14" font-weight="bold">{escape(title)}</text>{body}</svg>'


def curves(rows: list[tuple[str, float, float]], title: str) -> str:
    """A line for each name over x in [0, 1], as SVG text. rows: (name, x, y) in order."""
    top = max((y for _, _, y in rows), default=1) or 1
    by: dict[str, list[str]] = {}
    for k, x, y in rows:
        by.setdefault(k, []).append(f"{20 + 400 * x:.1f},{200 - 170 * y / top:.1f}")
    body = "".join(f'<polyline fill="none" stroke="#4477aa" stroke-opacity="{0.4 + 0.6 * (i + 1) / len(by):.2f}" points="{" ".join(p)}"><title>{escape(str(k))}</title></polyline>' for i, (k, p) in enumerate(by.items()))
    return f'<svg width="440" height="220"><text x="0" y="14" font-weight="bold">{escape(title)}</text>{body}</svg>'


def table(df: DataFrame, limit: int, file: str) -> str:
    """The first rows as HTML; what is left out is said, and where it stands."""
    rows = df.orderBy(*df.columns[:2]).limit(limit + 1).collect()
    more = f"<p>Only the first {limit} rows; all are in {escape(file)}.</p>" if len(rows) > limit else ""
    rows = rows[:limit]
    cell = lambda v: escape(f"{v:.4g}" if isinstance(v, float) else str(v))
    return "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>" + more


def write_report(m: LocusFrame, ref_counts: DataFrame, out: str, prefix: str = "", page_rows: int = 2000) -> str:
    """Writes the TSV tables and report.html through Spark; returns the folder of the page. Tables are computed once and read again for the
    page, which shows page_rows rows of each."""
    spark, tables = m.df.sparkSession, report_tables(m, ref_counts)
    name = lambda k: f"{out}/{prefix + '_' if prefix else ''}{k}"
    for k, df in tables.items():
        if k == "density":  # a folder for each sample
            df.withColumn("_s", F.col("sample")).repartition("_s").sortWithinPartitions("x").write.mode("overwrite").partitionBy("_s").csv(f"{name(k)}.tsv", sep="\t", header=True)
        else:
            df.coalesce(1).write.mode("overwrite").csv(f"{name(k)}.tsv", sep="\t", header=True)
    saved = read_tables(spark, out, prefix)
    mean = saved["global_MC_per_samp"].select("sample", "mean_meth", "mean_cov").orderBy("sample").collect()  # a row a sample
    covered = saved["n_covered_per_chr"].groupBy("sample").agg(F.sum("n_covered")).orderBy("sample").collect()
    shared = saved["n_covered_by_all_samples"].select("chr", "n_complete").orderBy("chr").limit(page_rows).collect()
    lines = saved["density"].orderBy("sample", "x").collect()  # 512 points a sample
    figures = bars([(r[0], r[1]) for r in mean], "mean methylation") + bars([(r[0], r[2]) for r in mean], "mean coverage") + bars([(r[0], r[1]) for r in covered], "covered loci") + bars([(r[0], r[1]) for r in shared], "loci covered by all samples")
    figures += curves([(r[0], r[1], r[2]) for r in lines], "methylation density")
    html = "<html><head><title>QC report</title></head><body><h1>QC report</h1>" + figures + "".join(f"<h2>{escape(k)}</h2>{table(saved[k], page_rows, f'{k}.tsv')}" for k in TABLES) + "</body></html>"
    spark.createDataFrame([(html,)], "value string").coalesce(1).write.mode("overwrite").text(f"{name('report')}.html")
    return f"{name('report')}.html"
