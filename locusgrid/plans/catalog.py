"""Every operator as a query over the driver's tables, with the SQL that DuckDB answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X
from locusgrid.operators import annotate, combine, filters, pca, regions, stats
from locusgrid.operators.intervals import KINDS
from locusgrid.plans import fixtures as fx
from locusgrid.plans.fixtures import COLDATA, SAMPLES, with_views
from locusgrid.sinks import export
from locusgrid.sources import calls, reference, store
from locusgrid.sources.presets import layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return put


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`").cast("double"), 6) for n in names})


def flat(m: LocusFrame, covs: bool = True) -> DataFrame:
    """chr, start, b1.. and c1..: a frame in the shape that the SQL returns."""
    cols = [F.round(m.beta(s), 6).alias(f"b{s[1:]}") for s in m.samples]
    cols += [m.cov(s).cast("long").alias(f"c{s[1:]}") for s in m.samples] if covs else []
    return m.df.select("chr", "start", *cols)


def flat_sql(where: str = "", samples=SAMPLES, source: str = "fx_wide", covs: bool = True) -> str:
    n = [s[1:] for s in samples]
    cols = [f"round(b{i}, 6) AS b{i}" for i in n] + ([f"CAST(c{i} AS BIGINT) AS c{i}" for i in n] if covs else [])
    return f"SELECT chr, start, {', '.join(cols)} FROM {source} w {where}"


#: ---- ingest ----
query("align_left_join", flat_sql())(lambda s, d: flat(fx.frame(s, d)))
query("missing_loci_anti", "SELECT chr, start FROM fx_ref r WHERE NOT EXISTS (SELECT 1 FROM fx_bg b WHERE b.chr = r.chr AND b.start = r.start)")(lambda s, d: calls.missing_loci(fx.reference(s, d), fx.cells(s, d)).select("chr", "start"))
query("nonref_counts", "SELECT sample, count(*) AS n FROM fx_bg b WHERE NOT EXISTS (SELECT 1 FROM fx_ref r WHERE b.chr = r.chr AND b.start = r.start) GROUP BY sample")(lambda s, d: calls.foreign_records(fx.reference(s, d), fx.cells(s, d)).groupBy("sample").agg(F.count("*").alias("n")))


@query("dedupe_first", "SELECT chr, start, sample, CAST(m AS DOUBLE) AS m, CAST(u AS DOUBLE) AS u, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY chr, start, sample ORDER BY l_orderkey, l_shipdate, l_extendedprice, m, u) AS k FROM fx_raw) t WHERE k = 1")
def dedupe_first(s, d):
    order = [F.col(c) for c in ("l_orderkey", "l_shipdate", "l_extendedprice", "M", "U")]
    out = calls.first_record(fx.records(s, d), order)
    return out.select("chr", "start", "sample", F.col("M").alias("m"), F.col("U").alias("u"), "l_orderkey")


def derive_query(name: str, have: dict[str, str]):
    sql = {"cov": "m + u", "beta": "m / (m + u)", "M": "m", "U": "u"}
    m, u = "m", "u"
    if {"beta", "cov"} == set(have):
        m = "CAST(trunc((m + u) * (m / (m + u))) AS DOUBLE)"
        u = f"(m + u) - {m}"
    text = f"SELECT chr, start, sample, CAST({m} AS DOUBLE) AS m, CAST({u} AS DOUBLE) AS u, CAST(m + u AS DOUBLE) AS cov, round(m / (m + u), 6) AS beta FROM fx_bg"

    @query(name, text)
    def run(s, d):
        df = fx.view(s, d, "fx_bg").select("chr", "start", "sample", *[F.expr(sql[c]).alias(c) for c in have])
        return calls.derive(df).select("chr", "start", "sample", F.col("M").alias("m"), F.col("U").alias("u"), "cov", F.round("beta", 6).alias("beta"))


derive_query("derive_columns_m_u", dict.fromkeys(("M", "U")))
derive_query("derive_columns_m_cov", dict.fromkeys(("M", "cov")))
derive_query("derive_columns_u_cov", dict.fromkeys(("U", "cov")))
derive_query("derive_columns_beta_cov", dict.fromkeys(("beta", "cov")))


@query("percent_to_fraction", "SELECT chr, start, sample, round(m / (m + u), 6) AS beta FROM fx_bg")
def percent(s, d):
    top = F.when(F.col("sample") == "S1", 1.0).otherwise(100.0)  # S1 holds fractions already
    df = fx.view(s, d, "fx_bg").select("chr", "start", "sample", (F.col("m") / (F.col("m") + F.col("u")) * top).alias("beta"))
    return rounded(calls.percent_to_fraction(df).select("chr", "start", "sample", "beta"), "beta")


query("zero_based_shift", "SELECT chr, start + 1 AS start, sample, m FROM fx_bg")(lambda s, d: calls.one_based(fx.view(s, d, "fx_bg").select("chr", "start", "sample", "m")))
query("prefix_fix", "SELECT replace(chr, 'chr', '') AS plain, chr AS prefixed, count(*) AS n FROM fx_bg GROUP BY 1, 2")(lambda s, d: calls.match_contigs(calls.match_contigs(fx.view(s, d, "fx_bg").select("chr"), False).withColumn("plain", F.col("chr")), True).groupBy("plain", F.col("chr").alias("prefixed")).agg(F.count("*").alias("n")))
query("contig_filter", "SELECT chr, start FROM fx_ref WHERE chr IN ('chr1', 'chr3')")(lambda s, d: reference.resolve(s, fx.view(s, d, "fx_ref"), ["chr1", "chr3"]).select("chr", "start"))
query("strand_expand", "SELECT chr, start, '+' AS strand FROM fx_ref UNION ALL SELECT chr, start + 1, '-' FROM fx_ref")(lambda s, d: reference.expand_strands(fx.reference(s, d)))
query("synced_coordinates", "SELECT chr, start + CASE WHEN strand = '-' THEN 1 ELSE 0 END AS start, strand, sample, count(*) AS n FROM fx_raw GROUP BY 1, 2, 3, 4")(lambda s, d: calls.sync_strands(fx.records(s, d)).groupBy("chr", "start", "strand", "sample").agg(F.count("*").alias("n")))


@query("strand_collapse", "SELECT chr, start, sample, m, u, m + u AS cov, round(m / (m + u), 6) AS beta FROM fx_bg")
def strand_collapse(s, d):
    out = calls.collapse_strands(calls.sync_strands(fx.records(s, d)))
    return rounded(out.select("chr", "start", "sample", F.col("M").alias("m"), F.col("U").alias("u"), "cov", "beta"), "beta")


query("reference_counts", "SELECT chr, count(*) AS n FROM fx_ref GROUP BY chr")(lambda s, d: reference.loci_per_contig(fx.reference(s, d)))
STAT = "round(avg(beta), 6) AS mean_meth, round(median(beta), 6) AS median_meth, round(avg(cov), 6) AS mean_cov, round(median(cov), 6) AS median_cov"
INGEST = ("mean_meth", "median_meth", "mean_cov", "median_cov")
query("ingest_genome_stat", f"SELECT sample, {STAT} FROM fx_long WHERE beta IS NOT NULL GROUP BY sample")(lambda s, d: rounded(calls.ingest_stats(fx.frame(s, d))[0], *INGEST))
query("ingest_chr_stat", f"SELECT chr, sample, {STAT} FROM fx_long WHERE beta IS NOT NULL GROUP BY chr, sample")(lambda s, d: rounded(calls.ingest_stats(fx.frame(s, d))[1], *INGEST))
query("ncpg_pivot", "SELECT chr, count(b1) AS S1, count(b2) AS S2, count(b3) AS S3, count(b4) AS S4 FROM fx_wide GROUP BY chr")(lambda s, d: calls.ingest_stats(fx.frame(s, d))[2])
query("outer_merge", "SELECT chr, start, " + ", ".join(f"round(max(CASE WHEN sample = '{x}' THEN m / (m + u) END), 6) AS b{x[1]}" for x in SAMPLES) + ", " + ", ".join(f"CAST(coalesce(max(CASE WHEN sample = '{x}' THEN m + u END), 0) AS BIGINT) AS c{x[1]}" for x in SAMPLES) + " FROM fx_bg GROUP BY chr, start")(lambda s, d: flat(calls.outer(fx.cells(s, d), SAMPLES)))

#: ---- filters ----
ge10 = " + ".join(f"CASE WHEN c{i} >= 10 THEN 1 ELSE 0 END" for i in range(1, 5))
pair = lambda a, b: f"(CASE WHEN c{a} >= 10 THEN 1 ELSE 0 END + CASE WHEN c{b} >= 10 THEN 1 ELSE 0 END)"
query("coverage_filter", flat_sql(f"WHERE {ge10} >= 2"))(lambda s, d: flat(filters.coverage_filter(fx.frame(s, d), 10, 2)))
query("coverage_filter_prop", flat_sql(f"WHERE {ge10} >= 3"))(lambda s, d: flat(filters.coverage_filter(fx.frame(s, d), 10, 1, 0.7)))
query("coverage_filter_group", flat_sql(f"WHERE {pair(1, 2)} >= 1 AND {pair(3, 4)} >= 1"))(lambda s, d: flat(filters.coverage_filter(fx.frame(s, d), 10, 1, group="cond")))
query("remove_uncovered", flat_sql("WHERE coalesce(c1, c2, c3, c4) IS NOT NULL"))(lambda s, d: flat(filters.remove_uncovered(fx.frame(s, d))))
query("complete_cases", flat_sql("WHERE b1 + b2 + b3 + b4 IS NOT NULL"))(lambda s, d: flat(filters.complete_cases(fx.frame(s, d))))
query("any_missing", "SELECT chr, start, b1 + b2 + b3 + b4 IS NULL AS any_na FROM fx_wide")(lambda s, d: filters.any_missing(fx.frame(s, d)).select("chr", "start", "any_na"))
query("bracket_subset", flat_sql("WHERE start <= 2000", ["S1", "S3"]))(lambda s, d: flat(fx.frame(s, d)[F.col("start") <= 2000, [0, 2]]))


def mask_sql(low: int | None, p: float | None) -> str:
    lo = [f"CASE WHEN c{i} >= {low} THEN c{i} END" if low else f"c{i}" for i in range(1, 5)]
    views = "lo AS (SELECT chr, start, b1, b2, b3, b4, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(lo, 1)) + " FROM fx_wide)"
    ok = [f"w.c{i} IS NOT NULL" for i in range(1, 5)]
    tail = ""
    if p:
        views += ", q AS (SELECT " + ", ".join(f"quantile_cont(c{i}, {p}) AS q{i}" for i in range(1, 5)) + " FROM lo)"
        ok, tail = [f"w.c{i} <= q.q{i}" for i in range(1, 5)], " CROSS JOIN q"
    cols = [f"round(CASE WHEN {ok[i - 1]} THEN w.b{i} END, 6) AS b{i}" for i in range(1, 5)] + [f"CAST(CASE WHEN {ok[i - 1]} THEN w.c{i} END AS BIGINT) AS c{i}" for i in range(1, 5)]
    body = f"SELECT w.chr, w.start, {', '.join(cols)} FROM lo w{tail}"
    head = with_views("SELECT 1 FROM fx_wide").removesuffix("SELECT 1 FROM fx_wide").rstrip()
    return f"{head},\n{views}\n{body}"


for _name, _low, _p in (("mask_low", 10, None), ("mask_high_quantile", None, 0.99), ("mask_both", 5, 0.95)):
    QUERIES[_name] = lambda s, d, low=_low, p=_p: flat(filters.mask(fx.frame(s, d), low, p)[0])
    ORACLE[_name] = mask_sql(_low, _p)
query("mask_counts", "SELECT l.sample, count_if(cov < 10) AS n_low, count_if(cov >= 10 AND cov > q) AS n_high FROM fx_long l JOIN (SELECT sample, quantile_cont(cov, 0.9) AS q FROM fx_long WHERE cov >= 10 GROUP BY sample) t ON t.sample = l.sample GROUP BY l.sample")(lambda s, d: filters.mask(fx.frame(s, d), 10, 0.9)[1])
query("get_matrix_m", "SELECT " + ", ".join(f"round(b{i}, 6) AS S{i}" for i in range(1, 5)) + " FROM fx_wide")(lambda s, d: rounded(filters.get_matrix(fx.frame(s, d)), *SAMPLES))
query("get_matrix_c_loci", "SELECT chr, start, '*' AS strand, start + 1 AS end_, " + ", ".join(f"CAST(c{i} AS BIGINT) AS S{i}" for i in range(1, 5)) + " FROM fx_wide")(lambda s, d: filters.get_matrix(fx.frame(s, d), "C", True, True).withColumns({x: F.col(x).cast("long") for x in SAMPLES}))
query("subset_contigs", flat_sql("WHERE chr IN ('chr2', 'chr5')"))(lambda s, d: flat(filters.subset(fx.frame(s, d), contigs=["chr2", "chr5"])))
query("subset_samples", flat_sql("", ["S2", "S4"]))(lambda s, d: flat(filters.subset(fx.frame(s, d), samples=["S2", "S4"])))

ON = {
    "within": "w.start >= r.r_start AND w.start + 1 <= r.r_end", "any": "w.start <= r.r_end AND w.start + 1 >= r.r_start",
    "start": "w.start = r.r_start", "end": "w.start + 1 = r.r_end", "equal": "w.start = r.r_start AND w.start + 1 = r.r_end",
}
for _k in KINDS:
    QUERIES[f"subset_regions_{_k}"] = lambda s, d, k=_k: flat(filters.subset(fx.frame(s, d), fx.view(s, d, "fx_regions_ov"), overlap=k))
    ORACLE[f"subset_regions_{_k}"] = with_views(flat_sql(f"WHERE EXISTS (SELECT 1 FROM fx_regions_ov r WHERE r.chr = w.chr AND {ON[_k]})"))
query("subset_regions_binned", flat_sql(f"WHERE EXISTS (SELECT 1 FROM fx_regions_ov r WHERE r.chr = w.chr AND {ON['any']})"))(lambda s, d: flat(filters.subset(fx.frame(s, d), fx.view(s, d, "fx_regions_ov"), overlap="any", broadcast=False)))
query("region_filter", flat_sql(f"WHERE NOT EXISTS (SELECT 1 FROM fx_regions r WHERE r.chr = w.chr AND {ON['within']})"))(lambda s, d: flat(filters.region_filter(fx.frame(s, d), fx.view(s, d, "fx_regions"))))

#: ---- region summaries ----
SQL_AGG = {"mean": "avg", "median": "median", "min": "min", "max": "max", "sum": "sum", "sd": "stddev_samp"}


def summary_sql(how: str, kind: str, overlap: str, source: str) -> str:
    cols = ", ".join(f"round(CAST({SQL_AGG[how]}(w.{kind}{i}) AS DOUBLE), 6) AS S{i}" for i in range(1, 5))
    return f"SELECT r.rid, r.chr, r.r_start, r.r_end, count(*) AS n_overlap, {cols} FROM {source} r JOIN fx_wide w ON w.chr = r.chr AND {ON[overlap]} GROUP BY r.rid, r.chr, r.r_start, r.r_end"


for _how in SQL_AGG:
    for _kind in ("M", "C"):
        _name = f"region_summary_{_how}" + ("" if _kind == "M" else "_cov")
        QUERIES[_name] = lambda s, d, h=_how, k=_kind: rounded(regions.region_summary(fx.frame(s, d), fx.view(s, d, "fx_regions"), k, h), *SAMPLES)
        ORACLE[_name] = with_views(summary_sql(_how, "b" if _kind == "M" else "c", "within", "fx_regions"))
query("region_summary_overlapping", summary_sql("mean", "b", "any", "fx_regions_ov"))(lambda s, d: rounded(regions.region_summary(fx.frame(s, d), fx.view(s, d, "fx_regions_ov"), "M", "mean", "any", broadcast=False), *SAMPLES))

#: ---- statistics ----
FULL = "round(avg(beta), 6) AS mean_meth, round(median(beta), 6) AS median_meth, round(stddev_samp(beta), 6) AS sd_meth, round(avg(cov), 6) AS mean_cov, round(median(cov), 6) AS median_cov, round(stddev_samp(cov), 6) AS sd_cov"
SIX = ("mean_meth", "median_meth", "sd_meth", "mean_cov", "median_cov", "sd_cov")
query("stats_per_chr", f"SELECT chr, sample, {FULL} FROM fx_long GROUP BY chr, sample")(lambda s, d: rounded(stats.get_stats(fx.frame(s, d)), *SIX))
query("stats_global", f"SELECT sample, {FULL} FROM fx_long GROUP BY sample")(lambda s, d: rounded(stats.get_stats(fx.frame(s, d), False), *SIX))
KEPT = f"SELECT chr, start FROM fx_wide WHERE {ge10} >= 2"


@query("stats_well_covered", f"SELECT l.chr, l.sample, {FULL} FROM fx_long l JOIN ({KEPT}) k ON k.chr = l.chr AND k.start = l.start GROUP BY l.chr, l.sample")
def stats_well_covered(s, d):
    """The flagship: align, drop uncovered loci, keep well covered ones, statistics by contig and sample."""
    m = filters.coverage_filter(filters.remove_uncovered(fx.frame(s, d)), 10, 2)
    return rounded(stats.get_stats(m), *SIX)


query("column_stat_sum", "SELECT " + ", ".join(f"CAST(sum(c{i}) AS BIGINT) AS S{i}" for i in range(1, 5)) + " FROM fx_wide")(lambda s, d: stats.column_stat(fx.frame(s, d), "sum", "C").select(*[F.col(x).cast("long").alias(x) for x in SAMPLES]))
for _how in ("mean", "median", "min", "max"):
    QUERIES[f"column_stat_{_how}"] = lambda s, d, h=_how: rounded(stats.column_stat(fx.frame(s, d), h), *SAMPLES)
    ORACLE[f"column_stat_{_how}"] = with_views("SELECT " + ", ".join(f"round({SQL_AGG[_how]}(b{i}), 6) AS S{i}" for i in range(1, 5)) + " FROM fx_wide")
query("column_quantile", "SELECT " + ", ".join(f"round(quantile_cont(c{i}, 0.9), 6) AS S{i}" for i in range(1, 5)) + " FROM fx_wide")(lambda s, d: rounded(stats.column_quantile(fx.frame(s, d), 0.9), *SAMPLES))
query("order_by_sd_top", "SELECT chr, start, round(sd, 6) AS sd FROM (SELECT chr, start, CASE WHEN count(beta) = 4 THEN stddev_samp(beta) END AS sd FROM fx_long GROUP BY chr, start) t ORDER BY round(sd, 9) DESC NULLS LAST, chr, start LIMIT 100")(lambda s, d: (lambda m: stats.with_sd(m.with_df(stats.order_by_sd(m, 9).limit(100))).select("chr", "start", F.round("_sd", 6).alias("sd")))(fx.frame(s, d)))
# to nine places first: two engines' sums may lie on either side of a tie of the sixth
query("row_variance", "SELECT chr, start, round(round(var_samp(beta), 9), 6) AS v FROM fx_long GROUP BY chr, start")(lambda s, d: (lambda m: m.df.select("chr", "start", F.round(F.round(X.row_var(m.betas), 9), 6).alias("v")))(fx.frame(s, d)))
query("report_n_covered", "SELECT t.chr, t.sample, t.n_covered, r.total, round(t.n_covered / r.total, 6) AS fraction FROM (SELECT chr, sample, count(beta) AS n_covered FROM fx_long GROUP BY chr, sample) t JOIN (SELECT chr, count(*) AS total FROM fx_ref GROUP BY chr) r ON r.chr = t.chr")(lambda s, d: rounded(stats.n_covered(fx.frame(s, d), reference.loci_per_contig(fx.reference(s, d))), "fraction"))
query("report_complete", "SELECT w.chr, count_if(b1 + b2 + b3 + b4 IS NOT NULL) AS n_complete, count(*) AS total, round(count_if(b1 + b2 + b3 + b4 IS NOT NULL) / count(*), 6) AS fraction FROM fx_wide w GROUP BY w.chr")(lambda s, d: rounded(stats.n_complete(fx.frame(s, d), reference.loci_per_contig(fx.reference(s, d))), "fraction"))
query("coverage_histogram", "SELECT sample, CAST(cov AS BIGINT) AS cov, count(*) AS n FROM fx_long WHERE cov <= 100 GROUP BY 1, 2")(lambda s, d: stats.histogram(fx.frame(s, d)))


@query("beta_density", "SELECT l.sample, CAST(g.i AS INTEGER) AS i, round(sum(exp(-0.5 * power((g.i / 63.0 - l.beta) / 0.05, 2))) / (count(*) * 0.05 * 2.5066282746310002), 5) AS density FROM fx_long l CROSS JOIN (SELECT unnest(range(64)) AS i) g WHERE l.beta IS NOT NULL GROUP BY 1, 2")
def beta_density(s, d):
    out = stats.density(fx.frame(s, d).to_long(), points=64, bw=0.05)
    return out.select("sample", F.round(F.col("x") * 63).cast("int").alias("i"), F.round("density", 5).alias("density"))


BOX = "CAST(min({0}) AS DOUBLE) AS lowest, round(quantile_cont({0}, 0.25), 6) AS q1, round(quantile_cont({0}, 0.5), 6) AS med, round(quantile_cont({0}, 0.75), 6) AS q3, CAST(max({0}) AS DOUBLE) AS highest"
query("beta_five_numbers", f"SELECT sample, {BOX.format('beta')} FROM fx_long GROUP BY sample")(lambda s, d: rounded(stats.five_numbers(fx.frame(s, d).to_long(), "sample", "beta"), "q1", "med", "q3"))
query("covered_five_numbers", f"SELECT chr, {BOX.format('n')} FROM (SELECT chr, sample, count(beta) AS n FROM fx_long GROUP BY chr, sample) t GROUP BY chr")(lambda s, d: rounded(stats.five_numbers(stats.n_covered(fx.frame(s, d)), "chr", "n_covered"), "lowest", "q1", "med", "q3", "highest"))
_H = "(0.9 * least(sd, coalesce(nullif(iqr / 1.34, 0), sd)) * power(n, -0.2))"
_STAT = "SELECT sample, count(*) AS n, stddev_samp(beta) AS sd, quantile_cont(beta, 0.75) - quantile_cont(beta, 0.25) AS iqr FROM fx_long WHERE beta IS NOT NULL GROUP BY sample"


@query("violin", f"SELECT l.sample, CAST(g.i AS INTEGER) AS i, round(sum(exp(-0.5 * power((g.i / 31.0 - l.beta) / h, 2))) / (count(*) * max(h) * 2.5066282746310002), 5) AS density, -round(sum(exp(-0.5 * power((g.i / 31.0 - l.beta) / h, 2))) / (count(*) * max(h) * 2.5066282746310002), 5) AS mirror FROM fx_long l JOIN (SELECT sample, {_H} AS h FROM ({_STAT}) z) t ON t.sample = l.sample CROSS JOIN (SELECT unnest(range(32)) AS i) g WHERE l.beta IS NOT NULL GROUP BY 1, 2")
def violin(s, d):
    """Default bandwidth."""
    out = stats.violin(fx.frame(s, d).to_long(), points=32)
    return out.select("sample", F.round(F.col("x") * 31).cast("int").alias("i"), F.round("density", 5).alias("density"), F.round("mirror", 5).alias("mirror"))


query("coverage_by_group", "SELECT CASE WHEN sample IN ('S1', 'S2') THEN 'cancer' ELSE 'normal' END AS variable, CAST(cov AS BIGINT) AS cov, count(*) AS n FROM fx_long WHERE cov <= 40 GROUP BY 1, 2")(lambda s, d: stats.coverage_data(fx.frame(s, d), "hist", "cond", True, 40))
query("plot_data_regions", f"SELECT sample AS variable, round(beta, 6) AS meth FROM fx_long w WHERE beta IS NOT NULL AND EXISTS (SELECT 1 FROM fx_regions r WHERE r.chr = w.chr AND {ON['within']})")(lambda s, d: rounded(stats.plot_data(fx.frame(s, d), None, fx.view(s, d, "fx_regions")), "meth"))
query("melt_long", "SELECT chr, start, sample, round(beta, 6) AS beta, CAST(cov AS BIGINT) AS cov FROM fx_long")(lambda s, d: rounded(fx.frame(s, d).to_long().select("chr", "start", "sample", "beta", "cov"), "beta"))
query("plot_data_pheno", "SELECT CASE WHEN sample IN ('S1', 'S2') THEN 'cancer' ELSE 'normal' END AS variable, round(beta, 6) AS meth FROM fx_long WHERE beta IS NOT NULL")(lambda s, d: rounded(stats.plot_data(fx.frame(s, d), None, pheno="cond"), "meth"))
query("stats_errorbars", "SELECT chr, sample, round(avg(beta), 6) AS value, round(greatest(avg(beta) - stddev_samp(beta), 0), 6) AS sd_low, round(avg(beta) + stddev_samp(beta), 6) AS sd_high FROM fx_long WHERE chr <> 'chr2' GROUP BY chr, sample")(lambda s, d: rounded(stats.errorbars(stats.get_stats(fx.frame(s, d)), ignore_chr=["chr2"]), "value", "sd_low", "sd_high"))

#: ---- combining ----
query("combine_rows", flat_sql())(lambda s, d: flat(combine.combine(fx.frame(s, d)[F.col("chr") == "chr1"], fx.frame(s, d)[F.col("chr") != "chr1"])))
query("combine_cols", flat_sql())(lambda s, d: flat(combine.combine(fx.frame(s, d)[:, ["S1", "S2"]], fx.frame(s, d)[:, ["S3", "S4"]], "col")))
query("duplicate_loci", "SELECT chr, start, strand, count(*) AS n FROM fx_raw GROUP BY chr, start, strand HAVING count(*) > 1")(lambda s, d: combine.duplicated(LocusFrame(fx.records(s, d).select("chr", "start", "strand", F.col("M").alias("beta__S1"), F.col("U").alias("cov__S1")), ["S1"])))

#: ---- SNPs and probes ----
SNP = "SELECT DISTINCT chr, pos - k AS start FROM fx_snp CROSS JOIN (VALUES (0), (1)) t(k) WHERE af_a >= 0.01 OR af_b >= 0.01"
AF = ["af_a", "af_b"]
hit = f"(SELECT 1 FROM ({SNP}) x WHERE x.chr = w.chr AND x.start = w.start)"
query("snp_filter", flat_sql(f"WHERE NOT EXISTS {hit}"))(lambda s, d: flat(annotate.remove_snps(fx.frame(s, d), fx.view(s, d, "fx_snp"), AF)[0]))
query("snp_kept", flat_sql(f"WHERE EXISTS {hit}"))(lambda s, d: flat(annotate.remove_snps(fx.frame(s, d), fx.view(s, d, "fx_snp"), AF)[1]))
query("snp_removed_per_chr", f"SELECT chr, count(*) AS n_removed FROM fx_wide w WHERE EXISTS {hit} GROUP BY chr")(lambda s, d: annotate.removed_per_contig(annotate.remove_snps(fx.frame(s, d), fx.view(s, d, "fx_snp"), AF)[1]))
SNP_LOW = "SELECT chr, pos - k AS start, bool_or(af_a <= 0.1 OR af_b <= 0.1) AS low FROM fx_snp CROSS JOIN (VALUES (0), (1)) t(k) WHERE af_a >= 0.01 OR af_b >= 0.01 GROUP BY 1, 2"
VAR = "SELECT chr, start, var_samp(beta) AS v FROM fx_long GROUP BY chr, start"
_hits = f"SELECT x.chr, x.start, x.low, v.v FROM ({SNP_LOW}) x JOIN ({VAR}) v ON v.chr = x.chr AND v.start = x.start"
query("snp_reduced", flat_sql(f"WHERE EXISTS (SELECT 1 FROM ({_hits}) h CROSS JOIN (SELECT quantile_cont(v, 0.25) AS q FROM ({_hits}) z WHERE low) qq WHERE h.chr = w.chr AND h.start = w.start AND (NOT h.low OR coalesce(h.v > qq.q, false)))"))(lambda s, d: flat(annotate.remove_snps(fx.frame(s, d), fx.view(s, d, "fx_snp"), AF, reduce_filtering=True, forced=True)[1]))
PROBE = "SELECT chr, pos, probe_id, array_type FROM (SELECT *, row_number() OVER (PARTITION BY chr, pos ORDER BY array_type, probe_id) AS k FROM fx_probe) t WHERE k = 1"
query("probe_exact", f"SELECT w.chr, w.start, p.probe_id, p.array_type, round(b1, 6) AS b1 FROM fx_wide w JOIN ({PROBE}) p ON p.chr = w.chr AND p.pos = w.start")(lambda s, d: rounded(annotate.probe_subset(fx.frame(s, d), fx.view(s, d, "fx_probe")).df.select("chr", "start", "probe_id", "array_type", F.col("beta__S1").alias("b1")), "b1"))
query("probe_tolerance", f"SELECT chr, start, probe_id, array_type FROM (SELECT w.chr, w.start, p.probe_id, p.array_type, row_number() OVER (PARTITION BY w.chr, w.start ORDER BY p.pos) AS k FROM fx_ref w JOIN ({PROBE}) p ON p.chr = w.chr AND abs(p.pos - w.start) <= 25) t WHERE k = 1")(lambda s, d: annotate.probe_subset(fx.frame(s, d), fx.view(s, d, "fx_probe"), 25).df.select("chr", "start", "probe_id", "array_type"))
_N = f"(SELECT count(*) FROM ({PROBE}) p) AS n_probes, (SELECT count(*) FROM fx_ref) AS n_loci, (SELECT count(*) FROM fx_ref w JOIN ({PROBE}) p ON p.chr = w.chr AND p.pos = w.start) AS n_matched"
query("probe_percent", f"SELECT round_even(CAST(n_matched * 100 AS DOUBLE) / n_loci, 2) AS pct_loci, round_even(CAST(n_matched * 100 AS DOUBLE) / n_probes, 2) AS pct_probes FROM (SELECT {_N}) t")(lambda s, d: annotate.probe_coverage(fx.frame(s, d), fx.view(s, d, "fx_probe")).select("pct_loci", "pct_probes"))
query("probe_coverage", f"SELECT (SELECT count(*) FROM ({PROBE}) p) AS n_probes, (SELECT count(*) FROM fx_ref) AS n_loci, (SELECT count(*) FROM fx_ref w JOIN ({PROBE}) p ON p.chr = w.chr AND p.pos = w.start) AS n_matched")(lambda s, d: annotate.probe_coverage(fx.frame(s, d), fx.view(s, d, "fx_probe")).select("n_probes", "n_loci", "n_matched"))

#: ---- exports ----
query("to_bsseq", "SELECT chr, start AS pos, " + ", ".join(f"round(coalesce(b{i} * c{i}, 0), 6) AS m{i}, CAST(coalesce(c{i}, 0) AS BIGINT) AS c{i}" for i in range(1, 5)) + " FROM fx_wide")(lambda s, d: export.to_bsseq(fx.frame(s, d)).select("chr", "pos", *[c for i in range(1, 5) for c in (F.round(f"M__S{i}", 6).alias(f"m{i}"), F.col(f"Cov__S{i}").cast("long").alias(f"c{i}"))]))
query("multibed_wide", "SELECT chr AS seqnames, start, start + 1 AS end_, '*' AS strand, " + ", ".join(f"round(b{i}, 6) AS S{i}" for i in range(1, 5)) + " FROM fx_wide")(lambda s, d: rounded(export.multibed(fx.frame(s, d)), *SAMPLES))
query("metilene_wide", "SELECT chr, start AS pos, " + ", ".join(f"round(b{i}, 6) AS {g}_S{i}" for i, g in ((1, "cancer"), (2, "cancer"), (3, "normal"), (4, "normal"))) + " FROM fx_wide WHERE b1 + b2 + b3 + b4 IS NOT NULL")(lambda s, d: rounded(export.metilene(fx.frame(s, d), "cond", rm_na=True), "cancer_S1", "cancer_S2", "normal_S3", "normal_S4"))
query("bedgraph_rows", "SELECT replace(chr, 'chr', '') AS chr, start, start + 1 AS end_, round(beta, 6) AS beta, CAST(cov AS BIGINT) AS cov FROM fx_long WHERE sample = 'S1' AND beta IS NOT NULL")(lambda s, d: rounded(export.bedgraph_rows(fx.frame(s, d), "S1", add_coverage=True, style="NCBI").withColumn("cov", F.col("cov").cast("long")), "beta"))
query("expression_matrix", f"SELECT p.probe_id, round(b1, 6) AS S1, round(b2, 6) AS S2, round(b3, 6) AS S3, round(b4, 6) AS S4 FROM fx_wide w JOIN ({PROBE}) p ON p.chr = w.chr AND p.pos = w.start")(lambda s, d: rounded(export.expression_matrix(annotate.probe_subset(fx.frame(s, d), fx.view(s, d, "fx_probe"))), *SAMPLES))
query("array_roundtrip", flat_sql())(lambda s, d: flat(LocusFrame.from_arrays(fx.frame(s, d).to_arrays(), SAMPLES)))
query("long_roundtrip", flat_sql())(lambda s, d: flat(LocusFrame.from_long(fx.frame(s, d).to_long(), SAMPLES)))
query("motif_positions", "SELECT doc_id, CAST(i AS BIGINT) AS start FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM documents) t WHERE substr(text, i, 2) = 'th'")(lambda s, d: reference.extract_loci(fx.table(s, d, "documents"), "doc_id", "text", "th"))

#: ---- PCA ----
_c = [f"(b{i} - (b1 + b2 + b3 + b4) / 4)" for i in range(1, 5)]
query("pca_gram", " UNION ALL ".join(f"SELECT 'S{i + 1}' AS i, 'S{j + 1}' AS j, round(sum({_c[i]} * {_c[j]}), 5) AS value FROM fx_wide" for i in range(4) for j in range(i, 4)))(lambda s, d: pca.gram(fx.frame(s, d)).select("i", "j", F.round("value", 5).alias("value")))


ORACLE["pca_reconstructed"] = ORACLE["pca_gram"]


@query("pca_reconstructed", None)
def pca_reconstructed(s, d):
    """The Gram matrix from the scores of all components: checks scores and variances whatever their signs."""
    p = pca.pca(fx.frame(s, d), top_var=None, n_pc=len(SAMPLES)).scores
    a, b = p.alias("a"), p.alias("b")  # a row a sample
    value = sum((F.col(f"a.PC{k}") * F.col(f"b.PC{k}") for k in range(1, len(SAMPLES) + 1)), F.lit(0.0))
    return a.join(b, F.col("a.sample") <= F.col("b.sample")).select(F.col("a.sample").alias("i"), F.col("b.sample").alias("j"), F.round(value, 5).alias("value"))


query("pca_scores", None)(lambda s, d: pca.pca(fx.frame(s, d)).scores)
query("pca_variance", None)(lambda s, d: s.createDataFrame([(f"PC{k + 1}", v) for k, v in enumerate(pca.pca(fx.frame(s, d)).variance)], "pc string, fraction double"))

#: ---- files: the fixture written in each call format, read back, aligned ----
FORMATS = {  # the fields of a line as SQL; the reader's arguments
    "Bismark_cov": (["chr", "start - 1", "start", "m / (m + u) * 100", "CAST(m AS BIGINT)", "CAST(u AS BIGINT)"], {}),
    "MethylDackel": (["replace(chr, 'chr', '')", "start - 1", "start", "'x'", "CAST(m AS BIGINT)", "CAST(u AS BIGINT)"], {}),
    "MethylcTools": (["chr", "start", "'x'", "'x'", "'x'", "CAST(m AS BIGINT)", "CAST(u AS BIGINT)"], {"zero_based": False}),
    "BisSNP": (["chr", "start - 1", "start", "m / (m + u)", "CAST(m + u AS BIGINT)"], {}),
    "BSseeker2_CGmap": (["chr", "'C'", "start", "'CG'", "'x'", "m / (m + u)", "'x'", "CAST(m + u AS BIGINT)"], {"zero_based": False}),
}


def files_query(name: str, preset: str | None, gz: bool = False, split: bool = False):
    """gz: compressed files. split: M on the forward strand, U on the reverse, one base on; read back stranded and collapsed."""

    @query(name, flat_sql())
    def run(s, d):
        fields, more = FORMATS[preset or "MethylcTools"]
        df = fx.view(s, d, "fx_bg")
        if split:
            df = df.selectExpr("chr", "sample", "inline(array(named_struct('start', start, 'm', double(m), 'u', 0D), named_struct('start', start + 1, 'm', 0D, 'u', double(u))))").where("m + u > 0")
        lines = df.select("sample", F.concat_ws("\t", *[F.expr(c).cast("string") for c in fields]).alias("value"))
        folder = store.scratch(s, name)
        lines.write.partitionBy("sample").option("compression", "gzip" if gz else "none").text(folder)
        cols = layout(preset) if preset else layout(None, chr=1, start=2, M=6, U=7)
        return flat(calls.read_calls(s, [f"{folder}/sample={x}" for x in SAMPLES], cols, fx.view(s, d, "fx_ref"), coldata=COLDATA, stranded=split, collapse=split, **more))


for _name in FORMATS:
    files_query(f"read_{_name.lower()}", _name)
files_query("read_gzip", "Bismark_cov", gz=True)
files_query("read_custom_stranded", None, split=True)


@query("bedgraph_roundtrip", flat_sql())
def bedgraph_roundtrip(s, d):
    paths = export.write_bedgraphs(fx.frame(s, d), store.scratch(s, "bedgraph"), add_coverage=True)
    return flat(calls.read_calls(s, paths, layout(None, chr=1, start=2, beta=4, cov=5), fx.view(s, d, "fx_ref"), zero_based=False))


@query("parquet_roundtrip", flat_sql())
def parquet_roundtrip(s, d):
    return flat(store.load(s, store.save(fx.frame(s, d), store.scratch(s, "frame"))))
