"""The driver's tables seen as methylation inputs: plain SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusgrid.frame import LocusFrame
from locusgrid.sources import calls

SAMPLES = ["S1", "S2", "S3", "S4"]
COLDATA = {"S1": {"cond": "cancer"}, "S2": {"cond": "cancer"}, "S3": {"cond": "normal"}, "S4": {"cond": "normal"}}

VIEWS = {
    "fx_ref": """SELECT concat('chr', CAST(r_regionkey + 1 AS VARCHAR(4))) AS chr, p_partkey * 10 + 1 AS start
        FROM region CROSS JOIN part WHERE p_size <> 50""",
    "fx_raw": """SELECT concat('chr', CAST(l_suppkey % 5 + 1 AS VARCHAR(4))) AS chr, l_partkey * 10 + 1 AS start,
        CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, concat('S', CAST(l_linenumber AS VARCHAR(4))) AS sample,
        CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END AS m, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS u,
        l_orderkey, l_extendedprice, l_shipdate FROM lineitem WHERE l_linenumber <= 4""",
    "fx_bg": "SELECT chr, start, sample, SUM(m) AS m, SUM(u) AS u FROM fx_raw GROUP BY chr, start, sample",
    "fx_regions": """SELECT CAST(n_nationkey AS BIGINT) AS rid, concat('chr', CAST(n_nationkey % 5 + 1 AS VARCHAR(4))) AS chr,
        CAST(n_nationkey * 800 + 1 + n_nationkey % 2 AS BIGINT) AS r_start,
        CAST(n_nationkey * 800 + 1501 + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS r_end FROM nation
        UNION ALL SELECT CAST(999 AS BIGINT), 'chr1', CAST(900000000 AS BIGINT), CAST(900000100 AS BIGINT) FROM region WHERE r_regionkey = 0""",
    "fx_regions_ov": """SELECT CAST(n_nationkey AS BIGINT) AS rid, concat('chr', CAST(n_nationkey % 5 + 1 AS VARCHAR(4))) AS chr,
        CAST(n_nationkey * 800 + 1 + n_nationkey % 2 AS BIGINT) AS r_start,
        CAST(n_nationkey * 800 + 5001 + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS r_end FROM nation
        UNION ALL SELECT CAST(100 + s_suppkey AS BIGINT), concat('chr', CAST(s_suppkey % 5 + 1 AS VARCHAR(4))),
        CAST(s_suppkey * 150 + 1 AS BIGINT), CAST(s_suppkey * 150 + 2 AS BIGINT) FROM supplier WHERE s_suppkey < 100""",
    "fx_snp": """SELECT concat('chr', CAST(c_nationkey % 5 + 1 AS VARCHAR(4))) AS chr, (c_custkey * 13) % 20000 AS pos,
        abs(c_acctbal) / 20000 AS af_a, abs(c_acctbal) / 40000 AS af_b FROM customer""",
    "fx_probe": """SELECT concat('chr', CAST(p_partkey % 5 + 1 AS VARCHAR(4))) AS chr,
        p_partkey * 10 + 1 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS pos, concat('cg', CAST(p_partkey AS VARCHAR(16))) AS probe_id,
        '450K' AS array_type FROM part WHERE p_size <= 10
        UNION ALL SELECT concat('chr', CAST(p_partkey % 5 + 1 AS VARCHAR(4))), p_partkey * 10 + 1 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END,
        concat('ep', CAST(p_partkey AS VARCHAR(16))), 'EPIC' FROM part WHERE p_size <= 20""",
}

#: For the oracle only: the aligned matrix in long and wide form.
ORACLE_VIEWS = VIEWS | {
    "fx_long": """SELECT r.chr, r.start, s.sample, b.m, b.u, b.m + b.u AS cov, CASE WHEN b.m + b.u > 0 THEN b.m / (b.m + b.u) END AS beta
        FROM fx_ref r CROSS JOIN (VALUES ('S1'), ('S2'), ('S3'), ('S4')) s(sample)
        LEFT JOIN fx_bg b ON b.chr = r.chr AND b.start = r.start AND b.sample = s.sample""",
    "fx_wide": "SELECT chr, start, " + ", ".join(f"max(CASE WHEN sample = '{s}' THEN {c} END) AS {c[0]}{s[1]}" for c in ("beta", "cov") for s in SAMPLES) + " FROM fx_long GROUP BY chr, start",
}


def with_views(body: str, more: dict[str, str] | None = None) -> str:
    """The query after the views that it needs."""
    views, need = ORACLE_VIEWS | (more or {}), []

    def visit(text: str) -> None:
        for name in views:
            if name not in need and name in text.replace(name + "_", "#"):
                visit(views[name])
                if name not in need:
                    need.append(name)

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in need) + "\n" if need else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of one folder."""
    import re

    text = with_views(f"SELECT * FROM {name}")
    used = [t for t in ("region", "nation", "part", "lineitem", "customer", "supplier") if re.search(rf"(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, start, strand, sample, M, U and the order columns."""
    return view(spark, sf_dir, "fx_raw").withColumnsRenamed({"m": "M", "u": "U"})


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per locus and sample, with all of M, U, cov, beta; cov 0 is NULL."""
    df = view(spark, sf_dir, "fx_bg").withColumnsRenamed({"m": "M", "u": "U"})
    return calls.zero_to_null(calls.derive(df))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return view(spark, sf_dir, "fx_ref").withColumn("strand", F.lit("*"))


def frame(spark: SparkSession, sf_dir: str) -> LocusFrame:
    return calls.align(reference(spark, sf_dir), cells(spark, sf_dir), SAMPLES, coldata=COLDATA, genome="fixture")
