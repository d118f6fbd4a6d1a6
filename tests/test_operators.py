"""Edge cases on literal rows: what the fixture tables do not hold."""

import gzip
import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X
from locusgrid.operators import annotate, combine, filters, pca, regions, stats
from locusgrid.operators.intervals import cast_regions
from locusgrid.sinks import bigwig, export, report
from locusgrid.sources import calls, reference, store
from locusgrid.sources.presets import layout
from locusgrid.streaming import ingest

SCHEMA = "chr string, start long, strand string, beta__A double, beta__B double, cov__A int, cov__B int"


def frame(spark, rows=None):
    rows = rows or [("chr1", 1, "*", 0.5, 0.2, 10, 20), ("chr1", 11, "*", None, 0.4, None, 5), ("chr1", 21, "*", None, None, None, None), ("chr2", 5, "*", 1.0, 0.0, 3, 300)]
    return LocusFrame(spark.createDataFrame(rows, SCHEMA), ["A", "B"], {"A": {"g": "x"}, "B": {"g": "y"}}, chrom_sizes={"chr1": 100, "chr2": 50})


def starts(m):
    return sorted((r.chr, r.start) for r in m.df.select("chr", "start").collect())


def test_frame_contract(spark):
    m = frame(spark)
    with pytest.raises(ValueError):
        m.select_samples(["Z"])
    with pytest.raises(ValueError):
        LocusFrame(m.df.drop("cov__A"), ["A", "B"])
    assert "2 samples" in repr(m)
    assert [r.start for r in m.ordered().collect()] == [1, 11, 21, 5]


def test_filters(spark):
    m = frame(spark)
    assert starts(filters.remove_uncovered(m)) == [("chr1", 1), ("chr1", 11), ("chr2", 5)]
    assert starts(filters.coverage_filter(m, 10, 1, group="g")) == [("chr1", 1)]
    assert starts(filters.coverage_filter(m, 5, 1, 0.51)) == [("chr1", 1)]
    with pytest.raises(TypeError):
        filters.coverage_filter(m, "a")
    with pytest.raises(ValueError):
        filters.subset(m, contigs=["chrX"], strict=True)
    with pytest.raises(ValueError):
        filters.get_matrix(m, "X")
    with pytest.raises(ValueError):
        filters.get_matrix(m, "M", False, True)
    masked, counts = filters.mask(m, 5, None)
    assert {r.sample: r.n_low for r in counts.collect()} == {"A": 1, "B": 0}
    assert masked.df.where("cov__A = 3").count() == 0
    with pytest.raises(ValueError):
        filters.mask(m, None, 2)
    assert filters.mask(m, 300, None)[0].df.where("cov__A IS NOT NULL").count() == 0


def test_idempotent_and_complement(spark):
    m = frame(spark)
    r = spark.createDataFrame([(1, "chr1", 1, 12)], "rid long, chr string, start long, end long")
    a, b = filters.subset(m, r), filters.region_filter(m, r)
    assert starts(a) + starts(b) == starts(m)
    assert starts(filters.subset(a, r)) == starts(a)
    assert starts(combine.combine(a, b)) == starts(m)
    with pytest.raises(ValueError):
        combine.combine(a, a)
    with pytest.raises(ValueError):
        combine.combine(m, m, "col")


@pytest.mark.parametrize("kind", ["within", "any", "start", "end", "equal"])
def test_binned_join_equals_broadcast(spark, kind):
    m = frame(spark, [("chr1", i, "*", 0.1, 0.1, 1, 1) for i in range(1, 300, 3)])
    r = spark.createDataFrame([(i, "chr1", i * 10, i * 10 + i % 7) for i in range(30)] + [(99, "chr1", 50, 40)], "rid long, chr string, r_start long, r_end long")
    from locusgrid.operators.intervals import interval_join

    got = [sorted((x.start, x.rid) for x in interval_join(m.df, r.where("r_end >= r_start"), kind, broadcast=b, width=16).collect()) for b in (True, False)]
    assert got[0] == got[1]


def test_region_summary_errors_and_nulls(spark):
    m = frame(spark)
    r = spark.createDataFrame([(1, "chr1", 21, 22), (2, "chrX", 1, 9)], "rid long, chr string, r_start long, r_end long")
    row = regions.region_summary(m, r, how="sum").collect()
    assert [(x.rid, x.n_overlap, x.A) for x in row] == [(1, 1, None)]
    with pytest.raises(ValueError):
        regions.region_summary(m, r, how="mode")
    with pytest.raises(TypeError):
        regions.region_summary(m.df, r)


def test_empty_frame(spark):
    m = frame(spark)
    e = m.with_df(m.df.where("false"))
    assert stats.get_stats(e).count() == 0
    assert filters.mask(e)[0].df.count() == 0
    assert pca.pca(e).variance == [0.0, 0.0]


def test_snp_without_hits_keeps_all(spark):
    m = frame(spark)
    none = spark.createDataFrame([("chr9", 5, 0.5)], "chr string, pos long, af double")
    kept, gone = annotate.remove_snps(m, none, ["af"])
    assert kept.df.count() == 4 and gone.df.count() == 0
    with pytest.raises(ValueError):
        annotate.remove_snps(m, none, ["af"], reduce_filtering=True)


def test_presets_and_layout_errors():
    assert layout("MethylDackel").idx["M"] == 5
    for bad in ({"chr": 1}, {"chr": 1, "start": 1, "M": 2, "U": 3}, {"chr": 1, "start": 2}, {"chr": 1, "start": 2, "beta": 3}, {"chr": 1, "start": 2, "cov": 3}):
        with pytest.raises(ValueError):
            layout(None, **bad)
    with pytest.raises(ValueError):
        layout("other")


def test_read_calls(spark, tmp_path):
    (tmp_path / "A.bedGraph").write_text("1\t0\t1\t100\t8\t0\n1\t0\t1\t0\t0\t8\n1\t10\t11\t50\t4\t4\n1\t20\t21\tbad\t0\t0\n1\t500\t501\t50\t1\t1\n")
    (tmp_path / "B.bedGraph").write_text("chr1\t10\t11\t25\t1\t3\n")
    paths = [str(tmp_path / f"{x}.bedGraph") for x in "AB"]
    ref = [("chr1", 1), ("chr1", 11), ("chr1", 21)]
    m = calls.read_calls(spark, paths, layout("Bismark_cov"), ref)
    got = {r.start: (r.beta__A, r.beta__B, r.cov__A, r.cov__B) for r in m.df.collect()}
    assert got == {1: (1.0, None, 8, None), 11: (0.5, 0.25, 8, 4), 21: (None, None, None, None)}
    assert calls.sample_names(["x/A.b.c", "y/A.d"]) == ["A", "A_1"]
    with pytest.raises(ValueError):
        calls.read_calls(spark, [], layout("Bismark_cov"), ref)


def test_cgmap_context_and_stranded(spark, tmp_path):
    (tmp_path / "S.map").write_text("chr1\tC\t1\tCG\tx\t0.5\t1\t4\nchr1\tC\t2\tCG\tx\t1.0\t4\t4\nchr1\tC\t5\tCHH\tx\t1.0\t4\t4\n")
    m = calls.read_calls(spark, [str(tmp_path / "S.map")], layout("BSseeker2_CGmap"), [("chr1", 1)], zero_based=False, stranded=True, collapse=True)
    r = m.df.collect()
    assert [(x.start, x.strand, x.beta__S, x.cov__S) for x in r] == [(1, "*", 0.75, 8)]


def test_fasta_loci(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 test\nACGC\nGCG\n>chr2\nTTT\n")
    loci, sizes = reference.extract_cpgs(spark, str(tmp_path / "g.fa"))
    assert sorted((r.chr, r.start) for r in loci.collect()) == [("chr1", 2), ("chr1", 4), ("chr1", 6)]
    assert dict(tuple(r) for r in sizes.collect()) == {"chr1": 7, "chr2": 3}


def test_fasta_over_blocks(spark, tmp_path):
    """Contigs over several blocks of a file, headers anywhere, a motif over each kind of border."""
    import random

    rnd = random.Random(3)
    seqs = {f"c{i}": "".join(rnd.choice("ACGcg") for _ in range(n)) for i, n in enumerate((2000, 61, 1, 3000))}
    text = "".join(f">{k} note\n" + "".join(v[i : i + 60] + "\n" for i in range(0, len(v), 60)) + "\n" for k, v in seqs.items())
    (tmp_path / "g.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        loci, sizes = reference.extract_cpgs(spark, str(tmp_path / "g.fa"))
        got, lengths = sorted((r.chr, r.start) for r in loci.collect()), dict(tuple(r) for r in sizes.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((k, i + 1) for k, v in seqs.items() for i in range(len(v) - 1) if v[i : i + 2].upper() == "CG")
    assert lengths == {k: len(v) for k, v in seqs.items()}


def test_loci_overlapping_and_empty(spark):
    df = spark.createDataFrame([("a", "aaaa"), ("b", ""), ("c", None), ("d", "baab"), ("e", "xaaaa" * 3000)], "k string, s string")
    got = sorted((r.k, r.start) for r in reference.extract_loci(df, "k", "s", "aa").where("k <> 'e'").collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("d", 2)]
    assert reference.extract_loci(df, "k", "s", "aa").where("k = 'e'").count() == 9000


def test_names_and_regions_are_checked(spark, tmp_path):
    assert X.make_names(["a b", "a.b", "1x", "", "ok"]) == ["a.b", "a.b.1", "X1x", "X", "ok"]
    (tmp_path / "f.cov").write_text("chr1\t0\t1\t100\t8\t0\n")
    with pytest.warns(UserWarning, match="my sample to my.sample"):
        m = calls.read_calls(spark, [str(tmp_path / "f.cov")], layout("Bismark_cov"), [("chr1", 1)], coldata={"my sample": {"g": 1}})
    assert m.samples == ["my.sample"] and m.coldata == {"my.sample": {"g": 1}} and m.df.first()["beta__my.sample"] == 1.0
    with pytest.warns(UserWarning, match="taking a, b, c"):
        cast_regions(spark.createDataFrame([("chr1", 1, 2)], "a string, b int, c int"))
    with pytest.raises(TypeError):
        cast_regions([("chr1", 1, 2)])
    with pytest.raises(ValueError):
        annotate.remove_snps(frame(spark), spark.createDataFrame([("chr9", 5, 0.5)], "chr string, pos long, af double"), ["af"], snp_genome="hg19")


def test_uncovered_loci_are_written(spark, tmp_path):
    (tmp_path / "A.cov").write_text("chr1\t0\t1\t100\t8\t0\n")
    calls.read_calls(spark, [str(tmp_path / "A.cov")], layout("Bismark_cov"), [("chr1", 1), ("chr1", 11)], uncovered_dir=str(tmp_path / "u"))
    assert [r.value for r in spark.read.text(str(tmp_path / "u" / "A_uncovered.bed")).collect()] == ["chr1\t11\t12"]


def test_quantiles_by_sketch(spark):
    m = frame(spark, [("chr1", i, "*", i / 5000, 1 - i / 5000, i, 5) for i in range(5000)])
    exact, near = (stats.get_stats(m, False, e).orderBy("sample").collect() for e in (None, 0.01))
    assert all(abs(a.median_meth - b.median_meth) <= 0.01 and abs(a.median_cov - b.median_cov) <= 50 for a, b in zip(exact, near, strict=True))
    assert abs(stats.column_quantile(m, 0.9, "M", 0.01).first()["A"] - 0.9) <= 0.01
    assert abs(filters.mask(m, None, 0.9, 0.01)[0].df.agg(F.max("cov__A")).first()[0] - 4500) <= 50
    with pytest.raises(ValueError):
        stats.get_stats(m, error=2)


def test_coverage_data(spark):
    m = frame(spark)
    got = {(r.variable, r.cov): r.n for r in stats.coverage_data(m, lim=20).collect()}
    assert got == {("A", 10): 1, ("A", 3): 1, ("B", 20): 1, ("B", 5): 1}
    assert sum(r.n for r in stats.coverage_data(m, lim=1000, size_lim=4, pheno="g", per_group=True).collect()) <= 4
    dens = stats.coverage_data(m, "dens", lim=100, points=101, bw=2.0).where("variable = 'A'").collect()
    assert abs(sum(r.density for r in dens) - 1) < 0.05
    for bad in ({"kind": "box"}, {"per_group": True}, {"per_group": True, "pheno": "z"}):
        with pytest.raises(ValueError):
            stats.coverage_data(m, **bad)


def test_coverage_data_counts_all_cells(spark):
    cells = {"beta__A": F.lit(0.5), "beta__B": F.lit(0.5), "cov__A": (F.col("id") % 10).cast("int"), "cov__B": F.lit(7)}
    df = spark.range(500_010).select(F.lit("chr1").alias("chr"), F.col("id").alias("start"), F.lit("*").alias("strand"), *[c.alias(n) for n, c in cells.items()])
    got = {(r.variable, r.cov): r.n for r in stats.coverage_data(LocusFrame(df, ["A", "B"])).collect()}
    assert got == {("A", k): 50_001 for k in range(10)} | {("B", 7): 500_010}


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_broad_regions_make_few_rows(spark, broadcast):
    m = frame(spark, [("chr1", i * 1000, "*", 0.1, 0.1, 1, 1) for i in range(100)])
    r = spark.createDataFrame([(0, "chr1", 0, 90_000_000), (1, "chr1", 5000, 5001)], "rid long, chr string, r_start long, r_end long")
    from locusgrid.operators.intervals import interval_join

    assert interval_join(m.df, r, "any", broadcast=broadcast).count() == 101


def test_zero_cov_and_nan(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (float("nan"), 1.0)], "M double, U double")
    rows = calls.zero_to_null(calls.derive(df.select(F.when(~F.isnan("M"), F.col("M")).alias("M"), "U"))).collect()
    assert [r.beta for r in rows] == [None, 0.5, None]


def test_store_roundtrip(spark, tmp_path):
    m = frame(spark)
    store.save(m, str(tmp_path / "m"))
    n = store.load(spark, str(tmp_path / "m"))
    assert starts(n) == starts(m) and n.coldata == m.coldata and n.chrom_sizes == m.chrom_sizes
    d = store.to_disk(m, str(tmp_path / "d"))
    with pytest.raises(ValueError):
        store.to_disk(d, str(tmp_path / "e"))
    assert store.to_memory(d).df.count() == 4
    with pytest.raises(ValueError):
        store.to_memory(m)


def test_bedgraph_roundtrip(spark, tmp_path):
    m = frame(spark)
    paths = export.write_bedgraphs(m, str(tmp_path), add_coverage=True, compress=False)
    back = calls.read_calls(spark, paths, layout(None, chr=1, start=2, beta=4, cov=5), m.df.select("chr", "start"), zero_based=False)
    want = {(r.chr, r.start): (r.beta__A, r.cov__B) for r in m.df.collect()}
    assert {(r.chr, r.start): (r.beta__A, r.cov__B) for r in back.df.collect()} == want
    with pytest.raises(ValueError):
        export.metilene(m, "nothing")
    export.write_multibed(export.multibed(m), str(tmp_path / "multi"))
    assert "." in spark.read.text(str(tmp_path / "multi")).where("value LIKE '%21%'").first()[0]


def test_bedgraphs_compute_the_frame_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = [(f"chr{i % 3}", i, "*", i / 1000, None if i % 2 else 0.5, i, 5) for i in range(1000)]

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    m = frame(spark, rows)
    # the shuffle is between the count and the sort, which samples its input
    m = m.with_df(m.df.mapInArrow(count, m.df.schema).repartition(7))
    paths = export.write_bedgraphs(m, str(tmp_path), zero_based=True)
    assert seen.value == 1000
    for path, name, k in zip(paths, "AB", (3, 4), strict=True):
        lines = [x for f in sorted((tmp_path / f"{name}.bedGraph").glob("part-*")) for x in gzip.decompress(f.read_bytes()).decode().splitlines()]
        assert path == f"{tmp_path}/{name}.bedGraph" and lines[0] == f'track type=bedGraph name="{name}"'
        assert lines[1:] == [f"{r[0]}\t{r[1] - 1}\t{r[1]}\t{r[k]}" for r in sorted(rows) if r[k] is not None]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["A.bedGraph", "B.bedGraph"]
    assert export.write_bedgraphs(m, str(tmp_path)) == paths and seen.value == 1000  # existing ones stay
    export.write_bedgraphs(m[F.lit(False)], str(tmp_path), force=True, header=False)
    assert spark.read.text(paths).count() == 0


def test_bigwig_layout(spark):
    out = {s: b"".join(parts) for s, parts in bigwig.write_bigwigs(frame(spark))}
    data = out["A"]
    magic, version, zooms, tree, full, index = struct.unpack_from("<IHHQQQ", data)
    assert (magic, version, zooms) == (0x888FFC26, 4, 0)
    n = struct.unpack_from("<Q", data, full)[0]
    assert n == 2
    c, s, e, off, size = struct.unpack_from("<IIIIQQ", data, index + 48 + 4)[0:2] + struct.unpack_from("<IIQQ", data, index + 48 + 4 + 8)[1:]
    raw = zlib.decompress(data[off : off + size])
    assert struct.unpack_from("<If", raw, 24) == (0, 0.5)
    with pytest.raises(ValueError):
        [list(parts) for _, parts in bigwig.write_bigwigs(frame(spark), {"chrZ": 1})]


def test_bigwig_levels(spark, monkeypatch):
    """Every value is found through an index of several levels."""
    monkeypatch.setattr(bigwig, "FANOUT", 4)
    rows = [(f"chr{c}", i, "*", i / 7000, None, 1, None) for c in (1, 2) for i in range(1, 14000, 2)]
    m = LocusFrame(spark.createDataFrame(rows, SCHEMA).repartition(5), ["A", "B"], chrom_sizes={"chr1": 14001, "chr2": 14001, "chr3": 9})
    files = {s: b"".join(parts) for s, parts in bigwig.write_bigwigs(m)}
    data = files["A"]
    full, at = struct.unpack_from("<QQ", data, 16)
    got, levels = {}, set()

    def walk(node, depth):
        leaf, _, n = struct.unpack_from("<BBH", data, node)
        levels.add(depth)
        for k in range(n):
            if leaf:
                c, s, _, e, off, size = struct.unpack_from("<IIIIQQ", data, node + 4 + 32 * k)
                raw = zlib.decompress(data[off : off + size])
                for j in range(struct.unpack_from("<H", raw, 22)[0]):
                    p, v = struct.unpack_from("<If", raw, 24 + 8 * j)
                    assert s <= p < e
                    got[c, p + 1] = v
            else:
                walk(struct.unpack_from("<Q", data, node + 4 + 24 * k + 16)[0], depth + 1)

    walk(at + 48, 0)
    assert len(levels) > 1 and struct.unpack_from("<Q", data, full)[0] == struct.unpack_from("<Q", data, at + 8)[0]
    assert got.keys() == {(int(r[0][3]) - 1, r[1]) for r in rows} and all(abs(got[int(r[0][3]) - 1, r[1]] - r[3]) < 1e-6 for r in rows)
    assert struct.unpack_from("<Q", files["B"], struct.unpack_from("<Q", files["B"], 16)[0])[0] == 0


def test_report(spark, tmp_path):
    m = frame(spark)
    page = report.write_report(m, reference.loci_per_contig(m.df), str(tmp_path))
    text = spark.read.text(page).first()[0]
    assert "mean coverage" in text and "methylation density" in text and "Only the first" not in text
    saved = report.read_tables(spark, str(tmp_path))
    assert saved["n_covered_per_chr"].count() == 4 and {r[0] for r in saved["density"].select("sample").distinct().collect()} == {"A", "B"}
    assert "Only the first 1 rows" in spark.read.text(report.write_report(m, reference.loci_per_contig(m.df), str(tmp_path), "p", 1)).first()[0]


def test_pca_matches_svd(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((40, 2))
    m = frame(spark, [("chr1", i, "*", float(a), float(b), 5, 5) for i, (a, b) in enumerate(x)])
    got = {r["sample"]: abs(r.PC1) for r in pca.pca(m, top_var=None).scores.collect()}
    c = x - x.mean(1, keepdims=True)
    assert math.isclose(got["A"], abs(np.linalg.svd(c.T, full_matrices=False)[0][0, 0] * np.linalg.svd(c.T, compute_uv=False)[0]), rel_tol=1e-6)


def test_pca_modes_and_annotation(spark):
    import numpy as np

    x = np.random.default_rng(1).random((60, 2))
    m = frame(spark, [("chr1", i, "*", float(a), float(b), 5, 5) for i, (a, b) in enumerate(x)])
    r = spark.createDataFrame([(1, "chr1", 0, 30)], "rid long, chr string, r_start long, r_end long")
    p = pca.pca(m, "rand", 10, r, seed=3)
    assert len(p.variance) == 2 and p.cumulative[-1] == 1.0 and p.cumulative[0] == p.variance[0]
    assert {(q["sample"], q.g) for q in pca.annotated(p, m, ["g"]).collect()} == {("A", "x"), ("B", "y")}
    inside = pca.pca(m, top_var=None, regions=r)
    c = x[:30] - x[:30].mean(1, keepdims=True)
    assert math.isclose(abs(inside.scores.where("sample = 'A'").first().PC1), abs(np.linalg.svd(c.T, full_matrices=False)[0][0, 0] * np.linalg.svd(c.T, compute_uv=False)[0]), rel_tol=1e-6)
    with pytest.raises(ValueError):
        pca.pca(m, "best")


def test_sampling_and_order(spark):
    m = frame(spark, [("chr1", i, "*", i / 100, 0.5, 5, 5) for i in range(100)])
    a, b = starts(filters.sample_rows(m, 10, 1)), starts(filters.sample_rows(m.with_df(m.df.repartition(7)), 10, 1))
    assert a == b and len(a) == 10 and a != starts(filters.sample_rows(m, 10, 2))
    assert [r.start for r in stats.order_by_sd(m, 9).limit(2).collect()] == [0, 1]
    regs = spark.createDataFrame([(2, "chr1", 0, 9), (1, "chr1", 20, 29)], "rid long, chr string, r_start long, r_end long")
    assert [r.rid for r in regions.region_summary(m, regs, ordered=True).collect()] == [1, 2]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("chr1\t1\tA\t3\t1\nchr1\t2\tA\t0\t0\n")
    q = ingest.running_stats(ingest.stream_records(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT chr, sample, n, beta FROM running").collect()] == [("chr1", "A", 1, 0.75)]
