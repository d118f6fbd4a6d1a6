"""Saved frames: Parquet range-partitioned by locus, with a one-row JSON table for the rest."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark.sql import SparkSession

from locusgrid.frame import LocusFrame


def save(m: LocusFrame, path: str, replace: bool = False) -> str:
    """Both tables are written by Spark, so any file system will do."""
    mode = "overwrite" if replace else "errorifexists"
    m.df.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start").write.mode(mode).parquet(f"{path}/loci")
    extra = {"samples": m.samples, "coldata": m.coldata, "genome": m.genome, "chrom_sizes": m.chrom_sizes, "meta": m.meta}
    m.df.sparkSession.createDataFrame([(json.dumps(extra),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/info")
    return path


def load(spark: SparkSession, path: str) -> LocusFrame:
    extra = json.loads(spark.read.text(f"{path}/info").first()[0])
    return LocusFrame(spark.read.parquet(f"{path}/loci"), **extra)


def to_disk(m: LocusFrame, path: str) -> LocusFrame:
    """Materialises a lazy frame; an error if it is already on disk."""
    if m.meta.get("path"):
        raise ValueError("already on disk")
    save(m, path, True)
    out = load(m.df.sparkSession, path)
    return out.with_df(out.df, meta={**m.meta, "path": path})


def to_memory(m: LocusFrame) -> LocusFrame:
    """Keeps a frame that is on disk in Spark's cache; an error if it is not on disk."""
    if not m.meta.get("path"):
        raise ValueError("not on disk")
    return m.with_df(m.df.persist(), meta={k: v for k, v in m.meta.items() if k != "path"})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and executors share: under `spark.checkpoint.dir`, or a temporary one for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='locusgrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _file_system(spark: SparkSession, path: str):
    """A path of any store that Spark can write, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """The folder old, or an empty one if there is none, in place of whatever is at new."""
    a, fs = _file_system(spark, old)
    b, _ = _file_system(spark, new)
    fs.delete(b, True)
    if not (fs.rename(a, b) if fs.exists(a) else fs.mkdirs(b)):
        raise OSError(f"could not move {old} to {new}")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        delete(spark, path)
