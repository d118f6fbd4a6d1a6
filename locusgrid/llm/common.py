"""Shared parts: staged tables, whole-number sketches merged across tasks, Bloom filters, components, text hashing.

Lineage is cut by tables written under `spark.checkpoint.dir`, so a lost executor costs only the tasks it held.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and executors share. Where none is set, a temporary one serves a local master; on a cluster that is an
    error, since executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='locusgrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


BATCH = 4 << 20  # bytes of an Arrow batch between the JVM and Python


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session does not, so that a task's memory does not follow the length of texts."""
    if spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set(key, BATCH)


_live: dict[str, SparkSession] = {}  # staged tables that are still there


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go as soon as it ends. Otherwise they stay until the driver happens to collect its garbage, and
    those of many steps add up on the executors' disks."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str, *partition_by: str, compact: bool = False) -> DataFrame:
    """Writes a table into the shared folder and reads it again; `unstage` deletes it, at the latest when the driver ends. compact: rows
    move once more into partitions of the advisory size, so that a table that may be small or large is as few files as it should be."""
    spark = df.sparkSession
    small_batches(spark)
    df = df.hint("rebalance") if compact else df
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex[:12]}"
    _live[path] = spark
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with shuffles_deleted(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out._staged = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_staged", None)) and _live.pop(path, None):
            delete(df.sparkSession, path)


def staged() -> set[str]:
    """The staged tables that are there now, for `sweep`."""
    return set(_live)


def sweep(before: set[str], *keep: DataFrame) -> None:
    """Deletes the tables staged since `before` was taken, but for those in keep: once a result has been written, nothing reads what its
    lazy plan read."""
    spare = before | {getattr(df, "_staged", None) for df in keep}
    for path in [p for p in _live if p not in spare]:
        delete(_live.pop(path), path)


@atexit.register
def _sweep_all() -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        sweep(set())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


# ---- fixed-size arrays summed over tasks ----

CHUNK = 1 << 16  # counters in one row


def pack(a: np.ndarray) -> bytes:
    """Counters in the narrowest of 1, 2, 4 or 8 bytes, after one byte that tells which."""
    top = int(a.max(initial=0))
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def chunk_rows(counts: np.ndarray) -> list[tuple[int, bytes]]:
    return [(i // CHUNK, pack(counts[i : i + CHUNK])) for i in range(0, len(counts), CHUNK)]


def merge_chunks(df: DataFrame, size: int, how: str = "sum") -> np.ndarray:
    """df: (task long, chunk int, blob binary). Sums (or ors) blobs of a chunk, at most 64 in one group, level by level; the driver
    gets one array of `size` counters, whatever the data's size."""

    def join(key, t):
        blobs = t.column("blob").to_pylist()
        acc = np.zeros(len(unpack(blobs[0])), np.uint64)
        for b in blobs:
            acc = acc + unpack(b) if how == "sum" else acc | unpack(b)
        return pa.table({"task": pa.array([key[1].as_py()], pa.int64()), "chunk": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([pack(acc)], pa.binary())})

    top = df.agg(F.max("task")).first()[0]
    tasks = (top if top is not None else 0) + 1
    while True:
        tasks = (tasks + 63) // 64
        df = df.withColumn("task", F.floor(F.col("task") / 64)).groupBy("chunk", "task").applyInArrow(join, "task long, chunk int, blob binary")
        if tasks == 1:
            break
    out = np.zeros(size, np.uint64)
    for r in df.select("chunk", "blob").collect():
        part = unpack(bytes(r[1]))
        out[r[0] * CHUNK : r[0] * CHUNK + len(part)] = part
    return out


# ---- Bloom filter of 64-bit keys with a fixed size ----


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bloom_bits(keys: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.uint64))
    mask = np.uint64((1 << log2) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def bloom(df: DataFrame, column: str, log2: int = 24) -> np.ndarray:
    """Bits (as bytes of eight) of all keys of a long column: 2^log2 bits however many keys there are. No key is missed."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits = np.zeros(1 << log2, bool)
        for b in batches:
            for at in bloom_bits(b.column(0).to_numpy(zero_copy_only=False), log2):
                bits[at] = True
        if bits.any():
            rows = chunk_rows(np.packbits(bits))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["task", "chunk", "blob"])

    parts = df.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(fill, "task long, chunk int, blob binary")
    parts = stage(parts, "bloom")
    out = merge_chunks(parts, 1 << (log2 - 3), "or").astype(np.uint8)
    unstage(parts)
    return out


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = bloom_bits(keys, int(len(bits)).bit_length() - 1 + 3)
    test = lambda at: (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (test(a) & test(b)).astype(bool)


# ---- connected components ----


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes of edges (a, b): each root hooks to its smallest neighbour's, paths halve."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        ru, rv = root[u], root[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def local_stars(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of a staged table with each partition's own components as stars: as connected as before, and no more rows than
    nodes a partition, whose size the reader's partition bytes bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        got: list[pa.RecordBatch] = []
        held = 0

        def folded():
            x = [np.concatenate((y, *(g.column(k).to_numpy() for g in got))) for k, y in enumerate((a, b))]
            node, root = roots(*x)
            far = node != root
            return node[far], root[far]

        for batch in batches:
            got.append(batch)
            held += batch.num_rows
            if held > 1 << 20:
                a, b = folded()
                got, held = [], 0
        a, b = folded()
        for k in range(0, len(a), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 18)]), pa.array(b[k : k + (1 << 18)])], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of the nodes in edges (a, b); the component is its smallest node. The result is a staged table.

    Each round makes stars of every partition's own components, then takes one large and one small star step over all. Neighbour minima
    are aggregates with map-side combine and come back by a join. They are dealt anew before it, as Spark can split a skewed key only
    where no aggregate stands between join and shuffle. Each round's edges are a staged table; edges that fit in one partition are
    settled by their first local step.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", compact=True)
    for _ in range(rounds):
        whole = e.rdd.getNumPartitions() <= 1
        n = stage(local_stars(e), "edges")
        unstage(e)
        e = n
        done = whole
        if not whole:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).hint("rebalance")
            large = e.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
            # an edge (a, b), a > b, seen from its smaller end b: a moves to b's smallest neighbour
            large = large.where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
            small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
            n = stage(small.where("a <> b").distinct(), "edges", compact=True)
            done = n.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() == 0 and n.join(n.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() == 0
            unstage(e)
            e = n
        if done:
            tops = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            out = stage(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops), "components")
            unstage(e)
            return out
    raise RuntimeError("components did not settle")


# ---- text hashing over Arrow buffers ----

SLICE = 1 << 19  # bytes of text handled at once


def string_slices(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about SLICE bytes; null as empty. A longer text is a run of its own."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1)
        yield at, offs[at : end + 1] - offs[at], data[offs[at] : offs[end]]
        at = end
    del bufs, data
    trim()


PRIME, PRIME_2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = PRIME) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            a = np.full(max(n, SLICE + 1), x, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _powers[base] = made[0], made[1]
    up, down = _powers[base]
    return up[:n], down[:n]


#: A scrambled value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(PRIME))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE, base: int = PRIME) -> np.ndarray:
    """c with c[i] = sum over j < i of table[data[j]] * base^j."""
    up, _ = powers(len(data) + 1, base)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = PRIME) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the span lies; the length goes in too."""
    _, down = powers(len(c), base)
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


WHITE = separators((0x20, 0x20), (0x09, 0x0D))
#: Lower-cased byte values, for words that ignore the case of A-Z.
LOWER_BYTE = BYTE[LOWER]


def words(offs: np.ndarray, data: np.ndarray, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start byte, first word of each text and the total) of a run of texts; A-Z in lower case."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    begin[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    h = span_hash(prefix_hash(data, LOWER_BYTE), s, e)
    return h, s, np.searchsorted(s, offs)


def trim() -> None:
    """Gives memory that a batch has freed back to the system, so that reused Python workers do not add up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            if (out := f(b)) is not None:
                yield out
        trim()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def flagged(docs: DataFrame, column: str, bits, mark: str) -> DataFrame:
    """docs with the boolean column `mark`: whether the row's key may be in the Bloom filter. Null keys are not."""
    from pyspark.sql import types as T

    at = docs.columns.index(column)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        key = b.column(at).cast(pa.int64())
        hit = in_bloom(bits.value, key.fill_null(0).to_numpy()) & ~key.is_null().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*b.schema.names, mark])

    return docs.mapInArrow(by_batch(run), T.StructType([*docs.schema.fields, T.StructField(mark, T.BooleanType())]))
