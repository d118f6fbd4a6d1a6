"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A full suffix array over all bytes costs a sort of every byte position. This one is sparse: a suffix is kept only where a text's
`passage`-byte windows have their minimiser, the grain (a run of GRAIN bytes) of least hash, leftmost on ties. Every window has exactly
one, the same place within it wherever the window stands, so two equal windows meet at suffixes that begin with the same grain, and no
repeat of `passage` bytes or more is missed. The minimisers of the longer `length`-byte windows are among them; their suffixes also carry
their context: the bytes that all the run's windows cover, a run being the windows whose minimiser it is.

Batches of documents get suffix arrays in order of fingerprint: (grain, context, count). A new batch is merge-scanned against itself
and every level of the family for suffixes that match another, then joins the family at level 0; two levels of equal rank are merged into
the next, so a batch is rewritten log2(batches) times. A scan finds

* a context that stands twice: all windows of its runs are repeated;
* a grain with several contexts: the runs' windows may be repeated in part. These runs' bytes are cut out, and counted by blocks of
  windows; a block that stands twice is repeated whole; one whose common core stands twice is cut into single windows, which are counted;
* a grain that stands twice: its documents share GRAIN bytes or more, and every repeat of `passage` bytes or more is among these. That is
  reported (n_echoes), not removed.

Contexts, blocks and windows are compared as two independent 64-bit hashes, 128 bits in all. All counts are aggregates with map-side
combine: a passage in a third of all documents makes one row per task. Matches never cross documents; the same document may hold both.
Windows are merged into runs of removed bytes, in sorted order, before a document's runs are gathered.

Defined cases: null and empty texts have no bytes and the digest of the empty string; texts under `length` bytes stay whole as they can
hold no window; repeated rows (equal ids too) repeat each other's bytes and get one result each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C

GRAIN = 96
PASSAGE = 256  # bytes of a repeat that is reported at least; about fifty short words
BLOCK = 16  # windows in a block
PART = 1 << 22  # positions of a longer text handled at once

Sums = tuple[np.ndarray, np.ndarray]


def sums(data: np.ndarray) -> Sums:
    return C.prefix_hash(data), C.prefix_hash(data, base=C.PRIME_2)


def named(c: Sums, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of data[start:end]."""
    return C.span_hash(c[0], start, end).astype(np.int64), C.span_hash(c[1], start, end, C.PRIME_2).astype(np.int64)


def minimiser_keys(c: Sums) -> np.ndarray:
    at = np.arange(len(c[0]) - GRAIN)
    return C.span_hash(c[0], at, at + GRAIN)


def window_runs(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): maximal runs of windows with the same minimiser, from the hashes of a text's grains."""
    n = len(h) + GRAIN - length
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    best = sliding_argmin(h, length - GRAIN + 1)
    cut = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    return best[cut], cut, np.concatenate((cut[1:], [n])) - 1


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost minimum of each run of w elements."""
    out = []
    for a in range(0, len(h) - w + 1, PART):
        part = h[a : a + PART + w - 1]
        m = len(part)
        # order by hash, then place: 40 bits of the hash and 24 of the place
        key = (part >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
        pad = (-m) % w
        full = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
        fore = np.minimum.accumulate(full, 1).ravel()
        back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
        best = np.minimum(back[: m - w + 1], fore[w - 1 : m])
        out.append((best & np.uint64((1 << 24) - 1)).astype(np.int64) + a)
    return np.concatenate(out)


def texts(col: pa.Array, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes) of the texts of at least `least` bytes."""
    for at, offs, data in C.string_slices(col):
        for i in np.flatnonzero(np.diff(offs) >= least).tolist():
            yield at + i, data[offs[i] : offs[i + 1]]


def flat(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from f(b)

    return run


def suffix_rows(docs: DataFrame, length: int, passage: int) -> DataFrame:
    """(row, at, grain, first, last, x, y): the sparse suffixes of each text. Those that are minimisers of `length`-byte windows have their
    run of windows and the hashes of its context; the others have nulls there. docs: (row, text)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = b.column("row").to_numpy()
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for i, data in texts(b.column("text"), passage):
            c = sums(data)
            h = minimiser_keys(c)
            at = window_runs(h, passage)[0]
            a, s, e = window_runs(h, length)
            place = np.searchsorted(at, a)  # these anchors are among the others
            x, y = named(c, s, e + length)
            more = [np.zeros(len(at), t) for t in (np.int32, np.int32, np.int64, np.int64)]
            for o, v in zip(more, (s, e, x, y), strict=True):
                o[place] = v
            none = np.ones(len(at), bool)
            none[place] = False
            parts.append((np.full(len(at), rows[i]), at.astype(np.int32), h[at].astype(np.int64), *more, none))
            held += len(at)
            if held > 1 << 16:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    def out(parts) -> pa.RecordBatch:
        *cols, none = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(v) for v in cols[:3]), *(pa.array(v, mask=none) for v in cols[3:])], names=["row", "at", "grain", "first", "last", "x", "y"])

    return docs.select("row", "text").mapInArrow(flat(run), "row long, at int, grain long, first int, last int, x long, y long")


NAME = ["grain", "x", "y"]


class SuffixFamily:
    """Suffix arrays (grain, x, y, k) in levels of doubling rank, each a staged table in order of fingerprint."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.hits: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Scans a batch against itself and the levels, then takes it in. The result is what the scan met: (grain, x, y, whole, part) of the
        suffixes, old and new, whose grain the batch has and that is not alone; whole: the context stands twice; part: its grain has
        other contexts."""
        level = C.stage(suffixes.groupBy(NAME).agg(F.count("*").alias("k")).sortWithinPartitions(NAME), "suffix-level")
        every = level.withColumn("new", F.lit(True))
        for other in self.levels.values():
            every = every.unionByName(other.withColumn("new", F.lit(False)))
        every = every.groupBy(NAME).agg(F.sum("k").alias("k"), F.max("new").alias("new"))
        met = every.groupBy("grain").agg(F.sum("k").alias("n"), F.count("x").alias("contexts"), F.max("new").alias("new")).where("new AND n > 1").select("grain", "contexts").hint("rebalance")  # so that Spark can split a hot grain in the join
        hits = every.join(met, "grain").select(*NAME, (F.col("x").isNotNull() & (F.col("k") > 1)).alias("whole"), (F.col("x").isNotNull() & (F.col("contexts") > 1)).alias("part"))
        hits = C.stage(hits, "suffix-hits")
        self.hits.append(hits)
        rank = 0
        while (other := self.levels.pop(rank, None)) is not None:
            merged = level.unionByName(other).groupBy(NAME).agg(F.sum("k").alias("k"))
            merged = C.stage(merged.sortWithinPartitions(NAME), "suffix-level")
            C.unstage(level, other)
            level, rank = merged, rank + 1
        self.levels[rank] = level
        return hits

    def met(self) -> DataFrame:
        """(grain, x, y, whole, part) of all that the scans so far have met."""
        every = self.hits[0]
        for x in self.hits[1:]:
            every = every.unionByName(x)
        return every.groupBy(NAME).agg(F.max("whole").alias("whole"), F.max("part").alias("part"))

    def close(self) -> None:
        """Deletes the family's tables."""
        C.unstage(*self.levels.values(), *self.hits)


def cut_bytes(docs: DataFrame, wanted, length: int) -> DataFrame:
    """The runs whose context may be wanted: n windows from byte `first` on, the anchor's place after it, and all bytes covered."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, got, seen = b.column("row").to_numpy(), [], set()
        for i, data in texts(b.column("text"), length):
            c = sums(data)
            a, s, e = window_runs(minimiser_keys(c), length)
            x, y = named(c, s, e + length)
            for k in np.flatnonzero(C.in_bloom(wanted.value, x)):
                if (name := (int(x[k]), int(y[k]))) not in seen:  # one run of a context is enough
                    seen.add(name)
                    got.append((*name, int(rows[i]), int(s[k]), int(e[k] - s[k]) + 1, int(a[k] - s[k]), data[s[k] : e[k] + length].tobytes()))
            if len(got) > 4096:
                yield out(got)
                got = []
        if got:
            yield out(got)

    def out(got) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["x", "y", "row", "first", "n", "anchor", "bytes"])

    return docs.select("row", "text").mapInArrow(flat(run), "x long, y long, row long, first int, n int, anchor int, bytes binary")


def block_rows(runs: DataFrame, length: int) -> DataFrame:
    """(x, y, j, a, z, wx, wy, core): blocks of windows aligned to the anchor, windows a..z of the run and the hashes of all their bytes;
    core: bytes that all windows of the block's full range would share."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list[np.ndarray]] = [[] for _ in range(8)]
        for x, y, n, anchor, buf in zip(*(b.column(k).to_pylist() for k in range(4)), b.column("bytes"), strict=True):
            c = sums(np.frombuffer(buf.as_buffer(), np.uint8))
            j = np.arange(-anchor // BLOCK, (n - 1 - anchor) // BLOCK + 1)
            a, z = np.maximum(j * BLOCK + anchor, 0), np.minimum(j * BLOCK + BLOCK - 1 + anchor, n - 1)
            # every window of the block holds the bytes from the last window's start to the first one's end, if the block were full
            core = C.span_hash(c[0], j * BLOCK + BLOCK - 1 + anchor, j * BLOCK + anchor + length)
            for o, v in zip(cols, (np.full(len(j), x), np.full(len(j), y), j, a, z, *named(c, a, z + length), core), strict=True):
                o.append(v)
        if not cols[0]:
            return None
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(t)) for o, t in zip(cols, kinds, strict=True)], names=["x", "y", "j", "a", "z", "wx", "wy", "core"])

    return runs.select("x", "y", "n", "anchor", "bytes").mapInArrow(C.by_batch(run), "x long, y long, j int, a int, z int, wx long, wy long, core long")


def window_rows(runs: DataFrame, length: int) -> DataFrame:
    """(row, first, wx, wy) of the windows of the given blocks. runs: (row, first, bytes, spans array<struct<a, z>>)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for row, first, buf, spans in zip(b.column("row").to_pylist(), b.column("first").to_pylist(), b.column("bytes"), b.column("spans").to_pylist(), strict=True):
            c = sums(np.frombuffer(buf.as_buffer(), np.uint8))
            o = np.concatenate([np.arange(v["a"], v["z"] + 1) for v in spans])
            for t, v in zip(cols, (np.full(len(o), row), first + o, *named(c, o, o + length)), strict=True):
                t.append(v)
        if not cols[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(t)) for o, t in zip(cols, (np.int64, np.int32, np.int64, np.int64), strict=True)], names=["row", "first", "wx", "wy"])

    return runs.select("row", "first", "bytes", "spans").mapInArrow(C.by_batch(run), "row long, first int, wx long, wy long")


def merged(windows: DataFrame, length: int) -> DataFrame:
    """(row, a, z): the bytes that the windows (row, first, last) cover, as runs that neither overlap nor touch. Sorted windows are merged
    as they stream by, so a long document is many small rows here."""
    by_row = windows.repartition("row").sortWithinPartitions("row", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int] | None = None
        for b in batches:
            row, s, e = b.column("row").to_numpy(), b.column("first").to_numpy().astype(np.int64), b.column("last").to_numpy().astype(np.int64) + length
            if held is not None:
                row, s, e = (np.concatenate(([h], v)) for h, v in zip(held, (row, s, e), strict=True))
            if not len(row):
                continue
            no = np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))  # ends of earlier rows must not count
            top = np.maximum.accumulate(e + (no << np.int64(32)))
            new = np.flatnonzero(np.concatenate(([True], s[1:] + (no[1:] << np.int64(32)) > top[:-1])))
            stop = top[np.concatenate((new[1:], [len(s)])) - 1] & np.int64((1 << 32) - 1)
            row, s = row[new], s[new]
            held = int(row[-1]), int(s[-1]), int(stop[-1])
            yield pa.RecordBatch.from_arrays([pa.array(v[:-1]) for v in (row, s, stop)], names=["row", "a", "z"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in held], names=["row", "a", "z"])

    return by_row.select("row", "first", "last").mapInArrow(run, "row long, a long, z long")


def repeats(docs: DataFrame, length: int, passage: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """Staged tables: (row, a, z), the runs of bytes to remove, and (row, n_echoes). docs: (row, text)."""
    spark = docs.sparkSession
    suffixes = C.stage(suffix_rows(docs, length, passage), "suffix-rows")
    family = SuffixFamily()
    for k in range(batches):
        family.add(suffixes.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == k))
    found = C.stage(family.met(), "suffix-found")
    family.close()
    echoes = suffixes.join(found.select("grain").distinct(), "grain", "left_semi").select("row", "at").distinct().groupBy("row").agg(F.count("*").alias("n_echoes"))
    echoes = C.stage(echoes, "suffix-echoes")
    whole = C.stage(suffixes.join(found.where("whole").select(NAME), NAME, "left_semi").select("row", "first", "last"), "suffix-whole")
    part = C.stage(found.where("part").select("x", "y").distinct(), "suffix-part")
    C.unstage(suffixes, found)

    bits = spark.sparkContext.broadcast(C.bloom(part, "x", 25))
    cut = cut_bytes(docs, bits, length).join(part, ["x", "y"], "left_semi")
    one = F.min_by(F.struct("row", "first", "n", "anchor", "bytes"), F.struct("row", "first"))  # whole contexts have several runs, equal in bytes
    runs = C.stage(cut.groupBy("x", "y").agg(one.alias("r")).select("x", "y", "r.*"), "suffix-runs")
    bits.destroy()
    blocks = C.stage(block_rows(runs, length), "suffix-blocks")
    by = blocks.groupBy("core", "wx", "wy").agg(F.count("*").alias("k"), F.min(F.struct("x", "y", "a", "z")).alias("rep"))
    core = by.groupBy("core").agg(F.count("*").alias("n"), F.max("k").alias("top")).where("n > 1 OR top > 1").select("core", "n")
    by = C.stage(by.join(core, "core").where("k > 1 OR n > 1"), "suffix-met")
    place = runs.select("x", "y", "row", "first")
    settled = blocks.join(by.where("k > 1").select("core", "wx", "wy"), ["core", "wx", "wy"], "left_semi").join(place, ["x", "y"]).select("row", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("z")).alias("last"))
    spans = by.where("n > 1").groupBy("rep.x", "rep.y").agg(F.collect_list(F.struct("rep.a", "rep.z")).alias("spans"))
    windows = C.stage(window_rows(runs.join(spans, ["x", "y"]), length), "suffix-windows")
    again = windows.groupBy("wx", "wy").agg(F.count("*").alias("k")).where("k > 1").select("wx", "wy")
    single = windows.join(again, ["wx", "wy"], "left_semi").select("row", "first", F.col("first").alias("last"))
    out = C.stage(merged(whole.unionByName(settled).unionByName(single), length), "suffix-spans")
    C.unstage(whole, part, runs, blocks, by, windows)
    return out, echoes


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = PASSAGE, batches: int = 3, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_echoes[, kept]) of every row of docs (doc_id, text, ...). n_echoes: the document's
    suffixes whose first GRAIN bytes also start elsewhere; at least one wherever `passage` bytes or more repeat."""
    if not GRAIN <= passage <= length:
        raise ValueError(f"passage must lie between {GRAIN} and length")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.withColumn("row", F.xxhash64("doc_id", "text"))  # the same in every pass; repeated rows share it and their spans
    found, echoes = repeats(d.select("row", "text"), length, passage, batches)
    spans = C.stage(found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "z"))).alias("spans")).join(echoes, "row", "full"), "suffix-marks")
    C.unstage(found, echoes)
    bits = docs.sparkSession.sparkContext.broadcast(C.bloom(spans, "row", 24))

    def apply(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for x, spans in zip(b.column("text").cast(pa.large_binary()), b.column("spans").to_pylist(), strict=True):
            data = x.as_buffer().to_pybytes()
            at, parts, removed = 0, [], 0
            for s in spans or []:
                parts.append(data[at : s["a"]])
                removed, at = removed + s["z"] - s["a"], s["z"]
            kept = b"".join(parts) + data[at:]
            for o, y in zip(out, (len(data), removed, len(spans or []), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                o.append(y)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        first, last = [b.column("doc_id"), *[pa.array(o, t) for o, t in zip(out[:4], kinds, strict=False)], b.column("n_echoes")], [pa.array(out[4], pa.binary())] if with_text else []
        return pa.RecordBatch.from_arrays(first + last, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_echoes", "kept"][: 6 + with_text])

    # only texts that may have spans move; the others are finished where they are
    marked = C.flagged(d, "row", bits, "maybe")
    moved = marked.where("maybe").join(spans, "row", "left").select("doc_id", "text", "spans", F.coalesce("n_echoes", F.lit(0)).cast("long").alias("n_echoes"))
    done = moved.mapInArrow(C.by_batch(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_echoes long" + ", kept binary" * with_text)
    zero = F.lit(0).cast("long")
    kept = F.encode("text", "UTF-8")
    rest = marked.where("NOT maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), zero.alias("n_echoes"), *([kept.alias("kept")] if with_text else []))
    return rest.unionByName(done)


def op8(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir))
