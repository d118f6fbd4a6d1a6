"""bigWig files by the published binary layout (fixed header, B+ chromosome tree, sections, R tree).

Sections are encoded and compressed by the executors, from rows that are range-sorted by contig and start. A bigWig is one file with one
index, so its sections' sizes and bounds, a row for each SECTION loci, come to the driver, which lays out header and index and then passes the
sections on in order, a partition at a time. The index has as many levels as it needs. Zoom levels are left out, which the format allows.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.frame import LocusFrame
from locusgrid.functions import expr as X

MAGIC, SECTION, FANOUT = 0x888FFC26, 1024, 256
HEAD, SUMMARY = 64, 40


def sections(rows: DataFrame, ids: dict[str, int]) -> DataFrame:
    """(c, s, e, n, lo, hi, total, squares, raw, blob) of runs of at most SECTION rows of one contig, in order within sorted partitions. rows:
    (chr, start, v) with 1-based starts; each value spans [start, start + 1]."""
    ordered = rows.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items = None, []

        def flush() -> pa.RecordBatch:
            body = b"".join(struct.pack("<If", s, v) for s, v in items)
            raw = struct.pack("<IIIIIBBH", ids[at], items[0][0], items[-1][0] + 2, 0, 2, 2, 0, len(items)) + body
            v = [x for _, x in items]
            row = (ids[at], items[0][0], items[-1][0] + 2, len(v), min(v), max(v), math.fsum(v), math.fsum(x * x for x in v), len(raw), zlib.compress(raw))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 4 + [pa.float64()] * 4 + [pa.int64(), pa.binary()], strict=True)], names=["c", "s", "e", "n", "lo", "hi", "total", "squares", "raw", "blob"])

        for b in batches:
            for name, start, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if items and (name != at or len(items) == SECTION):
                    yield flush()
                    items = []
                at = name
                items.append((start - 1, v))
        if items:
            yield flush()

    return ordered.mapInArrow(run, "c long, s long, e long, n long, lo double, hi double, total double, squares double, raw long, blob binary")


def chromosome_tree(names: list[str], sizes: dict[str, int]) -> bytes:
    width = max((len(n.encode()) for n in names), default=1)
    out = struct.pack("<IIIIQQ", 0x78CA8C91, max(1, len(names)), width, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    return out + b"".join(struct.pack(f"<{width}sII", n.encode(), i, sizes[n]) for i, n in enumerate(names))


def index(leaves: list[tuple[int, int, int, int, int]], at: int, end: int) -> bytes:
    """The R tree over sections (contig, start, end, offset, size), which begins at byte `at`; upper levels follow each other from the root."""
    levels = [[[(c, s, c, e, o, n) for c, s, e, o, n in leaves[i : i + FANOUT]] for i in range(0, len(leaves), FANOUT)] or [[]]]
    while len(levels[0]) > 1:
        below = levels[0]
        spans = [(x[0][0], x[0][1], x[-1][2], max(y[3] for y in x if y[2] == x[-1][2]), k) for k, x in enumerate(below)]
        levels.insert(0, [spans[i : i + FANOUT] for i in range(0, len(spans), FANOUT)])
    top = (leaves[0][0], leaves[0][1], leaves[-1][0], max(x[2] for x in leaves if x[0] == leaves[-1][0])) if leaves else (0, 0, 0, 0)
    head = struct.pack("<IIQIIIIQII", 0x2468ACE0, FANOUT, len(leaves), *top, end, 1, 0)
    size = lambda node, leaf: 4 + len(node) * (32 if leaf else 24)
    place, starts = at + len(head), []
    for k, level in enumerate(levels):
        starts.append([])
        for node in level:
            starts[k].append(place)
            place += size(node, k == len(levels) - 1)
    out = [head]
    for k, level in enumerate(levels):
        leaf = k == len(levels) - 1
        for node in level:
            out.append(struct.pack("<BBH", leaf, 0, len(node)))
            out += [struct.pack("<IIIIQQ", *x) if leaf else struct.pack("<IIIIQ", *x[:4], starts[k + 1][x[4]]) for x in node]
    return b"".join(out)


def encode(parts: DataFrame, sizes: dict[str, int]) -> Iterator[bytes]:
    """The file in pieces, from a persisted table of sections in order."""
    names = sorted(sizes)
    tree = chromosome_tree(names, sizes)
    data = HEAD + SUMMARY + len(tree)
    # a row for each SECTION loci
    meta = parts.select("c", "s", "e", "n", "lo", "hi", "total", "squares", "raw", F.octet_length("blob").alias("size")).toLocalIterator()
    leaves, offset, count, raw = [], data + 8, 0, 0
    lo, hi, total, squares = math.inf, -math.inf, 0.0, 0.0
    for m in meta:
        leaves.append((m.c, m.s, m.e, offset, m.size))
        offset, count, raw = offset + m.size, count + m.n, max(raw, m.raw)
        lo, hi, total, squares = min(lo, m.lo), max(hi, m.hi), total + m.total, squares + m.squares
    yield struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, HEAD + SUMMARY, data, offset, 0, 0, 0, HEAD, raw, 0)
    yield struct.pack("<Qdddd", count, lo if count else 0.0, hi if count else 0.0, total, squares) + tree + struct.pack("<Q", len(leaves))
    for r in parts.select("blob").toLocalIterator():
        yield bytes(r[0])
    yield index(leaves, offset, offset)


def write_bigwigs(m: LocusFrame, sizes: dict[str, int] | None = None) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(sample, pieces of its file in order), one sample at a time."""
    sizes = sizes or m.chrom_sizes
    if not sizes:
        raise ValueError("contig sizes are needed")
    ids = {n: i for i, n in enumerate(sorted(sizes))}
    if other := m.df.where(~F.col("chr").isin(list(ids)) & (X.row_count(m.betas) > 0)).select("chr").limit(1).collect():
        raise ValueError(f"no size for {other[0][0]}")
    for s in m.samples:
        rows = m.df.where(m.beta(s).isNotNull()).select("chr", "start", m.beta(s).cast("double").alias("v"))
        parts = sections(rows, ids).persist()
        try:
            yield s, encode(parts, sizes)
        finally:
            parts.unpersist()
