"""Near-duplicate vectors: int8 tile products with exact error bounds, full precision where the bound leaves doubt.

Each vector is first divided by its largest component, so that no square under- or overflows, then by its norm. A unit vector x is s q + e
with integers q of -127..127, s = max|x| / 127, and |e| known exactly. For two vectors x.y = s_x s_y q_x.q_y + r with
|r| <= |s_x q_x| |e_y| + |e_x| |s_y q_y| + |e_x| |e_y|. A pair whose bounds stay under the threshold is certainly no link, one whose bounds
stay over it certainly is one; pairs between are recomputed in double precision from the given components. Products of int8 tiles are
taken in float32, where these integers (below 2^24 up to 1,040 dimensions; wider ones use double) are exact.

Equal vectors are one class with a count. Classes are dealt into blocks, and each pair of blocks is one task's work. What travels to the
tiles is codes, scale and norms; full vectors follow in a second step, only to tiles where they are in doubt. A tile returns how many
vectors each of its vectors links with and a spanning forest of its links, so that a dense group makes rows in proportion to its size, not
to its pairs.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components link with nothing; vectors of different
lengths do not link; a null id gets a row with no links and a null component, and counts as a partner only if an equal vector has an id;
repeated rows keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C

STEP = 2048  # vectors of a side in one product
SLACK = 1e-9  # of double precision itself


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of norm 1. Components far below a row's largest vanish, by less than the slack."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, |s q|, |e|) of unit rows; the norms are rounded up."""
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    up = 1 + 1e-12
    return q, s, np.sqrt((back**2).sum(1)) * up, np.sqrt(((x - back) ** 2).sum(1)) * up + 1e-15


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of the edges (a, b): each node to its component's smallest."""
    node, root = C.roots(a, b)
    far = node != root
    return node[far], root[far]


def judged(x, y, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, certain) of the pairs that are links for certain or may be. x, y: (codes, scale, |s q|, |e|)."""
    (qx, sx, nx, ex), (qy, sy, ny, ey) = x, y
    kind = np.float32 if qx.shape[1] <= 1040 else np.float64
    g = qx.astype(kind) @ qy.astype(kind).T
    low = threshold - SLACK
    # a threshold on the integer product that holds for the whole row: largest bound and scale of the other side
    row = low - (nx * ey.max() + ex * ny.max() + ex * ey.max())
    row /= sx * np.where(row > 0, sy.max(), sy.min())
    i, j = np.nonzero(g >= np.floor(row).astype(kind)[:, None])
    about = g[i, j].astype(np.float64) * sx[i] * sy[j]
    bound = nx[i] * ey[j] + ex[i] * ny[j] + ex[i] * ey[j]
    keep = about + bound >= low
    return i[keep], j[keep], about[keep] - bound[keep] >= threshold + SLACK


def exact(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the rows of a and b reach the threshold, in double precision, scaled by each row's largest component."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= threshold


def vectors(t: pa.Table, column: str, kind) -> np.ndarray:
    """A matrix of a binary column."""
    return np.frombuffer(b"".join(x.as_buffer() for x in t.column(column).combine_chunks()), kind).reshape(t.num_rows, -1)


def pairs_of(coded, left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
    """The judged pairs of two lists of rows, product by product; each pair once."""
    side = lambda k: tuple(c[k] for c in coded)
    for a in range(0, len(left), STEP):
        for b in range(a if same else 0, len(right), STEP):
            p, r = left[a : a + STEP], right[b : b + STEP]
            x, y, sure = judged(side(p), side(r), threshold)
            x, y = p[x], r[y]
            keep = x < y if same and a == b else np.ones(len(x), bool)
            yield x[keep], y[keep], sure[keep]


def tallied(rep: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """(a, links, b, has_b) rows: links of each vector, and the edges of a spanning forest."""
    links = np.bincount(x, m[y], len(rep)) + np.bincount(y, m[x], len(rep))
    some = np.flatnonzero(links)
    u, v = forest(x, y) if len(x) else (np.zeros(0, np.int64),) * 2
    return [np.concatenate((rep[some], rep[u])), np.concatenate((links[some].astype(np.int64), np.zeros(len(u), np.int64))), np.concatenate((rep[some], rep[v]))]


FOUND = "p int, q int, a long, links long, b long, doubt boolean"


def near_duplicates(df: DataFrame, threshold: float = 0.95, block: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of df (vec_id, embedding, ...)."""
    base = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    plain = F.transform("v", lambda c: c + 0.0)  # -0.0 and 0.0 are one value
    base = C.stage(base.select("vec_id", F.when(F.col("vec_id").isNotNull() & sound, plain).alias("v")).withColumn("k", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))), "vec-rows")
    classes = base.where("k IS NOT NULL").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        """Classes with their vectors as bytes, codes, scale and norms."""
        blob, codes, more = [], [], [[], [], []]
        for x in b.column("v"):
            v = x.values.to_numpy(zero_copy_only=False)
            q, *rest = quantise(unit(v[None]))
            blob.append(v.tobytes())
            codes.append(q.tobytes())
            for o, r in zip(more, rest, strict=True):
                o.append(float(r[0]))
        cols = [b.column(c) for c in ("k", "rep", "m")] + [pa.array([len(x) for x in codes], pa.int32()), pa.array(blob, pa.binary()), pa.array(codes, pa.binary()), *(pa.array(o, pa.float64()) for o in more)]
        return pa.RecordBatch.from_arrays(cols, names=["k", "rep", "m", "dim", "v", "q", "s", "sq", "e"])

    classes = C.stage(classes.select("k", "rep", "m", "v").mapInArrow(C.by_batch(code), "k string, rep long, m long, dim int, v binary, q binary, s double, sq double, e double"), "vec-classes")
    total = classes.count()
    n_blocks = max(1, math.ceil(total / block))
    own = F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int")
    # each block goes to the pairs that it is in: i with every j
    copies = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    sent = classes.select("rep", "m", "dim", "q", "s", "sq", "e", own.alias("i")).withColumn("j", copies)
    sent = sent.select(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("t"), "dim", "i", "rep", "m", "q", "s", "sq", "e")

    def sides(t: pa.Table):
        p, r = t.column("p")[0].as_py(), t.column("t")[0].as_py()
        i = t.column("i").to_numpy()
        return p, r, np.flatnonzero(i == p), np.flatnonzero(i == r)

    def rows(p: int, r: int, cols: list[np.ndarray], doubtful: np.ndarray) -> pa.Table:
        a, links, b = cols
        n, d = len(a), len(doubtful)
        none = np.concatenate((links > 0, np.ones(d, bool)))
        return pa.table({"p": pa.array(np.full(n + d, p), pa.int32()), "q": pa.array(np.full(n + d, r), pa.int32()), "a": pa.array(np.concatenate((a, doubtful)), pa.int64()), "links": pa.array(np.concatenate((links, np.zeros(d, np.int64))), pa.int64()), "b": pa.array(np.concatenate((b, doubtful)), pa.int64(), mask=none), "doubt": pa.array(np.arange(n + d) >= n)})

    def work(t: pa.Table) -> pa.Table:
        p, r, left, right = sides(t)
        rep, m = t.column("rep").to_numpy(), t.column("m").to_numpy()
        coded = (vectors(t, "q", np.int8), *(t.column(c).to_numpy() for c in ("s", "sq", "e")))
        sure: list[list[np.ndarray]] = [[], []]
        doubt = np.zeros(len(rep), bool)
        for x, y, ok in pairs_of(coded, left, right, p == r, threshold):
            sure[0].append(x[ok])
            sure[1].append(y[ok])
            doubt[x[~ok]] = doubt[y[~ok]] = True
        x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in sure)
        return rows(p, r, tallied(rep, m, x, y), rep[doubt])

    found = C.stage(sent.groupBy("p", "t", "dim").applyInArrow(work, FOUND), "vec-found")

    def settle(t: pa.Table) -> pa.Table:
        """The pairs in doubt of a tile, from full vectors. The codes tell them again."""
        p, r, left, right = sides(t)
        rep, m, v = t.column("rep").to_numpy(), t.column("m").to_numpy(), vectors(t, "v", np.float64)
        good: list[list[np.ndarray]] = [[], []]
        coded = (vectors(t, "q", np.int8), *(t.column(c).to_numpy() for c in ("s", "sq", "e")))
        for x, y, ok in pairs_of(coded, left, right, p == r, threshold):
            x, y = x[~ok], y[~ok]
            for k in range(0, len(x), 1 << 16):
                a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                link = exact(v[a], v[b], threshold)
                good[0].append(a[link])
                good[1].append(b[link])
        x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in good)
        return rows(p, r, tallied(rep, m, x, y), np.zeros(0, np.int64))

    asked = found.where("doubt").select("p", F.col("q").alias("t"), F.col("a").alias("rep")).join(classes.drop("k").withColumn("i", own), "rep")
    settled = C.stage(asked.groupBy("p", "t", "dim").applyInArrow(settle, FOUND), "vec-settled")
    every = found.where("NOT doubt").unionByName(settled)
    links = every.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    comp = C.components(every.where("b IS NOT NULL").select("a", "b"))
    per = classes.select("k", "rep", "m").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per = C.stage(per.select("k", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vec-links")
    C.unstage(found, settled, comp, classes)
    out = base.select("vec_id", "k").join(per, "k", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
