"""Exact Jaccard join of documents on word n-grams: rare-first prefixes, length, positional and suffix filters.

Documents with equal n-gram sets are one class, named by a fingerprint of the set. The steps:

1. One pass over the texts gives each document's set size and class, and a fixed-size sketch of n-gram counts over all documents.
2. A second pass orders each set rare first (by the sketch's count, then the n-gram's hash: the same total order in every set) and
   keeps the prefix that any partner must share an n-gram with.
3. A prefix n-gram held by two classes or more is a bucket. Each class is first compared with its bucket's smallest and largest class,
   which is linear in the bucket; the components of these links follow.
4. Then every pair of a bucket's other classes that lies in different components and passes the filters (length, position, and the suffix
   filter's bound from parity bits of the whole sets) is compared, once. A bucket of up to three classes, or of one component, needs
   nothing more, so a large group of near copies never makes all its pairs, and no link between components is lost.

Texts of the compared classes come from a third pass and travel compressed: a set takes eight bytes a word, its packed text two or three.
n-grams are 64-bit hashes throughout.

Defined cases: a text without words or a null text has an empty set, links with nothing; fewer words than n make one n-gram of the
whole sequence; a null id gets a row with a null component, though links may pass through its text; repeated ids and rows keep a row each
and link by their texts; an empty table gives an empty result; very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C

HEADS = 24  # first open n-grams of a class by which repeated pairs are told
HELD = 16 << 20  # bytes of sets that a task of `verify` keeps for its next pairs
SKETCH = 1 << 20  # counters in the sketch of n-gram counts, whatever the corpus


def shingles(offs: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, text after text, each text's sorted; offsets) of a run of texts."""
    h, _, first = C.words(offs, data)
    count = np.diff(first)
    odd = C.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(C.PRIME)) | np.uint64(1)
    full = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        full += h[k : k + len(full)] * odd[k]
    full = C.mix(full + np.uint64(n))
    out, sizes = [], np.zeros(len(count), np.int64)
    for i, m in enumerate(count):
        a = first[i]
        if m >= n:
            u = full[a : a + m - n + 1].copy()
            u.sort()
            if len(u) > 1:
                u = u[np.concatenate(([True], u[1:] != u[:-1]))]
        elif m:
            u = C.mix((h[a : a + m] * odd[:m]).sum(keepdims=True) + np.uint64(m))
        else:
            continue
        out.append(u)
        sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def fingerprint(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A class name for each set: its mixed hashes summed, with the size."""
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
    return C.mix(c[offs[1:]] - c[offs[:-1]] + np.diff(offs).astype(np.uint64)).astype(np.int64)


def needed(n, percent: int):
    """The least overlap with any partner of a set of n."""
    return (n * percent + 99) // 100


def pair_needed(na, nb, percent: int):
    """The least overlap of two sets: 100 i >= percent (na + nb - i)."""
    return ((na + nb) * percent + 99 + percent) // (100 + percent)


def first_pass(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: key, id, size and class of a document; kind 1: a chunk of the task's n-gram counts. docs: (doc_id, text, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, seen = np.zeros(SKETCH, np.int64), False
        for b in batches:
            ids = b.column(0)
            for at, offs, data in C.string_slices(b.column(1)):
                values, so = shingles(offs, data, n)
                counts += np.bincount((values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                seen = True
                k = len(so) - 1
                null = lambda t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), b.column(2).slice(at, k), ids.slice(at, k), pa.array(np.diff(so)), pa.array(fingerprint(values, so)), null(pa.int64()), null(pa.int32()), null(pa.binary())], names=NAMES)
        if seen:
            rows = C.chunk_rows(counts)
            k, me = len(rows), TaskContext.get().partitionId()
            null = lambda: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), null(), null(), null(), null(), pa.array([me] * k, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=NAMES)

    return docs.mapInArrow(run, "kind int, key long, doc_id long, n long, sig long, task long, chunk int, blob binary")


NAMES = ["kind", "key", "doc_id", "n", "sig", "task", "chunk", "blob"]


MAPS = ["m0", "m1", "m2", "m3"]


def parity(values: np.ndarray) -> np.ndarray:
    """256 bits as four longs: whether a set has an odd number of members for each value of eight hash bits."""
    odd = np.bincount((values >> np.uint64(24)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near(a: str, b: str, percent: int):
    """The suffix filter: every bit that differs is a member that only one of the two sets has, and no more than n1 + n2 - 2 want may be."""
    want = F.floor(((F.col(f"{a}n") + F.col(f"{b}n")) * percent + 99 + percent) / (100 + percent))
    apart = sum((F.bit_count(F.col(a + m).bitwiseXOR(F.col(b + m))) for m in MAPS), F.lit(0))
    return apart <= F.col(f"{a}n") + F.col(f"{b}n") - 2 * want


def prefixes(docs: DataFrame, counts, n: int, percent: int) -> DataFrame:
    """(sig, n, blob, m0..m3): the prefix n-grams of each class, rare first, and the parity bits of its whole set; a class that a task
    meets again is left out there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        for b in batches:
            for _, offs, data in C.string_slices(b.column(0)):
                values, so = shingles(offs, data, n)
                sig = fingerprint(values, so)
                freq = table[(values & np.uint64(SKETCH - 1)).astype(np.int64)]
                rows: list[tuple[int, int, bytes]] = []
                maps: list[np.ndarray] = []
                for i, s in enumerate(sig.tolist()):
                    size = int(so[i + 1] - so[i])
                    if not size or s in seen:
                        continue
                    seen.add(s)
                    v = values[so[i] : so[i + 1]]
                    order = np.argsort(freq[so[i] : so[i + 1]], kind="stable")  # values are sorted: ties by hash
                    maps.append(parity(v))
                    rows.append((s, size, v[order[: size - needed(size, percent) + 1]].tobytes()))
                if rows:
                    s, z, p = zip(*rows, strict=True)
                    bits = np.stack(maps)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(z, pa.int64()), pa.array(p, pa.binary()), *[pa.array(bits[:, k]) for k in range(4)]], names=["sig", "n", "blob", *MAPS])

    return docs.select("text").mapInArrow(run, "sig long, n long, blob binary, m0 long, m1 long, m2 long, m3 long")


def ends(prefix: DataFrame) -> DataFrame:
    """(h, sig): of each prefix n-gram the smallest and largest class in a batch, so that even a hot one makes two rows a batch at most."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, size = unpacked(b)
        if not len(h):
            return None
        sig = np.repeat(b.column("sig").to_numpy(), size)
        order = np.lexsort((sig, h))
        h, sig = h[order], sig[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        last = np.concatenate((new[1:], [True]))
        keep = new | (last & np.concatenate(([False], sig[1:] != sig[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(sig[keep])], names=["h", "sig"])

    return prefix.mapInArrow(C.by_batch(run), "h long, sig long")


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a batch of prefixes, and how many each has."""
    blobs = [x.as_buffer() for x in b.column("blob")]
    return np.frombuffer(b"".join(blobs), np.int64), np.array([len(x) // 8 for x in blobs], np.int64)


def entries(prefix: DataFrame, bits) -> DataFrame:
    """(h, sig, n, pos) of the prefix n-grams that may be shared, by a Bloom filter."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, size = unpacked(b)
        if not len(h):
            return None
        keep = C.in_bloom(bits.value, h)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        cols = [h, np.repeat(b.column("sig").to_numpy(), size), np.repeat(b.column("n").to_numpy(), size).astype(np.int32), pos.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["h", "sig", "n", "pos"])

    return prefix.mapInArrow(C.by_batch(run), "h long, sig long, n int, pos int")


def possible(n1, p1, n2, p2, percent: int):
    """Whether two sets with a common n-gram at these places can be similar enough, by length and position. If they are, their first
    common n-gram passes: at least `want` n-grams are common, so it has `want` - 1 or more others after it in both sets."""
    want = F.floor(((n1 + n2) * percent + 99 + percent) / (100 + percent))
    length = (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)
    return length & (p1 <= n1 - want) & (p2 <= n2 - want)


def packed(text: bytes) -> bytes:
    """The length of a text and the text compressed."""
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def unpacked_set(blob: pa.Buffer, n: int) -> np.ndarray:
    """The sorted n-gram set of a packed text."""
    size = int.from_bytes(blob[:8].to_pybytes(), "little")
    data = np.frombuffer(pa.decompress(blob[8:], size, "zstd"), np.uint8)
    return shingles(np.array([0, size]), data, n)[0]


def texts(docs: DataFrame, wanted, n: int) -> DataFrame:
    """(sig, blob) of the documents whose key may be wanted: the class and the packed text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = C.in_bloom(wanted.value, b.column(2).to_numpy())
        col = b.column(1).filter(pa.array(keep))
        rows, seen = [], set()
        for _, offs, data in C.string_slices(col):
            values, so = shingles(offs, data, n)
            for i, s in enumerate(fingerprint(values, so).tolist()):
                if s not in seen:
                    seen.add(s)
                    rows.append((s, packed(data[offs[i] : offs[i + 1]].tobytes())))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["sig", "blob"])

    return docs.mapInArrow(C.by_batch(run), "sig long, blob binary")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the overlap from one split: partners lie on the same side of the middle element of y."""
    m = len(y) // 2
    k = int(np.searchsorted(x, y[m]))
    return min(k, m) + min(len(x) - k, len(y) - m)


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a staged table of classes whose sets are similar enough, as a table. Each pair is compared once, with sets of
    just its texts, of which a task holds the last HELD bytes."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(classes, "sig").select("key")
    wanted = docs.sparkSession.sparkContext.broadcast(C.bloom(named, "key", 24))
    store = C.stage(texts(docs, wanted, n), "ngram-texts")
    wanted.destroy()
    left = pairs.join(store.select(F.col("sig").alias("a"), F.col("blob").alias("x")), "a")
    both = left.join(store.select(F.col("sig").alias("b"), F.col("blob").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        room = HELD

        def members(sig: int, blob: pa.BinaryScalar) -> np.ndarray:
            nonlocal room
            if sig not in held:
                v = unpacked_set(blob.as_buffer(), n)
                if v.nbytes > room:
                    held.clear()
                    room = HELD
                held[sig] = v
                room -= v.nbytes
            return held[sig]

        for t in batches:
            good = []
            for a, b, p, q in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("x"), t.column("y"), strict=True):
                x, y = members(a, p), members(b, q)
                want = pair_needed(len(x), len(y), percent)
                good.append(min(len(x), len(y)) >= want and suffix_bound(x, y) >= want and overlap(x, y) >= want)
            yield t.select([0, 1]).filter(pa.array(good, pa.bool_()))
        held.clear()
        C.trim()

    out = C.stage(both.mapInArrow(run, "a long, b long"), "ngram-links")
    C.unstage(store)
    return out


def linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Staged tables: rows (key, doc_id, n, sig), one for each of docs (doc_id, text, key); and (sig, rep, comp) of each class of equal
    non-empty sets: its smallest id, and the class that names its component."""
    spark = docs.sparkSession
    one = C.stage(first_pass(docs, n), "ngram-first")
    rows = C.stage(one.where("kind = 0").select("key", "doc_id", "n", "sig"), "ngram-rows")
    counts = spark.sparkContext.broadcast(C.merge_chunks(one.where("kind = 1").select("task", "chunk", "blob"), SKETCH).astype(np.uint32))
    C.unstage(one)
    classes = C.stage(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key")), "ngram-classes")
    prefix = C.stage(prefixes(docs, counts, n, percent), "ngram-prefix")
    counts.destroy()

    shared = ends(prefix).repartition("h").groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi")
    bits = spark.sparkContext.broadcast(C.bloom(shared, "h", 25))
    held = C.stage(entries(prefix, bits), "ngram-held")
    bits.destroy()
    shape = C.stage(prefix.select("sig", "n", *MAPS).dropDuplicates(["sig"]), "ngram-shape")
    C.unstage(prefix)

    me = F.struct("sig", "n", "pos")
    extremes = held.groupBy("h").agg(F.min(me).alias("lo"), F.max(me).alias("hi"), F.count("*").alias("k")).where("lo.sig <> hi.sig")
    partners = F.filter(F.array("lo", "hi"), lambda x: (x["sig"] != F.col("sig")) & possible(F.col("n"), F.col("pos"), x["n"], x["pos"], percent))
    # all pairs of a bucket's smallest and largest class are in the star, so its other classes alone go on, if there may be two
    inner = (F.col("k") > 3) & (F.col("sig") != F.col("lo.sig")) & (F.col("sig") != F.col("hi.sig"))
    met = held.join(extremes, "h").select("h", "sig", "n", "pos", F.transform(partners, lambda x: x["sig"]).alias("to"), inner.alias("inner"))
    met = C.stage(met.where("inner OR size(to) > 0"), "ngram-met")
    C.unstage(held)
    star = met.select("sig", F.explode("to").alias("to")).select(F.least("sig", "to").alias("a"), F.greatest("sig", "to").alias("b")).distinct()
    sided = lambda k: shape.select([F.col(c).alias(k if c == "sig" else f"{k}_{c}") for c in shape.columns])
    star = C.stage(star.join(sided("a"), "a").join(sided("b"), "b").where(near("a_", "b_", percent)).select("a", "b"), "ngram-star")
    links = verify(star, docs, classes, n, percent)
    comp = C.components(links)

    # buckets that still hold two components: members outside the bucket's largest one meet all members of others
    named = met.where("inner").select("h", "sig", "n", "pos").distinct().join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component")
    named = C.stage(named, "ngram-named")
    C.unstage(met, comp)
    split = named.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select("h", "major")
    # a pair is made at its first common n-gram: each row has the earlier ones among its class's first HEADS, and a pair whose lists meet
    # was made before. Pairs that first meet beyond them may come more than once and are made distinct below
    still = C.stage(named.join(split, "h"), "ngram-still")
    C.unstage(named)
    heads = still.groupBy("sig").agg(F.slice(F.array_sort(F.collect_set(F.struct("pos", "h"))), 1, HEADS).alias("heads"))
    before = F.transform(F.filter("heads", lambda x: x["pos"] < F.col("pos")), lambda x: x["h"])
    open_ = C.stage(still.join(heads, "sig").withColumn("before", before).drop("heads").join(shape.drop("n"), "sig"), "ngram-open")
    C.unstage(still, shape)
    l, r = open_.where("c <> major").alias("l"), open_.drop("major").alias("r")
    on = (F.col("l.h") == F.col("r.h")) & (F.col("l.c") != F.col("r.c")) & possible(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"), percent) & near("l.", "r.", percent)
    on &= ((F.col("r.c") == F.col("l.major")) | (F.col("l.sig") < F.col("r.sig"))) & ~F.arrays_overlap("l.before", "r.before")
    cross = l.join(r, on).select(F.least("l.sig", "r.sig").alias("a"), F.greatest("l.sig", "r.sig").alias("b")).distinct()
    # pairs in different components that the star step compared are no links
    cross = C.stage(cross.join(star, ["a", "b"], "left_anti"), "ngram-cross")
    C.unstage(open_, star)
    more = verify(cross, docs, classes, n, percent)

    final = C.components(links.unionByName(more))
    C.unstage(links, more, cross)
    out = C.stage(classes.join(final.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("component", "sig").alias("comp")), "ngram-components")
    C.unstage(final, classes)
    return rows, out


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    rows, classes = linked(docs, n, percent)
    least = classes.groupBy("comp").agg(F.min("rep").alias("component_id")).hint("rebalance")  # so that Spark can split a large component
    out = rows.join(classes.join(least, "comp").select("sig", "component_id"), "sig", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null ids last; of one id with several texts, the one whose row hash is
    smallest), and of rows that equal it in id and text one. Rows without words link with nothing and all stay. Rows are told by a hash of
    id and text; only those that a fixed-size Bloom filter cannot clear are shuffled."""
    key, mark = C.fresh(docs, "_key", "_maybe")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    hashed = docs.withColumn(key, F.xxhash64(doc_id, text))
    rows, classes = linked(hashed.select(doc_id.alias("doc_id"), text.alias("text"), F.col(key).alias("key")), n, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")
    named = rows.where("n > 0").groupBy("sig", "doc_id", "key").agg(F.count("*").alias("k")).join(classes, "sig")
    named = C.stage(named, "ngram-rows-named")
    best = named.groupBy("comp").agg(F.min(rank).alias("best")).hint("rebalance")
    fate = named.join(best, "comp").select(F.col("key").alias(key), (F.col("key") == F.col("best.key")).alias("stays"), "k").where("NOT stays OR k > 1")
    fate = C.stage(fate.groupBy(key).agg(F.max("stays").alias("stays")), "ngram-fate")
    C.unstage(rows, classes, named)
    bits = docs.sparkSession.sparkContext.broadcast(C.bloom(fate, key, 24))
    marked = C.flagged(hashed, key, bits, mark)
    maybe = marked.where(F.col(mark)).drop(mark)
    free = maybe.join(fate, key, "left_anti")
    # of equal rows that stay, one: partial aggregation leaves a row a task
    single = maybe.join(fate.where("stays").select(key), key, "left_semi").dropDuplicates([key])
    names = docs.columns
    return marked.where(~F.col(mark)).select(names).unionByName(free.select(names)).unionByName(single.select(names))


def op3(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(C.documents(spark, sf_dir))
