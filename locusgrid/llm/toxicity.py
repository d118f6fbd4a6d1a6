"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse word features.

Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. P(grade > k) = sigmoid(w.x - b_k), one weight vector for
all thresholds b_0 < b_1. Features are hashed words (A-Z in lower case, split at white space and ASCII punctuation) and their beginnings, present in a text;
a feature enters if its presence goes with the grade, by a z-score and a share over the sample, and if it reaches documents that
features before it do not. The model is fitted on at most `sample` labelled
documents, the first by a hash of their id, on the driver; the flag's cut on the expected severity is the one of best F1 on a held-out
part of them. Scoring reads every whole text.

Defined cases: null and empty texts have no features and are scored by the thresholds alone; repeated rows keep a row each; null ids
pass like all others; without labels of both kinds, or with an empty table, nothing is flagged; a document with several labels counts as the
worst of them; severities at the cut are flagged; very long texts are scored whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C

SAMPLE = 20_000  # labelled documents that the fit may use
LEAST_DOCS, LEAST_SHARE = 5, 0.85  # toxic documents that have a feature, and their share of those that have it
STEMS = (4, 5, 6, 7, 8)  # bytes
SPLIT = C.separators((0, 47), (58, 64), (91, 96), (123, 127))


@dataclass
class Ordinal:
    """A fitted model: sorted feature hashes, their weights, thresholds and the flag's cut."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([3.0, 6.0]))
    cut: float = np.inf

    def severity(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(score[:, None] - self.thresholds[None]).sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def text_features(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, text number) of a run of texts: its words and their beginnings of the lengths in STEMS. In text order."""
    h, start, first = C.words(offs, data, SPLIT)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    if not len(h):
        return h, doc
    c = C.prefix_hash(data, C.LOWER_BYTE)
    inside = np.concatenate((~SPLIT[data], [False]))
    limit = offs[np.searchsorted(offs, start, "right")]  # words end with their text
    hashes, docs = [h], [doc]
    for k in STEMS:
        end = start + k
        ok = (end < limit) & inside[np.minimum(end, len(data))]  # the word goes on after k bytes
        for j in range(1, k):
            ok &= inside[np.minimum(start + j, len(data))]
        stem = C.span_hash(c, start[ok], end[ok]) ^ np.uint64(k)
        hashes.append(stem)
        docs.append(doc[ok])
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return h[order], doc[order]


def cover(x_doc: np.ndarray, col: np.ndarray, pure: np.ndarray, positive: np.ndarray, least: int) -> np.ndarray:
    """Of the pure features, those that in turn reach most positive documents that none before has, at least `least` each; then twice more
    over all of them, now at least a fiftieth of the positive documents. This keeps few of many features that say the same, so that
    weights are not spread over chance words, and still several for texts that have just one of them."""
    place = np.full(int(col.max(initial=-1)) + 1, -1)
    place[pure] = np.arange(len(pure))
    sel = (place[col] >= 0) & positive[x_doc]
    doc, f = x_doc[sel], place[col[sel]]
    order = np.argsort(f, kind="stable")
    by = np.split(doc[order], np.cumsum(np.bincount(f, minlength=len(pure)))[:-1])
    out: list[int] = []
    for layer in range(3):
        open_ = positive.copy()
        floor = least if layer == 0 else max(least, positive.sum() / 50)
        while len(pure):
            gain = np.bincount(f, open_[doc], len(pure))
            gain[out] = 0
            best = int(gain.argmax())
            if gain[best] < floor:
                break
            out.append(best)
            open_[by[best]] = False
    return pure[np.array(sorted(out), np.int64)]


def fit(x_doc: np.ndarray, x_word: np.ndarray, grades: np.ndarray, n_grades: int = 3, held: np.ndarray | None = None, least_z: float = 5.0, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, steps: int = 400, l2: float = 1e-3) -> Ordinal:
    """x_doc, x_word: which document has which word (once). The documents marked in held are kept out of the fit, for the cut."""
    model = Ordinal()
    n = len(grades)
    bad = grades > 0
    if n < 10 or not bad.any() or bad.all():
        return model
    held = np.zeros(n, bool) if held is None else held
    train = ~held
    words, col = np.unique(x_word, return_inverse=True)
    use = train[x_doc]
    seen = np.bincount(col[use], minlength=len(words))
    hit = np.bincount(col[use], bad[x_doc[use]], minlength=len(words))
    p = bad[train].mean()
    z = (hit - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p), 1e-9))
    pure = np.flatnonzero((z >= least_z) & (seen >= least_docs) & (hit >= least_share * seen))
    keep = cover(x_doc, col, pure, train & bad, least_docs)
    if not len(keep):
        return model
    place = np.full(len(words), -1)
    place[keep] = np.arange(len(keep))
    sel = place[col] >= 0
    d, f = x_doc[sel], place[col[sel]]
    w, b = np.zeros(len(keep)), np.linspace(1.0, 2.0, n_grades - 1)
    above = grades[:, None] > np.arange(n_grades - 1)[None]
    rate = np.clip(above[train].mean(0), 1e-3, 1 - 1e-3)
    b = np.log((1 - rate) / rate)
    gw, gb = np.full(len(keep), 1e-8), np.full(n_grades - 1, 1e-8)
    tr = train[d]
    for _ in range(steps):  # Adagrad on the sum of the binary losses that share w
        s = np.bincount(d, w[f], n)
        err = (sigmoid(s[:, None] - b[None]) - above) * train[:, None]
        each = err.sum(1)
        dw = np.bincount(f[tr], each[d[tr]], len(keep)) / train.sum() + l2 * w
        db = -err.sum(0) / train.sum()
        gw += dw * dw
        gb += db * db
        w -= 0.5 * dw / np.sqrt(gw)
        b = np.maximum.accumulate(b - 0.2 * db / np.sqrt(gb))
    model = Ordinal(words[keep], w, b)
    sev = model.severity(np.bincount(d, w[f], n))
    values = np.unique(sev)
    if len(values) > 1:
        cuts = (values[1:] + values[:-1]) / 2
        f1 = []
        for c in cuts:
            tp, fp, fn = (np.sum(x) for x in ((sev >= c) & bad & held, (sev >= c) & ~bad & held, (sev < c) & bad & held))
            f1.append(2 * tp / max(2 * tp + fp + fn, 1))
        model.cut = float(cuts[int(np.argmax(f1))])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model of a bounded sample: at most `sample` labelled documents. A third of them, by a hash of their ids, is held out. Spark counts
    each feature exactly over the rest; only the features that can pass come to the driver, with the grades of the documents that have them."""
    spark = docs.sparkSession
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    grade = F.when(toxic & (F.coalesce(F.col("quality"), F.lit(1)) == 0), 2).when(toxic, 1).otherwise(0)
    some = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(grade).alias("grade"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)
    some = C.stage(some, "tox-sample")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")  # `sample` rows at most

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, offs, data in C.string_slices(b.column("text")):
            h, doc = text_features(offs, data)
            cut = np.searchsorted(doc, np.arange(len(offs)))
            sets = [np.unique(h[cut[i] : cut[i + 1]]).view(np.int64) for i in range(len(offs) - 1)]
            words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(sets)) for c in ("grade", "held")), words], names=["grade", "held", "words"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from run(b)

    kept = C.stage(text.select("grade", "held", "text").mapInArrow(flat, "grade int, held boolean, words array<bigint>"), "tox-words")
    fitted = kept.where("NOT held")
    hits = fitted.where("grade > 0").select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("hit")).where(F.col("hit") >= LEAST_DOCS)
    hits = C.stage(hits, "tox-hits")
    known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hits.select("w").collect()], np.int64)))  # bounded by the sample's features

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of a task have each of the features that enough toxic ones have."""
        w = known.value
        n = np.zeros(len(w) + 1, np.int64)
        for b in batches:
            n += np.bincount(member(w, b.column(0).flatten().to_numpy()), minlength=len(w) + 1)
        some = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(w[some]), pa.array(n[some])], names=["w", "n"])

    counts = fitted.select("words").mapInArrow(seen, "w long, n long").groupBy("w").agg(F.sum("n").alias("seen"))
    passing = counts.join(hits, "w").where(F.col("hit") >= F.lit(LEAST_SHARE) * F.col("seen")).select("w")
    pure = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in passing.collect()], np.int64)))

    def thin(b: pa.RecordBatch) -> pa.RecordBatch:
        blobs = []
        for x in b.column("words"):
            v = x.values.to_numpy()
            blobs.append(v[member(pure.value, v) < len(pure.value)].tobytes())
        return pa.RecordBatch.from_arrays([b.column("grade"), b.column("held"), pa.array(blobs, pa.binary())], names=["grade", "held", "words"])

    got = kept.mapInArrow(C.by_batch(thin), "grade int, held boolean, words binary").collect()  # `sample` rows at most
    C.unstage(some, kept, hits)
    known.destroy()
    pure.destroy()
    if not got:
        return Ordinal()
    got = sorted((bytes(r[2]), r[0], r[1]) for r in got)  # the same model however the rows arrive
    sets = [np.frombuffer(w, np.uint64) for w, _, _ in got]
    return fit(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), np.array([g for _, g, _ in got]), held=np.array([h for _, _, h in got]))


def member(sorted_words: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The place of each of v in a sorted array; the array's length for those that are not in it."""
    if not len(sorted_words):
        return np.zeros(len(v), np.int64)
    at = np.minimum(np.searchsorted(sorted_words, v), len(sorted_words) - 1)
    return np.where(sorted_words[at] == v, at, len(sorted_words))


def scores(model: Ordinal, col: pa.Array) -> np.ndarray:
    """Expected severity of each text of a column."""
    out = [np.zeros(0)]
    for _, offs, data in C.string_slices(col):
        n = len(offs) - 1
        h, doc = text_features(offs, data)
        total = np.zeros(n)
        if len(model.features):
            k = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
            ok = model.features[k] == h
            pair = np.unique(doc[ok] * len(model.features) + k[ok])
            total = np.bincount(pair // len(model.features), model.weights[pair % len(model.features)], n)
        out.append(model.severity(total))
    return np.concatenate(out)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sev = scores(shared.value, b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sev), pa.array(np.rint(sev).astype(np.int32)), pa.array(sev >= shared.value.cut)], names=["doc_id", "expected_severity", "grade", "toxic"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(C.by_batch(run), "doc_id long, expected_severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are flagged, in the pass that scores them."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(scores(shared.value, b.column(at).cast(pa.string())) < shared.value.cut))

    return docs.mapInArrow(C.by_batch(run), docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
