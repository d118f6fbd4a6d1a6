"""Personal data: four known shapes, and identifiers found by bootstrapped context patterns.

The known shapes (seeds) induce patterns: the two words before an entity, and the two after it. Every identifier-like token (`least_chars`
characters or more with a digit, of any length) in the context of a pattern is an instance of it. Spark scores the bipartite graph of
patterns and instances iteratively: a pattern's score is the sum of its known instances' scores over the number of all its instances
plus 1/4; a pattern holds from `least_score` and `least_known` different known instances on; an instance that stands in a pattern that
holds becomes known with that pattern's score (seeds have 1). Newly known instances induce further patterns wherever else they stand. Scores only
rise, so the rounds end by themselves: when one adds neither pattern nor instance. The precision rule is the score itself: a context in
which unknown tokens outnumber `1 - least_score` of all yields nothing. Tokens in a pattern that holds are new spans of the kind `id`.

Counts are of distinct (pattern, instance) pairs over all documents. Defined cases: null and empty texts have no spans and the digest of
the empty string; texts are scanned whole, a word of any length is taken whole; an empty table gives an empty result; repeated rows keep
a row each and count once; tokens on the threshold are taken; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"\S*[0-9]\S*")
EDGE = "\"'()[]{}<>,.;:!?*#$%&"
WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run of its characters before, from the last match's end on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        # without a match the next one starts after this @, which is no local character
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the known shapes, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-20:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str | None, str | None]]:
    """The two words before and the two after each span, lower-cased; None where there are fewer."""
    starts, ends = array("q"), array("q")
    for m in WORD.finditer(text) if spans else ():
        starts.append(m.start())
        ends.append(m.end())
    out = []
    for a, b in spans:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        word = lambda k: text[starts[k] : ends[k]]
        out.append((f"{word(i - 2)} {word(i - 1)} <".lower() if i > 1 else None, f"> {word(j)} {word(j + 1)}".lower() if j + 1 < len(starts) else None))
    return out


def candidates(text: str, base: list[tuple[int, int, int]], least_chars: int) -> list[tuple[int, int]]:
    """Identifier-like tokens apart from the known shapes."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for m in TOKEN.finditer(text) if DIGIT.search(text) else ():
        s = m[0]
        a = m.start() + len(s) - len(s.lstrip(EDGE))
        b = m.end() - (len(s) - len(s.rstrip(EDGE)))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= least_chars and not (k < len(taken) and taken[k][0] < b):
            out.append((a, b))
    return out


def code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two columns that tell rows by id and text, under names that no column has: rows that agree in them are taken as equal."""
    names = C.fresh(docs, "_key", "_more")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select("*", F.xxhash64(doc_id, text).alias(names[0]), F.hash(text, doc_id).alias(names[1])), names


SEEN = "array<struct<start:int,end:int,seed:int,left:long,right:long,instance:long>>"
ROWS = f"doc_id long, key long, more int, base string, n_email long, n_ip long, n_card long, n_phone long, seen {SEEN}"


def first_pass(docs: DataFrame, least_chars: int) -> DataFrame:
    """Base spans of each document (doc_id, key, more, text), and the patterns and instance of each seed and candidate in it."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        base_text, counts, seen = [], [[], [], [], []], []
        for x in b.column("text").to_pylist():
            x = x or ""
            base = base_spans(x)
            base_text.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base))
            for k in range(4):
                counts[k].append(sum(s[0] == k for s in base))
            found = [(s, e, 1) for _, s, e in base] + [(s, e, 0) for s, e in candidates(x, base, least_chars)]
            around = contexts(x, [(s, e) for s, e, _ in found])
            seen.append([{"start": s, "end": e, "seed": z, "left": p and code(p), "right": q and code(q), "instance": code(x[s:e])} for (s, e, z), (p, q) in zip(found, around, strict=True) if p or q])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("instance", pa.int64())]))
        cols = [*(b.column(c) for c in ("doc_id", "key", "more")), pa.array(base_text, pa.string()), *[pa.array(c, pa.int64()) for c in counts], pa.array(seen, kind)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "more", "base", "n_email", "n_ip", "n_card", "n_phone", "seen"])

    return docs.mapInArrow(C.by_batch(run), ROWS)


def bootstrap(graph: DataFrame, least_known: int = 3, least_score: float = 0.7) -> DataFrame:
    """(pattern, weight) of the patterns that hold at the end, a staged table. graph: distinct (pattern, instance, seed), staged."""
    size = C.stage(graph.groupBy("pattern").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-size")
    seeds = graph.where("seed = 1").select("instance", F.lit(1.0).alias("score")).distinct()
    known, had = seeds, (0, 0)
    good = None
    while True:
        score = graph.join(known, "instance").groupBy("pattern").agg(F.sum("score").alias("s"), F.count("*").alias("k")).join(size, "pattern")
        more = C.stage(score.select("pattern", "k", (F.col("s") / (F.col("n") + F.lit(0.25))).alias("weight")).where((F.col("weight") >= least_score) & (F.col("k") >= least_known)), "pii-patterns")
        C.unstage(*[x for x in (good, known) if x is not None])
        good = more
        found = graph.join(good, "pattern").select("instance", F.col("weight").alias("score"))
        known = C.stage(seeds.unionByName(found).groupBy("instance").agg(F.max("score").alias("score")), "pii-known")
        have = (good.count(), known.count())
        if have == had:
            C.unstage(known, size)
            return good.select("pattern", "weight")
        had = have


def find(docs: DataFrame, least_chars: int = 5, **kw) -> tuple[DataFrame, DataFrame]:
    """Staged tables: (doc_id, key, more, counts, base) of each row of docs (doc_id, key, more, text), base being its spans as text, and
    (key, more, found): array<struct<start, end>> of the new identifiers of each different row that has some."""
    one = C.stage(first_pass(docs, least_chars), "pii-rows")
    seen = one.select("key", "more", F.explode("seen").alias("x")).select("key", "more", "x.*")
    both = F.explode(F.filter(F.array("left", "right"), lambda p: p.isNotNull())).alias("pattern")
    graph = C.stage(seen.select(both, "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    good = bootstrap(graph, **kw)
    new = seen.where("seed = 0").select("key", "more", "start", "end", both).join(good.select("pattern"), "pattern", "left_semi")
    new = C.stage(new.groupBy("key", "more").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found")), "pii-found")
    C.unstage(graph, good)
    return one, new


def as_text(found: str):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.lit("id"), s["start"].cast("string"), s["end"].cast("string"))), ",")


def joined(one: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with `spans`, all their spans as text."""
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("found") > 0, as_text("found")))
    return one.drop("seen").join(new, ["key", "more"], "left").withColumn("spans", spans)


def named(docs: DataFrame) -> DataFrame:
    full, (key, more) = keyed(docs.select("doc_id", "text"))
    return full.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), F.col(more).alias("more"), F.col("text").cast("string").alias("text"))


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, counts by kind, digest of the known shapes, all spans as text and their number."""
    df = joined(*find(named(docs), **kw))
    n_id = F.greatest(F.coalesce(F.size("found"), F.lit(0)), F.lit(0)).cast("long")
    total = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + n_id
    return df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", n_id.alias("n_id"), total.alias("n_spans"), F.sha2("base", 256).alias("base_sha256"), "spans")


def cover(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans as one, of the kind of the longest (the first by kind among equals)."""
    order = (*KINDS, "id")
    out: list[tuple[int, int, str, int]] = []
    for s, e, k in sorted(spans, key=lambda x: (x[0], x[1], order.index(x[2]))):
        if out and s < out[-1][1]:
            a, z, kind, size = out[-1]
            better = e - s > size or (e - s == size and order.index(k) < order.index(kind))
            out[-1] = (a, max(z, e), k if better else kind, max(size, e - s))
        else:
            out.append((s, e, k, e - s))
    return [x[:3] for x in out]


def redact(docs: DataFrame, **kw) -> DataFrame:
    """docs with each span, overlapping ones as one, replaced by its kind in brackets; n_chars follows if there is such a column. Spans meet
    the texts again by hashes of id and text, and only documents with spans move: rows with a null id and rows that repeat an id with
    another text each get the spans of their own text. Rows equal in both share their spans, which follow from the text alone."""
    from pyspark.sql import types as T

    full, (key, more) = keyed(docs)
    mark, spans = C.fresh(docs, "_maybe", "_spans")
    one, new = find(named(docs), **kw)
    marks = joined(one, new).where("spans <> ''").groupBy(F.col("key").alias(key), F.col("more").alias(more)).agg(F.max("spans").alias(spans))
    marks = C.stage(marks, "pii-marks")
    C.unstage(one, new)
    bits = docs.sparkSession.sparkContext.broadcast(C.bloom(marks, key, 24))
    names, schema = docs.columns, docs.schema

    def run(t: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for x, marked in zip(t.column("text").to_pylist(), t.column(spans).to_pylist(), strict=True):
            if x is None or not marked:
                texts.append(x)
                continue
            parts, at = [], 0
            for s, e, k in cover([(int(s), int(e), k) for k, s, e in (p.split(":") for p in marked.split(","))]):
                parts += [x[at:s], f"[{k.upper()}]"]
                at = e
            texts.append("".join(parts) + x[at:])
        cols = [pa.array(texts, pa.string()) if n == "text" else t.column(n) for n in names]
        return pa.RecordBatch.from_arrays(cols, names=names)

    split = C.flagged(full, key, bits, mark)
    # a shuffled join keeps the two Python steps in stages of their own: in one, each task would hold two workers
    touched = split.where(F.col(mark)).join(marks.hint("merge"), [key, more], "left").select(*names, spans).mapInArrow(C.by_batch(run), T.StructType(schema.fields))
    out = split.where(~F.col(mark)).select(*names).unionByName(touched)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op1(spark, sf_dir: str) -> DataFrame:
    return report(C.documents(spark, sf_dir))
