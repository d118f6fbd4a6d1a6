"""Benchmark decontamination by templates. DataFrame functions only.

Texts are canonicalised: names (capitalised words, whatever stands before them), numbers and units after numbers become typed slots; the
other words are lower-cased. Each window is hashed twice, with names as slots and with names as lower-cased words, so that copies in other
case or with other white space are found too. Windows of `window` canonical words are hashed, and the windows of documents meet those of benchmark items by an
equi join on the hash. A document and an item that share at least `least` different windows of the item (all, if it has fewer) are a
candidate; then the slots of the matched windows are compared: within a pair, one value of the item must always map to one value of the
document. Equal values are a verbatim copy; consistently different ones a re-parameterised question; others are dropped. A capitalised word at the
start of an item's sentence may be no name: it is held to one value only if the item has it inside a sentence as well.

The benchmark's windows, and the keys of contaminated texts, are broadcast only when their counted number is within BROADCAST_ROWS;
otherwise their joins shuffle. `least` windows bound the recall: an item of a length of `window` words or more is found where that many of its
windows stand whole in the text, twelve successive words with the given figures. Texts are told by a hash, so that equal texts are compared once.

Defined cases: null and empty texts match nothing; an item of fewer than `window` words has one window of the whole item, which documents
match at that length too, its first word by value unless it is a number; items under `short` words count only where they are the whole
document; texts of any length are taken whole; repeated rows of a document or item add nothing; null ids match nothing (in keep_clean they
are judged by their texts like all others); a document of several equally good windows is consistent if one fits; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C
from locusgrid.llm.spans import let

WINDOW, LEAST, SHORT = 8, 5, 4
BROADCAST_ROWS = 200_000  # 24 bytes each
BLOCK = 512  # places of a text that are one row while windows are hashed
#: Units that may follow a number.
UNITS = "kg|g|mg|km|m|cm|mm|mi|miles?|feet|ft|inch(?:es)?|l|ml|litres?|liters?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|pounds?|lbs?|kmh|mph|degrees?"
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"  # marks of a slot's type, before its value
INITIAL = "\u0004"  # in items, a capitalised word at the start of a sentence: a name or not
#: Separators of words but for point and comma; the letters of most texts are told from them by one test.
PLAIN = r"[^a-z\x{C0}-\x{167F}]"
BREAK = r"\x00\x05-\x2B\x2D\x2F\x3A-\x60\x7B-\x7F\x{85}\x{A0}\x{1680}\x{3000}\x{2000}-\x{206F}"


def marked(text: Column, item: bool = False) -> Column:
    """Words of a text, slots with their mark and value. item: INITIAL marks the capitalised words that start a sentence.

    Patterns start with a test of one character, so that most places cost just that, and repeat groups possessively: Java's other
    repeats of groups take a frame of the stack each."""
    plain = F.regexp_replace(text, f"[{NUMBER}-{INITIAL}]", " ")
    if item:
        plain = F.regexp_replace(plain, r"((?:^|[.!?:])[^\p{L}\p{N}]*)(\p{Lu})", f"$1{INITIAL}$2")
    named = F.regexp_replace(plain, f"(?=\\p{{Lu}})(?<![\\p{{L}}\\p{{M}}\\p{{N}}{INITIAL}])(\\p{{Lu}})", NAME + "$1")
    # a number keeps the point and comma inside it: words end at white space and other punctuation, or at these without a digit next
    apart = lambda numbered: F.split(numbered, f"(?:[{PLAIN}&&[{BREAK}]]|[.,](?:(?![0-9])|(?<![0-9][.,])))++")
    numbered = lambda lower: F.regexp_replace(F.regexp_replace(lower, r"(?=[0-9])(?<![\p{L}0-9])([0-9]+(?:[.,][0-9]+)*+)", f" {NUMBER}$1 "), f"({NUMBER}[0-9.,]+ )[\\s\u0085\u00a0\u3000]*[{NAME}{INITIAL}]?({UNITS})(?![\\p{{L}}0-9])", f"$1{UNIT}$2")
    words = let(F.lower(named), lambda lower: F.when(lower.rlike("[0-9]"), apart(numbered(lower))).otherwise(F.split(lower, f"[{PLAIN}&&[{BREAK}.,]]+")))
    # no word is empty or a mark alone; all that starts without a mark starts at 0 or beyond
    return F.filter(words, lambda w: (w >= "0") | (F.octet_length(w) > 1))


def first(w: Column) -> Column:
    return F.substring(w, 1, 1)


def bare(w: Column) -> Column:
    """A word without its mark."""
    return F.when(first(w) <= INITIAL, F.substring(w, 2, 1 << 30)).otherwise(w)


def canonical(words: Column, names: str = NAME + INITIAL) -> Column:
    """Each word's hash; numbers, units and the given marks of names by their type alone."""
    typed = lambda w: F.when(first(w).isin(NUMBER, UNIT), first(w)).when(first(w).isin(*names), F.lit(NAME)) if names else F.when(first(w).isin(NUMBER, UNIT), first(w))
    return F.transform(words, lambda w: F.when(w >= "0", F.xxhash64(w)).otherwise(F.xxhash64(typed(w).otherwise(bare(w)))))


def with_first(hashes: Column, h: Column) -> Column:
    return F.concat(F.array(h), F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))))


def plain_first(words: Column) -> Column:
    """Names as slots, but for the first word."""
    return with_first(canonical(words), canonical(F.slice(words, 1, 1), "")[0])


def window_hash(hashes: Column, i: Column, n: int, heads: Column | None = None) -> Column:
    """The hash of the n successive elements from place i on, and of n. heads: stand for the first of each run."""
    return F.xxhash64(F.lit(n), F.get(hashes if heads is None else heads, i), *[F.get(hashes, i + k) for k in range(1, n)])


def windows(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n successive elements; empty if there are fewer."""
    run = lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: window_hash(h, i, n)))
    return let(hashes, lambda h: F.coalesce(run(h), F.array().cast("array<bigint>")))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, size, at, h, n): the windows of each item, `at` counting from 0, n places in all; size is their length in words. A place
    has several hashes: names as slots or words, words that start a sentence as either, and the item's first word as a slot."""
    b = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), marked(F.col("text").cast("string"), True).alias("w")).where(F.size("w") > 0)
    b = b.withColumn("size", F.least(F.size("w"), F.lit(window)))
    w = F.col("w")
    slot = F.when(first(w[0]) == NUMBER, F.xxhash64(F.lit(NUMBER))).otherwise(F.xxhash64(F.lit(NAME)))
    whole = F.lit(None).cast("array<struct<at:int,h:bigint>>")
    put = lambda hs, n: F.transform(windows(hs, n), lambda h, i: F.struct(i.cast("int").alias("at"), h.alias("h")))
    for n in range(1, window):
        whole = F.when(F.col("size") == n, F.concat(put(canonical(w, ""), n), put(plain_first(w), n))).otherwise(whole)
    long = F.concat(*[put(canonical(w, names), window) for names in (NAME + INITIAL, NAME, "")], put(with_first(F.slice(canonical(w), 1, window), slot), window))
    b = b.select("item_id", "size", F.array_distinct(F.when(F.col("size") == window, long).otherwise(whole)).alias("hs"), (F.size("w") - F.col("size") + 1).alias("n"))
    return b.select("item_id", "size", "n", F.explode("hs").alias("x")).select("item_id", "size", "n", "x.at", "x.h")


def document_windows(docs: DataFrame, sizes: list[int], window: int, short: int) -> DataFrame:
    """(key, at, h) of all windows of the given sizes, with names as slots (in short windows not at the first word) and, where that
    differs, as words; those of under `short` words only if they are the whole text. docs: (key, text).

    Words are hashed in arrays, which Spark interprets; windows are rows of blocks of BLOCK places, which it compiles."""
    part = lambda x, at: F.slice(x, at + 1, BLOCK + window - 1)
    block = lambda c, at: F.struct(F.size(c["a"]).alias("size"), at.cast("int").alias("start"), part(c["a"], at).alias("a"), part(c["b"], at).alias("b"))
    starts = lambda c: F.when(F.size(c["a"]) > 0, F.sequence(F.lit(0), F.size(c["a"]) - 1, F.lit(BLOCK)))
    c = let(marked(F.col("text")), lambda w: F.struct(canonical(w).alias("a"), canonical(w, "").alias("b")))
    blocks = docs.select("key", F.explode(let(c, lambda x: F.transform(starts(x), lambda at: block(x, at)))).alias("x")).select("key", "x.*")
    i, at = F.col("i"), F.col("start") + F.col("i")
    places = blocks.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("size") - F.col("start")) - 1)).alias("i"))
    hashes = []
    for n in sizes:
        fits = (at + n <= F.col("size")) & (F.lit(n >= short) | (F.col("size") == n))
        slots = window_hash(F.col("a"), i, n, None if n == window else F.col("b"))
        hashes += [F.when(fits, slots), F.when(fits, window_hash(F.col("b"), i, n))]
    out = places.select("key", at.alias("at"), *[h.alias(f"h{k}") for k, h in enumerate(hashes)])
    differ = [F.when(F.col(f"h{k}") != F.col(f"h{k - 1}"), F.col(f"h{k}")) if k % 2 else F.col(f"h{k}") for k in range(len(hashes))]
    return out.select("key", "at", F.explode(F.array(*differ)).alias("h")).where("h IS NOT NULL")


def held(docs: DataFrame, benchmark: DataFrame, window: int, least: int, short: int) -> DataFrame:
    """(key, item_id, n_windows, share, n_slots, n_changed, verdict) of each different text of docs (key, text) that holds an item, staged."""


    items = C.stage(item_windows(benchmark, window), "bench-windows")
    n, sizes = items.count(), sorted(r[0] for r in items.select("size").distinct().collect())  # `window` sizes at most
    if not n:
        sizes = [window]
    keys = items.select("h").distinct()
    small = n <= BROADCAST_ROWS
    hits = document_windows(docs, sizes, window, short).join(F.broadcast(keys) if small else keys, "h", "left_semi")
    hits = C.stage(hits.distinct(), "bench-hits")  # equal texts have equal windows
    pairs = hits.join(F.broadcast(items) if small else items, "h")
    per = pairs.groupBy("key", "item_id").agg(F.countDistinct(items["at"]).alias("n_windows"), F.max("n").alias("n")).where(F.col("n_windows") >= F.least(F.lit(least), F.col("n")))
    per = C.stage(per, "bench-pairs")

    # slots: the words of just the candidate documents and items are taken again
    pair_at = C.stage(pairs.select("key", "item_id", "size", hits["at"].alias("i"), items["at"].alias("j")).join(per.select("key", "item_id"), ["key", "item_id"], "left_semi"), "bench-places")
    C.unstage(hits, items)
    part = lambda ws, k: F.slice(ws, k + 1, F.col("size"))
    slot = lambda ws, k: F.transform(part(ws, k), lambda w: F.when(first(w) <= INITIAL, w))
    bw = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), marked(F.col("text").cast("string"), True).alias("bw"))
    inside = lambda w: F.concat(F.lit(NAME), bare(w))
    named = lambda ws: F.transform(ws, lambda w, i: F.when((first(w) == INITIAL) & F.array_contains(ws, inside(w)), inside(w)).when((i == 0) & (first(w) > INITIAL), F.concat(F.lit(INITIAL), w)).otherwise(w))
    bw = bw.select("item_id", let(F.col("bw"), named).alias("bw"))
    slotted = bw.where(F.exists("bw", lambda w: first(w) <= INITIAL))
    open_ = pair_at.join(slotted.select("item_id"), "item_id", "left_semi")
    asked = C.stage(open_.select("key").distinct(), "bench-texts")
    n_asked = asked.count()
    dw = docs.join(F.broadcast(asked) if n_asked <= BROADCAST_ROWS else asked, "key", "left_semi").select("key", marked(F.col("text")).alias("dw")).dropDuplicates(["key"])
    pieces = dw.join(open_, "key").select("key", "item_id", "j", "size", F.transform(part(F.col("dw"), F.col("i")), bare).alias("ds"))
    both = pieces.join(slotted, "item_id").select("key", "item_id", "j", "ds", slot(F.col("bw"), F.col("j")).alias("bs"))
    cells = both.select("key", "item_id", "j", F.posexplode(F.arrays_zip("bs", "ds")).alias("k", "x")).where("x.bs IS NOT NULL").select("key", "item_id", (F.col("j") + F.col("k")).alias("place"), F.col("x.bs").alias("b"), F.col("x.ds").alias("v")).distinct()
    # an item's value maps to one value of the document, and so do its places; a window that stands twice brings several: the pair is
    # consistent if some value fits every place of it
    place = cells.groupBy("key", "item_id", "b", "place").agg(F.collect_set("v").alias("vs"))
    value = place.groupBy("key", "item_id", "b").agg(F.collect_list("vs").alias("all"))
    fits = F.aggregate("all", F.col("all")[0], lambda a, x: F.array_intersect(a, x))
    value = value.select("key", "item_id", ((F.size(fits) > 0) | (first(F.col("b")) == INITIAL)).alias("ok"), F.array_contains(fits, bare(F.col("b"))).alias("same"))
    slots = value.groupBy("key", "item_id").agg(F.count("*").alias("n_slots"), F.count_if(~F.col("same")).alias("n_changed"), F.min("ok").alias("ok"))
    out = per.join(slots, ["key", "item_id"], "left").where("coalesce(ok, true)")
    changed = F.coalesce("n_changed", F.lit(0))
    out = out.select("key", "item_id", "n_windows", (F.col("n_windows") / F.col("n")).alias("share"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), changed.alias("n_changed"), F.when(changed > 0, "template").otherwise("verbatim").alias("verdict"))
    out = C.stage(out, "bench-found")
    C.unstage(per, pair_at, asked)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, short: int = SHORT) -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_slots, n_changed, verdict) of each document that holds an item; verdict: verbatim or template."""
    text = F.col("text").cast("string")
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = held(d.select("key", "text"), benchmark, window, least, short)
    return d.select("doc_id", "key").join(found, "key").drop("key").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, short: int = SHORT) -> DataFrame:
    """docs without those whose text holds a benchmark item, whatever their id."""
    (key,) = C.fresh(docs, "_key")
    text = F.col("text").cast("string")
    found = held(docs.where("text IS NOT NULL").select(F.xxhash64(text).alias("key"), text.alias("text")), benchmark, window, least, short)
    gone = C.stage(found.select(F.col("key").alias(key)).distinct(), "bench-gone")
    C.unstage(found)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.withColumn(key, F.xxhash64(text)).join(gone, key, "left_anti").select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return contaminated(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
