"""License scan: phrases, and a set-similarity join of text blocks with license templates. DataFrame functions only.

A template of L words matches a text where a run of at most L * 100 / percent successive words, whatever line breaks stand in it, holds at
least `percent` of its distinct words. Blocks are runs of twice the longest such length at steps of it, so that each run lies in a block.
Words are put in one global order, rare first by the number of documents that hold them (counted over all documents, for the templates'
words, a set of fixed size). Of a template of size n that needs k words, a matching block must hold one of its n - k + 1 rarest, its
prefix. The join on prefix words, a length filter (the block holds k of the template's words) and a positional filter (enough words of
the template remain from the first one shared on) leave few pairs, whose runs are compared in full.

Two passes: one counts words, the other takes the blocks that hold a prefix word of any template to the join.

Defined cases: null and empty texts have no words, places or labels and score 0; an empty table gives an empty result; texts of any length
are taken whole; a run at the threshold matches; repeated rows keep a row each and all count; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C
from locusgrid.llm.spans import let

SEP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{SEP}]+"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Openings of widely used license texts, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "under the GNU General Public License",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def phrase_pattern(phrase: str) -> str:
    """The phrase's words in a row, whatever separates them, as whole words; A-Z in either case."""
    return f"(?i)(?<![^{SEP}])" + f"[{SEP}]+".join(phrase.split()) + f"(?![^{SEP}])"


WORD_OF = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(re.findall(WORD_OF, v.lower()))) for k, v in templates.items()}


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words_of(text: Column) -> Column:
    """A text's words, A-Z in lower case. No other letter becomes an ASCII one but the Kelvin sign, which is put aside first."""
    return F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), f"[{SEP}]+")


def best_run(block: Column, words: Column, length: Column) -> Column:
    """The most different ones of `words` that some `length` successive words of a block hold."""
    at = F.filter(F.transform(block, lambda x, i: F.when(F.array_contains(words, x), F.struct(i.alias("i"), x.alias("w")))), lambda x: x.isNotNull())
    inside = lambda e, s: F.filter(e, lambda x: (x["i"] >= s["i"]) & (x["i"] < s["i"] + length))
    return let(at, lambda e: F.array_max(F.transform(e, lambda s: F.size(F.array_distinct(F.transform(inside(e, s), lambda x: x["w"]))))))


def place_of(size: int):
    """Of a text split at a phrase of `size` words: how often it stands there, and the first and last word number."""
    last = lambda parts: n_words(F.col("t")) - n_words(F.element_at(parts, -1)) - size
    return lambda parts: F.struct((F.size(parts) - 1).cast("long").alias("n"), n_words(parts[0]).alias("first"), last(parts).cast("long").alias("last"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = templates or TEMPLATES
    sets = template_words(templates)
    vocabulary = sorted({w for s in sets.values() for w in s})
    need = {k: (len(s) * percent + 99) // 100 for k, s in sets.items()}
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"), F.monotonically_increasing_id().alias("row"))
    places = []
    for label, phrase in PHRASES.items():
        pattern, size = phrase_pattern(phrase), len(phrase.split())
        hit = F.when(F.col("t").rlike(pattern), let(F.split("t", pattern, -1), place_of(size)))
        places.append(F.struct(F.lit(label).alias("label"), hit.alias("p")))
    df = df.select("doc_id", "row", "t", n_words(F.col("t")).alias("n_words"), F.filter(F.array(*places), lambda x: x["p"].isNotNull()).alias("base"))
    known = F.array(*[F.lit(w) for w in vocabulary])

    # the templates in the global order: rows in proportion to the template list, whatever the corpus
    spark = docs.sparkSession
    counts = docs.select(F.explode(F.array_intersect(words_of(t), known)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    found = {r["w"]: r["df"] for r in counts.collect()}  # the templates' words at most
    ordered = {k: sorted(s, key=lambda w: (found.get(w, 0), w)) for k, s in sets.items()}
    long = {k: (len(re.findall(WORD_OF, v)) * 100 + percent - 1) // percent for k, v in templates.items()}
    prefix = [(k, w, i, len(ws), need[k], long[k], ws) for k, ws in ordered.items() for i, w in enumerate(ws[: len(ws) - need[k] + 1])]
    prefix_table = spark.createDataFrame(prefix, "label string, w string, i int, size int, need int, long int, ws array<string>")
    rare = F.array(*[F.lit(w) for w in sorted({p[1] for p in prefix})])

    step = max(long.values())
    runs = lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / step).cast("int")), lambda k: F.slice(ws, k * step + 1, F.lit(2 * step)))
    blocks = let(words_of(F.col("t")), lambda ws: F.when(F.arrays_overlap(ws, rare), F.filter(runs(ws), lambda b: F.arrays_overlap(b, rare))))
    one = C.stage(df.select("doc_id", "row", "n_words", "base", blocks.alias("blocks")), "license-rows")
    cut = one.where("blocks IS NOT NULL").select("row", F.explode("blocks").alias("b"))
    pairs = cut.select("row", "b", F.explode(F.array_intersect("b", rare)).alias("w")).join(F.broadcast(prefix_table), "w")  # a row a prefix word of the fixed templates
    # a pair is taken up at its first shared prefix word
    first = F.array_position("ws", F.array_intersect("ws", "b")[0]) - 1 == F.col("i")
    pairs = pairs.where(first & (F.size(F.array_intersect("b", "ws")) >= F.col("need")) & (F.col("size") - F.col("i") >= F.col("need")))
    score = best_run(F.col("b"), F.col("ws"), F.col("long")) / F.col("size")
    hits = pairs.withColumn("score", score).where(F.col("score") * 100 >= percent).groupBy("row").agg(F.collect_set(F.regexp_replace("label", "-notice$", "")).alias("more"), F.max("score").alias("score"))

    out = one.select("doc_id", "row", "n_words", "base").join(hits, "row", "left")
    base = F.transform("base", lambda x: x["label"])
    total = F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + x["p"]["n"])
    n_labels = F.size(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>"))))).cast("long")
    return out.select(
        "doc_id", "n_words", total.alias("n_base"), F.array_min(F.transform("base", lambda x: x["p"]["first"])).alias("first_word"), F.array_max(F.transform("base", lambda x: x["p"]["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), n_labels.alias("n_labels"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir))
