"""The corpus pipeline against plain versions of its stages, and each stage on awkward tables."""

import re
import zlib

import numpy as np

import corpus_pipeline
from locusgrid.llm import common, decontaminate, ngram_join, packing, pii, toxicity
from tests.llm.test_brute_force import personal

SF = "/root/testdata/sf0.001"


def near(rows):
    """The ids that stay, by comparing all sets."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, x in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    comp = {i: i for i in rows}
    links = [(a, b) for a in rows for b in rows if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i for i in rows if comp[i] == i}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = common.staged()
    out = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(common.staged() - before) == 1  # the result alone
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("toxic").collect()}  # the model has a test of its own
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in bad}
    rows = {i: rows[i] for i in near(rows)}
    norm = lambda x: " ".join("".join(c if c.isalnum() else " " for c in (x or "").lower()).split())
    items = [norm(r.text) for r in bench.collect()]
    rows = {i: x for i, x in rows.items() if not any(t in norm(x) for t in items)}
    tok, want = packing.WordIds(packing.tokenizer_path()).tok, {}
    for i, x in rows.items():
        clean, at = "", 0
        for s, e, k in pii.cover([(a, b, k) for k, a, b in personal(x)]):
            clean, at = clean + x[at:s] + f"[{k.upper()}]", e
        ids = [*tok.encode(clean + (x or "")[at:], add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))
    assert {k: v[:3] for k, v in out.items()} == want
    places = {}
    for _, n, _, seq, off in out.values():
        places.setdefault(seq, []).append((off, n))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1]] and sum(n for _, n in p) <= 4096
    assert len(places) <= 1.02 * sum(v[1] for v in out.values()) / 4096 + 1


def awkward(spark, rows):
    """Null and repeated ids, repeated rows, and columns whose names the stages use inside, in any case."""
    return spark.createDataFrame([(i, x, k, k, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, _KEY int, _maybe int, key int").repartition(3)


def kept(out):
    return sorted((str(r.doc_id), str(r.text)) for r in out.collect())


def test_near_duplicates_stage(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near_a = a.replace("a30 ", "zz ")
    rows = [(3, a), (3, a), (5, near_a), (None, a), (None, b), (None, b), (7, "x y"), (7, "p q r"), (8, None), (8, None), (9, ""), (4, a + " tail")]
    out = ngram_join.keep_one(awkward(spark, rows))
    assert out.columns == ["doc_id", "text", "_KEY", "_maybe", "key"]
    assert kept(out) == sorted([("3", a), ("None", b), ("7", "x y"), ("7", "p q r"), ("8", "None"), ("8", "None"), ("9", "")])
    assert ngram_join.keep_one(awkward(spark, rows).where("false")).count() == 0


def test_decontamination_stage(spark):
    item = "which of the seven bridges did the old ferryman cross before the storm came in from the sea"
    rows = [(None, f"well {item} he said"), (1, item.upper()), (1, "clean text of the same id"), (2, None), (3, "yes"), (3, "yes and no"), (4, "word " * 30000 + item), (None, None)]
    bench = spark.createDataFrame([(0, item), (1, "yes"), (None, "clean text of the same id"), (2, None)], "item_id long, text string")
    out = decontaminate.keep_clean(awkward(spark, rows), bench)
    assert kept(out) == sorted([("1", "clean text of the same id"), ("2", "None"), ("3", "yes and no"), ("None", "None")]) and len(out.columns) == 5
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(awkward(spark, rows), bench).collect()}
    assert found == {(1, 0), (3, 1), (4, 0)}
    assert decontaminate.keep_clean(awkward(spark, rows).where("false"), bench).count() == 0


def test_toxicity_and_packing_stages(spark):
    rows = [(i, "fine words here" if i % 4 else "you awful scum") for i in range(200)] + [(None, "awful scum"), (None, None), (3, "fine words here"), (3, "fine words here")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    out = toxicity.keep_clean(awkward(spark, rows), labels)
    assert kept(out) == sorted([*[(str(i), "fine words here") for i in range(200) if i % 4], ("None", "None"), ("3", "fine words here"), ("3", "fine words here")])
    assert toxicity.keep_clean(awkward(spark, rows).where("false"), labels).count() == 0
    pieces = packing.pack(awkward(spark, rows[-4:])).collect()
    assert len(pieces) == 4 and sorted(r.offset for r in pieces)[0] == 0 and {r.piece for r in pieces} == {0}
