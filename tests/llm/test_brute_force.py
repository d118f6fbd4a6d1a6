"""Operators against plain versions of their definitions, over random texts."""

import hashlib
import math
import random
import re

import pytest

from locusgrid.llm import licenses, pii, registry, secrets
from tests.oracle import check

SF = "/root/testdata/sf0.001"
RND = random.Random(7)


def mixture(pool, n, size):
    return ["".join(RND.choice(pool) for _ in range(RND.randrange(size))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, x, "s", 1, "k") for i, x in enumerate(rows)], "doc_id long, text string, key string, row int, _t string").repartition(3)


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(x):
    """The known shapes by the definition."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, x or "", re.ASCII) if ok(m)]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    check(registry.queries()[name](spark, SF), registry.ORACLE[name], SF)


def test_pii_base(spark):
    pool = [*"0123456789", ".", "+", "-", " ", "@", "(", ")", "a", "Z", "%", "é", "a@b.co", "4111 1111 1111 1111", "10.0.0.1", "+1 (658) 555-4270", "\n"]
    rows = [*mixture(pool, 400, 60), None, ""]

    got = {r.doc_id: r for r in pii.report(table(spark, rows)).collect()}
    for i, x in enumerate(rows):
        base = personal(x)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest(), (x, got[i].spans, base)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert got[i].spans.startswith(joined(base)) and got[i].n_spans == len(base) + got[i].n_id


def test_pii_bootstrapping(spark):
    """The same known set as rounds over plain dictionaries."""
    verbs = ["call", "mail", "ask", "tell", "see"]
    ids = [f"K{i}7Q" for i in range(25)]
    rows = []
    for _ in range(700):
        v = RND.choice(verbs)
        token = f"p{RND.randrange(12)}@x.org" if RND.random() < {"call": 0.95, "mail": 0.8, "ask": 0.3}.get(v, 0.0) else RND.choice(ids[: 8 if v != "see" else 25])
        rows.append(f"now {v} {token} {RND.choice(['at', 'by'])} {RND.choice(verbs)}")
    graph = {}
    for x in rows:
        a, v, t, p, w = x.split()
        for pattern in (("<", a, v), (">", p, w)):
            graph.setdefault(pattern, set()).add(t)
    seeds = {t: 1.0 for ts in graph.values() for t in ts if "@" in t}
    known, good = seeds, {}
    while True:
        weight = {p: sum(known.get(t, 0) for t in ts) / (len(ts) + 0.25) for p, ts in graph.items()}
        now = {p: w for p, w in weight.items() if w >= 0.55 and sum(t in known for t in graph[p]) >= 3}
        found = dict(seeds)
        for p, w in now.items():
            for t in graph[p]:
                found[t] = max(found.get(t, 0), w)
        if (len(now), len(found)) == (len(good), len(known)) and good:
            break
        good, known = now, found
    want = [["@" not in t and (("<", a, v) in good or (">", p, w) in good) for a, v, t, p, w in [x.split()]][0] for x in rows]
    got = {r.doc_id: r.n_id for r in pii.report(table(spark, rows), least_score=0.55, least_chars=4).collect()}
    assert [got[i] for i in range(len(rows))] == [int(x) for x in want] and 0 < sum(want) < len(rows)


def test_secrets_base_and_entropy(spark):
    pool = ["token", "API_KEY", "secret", "passwd", "=", ": ", '"', "'", " ", "AKIA", "ABCD1234", "deadbeef", "0123456789", "x", "é", "\n", "/", "Zk3Qx9Lm", "=="]
    rows = [*mixture(pool, 900, 14), None, "", "deadbeef" * 4, "AKIA" + "ABCD1234" * 2]

    def plain(x):
        kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
        found = [(m.start(), o, k, m.end()) for o, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, x or "", re.ASCII) if ok(m)]
        return [(k, a, b) for a, _, k, b in sorted(found)]

    got = {r.doc_id: r for r in secrets.report(table(spark, rows)).collect()}
    for i, x in enumerate(rows):
        base = plain(x)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest(), (x, got[i].spans, base)
        spans = [s for s in got[i].spans.split(",") if s]
        assert [s for s in spans if not s.startswith("entropy")] == [joined([b]) for b in base]
    assert sum(len(plain(x)) for x in rows) > 50 and secrets.report(table(spark, rows).where("false")).count() == 0
    from pyspark.sql import functions as F

    words = [x for x in mixture(list("aabbcdeXYZ0123456789+/=_-") + ["é"], 60, 70) if x]
    peaks = spark.createDataFrame([(w,) for w in words], "t string").select("t", secrets.peak_entropy(F.col("t"), 20).alias("h")).collect()
    for r in peaks:
        runs = [r.t[k : k + 20] for k in range(max(1, len(r.t) - 19))]
        h = max(-sum(c / len(x) * math.log2(c / len(x)) for c in (x.count(y) for y in set(x))) for x in runs)
        assert r.h == pytest.approx(h)


def test_licenses_base_and_runs(spark):
    pool = [" under ", "the", "mit", " ", "license", "-", "\n", "apache", " version ", "2", "cc", "by", "nc", "MIT", "é", "under the MIT license", "apache license version 2", "x"]
    rows = [*mixture(pool, 250, 16), None, ""]
    for k, v in licenses.TEMPLATES.items():  # a template with words left out or changed, in other text
        words = v.split()
        for drop in (0.05, 0.15, 0.3):
            kept = [w if RND.random() > drop else RND.choice(["foo", "", "Bar,"]) for w in words]
            rows.append("lorem ipsum \n" * RND.randrange(9) + RND.choice([" ", "\n", " // "]).join(kept) + " dolor sit" * RND.randrange(30))
    rows.append(" ".join(RND.choice(" ".join(licenses.TEMPLATES.values()).split()) for _ in range(3000)))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(low))
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    for i, x in enumerate(rows):
        w = split(x)
        at = {k: [j for j in range(len(w)) if w[j : j + len(p.split())] == p.split()] for k, p in licenses.PHRASES.items()}
        every = sorted(j for v in at.values() for j in v)
        base = sorted(k for k, v in at.items() if v)
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == (len(w), len(every), *((every[0], every[-1]) if every else (None, None)), ",".join(base)), x
        labels = set(base)
        for k, v in licenses.TEMPLATES.items():
            t, size = set(split(v)), -(-len(split(v)) * 100 // 80)
            if any(100 * len(t & set(w[j : j + size])) >= 80 * len(t) for j in range(max(1, len(w) - size + 1))):
                labels.add(k.removesuffix("-notice"))
        assert got[i].labels == ",".join(sorted(labels)), x
