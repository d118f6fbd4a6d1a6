"""Secret scan: three known shapes, and strings whose sliding-window entropy is too high for text. DataFrame functions only.

A candidate is a run of key characters. Its class follows from the kinds of characters in it: hex (only hexadecimal digits, a digit and a
letter of one case or both), mixed (digits, upper and lower case), lower (digits and lower case), upper (digits and upper case), letters
(upper and lower case), one_case (letters of one case), digits; a candidate of symbols alone is of class symbols. Symbols may stand in any
but hex. Each class has its own threshold. A window of `window` characters slides over it; counts per character and the sum of
c log2 c are updated by the character that enters and the one that leaves, and the highest entropy decides against the class's
threshold. Candidates of the allow list, and those that touch a known shape, are left out.

Defined cases: null and empty texts have no spans and the digest of the empty string; any length is scanned whole; other columns stay out
of the result; repeated rows keep a row each; an empty table gives an empty result; a window at the class's threshold is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusgrid.llm import common as C
from locusgrid.llm.spans import let, places, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same spans for texts that can hold one at all: a quick test before the exact pattern.
HEX_LONG, ACCESS_LONG = r"[0-9a-f]{32,}", r"AKIA[A-Z0-9]{12,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/=_-"
#: Strings that are no secrets though their entropy is high.
ALLOW = [r"(?i)example|sample|placeholder|dummy|changeme", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^(.)\1+$", r"^[A-Za-z]+([-_/][A-Za-z]+)+$"]
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}


BITS_EACH, PER_LONG = 6, 10  # counters of the window's characters, ten to a long
LONGS = -(-(len(ALPHABET) + 1) // PER_LONG)


def peak_entropy(text: Column, window: int = 20) -> Column:
    """The highest Shannon entropy, in bits, of any `window` successive characters (63 at most); the whole string's if it is shorter. A step
    adds one to the counter of the character that enters and takes one from that of the one that leaves."""
    if not 1 <= window < 1 << BITS_EACH:
        raise ValueError("window must lie between 1 and 63")
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    place = lambda code: ((code % PER_LONG) * BITS_EACH).cast("int")
    number = lambda code: F.floor(code / PER_LONG).cast("int")

    def count(acc: Column, code: Column) -> Column:
        held = acc["n0"]
        for k in range(1, LONGS):
            held = F.when(number(code) == k, acc[f"n{k}"]).otherwise(held)
        return F.call_function("shiftright", held, place(code)).bitwiseAND(F.lit((1 << BITS_EACH) - 1)).cast("int")

    def walk(letters: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enter = letters[i]
            leave = F.when(i >= window, letters[F.greatest(i - window, F.lit(0))]).otherwise(enter)
            return let(F.struct(enter.alias("in"), leave.alias("out"), count(acc, enter).alias("c_in"), count(acc, leave).alias("c_out")), lambda x: moved(acc, x, i))

        def moved(acc: Column, x: Column, i: Column) -> Column:
            one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), place(code))
            full = i >= window
            gain = table[x["c_in"] + 1] - table[x["c_in"]]
            loss = F.when(full, table[x["c_out"]] - table[F.greatest(x["c_out"] - 1, F.lit(0))]).otherwise(F.lit(0.0))
            s = F.when(full & (x["in"] == x["out"]), acc["s"]).otherwise(acc["s"] + gain - loss)
            nil = F.lit(0).cast("long")
            n = [(acc[f"n{k}"] + F.when(number(x["in"]) == k, one(x["in"])).otherwise(nil) - F.when(full & (number(x["out"]) == k), one(x["out"])).otherwise(nil)).alias(f"n{k}") for k in range(LONGS)]
            return let(s, lambda t: F.struct(*n, t.alias("s"), F.when(i >= window - 1, F.least(acc["low"], t)).otherwise(acc["low"]).alias("low")))

        start = F.struct(*[F.lit(0).cast("long").alias(f"n{k}") for k in range(LONGS)], F.lit(0.0).alias("s"), F.lit(1e18).alias("low"))
        end = F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step)
        size = F.least(F.size(letters), F.lit(window)).cast("double")
        return let(end, lambda e: F.log2(size) - F.when(F.size(letters) >= window, e["low"]).otherwise(e["s"]) / size)

    codes = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    return F.when(F.length(text) > 0, let(codes, walk)).otherwise(F.lit(0.0))


def entropy_class(text: Column) -> Column:
    digit, upper, lower = text.rlike("[0-9]"), text.rlike("[A-Z]"), text.rlike("[a-z]")
    kind = F.when(text.rlike("^[0-9a-fA-F]+$") & digit & (upper | lower), "hex").when(digit & upper & lower, "mixed").when(digit & lower, "lower").when(digit & upper, "upper")
    return kind.when(upper & lower, "letters").when(upper | lower, "one_case").when(digit, "digits").otherwise("symbols")


#: Bits that the best window must have, by class. For random keys of 32 characters the median is 4.02 (lower), 3.92 (upper,
#: base32), 4.12 (letters), 3.78 (one_case), 3.11 (digits), by 3,000 draws each.
BITS = {"lower": 3.6, "upper": 3.4, "letters": 3.9, "one_case": 3.7, "digits": 3.0, "symbols": 2.1}
#: Words and short numbers joined to a path, allowed in the classes of BITS.
PATH = r"^([A-Za-z]+|[0-9]{1,4})([-_/]+([A-Za-z]+|[0-9]{1,4}))+$"


def scan(docs: DataFrame, window: int = 20, hex_bits: float = 3.0, mixed_bits: float = 3.8, bits_of: dict[str, float] | None = None) -> DataFrame:
    """doc_id, base (spans of known shapes) and found (spans by entropy): arrays of (start, order, kind, end)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def spans(kind: str, found: Column, good=None) -> Column:
        found = F.filter(found, good) if good else found
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER[kind]).alias("o"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    value = lambda s: F.length(F.regexp_replace(s["hit"], ASSIGN_HEAD, "")) >= 8
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    base = F.array_sort(F.concat(spans("assign", places(F.col("t"), ASSIGN), value), spans("access", places(F.col("t"), ACCESS_LONG)), spans("hex", places(F.col("t"), HEX_LONG))))

    def suspicious(s: Column) -> Column:
        kind = entropy_class(s["hit"])
        allowed = F.lit(False)
        for a in ALLOW:
            allowed = allowed | s["hit"].rlike(a)
        allowed = allowed | (~kind.isin("hex", "mixed") & s["hit"].rlike(PATH))
        bits = F.when(allowed, F.lit(-1.0)).otherwise(peak_entropy(s["hit"], window))
        least = F.lit(None).cast("double")
        for k, v in ({"hex": hex_bits, "mixed": mixed_bits} | BITS | (bits_of or {})).items():
            least = F.when(kind == k, F.lit(v)).otherwise(least)
        return bits >= least

    apart = lambda b: lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
    candidates = places(F.col("t"), CANDIDATE)
    df = df.select("doc_id", "t", base.alias("base"))
    return df.select("doc_id", "base", spans("entropy", let(F.col("base"), lambda b: F.filter(candidates, lambda s: suspicious(s) & apart(b)(s)))).alias("found"))


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, counts by kind, digest of the known shapes, and all spans as text."""
    df = scan(docs, **kw)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    both = F.array_sort(F.concat("base", "found"))
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.size("found").cast("long").alias("n_entropy"), F.size(both).cast("long").alias("n_spans"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(both).alias("spans"))


def op5(spark, sf_dir: str) -> DataFrame:
    return report(C.documents(spark, sf_dir))
