"""Column expressions shared by the operators.

Missing values are NULL everywhere: NaN is turned into NULL at ingest, division by
zero gives NULL, and row statistics say whether they skip NULL or are poisoned by it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """NULL for NaN."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0 or either is NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def to_number(c: Column, kind: str = "double") -> Column:
    """Text to a number; NULL for malformed text."""
    return c.try_cast(kind)


def count_where(conds: list[Column]) -> Column:
    """How many of the conditions hold; a NULL condition counts as false."""
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conds], F.lit(0))


def row_count(cols: list[Column]) -> Column:
    return count_where([c.isNotNull() for c in cols])


def row_sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols], F.lit(0.0))


def row_mean(cols: list[Column], na_rm: bool = True) -> Column:
    """Mean over the columns of one row; with na_rm False any NULL gives NULL."""
    mean = ratio(row_sum(cols), row_count(cols))
    return mean if na_rm else F.when(row_count(cols) == len(cols), mean)


def row_var(cols: list[Column], na_rm: bool = True) -> Column:
    """Sample variance over the columns of one row (NULL under two values)."""
    mean, n = row_mean(cols, True), row_count(cols)
    dev = reduce(lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols], F.lit(0.0))
    need = F.lit(2) if na_rm else F.lit(len(cols))
    return F.when((n >= need) & (n >= 2), ratio(dev, n - 1))


def row_sd(cols: list[Column], na_rm: bool = False) -> Column:
    return F.sqrt(row_var(cols, na_rm))


def add_chr(c: Column) -> Column:
    """`1` to `chr1`; names that have the prefix stay."""
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def strip_chr(c: Column) -> Column:
    return F.regexp_replace(c, "^chr", "")


def seq_style(c: Column, style: str) -> Column:
    """Chromosome names in UCSC (`chr1`) or NCBI (`1`) style."""
    if style.upper() not in ("UCSC", "NCBI"):
        raise ValueError("style must be UCSC or NCBI")
    return add_chr(c) if style.upper() == "UCSC" else strip_chr(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def sums_before(a: Column, block: int = 256) -> Column:
    """Sums of the elements before each place of an integer array. Blocks keep the work linear up to millions of elements."""
    zero = F.lit(0).cast("long")
    total = lambda part: F.aggregate(part, zero, lambda x, y: x + y)

    def body(arr: Column) -> Column:
        last = F.floor((F.size(arr) - 1) / block).cast("int")
        each = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(arr, b * block + 1, F.lit(block))))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        heads = F.aggregate(each, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]
        inside = lambda i: total(F.slice(arr, F.floor(i / block).cast("int") * block + 1, F.pmod(i, F.lit(block))))
        place = lambda h: F.transform(arr, lambda _, i: F.element_at(h, F.floor(i / block).cast("int") + 1) + inside(i))
        return F.when(F.size(arr) == 0, F.array().cast("array<bigint>")).otherwise(let(heads, place))

    return let(F.transform(a, lambda x: x.cast("long")), body)


def quantile(c: Column, p: float | list[float], error: float | None = None) -> Column:
    """Type 7 quantiles, which keep a count of every distinct value of a group; with `error`, the value of a rank that is off by at most
    that share of the group's values, from a sketch of bounded size that merges across tasks."""
    at = F.array(*[F.lit(x) for x in p]) if isinstance(p, list) else F.lit(p)
    if error is None:
        return F.percentile(c, at)
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return F.percentile_approx(c.cast("double"), at, int(1 / error) + 1)


def make_names(names: list[str]) -> list[str]:
    """Valid, unique names: other characters than letters, digits, dots and underscores become dots, a name that starts like a number or is
    empty gets an X, repeats get .1, .2 and so on."""
    out: list[str] = []
    for n in names:
        base = "".join(c if c.isalnum() or c in "._" else "." for c in n)
        if not base or not (base[0].isalpha() or (base[0] == "." and not base[1:2].isdigit())):
            base = f"X{base}"
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def agg_na(name: str, c: Column, na_rm: bool = True) -> Column:
    """One aggregate by name. NULL for groups without values, also for sum. With na_rm False a NULL poisons the group."""
    known = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum, "sd": F.stddev_samp}
    if name not in known:
        raise ValueError(f"how must be one of {', '.join(known)}")
    out = known[name](c)
    return out if na_rm else F.when(F.count(c) == F.count(F.lit(1)), out)
