"""Scalar functions: dual-typed arithmetic and comparison, IEEE division, hashes, text forms, question fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def numeric(s: Column) -> Column:
    """The text as a number, null where it is none."""
    return s.try_cast("double")


def ieee_divide(a: Column, b: Column) -> Column:
    """Division of doubles with signed infinities and NaN for a zero divisor."""
    zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ieee_remainder(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def dual(d: Column | None = None, s: Column | None = None) -> Column:
    """A dual-typed value: number and text, either of which may be null."""
    none = F.lit(None)
    return F.struct((none.cast("double") if d is None else d).alias("d"), (none.cast("string") if s is None else s).alias("s"))


def dual_text(s: Column) -> Column:
    return dual(numeric(s), s)


def dual_arithmetic(op: str, a: Column, b: Column) -> Column:
    """Numbers where both sides are numbers; + joins texts where one is not; all else fails, as null."""
    x, y = a["d"], b["d"]
    number = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: ieee_divide(x, y), "%": lambda: ieee_remainder(x, y)}[op]()
    text = F.when(x.isNull() | y.isNull(), F.concat(a["s"], b["s"])) if op == "+" else F.lit(None).cast("string")
    return dual(number, F.coalesce(number.cast("string"), text))


def dual_compare(op: str, a: Column, b: Column) -> Column:
    """Compared as numbers where both are, else as texts; null where a side has neither."""
    fn = {"==": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    both = a["d"].isNotNull() & b["d"].isNotNull()
    return F.when(both, fn(a["d"], b["d"])).otherwise(fn(a["s"], b["s"]))


def strict_and(a: Column, b: Column) -> Column:
    """Fails (null) if either side fails: no short cut."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def strict_or(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a | b)


def quoted(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def applied(body: str, *args: Column) -> Column:
    """A SQL lambda of one or two columns, applied to them: a long expression that is parsed at once."""
    arrays = [F.array(a) for a in args]
    return F.element_at(F.call_function("transform" if len(args) == 1 else "zip_with", *arrays, F.expr(body)), 1)


def row_hash(s: Column) -> Column:
    """h = ((h << 5) ^ (h >> 27)) ^ code over the characters in 32-bit arithmetic, then the remainder of 10**6."""
    codes = "if(length(s) > 0, split(s, ''), cast(array() AS array<string>))"
    return applied(f"s -> aggregate({codes}, 0, (h, c) -> (shiftleft(h, 5) ^ shiftright(h, 27)) ^ ascii(c), h -> h % 1000000)", s)


def match_hash(hashes: Column) -> Column:
    """Row hashes summed with the remainder of 10**6 at each step, without sign, in hexadecimal."""
    total = F.aggregate(hashes, F.lit(0), lambda a, h: (a + h) % 1_000_000)
    return F.lower(F.hex(F.abs(total)))


def sanitised(name: Column) -> Column:
    """A column's public name: upper case, runs of other than letters and digits as one underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " ")), " +", "_")


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.trim(s), " +"), lambda x: x != "")


def alternatives(s: Column) -> Column:
    """Phrasings of a cell: parts between semicolons, then those with a hyphen once more with a space instead."""
    parts = F.transform(F.split(s, ";"), lambda x: F.trim(x))
    return F.concat(parts, F.transform(F.filter(parts, lambda x: x.contains("-")), lambda x: F.replace(x, F.lit("-"), F.lit(" "))))


def stem_and_choices(s: Column) -> Column:
    """Parts of a multiple-choice question: the stem, then the choices."""
    return F.transform(F.split(s, r"\(([A-E]|[1-5])\)"), lambda x: F.trim(x))


def answer_index(s: Column) -> Column:
    """0-based index of an answer letter or digit; -1 for all else."""
    t = F.upper(F.trim(s))
    return F.when(t.rlike("^[A-E]$"), F.ascii(t) - 65).when(t.rlike("^[1-5]$"), F.ascii(t) - 49).otherwise(F.lit(-1))


def explanation(s: Column) -> Column:
    """uid|ROLE uid|ROLE ... as an array of (uid in lower case, role in upper case); the first of a uid counts."""
    words = F.filter(F.split(F.trim(F.coalesce(s, F.lit(""))), r"\s+"), lambda x: x != "")
    pairs = F.transform(words, lambda x: F.struct(F.lower(F.split_part(x, F.lit("|"), F.lit(1))).alias("uid"), F.upper(F.split_part(x, F.lit("|"), F.lit(2))).alias("role")))
    fresh = lambda a, p: F.when(F.exists(a, lambda q: q["uid"] == p["uid"]), a).otherwise(F.concat(a, F.array(p)))
    return F.aggregate(pairs, F.array().cast("array<struct<uid:string,role:string>>"), fresh)


def with_roles(expl: Column, roles: list[str]) -> Column:
    return F.filter(expl, lambda e: e["role"].isin(*[r.upper() for r in roles]))


def has_flag(flags: Column, flag: str) -> Column:
    """Whether a space-separated list of flags holds one; a question is kept once, however many flags it has."""
    return F.array_contains(F.split(F.upper(F.trim(flags)), r"\s+"), flag.upper())


def topic_prefix(label: Column, n: Column | int) -> Column:
    """The first n levels of a topic label, whose levels are parted by underscores."""
    return F.array_join(F.slice(F.split(label, "_"), F.lit(1), n if isinstance(n, Column) else F.lit(n)), "_")
