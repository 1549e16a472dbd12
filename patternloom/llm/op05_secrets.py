"""Secret scans: candidates of whole texts, told apart by how many repositories and owners share their value."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import join_counted, map_chunks, neutral, neutral_name, prepare, read, save

#: A value that so many different owners hold is an example that was copied, not a credential of any of them. So is one of
#: two owners that stands in so many repositories: too widely spread for a credential that two parties share.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
#: The base kinds, in the order of their names in results; matches of assign with a value under 6 characters are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the run of 20 or more that AKIA[A-Z0-9]+ takes
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
#: The lines that open and close a private key.
MARK = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,40}PRIVATE KEY)-----")
#: What a key's body holds at least; and the body, after header lines, of a key whose end is missing.
BODY = re.compile(r"[A-Za-z0-9+/=]{16}")
CUT_BODY = re.compile(r"(?:\s*\n[A-Za-z0-9-]+: [^\n]*)*(?:\s+[A-Za-z0-9+/]{32,}={0,2})+(?:\s+[A-Za-z0-9+/]+={1,2})?")
#: Kinds besides: spans of the method's own, where no base kind has the same span. Keys are found by their marks.
MORE = (
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("forge", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})")),
)
KINDS = (*BASE, "pem", *(k for k, _ in MORE))


def private_keys(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value): from each opening line to the closing line of its name, whatever is between; its value is the
    body without spaces. A key cut off before its closing line goes as far as its body; without a body it is none."""
    if "PRIVATE KEY-----" not in text:
        return []
    out, marks = [], list(MARK.finditer(text))
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        if m[1] == "END":
            continue
        whole = after is not None and after[1] == "END" and after[2] == m[2]
        if whole and BODY.search(text, m.end(), after.start()):
            out.append((m.start(), after.end(), "".join(text[m.end() : after.start()].split())))
        elif not whole and (body := CUT_BODY.match(text, m.end())):
            out.append((m.start(), body.end(), "".join(body[0].split())))
    return out


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) in order; positions are code points."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    out += [(a, len(BASE), b, value) for a, b, value in private_keys(text)]
    for n, (_, pattern) in enumerate(MORE, len(BASE) + 1):
        out += [(m.start(), n, m.end(), m[0]) for m in pattern.finditer(text)]
    out.sort()
    return out


def joined(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in found)


FOUND = "__row long, __n long, __n_assign long, __n_access long, __n_hex long, __base string, __spans string, __found array<struct<kind:string,start:int,end:int,value:string>>"
LIVE = "array<struct<start:int,end:int,kind:string>>"


def find_candidates(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the spans of every whole text and a hash of each value; the value itself isn't kept. __row numbers rows."""
    prepare(docs.sparkSession)
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema if not f.name.startswith("__")]
    own = [(n, t) for n, t in fields if keep_text or n != text]

    def once():
        task, seen = TaskContext.get().partitionId() << 40, [0]

        def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
            rows = [candidates(x.decode("utf-8", "replace")) if x else [] for x in texts]
            t = t.select([n for n, _ in own])
            t = t.append_column("__row", pa.array(np.arange(len(rows)) + (task + seen[0])))
            seen[0] += len(rows)
            t = t.append_column("__n", pa.array([len(r) for r in rows], pa.int64()))
            for n, name in enumerate(BASE):
                t = t.append_column(f"__n_{name}", pa.array([sum(k == n for _, k, _, _ in r) for r in rows], pa.int64()))
            t = t.append_column("__base", pa.array([hashlib.sha256(joined([x for x in r if x[1] < len(BASE)]).encode()).hexdigest() for r in rows]))
            t = t.append_column("__spans", pa.array([joined(r) for r in rows]))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
            return t.append_column("__found", pa.array([[{"kind": KINDS[k], "start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest()[:32]} for a, k, b, v in r] for r in rows], kind))

        return step

    return map_chunks(docs.select(*(F.col(f"`{n}`") for n, _ in fields)), text, None, ", ".join([*(f"`{n}` {t}" for n, t in own), FOUND]), once=once)


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """value -> owners, repositories: how many different ones hold it; spans: in how many spans it stands. A null owner or
    repository counts as one of its own.

    Rows are first reduced to a row for each value, owner and repository, so a value in very many rows is counted by
    partial sums.
    """
    each = found.where("__n > 0").select(F.explode("__found.value").alias("value"), F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("o"), F.coalesce(F.col(repository).cast("string"), F.lit("\x00")).alias("r"))
    each = each.groupBy("value", "o", "r").agg(F.count("*").alias("n"))
    owners = each.groupBy("value", "o").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("spans"))


def counted(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """__row, told: for each span of a row in order (pos, owners, repositories). Rows without spans are left out."""
    values = save(ownership(found, owner, repository), "secret-values")
    spans = found.where("__n > 0").select("__row", F.posexplode("__found.value").alias("pos", "value"))
    both = join_counted(spans, values, "value", "spans")
    return both.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("pos", "owners", "repositories"))).alias("told"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, keep_text: bool = True) -> DataFrame:
    """docs with, for every row, its spans, how many owners and repositories hold the value of each, and `__live`: the spans
    that are no copied examples.

    A null or empty text has no spans. Repeated rows are rows of their own and count once as an owner. Only rows with spans
    are shuffled.
    """
    found = save(find_candidates(docs, text, keep_text), "secrets")
    example = lambda t: (t["owners"] >= example_owners) | ((t["owners"] > 1) & (t["repositories"] >= example_repositories))
    live = F.filter(F.arrays_zip(F.col("__found").alias("f"), F.col("told").alias("t")), lambda x: ~example(x["t"]))
    of = lambda name: F.array_join(F.transform("told", lambda x: x[name].cast("string")), ",")
    some = found.where("__n > 0").join(counted(found, owner, repository), "__row")
    some = some.withColumns({"__live": F.transform(live, lambda x: F.struct(x["f"]["start"].alias("start"), x["f"]["end"].alias("end"), x["f"]["kind"].alias("kind"))), "__owners": of("owners"), "__repositories": of("repositories")}).drop("told")
    none = found.where("__n = 0").withColumns({"__live": F.array().cast(LIVE), "__owners": F.lit(""), "__repositories": F.lit("")})
    return none.unionByName(some)


def mask_live(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", mask: str = "<secret>", **options) -> DataFrame:
    """docs with every live credential in their texts replaced by mask; no row is lost, and no other column is touched but
    n_chars, which follows the text where there is one.

    Overlapping spans are masked as one.
    """
    plain = neutral(docs)
    t, o, r = (neutral_name(docs, c) for c in (text, owner, repository))
    # parts of the text before each span that begins after all former ones have ended
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.col(t)
    cut = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    masked = F.aggregate("__live", start, cut, lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, 2**31 - 1)))
    has = F.size("__live") > 0
    out = scan(plain, t, o, r, **options).withColumn("__text", F.when(has, masked).otherwise(whole))
    new = {t: F.col("__text")}
    if "n_chars" in docs.columns:
        n = neutral_name(docs, "n_chars")
        new[n] = F.when(has, F.length("__text")).otherwise(F.col(n)).cast(plain.schema[n].dataType)
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in plain.columns)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    live = F.size("__live").cast("long")
    return out.select(
        "doc_id", F.col("__n_assign").alias("n_assign"), F.col("__n_access").alias("n_access"), F.col("__n_hex").alias("n_hex"), F.col("__base").alias("base_sha256"), F.col("__spans").alias("spans"),
        live.alias("n_live"), (F.col("__n") - live).alias("n_example"), F.col("__owners").alias("owners"), F.col("__repositories").alias("repositories"),
    )


def brute(docs: list[tuple], example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> list[tuple]:
    """(id, spans, n_live, owners, repositories) of (id, text, owner) by counting in memory, for tests."""
    owners: dict[str, set] = {}
    homes: dict[str, set] = {}
    found = [(i, o, candidates(t or "")) for i, t, o in docs]
    for i, o, spans in found:
        for *_, value in spans:
            owners.setdefault(value, set()).add(o)
            homes.setdefault(value, set()).add((o, i))
    out = []
    for i, _, spans in found:
        n = [(len(owners[v]), len(homes[v])) for *_, v in spans]
        live = sum(not (a >= example_owners or a > 1 and b >= example_repositories) for a, b in n)
        out.append((i, joined(spans), live, ",".join(str(a) for a, _ in n), ",".join(str(b) for _, b in n)))
    return out
