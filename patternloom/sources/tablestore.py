"""Table stores: tab-separated tables of short texts, with roles in their headers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.checkpoints import checkpoint
from patternloom.functions.annotate import alternatives_of, annotate, row_alternatives_of
from patternloom.shipping import ship

DATA, FILL, SKIP, DEP, UID = "DATA", "FILL", "SKIP", "DEP", "UID"


def role_of(header: str) -> str:
    h = header.strip().upper()
    if h.startswith("[FILL]"):
        return FILL
    if re.match(r"\[SKIP\] *UID\b", h):
        return UID
    if re.match(r"\[SKIP\] *DEP\b", h):
        return DEP
    return SKIP if h.startswith(("[SKIP]", "#")) else DATA


def sanitise(name: str) -> str:
    return re.sub(" +", "_", re.sub(r"[^A-Z0-9]+", " ", name.upper()).strip())


@dataclass
class Table:
    """A named table. rows: uid, cells ARRAY<STRING> by position, generated (null, GEN or TEMPGEN)."""

    name: str
    header: list[str]
    rows: DataFrame
    roles: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.roles = self.roles or [role_of(h) for h in self.header]
        self.planned: int | None = None
        self.lookup: dict[str, int] = {}
        for i, h in enumerate(self.header):  # of equal names the last counts
            self.lookup[h.strip().upper()] = i
            self.lookup[sanitise(h)] = i

    def planned_bytes(self) -> int:
        """What the planner takes the rows to have; an immense number where it can't tell."""
        if self.planned is None:
            self.planned = int(self.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return self.planned

    def column(self, name: str) -> int:
        """Position of a column by its upper-cased raw name or its sanitised form."""
        for key in (name.strip().upper(), sanitise(name)):
            if key in self.lookup:
                return self.lookup[key]
        raise KeyError(f"table {self.name} has no column {name}")

    def column_starting(self, prefix: str) -> int:
        """The first column whose name begins with prefix."""
        return next(i for i, h in enumerate(self.header) if h.strip().upper().startswith(prefix.upper()) or sanitise(h).startswith(prefix.upper()))

    def of_roles(self, *roles: str) -> list[int]:
        return [i for i, r in enumerate(self.roles) if r in roles]

    def text(self, data_only: bool = False) -> F.Column:
        """The row as a sentence: its filled DATA (and FILL) cells joined by spaces."""
        cells = [F.trim(F.element_at("cells", i + 1)) for i in self.of_roles(*([DATA] if data_only else [DATA, FILL]))]
        return F.trim(F.regexp_replace(F.concat_ws(" ", *cells), " +", " ")) if cells else F.lit("")

    def labelled_text(self) -> F.Column:
        """The sentence with its source; cells with alternatives stand in parentheses."""
        cells = [F.trim(F.element_at("cells", i + 1)) for i in self.of_roles(DATA, FILL)]
        shown = [F.when(c.contains(";"), F.concat(F.lit("("), c, F.lit(")"))).otherwise(c) for c in cells]
        return F.concat(F.trim(F.regexp_replace(F.concat_ws(" ", *shown), " +", " ")), F.lit(f" ({self.name}, UID: "), F.col("uid"), F.lit(")"))

    def annotated(self, columns: list[int] | None = None, lemmas: F.Column | None = None, content_only: bool = True, whole_rows: bool = False) -> DataFrame:
        """uid, generated and for each wanted column an array of alternatives (slots, value); only wanted columns are read.

        With whole_rows a word is tagged as part of the sentence that its row is, with the cells (DATA and FILL) around its own.
        """
        wanted = self.of_roles(DATA, FILL) if columns is None else columns
        out = [F.col("uid"), F.col("generated"), F.col("cells")]
        if whole_rows:
            sentence = self.of_roles(DATA, FILL)
            sentence += [i for i in wanted if i not in sentence]
            alts = row_alternatives_of([F.element_at("cells", i + 1) for i in sentence], [sentence.index(i) for i in wanted], lemmas, content_only)
            return self.rows.select(*out, *(a.alias(f"alts_{i}") for i, a in zip(wanted, alts, strict=True)))
        for i in wanted:
            out.append(alternatives_of(F.element_at("cells", i + 1), lemmas, content_only).alias(f"alts_{i}"))
        return self.rows.select(*out)

    def cell_texts(self, columns: list[int]) -> F.Column:
        """The texts of a row's cells in these columns, as a struct."""
        return F.struct(*(F.element_at("cells", i + 1).alias(f"c{i}") for i in dict.fromkeys(columns)))

    def annotated_texts(self, rows: DataFrame, columns: list[int], lemmas: F.Column | None = None) -> DataFrame:
        """_x and the alternatives of each wanted column for the distinct cell_texts() of rows: equal texts are annotated once."""
        alts = [alternatives_of(F.col(f"_x.c{i}"), lemmas, True).alias(f"alts_{i}") for i in dict.fromkeys(columns)]
        return rows.select(self.cell_texts(columns).alias("_x")).distinct().select("_x", *alts)

    def duplicates_key(self) -> F.Column:
        """Rows are duplicates if the lower-cased words of all their DATA columns are equal, first alternatives."""
        cells = [F.lower(F.trim(F.split_part(F.element_at("cells", i + 1), F.lit(";"), F.lit(1)))) for i in self.of_roles(DATA)]
        return F.concat_ws("\x1f", *[F.regexp_replace(c, " +", " ") for c in cells])


@dataclass
class Shared:
    """What several patterns have in common: annotated tables by name, fitting rows by constraint."""

    columns: dict[str, list[int]]
    often: set
    tables: dict[str, DataFrame] = field(default_factory=dict)
    slots: dict[Any, DataFrame] = field(default_factory=dict)


class Store:
    """Tables by name, any case; edits replace a table's rows, so earlier DataFrames stay as they were. With whole_rows the cells
    that patterns read are tagged as parts of their rows."""

    def __init__(self, spark: SparkSession, whole_rows: bool = False) -> None:
        ship(spark)
        self.spark, self.tables, self.whole_rows = spark, {}, whole_rows
        self.version = 0  # counts edits
        self.shared: Shared | None = None
        self.located: dict[str, str | None] = {}

    def add(self, table: Table) -> None:
        self.tables[table.name.upper()] = table
        self.version += 1
        self.located.clear()
        self.shared = None

    def share(self, columns: dict[str, list[int]], often: set) -> None:
        """From now on, until a table is edited: annotate these columns of each table once, and compute what once() is asked
        for under one of these keys once. Both are written down."""
        self.shared = Shared(columns, often)

    def annotated(self, name: str, columns: list[int], lemmas: F.Column | None = None) -> DataFrame:
        """A table's wanted columns as alternatives (see Table.annotated)."""
        t, key = self[name], name.upper()
        if self.shared is None or not set(columns) <= set(self.shared.columns.get(key, ())):
            return t.annotated(columns, lemmas, whole_rows=self.whole_rows)
        if key not in self.shared.tables:
            self.shared.tables[key] = checkpoint(t.annotated(self.shared.columns[key], lemmas, whole_rows=self.whole_rows))
        return self.shared.tables[key]

    def once(self, key: Any, make: Callable[[], DataFrame]) -> DataFrame:
        if self.shared is None or key not in self.shared.often:
            return make()
        if key not in self.shared.slots:
            self.shared.slots[key] = checkpoint(make())
        return self.shared.slots[key]

    def locate(self, uids: list[str]) -> dict[str, str | None]:
        """The table of each uid, None where no table holds it; one job for all that are not known yet."""
        fresh = sorted(set(uids) - self.located.keys())
        if fresh:
            self.located |= dict.fromkeys(fresh)
            for r in self.rows().where(F.col("uid").isin(fresh)).select("uid", "table").collect():  # the uids asked for
                self.located[r.uid] = self.located[r.uid] or r.table
        return {u: self.located[u] for u in uids}

    def __getitem__(self, name: str) -> Table:
        try:
            return self.tables[name.upper()]
        except KeyError:
            raise KeyError(f"no table {name}") from None

    def __contains__(self, name: str) -> bool:
        return name.upper() in self.tables

    def row(self, uid: str) -> DataFrame:
        """The row with a uid, from whichever table holds it."""
        return self.rows().where(F.col("uid") == uid)

    def rows(self, labelled: bool = False) -> DataFrame:
        """All rows: table, uid, row_text, data_text, generated."""
        out = None
        for t in self.tables.values():
            part = t.rows.select(F.lit(t.name).alias("table"), "uid", (t.labelled_text() if labelled else t.text()).alias("row_text"), t.text(True).alias("data_text"), "generated")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "table string, uid string, row_text string, data_text string, generated string")

    def cells(self) -> DataFrame:
        """One row for each cell: table, uid, col, col_idx, role, text, alts."""
        out = None
        for t in self.tables.values():
            info = F.array(*(F.struct(F.lit(h).alias("col"), F.lit(i).alias("col_idx"), F.lit(r).alias("role")) for i, (h, r) in enumerate(zip(t.header, t.roles, strict=True))))
            part = t.rows.select(F.lit(t.name).alias("table"), "uid", F.explode(F.arrays_zip(info.alias("i"), F.col("cells").alias("c"))).alias("z"))
            part = part.select("table", "uid", "z.i.col", "z.i.col_idx", "z.i.role", F.col("z.c").alias("text"))
            out = part if out is None else out.unionByName(part)
        return out.withColumn("alts", F.when(F.col("role").isin(DATA, FILL), annotate(F.col("text"), content_only=False)))

    def words(self, texts: list[str] = ()) -> DataFrame:
        """word: the distinct words of all annotated cells, and of some texts, in lower case."""
        cells = self.cells().where("alts is not null").select("alts")
        more = self.spark.createDataFrame([(t,) for t in texts], "text string").select(annotate(F.col("text"), content_only=False).alias("alts"))
        return cells.unionByName(more).select(F.explode(F.flatten("alts")).alias("t")).select(F.col("t.lower").alias("word")).distinct()

    def catalog(self) -> DataFrame:
        rows = [(t.name, h, sanitise(h), i, r) for t in self.tables.values() for i, (h, r) in enumerate(zip(t.header, t.roles, strict=True))]
        return self.spark.createDataFrame(rows, "table string, col string, name string, col_idx int, role string")

    def remove(self, uids: DataFrame) -> None:
        """Drop the rows of uids(uid) from all tables."""
        for t in list(self.tables.values()):
            self.add(Table(t.name, t.header, t.rows.join(uids.select("uid").distinct(), "uid", "left_anti"), t.roles))

    def drop_generated(self, kind: str = "TEMPGEN") -> None:
        for t in list(self.tables.values()):
            self.add(Table(t.name, t.header, t.rows.where(F.coalesce("generated", F.lit("")) != kind), t.roles))

    def with_rows(self, rows: dict[str, DataFrame]) -> Store:
        """A store of these tables alone, with other rows."""
        out = Store(self.spark, self.whole_rows)
        for name, df in rows.items():
            t = self[name]
            table = Table(t.name, t.header, df, t.roles)
            table.planned = 1 << 62  # not worth planning for
            out.add(table)
        return out

    def fresh(self, name: str, cells: DataFrame, kind: str = "GEN") -> DataFrame:
        """The rows that insert() would add."""
        have = self[name].rows.select(self[name].duplicates_key().alias("_key"))
        return self._given(name, cells, kind).join(have, "_key", "left_anti").select(F.col("_made").alias("uid"), "cells", F.lit(kind).alias("generated"))

    def _given(self, name: str, cells: DataFrame, kind: str) -> DataFrame:
        """cells, each once, with _key (its DATA words) and _made (a uid of them)."""
        given = cells.select("cells").withColumn("_key", self[name].duplicates_key()).dropDuplicates(["_key"])
        return given.withColumn("_made", F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(self[name].name), "_key"), 256), 1, 16)))

    def insert(self, name: str, cells: DataFrame, kind: str = "GEN") -> DataFrame:
        """Add rows given as cells ARRAY<STRING>; those whose DATA words the table already has are left out.

        A new row's uid is made of its content, so a repeated step adds nothing. Returns uid for every given row: its own or
        that of the row it repeats.
        """
        t, fresh = self[name], self.fresh(name, cells, kind)
        have = t.rows.withColumn("_key", t.duplicates_key()).groupBy("_key").agg(F.min("uid").alias("old"))
        given = self._given(name, cells, kind).join(have, "_key", "left")
        self.add(Table(t.name, t.header, t.rows.unionByName(fresh), t.roles))
        return given.select(F.coalesce("old", "_made").alias("uid"), "cells", F.col("old").isNull().alias("added"))


def split_line(line: str) -> list[str]:
    out = line.rstrip("\r\n").split("\t")
    while out and not out[-1]:
        out.pop()
    return out


def load_table(spark: SparkSession, path: str, two_line_header: bool = False) -> Table | None:
    """A table from a TSV file; None where it has no uid column. Its name is the file's up to the first dot.

    Blank lines are skipped. A row is kept if it has a uid and anything else and is not deprecated; a row whose fields
    outnumber the header fails.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    lines = spark.read.text(path)
    head = [r.value for r in lines.limit(2).collect()]
    header = split_line(head[int(two_line_header)]) if len(head) > int(two_line_header) else []
    roles = [role_of(h) for h in header]
    if UID not in roles:
        return None
    skipped = {line for line in head[: 1 + int(two_line_header)]}
    n, uid = len(header), roles.index(UID) + 1
    fields = F.transform(F.split(F.regexp_replace("value", "[\t\r]+$", ""), "\t", -1), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    rows = lines.where((F.trim(F.regexp_replace("value", "\t", " ")) != "") & ~F.col("value").isin(*skipped)).select(fields.alias("cells"))
    rows = rows.withColumn("cells", F.when(F.size("cells") > n, F.raise_error(F.concat(F.lit(f"{name}: a row has more fields than the header: "), F.array_join("cells", "|")))).otherwise(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size("cells"))))))
    other = F.exists(F.slice(F.col("cells"), 1, n), lambda x: x != "") if n == 1 else F.exists(F.concat(F.slice("cells", 1, uid - 1), F.slice("cells", uid + 1, n)) if uid > 1 else F.slice("cells", 2, n), lambda x: x != "")
    keep = (F.element_at("cells", uid) != "") & other
    if DEP in roles:
        keep = keep & (F.element_at("cells", roles.index(DEP) + 1) == "")
    return Table(name, header, rows.where(keep).select(F.element_at("cells", uid).alias("uid"), "cells", F.lit(None).cast("string").alias("generated")), roles)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a file stands there, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def load_store(spark: SparkSession, index: str, two_line_header: bool = False, in_tables: bool = True, whole_rows: bool = False) -> Store:
    """The tables that an index file names, one a line, from `tables/` beside it; missing and invalid ones are left out."""
    store, base = Store(spark, whole_rows), (index.rsplit("/", 1)[0] if "/" in index else ".") + "/tables" * in_tables
    for r in spark.read.text(index).collect():
        file = f"{base}/{r.value.strip()}"
        if r.value.strip() and is_file(spark, file):
            t = load_table(spark, file, two_line_header)
            if t is not None:
                store.add(t)
    return store


def from_rows(spark: SparkSession, name: str, header: list[str], rows: list[list[str]]) -> Table:
    """A table from Python lists; the uid column is the one that the header marks."""
    roles = [role_of(h) for h in header]
    uid = roles.index(UID)
    return Table(name, header, spark.createDataFrame([(r[uid], r, None) for r in rows], "uid string, cells array<string>, generated string"), roles)


def from_frame(name: str, df: DataFrame, uid: str, columns: dict[str, str]) -> Table:
    """A table over any DataFrame: columns maps header names to columns, uid becomes the row id; nothing is read yet."""
    header = [*columns, "[SKIP] UID"]
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*columns.values(), uid]))
    return Table(name, header, df.select(F.col(uid).cast("string").alias("uid"), cells.alias("cells"), F.lit(None).cast("string").alias("generated")))
