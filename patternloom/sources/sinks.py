"""Writers: solutions and tables as JSON, HTML and TSV."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.functions.omni import omni_text
from patternloom.plans.ast import Pattern
from patternloom.sources.tablestore import DATA, FILL, Store, sanitise

#: Text that is sent to a file at once.
CHARS = 1 << 20


class TextFile:
    """A text file to be written on any file system that Spark writes to; its folder is made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.setWriteChecksum(False)
        self.out, self.held, self.size = fs.create(at, True), [], 0

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size >= CHARS:
            self.flush()

    def flush(self) -> None:
        self.out.write(bytearray("".join(self.held).encode()))
        self.held, self.size = [], 0

    def __enter__(self) -> TextFile:
        return self

    def __exit__(self, *failed) -> None:
        self.flush()
        self.out.close()


#: Solutions of a pattern on a page.
HTML_ROWS = 200


def match_documents(pattern: Pattern, matches: DataFrame, store: Store) -> DataFrame:
    """pattern, json: one JSON object for each solution, with its uids, slots (each with how often it was relaxed), variables as
    lemmas and as the words of their cells; flags and counts are strings."""
    text = store.rows().select(F.col("uid"), "row_text")
    slots = [c[4:] for c in matches.columns if c.startswith("uid_")]
    fixed = {s.name: s for s in pattern.slots}
    variables = [c[2:] for c in matches.columns if c.startswith("v_")]
    out = matches.withColumn("_id", F.monotonically_increasing_id())
    entries = []
    for s in slots:
        slot = fixed.get(s)
        entries.append(F.struct(
            F.lit(len(entries)).alias("n"), F.lit(s).alias("rowSlotName"), F.coalesce(F.col(f"`uid_{s}`"), F.lit("")).alias("uuid"),
            F.lit(str(bool(slot and slot.ref.uuid)).lower()).alias("rowStatic"), F.lit(str(bool(slot and slot.optional)).lower()).alias("rowOptional"),
            F.coalesce(F.col(f"`relax_{s}`"), F.lit(0)).cast("string").alias("relaxedCount"),
        ))
    each = out.select("_id", F.explode(F.array(*entries)).alias("e"), *[f"`{k}_{v}`" for v in variables for k in "vo"])
    each = each.join(text.withColumnRenamed("uid", "_u"), F.col("e.uuid") == F.col("_u"), "left")
    def named(text) -> F.Column:
        if not variables:
            return F.array().cast("array<struct<name:string,value:string>>")
        return F.filter(F.array(*(F.struct(F.lit(v).alias("name"), text(v).alias("value")) for v in variables)), lambda x: x["value"].isNotNull())

    slot = F.struct(F.col("e.n").alias("n"), F.struct("e.rowSlotName", "e.uuid", F.coalesce("row_text", F.lit("")).alias("rowText"), "e.rowStatic", "e.rowOptional", "e.relaxedCount").alias("s"))
    got = each.groupBy("_id").agg(F.sort_array(F.collect_list(slot)).alias("slots"), F.first(named(lambda v: omni_text(F.col(f"`v_{v}`")))).alias("variables"), F.first(named(lambda v: F.col(f"`o_{v}`"))).alias("words"))
    ordered = F.transform("slots", lambda x: x["s"])
    doc = F.struct(F.filter(F.transform(ordered, lambda s: s["uuid"]), lambda u: u != "").alias("uuids"), ordered.alias("slots"), F.col("variables"), F.col("words").alias("variablesOrigTextInferred"))
    return got.select(F.lit(pattern.name).alias("pattern"), "_id", F.to_json(doc).alias("json"))


def write_matches_json(path: str, found: list[tuple[Pattern, DataFrame]], store: Store) -> None:
    """{"patternMatches": [{"patternName", "matches"}]}, one solution after another into the file."""
    with TextFile(store.spark, path) as out:
        out.write('{"patternMatches": [')
        for k, (p, m) in enumerate(found):
            out.write(", " * (k > 0) + f'{{"patternName": {json.dumps(p.name, ensure_ascii=False)}, "matches": ')
            stream_list(out, match_documents(p, m, store).orderBy("_id").select("json"))
            out.write("}")
        out.write("]}")


def stream_list(out, rows: DataFrame) -> None:
    """A JSON list of rows that hold one object each, into an open file."""
    out.write("[")
    for k, r in enumerate(rows.toLocalIterator()):
        out.write(", " * (k > 0) + r[0])
    out.write("]")


def store_documents(store: Store) -> DataFrame:
    """table, json: one JSON object for each row with its cells and their annotation."""
    from patternloom.functions.annotate import annotate

    out = None
    for t in store.tables.values():
        idx = t.of_roles(DATA, FILL)
        alts = [annotate(F.element_at("cells", i + 1), content_only=False) for i in idx]
        field = lambda name: F.array(*(F.transform(a, lambda ts: F.transform(ts, lambda x: x[name])) for a in alts))  # noqa: B023, E731
        doc = F.struct(F.col("uid").alias("uuid"), F.lit(t.name).alias("tablename"), F.array(*map(F.lit, t.header)).alias("header"), F.array(*(F.lit(sanitise(h)) for h in t.header)).alias("headerSanitized"), F.col("cells"), field("word").alias("cellWords"), field("lower").alias("cellWordsLowerCase"), field("lemma").alias("cellLemmas"), field("tag").alias("cellTags"))
        part = t.rows.select(F.lit(t.name).alias("table"), F.to_json(doc).alias("json"))
        out = part if out is None else out.unionByName(part)
    return out


def write_store_json(path: str, store: Store) -> None:
    """A folder of JSON lines for each table."""
    store_documents(store).write.mode("overwrite").partitionBy("table").text(path)


def write_store_document(path: str, store: Store) -> None:
    """One JSON document with the list of each table's rows, written row by row; for a store of any size, write_store_json."""
    with TextFile(store.spark, path) as out:
        out.write("{")
        for k, t in enumerate(store.tables.values()):
            one = Store(store.spark)
            one.add(t)
            out.write(", " * (k > 0) + json.dumps(t.name, ensure_ascii=False) + ": ")
            stream_list(out, store_documents(one).select("json"))
        out.write("}")


def page(title: str, body: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def html_table(header: list[str], rows: list[list]) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    return "<table border=1><tr>" + "".join(cell("th", h) for h in header) + "</tr>" + "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in rows) + "</table>"


def solutions(pattern: Pattern, matches: DataFrame, store: Store, limit: int) -> str:
    rows = [json.loads(r.json) for r in match_documents(pattern, matches.limit(limit), store).orderBy("_id").collect()]
    return "".join(html_table(["slot", "uid", "text"], [[s["rowSlotName"], s["uuid"], s["rowText"]] for s in r["slots"]]) + html_table(["variable", "value"], [[v["name"], v["value"]] for v in r["variables"]]) for r in rows)


def write_matches_html(path: str, found: list[tuple[Pattern, DataFrame]], store: Store, limit: int = HTML_ROWS) -> None:
    """The first solutions of each pattern as tables of slots and variables."""
    body = [f"<h2>{html.escape(p.name)}</h2><p>{html.escape(p.description)}</p>" + solutions(p, m, store, limit) for p, m in found]
    with TextFile(store.spark, path) as out:
        out.write(page("Solutions", "".join(body)))


def stream_table(out, header: list[str], rows: DataFrame) -> None:
    """Every row of a table, one after another into an open file."""
    head, foot = html_table(header, []), "</table>"
    out.write(head.removesuffix(foot))
    for r in rows.toLocalIterator():
        out.write(html_table([], [list(r)]).removeprefix("<table border=1><tr></tr>").removesuffix(foot))
    out.write(foot)


def write_candidates_html(path: str, found: list[tuple[Pattern, DataFrame]], store: Store, lemmas: F.Column | None = None, limit: int = HTML_ROWS) -> None:
    """For each pattern every row that fits a slot by itself with the slot's variables, then the first solutions."""
    from patternloom.plans.compile import candidates, lowered

    start, end = page("Candidates", "\0").split("\0")
    text = store.rows().select("uid", "row_text")
    with TextFile(store.spark, path) as out:
        out.write(start)
        for p, m in found:
            out.write(f"<h2>{html.escape(p.name)}</h2>")
            for k, slot in enumerate(p.slots):
                c = candidates(store, lowered(slot, p.constants), k, lemmas=lemmas)
                rows = c.rows.join(text.withColumnRenamed("uid", f"s{k}_uid"), f"s{k}_uid", "left")
                out.write(f"<h3>Candidates of {html.escape(slot.name)}</h3>")
                stream_table(out, ["uid", "text", "relaxed", *(o.var for o in c.occurrences)], rows.select(f"s{k}_uid", "row_text", f"s{k}_relaxed", *(omni_text(F.col(o.column)) for o in c.occurrences)))
            out.write(solutions(p, m, store, limit))
        out.write(end)


def write_store_html(path: str, store: Store, mode: str = "RAW") -> None:
    """All rows of each table. mode: RAW, WORDS, LEMMAS, TWORDS or TLEMMAS."""
    from patternloom.functions.annotate import annotate

    name = {"WORDS": "word", "LEMMAS": "lemma", "TWORDS": "tword", "TLEMMAS": "tlemma"}.get(mode.upper())
    shown = lambda i: F.element_at("cells", i + 1) if name is None else F.array_join(F.transform(annotate(F.element_at("cells", i + 1), content_only=False), lambda ts: F.array_join(F.transform(ts, lambda x: x[name]), " ")), " ; ")
    start, end = page("Tables", "\0").split("\0")
    with TextFile(store.spark, path) as out:
        out.write(start)
        for t in store.tables.values():
            out.write(f"<h2>{html.escape(t.name)}</h2>")
            stream_table(out, t.header, t.rows.select(*(shown(i).alias(f"c{i}") for i in range(len(t.header)))))
        out.write(end)


def write_states_html(spark: SparkSession, path: str, states: list[dict]) -> None:
    """Each state's instances and what changed since the one before."""
    body, last = [], {}
    for k, s in enumerate(states):
        now = {(i, p): v for i, props in s["instances"].items() for p, v in props.items()}
        rows = [[i, p, v, "" if last.get((i, p)) == v else "changed"] for (i, p), v in sorted(now.items())]
        body.append(f"<h2>State {k} {html.escape(s.get('name') or '')}</h2>" + html_table(["instance", "property", "value", ""], rows) + "".join(f"<p>{html.escape(x)}</p>" for x in s.get("explanation", [])))
        last = now
    with TextFile(spark, path) as out:
        out.write(page("States", "".join(body)))


def write_training_pairs(path: str, pairs: DataFrame) -> None:
    """pattern, n, text_a, text_b as TSV."""
    pairs.select("pattern", "n", "text_a", "text_b").write.mode("overwrite").option("sep", "\t").csv(path)
