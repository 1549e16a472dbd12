"""Parsing, solving, composing, fixpoints and scripts on small stores."""

import functools
import itertools
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from patternloom.operators.closure import complete_taxonomy, transitive_closure
from patternloom.plans.compile import solve
from patternloom.plans.parser import ParseError, load, parse
from patternloom.runtime import Runtime, ScriptError, enumerate_patterns
from patternloom.sources import sinks
from patternloom.sources.tablestore import Store, from_rows, load_store


def store_of(spark):
    s = Store(spark)
    s.add(from_rows(spark, "KINDOF", ["HYPONYM", "[FILL] is a kind of", "HYPERNYM", "[SKIP] UID"], [
        ["cat", "is a kind of", "animal ; pet", "k1"], ["animal", "is a kind of", "organism", "k2"], ["dogs", "is a kind of", "animals", "k3"], ["oak", "is a kind of", "tree", "k4"],
    ]))
    s.add(from_rows(spark, "PARTOF", ["PART", "WHOLE", "[SKIP] UID"], [["tail", "cat", "p1"], ["leaf", "tree", "p2"], ["paw", "dog", "p3"]]))
    s.add(from_rows(spark, "PROP-GENERIC", ["PROPERTY", "OBJECT", "VALUES", "[SKIP] UID"], [["temperature", "cat", "38", "g1"]]))
    return s


def one(text):
    return parse(text).patterns[0]


def test_two_slots(spark):
    m = solve(store_of(spark), one('inferencepattern p row a=[TABLE:"KINDOF", HYPONYM:<x>, HYPERNYM:<w>] row b=[TABLE:"PARTOF", PART:<y>, WHOLE:<x>] endinferencepattern'))
    assert {(r.uid_a, r.uid_b) for r in m.collect()} == {("k1", "p1"), ("k3", "p3")}  # dogs and dog share a lemma


def test_optional_row_is_both_filled_and_not(spark):
    m = solve(store_of(spark), one('inferencepattern p row a=[TABLE:"KINDOF", HYPONYM:<x>] row *b=[TABLE:"PARTOF", WHOLE:<x>] endinferencepattern'))
    rows = [(r.uid_a, r.uid_b, r.n_opt_unfilled) for r in m.collect()]
    assert sorted(rows, key=str) == sorted([("k1", "p1", 0), ("k3", "p3", 0), ("k1", None, 1), ("k2", None, 1), ("k3", None, 1), ("k4", None, 1)], key=str)
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)


def test_two_optional_rows_filled_together(spark):
    text = 'inferencepattern p row a=[TABLE:"KINDOF", HYPONYM:<x>] row *b=[TABLE:"PARTOF", WHOLE:<x>] row *c=[TABLE:"PARTOF", PART:"tail"] musthaveoromit((<b> != "" && <c> != "") || (<b> == "" && <c> == "")) endinferencepattern'
    rows = {(r.uid_a, r.uid_b, r.uid_c) for r in solve(store_of(spark), one(text)).collect()}
    assert rows == {("k1", "p1", "p1"), ("k3", "p3", "p1"), ("k1", None, None), ("k2", None, None), ("k3", None, None), ("k4", None, None)}


def test_static_rows_ignore_comment_literals(spark):
    m = solve(store_of(spark), one('inferencepattern p row a=[UUID:"k1", HYPONYM:"nothing like it"] row b=[UUID:"p1", WHOLE:<x>] endinferencepattern'))
    assert [(r.uid_a, r.uid_b) for r in m.collect()] == [("k1", "p1")]


def test_literals_options_and_concatenation(spark):
    s = store_of(spark)
    m = solve(s, one('inferencepattern p row a=[TABLE:"KINDOF", HYPONYM:"cat" || "oak", HYPERNYM:<w>] endinferencepattern'))
    assert sorted(r.uid_a for r in m.collect()) == ["k1", "k1", "k4"]  # two alternatives of k1
    s.add(from_rows(spark, "T", ["C", "[SKIP] UID"], [["sound energy source", "t1"], ["energy", "t2"]]))
    m = solve(s, one('inferencepattern p row a=[TABLE:"T", C:<a> + "energy" + <b>] endinferencepattern'))
    assert [(r.uid_a, r.v_a, r.v_b) for r in m.collect()] == [("t1", [["sound"]], [["source"]])]


def test_musthave_marks_and_unprocessed_keeps(spark):
    m = solve(store_of(spark), one('inferencepattern p row a=[TABLE:"PARTOF", PART:<x>] musthave(<x> == "tail") shouldhave(<x> != "leaf") musthaveoromit(<nowhere> == "1") endinferencepattern'))
    assert {(r.uid_a, r.executable, r.should_score) for r in m.collect()} == {("p1", False, 1.0), ("p2", False, 0.0), ("p3", False, 1.0)}  # an open condition keeps all from being executed
    m = solve(store_of(spark), one('inferencepattern p row a=[TABLE:"PARTOF", PART:<x>] musthave(<x> == "tail") shouldhave(<x> != "leaf") endinferencepattern'))
    assert {(r.uid_a, r.executable, r.should_score) for r in m.collect()} == {("p1", True, 1.0), ("p2", False, 0.0), ("p3", False, 1.0)}


def test_relaxable_variable_never_rejects(spark):
    m = solve(store_of(spark), one('inferencepattern p row a=[UUID:"k1", HYPONYM:<x>] row b=[TABLE:"PARTOF", WHOLE:<~x>] endinferencepattern'))
    assert sorted(r.uid_b for r in m.collect()) == ["p1", "p2", "p3"]


def test_three_way_binding_is_to_the_first(spark):
    """a~b and a~c do not imply b~c: both join to the binder."""
    s = Store(spark)
    for name, cell in (("A", "running"), ("B", "run"), ("C", "running")):
        s.add(from_rows(spark, name, ["W", "[SKIP] UID"], [[cell, name.lower()]]))
    m = solve(s, one('inferencepattern p row a=[TABLE:"A", W:<x>] row b=[TABLE:"B", W:<x>] row c=[TABLE:"C", W:<x>] endinferencepattern'))
    assert m.count() == 1


def test_composite(spark):
    prog = parse("""inferencepattern a row r=[TABLE:"PARTOF", WHOLE:<x>] endinferencepattern
      inferencepattern b row q=[TABLE:"PARTOF", PART:"tail"] endinferencepattern
      inferencepattern c infpat u = a infpat v = b rowequiv u.r = v.q endinferencepattern""")
    s, solved = store_of(spark), {}
    for p in prog.patterns:
        solved[p.name] = solve(s, p, solved=solved)
    assert [(r.uid_u__r, r.uid_v__q) for r in solved["c"].collect()] == [("p1", "p1")]


def test_random_tables_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = lambda p: [[rng.choice(["rat", "bat ; rat", "hat", "mat"]), rng.choice(["rat", "hat", "cot"]), f"{p}{i}"] for i in range(8)]
    left, right = rows("l"), rows("r")
    s = Store(spark)
    s.add(from_rows(spark, "L", ["A", "B", "[SKIP] UID"], left))
    s.add(from_rows(spark, "R", ["A", "B", "[SKIP] UID"], right))
    m = solve(s, one('inferencepattern p row l=[TABLE:"L", A:<x>, B:<y>] row r=[TABLE:"R", A:<y>, B:<x>] endinferencepattern'), None)
    cut = lambda c: {a.strip() for a in c.split(";")}
    want = {(a[2], b[2]) for a, b in itertools.product(left, right) if cut(a[0]) & cut(b[1]) and cut(a[1]) & cut(b[0])}
    assert {(r.uid_l, r.uid_r) for r in m.collect()} == want


def test_closure_terminates_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "src string, dst string")
    got = {tuple(r) for r in transitive_closure(e).collect()}
    assert got == set(itertools.product("abc", "abcd"))


def test_taxonomy_completion(spark):
    s = store_of(spark)
    assert complete_taxonomy(s) == 2  # cat and dog are organisms
    assert complete_taxonomy(s) == 0
    assert s["KINDOF"].rows.where("generated = 'TEMPGEN'").count() == 2


def test_insert_and_remove(spark):
    s = store_of(spark)
    new = spark.createDataFrame([(["TAIL", "cat", ""],), (["ear", "cat", ""],), (["ear", "cat", ""],)], "cells array<string>")
    got = {(r.uid, r.added) for r in s.insert("PARTOF", new).collect()}
    assert ("p1", False) in got and len(got) == 2
    s.remove(spark.createDataFrame([("p1",), ("p2",)], "uid string"))
    assert s["PARTOF"].rows.count() == 2


def test_rules_run_to_their_fixpoint(spark):
    text = """inferencepattern wholes executionmode = "AUTO"
      row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] row b=[TABLE:"KINDOF", HYPONYM:<z>, HYPERNYM:<y>]
      generateRow([TABLE:"PARTOF", PART:<x>, WHOLE:<z>]) endinferencepattern
      executeAutoPatterns"""
    s = store_of(spark)
    assert Runtime(spark, s, parse(text)).run() == 0
    assert {tuple(r[:2]) for (r,) in s["PARTOF"].rows.select("cells").collect()} >= {("leaf", "oak")}


def test_script(spark, tmp_path):
    text = """inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>]
        println(<x> + " of " + <y>) temporalblock(now) println("now") endtemporalblock endinferencepattern
      setStateName("start")
      instantiate c([KINDOF:"cat"])
      var n = 0
      while (n < 3) n = n + 1 if (n == 2) then break endif endwhile
      c."lives" = 9 - n
      incrementState
      c."temperature" = c."temperature" + 1
      executePattern(p, [<x> == "leaf"], temporalblocks=[now])
      println(getStateFirstWithName("start").c."temperature")
      populateInfPatMatches
      exportInfPatJSON() exportStateSpaceHTML() exportInfPatHTML() exportTableStoreHTML()
      verifyAnswer(c."temperature" == 39 && c."lives" == 7)
      exit(3)"""
    run = Runtime(spark, store_of(spark), parse(text), str(tmp_path))
    assert run.run() == 3
    assert run.printed == ["leaf of tree", "now", "38"]
    doc = json.loads((tmp_path / "matches.json").read_text())["patternMatches"][0]
    assert doc["patternName"] == "p" and len(doc["matches"]) == 3
    slot = doc["matches"][0]["slots"][0]
    assert set(slot) == {"rowSlotName", "uuid", "rowText", "rowStatic", "rowOptional", "relaxedCount"} and slot["rowStatic"] == "false"
    assert run.states_frame().where("state_idx = 0 and property = 'temperature'").first().value == "38"


def test_exports_hold_every_row(spark, tmp_path):
    store = Store(spark)
    store.add(from_rows(spark, "PARTOF", ["PART", "WHOLE", "[SKIP] UID"], [[f"part{i}", "<whole>", f"p{i}"] for i in range(450)]))
    text = """inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] row b=[TABLE:"PARTOF", PART:<y>, WHOLE:<z>] endinferencepattern
      populateInfPatMatches exportTableStoreHTML() exportInfPatDebugHTML()"""
    Runtime(spark, store, parse(text), str(tmp_path)).run()
    tables, debug = ((tmp_path / f).read_text() for f in ("tables.html", "debug.html"))
    assert all(f"<td>part{i}</td>" in tables for i in range(450)) and tables.count("<tr>") == 451 and "&lt;whole&gt;" in tables
    assert all(debug.count(f"<td>p{i}</td>") == 2 for i in range(450)) and tables.endswith("</html>")


def test_the_command_line_exports_tables_and_runs_scripts(spark, tmp_path, capsys):
    from patternloom.runtime import main

    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "PARTOF.tsv").write_text('PART\tWHOLE\t[SKIP] UID\nleaf "a"\ttree\tp1\ntree\twood\tp2\n')
    (tmp_path / "tables" / "SIZE.tsv").write_text("WHAT\t[SKIP] UID\nbig\ts1\n")
    (tmp_path / "index.txt").write_text("PARTOF.tsv\nmissing.tsv\nSIZE.tsv\n")
    index, file = str(tmp_path / "index.txt"), tmp_path / "store.json"
    assert main(["--tablestoreIndex", index, "--exportTablestore", str(file)]) == 0
    got = json.loads(file.read_text())
    assert {t: sorted(r["uuid"] for r in rows) for t, rows in got.items()} == {"PARTOF": ["p1", "p2"], "SIZE": ["s1"]}
    assert got["SIZE"][0]["cells"] == ["big", "s1"] and next(r for r in got["PARTOF"] if r["uuid"] == "p1")["cells"][0] == 'leaf "a"'
    (tmp_path / "s.iml").write_text("""inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] endinferencepattern
      inferencepattern none row a=[TABLE:"PARTOF", PART:"nothing"] endinferencepattern
      populateInfPatMatches exportInfPatJSON() println("done")""")
    (tmp_path / "lemmas.txt").write_text("lumber\twood\n")
    assert main(["--script", str(tmp_path / "s.iml"), "--tablestoreIndex", index, "--outputPath", str(tmp_path), "--lemmas", str(tmp_path / "lemmas.txt"), "--timeLimit", "600"]) == 0
    assert "done" in capsys.readouterr().out
    found = {p["patternName"]: p["matches"] for p in json.loads((tmp_path / "matches.json").read_text())["patternMatches"]}
    assert len(found["p"]) == 2 and found["none"] == []
    assert sorted(v["value"] for m in found["p"] for v in m["variables"] if v["name"] == "y") == ["lumber", "tree"]


def test_a_lemma_dictionary_is_used_or_refused(spark, tmp_path):
    from patternloom.sources.readers import lemma_dictionary

    (tmp_path / "lemmas.txt").write_text("lemma\tword\ntree\tarbor\n")
    with pytest.raises(ValueError, match="not supported"):
        lemma_dictionary(spark, str(tmp_path / "lemmas.txt"), limit=1)
    store = Store(spark)
    store.add(from_rows(spark, "PARTOF", ["PART", "WHOLE", "[SKIP] UID"], [["leaf", "arbor", "p1"], ["tree", "wood", "p2"]]))
    text = 'inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] row b=[TABLE:"PARTOF", PART:<y>, WHOLE:<z>] endinferencepattern populateInfPatMatches'
    run = Runtime(spark, store, parse(text), lemmas=lemma_dictionary(spark, str(tmp_path / "lemmas.txt")))
    run.run()
    assert [(r.uid_a, r.uid_b) for r in run.matches["p"].collect()] == [("p1", "p2")]


def test_a_lemma_file_of_any_length_is_cut_to_the_words_in_use(spark, tmp_path):
    from patternloom.runtime import literals
    from patternloom.sources.readers import lemma_dictionary

    lines = [f"l{i}\tw{i}" for i in range(5000)] + ["sapling\tarbor", "tree\tarbor", "plant\ttree", "shrub\tbush", "timber\twood"]
    (tmp_path / "lemmas.txt").write_text("\n".join(lines) + "\n")
    store = Store(spark)
    store.add(from_rows(spark, "PARTOF", ["PART", "WHOLE", "[SKIP] UID"], [["leaf", "Arbors ; ARBOR", "p1"], ["x", "wood", "p2"]]))
    program = parse('inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:"bush"] endinferencepattern')
    got = lemma_dictionary(spark, str(tmp_path / "lemmas.txt"), store.words(sorted(set(literals(program)))), limit=4)
    # the last line of a word counts, and lemmas are looked up as words too
    assert spark.range(1).select(got.alias("m")).first().m == {"arbor": "tree", "tree": "plant", "bush": "shrub", "wood": "timber"}
    assert lemma_dictionary(spark, str(tmp_path / "lemmas.txt"), spark.createDataFrame([("none",)], "word string")) is None


def test_the_time_limit_cancels_a_running_job(spark):
    @F.udf("int")
    def slow(_):
        time.sleep(60)
        return 1

    run = Runtime(spark, store_of(spark), parse("verifyAnswer(1 == 1)"), time_limit=1)
    run.execute = lambda _: spark.range(0, 2, 1, 1).select(slow("id").alias("x")).where("x > 0").count()
    start = time.monotonic()
    with pytest.raises(ScriptError, match="time limit"):
        run.run()
    assert time.monotonic() - start < 30
    assert spark.range(3).count() == 3  # jobs of others go on


def test_hash_of_rows_and_components(spark):
    from test_functions import java_hash

    lasting = "a1b2-c3d4-e5f6-0a1b"
    store = Store(spark)
    store.add(from_rows(spark, "T", ["A", "[FILL] F", "B", "[SKIP] UID"], [["Big  cat", "is", "animal", lasting], ["animal", "is", "thing", "GEN-7"]]))
    text = """inferencepattern p row r=[TABLE:"T", A:<x>, B:"animal"] endinferencepattern
    inferencepattern q row s=[TABLE:"T", A:<y>, B:"thing"] endinferencepattern
    inferencepattern c infpat m=p infpat n=q row t=[TABLE:"T", A:<z>, B:"thing"] endinferencepattern"""
    run = Runtime(spark, store, parse(text))
    run.populate()
    p, q = java_hash(lasting), java_hash("animal thing")
    code = lambda *hs: f"{abs(functools.reduce(lambda a, h: int(math.fmod(a + h, 1_000_000)), hs, 0)):x}"
    got = {n: run.matches[n].first()["hash"] for n in "pqc"}
    assert got == {"p": code(p), "q": code(q), "c": code(q, abs(p), abs(q))}


def test_failed_answer(spark):
    assert Runtime(spark, store_of(spark), parse("verifyAnswer(1 == 2)")).run() == -10


def test_enumeration_summary(spark):
    prog = parse('inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] endinferencepattern')
    found, summary = enumerate_patterns(spark, store_of(spark), prog)
    assert summary["solutions"] == 3 and summary["mean_slots"] == 1 and summary["mean_variables"] == 2


def test_parser_errors_and_imports(tmp_path):
    with pytest.raises(ParseError):
        parse("inferencepattern p description = \"a\" description = \"b\" endinferencepattern")
    (tmp_path / "a.iml").write_text('import "b.iml"\nprintln("a")')
    (tmp_path / "b.iml").write_text('import "a.iml"\n/* both */ println("b") // import each other')
    assert [s.args[0].args[0] for s in load(tmp_path / "a.iml").statements] == ["b", "a"]


def test_table_files(spark, tmp_path):
    (tmp_path / "tables").mkdir()
    (tmp_path / "index.txt").write_text("T.tsv\nBAD.tsv\nMISSING.tsv\n")
    (tmp_path / "tables" / "T.tsv").write_text("NAME\tSCOPE\t[FILL] is\tSCOPE\t[SKIP] DEP\t[SKIP] UID\t\n\n  a  b \tx\tis\ty\t\tu1\t\t\nold\t\t\t\tyes\tu2\n\t\t\t\t\tu3\nno uid\t\t\t\t\t\n")
    (tmp_path / "tables" / "BAD.tsv").write_text("one\ttwo\n")
    s = load_store(spark, str(tmp_path / "index.txt"))
    assert list(s.tables) == ["T"] and s["t"].column("scope") == 3
    rows = s["T"].rows.select("uid", s["T"].text().alias("t")).collect()
    assert [(r.uid, r.t) for r in rows] == [("u1", "a b x is y")]
    assert s.cells().where("role = 'DATA'").count() == 3
    assert sinks.store_documents(s).count() == 1


def test_composite_runs_its_components_with_mapped_instances(spark):
    text = """inferencepattern a require instance thing = [KINDOF:"cat"] row r=[TABLE:"PARTOF", PART:<p>, WHOLE:"cat"] thing."part" = <p> endinferencepattern
      inferencepattern b row q=[TABLE:"PARTOF", PART:<p>] println("b " + <p>) endinferencepattern
      inferencepattern c infpat u = a infpat v = b rowequiv u.r = v.q instmap pet = u.thing musthaveoromit(u.<p> == v.<p>) println("c " + u.<p>) endinferencepattern
      instance felix = [KINDOF:"cat"]
      executePattern(c, 0, [pet->felix])"""
    run = Runtime(spark, store_of(spark), parse(text))
    assert run.run() == 0
    assert run.printed == ["b tail", "c tail"] and run.state.instances["felix"].props == {"part": "tail"}


def test_missing_part_keeps_condition_open(spark):
    m = solve(store_of(spark), one('inferencepattern p row *a=[TABLE:"PARTOF", PART:<x>] row b=[UUID:"k1"] musthaveoromit(<x> == "tail") endinferencepattern'))
    assert {(r.uid_a, r.uid_b) for r in m.collect()} == {("p1", "k1"), (None, "k1")}


REQUIRES = """inferencepattern p require instance thing = [KINDOF:"cat"] row r=[TABLE:"PARTOF", PART:<x>, WHOLE:"cat"] CONDITION println("ran " + <x>) endinferencepattern
  instance felix = [KINDOF:"cat"] instance rover = [KINDOF:"dog"] instance tom = [KINDOF:"cat"]
  felix."age" = 9 tom."age" = 60 rover."age" = 99
"""


def scripted(spark, condition, rest):
    run = Runtime(spark, store_of(spark), parse(REQUIRES.replace("CONDITION", condition) + rest))
    try:
        return run.run(), run.printed
    except ScriptError as e:
        return str(e), run.printed


def test_requirements_are_met_first(spark):
    hold = 'musthave(thing."age" > 50)'
    code, printed = scripted(spark, hold, "executePattern(p, 0, [thing->felix])")
    assert "requirements" in str(code) and printed == []
    assert scripted(spark, hold, "executePattern(p, 0, [thing->tom])") == (0, ["ran tail"])
    assert scripted(spark, hold, "executePattern(p, 0)") == (0, ["ran tail"])  # the map that fits is found
    assert scripted(spark, 'musthaveoromit(thing."age" > 50)', "executePattern(p, 0, [thing->felix])")[1] == []
    assert scripted(spark, 'musthave(<x> == "nothing")', "executePattern(p, 0, [thing->tom])")[1] == []
    assert scripted(spark, 'shouldhave(thing."age" > 50)', "executePattern(p, 0, [thing->felix])") == (0, ["ran tail"])
    assert scripted(spark, 'musthave(thing."height" > 50)', "executePattern(p, 0, [thing->tom])")[1] == []  # can't be evaluated


def test_kind_and_number_of_instances(spark):
    assert scripted(spark, "", "executePattern(p, 0, [thing->rover])")[1] == []  # a dog
    assert "needs 1" in str(scripted(spark, "", "executePattern(p, 0, [thing->felix, other->tom])")[0])
    text = REQUIRES.replace('KINDOF:"cat"] row', 'KINDOF:"dragon"] row').replace("CONDITION", "")
    with pytest.raises(ScriptError):
        Runtime(spark, store_of(spark), parse(text + "executePattern(p, 0)")).run()


def test_kinds_by_words_or_lemmas_of_the_first_alternative(spark):
    run = Runtime(spark, store_of(spark), parse(""))
    assert run.is_kind("dog", "animal") and run.is_kind("Dogs", "animals")  # of the row dogs, animals
    assert run.is_kind("cat", "animal") and not run.is_kind("cat", "pet") and not run.is_kind("animal", "cat")
    assert run.is_kind("rock", "thing") and run.is_kind("Red  rock", "red rock") and not run.is_kind("rock", "animal")


def test_generated_rows_are_found_again_and_removed(spark):
    text = """generateRow([TABLE:"PARTOF", PART:"fin", WHOLE:"fish"]) generateRow([TABLE:"PARTOF", PART:"Fin", WHOLE:"fish"]) generateRow([TABLE:"PARTOF", PART:"gill", WHOLE:"fish"])
      removeRows([TABLE:"PARTOF", PART:"GILL"]) removeRow("p1") removeRow("absent")"""
    s = store_of(spark)
    assert Runtime(spark, s, parse(text)).run() == 0
    assert sorted(r[0][0] for r in s["PARTOF"].rows.select("cells").collect()) == ["fin", "leaf", "paw"]


def test_meets_requirements_follows_instances(spark):
    rest = """var n = 0
      while (meetsRequirements(p, [<x> == "tail"], [thing->felix]) < 1) felix."age" = felix."age" + 20 n = n + 1 endwhile
      println("n " + n)"""
    assert scripted(spark, 'musthave(thing."age" > 50)', rest) == (0, ["n 3.0"])


def test_a_properties_file_runs_an_enumeration(spark, tmp_path):
    from patternloom.runtime import main

    (tmp_path / "tables").mkdir()
    (tmp_path / "index.txt").write_text("PARTOF.tsv\n")
    (tmp_path / "tables" / "PARTOF.tsv").write_text("PART\tWHOLE\t[SKIP] UID\ntail\tcat\tp1\nleaf\ttree\tp2\n")
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.iml").write_text('inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] endinferencepattern')
    (tmp_path / "run.props").write_text(f"tablestoreIndex = {tmp_path}/index.txt\nIMLInputPath = {tmp_path}/in\nIMLOutputPath = {tmp_path}/out\nmaxMatches = 1\nnumThreads = 2\nexportTableStoreHTML = true\n")
    assert main(["--props", str(tmp_path / "run.props")]) == 0
    for name in "ab":
        assert len(json.loads((tmp_path / "out" / f"{name}.iml.json").read_text())["patternMatches"][0]["matches"]) == 1
        assert "leaf" in (tmp_path / "out" / f"{name}.iml.tables.html").read_text()


def test_predictions_reader(spark, tmp_path):
    from patternloom.sources.readers import label_probabilities

    row = {"id": "Mercury_7-1-A__x__ab12-0000-1111-2222", "context": "B: a leaf", "label": 1, "label_predicted": 0, "label_logits": [0.5, 2.0], "label_probs": [0.25, 0.75]}
    (tmp_path / "p.jsonl").write_text(json.dumps(row) + "\nnot json\n\n")
    assert [tuple(r) for r in label_probabilities(spark, str(tmp_path / "p.jsonl")).collect()] == [("Mercury_7-1", "ab12-0000-1111-2222", "a leaf", 0.75, 2.0, True)]


def test_a_condition_of_one_slot_filters_it_before_the_join(spark):
    text = 'inferencepattern p row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] row b=[TABLE:"KINDOF", HYPONYM:<z>, HYPERNYM:<y>] musthaveoromit(<x> == "leaf") endinferencepattern'
    m = solve(store_of(spark), one(text), None)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("leaf") > plan.index("Join") and all(r.v_x == [["leaf"]] for r in m.collect())


def test_solutions_have_words_of_cells_and_relaxations_of_slots(spark):
    s = Store(spark)
    s.add(from_rows(spark, "A", ["W", "L", "[SKIP] UID"], [["Big Cats", "red old widget", "a1"]]))
    s.add(from_rows(spark, "B", ["W", "[SKIP] UID"], [["big cat", "b1"], ["Cat big", "b2"]]))
    p = one('inferencepattern p row a=[TABLE:"A", W:<x>, L: ~"red" + "widget"] row b=[TABLE:"B", W:<x>] row *c=[TABLE:"B", W:<~x>] endinferencepattern')
    docs = [json.loads(r.json) for r in sinks.match_documents(p, solve(s, p), s).collect()]
    assert len(docs) == 3
    for d in docs:
        assert [x["relaxedCount"] for x in d["slots"]] == ["1", "0", "0"]
        assert d["variables"] == [{"name": "x", "value": "big cat"}] and d["variablesOrigTextInferred"] == [{"name": "x", "value": "Big Cats"}]
    row = solve(s, one('inferencepattern p row a=[TABLE:"A", W:<x>] row b=[TABLE:"B", W:<~x>] endinferencepattern')).where("uid_b = 'b1'").first()
    assert row.o_x == "Big Cats" and row.v_x == [["big"], ["cat"]] or row.v_x[1] == ["cat"]


def chain_rule(n):
    steps = [[f"w{k}", f"w{k + 1}", f"p{k}"] for k in range(n)]
    text = """inferencepattern far executionmode = "AUTO" row a=[TABLE:"FAR", PART:<x>, WHOLE:<y>] row b=[TABLE:"NEXT", PART:<y>, WHOLE:<z>] row *c=[TABLE:"NEXT", PART:<x>]
      generateRow([TABLE:"FAR", PART:<x>, WHOLE:<z>]) endinferencepattern executeAutoPatterns"""
    return steps, text


def test_rules_run_round_by_round(spark, monkeypatch):
    """Each round adds one step; a rule that is not done by the last round fails."""
    from patternloom import runtime

    def run(n):
        steps, text = chain_rule(n)
        s = Store(spark)
        for name in ("FAR", "NEXT"):
            s.add(from_rows(spark, name, ["PART", "WHOLE", "[SKIP] UID"], steps[:1] if name == "FAR" else steps))
        r = Runtime(spark, s, parse(text))
        r.run()
        return {tuple(r.cells[:2]) for r in s["FAR"].rows.collect()}

    assert run(10) == {("w0", f"w{k}") for k in range(1, 11)}  # more than eight rounds: the table is written down once
    monkeypatch.setattr(runtime, "AUTO_ROUNDS", 3)
    with pytest.raises(ScriptError, match="still add rows"):
        run(6)


def test_a_closure_that_is_not_done_fails(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)], "src int, dst int")
    with pytest.raises(RuntimeError, match="not complete"):
        transitive_closure(e, rounds=2)


def test_patterns_share_tables_and_slots(spark, monkeypatch):
    """Each table is annotated once, equal slots are solved once, and the solutions are those of patterns alone."""
    from patternloom.plans import compile as plans
    from patternloom.sources.tablestore import Table

    text = """inferencepattern p row a=[TABLE:"KINDOF", HYPONYM:<x>, HYPERNYM:<w>] row b=[TABLE:"PARTOF", PART:<y>, WHOLE:<x>] endinferencepattern
      inferencepattern q row k=[TABLE:"KINDOF", HYPONYM:<n>, HYPERNYM:<m>] row *b=[TABLE:"PARTOF", WHOLE:<n>] endinferencepattern
      inferencepattern r row k=[UUID:"k1", HYPONYM:<n>] row c=[TABLE:"PARTOF", PART:<y>, WHOLE:<n>] endinferencepattern"""
    program, calls, solved = parse(text), [], []
    annotated, fitting = Table.annotated, plans.fitting
    monkeypatch.setattr(Table, "annotated", lambda t, *a, **k: calls.append(t.name) or annotated(t, *a, **k))
    monkeypatch.setattr(plans, "fitting", lambda store, name, *a: solved.append(name) or fitting(store, name, *a))
    key = lambda rows: sorted(repr(r) for r in rows)
    s = store_of(spark)
    found, told = enumerate_patterns(spark, s, program, 100)
    assert sorted(calls) == ["KINDOF", "PARTOF"] and sorted(solved) == ["KINDOF", "KINDOF", "PARTOF", "PARTOF"] and told["patterns"] == 3
    alone = s.with_rows({name: t.rows for name, t in s.tables.items()})
    for p, m in found:
        assert key(m.collect()) == key(solve(alone, p, 100).collect())
    s = store_of(spark)
    plans.share(s, program.patterns)
    solve(s, program.patterns[0])
    s.remove(spark.createDataFrame([("k1",)], "uid string"))  # an edit ends what is shared
    assert {r.uid_a for r in solve(s, program.patterns[0]).collect()} == {"k3"}
