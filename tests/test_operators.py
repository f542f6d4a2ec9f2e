"""Operators that SQL can't express against plain Python, and sources against small files."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import markup, strings
from weftgraph.operators import catalog, issues, joins, records, reports, views
from weftgraph.sources import archives


def wiki(text):
    """The rules in plain Python, one after the other."""
    if not (text or "").strip():
        return ""
    quoted = lambda s: s.strip().replace("\n", "\n> ")
    text = re.sub(markup.CODE, lambda m: f"```{(m[1] or '').strip()}\n{m[2].strip()}\n```", text)
    text = re.sub(markup.NOFORMAT, lambda m: f"```\n{m[1].strip()}\n```", text)
    text = re.sub(markup.PANEL, lambda m: f"> {f'**{m[1].strip()}**' + chr(10) if m[1] else ''}> {quoted(m[2])}", text)
    text = re.sub(markup.QUOTE, lambda m: f"> {quoted(m[1])}", text)
    text = re.sub(markup.COLOR, r"\1", text)
    for name, mark in markup.NOTES:
        text = re.sub(rf"(?s)\{{{name}[^}}]*\}}(.*?)\{{{name}\}}", lambda m, mark=mark: f"> {mark} {m[1].strip()}", text)
    out = []
    for line in text.split("\n"):
        if m := re.match(markup.HEADING, line):
            line = "#" * int(m[1]) + " " + m[2].strip()
        if line.lstrip().startswith("||"):
            cols = [c.strip() for c in line.split("||") if c]
            line = "| " + " | ".join(cols) + " |\n| " + " | ".join("---" for _ in cols) + " |"
        elif line.lstrip().startswith("|"):
            line = "| " + " | ".join(c.strip() for c in line.strip().strip("|").split("|")) + " |"
        for pattern, mark in ((markup.BULLET, "- "), (markup.NUMBERED, "1. ")):
            if m := re.match(pattern, line):
                line = "  " * (len(m[1]) - 1) + mark + m[2].strip()
        for pattern, shown in markup.INLINE:
            line = re.sub(pattern, shown.replace("$1", r"\1").replace("$2", r"\2"), line)
        out.append(line)
    return "\n".join(out).rstrip()


def test_wiki_markup(spark):
    texts = ["h1. A\nh3. *B* -c-\n* x\n** y_z_\n# n\n## m", "||a|| b||\n|c| d |\n", "{code:sql}\nselect 1\n{code} and {code}x{code}", "{noformat}raw *b*{noformat}\n{panel:title= T }a\nb{panel}{panel}c{panel}", "{quote}q\nr{quote}\n{color:red}z{color} {tip}t{tip}{warning:x}w{warning}", "[a|http://b] [http://c] !p.png|width=3! {{m}} +u+ **k** __l__ --d--", None, "  \n", "plain $1 and \\ text", "{quote}open", "a\n\n"]
    got = [r["m"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", markup.wiki_to_markdown(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [wiki(t) for t in texts]


def plain_identifiers(text, weight):
    code_name = re.compile(issues.CODE_NAME.replace(r"\x{4E00}-\x{9FFF}", "一-鿿"))
    keys = [m.span() for m in re.finditer(issues.ISSUE_KEY, text)]
    out, covered = [], []

    def ok(at, code):
        around = text[max(0, at - issues.WINDOW) : at + len(code) + issues.WINDOW]
        bad = any(s <= at < e for s, e in keys) or any(w in around.lower() for w in issues.OTHER_WORDS) or re.search(issues.DATE, around.lower())
        return around if not 1900 <= int(code) <= 2100 and 1000 <= int(code) <= 999999 and not bad else None

    for m in code_name.finditer(text):
        name = m[2].strip("-_.,，。)([]")
        if ok(m.start(), m[1]) is not None and name:
            out.append((m.start(), m[1], name, round(min(0.99, weight + 0.15), 6), m[0]))
            covered.append(m.span())
    for m in re.finditer(issues.CODE_ONLY, text):
        around = ok(m.start(), m[1])
        if not any(s <= m.start() < e for s, e in covered) and around is not None and any(w in around.lower() for w in issues.FEATURE_WORDS):
            out.append((m.start(), m[1], None, round(max(0.0, min(0.85, weight - 0.08)), 6), around))
    return out


def test_issue_identifiers(spark):
    texts = ["menu 1234-Orders and 4321 feature", "ABC-1234 menu 5555", "in 2024 the menu 1999 and 2024-12-31 menu 7777 is far away from all of that, really 8888 menu", "報表 3456－維護作業 查詢 9876", "version 4444 menu", "4444", "", None, "1234 - (x) menu 123456-ab", "é1234 menu 12345678 menu 00123 menu", "menu 1000-Name 1000-Name", "feature 777777 and 1234 - _-_ feature"]
    rows = [(i, t, "summary" if i % 2 else "comment") for i, t in enumerate(texts)]
    got = issues.identifiers(spark.createDataFrame(rows, "i int, t string, s string"), "i", "t", "s").collect()
    for i, t, s in rows:
        mine = sorted((r["at"], r["code"], r["name"] or "", round(r["confidence"], 6), r["evidence"]) for r in got if r["id"] == i)
        assert mine == sorted((a, c, n or "", w, e) for a, c, n, w, e in plain_identifiers(t or "", issues.SOURCES[s])), t


def test_run_states(spark):
    allowed = {"": ("new",), "new": ("run", "stop"), "run": ("done", "new")}
    log = [("a", 1, "new"), ("a", 2, "done"), ("a", 3, "run"), ("a", 4, "done"), ("b", 1, "run"), ("c", 2, "new"), ("c", 1, "stop")]
    for stretch in (1, 2, 100_000):
        got = {r["k"]: (r["state"], r["rejected"]) for r in records.latest_state(spark.createDataFrame(log, "k string, n int, state string"), "k", "n", allowed, stretch).collect()}
        assert got == {"a": ("done", 1), "b": ("", 1), "c": ("new", 1)}


def test_redaction_cases(spark):
    """The closing quote of a JSON secret stays; blanks before a separator are no match, as the pattern says."""
    cases = {'{"apiKey": "x1"}': '{"apiKey": "[REDACTED]"}', "Bearer abc, next": "Bearer [REDACTED], next", "token=1;x": "token=[REDACTED];x", "token = 1": "token = 1", "https://u:pw@h/x": "https://u:[REDACTED]@h/x", "api_key: z": "api_key: [REDACTED]"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", strings.redact_secrets(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == cases


def test_ad_hoc_selects(spark):
    n = spark.createDataFrame([("a", "File", "x")], "id string, kind string, name string")
    e = spark.createDataFrame([("CALLS", "a", "a", 1, "e")], "type string, src string, dst string, occurrence_count int, edge_id string")
    assert views.select_graph(n, e, "SELECT name FROM graph_nodes WHERE name <> 'drop; it'", 5).collect()[0]["name"] == "x"
    n.createOrReplaceTempView("other")
    for bad in (
        "DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "", "SET x = 1", "CACHE TABLE graph_nodes", "EXPLAIN SELECT 1", "SHOW TABLES", "nonsense",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM other", "SELECT * FROM default.graph_nodes", "SELECT (SELECT max(id) FROM other) AS m FROM graph_nodes",
        "SELECT * FROM graph_nodes WHERE id IN (SELECT id FROM other)", "WITH other2 AS (SELECT * FROM other) SELECT * FROM other2", "SELECT * FROM (WITH a AS (SELECT 1 AS x) SELECT * FROM a) JOIN a", "SELECT * FROM range(9)",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'exit', 1) FROM graph_nodes", "SELECT transform(array(1), x -> reflect('a', 'b')) AS t FROM graph_nodes",
    ):
        with pytest.raises(ValueError):
            views.select_graph(n, e, bad, 5)
    for good, rows in (
        ("SELECT name AS `set`, id AS `use`, kind AS `drop` FROM graph_nodes;", 1), ("WITH a AS (SELECT * FROM graph_nodes), b AS (SELECT * FROM a) SELECT * FROM b JOIN a USING (id)", 1), ("SELECT 1 AS x UNION ALL SELECT 2", 2),
        ("SELECT kind, count(*) OVER (PARTITION BY kind) AS n FROM Graph_Nodes n WHERE EXISTS (SELECT 1 FROM graph_edges e WHERE e.src = n.id) ORDER BY 1", 1), ("VALUES (1), (2)", 2),
        ("SELECT kind, count(*) AS n FROM graph_nodes GROUP BY kind HAVING n > 0", 1), ("WITH RECURSIVE r AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM r WHERE x < 3) SELECT * FROM r", 3),
    ):
        assert views.select_graph(n, e, good, 5).count() == rows
    with pytest.raises(ValueError):
        views.canonical(["File", "Nothing"], ["File"])
    assert views.canonical([" file", "FILE"], ["File"]) == ["File"] and views.facet_filters([("Node-Category", ["type", "METHOD", " "]), ("edge-type", ["calls"]), ("", ["x"]), ("edge-type", None)]) == (["Type", "Method"], ["CALLS"])
    for bad in ([("code", [])], [("edge-type", ["File"])]):
        with pytest.raises(ValueError):
            views.facet_filters(bad)
    with pytest.raises(ValueError):
        records.choose_one(["a", "b"], None)


def test_selected_subgraph(spark):
    n = spark.createDataFrame([(i, "File", i) for i in "abcdef"], "id string, kind string, name string")
    e = spark.createDataFrame([("CALLS", "a", "b", 1, "1"), ("CALLS", "c", "d", 1, "2"), ("CALLS", "e", "e", 1, "3")], "type string, src string, dst string, occurrence_count int, edge_id string")

    def of(rows, limit):
        shown, links = views.selected_subgraph(spark.createDataFrame(rows, "x string, y string, z int"), n, e, limit)
        return "".join(sorted(r["id"] for r in shown.collect())), "".join(r["edge_id"] for r in links.collect())

    assert of([("a", "1", 1), ("f", None, 2)], 9) == ("abf", "1")  # b is added as an end
    assert of([("a", "1", 1), ("f", "2", 2)], 3) == ("abf", "1")  # no room for the second edge's ends
    assert of([("a", "b", 1), ("1", "f", 2)], 2) == ("ab", "1")
    assert of([("3", "zz", 1)], 9) == ("e", "3") and of([(None, None, 1)], 9) == ("", "")


def test_references_in_sql(spark):
    o = spark.createDataFrame([("dbo", "T", "Table"), ("x", "T", "View"), ("dbo", "P", "StoredProcedure")], "space string, name string, type string")
    t = spark.createDataFrame([(1, "select * from [x].[t] -- dbo.P\n/* T */ exec p; insert into nope.T values"), (2, None), (3, "")], "id int, q string")
    got = {(r["id"], r["space"], r["name"], r["access"]) for r in catalog.references(t, "id", "q", o).collect()}
    assert got == {(1, "x", "T", "READ"), (1, "dbo", "P", "CALL"), (1, "dbo", "T", "WRITE")}


def test_archives(spark, tmp_path):
    def packed(files):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return box.getvalue()

    rows = [("a.zip", packed({"x.txt": "one", "../up.txt": "no", "d/y.txt": "two"})), ("b.zip", b"broken"), ("c.docx", packed({"word/document.xml": "<w:document><w:p><w:r><w:t>A &amp; b</w:t></w:r><w:r><w:t xml:space='p'> c</w:t></w:r></w:p><w:p w:x='1'><w:t>d</w:t></w:p></w:document>"}))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r["archive"], r["entry"]): (r["content"] and bytes(r["content"]).decode(), r["problem"]) for r in archives.zip_entries(df.where("path like '%.zip'")).collect()}
    assert got == {("a.zip", "x.txt"): ("one", None), ("a.zip", "../up.txt"): (None, "outside"), ("a.zip", "d/y.txt"): ("two", None), ("b.zip", None): (None, "no zip")}
    assert {r["path"]: r["text"] for r in archives.docx_text(df).collect()} == {"a.zip": None, "b.zip": None, "c.docx": "A & b c\nd"}
    archives.save_records(spark.createDataFrame([("k1", 1)], "key string, v int"), "key", f"file://{tmp_path}/out")
    assert [json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.json")] == [{"key": "k1", "v": 1}]
    skills = spark.createDataFrame([("a", "---\nname: x\ndescription: y\n---\n"), ("b", "none"), ("c", "---\nname: x\n---\n")], "path string, text string")
    assert {r["path"]: r["problem"] for r in archives.skill_problems(skills).collect()} == {"a": None, "b": "no front matter", "c": "no description"}


def test_paged_source(spark):
    def fetch(page):
        return [(i, f"r{i}") for i in range(page * 10, min(page * 10 + 10, 25))]

    assert sorted(tuple(r) for r in archives.paged_source(spark, "fixture", fetch, "id long, name string", 25, 10).collect()) == [(i, f"r{i}") for i in range(25)]


def test_words_meet_each_text_once(spark):
    """Repeated texts and words count as often as they come; neither the exploded texts nor the rows are broadcast."""
    texts = spark.createDataFrame([(1, "Blue Ring"), (1, "blue ring"), (2, "x"), (3, ""), (4, None)], "id int, t string")
    words = spark.createDataFrame([(7, "RING"), (8, "ring"), (8, "ring"), (9, "x"), (9, "e r"), (10, ""), (11, None)], "w int, word string")
    got = joins.containing(texts, "id", "t", words, "w", "word")
    assert sorted(tuple(r) for r in got.collect()) == sorted([(1, 7), (1, 8), (1, 8), (1, 9)] * 2 + [(2, 9)])
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_bindings_meet_once(spark):
    """A thousand bindings and a thousand parameters of one name make a thousand rows, not a million, before they are told apart."""
    bound = spark.range(1000).selectExpr("id as method", "'DBO' as space", "'P' as object", "'@A' as name")
    parameters = spark.range(1000).selectExpr("'dbo' as space", "'p' as object", "if(id % 2 = 0, '@a', '@A') as parameter")
    got = reports.parameter_bindings(bound, parameters)
    assert got.count() == 2000 and {r["parameter"] for r in got.collect()} == {"@a", "@A"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3  # both sides and the result


def test_owner_among_methods_of_the_same_lines(spark):
    """Many methods with the same lines are one before the lines are spread; the spread side is not broadcast."""
    calls = spark.createDataFrame([("F", 5), ("f", 70), ("g", 1)], "path string, line int")
    methods = spark.range(300).selectExpr("'f' as path", "1 as first", "100 as last", "lpad(cast(id as string), 3, '0') as method").unionByName(spark.createDataFrame([("F", 60, 80, "inner")], "path string, first int, last int, method string"))
    got = reports.method_at(calls, methods)
    assert {tuple(r) for r in got.collect()} == {("F", 5, "000", "METHOD"), ("f", 70, "inner", "METHOD"), ("g", 1, "g", "FILE")}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_constants_of_one_place(spark):
    """Of constants with the same place the smallest, in whatever order they come."""
    formats = spark.createDataFrame([(1, "x")], "format int, category string")
    for order in (["c", "a", "b"], ["b", "c", "a"], ["a", "b", "c"]):
        rows = spark.createDataFrame([("x", c, 5) for c in order] + [("x", "0", 6)], "value string, constant string, seq int").coalesce(1)
        assert reports.category_constants(formats, rows).first()["constant"] == "a"


def test_menu_actions_reach_all_methods_of_a_type(spark):
    """Both methods of each controller type that a menu names."""
    from weftgraph.plans import registry

    got = registry.QUERIES["menu_routes"](spark, "/root/testdata/sf0.001").where("relation = 'NAVIGATES_TO_ACTION'")
    assert {r["target"] for r in got.where("menu = 6").collect()} == {"m0", "m6"}
    assert {r["count"] for r in got.groupBy("menu").count().collect()} == {2}
