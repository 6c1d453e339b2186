"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables; the others give rows."""

import os

import pytest
from pyspark.sql import functions as F

from inkwell.functions.spell import distance
from inkwell.operators import native as N
from inkwell.operators import reports as R
from inkwell.plans import catalogue

AT = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(AT):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{AT}/{f}')")
    return c


def _norm(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("~" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.skipif(not os.path.isdir(AT), reason="the test tables aren't here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, AT)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns) and _norm(rows, df.columns) == _norm(want.fetchall(), want.columns)
    else:
        assert rows


def test_native_operators_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "the The cat"), (2, None), (3, ""), (4, "x"), (1, "a a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.pos, r.token) for r in N.repetitions(df, "doc_id", "text").collect()) == [(1, 1, "a"), (1, 1, "the")]
    assert N.count_matches(df, "text", ["cat"]).count() == 1 and N.spans(df, "doc_id", "text", r"\bcat\b").first().begin_at == 8
    assert N.occurrences(df, "doc_id", "text", "[a-z]", least=1).collect() == [(3, 0)]
    for op in (N.repetitions(df.limit(0), "doc_id", "text"), N.matches(df.limit(0), "doc_id", "text", ["a"]), N.undefined(N.lines(df.limit(0), "doc_id", "text"), "doc_id", "block_seq", "block", "(a)", "(b)")):
        assert op.collect() == []


def test_reports(spark, tmp_path):
    cols = "alert_id long, path string, line int, line_no int, col_begin int, check_name string, severity string, message string"
    a = spark.createDataFrame([(1, "b", 1, 1, 2, "S.A", "error", "m"), (2, "a", 3, 3, 1, "S.B", "warning", "n"), (3, "a", 3, 3, 1, "S.B", None, None)], cols)
    assert R.exit_status(a) == 1 and R.exit_status(a.where("severity = 'warning'")) == 0 and {r.severity: r.n for r in R.totals(a).collect()} == {"error": 1, "warning": 1, None: 1}
    assert R.first_at_place(a, ["path", "line_no", "col_begin", "check_name"], ["alert_id"]).count() == 2 and R.at_least(a, "error").count() == 1
    assert R.render(a.where("alert_id < 3"), "{path}|{line}:{col} {severity} {check} {message}|-", "path") == "a\n3:1 warning S.B n\n-\nb\n1:2 error S.A m\n-"
    R.write_json(a, "path", str(tmp_path / "j"))
    R.write_table(a, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_pushdown_and_plans(spark):
    plan = QUERIES["rules_enabled"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(severity" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    plan = QUERIES["existence_count"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan and "Python" not in plan


def test_closest_ranks_the_whole_dictionary(spark):
    terms = ["index", "heading", "éclair", "a-b", "list", "lists", "wörterbuch", "table"]
    d = spark.createDataFrame([(t,) for t in [*terms, "list", None]], "term string")
    words = ["qqqqqqqqqqqq", "Lsit", "ecl", "list", "", "Lsit", "A-c", None]
    df = spark.createDataFrame([(w,) for w in words], "word string")

    def by_hand(w, ts, k):
        got = sorted(ts, key=lambda t: (distance(w, t) / max(len(w), len(t), 1), t))[:k]
        return [t[:1].upper() + t[1:] if w[:1] == w[:1].upper() else t for t in got]

    for block in (3, 4096):
        rows = N.closest(df, [d], block=block).collect()
        for w in {*words} - {None, "A-c"}:
            assert [r.term for r in sorted(rows, key=lambda r: r.place) if r.word == w] == [t if t != "A-b" else "A-B" for t in by_hand(w, terms, 5)]
        assert next(r for r in rows if r.word == "list" and r.place == 1).similarity == 1.0
    two = N.closest(df, [d, spark.createDataFrame([("lost",), ("lust",)], "term string")]).where("word = 'Lsit'").orderBy("place").collect()
    assert len(two) == 6 and {"Lost", "Lust"} <= {r.term for r in two}
    assert N.closest(df, [d.limit(0)]).collect() == [] == N.closest(df.limit(0), [d]).collect()


def test_suggestions_for_words_far_from_all_terms(spark):
    words = spark.read.parquet(f"{AT}/alerts.parquet").where("match_text IS NOT NULL").select("match_text").distinct().count()
    got = {r["count"] for r in QUERIES["spelling_ranked"](spark, AT).groupBy("word").count().collect()}
    assert got == {5} and QUERIES["spelling_ranked"](spark, AT).select("word").distinct().count() == words


def test_solutions_of_all_actions(spark):
    rows = [
        ("replace", ["a", "b"], "x", ["a", "b"], None), ("remove", None, "x", [""], None), ("edit", ["split", ".", "1"], "a.b .c", ["b"], None), ("edit", ["split", "", "2"], "abc", ["c"], None),
        ("edit", ["split", ".", "3"], "a.b", [], "index out of range"), ("edit", ["split", ".", "-1"], "a.b", [], "index out of range"), ("edit", ["split", ".", "x"], "a.b", [], 'strconv.Atoi: parsing "x": invalid syntax'),
        ("edit", ["regex"], "x", [], "invalid number of parameters"), ("edit", ["regex", "(a)(?P<n>b)?", "<${1}$n$9$$>"], "abca", ["<ab$>c<a$>"], None), ("edit", ["regex", "x*", "-"], "abxd", ["-a-b-d-"], None),
        ("edit", ["trim", "*_"], "*_a*", ["a"], None), ("edit", ["trim_left", "."], "..a.", ["a."], None), ("edit", ["trim_right", "."], "..a.", ["..a"], None), ("edit", ["truncate", "(s"], "a(s)", ["a"], None),
        ("edit", ["other"], " a ", ["a"], None), ("edit", [], "x", [], "no parameters"), ("edit", None, "x", [], "no parameters"), ("convert", ["simple"], "A B", ["a b"], None), ("convert", ["else"], "A B", ["A B"], None),
        ("suggest", ["spellings"], "Lsit", ["List", "Lists", "Table"], None), ("suggest", ["my.tengo"], "x", [], "script 'my.tengo' not found"), ("suggest", ["spellings"], "lists", ["lists", "list", "table"], None), ("other", [], "x", [], "unknown action 'other'"),
    ]
    a = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)] + [(0, *rows[0][:3]), (99, None, None, "x")], "alert_id long, action_name string, action_params array<string>, match_text string")
    got = R.solutions(a, [spark.createDataFrame([("list",), ("lists",), ("table",)], "term string")]).collect()
    assert {r.alert_id: (r.action_name, r.suggestions, r.error) for r in got} == {i: (r[0], r[3], r[4]) for i, r in enumerate(rows)} and len(got) == len(rows)


def test_solutions_of_the_tables(spark):
    alerts = spark.read.parquet(f"{AT}/alerts.parquet").where("action_name IS NOT NULL")
    got = QUERIES["alert_solutions"](spark, AT).collect()
    assert len(got) == alerts.select("alert_id").distinct().count() and {"edit", "replace", "suggest"} <= {r.action_name for r in got}
    assert {len(r.suggestions) for r in got if r.action_name == "suggest"} == {5} and {r.error for r in got if r.action_name == "edit"} == {"invalid number of parameters"}


def test_pages_by_extension_or_content(spark):
    rows = [(".html", None, "x"), (None, ".HTM", "x"), (".zzz", ".html", "x"), (None, None, " <!-- a -->\n<!DOCTYPE html><p>"), (None, ".zzz", "<html lang=en>"), (".md", ".html", "<html>"), (None, ".rst", "<html>"), (None, None, "# a <html>"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, t string")
    assert [r.p for r in df.select(catalogue.is_page("a", "b", "t").alias("p")).collect()] == [True] * 5 + [False] * 4


def test_line_starts_of_any_file(spark):
    df = spark.createDataFrame([(1, "é\n\nab"), (2, ""), (3, None), (4, "x\n")], "k long, t string")
    assert sorted(map(tuple, N.line_starts(df, "k", "t").collect())) == [(1, 1, 0), (1, 2, 2), (1, 3, 3), (2, 1, 0), (4, 1, 0), (4, 2, 2)]
    n = spark.read.parquet(f"{AT}/files.parquet").where("file_content IS NOT NULL").select("file_id").distinct().count()
    assert QUERIES["line_starts"](spark, AT).select("file_id").distinct().count() == n


def test_nearest_finds_all_within_two_edits(spark):
    import random

    r = random.Random(4)
    terms = sorted({"".join(r.choice("abcé") for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 14, 15, 16, 17, 18, 19, 20, 25, 60) for _ in range(12)})
    words = []
    for t in terms:
        for _ in range(3):
            w = list(t)
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(w))
                w[at : at + r.randint(0, 1)] = r.choice(["", "a", "x"])
            words.append("".join(w))
    words = sorted(set(words))
    got = {(x.word, x.term, x.edits) for x in N.nearest(spark.createDataFrame([(w,) for w in words + [None]], "word string"), spark.createDataFrame([(t,) for t in terms + [None]], "term string"), k=10_000).collect()}
    assert got == {(w, t, e) for w in words for t in terms if w != t and (e := distance(w, t)) <= 2}


def test_scopes_meet_rules_as_in_scope_says(spark):
    from inkwell.plans.rules import in_scope

    scopes = ["text.md", "text.heading.h1.md", "sentence.text.md", "raw.md", "summary.md", "text.table.cell.md", "text.table.header.md", "paragraph.text.md", "meta.md", "sentence.text.list.md"]
    entries = ["text", "heading", "~heading & text", "~table.header & text", "~heading", "sentence", "sentence & ~list", "raw", "summary", "table.cell", "~raw", "h1.heading"]
    s = spark.createDataFrame([(x,) for x in scopes + [None]], "scope_path string")
    rules = spark.createDataFrame([(f"R{i}", e) for i, e in enumerate(entries)], "check_name string, scope_path string")
    got = {(r.scope_path, r.check_name) for r in N.scope_matches(s, rules).collect()}
    assert got == {(x, f"R{i}") for x in scopes for i, e in enumerate(entries) if in_scope((e,), x)}


def test_expressions_in_native_rules(spark):
    df = spark.createDataFrame([(1, "An e-mail, email or E-Mail, foo and bar."), (2, None)], "doc_id long, text string")
    assert N.count_matches(df, "text", ["e-?mail", "foo|bar"]).first().n == 5
    masked = df.select(N.mask_phrases(F.col("text"), ["e-?mail", "foo"]).alias("t")).first().t
    assert masked == "An ******, ***** or E-Mail, *** and bar."
