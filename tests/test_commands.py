import json

from inkwell.__main__ import main
from inkwell.functions.spell import Dictionary, suggestions
from inkwell.operators import commands as C
from inkwell.operators import reports as R
from inkwell.operators.lint import lint_document
from inkwell.operators.matching import Program
from inkwell.plans.config import Config
from inkwell.plans.rules import parse_rule
from inkwell.sources.blocks import Source, data_blocks, document_blocks, extract_blocks


def test_places_in_the_text_as_stored(spark):
    text = "It&rsquo;s bad\r\nand bad.\r\rThe&rsquo;x bad."
    s = Source(text)
    assert s.text == "It's bad\nand bad.\n\nThe'x bad."
    r = parse_rule("S.R", {"extends": "existence", "message": "x", "tokens": ["bad"]})
    got = [(a[0], a[1]) for a in lint_document(text, ".txt", "x", Program([r], Config(styles=["S"])))]
    assert sorted(got) == [(1, 12), (2, 5), (4, 13)]
    b = extract_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"), ext="'.txt'").first()
    for x in b.runs:
        assert text[x.src : x.src + x.n - 1].replace("\r", "\n") == b.text[x.at : x.at + x.n - 1]  # what was rewritten ends a run


def test_inline_scopes_only_where_asked():
    text = "Some **strong one**, *soft* and [a label](http://x.y) with `code x`.\n"
    page = "<p>Some <b>strong one</b>, <i>soft</i> and <a href='x'>a label</a> with <code>code x</code>.</p>"
    for ext, t in ((".md", text), (".html", page)):
        assert not any(b.scope.startswith(("link", "strong")) for b in document_blocks(t, ext, Config()))
        got = {(b.scope, b.text) for b in document_blocks(t, ext, Config(inline=True), False)}
        assert {(f"strong{ext}", "strong one"), (f"emphasis{ext}", "soft"), (f"link{ext}", "a label"), (f"code{ext}", "code x")} <= got
    r = parse_rule("S.R", {"extends": "existence", "message": "x", "tokens": ["label", "code"], "scope": ["link", "code"]})
    assert [(a[0], a[1], a[8]) for a in lint_document(text, ".md", "x", Program([r], Config(styles=["S"], inline=True)))] == [(1, 36, "label"), (1, 61, "code")]


def test_toml_values():
    assert [(b.scope, b.text) for b in data_blocks('a = "one"\n[t]\nb = ["two"]\n', ".toml")] == [("text.a.toml", "one"), ("text.t_b_0.toml", "two")] and data_blocks("a = [", ".toml") == []


def test_metrics_and_counts(spark):
    text = "# Head\n\n## Two\n\nOne two three. Four.\n\n- item\n- item\n\n> quote\n"
    got = C.metrics(text)
    assert got["heading_h1"] == got["heading_h2"] == got["blockquote"] == got["paragraphs"] == 1 and got["list"] == 2 and got["words"] == 7 and C.metrics("x", ".txt") == {} == C.metrics(None)
    rows = C.document_metrics(spark.createDataFrame([(1, text), (2, None), (None, "x")], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.metrics) > 5 for r in rows} == {1: True, 2: False}


def test_rule_tests(tmp_path, capsys):
    (tmp_path / "S").mkdir()
    (tmp_path / "S" / "R.yml").write_text("extends: existence\nmessage: \"'%s'\"\ntokens: [bad]\n")
    (tmp_path / "S" / "R.test.yml").write_text(
        "- {name: a, input: 'a bad one', rule: R.yml, want: \"1:3:S.R:'bad'\"}\n- {name: b, input: good, rule: R.yml, contains: bad}\n- {name: c, input: bad, rule: R.yml, absent: [S.R]}\n- {name: d, input: x, rule: R.yml}\n- {name: e, input: x, rule: Q.yml, want: ''}\n- {name: f, input: bad, want: x}\n"
    )
    got = C.run_tests(str(tmp_path))
    assert [(r.name, r.passed) for r in got] == [("a", True), ("b", False), ("c", False), ("d", False), ("e", False), ("f", False)] and "-x" in got[5].diff
    rule = str(tmp_path / "S" / "R.yml")
    assert main(["compile", rule]) == 0 and json.loads(capsys.readouterr().out)["pattern"] == r"(?m)\b(?:bad)\b"
    (tmp_path / "x.md").write_text("# a bad one\n")
    assert main(["run", rule, str(tmp_path / "x.md")]) == 0 and capsys.readouterr().out.endswith("x.md:1:5:Test.Rule:'bad'\n")
    assert main(["ls-metrics", str(tmp_path / "x.md")]) == 0 and main(["tag", str(tmp_path / "x.md")]) == 0 and main(["ls-config"]) == 0 and main(["transform", str(tmp_path / "x.md")]) == 0
    assert main(["test", str(tmp_path)]) == 1 and main(["compile", str(tmp_path / "none.yml")]) == 2
    (tmp_path / "S" / "B.yml").write_text("extends: nothing\nmessage: x\n")
    capsys.readouterr()
    assert main(["compile", str(tmp_path / "S" / "B.yml")]) == 2 and "extends" in json.loads(capsys.readouterr().err)["Text"]


def test_fixes():
    d = Dictionary({"list", "lists", "table"})
    assert C.fix({"Match": "lsit", "Action": {"Name": "suggest", "Params": ["spellings"]}}, [d])["suggestions"][0] == "list" and suggestions("lsit", [d, Dictionary({"lost"})])[:2] == ["list", "lost"]
    assert C.fix({"Match": "x", "Action": {"Name": "replace", "Params": ["y"]}}) == {"suggestions": ["y"], "error": ""} and C.fix({})["error"]


def test_report_by_partition(spark):
    a = spark.createDataFrame([("b", 1, 2, "error", "S.A", "m"), ("a", 3, 1, "warning", "S.B", "n"), ("a", 2, 1, "warning", "S.B", "n")], "path string, line int, col_begin int, severity string, check_name string, message string")
    lines = [r.report_line for r in R.rendered(a, "{path}|{line}:{col} {message}|-", "path").collect()]
    at = lines.index("a")
    assert lines[at : at + 4] == ["a", "2:1 n", "3:1 n", "-"] and sorted(lines) == sorted(["a", "2:1 n", "3:1 n", "-", "b", "1:2 m", "-"])
    assert R.rendered(a.limit(0), "{path}|x|y", "path").collect() == []


def test_scripts_end_in_time(monkeypatch):
    import pytest

    from inkwell.operators import matching as M
    from inkwell.plans.rules import RuleError

    monkeypatch.setattr(M, "SCRIPT_LIMIT", 0.2)

    def endless(text):
        while True:
            pass

    with pytest.raises(RuleError):
        M.script(parse_rule("S.R", {"extends": "script", "message": "x", "script": endless}), Config())("x", M.State())
    page = '<img class="the dog" alt="the dog">'
    b = document_blocks(page, ".html", Config(), False)[0]
    assert b.text == "the dog" and page[b.source(0) :].startswith("the dog")


def test_comments_by_language(spark):
    from inkwell.sources.blocks import code_blocks

    of = lambda t, e: [b.text for b in code_blocks(t, e)]
    py = '#!/bin/x\n"""Module."""\nx = """no"""\ndef f():  # why\n\n    """Doc.\n\n    More."""\n    y = f("# no")\n    """not one"""\n'
    assert of(py, ".py") == ["Module.", "why", "Doc.\n\nMore."]
    assert of("# one\n// two\n/* three */ $x = '# no';", ".php") == ["one\ntwo", "three"] and of('#= a\n b =# x = "# no" # c', ".jl") == ["a\nb", "c"] and of("<# a #> $x # b", ".ps1") == ["a", "b"]


def test_suggesting_scripts_and_summary(spark, monkeypatch):
    from inkwell.functions import text as X

    monkeypatch.setitem(X.ACTIONS, "own", lambda m: [m.upper(), m * 2])
    assert X.solution("a", "suggest", ["own"]) == (["A", "aa"], None) and X.solution("a", "suggest", ["none"])[1]
    a = spark.createDataFrame([("error",), ("warning",), ("warning",), (None,)], "severity string")
    assert R.summary(a, 1) == "\u2716 1 error, 2 warnings and 0 suggestions in 1 file." and R.summary(a.limit(0), 2).startswith("\u2714 0 errors")
