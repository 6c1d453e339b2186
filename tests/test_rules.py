import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.functions import text as X
from inkwell.functions.spell import Affixes, Dictionary, checked, distance
from inkwell.functions.tagger import tag
from inkwell.operators.lint import lint_document
from inkwell.operators.matching import Program, formula, holds
from inkwell.plans.config import Config, Section, filter_rules, glob_matches, read_config, vocabulary_rules
from inkwell.plans.rules import RuleError, in_scope, literals, load_rules, message, options, parse_rule, to_sentence


def rule(name="S.R", **k):
    return parse_rule(name, {"message": "m '%s'"} | k)


def alerts(text, *rules, ext=".md", cfg=None):
    cfg = cfg or Config(styles=["S"])
    return [(a[0], a[1], a[3].split(".")[1], a[5]) for a in lint_document(text, ext, "a" + ext, Program(list(rules), cfg))]


def test_validation():
    for bad in ({"extends": "nothing"}, {"extends": "existence", "message": ""}, {"extends": "existence", "level": "fatal"}, {"extends": "existence", "colour": 1}, {"extends": "existence", "code": True}):
        with pytest.raises(RuleError):
            rule(**bad)
    assert rule(extends="spelling", anything=1).kind == "spelling"
    assert rule(extends="metric", formula="words", condition="> 1").scope == ("summary",)


def test_existence_exceptions_and_places():
    r = rule(extends="existence", tokens=["very", "quite a few"], ignorecase=True, exceptions=["very Large"])
    assert alerts("A Very\nbig and quite a few.\n", r) == [(1, 3, "R", "m 'Very'"), (2, 9, "R", "m 'quite a few'")]
    assert alerts("", r) == alerts(None, r) == []


def test_substitution_longest_key_and_groups():
    r = rule(extends="substitution", message="%s for %s", swap={"mail": "post", "e-?mail": "email", r"(\w+)ise\b": "$1ize"}, ignorecase=True)
    assert [a[3] for a in alerts("An E-mail, email, mail, organise.", r)] == ["email for E-mail", "post for mail", "organize for organise"]


def test_occurrence_counts_and_one_alert():
    r = rule(extends="occurrence", token=r"\w+", max=2, scope="sentence", message="%s")
    assert alerts("One two. One two three. `a b` c", r) == [(1, 10, "R", "3")]
    assert [a[3] for a in alerts("# head\n\nbody", rule(extends="occurrence", token="zzz", min=1, message="%s"))] == ["0", "0"]


def test_repetition_counter_is_kept():
    r = rule(extends="repetition", tokens=[r"[^\s.]+"], ignorecase=True, alpha=True)
    assert len(alerts("the The cat cat sat", r)) == 2 and alerts("It ended. Ended well.", r) == []
    assert len(alerts("a a b b", rule(extends="repetition", tokens=[r"\w+"], max=1))) == 1


def test_consistency_and_conditional_look_back():
    c = rule(extends="consistency", either={"advisor": "adviser"})
    assert alerts("An advisor.\n\nNothing.\n\nAn adviser.\n", c) == [(5, 4, "R", "m 'adviser'")]
    d = rule(extends="conditional", first=r"\b([A-Z]{3,5})\b", second=r"\(([A-Z]{3,5})\)")
    assert alerts("WHO first.\n\nWorld Health (WHO).\n\nWHO again, NASA.\n", d) == [(1, 1, "R", "m 'WHO'"), (5, 12, "R", "m 'NASA'")]


def test_capitalization_forms():
    t = rule(extends="capitalization", match="$title", scope="heading", message="%s")
    assert alerts("# The Cat of the House\n\n# The cat sat there\n", t) == [(3, 3, "R", "The cat sat there")]
    s = rule(extends="capitalization", match="$sentence", scope="heading", exceptions=["API"])
    assert len(alerts("# The API of cats\n\n# The Cat Of Them\n\n# the cat\n", s)) == 2
    assert len(alerts("# lower\n\n# Upper\n", rule(extends="capitalization", match="$lower", scope="heading"))) == 1


def test_metrics():
    assert holds(formula("4.71 * (characters / words) + math.sqrt(unset)")({"characters": 10.0, "words": 2.0}), "> 23")
    assert not holds(formula("words / sentences")({}), "> 0") and not holds(8.0000001, "> 8")
    for bad in ("__import__('os')", "words.real", "[1]"):
        with pytest.raises(RuleError):
            formula(bad)
    assert alerts("One two three four five six seven.", rule(extends="metric", formula="words", condition="> 3", message="%s")) == [(1, 1, "R", "7.00")]


def test_sequence_with_skips_and_targets():
    r = rule(extends="sequence", tokens=[{"tag": "MD"}, {"pattern": "be"}, {"tag": "JJ"}], message="%[1]s-%[3]s")
    assert alerts("It will be new here.", r) == [(1, 4, "R", "will-new")] and alerts("It will go.", r) == []
    s = rule(extends="sequence", tokens=[{"pattern": "not"}, {"skip": 2}, {"pattern": "also", "target": True}], message="%s")
    assert alerts("He is not only here also.", s) == [(1, 21, "R", "not")]


def test_spelling_chain():
    d = Dictionary.parse("3\ncat/S\ndog\nkm\n", "SFX S Y 1\nSFX S 0 s .\nICONV 1\nICONV ’ '\n")
    assert d.accepts("cats") and d.accepts("Dog") and d.accepts("12km") and d.accepts("0xFF") and not d.accepts("dgo")
    assert Affixes.parse("PFX U Y 1\nPFX U 0 un .\nSFX S Y 1\nSFX S 0 s .\n").forms("do", "US") == {"do", "undo", "dos", "undos"}
    assert not checked("naïve") and not checked("abC1") and checked("plain") and checked("naïve", custom=True)
    r = rule(extends="spelling", dictionary=d, ignore_words=["zz"])
    assert alerts("The cats see zz dgo.", rule(extends="spelling", dictionary=Dictionary({"the", "see", "cats"}), ignore_words=["zz"])) == [(1, 17, "R", "m 'dgo'")]
    assert r.kind == "spelling" and distance("kitten", "sitting") == 3


def test_script_and_vocabulary_rules():
    r = rule(extends="script", script=lambda t: [{"begin": 0, "end": 3, "message": "first"}], scope="heading")
    assert alerts("# abc def\n", r) == [(1, 3, "R", "first")]
    cfg = Config(styles=["Builtin"], accept=["JavaScript"], reject=["foo"])
    assert {r.name for r in vocabulary_rules(cfg)} == {"Builtin.Terms", "Builtin.Avoid"}
    got = lint_document("javascript foo JavaScript", ".txt", "x", Program(vocabulary_rules(cfg), cfg))
    assert [(a[3], a[8]) for a in got] == [("Builtin.Avoid", "foo"), ("Builtin.Terms", "javascript")]  # rules run in the order of their names


def test_controls_limits_and_dedup():
    r = rule(extends="existence", tokens=["bad"], limit=2)
    text = "bad one\n\n<!-- lint S.R = NO -->\n\nbad two\n\n<!-- lint S.R = YES -->\n\nbad three bad four\n"
    assert [a[:2] for a in alerts(text, r)] == [(1, 1), (9, 1)]
    assert alerts("<!-- lint off -->\n\nbad\n\n<!-- lint on -->\n\nbad\n", r) == [(7, 1, "R", "m 'bad'")]
    assert alerts('<!-- lint S.R["bad"] = NO -->\n\nbad\n', r) == [] and alerts("<!-- lint style = T -->\n\nbad\n", r) == []
    same = rule("S.Two", extends="existence", tokens=["bad", "bad one"])
    assert len(alerts("bad one", same)) == 1


def test_scopes():
    assert in_scope(("heading",), "text.heading.h1.md") and not in_scope(("heading.h2",), "text.heading.h1.md")
    assert in_scope(("~heading & text",), "text.list.md") and not in_scope(("~heading",), "raw.md") and not in_scope(("~heading",), "summary.md")
    assert not in_scope(("text",), "sentence.text.md") and in_scope(("sentence",), "sentence.text.md") and in_scope(("text", "raw"), "raw.md")


def test_globs_and_sections():
    assert glob_matches("*.md", "a/b.md") and not glob_matches("!*.md", "a/b.md") and glob_matches("**/b.{md,txt}", "a/c/b.txt") and not glob_matches("a/*/**/x", "b/x")
    cfg = read_config("MinAlertLevel = warning\n[*]\nBasedOnStyles = A\n[*.md]\nBasedOnStyles = B\nB.One = NO\nA.Two = error\n[docs/*]\nC = YES\n")
    s = cfg.section_of("docs/x.md")
    r = lambda n, level="warning": parse_rule(n, {"extends": "existence", "message": "x", "level": level})
    assert s.styles == ["B"] and not cfg.runs(r("B.One"), s) and cfg.runs(r("B.Two"), s) and cfg.runs(r("A.Two", "suggestion"), s) and cfg.runs(r("C.X"), s)
    assert not cfg.runs(r("B.Low", "suggestion"), s) and not cfg.runs(r("A.One"), s) and cfg.level_of(r("A.Two"), s) == "error"
    assert Config(checks={"D": True}).runs(r("D.X"), Section("x"))


def test_filters():
    rs = [rule("S.A", extends="existence", level="error"), rule("T.B", extends="spelling")]
    assert [r.name for r in filter_rules(rs, '.Level == "error" && .Extends in ["existence"]')] == ["S.A"]
    assert [r.name for r in filter_rules(rs, '!(.Name == "S.A") or "raw" in .Scope')] == ["T.B"]
    with pytest.raises(ValueError):
        filter_rules(rs, "__import__('os')")


def test_messages():
    assert message("a %s %d %s", 1) == "a 1  " and message("%[2]s %[1]s", "x", "y", "z") == "y x" and message("100%% %.2f", 2.5) == "100% 2.50"
    assert to_sentence(["a"]) == "'a'" and to_sentence(["a", "b"]) == "'a' or 'b'" and to_sentence(["a", "b", "c"]) == "'a', 'b', or 'c'"
    assert options(r"a|b\|c") == ["a", "b|c"] and literals(["foo(?:bar)?", "[ab]x"]) is None and literals(["very much", "colou?r"]) == ["very much", "colo"]


def test_load_rules(tmp_path):
    (tmp_path / "S").mkdir()
    (tmp_path / "S" / "A.yml").write_text("extends: existence\nmessage: x\ntokens: [a]\n")
    (tmp_path / "S" / "A.test.yml").write_text("[]")
    assert [r.name for r in load_rules(str(tmp_path))] == ["S.A"] and load_rules(str(tmp_path), {"T"}) == []
    (tmp_path / "S" / "B.yml").write_text("a: 'b\\'")
    with pytest.raises(RuleError):
        load_rules(str(tmp_path))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="very good\n.!`*_#->| é", max_size=80))
def test_every_span_re_extracts(text):
    r = rule(extends="existence", tokens=["very", "good"])
    lines = text.split("\n")
    for a in lint_document(text, ".md", "x.md", Program([r], Config(styles=["S"]))):
        assert lines[a[0] - 1][a[1] - 1 : a[2]] == a[8]


def test_case_functions():
    assert X.title_case("a tale of two cities") == "A Tale of Two Cities" and X.sentence_case("A Tale Of") == "A tale of"
    assert X.recase("ABC", "def") == "DEF" and X.recase("Abc", "def") == "Def" and X.recase("abc", "DEF") == "def"
    assert [X.syllables(w) for w in ("cat", "table", "syllable", "made")] == [1, 2, 3, 1]
    assert [t for _, t, _ in tag("She will be new")] == ["PRP", "MD", "VB", "JJ"]
