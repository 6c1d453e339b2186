import time

import pytest

from inkwell.operators.lint import lint_document
from inkwell.operators.matching import Program
from inkwell.plans.catalogue import flagship_rules
from inkwell.plans.config import Config, read_config
from inkwell.plans.rules import RuleError, load_rules, parse_rule
from inkwell.sources.blocks import document_blocks

CFG = Config()
SAME = {
    ".org": "#+TITLE: t\n* TODO A *big* head :tag:\n:PROPERTIES:\n:ID: 1\n:END:\nText with ~code~ and [[http://a.b][a link]],\nmore.[fn:1]\n\n- one\n- two\n\n#+BEGIN_SRC py\nx = 1\n#+END_SRC\n\n#+BEGIN_QUOTE\nSaid so.\n#+END_QUOTE\n\n| a | b |\n|---+---|\n| c | d |\n# no\n",
    ".rst": "A **big** head\n==============\n\n:author: x\n\nText with ``code`` and `a link <http://a.b>`__,\nmore. [1]_\n\n* one\n* two\n\n.. code-block:: py\n\n   x = 1\n\n   Said so.\n\n.. no\n\n   Said so.\n\nSo::\n\n   Said so.\n\nx\n\n  Said so.\n\n===  ===\na    b\n===  ===\nc    d\n===  ===\n",
    ".adoc": ":toc: left\n\n= A *big* head\n\nText with `code` and http://a.b[a link],\nmore.footnote:[No.]\n\n* one\n* two\n\n[source,py]\n----\nx = 1\n----\n\n____\nSaid so.\n____\n\n|===\n|a |b\n\n|c |d\n|===\n// no\n",
}


def texts(text, ext, cfg=CFG):
    return [(b.scope, b.text) for b in document_blocks(text, ext, cfg, False) if not b.scope.startswith(("raw", "summary"))]


@pytest.mark.parametrize("ext", list(SAME))
def test_same_document(ext):
    got = texts(SAME[ext], ext)
    for want in [("text.heading.h1", "A big head"), ("text", "Text with **** and a link,\nmore."), ("text.list", "one"), ("text.list", "two"), ("text.blockquote", "Said so."), ("text.table.header", "a"), ("text.table.cell", "d")]:
        assert (want[0] + ext, want[1]) in got, (want, got)
    assert not any("x = 1" in t or t in ("no", "t", "x") and s != "text.rst" for s, t in got)
    for b in document_blocks(SAME[ext], ext, CFG, False):
        for at, src, n in b.runs:
            piece = b.text[at : at + n]
            assert set(piece) <= {"*"} or SAME[ext][src : src + n] == piece, (b.scope, piece, SAME[ext][src : src + n])


def test_dialects_of_markdown():
    mdx = "import X from 'x'\n\nexport const a = {\n  b: 1,\n}\n\n# Head\n\n<Note kind=\"a>b\">\n\nInside {props.name} text.\n\n</Note>\n\n{/* no */}\n\n```js\nimport y\n```\n"
    assert texts(mdx, ".mdx") == [("text.heading.h1.mdx", "Head"), ("text.mdx", "Inside              text.")]
    myst = "(target)=\n# Head\n\n:::{note}\n:class: x\nA note with {ref}`a label <x>` here.\n:::\n\n```{code-block} py\nx = 1\n```\n\n% no\n\n```{tip}\nA tip.\n```\n"
    got = [(s, " ".join(t.split())) for s, t in texts(myst, ".myst")]
    assert got == [("text.heading.h1.myst", "Head"), ("text.myst", "A note with a label here."), ("text.myst", "A tip.")]
    qmd = "# Head {#id .c}\n\n::: {.callout-note}\nA note {{< video x >}} here.\n:::\n"
    assert [(s, " ".join(t.split())) for s, t in texts(qmd, ".qmd")] == [("text.heading.h1.qmd", "Head"), ("text.qmd", "A note here.")]
    qdoc = "/*!\n    \\page a.html\n    \\title The title\n\n    Some \\c code and \\l {x}{a link}.\n    \\list\n    \\li one\n    \\endlist\n    \\code\n    int x;\n    \\endcode\n*/\nint y; // no\n"
    assert texts(qdoc, ".qdoc") == [("text.heading.h1.qdoc", "The title"), ("text.qdoc", "Some **** and a link."), ("text.list.qdoc", "one")]


def test_unknown_endings_are_one_block():
    text = "One. Two.\n\nThree."
    assert [b.scope for b in document_blocks(text, ".xyz", CFG)] == ["text.xyz", "raw.xyz"]
    assert [b.scope for b in document_blocks("# x", ".md", Config(ignore_syntax=True))] == ["text.md", "raw.md"]
    assert [b.scope for b in document_blocks(text, ".txt", CFG)].count("sentence.text.txt") == 3


def test_fragments_keep_their_places():
    cfg = read_config("[formats]\npy = md\n")
    text = "x = 1\n# # A head\n# Some *old* text\n# is `here`.\ny = 2\n"
    got = document_blocks(text, ".py", cfg, False)
    assert ("text.heading.h1.md", "A head") in [(b.scope, b.text) for b in got]
    p = Program([parse_rule("S.R", {"extends": "existence", "message": "'%s'", "tokens": ["old", "is"]})], Config(styles=["S"], fragments=cfg.fragments))
    assert [(a[0], a[1], a[8]) for a in lint_document(text, ".py", "a.py", p)] == [(3, 9, "old"), (4, 3, "is")]


def test_config_keys(tmp_path):
    voc = tmp_path / "config" / "vocabularies" / "V"
    voc.mkdir(parents=True)
    (voc / "accept.txt").write_text("OAuth2?\n# no\n")
    cfg = read_config("Vocab = V\n[*]\nBasedOnStyles = A, A, B\nCommentDelimiters = \"{#, #}\"\n".replace('"', ""), str(tmp_path))
    assert cfg.accept == ["OAuth2?"] and cfg.styles == ["A", "B"] and cfg.section_of("x").delimiters == ("{#", "#}")
    for bad in ("Colour = 1\n", "MinAlertLevel = loud\n", "Vocab = W\n", "[*]\nCommentDelimiters = x\n"):
        with pytest.raises(ValueError):
            read_config(bad, str(tmp_path))
    r = parse_rule("S.R", {"extends": "existence", "message": "x", "tokens": ["bad"]})
    p = Program([r], Config(styles=["S"], sections=cfg.sections, checks={"S": True}))
    assert lint_document("{# lint off #}\n\nbad\n", ".txt", "x", p) == []


def test_spelling_rules_from_files(tmp_path):
    d = tmp_path / "config" / "dictionaries"
    d.mkdir(parents=True)
    (tmp_path / "S").mkdir()
    (d / "en.dic").write_text("3\nthe\ncat/1001,1002\nsit/1003\n")
    (d / "en.aff").write_text("FLAG num\nSFX 1001 Y 1\nSFX 1001 0 s .\nPFX 1002 Y 1\nPFX 1002 0 un .\nSFX 1003 Y 1\nSFX 1003 it at it\n")
    (d / "long.dic").write_text("1\ndog/AaBb\n")
    (d / "long.aff").write_text("FLAG long\nSFX Aa Y 1\nSFX Aa 0 gy [^-a]\nSFX Bb Y 1\nSFX Bb 0 s .\n")
    (tmp_path / "config" / "ignore").mkdir()
    (tmp_path / "config" / "ignore" / "own.txt").write_text("zzword\n")
    (tmp_path / "S" / "Sp.yml").write_text("extends: spelling\nmessage: \"'%s'\"\nignore: own.txt\n")
    rules = load_rules(str(tmp_path))
    got = lint_document("The cats sat, uncat zzword doggy dogs qqcat.", ".txt", "x", Program(rules, Config(styles=["S"])))
    assert [a[8] for a in got] == ["qqcat"]
    (tmp_path / "S" / "Sp.yml").write_text("extends: spelling\nmessage: x\ndictionaries: [fr]\n")
    with pytest.raises(RuleError) as e:
        load_rules(str(tmp_path))
    assert e.value.path.endswith("Sp.yml") and '"Line": 1' in e.value.as_json() and ":1:1:" in e.value.as_line()


def test_terms_in_their_own_spelling():
    cfg = Config(accept=["OAuth2?", "Node\\.js"])
    from inkwell.plans.config import vocabulary_rules

    got = lint_document("Oauth and node.js, OAuth2.", ".txt", "x", Program(vocabulary_rules(cfg), Config(accept=cfg.accept, checks={"Builtin": True})))
    assert [(a[8], a[5]) for a in got] == [("Oauth", "Use 'OAuth' instead of 'Oauth'."), ("node.js", "Use 'Node.js' instead of 'node.js'.")]


def test_time_is_linear_in_one_paragraph():
    p = Program(flagship_rules(), Config(styles=["Plain"]))
    for ext in (".md", ".txt", ".html", ".org", ".rst", ".adoc"):
        took = []
        for n in (100_000, 1_000_000):
            text = "Some *old* text that is not clear, and every list is long. The the API of `x` here & now.\n" * (n // 91)
            began = time.time()
            lint_document(text, ext, "x", p)
            took.append(time.time() - began)
        assert took[1] < 25 * took[0] + 1, (ext, took)
    text = "Some old text that is clear. " * 345_000
    assert len(lint_document(text, ".txt", "x", Program(flagship_rules()[:1], Config(styles=["Plain"])))) == 3 * 345_000
