import pytest

from inkwell.llm.crf import LinearChainCRF
from inkwell.llm.leaves import Leaf, guess_format
from inkwell.llm.markup import FORMS, block_model, features, labelled, markup_units, units

CASES = {
    "md": "---\ntitle: x\n---\n# A **big** head #\n\nText with `a*b` and $x^2$, 5 \\* 3 &lt; 4.[^1]\n\n- one [link](http://a.b)\n    - two\n\n| a | b |\n|---|---|\n| c | d |\n\n```py\nx = 1\n```\n\n<!-- no -->\n\n[^1]: A note.\n",
    "html": "<html><head><title>t</title><style>x</style></head><body><h1>A <b>big</b> head</h1><p>Text with <code>a*b</code> and <span class='math'>\\(x^2\\)</span>, 5 * 3 &lt; 4.<ul><li>one <a href='#'>link</a><ul><li>two</li></ul></li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>c</td><td>d</td></tr></table><pre><code>x = 1</code></pre><!-- no --><script>var a;</script></body></html>",
    "rst": "A **big** head\n==============\n\nText with ``a*b`` and :math:`x^2`, 5 \\* 3 < 4. [1]_\n\n* one `link <http://a.b>`__\n\n  - two\n\n===  ===\na    b\n===  ===\nc    d\n===  ===\n\n.. code-block:: py\n\n   x = 1\n\n.. no\n\n.. [1] A note.\n",
    "org": "#+TITLE: t\n* A *big* head\n:PROPERTIES:\n:ID: 1\n:END:\n\nText with ~a*b~ and \\(x^2\\), 5 * 3 < 4.[fn:1]\n\n- one [[http://a.b][link]]\n  - two\n\n| a | b |\n|---+---|\n| c | d |\n\n#+BEGIN_SRC py\nx = 1\n#+END_SRC\n\n# no\n\n[fn:1] A note.\n",
    "adoc": ":toc: left\n\n= A *big* head\n\nText with `a*b` and stem:[x^2], 5 * 3 < 4.footnote:[A note.]\n\n* one http://a.b[link]\n** two\n\n|===\n|a |b\n|c |d\n|===\n\n[source,py]\n----\nx = 1\n----\n\n// no\n",
    "wiki": "{{stub|x}}\n= A '''big''' head =\n\nText with <code>a*b</code> and <math>x^2</math>, 5 * 3 &lt; 4.<ref>A note.</ref>\n\n* one [[Page|link]]\n** two\n\n{| class=\"t\"\n|-\n! a !! b\n|-\n| c || d\n|}\n\n<syntaxhighlight lang=\"py\">\nx = 1\n</syntaxhighlight>\n\n<!-- no -->\n[[Category:x]]\n",
    "tex": "\\documentclass{a}\n\\begin{document}\n\\section{A \\textbf{big} head}\\label{x}\n\nText with \\verb|a*b| and $x^2$, 5 * 3 \\textless{} 4.\\footnote{A note.}\n\n\\begin{itemize}\n\\item one \\href{http://a.b}{link}\n\\begin{itemize}\n\\item two\n\\end{itemize}\n\\end{itemize}\n\n\\begin{tabular}{ll}\n\\hline\na & b \\\\\nc & d \\\\\n\\end{tabular}\n\n\\begin{verbatim}\nx = 1\n\\end{verbatim}\n% no\n\\end{document}\n",
}
WANT = {("heading", 1, "A big head"), ("para", 0, "Text with a*b and x^2, 5 * 3 < 4."), ("formula", 0, "x^2"), ("item", 1, "one link"), ("item", 2, "two"), ("row", 0, "a | b"), ("row", 0, "c | d"), ("code", 0, "x = 1")}


@pytest.mark.parametrize("form", list(CASES))
def test_same_document_in_every_format(form):
    assert guess_format(CASES[form]) == form
    assert set(units(CASES[form])) == WANT


@pytest.mark.parametrize("form", FORMS)
def test_held_out_pages(form):
    model, right, n = block_model(), 0, 0
    for seed in range(5000, 5010):
        xs, ys = labelled(form, seed)
        right += sum(a == b for a, b in zip(model.decode(xs), ys))
        n += len(ys)
    assert right >= 0.98 * n


def test_field_uses_the_neighbours():
    pages = [([["a"], ["x"]], ["A", "A"]), ([["b"], ["x"]], ["B", "B"])] * 20
    m = LinearChainCRF(["A", "B"]).fit(pages)
    assert m.decode([["a"], ["x"]]) == ["A", "A"] and m.decode([["b"], ["x"]]) == ["B", "B"] and m.decode([]) == []


def test_edges(spark):
    rows = [(1, CASES["md"], None, None, "c"), (2, None, ".md", None, "c"), (3, "", ".md", None, "c"), (None, "# x", ".md", None, "c"), (4, "# a\n\n# a\n", "unknown", ".MD", "c"), (5, "word " * 60_000, ".md", ".md", "c")]
    df = spark.createDataFrame(rows, "file_id long, file_content string, normed_ext string, real_ext string, unit_text string")
    got = markup_units(df).collect()
    assert {tuple(r)[1:] for r in got if r.file_id == 1} == WANT
    assert [tuple(r) for r in got if r.file_id == 4] == [(4, "heading", 1, "a")]
    assert {r.file_id for r in got} == {1, 4, 5} and max(len(r.unit_text) for r in got) == 299_999
    assert markup_units(df.limit(0)).collect() == []


def test_letters_of_the_whole_leaf():
    leaf = Leaf(("doc", "p"), "1 " * 200 + "a" * 4000)
    assert "letters=4" in features([leaf])[0]


def test_the_field_decides_and_not_the_containers():
    """On held-out pages the field is right where the most frequent kind of the last two containers isn't."""
    from collections import Counter, defaultdict

    pair = lambda fs: next(f for f in fs if f.startswith("pair="))
    table = defaultdict(Counter)
    for seed in range(30):
        for form in FORMS:
            for fs, y in zip(*labelled(form, seed)):
                table[pair(fs)][y] += 1
    model, n, field_right, table_right = block_model(), 0, 0, 0
    for seed in range(6000, 6008):
        for form in FORMS:
            xs, ys = labelled(form, seed)
            for y, a, fs in zip(ys, model.decode(xs), xs):
                best = table[pair(fs)].most_common(1)
                n, field_right, table_right = n + 1, field_right + (a == y), table_right + bool(best and best[0][0] == y)
    assert field_right >= 0.99 * n and table_right < 0.7 * n
