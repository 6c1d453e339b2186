"""Labelled pages for the block model.

The pages are made here: random structure and invented words, written in each format with
the residue such pages carry (metadata, scripts, templates, comments, notes, navigation). A
block's label is known because its text holds a marker word; a leaf without one is residue.
The model is fitted on ``PAGES_PER_FORMAT`` of them, a documented bound.
"""

from __future__ import annotations

import random

PAGES_PER_FORMAT = 150
LABELS = ["para", "heading", "item", "row", "code", "formula", "drop"]
_SYL = "ba ce di fo gu la me ni po ru sa te vi wo za".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYL) for _ in range(r.randint(1, 3)))


def _words(r: random.Random, a: int, b: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(a, b)))


def page(form: str, seed: int) -> tuple[str, dict[str, str]]:
    """A page's text, and its markers with their labels."""
    r = random.Random(f"{form}-{seed}")
    marks: dict[str, str] = {}

    def mark(label: str) -> str:
        m = f"zq{seed}x{len(marks)}qz"
        marks[m] = label
        return m

    def sentence(label: str, a: int = 3, b: int = 14) -> str:
        s = f"{_words(r, 1, 3).capitalize()} {mark(label)} {_words(r, a, b)}"
        if b >= 6 and r.random() < 0.5:
            s += " " + _inline(form, r) + " " + _words(r, 0, 5)
        if b > 10 and r.random() < 0.4:
            s += r.choice([". ", ", ", "\n", ": "]) + _words(r, 4, 16)
        return s.rstrip() + r.choice([".", ".", ".", "", "?", ":"])

    def code(label: str = "code") -> list[str]:
        return [f"{_word(r)}({mark(label)})"] + [r.choice(["    return x", "# not a heading", "level: warning", "}", "* not an item", "$ run --all", "if n > 3 {", "<i>x</i>", f"{_word(r)}: {_word(r)}", f"for {_word(r)} in {_word(r)}:", f"print('{_word(r)}')"]) for _ in range(r.randint(0, 3))]

    def tex() -> str:
        m, a, n = mark("formula"), r.choice("abkmnpqxyz"), r.randint(1, 99)
        return r.choice([r"\frac{%s}{2} + %s" % (m, a), f"{a}^{n} + {m} = {n}", r"\sum_{i=1}^{%s} %s_i" % (a, m), f"{n}.{n} - {m}", rf"{a} = \sqrt{{{m}}}", f"{m} \\le {a}", r"\int_0^1 %s(%s) d%s" % (m, a, a), f"e^{{-{a} {m}}}"])

    kinds = ["para"] * 6 + ["heading"] * 3 + ["list"] * 2 + ["table", "code", "formula", "quote", "drop", "drop"]
    one = lambda label, a=3, b=14: sentence(label, a, b).replace("\n", " ")
    parts: list[str] = []
    for _ in range(r.randint(5, 16)):
        kind = r.choice(kinds)
        parts.append(_block(form, kind, r, sentence if kind == "para" else one, code, tex, mark))
    return _page(form, parts, r, mark), marks


def _inline(form: str, r: random.Random) -> str:
    """A piece of text as it stands in running text: code, a link, a formula, emphasis, numbers."""
    w, x = _words(r, 1, 3), f"{_word(r)}_{_word(r)}"
    v = lambda: r.choice("abghkmnpqrs")
    t = r.choice([f"{v()}^{r.randint(2, 9)}", f"{v()}_{{{v()}}} + {v()}_{v()} = {v()}", rf"\\sqrt{{{v()} + {v()}}}", rf"\\frac{{{v()}}}{{{v()}}}", f"{r.randint(1, 9)}.{r.randint(1, 9)} ({v()} - {v()})"])
    link, code, bold, tex = {
        "html": (f'<a href="http://{_word(r)}.example/{x}">{w}</a>', f"<code>{x}</code>", f"<b>{w}</b>", f"\\({t}\\)"),
        "md": (f"[{w}](https://{_word(r)}.example/{x})", f"`{x}`", f"**{w}**", f"${t}$"),
        "rst": (f"`{w} <https://{_word(r)}.example/{x}>`__", f"``{x}``", f"**{w}**", f":math:`{t}`"),
        "org": (f"[[https://{_word(r)}.example][{w}]]", f"~{x}~", f"*{w}*", f"\\({t}\\)"),
        "adoc": (f"https://{_word(r)}.example/{x}[{w}]", f"`{x}`", f"*{w}*", f"stem:[{t}]"),
        "wiki": (f"[[{w}|{x}]]", f"<code>{x}</code>", f"'''{w}'''", f"<math>{t}</math>"),
        "tex": (f"\\href{{https://{_word(r)}.example/{x}}}{{{w}}}", f"\\texttt{{{_word(r)}}}", f"\\emph{{{w}}}", f"${t}$"),
    }[form]
    return r.choice(["{" + w + "}" if form not in ("tex", "wiki") else w, link, code, bold, tex, f"{r.randint(1, 99)}.{r.randint(1, 9)} {w}", f"({w})", f"{r.randint(2, 9)} > 1", x if form != "tex" else w])


def bullet(r: random.Random, *marks: str) -> str:
    return r.choice(marks)


def _block(form, kind, r, sentence, code, tex, mark):  # noqa: C901
    drop = f"{_words(r, 1, 6)} {mark('drop')}" + r.choice(["", "", f" {_words(r, 4, 14)}."])
    depth = r.randint(1, 3)
    cells = [[f"{_words(r, 1, 3)} {mark('row') if j == 0 else ''}".strip() for j in range(3)] for _ in range(r.randint(2, 4))]
    items = [(r.choice([1, 1, 2]) if i else 1, sentence("item", 1, 10)) for i in range(r.randint(1, 5))]
    if form == "html":
        li = "".join(f"<li>{s}</li>\n" if d == 1 else f"<li><ul><li>{s}</li></ul></li>\n" for d, s in items)
        rows = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>\n" for row in cells)
        return {
            "para": r.choice([f"<p>{sentence('para')}</p>", f"<p>{sentence('para')}\n</p>", f"<p class=\"{_word(r)}\">{sentence('para', 0, 3)}", f"<div>{sentence('para')}</div>"]), "heading": f"<h{depth}>{sentence('heading', 1, 6)}</h{depth}>", "list": f"<ul>{li}</ul>", "table": f"<table>{rows}</table>",
            "code": "<pre><code>" + "\n".join(code()) + "</code></pre>", "formula": f'<div class="math">\\[{tex()}\\]</div>', "quote": f"<blockquote><p>{sentence('para')}</p></blockquote>",
            "drop": r.choice([f"<!-- {drop} -->", f"<script>{drop}</script>", f"<style>{drop}</style>", f"<nav><ul><li>{drop}</li></ul></nav>", f"<footer><p>{drop}</p></footer>"]),
        }[kind]
    if form == "md":
        return {
            "para": sentence("para"), "heading": r.choice([f"{'#' * r.randint(1, 6)} {sentence('heading', 1, 6)}", f"{sentence('heading', 1, 6)}\n{r.choice(['=====', '-----'])}"]),
            "list": "\n".join("    " * (d - 1) + bullet(r, "*", "-", "+", "1.", "2)") + " " + s for d, s in items), "table": "\n".join("| " + " | ".join(row) + " |" + ("\n|---|---|---|" if not i else "") for i, row in enumerate(cells)),
            "code": r.choice([f"{(f := r.choice(['```', '~~~']))}py\n" + "\n".join(code()) + f"\n{f}", "\n".join("    " + x for x in code())]), "formula": f"$$\n{tex()}\n$$", "quote": f"> {sentence('para')}",
            "drop": r.choice([f"<!-- {drop} -->", f"[^1]: {drop}", f"[{mark('drop')}]: https://x.example", "---", "***", f"::: {drop}", f"{{% {_word(r)} {mark('drop')} %}}"]),
        }[kind]
    if form == "rst":
        return {
            "para": sentence("para"), "heading": (h := sentence("heading", 1, 6)) + "\n" + r.choice("=-~^#*+")* len(h), "list": "\n\n".join("  " * (d - 1) + bullet(r, "*", "-", "+", "1.", "#.") + " " + s for d, s in items),
            "table": r.choice(["====  ====  ====\n" + "\n".join("  ".join(row) for row in cells) + "\n====  ====  ====", "+---+---+---+\n" + "\n+---+---+---+\n".join("| " + " | ".join(row) + " |" for row in cells) + "\n+---+---+---+"]),
            "code": r.choice([f".. {r.choice(['code-block', 'code', 'sourcecode', 'parsed-literal'])}:: text\n\n", f"{sentence('para')[:-1]}::\n\n"]) + "\n".join("   " + x for x in code()),
            "formula": f".. math::\n\n   {tex()}", "quote": "   " + sentence("para"), "drop": r.choice([f".. {drop}", f".. {r.choice(['image', 'figure', 'toctree', 'contents', 'meta', 'include', 'index'])}:: {drop}", f".. |{_word(r)}| {drop}", f".. [1] {drop}", f".. _{mark('drop')}:", f".. raw:: html\n\n   {drop}", f":author: {drop}"]),
        }[kind]
    if form == "org":
        return {
            "para": sentence("para"), "heading": "*" * depth + " " + sentence("heading", 1, 6), "list": "\n".join("  " * (d - 1) + bullet(r, "-", "+", "1.", "2)") + " " + s for d, s in items), "table": "\n".join("| " + " | ".join(row) + " |" for row in cells),
            "code": r.choice([f"#+BEGIN_{(k := r.choice(['SRC', 'EXAMPLE', 'src', 'example']))} text\n" + "\n".join(code()) + f"\n#+END_{k}", "\n".join(": " + x for x in code())]), "formula": r.choice([f"\\[\n{tex()}\n\\]", f"$$\n{tex()}\n$$", f"\\begin{{equation}}\n{tex()}\n\\end{{equation}}"]), "quote": f"#+BEGIN_QUOTE\n{sentence('para')}\n#+END_QUOTE",
            "drop": r.choice([f"# {drop}", f"#+TITLE: {drop}", f":PROPERTIES:\n:ID: {mark('drop')}\n:END:", f"[fn:1] {drop}", f"#+BEGIN_COMMENT\n{drop}\n#+END_COMMENT", "-----"]),
        }[kind]
    if form == "adoc":
        return {
            "para": sentence("para"), "heading": "=" * depth + " " + sentence("heading", 1, 6), "list": "\n".join(r.choice(["*", "*", "."]) * d + " " + s for d, s in items), "table": "|===\n" + "\n".join("|" + " |".join(row) for row in cells) + "\n|===",
            "code": r.choice(["[source,text]\n----\n", "----\n"]) + "\n".join(code()) + "\n----" if r.random() < 0.7 else "....\n" + "\n".join(code()) + "\n....", "formula": f"{r.choice(['[stem]', '[latexmath]', '[asciimath]'])}\n++++\n{tex()}\n++++", "quote": f"____\n{sentence('para')}\n____",
            "drop": r.choice([f"// {drop}", f":{mark('drop')}: x", f"////\n{drop}\n////", f"[{mark('drop')}]", f"[pass]\n++++\n{drop}\n++++", f"include::{mark('drop')}[]"]),
        }[kind]
    if form == "wiki":
        return {
            "para": sentence("para"), "heading": "=" * depth + " " + sentence("heading", 1, 6) + " " + "=" * depth, "list": "\n".join(r.choice(["*", "*", "#"]) * d + " " + s for d, s in items),
            "table": '{| class="t"\n' + "\n".join("|-\n| " + " || ".join(row) for row in cells) + "\n|}", "code": r.choice([f"<{(k := r.choice(['syntaxhighlight', 'source', 'pre']))}>\n" + "\n".join(code()) + f"\n</{k}>", "\n".join(" " + x for x in code())]),
            "formula": f'<math display="block">{tex()}</math>', "quote": f": {sentence('para')}", "drop": r.choice([f"<!-- {drop} -->", f"{{{{stub|{drop}}}}}", f"[[Category:{drop}]]", "----"]),
        }[kind]
    return {
        "para": sentence("para"), "heading": "\\" + "sub" * (depth - 1) + "section{" + sentence("heading", 1, 6) + "}", "list": f"\\begin{{{(kind_of := r.choice(['itemize', 'enumerate']))}}}\n" + "\n".join(f"  \\item {s}" for _, s in items) + f"\n\\end{{{kind_of}}}",
        "table": "\\begin{tabular}{lll}\n\\hline\n" + " \\\\\n".join(" & ".join(row) for row in cells) + "\\\\\n\\hline\n\\end{tabular}", "code": f"\\begin{{{(k := r.choice(['verbatim', 'verbatim', 'lstlisting', 'Verbatim']))}}}\n" + "\n".join(code()) + f"\n\\end{{{k}}}",
        "formula": r.choice([f"\\[\n{tex()}\n\\]", f"$$\n{tex()}\n$$", f"\\begin{{{(e := r.choice(['equation', 'align', 'gather', 'multline']))}}}\n{tex()}\n\\end{{{e}}}"]), "quote": f"\\begin{{quote}}\n{sentence('para')}\n\\end{{quote}}", "drop": r.choice([f"% {drop}", f"\\{r.choice(['title', 'author', 'date', 'bibliography', 'input', 'include'])}{{{drop}}}", f"\\label{{{mark('drop')}}}", f"\\maketitle % {mark('drop')}"]),
    }[kind]


def _page(form, parts, r, mark):
    body = "\n\n".join(parts) if form != "html" else "\n".join(parts)
    if form == "html" and r.random() < 0.6:
        box = r.choice(["div", "div", "main", "article", "section"])
        body = f"<{box} class=\"{_word(r)}\">\n{body}\n</{box}>"
    if r.random() < 0.5:
        return body
    d = mark("drop")
    return {
        "html": f"<!DOCTYPE html>\n<html><head><title>{d}</title><style>p {{}}</style></head>\n<body>\n{body}\n</body></html>", "md": f"---\ntitle: {d}\n---\n\n{body}", "rst": f":date: {d}\n\n{body}",
        "org": f"#+TITLE: {d}\n#+OPTIONS: x\n\n{body}", "adoc": f":toc: {d}\n\n{body}", "wiki": f"{{{{stub|{d}}}}}\n\n{body}", "tex": f"\\documentclass{{article}}\n\\usepackage{{{d}}}\n\\begin{{document}}\n\n{body}\n\n\\end{{document}}",
    }[form]
