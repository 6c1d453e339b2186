"""Light markup other than Markdown: Org, reStructuredText, AsciiDoc, QDoc, and the dialects of Markdown.

Each is read line by line where it lies. A dialect's own constructs are blanked out at equal length
and the rest is read as Markdown, so that every offset stays true. What is code, directive,
metadata or comment gives no block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from inkwell.plans.config import Config

Line = tuple[int, str]

# Directives of MyST and reStructuredText that hold prose; all others are literal.
PROSE = set("admonition attention caution danger epigraph error hint important note pull-quote seealso tip topic warning sidebar versionadded versionchanged deprecated todo dropdown card grid tab-set tab-item".split())
# QDoc commands that begin a heading or an item, stand before prose, and those whose block is literal.
QDOC_HEADINGS = {"section1": 1, "section2": 2, "section3": 3, "section4": 4, "title": 1}
QDOC_PROSE = set("brief note warning quotation sa legalese".split())
QDOC_LITERAL = {"code": "endcode", "badcode": "endcode", "qml": "endqml", "js": "endjs", "raw": "endraw", "omit": "endomit", "quotefromfile": ""}


def lines_of(text: str) -> list[Line]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line.rstrip("\r")))
        at += len(line) + 1
    return out


def blank(text: str, pattern: str, flags: int = re.M, keep: str = "") -> str:
    """Matches as spaces, line breaks kept; the group named ``keep`` stays as it is."""

    def each(m: re.Match) -> str:
        out = re.sub(r"[^\n]", " ", m.group())
        if keep and m.group(keep) is not None:
            a, b = m.start(keep) - m.start(), m.end(keep) - m.start()
            out = out[:a] + m.group(keep) + out[b:]
        return out

    return re.sub(pattern, each, text, flags=flags)


# ---------------------------------------------------------------- dialects of Markdown


def plain_mdx(text: str) -> str:
    """MDX without modules, expressions and component tags; what stands between tags is kept."""
    parts = re.split(r"(^(?:```|~~~).*?^(?:```|~~~)[^\n]*$|`[^`\n]*`)", text, flags=re.M | re.S)  # code stays for the Markdown reader to skip
    for i in range(0, len(parts), 2):
        x = blank(parts[i], r"\{/\*.*?\*/\}", re.S)
        x = blank(x, r"^(?:import|export)\b[^\n]*(?:\n(?![ \t]*$)[^\n]+)*")
        for _ in range(3):
            x = blank(x, r"\{[^{}]*\}", re.S)
        parts[i] = blank(x, r"</?[A-Z][\w.]*(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?>", re.S)
    return "".join(parts)


def plain_myst(text: str) -> str:
    """MyST without directives' fences and options, roles, targets, comments and substitutions; literal directives stay code."""
    out, prose = [], []
    for line in text.split("\n"):
        m = re.match(r"^\s*(:{3,}|`{3,}|~{3,})\s*(?:\{([\w:.-]+)\})?", line)
        if m and m.group(2):
            if m.group(2).lower() in PROSE or m.group(1)[0] == ":":
                prose.append(m.group(1))
                out.append(" " * len(line))
                continue
        elif m and prose and line.strip() == prose[-1]:
            prose.pop()
            out.append(" " * len(line))
            continue
        elif prose and re.match(r"^\s*:[\w-]+:", line) or re.match(r"^\s*%|^\([\w-]+\)=\s*$|^\+\+\+", line):
            out.append(" " * len(line))
            continue
        out.append(line)
    x = blank("\n".join(out), r"\{[\w:.-]+\}`(?P<label>[^`<\n]*)(?:<[^`\n]*>)?`", keep="label")
    return blank(x, r"\{\{[^{}\n]*\}\}")


def plain_quarto(text: str) -> str:
    """Quarto without fences of divs, shortcodes and attributes."""
    x = blank(text, r"^\s*:{3,}.*$")
    x = blank(x, r"\{\{<.*?>\}\}")
    return blank(x, r"(?<=[\]\)`#\w ])\{[#.=][^{}\n]*\}")


# ---------------------------------------------------------------- inline marks

_I = lambda *ps: re.compile("|".join(ps), re.S)
_AROUND, _AFTER = r"(?<![^\s({\['\"“«—–-])", r"(?![^\s)}\]'\"”».,;:!?…—–-])"
INLINE = {
    # the group ``text`` is kept, ``code`` is starred out, all else of a match goes
    "org": _I(rf"{_AROUND}[~=](?P<code>\S(?:[^~=\n]*?\S)?)[~=]{_AFTER}", r"\[\[[^\[\]]*\]\[(?P<text>[^\[\]]*)\]\]", r"\[\[[^\[\]]*\]\]|\[fn:[^\[\]]*\]", r"\\\((?P<math>.*?)\\\)", rf"{_AROUND}[*/_+](?=\S)|(?<=\S)[*/_+]{_AFTER}"),
    "rst": _I(r"``(?P<code>.+?)``", r":[\w:-]+:`(?P<text>[^`<]*?)(?:\s*<[^`>]*>)?`", r"`(?P<link>[^`<]*?)(?:\s*<[^`>]*>)?`_{0,2}", r"\s?\[[^\]\s]+\]_(?!\w)", r"\|(?P<sub>[^|\s][^|\n]*)\|_?", r"\\(?P<esc>.)", r"(?<![\w*])\*{1,2}(?=\S)|(?<=\S)\*{1,2}(?![\w*])", r"(?<=\w)_{1,2}(?!\w)"),
    "adoc": _I(r"`\+?(?P<code>[^`\n]+?)\+?`", r"(?:https?|ftp|irc|mailto)://?[^\s\[\]]+\[(?P<text>[^\[\]]*)\]", r"(?:link|xref|mailto):[^\s\[\]]+\[(?P<link>[^\[\]]*)\]", r"<<[^<>,]*,\s*(?P<sub>[^<>]*)>>|<<[^<>]*>>", r"(?:footnote|image|icon|kbd|btn|stem|latexmath|indexterm\w*):[^\s\[\]]*\[[^\[\]]*\]", r"\[\[[^\]]*\]\]|\{[\w-]+\}", r"(?<![\w*])\*{1,2}(?=\S)|(?<=\S)\*{1,2}(?![\w*])|(?<!\w)_{1,2}(?=\S)|(?<=\S)_{1,2}(?!\w)"),
    "qdoc": _I(r"\\c\s+(?:\{(?P<code>[^}]*)\}|(?P<word>\S+))", r"\\l\s+\{[^}]*\}\s*\{(?P<text>[^}]*)\}", r"\\(?:l|e|b|i|uicontrol|tt|underline)\s+\{(?P<link>[^}]*)\}", r"\\(?:l|e|b|i|uicontrol|underline)\s+", r"\\[a-z]+\d?(?:\s*\{[^}]*\})?"),
}


def inline(block, text: str, base: int, form: str) -> None:
    """Appends a line's text without its marks; code is starred out at its length."""
    at = 0
    for m in INLINE[form].finditer(text):
        if m.start() < at:
            continue
        block.add(text[at : m.start()], base + at)
        at = m.end()
        for name, value in m.groupdict().items():
            if value:
                block.add("*" * len(value) if name in ("code", "word", "math") else value, base + m.start(name))
                break
    block.add(text[at:], base + at)


# ---------------------------------------------------------------- readers: (kind, place, text) by line

Piece = tuple[str, int, str]  # kind: "" paragraph, "+" goes on, "-" ends the block, else a scope


def _org(lines: list[Line]) -> Iterator[Piece]:
    i, n, quote = 0, len(lines), False
    while i < n:
        at, line = lines[i]
        s, low = line.strip(), line.strip().lower()
        i += 1
        if not s:
            yield "-", at, ""
        elif m := re.match(r"#\+begin_(\w+)", low):
            yield "-", at, ""
            if m.group(1) in ("quote", "verse", "center"):
                quote = m.group(1) == "quote"
            else:
                i = next((k + 1 for k in range(i, n) if lines[k][1].strip().lower() == f"#+end_{m.group(1)}"), n)
        elif low.startswith("#+end_"):
            quote = False
            yield "-", at, ""
        elif low.startswith("#+") or s == "#" or s.startswith("# "):
            yield "-", at, ""
        elif re.fullmatch(r":[A-Za-z_]+:", s):
            i = next((k + 1 for k in range(i, n) if lines[k][1].strip().lower() == ":end:"), i)
        elif m := re.match(r"^(\*+)\s+(?:(?:TODO|DONE)\s+)?(.*?)(?:\s+:[\w:@]+:)?\s*$", line):
            yield f".heading.h{min(6, len(m.group(1)))}", at + m.start(2), m.group(2)
            yield "-", at, ""
        elif s.startswith("|"):
            if not re.match(r"^\|[-+]+\|?$", s):
                head = i < n and bool(re.match(r"^\s*\|[-+]+\|?\s*$", lines[i][1]))
                for c in re.finditer(r"[^|]+", line):
                    yield ".table.header" if head else ".table.cell", at + c.start(), c.group()
            yield "-", at, ""
        elif s.startswith((": ", "\\[", "$$", "\\begin{")) or re.fullmatch(r"-{5,}", s) or s == ":":
            yield "-", at, ""
            if s[0] in "\\$":
                shut = {"\\[": "\\]", "$$": "$$"}.get(s[:2], "\\end{")
                i = next((k + 1 for k in range(i - 1, n) if shut in (lines[k][1] if k >= i else s[2:])), n)
        elif m := re.match(r"^(\s*)(?:[-+]|\d+[.)]|(?<=\s)\*)\s+(?:\[[ xX-]\]\s+)?", line):
            yield ".list", at + m.end(), line[m.end() :]
        else:
            lead = len(line) - len(line.lstrip())
            yield ".blockquote+" if quote else "+", at + lead, line[lead:]


_ADORN = re.compile(r"^([!-/:-@\[-`{-~])\1{2,}\s*$")


def _rst(lines: list[Line], styles: list[str] | None = None) -> Iterator[Piece]:
    styles = [] if styles is None else styles
    i, n = 0, len(lines)
    indent = lambda s: len(s.expandtabs()) - len(s.expandtabs().lstrip())

    def after(k: int, least: int) -> int:
        while k < n and (not lines[k][1].strip() or indent(lines[k][1]) >= least):
            k += 1
        return k

    def heading(style: str, at: int, line: str) -> Iterator[Piece]:
        if style not in styles:
            styles.append(style)
        lead = len(line) - len(line.lstrip())
        yield f".heading.h{min(6, styles.index(style) + 1)}", at + lead, line.strip()
        yield "-", at, ""

    literal = False
    while i < n:
        at, line = lines[i]
        s = line.strip()
        i += 1
        if not s:
            yield "-", at, ""
            if literal:
                k = next((k for k in range(i, n) if lines[k][1].strip()), n)
                if k < n and indent(lines[k][1]) > 0:
                    i = after(k, indent(lines[k][1]))
                literal = False
        elif s.startswith(".. ") or s == "..":
            yield "-", at, ""
            end = after(i, indent(line) + 1)
            m = re.match(r"\.\. ([\w:-]+)::\s*(.*)$", s)
            if m and m.group(1).lower() in PROSE:
                inner = [x for x in lines[i:end] if not re.match(r"\s*:[\w-]+:", x[1])]
                cut = min((indent(x) for _, x in inner if x.strip()), default=0)
                if m.group(2) and m.group(1) not in ("admonition", "topic", "versionadded", "versionchanged", "deprecated"):
                    yield "+", at + line.index(m.group(2)), m.group(2)
                yield from _rst([(a + min(cut, len(x)), x[cut:]) for a, x in inner], styles)
            i = max(end, i)
        elif _ADORN.match(line) and i + 1 < n and lines[i][1].strip() and _ADORN.match(lines[i + 1][1]) and lines[i + 1][1][0] == line[0]:
            yield from heading(line[0] * 2, *lines[i])
            i += 2
        elif i < n and _ADORN.match(lines[i][1]) and not _ADORN.match(line) and indent(line) == 0:
            yield "-", at, ""
            yield from heading(lines[i][1][0], at, line)
            i += 1
        elif re.match(r"^=+( +=+)+\s*$", s):
            rows, rules, first = [], 1, i
            while i < n and rules < 3 and lines[i][1].strip():
                if re.match(r"^=+( +=+)*\s*$", lines[i][1].strip()):
                    rules += 1
                    if rules == 2 and (i + 1 >= n or not lines[i + 1][1].strip()):
                        i += 1
                        break
                else:
                    rows.append((i, rules))
                i += 1
            for k, part in rows:
                for c in re.finditer(r"\S+(?: \S+)*", lines[k][1]):
                    yield ".table.header" if part == 1 and rules == 3 else ".table.cell", lines[k][0] + c.start(), c.group()
            yield "-", lines[first - 1][0], ""
        elif re.match(r"^\+[-=+]+\+\s*$", s) or s.startswith("|") and s.endswith("|"):
            if s[0] == "|":
                for c in re.finditer(r"[^|]+", line):
                    yield ".table.cell", at + c.start(), c.group()
            yield "-", at, ""
        elif re.match(r"^:[\w -]+:(\s|$)", s) or _ADORN.match(line):
            yield "-", at, ""
        elif m := re.match(r"^\s*(?:[-*+•]|#\.|\d+[.)]|\(?[a-z]\))\s+(?=\S)", line):
            yield ".list", at + m.end(), line[m.end() :]
        else:
            lead = len(line) - len(line.lstrip())
            body = line[lead:].rstrip()
            literal = body.endswith("::")
            if literal:
                body = body[:-1] if body[:-2].strip() and not body.endswith(" ::") else body[:-2]
            yield ".blockquote+" if lead and not line.startswith("\t") else "+", at + lead, body


def _adoc(lines: list[Line]) -> Iterator[Piece]:
    i, n, quote, table = 0, len(lines), False, False
    while i < n:
        at, line = lines[i]
        s = line.strip()
        i += 1
        if not s:
            yield "-", at, ""
        elif re.fullmatch(r"/{4,}|-{4,}|\.{4,}|\+{4,}|`{3,}\w*", s):
            shut = s if s[0] != "`" else "`" * (len(s) - len(s.lstrip("`")))
            yield "-", at, ""
            i = next((k + 1 for k in range(i, n) if lines[k][1].strip() == shut), n)
        elif s == "|===":
            table = not table
            yield "-", at, ""
        elif table:
            head = i > 1 and lines[i - 2][1].strip() == "|===" and i < n and not lines[i][1].strip()
            for c in re.finditer(r"(?<=\|)[^|]+", line):
                yield ".table.header" if head else ".table.cell", at + c.start(), c.group()
            yield "-", at, ""
        elif re.fullmatch(r"_{4,}|={4,}|\*{4,}|--", s):
            quote = not quote if s[0] == "_" else quote
            yield "-", at, ""
        elif s.startswith("//") or re.match(r"^:!?[\w-]+!?:(\s|$)", line) or re.fullmatch(r"\[[^\]]*\]", s) or re.match(r"^(ifdef|ifndef|endif|include|image|video)::", s) or s == "+":
            if s != "+":
                yield "-", at, ""
        elif m := re.match(r"^(={1,6})\s+(.*?)(?:\s+\1)?\s*$", line):
            yield f".heading.h{len(m.group(1))}", at + m.start(2), m.group(2)
            yield "-", at, ""
        elif m := re.match(r"^\.(?=\w)", s):
            yield ".figure.caption", at + line.index(".") + 1, s[1:]
            yield "-", at, ""
        elif m := re.match(r"^\s*(?:\*{1,5}|\.{1,5}|-|\d+\.)\s+(?:\[[ xX*]\]\s+)?(?=\S)", line):
            yield ".list", at + m.end(), line[m.end() :]
        else:
            m = re.match(r"^(?:(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION): )?", line)
            yield ".blockquote+" if quote else "+", at + m.end(), line[m.end() :]


def _qdoc(lines: list[Line]) -> Iterator[Piece]:
    """The comments ``/*! ... */`` of QDoc; in a ``.qdoc`` file nothing else is prose."""
    i, n, open_ = 0, len(lines), False
    while i < n:
        at, line = lines[i]
        i += 1
        if not open_:
            if (k := line.find("/*!")) < 0:
                continue
            open_, at, line = True, at + k + 3, line[k + 3 :]
        shut = line.find("*/")
        if shut >= 0:
            open_, line = False, line[:shut]
        m = re.match(r"^\s*(?:\*(?!/)\s?)?\s*", line)
        at, s = at + m.end(), line[m.end() :].rstrip()
        if not s:
            yield "-", at, ""
            continue
        if not (c := re.match(r"^\\([A-Za-z]+\d?)\s*", s)):
            yield "+", at, s
            continue
        name, rest, where = c.group(1), s[c.end() :], at + c.end()
        if name in QDOC_LITERAL:
            yield "-", at, ""
            if end := QDOC_LITERAL[name]:
                i = next((k + 1 for k in range(i, n) if re.search(rf"\\{end}\b", lines[k][1])), n)
        elif name in QDOC_HEADINGS:
            yield f".heading.h{QDOC_HEADINGS[name]}", where, rest
            yield "-", at, ""
        elif name in ("li", "o"):
            yield ".list", where, rest
        elif name in QDOC_PROSE:
            yield "-", at, ""
            if rest:
                yield "+", where, rest
        elif name in ("c", "l", "e", "b", "i", "uicontrol", "tt", "underline"):
            yield "+", at, s
        else:
            yield "-", at, ""  # a topic, image, snippet or index command


READERS = {"org": _org, "rst": _rst, "adoc": _adoc, "qdoc": _qdoc}


def light_blocks(text: str, ext: str, cfg: Config, form: str) -> list:
    """Blocks of a document in one of ``READERS``."""
    from inkwell.sources.blocks import Block

    control = re.compile(rf"^\s*(?:#|\.\.|//|<!--)\s*{re.escape(cfg.control_word)}\s+(off|on)\b")
    lines, quiet = [], False
    for at, line in lines_of(text):
        if m := control.match(line):
            quiet = m.group(1) == "off"
        lines.append((at, "" if quiet or m else line))
    out, now = [], None

    def close() -> None:
        nonlocal now
        if now is not None and (b := now.trimmed()):
            b.split = now.split
            out.append(b)
        now = None

    for kind, at, body in READERS[form](lines):
        if kind == "-":
            close()
            continue
        scope = f"text{kind.rstrip('+')}{ext}"
        goes_on = kind.endswith("+") and now is not None and (now.scope == scope or kind == "+" and now.scope == f"text.list{ext}")
        if not goes_on:
            close()
            now = Block(scope, split=kind.rstrip("+") in ("", ".list", ".blockquote"))
        elif len(now):
            now.add("\n", at - 1)
        inline(now, body, at, form)
    close()
    return out
