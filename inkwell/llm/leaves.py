"""Markup to leaf blocks: one small document tree for every format.

A leaf is a block that holds text and no further blocks. Each format's reader gives leaves
with the containers around them, the mark that opens them as it stands in the text (``##``, ``-``,
``.. note::``, ``\\item``; the adornment below a line as ``_=``), a depth where the format states
one, and the raw text between the marks. What a leaf *is* (paragraph, item, residue...) is left to
the sequence model: no reader says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Leaf:
    tags: tuple[str, ...]
    text: str
    depth: int = 0
    form: str = ""  # how the text is marked up inside
    attrs: str = field(default="")
    mark: str = ""  # what opens the block, as written


# File name endings of the formats.
ENDINGS = {
    "md": ".md .markdown .mdown .mkd .qmd .rmd .mdx .myst",
    "html": ".html .htm .xhtml",
    "rst": ".rst .rest",
    "org": ".org",
    "adoc": ".adoc .asc .asciidoc .ad",
    "wiki": ".wiki .mediawiki .mw",
    "tex": ".tex .latex .ltx",
}
BY_ENDING = {e: f for f, es in ENDINGS.items() for e in es.split()}

CUES = {
    "html": [(r"(?i)^\s*(<!doctype html|<html)", 6), (r"(?i)<(p|h[1-6]|ul|ol|table|div|blockquote|pre)\b[^>]*>", 2), (r"(?im)^</?(body|head|ul|p)\b", 1)],
    "tex": [(r"\\documentclass|\\begin\{document\}", 6), (r"\\(sub)*section\*?\{", 5), (r"\\(begin|end|emph|textbf|href|item)\b", 3)],
    "wiki": [(r"(?m)^(=+)[^=\n]+\1\s*$", 3), (r"'''|(?<!')''(?!')", 2), (r"\[\[[^\]\n]*\]\](?!\()|<math>|<syntaxhighlight|<nowiki>|^\{\|", 3)],
    "rst": [(r"(?m)^\.\. [\w-]+::|:[a-z]+:`|`__\b|`_\b|`__", 4), (r"(?m)^\S.*\n([=\-~^\"#*+])\1{3,}\s*$", 2), (r"(?m)^#\. ", 2)],
    "org": [(r"(?im)^#\+(begin|title|options|end)", 5), (r"(?m)^:PROPERTIES:", 5), (r"\[\[[^\]]+\]\[[^\]]+\]\]", 4), (r"(?m)^\*{2,} \S", 2)],
    "adoc": [(r"(?m)^\[(source|stem)|^\|===|^//-|stem:\[", 4), (r"(?m)^={1,5} \S[^=\n]*$", 3), (r"https?://\S+\[", 3), (r"(?m)^-{4,}$", 1)],
    "md": [(r"(?m)^#{1,6} \S", 2), (r"\]\(\S+\)|\]\[\w+\]", 3), (r"(?m)^(```|~~~)", 3), (r"(?m)^\|?[ :]*-{3,}[ :]*\|", 2), (r"(?m)^---\n", 1), (r"(?m)^[-=]{4,}$", 1)],
}
_CUES = {f: [(re.compile(p), w) for p, w in xs] for f, xs in CUES.items()}


def guess_format(text: str, normed_ext: str | None = None, real_ext: str | None = None) -> str:
    """The format by cues in the text, with the endings as hints; Markdown where nothing speaks."""
    score = {f: sum(w for p, w in xs if p.search(text)) for f, xs in _CUES.items()}
    for ext, w in ((normed_ext, 3), (real_ext, 4)):
        if ext and (f := BY_ENDING.get(ext.lower())):
            score[f] += w
    return max(score, key=lambda f: (score[f], f == "md"))


def leaves_of(text: str, form: str) -> list[Leaf]:
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    return _READERS[form](text)


# ---------------------------------------------------------------- HTML

TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|" + TAG.pattern, re.S)
# Tags that begin or end a block, and those whose content is raw.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = {"script", "style", "template", "noscript", "textarea"}
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "col", "source", "wbr"}
_CLOSED_BY = {"p": BLOCK_TAGS, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def html_leaves(text: str, within: tuple[str, ...] = ("html",)) -> list[Leaf]:
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    buf: list[str] = []
    row: list[str] | None = None

    def path() -> tuple[str, ...]:
        return within + tuple(t for t, _ in stack)

    def flush() -> None:
        nonlocal buf
        raw = "".join(buf)
        buf = []
        if not raw.strip():
            return
        if row is not None and any(t in ("td", "th") for t, _ in stack):
            row[-1] += raw
            return
        tags = [t for t, _ in stack]
        depth = next((int(t[1]) for t in reversed(tags) if re.fullmatch("h[1-6]", t)), 0) or sum(t in ("ul", "ol", "menu", "dir") for t in tags)
        out.append(Leaf(path(), raw, depth, "html", " ".join(a for _, a in stack[-2:])))

    def close_to(i: int) -> None:
        nonlocal row
        while len(stack) > i:
            flush()
            tag = stack[-1][0]
            if tag == "tr" and row is not None:
                if row:
                    out.append(Leaf(path(), "\x00".join(row), 0, "html"))
                row = None
            stack.pop()

    at = 0
    while m := _TOKEN.search(text, at):
        buf.append(text[at : m.start()])
        at = m.end()
        if not m.group(2):
            if m.group().startswith("<!--"):
                flush()
                out.append(Leaf(path(), m.group(), 0, "html", mark="<!--"))
            continue
        tag, shut = m.group(2).lower(), bool(m.group(1))
        if tag in RAW_TAGS and not shut:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            flush()
            out.append(Leaf(path() + (tag,), text[at : end.start() if end else len(text)], 0, "html"))
            at = end.end() if end else len(text)
            continue
        if tag not in BLOCK_TAGS:
            buf.append(m.group())
            continue
        if shut:
            flush()
            if (i := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)) is not None:
                close_to(i)
            continue
        flush()
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            close_to(len(stack) - 1)
        if tag == "hr":
            continue
        if tag == "tr":
            row = []
        elif tag in ("td", "th") and row is not None:
            row.append("")
        stack.append((tag, m.group(3)))
    buf.append(text[at:])
    close_to(0)
    flush()
    return out


# ---------------------------------------------------------------- Markdown

_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})\s*(\S*)")
_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])(\s+)(?=\S)")
_HTML_START = re.compile(r"^ {0,3}</?(" + "|".join(sorted(BLOCK_TAGS | RAW_TAGS)) + r")\b", re.I)
_RULER = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def _indent(s: str) -> int:
    return len(s.expandtabs(4)) - len(s.expandtabs(4).lstrip())


def md_cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip() for c in re.split(r"(?<!\\)\|", line)]


def md_leaves(text: str) -> list[Leaf]:
    out: list[Leaf] = []
    lines = text.split("\n")
    i, n = 0, len(lines)
    while i < n and not lines[i].strip():
        i += 1
    if i < n and lines[i].rstrip() in ("---", "+++"):
        end = next((k for k in range(i + 1, n) if lines[k].rstrip() == lines[i].rstrip() or lines[k].rstrip() == "..."), None)
        if end is not None:
            out.append(Leaf(("md",), "\n".join(lines[i + 1 : end]), 0, "md", mark=lines[i].strip()))
            i = end + 1
    para: list[str] = []
    quote = False
    items: list[int] = []  # indents of the open items
    blank = True

    def flush() -> None:
        nonlocal para, quote
        if para:
            out.append(Leaf(("md",), "\n".join(para), 0, "md", mark=">" if quote else ""))
        para, quote = [], False

    open_item: Leaf | None = None
    while i < n:
        line = lines[i]
        s = line.strip()
        if not s:
            flush()
            open_item, blank = None, True
            i += 1
            continue
        if (m := _FENCE.match(line)) or (items and (m := _FENCE.match(line.lstrip()))):
            flush()
            close = re.compile(rf"^\s*{re.escape(m.group(2)[0])}{{{len(m.group(2))},}}\s*$")
            end = next((k for k in range(i + 1, n) if close.match(lines[k])), n)
            out.append(Leaf(("md",), "\n".join(lines[i + 1 : end]), 0, "md", m.group(3), m.group(2)))
            i, open_item = end + 1, None
            continue
        if s.startswith("<!--"):
            flush()
            end = i
            while end < n - 1 and "-->" not in lines[end]:
                end += 1
            rest = lines[end].partition("-->")[2]
            out.append(Leaf(("md",), "\n".join(lines[i : end + 1]), 0, "md", mark="<!--"))
            i = end + 1
            if rest.strip():
                para.append(rest)
            continue
        if s.startswith("$$"):
            flush()
            if len(s) > 4 and s.endswith("$$"):
                out.append(Leaf(("md",), s, 0, "md", mark="$$"))
                i += 1
                continue
            end = next((k for k in range(i + 1, n) if lines[k].strip().endswith("$$")), n - 1)
            out.append(Leaf(("md",), "\n".join(lines[i : end + 1]), 0, "md", mark="$$"))
            i = end + 1
            continue
        if m := re.match(r"^ {0,3}\[\^([^\]]+)\]:", line):
            flush()
            end = i + 1
            while end < n and (lines[end].startswith(("    ", "\t")) or (lines[end].strip() and not re.match(r"^ {0,3}\[", lines[end]) and lines[end - 1].strip())):
                end += 1
            out.append(Leaf(("md",), "\n".join(lines[i:end]), 0, "md", mark="[^]:"))
            i = end
            continue
        if not para and re.match(r"^ {0,3}\[[^\]]+\]:\s*\S+", line):
            out.append(Leaf(("md",), line, 0, "md", mark="[]:"))
            i += 1
            continue
        if m := re.match(r"^ {0,3}(#{1,6})(\s+(.*?))?(\s+#+)?\s*$", line):
            flush()
            items, open_item = [], None
            out.append(Leaf(("md",), m.group(3) or "", len(m.group(1)), "md", mark=m.group(1)))
            i += 1
            continue
        if para and not quote and (m := re.match(r"^ {0,3}(=+|-+)\s*$", line)):
            body, para = "\n".join(para), []
            out.append(Leaf(("md",), body, 1 if m.group(1)[0] == "=" else 2, "md", mark="_" + m.group(1)))
            items, open_item = [], None
            i += 1
            continue
        if re.match(r"^ {0,3}([-*_])(\s*\1){2,}\s*$", line):
            flush()
            out.append(Leaf(("md",), line, 0, "md", mark=m.group(1) if (m := re.match(r"\s*(\S)", line)) else ""))
            i += 1
            continue
        if s.startswith(":::") or re.match(r"^\{%.*%\}$|^\{\{[<%].*[>%]\}\}$", s):
            flush()
            out.append(Leaf(("md",), line, 0, "md", mark=s[:2]))
            i += 1
            continue
        if "|" in s and i + 1 < n and not para and "|" in lines[i + 1] and _RULER.match(lines[i + 1]):
            k = i
            while k < n and lines[k].strip() and "|" in lines[k]:
                if k != i + 1:
                    out.append(Leaf(("md", "|"), "\x00".join(md_cells(lines[k])), 0, "md", mark="|"))
                k += 1
            i, open_item = k, None
            continue
        if _HTML_START.match(line) and not para:
            end = i
            raw = re.match(r"^\s*<(script|style|pre|textarea)\b", line, re.I)
            while end < n and (f"</{raw.group(1).lower()}" not in lines[end].lower() if raw else lines[end].strip()):
                end += 1
            end = min(n, end + 1 if raw else end)
            out.extend(html_leaves("\n".join(lines[i:end]), ("md", "html")))
            i, open_item = end, None
            continue
        if m := re.match(r"^ {0,3}> ?(.*)$", line):
            if not quote:
                flush()
            if not m.group(1).strip():
                flush()
            else:
                quote = True
                para.append(m.group(1))
            i += 1
            continue
        if (m := _ITEM.match(line)) and (not para or not m.group(2)[0].isdigit() or open_item or blank):
            ind = _indent(line)
            if not (blank and not items and ind >= 4):
                flush()
                while items and ind < items[-1] + 2 and ind <= items[-1] + 1:
                    items.pop()
                items.append(ind)
                body = line[m.end() :]
                body = re.sub(r"^\[[ xX]\]\s+", "", body)
                open_item = Leaf(("md",), body, len(items), "md", mark=m.group(2))
                out.append(open_item)
                blank = False
                i += 1
                continue
        if open_item is not None and not para:
            open_item.text += "\n" + s  # a lazy or indented continuation
            i += 1
            continue
        if blank and not para and _indent(line) >= 4 and not items:
            end = i
            while end < n and (not lines[end].strip() or _indent(lines[end]) >= 4):
                end += 1
            out.append(Leaf(("md",), "\n".join(lines[i:end]), 0, "md", mark="    "))
            i = end
            continue
        if blank and items and _indent(line) < 2:
            items = []
        para.append(line)
        blank = False
        i += 1
    flush()
    return out


# ---------------------------------------------------------------- reStructuredText

_ADORN = re.compile(r"^([!-/:-@\[-`{-~])\1{2,}\s*$")


def rst_leaves(text: str) -> list[Leaf]:
    out: list[Leaf] = []
    lines = text.split("\n")
    i, n = 0, len(lines)
    styles: list[str] = []
    items: list[int] = []

    def level(style: str) -> int:
        if style not in styles:
            styles.append(style)
        return styles.index(style) + 1

    def block(k: int, least: int) -> int:
        """The end of the indented block from line k."""
        while k < n and (not lines[k].strip() or _indent(lines[k]) >= least):
            k += 1
        return k

    while i < n:
        line = lines[i]
        s = line.strip()
        if not s:
            i += 1
            continue
        ind = _indent(line)
        if s.startswith(".. ") or s == "..":
            end = block(i + 1, ind + 1)
            body = lines[i + 1 : end]
            if m := re.match(r"\.\. ([\w:-]+)::\s*(.*)$", s):
                name, arg = m.group(1).lower(), m.group(2)
                while body and re.match(r"\s*:[\w-]+:", body[0]):
                    body = body[1:]
                if name in ("code-block", "code", "sourcecode", "parsed-literal", "literalinclude", "highlight"):
                    out.append(Leaf(("rst",), "\n".join(body), 0, "rst", arg, f".. {name}::"))
                elif name == "math":
                    out.append(Leaf(("rst",), "\n".join([arg, *body]), 0, "rst", mark=f".. {name}::"))
                elif name in ("note", "warning", "tip", "important", "caution", "attention", "hint", "danger", "error", "admonition", "epigraph", "pull-quote"):
                    cut = min((_indent(x) for x in body if x.strip()), default=0)
                    inner = "\n".join(x[cut:] for x in body)
                    out.extend(rst_leaves((arg + "\n" + inner) if arg and name != "admonition" else inner))
                else:
                    out.append(Leaf(("rst",), "\n".join([s, *body]), 0, "rst", mark=f".. {name}::"))
            elif re.match(r"\.\. \[[^\]]+\]", s):
                out.append(Leaf(("rst",), "\n".join([s, *body]), 0, "rst", mark=".. []"))
            elif re.match(r"\.\. (_|__)", s) or re.match(r"\.\. \|", s):
                out.append(Leaf(("rst",), "\n".join([s, *body]), 0, "rst", mark=s[:4]))
            else:
                out.append(Leaf(("rst",), "\n".join([s, *body]), 0, "rst", mark=".."))
            i = max(end, i + 1)
            continue
        if re.match(r"^=+( +=+)+\s*$", s):
            k, rows, rulers = i + 1, [], 1
            while k < n and rulers < 3 and lines[k].strip():
                if re.match(r"^=+( +=+)*\s*$", lines[k].strip()):
                    rulers += 1
                    if rulers == 2 and (k + 1 >= n or not lines[k + 1].strip()):
                        k += 1
                        break
                elif not re.match(r"^[-=]+( +[-=]+)*$", lines[k].strip()):
                    rows.append(re.split(r"\s{2,}", lines[k].strip()))
                k += 1
            out.extend(Leaf(("rst", "= ="), "\x00".join(r), 0, "rst") for r in rows)
            i = k
            continue
        if re.match(r"^\+[-=+]+\+\s*$", s):
            k = i
            while k < n and lines[k].strip()[:1] in "+|" and lines[k].strip():
                if lines[k].strip().startswith("|"):
                    out.append(Leaf(("rst", "+-+"), "\x00".join(md_cells(lines[k])), 0, "rst", mark="|"))
                k += 1
            i = k
            continue
        if _ADORN.match(line) and i + 2 < n and lines[i + 1].strip() and _ADORN.match(lines[i + 2]) and lines[i + 2][0] == line[0]:
            out.append(Leaf(("rst",), lines[i + 1].strip(), level(line[0] * 2), "rst", mark="_" + line.strip()))
            i, items = i + 3, []
            continue
        if ind == 0 and i + 1 < n and _ADORN.match(lines[i + 1]) and not _ADORN.match(line) and (len(lines[i + 1].strip()) >= 3):
            out.append(Leaf(("rst",), s, level(lines[i + 1][0]), "rst", mark="_" + lines[i + 1].strip()))
            i, items = i + 2, []
            continue
        if _ADORN.match(line) and len(s) >= 4:
            out.append(Leaf(("rst",), s, 0, "rst", mark=s[0]))
            i += 1
            continue
        if m := re.match(r"^(\s*)([-*+•]|#\.|\d+[.)]|\(?[a-z]\))(\s+)(?=\S)", line):
            while items and ind <= items[-1]:
                items.pop()
            items.append(ind)
            k, body = i + 1, [line[m.end() :]]
            while k < n and lines[k].strip() and _indent(lines[k]) > ind:
                body.append(lines[k].strip())
                k += 1
            out.append(Leaf(("rst",), "\n".join(body), len(items), "rst", mark=m.group(2)))
            i = k
            continue
        if ind == 0:
            items = []
        k, body = i, []
        while k < n and lines[k].strip() and (k == i or _indent(lines[k]) == ind or ind == 0):
            body.append(lines[k].strip())
            k += 1
        literal = body[-1].endswith("::")
        if re.match(r"^:[\w -]+:(\s|$)", s) and ind == 0:
            out.append(Leaf(("rst",), "\n".join(body), 0, "rst", mark=":x:"))
        elif body != ["::"]:
            if literal:
                body[-1] = body[-1][:-1].rstrip() if not body[-1].endswith(" ::") else body[-1][:-2].rstrip()
            out.append(Leaf(("rst",), "\n".join(body), 0, "rst", mark="  " if ind else ""))
        i = k
        if literal:
            end = block(i, ind + 1)
            out.append(Leaf(("rst",), "\n".join(lines[i:end]), 0, "rst", mark="::"))
            i = max(i, end)
    return out


# ---------------------------------------------------------------- Org

def org_leaves(text: str) -> list[Leaf]:
    out: list[Leaf] = []
    lines = text.split("\n")
    i, n = 0, len(lines)
    items: list[int] = []
    para: list[str] = []

    def flush(quote: bool = False) -> None:
        nonlocal para
        if para:
            out.append(Leaf(("org", "quote") if quote else ("org",), "\n".join(para), 0, "org"))
        para = []

    quote = False
    open_item: Leaf | None = None
    while i < n:
        line = lines[i]
        s = line.strip()
        low = s.lower()
        if not s:
            flush(quote)
            open_item = None
            i += 1
            continue
        if m := re.match(r"#\+begin_(\w+)", low):
            kind = m.group(1)
            flush(quote)
            open_item = None
            if kind in ("quote", "verse", "center"):
                quote = True
                i += 1
                continue
            end = next((k for k in range(i + 1, n) if lines[k].strip().lower() == f"#+end_{kind}"), n)
            body = [re.sub(r"^(\s*),(?=[*,]|#\+)", r"\1", x) for x in lines[i + 1 : end]]
            out.append(Leaf(("org",), "\n".join(body), 0, "org", mark=f"#+begin_{kind}"))
            i = end + 1
            continue
        if re.match(r"#\+end_", low):
            flush(quote)
            quote = False
            i += 1
            continue
        if low.startswith("#+") or s == "#" or s.startswith("# "):
            flush(quote)
            out.append(Leaf(("org",), s, 0, "org", mark=s[:2].strip()))
            i += 1
            continue
        if re.fullmatch(r":[A-Z_]+:", s):
            flush(quote)
            end = next((k for k in range(i + 1, n) if lines[k].strip() == ":END:"), i)
            out.append(Leaf(("org",), "\n".join(lines[i : end + 1]), 0, "org", mark=":X:"))
            i = end + 1
            continue
        if m := re.match(r"^(\*+)\s+(.*)$", line):
            flush(quote)
            items, open_item = [], None
            out.append(Leaf(("org",), re.sub(r"\s+:[\w:@]+:$", "", re.sub(r"^(TODO|DONE)\s+", "", m.group(2))), len(m.group(1)), "org", mark=m.group(1) + " "))
            i += 1
            continue
        if re.match(r"\[fn:[^\]]*\]", s) and not para and line[0] == "[":
            out.append(Leaf(("org",), s, 0, "org", mark="[fn:]"))
            i += 1
            while i < n and lines[i].strip() and not lines[i].startswith("[fn:"):
                out[-1].text += "\n" + lines[i]
                i += 1
            continue
        if s.startswith(("\\[", "$$", "\\begin{")):
            flush(quote)
            shut = {"\\[": "\\]", "$$": "$$"}.get(s[:2], "\\end{")
            end = next((k for k in range(i, n) if shut in (lines[k] if k > i else lines[k].strip()[2:])), n - 1)
            out.append(Leaf(("org",), "\n".join(lines[i : end + 1]), 0, "org", mark=s[:2]))
            i, open_item = end + 1, None
            continue
        if s.startswith("|"):
            flush(quote)
            if not re.match(r"^\|[-+]+\|?$", s):
                out.append(Leaf(("org", "|"), "\x00".join(md_cells(s)), 0, "org", mark="|"))
            i, open_item = i + 1, None
            continue
        if s.startswith(": ") or s == ":":
            flush(quote)
            k = i
            while k < n and lines[k].strip().startswith(":"):
                k += 1
            out.append(Leaf(("org",), "\n".join(x.strip()[2:] for x in lines[i:k]), 0, "org", mark=":"))
            i = k
            continue
        if re.fullmatch(r"-{5,}", s):
            flush(quote)
            out.append(Leaf(("org",), s, 0, "org", mark=s[0]))
            i += 1
            continue
        if m := re.match(r"^(\s*)([-+]|\d+[.)]|(?<=\s)\*)(\s+)(?=\S)", line):
            flush(quote)
            ind = _indent(line)
            while items and ind <= items[-1]:
                items.pop()
            items.append(ind)
            open_item = Leaf(("org",), re.sub(r"^\[[ xX-]\]\s+", "", line[m.end() :]), len(items), "org", mark=m.group(2))
            out.append(open_item)
            i += 1
            continue
        if open_item is not None and not para and _indent(line) > items[-1]:
            open_item.text += "\n" + s
            i += 1
            continue
        open_item = None
        if not para and _indent(line) == 0:
            items = []
        para.append(s)
        i += 1
    flush(quote)
    return out


# ---------------------------------------------------------------- AsciiDoc

def adoc_leaves(text: str) -> list[Leaf]:
    out: list[Leaf] = []
    lines = text.split("\n")
    i, n = 0, len(lines)
    para: list[str] = []
    attr = ""
    quote = False
    open_item: Leaf | None = None

    def flush() -> None:
        nonlocal para
        if para:
            out.append(Leaf(("adoc", "____") if quote else ("adoc",), "\n".join(para), 0, "adoc"))
        para = []

    while i < n:
        line = lines[i]
        s = line.strip()
        if not s:
            flush()
            open_item = None
            i += 1
            continue
        if re.fullmatch(r"/{4,}", s):
            flush()
            end = next((k for k in range(i + 1, n) if lines[k].strip() == s), n)
            out.append(Leaf(("adoc",), "\n".join(lines[i : end + 1]), 0, "adoc", mark="////"))
            i = end + 1
            continue
        if s.startswith("//") and not s.startswith("///"):
            flush()
            out.append(Leaf(("adoc",), s, 0, "adoc", mark="//"))
            i, open_item = i + 1, None
            continue
        if re.fullmatch(r"(-{4,}|\.{4,}|\+{4,}|`{3,}\w*)", s):
            flush()
            shut = s if s[0] != "`" else "`" * (len(s) - len(s.lstrip("`")))
            end = next((k for k in range(i + 1, n) if lines[k].strip() == shut), n)
            out.append(Leaf(("adoc",), "\n".join(lines[i + 1 : end]), 0, "adoc", attr, s[:4] + " " + "".join(re.findall(r"^\[\w*", attr))))
            i, attr, open_item = end + 1, "", None
            continue
        if s == "|===":
            flush()
            end = next((k for k in range(i + 1, n) if lines[k].strip() == "|==="), n)
            for x in lines[i + 1 : end]:
                if x.strip().startswith("|"):
                    cells = [c.strip() for c in re.split(r"(?<!\\)\|", x.strip())[1:]]
                    out.append(Leaf(("adoc", "|==="), "\x00".join(cells), 0, "adoc", mark="|"))
                elif x.strip() and out and out[-1].tags[-1] == "|===":
                    out[-1].text += " " + x.strip()
            i, attr, open_item = end + 1, "", None
            continue
        if re.fullmatch(r"(_{4,}|={4,}|\*{4,}|--)", s):
            flush()
            if s[0] == "_":
                quote = not quote
            attr = ""
            i += 1
            continue
        if not para and (m := re.match(r"^(={1,6})\s+(.*?)(\s+\1)?$", line)):
            open_item = None
            out.append(Leaf(("adoc",), m.group(2), len(m.group(1)), "adoc", mark=m.group(1)))
            i += 1
            continue
        if re.match(r"^:!?[\w-]+!?:(\s|$)", line):
            flush()
            out.append(Leaf(("adoc",), s, 0, "adoc", mark=":x:"))
            i += 1
            continue
        if re.fullmatch(r"\[[^\]]*\]", s) and not para or re.fullmatch(r"\[\[[^\]]*\]\]", s) or re.match(r"^(ifdef|ifndef|endif|include)::", s):
            flush()
            attr = s
            out.append(Leaf(("adoc",), s, 0, "adoc", mark="[]" if s[0] == "[" else "x::"))
            i += 1
            continue
        if m := re.match(r"^\s*(\*{1,5}|\.{1,5}|-|\d+\.)\s+(?=\S)", line):
            flush()
            depth = len(m.group(1)) if m.group(1)[0] in "*." else 1
            open_item = Leaf(("adoc",), line[m.end() :], depth, "adoc", mark=m.group(1) + " ")
            out.append(open_item)
            i += 1
            continue
        if not para and re.match(r"^\.\w", s):
            out.append(Leaf(("adoc",), s[1:], 0, "adoc", mark=".x"))
            i += 1
            continue
        if open_item is not None and not para:
            open_item.text += "\n" + s if s != "+" else ""
            i += 1
            continue
        para.append(re.sub(r"^(NOTE|TIP|IMPORTANT|WARNING|CAUTION): ", "", s) if not para else s)
        i += 1
    flush()
    return out


# ---------------------------------------------------------------- wiki text

def wiki_leaves(text: str) -> list[Leaf]:
    out: list[Leaf] = []
    held: list[tuple[str, str]] = []

    def hold(tag):
        def f(m):
            held.append((tag, m.group(1) if m.groups() else m.group()))
            return f"\n\x01{len(held) - 1}\x01\n"

        return f

    text = re.sub(r"<!--.*?(?:-->|\Z)", hold("<!--"), text, flags=re.S)
    text = re.sub(r"<(?:syntaxhighlight|source|pre)\b[^>]*>(.*?)</(?:syntaxhighlight|source|pre)>", hold("<source>"), text, flags=re.S | re.I)
    text = re.sub(r"<math\b[^>]*display\s*=\s*[\"']?block[^>]*>(.*?)</math>", hold("<math>"), text, flags=re.S | re.I)
    while (new := re.sub(r"(?m)^\s*\{\{[^{}]*\}\}\s*$", hold("{{"), text)) != text:
        text = new
    lines = text.split("\n")
    i, n = 0, len(lines)
    para: list[str] = []

    def flush() -> None:
        nonlocal para
        if para:
            out.append(Leaf(("wiki",), "\n".join(para), 0, "wiki"))
        para = []

    while i < n:
        s = lines[i].strip()
        if not s:
            flush()
        elif m := re.fullmatch(r"\x01(\d+)\x01", s):
            flush()
            mark, body = held[int(m.group(1))]
            out.append(Leaf(("wiki",), body, 0, "wiki", mark=mark))
        elif m := re.match(r"^(={1,6})\s*(.+?)\s*\1\s*$", s):
            flush()
            out.append(Leaf(("wiki",), m.group(2), len(m.group(1)), "wiki", mark=m.group(1)))
        elif re.fullmatch(r"(\[\[\s*(Category|Kategorie|Catégorie|Categoría|Категория|File|Image|[a-z]{2,3})\s*:[^\]]*\]\]\s*)+|__[A-Z]+__|#REDIRECT.*", s):
            flush()
            out.append(Leaf(("wiki",), s, 0, "wiki", mark=s[:2] + ":"))
        elif re.fullmatch(r"-{4,}", s):
            flush()
            out.append(Leaf(("wiki",), s, 0, "wiki", mark=s[0]))
        elif s.startswith("{|"):
            flush()
            row: list[str] = []

            def end_row() -> None:
                nonlocal row
                if row:
                    out.append(Leaf(("wiki", "{|"), "\x00".join(row), 0, "wiki", mark="|"))
                row = []

            i += 1
            while i < n and not lines[i].strip().startswith("|}"):
                x = lines[i].strip()
                if x.startswith("|-"):
                    end_row()
                elif x.startswith("|+"):
                    out.append(Leaf(("wiki", "{|"), x[2:], 0, "wiki", mark="|+"))
                elif x[:1] in ("|", "!"):
                    for c in re.split(r"\|\|" if x[0] == "|" else r"!!|\|\|", x[1:]):
                        row.append(re.sub(r"^\s*(?:\w+\s*=\s*(?:\"[^\"]*\"|\S+)\s*)+\|(?!\|)", "", c).strip())
                elif x and row:
                    row[-1] += " " + x
                i += 1
            end_row()
        elif m := re.match(r"^([*#:;]+)\s*(.*)$", s):
            flush()
            marks = m.group(1)
            if marks.strip(":"):
                out.append(Leaf(("wiki",), m.group(2), len(marks), "wiki", mark=marks + " "))
            else:
                out.append(Leaf(("wiki",), m.group(2), 0, "wiki", mark=marks))
        elif m := re.match(r"^</?blockquote>\s*$", s, re.I):
            flush()
        elif lines[i].startswith(" ") and not para:
            k = i
            while k < n and lines[k].startswith(" ") and lines[k].strip():
                k += 1
            out.append(Leaf(("wiki",), "\n".join(lines[i:k]), 0, "wiki", mark=" "))
            i = k
            continue
        else:
            para.append(s)
        i += 1
    flush()
    return out


# ---------------------------------------------------------------- LaTeX

_MATH_ENVS = r"equation|align|gather|multline|displaymath|eqnarray|math"


def braced(text: str, at: int) -> int:
    """The offset after the group that opens at ``at``."""
    depth, k = 0, at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        depth += (c == "{") - (c == "}")
        k += 1
        if depth == 0:
            return k
    return len(text)


def tex_leaves(text: str) -> list[Leaf]:
    out: list[Leaf] = []
    if (m := re.search(r"\\begin\{document\}", text)):
        out.append(Leaf(("tex",), text[: m.start()], 0, "tex", mark=text[: m.start()].lstrip()[:9]))
        text = text[m.end() :]
        if (m := re.search(r"\\end\{document\}", text)):
            text = text[: m.start()]
    depth, quote = 0, 0
    buf: list[str] = []
    stack: list[bool] = []  # whether an item is open at each depth

    def flush() -> None:
        nonlocal buf
        raw = "".join(buf)
        buf = []
        for part in re.split(r"\n\s*\n", raw):
            if not part.strip():
                continue
            if depth and stack and stack[-1]:
                out.append(Leaf(("tex", "list"), part, depth, "tex", mark="\\item"))
                stack[-1] = False
            else:
                out.append(Leaf(("tex", "quote") if quote else ("tex",), part, 0, "tex"))

    rx = re.compile(
        r"(?<!\\)%[^\n]*\n?|\\begin\{(verbatim|lstlisting|minted|Verbatim)\*?\}(?:\[[^\]]*\])?(.*?)\\end\{\1\*?\}"
        rf"|\\begin\{{(({_MATH_ENVS})\*?)\}}(.*?)\\end\{{\3\}}|\\\[(.*?)\\\]|\$\$(.*?)\$\$"
        r"|\\begin\{(tabularx?|longtable|array)\*?\}(.*?)\\end\{\8\*?\}"
        r"|\\((?:sub)*(?:section|paragraph)|chapter|part)\*?(?:\[[^\]]*\])?\{|\\begin\{(\w+)\*?\}(?:\[[^\]]*\])?|\\end\{(\w+)\*?\}|\\item\b(?:\[[^\]]*\])?"
        r"|\\(?:title|author|date|bibliography|bibliographystyle|input|include|usepackage|documentclass|maketitle|tableofcontents)\b(?:\[[^\]]*\])?"
        r"|\\verb\*?([^a-zA-Z\s]).*?\13|\\(?:href|url)\{[^{}]*\}",
        re.S,
    )
    at = 0
    while m := rx.search(text, at):
        buf.append(text[at : m.start()])
        at = m.end()
        t = m.group()
        if t.startswith("%"):
            if text[: m.start()].rpartition("\n")[2].strip() == "":
                flush()
                out.append(Leaf(("tex",), t, 0, "tex", mark="%"))
        elif t.startswith(("\\verb", "\\href", "\\url")):
            buf.append(t)
        elif m.group(1):
            flush()
            out.append(Leaf(("tex",), m.group(2), 0, "tex", mark=f"\\begin{{{m.group(1)}}}"))
        elif m.group(3):
            flush()
            out.append(Leaf(("tex",), m.group(5), 0, "tex", mark=f"\\begin{{{m.group(4)}}}"))
        elif m.group(6) is not None or m.group(7) is not None:
            flush()
            out.append(Leaf(("tex",), m.group(6) if m.group(6) is not None else m.group(7), 0, "tex", mark=t[:2]))
        elif m.group(8):
            flush()
            body = m.group(9)
            if body.lstrip().startswith("{"):
                body = body.lstrip()
                body = body[braced(body, 0) :]
            body = re.sub(r"\\(hline|toprule|midrule|bottomrule)|\\cline\{[^}]*\}", "", body)
            for row in re.split(r"\\\\(?:\[[^\]]*\])?", body):
                if row.strip():
                    out.append(Leaf(("tex", m.group(8)), "\x00".join(re.split(r"(?<!\\)&", row)), 0, "tex", mark="&"))
        elif m.group(10):
            flush()
            end = braced(text, at - 1)
            name = m.group(10)
            out.append(Leaf(("tex",), text[at : end - 1], {"section": 1, "chapter": 1, "part": 1}.get(name, name.count("sub") + 1), "tex", mark="\\" + name))
            at = end
        elif m.group(11):
            flush()
            if m.group(11) in ("itemize", "enumerate", "description"):
                depth += 1
                stack.append(False)
            elif m.group(11) in ("quote", "quotation", "verse"):
                quote += 1
        elif m.group(12):
            flush()
            if m.group(12) in ("itemize", "enumerate", "description") and depth:
                depth -= 1
                stack.pop()
            elif m.group(12) in ("quote", "quotation", "verse"):
                quote = max(0, quote - 1)
        elif t.startswith("\\item"):
            flush()
            if stack:
                stack[-1] = True
        else:
            flush()
            end = braced(text, at) if text[at : at + 1] == "{" else at
            out.append(Leaf(("tex",), t + text[at:end], 0, "tex", mark=re.match(r"\\[a-z]+", t).group()))
            at = end
    buf.append(text[at:])
    flush()
    return out


_READERS = {"html": html_leaves, "md": md_leaves, "rst": rst_leaves, "org": org_leaves, "adoc": adoc_leaves, "wiki": wiki_leaves, "tex": tex_leaves}
