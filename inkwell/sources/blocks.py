"""Documents to scoped blocks of text, with exact places in the source.

A block's text is made of pieces of the source; ``runs`` say where each piece begins in the text
and in the source, so that a span of the text is found in the source by arithmetic.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from inkwell.functions.text import sentences
from inkwell.plans.config import Config
from inkwell.session import spread
from inkwell.sources.light import light_blocks, plain_mdx, plain_myst, plain_quarto

BLOCK_SCHEMA = (
    "doc_id long, block_seq int, scope string, sections array<string>, text string, line int, offset int, "
    "runs array<struct<at:int,src:int,n:int>>"
)

# Endings and the format each stands for, and the tags of the HTML reader.
FORMATS = {
    ".md": "md", ".markdown": "md", ".mdown": "md", ".qmd": "qmd", ".rmd": "qmd", ".mdx": "mdx", ".myst": "myst", ".rst": "rst", ".rest": "rst", ".adoc": "adoc", ".asciidoc": "adoc", ".asc": "adoc", ".qdoc": "qdoc", ".html": "html", ".htm": "html", ".xhtml": "html", ".txt": "txt", ".org": "org", ".json": "data", ".yml": "data", ".yaml": "data", ".toml": "data",
}
COMMENTS = {
    "c": (".c .h .cpp .cc .cxx .hpp .java .cs .swift .scala .kt .go .rs .js .jsx .ts .tsx .css .scss .sass .less .proto .qml", r"//[^\n]*|/\*.*?\*/", r'"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`'),
    "py": (".py .pyi .pyw", r'#[^\n]*|[rRuU]?"""(?:.*?)"""|[rRuU]?\'\'\'(?:.*?)\'\'\'', r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''),
    "php": (".php", r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/", r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\''),
    "jl": (".jl", r"#=.*?=#|#[^\n]*", r'"""(?:.*?)"""|"(?:\\.|[^"\\])*"'),
    "ps": (".ps1 .psm1", r"<#.*?#>|#[^\n]*", r'"(?:`.|[^"`])*"|\'[^\']*\''),
    "hash": (".rb .r .pl .pm .sh .bash", r"#[^\n]*|=begin.*?=end", r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''),
    "dash": (".hs .elm .lua .sql", r"--\[\[.*?\]\]|\{-.*?-\}|--[^\n]*", r'"(?:\\.|[^"\\\n])*"'),
    "semi": (".clj .lisp .el", r";[^\n]*", r'"(?:\\.|[^"\\])*"'),
}
CODE = {e: k for k, (es, *_) in COMMENTS.items() for e in es.split()}
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strong sub sup tt u var wbr br".split())
# Inline tags that are scopes of their own, for rules that ask for them.
INLINE_SCOPES = {"a": "link", "strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "code": "code", "tt": "code"}
SCOPE_TAGS = {"th": "table.header", "td": "table.cell", "li": "list", "blockquote": "blockquote", "caption": "table.caption", "figcaption": "figure.caption"}


class Block:
    """A scoped piece of text made of pieces of the source; appending and finding places stay linear in its length."""

    __slots__ = ("scope", "split", "runs", "inlines", "_pieces", "_size", "_starts")

    def __init__(self, scope: str, text: str = "", runs: list[tuple[int, int, int]] | None = None, split: bool = False):
        self.scope, self.split = scope, split
        self.runs: list[tuple[int, int, int]] = runs if runs is not None else []
        self._pieces, self._size = [text] if text else [], len(text)
        self._starts: list[int] | None = None
        self.inlines: list[tuple] = []  # (kind, begin, end) in the text, or (kind, code, source) of code, which is starred out there

    def __len__(self) -> int:
        return self._size

    @property
    def text(self) -> str:
        if len(self._pieces) > 1:
            self._pieces = ["".join(self._pieces)]
        return self._pieces[0] if self._pieces else ""

    def add(self, text: str, src: int, n: int | None = None) -> None:
        """Appends text that stands for ``n`` characters of the source at ``src``, by default its own length."""
        if not text:
            return
        n = len(text) if n is None else n
        if self.runs and n == len(text) and self.runs[-1][1] + self.runs[-1][2] == src and self.runs[-1][0] + self.runs[-1][2] == self._size:
            at, s, k = self.runs[-1]
            self.runs[-1] = (at, s, k + n)
        else:
            self.runs.append((self._size, src, min(n, len(text))))
        self._pieces.append(text)
        self._size += len(text)
        self._starts = None

    def join(self, other: Block, gap: str = "") -> None:
        """Appends another block after a gap that has no place."""
        at = self._size + len(gap)
        self.runs += [(at + a, s, n) for a, s, n in other.runs]
        self._pieces += [x for x in (gap, other.text) if x]
        self._size = at + len(other)
        self._starts = None

    def _run(self, at: int) -> int:
        if self._starts is None or len(self._starts) != len(self.runs):
            self._starts = [r[0] for r in self.runs]
        return bisect_right(self._starts, at) - 1

    def source(self, at: int) -> int:
        """The source offset of an offset in the text; -1 where the block has no place."""
        i = self._run(at)
        if i < 0:
            return -1
        a, s, n = self.runs[i]
        return s + min(at - a, n)

    def trimmed(self) -> Block | None:
        body = self.text.strip()
        if not body:
            return None
        lead = len(self.text) - len(self.text.lstrip())
        return self if len(body) == len(self) else self.part(lead, lead + len(body), self.scope)

    def part(self, a: int, b: int, scope: str) -> Block:
        """The text from ``a`` to ``b`` with the runs that touch it, found from both ends."""
        runs = []
        for at, s, n in self.runs[max(0, self._run(a)) : self._run(b - 1) + 1]:
            x, y = max(at, a), min(at + n, b)
            if x < y:
                runs.append((x - a, s + x - at, y - x))
        return Block(scope, self.text[a:b], runs, self.split)


def inline_blocks(b: Block, ext: str) -> list[Block]:
    """Links, strong and emphasized text and code of a block as blocks beside it; only rules that name them see these."""
    out = []
    for kind, a, e in b.inlines:
        out.append(Block(f"code{ext}", a, [(0, e, len(a))]) if kind == "code" else b.part(a, e, f"{kind}{ext}"))
    return [x for x in out if x.text.strip()]


_REWRITTEN = re.compile("&rsquo;|\r\n?")


class Source:
    """A document's text as it is read, and the places of its offsets in the document as stored.

    Line ends become line feeds and the quote entity its character. Lines and columns, and
    offsets by ``original``, are those of the text as stored.
    """

    def __init__(self, text: str):
        self.text = text
        self._at: list[int] = []  # offsets behind rewrites, in the text as read
        self._gone: list[int] = []  # characters that had gone by then
        self._quotes: list[int] = []
        if "\r" in text or "&rsquo;" in text:
            out, at, gone, size = [], 0, 0, 0
            for m in _REWRITTEN.finditer(text):
                new = "'" if m.group()[0] == "&" else "\n"
                out += [text[at : m.start()], new]
                size += m.start() - at + 1
                at = m.end()
                if len(m.group()) > 1:
                    gone += len(m.group()) - 1
                    self._at.append(size)
                    self._gone.append(gone)
                if new == "'":
                    self._quotes.append(size)
            self.text = "".join(out) + text[at:]
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def original(self, offset: int) -> int:
        """The offset in the text as stored."""
        i = bisect_right(self._at, offset)
        return offset + (self._gone[i - 1] if i else 0)

    def runs(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs by offsets in the text as stored, cut where something was rewritten."""
        if not self._at:
            return runs
        out = []
        for at, src, n in runs:
            x = src
            for y in [*self._at[bisect_right(self._at, src) : bisect_right(self._at, src + n - 1)], src + n]:
                out.append((at + x - src, self.original(x), y - x))
                x = y
        return out

    def place(self, offset: int) -> tuple[int, int]:
        """Line and column, both from 1."""
        offset = max(0, offset)
        line = bisect_right(self.starts, offset)
        begin = self.starts[line - 1]
        wider = 6 * (bisect_right(self._quotes, offset) - bisect_right(self._quotes, begin)) if self._quotes else 0
        return line, offset - begin + 1 + wider


def plain_blocks(text: str, ext: str, split: bool = True) -> list[Block]:
    """A text as one block; one of unknown format isn't split further."""
    return [Block(f"text{ext}", text, [(0, 0, len(text))], split)] if text else []


_TOKEN = re.compile(r"<!--(.*?)-->|<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", re.S)
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);")


def html_blocks(text: str, ext: str, cfg: Config, base: int = 0, blocks: list[Block] | None = None) -> list[Block]:
    """Blocks of HTML by its tokens, never as a tree: a block ends at any end tag that isn't inline.

    The tags seen since the last block's end give its scope; classes around it are added as
    ``class.<name>``; alternative texts are blocks; text between ``off`` and ``on`` comments is
    left out.
    """
    out = blocks if blocks is not None else []
    seen: list[str] = []
    classes: list[tuple[str, str]] = []
    skip: list[str] = []
    quiet = False
    now = Block("")
    control = re.compile(rf"\s*{re.escape(cfg.control_word)}\s+(off|on)\s*$")

    def scope() -> str:
        kind = next((SCOPE_TAGS[t] for t in seen if t in SCOPE_TAGS), None) or next((f"heading.{t}" for t in seen if re.fullmatch("h[1-6]", t)), None)
        names = "".join(f".class.{c}" for _, cs in classes for c in cs.split() if not re.search(r"[.&~]", c))
        if "data" in seen:
            return f"meta{names}{ext}"
        return "text" + (f".{kind}" if kind else "") + names + ext

    def flush() -> None:
        nonlocal now
        if not quiet and (b := now.trimmed()):
            b.scope = scope()
            b.split = b.scope in (f"text{ext}",) or "blockquote" in b.scope or "list" in b.scope
            out.append(b)
            if cfg.inline:
                out.extend(inline_blocks(now, ext))
        now = Block("")

    def literal(a: int, b: int) -> None:
        at = a
        mask = bool(set(seen[-1:]) & set(cfg.ignored_scopes)) or any(t in cfg.ignored_scopes for t in inline)
        for m in _ENTITY.finditer(text, a, b):
            now.add("*" * (m.start() - at) if mask else text[at : m.start()], base + at)
            now.add(html.unescape(m.group()), base + m.start(), len(m.group()))
            at = m.end()
        now.add("*" * (b - at) if mask else text[at:b], base + at)

    inline: list[str] = []
    opened: dict[str, tuple[int, int]] = {}
    at = 0
    for m in [*_TOKEN.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at and not skip:
            literal(at, end)
        if m is None:
            break
        at = m.end()
        if m.group(1) is not None:
            if c := control.match(m.group(1)):
                flush()
                quiet = c.group(1) == "off"
            continue
        if not m.group(3):
            continue
        tag, shut = m.group(3).lower(), bool(m.group(2))
        attrs = dict((k.lower(), v.strip("\"'")) for k, v in re.findall(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", m.group(4) or ""))
        ignored = tag in cfg.skipped_scopes or tag in ("head", "title", "svg") or bool(set(attrs.get("class", "").split()) & set(cfg.ignored_classes))
        if skip:
            if shut and tag == skip[-1]:
                skip.pop()
            elif not shut and tag == skip[-1]:
                skip.append(tag)
            continue
        if ignored and not shut and tag not in INLINE:
            flush()
            skip.append(tag)
            continue
        if tag in INLINE:
            if tag == "img" and attrs.get("alt"):
                where = base + m.start(4) + m.group(4).find(attrs["alt"])
                out.append(Block(f"text.attr.alt{ext}", attrs["alt"], [(0, where, len(attrs["alt"]))]))
            elif tag == "br":
                now.add(" ", base + m.start(), len(m.group()))
            elif shut and tag in inline:
                inline.remove(tag)
                if cfg.inline and tag in INLINE_SCOPES and tag in opened:
                    begin, src = opened.pop(tag)
                    now.inlines.append(("code", html.unescape(text[src : m.start()]), base + src) if INLINE_SCOPES[tag] == "code" else (INLINE_SCOPES[tag], begin, len(now)))
            elif not shut:
                inline.append(tag)
                opened[tag] = (len(now), at)
            continue
        flush()
        if shut:
            seen.clear()
            if any(t == tag for t, _ in classes):
                while classes.pop()[0] != tag:
                    pass  # elements left open inside end with it
            inline.clear()
            opened.clear()
        else:
            seen.append(tag)
            if tag in ("div", "section", "aside", "article", "p", "ul", "ol", "table"):
                classes.append((tag, attrs.get("class", "")))
    flush()
    return out


_MD_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<code>(`+)(?!`)(?P<body>.+?)(?<!`)\3(?!`))|(?P<com><!--.*?-->)|!?\[(?P<label>(?:[^\[\]]|\[[^\[\]]*\])*)\](?:\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[[^\[\]]*\])|(?P<foot>\[\^[^\]]+\])"
    r"|(?P<mark>\*\*|__|(?<![\w*])\*(?=\S)|(?<=\S)\*(?![\w*])|(?<!\w)_(?=\S)|(?<=\S)_(?!\w)|~~)|(?P<tag></?[A-Za-z][^<>]*>)|(?P<ent>&(?:#\d+|\w+);)", re.S
)


def _md_inline(b: Block, text: str, base: int) -> None:
    at, marks = 0, {}
    for m in _MD_INLINE.finditer(text):
        if m.start() < at:
            continue
        b.add(text[at : m.start()], base + at)
        at = m.end()
        if m.group("esc"):
            b.add(m.group()[1:], base + m.start() + 1)
        elif m.group("code"):
            b.inlines.append(("code", m.group("body"), base + m.start("body")))
            b.add("*" * len(m.group("body")), base + m.start("body"))
        elif m.group("label") is not None:
            begin = len(b)
            _md_inline(b, m.group("label"), base + m.start("label"))
            if m.group()[0] != "!":
                b.inlines.append(("link", begin, len(b)))
        elif m.group("ent"):
            b.add(html.unescape(m.group()), base + m.start(), len(m.group()))
        elif (mark := m.group("mark")) and mark != "~~":
            if mark in marks:
                b.inlines.append(("strong" if len(mark) == 2 else "emphasis", marks.pop(mark), len(b)))
            else:
                marks[mark] = len(b)
    b.add(text[at:], base + at)


def md_blocks(text: str, ext: str, cfg: Config) -> list[Block]:
    """Blocks of Markdown: headings, list items, quotes, table cells and paragraphs; code and metadata are left out."""
    out: list[Block] = []
    pos, lines = 0, []
    for line in text.split("\n"):
        lines.append((pos, line.rstrip("\r")))
        pos += len(line) + 1
    i, n = 0, len(lines)
    if n and lines[0][1] in ("---", "+++"):
        end = next((k for k in range(1, n) if lines[k][1] == lines[0][1]), None)
        if end is not None:
            for at, line in lines[1:end]:
                if m := re.match(r"([\w-]+)\s*[:=]\s*([\"']?)([^\"'\[{|>].*?)\2\s*$", line):
                    out.append(Block(f"text.frontmatter.{m.group(1)}{ext}", m.group(3), [(0, at + m.start(3), len(m.group(3)))]))
            i = end + 1
    quiet = False
    control = re.compile(rf"^\s*<!--\s*{re.escape(cfg.control_word)}\s+(off|on)\s*-->\s*$")
    open_block: Block | None = None
    skip_indent = False

    def close() -> None:
        nonlocal open_block
        if open_block is not None and not quiet and (b := open_block.trimmed()):
            b.split = open_block.split
            out.append(b)
            if cfg.inline:
                out.extend(inline_blocks(open_block, ext))
        open_block = None

    def piece(kind: str, body: str, at: int, split: bool = False) -> None:
        nonlocal open_block
        close()
        open_block = Block(f"text{kind}{ext}", split=split)
        _md_inline(open_block, body, at)

    while i < n:
        at, line = lines[i]
        s = line.strip()
        if not s:
            close()
            skip_indent = True
        elif m := control.match(line):
            close()
            quiet = m.group(1) == "off"
        elif m := re.match(r"^\s*(`{3,}|~{3,})", line):
            close()
            i = next((k for k in range(i + 1, n) if lines[k][1].strip().startswith(m.group(1))), n)
        elif s.startswith("$$"):
            close()
            if len(s) < 5 or not s.endswith("$$"):
                i = next((k for k in range(i + 1, n) if lines[k][1].strip().endswith("$$")), n)
        elif re.match(r"^ {0,3}\[[^\]]+\]:", line) or re.match(r"^ {0,3}([-*_])(\s*\1){2,}\s*$", line):
            if not (open_block is not None and set(s) <= {"-"} and open_block.scope == f"text{ext}"):
                close()
            else:
                open_block.scope, open_block.split = f"text.heading.h2{ext}", False
                close()
        elif open_block is not None and open_block.scope == f"text{ext}" and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            open_block.scope, open_block.split = f"text.heading.{'h1' if '=' in s else 'h2'}{ext}", False
            close()
        elif m := re.match(r"^ {0,3}(#{1,6})\s+(.*?)(\s+#+)?\s*$", line):
            piece(f".heading.h{len(m.group(1))}", m.group(2), at + m.start(2))
            close()
        elif re.match(r"^ {0,3}</?(\w+)", line) and re.match(r"^ {0,3}</?(\w+)", line).group(1).lower() not in INLINE:
            close()
            end = next((k for k in range(i, n) if not lines[k][1].strip()), n)
            stop = lines[end - 1][0] + len(lines[end - 1][1])
            if not quiet:
                html_blocks(text[at:stop], ext, cfg, at, out)
            i = end - 1
        elif m := re.match(r"^(\s*)(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?", line):
            piece(".list", line[m.end() :], at + m.end(), True)
        elif m := re.match(r"^ {0,3}>\s?", line):
            if open_block is not None and "blockquote" in open_block.scope:
                open_block.add("\n", at - 1)
                _md_inline(open_block, line[m.end() :], at + m.end())
            else:
                piece(".blockquote", line[m.end() :], at + m.end(), True)
        elif s.startswith("|") or (open_block is None and i + 1 < n and re.match(r"^[\s|:-]+$", lines[i + 1][1]) and "|" in line and "-" in lines[i + 1][1]):
            close()
            head = i + 1 < n and bool(re.match(r"^[\s|:-]*-[\s|:-]*$", lines[i + 1][1]))
            if not re.match(r"^[\s|:-]+$", line):
                for c in re.finditer(r"(?<!\\)[^|]+", line):
                    if c.group().strip():
                        lead = len(c.group()) - len(c.group().lstrip())
                        piece(".table.header" if head else ".table.cell", c.group().strip(), at + c.start() + lead)
                        close()
        elif re.match(r"^( {4}|\t)", line) and open_block is None and skip_indent:
            pass
        else:
            skip_indent = False
            if open_block is None:
                piece("", line, at, True)
            else:
                open_block.add("\n", at - 1)
                _md_inline(open_block, line, at)
        i += 1
    close()
    return out


def _docstring(text: str, at: int) -> bool:
    """Whether a string of Python that begins at an offset documents a module, class or function: it is the first statement."""
    k = at
    while k and text[k - 1] in " \t":
        k -= 1
    if k and text[k - 1] != "\n":
        return False
    while k:
        begin = text.rfind("\n", 0, k - 1) + 1
        line = text[begin : k - 1].split("#")[0].rstrip() if "#" in text[begin : k - 1] else text[begin : k - 1].rstrip()
        if line:
            return line.endswith(":")
        k = begin
    return True


def code_blocks(text: str, ext: str) -> list[Block]:
    """Comments of source code; lines of comments that follow each other at one indent are one block, string contents are no comments."""
    kind = CODE[ext.lower()]
    _, com, strings = COMMENTS[kind]
    out: list[Block] = []
    last: tuple[int, int] | None = None  # line and indent of the comment before
    src = Source(text)
    for m in re.finditer(rf"(?P<c>{com})|(?P<s>{strings})", text, re.S):
        if m.group("c") is None or m.start() == 0 and m.group().startswith("#!"):
            continue
        raw = m.group("c")
        if kind == "py" and raw[0] != "#" and not _docstring(text, m.start()):
            continue
        line, col = src.place(m.start())
        block = "\n" in raw or raw[:1] in "rRuU\"'" or raw.startswith(("/*", "{-", "--[[", "=begin", "#=", "<#"))
        b = Block(f"text.comment.{'block' if block else 'line'}{ext}")
        at = m.start()
        for k, part in enumerate(raw.split("\n")):
            lead = re.match(r"\s*(?:/\*+!?|\{-|--\[\[|[rRuU]?(?:\"\"\"|''')|=begin|#=|<#|///?!?|#+!?|-{2,}|;+|\*(?!/))?[ \t]?" if k == 0 or block else r"\s*", part).end()
            body = re.sub(r"\s*(?:\*+/|-\}|\]\]|\"\"\"|'''|=end|=#|#>)\s*$", "", part[lead:])
            b.add(body + ("\n" if k < raw.count("\n") else ""), at + lead)
            at += len(part) + 1
        if not block and last == (line - 1, col) and out and out[-1].scope == b.scope:
            out[-1].join(b, "\n")
        elif b.text.strip():
            out.append(b)
        last = None if block else (line, col)
    return [x for b in out if (x := b.trimmed())]


def data_blocks(text: str, ext: str, paths: dict[str, str] | None = None) -> list[Block]:
    """String values of JSON, YAML or TOML, by name; ``paths`` names the values wanted by dotted path, ``*`` for any part."""
    try:
        value = json.loads(text)
    except ValueError:
        import yaml

        try:
            if ext.lower() == ".toml":
                import tomllib

                value = tomllib.loads(text)
            else:
                value = yaml.safe_load(text)
        except (yaml.YAMLError, ValueError):
            return []
    found: list[tuple[str, str]] = []

    def walk(v, at: tuple[str, ...]) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, (*at, str(k)))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, (*at, str(i)))
        elif isinstance(v, str):
            if paths is None:
                found.append((".".join(at), v))
            for name, p in (paths or {}).items():
                parts = p.split(".")
                if len(parts) == len(at) and all(a in ("*", b) for a, b in zip(parts, at)):
                    found.append((name, v))

    walk(value, ())
    out, used = [], 0
    for name, v in found:
        where = text.find(v, used)  # values come in document order; each takes the first equal one not yet taken
        if where < 0:
            where = text.find(v)
        if where >= 0:
            used = where + len(v) if where >= used else used
        out.append(Block(f"text.{re.sub(r'[^A-Za-z0-9_-]+', '_', name)}{ext}", v, [(0, where, len(v))] if where >= 0 else [], True))
    return out


def sub_blocks(b: Block) -> list[Block]:
    """Paragraphs where the block is split, then sentences, then the block itself."""
    out = []
    if b.split:
        at = 0
        for part in re.findall(r".*?\n\n|.+\Z", b.text, re.S) or [b.text]:
            out.append(b.part(at, at + len(part), f"paragraph.{b.scope}"))
            at += len(part)
    if b.scope.startswith(("text", "meta")):
        out += [b.part(x, y, f"sentence.{b.scope}") for x, y in sentences(b.text)]
    return [*out, b]


DIALECTS = {"md": lambda t: t, "mdx": plain_mdx, "myst": plain_myst, "qmd": plain_quarto}


def fragments(comments: list[Block], cfg: Config, kind: str, ext: str) -> list[Block]:
    """Comments that hold markup, read as such; places go through the comment's runs back to the source."""
    out = []
    for c in comments:
        text = c.text
        inner = DIALECTS[kind](text) if kind in DIALECTS else text
        blocks = md_blocks(inner, ext, cfg) if kind in DIALECTS else light_blocks(text, ext, cfg, kind) if kind in ("org", "rst", "adoc", "qdoc") else html_blocks(text, ext, cfg)
        for b in blocks:
            b.runs = [(at + x - src, c.source(x), y - x) for at, src, n in b.runs for x, y in _cut_at(c, src, src + n)]
            b._starts = None
            out.append(b)
    return out


def _cut_at(c: Block, a: int, b: int) -> list[tuple[int, int]]:
    """A stretch of a block's text cut where its runs end, so that each part lies together in the source."""
    cuts = sorted({a, b, *(at for at, _, _ in c.runs if a < at < b)})
    return list(zip(cuts, cuts[1:]))


def document_blocks(text: str | None, ext: str | None, cfg: Config, nested: bool = True, ignores: tuple[list[str], list[str]] = ([], []), shown: bool = False) -> list[Block]:
    """All blocks of a document in the order they are linted: text blocks with their parts, ``raw``, then ``summary``.

    With ``shown``, only the text that the readers see, as one block.
    """
    if not text:
        return []
    ext = cfg.formats.get((ext or "").lower(), (ext or ".txt").lower())
    seen = text
    for pattern in [*ignores[0], *ignores[1]]:
        seen = re.sub(pattern, lambda m: re.sub(r"[^\n]", "*", m.group()), seen)  # ignored text keeps its length
    if shown:
        return plain_blocks(seen, ext)
    kind = None if cfg.ignore_syntax else FORMATS.get(ext)
    if kind in DIALECTS:
        top = md_blocks(DIALECTS[kind](seen), ext, cfg)
    elif kind in ("org", "rst", "adoc", "qdoc"):
        top = light_blocks(seen, ext, cfg, kind)
    elif kind == "html":
        top = html_blocks(seen, ext, cfg)
    elif kind == "data":
        top = data_blocks(seen, ext, cfg.view)
    elif ext.lower() in CODE and not cfg.ignore_syntax:
        top = code_blocks(seen, ext)
        if fragment := FORMATS.get(cfg.fragments.get(ext, "")):
            top = fragments(top, cfg, fragment, cfg.fragments[ext])
    else:
        top = plain_blocks(seen, ext, kind == "txt")
        nested = nested and kind == "txt"
    out = [x for b in top for x in (sub_blocks(b) if nested else [b])]
    out.append(Block(f"raw{ext}", text, [(0, 0, len(text))]))
    if kind not in (None, "txt", "data"):
        prose = [b for b in top if b.scope.startswith("text") and not any(k in b.scope for k in (".heading", ".table", ".attr", ".frontmatter"))]
        s = Block(f"summary{ext}")
        for i, b in enumerate(prose):
            s.join(b, "\n\n" if i else "")
        if len(s):
            out.append(s)
    return out


def extract_blocks(docs: DataFrame, cfg: Config | None = None, nested: bool = False, key: str = "doc_id", text: str = "text", ext: str = "ext") -> DataFrame:
    """``docs`` as blocks (``BLOCK_SCHEMA``), read where they lie without a shuffle. Null texts have none."""
    import pandas as pd

    cfg = cfg or Config()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t, e in zip(pdf["k"], pdf["t"], pdf["e"]):
                if t:
                    src = Source(t)
                    for i, b in enumerate(document_blocks(src.text, e, cfg, nested)):
                        at = b.source(0)
                        runs = [{"at": a, "src": s, "n": n} for a, s, n in src.runs(b.runs)]
                        rows.append((k, i, b.scope, b.scope.split("."), b.text, src.place(at)[0] if at >= 0 else 1, src.original(at) if at >= 0 else at, runs))
            yield pd.DataFrame(rows, columns=["doc_id", "block_seq", "scope", "sections", "text", "line", "offset", "runs"]).astype({"doc_id": "int64", "block_seq": "int32", "line": "int32", "offset": "int32"})

    cols = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t", f"{ext} AS e").where("k IS NOT NULL")
    return spread(cols, "k").mapInPandas(run, BLOCK_SCHEMA)


def tag_counts(text: str | None) -> dict[str, int]:
    """How often each start tag stands in a page, ``table`` and its parts left out."""
    out: dict[str, int] = {}
    for m in _TOKEN.finditer(text or ""):
        if m.group(3) and not m.group(2) and not m.group(3).lower().startswith("table"):
            t = m.group(3).lower()
            out[t] = out.get(t, 0) + 1
    return out


def block_counts(blocks: list[Block]) -> dict[str, int]:
    """How many blocks of each kind a document has, as metric formulas name them; those of tables are left out."""
    out: dict[str, int] = {}
    for b in blocks:
        parts = b.scope.split(".")
        if parts[0] != "text":
            continue
        kind = "heading_" + parts[2] if parts[1] == "heading" else parts[1] if len(parts) > 2 else "paragraphs"
        if not kind.startswith(("table", "class", "attr", "frontmatter")):
            out[kind] = out.get(kind, 0) + 1
    return out
