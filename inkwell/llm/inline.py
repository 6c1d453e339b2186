"""Text inside a block: marks taken off, labels kept, escapes and entities resolved."""

from __future__ import annotations

import html
import re
from functools import lru_cache

from inkwell.llm.leaves import BLOCK_TAGS, TAG, braced

_S, _SI = int(re.S), int(re.S | re.I)  # joined once, not at every call
_rx = lru_cache(maxsize=None)(re.compile)


def _sub(pattern: str, to, text: str, flags: int = 0) -> str:
    return _rx(pattern if isinstance(pattern, str) else pattern.pattern, flags).sub(to, text)


_SPACE = re.compile(r"\s+")
_HELD = re.compile("\ue000(\\d+)\ue001")
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
# The inline tags of HTML; other names in angle brackets are text in light markup.
INLINE_TAGS = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr math ref".split()
)


def squeeze(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


def unescape(s: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m.group()), s)


class Cleaner:
    """Cleans one block; ``formulas`` then has the formulas met in it, in order."""

    def __init__(self, form: str):
        self.form = form
        self.held: list[str] = []
        self.formulas: list[str] = []

    def hold(self, s: str) -> str:
        """Stands for text that no later rule may touch."""
        self.held.append(s)
        return f"\ue000{len(self.held) - 1}\ue001"

    def formula(self, tex: str) -> str:
        tex = squeeze(self.restore(tex))
        if tex:
            self.formulas.append(tex)
        return self.hold(tex)

    def restore(self, s: str) -> str:
        while _HELD.search(s):
            s = _HELD.sub(lambda m: self.held[int(m.group(1))], s)
        return s

    def clean(self, raw: str) -> str:
        raw = _sub("[\ue000\ue001]", lambda m: " ", raw)
        return squeeze(self.restore(getattr(self, self.form)(raw)))

    # -- HTML, alone and inside other formats

    def tags(self, s: str, every: bool) -> str:
        s = _sub(r"<!--.*?(?:-->|\Z)", "", s, flags=_S)
        s = _sub(r"<(script|style)\b[^>]*>.*?</\1\s*>", "", s, flags=_SI)
        s = _sub(
            r"<(span|div)\b[^>]*class\s*=\s*[\"']?[^\"'>]*\bmath\b[^>]*>(.*?)</\1\s*>",
            lambda m: self.formula(undelimited(unescape(_sub(TAG, "", m.group(2))))), s, flags=_SI,
        )
        s = _sub(r"<(code|kbd|samp|tt)\b[^>]*>(.*?)</\1\s*>", lambda m: self.hold(unescape(_sub(TAG, "", m.group(2)))), s, flags=_SI)

        def tag(m):
            name = m.group(2).lower()
            if name == "br":
                return " "
            return "" if every or name in INLINE_TAGS or name in BLOCK_TAGS else m.group()

        return TAG.sub(tag, s)

    def html(self, s: str) -> str:
        s = self.tags(s, True)
        s = _sub(r"\\\((.+?)\\\)", lambda m: self.formula(unescape(m.group(1))), s, flags=_S)
        s = _sub(r"\\\[(.+?)\\\]", lambda m: self.formula(unescape(m.group(1))), s, flags=_S)
        return unescape(s)

    # -- Markdown

    def md(self, s: str) -> str:
        def literal(m):
            if m.group(1):
                return self.hold(m.group(1)) if m.group(1) != "\n" else " "
            if m.group(2):
                code = m.group(3)
                strip = code.startswith(" ") and code.endswith(" ") and code.strip()
                return self.hold(code[1:-1] if strip else code)
            if m.group(4) is not None:
                return self.formula(m.group(4))
            if m.group(5) is not None:
                return self.formula(m.group(5))
            return self.hold(m.group(6))

        s = _sub(
            r"\\([!-/:-@\[-`{-~\n])|(?<!`)(`+)(?!`)(.+?)(?<!`)\2(?!`)|\$\$(.+?)\$\$|(?<![\w$])\$(?=[^\s$])([^$]*?[^\s$\\]|\S)\$(?![\d$])|<((?:https?|ftp|mailto):[^\s<>]+)>",
            literal, _hold_math(s, self), flags=_S,
        )
        s = self.tags(s, False)
        s = _sub(r"\[\^[^\]\s]+\]", "", s)
        for _ in range(3):
            new = _sub(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*(?:<[^>]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)(?:\{[^{}]*\})?", r"\1", s)
            new = _sub(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])+)\]\s?\[[^\[\]]*\]", r"\1", new)
            if new == s:
                break
            s = new
        s = _sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", s, flags=_S)
        s = _sub(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])", r"\1", s, flags=_S)
        s = _sub(r"(?<!\w)_(?=[^\s_])(.+?)(?<=[^\s_])_(?!\w)", r"\1", s, flags=_S)
        s = _sub(r"\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*", r"\1", s)
        s = _sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", s, flags=_S)
        s = _sub(r"\s*\{#[\w:-]+\}\s*$", "", s)
        return unescape(s)

    # -- reStructuredText

    def rst(self, s: str) -> str:
        def literal(m):
            if m.group(1) is not None:
                return self.hold(m.group(1))
            if m.group(2) == "math":
                return self.formula(m.group(3))
            if m.group(2):
                body = _sub(r"\s*<[^<>]*>$", "", m.group(3)) if re.search(r"\S\s*<[^<>]*>$", m.group(3)) else m.group(3)
                return self.hold(body)
            return "" if m.group(4).isspace() else self.hold(m.group(4))

        s = _sub(r"``(.+?)``(?=\W|$)|:([a-zA-Z][\w:-]*):`([^`]+)`|\\(.)", literal, s, flags=_S)
        s = _sub(r"`([^`<]+?)\s*<[^`<>]*>`__?", r"\1", s)
        s = _sub(r"`([^`]+)`__?", r"\1", s)
        s = _sub(r"`([^`]+)`(?::[a-z]+:)?", r"\1", s)
        s = _sub(r"\s*\[(?:\d+|#[\w-]*|\*|[A-Za-z][\w-]*)\]_(?!\w)", "", s)
        s = _sub(r"(?<![\w*])\*\*(?=\S)(.+?)(?<=\S)\*\*(?!\w)", r"\1", s, flags=_S)
        s = _sub(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])", r"\1", s, flags=_S)
        s = _sub(r"(?<!\w)\|(?=\S)([^|\n]+?)(?<=\S)\|_?(?!\w)", r"\1", s)
        return _sub(r"\b([\w-]*[A-Za-z0-9])__?(?!\w)", r"\1", s)

    # -- Org

    def org(self, s: str) -> str:
        s = _sub(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$", lambda m: self.formula(next(g for g in m.groups() if g is not None)), s, flags=_S)
        around, after = r"(?<![^\s({\['\"“«—–-])", r"(?![^\s)}\]'\"”».,;:!?…—–-])"
        for mark in ("~", "="):
            s = _sub(rf"{around}{mark}(?=\S)([^{mark}]+?)(?<=\S){mark}{after}", lambda m: self.hold(m.group(1)), s)
        s = _sub(r"(?<![\w$])\$(?=[^\s$.,;])([^$\n]*?[^\s$.,]|\S)\$(?!\w)", lambda m: self.formula(m.group(1)), s)
        s = _sub(r"\s*\[fn:[^\[\]]*\]", "", s)
        s = _sub(r"\[\[([^\[\]]*)\]\[([^\[\]]*)\]\]", r"\2", s)
        s = _sub(r"\[\[([^\[\]]*)\]\]", r"\1", s)
        for _ in range(2):
            for mark in ("*", "/", "_", "+"):
                e = re.escape(mark)
                s = _sub(rf"{around}{e}(?=\S)([^{e}]+?)(?<=\S){e}{after}", r"\1", s)
        return s

    # -- AsciiDoc

    def adoc(self, s: str) -> str:
        s = _sub(r"(?:stem|latexmath|asciimath):\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]", lambda m: self.formula(m.group(1).replace("\\]", "]")), s)
        s = _sub(r"`\+(.+?)\+`", lambda m: self.hold(m.group(1)), s)
        s = _sub(r"\+\+\+?(.+?)\+\+\+?", lambda m: self.hold(m.group(1)), s)
        s = _sub(r"(?<![\w`])``?(?=\S)(.+?)(?<=\S)``?(?![\w`])", lambda m: self.hold(unescape(m.group(1))), s, flags=_S)
        s = _sub(r"pass:[a-z]*\[([^\]]*)\]", lambda m: self.hold(m.group(1)), s)
        s = _sub(r"(?<!\w)\+(?=\S)([^+\n]+?)(?<=\S)\+(?!\w)", lambda m: self.hold(m.group(1)), s)
        s = _sub(r"\\(?=[*_`#\[{+^~<&])(.)", lambda m: self.hold(m.group(1)), s)
        s = _sub(r"\s*footnote(?:ref)?:[\w-]*\[(?:[^\[\]]|\[[^\[\]]*\])*\]", "", s)
        s = _sub(r"(?:link|mailto|xref):(?:\+\+)?[^\s\[]+\[([^\[\]]*)\]", lambda m: m.group(1).split(",window")[0].rstrip("^"), s)
        s = _sub(r"\b(?:https?|ftp|irc)://[^\s\[\]]+\[([^\[\]]*)\]", lambda m: m.group(1).split(",window")[0].rstrip("^"), s)
        s = _sub(r"<<[^<>,]*,\s*([^<>]*)>>", r"\1", s)
        s = _sub(r"\[\[[^\]]*\]\]|\(\(\([^)]*\)\)\)", "", s)
        s = _sub(r"\[[.#\w-]*\](?=[#*_`])", "", s)
        for mark in ("*", "_", "#"):
            e = re.escape(mark)
            s = _sub(rf"{e}{e}(?=\S)(.+?)(?<=\S){e}{e}", r"\1", s, flags=_S)
            s = _sub(rf"(?<![\w{e}]){e}(?=[^\s{e}])(.+?)(?<=[^\s{e}]){e}(?![\w{e}])", r"\1", s, flags=_S)
        s = _sub(r" \+(?=\n|$)", " ", s)
        return unescape(s)

    # -- wiki text

    def wiki(self, s: str) -> str:
        s = _sub(r"<!--.*?(?:-->|\Z)", "", s, flags=_S)
        s = _sub(r"<nowiki>(.*?)</nowiki>", lambda m: self.hold(unescape(m.group(1))), s, flags=_SI)
        s = _sub(r"<math\b[^>]*>(.*?)</math>", lambda m: self.formula(unescape(m.group(1))), s, flags=_SI)
        s = _sub(r"\s*<ref\b[^>/]*/>|\s*<ref\b[^>]*>.*?</ref>|<nowiki\s*/>|<references[^>]*>", "", s, flags=_SI)
        s = self.tags(s, False)
        while (new := _sub(r"\{\{[^{}]*\}\}", "", s)) != s:
            s = new
        s = _sub(r"\[\[(?:Category|File|Image|Kategorie|Catégorie|Categoría|Категория)\s*:[^\[\]]*\]\]", "", s)
        s = _sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]+)\]\]", r"\1", s)
        s = _sub(r"\[(?:https?|ftp|mailto):\S+\s+([^\[\]]+)\]", r"\1", s)
        s = _sub(r"\[((?:https?|ftp):[^\s\[\]]+)\]", "", s)
        s = _sub(r"'{5}(.+?)'{5}", r"\1", s, flags=_S)
        s = _sub(r"'''(.+?)'''", r"\1", s, flags=_S)
        s = _sub(r"''(.+?)''", r"\1", s, flags=_S)
        return unescape(s)

    # -- LaTeX

    def tex(self, s: str) -> str:
        s = _sub(r"\\verb\*?([^a-zA-Z\s])(.*?)\1", lambda m: self.hold(m.group(2)), s, flags=_S)
        s = _sub(r"\\\((.+?)\\\)|(?<!\\)\$([^$]+?)(?<!\\)\$|\\begin\{math\}(.+?)\\end\{math\}", lambda m: self.formula(next(g for g in m.groups() if g is not None)), s, flags=_S)
        return self._commands(s)

    def _commands(self, s: str) -> str:
        out: list[str] = []
        k = 0
        while k < len(s):
            c = s[k]
            if c == "%":
                k = s.find("\n", k) + 1 or len(s)
            elif c in "{}":
                k += 1
            elif c == "~":
                out.append(" ")
                k += 1
            elif c != "\\":
                out.append(c)
                k += 1
            elif m := re.match(r"\\([A-Za-z]+)\*?", s[k : k + 40]):
                name, k = m.group(1), k + m.end()
                if name in _SYMBOLS:
                    out.append(self.hold(_SYMBOLS[name]))
                    if s[k : k + 2] == "{}":
                        k += 2
                    elif s[k : k + 1] == " ":
                        k += 1
                    continue
                while s[k : k + 1] == "[" and (e := s.find("]", k)) > 0:
                    k = e + 1
                args = []
                while s[k : k + 1] == "{" and len(args) < _ARGS.get(name, 1):
                    e = braced(s, k)
                    args.append(s[k + 1 : e - 1])
                    k = e
                if name in _DROPPED:
                    if out and name in ("footnote", "footnotemark", "label"):
                        out[-1] = out[-1] if name == "label" else out[-1].rstrip(" ")
                elif args:
                    out.append(self.hold(self.restore(self._commands(args[-1]))) if name in ("texttt", "url", "path", "code") else self._commands(args[-1]))
                elif name in ("newline", "par", "quad", "qquad", "item", "linebreak"):
                    out.append(" ")
            else:
                nxt = s[k + 1 : k + 2]
                if nxt == "\\":
                    out.append(" ")
                    k += 2
                elif nxt in ",;: !\n/-@":
                    out.append(" " if nxt in ", ;:\n" else "")
                    k += 2
                elif m := re.match(r"\\([`'^\"~=.])\{?\\?([A-Za-z])\}?", s[k : k + 6]):
                    import unicodedata

                    mark = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇"}[m.group(1)]
                    out.append(unicodedata.normalize("NFC", m.group(2) + mark))
                    k += m.end()
                else:
                    out.append(self.hold(nxt))
                    k += 2
        return "".join(out).replace("``", "“").replace("''", "”")


# LaTeX commands that stand for a character, and those whose argument is no text.
_SYMBOLS = {
    "textless": "<", "textgreater": ">", "textasciitilde": "~", "textbackslash": "\\", "textasciicircum": "^", "textbar": "|", "ldots": "…", "dots": "…",
    "textunderscore": "_", "textdollar": "$", "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å", "S": "§", "P": "¶", "copyright": "©", "euro": "€",
    "textendash": "–", "textemdash": "—", "LaTeX": "LaTeX", "TeX": "TeX", "textquotesingle": "'", "lbrace": "{", "rbrace": "}",
}
_DROPPED = set("footnote footnotemark footnotetext label ref eqref pageref cite citep citet index vspace hspace includegraphics centering noindent bigskip medskip smallskip pagestyle thispagestyle begin end caption".split())
_ARGS = {"href": 2, "textcolor": 2, "vspace": 1, "centering": 0, "noindent": 0, "bigskip": 0, "medskip": 0, "smallskip": 0, "begin": 1}


def _hold_math(s: str, c: Cleaner) -> str:
    """TeX brackets in Markdown are escapes, but for those of embedded HTML."""
    return _sub(
        r"<(span|div)\b[^>]*class\s*=\s*[\"']?[^\"'>]*\bmath\b[^>]*>(.*?)</\1\s*>",
        lambda m: c.formula(undelimited(unescape(m.group(2)))), s, flags=_SI,
    )


def undelimited(s: str) -> str:
    """TeX without the marks around it."""
    s = s.strip()
    for a, b in (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$")):
        if s.startswith(a) and s.endswith(b) and len(s) >= len(a) + len(b):
            return s[len(a) : len(s) - len(b)].strip()
    return _sub(r"^\\begin\{(\w+)\*?\}(.*)\\end\{\1\*?\}$", r"\2", s, flags=_S).strip()
