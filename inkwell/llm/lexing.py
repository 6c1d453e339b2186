"""Comments and strings of source code, by finite automata that can start anywhere.

A file is cut into chunks. Each chunk's effect is a function from the lexer's state before it
to the state after it; the functions are composed by a prefix scan, so every chunk learns its
own start state and all chunks are then read independently of each other.

A chunk is a run of *units*: lines, and parts of lines over ``LONG_LINE`` characters. Units depend
on the text alone, so what is read of them doesn't depend on where chunks end.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Characters in a chunk, and in the longest line that is read in one.
CHUNK, LONG_LINE = 65536, 16384

_C = {"//": "line", "/*": "block:*/", '"': 'str:"'}
_CHAR = {"'\"'": "code", "'\\''": "code", "'\\\"'": "code"}
# The marks of each family of languages, and the endings of its files.
FAMILIES: dict[str, tuple[dict[str, str], str]] = {
    "c": (_C | _CHAR, ".c .h .cpp .cc .cxx .hpp .java .cs .swift .kt .scala .rs .proto .m"),
    "go": (_C | _CHAR | {"`": "raw:`"}, ".go"),
    "js": (_C | {"'": "str:'", "`": "str:`"}, ".js .jsx .mjs .ts .tsx .qml .dart"),
    "php": (_C | {"'": "str:'", "#": "line"}, ".php"),
    "css": ({"/*": "block:*/", '"': 'str:"', "'": "str:'"}, ".css .scss .sass .less"),
    "py": ({"#": "line", '"""': 'str:"""', "'''": "str:'''", '"': 'str:"', "'": "str:'"}, ".py .pyi .rpy"),
    "rb": ({"#": "line", "=begin": "block:=end", '"': 'str:"', "'": "str:'"}, ".rb .gemspec"),
    "sh": ({"#": "line", '"': 'str:"', "'": "raw:'"}, ".sh .bash .zsh .yml .yaml .toml .r .pl .pm .ps1 .tcl .mk"),
    "jl": ({"#": "line", "#=": "block:=#", '"""': 'str:"""', '"': 'str:"'} | _CHAR, ".jl"),
    "hs": ({"--": "line", "{-": "block:-}", '"': 'str:"'} | _CHAR, ".hs .elm"),
    "lua": ({"--": "line", "--[[": "block:]]", "[[": "raw:]]", '"': 'str:"', "'": "str:'"}, ".lua"),
    "sql": ({"--": "line", "/*": "block:*/", "'": "raw:'", '"': 'raw:"'}, ".sql"),
    "clj": ({";": "line", '"': 'str:"'}, ".clj .lisp .scm .el"),
    "any": ({"//": "line", "/*": "block:*/", '"""': 'str:"""', '"': 'str:"', "# ": "line", "-- ": "line"}, ""),
}
BY_ENDING = {e: f for f, (_, es) in FAMILIES.items() for e in es.split()}


def family(*endings: str | None) -> str:
    """The family of a file by its endings; the first known one counts."""
    return next((BY_ENDING[e.lower()] for e in endings if e and e.lower() in BY_ENDING), "any")


class Lexer:
    """The automaton of one family. A state is a mode and the beginning of a mark not yet complete."""

    def __init__(self, name: str):
        marks = FAMILIES[name][0]
        self.modes: dict[str, dict[str, str]] = {"code": marks, "line": {"\n": "code"}}
        for mode in set(marks.values()) - {"code", "line"}:
            kind, _, shut = mode.partition(":")
            self.modes[mode] = {shut: "code"}
            if kind == "str" and len(shut) == 1 and shut != "`":
                self.modes[mode] |= {"\n": "code"}
        self.escapes = {m for m in self.modes if m.startswith("str:")}
        self._find = {}
        for m, ts in self.modes.items():
            alts = [re.escape(t) for t in sorted(ts, key=len, reverse=True)]
            self._find[m] = re.compile("|".join(([r"\\(?s:.)"] if m in self.escapes else []) + alts))
        self._build()

    def step(self, mode: str, pending: str, c: str) -> tuple[str, str]:
        """The state after one more character."""
        buf = pending + c
        while buf:
            marks = self.modes[mode]
            if mode in self.escapes and buf[0] == "\\":
                if len(buf) == 1:
                    return mode, buf
                buf = buf[2:]
            elif any(t.startswith(buf) and t != buf for t in marks):
                return mode, buf
            elif hit := max((t for t in marks if buf.startswith(t)), key=len, default=""):
                mode, buf = marks[hit], buf[len(hit) :]
            else:
                buf = buf[1:]
        return mode, ""

    def _build(self) -> None:
        signs = sorted({c for ts in self.modes.values() for t in ts for c in t} | {"\\", "\n"})
        self.signs = {c: i + 1 for i, c in enumerate(signs)}
        other = next(chr(c) for c in range(0xE000, 0xE100))
        self.states: list[tuple[str, str]] = [("code", "")]
        seen = {self.states[0]: 0}
        table: list[list[int]] = []
        for at in self.states:  # grows while it is read
            row = []
            for c in [other, *signs]:
                to = self.step(*at, c)
                if to not in seen:
                    seen[to] = len(self.states)
                    self.states.append(to)
                row.append(seen[to])
            table.append(row)
        self._number = seen
        self.table = np.array(table, dtype=np.int32).T.copy()  # sign, state

    def function(self, chunk: str) -> np.ndarray:
        """The state after the chunk, for each state before it."""
        f = np.arange(len(self.states), dtype=np.int32)
        code = np.zeros(0x110000 if any(ord(c) > 0xFFFF for c in self.signs) else 0x10000, np.int8)
        for c, i in self.signs.items():
            code[ord(c)] = i
        points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = np.where(points < len(code), code[np.minimum(points, len(code) - 1)], 0)
        # a run of other characters does what one does twice, as a mark's beginning ends at the first
        keep = np.ones(len(signs), bool)
        keep[2:] = (signs[2:] != 0) | (signs[1:-1] != 0) | (signs[:-2] != 0)
        return composition(self.table[signs[keep]])

    def read(self, units: list[str], state: int = 0) -> list[tuple[str, str]]:
        """``(kind, text)`` of units that follow each other: runs of whole lines are read in one, parts of a long line by themselves.

        The beginning of a mark at the end of a part is left to the next part, or to nothing.
        """
        out, at = [], 0
        while at < len(units):
            end = at + 1
            if whole := units[at].endswith("\n"):
                while end < len(units) and units[end].endswith("\n"):
                    end += 1
            text = "".join(units[at:end])
            after = None if whole else int(self.function(text)[state])
            got, mode = self._walk(text, state, after)
            out += got
            state, at = self._number[(mode, "")] if whole else after, end  # no mark begins with a line break
        return out

    def spans(self, chunk: str, before: int = 0, after: int | None = None) -> list[tuple[str, str]]:
        """``(kind, text)`` of the chunk, kind being code, comment or string; ``after`` is None for the last chunk.

        The beginning of a mark that the next chunk may complete is left to that chunk.
        """
        return self._walk(chunk, before, after)[0]

    def _walk(self, chunk: str, before: int, after: int | None) -> tuple[list[tuple[str, str]], str]:
        mode, pending = self.states[before]
        text = pending + chunk
        if after is not None and (left := len(self.states[after][1])):
            text = text[:-left] if left <= len(text) else ""
        out: list[tuple[str, str]] = []
        at = start = 0
        while m := self._find[mode].search(text, at):
            hit = m.group()
            at = m.end()
            to = self.modes[mode].get(hit)
            if to is None:
                continue  # an escape
            if to != mode:
                if m.start() > start:
                    out.append((_KIND[mode.partition(":")[0]], text[start : m.start()]))
                mode, start = to, at
                if hit == "\n":
                    start = at - 1
        if start < len(text):
            out.append((_KIND[mode.partition(":")[0]], text[start:]))
        return out, mode


_KIND = {"code": "code", "line": "comment", "block": "comment", "str": "string", "raw": "string"}


@lru_cache(maxsize=64)
def lexer(name: str) -> Lexer:
    return Lexer(name)


def units(text: str) -> list[str]:
    """The lines of a text with their ends, those over ``LONG_LINE`` characters in parts of that length."""
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        out += [line] if len(line) <= LONG_LINE else [line[i : i + LONG_LINE] for i in range(0, len(line), LONG_LINE)]
    return out


def cut(text: str, size: int = CHUNK) -> list[list[str]]:
    """Chunks: runs of units of at most ``size`` characters, or one unit."""
    out: list[list[str]] = [[]]
    n = 0
    for u in units(text):
        if out[-1] and n + len(u) > size:
            out.append([])
            n = 0
        out[-1].append(u)
        n += len(u)
    return out


def composition(functions: np.ndarray) -> np.ndarray:
    """What functions (rows) do one after the other, by pairs: half as many after each round."""
    identity = np.arange(functions.shape[1], dtype=functions.dtype)[None]
    if not len(functions):
        return identity[0]
    while len(functions) > 1:
        if len(functions) % 2:
            functions = np.concatenate((functions, identity))
        functions = np.take_along_axis(functions[1::2], functions[::2], axis=1)
    return functions[0]


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What the two chunks do one after the other; this is associative."""
    return second[first]


def scan(functions: list[np.ndarray], start: int = 0) -> list[int]:
    """The state before each chunk, by a prefix scan in log2(n) rounds of independent compositions."""
    pre = list(functions)
    d = 1
    while d < len(pre):
        pre = [pre[i] if i < d else compose(pre[i - d], pre[i]) for i in range(len(pre))]
        d *= 2
    return [start] + [int(f[start]) for f in pre[:-1]]
