"""Per-document text statistics that tell prose from lists, tables and junk.

Method: huge documents are cut into chunks, each a row of its own. A chunk gives partial counts,
and for the blocks that it begins or ends within, partial states; counts and states add up
(``merged`` is associative and mends lines and blocks at the seam), in a tree of two levels. Ratios
and rule outcomes are derived from the sums.

All that is judged is a sum over the *pieces* of a text, and these depend on the text alone: its
lines, and parts of lines over ``PIECE`` characters. Chunks are runs of pieces, so every chunk
size gives the same figures.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import bounded, spread, written

#: Characters in a chunk, and of lines whose letter pairs are counted at once.
CHUNK, READ = 65536, 1 << 20
#: The longest line that is read in one, and how many chunks one merging task takes.
PIECE, FAN = 4096, 64
#: A block below this mean log-probability of a letter pair is text of no language.
JUNK_LEVEL = -3.55
#: A block of many words of which next to none is a common one needs a better score to pass as a language.
UNKNOWN_WORDS, UNKNOWN_SHARE, UNKNOWN_LEVEL = 18, 0.03, -2.85
#: Rows of fields whose letters score below this, and that hold so many signs inside words for each word, are no table.
FIELD_LEVEL, STREWN_SHARE = -4.05, 0.3
NEUTRAL, SCALE = -2.3, 1_000_000
#: The least log-probability of a pair: what was never seen would else cost more, the larger the table, while the levels above stay.
LEAST = -18.7
SHORT_WORDS, SHORT_SIGNS = 3.45, 9.0  # mean line of a list without bullets, in words and in wide characters

COUNTS = ["n_words", "word_chars", "n_chars", "n_solid", "n_symbols", "n_lines", "n_ended", "n_common", "list_chars", "table_chars", "junk_chars", "prose_chars"]

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿‪-‮]")
_ODD_SPACE = re.compile("[   -   　]")
_BULLET = re.compile(r"^\s*(?:[-*+•‣◦▪●○·–—>]|\[[ xX✓✔]?\]|[☐☑☒✓✔✗]|\(?\d{1,4}[.)）]|\(?\d{1,3}(?:\.\d{1,3})+[.)]?|\([a-zA-Zа-яА-Я]{1,4}\)|[a-zA-Zа-я]\)|[①-⑳])\s+\S")
_SETTING = re.compile(r"^\s*[\w.\-/\[\]]{1,60}\s?(?:[:=]|:=|=>)\s*\S{0,60}(?:[ \t]\S{1,30}){0,2}\s*$")
_CELL_TAG = re.compile(r"</?(?:table|tr|td|th|thead|tbody|tfoot|caption|colgroup|col)\b[^>]*>", re.I)
_BOX = re.compile("[│┃║┆┊╎╏┤├┼]")
_RULE = re.compile(r"^[\s|+\-=:_─━═┄┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬│║]{3,}$")
_GAP = re.compile(r"(?<=[^\s.!?。！？]) {2,}(?=\S)")
_QUOTED = re.compile(r'"[^"\n]*"')
_CLOSERS, _MARKS_OF_END = "\"'”»」』）)]", ".!?。！？।؟…"
_WORD, _TOKEN = re.compile(r"\w+"), re.compile(r"\S+")
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯฀-๿]")
_SIGN = re.compile(r"[^\w\s|+\-=:,;<>/\"│┃]")
_SYMBOL = re.compile(r"[^\w\s]")


class LetterModel:
    """Log-probabilities of pairs of letters. Letters of large scripts stand for their script."""

    def __init__(self):
        self.ids = np.zeros(65536, np.int32)
        n = 2
        for c in range(65536):
            ch = chr(c)
            if 0xD800 <= c < 0xE000:
                continue
            if ch.isdigit():
                self.ids[c] = 1
            elif 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7B0 or 0xE00 <= c < 0xE80 or 0x3000 <= c < 0x3040 or 0xFF00 <= c < 0xFFF0:
                self.ids[c] = 2
            elif ch.isspace():
                self.ids[c] = 3
        small = {}
        for c in [*range(0x21, 0x250), *range(0x370, 0x530), *range(0x590, 0x700), *range(0x900, 0x980), *range(0x2010, 0x2030)]:
            if self.ids[c] == 0:
                low = chr(c).lower()
                key = low if len(low) == 1 else chr(c)
                n = small.setdefault(key, len(small) + 4)
                self.ids[c] = n
        self.size = len(small) + 4
        self.table = np.zeros((self.size, self.size), np.int64)

    def code(self, text: str) -> np.ndarray:
        if text.isascii():
            return self.ids.take(np.frombuffer(text.encode("ascii"), np.uint8))
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return self.ids.take(points, mode="clip")

    def pairs(self, lines: Iterable[str]) -> np.ndarray:
        """How often each pair stands in the lines, each with a space around it; such counts add up."""
        counts = np.zeros(self.size * self.size, np.int64)
        held, n = [], 0
        for line in lines:
            held.append(line)
            n += len(line) + 1
            if n >= READ:
                self._tally(counts, held)
                held, n = [], 0
        self._tally(counts, held)
        return counts

    def _tally(self, counts: np.ndarray, lines: list[str]) -> None:
        text = " " + "\n".join(lines) + " " if lines else ""  # a line break is a space to the model
        for at in range(0, len(text) - 1, READ):
            c = self.code(text[at : at + READ + 1])
            counts += np.bincount(c[:-1] * self.size + c[1:], minlength=len(counts))

    def fit(self, lines: Iterable[str]) -> LetterModel:
        return self.fitted(self.pairs(lines))

    def fitted(self, pairs: np.ndarray) -> LetterModel:
        """The model of the counts that ``pairs`` gives."""
        counts = pairs.reshape(self.size, self.size).astype(np.float64)
        whole = counts.sum(axis=1, keepdims=True)
        back = (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * self.size)
        table = np.maximum(np.log((counts + 3 * back[None, :]) / (whole + 3)), LEAST)
        table[2, :] = table[:, 2] = NEUTRAL  # pairs of large scripts say nothing
        self.table = np.round(table * SCALE).astype(np.int64)  # whole numbers add up alike in any order
        return self

    def total(self, text: str) -> tuple[int, int]:
        """The sum over the pairs of a text with a space around it, and how many there are."""
        c = self.code(f" {text} ")
        return int(self.table.take(c[:-1] * self.size + c[1:]).sum()), len(c) - 1


def pieces(text: str):
    """``(piece, begins a line, ends a line, begins inside a word)`` of a text, by the text alone."""
    for line in text.split("\n"):
        at, n = 0, len(line)
        while n - at > PIECE:
            end = line.rfind(" ", at, at + PIECE) + 1
            if end <= at:
                end = at + PIECE
            yield line[at:end], at == 0, False, at > 0 and _inner(line[at - 1], line[at])
            at = end
        yield line[at:], at == 0, True, at > 0 and _inner(line[at - 1], line[at : at + 1])


def _inner(a: str, b: str) -> bool:
    return (a.isalnum() or a == "_") and (b.isalnum() or b == "_")


def cut(text: str, size: int = CHUNK) -> list[list[tuple]]:
    """Chunks: runs of pieces of about ``size`` characters."""
    out, n = [[]], 0
    for p in pieces(text):
        if out[-1] and n + len(p[0]) > size:
            out.append([])
            n = 0
        out[-1].append(p)
        n += len(p[0]) + 1
    return out


# ---------------------------------------------------------------- lines


def _closing(x: str) -> str:
    """The last sign of a line behind which only closing quotes and brackets stand; what no set of marks holds where there is none."""
    return x.rstrip().rstrip(_CLOSERS)[-1:] or "\0"


_SEPS = "|\t,;"
_KINDS = "PSB"  # plain, setting, bullet


class Line:
    """What counts of a line; parts of a long line are joined."""

    __slots__ = ("kind", "hang", "setting", "solid", "ended", "wide", "size", "words", "tag", "box", "rule", "has", "counts", "spaced", "gaps", "begins", "ends")

    def __init__(self, x: str, begins: bool, ends: bool, end: str):
        self.begins, self.ends = begins, ends
        self.setting = begins and ends and (":" in x or "=" in x) and _SETTING.match(x) is not None
        bullet = begins and not (x[:1].isalpha() and x[1:2] != ")") and _BULLET.match(x) is not None
        self.kind = ("B" if bullet else "S" if self.setting else "P") if begins else None
        self.hang = self.kind == "P" and x[0] in " \t" and x.startswith(("  ", "\t"))
        parts = x.split()
        self.words, self.solid = len(parts), len("".join(parts))
        self.size = len(x.strip())
        self.ended = ends and end in _MARKS_OF_END
        plain = x.isascii()
        self.wide = 0 if plain else len(_WIDE.findall(x))
        self.tag = "<" in x and _CELL_TAG.search(x) is not None
        self.box = not plain and _BOX.search(x) is not None
        self.rule = not x[:1].isalnum() and _RULE.match(x) is not None
        n = x.count
        self.has = (n("|"), n("\t"), n(","), n(";"))
        if x.endswith((",", ";")):  # what closes an item sets off no field
            n = x[:-1].count
        y = x
        if '"' in x:
            y = _QUOTED.sub("q", x[:-1] if x.endswith((",", ";")) else x)
            n = y.count
            self.counts = (n("|"), n("\t"), n(","), n(";"))
        else:
            self.counts = (n("|"), n("\t"), n(","), n(";"))
        self.spaced = (False, False, ", " in y, "; " in y)  # a separator before a space is punctuation
        self.gaps = len(_GAP.findall(x.strip())) if "  " in x else 0

    def join(self, o: Line) -> Line:
        both = lambda f, a, b: tuple(f(x, y) for x, y in zip(a, b))
        for k in ("words", "solid", "size", "wide", "gaps"):
            setattr(self, k, getattr(self, k) + getattr(o, k))
        self.tag, self.box, self.rule = self.tag or o.tag, self.box or o.box, self.rule and o.rule
        self.spaced = both(lambda x, y: x or y, self.spaced, o.spaced)
        self.has, self.counts = both(lambda x, y: x + y, self.has, o.has), both(lambda x, y: x + y, self.counts, o.counts)
        self.ended, self.ends = o.ended, o.ends
        return self


# ---------------------------------------------------------------- blocks


class Block:
    """A run of lines without a blank one, or the part of it that lies in a chunk.

    ``head`` is the end of a line that began before, ``tail`` the beginning of one that goes on.
    While the pieces are here, what is rarely asked for is worked out when it is asked for.
    """

    def __init__(self, model: LetterModel, common: set[str]):
        self.model, self.common = model, common
        self.texts: list[tuple[str, str | None]] | None = []  # piece, kind of its line; None where the line began before
        self.head: Line | None = None
        self.tail: Line | None = None
        self.n = self.n_settings = self.tags = self.boxes = self.gap_lines = self.gaps = self.rules = 0
        self.first_bullet: bool | None = None
        self.count = dict.fromkeys(_KINDS, 0)
        self.sums = {k: [0, 0, 0, 0, 0] for k in _KINDS}  # solid, ended, wide, size, words
        self.has, self.seps = [0, 0, 0, 0], [Counter() for _ in _SEPS]
        self.root: str | None = None  # the kind of line that hanging lines at the end belong to; None: it stands before this part, if there is one
        self.hung = {"B": 0, "S": 0, "P": 0, None: 0}
        self.known: dict[str, object] = {}

    def add(self, piece: str, begins: bool, ends: bool, raw: str, end: str) -> int:
        """``piece`` is judged; the characters of ``raw`` other than white space, with the invisible ones, are counted and given back."""
        x = Line(piece, begins, ends, end)
        if len(raw) != len(piece):
            x.solid = len("".join(raw.split()))
        if begins:
            self.texts.append((piece, x.kind))
            self.tail = x
        else:
            last = self.tail or self.head
            self.texts.append((piece, self.tail.kind if self.tail else None))
            if last is not None:
                last.join(x)
            else:
                self.head = x
        solid = x.solid
        if ends and self.tail is not None:
            self._close(self.tail)
            self.tail = None
        return solid

    def _close(self, x: Line) -> None:
        """Counts a whole line."""
        if self.first_bullet is None and self.head is None:
            self.first_bullet = x.kind == "B"
        self.n += 1
        self.n_settings += x.setting
        self.tags += x.tag
        self.boxes += x.box
        self.rules += x.rule
        self.gap_lines += x.gaps > 0
        self.gaps += x.gaps
        self.count[x.kind] += 1
        t = self.sums[x.kind]
        t[0] += x.solid
        t[1] += x.ended
        t[2] += x.wide
        t[3] += x.size
        t[4] += x.words
        if any(x.has):
            for i in range(4):
                if x.has[i]:
                    self.has[i] += 1
                    if x.counts[i] and not x.spaced[i] and not x.rule:
                        self.seps[i][x.counts[i]] += 1  # lines without the separator are the rest
        if x.hang:
            self.hung[self.root] += x.solid
        else:
            self.root = x.kind

    # -- figures of the whole text, additive over its pieces

    def _get(self, name: str, work):
        if name not in self.known:
            self.known[name] = work()
        return self.known[name]

    @property
    def text(self) -> str:
        return self._get("text", lambda: "\n".join([t for t, _ in self.texts]))

    @property
    def symbols(self) -> int:
        return self._get("symbols", lambda: len(_SYMBOL.findall(self.text)))

    @property
    def signs(self) -> int:
        return self._get("signs", lambda: len(_SIGN.findall(self.text)))

    @property
    def alnum(self) -> int:
        return self._get("alnum", lambda: sum(map(str.isalnum, self.text)))

    @property
    def n_common(self) -> int:
        return self._get("n_common", lambda: sum(map(self.common.__contains__, map(str.lower, _WORD.findall(self.text)))))

    @property
    def field_score(self) -> tuple[int, int]:
        return self._get("field_score", lambda: _added(self.model.total(_FIELDS.sub(" ", t)) for t, _ in self.texts))

    @property
    def strewn(self) -> int:
        return self._get("strewn", lambda: len(_STREWN.findall(self.text)))

    @property
    def bare_score(self) -> tuple[int, int]:
        return self._get("bare_score", lambda: _added(self.model.total(_MARKS.sub(" ", t)) for t, _ in self.texts))

    def score(self, kinds: str) -> tuple[int, int]:
        if self.texts is not None and kinds == _KINDS:
            return self.model.total(self.text)  # a line break is a space to the model
        return _added(self._get(f"score {k}", lambda k=k: self.model.total(" ".join(x)) if (x := [t for t, y in self.texts if y == k]) else (0, 0)) for k in kinds)

    @property
    def repeats(self) -> Repeats:
        return self._get("repeats", lambda: Repeats.of([t for t, _ in self.texts]))

    def frozen(self) -> Block:
        """All figures worked out and the text let go, so that the block may leave its chunk."""
        for name in ("symbols", "signs", "alnum", "n_common", "strewn", "bare_score", "field_score", "repeats"):
            getattr(self, name)
        self.score(_KINDS[::-1])
        if self.head is not None:
            self._get("score None", lambda: self.model.total(" ".join(t for t, y in self.texts if y is None)))
        self.known.pop("text", None)
        self.texts, self.model, self.common = None, None, None
        return self

    def merged(self, o: Block) -> Block:
        """This block and what goes on from it; both are frozen."""
        for name in ("symbols", "signs", "alnum", "n_common", "strewn"):
            self.known[name] += o.known[name]
        self.known["repeats"] = self.repeats.merged(o.repeats)
        for name in ("bare_score", "field_score"):
            self.known[name] = _added((self.known[name], o.known[name]))
        for k in (*_KINDS, None):
            name = f"score {k}"
            if name in o.known:
                at = f"score {self.tail.kind}" if k is None and self.tail else name
                self.known[at] = _added((self.known.get(at, (0, 0)), o.known[name]))
        if o.head is not None:
            line = self.tail or self.head
            line.join(o.head)
            if line.ends and self.tail is not None:
                self._close(line)
                self.tail = None
        if o.n == 0 and o.tail is None:
            return self
        if self.first_bullet is None and self.head is None:
            self.first_bullet = o.first_bullet
        for name in ("n", "n_settings", "tags", "boxes", "rules", "gap_lines", "gaps"):
            setattr(self, name, getattr(self, name) + getattr(o, name))
        for k in _KINDS:
            self.count[k] += o.count[k]
            self.sums[k] = [a + b for a, b in zip(self.sums[k], o.sums[k])]
        self.has = [a + b for a, b in zip(self.has, o.has)]
        for a, b in zip(self.seps, o.seps):
            a.update(b)
        self.hung[self.root] += o.hung[None]
        for k in "BSP":
            self.hung[k] += o.hung[k]
        if o.n:
            self.root = o.root or self.root
        self.tail = o.tail
        return self


_STREWN = re.compile(r"(?<=[^\W\d_])[`^~:.'|;](?=[^\W\d_])")
_MARKS, _FIELDS = re.compile(r"^\W+|[_=:]"), re.compile(r"[|,;\t]")


def _added(xs) -> tuple[int, int]:
    a = b = 0
    for x, y in xs:
        a, b = a + x, b + y
    return a, b


class Repeats:
    """Whether a text is one phrase over and over: distinct tokens, pairs and six-letter runs, as far as they are few."""

    MOST_TOKENS, MOST_PAIRS, MOST_RUNS = 12, 150, 600

    def __init__(self, n, tokens, pairs, first, last, size, runs, begins, ends):
        self.n, self.tokens, self.pairs, self.first, self.last = n, tokens, pairs, first, last
        self.size, self.runs, self.begins, self.ends = size, runs, begins, ends

    @classmethod
    def of(cls, texts: list[str]) -> Repeats:
        tokens = [t for x in texts for t in x.split()]
        if len(set(tokens[:64])) > cls.MOST_TOKENS or len(distinct := set(tokens)) > cls.MOST_TOKENS:
            return cls(len(tokens), None, None, tokens[:1], tokens[-1:], 0, None, "", "")
        pairs = set(zip(tokens, tokens[1:]))
        solid = "".join(tokens)
        runs: set[str] | None = None
        if len(tokens) < 12:  # with more tokens the runs aren't looked at
            runs = set()
            for at in range(0, len(solid) - 5, 1024):
                runs |= {solid[i : i + 6] for i in range(at, min(at + 1024, len(solid) - 5))}
                if len(runs) > cls.MOST_RUNS:
                    runs = None
                    break
        return cls(len(tokens), distinct, pairs, tokens[:1], tokens[-1:], len(solid), runs, solid[:5], solid[-5:])

    def merged(self, o: Repeats) -> Repeats:
        if not self.n or not o.n:
            return o if not self.n else self
        tokens = self.tokens | o.tokens if self.tokens is not None and o.tokens is not None else None
        if tokens is not None and len(tokens) > self.MOST_TOKENS:
            tokens = None
        pairs = self.pairs | o.pairs | {(self.last[0], o.first[0])} if tokens is not None else None
        runs = None
        if tokens is not None and self.runs is not None and o.runs is not None:
            seam = self.ends + o.begins
            runs = self.runs | o.runs | {seam[i : i + 6] for i in range(len(seam) - 5)}
            if len(runs) > self.MOST_RUNS:
                runs = None
        begins, ends = (self.begins + o.begins)[:5], (self.ends + o.ends)[-5:]
        return Repeats(self.n + o.n, tokens, pairs, self.first, o.last, self.size + o.size, runs, begins, ends)

    def __bool__(self) -> bool:
        if self.n >= 12:
            return self.tokens is not None and len(self.pairs) <= 0.15 * self.n + 2
        return self.size >= 40 and self.runs is not None and len(self.runs) <= 0.15 * self.size


def _columns(b: Block) -> bool:
    """Whether the lines of a block are rows of fields set off alike."""
    n = b.n
    if b.tags >= 0.6 * n or b.boxes >= 0.6 * n:
        return True
    bare = n - b.rules
    for i, sep in enumerate(_SEPS):
        if not b.has[i]:
            continue
        if not bare:
            return n > 1
        if not b.seps[i]:
            continue
        most, times = b.seps[i].most_common(1)[0]
        if most >= (2 if sep == "|" or bare == 1 else 1) and times >= 0.7 * bare and (bare > 1 or sep in "|\t"):
            return True
    return n > 1 and b.gap_lines >= 0.75 * n and b.gaps >= 1.3 * n


def judged(b: Block) -> dict[str, int]:
    """Characters other than white space of a whole block by the kind of their lines: ``list``, ``table``, ``junk``, ``prose``."""
    n = b.n
    total = sum(b.sums[k][0] for k in _KINDS)
    all_of = lambda kind: {kind: total}
    active = b.n_settings >= 2 or n == 1  # one setting among other lines is none
    plain = ["P"] if active else ["P", "S"]
    n_plain = sum(b.count[k] for k in plain)
    solid = max(1, total)
    # rows hold more text than signs other than those that set fields off
    if _columns(b) and b.signs <= b.alnum:
        s, k = (0, 1) if b.tags or b.boxes else b.field_score
        if s >= FIELD_LEVEL * SCALE * k or b.strewn <= STREWN_SHARE * sum(b.sums[x][4] for x in _KINDS):
            return all_of("table")
    if not n_plain:
        if b.symbols > 0.6 * solid:
            return all_of("junk")
        if b.n_settings < n and solid > 20:
            s, k = b.bare_score
            if s < (JUNK_LEVEL - 0.8) * SCALE * k:
                return all_of("junk")
        return all_of("list")
    if b.repeats:
        return all_of("junk")
    s, k = b.score("".join(plain) if b.count["B"] > n / 2 else _KINDS)
    if solid >= 12 and s < JUNK_LEVEL * SCALE * k:
        return all_of("junk")
    words = sum(b.sums[x][4] for x in _KINDS)
    if s < UNKNOWN_LEVEL * SCALE * k and words >= UNKNOWN_WORDS and not b.count["B"] and b.n_common <= UNKNOWN_SHARE * words:
        return all_of("junk")
    if b.symbols > 0.5 * solid and solid > 12:
        return all_of("junk")
    if n_plain >= 3 or n_plain == n == 2:
        _, ended, wide, size, n_words = (sum(b.sums[x][i] for x in plain) for i in range(5))
        mean, most = (size / n_plain, SHORT_SIGNS) if wide * 2 > size else (n_words / n_plain, SHORT_WORDS)
        if mean <= (most if n_plain > 2 else most * 0.8) and ended <= 0.15 * n_plain:
            return all_of("list")
    listed = b.sums["B"][0] + (b.sums["S"][0] if active else 0)
    if b.first_bullet:  # hanging lines of items
        listed += b.hung["B"] + (b.hung["S"] if active else 0)
    return {"list": listed, "prose": total - listed}


# ---------------------------------------------------------------- chunks


class Partial:
    """The counts of a run of pieces, with the blocks it begins and ends within; ``through``: it is one block from end to end."""

    def __init__(self, counts: dict[str, int], first: Block | None, last: Block | None, through: bool):
        self.counts, self.first, self.last, self.through = counts, first, last, through

    def merged(self, o: Partial) -> Partial:
        """Both runs, ``o`` right after this one."""
        counts = {k: v + o.counts[k] for k, v in self.counts.items()}
        left = self.first if self.through else self.last
        if left is None or o.first is None:
            for b in (None if self.through else left, None if o.through else o.first):
                if b is not None:
                    _tally(counts, b)
            first = self.first
            last = o.first if o.through else o.last
            return Partial(counts, first, last, False)
        joined = left.merged(o.first)
        if self.through and o.through:
            return Partial(counts, joined, None, True)
        if self.through:
            return Partial(counts, joined, o.last, False)
        if o.through:
            return Partial(counts, self.first, joined, False)
        _tally(counts, joined)
        return Partial(counts, self.first, o.last, False)

    def total(self) -> dict[str, int]:
        """The counts of a whole text."""
        for b in (self.first, self.last):
            if b is not None:
                _tally(self.counts, b)
        self.first = self.last = None
        n = self.counts
        n["n_solid"] = n["list_chars"] + n["table_chars"] + n["junk_chars"] + n["prose_chars"]
        return n


def _tally(counts: dict[str, int], b: Block) -> None:
    for kind, chars in judged(b).items():
        counts[f"{kind}_chars"] += chars


def partial(run, common: set[str], model: LetterModel, freeze: bool = True) -> Partial:
    """The counts of a run of pieces of one text."""
    n = dict.fromkeys(COUNTS, 0)
    done: list[Block] = []
    block: Block | None = None
    opened = ended = False  # whether the run begins inside a block, and ends inside one
    run = list(run)
    text = "\n".join([p[0] for p in run])
    words = _WORD.findall(text)
    n["n_words"] = len(words) - sum([p[3] for p in run])
    n["word_chars"] = len("".join(words))
    n["n_common"] = sum(map(common.__contains__, map(str.lower, words)))
    solid = 0
    for i, (x, begins, ends, _) in enumerate(run):
        if not (begins and ends) or x and not x.isspace():
            n["n_lines"] += begins
            end = _closing(x) if ends else ""
            n["n_ended"] += ends and end in ".!?。！？।؟…;:"
            if block is None:
                block = Block(model, common)
                opened = opened or i == 0
            if x[-1:] == "\r":
                x = x.rstrip("\r")
            solid += block.add(x if x.isascii() else _ODD_SPACE.sub(" ", _INVISIBLE.sub("", x)), begins, ends, x, end)
        elif block is not None:
            done.append(block)
            block = None
    n["n_symbols"] = solid - n["word_chars"]  # what is neither of a word nor white space
    if block is not None:
        done.append(block)
        ended = True
    through = len(done) == 1 and opened and ended
    first = done.pop(0) if done and opened else None
    last = done.pop() if done and ended and not through else None
    for b in done:
        _tally(n, b)
    if freeze:
        first, last = (b.frozen() if b is not None else None for b in (first, last))
    return Partial(n, first, last, through)


def spoken(text: str, common: set[str]) -> Iterator[str]:
    """The lines of a text that hold two common words."""
    for line, low in zip(text.split("\n"), text.lower().split("\n")):
        words = low.split() if len(low) <= PIECE else (m.group() for m in _TOKEN.finditer(low))
        if len(list(islice(filter(common.__contains__, words), 2))) == 2:
            yield line


def letter_model(docs: DataFrame, key: str, text: str, common: set[str]) -> LetterModel:
    """The letter model, fitted on the lines of all documents that hold two common words; rows that repeat a key count once.

    The pairs are counted where the documents lie, and summed; of the texts only those of repeated
    rows are shuffled, and those of a table smaller than the cluster. The driver gets a row per pair that occurs, no more than the model has cells.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    repeated = written(rows.groupBy("k").count().where("count > 1").select("k"))  # its true size tells whether it can be broadcast
    if repeated.isEmpty():
        once = spread(rows, "k")
    else:
        again = rows.join(repeated, "k", "left_semi").groupBy("k").agg(F.min("t").alias("t"))
        once = spread(rows, "k").join(repeated, "k", "left_anti").unionByName(again)

    def count(batches):
        got = LetterModel().pairs(line for pdf in batches for t in pdf["t"] for line in spoken(t, common))
        at = np.flatnonzero(got)
        yield pd.DataFrame({"pair": at.astype(np.int32), "n": got[at]})

    model = LetterModel()
    sums = once.select("t").mapInPandas(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    got = bounded(sums, model.size**2, "the counts of letter pairs")
    pairs = np.zeros(model.size**2, np.int64)
    pairs[[r["pair"] for r in got]] = [r["n"] for r in got]
    return model.fitted(pairs)


def text_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: its counts, ratios, and ``doc_kind``.

    ``doc_kind`` is ``list``, ``table`` or ``junk`` where more than half of the characters other
    than white space stand in such lines, ``blank`` where there are none (null and blank texts),
    else ``prose``. Rows with a null key are left out; rows that repeat a key count once (their
    texts are taken as equal). ``common_words(lang, word)`` is pooled over languages; it must be
    a small table. Ratios with nothing below the line are null. Other columns play no part.
    Documents up to ``chunk`` characters are counted where they lie; the chunks of longer ones are
    rows of their own, spread over the cluster and merged ``FAN`` at a time. The chunk size has no
    influence on any figure.
    """
    common = {r["word"].lower() for r in bounded(common_words.select("word").where("word IS NOT NULL").distinct(), 100_000, "the common words")}
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    model = letter_model(docs, key, text, common)
    out = [c for c in COUNTS if c != "n_chars"]
    schema = "k long, n_chars long, " + ", ".join(f"{c} long" for c in out)

    def frame(rows):
        return pd.DataFrame(rows, columns=["k", "n_chars", *out]).astype("int64")

    def whole(batches):
        for pdf in batches:
            got = []
            for k, t, n in zip(pdf["k"], pdf["t"], pdf["n"]):
                x = partial(pieces(t.replace("\r\n", "\n")), common, model, False).total()
                got.append((k, n, *(x[c] for c in out)))
            yield frame(got)

    def chunks(batches):
        for pdf in batches:
            for k, t, n in zip(pdf["k"], pdf["t"], pdf["n"]):
                for seq, run in enumerate(cut(t.replace("\r\n", "\n"), chunk)):
                    yield pd.DataFrame([(k, n, seq, [tuple(p) for p in run])], columns=["k", "n", "seq", "run"])

    def count(batches):
        for pdf in batches:
            got = [pickle.dumps(partial([(p["text"], p["begins"], p["ends"], p["inner"]) for p in run], common, model)) for run in pdf["run"]]
            yield pd.DataFrame({"k": pdf["k"], "n": pdf["n"], "seq": pdf["seq"], "state": got})

    def merge(pdf):
        pdf = pdf.drop_duplicates("seq").sort_values("seq")
        state = pickle.loads(pdf["state"].iloc[0])
        for x in pdf["state"].iloc[1:]:
            state = state.merged(pickle.loads(x))
        return pdf.iloc[0], state

    def some(pdf):
        at, state = merge(pdf)
        return pd.DataFrame([(at["k"], at["n"], at["seq"], pickle.dumps(state))], columns=["k", "n", "seq", "state"])

    def last(pdf):
        at, state = merge(pdf)
        x = state.total()
        return frame([(at["k"], at["n"], *(x[c] for c in out))])

    rows = spread(rows, "k")
    small = rows.where(F.col("n") <= chunk).mapInPandas(whole, schema)
    pieced = rows.where(F.col("n") > chunk).mapInPandas(chunks, "k long, n long, seq int, run array<struct<text:string,begins:boolean,ends:boolean,inner:boolean>>")
    states = written(pieced.repartition("k", "seq")).mapInPandas(count, "k long, n long, seq int, state binary")
    states = states.groupBy("k", F.floor(F.col("seq") / FAN).alias("part")).applyInPandas(some, "k long, n long, seq int, state binary")
    large = states.groupBy("k").applyInPandas(last, schema)
    sums = small.unionByName(large).groupBy("k").agg(*[F.first(c).alias(c) for c in ("n_chars", *out)]).withColumnRenamed("k", key)
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    half = lambda c: F.col(f"{c}_chars") * 2 > F.col("n_solid")
    kind = F.when(F.col("n_solid") == 0, "blank").when(half("list"), "list").when(half("table"), "table").when(half("junk"), "junk").otherwise("prose")
    return sums.select(
        key, *COUNTS, ratio("word_chars", "n_words").alias("mean_word_length"), ratio("n_symbols", "n_solid").alias("symbol_ratio"), ratio("n_ended", "n_lines").alias("ended_share"),
        ratio("n_common", "n_words").alias("common_share"), kind.alias("doc_kind"),
    )


def _tables(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/common_words.parquet")


def statistics(spark, sf_dir: str) -> DataFrame:
    return text_statistics(*_tables(spark, sf_dir))


def found(spark, sf_dir: str) -> DataFrame:
    return text_statistics(*_tables(spark, sf_dir)).where("doc_kind NOT IN ('prose', 'blank')").select("doc_id", "doc_kind")


def counts(spark, sf_dir: str) -> DataFrame:
    """The counts that SQL can state too."""
    return text_statistics(*_tables(spark, sf_dir)).select("doc_id", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines")


_SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
_COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, any_value(coalesce(text, '')) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, length(t) AS n_chars, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS n_words, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]')) AS word_chars,
  len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_{_SPACE}]')) AS n_symbols, len(regexp_extract_all(t, '[^\n{_SPACE}][^\n]*')) AS n_lines FROM d
"""
QUERIES = {"p8_found": found, "p8_statistics": statistics, "p8_counts": counts}
SQL: dict[str, str] = {"p8_counts": _COUNTS_SQL}
