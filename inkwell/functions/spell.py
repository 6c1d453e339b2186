"""Spelling: dictionaries with affixes, the chain of tests that accept a word, and suggestions."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Patterns of the words that are never checked.
SKIPPED = (re.compile(r"[A-Z]{1}[a-z]+[A-Z]+\w+"), re.compile(r"[A-Z]+$"), re.compile(r"[^a-zA-Z_']"))
_NUMBER, _HEX, _BINARY, _HASH = (re.compile(p) for p in (r"^[-+]?\d[\d,.]*$", r"^0[xX][0-9a-fA-F]+$", r"^0[bB][01]+$", r"^[0-9a-fA-F]{40}$"))
_UNIT = re.compile(r"^\d+(?:\.\d+)?([A-Za-zµ]+)$")


@dataclass
class Affixes:
    """Prefixes and suffixes by flag, conversions and compound rules of an affix file.

    Flags are single characters, pairs of them (``FLAG long``) or numbers (``FLAG num``).
    """

    rules: dict[str, list[tuple[bool, str, str, re.Pattern, bool, str]]] = field(default_factory=dict)
    iconv: list[tuple[str, str]] = field(default_factory=list)
    compounds: list[str] = field(default_factory=list)
    compound_flag: str = ""
    compound_min: int = 3
    kind: str = ""

    def flags(self, text: str) -> list[str]:
        """The flags in a run of flags."""
        text = text.strip()
        if self.kind == "num":
            return [f.strip() for f in text.split(",") if f.strip()]
        return [text[i : i + 2] for i in range(0, len(text) - 1, 2)] if self.kind == "long" else list(text)

    @classmethod
    def parse(cls, text: str) -> Affixes:
        out, cross = cls(), {}
        for line in text.splitlines():
            p = line.split("#")[0].split() if not line.startswith(("PFX", "SFX")) else line.split()
            if len(p) < 2:
                continue
            if p[0] == "FLAG":
                out.kind = "" if p[1] in ("ASCII", "UTF-8") else p[1]
            elif p[0] in ("PFX", "SFX") and len(p) == 4 and p[2] in "YN" and p[3].isdigit():
                cross[p[1]] = p[2] == "Y"
            elif p[0] in ("PFX", "SFX") and len(p) >= 4:
                add, _, more = p[3].partition("/")
                cond = re.sub(r"-(?=[^\]]*\])", r"\\-", p[4]) if len(p) > 4 else "."
                rx = re.compile(f"^{cond}" if p[0] == "PFX" else f"{cond}$")
                out.rules.setdefault(p[1], []).append((p[0] == "PFX", "" if p[2] == "0" else p[2], "" if add == "0" else add, rx, cross.get(p[1], False), more))
            elif p[0] == "ICONV" and len(p) == 3:
                out.iconv.append((p[1], p[2]))
            elif p[0] == "COMPOUNDRULE" and not p[1].isdigit():
                out.compounds.append(p[1])
            elif p[0] == "COMPOUNDFLAG":
                out.compound_flag = p[1]
            elif p[0] == "COMPOUNDMIN":
                out.compound_min = int(p[1])
        return out

    def forms(self, word: str, flags: str, depth: int = 0) -> set[str]:
        """All forms of a stem: each affix, prefixes with suffixes where both allow it, and two continuations at most."""
        out, pre, suf = {word}, [], []
        for f in self.flags(flags):
            for is_prefix, strip, add, cond, cross, more in self.rules.get(f, ()):
                if not cond.search(word):
                    continue
                if is_prefix and word.startswith(strip):
                    new = add + word[len(strip) :]
                    pre.append((add, strip, cross, cond))
                elif not is_prefix and word.endswith(strip):
                    new = word[: len(word) - len(strip)] + add
                    suf.append((new, cross))
                else:
                    continue
                out.add(new)
                if more and depth < 2:
                    out |= self.forms(new, more, depth + 1)
        for add, strip, crossed, cond in pre:
            out |= {add + s[len(strip) :] for s, cross in suf if cross and crossed and s.startswith(strip) and cond.search(s)}
        return out


@dataclass
class Dictionary:
    words: set[str]
    affixes: Affixes = field(default_factory=Affixes)
    by_flag: dict[str, set[str]] = field(default_factory=dict)
    _rules: dict[str, re.Pattern] = field(default_factory=dict)

    @classmethod
    def parse(cls, dic: str, aff: str = "") -> Dictionary:
        affixes = Affixes.parse(aff)
        words: set[str] = set()
        by_flag: dict[str, set[str]] = {}
        for i, line in enumerate(dic.splitlines()):
            entry = line.split("\t")[0].strip()
            if not entry or i == 0 and entry.isdigit():
                continue
            word, _, flags = entry.partition("/")
            words |= affixes.forms(word, flags.strip())
            for f in affixes.flags(flags):
                by_flag.setdefault(f, set()).add(word)
        return cls(words, affixes, by_flag)

    def convert(self, word: str) -> str:
        for a, b in self.affixes.iconv:
            word = word.replace(a, b)
        return word

    def accepts(self, word: str) -> bool:
        """The first test that holds accepts: as written, in lower case, numbers and hashes, compounds, a number with a known unit."""
        if word in self.words or word.lower() in self.words or word[:1] + word[1:].lower() in self.words and word.isupper():
            return True
        if any(p.match(word) for p in (_NUMBER, _HEX, _BINARY, _HASH)):
            return True
        if any(self._rule(c).fullmatch(word) for c in self.affixes.compounds) or self._compound(word, 0):
            return True
        return bool((m := _UNIT.match(word)) and m.group(1) in self.words)

    def _rule(self, rule: str) -> re.Pattern:
        """A compound rule over flags as an expression over the words that have them."""
        if rule not in self._rules:
            parts = re.findall(r"\(([^)]*)\)|([*?])|(.)", rule)
            of = lambda f: "(?:" + "|".join(map(re.escape, sorted(self.by_flag.get(f, {"\0"})))) + ")"
            self._rules[rule] = re.compile("".join(mark or of(long or one) for long, mark, one in parts))
        return self._rules[rule]

    def _compound(self, word: str, depth: int) -> bool:
        parts = self.by_flag.get(self.affixes.compound_flag, set()) if self.affixes.compound_flag else set()
        least = self.affixes.compound_min
        if not parts or depth > 4 or len(word) < least:
            return False
        if depth and word in parts:
            return True
        return any(word[:i] in parts and self._compound(word[i:], depth + 1) for i in range(least, len(word) - least + 1))


    def suggest(self, word: str, most: int = 5) -> list[tuple[float, str]]:
        """The words most like a word, ``(similarity, word)``: 1 - edits over the longer length, ties by text."""
        each = ((-round(1 - distance(word, w) / max(len(word), len(w), 1), 9), w) for w in self.words)
        return [(-s, w) for s, w in heapq.nsmallest(most, each)]


def suggestions(word: str, dictionaries: list[Dictionary], each: int = 5, most: int = 6) -> list[str]:
    """``each`` words of every dictionary, of these the ``most`` that are most like it."""
    near = sorted((-s, w) for d in dictionaries for s, w in d.suggest(word, each))
    return list(dict.fromkeys(w for _, w in near))[:most]


@lru_cache(maxsize=64)
def read_dictionary(dic: str, aff: str) -> Dictionary:
    """A dictionary from its two files; the affix file may be missing."""
    from pathlib import Path

    text = lambda p: Path(p).read_text(encoding="utf-8", errors="replace") if p and Path(p).is_file() else ""
    return Dictionary.parse(text(dic), text(aff))


def checked(word: str, custom: bool = False) -> bool:
    """Whether the default filters leave a word to be checked."""
    return custom or not any(p.search(word) for p in SKIPPED)


def distance(a: str, b: str, most: int = 99) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]
