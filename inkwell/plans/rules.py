"""Rules: parsing, validation, and compilation to portable patterns. Driver only.

Twelve kinds of rule are known. A rule is compiled once; its regular expressions use ASCII word
classes so that Python, Java and SQL engines agree, and inline flags are turned into scoped
groups. Where a rule lists alternatives they become one alternation, the longest first, and the
literal every match must hold is derived for a cheap test before the expression runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

# Severities by rank, and the keys of each kind beside the common ones.
LEVELS = {"suggestion": 0, "warning": 1, "error": 2}
COMMON = {"extends", "message", "level", "scope", "link", "description", "limit", "matchcase", "action", "name"}
KINDS: dict[str, set[str]] = {
    "existence": {"tokens", "raw", "exceptions", "append", "ignorecase", "nonword", "vocab"},
    "substitution": {"swap", "exceptions", "ignorecase", "nonword", "vocab", "capitalize", "pos"},
    "occurrence": {"token", "max", "min", "ignorecase"},
    "repetition": {"tokens", "max", "ignorecase", "alpha", "exceptions", "vocab"},
    "consistency": {"either", "nonword", "ignorecase"},
    "conditional": {"first", "second", "exceptions", "ignorecase", "vocab"},
    "capitalization": {"match", "style", "exceptions", "indicators", "threshold", "vocab", "prefix"},
    "readability": {"metrics", "grade"},
    "metric": {"formula", "condition"},
    "spelling": {"dictionaries", "dic", "aff", "dicpath", "ignore", "filters", "custom", "append", "threshold"},
    "sequence": {"tokens", "model", "ignorecase"},
    "script": {"script"},
}
OPEN_KINDS = {"consistency", "spelling"}  # unknown keys are let through


class RuleError(ValueError):
    """A rule that can't be used, with the reason and, where they are known, its file, line and column."""

    def __init__(self, text: str, path: str | None = None, line: int = 1, column: int = 1):
        super().__init__(text)
        self.text, self.path, self.line, self.column = text, path, line, column

    def as_line(self) -> str:
        return f"{self.path or 'rule'}:{self.line}:{self.column}:{self.text}"

    def as_json(self) -> str:
        import json

        return json.dumps({"Path": self.path, "Line": self.line, "Span": self.column, "Text": self.text}, ensure_ascii=False)


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    message: str
    level: str = "warning"
    scope: tuple[str, ...] = ("text",)
    description: str = ""
    link: str = ""
    limit: int = 0
    action: tuple[str, tuple[str, ...]] | None = None
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    @property
    def style(self) -> str:
        return self.name.partition(".")[0]


def parse_rule(name: str, spec: dict[str, Any], level: str | None = None) -> Rule:
    """A validated rule. ``level`` overrides what the rule states."""
    if not isinstance(spec, dict):
        raise RuleError(f"{name}: a rule is a mapping")
    kind = spec.get("extends")
    if kind not in KINDS:
        raise RuleError(f"{name}: 'extends' must be one of {', '.join(KINDS)}")
    if not spec.get("message"):
        raise RuleError(f"{name}: 'message' is missing")
    if spec.get("code"):
        raise RuleError(f"{name}: 'code' is no longer supported")
    if spec.get("level", "warning") not in LEVELS:
        raise RuleError(f"{name}: 'level' must be one of {', '.join(LEVELS)}")
    if kind not in OPEN_KINDS and (extra := set(spec) - COMMON - KINDS[kind]):
        raise RuleError(f"{name}: unknown keys {', '.join(sorted(extra))}")
    scope = spec.get("scope") or ("text" if kind != "sequence" else "sentence")
    scope = [scope] if isinstance(scope, str) else list(scope)
    if kind == "metric" or kind == "readability":
        scope = ["summary"]
    act = spec.get("action") or {}
    action = (act["name"], tuple(map(str, act.get("params") or ()))) if act.get("name") else None
    params = {k: v for k, v in spec.items() if k not in COMMON} | {"matchcase": bool(spec.get("matchcase"))}
    return Rule(name, kind, spec["message"], level or spec.get("level", "warning"), tuple(scope), spec.get("description", ""), spec.get("link", ""), int(spec.get("limit") or 0), action, params)


def load_rules(folder: str, enabled: set[str] | None = None) -> list[Rule]:
    """The rules of ``folder/<Style>/<Rule>.yml``; test files beside them are left out, and so are styles not enabled."""
    from pathlib import Path

    import yaml

    out = {}
    for p in sorted(Path(folder).glob("*/*.y*ml")):
        name = f"{p.parent.name}.{p.stem}"
        if ".test" in p.suffixes or p.stem.endswith(".test") or (enabled is not None and not {name, p.parent.name} & enabled):
            continue
        text = p.read_text(encoding="utf-8")
        try:
            spec = yaml.safe_load(text) or {}
        except yaml.YAMLError as e:
            at = getattr(e, "problem_mark", None)
            raise RuleError(f"{name}: not readable as YAML: {str(e)[:200]}", str(p), at.line + 1 if at else 1, at.column + 1 if at else 1) from e
        try:
            rule = parse_rule(name, spec)
            if rule.kind == "spelling":
                rule.params.update(dictionaries_of(rule, folder))
        except RuleError as e:
            keys = re.findall(r"\b\w+\b", e.text.partition("unknown keys")[2]) or ["extends"]
            line = next((i for i, x in enumerate(text.splitlines(), 1) if x.startswith(keys[0] + ":")), 1)
            raise RuleError(e.text, str(p), line) from e
        out.setdefault(name, rule)
    return [out[k] for k in sorted(out)]


def dictionaries_of(rule: Rule, folder: str) -> dict[str, Any]:
    """``dictionary`` and ``ignore_words`` of a spelling rule, from the files it names.

    ``aff`` and ``dic`` name one dictionary; else ``dictionaries`` are names, or all there are, in
    ``dicpath`` or ``config/dictionaries``; with ``append`` those of ``config/dictionaries`` come
    in too. ``ignore`` names word lists. A rule without any dictionary is an error.
    """
    from pathlib import Path

    from inkwell.functions.spell import read_dictionary

    p, home = rule.params, Path(folder)
    named = lambda x, *at: next((str(f) for f in (Path(x), home / x, *(home / a / x for a in at)) if f.exists()), None)
    own, got = home / "config" / "dictionaries", []
    if p.get("dic") and p.get("aff"):
        dic, aff = named(p["dic"], "config/dictionaries"), named(p["aff"], "config/dictionaries")
        if not (dic and aff):
            raise RuleError(f"{rule.name}: there is no dictionary {p['dic']} with {p['aff']}")
        got = [read_dictionary(dic, aff)]
    else:
        at = named(p["dicpath"]) if p.get("dicpath") else str(own)
        if at is None:
            raise RuleError(f"{rule.name}: there is no folder {p['dicpath']}")
        names = p.get("dictionaries") or []
        names = [names] if isinstance(names, str) else names
        files = [Path(at) / f"{n}.dic" for n in names] if names else sorted(Path(at).glob("*.dic"))
        if p.get("append"):
            files += sorted(own.glob("*.dic"))
        for f in dict.fromkeys(files):
            if not f.is_file():
                raise RuleError(f"{rule.name}: there is no dictionary {f}")
            got.append(read_dictionary(str(f), str(f.with_suffix(".aff"))))
    if not got:
        raise RuleError(f"{rule.name}: a spelling rule needs a dictionary")
    words: set[str] = set()
    for x in [p["ignore"]] if isinstance(p.get("ignore"), str) else p.get("ignore") or []:
        if f := named(x, "config/ignore"):
            words |= {w.strip() for w in Path(f).read_text(encoding="utf-8").splitlines() if w.strip()}
    return {"dictionary": got, "ignore_words": words}


_GLOBAL_FLAG = re.compile(r"\(\?([imsx]+)\)")
_GO_NAMED = re.compile(r"\(\?<([A-Za-z_]\w*)>")


def portable(pattern: str) -> str:
    """A pattern that Python takes: named groups in its spelling, and flags in the middle as groups to the end."""
    pattern = _GO_NAMED.sub(r"(?P<\1>", pattern)
    pattern = re.sub(r"\\p\{L\}", r"[^\\W\\d_]", pattern)
    out, depth_closes = pattern, 0
    while m := _GLOBAL_FLAG.search(out):
        out = out[: m.start()] + f"(?{m.group(1)}:" + out[m.end() :]
        depth_closes += 1
    return out + ")" * depth_closes


def longest_first(parts: list[str]) -> list[str]:
    """A total order: by length, the longest first, then by text."""
    return sorted(parts, key=lambda s: (-len(s), s))


def words_pattern(parts: list[str], nonword: bool = False, ignorecase: bool = False, raw: str = "", append: bool = False, template: str = r"\b(?:%s)\b") -> str:
    """``raw`` and an alternation of ``parts`` in word boundaries; a percent sign in ``raw`` is a percent sign."""
    body = "|".join(parts)
    words = ("(?:" + body + ")" if nonword else template.replace("%s", body)) if parts else ""
    p = words + raw if append else raw + words
    return ("(?i)" if ignorecase else "") + "(?m)" + p


def compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(portable(pattern), re.ASCII)
    except re.error as e:
        raise RuleError(f"a pattern can't be compiled: {e}: {pattern[:80]}") from e


def literals(parts: list[str]) -> list[str] | None:
    """For each part a literal that any match holds, in lower case; None where a part has none of two letters."""
    out = []
    for p in parts:
        if "|" in p:
            return None
        bare = re.sub(r"\(\?[=!<][^)]*\)", "\n", p)
        bare = re.sub(r"\[[^\]]*\][*+?]?|\([^)]*\)[*+?]?|\\.|.[*?]|.\{\d+(?:,\d*)?\}|[.^$()+]", "\n", bare)
        best = max(re.findall(r"[\w '-]+", bare), key=len, default="").lower()
        if len(best.strip()) < 2:
            return None
        out.append(best)
    return out


def options(value: str) -> list[str]:
    """The choices of a replacement: parts between bars that aren't escaped."""
    return [p.replace("\\|", "|") for p in re.split(r"(?<!\\)\|", value)]


def to_sentence(parts: list[str], word: str = "or") -> str:
    """``'a'``, ``'a' or 'b'``, ``'a', 'b', or 'c'``."""
    q = [f"'{p}'" for p in parts]
    if len(q) < 3:
        return f" {word} ".join(q)
    return ", ".join(q[:-1]) + f", {word} {q[-1]}"


_VERB = re.compile(r"%(?:\[(\d+)\])?(?:\.(\d+))?([sdvqf%])")


def message(template: str, *args: Any) -> str:
    """The template with its verbs filled; surplus arguments are dropped, a missing one is empty."""
    at = 0

    def fill(m: re.Match) -> str:
        nonlocal at
        if m.group(3) == "%":
            return "%"
        if m.group(1):
            at = int(m.group(1)) - 1
        value = args[at] if at < len(args) else ""
        at += 1
        return f"{value:.{m.group(2)}f}" if m.group(2) and isinstance(value, (int, float)) else str(value)

    return _VERB.sub(fill, template)


# ---------------------------------------------------------------- scopes

def scope_parts(entry: str) -> list[tuple[bool, frozenset[str]]]:
    """``(negated, labels)`` for each part of ``a.b & ~c``."""
    out = []
    for part in entry.split("&"):
        part = part.strip()
        negated = part.startswith("~")
        out.append((negated, frozenset(x for x in part.lstrip("~").strip().split(".") if x)))
    return out


def in_scope(entries: tuple[str, ...], block: str) -> bool:
    """Whether any entry selects the block's scope.

    All parts of an entry must hold; a part holds if its labels are among the block's, a negated
    one if they aren't, and never on ``raw`` and ``summary`` blocks. Sentence blocks are seen only
    by entries that name them.
    """
    labels = frozenset(block.split("."))
    for entry in entries:
        parts = scope_parts(entry)
        if block.startswith("sentence.") and not any(not neg and "sentence" in ls for neg, ls in parts):
            continue
        if all((not (ls <= labels) and not labels & {"raw", "summary"}) if neg else ls <= labels for neg, ls in parts):
            return True
    return False
