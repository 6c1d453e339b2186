"""Configuration: sections by glob, their styles, levels, ignores and vocabulary."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field
from functools import lru_cache

from inkwell.plans.rules import LEVELS, Rule


@lru_cache(maxsize=4096)
def glob_regex(pattern: str) -> re.Pattern:
    """A glob as an expression for a whole path.

    ``*`` crosses separators unless the pattern has ``**``, which then is what crosses them;
    ``{a,b}`` are choices, ``[...]`` a class.
    """
    deep = "**" in pattern
    out, i, level = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*" if deep else ".*"
        elif c == "?":
            out += "[^/]" if deep else "."
        elif c == "{":
            out, level = out + "(?:", level + 1
        elif c == "}" and level:
            out, level = out + ")", level - 1
        elif c == "," and level:
            out += "|"
        elif c == "[" and (e := pattern.find("]", i + 1)) > 0:
            out, i = out + "[" + pattern[i + 1 : e].replace("!", "^", 1 if pattern[i + 1] == "!" else 0) + "]", e
        else:
            out += re.escape(c)
        i += 1
    return re.compile(out, re.S)


def glob_matches(pattern: str, path: str) -> bool:
    """A leading ``!`` negates."""
    negate = pattern.startswith("!")
    return bool(glob_regex(pattern.lstrip("!") if negate else pattern).fullmatch(path)) != negate


@dataclass
class Section:
    glob: str
    styles: list[str] | None = None
    checks: dict[str, bool] = field(default_factory=dict)
    levels: dict[str, str] = field(default_factory=dict)
    block_ignores: list[str] = field(default_factory=list)
    token_ignores: list[str] = field(default_factory=list)
    lang: str | None = None
    delimiters: tuple[str, str] | None = None  # what opens and closes comments beside those of the format


@dataclass
class Config:
    min_level: str = "suggestion"
    styles: list[str] = field(default_factory=list)
    checks: dict[str, bool] = field(default_factory=dict)
    levels: dict[str, str] = field(default_factory=dict)
    sections: list[Section] = field(default_factory=list)
    accept: list[str] = field(default_factory=list)
    reject: list[str] = field(default_factory=list)
    formats: dict[str, str] = field(default_factory=dict)
    skipped_scopes: tuple[str, ...] = ("script", "style", "pre", "figure", "noscript", "iframe")
    ignored_scopes: tuple[str, ...] = ("tt", "code", "kbd")
    ignored_classes: tuple[str, ...] = ("problematic", "pre", "code")
    word_template: str = r"\b(?:%s)\b"
    control_word: str = "lint"  # what control comments begin with
    inline: bool = False  # links, emphasis and code are blocks too; linting turns it on where a rule asks for them
    ignore_syntax: bool = False  # every document is one text
    fragments: dict[str, str] = field(default_factory=dict)  # endings of code whose comments hold markup, with its ending
    view: dict[str, str] | None = None  # names and paths of the values of data documents that are linted; all where there is none
    transform: str | None = None
    packages: list[str] = field(default_factory=list)
    vocabularies: list[str] = field(default_factory=list)

    def section_of(self, path: str) -> Section:
        """What holds for a path: the styles of the last matching section, the settings of all, later ones first."""
        out = Section(path, list(self.styles), {}, {})
        for s in self.sections:
            if glob_matches(s.glob, path):
                if s.styles is not None:
                    out.styles = list(s.styles)
                out.checks |= s.checks
                out.levels |= s.levels
                out.block_ignores += s.block_ignores
                out.token_ignores += s.token_ignores
                out.lang = s.lang or out.lang
                out.delimiters = s.delimiters or out.delimiters
        return out

    def level_of(self, rule: Rule, section: Section | None = None) -> str:
        """The section's level for the rule, else for its style, else the configured one, else the rule's own."""
        for table in ([section.levels] if section else []) + [self.levels]:
            if rule.name in table:
                return table[rule.name]
            if rule.style in table:
                return table[rule.style]
        return rule.level

    def runs(self, rule: Rule, section: Section) -> bool:
        """Whether a rule runs on files of a section: its level first, then file settings, global ones, and base styles."""
        if LEVELS[self.level_of(rule, section)] < LEVELS[self.min_level]:
            return False
        for table in (section.checks, self.checks):
            for key in (rule.name, rule.style):
                if key in table:
                    return table[key]
        return rule.style in (section.styles or [])


def _setting(value: str) -> tuple[bool, str | None]:
    """A setting is off at ``NO`` or any unknown word, on at ``YES``, and on at a level by that level's name."""
    if value in LEVELS:
        return True, value
    return value.upper() in ("YES", "ON", "TRUE"), None


def read_config(text: str, styles: str | None = None) -> Config:
    """A configuration from INI text: top keys, ``[formats]``, ``[*]`` and sections by glob.

    With ``styles``, the folder of the styles, vocabularies and views are read from below it. A
    format that turns code into markup makes its comments fragments. An unknown key that isn't the
    name of a rule or style is an error.
    """
    ini = configparser.ConfigParser(default_section="\x00", delimiters=("=",), comment_prefixes=("#", ";"), interpolation=None, strict=False)
    ini.optionxform = str
    ini.read_string("[\x01]\n" + text)
    split = lambda v: [x.strip() for x in re.split(r"(?<!\\),", v) if x.strip()]
    cfg = Config()
    for name in ini.sections():
        rows = dict(ini.items(name))
        if name == "\x01":
            cfg.min_level = rows.get("MinAlertLevel", cfg.min_level)
            cfg.word_template = rows.get("WordTemplate", cfg.word_template)
            if cfg.min_level not in LEVELS:
                raise ValueError(f"MinAlertLevel must be one of {', '.join(LEVELS)}")
            if unknown := set(rows) - TOP_KEYS:
                raise ValueError(f"unknown keys {', '.join(sorted(unknown))}")
            cfg.packages, cfg.vocabularies = split(rows.get("Packages", "")), split(rows.get("Vocab", ""))
            for name_ in cfg.vocabularies if styles else ():
                accept, reject = read_vocabulary(styles, name_)
                cfg.accept += [x for x in accept if x not in cfg.accept]
                cfg.reject += [x for x in reject if x not in cfg.reject]
            for key, attr in (("SkippedScopes", "skipped_scopes"), ("IgnoredScopes", "ignored_scopes"), ("IgnoredClasses", "ignored_classes")):
                if key in rows:
                    setattr(cfg, attr, tuple(split(rows[key])))
            continue
        if name == "formats":
            from inkwell.sources.blocks import CODE, FORMATS

            for k, v in ((f".{k.lstrip('.')}", f".{v.lstrip('.')}") for k, v in rows.items()):
                (cfg.fragments if k in CODE and FORMATS.get(v) not in (None, "txt", "data") else cfg.formats)[k] = v
            continue
        if name == "asciidoctor":
            continue
        s = Section(name)
        for k, v in rows.items():
            if k == "BasedOnStyles":
                s.styles = list(dict.fromkeys(split(v)))
            elif k == "BlockIgnores":
                s.block_ignores = split(v)
            elif k in ("TokenIgnores", "IgnorePatterns"):
                s.token_ignores = split(v)
            elif k == "Lang":
                s.lang = v
            elif k == "CommentDelimiters":
                if len(pair := split(v)) != 2:
                    raise ValueError("CommentDelimiters takes what opens and what closes a comment")
                s.delimiters = (pair[0], pair[1])
            elif k == "Transform":
                cfg.transform = v
            elif k == "View":
                cfg.view = read_view(f"{styles}/config/views/{v}.yml") if styles else cfg.view
            elif k[:1].isupper():
                on, level = _setting(v)
                s.checks[k] = on
                if level:
                    s.levels[k] = level
        if name == "*":
            cfg.styles, cfg.checks, cfg.levels = s.styles or cfg.styles, cfg.checks | s.checks, cfg.levels | s.levels
        cfg.sections.append(s)
    return cfg


TOP_KEYS = set("StylesPath MinAlertLevel IgnoredScopes WordTemplate SkippedScopes IgnoredClasses Vocab NLPEndpoint Packages".split())


def read_vocabulary(styles: str, name: str) -> tuple[list[str], list[str]]:
    """The accepted and rejected expressions of a vocabulary folder; a file that isn't there holds none."""
    from pathlib import Path

    at = Path(styles) / "config" / "vocabularies" / name
    if not at.is_dir():
        raise ValueError(f"there is no vocabulary {name}")
    return tuple(vocabulary(f.read_text(encoding="utf-8")) if (f := at / x).is_file() else [] for x in ("accept.txt", "reject.txt"))


def read_view(path: str) -> dict[str, str]:
    """Names and paths of a view file: ``scopes`` with ``name`` and ``expr``."""
    from pathlib import Path

    import yaml

    spec = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    out = {}
    for i, s in enumerate(spec.get("scopes") or []):
        expr = re.sub(r"\.?all\(\)|\[\]|\[\*\]", ".*", str(s["expr"])).lstrip(".")
        out[s.get("name") or f"value{i}"] = re.sub(r"\[(\d+)\]", r".\1", expr).replace("..", ".")
    return out


def vocabulary(text: str) -> list[str]:
    """The expressions of a vocabulary file: one a line, without comments."""
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("# ")]


def vocabulary_rules(cfg: Config) -> list[Rule]:
    """The rules a vocabulary makes: accepted terms in their spelling, rejected ones not at all."""
    out = []
    if cfg.accept:
        out.append(Rule("Builtin.Terms", "substitution", "Use '%s' instead of '%s'.", "error", params={"swap": {t.lower(): t for t in cfg.accept}, "ignorecase": True, "vocab": False}))
    if cfg.reject:
        out.append(Rule("Builtin.Avoid", "existence", "Avoid using '%s'.", "error", params={"tokens": list(cfg.reject), "ignorecase": True, "vocab": False}))
    return out


def filter_rules(rules: list[Rule], expression: str) -> list[Rule]:
    """Rules for which a boolean expression on ``.Name .Level .Extends .Scope .Message .Link`` holds."""
    import ast

    names = {".Name": "name", ".Level": "level", ".Extends": "kind", ".Scope": "scope", ".Message": "message", ".Link": "link", ".Description": "description"}
    words = {"&&": " and ", "||": " or ", "!": " not "}

    def each(m: re.Match) -> str:  # strings stay as they are
        return m.group() if m.group()[0] in "\"'" else words.get(m.group()) or (names.get(m.group(), "_unknown") if m.group()[0] == "." else m.group())

    text = re.sub(r"\"[^\"]*\"|'[^']*'|!=|&&|\|\||!|\.[A-Z]\w*", each, expression)
    tree = ast.parse(text.strip(), mode="eval")
    allowed = (ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.Compare, ast.Eq, ast.NotEq, ast.In, ast.NotIn, ast.Name, ast.Load, ast.Constant, ast.List, ast.Tuple)
    for node in ast.walk(tree):
        if not isinstance(node, allowed) or isinstance(node, ast.Name) and node.id == "_unknown":
            raise ValueError(f"a rule filter can't use {ast.dump(node)[:60]}")
    code = compile(tree, "filter", "eval")
    return [r for r in rules if eval(code, {"__builtins__": {}}, {v: getattr(r, v) for v in names.values()})]
