"""The twelve kinds of rule over the blocks of one document, with exact places.

A rule becomes a matcher: ``run(block, state) -> hits``. Hits carry offsets in the block; the
document step turns them into lines and columns, applies suppression, dedup and limits, and
so needs no shuffle: a document is linted where it lies.
"""

from __future__ import annotations

import ast
import math
import re
import signal
import threading
from bisect import bisect_right
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from inkwell.functions.spell import Dictionary, checked
from inkwell.functions.tagger import tag, universal
from inkwell.functions.text import metrics_of, recase, sentence_case, syllables, title_case
from inkwell.plans.config import Config
from inkwell.plans.rules import Rule, RuleError, compiled, in_scope, literals, longest_first, message, options, portable, to_sentence, words_pattern


@dataclass
class Hit:
    begin: int  # in the block's text
    end: int
    match: str
    args: tuple
    params: tuple[str, ...] | None = None


@dataclass
class State:
    """What rules remember of a document, each under its own name."""

    seen: dict[str, set] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    tags: dict[str, list] = field(default_factory=dict)


Runner = Callable[[str, State], list[Hit]]


def exceptions(rule: Rule, cfg: Config) -> re.Pattern | None:
    """One expression for what a match may hold and still be fine; a search, not a whole match."""
    parts = list(rule.params.get("exceptions") or ())
    if rule.params.get("vocab", True):
        parts += cfg.accept
    if not parts:
        return None
    return compiled(("" if rule.params.get("matchcase") else "(?i)") + r"\b(?:" + "|".join(longest_first(parts)) + r")\b")


def _phrases(cfg: Config) -> re.Pattern | None:
    """One expression for the accepted phrases of several words, in which nothing is reported."""
    many = [p for p in cfg.accept if re.search(r"\w(?:\s|\\s[+*]?)+\w", p)]
    return compiled("(?i)\\b(?:" + "|".join(longest_first(many)) + ")\\b") if many else None


def phrase_spans(text: str, phrases: re.Pattern | None) -> list[tuple[int, int]]:
    """Places of accepted phrases in order; they don't overlap."""
    return [m.span() for m in phrases.finditer(text)] if phrases else []


def _inside(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    i = bisect_right(spans, (a, 1 << 62)) - 1
    return i >= 0 and b <= spans[i][1]


def _cheap(parts: list[str] | None, plain: bool) -> Callable[[str], bool]:
    """A test that a text may match at all."""
    if plain or not parts or (lits := literals(parts)) is None:
        return lambda low: True
    lits = list(dict.fromkeys(lits))
    return lambda low: any(x in low for x in lits)


def existence(rule: Rule, cfg: Config) -> Runner:
    p = rule.params
    tokens = longest_first(list(p.get("tokens") or ()))
    raw = "".join(p.get("raw") or ())
    rx = compiled(words_pattern(tokens, bool(p.get("nonword")) or not tokens, bool(p.get("ignorecase")), raw, bool(p.get("append")), cfg.word_template))
    skip, may = exceptions(rule, cfg), _cheap(tokens, bool(raw))
    phrases = _phrases(cfg) if p.get("vocab", True) else None

    def run(text: str, state: State) -> list[Hit]:
        if not may(text.lower()):
            return []
        spans = phrase_spans(text, phrases)
        return [
            Hit(m.start(), m.end(), m.group(), (m.group(),)) for m in rx.finditer(text)
            if m.group().strip() and not (skip and skip.search(m.group())) and not _inside(spans, *m.span())
        ]

    return run


MOST_SPELLINGS = 64


def spellings(pattern: str, most: int = MOST_SPELLINGS) -> list[str] | None:
    """All strings an expression of letters, ``?``, ``|`` and groups matches; None where they aren't few."""
    import re._parser as parser

    try:
        tree = parser.parse(pattern)
    except re.error:
        return None

    def of(seq) -> list[str] | None:
        out = [""]
        for op, arg in seq:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "SUBPATTERN":
                more = of(arg[3])
            elif name == "BRANCH":
                parts = [of(x) for x in arg[1]]
                more = None if None in parts else [y for x in parts for y in x]
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                inner = of(arg[2])
                more = None if inner is None else [*inner, ""]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                more = [chr(c) for _, c in arg]  # alternatives of one letter are read as a class
            else:
                more = None
            if more is None or len(out) * len(more) > most:
                return None
            out = [a + b for a in out for b in more]
        return out

    return None if re.search(r"(?<!\\)\[", pattern) else of(tree)


def canonical(term: str, observed: str) -> str:
    """A term's own spelling of what was met: the one that differs in case alone, else the term as it is written."""
    return next((w for w in spellings(term) or () if w.lower() == observed.lower()), term)


def substitution(rule: Rule, cfg: Config) -> Runner:
    p = rule.params
    swap = {str(k): str(v) for k, v in (p.get("swap") or {}).items()}
    keys = longest_first(list(swap))
    ignore = bool(p.get("ignorecase", True))
    flat = [re.sub(r"(?<!\\)\((?!\?)", "(?:", k) for k in keys]
    rx = compiled(words_pattern([f"({k})" for k in flat], bool(p.get("nonword")), ignore, template=cfg.word_template))
    own = [compiled(("(?i)" if ignore else "") + k) for k in keys]
    skip, may = exceptions(rule, cfg), _cheap(keys, False)
    parts = re.compile(p["pos"]) if p.get("pos") else None  # what the tags of the match, joined by spaces, must fit
    phrases = _phrases(cfg) if p.get("vocab", True) else None

    def run(text: str, state: State) -> list[Hit]:
        if not may(text.lower()):
            return []
        spans = phrase_spans(text, phrases)
        out = []
        for m in rx.finditer(text):
            got = m.group()
            i = next((i for i, g in enumerate(m.groups()) if g is not None and (g or m.start(i + 1) > 0)), None)
            if i is None or skip and skip.search(got) or _inside(spans, *m.span()):
                continue
            if parts is not None:
                words = state.tags.get(text) or state.tags.setdefault(text, tag(text))
                if not parts.search(" ".join(t for _, t, at in words if m.start() <= at < m.end())):
                    continue
            want = swap[keys[i]]
            if "$" in want and (k := own[i].search(got)):
                want = re.sub(r"\$(\d+)", lambda x: (k.group(int(x.group(1))) or "") if int(x.group(1)) <= len(k.groups()) else "", want)
            choices = options(want)
            replace = rule.action is not None and rule.action[0] == "replace" and not rule.action[1]
            if replace and got in choices:
                continue
            try:
                if not replace and (got == want or re.fullmatch(portable(want), got)):
                    continue
            except re.error:
                if got == want:
                    continue
            params = None
            if replace:
                if p.get("capitalize") and got[:1].isupper():
                    choices = [c[:1].upper() + c[1:] for c in choices]
                if p.get("matchcase"):
                    choices = [recase(got, c) for c in choices]
                params, shown = tuple(choices), to_sentence(choices)
                shown = shown[1:-1] if rule.message.count("'%s'") >= 1 and len(choices) == 1 else shown
            else:
                want = canonical(want, got)
                if got == want:
                    continue
                shown = recase(got, want) if p.get("matchcase") else want
                shown = to_sentence(choices) if len(choices) > 1 else shown
            out.append(Hit(m.start(), m.end(), got, (shown, got), params))
        return out

    return run


def _is_code(text: str) -> bool:
    return bool(re.fullmatch(r"[*@\s]*", text))


def occurrence(rule: Rule, cfg: Config) -> Runner:
    p = rule.params
    rx = compiled(("(?i)" if p.get("ignorecase") else "") + f"(?:{p['token']})")
    most, least = int(p.get("max") or 0), int(p.get("min") or 0)

    def run(text: str, state: State) -> list[Hit]:
        ms = list(rx.finditer(text))
        if not (most > 0 and len(ms) > most or least > 0 and len(ms) < least):
            return []
        if not ms:
            return [Hit(0, 1, text[:1], (0,))]
        m = next((m for m in ms if m.group().strip() and not _is_code(m.group())), None)
        return [Hit(m.start(), m.end(), m.group(), (len(ms),))] if m else []

    return run


def repetition(rule: Rule, cfg: Config) -> Runner:
    p = rule.params
    rx = compiled(("(?i)" if p.get("ignorecase") else "") + "(" + "|".join(longest_first(list(p.get("tokens") or [r"[^\s]+"]))) + ")")
    most, alpha, fold = int(p.get("max") or 0), bool(p.get("alpha")), bool(p.get("ignorecase"))
    skip = exceptions(rule, cfg)

    def run(text: str, state: State) -> list[Hit]:
        out, count, before = [], 0, None
        for m in rx.finditer(text):
            w = m.group().strip()
            if not w:
                continue
            if before is not None:
                b = before.group().strip()
                same = b.lower() == w.lower() if fold else b == w
                # the counter isn't reset by a pair that differs, only by a report
                if same and not (alpha and not w.isalpha()) and not re.search(r"[.!?]\s|\n\s*\n", text[before.end() : m.start() + 1]):
                    count += 1
                    if count > most and not (skip and skip.search(w)):
                        out.append(Hit(before.start(), m.end(), text[before.start() : m.end()], (w,)))
                        count = 0
            before = m
        return out

    return run


def consistency(rule: Rule, cfg: Config) -> Runner:
    p = rule.params
    flags = "(?i)" if p.get("ignorecase") else ""
    form = "%s" if p.get("nonword") else r"\b%s\b"
    pairs = [(a, b, compiled(flags + form % f"(?:{a})"), compiled(flags + form % f"(?:{b})")) for a, b in sorted((p.get("either") or {}).items())]

    def run(text: str, state: State) -> list[Hit]:
        out, seen = [], state.seen.setdefault(rule.name, set())
        for a, b, ra, rb in pairs:
            ms = sorted([(m.start(), m, "a") for m in ra.finditer(text)] + [(m.start(), m, "b") for m in rb.finditer(text)], key=lambda x: x[0])
            seen |= {(a, b, side) for _, _, side in ms}
            if ms and (a, b, "a") in seen and (a, b, "b") in seen:
                m = ms[-1][1]
                out.append(Hit(m.start(), m.end(), m.group(), (m.group(),)))
        return out

    return run


def conditional(rule: Rule, cfg: Config) -> Runner:
    first, second = compiled(rule.params["first"]), compiled(rule.params["second"])
    skip = exceptions(rule, cfg)

    def run(text: str, state: State) -> list[Hit]:
        ok = lambda m: m.group() and not (skip and skip.search(m.group()))
        if not second.groups:
            ms = [m for m in first.finditer(text) if ok(m)]
            return [] if second.search(text) else [Hit(m.start(), m.end(), m.group(), (m.group(),)) for m in ms]
        seen = state.seen.setdefault(rule.name, set())
        seen |= {g for m in second.finditer(text) for g in m.groups() if g}
        return [Hit(m.start(), m.end(), m.group(), (m.group(),)) for m in first.finditer(text) if ok(m) and m.group() not in seen]

    return run


_WORDS = r"[\w*][^\s]*"


def capitalization(rule: Rule, cfg: Config) -> Runner:
    p = rule.params
    kind = p.get("match", "$title")
    least = float(p.get("threshold") or 0.8)
    marks = tuple(p.get("indicators") or ())
    extra = list(p.get("exceptions") or ()) + (cfg.accept if p.get("vocab", True) else [])
    skip = re.compile("|".join([*map(portable, longest_first(extra))]), re.I if not p.get("matchcase") else 0) if extra else None
    words = re.compile("|".join([*(f"(?:{portable(x)})" for x in longest_first(extra)), _WORDS]))
    own = None if kind.startswith("$") else compiled(kind)

    def share(text: str, want: str, sentence: bool) -> float | None:
        got, exp = words.findall(text), words.findall(want)
        if not got:
            return None
        n, free = 0.0, False
        for i, w in enumerate(got):
            if i == 0 and sentence and w[:1].islower() and not (skip and skip.search(w)):
                return 0.0
            fine = free or i >= len(exp) or w == exp[i] or bool(skip and skip.search(w)) or (not sentence and w.isupper()) or bool(re.match(r"^\d+\.$", got[0])) and i == 1
            n += fine
            free = w.endswith(marks) if marks else False
        return n / len(got)

    def run(text: str, state: State) -> list[Hit]:
        body = text[len(p["prefix"]) :] if p.get("prefix") and text.startswith(p["prefix"]) else text
        if kind == "$title":
            want = title_case(body, p.get("style", "AP"))
            s = share(body, want, False)
            good = s is not None and s >= least
        elif kind == "$sentence":
            want = sentence_case(body)
            s = share(body, want, True)
            good = s is not None and s >= least
        elif kind in ("$lower", "$upper"):
            want = body.lower() if kind == "$lower" else body.upper()
            good = body == want or bool(skip and skip.fullmatch(body))
        else:
            want, good = kind, bool(own.search(body)) or bool(skip and skip.fullmatch(body))
        return [] if good else [Hit(0, len(text), text, (text, want))]

    return run


_MATH = {"sqrt": math.sqrt, "abs": abs, "log": math.log, "pow": pow, "floor": math.floor, "ceil": math.ceil}


def formula(text: str) -> Callable[[dict[str, float]], float]:
    """A metric formula as a function of metrics: numbers, names, ``+ - * /``, and functions of ``math``; unset names are 0."""
    tree = ast.parse(" ".join(text.split()), mode="eval")

    def value(n, env):
        if isinstance(n, ast.Expression):
            return value(n.body, env)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return float(n.value)
        if isinstance(n, ast.Name):
            return float(env.get(n.id, 0.0))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -value(n.operand, env) if isinstance(n.op, ast.USub) else value(n.operand, env)
        if isinstance(n, ast.BinOp):
            a, b = value(n.left, env), value(n.right, env)
            if isinstance(n.op, ast.Div):
                return a / b if b else math.nan
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Mod: lambda: math.fmod(a, b) if b else math.nan}[type(n.op)]()
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and getattr(n.func.value, "id", "") == "math" and n.func.attr in _MATH:
            return float(_MATH[n.func.attr](*(value(x, env) for x in n.args)))
        raise RuleError(f"a formula can't use {ast.dump(n)[:60]}")

    value(tree, {})  # anything not allowed shows at once
    return lambda env: value(tree, env)


def holds(value: float, condition: str) -> bool:
    """``value`` against a condition such as ``> 8``, after rounding to six decimals; NaN never holds."""
    m = re.fullmatch(r"\s*(>=|<=|>|<|==|!=)\s*(-?[\d.]+)\s*", condition)
    if not m:
        raise RuleError(f"not a condition: {condition}")
    a, b = round(value, 6), float(m.group(2))
    return not math.isnan(a) and {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": a == b, "!=": a != b}[m.group(1)]


# The readability formulas by name.
GRADES = {
    "Gunning Fog": "0.4 * ((words / sentences) + 100 * (complex_words / words))", "Coleman-Liau": "(0.0588 * (characters / words) * 100) - (0.296 * (sentences / words) * 100) - 15.8",
    "Flesch-Kincaid": "(0.39 * (words / sentences)) + (11.8 * (syllables / words)) - 15.59", "SMOG": "1.0430 * math.sqrt((polysyllabic_words * 30.0) / sentences) + 3.1291",
    "Automated Readability": "(4.71 * (characters / words)) + (0.5 * (words / sentences)) - 21.43", "Flesch Reading Ease": "206.835 - (1.015 * (words / sentences)) - (84.6 * (syllables / words))",
    "LIX": "(words / sentences) + ((long_words * 100) / words)",
}


def metric(rule: Rule, cfg: Config) -> Runner:
    f, cond = formula(rule.params["formula"]), rule.params["condition"]

    def run(text: str, state: State) -> list[Hit]:
        v = f(metrics_of(text) | {k: float(n) for k, n in state.counts.items()})
        return [Hit(-1, 0, "", (v,))] if holds(v, cond) else []

    return run


def readability(rule: Rule, cfg: Config) -> Runner:
    fs = [formula(GRADES[m]) for m in rule.params.get("metrics") or ["Flesch-Kincaid"] if m in GRADES]
    most = float(rule.params["grade"])

    def run(text: str, state: State) -> list[Hit]:
        m = metrics_of(text)
        if not m["words"]:
            return []
        v = sum(f(m) for f in fs) / len(fs)
        return [Hit(-1, 0, "", (v,))] if v > most else []

    return run


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\w+")


def spelling(rule: Rule, cfg: Config) -> Runner:
    p = rule.params
    dics = p.get("dictionary")
    dics = [dics] if isinstance(dics, Dictionary) else list(dics or ())
    if not dics:
        raise RuleError(f"{rule.name}: a spelling rule needs a dictionary")
    ignore = {w.lower() for w in p.get("ignore_words") or ()}
    filters = [compiled(f) for f in p.get("filters") or ()]
    phrases = _phrases(cfg)
    accept = compiled("(?i)" + "|".join(rf"\b(?:{t})\b" for t in cfg.accept)) if cfg.accept else None

    def run(text: str, state: State) -> list[Hit]:
        shown = text
        if phrases:
            shown = phrases.sub(lambda m: "*" * len(m.group()), text)
        out = []
        for m in _TOKEN.finditer(shown):
            w = dics[0].convert(m.group())
            if not checked(w, bool(p.get("custom"))) or any(f.search(w) for f in filters) or w.lower() in ignore:
                continue
            if not any(d.accepts(w) for d in dics) and not (accept and accept.search(w)):
                out.append(Hit(m.start(), m.end(), m.group(), (w,)))
        return out

    return run


def sequence(rule: Rule, cfg: Config) -> Runner:
    fold = re.I if rule.params.get("ignorecase") else 0
    steps: list[dict] = []
    for t in rule.params["tokens"]:
        test = {"negate": bool(t.get("negate")), "target": bool(t.get("target")), "tag": None, "pattern": None, "words": None}
        if t.get("tag"):
            test["tag"] = re.compile(t["tag"])
        if t.get("upos"):
            try:
                test["tag"], test["words"] = universal(t["upos"])
            except ValueError as e:
                raise RuleError(f"{rule.name}: {e}") from e
        if t.get("pattern"):
            test["pattern"] = re.compile(rf"^(?:{portable(t['pattern'])})$", fold)
        bare = not (test["tag"] or test["pattern"])
        steps += [test | {"optional": True, "target": False}] * int(t.get("skip") or 0)
        if not (bare and t.get("skip")):
            steps.append(test | {"optional": False})
    anchor = next((i for i, s in enumerate(steps) if s["pattern"] and not s["negate"] and not s["optional"]), None)
    if anchor is None:
        anchor = next((i for i, s in enumerate(steps) if s["tag"] and not s["optional"]), 0)

    def fits(s: dict, word: tuple[str, str, int]) -> bool:
        ok = (s["tag"] is None or bool(s["tag"].search(word[1]))) and (s["pattern"] is None or bool(s["pattern"].match(word[0]))) and (s["words"] is None or word[0].lower() in s["words"])
        return ok != s["negate"]

    def walk(words, at: int, side: list[dict], step: int) -> list[tuple[int, dict]] | None:
        """The words a side of the anchor takes; None if a required one is missing."""
        got, k = [], at
        wild = lambda s: not (s["tag"] or s["pattern"])
        for i, s in enumerate(side):
            k += step
            if not 0 <= k < len(words):
                if s["optional"] or s["negate"]:
                    k -= step
                    continue
                return None
            if s["optional"]:
                rest = next((x for x in side[i + 1 :] if not x["optional"]), None)
                if rest is not None and fits(rest, words[k]) or not wild(s) and not fits(s, words[k]):
                    k -= step  # nothing is skipped here
                    continue
            elif not fits(s, words[k]):
                return None
            got.append((k, s))
        return got

    def run(text: str, state: State) -> list[Hit]:
        words = state.tags.get(text)
        if words is None:
            words = state.tags[text] = tag(text)
        out, used = [], set()
        for i, w in enumerate(words):
            if i in used or not fits(steps[anchor], w):
                continue
            left = walk(words, i, steps[:anchor][::-1], -1)
            right = walk(words, i, steps[anchor + 1 :], 1) if left is not None else None
            if right is None:
                continue
            got = sorted([*left, (i, steps[anchor]), *right], key=lambda x: x[0])
            marked = [k for k, s in got if s["target"]] or [k for k, _ in got]
            used |= {k for k, _ in got}
            a, b = words[min(marked)][2], words[max(marked)][2] + len(words[max(marked)][0])
            out.append(Hit(a, b, text[a:b], tuple(words[k][0] for k, _ in got)))
        return out

    return run


#: Callables for script rules, by name: text to a list of ``{"begin", "end", "message"?}``.
SCRIPTS: dict[str, Callable[[str], list[dict]]] = {}


#: Seconds that a script may take over one block.
SCRIPT_LIMIT = 2.0


@contextmanager
def _limited(seconds: float, name: str):
    """Ends what runs inside after so many seconds, where signals can be had: in the main thread, as Python workers are."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        yield
        return

    def stop(*_):
        raise RuleError(f"{name}: the script took more than {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def script(rule: Rule, cfg: Config) -> Runner:
    f = rule.params["script"]
    f = SCRIPTS.get(f) if isinstance(f, str) else f
    if f is None:
        raise RuleError(f"{rule.name}: no script is registered as {rule.params['script']!r}")

    def run(text: str, state: State) -> list[Hit]:
        with _limited(SCRIPT_LIMIT, rule.name):
            found = list(f(text))
        return [Hit(m["begin"], m["end"], text[m["begin"] : m["end"]], (text[m["begin"] : m["end"]],), (m["message"],) if m.get("message") else None) for m in found]

    return run


BUILDERS: dict[str, Callable[[Rule, Config], Runner]] = {
    "existence": existence, "substitution": substitution, "occurrence": occurrence, "repetition": repetition, "consistency": consistency, "conditional": conditional,
    "capitalization": capitalization, "metric": metric, "readability": readability, "spelling": spelling, "sequence": sequence, "script": script,
}


class Program:
    """Rules compiled for a configuration, with the rules of each scope found once."""

    def __init__(self, rules: list[Rule], cfg: Config):
        self.cfg = cfg
        self.rules = sorted(rules, key=lambda r: r.name)
        self.runners = {r.name: BUILDERS[r.kind](r, cfg) for r in self.rules}
        self._scopes: dict[str, list[Rule]] = {}

    def of_scope(self, scope: str) -> list[Rule]:
        if scope not in self._scopes:
            self._scopes[scope] = [r for r in self.rules if in_scope(r.scope, scope)]
        return self._scopes[scope]


__all__ = ["BUILDERS", "GRADES", "Hit", "Program", "SCRIPTS", "State", "formula", "holds", "message", "syllables"]
