"""Documents and rules to alerts."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.matching import Program, State
from inkwell.plans.config import Config, vocabulary_rules
from inkwell.plans.rules import Rule, message, scope_parts
from inkwell.session import spread
from inkwell.sources.blocks import Source, block_counts, document_blocks, tag_counts

INLINE_KINDS = {"link", "strong", "emphasis", "code"}
ALERT_SCHEMA = (
    "doc_id long, path string, alert_seq int, line int, col_begin int, col_end int, check_name string, severity string, message string, "
    "description string, link string, match_text string, action_name string, action_params array<string>"
)


class Controls:
    """Comments that turn rules off and on, in document order.

    ``<word> off|on``, ``<word> Style.Rule = NO|YES``, ``<word> Style = NO``, ``<word> style = A, B``
    (all others off) and ``<word> Style.Rule["match"] = NO``.
    """

    def __init__(self, text: str, word: str, delimiters: tuple[str, str] | None = None):
        opens, shuts = (f"{re.escape(d)}|" for d in delimiters) if delimiters else ("", "")
        rx = re.compile(rf"(?:{opens}<!--|\{{/\*|/\*|#|//|--|;|%|\.\.)[ \t]*{re.escape(word)}[ \t]+(off|on|styles?[ \t]*=[ \t]*[^\n>]+?|[A-Za-z][\w.]*(?:\[[^\]\n]*\])?[ \t]*=[ \t]*\w+)[ \t]*(?:{shuts}-->|\*/\}}?|$)", re.M)
        # one timeline of settings for each thing that can be set, so that a place is looked up by bisection
        self.lines: dict[tuple, tuple[list[int], list]] = {}
        for m in rx.finditer(text) if word in text else ():
            key, _, value = m.group(1).partition("=")
            key, value = key.strip(), value.strip()
            on = value.upper() in ("YES", "ON", "TRUE")
            if key in ("off", "on"):
                self._set(("off",), m.start(), key == "off")
            elif key in ("style", "styles"):
                self._set(("only",), m.start(), frozenset(v.strip() for v in value.split(",")))
            elif "[" in key:
                name, _, body = key.partition("[")
                for x in re.findall(r"[\"']([^\"']*)[\"']", body):
                    self._set(("match", name.strip(), x), m.start(), on)
            else:
                self._set(("rule" if "." in key else "style", key), m.start(), on)

    def _set(self, key: tuple, at: int, value) -> None:
        places, values = self.lines.setdefault(key, ([], []))
        places.append(at)
        values.append(value)

    def _at(self, key: tuple, at: int, default):
        if key not in self.lines:
            return default
        places, values = self.lines[key]
        i = bisect_right(places, at) - 1
        return values[i] if i >= 0 else default

    def allows(self, rule: Rule, at: int, match: str) -> bool:
        if not self.lines:
            return True
        only = self._at(("only",), at, None)
        if self._at(("off",), at, False) or only is not None and rule.style not in only:
            return False
        if not self._at(("rule", rule.name), at, self._at(("style", rule.style), at, True)):
            return False
        return self._at(("match", rule.name, match), at, True)


def lint_document(text: str | None, ext: str | None, path: str, program: Program, run: list[Rule] | None = None) -> list[tuple]:
    """The alerts of one document in the order they arise, deduplicated and limited.

    Two alerts of one check at one place are one, the first; a rule with a limit reports so many
    in a document, in order of arising. A match whose place isn't known is put at 1:1.
    """
    if not text:
        return []
    cfg = program.cfg
    section = cfg.section_of(path)
    rules = [r for r in (program.rules if run is None else run) if cfg.runs(r, section)]
    if not rules:
        return []
    names = {r.name for r in rules}
    src, state = Source(text), State()
    text = src.text
    controls = Controls(text, cfg.control_word, section.delimiters)
    if any(r.kind == "metric" for r in rules):
        plain = document_blocks(text, ext, cfg, False, (section.block_ignores, section.token_ignores))
        state.counts = block_counts(plain) | (tag_counts(text) if (ext or "").lower() in (".html", ".htm", ".xhtml") else {})
    out: list[tuple] = []
    seen: set[tuple] = set()
    counts: dict[str, int] = {}
    for block in document_blocks(text, ext, cfg, True, (section.block_ignores, section.token_ignores)):
        for r in program.of_scope(block.scope):
            if r.name not in names:
                continue
            for h in program.runners[r.name](block.text, state):
                if h.begin < 0:
                    a = b = (1, 1)
                    at = len(text)
                else:
                    at = block.source(h.begin)
                    a, b = src.place(at), src.place(block.source(max(h.begin, h.end - 1)))
                if not controls.allows(r, at, h.match) or (a, r.name) in seen:
                    continue
                if r.limit and counts.get(r.name, 0) >= r.limit:
                    continue
                seen.add((a, r.name))
                counts[r.name] = counts.get(r.name, 0) + 1
                note = h.params[0] if r.kind == "script" and h.params else message(r.message, *(f"{x:.2f}" if isinstance(x, float) else x for x in h.args))
                end = b[1] if b[0] == a[0] else a[1] + max(0, len(h.match.split("\n")[0]) - 1)
                action, params = (r.action or (None, ()))
                if h.params and r.kind == "substitution":
                    params = h.params
                out.append((a[0], a[1], end, r.name, cfg.level_of(r, section), note, r.description, r.link, h.match, action, list(params) if action else None))
    return out


def lint(docs: DataFrame, rules: list[Rule], cfg: Config | None = None, key: str = "doc_id", text: str = "text", path: str | None = None, ext: str = "'.txt'") -> DataFrame:
    """``docs`` linted by ``rules``: one row per alert (``ALERT_SCHEMA``).

    ``path`` names the column that sections and globs look at; ``ext`` is an expression for the
    ending that says the format. Rules are compiled on the driver and travel with the tasks;
    documents stay where they are. Null and empty texts have no alerts, rows with a null key are
    left out, repeated rows give repeated alerts; other columns play no part.
    """
    cfg = cfg or Config(styles=sorted({r.style for r in rules}))
    rules = [*rules, *vocabulary_rules(cfg)]
    if any(x in INLINE_KINDS for r in rules for entry in r.scope for _, ls in scope_parts(entry) for x in ls):
        cfg.inline = True
    if any(r.style == "Builtin" for r in rules) and "Builtin" not in cfg.styles:
        cfg.checks = {"Builtin": True} | cfg.checks

    def run(batches):
        program = Program(rules, cfg)
        for pdf in batches:
            rows = []
            for k, t, p, e in zip(pdf["k"], pdf["t"], pdf["p"], pdf["e"]):
                p = p if isinstance(p, str) else ""
                for i, a in enumerate(lint_document(t, e, p, program)):
                    rows.append((k, p, i, *a))
            names = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "int64", "alert_seq": "int32", "line": "int32", "col_begin": "int32", "col_end": "int32"})

    cols = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), (F.col(path) if path else F.lit("")).alias("p"), F.expr(ext).alias("e"))
    return spread(cols.where("k IS NOT NULL AND t IS NOT NULL"), "k").mapInPandas(run, ALERT_SCHEMA)


HIT_SCHEMA = "doc_id long, block_seq int, check_name string, begin_at long, end_at long, match_text string, args array<string>"


def block_hits(docs: DataFrame, rules: list[Rule], cfg: Config | None = None, key: str = "doc_id", text: str = "text", by_line: bool = False) -> DataFrame:
    """What each rule finds in the blocks of each document (``HIT_SCHEMA``), before any place is deduplicated or limited.

    A document is one block, or with ``by_line`` a block a line, in order; rules that remember do so
    within a document. Offsets count from the block's beginning; a rule on the whole text has -1.
    Null texts and null keys give nothing, repeated rows give repeated hits. Documents stay where they lie.
    """
    cfg = cfg or Config(styles=sorted({r.style for r in rules}))

    def run(batches):
        program = Program(rules, cfg)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                state = State()
                for i, block in enumerate(t.split("\n") if by_line else [t]):
                    for r in program.rules:
                        for h in program.runners[r.name](block, state):
                            rows.append((k, i, r.name, h.begin, h.end, h.match, [str(x) for x in h.args]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HIT_SCHEMA.split(", ")]).astype({"doc_id": "int64", "block_seq": "int32", "begin_at": "int64", "end_at": "int64"})

    cols = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    return spread(cols, "k").mapInPandas(run, HIT_SCHEMA)
