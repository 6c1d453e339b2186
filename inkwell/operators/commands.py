"""What the command line offers, as functions: metrics, compiled rules, rule tests, fixes, settings.

They work on single texts and files, in Python alone. ``document_metrics`` is the DataFrame form.
"""

from __future__ import annotations

import dataclasses
import difflib
import json
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.spell import Dictionary, suggestions
from inkwell.functions.tagger import tag
from inkwell.functions.text import metrics_of, solution
from inkwell.operators.lint import lint_document
from inkwell.operators.matching import Program
from inkwell.plans.config import Config
from inkwell.plans.rules import Rule, RuleError, longest_first, parse_rule, words_pattern
from inkwell.session import spread
from inkwell.sources.blocks import Source, block_counts, document_blocks


def metrics(text: str | None, ext: str = ".md", cfg: Config | None = None) -> dict[str, float]:
    """The metrics of a document: figures of its summary text and how many blocks of each kind it has; none where it has no summary."""
    blocks = document_blocks(Source(text or "").text, ext, cfg or Config(), False)
    summary = next((b for b in blocks if b.scope.startswith("summary")), None)
    return metrics_of(summary.text) | {k: float(v) for k, v in block_counts(blocks).items()} if summary else {}


def document_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text", ext: str = "'.md'", cfg: Config | None = None) -> DataFrame:
    """``doc_id, metrics``: a map of each document's metrics; null texts have an empty one, null keys no row."""
    cfg = cfg or Config()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["k"], "metrics": [metrics(t, e, cfg) for t, e in zip(pdf["t"], pdf["e"])]})

    cols = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.expr(ext).alias("e")).where("k IS NOT NULL")
    return spread(cols, "k").mapInPandas(run, "doc_id long, metrics map<string,double>")


def read_rule(path: str, name: str | None = None) -> Rule:
    """A rule from its file, by default under the name of its folder and file."""
    import yaml

    p = Path(path)
    try:
        return parse_rule(name or f"{p.parent.name}.{p.stem}", yaml.safe_load(p.read_text(encoding="utf-8")) or {})
    except yaml.YAMLError as e:
        raise RuleError(f"{p.stem}: not readable as YAML: {str(e)[:200]}", str(p)) from e


def compiled_pattern(rule: Rule) -> str:
    """The expression a rule looks for; empty for kinds that have none."""
    p = rule.params
    if rule.kind == "existence":
        tokens = longest_first(list(p.get("tokens") or ()))
        return words_pattern(tokens, bool(p.get("nonword")) or not tokens, bool(p.get("ignorecase")), "".join(p.get("raw") or ()), bool(p.get("append")))
    if rule.kind == "substitution":
        return words_pattern([f"({k})" for k in longest_first([str(k) for k in p.get("swap") or {}])], bool(p.get("nonword")), bool(p.get("ignorecase", True)))
    if rule.kind == "occurrence":
        return ("(?i)" if p.get("ignorecase") else "") + f"(?:{p['token']})"
    if rule.kind == "repetition":
        return ("(?i)" if p.get("ignorecase") else "") + "(" + "|".join(longest_first(list(p.get("tokens") or [r"[^\s]+"]))) + ")"
    return {"capitalization": p.get("match", ""), "conditional": p.get("first", "")}.get(rule.kind, "")


def run_rule(rule: Rule, text: str, ext: str = ".txt") -> list[tuple]:
    """The alerts of one rule alone, whatever its level."""
    return lint_document(text, ext, f"stdin{ext}", Program([rule], Config(styles=[rule.style])))


def fix(alert: dict, dictionaries: list[Dictionary] = ()) -> dict:
    """``{"suggestions": [...], "error": ...}`` for an alert as the JSON report has it."""
    action = alert.get("Action") or {}
    name, params, match = action.get("Name"), action.get("Params") or [], alert.get("Match") or ""
    if name == "suggest" and params[:1] == ["spellings"]:
        return {"suggestions": suggestions(match, list(dictionaries)), "error": ""}
    got, error = solution(match, name, params)
    return {"suggestions": got, "error": error or ""}


def tagged(text: str) -> list[list[tuple[str, str, int]]]:
    """The words of each line with their tags and places."""
    return [tag(line) for line in Source(text).text.split("\n")]


def transform(text: str, ext: str, path: str, cfg: Config) -> str:
    """The text as the readers see it: line ends set right and ignored parts starred out."""
    section = cfg.section_of(path)
    raw = document_blocks(Source(text).text, ext, cfg, False, (section.block_ignores, section.token_ignores), shown=True)
    return raw[0].text if raw else ""


def settings(cfg: Config) -> str:
    """A configuration as JSON."""
    return json.dumps(dataclasses.asdict(cfg), indent=2, ensure_ascii=False, default=list)


# ---------------------------------------------------------------- rule tests


@dataclass
class TestResult:
    __test__ = False
    name: str
    passed: bool
    reason: str = ""
    diff: str = ""


def run_case(case: dict, rules: dict[str, Rule] | None, at: Path, cfg: Config | None = None) -> TestResult:
    """One case: ``input`` linted as ``format``, compared with ``want``, ``contains`` and ``absent``.

    A case names its ``rule`` by a path beside the test, or is linted by all ``rules``.
    """
    name = str(case.get("name") or "")
    if not any(k in case for k in ("want", "contains", "absent")):
        return TestResult(name, False, "a case needs 'want', 'contains' or 'absent'")
    try:
        run = [read_rule(str(at.parent / case["rule"]))] if case.get("rule") else list((rules or {}).values())
        own = cfg if cfg and not case.get("rule") else Config(styles=sorted({r.style for r in run}))
        ext = "." + str(case.get("format") or "md").lstrip(".")
        alerts = lint_document(case.get("input") or "", ext, f"stdin{ext}", Program(run, own))
    except (RuleError, OSError) as e:
        return TestResult(name, False, str(e))
    got = "\n".join(f"{a[0]}:{a[1]}:{a[3]}:{a[5]}" for a in sorted(alerts, key=lambda a: (a[0], a[1], a[3])))
    if case.get("want") is not None and got.strip() != str(case["want"]).strip():
        diff = "\n".join(difflib.unified_diff(str(case["want"]).strip().split("\n"), got.split("\n"), "want", "got", lineterm=""))
        return TestResult(name, False, "output does not match", diff)
    if case.get("contains") and str(case["contains"]) not in got:
        return TestResult(name, False, f"output does not contain {case['contains']!r}")
    for x in case.get("absent") or []:
        if str(x) in got:
            return TestResult(name, False, f"output contains {x!r}")
    return TestResult(name, True)


def run_tests(path: str, rules: list[Rule] = (), cfg: Config | None = None) -> list[TestResult]:
    """The results of a test file, or of all ``*.test.yml`` below a folder, in order."""
    import yaml

    p = Path(path)
    files = [p] if p.is_file() else sorted([*p.rglob("*.test.yml"), *p.rglob("*.test.yaml")])
    by_name = {r.name: r for r in rules}
    return [run_case(c, by_name, f, cfg) for f in files for c in (yaml.safe_load(f.read_text(encoding="utf-8")) or [])]
