"""``python -m inkwell COMMAND ...``: linting of files and folders, and the commands of ``operators.commands``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from inkwell.operators import commands as C
from inkwell.operators import reports as R
from inkwell.operators.lint import lint
from inkwell.plans.config import Config, filter_rules, read_config
from inkwell.plans.rules import RuleError, load_rules


def _settings(args) -> tuple[Config, list]:
    text = Path(args.config).read_text(encoding="utf-8") if args.config else ""
    cfg = read_config(text, args.styles)
    rules = load_rules(args.styles) if args.styles else []
    if args.min_level:
        cfg.min_level = args.min_level
    cfg.ignore_syntax = args.ignore_syntax
    return cfg, filter_rules(rules, args.filter) if args.filter else rules


def _lint(args) -> int:
    from pyspark.sql import functions as F

    from inkwell.session import local_session
    from inkwell.sources.files import from_text, read_folder

    cfg, rules = _settings(args)
    spark = local_session("inkwell")
    spark.sparkContext.setLogLevel("ERROR")
    if args.paths == ["-"] or not args.paths:
        docs = from_text(spark, sys.stdin.read(), args.ext)
    else:
        docs = None
        for p in args.paths:
            x = read_folder(spark, p, args.glob)
            docs = x if docs is None else docs.unionByName(x)
    alerts = lint(docs, rules, cfg, path="path", ext="ext").cache()
    if args.output == "json":
        for r in R.by_file(alerts.withColumnsRenamed({"line": "line_no", "alert_seq": "alert_id"}), "path").toJSON().toLocalIterator():
            print(r)
    else:
        lines = R.line_report(alerts, F.col("path"), F.col("line"), F.col("col_begin"), F.col("check_name"), F.col("message"))
        for r in lines.orderBy("report_line").toLocalIterator():
            print(r["report_line"])
        if args.output == "cli":
            print(R.summary(alerts, docs.count()))
    status = 0 if args.no_exit else R.exit_status(alerts)
    spark.stop()
    return status


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkwell")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("lint", "ls-config", "transform", "test"):
        s = sub.add_parser(name)
        s.add_argument("paths", nargs="*")
        for flag in ("--config", "--styles", "--filter", "--min-level"):
            s.add_argument(flag)
        s.add_argument("--ext", default=".txt")
        s.add_argument("--glob", default="*")
        s.add_argument("--output", default="line", choices=["line", "json", "cli"])
        s.add_argument("--no-exit", action="store_true")
        s.add_argument("--ignore-syntax", action="store_true")
    for name, n in (("ls-metrics", 1), ("compile", 1), ("run", 2), ("fix", 1), ("tag", 1)):
        sub.add_parser(name).add_argument("paths", nargs=n)
    args = p.parse_args(argv)
    read = lambda i: Path(args.paths[i]).read_text(encoding="utf-8")
    try:
        if args.command == "lint":
            return _lint(args)
        if args.command == "ls-config":
            print(C.settings(_settings(args)[0]))
        elif args.command == "transform":
            print(C.transform(read(0), Path(args.paths[0]).suffix, args.paths[0], _settings(args)[0]))
        elif args.command == "test":
            cfg, rules = _settings(args)
            results = [r for path in args.paths for r in C.run_tests(path, rules, cfg)]
            for r in results:
                print(("ok   " if r.passed else "FAIL ") + r.name + (f": {r.reason}\n{r.diff}" if r.reason else ""))
            return 0 if all(r.passed for r in results) else 1
        elif args.command == "ls-metrics":
            print(json.dumps(C.metrics(read(0), Path(args.paths[0]).suffix), indent=2))
        elif args.command == "compile":
            print(json.dumps({"pattern": C.compiled_pattern(C.read_rule(args.paths[0]))}))
        elif args.command == "run":
            for a in C.run_rule(C.read_rule(args.paths[0], "Test.Rule"), read(1), Path(args.paths[1]).suffix):
                print(f"{args.paths[1]}:{a[0]}:{a[1]}:{a[3]}:{a[5]}")
        elif args.command == "fix":
            alert = json.loads(args.paths[0] if args.paths[0].lstrip().startswith("{") else read(0))
            print(json.dumps(C.fix(alert), ensure_ascii=False))
        elif args.command == "tag":
            print(json.dumps(C.tagged(read(0)), ensure_ascii=False))
    except (RuleError, ValueError, OSError) as e:
        print(e.as_json() if isinstance(e, RuleError) else e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
