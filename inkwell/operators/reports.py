"""Alerts after matching: dedup, limits, order, totals and the shapes they are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import solution
from inkwell.operators.native import closest
from inkwell.plans.rules import LEVELS
from inkwell.session import bounded


def distinct_alerts(alerts: DataFrame, key: str = "alert_id") -> DataFrame:
    """Repeated rows once."""
    return alerts.dropDuplicates([key])


def first_at_place(alerts: DataFrame, place: list[str], order: list[str]) -> DataFrame:
    """Of alerts of one check at one place the first by ``order``.

    ``min_by`` combines before the shuffle, so a hot place is one row for each task, and the full
    rows are never sorted.
    """
    rest = [c for c in alerts.columns if c not in place]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("x")
    return alerts.groupBy(*place).agg(first).select(*place, *[F.col(f"x.{c}").alias(c) for c in rest])


def limited(alerts: DataFrame, limits: DataFrame, group: list[str], order: list[str], limit: str = "alert_limit") -> DataFrame:
    """Alerts up to each check's limit in a file, in order; a limit of 0 or null is none.

    Checks without a limit pass by and are never sorted; for the others Spark keeps the first rows
    of each group while it shuffles (a window group limit).
    """
    x = alerts.join(limits.select("check_name", limit), "check_name", "left")
    free = x.where(F.coalesce(limit, F.lit(0)) <= 0)
    bound = x.where(F.coalesce(limit, F.lit(0)) > 0)
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return free.drop(limit).unionByName(bound.withColumn("_n", n).where(F.col("_n") <= F.col(limit)).drop("_n", limit))


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, i in LEVELS.items():
        out = F.when(severity == name, i).otherwise(out)
    return out


def at_least(alerts: DataFrame, level: str, column: str = "severity") -> DataFrame:
    """Alerts of a level or above; put on the rules before a join wherever that is possible."""
    return alerts.where(F.col(column).isin([n for n, i in LEVELS.items() if i >= LEVELS[level]]))


def totals(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def summary(alerts: DataFrame, files: int) -> str:
    """One line of totals, as under a table of alerts; three counts are all that reaches the driver."""
    n = {r["severity"]: r["n"] for r in totals(alerts).where(F.col("severity").isin(*LEVELS)).collect()}
    each = [f"{n.get(k, 0)} {k}{'' if n.get(k, 0) == 1 else 's'}" for k in ("error", "warning", "suggestion")]
    mark = "\u2716" if n.get("error") else "\u2714"
    return f"{mark} {each[0]}, {each[1]} and {each[2]} in {files} file{'' if files == 1 else 's'}."


def by_file(alerts: DataFrame, path: str) -> DataFrame:
    """A row for each file with its alerts as an array of structs in place order.

    A file's alerts become one value, as the JSON report wants them; use the line report for
    files of unbounded numbers of alerts.
    """
    row = F.struct("line_no", "col_begin", "check_name", "alert_id")
    return alerts.groupBy(path).agg(F.sort_array(F.collect_list(row)).alias("alerts"), F.count(F.lit(1)).alias("n"))


def line_report(alerts: DataFrame, path: Column, line: Column, col: Column, check: Column, note: Column) -> DataFrame:
    """``path:line:col:check:message``."""
    return alerts.select(F.concat_ws(":", path, line.cast("string"), col.cast("string"), check, note).alias("report_line"))


def ordered(alerts: DataFrame, *columns: str) -> DataFrame:
    return alerts.orderBy(*columns)


def exit_status(alerts: DataFrame, column: str = "severity") -> int:
    """1 if any alert is an error, else 0; stops at the first one found."""
    return 0 if alerts.where(F.col(column) == "error").isEmpty() else 1


def write_json(alerts: DataFrame, path: str, to: str) -> None:
    by_file(alerts, path).write.mode("overwrite").json(to)


def write_lines(lines: DataFrame, to: str) -> None:
    lines.write.mode("overwrite").text(to)


def write_table(alerts: DataFrame, to: str) -> None:
    alerts.write.mode("overwrite").parquet(to)


def _rendered(rows, template: str, path: str):
    """Lines of a report by a template ``head|row|foot`` over rows in path order."""
    head, row, foot = (template.split("|") + ["", ""])[:3]
    at = None
    for r in rows:
        if r[path] != at:
            if at is not None and foot:
                yield foot
            if head:
                yield head.format(path=r[path])
            at = r[path]
        yield row.format(line=r["line"], col=r["col_begin"], severity=r["severity"], check=r["check_name"], message=r["message"])
    if at is not None and foot:
        yield foot


def rendered(alerts: DataFrame, template: str, path: str) -> DataFrame:
    """``report_line``: a report by a template, each file's lines together and in order.

    ``template`` is ``head|row|foot`` with ``{path}`` and, for each alert, ``{line}:{col} {severity}
    {check} {message}`` placeholders. It is written by partition (``write_lines``); nothing passes the driver.
    """
    import pandas as pd

    cols = ["line", "col_begin", "severity", "check_name", "message"]

    def run(batches):
        rows = (r for pdf in batches for r in pdf.to_dict("records"))
        part: list[str] = []
        for line in _rendered(rows, template, path):
            part.append(line)
            if len(part) == 10_000:
                yield pd.DataFrame({"report_line": part})
                part = []
        yield pd.DataFrame({"report_line": part}, dtype="object")

    x = alerts.select(path, *cols).repartition(path).sortWithinPartitions(path, "line", "col_begin", "check_name")
    return x.mapInPandas(run, "report_line string")


def render(alerts: DataFrame, template: str, path: str, most: int = 100_000) -> str:
    """The same report as one string, for up to ``most`` alerts; more are an error."""
    rows = bounded(alerts.select(path, "line", "col_begin", "severity", "check_name", "message"), most, "the report")
    rows.sort(key=lambda r: (r[path], r["line"], r["col_begin"], r["check_name"]))
    return "\n".join(_rendered(rows, template, path))


def suggestions(alerts: DataFrame, fixed: Column) -> DataFrame:
    """Alerts with an action and what it makes of the match."""
    return alerts.where("action_name IS NOT NULL").withColumn("suggestion", fixed)


def solutions(alerts: DataFrame, dictionaries: list[DataFrame], key: str = "alert_id") -> DataFrame:
    """``key, action_name, suggestions, error`` for each alert with an action, by any of the fixers.

    ``suggest spellings`` is answered by ranking the distinct matches once and joining them on; the
    others are one Arrow stage.
    """
    a = alerts.where("action_name IS NOT NULL").select(key, "action_name", F.coalesce("match_text", F.lit("")).alias("match_text"), "action_params")
    a = distinct_alerts(a, key)
    spelled = F.coalesce((F.col("action_name") == "suggest") & (F.get("action_params", F.lit(0)) == "spellings"), F.lit(False))
    words = a.where(spelled)
    ranked = closest(words.select(F.col("match_text").alias("word")), dictionaries).groupBy(F.col("word").alias("match_text"))
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("place", "term")))["term"].alias("suggestions"))
    near = words.join(ranked, "match_text", "left").select(key, "action_name", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"), F.lit(None).cast("string").alias("error"))
    fix = F.udf(solution, "suggestions array<string>, error string", useArrow=True)
    rest = a.where(~spelled).select(key, "action_name", fix("match_text", "action_name", "action_params").alias("x")).select(key, "action_name", "x.suggestions", "x.error")
    return near.unionByName(rest)
