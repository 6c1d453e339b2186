"""The registered queries of the core engine, each over whole tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import text as X
from inkwell.functions.spell import Dictionary
from inkwell.operators import native as N
from inkwell.operators import reports as R
from inkwell.operators.lint import block_hits, lint
from inkwell.operators.matching import GRADES, SCRIPTS
from inkwell.plans.config import Config, filter_rules, glob_regex
from inkwell.plans.rules import Rule, parse_rule
from inkwell.session import bounded
from inkwell.sources.blocks import extract_blocks, tag_counts
from inkwell.sources.files import json_values

WEASEL = ["several", "some", "every", "all", "weak", "passive", "clear", "long", "empty", "hidden", "old"]
SWAP = {"overrides": "replaces", "hidden": "invisible", "the same message twice": "one message twice", "stale": "outdated", "foreign terms": "loan words"}
PAIRS = {"list": "table", "rule": "check"}
FIRST, SECOND = r"\b([A-Z]{2,6})\b", r"\(([A-Z]{2,6})\)"
SECTIONS = [("*", "Plainly"), ("*.{md,qmd,markdown}", "Lexa,Klar"), ("**/guide/**", "Readwell"), ("*.rst", "Tonic"), ("*-core/lib/*", "Termin")]
OR = "|".join
_WEASEL = r"(?i)\b(?:" + OR(N.longest_first(WEASEL)) + r")\b"
_SWAP = r"(?i)\b(?:" + OR(N.longest_first(list(SWAP))) + r")\b"

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        _Q[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _Q.items() if s}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _alerts(spark, d):
    return R.distinct_alerts(_read(spark, d, "alerts"))


def java(pattern: str) -> str:
    return pattern.replace(r"\b", N.EDGE)


A = "WITH a AS (SELECT DISTINCT ON (alert_id) * FROM alerts) "

# ---------------------------------------------------------------- rule kinds


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_WEASEL}')) AS n FROM documents WHERE regexp_matches(text, '{_WEASEL}')")
def existence_count(spark, d):
    return N.count_matches(_read(spark, d, "documents").select("doc_id", "text"), "text", WEASEL).select("doc_id", "n")


@query(f"SELECT doc_id, match_text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_WEASEL}')) AS match_text FROM documents) GROUP BY 1, 2")
def existence_matches(spark, d):
    return N.matches(_read(spark, d, "documents"), "doc_id", "text", WEASEL)


@query(f"""
WITH m AS (SELECT doc_id, regexp_split_to_array(text, '{_WEASEL}') AS ps, regexp_extract_all(text, '{_WEASEL}') AS ms FROM documents),
u AS (SELECT doc_id, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS match_text, unnest(range(len(ms))) AS i FROM m),
c AS (SELECT *, sum(length(p) + length(match_text)) OVER w AS e, 1 + sum(length(p) - length(replace(p, chr(10), ''))) OVER w AS line_no FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(e - length(match_text) AS BIGINT) AS begin_at, CAST(e AS BIGINT) AS end_at, CAST(line_no AS BIGINT) AS line_no, match_text FROM c""")
def existence_spans(spark, d):
    return N.spans(_read(spark, d, "documents"), "doc_id", "text", _WEASEL)


@query(f"SELECT doc_id, match_text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_WEASEL}')) AS match_text FROM documents) WHERE NOT regexp_matches(match_text, '(?i)every|clear') GROUP BY 1, 2")
def existence_exceptions(spark, d):
    return N.without_exceptions(N.matches(_read(spark, d, "documents"), "doc_id", "text", WEASEL), "match_text", ["clear", "every"])


@query(r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(replace(text, 'term list', '*********'), 'list of exceptions', '******************', 'g'), '(?i)\b(?:exceptions|list)\b')) AS n
FROM documents WHERE regexp_matches(regexp_replace(replace(text, 'term list', '*********'), 'list of exceptions', '******************', 'g'), '(?i)\b(?:exceptions|list)\b')""")
def phrase_mask(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", N.mask_phrases(F.col("text"), ["term list", "list of exceptions"]).alias("text"))
    return N.count_matches(docs, "text", ["exceptions", "list"]).select("doc_id", "n")


@query(
    f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SWAP}')) AS observed FROM documents), s AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in SWAP.items())
    + ") t(k, expected)) SELECT doc_id, observed, expected, count(*) AS n FROM m JOIN s ON lower(observed) = k WHERE observed <> expected GROUP BY ALL"
)
def substitution_suggest(spark, d):
    return N.substitutions(_read(spark, d, "documents"), "doc_id", "text", SWAP)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{12,}')) AS n FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]{12,}')) > 9")
def occurrence_max(spark, d):
    return N.occurrences(_read(spark, d, "documents"), "doc_id", "text", "[A-Za-z]{12,}", most=9)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[.!?]')) AS n FROM documents WHERE len(regexp_extract_all(text, '[.!?]')) < 2")
def occurrence_min(spark, d):
    return N.occurrences(_read(spark, d, "documents"), "doc_id", "text", "[.!?]", least=2)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ts FROM documents),
u AS (SELECT doc_id, lower(unnest(ts)) AS token, unnest(range(len(ts))) AS pos FROM t),
l AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM u) SELECT doc_id, CAST(pos AS INT) AS pos, token FROM l WHERE token = b""")
def repetition_adjacent(spark, d):
    return N.repetitions(_read(spark, d, "documents"), "doc_id", "text")


def _pair_sql(a, b):
    return f"""SELECT doc_id, block_seq, '{a}' AS first_form, '{b}' AS second_form FROM (SELECT *, bool_or(ha) OVER w AS sa, bool_or(hb) OVER w AS sb FROM
(SELECT doc_id, block_seq, regexp_matches(block, '(?i)\\b(?:{a})\\b') AS ha, regexp_matches(block, '(?i)\\b(?:{b})\\b') AS hb FROM l) WINDOW w AS (PARTITION BY doc_id ORDER BY block_seq)) WHERE (ha OR hb) AND sa AND sb"""


_LINES = "WITH l AS (SELECT doc_id, unnest(x) AS block, CAST(unnest(range(len(x))) AS INT) AS block_seq FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) "


@query(_LINES + " UNION ALL ".join(_pair_sql(a, b) for a, b in sorted(PAIRS.items())))
def consistency_pairs(spark, d):
    return N.inconsistencies(N.lines(_read(spark, d, "documents"), "doc_id", "text"), "doc_id", "block_seq", "block", PAIRS)


@query(_LINES.rstrip() + f""", u AS (SELECT DISTINCT doc_id, block_seq, unnest(regexp_extract_all(block, '{FIRST}', 1)) AS term FROM l),
g AS (SELECT doc_id, term, min(block_seq) AS since FROM (SELECT doc_id, block_seq, unnest(regexp_extract_all(block, '{SECOND}', 1)) AS term FROM l) GROUP BY 1, 2)
SELECT u.doc_id, u.block_seq, u.term FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.term = u.term WHERE since IS NULL OR since > block_seq""")
def conditional_defined(spark, d):
    blocks = N.lines(_read(spark, d, "documents"), "doc_id", "text")
    return N.undefined(blocks, "doc_id", "block_seq", "block", java(FIRST), SECOND)


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bpassive\b') AND NOT regexp_matches(text, '(?i)\breviewer\b')")
def conditional_presence(spark, d):
    return N.requires(_read(spark, d, "documents"), "doc_id", "text", java(r"(?i)\bpassive\b"), java(r"(?i)\breviewer\b"))


@query(A + r"""SELECT match_text, match_text = lower(match_text) AS is_lower, match_text = upper(match_text) AS is_upper, regexp_matches(match_text, '^[A-Z][a-z]*( [A-Z][a-z]*)*$') AS is_capped, count(*) AS n
FROM a WHERE match_text IS NOT NULL GROUP BY ALL""")
def capitalization_forms(spark, d):
    m = F.col("match_text")
    x = _alerts(spark, d).where("match_text IS NOT NULL").groupBy("match_text").agg(F.count(F.lit(1)).alias("n"))
    return x.select("match_text", (m == F.lower(m)).alias("is_lower"), (m == F.upper(m)).alias("is_upper"), m.rlike(r"^[A-Z][a-z]*( [A-Z][a-z]*)*\z").alias("is_capped"), "n")


_W, _L = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))", r"len(regexp_extract_all(text, '\p{L}'))"
_S = rf"CASE WHEN {_W} > 0 THEN greatest(len(regexp_extract_all(text, '[.!?。！？।؟]+')), 1) ELSE 0 END"
_G = r"len(regexp_extract_all(text, '\p{L}{7,}'))"


def _metrics(spark, d):
    t = F.col("text")
    return _read(spark, d, "documents").select("doc_id", X.word_count(t).alias("words"), X.sentence_count(t).alias("sentences"), X.letter_count(t).alias("letters"), X.long_word_count(t).alias("long_words"))


@query(f"SELECT doc_id, {_W} AS words, {_S} AS sentences, {_L} AS letters, {_G} AS long_words FROM documents")
def document_metrics(spark, d):
    return _metrics(spark, d)


@query(f"""WITH m AS (SELECT doc_id, CAST({_W} AS DOUBLE) AS w, CAST({_S} AS DOUBLE) AS s, CAST({_L} AS DOUBLE) AS l, CAST({_G} AS DOUBLE) AS g FROM documents)
SELECT doc_id, floor((4.71 * (l / w) + 0.5 * (w / s) - 21.43) * 10000 + 0.5) / 10000 AS ari, floor((0.0588 * (l / w) * 100 - 0.296 * (s / w) * 100 - 15.8) * 10000 + 0.5) / 10000 AS cli, floor((w / s + g * 100 / w) * 10000 + 0.5) / 10000 AS lix FROM m WHERE w > 0""")
def readability_grades(spark, d):
    w, s, n, g = (F.col(c).cast("double") for c in ("words", "sentences", "letters", "long_words"))
    x = _metrics(spark, d).where("words > 0")
    four = lambda v: F.floor(v * 10000 + 0.5) / 10000.0  # to four places; engines round ties apart
    return x.select("doc_id", four(4.71 * (n / w) + 0.5 * (w / s) - 21.43).alias("ari"), four(0.0588 * (n / w) * 100 - 0.296 * (s / w) * 100 - 15.8).alias("cli"), four(w / s + g * 100 / w).alias("lix"))


@query(f"""WITH m AS (SELECT doc_id, CAST({_W} AS DOUBLE) AS w, CAST({_S} AS DOUBLE) AS s FROM documents) SELECT doc_id, round(w / s, 6) AS value FROM m WHERE w > 0 AND round(w / s, 6) > 20""")
def metric_condition(spark, d):
    v = F.round(F.col("words").cast("double") / F.col("sentences"), 6)
    return _metrics(spark, d).where("words > 0").select("doc_id", v.alias("value")).where("value > 20")


def _dictionary(spark, d):
    words = _read(spark, d, "rules").select(F.explode("tokens").alias("x")).unionByName(_read(spark, d, "vocab_terms").select(F.col("term").alias("x"))).unionByName(_read(spark, d, "common_words").select(F.col("word").alias("x")))
    return words.select(F.explode(F.split(F.lower("x"), " ")).alias("word")).distinct()


_DICT = """d AS (SELECT DISTINCT unnest(string_split(lower(x), ' ')) AS word FROM (SELECT unnest(tokens) AS x FROM rules UNION ALL SELECT term FROM vocab_terms UNION ALL SELECT word FROM common_words))"""


@query(rf"""WITH {_DICT}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents)
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t WHERE word NOT IN (SELECT word FROM d) GROUP BY 1""")
def spelling_unknown(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return N.unknown_words(docs, "doc_id", "text", _dictionary(spark, d), r"\p{L}+")


@query(rf"""WITH {_DICT}, e AS (SELECT DISTINCT regexp_replace(word, '[^ -~]', '?', 'g') AS term FROM d), w AS (SELECT DISTINCT regexp_replace(lower(match_text), '[^ -~]', '?', 'g') AS word FROM alerts WHERE match_text IS NOT NULL),
p AS (SELECT w.word, term, levenshtein(w.word, term) AS edits FROM w JOIN e ON abs(length(w.word) - length(term)) <= 2 AND levenshtein(w.word, term) <= 2 AND w.word <> term)
SELECT word, term, CAST(edits AS INT) AS edits, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY edits, term) AS place FROM p) WHERE place <= 3""")
def spelling_suggest(spark, d):
    """Terms within two edits of any match, in the shape that all engines measure alike."""
    words = _read(spark, d, "alerts").where("match_text IS NOT NULL").select(X.ascii_shape(F.lower("match_text")).alias("word"))
    return N.nearest(words, _dictionary(spark, d).select(X.ascii_shape(F.col("word")).alias("term")))


@query()
def spelling_ranked(spark, d):
    """The whole dictionary ranked by similarity, with no bound on the edits."""
    words = _read(spark, d, "alerts").select(F.col("match_text").alias("word"))
    return N.closest(words, [_dictionary(spark, d).withColumnRenamed("word", "term")])


@query(A + """, u AS (SELECT DISTINCT check_name AS word FROM a WHERE check_name NOT IN (SELECT check_name FROM rules)),
p AS (SELECT word, check_name AS term, levenshtein(word, check_name) AS edits FROM u JOIN rules r ON abs(length(word) - length(check_name)) <= 2 AND levenshtein(word, check_name) <= 2)
SELECT word, term, CAST(edits AS INT) AS edits, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY edits, term) AS place FROM p) WHERE place <= 1""")
def unknown_checks_suggest(spark, d):
    rules = _read(spark, d, "rules").select(F.col("check_name").alias("term"))
    unknown = _read(spark, d, "alerts").where("check_name IS NOT NULL").select(F.col("check_name").alias("word")).distinct().join(rules, F.col("word") == F.col("term"), "left_anti")
    return N.nearest(unknown, rules, k=1)


# ---------------------------------------------------------------- scopes, sections, rules


@query("""WITH s AS (SELECT DISTINCT scope_path, string_split(scope_path, '.') AS ls FROM code_comments WHERE scope_path IS NOT NULL)
SELECT s.scope_path, check_name FROM s JOIN rules r ON CASE WHEN r.scope_path = '~heading & text' THEN NOT list_contains(ls, 'heading') AND list_contains(ls, 'text') ELSE list_has_all(ls, string_split(r.scope_path, '.')) END""")
def scope_join(spark, d):
    return N.scope_matches(_read(spark, d, "code_comments"), _read(spark, d, "rules"))


def _section_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(file_path, '^(?:{glob_regex(g).pattern})$') THEN '{s}'" for g, s in reversed(SECTIONS))
    return f"SELECT file_id, CASE {cases} ELSE 'Houseform' END AS styles FROM files"


@query(_section_sql())
def config_sections(spark, d):
    sections = [(f"^(?:{glob_regex(g).pattern})$", s) for g, s in SECTIONS]
    return _read(spark, d, "files").select("file_id", N.section_styles(_read(spark, d, "files"), "file_path", sections, "Houseform").alias("styles"))


@query("SELECT file_id, file_path FROM files WHERE regexp_matches(file_path, '^.*/lib/.*\\.(py|rb|go)$')")
def path_glob(spark, d):
    return _read(spark, d, "files").where(F.col("file_path").rlike("^" + glob_regex("*/lib/*.{py,rb,go}").pattern + "$")).select("file_id", "file_path")


@query("""SELECT r.check_name, count(*) AS n_files FROM (SELECT file_id, unnest(list_distinct(base_styles)) AS style_name FROM files) f JOIN rules r USING (style_name) WHERE r.severity IN ('warning', 'error') GROUP BY 1""")
def rules_enabled(spark, d):
    # the level is tested on the rules, before the join
    rules = R.at_least(_read(spark, d, "rules"), "warning").select("check_name", "style_name")
    styles = _read(spark, d, "files").select("file_id", F.explode(F.array_distinct("base_styles")).alias("style_name")).groupBy("style_name").agg(F.count(F.lit(1)).alias("n_files"))
    return rules.join(styles, "style_name").select("check_name", "n_files")


@query("SELECT check_name, extends, severity FROM rules WHERE extends IN ('existence', 'substitution') AND severity <> 'suggestion' AND (list_contains(tokens, 'scope') OR ignore_case)")
def rule_filter(spark, d):
    return _read(spark, d, "rules").where("extends IN ('existence', 'substitution') AND severity <> 'suggestion' AND (array_contains(tokens, 'scope') OR ignore_case)").select("check_name", "extends", "severity")


@query("SELECT t.term_id, t.term FROM vocab_terms t WHERE accepted AND term NOT IN (SELECT match_text FROM alerts WHERE match_text IS NOT NULL)")
def terms_unused(spark, d):
    seen = _read(spark, d, "alerts").select(F.col("match_text").alias("term")).where("term IS NOT NULL").distinct()
    return _read(spark, d, "vocab_terms").where("accepted").join(seen, "term", "left_anti").select("term_id", "term")


@query("SELECT word FROM (SELECT lower(unnest(tokens)) AS word FROM rules INTERSECT SELECT lower(match_text) FROM alerts) EXCEPT SELECT word FROM common_words")
def vocabulary_sets(spark, d):
    a = _read(spark, d, "rules").select(F.explode("tokens").alias("word")).select(F.lower("word").alias("word"))
    b = _read(spark, d, "alerts").where("match_text IS NOT NULL").select(F.lower("match_text").alias("word"))
    return a.intersect(b).subtract(_read(spark, d, "common_words").select("word"))


# ---------------------------------------------------------------- alerts


@query(A + ", b AS (SELECT *, row_number() OVER (PARTITION BY file_id, line_no, col_begin, check_name ORDER BY linted_at, alert_id) AS n FROM a) SELECT alert_id, file_id, line_no, col_begin, check_name FROM b WHERE n = 1")
def alert_dedup(spark, d):
    a = _alerts(spark, d).select("alert_id", "file_id", "line_no", "col_begin", "check_name", "linted_at")
    return R.first_at_place(a, ["file_id", "line_no", "col_begin", "check_name"], ["linted_at", "alert_id"]).drop("linted_at")


@query(A + """, b AS (SELECT a.alert_id, coalesce(alert_limit, 0) AS lim, row_number() OVER (PARTITION BY a.file_id, a.check_name ORDER BY a.linted_at, a.alert_id) AS n FROM a LEFT JOIN rules r ON r.check_name = a.check_name)
SELECT alert_id FROM b WHERE lim <= 0 OR n <= lim""")
def alert_limit(spark, d):
    a = _alerts(spark, d).select("alert_id", "file_id", "check_name", "linted_at")
    return R.limited(a, _read(spark, d, "rules"), ["file_id", "check_name"], ["linted_at", "alert_id"]).select("alert_id")


@query(A + "SELECT severity, count(*) AS n FROM a GROUP BY 1")
def alert_totals(spark, d):
    return R.totals(_alerts(spark, d))


@query(A + """, s AS (SELECT split_part(check_name, '.', 1) AS style_name, check_name, severity FROM a WHERE check_name IS NOT NULL AND severity IS NOT NULL)
SELECT style_name, check_name, severity, count(*) AS n FROM s GROUP BY ROLLUP (style_name, check_name, severity)""")
def alert_rollup(spark, d):
    a = _alerts(spark, d).where("check_name IS NOT NULL AND severity IS NOT NULL").withColumn("style_name", F.substring_index("check_name", ".", 1))
    return a.rollup("style_name", "check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(A + "SELECT file_id, count(*) AS n, CAST(max(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS INT) AS failed FROM a GROUP BY 1")
def file_status(spark, d):
    return _alerts(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("severity") == "error", 1).otherwise(0)).alias("failed"))


@query(A + ", f AS (SELECT file_id, bool_or(severity = 'error') AS bad FROM a GROUP BY 1) SELECT CASE WHEN coalesce(bad, false) THEN 'failed' ELSE 'passed' END AS outcome, count(*) AS n FROM files LEFT JOIN f USING (file_id) GROUP BY 1")
def outcome_totals(spark, d):
    bad = _read(spark, d, "alerts").where("severity = 'error'").select("file_id").distinct().withColumn("bad", F.lit(True))
    return _read(spark, d, "files").select("file_id").join(bad, "file_id", "left").groupBy(F.when(F.col("bad"), "failed").otherwise("passed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(A + "SELECT check_name, count(*) AS n FROM a WHERE check_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, check_name LIMIT 20")
def top_checks(spark, d):
    return _alerts(spark, d).where("check_name IS NOT NULL").groupBy("check_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "check_name").limit(20)


@query(A + "SELECT file_path || ':' || line_no || ':' || col_begin || ':' || check_name || ':' || message AS report_line FROM a JOIN files USING (file_id) WHERE line_no IS NOT NULL AND col_begin IS NOT NULL AND check_name IS NOT NULL AND message IS NOT NULL")
def report_lines(spark, d):
    a = _alerts(spark, d).where("line_no IS NOT NULL AND col_begin IS NOT NULL AND check_name IS NOT NULL AND message IS NOT NULL")
    x = a.join(_read(spark, d, "files").select("file_id", "file_path"), "file_id")
    return R.line_report(x, F.col("file_path"), F.col("line_no"), F.col("col_begin"), F.col("check_name"), F.col("message"))


@query(A + """SELECT file_id, count(*) AS n, string_agg(line_no || ':' || col_begin || ' ' || check_name || ' ' || alert_id, ';' ORDER BY line_no, col_begin, check_name, alert_id) AS alerts
FROM a WHERE line_no IS NOT NULL AND col_begin IS NOT NULL AND check_name IS NOT NULL GROUP BY 1""")
def report_by_file(spark, d):
    a = _alerts(spark, d).where("line_no IS NOT NULL AND col_begin IS NOT NULL AND check_name IS NOT NULL").select("file_id", "line_no", "col_begin", "check_name", "alert_id")
    one = lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["col_begin"].cast("string"), F.lit(" "), x["check_name"], F.lit(" "), x["alert_id"].cast("string"))
    return R.by_file(a, "file_id").select("file_id", "n", F.array_join(F.transform("alerts", one), ";").alias("alerts"))


@query(A + "SELECT alert_id, action_name, CASE action_name WHEN 'replace' THEN action_params[1] WHEN 'remove' THEN '' END AS suggestion FROM a WHERE action_name IN ('replace', 'remove', 'suggest')")
def alert_fixes(spark, d):
    a = _alerts(spark, d).where("action_name IN ('replace', 'remove', 'suggest')")
    return R.suggestions(a, X.fixed(F.col("match_text"), F.col("action_name"), F.col("action_params"))).select("alert_id", "action_name", "suggestion")


@query()
def alert_solutions(spark, d):
    """The whole of what ``alert_fixes`` asks for three actions: all actions, all suggestions of each, and what went wrong."""
    return R.solutions(_read(spark, d, "alerts"), [_dictionary(spark, d).withColumnRenamed("word", "term")])


@query(A + """, l AS (SELECT file_id, match_text, alert_id, row_number() OVER (PARTITION BY file_id, match_text ORDER BY linted_at, alert_id) AS k FROM a WHERE match_text IS NOT NULL),
r AS (SELECT file_id, match_text, alert_id AS other_id, row_number() OVER (PARTITION BY file_id, match_text ORDER BY line_no, col_begin, alert_id) AS k FROM a WHERE match_text IS NOT NULL)
SELECT alert_id, other_id FROM l JOIN r USING (file_id, match_text, k) WHERE alert_id <> other_id""")
def nth_equal_value(spark, d):
    a = _alerts(spark, d).where("match_text IS NOT NULL").select("file_id", "match_text", "alert_id", "linted_at", "line_no", "col_begin")
    w = Window.partitionBy("file_id", "match_text")
    x = a.withColumn("k", F.row_number().over(w.orderBy("linted_at", "alert_id"))).withColumn("j", F.row_number().over(w.orderBy(F.col("line_no").asc_nulls_last(), F.col("col_begin").asc_nulls_last(), "alert_id")))
    right = x.select("file_id", "match_text", F.col("j").alias("k"), F.col("alert_id").alias("other_id"))
    return x.select("file_id", "match_text", "k", "alert_id").join(right, ["file_id", "match_text", "k"]).where("alert_id <> other_id").select("alert_id", "other_id")


@query("""WITH c AS (SELECT DISTINCT ON (comment_id) comment_id, file_id, line_no, comment_source FROM code_comments),
e AS (SELECT *, CASE WHEN regexp_matches(comment_source, 'eslint-disable|noqa') THEN 'off' WHEN regexp_matches(comment_source, 'region') THEN 'on' END AS s FROM c)
SELECT comment_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no, comment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'on') AS state FROM e""")
def control_state(spark, d):
    c = _read(spark, d, "code_comments").select("comment_id", "file_id", "line_no", "comment_source").dropDuplicates(["comment_id"])
    s = F.when(F.col("comment_source").rlike("eslint-disable|noqa"), "off").when(F.col("comment_source").rlike("region"), "on")
    w = Window.partitionBy("file_id").orderBy(F.col("line_no").asc_nulls_last(), "comment_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("comment_id", F.coalesce(F.last(s, ignorenulls=True).over(w), F.lit("on")).alias("state"))


# ---------------------------------------------------------------- text functions and sources


@query("SELECT file_id, length(replace(replace(replace(file_content, '&rsquo;', ''''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS size, md5(replace(replace(replace(file_content, '&rsquo;', ''''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM files")
def sanitize_text(spark, d):
    t = X.sanitized(F.col("file_content"))
    return _read(spark, d, "files").select("file_id", F.length(t).alias("size"), F.md5(F.encode(t, "UTF-8")).alias("digest"))


@query("""WITH p AS (SELECT file_id, string_split(file_content, chr(10) || chr(10)) AS ps FROM files), u AS (SELECT file_id, len(ps) AS k, unnest(ps) AS p, unnest(range(len(ps))) AS seq FROM p)
SELECT file_id, CAST(seq AS INT) AS seq, length(p) + CASE WHEN seq < k - 1 THEN 2 ELSE 0 END AS size FROM u""")
def paragraph_split(spark, d):
    return _read(spark, d, "files").select("file_id", F.posexplode(X.paragraphs(F.col("file_content"))).alias("seq", "p")).select("file_id", "seq", F.length("p").alias("size"))


@query("""WITH l AS (SELECT file_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT file_id, string_split(file_content, chr(10)) AS x FROM files))
SELECT file_id, CAST(i + 1 AS INT) AS line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY i) - length(line) - 1 AS BIGINT) AS start_at FROM l""")
def line_starts(spark, d):
    return N.line_starts(_read(spark, d, "files"), "file_id", "file_content")


@query(r"""WITH m AS (SELECT DISTINCT match_text FROM alerts WHERE match_text IS NOT NULL)
SELECT match_text, CASE WHEN regexp_matches(match_text, '^[a-z]') THEN upper(substr(match_text, 1, 1)) || substr(match_text, 2) ELSE match_text END AS capped, regexp_matches(match_text, '^\p{L}*$') AS letters_only,
regexp_replace(match_text, '[^\n]', '*', 'g') AS masked, trim(match_text, ' ') AS trimmed, length(match_text) AS size FROM m""")
def scalar_functions(spark, d):
    m = F.col("match_text")
    return _read(spark, d, "alerts").where("match_text IS NOT NULL").select("match_text").distinct().select(
        "match_text", X.cap_first(m).alias("capped"), X.is_letters(m).alias("letters_only"), X.masked(m).alias("masked"), F.trim(m).alias("trimmed"), F.length(m).alias("size")
    )


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def json_view(spark, d):
    e = _read(spark, d, "events")
    v = json_values(e, "event_type", "props", {"k": "$.k"})
    return v.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("k_sum"))


@query(r"""WITH l AS (SELECT file_id, regexp_replace(unnest(x), '[^ -~]', '?', 'g') AS line, CAST(unnest(range(len(x))) + 1 AS INT) AS line_no FROM (SELECT file_id, string_split(file_content, chr(10)) AS x FROM files)),
s AS (SELECT *, levenshtein(line, 'level: warning') AS edits FROM l)
SELECT file_id, line_no, CAST(edits AS INT) AS edits FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY edits, line_no) AS n FROM s) WHERE n = 1""")
def closest_line(spark, d):
    x = _read(spark, d, "files").select("file_id", F.posexplode(F.split("file_content", "\n")).alias("i", "line"))
    best = F.min(F.struct(F.levenshtein(X.ascii_shape(F.col("line")), F.lit("level: warning")).alias("edits"), (F.col("i") + 1).alias("line_no")))
    return x.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.line_no", "b.edits")


# Extensions of pages, and of markup that isn't one.
PAGES = [".html", ".htm", ".xhtml", ".shtml"]
OTHER_MARKUP = [".md", ".markdown", ".mdown", ".mkd", ".qmd", ".rmd", ".mdx", ".myst", ".rst", ".rest", ".org", ".adoc", ".asciidoc", ".asc", ".wiki", ".mediawiki", ".tex", ".typ", ".xml", ".dita"]


def is_page(normed: str, real: str, text: str):
    """Whether markup is HTML: the first of the extensions that is known says so, else the start of the text."""
    known = lambda c: F.when(F.lower(c).isin(PAGES), True).when(F.lower(c).isin(OTHER_MARKUP), False)
    return F.coalesce(known(normed), known(real), F.col(text).rlike(r"(?i)^\uFEFF?\s*(?:<\?xml[^>]*>\s*)?(?:<!--(?s:.*?)-->\s*)*<(?:!doctype\s+html|html|head|body)\b"), F.lit(False))


def _page_sql() -> str:
    of = lambda xs: ", ".join(f"'{x}'" for x in xs)
    known = lambda c: f"CASE WHEN lower({c}) IN ({of(PAGES)}) THEN true WHEN lower({c}) IN ({of(OTHER_MARKUP)}) THEN false END"
    return f"coalesce({known('normed_ext')}, {known('real_ext')}, regexp_matches(file_content, '(?i)^\\x{{FEFF}}?\\s*(?:<\\?xml[^>]*>\\s*)?(?:<!--(?s:.*?)-->\\s*)*<(?:!doctype\\s+html|html|head|body)\\b'), false)"


@query(rf"""SELECT file_id, tag_name, count(*) AS n FROM (SELECT file_id, lower(unnest(regexp_extract_all(regexp_replace(file_content, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<([A-Za-z][A-Za-z0-9]*)[^<>]*>', 1))) AS tag_name
FROM files WHERE file_format = 'markup' AND {_page_sql()}) WHERE NOT starts_with(tag_name, 'table') GROUP BY 1, 2""")
def html_tag_counts(spark, d):
    t = F.regexp_replace("file_content", r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "")
    pages = _read(spark, d, "files").where(F.col("file_format") == "markup").where(is_page("normed_ext", "real_ext", "file_content"))
    x = pages.select("file_id", F.explode(F.regexp_extract_all(t, F.lit(r"<([A-Za-z][A-Za-z0-9]*)[^<>]*>"), 1)).alias("tag"))
    return x.groupBy("file_id", F.lower("tag").alias("tag_name")).agg(F.count(F.lit(1)).alias("n")).where("tag_name NOT LIKE 'table%'")


# ---------------------------------------------------------------- the rule kinds of the engine, over whole tables


def _hits(spark, d, *rules: Rule, by_line: bool = False, cfg: Config | None = None) -> DataFrame:
    return block_hits(_read(spark, d, "documents"), list(rules), cfg, by_line=by_line)


def _rule(kind: str, name: str = "Own.Rule", **spec) -> Rule:
    return parse_rule(name, {"extends": kind, "message": "'%s'"} | spec)


def _spans_sql(pattern: str, more: str = "") -> str:
    """Offsets of all matches in each document, as the engine gives them."""
    return f"""WITH m AS (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms FROM documents),
u AS (SELECT doc_id, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS match_text, unnest(range(len(ms))) AS i FROM m),
c AS (SELECT *, sum(length(p) + length(match_text)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
SELECT doc_id, CAST(e - length(match_text) AS BIGINT) AS begin_at, CAST(e AS BIGINT) AS end_at, match_text FROM c {more}"""


@query(_spans_sql(_WEASEL, "WHERE NOT regexp_matches(match_text, '(?i)every|clear')"))
def rule_existence(spark, d):
    return _hits(spark, d, _rule("existence", tokens=WEASEL, ignorecase=True, exceptions=["every", "clear"])).select("doc_id", "begin_at", "end_at", "match_text")


@query(
    _spans_sql(_SWAP).replace("SELECT doc_id, CAST(e - length(match_text)", "SELECT doc_id, expected, CAST(e - length(match_text)")
    + "JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SWAP.items()) + ") t(k, expected) ON lower(match_text) = k WHERE match_text <> expected"
)
def rule_substitution(spark, d):
    return _hits(spark, d, _rule("substitution", swap=SWAP, ignorecase=True, message="'%s' for '%s'")).select("doc_id", F.get("args", F.lit(0)).alias("expected"), "begin_at", "end_at", "match_text")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]{12,}')) AS VARCHAR) AS n, regexp_extract(text, '[A-Za-z]{12,}') AS match_text FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]{12,}')) > 9")
def rule_occurrence(spark, d):
    return _hits(spark, d, _rule("occurrence", token="[A-Za-z]{12,}", max=9)).select("doc_id", F.get("args", F.lit(0)).alias("n"), "match_text")


_GAP_ENDS = r"[.!?][\s]|\n\s*\n"


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ts, regexp_split_to_array(text, '[A-Za-z]+') AS ps FROM documents),
u AS (SELECT doc_id, unnest(ts) AS token, unnest(ps[1:len(ts)]) AS gap, unnest(range(len(ts))) AS i FROM t),
l AS (SELECT *, lag(token) OVER w AS b, sum(length(gap) + length(token)) OVER w AS e FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(e - length(token) - length(gap) - length(b) AS BIGINT) AS begin_at, CAST(e AS BIGINT) AS end_at, token FROM l
WHERE lower(token) = lower(b) AND NOT regexp_matches(gap || token[1], '{_GAP_ENDS}')""")
def rule_repetition(spark, d):
    return _hits(spark, d, _rule("repetition", tokens=["[A-Za-z]+"], ignorecase=True)).select("doc_id", "begin_at", "end_at", F.get("args", F.lit(0)).alias("token"))


@query(_LINES + " UNION ALL ".join(_pair_sql(a, b).replace(f"'{a}' AS first_form, '{b}' AS second_form", f"'Own.{a}' AS check_name") for a, b in sorted(PAIRS.items())))
def rule_consistency(spark, d):
    return _hits(spark, d, *[_rule("consistency", f"Own.{a}", either={a: b}, ignorecase=True) for a, b in PAIRS.items()], by_line=True).select("doc_id", "block_seq", "check_name")


@query(_LINES.rstrip() + f""", u AS (SELECT doc_id, block_seq, unnest(regexp_extract_all(block, '{FIRST}', 1)) AS term FROM l),
g AS (SELECT doc_id, term, min(block_seq) AS since FROM (SELECT doc_id, block_seq, unnest(regexp_extract_all(block, '{SECOND}', 1)) AS term FROM l) GROUP BY 1, 2)
SELECT u.doc_id, u.block_seq, u.term, count(*) AS n FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.term = u.term WHERE since IS NULL OR since > block_seq GROUP BY ALL""")
def rule_conditional(spark, d):
    hits = _hits(spark, d, _rule("conditional", first=FIRST, second=SECOND), by_line=True)
    return hits.groupBy("doc_id", "block_seq", F.col("match_text").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query(_LINES + r"""SELECT doc_id, block_seq, block AS match_text, 'Own.Lower' AS check_name FROM l WHERE block <> lower(block)
UNION ALL SELECT doc_id, block_seq, block, 'Own.Upper' FROM l WHERE block <> upper(block) UNION ALL SELECT doc_id, block_seq, block, 'Own.First' FROM l WHERE NOT regexp_matches(block, '^[A-Z0-9]')""")
def rule_capitalization(spark, d):
    rules = [_rule("capitalization", "Own.Lower", match="$lower"), _rule("capitalization", "Own.Upper", match="$upper"), _rule("capitalization", "Own.First", match="^[A-Z0-9]")]
    return _hits(spark, d, *rules, by_line=True).select("doc_id", "block_seq", "match_text", "check_name")


_MW, _ML = r"regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')", r"len(regexp_extract_all(text, '\p{L}'))"
_MS = r"greatest(1, len(regexp_extract_all(text, '[.!?]+(?:[\p{Z}\t-\r\x1c-\x1f\x85]|$)')))"


@query(f"""WITH m AS (SELECT doc_id, CAST(len({_MW}) AS DOUBLE) AS w, CAST({_MS} AS DOUBLE) AS s, CAST({_ML} AS DOUBLE) AS c FROM documents),
v AS (SELECT doc_id, 4.71 * (c / w) + 0.5 * (w / s) - 21.43 AS v FROM m WHERE w > 0) SELECT doc_id, floor(v * 10000 + 0.5) / 10000 AS value FROM v WHERE round(v, 6) > 8""")
def rule_metric(spark, d):
    hits = _hits(spark, d, _rule("metric", formula=GRADES["Automated Readability"], condition="> 8"))
    return hits.select("doc_id", (F.floor(F.get("args", F.lit(0)).cast("double") * 10000 + 0.5) / 10000.0).alias("value"))


@query(f"""WITH m AS (SELECT doc_id, {_MW} AS ws, CAST({_MS} AS DOUBLE) AS s, CAST({_ML} AS DOUBLE) AS c FROM documents),
n AS (SELECT doc_id, CAST(len(ws) AS DOUBLE) AS w, s, c, CAST(len(list_filter(ws, lambda x: length(x) > 6)) AS DOUBLE) AS g FROM m),
v AS (SELECT doc_id, (0.0588 * (c / w) * 100 - 0.296 * (s / w) * 100 - 15.8 + w / s + g * 100 / w) / 2 AS v FROM n WHERE w > 0) SELECT doc_id, floor(v * 10000 + 0.5) / 10000 AS value FROM v WHERE v > 20""")
def rule_readability(spark, d):
    hits = _hits(spark, d, _rule("readability", metrics=["Coleman-Liau", "LIX"], grade=20))
    return hits.select("doc_id", (F.floor(F.get("args", F.lit(0)).cast("double") * 10000 + 0.5) / 10000.0).alias("value"))


@query(rf"""WITH {_DICT}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''’][\p{{L}}\p{{Nl}}\p{{No}}]+)*|[\p{{L}}\p{{N}}_]+')) AS word FROM documents)
SELECT doc_id, word AS match_text, count(*) AS n FROM t WHERE NOT regexp_matches(word, '[A-Z][a-z]+[A-Z]+\w+|[A-Z]+$|[^a-zA-Z_'']') AND lower(word) NOT IN (SELECT word FROM d) GROUP BY 1, 2""")
def rule_spelling(spark, d):
    words = {r["word"] for r in bounded(_dictionary(spark, d), 2_000_000, "the dictionary")}
    hits = _hits(spark, d, _rule("spelling", dictionary=Dictionary(words)))
    return hits.groupBy("doc_id", "match_text").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ts FROM documents), u AS (SELECT doc_id, unnest(ts) AS w, unnest(range(len(ts))) AS i FROM t),
l AS (SELECT doc_id, w, lead(w) OVER x AS a, lead(w, 2) OVER x AS b FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS n FROM l WHERE lower(w) = 'the' AND lower(a) <> 'the' AND lower(b) = 'rule' GROUP BY 1""")
def rule_sequence(spark, d):
    """Patterns alone: a word, any other word, and a word, over the letters of each text."""
    letters = F.regexp_replace("text", "[^A-Za-z]+", " ")
    docs = _read(spark, d, "documents").select("doc_id", letters.alias("text"))
    rule = _rule("sequence", tokens=[{"pattern": "the"}, {"pattern": "the", "negate": True}, {"pattern": "rule"}], ignorecase=True)
    return block_hits(docs, [rule]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _long_words(text: str) -> list[dict]:
    import re

    return [{"begin": m.start(), "end": m.end()} for m in re.finditer("[A-Za-z]{14,}", text)]


SCRIPTS["long_words"] = _long_words


@query(_spans_sql("[A-Za-z]{14,}"))
def rule_script(spark, d):
    return _hits(spark, d, _rule("script", script=_long_words)).select("doc_id", "begin_at", "end_at", "match_text")


def table_rules(spark, d, kind: str | None = None) -> list[Rule]:
    """The rules of the table compiled: existence and occurrence from their tokens, substitution by a common mark, the others by name and scope."""
    out = []
    for r in bounded(_read(spark, d, "rules"), 1_000_000, "the rules"):
        if kind is None or r["extends"] == kind:
            tokens = list(r["tokens"] or [])
            own = {"existence": {"tokens": tokens}, "occurrence": {"token": r"(?:" + OR(N.longest_first(tokens)) + r")", "max": 3}, "spelling": {"custom": True}}.get(r["extends"], {})
            if r["extends"] in ("existence", "occurrence"):
                own["ignorecase"] = bool(r["ignore_case"])
            own |= {"substitution": {"swap": {t: "…" for t in tokens}, "ignorecase": bool(r["ignore_case"])}, "repetition": {"tokens": tokens}, "consistency": {"either": dict(zip(tokens[::2], tokens[1::2]))}}.get(r["extends"], {})
            own |= {"conditional": {"first": OR(tokens), "second": OR(tokens)}, "capitalization": {"match": "$sentence"}, "metric": {"formula": "words", "condition": "> 0"}, "readability": {"grade": 0}, "sequence": {"tokens": [{"pattern": OR(tokens)}]}, "script": {"script": "long_words"}}.get(r["extends"], {})
            spec = {"extends": r["extends"], "message": r["message"], "level": r["severity"], "scope": r["scope_path"], "limit": r["alert_limit"], "link": r["link_url"] or "", "description": r["description"] or ""}
            out.append(parse_rule(r["check_name"], spec | own))
    return out


def _table_sql(more: str) -> str:
    return rf"""WITH r AS (SELECT check_name, alert_limit, (CASE WHEN ignore_case THEN '(?i)' ELSE '' END) || '\b(?:' || (SELECT string_agg(t, '|' ORDER BY length(t) DESC, t) FROM unnest(tokens) x(t)) || ')\b' AS rx FROM rules WHERE extends = 'existence'),
m AS (SELECT doc_id, check_name, alert_limit, len(regexp_extract_all(text, rx)) AS n FROM documents, r WHERE regexp_matches(text, rx)) {more}"""


@query(_table_sql("SELECT doc_id, check_name, n FROM m"))
def table_existence(spark, d):
    """All existence rules of the table over whole texts."""
    hits = block_hits(_read(spark, d, "documents"), table_rules(spark, d, "existence"))
    return hits.groupBy("doc_id", "check_name").agg(F.count(F.lit(1)).alias("n"))


@query(_table_sql("SELECT doc_id, check_name, CASE WHEN alert_limit > 0 THEN least(n, alert_limit) ELSE n END AS n FROM m"))
def table_lint(spark, d):
    """The same rules through the whole of linting, on raw text: places, dedup and limits."""
    import dataclasses

    rules = [dataclasses.replace(r, scope=("raw",)) for r in table_rules(spark, d, "existence")]
    return lint(_read(spark, d, "documents"), rules).groupBy("doc_id", "check_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT check_name, extends, severity FROM rules WHERE (extends IN ('existence', 'substitution') AND severity <> 'suggestion') OR scope_path = 'heading' AND extends NOT IN ('metric', 'readability')")
def rules_filtered(spark, d):
    """A filter expression over the compiled rules."""
    rules = filter_rules(table_rules(spark, d), '(.Extends in ["existence", "substitution"] and .Level != "suggestion") or "heading" in .Scope')
    return spark.createDataFrame([(r.name, r.kind, r.level) for r in rules], "check_name string, extends string, severity string")


@query("""WITH t AS (SELECT file_id, replace(replace(replace(file_content, '&rsquo;', ''''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM files WHERE file_format = 'text'),
p AS (SELECT file_id, string_split(t, chr(10) || chr(10)) AS ps FROM t WHERE length(t) > 0),
u AS (SELECT file_id, unnest(ps) AS p, unnest(range(len(ps))) AS seq, len(ps) AS k FROM p), b AS (SELECT file_id, seq, p || CASE WHEN seq < k - 1 THEN chr(10) || chr(10) ELSE '' END AS block FROM u)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS nth, length(block) AS size FROM b WHERE length(block) > 0""")
def text_paragraphs(spark, d):
    """Paragraph blocks of plain text, by the reader, in the order of their places."""
    files = _read(spark, d, "files").where("file_format = 'text'")
    b = extract_blocks(files, nested=True, key="file_id", text="file_content", ext="'.txt'").where(F.col("scope").startswith("paragraph."))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("offset"))
    return b.select(F.col("doc_id").alias("file_id"), nth.alias("nth"), F.length("text").alias("size"))


# ---------------------------------------------------------------- the engine itself (no SQL: checked by tests)


def flagship_rules() -> list[Rule]:
    r = lambda name, **k: parse_rule(name, k)
    return [
        r("Plain.Weasel", extends="existence", message="'%s' is a weasel word", tokens=WEASEL, ignorecase=True), r("Plain.Swaps", extends="substitution", message="Use '%s' instead of '%s'", swap=SWAP, ignorecase=True, level="error"),
        r("Plain.Repeats", extends="repetition", message="'%s' is repeated", tokens=[r"[^\s.!?]+"], ignorecase=True, alpha=True), r("Plain.Length", extends="occurrence", message="A sentence of %s words", token=r"\b\w+\b", max=25, scope="sentence", level="suggestion"),
        r("Plain.Pairs", extends="consistency", message="Inconsistent use of '%s'", either=PAIRS, ignorecase=True), r("Plain.Acronyms", extends="conditional", message="'%s' has no definition", first=FIRST, second=SECOND),
        r("Plain.Headings", extends="capitalization", message="'%s' should be in sentence case", match="$sentence", scope="heading"), r("Plain.Grade", extends="metric", message="A grade of %s", formula=GRADES["Automated Readability"], condition="> 10"),
        r("Plain.Fog", extends="readability", message="A fog of %s", metrics=["Gunning Fog"], grade=12), r("Plain.Modal", extends="sequence", message="'%[1]s %[2]s'", tokens=[{"tag": "MD"}, {"tag": "RB", "skip": 1}, {"tag": "VB"}]),
    ]


def flagship(spark, d):
    return lint(_read(spark, d, "documents"), flagship_rules())


@query()
def lint_documents(spark, d):
    return lint(_read(spark, d, "documents"), flagship_rules())


@query()
def lint_files(spark, d):
    files = _read(spark, d, "files").withColumn("ext", F.lower(F.coalesce("normed_ext", "real_ext", F.lit(".txt"))))
    return lint(files, flagship_rules(), Config(styles=["Plain"]), key="file_id", text="file_content", path="file_path", ext="ext")


@query()
def file_blocks(spark, d):
    files = _read(spark, d, "files").withColumn("ext", F.lower(F.coalesce("normed_ext", "real_ext", F.lit(".txt"))))
    return extract_blocks(files, key="file_id", text="file_content", ext="ext").select("doc_id", "block_seq", "scope", "text", "line", "offset")


@query()
def page_tags(spark, d):
    """Pages are told by ``normed_ext``, else ``real_ext``, else by how the text begins."""
    f = F.udf(tag_counts, T.MapType(T.StringType(), T.IntegerType()), useArrow=True)
    return _read(spark, d, "files").where(F.col("file_format") == "markup").where(is_page("normed_ext", "real_ext", "file_content")).select("file_id", F.explode(f("file_content")).alias("tag_name", "n"))
