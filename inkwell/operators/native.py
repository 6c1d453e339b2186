"""Rule kinds and joins as plain Spark plans: no Python in them, for counting and filtering at scale.

Each has the semantics of its counterpart in ``matching`` where no span is asked for.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import EDGE, titled
from inkwell.plans.rules import longest_first, scope_parts
from inkwell.session import bounded, spread


def word_regex(words: list[str], ignorecase: bool = True) -> str:
    """An alternation of words or expressions between ASCII boundaries, the longest first, for Java.

    Where all are plain words, a look at the character before and at the first letter comes first,
    so that the alternatives are tried at few places only.
    """
    flag = "(?i:" if ignorecase else "(?:"
    body = flag + "|".join(longest_first(words)) + ")"
    if all(re.fullmatch(r"[A-Za-z0-9](?:[\w '-]*\w)?", w, re.ASCII) for w in words) and words:
        first = "".join(sorted({c for w in words for c in ((w[0].lower(), w[0].upper()) if ignorecase else w[0])}))
        return f"(?<![0-9A-Za-z_])(?=[{first}]){body}(?![0-9A-Za-z_])"
    return EDGE + body + EDGE


def count_matches(docs: DataFrame, text: str, words: list[str], name: str = "n") -> DataFrame:
    """``docs`` with the number of matches; rows without any are left out."""
    return docs.withColumn(name, F.regexp_count(text, F.lit(word_regex(words)))).where(F.col(name) > 0)


def matches(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``key, match_text, n``: each match as written, with its number in the document."""
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(word_regex(words)), 0)).alias("match_text"))
    return found.groupBy(key, "match_text").agg(F.count(F.lit(1)).alias("n"))


def spans(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, begin_at, end_at, line_no, match_text``: every match with its offsets from 0.

    The built-ins give no offsets, so this is an Arrow batch stage; only key and text enter it.
    """
    rx = re.compile(pattern, re.ASCII)

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                line, at = 1, 0
                for m in rx.finditer(t):
                    line += t.count("\n", at, m.start())
                    at = m.start()
                    rows.append((k, m.start(), m.end(), line, m.group()))
            yield pd.DataFrame(rows, columns=["k", "begin_at", "end_at", "line_no", "match_text"]).astype({"k": "int64", "begin_at": "int64", "end_at": "int64", "line_no": "int64"})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    return spread(rows, "k").mapInPandas(run, "k long, begin_at long, end_at long, line_no long, match_text string").withColumnRenamed("k", key)


def without_exceptions(found: DataFrame, match: str, exceptions: list[str]) -> DataFrame:
    """Matches in which no exception is found; an exception is searched for, not matched whole."""
    return found.where(~F.col(match).rlike("(?i)" + "|".join(longest_first(exceptions)))) if exceptions else found


def mask_phrases(c: Column, phrases: list[str]) -> Column:
    """The text with accepted phrases starred out, so that no match lies in one.

    Lengths are kept: a plain phrase by a mask of its own length, an expression, whose matches may
    differ in length, in an Arrow stage.
    """
    for p in longest_first(phrases):
        if re.fullmatch(r"[\w '-]+", p):
            c = F.regexp_replace(c, F.lit(p), F.lit("*" * len(p)))
        else:
            rx = re.compile(p, re.ASCII)
            c = F.udf(lambda t, rx=rx: None if t is None else rx.sub(lambda m: "*" * len(m.group()), t), "string", useArrow=True)(c)
    return c


def substitutions(docs: DataFrame, key: str, text: str, swap: dict[str, str]) -> DataFrame:
    """``key, observed, expected, n`` for literal swaps; what is already as expected is left out."""
    found = matches(docs, key, text, list(swap)).withColumnRenamed("match_text", "observed")
    table = F.create_map(*[x for k, v in swap.items() for x in (F.lit(k.lower()), F.lit(v))])
    return found.withColumn("expected", F.element_at(table, F.lower("observed"))).where("observed <> expected").select(key, "observed", "expected", "n")


def occurrences(docs: DataFrame, key: str, text: str, pattern: str, most: int = 0, least: int = 0) -> DataFrame:
    """``key, n`` where the pattern occurs more than ``most`` (if positive) or fewer than ``least`` times."""
    n = F.regexp_count(text, F.lit(pattern))
    bad = (n > most) if most > 0 else F.lit(False)
    return docs.select(key, n.alias("n"), (bad | (n < least) if least > 0 else bad).alias("bad")).where("bad").select(key, "n")


def tokens(docs: DataFrame, key: str, text: str, pattern: str = "[A-Za-z]+") -> DataFrame:
    """``key, pos, token``: the tokens of each document in order, from 0."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("pos", "token"))


def repetitions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, token`` where a token equals the one before it, case aside.

    The pairs are found inside the array of a document's tokens, so there is no window and no shuffle.
    """
    toks = docs.select(key, F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0), lambda t: F.lower(t)).alias("t"))
    n = F.size("t")
    pairs = F.when(n > 1, F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get("t", i) == F.get("t", i - 1)))
    return toks.select(key, "t", F.explode(pairs).alias("pos")).select(key, "pos", F.get("t", F.col("pos")).alias("token"))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, block_seq, block``: the lines of each document as blocks."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("block_seq", "block"))


def line_starts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, start_at``: lines from 1 with their offsets from 0, in one pass over each text.

    An Arrow stage: the built-ins have no running sum inside an array that is linear.
    """
    f = F.udf(_starts, "array<bigint>", useArrow=True)
    return docs.select(key, F.posexplode(f(text)).alias("i", "start_at")).select(key, (F.col("i") + 1).alias("line_no"), "start_at")


def _starts(text: str | None) -> list[int] | None:
    return None if text is None else [0, *(m.end() for m in re.finditer("\n", text))]


def inconsistencies(blocks: DataFrame, key: str, seq: str, text: str, either: dict[str, str]) -> DataFrame:
    """``key, seq, first_form, second_form``: blocks with a form of a pair of which both were seen so far in the document."""
    out = None
    so_far = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for a, b in sorted(either.items()):
        both = word_regex([a, b])
        # only blocks with a form matter, which keeps what the window sorts small
        x = blocks.where(F.col(text).rlike(both)).select(key, seq, F.col(text).rlike(word_regex([a])).alias("has_a"), F.col(text).rlike(word_regex([b])).alias("has_b"))
        x = x.withColumn("seen_a", F.max("has_a").over(so_far)).withColumn("seen_b", F.max("has_b").over(so_far))
        x = x.where("seen_a AND seen_b").select(key, seq, F.lit(a).alias("first_form"), F.lit(b).alias("second_form"))
        out = x if out is None else out.unionByName(x)
    return out


def undefined(blocks: DataFrame, key: str, seq: str, text: str, first: str, second: str) -> DataFrame:
    """``key, seq, term``: terms of ``first`` that no ``second`` has defined in this or an earlier block.

    An as-of anti-join: the first definition of each term in each document is joined on.
    """
    used = blocks.where(F.col(text).rlike(first)).select(key, seq, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(first), 1))).alias("term"))
    given = blocks.where(F.col(text).rlike(second)).select(key, F.col(seq).alias("since"), F.explode(F.regexp_extract_all(text, F.lit(second), 1)).alias("term"))
    given = given.groupBy(key, "term").agg(F.min("since").alias("since"))
    return used.join(given, [key, "term"], "left").where(F.col("since").isNull() | (F.col("since") > F.col(seq))).select(key, seq, "term")


def requires(docs: DataFrame, key: str, text: str, first: str, second: str) -> DataFrame:
    """``key``: blocks that hold ``first`` and lack ``second``."""
    return docs.where(F.col(text).rlike(first) & ~F.col(text).rlike(second)).select(key)


def unknown_words(docs: DataFrame, key: str, text: str, dictionary: DataFrame, pattern: str) -> DataFrame:
    """``word, n, n_docs``: words not in ``dictionary(word)``.

    Words are counted per document and in all before the anti-join, so that hot words are one row.
    """
    w = tokens(docs, key, text, pattern).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    w = w.groupBy(F.col("token").alias("word")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    return w.join(dictionary.select("word").distinct(), "word", "left_anti")


SHORT = 16  # up to this length words meet on what is left of them after deletions, beyond it on thirds


def _without(c: Column) -> Column:
    """A string with each of its characters left out in turn."""
    n = F.length(c)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def _deletions(c: Column, most: int) -> Column:
    """A string and what is left of it after up to ``most`` deletions; strings within so many edits share one."""
    out, last = F.array(c), F.array(c)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda x: _without(x))))
        out = F.concat(out, last)
    return F.array_distinct(out)


def _segment(i: int, n: Column, parts: int) -> tuple[Column, Column]:
    """Where segment ``i`` of a string of length ``n`` begins (from 1), and its length."""
    at = F.floor(n * i / parts).cast("int")
    return at + 1, F.floor(n * (i + 1) / parts).cast("int") - at


def _keys(c: Column, most: int, term: bool) -> Column:
    """What a word and a term within ``most`` edits of each other share at least one of.

    Short strings: what deletions leave. Long ones: of ``most + 1`` segments of the term one is in
    the word unchanged, moved by no more than the edits. Near the bound a term has keys of both kinds.
    """
    n = F.length(c)
    short = F.transform(_deletions(c, most), lambda x: F.concat(F.lit("d"), x))
    parts, none = most + 1, F.array().cast("array<string>")
    found = []
    for i in range(parts):
        if term:
            at, size = _segment(i, n, parts)
            found.append(F.array(F.concat(F.lit(f"s{i}."), n.cast("string"), F.lit("."), F.substring(c, at, size))))
            continue
        for change in range(-most, most + 1):  # the lengths that the term may have
            at, size = _segment(i, n + change, parts)
            for move in range(-most, most + 1):
                piece = F.concat(F.lit(f"s{i}."), (n + change).cast("string"), F.lit("."), F.substring(c, at + move, size))
                found.append(F.when(at + move >= 1, F.array(piece)).otherwise(none))
    long = F.array_distinct(F.concat(*found))
    if not term:
        return F.when(n <= SHORT, short).otherwise(long)
    return F.concat(F.when(n <= SHORT + most, short).otherwise(none), F.when(n > SHORT - most, long).otherwise(none))


def nearest(words: DataFrame, terms: DataFrame, most: int = 2, k: int = 3) -> DataFrame:
    """``word, term, edits, place``: the ``k`` terms within ``most`` edits of each word, ties by text.

    Words and terms meet on keys that two strings so near must share, see ``_keys``; each pair is
    then measured once.
    """
    t = terms.select("term").where("term IS NOT NULL").distinct().select("term", F.explode(_keys(F.col("term"), most, True)).alias("key"))
    w = words.select("word").where("word IS NOT NULL").distinct().select("word", F.explode(_keys(F.col("word"), most, False)).alias("key"))
    near = w.join(t, "key").select("word", "term").distinct().withColumn("edits", F.levenshtein("word", "term", most)).where("edits >= 0 AND word <> term")
    place = F.row_number().over(Window.partitionBy("word").orderBy("edits", "term"))
    return near.withColumn("place", place).where(F.col("place") <= k).select("word", "term", "edits", "place")


def closest(words: DataFrame, dictionaries: list[DataFrame], each: int = 5, k: int = 6, block: int = 4096, most: int = 2_000_000) -> DataFrame:
    """``word, term, similarity, place``: the ``each`` terms of each dictionary most like a word, of these the ``k`` most like it.

    Whole dictionaries are ranked, without a bound on the edits: similarity is 1 - edits over the
    longer length, by code points, ties by text. A word with capitals as in a title gets its terms so.
    Terms lie in blocks of ``block``; each word meets each block once and keeps ``each`` of it, so
    no more than that is ever sorted.
    """
    spark, rows = words.sparkSession, []
    for i, d in enumerate(dictionaries):
        terms = [r["term"] for r in bounded(d.select("term").where("term IS NOT NULL").distinct(), most, "the dictionary")]
        rows += [(len(rows) + n, i, terms[at : at + block]) for n, at in enumerate(range(0, len(terms), block))]
    blocks = F.broadcast(spark.createDataFrame(rows, "block int, dictionary int, terms array<string>"))
    w = words.select("word").where("word IS NOT NULL").distinct()
    # a shuffle of its own, which isn't folded into that of the distinct words or merged for their size
    n_parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = w.repartition(n_parts, F.xxhash64("word")).withColumn("block", F.explode(F.array(*[F.lit(r[0]) for r in rows]).cast("array<int>")))
    # the negative comes first, so that the least structs are the most like and then the first by text
    score = lambda t: F.struct((F.levenshtein("word", t) / F.greatest(F.length("word"), F.length(t), F.lit(1)) - 1).alias("away"), t.alias("term"))
    best = w.join(blocks, "block").select("word", "dictionary", F.explode(F.slice(F.sort_array(F.transform("terms", score)), 1, each)).alias("x"))
    best = best.select("word", "dictionary", "x.*")
    n = F.row_number().over(Window.partitionBy("word", "dictionary").orderBy("away", "term"))
    best = best.withColumn("n", n).where(F.col("n") <= each)
    place = F.row_number().over(Window.partitionBy("word").orderBy("away", "term", "dictionary"))
    best = best.withColumn("place", place).where(F.col("place") <= k)
    term = F.when(F.col("word") == titled(F.col("word")), titled(F.col("term"))).otherwise(F.col("term"))
    return best.select("word", term.alias("term"), (-F.col("away")).alias("similarity"), "place")


def scope_matches(scopes: DataFrame, rules: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``scope_path, check_name``: rules that see each distinct scope, as ``rules.in_scope`` says.

    The theta join on label sets becomes an equi-join: scopes and the parts of entries meet on each
    label, a part holds if all its labels were met, and an entry if all its plain parts hold and no
    negated one does. ``rules`` is a rule set: more than ``most`` rows are an error.
    """
    spark = scopes.sparkSession
    parts = []  # check, entry, part, negated, label, labels of the part, plain parts of the entry
    for e, r in enumerate(bounded(rules.select("check_name", "scope_path").distinct(), most, "the rules")):
        want, ban = [frozenset("*")], []
        for negated, ls in scope_parts(r["scope_path"] or "text"):
            (ban if negated else want).append(ls)
        if ban:
            ban += [frozenset(["raw"]), frozenset(["summary"])]
        if not any("sentence" in ls for ls in want):
            ban.append(frozenset(["*sentence"]))  # what only entries that name sentences see
        for p, (ls, negated) in enumerate([*((x, False) for x in want), *((x, True) for x in ban)]):
            parts += [(r["check_name"], e, p, negated, x, len(ls), len(want)) for x in ls]
    d = scopes.select("scope_path").where("scope_path IS NOT NULL").distinct()
    extra = F.when(F.col("scope_path").startswith("sentence."), F.array(F.lit("*"), F.lit("*sentence"))).otherwise(F.array(F.lit("*")))
    labels = d.select("scope_path", F.explode(F.array_distinct(F.concat(F.split("scope_path", r"\."), extra))).alias("label"))
    wanted = spark.createDataFrame(parts, "check_name string, entry int, part int, negated boolean, label string, size int, plain int")
    met = labels.join(F.broadcast(wanted), "label").groupBy("scope_path", "check_name", "entry", "part", "negated", "size", "plain").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    entries = met.groupBy("scope_path", "check_name", "entry", "plain").agg(F.count_if(~F.col("negated")).alias("held"), F.count_if("negated").alias("banned"))
    return entries.where("held = plain AND banned = 0").select("scope_path", "check_name").distinct()


def section_styles(files: DataFrame, path: str, sections: list[tuple[str, str]], otherwise: str) -> Column:
    """The styles of the last section whose expression matches the path."""
    out = F.lit(otherwise)
    for pattern, styles in sections:
        out = F.when(F.col(path).rlike(pattern), F.lit(styles)).otherwise(out)
    return out
