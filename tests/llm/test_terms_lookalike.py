import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import lookalike as L
from inkwell.llm import terms as T

ALERTS = "alert_id long, file_id long, check_name string, match_text string, term string, rng int"


def _brute(rows):
    seen, out = set(), {}
    for r in rows:
        if (r[0], r[1], r[2], r[3]) in seen and r[0] is not None:
            continue
        seen.add((r[0], r[1], r[2], r[3]))
        for f, t in (("check_name", r[2]), ("match_text", r[3])):
            if t is not None:
                n, files = out.setdefault((f, t), [0, set()])
                out[(f, t)][0] += 1
                if r[1] is not None:
                    files.add(r[1])
    return {k: (n, len(files)) for k, (n, files) in out.items()}


def test_frequencies_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, i % 7, "A.B" if i % 3 else None, ["hot", "", "rare%d" % i, None][i % 4 if i % 5 else 0], "x", 1) for i in range(200)]
    rows += rows[:30] + [(900, None, "A.B", "hot", None, None), (901, 3, None, None, None, None)]
    df = spark.createDataFrame(rows, ALERTS)
    got = {(r.field_name, r.term): (r.n_rows, r.n_records) for r in T.term_frequencies(df, "file_id", ["check_name", "match_text"], "alert_id", n_blocks=3, n_ranges=5).collect()}
    assert got == _brute(rows)


def test_frequencies_of_nothing(spark):
    assert T.term_frequencies(spark.createDataFrame([], ALERTS), "file_id", ["match_text"], "alert_id").collect() == []


def test_marks(spark):
    rows = [(i, i, "all", "one" if i == 0 else "many", None, None) for i in range(20)]
    df = spark.createDataFrame(rows, ALERTS)
    limits = spark.createDataFrame([("match_text", 2, 500), ("check_name", 2, 1000)], "field_name string, min_files int, max_permille int")
    freq = T.term_frequencies(df, "file_id", ["check_name", "match_text"], "alert_id")
    got = {(r.field_name, r.term): r.mark for r in T.marked_terms(freq, limits, df, "file_id").collect()}
    assert got == {("match_text", "one"): "rare", ("match_text", "many"): "common", ("check_name", "all"): None}


TERMS = [(1, "résumé sheet"), (2, "resume sheet"), (3, "OfficeFlow"), (4, "словарь терминов"), (5, "office"), (6, None), (7, "")]


def _found(spark, texts, whole=False):
    rec = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "record_id long, text string, value string")
    terms = spark.createDataFrame(TERMS, "term_id long, term string")
    return {(r.record_id, r.term_id) for r in L.look_alikes(rec, terms, whole=whole).collect()}


def test_looks_alike_whole(spark):
    texts = ["re\u0301sume\u0301 sheet", "r\u00e9sum\u00e9 sheet", "Оffice\u200bFlow", "ｏｆｆｉｃｅ", "oﬃce", "Office", "resume\u00a0sheet", "rèsume sheet", None, "", "offices", "cловарь терминов", "resume\nsheet"]
    assert _found(spark, texts, whole=True) == {(0, 1), (2, 3), (3, 5), (4, 5), (6, 2), (11, 4)}


def test_looks_alike_inside_but_not_in_longer_words(spark):
    texts = ["the ｏｆｆｉｃｅ is", "preｏｆｆｉｃｅ is", "see resume\u2007sheet.", "resume\u00a0sheets", "an оffice\nhere", None, "", "plain office"]
    assert _found(spark, texts) == {(0, 5), (2, 2), (4, 5)}


def test_canonical_member_is_the_plainest(spark):
    v = spark.createDataFrame([("ｃａｔ",), ("cat",), ("cаt",), (None,), ("cat",), ("",)], "value string")
    got = {r.value: r.canonical for r in L.canonical_forms(v).collect()}
    assert got == {"ｃａｔ": "cat", "cat": "cat", "cаt": "cat", "": ""}


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="aeobcіеоА\u0301\u200b ", max_size=6))
def test_letter_map_is_stable(s):
    table = L.LETTERS
    once = "".join(table.get(c, c) for c in s if c not in L.INVISIBLE)
    assert "".join(table.get(c, c) for c in once) == once
    assert all(unicodedata.category(c) != "Cf" for c in once)


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([(1, 1, "a", "b", "c", 1)], ALERTS)
    limits = spark.createDataFrame([("match_text", 2, 500)], "field_name string, min_files int, max_permille int")
    freq = T.term_frequencies(df, "file_id", ["match_text"], "alert_id")
    plan = T.marked_terms(freq, limits, df, "file_id").where(F.col("mark").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_frequencies_of_a_hot_record_and_clashing_codes(spark, monkeypatch):
    rows = [(i, 7, "A.B", f"m{i % 5}", "x", 1) for i in range(3000)] + [(i, None, "C.D", "hot", "x", 1) for i in range(3000, 4500)] + [(5000 + i, i, "A.B", "hot", "x", 1) for i in range(40)]
    rows += rows[:100] + rows[3000:3050]
    df = spark.createDataFrame(rows, ALERTS)
    got = {(r.field_name, r.term): (r.n_rows, r.n_records) for r in T.term_frequencies(df, "file_id", ["check_name", "match_text"], "alert_id", n_blocks=2).collect()}
    assert got == _brute(rows)
    values = T.distinct_values(df, ["check_name", "match_text"])[0].collect()
    clash = [values[0].code]
    assert df.select(T._code("check_name", F.lit(values[0].term), clash).alias("c")).first().c != values[0].code
    plan = T.block_counts(df.where("file_id < 20 AND file_id <> 7"), "file_id", ["check_name"], "alert_id", 4, [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # rows to their block, and the counts of blocks


def test_composed_letters_of_other_scripts(spark):
    terms = spark.createDataFrame([(1, "счётчик"), (2, "naïve"), (3, "café")], "term_id long, term string")
    rows = [(1, "счётчик"), (2, "счëтчик"), (3, "naїve"), (4, "счётчик"), (5, "naive"), (6, "\U0001d41c\U0001d41a\U0001d41fé"), (7, "счетчик")]
    got = L.look_alikes(spark.createDataFrame(rows, "record_id long, text string"), terms, whole=True).collect()
    assert {(r.record_id, r.term_id) for r in got} == {(1, 1), (2, 1), (3, 2), (6, 3)}
