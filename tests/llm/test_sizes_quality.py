import random

import pytest

from inkwell.llm import mixing as X
from inkwell.llm import packing as P
from inkwell.llm import quality as Q

PACKS = "pack_name string, lang string, capacity_tokens int, gap_tokens int"


def _check(rows, packs, items):
    caps = {p[0]: p for p in packs}
    boxes, pieces = {}, {}
    for r in rows:
        pieces.setdefault((r.pack_name, r.item_id), []).append((r.piece_no, r.first_token, r.n_tokens))
        if r.container_id is not None:
            boxes.setdefault((r.pack_name, r.container_id), []).append(r.n_tokens)
    for (name, _), sizes in boxes.items():
        assert sum(sizes) + (len(sizes) - 1) * caps[name][3] <= caps[name][2]
    for (name, i), ps in pieces.items():
        ps.sort()
        size = dict((a, b or 0) for a, b, _ in items)[i]
        assert sum(n for *_, n in ps) == size and (len(ps) == 1 or size > caps[name][2])
        assert [f for _, f, _ in ps] == [k * caps[name][2] for k in range(len(ps))]
    return boxes, pieces


def test_packing_is_whole_and_tight(spark):
    r = random.Random(1)
    items = [(i, 100 if i % 3 == 0 else r.randint(1, 400), "de" if i % 2 else None) for i in range(3000)] + [(5000, 5000, "DE"), (5001, 0, "de"), (5002, None, "de")]
    packs = [("a", None, 512, 1), ("b", "de", 300, 0)]
    df = spark.createDataFrame(items, "item_id long, size int, lang string")
    rows = P.pack(df, spark.createDataFrame(packs, PACKS)).collect()
    boxes, pieces = _check(rows, packs, items)
    assert {i for n, i in pieces if n == "a"} == {i for i, *_ in items} and {i for n, i in pieces if n == "b"} == {i for i, _, lg in items if lg and lg.lower() == "de"}
    parts = P.pack(df, spark.createDataFrame(packs, PACKS), ranked=50).collect()  # the hot length in many parts
    assert len(parts) == len(rows) and len(_check(parts, packs, items)[0]) == len(boxes)
    used = sum(s or 0 for _, s, _ in items)
    assert len([1 for n, _ in boxes if n == "a"]) <= 1.03 * (used / 512) + 2


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, size int, lang string")
    assert P.pack(empty, spark.createDataFrame([("a", None, 10, 0)], PACKS)).collect() == []
    assert P.pack(empty, spark.createDataFrame([], PACKS)).collect() == []
    with pytest.raises(ValueError):
        P.pack(empty, spark.createDataFrame([("a", None, 0, 0)], PACKS))


def test_plan_uses_up_the_histogram():
    r = random.Random(2)
    hist = {s: r.randint(1, 500) for s in r.sample(range(1, 200), 60)}
    left = dict(hist)
    for p in P.plan(hist, 200):
        assert sum(s * m for s, m in p.items.items()) <= 200 and p.repeats > 0
        for s, m in p.items.items():
            left[s] -= m * p.repeats
    assert not any(left.values())


TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    r = random.Random(4)
    rows = [(i, "big" if i % 3 else "mid", r.randint(1, 100)) for i in range(6000)] + [(10_000 + i, "small", 50) for i in range(40)] + [(20_000, None, 5), (None, "big", 5), (20_001, "mid", 9000), (20_002, "big", None)]
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "mid", 0.3, 2), ("m", "small", 0.1, 4), ("m", "none", 0.1, 3)], TARGETS)
    taken, shares = X.mix(spark.createDataFrame(rows, "record_id long, source string, n_tokens int"), targets)
    got = {s.source: s for s in shares.collect()}
    assert got["none"].actual_share == 0 and got["small"].repeats == 4
    for s, want in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert abs(got[s].actual_share - want) < 0.003
    copies = {}
    for t in taken.collect():
        assert t.record_id is not None and t.copies <= {"big": 2, "mid": 2, "small": 4}[t.source]
        copies.setdefault(t.source, set()).add(t.copies)
    assert all(max(c) - min(c) <= 1 for c in copies.values())


def test_smaller_mix_is_nested(spark):
    df = spark.createDataFrame([(i, "s", 10) for i in range(5000)], "record_id long, source string, n_tokens int")
    t = spark.createDataFrame([("m", "s", 1.0, 1)], TARGETS)
    a, b = ({r.record_id for r in X.mix(df, t, total=n)[0].collect()} for n in (5000, 20000))
    assert a < b and abs(len(a) - 500) <= 2 and abs(len(b) - 2000) <= 2


def test_budget_goes_on_behind_a_long_record(spark):
    rows = [(i, "s", 1000 if i % 50 else 400_000) for i in range(2000)] + [(5000 + i, "t", 7) for i in range(50_000)]
    df = spark.createDataFrame(rows, "record_id long, source string, n_tokens int")
    t = spark.createDataFrame([("m", "s", 0.5, 1), ("m", "t", 0.5, 1), ("n", "s", 1.0, 1)], TARGETS)
    taken, shares = X.mix(df, t, total=600_000)
    size = {i: n for i, _, n in rows}
    for mix, source, want in (("m", "s", 300_000), ("m", "t", 300_000), ("n", "s", 600_000)):
        got = sum(size[r.record_id] for r in taken.where(f"mix_name = '{mix}' AND source = '{source}'").collect())
        assert 0 <= want - got < 1000, (mix, source, got)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "record_id long, source string, n_tokens int")
    taken, shares = X.mix(df, spark.createDataFrame([("m", "s", 1.0, 1)], TARGETS))
    assert taken.collect() == [] and shares.collect()[0].actual_share is None


def _stats(spark, texts, chunk=Q.CHUNK):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, k int")
    words = spark.createDataFrame([("en", w) for w in "the and of is a to in that it not with on".split()], "lang string, word string")
    return {r.doc_id: r for r in Q.text_statistics(docs, words, chunk=chunk).collect()}


PROSE = "The cat is on the mat and it is not sure that the dog is in the house. It is the end of the day, and the rest of it is a story to tell.\nThe rain is in the hills and on the road to the town; that is all there is to it."


def test_kinds(spark):
    texts = [PROSE] * 40 + [
        None, " \n ", "- a cat\n- the dog\n- on it\n- a mat", "1. The cat is here.\n2. The dog is not.\n3. It is a day.", "key_a = 1\nkey_b: true\nkey_c = warning", "a cat\nthe dog\nthe mat\nan old tree\nthe rain", "| a | b | c |\n|---|---|---|\n| d | e | f |",
        "x,1,yes\ny,2,no\nz,3,yes", "a\tb\tc\nd\te\tf", "the cat    12   yes\nthe dog    3    no\na mat      44   no", "Zxq7Kp/Q1+wL9vBn3TtYzz0aPqRw8kLmXc5\nHh2JkQz/Xv9+bNw7LpTtR4sYyUq1Mn0Zz8", "good day good day good day good day good day good day good day good day", "+<=} +?{\\ ~ |~<%}% #*<^ ]!?/= @{+?|", "(a) the cat;\n(b) the dog;\n(c) an old mat;",
    ]
    got = _stats(spark, texts)
    want = ["blank", "blank", "list", "list", "list", "list", "table", "table", "table", "table", "junk", "junk", "junk", "list"]
    assert [got[40 + i].doc_kind for i in range(len(want))] == want and got[0].doc_kind == "prose"
    assert got[40].mean_word_length is None and got[0].common_share > 0.3 and got[0].ended_share == 1


def test_chunks_of_any_size_give_the_same_row(spark):
    long = (PROSE + "\n\n- one\n  more of it\n- two\n\na = 1\nb = 2\n\n| a | b |\n| c | d |\n") * 20 + "x" * 9000 + " end. " + "good day " * 3000
    a, b, c = (_stats(spark, [PROSE, long, long + "\n"], chunk=n) for n in (1 << 20, 200, 5000))
    assert [a[i] for i in a] == [b[i] for i in a] == [c[i] for i in a] and a[1].list_chars and a[1].junk_chars


def test_partials_merge_in_any_order():
    import pickle

    words = set("the and of is a to in that it not with on".split())
    model = Q.LetterModel().fit([PROSE])
    r = random.Random(1)
    parts = ["- item one two\n", "  hanging on it\n", "a: b\n", "x = 12\n", "| a | b |\n", "plain words. ", "\n\n", "\tq\tw\n", "word " * 900, "tok" * 1500, "<td>x</td> " * 500, 'say "a, b" ', "a,b,c\n", "\n", " " * 5000]
    for _ in range(60):
        text = "".join(r.choice(parts) for _ in range(r.randint(3, 30)))
        whole = Q.partial(Q.pieces(text), words, model, False).total()
        for size in (40, 1000, 5000):
            cs = [pickle.loads(pickle.dumps(Q.partial(x, words, model))) for x in Q.cut(text, size)]
            while len(cs) > 1:
                i = r.randrange(len(cs) - 1)
                cs[i : i + 2] = [cs[i].merged(cs[i + 1])]
            assert cs[0].total() == whole, (size, text)


def test_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE)], "doc_id long, text string")
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    got = Q.text_statistics(docs, words).collect()
    assert len(got) == 1 and got[0].n_chars == len(PROSE)
    assert Q.text_statistics(docs.limit(0), words).collect() == []


def test_letters_are_counted_in_all_documents(spark):
    import numpy as np
    from pyspark.sql import functions as F

    common = {"the", "and", "of", "is", "και", "το", "την", "είναι"}
    greek = "το σπίτι είναι κοντά και το παιδί βλέπει την πόλη.\nτο βράδυ είναι ήσυχο και το φως πέφτει στην αυλή."
    ids = [r.id for r in spark.range(2040).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {i: f"{PROSE}\n{n} is the number of it" if n < 2000 else greek for n, i in enumerate(ids)}
    texts[ids[0]] = "\n".join(f"the word {n:o} is one of many" for n in range(41_000)) + "\nno word of " + "x" * 5000 + " and the end"
    rows = [(i, t) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, *rows[:50], (None, "the zzz is the qqq"), (9999, None)], "doc_id long, text string")
    model = Q.letter_model(docs, "doc_id", "text", common)
    lines = [x for t in texts.values() for x in t.split("\n") if sum(w in common for w in x.lower().split()) >= 2]
    assert len(lines) > 45_000 and np.array_equal(model.table, Q.LetterModel().fit(lines).table)
    words = spark.createDataFrame([("", w) for w in sorted(common)], "lang string, word string")
    kinds = {r.doc_id: r.doc_kind for r in Q.text_statistics(docs, words).select("doc_id", "doc_kind").collect()}
    assert [kinds[i] for i in ids[2000:]] == ["prose"] * 40


def test_letter_levels_hold_at_any_size():
    model = Q.LetterModel()
    pairs = model.pairs([PROSE])
    assert (pairs == model.pairs(PROSE.split("\n"))).all() and pairs.sum() == len(PROSE) + 1
    strange = "Ąžuolas žydi prie upės, đak čita knjigu"
    a, b = (Q.LetterModel().fitted(pairs * n).total(strange)[0] for n in (10**9, 10**12))
    assert a == b


def test_combinations_are_shared_by_all_lengths():
    import numpy as np

    from inkwell.llm.packing import MOST_COMBINATIONS, combinations

    sizes = np.arange(1, 8193)
    got = combinations(sizes, 8192, 81, counts=np.ones(8192))
    assert len(got) == MOST_COMBINATIONS == len({tuple(sorted(c.items())) for c in got})
    assert all(8192 - 81 <= sum(s * n for s, n in c.items()) <= 8192 for c in got)
    led = np.bincount([int(max(c, key=lambda s: s * c[s])) * 8 // 8193 for c in got], minlength=8)
    used = {s for c in got for s in c}
    assert len(used) > 8000 and led[2:].min() > 0 and any(len(c) == 3 for c in combinations(sizes[::8], 8192, 81))
