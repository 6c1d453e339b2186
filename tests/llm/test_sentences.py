from inkwell.llm import sentences as S

M = S.Model({"dr", "e.g", "etc", "fig", "##number##"}, {("##number##", "mai")}, {"the", "we"}, {"without", "note"}, {"etc"})


def split(text, model=M):
    return [text[a:b] for a, b in S.split_text(text, model)]


def test_blank_and_null():
    assert S.split_text(None, M) == [] == S.split_text(" \r\n \n ", M)


def test_abbreviations_numbers_initials():
    assert split("Dr. Silve sees Fig. 7 and 3.5 files, e.g. two. The rest, etc. We go.") == ["Dr. Silve sees Fig. 7 and 3.5 files, e.g. two.", "The rest, etc.", "We go."]
    assert split("Am 7. Mai kam Dr. A. B. Lin an.") == ["Am 7. Mai kam Dr. A. B. Lin an."]


def test_line_breaks():
    assert split("One two\r\nthree. Four\nfive\r\n\r\nsix") == ["One two\r\nthree.", "Four\nfive", "six"]


def test_quotations_and_brackets():
    assert split("“Go! Now.” said Ann. He left.") == ["“Go! Now.” said Ann.", "He left."]
    assert split('He wrote: "It is. So." The end.') == ['He wrote: "It is. So."', "The end."]
    assert split("It is so. (It was.) The end (see e.g. two).") == ["It is so.", "(It was.)", "The end (see e.g. two)."]
    assert split("他说：“好。”我走。") == ["他说：“好。”", "我走。"]
    assert split("「行く？」と聞いた。次。") == ["「行く？」と聞いた。", "次。"]


def test_thai_and_ellipsis():
    assert split("ย่อหน้านี้ข้าม ฉบับที่สองตรวจ\nคำ") == ["ย่อหน้านี้ข้าม", "ฉบับที่สองตรวจ\nคำ"]
    assert split("He waits ... but not long. Done...") == ["He waits ... but not long.", "Done..."]


def test_learns_and_finds_places(spark):
    rows = [(i, "en", f"Dr. Name{i} met Dr. Other{i}. The cat saw approx. {i} dogs. We saw the dogs and the cat. The end came, and the cat ran. ") for i in range(120)]
    rows += [(1000, None, "The dog met Dr. Zed. We ran."), (1001, "en", None), (None, "en", "x."), (1002, "xx", "Ein Satz. Noch einer."), (1003, "EN", "")]
    df = spark.createDataFrame(rows, "k long, lang string, body string")
    models, common = S.learn(df.selectExpr("lang", "body AS text"))
    assert {"dr", "approx"} <= models["en"].abbreviations and "cat" not in models["en"].abbreviations
    got = S.sentence_units(df, "k", "body", "lang").collect()
    text = {r[0]: r[2] for r in rows}
    of = lambda k: sorted(text[k][r.start_at : r.end_at] for r in got if r.k == k)
    assert of(1000) == ["The dog met Dr. Zed.", "We ran."] and of(1002) == ["Ein Satz.", "Noch einer."] and len(of(5)) == 4
    assert not [r for r in got if r.k in (1001, 1003, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, lang string, body string")
    assert S.sentence_units(df, "k", "body", "lang").collect() == []


def test_language_by_the_whole_text():
    text = "der und die. " * 2000 + "the and of. " * 4000
    assert S.language_of(text, {"de": {"der", "und", "die"}, "en": {"the", "and", "of"}}) == "en"
    assert S.language_of("1 2 3 " * 5000 + "the and", {"de": {"der"}, "en": {"the"}}) == "en"


def test_texts_without_a_language_teach(spark):
    rows = [("en", f"The cat saw {i} dogs. We saw the dogs and the cat. The end came, and the cat ran. ") for i in range(60)]
    bare = [(None, f"The dog met approx. {i} cats and Dr. Zed{i} saw the cat. We saw the cat and the dog. ") for i in range(60)] + [("", "We met Dr. No.")]
    models, common = S.learn(spark.createDataFrame(rows + bare, "lang string, text string"))
    assert {"approx", "dr"} <= models["en"].abbreviations and set(common) == {"en"} == set(models)
    df = spark.createDataFrame([(i, None, t) for i, (_, t) in enumerate(bare)], "k long, lang string, text string")
    assert "approx" in S.learn(df.select("lang", "text"))[0][""].abbreviations
    got = [(r.start_at, r.end_at) for r in S.sentence_units(df, "k", "text", "lang").where("k = 5").orderBy("start_at").collect()]
    assert [bare[5][1][a:b] for a, b in got] == ["The dog met approx. 5 cats and Dr. Zed5 saw the cat.", "We saw the cat and the dog."]


def test_rare_abbreviations_of_a_large_corpus(spark):
    much = "the cat saw the dog and the dog saw a cat that ran on. " * 3000
    rows = [("en", much)] * 40 + [("en", "We met xq. Ann and xq. Bo at the zo with a ze. "), ("en", "Then zo. Rem came, ze. Rem went, and a rem ran. ")]
    models, _ = S.learn(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert "xq" in models["en"].abbreviations


def test_learns_the_case_of_what_splitting_looks_up(spark):
    rows = [("en", "We saw approx. Ten of ten. And ten ran... ‘Ten’ more, etc. Ten. ")] * 30 + [("en", "The cat and the dog met at noon. ")] * 300
    models, _ = S.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert "ten" in models["en"].lower or "ten" in models["en"].starters


def test_time_is_linear_in_one_paragraph():
    import time

    for piece in ("Dr. Silve (see e.g. two) sees “Fig. 7” and 3.5 files ... but. ", "字。“好。”", '"', "(", "1. ", "a.b"):
        took = []
        for n in (100_000, 1_000_000):
            text, began = piece * (n // len(piece)), time.time()
            S.split_text(text, M)
            took.append(time.time() - began)
        assert took[1] < 30 * took[0] + 0.5, (piece, took)
    text = ("Dr. Silve saw it. " * 560_000)[:10_000_000]
    assert len(split(text)) == 555_556


def test_long_types_stay_distinct():
    a, b = "x" * 60 + "a", "x" * 60 + "b"
    kinds = [k for k, *_ in S.words(f"{a} {b} {a.upper()}. short")]
    assert kinds[0] != kinds[1] and kinds[0] == kinds[2] and all(len(k) < S.WIDE_TYPE for k in kinds) and kinds[3] == "short"


def test_pairs_in_one_pass():
    assert S._pairs_in("a (b (c) d) “e” »f« (g") == {2: (10, False), 12: (14, True), 16: (18, True)}
    assert S._pairs_in('say "x" or 5" and "y"') == {4: (6, True), 18: (20, True)} and S._pairs_in("»ja« so") == {0: (3, True)} and S._pairs_in("") == {}
