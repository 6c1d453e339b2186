import itertools
import random

import numpy as np

from inkwell.llm import codetext as C
from inkwell.llm.lexing import FAMILIES, LONG_LINE, compose, composition, cut, lexer, scan, units


def _joined(spans):
    return [(k, "".join(t for _, t in g)) for k, g in itertools.groupby(spans, key=lambda x: x[0])]


def test_chunks_read_as_the_whole():
    r = random.Random(3)
    parts = ['"', "'", "/", "*", "-", "#", "\\", "\n", "[", "]", "=", "{", "}", "a", "b ", '"""', "--[[", "]]", "=begin", "=end", "{-", "-}", "`", "*/", "//"]
    for name in FAMILIES:
        lx = lexer(name)
        for _ in range(40):
            text = "".join(r.choice(parts) for _ in range(50))
            cs = [text[i : i + 6] for i in range(0, len(text), 6)]
            fs = [lx.function(c) for c in cs]
            st = scan(fs)
            got = [s for i, c in enumerate(cs) for s in lx.spans(c, st[i], None if i == len(cs) - 1 else int(fs[i][st[i]]))]
            assert _joined(got) == _joined(lx.spans(text)), (name, text)


def test_functions_compose():
    lx = lexer("c")
    a, b = "x = '/* ' /", "* y */ \"z"
    assert np.array_equal(lx.function(a + b), compose(lx.function(a), lx.function(b)))


def test_cut_keeps_every_character():
    text = "line one\nline two\n" * 50 + "x" * 300 + "\n" + "y" * (2 * LONG_LINE + 5)
    assert "".join(u for c in cut(text, 64) for u in c) == text == "".join(units(text)) and units("") == [] and cut("", 64) == [[]]
    assert [len(u) for u in units(text)[-3:]] == [LONG_LINE, LONG_LINE, 5]


def test_units_read_alike_in_any_chunks():
    r = random.Random(5)
    parts = ['"', "'", "/*", "*/", "//", "#", "\\", "\n", "[[", "]]", "a ", "b" * LONG_LINE, '"""', "--", "{-", "-}", "`", "word word word "]
    for name in FAMILIES:
        lx = lexer(name)
        for _ in range(12):
            text = "".join(r.choice(parts) for _ in range(60))
            whole = _joined(lx.read(units(text)))
            for size in (1, 40, 20_000):
                chunks = cut(text, size)
                st = scan([lx.function("".join(c)) for c in chunks])
                assert _joined([s for c, a in zip(chunks, st) for s in lx.read(c, a)]) == whole, (name, size)
            f = composition(np.stack([lx.function("".join(c)) for c in chunks]))
            assert np.array_equal(f, lx.function(text))


def _files(spark):
    langs = {"en": "The cat sees that this old list is not clear to the reader", "de": "Die Katze sieht nicht alle alten Listen und die Leser warten auf eine Antwort", "zh": "这条规则比较所有旧的术语而且检查错误的写法", "ru": "Каждый заголовок проверяет старые термины и собирает повторы слов"}
    rows = [(i * 10 + j, "text", k, t + ". " + t + "!", ".txt", ".txt") for i in range(30) for j, (k, t) in enumerate(langs.items())]
    rows += [(1000 + i, "code", "en", f"int a{i} = get(b, {i});\nif (a > 3) {{ return a[{i}]; }}\n// {langs['en']}\n", ".c", ".c") for i in range(30)]
    return spark.createDataFrame(rows, "file_id long, file_format string, lang string, file_content string, normed_ext string, real_ext string")


def test_languages_by_comment(spark):
    model = C.fit_model(_files(spark))
    src = [
        (1, ".c", ".c", '// The old list is not clear to the reader\nint a = get("x y z");', 9), (2, ".c", ".c", "// int a = get(b, 3); return a[3];", 9), (3, ".py", ".py", '"""\nDie Leser warten auf eine Antwort\n\n检查错误的写法和旧的术语\n"""', 9),
        (4, None, None, None, 9), (5, ".c", ".c", "", 9), (6, ".c", ".c", "x = 'a'; /* see */", 9), (None, ".c", ".c", "// The old list is not clear", 9),
    ]
    big = "int a = 1;\n" * 300 + '/* The old list is not clear\n to the reader and the cat */ "s"\n' + "b = 2;\n" * 300
    df = spark.createDataFrame([*src, (7, ".c", ".c", big, 9)], "key long, ext string, real_ext string, text string, chunk int")
    whole = {(r.key, r.lang): r.n_chars for r in C.code_languages(df, model).collect()}
    assert set(whole) == {(1, "en"), (3, "de"), (3, "zh"), (7, "en")}
    assert {(r.key, r.lang): r.n_chars for r in C.code_languages(df, model, chunk=500).collect()} == whole
    wide = "// " + "The old list is not clear to the reader " * 2000
    long = df.limit(0).unionByName(spark.createDataFrame([(8, ".c", ".c", wide, 9)], df.schema))
    one, many = ([tuple(r) for r in C.code_languages(long, model, chunk=n).collect()] for n in (1 << 20, 64))
    assert one == many and one[0][1] == "en"
    assert C.code_languages(df.limit(0), model).collect() == []


def test_held_out_residue_is_no_language(spark):
    model = C.fit_model(_files(spark))
    r = random.Random(99)
    lines = [x for x in (C._residue(r) for _ in range(600)) if C.worth(x)]
    assert sum(model.label(x) == "none" for x in lines) >= 0.97 * len(lines)
