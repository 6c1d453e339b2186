from inkwell.operators.lint import lint
from inkwell.plans.catalogue import flagship_rules
from inkwell.plans.config import Config
from inkwell.sources.blocks import code_blocks, data_blocks, document_blocks, extract_blocks, html_blocks, tag_counts
from inkwell.sources.files import from_text, json_values, read_folder
from inkwell.streaming.lint import lint_stream

CFG = Config()


def of(blocks):
    return [(b.scope, b.text) for b in blocks]


def places(text, blocks):
    for b in blocks:
        for at, src, n in b.runs:
            piece = b.text[at : at + n]
            assert set(piece) <= {"*"} or piece == " " or text[src : src + n] == piece or "&" in text[src : src + 8], (b.scope, piece, text[src : src + n])


def test_html_walker_is_a_token_walk():
    t = "<h1>A <b>head</b></h1><div class='note'><p>One &amp; <code>x y</code> two<br>three</div><ul><li>item<p>para</p>after</li></ul><script>no</script><img alt='pic'><table><tr><th>h</th><td>c"
    b = html_blocks(t, ".html", CFG)
    got = of(b)
    assert ("text.heading.h1.html", "A head") in got and ("text.class.note.html", "One & *** two three") in got and ("text.list.html", "item") in got and ("text.attr.alt.html", "pic") in got
    assert ("text.html", "after") in got and ("text.table.cell.html", "c") in got and not any("no" == x for _, x in got)
    places(t, b)


def test_markdown_blocks():
    t = "---\ntitle: The title\n---\n# Head\n\nSetext\n======\n\nA *b* [c](http://d) `e`\nnext\n\n* item one\n> quote\n\n| a | b |\n|---|---|\n| c | d |\n\n```\nskip\n```\n\n    code\n\n<div>html</div>\n"
    b = document_blocks(t, ".md", CFG, nested=False)
    got = of(b)
    for want in [("text.frontmatter.title.md", "The title"), ("text.heading.h1.md", "Head"), ("text.heading.h1.md", "Setext"), ("text.md", "A b c *\nnext"), ("text.list.md", "item one"), ("text.blockquote.md", "quote"), ("text.table.header.md", "a"), ("text.table.cell.md", "d"), ("text.md", "html")]:
        assert want in got, (want, got)
    assert not any(x in ("skip", "code") for _, x in got) and got[-2][0] == "raw.md" and got[-1][0] == "summary.md"
    places(t, b[:-2])


def test_comments_and_data():
    t = '#!/bin/x\nx = "# no"  # one\n# two\n# three\ndef f():\n    """Doc."""\n'
    assert of(code_blocks(t, ".py")) == [("text.comment.line.py", "one"), ("text.comment.line.py", "two\nthree"), ("text.comment.block.py", "Doc.")]
    assert of(code_blocks("/* a\n * b */ int x; // c", ".c")) == [("text.comment.block.c", "a\nb"), ("text.comment.line.c", "c")]
    j = '{"a": {"b": "one"}, "c": ["one", "two"], "n": 1}'
    got = data_blocks(j, ".json")
    assert [(b.scope, b.text, b.source(0)) for b in got] == [("text.a_b.json", "one", 13), ("text.c_0.json", "one", 27), ("text.c_1.json", "two", 34)]
    assert of(data_blocks(j, ".json", {"all": "c.*"})) == [("text.all.json", "one"), ("text.all.json", "two")] and data_blocks("{", ".json") == []
    assert tag_counts("<p><b>x</b><table><tr></p>") == {"p": 1, "b": 1, "tr": 1}


def test_ignores_keep_places():
    cfg = Config()
    b = document_blocks("good {{bad}} good", ".txt", cfg, False, ([], [r"\{\{.*?\}\}"]))
    assert b[0].text == "good ******* good"


def test_folder_and_text(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in (("a/x.md", "# Some head"), ("a/y.txt", "plain"), ("node_modules/z.md", "no")):
        (tmp_path / name).write_text(body)
    got = {(r.ext, r.text) for r in read_folder(spark, str(tmp_path)).collect()}
    assert got == {(".md", "# Some head"), (".txt", "plain")}
    assert [r.text for r in read_folder(spark, str(tmp_path), "*.md").collect()] == ["# Some head"] and [r.text for r in read_folder(spark, str(tmp_path), "!*.md").collect()] == ["plain"]
    assert from_text(spark, "x").first().text == "x"


def test_blocks_and_lint_on_odd_tables(spark):
    rows = [(1, "Some text.", "k"), (2, None, "k"), (3, "", "k"), (None, "Some", "k"), (1, "Some text.", "k"), (4, "some " * 30_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = lint(df, flagship_rules()).where("check_name = 'Plain.Weasel'").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 2, 4: 30_000}
    assert lint(df.limit(0), flagship_rules()).collect() == []
    b = extract_blocks(df, ext="'.txt'").where("doc_id = 1").first()
    assert b.scope == "text.txt" and b.offset == 0 and b.runs[0].n == 10
    v = spark.createDataFrame([(1, '{"a": {"b": 5}}'), (2, "x"), (3, None)], "id long, j string")
    assert [tuple(r) for r in json_values(v, "id", "j", {"b": "$.a.b", "c": "$.c"}).collect()] == [(1, "b", "5")]


def test_same_alerts_in_any_partitioning(spark):
    df = spark.createDataFrame([(i, f"Some old text {i} is hidden.") for i in range(50)], "doc_id long, text string")
    a, b = (sorted(map(str, lint(df.repartition(n), flagship_rules()).collect())) for n in (1, 7))
    assert a == b and len(a) == 200  # three words and one swap in each


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "Some old text.")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = lint_stream(spark, str(tmp_path / "in"), "doc_id long, text string", flagship_rules(), None, lambda x, i: x.write.mode("overwrite").parquet(str(tmp_path / f"out{i}")), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out0")).where("check_name = 'Plain.Weasel'").count() == 2
