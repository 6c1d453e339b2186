"""Natural language in the comments and strings of source code.

Method: lexer state-transition functions over chunks, composed by parallel prefix (``lexing``),
and a multinomial logistic regression on hashed n-grams that labels each line of a span with
its language, or with none (code, directives, paths, patterns, keys...).
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.lexing import CHUNK, composition, cut, family, lexer, scan, units
from inkwell.session import bounded, spread, written

LANGS = ["en", "de", "fr", "es", "ru", "zh", "ja"]
CLASSES = ["none", *LANGS, "other"]
#: The sample that the classifier is fitted on: files of each language, and code files.
TEXTS_PER_LANG, CODE_FILES, LINES_PER_CLASS = 150, 200, 1500
BITS = 16
FAN = 256  # chunks whose functions one task composes; a text of 2 GB has some 130 such groups
MIN_WORDS, MIN_SIGNS = 3, 6

_DIGITS = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_AROUND = ".,;:!?()[]\"'‘’“”«»„¿¡…–—*`"
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_MARKS = re.compile(r"^[\s*/#!;<>|=~+\-]+|[\s*/#=~+\-]+$")
_HOLDERS = re.compile(r"%[-+ 0#]*\d*(?:\.\d+)?[sdifgxqv]|\{[\w.:]*\}|\$\{[\w.]+\}|\\[nrt]")


def features(line: str) -> np.ndarray:
    """Hashed features: words, letter n-grams of one to three, and which signs the line holds."""
    t = _DIGITS.sub("0", " ".join(line.lower().split()))
    t = f" {t} "
    grams = {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    grams |= {f"w={w}" for w in t.split()}
    signs = sum(not (c.isalnum() or c.isspace() or c in ".,!?'’-–—:«»“”„¿¡。，、？！") for c in t)
    words = max(1, len(t.split()))
    grams |= {f"#signs={min(signs, 6)}", f"#rate={min(6, signs * 3 // words)}", f"#words={min(8, words)}", f"#joined={min(3, len(re.findall(r'[a-z0]-[a-z0]|[a-z]_[a-z]|[a-z]\.[a-z]', t)))}"}
    return np.fromiter((zlib.crc32(g.encode()) & ((1 << BITS) - 1) for g in grams), dtype=np.int64)


class LineModel:
    """Multinomial logistic regression on hashed features, fitted by AdaGrad on small batches in a fixed order."""

    def __init__(self):
        self.w = np.zeros((1 << BITS, len(CLASSES)), dtype=np.float32)

    def fit(self, lines: list[tuple[str, str]], epochs: int = 6, rate: float = 0.15, batch: int = 64) -> LineModel:
        r = random.Random(7)
        rows = [(features(t), CLASSES.index(y)) for t, y in lines]
        g = np.full(self.w.shape, 1e-6, dtype=np.float32)
        for _ in range(epochs):
            r.shuffle(rows)
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                size = np.array([len(x) for x, _ in part])
                x = np.concatenate([x for x, _ in part])
                s = np.add.reduceat(self.w[x], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0)
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(part)), [y for _, y in part]] -= 1
                at_x, where = np.unique(x, return_inverse=True)  # a feature's gradient is summed over the batch
                each = np.repeat(p, size, axis=0)
                grad = np.stack([np.bincount(where, each[:, c], len(at_x)) for c in range(p.shape[1])], axis=1).astype(np.float32)
                g[at_x] += grad * grad
                self.w[at_x] -= rate * grad / np.sqrt(g[at_x])
        return self

    def label(self, line: str) -> str:
        return CLASSES[int(self.w[features(line)].sum(axis=0).argmax())]


_SYLLABLES = "ba ce di fo gu ha ji ke lo mu na pi ro sa te vu wi xo ye zu bra cle dri flo gru pla sti tre".split()


def _residue(r: random.Random) -> str:
    """A line that stands in strings and comments and is no natural language, with invented names.

    Its kinds are those of any source code: queries, markup attributes, paths, patterns, formats,
    keys, tool directives, licence marks, tags and rulers.
    """
    w = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))
    n = lambda: r.randint(0, 999)
    some = lambda f, a, b, sep: sep.join(f() for _ in range(r.randint(a, b)))
    up = lambda x: x.upper() if r.random() < 0.6 else x
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda: "".join(r.choice(signs) for _ in range(r.randint(8, 40)))
    name = lambda: r.choice([w(), f"{w()}_{w()}", w() + w().title(), f"{w()}{n()}"])

    def query() -> str:
        cols, where = some(name, 1, 3, ", "), f"{name()} {r.choice('=<>')} {r.choice([str(n()), '?', f':{w()}', repr(w())])}"
        return r.choice(
            [
                f"{up('select')} {cols} {up('from')} {w()} {up('where')} {where}", f"{up('insert into')} {w()} ({cols}) {up('values')} ({some(lambda: '?', 1, 4, ', ')})", f"{up('update')} {w()} {up('set')} {where}",
                f"{up('delete from')} {w()} {up('where')} {where}", f"{up('select')} {cols} {up('from')} {w()} {up('order by')} {name()} {up('limit')} {n()}", f"{up('create table')} {w()} ({name()} {up('text')}, {name()} {up('int')})",
            ]
        )

    def attributes() -> str:
        return some(lambda: r.choice([w(), f"{w()}-{n() % 13}", f"{w()}-{w()}", f"{w()}__{w()}", f"{w()}:{w()}"]), 3, 7, " ")

    def path() -> str:
        sep = r.choice(["/", "/", "\\"])
        return r.choice(["", "./", "~/", f"{w().upper()[:1]}:\\", f"https://{w()}.example/"]) + some(name, 2, 5, sep) + r.choice(["", f".{w()[:3]}", f"?{w()}={n()}&{w()}={w()}"])

    def pattern() -> str:
        atom = lambda: r.choice([f"[a-{r.choice('kmz')}]", "\\d", "\\w+", "\\s*", f"({w()}|{w()})", f"[^{r.choice(',;/ ')}]", f"{{{n() % 5},{n()}}}", w(), "(.*)", "?:"])
        return r.choice(["^", "", "(?i)"]) + some(atom, 3, 7, r.choice(["", "", " "])) + r.choice(["$", ""])

    def form() -> str:
        parts = r.sample(["%Y", "%m", "%d", "%H", "%M", "%S", "%j", "%b", "YYYY", "MM", "DD", "HH", "mm", "ss", "zzz", "%s", "%d", "%5.2f", "{}", f"{{{w()}}}", f"{w()}=%s", f"{w()}: %d"], r.randint(3, 6))
        return r.choice(["-", ":", " ", "; ", ", ", "/"]).join(parts)

    def directive() -> str:
        verb = r.choice(["disable", "enable", "ignore", "off", "on", "skip", "begin", "end", "pragma", "region", "endregion", "nolint", "build"])
        return r.choice(
            [
                f"{w()}-{verb}-{w()}-{w()} {w()}-{w()}", f"{w()}: {verb}={name()},{name()}", f"{w()}:{verb} {w()} && !{w()}", f"{verb} {w()} {w()}", f"{verb}: {w()}[{w()}-{w()}]", f"{w()} {w().title()}.{w().title()} = {r.choice(['NO', 'YES', 'off', 'on'])}",
                f"{w()} {verb}", f"{w()} style = {w().title()}, {w().title()}", f"{w()}: set {w()[:2]}={n() % 9} {w()[:2]}={n() % 9} {w()}:", f"-*- {w()}: {w()}-{n()} -*-", f"{verb} once {name()}", f"{w()}: {r.choice('EWFC')}{n()}, {r.choice('EWFC')}{n()}",
            ]
        )

    def licence() -> str:
        who = f"{w().title()} {w().title()}"
        return r.choice(
            [
                f"Copyright (c) {1990 + n() % 40} The {who} Authors", f"Copyright {1990 + n() % 40}-{1990 + n() % 40} {who}", f"(C) {1990 + n() % 40} {who} Inc. All rights reserved.", f"Licensed under the {who} License, Version {n() % 4}.{n() % 9}",
                f"SPDX-License-Identifier: {w().upper()}-{n() % 4}.{n() % 9} OR {w().upper()}", f"@author {who} <{w()}@{w()}.example>", f"@license {w().upper()} {w().title()} v{n() % 5}", f"All rights reserved. {who} {1990 + n() % 40}",
            ]
        )

    def tag() -> str:
        return r.choice([f"@{r.choice(['param', 'arg', 'return', 'throws', 'see', 'type'])} {name()} {name()}", f":{r.choice(['param', 'type', 'raises'])} {name()}: {name()} {w()}", f"<{w()} {w()}={w()}>{w()}</{w()}>", f"\\{w()}{{{w()}}} {w()}", f"[{w()}]({path()}) {name()}"])

    def secret() -> str:
        return r.choice([key(), f"{w()}:{key()}", f"{key()}=={key()}", f"{w()} {key()} {key()}", some(lambda: f"{n():03x}", 4, 12, r.choice(["-", ":", " "]))])

    def ruler() -> str:
        return r.choice(["-", "=", "*", "#", "~", "-=", "+-"]) * r.randint(8, 40) + r.choice(["", f" {w()} ", f"[ {w()} {w()} {n()} ]"])

    return r.choice([query, attributes, attributes, path, pattern, form, directive, directive, directive, licence, tag, secret, ruler])()


def _vary(line: str, lang: str, r: random.Random) -> str:
    """A sentence the way it may stand in code: a part of it, with holders, with a task mark, without its capital or its closing mark."""
    parts = line.split()
    spaced = lang not in ("zh", "ja")
    if spaced and len(parts) > 6 and r.random() < 0.35:
        a = r.randrange(0, len(parts) - 4)
        parts = parts[a : a + r.randint(4, 9)]
    if spaced and len(parts) > 3 and r.random() < 0.35:
        for _ in range(r.choice([1, 1, 2])):
            parts[r.randrange(0, len(parts))] = r.choice(["%s", "%d", "%v", "{}", "{0}", f"{{{r.choice(_SYLLABLES)}}}"])
    line = " ".join(parts)
    if r.random() < 0.4:
        line = line.rstrip(".!?。！？।")
    if r.random() < 0.4:
        line = line[:1].lower() + line[1:]
    k = r.random()
    if k < 0.1:
        return r.choice(["TODO: ", "FIXME: ", "NOTE: "]) + line
    return line + r.choice(["\\n", " (%s)", ": %s", ": {}"]) if k < 0.2 else line


def training_lines(texts: list[tuple[str, str]], code: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Labelled lines from ``(language, text)`` and ``(family, code)``, and invented residue."""
    r = random.Random(11)
    by: dict[str, list[str]] = {c: [] for c in CLASSES}
    for lang, text in texts:
        for line in re.split(r"[\n\r]+|(?<=[.!?。！？।؟])\s+|(?<=[。！？])", text or ""):
            if worth(line):
                by[lang if lang in LANGS else "other"].append(line.strip())
    for fam, text in code:
        spans = "\n".join(t for kind, t in lexer(fam).spans(text or "") if kind == "code")
        by["none"] += [x.strip() for x in spans.split("\n") if worth(x)]
    out = []
    for c in CLASSES:
        rows = by[c]
        r.shuffle(rows)
        rows = rows[:LINES_PER_CLASS]
        out += [(x, c) for x in rows] + ([(_vary(x, c, r), c) for x in rows] if c != "none" else [])
    out += [(x, "none") for x in (_residue(r) for _ in range(4 * LINES_PER_CLASS)) if worth(x)]
    return out


def worth(line: str) -> bool:
    """Whether a line has enough words, or characters of a script without spaces."""
    if len(_CJK.findall(line)) >= MIN_SIGNS:
        return True
    n = 0
    for t in _HOLDERS.sub(" ", line).split():
        n += _WORD.fullmatch(t.strip(_AROUND)) is not None  # words stand between spaces; parts of names and paths don't count
        if n >= MIN_WORDS:
            return True
    return False


def fit_model(files: DataFrame) -> LineModel:
    """The line model, fitted on a bounded sample of ``files``: text files for the languages, code files for code.

    ``TEXTS_PER_LANG`` files of each stated language and ``CODE_FILES`` code files are taken by
    hash of the id, which first looks at ids and languages alone.
    """
    ids = files.select("file_id", "file_format", F.lower("lang").alias("lang")).where("file_id IS NOT NULL")
    kind = F.when(F.col("file_format") == "code", "#code").when(F.col("file_format") == "text", F.col("lang"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("file_id"), "file_id"))
    most = F.when(F.col("kind") == "#code", CODE_FILES).otherwise(TEXTS_PER_LANG)
    chosen = ids.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= most).select("file_id", "kind")
    rows = files.select("file_id", "normed_ext", "real_ext", F.col("file_content").alias("text")).join(chosen, "file_id")
    got = bounded(rows.select("kind", "normed_ext", "real_ext", "text"), 20_000, "the sample of labelled files")
    got.sort(key=lambda x: (x["kind"], x["text"] or ""))
    texts = [(x["kind"], x["text"]) for x in got if x["kind"] != "#code"]
    code = [(family(x["normed_ext"], x["real_ext"]), x["text"]) for x in got if x["kind"] == "#code"]
    return LineModel().fit(training_lines(texts, code))


def lines_of(text: str):
    """The lines of a span without the marks around them."""
    for line in text.split("\n"):
        line = _MARKS.sub("", line)
        if line:
            yield line


def languages(spans: list[tuple[str, str]], model: LineModel) -> dict[str, int]:
    """Characters of natural language by language in the comments and strings of a text."""
    out: dict[str, int] = {}
    for kind, text in spans:
        if kind != "code":
            for line in lines_of(text):
                if worth(line) and (y := model.label(line)) in LANGS:
                    n = len(_CJK.findall(line))
                    if y in ("zh", "ja") and n < MIN_SIGNS:
                        continue
                    out[y] = out.get(y, 0) + len(line)
    return out


def code_languages(rows: DataFrame, model: LineModel, chunk: int = CHUNK) -> DataFrame:
    """``key, lang, n_chars``: natural language in each text, by language.

    ``rows(key, ext, real_ext, text)``. Texts longer than a chunk are cut between their units (lines,
    and parts of lines over ``LONG_LINE`` characters); the chunks' transition functions are
    composed in a tree of ``FAN`` children, the start states are handed down it, and the chunks
    are read apart, so one huge file keeps many tasks busy. A unit is judged alike in a chunk and in
    a whole text, so the chunk size has no influence. Null and blank texts give nothing; unknown
    endings are read by the marks most languages share. Repeated keys add up, so repeated rows
    should be taken out before.
    """
    rows = rows.select("key", "ext", "real_ext", "text").where("key IS NOT NULL AND text IS NOT NULL")

    def whole(batches):
        for pdf in batches:
            out = []
            for k, a, b, t in zip(pdf["key"], pdf["ext"], pdf["real_ext"], pdf["text"]):
                out += [(k, lang, n) for lang, n in languages(lexer(family(a, b)).read(units(t)), model).items()]
            yield pd.DataFrame(out, columns=["key", "lang", "n"]).astype({"key": "int64", "n": "int64"})

    def chunks(batches):
        for pdf in batches:
            for k, a, b, t in zip(pdf["key"], pdf["ext"], pdf["real_ext"], pdf["text"]):
                f = family(a, b)
                for seq, c in enumerate(cut(t, chunk)):
                    yield pd.DataFrame([(k, f, seq, c)], columns=["key", "family", "seq", "units"])

    def functions(batches):
        for pdf in batches:
            fs = [lexer(f).function("".join(c)) for f, c in zip(pdf["family"], pdf["units"])]
            yield pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "f": fs})

    def composed(pdf):
        """What the chunks of one group do, one after the other."""
        pdf = pdf.sort_values("seq")
        f = composition(np.stack([np.asarray(x) for x in pdf["f"]]))
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": [int(pdf["seq"].iloc[0]) // FAN], "f": [f]})

    def entered(pdf):
        """The state before each group of a text."""
        pdf = pdf.sort_values("part")
        return pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "enter": scan([np.asarray(f) for f in pdf["f"]])})

    def starts(pdf):
        pdf = pdf.sort_values("seq")
        fs = [np.asarray(f) for f in pdf["f"]]
        states = scan(fs, int(pdf["enter"].iloc[0]))
        return pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "before": states})

    def read(batches):
        for pdf in batches:
            out = []
            for k, f, c, a in zip(pdf["key"], pdf["family"], pdf["units"], pdf["before"]):
                out += [(k, lang, n) for lang, n in languages(lexer(f).read(list(c), a), model).items()]
            yield pd.DataFrame(out, columns=["key", "lang", "n"]).astype({"key": "int64", "n": "int64"})

    rows = spread(rows, "key")
    small = rows.where(F.length("text") <= chunk).mapInPandas(whole, "key long, lang string, n long")
    pieces = rows.where(F.length("text") > chunk).mapInPandas(chunks, "key long, family string, seq int, units array<string>")
    pieces = written(pieces.repartition("key", "seq"))
    fs = pieces.mapInPandas(functions, "key long, seq int, f array<int>").withColumn("part", F.floor(F.col("seq") / FAN).cast("int"))
    groups = fs.groupBy("key", "part").applyInPandas(composed, "key long, part int, f array<int>")  # a few numbers for each chunk, no text
    enter = groups.groupBy("key").applyInPandas(entered, "key long, part int, enter int")
    at = fs.join(enter, ["key", "part"]).groupBy("key", "part").applyInPandas(starts, "key long, seq int, before int")
    large = pieces.join(at, ["key", "seq"]).mapInPandas(read, "key long, lang string, n long")
    return small.unionByName(large).groupBy("key", "lang").agg(F.sum("n").alias("n_chars"))


def _comments(spark, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/files.parquet").select("file_id", F.col("normed_ext").alias("ext"), "real_ext")
    c = spark.read.parquet(f"{sf_dir}/code_comments.parquet").select("comment_id", "file_id", "comment_text", "comment_source")
    # what a comment says without its marks stands in where its source is missing
    text = F.coalesce("comment_source", F.concat(F.lit("/* "), F.col("comment_text"), F.lit(" */")))
    c = c.withColumn("text", text)  # a repeated row gives the same languages again; the result's rows are distinct
    return c.join(files, "file_id", "left").select(F.col("comment_id").alias("key"), "ext", "real_ext", "text")


def found(spark, sf_dir: str) -> DataFrame:
    model = fit_model(spark.read.parquet(f"{sf_dir}/files.parquet"))
    return code_languages(_comments(spark, sf_dir), model).select(F.col("key").alias("comment_id"), "lang")


def file_shares(spark, sf_dir: str) -> DataFrame:
    """``file_id, lang, share``: the share of each code file's characters that is natural language."""
    files = spark.read.parquet(f"{sf_dir}/files.parquet")
    model = fit_model(files)
    code = files.where("file_format = 'code'")
    got = code_languages(code.select(F.col("file_id").alias("key"), F.col("normed_ext").alias("ext"), "real_ext", F.col("file_content").alias("text")), model)
    sizes = code.select("file_id", F.length("file_content").alias("size"))
    return got.join(sizes, F.col("key") == F.col("file_id")).select("file_id", "lang", "n_chars", (F.col("n_chars") / F.col("size")).alias("share"))


QUERIES = {"p5_found": found, "p5_file_shares": file_shares}
SQL: dict[str, str] = {}
