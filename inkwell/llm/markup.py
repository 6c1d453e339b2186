"""Markup to clean text that keeps its structure.

Method: every format is read into the leaf blocks of a small document tree; a linear-chain
conditional random field over the leaves, with ancestor tags and text figures as features,
trained on labelled pages, says what each leaf is (Viterbi); the text inside is cleaned by
the format's rules.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from inkwell.llm.crf import LinearChainCRF
from inkwell.llm.inline import Cleaner, squeeze, undelimited
from inkwell.llm.leaves import Leaf, guess_format, leaves_of
from inkwell.llm.pages import LABELS, PAGES_PER_FORMAT, page
from inkwell.session import spread

FORMS = ["md", "html", "rst", "org", "adoc", "wiki", "tex"]
_MARK = re.compile(r"zq\d+x\d+qz")


_REPEAT, _NUMBER = re.compile(r"(.)\1+"), re.compile(r"\d+|^[a-zA-Z](?=[.)])")


_START = re.compile(r"\\[a-z]+|<[a-z]+|[{\[<|:!.]{1,2}")  # a command or tag that the text itself begins with


def _shape(mark: str) -> str:
    """A mark with its numbers and its length left out: ``####`` as ``#+``, ``12.`` as ``0.``."""
    return _REPEAT.sub(r"\1+", _NUMBER.sub("0", mark.lower()))


def features(leaves: list[Leaf]) -> list[list[str]]:
    """Per leaf: its ancestors (last, pair, each), the mark it opens with, and figures of its text and place."""
    out = []
    for i, x in enumerate(leaves):
        t = x.text.strip()
        letters = sum(map(str.isalpha, t)) / max(1, len(t))
        form = x.tags[0]
        shape = _shape(x.mark)
        out.append(
            ["bias", f"form={form}", f"tag={x.tags[-1]}", f"pair={x.tags[-2:]}", f"mark={form} {shape}", f"sign={form} {shape[:2]}", f"len={min(len(t).bit_length(), 8)}"]
            + [f"in={a}" for a in set(x.tags[1:])] + [f"word={w}" for w in re.findall(r"[a-z]{2,}", shape)]
            + [f"letters={int(letters * 5)}", f"end={'stop' if t[-1:] in '.!?:。！？' else 'other'}", f"depth={min(x.depth, 3)}", f"first={i == 0}", f"lines={min(t.count(chr(10)), 3)}", f"bare={letters == 0}"]
            + ([f"starts={form} {m.group()}"] if (m := _START.match(t)) else [])
            + ([f"has={c}" for c in ("\\", "{", "\x00", "://") if c in t])
        )
    return out


def labelled(form: str, seed: int) -> tuple[list[list[str]], list[str]]:
    """A labelled page as the model sees it."""
    text, marks = page(form, seed)
    leaves = leaves_of(text, form)
    ys = []
    for x in leaves:
        # a leaf's last tag counts as well: the marker of a definition can stand in its mark
        m = _MARK.search(x.text) or _MARK.search(x.attrs)
        ys.append(marks[m.group()] if m else "drop")
        x.text, x.attrs = _MARK.sub("x", x.text), _MARK.sub("x", x.attrs)  # the model doesn't see the marker
    return features(leaves), ys


@lru_cache(maxsize=1)
def block_model(pages_per_format: int = PAGES_PER_FORMAT) -> LinearChainCRF:
    pages = [labelled(form, seed) for seed in range(pages_per_format) for form in FORMS]
    return LinearChainCRF(LABELS).fit(pages)


def units(text: str | None, normed_ext: str | None = None, real_ext: str | None = None, model: LinearChainCRF | None = None) -> list[tuple[str, int, str]]:
    """``(kind, level, text)`` of one document, in order. Null and blank texts have none."""
    if not text or not text.strip():
        return []
    leaves = [x for x in leaves_of(text, guess_format(text, normed_ext, real_ext))]
    out: list[tuple[str, int, str]] = []
    for x, kind in zip(leaves, (model or block_model()).decode(features(leaves))):
        if kind == "drop":
            continue
        if kind == "code":
            body = x.text
            if x.form == "html":
                c = Cleaner("html")
                body = c.clean(re.sub(r"\\", lambda m: c.hold("\\"), body))
            if body.strip():
                out.append(("code", 0, squeeze(body)))
            continue
        if kind == "formula":
            c = Cleaner("html") if x.form == "html" else None
            body = undelimited(x.text if c is None else re.sub(r"<[^>]*>", "", x.text))
            if c:
                import html

                body = html.unescape(body)
            if body:
                out.append(("formula", 0, squeeze(body)))
            continue
        if kind == "row":
            cells, formulas = [], []
            for cell in x.text.split("\x00"):
                c = Cleaner(x.form)
                cells.append(c.clean(cell))
                formulas += c.formulas
            body = " | ".join(cells).strip()
        else:
            c = Cleaner(x.form)
            body, formulas = c.clean(x.text.replace("\x00", " ")), c.formulas
        if body and formulas == [body] and kind == "para":
            out.append(("formula", 0, body))  # a formula displayed in a paragraph of its own
            continue
        if body:
            out.append((kind, max(1, x.depth) if kind in ("heading", "item") else 0, body))
        out += [("formula", 0, f) for f in formulas]
    return out


def markup_units(docs: DataFrame, key: str = "file_id", text: str = "file_content", normed_ext: str = "normed_ext", real_ext: str = "real_ext") -> DataFrame:
    """``key, unit_kind, unit_level, unit_text``: the distinct units of every document.

    Kinds are ``heading``, ``item``, ``para``, ``row``, ``code`` and ``formula``. Endings are
    hints and may be null or wrong. Null and blank texts give no rows; a document of any length
    is read whole; repeated units of a document come out once. A repeated document under
    another key has its own rows. There is no shuffle (but of tables smaller than the cluster): each document is
    worked on where it lies, and the model (a few thousand weights) travels with the task.
    """
    model = block_model()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t, n, r in zip(pdf["k"], pdf["t"], pdf["n"], pdf["r"]):
                rows += [(k, *u) for u in dict.fromkeys(units(t, n, r, model))]
            yield pd.DataFrame(rows, columns=["k", "unit_kind", "unit_level", "unit_text"]).astype({"k": "int64", "unit_level": "int32"})

    cols = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t", f"`{normed_ext}` AS n", f"`{real_ext}` AS r").where("k IS NOT NULL AND t IS NOT NULL")
    return spread(cols, "k").mapInPandas(run, "k long, unit_kind string, unit_level int, unit_text string").withColumnRenamed("k", key)


def found(spark, sf_dir: str) -> DataFrame:
    return markup_units(spark.read.parquet(f"{sf_dir}/files.parquet").where("file_format = 'markup'"))


QUERIES = {"p4_found": found}
SQL: dict[str, str] = {}
