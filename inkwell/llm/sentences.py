"""Sentence boundaries across languages and scripts.

Method: abbreviations, collocations and sentence starters are learned per language without
supervision, by log-likelihood ratios over the counts of all texts; each period is then
classified with these statistics. Quotations, brackets, and scripts with their own marks or
none are handled around that. Every step is linear in the length of a text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import bounded, release, spread, written

ABBREV_LEVEL, COLLOC_LEVEL, STARTER_LEVEL = 0.3, 7.88, 30.0
FINAL_SHARE, ENDER_SHARE = 0.93, 0.5
LANG_WORDS = 60  # the most frequent types of a language, to tell the language of texts that don't state it

# Marks that end a sentence, and pairs of quotation marks and brackets.
HARD = set("!?。！？؟।॥‼⁇⁈⁉．｡۔")
QUOTES = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", '"': '"', "»": "«"}
BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】"}
CLOSERS = set("”»“」』›\")]）】’'")
# Words that attribute a quotation, for scripts without case.
ATTRIBUTES = ("と", "って", "问", "說", "说", "答", "写道", "写", "喊", "पूछा", "कहा", "लिखा", "قال", "سأل", "كتب")

_OPENED_BY: dict[str, list[str]] = {}
for _o, _cs in (QUOTES | BRACKETS).items():
    for _c in _cs:
        if _o != '"':
            _OPENED_BY.setdefault(_c, []).append(_o)

_BREAK = r"(?:\r\n|\n|\r(?!\n))"
_PARA = re.compile(rf"{_BREAK}[^\S\r\n]*{_BREAK}\s*")
_WORD = re.compile(r"\S+")
_CLOSE = "".join(CLOSERS)
_STRIP = "“”«»„‘’'\"()[]{}「」『』（），,;:¿¡—–-…"
_NUMBER = re.compile(r"^[\d.,]*\d[\d.,]*%?$")
_THAI = re.compile("[฀-๿]")


WIDE_TYPE = 40  # a longer type is known by its 128-bit hash, which keeps it distinct and its row short
_MEMO = 400_000  # tokens whose reading a worker remembers


def _read(raw: str) -> tuple[str | None, bool, int, bool, bool]:
    """``(type, has a period, case, ends hard, ends a sentence as far as it shows)`` of a token; case is 1 upper, -1 lower, 0 none."""
    core = raw.strip(_STRIP)
    while core and core[-1] in HARD:
        core = core[:-1].rstrip(_STRIP)
    hard = any(c in HARD for c in raw[-3:])
    base = core.rstrip(".")
    if not base:
        return None, False, 0, hard, hard
    dots = len(core) - len(base)
    return _key(base.lower()), dots == 1, base[:1].isupper() - base[:1].islower(), hard, hard or dots > 0 or raw[-1] == ":"


class _Tokens(dict):
    """Tokens as ``_read`` reads them, each once; text repeats its tokens, so most are looked up."""

    def __missing__(self, raw: str):
        if len(self) >= _MEMO:
            self.clear()
        got = _read(raw)
        if len(raw) <= 4 * WIDE_TYPE:
            self[raw] = got
        return got


_TOKENS = _Tokens()


def words(text: str):
    """``(type, has a period, case, begins a sentence, ends hard)`` for each token of a paragraph."""
    fresh = True
    for kind, dot, case, hard, ends in map(_TOKENS.__getitem__, text.split()):
        if kind is None:
            fresh = fresh or hard
        else:
            yield kind, dot, case, fresh, hard
            fresh = ends


def _key(w: str) -> str:
    if _NUMBER.match(w):
        return "##number##"
    return w if len(w) <= WIDE_TYPE else "##" + xxhash.xxh3_128_hexdigest(w)


@dataclass
class Model:
    """What was learned of one language."""

    abbreviations: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    lower: set[str] = field(default_factory=set)  # types met in lower case, of those that follow a period that may not end
    enders: set[str] = field(default_factory=set)  # abbreviations after which a capital mostly is a sentence starter's

    def ends(self, left: str, right: str) -> bool:
        """Whether the period after ``left`` ends a sentence when the token ``right`` comes next."""
        kind = _TOKENS[left][0]
        if kind is None:
            return True
        nxt = right.lstrip(_STRIP)
        w = left.strip(_STRIP).rstrip(".")
        initial = len(w) == 1 and w.isalpha() and (w.isascii() or w.isupper() or kind in self.abbreviations)
        known = kind in self.abbreviations or initial
        if not nxt:
            return not (kind in self.abbreviations or len(w) == 1 and w.isalpha()) or right[:1] in "“«„¿¡「\"("
        n = _TOKENS[right][0] or ""
        if (kind, n) in self.collocations:
            return False
        if kind == "##number##" and kind not in self.abbreviations:
            return not nxt[0].islower()
        if not known or right[:1] in "¿¡":
            return True
        if nxt[0].islower() or nxt[0].isdigit():
            return False
        if re.match(r"[^\W\d_]\.", nxt):
            return kind in self.enders  # an initial comes next
        return kind in self.enders or n in self.starters or nxt[0].isupper() and n in self.lower


def _gap(c0, c1):
    return F.col(c0) + F.col(c1)


def _log_likelihood(k, n, p):
    """The logarithm of a binomial likelihood, safe at 0 and 1."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _association(both, first, second, total):
    """Dunning's log-likelihood ratio that ``second`` follows ``first`` more often than elsewhere."""
    p, p1, p2 = second / total, both / first, (second - both) / F.greatest(total - first, F.lit(1))
    ratio = _log_likelihood(both, first, p) + _log_likelihood(second - both, total - first, p) - _log_likelihood(both, first, p1) - _log_likelihood(second - both, total - first, p2)
    return F.when(p1 > p2, -2 * ratio).otherwise(F.lit(0.0))


def _count_types(common):
    def run(batches):
        for pdf in batches:
            n: dict[tuple[str, str], list[int]] = {}
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if not text:
                    continue
                lang = placed(lang, text, common)
                for para in _PARA.split(text):
                    for kind, dot, case, fresh, _ in words(para):
                        row = n.setdefault((lang, kind), [0, 0, 0, 0])
                        row[dot] += 1
                        row[2] += case < 1
                        row[3] += case == 1 and not fresh
            yield pd.DataFrame([(*k, *v) for k, v in n.items()], columns=["lang", "type", "c0", "c1", "low", "up"])

    return run


def _types(rows: DataFrame, common: dict[str, set[str]]) -> DataFrame:
    return _summed(rows.mapInPandas(_count_types(common), "lang string, type string, c0 long, c1 long, low long, up long"))


def _summed(types: DataFrame) -> DataFrame:
    return types.groupBy("lang", "type").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "low", "up")])


def _count_pairs(models, common):
    def run(batches):
        for pdf in batches:
            n: Counter = Counter()
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if not text:
                    continue
                lang = placed(lang, text, common)
                m = models.get(lang)
                if m is None:
                    continue
                for para in _PARA.split(text):
                    before = None
                    for raw in para.split():
                        kind, dot, case, hard, _ = _TOKENS[raw]
                        if kind is None:
                            before = ("start", "") if hard else before
                            continue
                        if before is not None and (case >= 0 or before[0] != "start"):
                            n[(lang, *before, kind, case >= 0 and kind != "##number##")] += 1
                        if hard:
                            before = ("start", "")
                        elif dot and (kind in m.abbreviations or len(kind) == 1 or kind == "##number##"):
                            before = ("pair", kind)
                        elif raw.rstrip(_CLOSE).endswith(("…", "..")):
                            before = ("asked", "")
                        else:
                            before = ("start", "") if dot else None
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["lang", "what", "first", "second", "open", "n"])

    return run


def learn(texts: DataFrame, most: int = 2_000_000) -> tuple[dict[str, Model], dict[str, set[str]]]:
    """Models by language, and each language's most frequent words, from ``texts(lang, text)``.

    All texts count. One pass counts types and one counts what follows candidates and sentence
    ends; both results are written, so neither is counted twice. The frequent words are those of
    texts that state their language; the others are placed by them, see ``placed``, and only
    they are read in a pass of their own. Counts are added up before the shuffle and after it, and
    no type is left out for being rare; the driver gets only types that pass the ratios, and
    types in lower case that follow a period or an ellipsis that may not end a sentence.
    """
    rows = texts.select(F.nullif(F.lower("lang"), F.lit("")).alias("lang"), "text").where("text IS NOT NULL")
    stated = written(_types(rows.where("lang IS NOT NULL"), {}))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(_gap("c0", "c1")), "type"))
    top = stated.where("type NOT LIKE '##%'").withColumn("rank", rank).where(F.col("rank") <= LANG_WORDS)
    common: dict[str, set[str]] = {}
    for r in bounded(top.select("lang", "type"), 10_000 * LANG_WORDS, "the common words"):
        common.setdefault(r["lang"], set()).add(r["type"])

    types = written(_summed(stated.unionByName(_types(rows.where("lang IS NULL"), common))))
    release(stated)
    sums = bounded(types.groupBy("lang").agg(F.sum(_gap("c0", "c1")).alias("n"), F.sum("c1").alias("dots")), 10_000, "the table of languages")
    totals = types.sparkSession.createDataFrame([tuple(r) for r in sums], "lang string, n long, dots long")
    known = types.join(F.broadcast(totals), "lang")
    n, k, p = _gap("c0", "c1"), F.col("c1"), F.col("dots") / F.col("n")
    core = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - core + 1
    ratio = -2 * (_log_likelihood(k, n, p) - _log_likelihood(k, n, F.lit(0.99)))
    # a type is weighed by its length, its inner periods, and how often it stands without its period
    score = F.when(F.col("type") == "##number##", F.when(F.col("c1") > F.col("c0"), 1.0).otherwise(0.0)).otherwise(
        ratio * F.exp(-core.cast("double")) * inner * F.pow(F.greatest(core, F.lit(1)).cast("double"), -F.col("c0").cast("double"))
    )
    cand = known.where((F.col("c1") > 0) & F.col("type").rlike(r"^[\p{L}\p{M}.\-]+$|^##number##$")).where(score >= ABBREV_LEVEL)
    models: dict[str, Model] = {r["lang"]: Model() for r in sums}
    for r in bounded(cand.select("lang", "type"), most, "the abbreviations"):
        models[r["lang"]].abbreviations.add(r["type"])

    pairs = rows.mapInPandas(_count_pairs(models, common), "lang string, what string, first string, second string, open boolean, n long")
    pairs = written(pairs.groupBy("lang", "what", "first", "second", "open").agg(F.sum("n").alias("both")))
    after = known.select("lang", F.col("type").alias("second"), _gap("c0", "c1").alias("of_second"), "n", "c0", "c1")
    first = known.select("lang", F.col("type").alias("first"), F.col("c1").alias("of_first"))
    asked = pairs.where("what <> 'start' AND open").select("lang", F.col("second").alias("type")).distinct()
    for r in bounded(asked.join(known.where("low > 0 AND low >= up").select("lang", "type"), ["lang", "type"]), most, "the types in lower case"):
        models[r["lang"]].lower.add(r["type"])
    starts = pairs.where("what = 'start'").groupBy("lang", "second").agg(F.sum("both").alias("both"))
    breaks = {r["lang"]: r["n"] for r in bounded(starts.groupBy("lang").agg(F.sum("both").alias("n")), 10_000, "the table of languages")}
    breaks = F.broadcast(types.sparkSession.createDataFrame(list(breaks.items()), "lang string, breaks long"))
    s = starts.join(after, ["lang", "second"]).join(breaks, "lang")
    s = s.where(_association(F.col("both"), F.col("breaks"), F.col("of_second"), F.col("n")) > STARTER_LEVEL)
    for r in bounded(s.select("lang", "second"), most, "the sentence starters"):
        models[r["lang"]].starters.add(r["second"])
    # a type that only ever stands before sentence starters ends sentences; it is no abbreviation
    before = pairs.where("what = 'pair'").join(s.select("lang", "second").withColumn("starts", F.lit(1)), ["lang", "second"], "left")
    starter = F.sum(F.when((F.col("starts") == 1) & F.col("open"), F.col("both")).otherwise(0))
    shares = before.groupBy("lang", "first").agg((starter / F.sum("both")).alias("of_all"), F.try_divide(starter, F.sum(F.when(F.col("open"), F.col("both")).otherwise(0))).alias("of_open"))
    for r in bounded(shares.where(F.col("of_open") >= ENDER_SHARE), most, "the types that may end a sentence"):
        models[r["lang"]].enders.add(r["first"])
        if r["of_all"] >= FINAL_SHARE:
            models[r["lang"]].abbreviations.discard(r["first"])
    c = pairs.where("what = 'pair'").groupBy("lang", "first", "second").agg(F.sum("both").alias("both")).where("both > 1").join(after, ["lang", "second"]).join(first, ["lang", "first"]).where("of_first >= both")
    c = c.where(_association(F.col("both"), F.col("of_first"), F.col("of_second"), F.col("n")) > COLLOC_LEVEL)
    for r in bounded(c.select("lang", "first", "second"), most, "the collocations"):
        m = models[r["lang"]]
        if r["second"] not in m.starters:
            m.collocations.add((r["first"], r["second"]))
    release(types, pairs)
    return models, common


def language_of(text: str, common: dict[str, set[str]]) -> str | None:
    """The language whose frequent words the text holds most; ties go to the first by name."""
    n = Counter(_TOKENS[t][0] for t in text.split())
    hits = {lang: sum(n[w] for w in ws) for lang, ws in common.items()}
    best = max(sorted(hits), key=lambda x: hits[x], default=None)
    return best if best is not None and hits[best] else None


def placed(lang: str | None, text: str, common: dict[str, set[str]]) -> str:
    """The language stated for a text, else the one it is told by; texts that tell none are a language of their own, ``""``."""
    return lang.lower() if isinstance(lang, str) and lang else language_of(text, common) or ""


_PAIRED = re.compile("[" + re.escape("".join({*QUOTES, *BRACKETS, *"".join(QUOTES.values()), *BRACKETS.values()})) + "]")


def _pairs_in(s: str) -> dict[int, tuple[int, bool]]:
    """``open: (close, is_quote)`` for the outermost matched quotations and brackets of a paragraph, in one pass over its marks."""
    marks = [(m.start(), m.group()) for m in _PAIRED.finditer(s)]
    if not marks:
        return {}
    first, last = {}, {}
    for k, c in marks:
        first.setdefault(c, k)
        last[c] = k
    reverse = first.get("«", -1) > first.get("»", len(s))  # marks that point inwards
    straight = [k for k, c in marks if c == '"']
    stacks: dict[str, list[int]] = {}
    shut: dict[int, int] = {}
    for k, c in marks:
        for o in _OPENED_BY.get(c, ()):
            if stack := stacks.get(o):
                shut[stack.pop()] = k
        if c != '"' and (c in QUOTES or c in BRACKETS):
            stacks.setdefault(c, []).append(k)
    out, free = {}, 0
    for k, c in marks:
        if k < free:
            continue
        if c == '"':
            if k and s[k - 1].isdigit():
                continue  # inches
            i = bisect_right(straight, k + 1)
            end = straight[i] if i < len(straight) else None
        elif c == "»" and not (reverse and last.get("«", -1) > k):
            continue
        else:
            end = shut.get(k) if c in QUOTES or c in BRACKETS else None
        if end is not None:
            out[k] = (end, c in QUOTES)
            free = end + 1
    return out


def _terminal(s: str, begin: int, at: int) -> bool:
    """Whether the text from ``begin`` to ``at`` ends with a closing mark of a sentence."""
    while at > begin and (s[at - 1].isspace() or s[at - 1] in CLOSERS):
        at -= 1
    return at > begin and (s[at - 1] in HARD or s[at - 1] in ".…")


_CLAUSE = re.compile(r"[^\s。！？!?।؟.，,、「“«]{1,12}")


def _attributed(s: str, at: int, alone: bool) -> bool:
    """Whether what follows a quotation at ``at`` belongs to it; ``alone``: nothing of the sentence stands before it."""
    k = at
    while k < len(s) and s[k].isspace():
        k += 1
    if k == len(s):
        return False
    c = s[k]
    if c in ",，、;:—–-،" or c.islower():
        return True
    if c.isupper() or c in QUOTES or c in BRACKETS or c in "¿¡" or c.isdigit():
        return False
    if not alone:
        return False
    m = _CLAUSE.match(s, k)
    clause = m.group() if m else ""
    if k == at and clause and len(clause) <= 12 and re.match(r"[぀-ヿ一-鿿]", clause):
        return clause.startswith(ATTRIBUTES[:2]) or clause.endswith(ATTRIBUTES[2:9]) and len(clause) <= 8
    return clause.startswith(ATTRIBUTES[9:])


_STOP = "".join(HARD) + ".…"
_SPOT = re.compile(f"[{re.escape(_STOP)}]+|[{re.escape(''.join(QUOTES))}{re.escape(''.join(BRACKETS))}]")
_SPOT_OR_SPACE = re.compile(_SPOT.pattern + r"|\s+")
_OPENING = set(QUOTES) | set(BRACKETS)


def split_paragraph(s: str, model: Model) -> list[tuple[int, int]]:
    """Sentence places in one paragraph; the marks are visited in order, each once."""
    tokens = [(m.start(), m.end()) for m in _WORD.finditer(s)]
    begins = [a for a, _ in tokens]
    thai = len(_THAI.findall(s)) * 3 > sum(b - a for a, b in tokens)
    spots = _SPOT_OR_SPACE if thai else _SPOT
    inside = _pairs_in(s)
    n, k, start = len(s), 0, 0
    cuts: list[int] = []

    def solid(at: int) -> int:
        """The first place from ``at`` on that isn't white space."""
        if at < n and not s[at].isspace():
            return at
        i = bisect_right(begins, at)
        return begins[i] if i < len(begins) else n

    while m := spots.search(s, k):
        k, c = m.start(), s[m.start()]
        if k in inside:
            shut, quote = inside[k]
            alone = solid(start) >= k
            done = _terminal(s, k + 1, shut)
            k = shut + 1
            if done:
                nxt = s[k : k + 1]
                if alone if not quote else not _attributed(s, k, alone) and not (nxt and (nxt in CLOSERS or nxt in _STOP)):
                    cuts.append(k)
                    start = k
        elif c.isspace():
            if not re.search(r"[\r\n]", m.group()):
                cuts.append(k)
                start = m.end()
            k = m.end()
        elif c in _OPENING and c not in _STOP:
            k += 1
        else:
            e, mark = m.end(), m.group()
            while e < n and s[e] in CLOSERS and e not in inside:
                e += 1
            spaced = e >= n or s[e].isspace()
            i = bisect_right(begins, e - 1)  # the first token that begins at or after e
            after = s[e] if not spaced else s[begins[i]] if i < len(begins) else ""
            hard = any(x in HARD for x in mark)
            if hard:
                cut = spaced or any(x in "。！？．｡॥।؟‼" for x in mark) or after in _OPENING
            elif mark != ".":  # an ellipsis
                cut = spaced and bool(after) and begins[0] < k and (after.isupper() or after in "¿¡" or after in QUOTES)
                if cut and not after.isupper() and not s[k - 1].isspace():
                    w = _TOKENS[s[begins[i] : tokens[i][1]]][0]
                    cut = w is None or w in model.starters or w in model.lower
            elif spaced:
                left = s[begins[bisect_right(begins, k) - 1] : k + 1]
                cut = not after or model.ends(left, s[begins[i] : tokens[i][1]])
            else:
                cut = False
            if cut:
                cuts.append(e)
                start = e
            k = e
    out, a = [], 0
    for b in [*cuts, n]:
        x, y = a, b
        while x < y and s[x].isspace():
            x += 1
        while y > x and s[y - 1].isspace():
            y -= 1
        if x < y:
            out.append((x, y))
        a = b
    return out


def split_text(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Sentence places in a whole text. Null and blank texts have none."""
    out, at = [], 0
    for m in [*_PARA.finditer(text or ""), None]:
        end = m.start() if m else len(text or "")
        out += [(at + a, at + b) for a, b in split_paragraph((text or "")[at:end], model)]
        at = m.end() if m else end
    return out


def sentence_units(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, start_at, end_at``: offsets of code points from 0, one row per sentence.

    Rows with a null key or text give nothing, nor do blank texts. A null or unknown language
    is told by the learned frequent words; texts that hold none of these are learned from and
    split as one language. Repeated keys give repeated rows; other columns are not looked at. Two
    passes learn (texts without a language are read once more, to place them), one splits; only
    the counts of types are shuffled.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("k IS NOT NULL AND text IS NOT NULL")
    rows = spread(rows, "k")
    models, common = learn(rows)
    none = Model()

    def run(batches):
        for pdf in batches:
            out = []
            for k, t, lg in zip(pdf["k"], pdf["text"], pdf["lang"]):
                m = models.get(placed(lg, t, common)) or none
                out += [(k, a, b) for a, b in split_text(t, m)]
            yield pd.DataFrame(out, columns=["k", "start_at", "end_at"]).astype("int64")

    return rows.mapInPandas(run, "k long, start_at long, end_at long").withColumnRenamed("k", key)


def found(spark, sf_dir: str) -> DataFrame:
    return sentence_units(spark.read.parquet(f"{sf_dir}/files.parquet").where("file_format = 'text'"), "file_id", "file_content", "lang")


QUERIES = {"p2_found": found}
SQL: dict[str, str] = {}
