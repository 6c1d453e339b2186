"""Text that looks the same in other characters, brought to one form.

Method: values are mapped letter by letter to the letters they look like, grouped under an
accent-sensitive Unicode collation in SQL, one member of each class is chosen as the
canonical one, and it is joined back.

The collation (ICU, tertiary) settles what the map leaves: composed and decomposed accents
compare equal, invisible characters are ignored, case and accents differ.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts with the shape of a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮԌԚԜаеѕіјорсухүԁһԛԝӏ", "ABESIJKMHOPCTXYGQWaesijopcyxydhqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc"))
ARMENIAN = dict(zip("ՍՏՕհոսցօ", "USOhnugo"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏏᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4bRWVSLCPKB"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲬ", "HIKMNOoPpCcTX"))
LIGATURES = dict(zip("ﬀﬁﬂﬃﬄﬅﬆ", ["ff", "fi", "fl", "ffi", "ffl", "st", "st"]))

FULLWIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
SPACES = {c: " " for c in map(chr, [0x09, *range(0x80, 0x3001)]) if c == "\t" or unicodedata.category(c) == "Zs"}
#: Characters without a width: format characters, and the joiner that Unicode files under marks.
INVISIBLE = {c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Cf" and not 0x600 <= ord(c) <= 0x8FF} | {"͏"}



def _compatible() -> dict[str, str]:
    """Letters and digits that Unicode calls another form of one basic letter or digit: mathematical, letter-like, circled... ."""
    out = {}
    for c in map(chr, [*range(0x2100, 0x2200), *range(0x1D400, 0x1D800)]):
        to = unicodedata.normalize("NFKC", c)
        if len(to) == 1 and to != c and to.isalnum():
            out[c] = to
    return out


SHAPES = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC


def _composed() -> dict[str, str]:
    """Composed letters of other scripts whose base has the shape of a Latin letter, as that letter with their accents."""
    out = {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0] in SHAPES and len(to := unicodedata.normalize("NFC", SHAPES[base[0]] + base[1:])) == 1:
            out[c] = to
    return out


LETTERS = SHAPES | _composed() | _compatible() | FULLWIDTH | SPACES


def _accents() -> dict[str, str]:
    """Composed letters to their mapped base; derived from the decompositions, for the prefilter only."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            out.setdefault(LETTERS.get(c, c), LETTERS.get(base[0], base[0]))
    return out


ACCENTED = _accents()


def _translate(col: Column, table: dict[str, str], drop: set[str] = frozenset()) -> Column:
    keys = list(table) + sorted(drop)
    return F.translate(col, "".join(keys), "".join(table[k] for k in table))


def mapped(col: Column) -> Column:
    """The value in the letters it looks like; equal looks are then equal under the collation."""
    for k, v in LIGATURES.items():
        col = F.replace(col, F.lit(k), F.lit(v))
    return _translate(col, LETTERS, INVISIBLE)


def base_key(col: Column) -> Column:
    """``mapped`` without any accents: equal looks have equal keys, so it finds candidates in an equi-join."""
    return F.regexp_replace(_translate(mapped(col), ACCENTED), r"\p{M}+", "")


def _class(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


#: A value without any of these is its own mapped form.
ODD = "[\\p{M}" + _class("".join(k for k in [*LETTERS, *LIGATURES, *sorted(INVISIBLE)])) + "]"
#: A character that ASCII text doesn't have; a tab may stand for a space.
BEYOND = r"[^\x00-\x7f]|\t"
WORD = r"[\p{L}\p{N}\p{M}\p{Cf}_]"
GAP = r"[\p{Zs}\t]"


def canonical_forms(values: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``value, canonical, anchored``: every distinct value with the one that stands for its class.

    ``values(value)`` may repeat and hold nulls (left out) and empty strings (a class of their
    own). A class is a group of values equal under the collation ``UNICODE`` after the letters
    are mapped. Its canonical member is an anchor where it has one, else the value with the
    fewest odd characters, then the first in binary order; so ties are settled. With
    ``anchors(value)`` given only classes with an anchor come out. Grouping and join run on
    distinct values, so the number of copies makes no skew; the class is joined back on its
    mapped form under the collation.
    """
    v = values.select("value").where("value IS NOT NULL").distinct().withColumn("is_anchor", F.lit(False))
    if anchors is not None:
        a = anchors.select("value").where("value IS NOT NULL").distinct()
        near = a.select(base_key(F.col("value")).alias("near")).distinct()
        v = v.withColumn("near", base_key(F.col("value"))).join(near, "near", "left_semi").drop("near")
        v = v.join(a, "value", "left_anti").unionByName(a.withColumn("is_anchor", F.lit(True)))
    v = v.withColumn("form", F.collate(mapped(F.col("value")), "UNICODE"))
    odd = F.regexp_count("value", F.lit(ODD))
    rank = F.struct((~F.col("is_anchor")).alias("a"), odd.alias("b"), F.col("value").alias("c"))
    classes = v.groupBy("form").agg(F.min(rank).alias("best"))
    out = v.join(classes, "form").select("value", F.col("best.c").alias("canonical"), (~F.col("best.a")).alias("anchored"))
    return out.where("anchored") if anchors is not None else out


def windows(text: Column, most_words: int) -> Column:
    """All runs of one to ``most_words`` whole words with single spaces between them, overlapping ones too.

    A word is letters, digits, marks, underscores and invisible characters; a line break is no space.
    """
    runs = [F.regexp_extract_all(text, F.lit(f"(?<!{WORD})(?=({WORD}+(?:{GAP}{WORD}+){{{k}}})(?!{WORD}))"), 1) for k in range(most_words)]
    return F.array_distinct(F.concat(*runs)) if len(runs) > 1 else F.array_distinct(runs[0])


def look_alikes(records: DataFrame, terms: DataFrame, most_words: int | None = None, whole: bool = False) -> DataFrame:
    """``record_id, term_id`` where a record holds a term in characters other than the term's own.

    ``records(record_id, text)``; ``terms(term_id, term)``. With ``whole`` the entire text must
    look like the term, else an occurrence that is no part of a longer word. Null texts, null
    terms and empty terms find nothing. Several ids of one term all come out. Each pair comes
    out once, however often it occurs. The vocabulary is joined, never collected.
    """
    terms = terms.where("term IS NOT NULL AND term <> ''").select("term_id", "term")
    # ASCII text looks like a term in other characters only if such a term's own mapped form is ASCII
    ascii_form = (F.col("term").rlike(BEYOND)) & ~mapped(F.col("term")).rlike(BEYOND)
    everything = terms.where(ascii_form).limit(1).count() > 0
    may = lambda c: F.lit(True) if everything else F.col(c).rlike(BEYOND)
    if whole:
        cand = records.select("record_id", F.col("text").alias("value")).where(may("value"))
    else:
        if most_words is None:
            got = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0]
            most_words = got or 1
        cand = records.where(may("text")).select("record_id", F.explode(windows(F.col("text"), most_words)).alias("value"))
        cand = cand.where(may("value"))
    keys = terms.select(base_key(F.col("term")).alias("near")).distinct()
    cand = cand.withColumn("near", base_key(F.col("value"))).join(keys, "near", "left_semi").select("record_id", "value").distinct()
    forms = canonical_forms(cand.select("value"), terms.select(F.col("term").alias("value")))
    hit = forms.where("value <> canonical").join(terms, F.col("canonical") == F.col("term")).select("value", "term_id")
    return cand.join(hit, "value").select("record_id", "term_id").distinct()


def found(spark, sf_dir: str) -> DataFrame:
    terms = spark.read.parquet(f"{sf_dir}/vocab_terms.parquet").select("term_id", "term")
    alerts = spark.read.parquet(f"{sf_dir}/alerts.parquet").select(F.col("alert_id").alias("record_id"), F.col("match_text").alias("text"))
    files = spark.read.parquet(f"{sf_dir}/files.parquet").where("file_format = 'text'").select(F.col("file_id").alias("record_id"), F.col("file_content").alias("text"))
    a = look_alikes(alerts, terms, whole=True).select(F.lit("alert").alias("record_kind"), "record_id", "term_id")
    f = look_alikes(files, terms).select(F.lit("file").alias("record_kind"), "record_id", "term_id")
    return a.unionByName(f)



def canonical_matches(spark, sf_dir: str) -> DataFrame:
    """Every distinct ``match_text`` with the value that stands for all that look like it."""
    alerts = spark.read.parquet(f"{sf_dir}/alerts.parquet")
    return canonical_forms(alerts.select(F.col("match_text").alias("value"))).select("value", "canonical")


QUERIES = {"p3_found": found, "p3_canonical": canonical_matches}
SQL: dict[str, str] = {}
