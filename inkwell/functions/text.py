"""Scalar text functions: as Spark columns where the built-ins can say it, in Python where not."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary in ASCII that Java reads as Python and SQL engines read ``\\b``.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def sanitized(c: Column) -> Column:
    """Line feeds alone as line ends, and the quote entity as its character."""
    c = F.replace(c, F.lit("&rsquo;"), F.lit("'"))
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def sentence_count(c: Column) -> Column:
    """Runs of closing marks, one at least where the text has words."""
    n = F.regexp_count(c, F.lit(r"[.!?。！？।؟]+"))
    return F.when(word_count(c) > 0, F.greatest(n, F.lit(1))).otherwise(F.lit(0))


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def long_word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}{7,}"))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset from 0."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, offset: Column) -> Column:
    """The column, from 1, of an offset from 0."""
    return (F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1).cast("int")


def paragraphs(c: Column) -> Column:
    """Pieces of a text with the blank line that ends each; splits don't overlap, a last piece may be empty."""
    parts = F.split(c, "\n\n", -1)
    return F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n\n"))).otherwise(x))


def cap_first(c: Column) -> Column:
    """A capital first, of letters in ASCII alone."""
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.concat(F.translate(F.substring(c, 1, 1), small, large), F.substring(c, F.lit(2), F.length(c)))


def ascii_shape(c: Column) -> Column:
    """The text with every character beyond printable ASCII as a question mark, so that engines measure its edits alike."""
    return F.regexp_replace(c, r"[^ -~]", "?")


def titled(c: Column) -> Column:
    """A capital after each character that parts words, the rest as it is; letters, digits and ``_`` don't part words."""
    parts = F.split(c, r"(?<=[\x00-/:-@\[-^`{-\x7f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])", -1)
    first = lambda x: F.upper(F.substring(x, 1, 1))
    # a letter whose capital is more than one (ß) stays
    return F.array_join(F.transform(parts, lambda x: F.when(F.length(first(x)) == 1, F.concat(first(x), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)), "")


def masked(c: Column) -> Column:
    """Every character but line feeds as a star, the length kept."""
    return F.regexp_replace(c, r"[^\n]", "*")


def is_letters(c: Column) -> Column:
    return c.rlike(r"^\p{L}*$")


def is_code(c: Column) -> Column:
    """Nothing but the characters that masked code is made of."""
    return c.rlike(r"^[*@\s]*$")


def is_phrase(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N} -]*$") & (F.length(c) > 0)


def plain_markdown(c: Column) -> Column:
    """Markdown without its marks, by ordered replacements."""
    for pattern, to in (
        (r"(?m)^ {0,3}(```|~~~)[^\n]*$", ""), (r"(?m)^ {0,3}#{1,6}\s+", ""), (r"(?m)^ {0,3}>\s?", ""), (r"(?m)^\s*(?:[-*+]|\d+[.)])\s+", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*\*|__)(.+?)\1", "$2"), (r"(?<![\w*])[*_](?=\S)(.+?)(?<=\S)[*_](?![\w*])", "$1"), (r"`([^`]*)`", "$1"), (r"(?m)^ {0,3}(?:[-*_]\s*){3,}$", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def fixed(match: Column, name: Column, params: Column) -> Column:
    """What an action makes of a match, null where it needs more than the match: ``replace``, ``remove``, ``edit``, ``convert``."""
    first, second, third = F.get(params, F.lit(0)), F.get(params, F.lit(1)), F.get(params, F.lit(2))
    edit = (
        F.when(first == "trim", F.trim(match)).when(first == "trim_left", F.ltrim(match)).when(first == "trim_right", F.rtrim(match))
        .when((first == "truncate") & second.isNotNull(), F.get(F.split(match, F.concat(F.lit("\\Q"), F.coalesce(second, F.lit("")), F.lit("\\E"))), F.lit(0)))
        .when((first == "regex") & second.isNotNull(), F.regexp_replace(match, F.coalesce(second, F.lit("(?!)")), F.coalesce(third, F.lit(""))))
    )
    convert = F.when(first == "simple", F.lower(match)).otherwise(F.lower(match))
    return F.when(name == "replace", first).when(name == "remove", F.lit("")).when(name == "edit", edit).when(name == "convert", convert)


# ---------------------------------------------------------------- Python side

# The characters trimmed from an edited match.
BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GROUP = re.compile(r"\$(?:(\$)|([0-9A-Za-z_]+)|\{([0-9A-Za-z_]+)\})")


def _filled(template: str, m: re.Match) -> str:
    """A template with ``$1``, ``$name``, ``${name}`` and ``$$``; groups that aren't there are empty."""

    def each(g: re.Match) -> str:
        name = g.group(2) or g.group(3)
        if name is None:
            return "$"
        if name.isdigit():
            return (m.group(int(name)) or "") if int(name) <= m.re.groups else ""
        return m.groupdict().get(name) or ""

    return _GROUP.sub(each, template)


def _replaced(pattern: str, template: str, text: str) -> str:
    """All matches filled in; an empty match right after another one isn't a match."""
    out, at = [], None
    for m in re.compile(pattern, re.ASCII).finditer(text):
        if m.end() != at:
            out += [text[at or 0 : m.start()], _filled(template, m)]
            at = m.end()
    return "".join(out) + text[at or 0 :]


def _edited(match: str, params: list[str]) -> str:
    name, n = params[0], len(params)
    if name in ("regex", "split") and n != 3 or name in ("trim", "trim_left", "trim_right", "truncate") and n != 2:
        raise ValueError("invalid number of parameters")
    if name == "regex":
        try:
            return _replaced(params[1], params[2], match)
        except re.error as e:
            raise ValueError(f"error parsing regexp: {e}") from e
    if name in ("trim", "trim_left", "trim_right"):
        return {"trim": str.strip, "trim_left": str.lstrip, "trim_right": str.rstrip}[name](match, params[1])
    if name in ("truncate", "split"):
        parts = match.split(params[1]) if params[1] else list(match)
        if name == "truncate":
            return parts[0] if parts else ""
        if not re.fullmatch(r"[+-]?[0-9]+", params[2]):
            raise ValueError(f'strconv.Atoi: parsing "{params[2]}": invalid syntax')
        if not 0 <= int(params[2]) < len(parts):
            raise ValueError("index out of range")
        return parts[int(params[2])]
    return match


#: Callables for ``suggest``, by name: a match to suggestions. They are looked up where an alert is fixed, so a cluster's workers import them.
ACTIONS: dict[str, Callable[[str], list[str]]] = {}


def solution(match: str | None, name: str | None, params: list[str] | None) -> tuple[list[str], str | None]:
    """All suggestions of an action for a match, and what went wrong; ``suggest spellings`` isn't for this function."""
    match, params = match or "", [p or "" for p in (params if params is not None else [])]
    if name == "replace":
        return params, None
    if name == "remove":
        return [""], None
    if name not in ("suggest", "edit", "convert"):
        return [], f"unknown action '{name or ''}'"
    if not params:
        return [], "no parameters"
    if name == "suggest":
        if (own := ACTIONS.get(params[0])) is None:
            return [], f"script '{params[0]}' not found"
        try:
            return [str(x) for x in own(match)], None
        except Exception as e:  # a script's own failure is its answer
            return [], str(e)
    if name == "convert":
        return [match.lower() if params[0] == "simple" else match], None
    try:
        return [_edited(match, params).strip(BLANK)], None
    except ValueError as e:
        return [], str(e)


# Words that stay in lower case inside a title, by style.
SMALL = {
    "AP": set("a an and as at but by en for if in of on or the to v via vs nor".split()),
    "Chicago": set("a an and as at but by en for if in of on or the to v via vs nor into from with over up".split()),
}
TITLE_WORD = re.compile(r"[^\W_*]*[*\w]\S*", re.UNICODE)


def title_case(text: str, style: str = "AP") -> str:
    """Title case: the first and last word, and all but the small words."""
    ms = list(TITLE_WORD.finditer(text))
    out = list(text)
    for i, m in enumerate(ms):
        w = m.group()
        edge = i in (0, len(ms) - 1) or text[: m.start()].rstrip().endswith(":")
        new = w.lower() if w.lower() in SMALL[style] and not edge else w if w[1:] != w[1:].lower() else w[:1].upper() + w[1:]
        out[m.start() : m.end()] = list(new)
    return "".join(out)


def sentence_case(text: str) -> str:
    """The first word with a capital, the rest in lower case."""
    first = True

    def each(m: re.Match) -> str:
        nonlocal first
        w = m.group()
        new = w[:1].upper() + w[1:].lower() if first else w.lower()
        first = False
        return new

    return TITLE_WORD.sub(each, text)


_CASES = {"lower": str.lower, "upper": str.upper, "title": lambda w: w[:1].upper() + w[1:].lower(), "mixed": lambda w: w}


def case_of(text: str) -> str:
    """``lower``, ``upper`` (of two letters or more), ``title`` (a capital first, none later), else ``mixed``; no letters are ``mixed``."""
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return "mixed"
    if all(c.islower() for c in letters):
        return "lower"
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return "upper"
    return "title" if letters[0].isupper() and not any(c.isupper() for w in text.split() for c in w[1:]) else "mixed"


def recase(like: str, text: str) -> str:
    """``text`` in the case of ``like``.

    Words that both begin or end with keep the case they have in ``like``, each its own; what was
    changed between them takes the case of what it stands for, as one piece: a capital for its
    first word only, unless every word it stands for has one. Where nothing stands there, the next
    word tells, else the one before. Mixed case tells nothing and leaves the text as it is.
    """
    new, old = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text), re.findall(r"[^\W_]+(?:['’][^\W_]+)*", like)
    if not new or not old:
        return text
    same = lambda a, b: a.lower() == b.lower()
    head = next((i for i, (a, b) in enumerate(zip(new, old)) if not same(a, b)), min(len(new), len(old)))
    room = min(len(new), len(old)) - head
    tail = next((i for i in range(room) if not same(new[-1 - i], old[-1 - i])), room)
    middle = old[head : len(old) - tail]
    told = " ".join(middle) or (old[len(old) - tail] if tail else old[head - 1])
    case, every = case_of(told), bool(middle) and all(case_of(w) in ("title", "upper") and w[:1].isupper() for w in middle) and len(middle) > 1
    if every and case == "mixed" and all(case_of(w) == "title" for w in middle):
        case = "title"
    out, at = [], 0
    for i, w in enumerate(new):
        k = text.index(w, at)
        if i < head:
            c = case_of(old[i])
        elif i >= len(new) - tail:
            c = case_of(old[i - len(new)])
        else:
            c = "lower" if case == "title" and i > head and not every else case
        out += [text[at:k], _CASES[c](w)]
        at = k + len(w)
    return "".join(out) + text[at:]


def syllables(word: str) -> int:
    """Groups of vowels, without a silent last e; one at least."""
    w = re.sub(r"[^a-z]", "", word.lower())
    if not w:
        return 0
    n = len(re.findall(r"[aeiouy]+", w))
    if w.endswith("e") and not w.endswith(("le", "ee")) and n > 1:
        n -= 1
    if w.endswith(("es", "ed")) and n > 1 and not w.endswith(("tes", "ses", "zes", "ces", "ges", "ted", "ded", "ies")):
        n -= 1
    return max(1, n)


def metrics_of(text: str) -> dict[str, float]:
    """Counts of a summary text, with those that readability formulas take."""
    words = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", text)
    counts = [syllables(w) for w in words]
    sentences = max(1, len(re.findall(r"[.!?]+(?=\s|$)", text))) if words else 0
    hard = lambda w, n: n >= 3 and not (w[:1].isupper() or w.endswith(("es", "ed", "ing")) and n - 1 < 3)
    return {
        "words": float(len(words)), "sentences": float(sentences), "characters": float(sum(c.isalpha() for c in text)), "syllables": float(sum(counts)),
        "complex_words": float(sum(hard(w, n) for w, n in zip(words, counts))), "long_words": float(sum(len(w) > 6 for w in words)), "polysyllabic_words": float(sum(n >= 3 for n in counts)),
    }


_ENDS = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s+[^\sa-zß-ÿ])|[.!?…]+[\"'”’»)\]]*\s*$|[。！？]+[」』”]*|\n\s*\n")
_SHORT = re.compile(r"[\"'(]*(?:[A-Z]|Mr|Mrs|Ms|Dr|Prof|St|vs|etc|e\.g|i\.e|No|Fig|al|cf|approx)")


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of sentences by closing marks before a space and a capital; known short forms don't end one."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        if m.group().rstrip("\"'”’»)] \n") == ".":
            left = text[max(at, m.start() - 12) : m.start()].rsplit(None, 1)[-1:] or [""]  # no short form is longer
            if _SHORT.fullmatch(left[0]):
                continue
        out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed
