"""A small part-of-speech tagger with Penn tags: a lexicon of closed classes, endings, and a few rules of context."""

from __future__ import annotations

import re
from functools import lru_cache

# Our own lexicon of closed classes.
LEXICON = {
    "DT": "a an the this that these those each every some any no another either neither all both", "IN": "of in on at by for with from into over under after before since until about between through during without within upon against because although though while if unless whether as than like per",
    "CC": "and or but nor yet so", "PRP": "i you he she it we they me him her us them myself yourself itself themselves", "PRP$": "my your his its our their", "MD": "can could may might must shall should will would ought", "TO": "to",
    "VBZ": "is has does 's", "VBP": "am are have do 're 'm 've", "VBD": "was were had did said wrote asked 'd", "VB": "be", "VBN": "been done", "VBG": "being having doing", "EX": "there", "WDT": "which", "WP": "who whom what", "WP$": "whose", "WRB": "when where why how", "RB": "not never very too also only just often always again still already now then here soon quite really",
    "JJ": "new old other same different good bad long short first last small large great high low own late early", "CD": "one two three four five six seven eight nine ten",
}
# The universal tags in Penn tags, and the words that narrow two of them.
UPOS = {
    "ADJ": r"JJ|JJR|JJS",
    "ADP": r"IN|RP",
    "ADV": r"RB|RBR|RBS|WRB",
    "AUX": r"MD|VB|VBD|VBG|VBN|VBP|VBZ",
    "CCONJ": r"CC",
    "DET": r"DT|PDT|WDT|WP\$",
    "INTJ": r"UH",
    "NOUN": r"NN|NNS",
    "NUM": r"CD",
    "PART": r"TO|RP|POS",
    "PRON": r"PRP|PRP\$|WP|EX",
    "PROPN": r"NNP|NNPS",
    "PUNCT": r"[.,:]|''|``|-LRB-|-RRB-|\(|\)",
    "SCONJ": r"IN|WRB",
    "SYM": r"SYM|\$|#",
    "VERB": r"VB|VBD|VBG|VBN|VBP|VBZ",
    "X": r"FW|LS",
}
UPOS_WORDS = {
    "AUX": "am is are was were be been being have has had having do does did doing will would shall should can could may might must ought 's 're 'm 've 'll 'd",
    "SCONJ": "after although as because before even if since so than that though unless until when whenever where whereas wherever whether while why how",
}


def universal(names: str) -> tuple[re.Pattern, frozenset[str] | None]:
    """What ``A|B`` asks of a token: an expression for its whole tag, and words it must be one of; None where any word will do."""
    parts = [p.strip().upper() for p in names.split("|")]
    if unknown := [p for p in parts if p not in UPOS]:
        raise ValueError(f"unknown universal tag {unknown[0]!r}; expected one of {', '.join(sorted(UPOS))}")
    words = frozenset(w for p in parts for w in UPOS_WORDS.get(p, "").split()) if all(p in UPOS_WORDS for p in parts) else None
    return re.compile("^(?:" + "|".join(UPOS[p] for p in parts) + ")$"), words


ENDINGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("less", "JJ"), ("est", "JJS"), ("ical", "JJ"), ("tion", "NN"), ("ness", "NN"), ("ment", "NN"), ("ity", "NN"), ("ss", "NN"), ("us", "NN"), ("s", "NNS")]
_SIGNS = {"(": "-LRB-", ")": "-RRB-", "[": "-LRB-", "]": "-RRB-", "!": ".", "?": ".", "“": "``", "‘": "``", "”": "''", "’": "''", '"': "''", "'": "''"}
_CLOSED = {w: t for t, ws in LEXICON.items() for w in ws.split()}
# a contraction's ending is a token of its own
TOKEN = re.compile(r"(?<=\w)n['’]t\b|(?<=\w)['’](?:s|re|m|ve|ll|d)\b|(?:(?!n['’]t\b)[^\W_])+(?:(?:['’](?!(?:s|re|m|ve|ll|d)\b)|[.-])[^\W_]+)*|[^\w\s]")


@lru_cache(maxsize=100_000)
def _alone(word: str, first: bool) -> str:
    low = word.lower().replace("’", "'")
    if low in _CLOSED:
        return _CLOSED[low]
    if low in ("n't", "'ll"):
        return "RB" if low == "n't" else "MD"
    if not word[0].isalnum():
        return _SIGNS.get(word, word if word in ".,$#" else ":" if word in ":;-–—…" else "SYM")
    if re.fullmatch(r"[\d.,]+\w{0,2}", word):
        return "CD"
    if word[0].isupper() and not first:
        return "NNP"
    return next((t for e, t in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "NN")


def tag(text: str) -> list[tuple[str, str, int]]:
    """``(token, tag, start)``; tags look at the word, then at its left neighbour."""
    out: list[tuple[str, str, int]] = []
    for m in TOKEN.finditer(text):
        t = _alone(m.group(), not out)
        before = out[-1][1] if out else ""
        if m.group()[0] in "'’" and t == "VBZ" and before in ("NN", "NNS", "NNP", "CD"):
            t = "POS"
        if before in ("MD", "TO") and t in ("NN", "VBP", "NNS", "VBD", "JJ"):
            t = "VB" if t != "JJ" else t
        elif before in ("VBZ", "VBP", "VBD", "VB") and t == "VBD":
            t = "VBN"
        elif before in ("DT", "PRP$", "JJ") and t in ("VBP", "VB", "VBG"):
            t = "NN"
        elif before in ("PRP", "NNS", "NN", "NNP") and t == "NNS":
            t = "VBZ" if before in ("PRP", "NN", "NNP") and not out[-1][0].lower().endswith("s") else t
        out.append((m.group(), t, m.start()))
    return out
