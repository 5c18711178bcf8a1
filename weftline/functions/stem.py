"""Stems of English words by the published Porter2 rules; a worker stems each distinct word once."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import token_set

# Fixed values of the published rules.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
UNCHANGED_ONCE_SINGULAR = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

#: Distinct words whose stems a worker keeps (some 200 bytes each).
KEPT = 1 << 17
_region = re.compile("[aeiouy][^aeiouy]")
_double = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$").search
#: A vowel between other letters, the last no w, x or consonant y; or a vowel that begins the word.
_short = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$").search


def _after(word: str, start: int) -> int:
    m = _region.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=KEPT)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in WHOLE or word in UNCHANGED:
        return WHOLE.get(word, word)
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.lstrip("'"))  # a y that is a consonant
    known = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(known) if known else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub("'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in UNCHANGED_ONCE_SINGULAR:
        return w
    # past and present participles
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # suffixes to shorter ones, then away; the longest ending alone is looked at, whether or not it lies far enough back
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)][-1:]
        if not (end == "ogi" and before != "l") and not (end == "li" and before not in tuple("cdeghkmnrt")):
            w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else sorted({stem(w) for w in ws}))


def stem_set(text: Column) -> Column:
    """The sorted distinct stems of a text's words that are no stopwords."""
    return F.pandas_udf(_stems, "array<string>")(token_set(text))
