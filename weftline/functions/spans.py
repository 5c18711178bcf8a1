"""Sentences with their places, passages packed from them, and phrases of a lexicon found in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence ends before white space and a capital, or at an empty line; shorter ones are left out.
_breaks = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|\n\s*\n")
LEAST_CHARS = 15
TARGET_TOKENS, SHARED = 150, 1

# Phrases that tell nothing about a link's target.
GENERIC = """click here;click this;click this link;click here for more;click here to read;click here to learn;click here to find out;click for more;click for details;click for more info
read more;read more here;read this;read more about;read on;learn more;learn more here;learn more about;find out;find out more;find out here;find out how
see more;see here;see this;see this link;see this article;see details;see what;see for yourself;view more;view here;view this;view details;view full
visit;visit here;visit this;visit this site;visit this page;go here;go to;follow this;follow this link;follow link;follow the link
this;this article;this post;this page;this link;this site;this one;that;that article;that post;this thing;the thing;here;right here;over here
more;more info;more here;more information;more details;more about;more on;even more;it;something;anything
buy now;download;download now;download here;get started;get it now;get more;get this;get the;sign up;register;join now;join here;subscribe;try it;try now;try this;try free;free trial;add to cart
the best;the ultimate;the complete;ultimate guide;complete guide;best of;top;top picks;top rated;new;latest;latest news;official;official site;official page
empty link;no text;untitled link""".replace("\n", ";").split(";")

SPANS = "array<struct<position:int,start:int,end:int,text:string>>"
PASSAGES = "array<struct<position:int,token_start:int,token_end:int,text:string>>"


def sentence_spans(text: str, least: int = LEAST_CHARS) -> list[tuple[int, int, int, str]]:
    """(position, start, end, sentence) in code points; positions count the sentences that are long enough."""
    edges = [0, *(e for m in _breaks.finditer(text) for e in m.span()), len(text)]
    out = []
    for a, z in zip(edges[::2], edges[1::2]):
        part = text[a:z]
        start = a + len(part) - len(part.lstrip())
        end = start + len(part.strip())
        if end - start >= max(1, least):
            out.append((len(out), start, end, text[start:end]))
    return out


def packed(sentences: Iterable[str], target: int = TARGET_TOKENS, shared: int = SHARED) -> list[tuple[int, int, int, str]]:
    """(position, token_start, token_end, passage): whole sentences up to the target, the last ones shared with the next passage.

    A sentence beyond the target is a passage of its own. Of a passage with no more than the shared sentences none is shared.
    """
    sized = [(s, len(s.split())) for s in sentences if s and s.strip()]
    starts = [0]
    for _, n in sized:
        starts.append(starts[-1] + n)
    out, first = [], 0
    for i in range(1, len(sized) + 1):
        if i == len(sized) or starts[i + 1] - starts[first] > target:
            out.append((len(out), starts[first], starts[i], " ".join(s for s, _ in sized[first:i])))
            first = i - shared if 0 < shared < i - first else i
    return out


def _over(function, kind: str):
    return F.pandas_udf(lambda x: x.map(lambda v: None if v is None else function(v)), kind)


def spans(text: Column, least: int = LEAST_CHARS) -> Column:
    """Sentences of a text with positions and offsets."""
    return _over(lambda t: sentence_spans(t, least), SPANS)(text)


def passages(text: Column, target: int = TARGET_TOKENS, shared: int = SHARED) -> Column:
    """Passages packed from the sentences of a text."""
    return _over(lambda t: packed((s[3] for s in sentence_spans(t)), target, shared), PASSAGES)(text)


_automata: dict[tuple[str, ...], object] = {}


def automaton(phrases: Iterable[str]):
    """An automaton over all phrases of a lexicon, built once in a worker."""
    key = tuple(dict.fromkeys(p.lower() for p in phrases if p))
    if key not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in key:
            a.add_word(p, p)
        a.make_automaton()
        _automata.clear()
        _automata[key] = a
    return _automata[key]


def generic_phrases(anchor: str | None, phrases: Iterable[str] = tuple(GENERIC)) -> tuple[list[str], float]:
    """The distinct phrases inside an anchor, sorted, and their words as a share of the anchor's, 1 at most.

    A phrase counts wherever its characters stand, inside a longer word and inside another phrase too.
    """
    text = (anchor or "").lower().strip()
    if not text:
        return [], 0.0
    found = sorted({p for _, p in automaton(phrases).iter(text)})
    return found, min(1.0, sum(len(p.split()) for p in found) / max(1, len(text.split())))


def genericness(anchor: Column, phrases: Iterable[str] = tuple(GENERIC)) -> Column:
    """phrases found in an anchor and genericness, from one pass of an automaton over each Arrow batch."""
    lexicon = tuple(phrases)

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([generic_phrases(a, lexicon) for a in batch], columns=["phrases", "genericness"])

    return F.pandas_udf(run, "phrases array<string>, genericness double")(anchor)
