"""Links of a text with their places and context: BBCode links, HTML anchors, bare URLs."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a link looks like in each form, and how far its context reaches.
BBCODE = re.compile(r"\[URL=([^\]]+)\](.*?)\[/URL\]", re.I | re.S)
ANCHOR = re.compile(r"<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.I | re.S)
BARE = re.compile(r"https?://[^\s\[\]<>\"']+", re.I)
SIDE = 80

_markup = re.compile(r"<[^>]+>|\[[^\]]+\]")
_word = re.compile("[A-Za-z0-9]")
LINKS = "array<struct<ordinal:int,start:int,end:int,url:string,anchor:string,form:string,context:string>>"


def plain(text: str) -> str:
    """Without tags of either markup, white space collapsed."""
    return " ".join(_markup.sub(" ", html.unescape(text)).split())


def tells(side: str) -> bool:
    """Whether one side of a link holds a word that is no tag and no URL."""
    return bool(_word.search(BARE.sub(" ", _markup.sub(" ", html.unescape(side)))))


def links(text: str, side: int = SIDE) -> list[tuple[int, int, int, str, str, str, str]]:
    """(ordinal, start, end, url, anchor, form, context) of every link in order; of two that overlap the more explicit form stays.

    Context: words on both sides make a link contextual, on one side weak, on neither isolated.
    """
    found: list[tuple[int, int, str, str, str]] = []
    for form, pattern in (("bbcode_anchor", BBCODE), ("html_anchor", ANCHOR), ("bare_url", BARE)):
        taken = sorted(found)
        k = 0
        for m in pattern.finditer(text):
            a, z = m.span()
            while k < len(taken) and taken[k][1] <= a:  # links of earlier forms don't overlap, so both lists run on
                k += 1
            if k == len(taken) or taken[k][0] >= z:
                found.append((a, z, m[0] if form == "bare_url" else m[1], "" if form == "bare_url" else plain(m[2]), form))
    names = ("isolated", "weak_context", "contextual")
    return [(i, a, z, url, anchor, form, names[tells(text[max(0, a - side) : a]) + tells(text[z : z + side])]) for i, (a, z, url, anchor, form) in enumerate(sorted(found))]


def link_spans(text: Column) -> Column:
    """All links of a text, found on Arrow batches; null for a null text."""
    return F.pandas_udf(lambda x: x.map(lambda t: None if t is None else links(t)), LINKS)(text)
