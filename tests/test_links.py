"""Links, nested blocks and slates against plain loops."""

import math
import random
import re

from pyspark.sql import functions as F

from weftline.functions import links as L
from weftline.functions import text as X
from weftline.operators import ranking


def test_links():
    text = "See [URL=http://a.example/x]the <b>A</b> page[/URL] and <a class='k' href=\"/b\">B\n here</a>, or http://c.example/y?z=1 now"
    got = L.links(text)
    assert [(g[0], g[3], g[4], g[5]) for g in got] == [(0, "http://a.example/x", "the A page", "bbcode_anchor"), (1, "/b", "B here", "html_anchor"), (2, "http://c.example/y?z=1", "", "bare_url")]
    assert text[got[1][1] : got[1][2]].startswith("<a") and {g[6] for g in got} == {"contextual"}
    assert [g[6] for g in L.links("<p><a href='/x'>x</a></p>")] == ["isolated"]
    assert L.links("word <i></i><a href='/x'>x</a> http://only.example")[0][6] == "weak_context"
    # an anchor around a bare URL is one link, and so is a BBCode link inside an anchor's text
    assert [g[5] for g in L.links('<a href="http://d.example">http://d.example</a>')] == ["html_anchor"]
    assert [g[5] for g in L.links('<a href="/o">[url=/i]i[/url]</a>')] == ["bbcode_anchor"]
    assert L.links("") == [] and L.links("no link < a [url=]") == []


def test_links_that_overlap():
    """The quick merge of forms is the rule by all pairs."""
    r = random.Random(5)
    pieces = ["[URL=/x]", "[/URL]", '<a href="/y">', "</a>", " http://z.example ", "text ", "\n"]
    for _ in range(300):
        t = "".join(r.choice(pieces) for _ in range(14))
        kept = []
        for pattern in (L.BBCODE, L.ANCHOR, L.BARE):
            kept += [m.span() for m in pattern.finditer(t) if not any(m.start() < z and m.end() > a for a, z in kept)]
        assert [g[1:3] for g in L.links(t)] == sorted(kept)


def test_link_spans(spark):
    rows = spark.createDataFrame([("<a href='/x'>x</a>",), (None,), ("",)], "t string").select(L.link_spans(F.col("t")).alias("l")).collect()
    assert rows[0].l[0].url == "/x" and rows[1].l is None and rows[2].l == []


def test_nested_blocks():
    deep = "a " + "[quote]x" * 3000 + "[/quote]" * 3000 + " b"
    assert X.without_blocks(deep).split() == ["a", "b"]
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["[quote=x]", "[/QUOTE]", "a", "b ", "[b]"]) for _ in range(12))
        fixed, n = t, 1
        while n:  # innermost first, until there is none
            fixed, n = re.subn(r"(?is)\[quote[^\]]*\](?:(?!\[/?quote)[\s\S])*?\[/quote\]", " ", fixed)
        assert X.without_blocks(t).split() == fixed.split()


def test_slates_take_all_items(spark):
    r = random.Random(2)
    rows = [(h, 100 * h + i, r.randrange(40) / 100 + 0.5, [r.gauss(0, 1) for _ in range(4)]) for h in range(3) for i in range((0, 3, 40)[h])]
    rows += [(1, 199, 0.8, [0.0] * 4)]

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / max(n, 1e-300) for x in v]

    brute = []
    for h in {x[0] for x in rows}:
        top = max(x[2] for x in rows if x[0] == h)
        left = [(i, s, unit(v)) for g, i, s, v in rows if g == h and s >= top - 0.3]
        chosen = []
        for place in range(1, 6):
            if not left:
                break
            close = {i: max([0.0, *(sum(a * b for a, b in zip(v, c[2])) for c in chosen)]) for i, _, v in left}
            pick = max(left, key=lambda x: (0.65 * x[1] - 0.35 * close[x[0]], x[1], -x[0]))
            brute.append((h, pick[0], place, close[pick[0]] > 0.9))
            chosen.append(pick)
            left.remove(pick)
    got = ranking.slates(spark.createDataFrame(rows, "host long, id long, score double, vec array<double>"))
    assert sorted(map(tuple, got.collect())) == sorted(brute)
