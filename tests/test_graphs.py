"""Loops over links against plain algorithms on small graphs."""

import random
from collections import defaultdict

import pytest

from weftline.operators import graph


def frame(spark, links):
    return spark.createDataFrame([(a, b, 1) for a, b in links], "src long, dst long, w long")


def neighbours(links):
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def connected(nodes, near):
    """Components of the graph that these nodes and their links make."""
    left, out = set(nodes), []
    while left:
        todo, got = [left.pop()], set()
        while todo:
            n = todo.pop()
            got.add(n)
            todo += near[n] & left
            left -= near[n]
        out.append(got)
    return out


def same_block(near, e, f):
    """Two links are in one block if no single node parts them."""
    if e == f:
        return True
    for cut in near:
        parts = connected(set(near) - {cut}, near)
        of = lambda x: {i for i, p in enumerate(parts) if p & set(x)}
        if not of(e) & of(f):
            return False
    return True


def by_definition(links):
    """node to (articulation, size of its largest block)."""
    near = neighbours(links)
    parts = connected(near, near)
    if len(parts) > 1:
        return {n: v for p in parts for n, v in by_definition([e for e in links if e[0] in p and e[0] != e[1]]).items()}
    es = [tuple(sorted(e)) for e in {frozenset(e) for e in links if e[0] != e[1]}]
    blocks = []
    for e in es:
        home = next((b for b in blocks if same_block(near, e, b[0])), None)
        blocks.append([e]) if home is None else home.append(e)
    sizes = defaultdict(list)
    for b in blocks:
        nodes = {n for e in b for n in e}
        for n in nodes:
            sizes[n].append(len(nodes))
    whole = len(connected(near, near))
    cuts = {n: len(connected(set(near) - {n}, near)) > whole for n in near}
    return {n: (cuts[n], max(sizes[n])) for n in near}


CASES = {
    "chain": [(i, i + 1) for i in range(7)],
    "ring": [(i, (i + 1) % 6) for i in range(6)],
    "two rings in a node": [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 5), (5, 0)],
    "rings on a bridge": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (20, 21), (21, 22), (22, 20), (22, 1)],
    "star": [(0, i) for i in range(1, 7)],
    "wheel and a tail": [(0, i) for i in range(1, 6)] + [(i, i % 5 + 1) for i in range(1, 6)] + [(9, 3), (9, 10)],
    "doubled and looped": [(1, 2), (2, 1), (1, 2), (3, 3), (2, 3)],
}


def test_blocks(spark):
    """All cases and random graphs side by side, as components of one graph."""
    r = random.Random(1)
    graphs = [*CASES.values(), *([(r.randrange(14), r.randrange(14)) for _ in range(n)] for n in (9, 13, 18, 24))]
    links = [(a + 100 * k, b + 100 * k) for k, g in enumerate(graphs) for a, b in g]
    got = {r.node: (r.articulation, r.block) for r in graph.biconnected(frame(spark, links)).collect()}
    assert got == by_definition(links)


def test_cores(spark):
    r = random.Random(3)
    links = [(r.randrange(25), r.randrange(25)) for _ in range(80)]
    near = neighbours(links)
    core = {}
    for k in range(30):
        alive = set(near)
        while weak := {n for n in alive if len(near[n] & alive) < k}:
            alive -= weak
        core |= dict.fromkeys(alive, k)
    assert {r.node: r.core for r in graph.cores(frame(spark, links)).collect()} == core


def test_paths(spark):
    links = [(1, 5), (1, 3), (3, 7), (5, 7), (7, 8), (8, 9), (9, 10), (7, 1), (2, 3)]
    got = {(r.source, r.node): r.path for r in graph.paths(frame(spark, links), spark.createDataFrame([(1,), (2,)], "node long")).collect()}
    assert got[1, 9] == [1, 3, 7, 8, 9] and (1, 10) not in got and got[2, 8] == [2, 3, 7, 8] and got[1, 1] == [1] and got[2, 5] == [2, 3, 7, 1, 5]


def plain_rank(links, seeds=None, teleport=0.15):
    nodes = sorted({n for e in links for n in e})
    base = {n: 1.0 * (seeds is None or n in seeds) for n in nodes}
    base = {n: b / sum(base.values()) for n, b in base.items()}
    out = defaultdict(list)
    for a, b in links:
        out[a].append(b)
    score = dict(base)
    for _ in range(300):
        lost = sum(s for n, s in score.items() if not out[n])
        score = {n: (1 - teleport) * (sum(score[a] / len(out[a]) for a, b in links if b == n) + lost * base[n]) + teleport * base[n] for n in nodes}
    return score


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], [(1, 2), (2, 3), (3, 1), (1, 3)]])
@pytest.mark.parametrize("seeds", [None, [1]])
def test_page_rank_goes_to_the_fixed_point(spark, links, seeds):
    got = {r.node: r.score for r in graph.pagerank(frame(spark, links), seeds=seeds).collect()}
    assert got == pytest.approx(plain_rank(links, seeds), abs=1e-7)


def test_hits_go_to_the_fixed_point(spark):
    links = [(1, 2), (1, 3), (2, 3), (4, 3), (4, 2), (3, 1)]
    hub = dict.fromkeys([1, 2, 3, 4], 1.0)
    for _ in range(200):
        auth = {n: sum(hub[a] for a, b in links if b == n) for n in hub}
        hub = {n: sum(auth[b] for a, b in links if a == n) for n in hub}
        auth, hub = ({n: v / sum(x.values()) for n, v in x.items()} for x in (auth, hub))
    got = graph.hits(frame(spark, links)).collect()
    assert {r.node: r.authority for r in got} == pytest.approx(auth, abs=1e-6) and {r.node: r.hub for r in got} == pytest.approx(hub, abs=1e-6)


def test_automatic_seeds(spark):
    links = [(1, 2), (1, 3), (1, 4), (2, 3), (5, 1)]
    quality = spark.createDataFrame([(1, 0.9, 10.0, False), (2, 0.5, 10.0, False), (5, 0.9, 20.0, None), (3, 0.8, None, True)], "node long, quality double, readability double, spam boolean")
    back = plain_rank([(b, a) for a, b in links])
    got = graph.automatic_seeds(frame(spark, links), quality, pool=4, kept=2).collect()
    first = sorted(back, key=lambda n: (-back[n], n))[:4]
    assert [r.node for r in got] == [n for n in first if n not in (2, 3, 5)][:2]
    bad = quality.selectExpr("node", "0.1D AS quality", "readability", "spam").union(spark.createDataFrame([(4, 0.1, None, None)], quality.schema))
    ahead = plain_rank(links)
    assert [r.node for r in graph.automatic_seeds(frame(spark, links), bad, kept=3).collect()] == sorted(ahead, key=lambda n: (-ahead[n], n))[:3]
