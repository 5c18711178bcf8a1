"""Fill-in-middle: a text's units (lines) are cut in three and rearranged with sentinels, over a rope.

A rope is a binary tree over pieces of a text. A leaf holds some whole lines; every node caches how many units and
how many code points stand below it. So a split at the rank of a unit, or of a code point, walks down one path, and
joining is a new node: the rearranged text is made of the same leaves, and only written out at the end. The inverse
makes a rope of the output, splits it at the sentinels' places and joins the parts in their old order.

Which documents are rearranged, where they are cut and in which order the parts stand follows from a hash of the
seed and the doc_id alone, so it is the same wherever and however often a row is computed.

Null text counts as empty; empty texts, and those that hold a sentinel's string, stay plain; a null doc_id is hashed
as an empty string; rows that repeat a doc_id are cut by the same ranks, each by its own number of units; a text
without a line end is one unit of any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that a leaf has at least, but for the last one; it ends with a line.
LEAF = 4096
_sentinel = re.compile("<[PSM]>")


@dataclass(slots=True)
class Leaf:
    text: str
    units: int
    chars: int


@dataclass(slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int


EMPTY = Leaf("", 0, 0)


def n_units(text: str) -> int:
    """Lines, the last one with or without its end."""
    return text.count("\n") + (text != "" and text[-1] != "\n")


def leaf(text: str) -> Leaf:
    return Leaf(text, n_units(text), len(text)) if text else EMPTY


def join(left: Leaf | Node, right: Leaf | Node) -> Leaf | Node:
    if not left.chars:
        return right
    if not right.chars:
        return left
    return Node(left, right, left.units + right.units, left.chars + right.chars)


def rope(text: str) -> Leaf | Node:
    """A balanced tree over the leaves of a text."""
    level, start = [], 0
    while start < len(text):
        end = text.find("\n", min(start + LEAF, len(text)) - 1) + 1 or len(text)
        level.append(leaf(text[start:end]))
        start = end
    while len(level) > 1:
        level = [join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def split_units(tree: Leaf | Node, rank: int) -> tuple[Leaf | Node, Leaf | Node]:
    """What stands before the unit of a rank (from 0), and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= tree.units:
        return tree, EMPTY
    if isinstance(tree, Node):
        if rank < tree.left.units:
            a, b = split_units(tree.left, rank)
            return a, join(b, tree.right)
        a, b = split_units(tree.right, rank - tree.left.units)
        return join(tree.left, a), b
    at = -1
    for _ in range(rank):
        at = tree.text.index("\n", at + 1)
    return leaf(tree.text[: at + 1]), leaf(tree.text[at + 1 :])


def split_chars(tree: Leaf | Node, rank: int) -> tuple[Leaf | Node, Leaf | Node]:
    """The first code points, as many as rank, and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= tree.chars:
        return tree, EMPTY
    if isinstance(tree, Node):
        if rank < tree.left.chars:
            a, b = split_chars(tree.left, rank)
            return a, join(b, tree.right)
        a, b = split_chars(tree.right, rank - tree.left.chars)
        return join(tree.left, a), b
    return leaf(tree.text[:rank]), leaf(tree.text[rank:])


def leaves(tree: Leaf | Node) -> Iterator[str]:
    stack = [tree]
    while stack:
        top = stack.pop()
        if isinstance(top, Node):
            stack += [top.right, top.left]
        else:
            yield top.text


def written(tree: Leaf | Node) -> str:
    return "".join(leaves(tree))


def rearrange(text: str, key: str, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text.

    rate: of 100 texts, so many are rearranged; spm: of 100 of those, so many begin with the suffix.
    """
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or _sentinel.search(text) or h3 % 100 >= rate:
        return n_units(text), "plain", None, None, text
    tree = rope(text)
    first, second = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    head, suffix = split_units(tree, second)
    prefix, middle = split_units(head, first)
    form = "spm" if h4 % 100 < spm else "psm"
    p, s, m = (Leaf(x, 1, len(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = EMPTY
    for part in parts:
        out = join(out, part)
    return tree.units, form, prefix.chars, middle.chars, written(out)


def restore(output: str, form: str) -> str:
    """The text that was rearranged, from its output and form."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    rest, parts, cut = rope(output), {}, 0
    at = [output.index(x) for x in order]
    for name, start, end in zip(order, at, [*at[1:], len(output)]):
        part, rest = split_chars(rest, end - cut)
        parts[name] = split_chars(part, start + len(name) - cut)[1]
        cut = end
    return written(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output (the rearranged text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = [rearrange(t, "" if i is None else str(i), seed, rate, spm) for i, t in zip(ids, b.column("text").to_pylist())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            columns[4] = columns[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The texts that transform() rearranged, on Arrow batches."""

    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array(list(map(restore, outputs.to_pylist(), forms.to_pylist())), pa.string())

    return F.arrow_udf(run, "string")(output, form)


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """What transform() made of every document, with digests of the output and of the text rebuilt from it."""
    rows = transform(docs, seed, rate, spm)
    rows = rows.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)})
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The same by lists of lines, for the queries' check.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
