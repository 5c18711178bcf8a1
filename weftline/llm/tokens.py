"""Exact, cached calls of the tokenizers library, shared by the operators that encode texts.

A text is cut before each space that follows a character other than white space. Both public vocabularies split
there too, whatever comes before or after, so a text's ids are the ids of its pieces, one after another. Most
pieces recur, so a worker keeps the ids of those it has met and calls the library for the others only. A text
that may hold a special token's string goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftline.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Pieces a worker keeps at most (about 230 bytes each), and the longest piece it keeps; both bound the cache, not the results.
CACHE_PIECES, CACHE_CHARS = 1_600_000, 48
#: Missing pieces that are worked on at a time, with about 500 bytes each meanwhile.
ADDED = 1 << 15
#: The same for the pipeline, whose workers other stages use before.
FEW_PIECES = 200_000

_loose = re.compile(r"\s ")
_cut = re.compile(r"(?<=\S) ")
#: A word of Latin letters and marks after it, and perhaps one line end and the same again: both vocabularies split
#: between all of these, so they can be met separately.
_letters, _marks = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)", "([.,;:!?*&%$#|()\\[\\]\"]*)"
_word = re.compile(f"{_letters}{_marks}(?:\n{_letters}{_marks})?").fullmatch
#: A character beyond those that lower() treats one by one.
_beyond = re.compile("[^\x00-\u012f\u0131-\u024f]").search
_loaded: dict[str, object] = {}
_edges: dict[str, tuple[bool, np.ndarray] | None] = {}
_caches: dict[tuple, tuple[dict, dict]] = {}


def clear() -> None:
    for caches in _caches.values():
        for c in caches:
            c.clear()
    _caches.clear()
    _edges.clear()
    _loaded.clear()


common.cached_by("tokens", clear)


def load(path: str):
    """The tokenizer at path, once for each worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def pieces(text: str) -> list[str]:
    """The pieces of a text; all but the first have lost the space they begin with."""
    return _cut.split(text) if _loose.search(text) else text.split(" ")


def as_bytes(ids: bytes) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids


def as_length(ids: bytes) -> int:
    return len(ids) // 4


def _bytes(encoding) -> bytes:
    return array("I", encoding.ids).tobytes()


def _word_edges(tokenizer) -> tuple[bool, np.ndarray] | None:
    """Which ids begin a word after a space (False), or end a word (True); None if the vocabulary marks neither."""
    words = tokenizer.get_vocab()
    for at_end, mark in ((False, "\u0120"), (True, "</w>")):
        edges = np.zeros(max(words.values()) + 1, bool)
        edges[[i for w, i in words.items() if (w.endswith(mark) if at_end else w.startswith(mark))]] = True
        if edges.sum() > 1000:
            return at_end, edges
    return None


class PieceEncoder:
    """join() of the value() of every text's pieces, from a cache that starts with known (tail pieces, values)."""

    def __init__(self, path: str, value: Callable, join: Callable[[Iterable], object], known: dict | None = None, key: str = "", kept: int | None = None) -> None:
        common.enter("tokens")
        self.kept = kept or CACHE_PIECES
        self.tokenizer, self.value, self.join, self.known = load(path), value, join, known or {}
        self.edges = _edges.setdefault(path, _word_edges(self.tokenizer)) if path not in _edges else _edges[path]
        #: whether the vocabulary doesn't tell capitals from small letters
        self.folds = all(self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(a.lower(), add_special_tokens=False).ids for a in ("A", "\u00c9", "Ab"))
        #: where a word after a line end is met: with the words after a space, if spaces don't count
        self.blind = self.tokenizer.encode("a", add_special_tokens=False).ids == self.tokenizer.encode(" a", add_special_tokens=False).ids
        self.bare = self._bare() if self.blind else None
        self.head, self.tail = _caches.setdefault((path, value.__name__, key), ({}, dict(self.known)))

    def _add(self, cache: dict, new: list[str], prefix: str) -> list[str]:
        """Put pieces that are missing into the cache, ADDED at a time; returns those too long to stay there."""
        for i in range(0, len(new), ADDED):
            self._add_some(cache, new[i : i + ADDED], prefix)
        return [p for p in new if len(p) > CACHE_CHARS]

    def _add_some(self, cache: dict, new: list[str], prefix: str) -> None:
        rest = new
        parts = []
        if prefix and self.edges:
            words, others, rest = set(), set(), []
            for p in new:
                found = _word(p) if len(p) <= CACHE_CHARS and "\u0130" not in p else None
                if found is None:
                    rest.append(p)
                    continue
                w, m, w2, m2 = found.groups()
                if self.folds:
                    w, w2 = w.lower(), w2 and w2.lower()
                if w != p:
                    parts.append((p, w, m, w2, m2))
                    others.add(m)
                    if w2:
                        others.update(("\n", m2))
                        (words if self.blind else others).add(w2)
                words.add(w)
            listed = [w for w in words if w not in cache]
            for i in range(0, len(listed), 512):  # one call for many words costs less than as many calls
                self._add_words(cache, listed[i : i + 512])
            rest += [w for w in listed if w not in cache]
            self._add(self.head, [p for p in others if p and p not in self.head], "")
        for i in range(0, len(rest), 2048):
            part = rest[i : i + 2048]
            found = self.tokenizer.encode_batch_fast([prefix + p for p in part], add_special_tokens=False)
            cache.update(zip(part, map(self.value, map(_bytes, found))))
        head, second = self.head, cache if self.blind else self.head
        for p, w, m, w2, m2 in parts:
            ids = cache[w] + head[m] if m else cache[w]
            if w2:
                ids += head["\n"] + second[w2]
                if m2:
                    ids += head[m2]
            cache[p] = ids

    def _bare(self):
        """The tokenizer's model for small letters of _letters with spaces between, which its normaliser and its splits leave alone."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return bare

    def _add_words(self, cache: dict, words: list[str]) -> None:
        """Encode words with spaces between, and cut the ids where the vocabulary marks the words' edges."""
        ids = _bytes((self.bare or self.tokenizer).encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0])
        at_end, edges = self.edges
        at = np.flatnonzero(edges[np.frombuffer(ids, "<u4")])
        if len(at) == len(words):
            ends = ((at + 1) * 4 if at_end else np.append(at[1:] * 4, len(ids))).tolist()
            start = 0
            for w, end in zip(words, ends):
                cache[w] = self.value(ids[start:end])
                start = end

    def _cut(self, texts: list[str]) -> tuple[list[int], pa.ListArray]:
        """Places in texts and pieces of all that can be cut, capitals made small where they don't count."""
        at: tuple[list, list] = [], []
        for i, t in enumerate(texts):
            if "<|" not in t:
                at[bool(_loose.search(t))].append(i)
        plain, loose = ([t.lower() if self.folds and (t.isascii() or not _beyond(t)) else t for t in map(texts.__getitem__, a)] for a in at)
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        return at[0] + at[1], pa.concat_arrays([cut, pa.array(map(_cut.split, loose), cut.type)])

    def __call__(self, texts: list[str]) -> list:
        """The joined value of each text, in order."""
        at, cut = self._cut(texts)
        flat, ends = cut.flatten(), cut.offsets.to_numpy()
        inner = np.ones(len(flat), bool)
        inner[ends[:-1]] = False
        first = flat.take(pa.array(ends[:-1])).to_pylist()
        # every different piece is looked up once, however often these texts have it
        coded = flat.filter(pa.array(inner)).dictionary_encode()
        heads, tails = set(first), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.tail) + len(self.head) > self.kept + len(self.known):  # what these texts hold is frequent, and stays
            for cache, wanted, known in ((self.head, heads, {}), (self.tail, tails, self.known)):
                stays = {p: cache[p] for p in wanted if p in cache}
                cache.clear()
                cache.update(known)
                cache.update(stays)
        long = self._add(self.head, [p for p in heads if p not in self.head], "")
        values, codes = list(map(self.tail.get, tails)), coded.indices.to_numpy()
        missing = [k for k, v in enumerate(values) if v is None]
        long_tails = self._add(self.tail, [tails[k] for k in missing], " ")
        for k in missing:
            values[k] = self.tail[tails[k]]
        out: list = [None] * len(texts)
        ends = (ends - np.arange(len(ends))).tolist()
        for i, p, start, end in zip(at, first, ends, ends[1:]):
            out[i] = self.join([self.head[p], *map(values.__getitem__, codes[start:end].tolist())])
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.value(_bytes(self.tokenizer.encode(t, add_special_tokens=False)))
        for p in long:
            del self.head[p]
        for p in long_tails:
            del self.tail[p]
        return out
