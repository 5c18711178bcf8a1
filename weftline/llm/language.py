"""Language identification of mixed texts: script ranges, scores of words, Viterbi.

A text is cut into words. The script of a word leaves only the languages that were learned with that script; each of
them scores the word by its character n-grams; and Viterbi with a penalty for every switch labels the words, so runs
of one language are spans. A text's language is the one that labels most letters, its score the share of them.

The model is fitted on a bounded sample of labelled documents (SAMPLE_ROWS); every document is labelled.

Null text and text without a letter are `und` with score 0 (other languages need a letter); a word whose script no
language was learned with is `und` too, but a text with letters always gets a learned language (the most frequent
one if nothing else tells) while there is one to learn; with no labelled row all texts are `und`. An empty table
gives no rows; repeated rows are labelled each; texts of any length are labelled whole; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

#: Rows the model is fitted on at most: those of the least hashes of doc_id, spread evenly over the corpus.
SAMPLE_ROWS = 3000
#: n-gram lengths, n-grams kept for each language, the penalty of a switch (nats), words a worker keeps scores of.
ORDERS, KEPT_GRAMS, SWITCH, CACHE_WORDS = (1, 2, 3), 20_000, 8.0, 900_000
#: The same for keep(), whose workers other stages use before and after.
FEW_WORDS = 300_000
UNKNOWN = "und"
#: Script ranges of letters, by their first and last code point.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)),
}
_words = re.compile(r"[^\W\d_]+")


def letters(match: re.Match) -> list[tuple[int, int]]:
    """(start, end) of the runs of letters (Unicode category L) in a match, which may hold number signs such as a superscript."""
    w = match.group()
    if w.isalpha():
        return [match.span()]
    edges = [0, *(i for i in range(1, len(w)) if w[i - 1].isalpha() != w[i].isalpha()), len(w)]
    return [(match.start() + a, match.start() + b) for a, b in zip(edges, edges[1:]) if w[a].isalpha()]


def words_of(text: str) -> list[str]:
    """The runs of letters of a text."""
    found = _words.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [text[a:b] for m in _words.finditer(text) for a, b in letters(m)]


def script(word: str) -> str:
    """The script of a word's first letter."""
    c = ord(word[0])
    return next((name for name, ranges in SCRIPTS.items() for a, b in ranges if a <= c <= b), "other")


def grams(word: str) -> list[str]:
    """The n-grams of a lower-case word between its edges."""
    w = f"<{word}>"
    out = level = list(w)
    for n in ORDERS[1:]:  # each order is one more than the one before
        level = list(map(str.__add__, level, w[n - 1 :]))
        out = out + level
    return out


def fit(rows: list[tuple[str, str]]) -> dict:
    """A model from (text, language) rows: log-probabilities of n-grams, and the languages of each script."""
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    scripts: dict[str, Counter[str]] = defaultdict(Counter)
    letters: Counter[str] = Counter()
    for text, language in rows:
        words = Counter(w.lower() for w in words_of(text))
        for w, n in words.items():
            scripts[script(w)][language] += n
            letters[language] += n * len(w)
            for g in grams(w):
                counts[language][g] += n
    languages = sorted(counts)
    every = {g for c in counts.values() for g, _ in c.most_common(KEPT_GRAMS)}
    totals = {lang: sum(counts[lang].values()) + 0.5 * (len(every) + 1) for lang in languages}
    weights = {g: np.array([math.log((counts[lang][g] + 0.5) / totals[lang]) for lang in languages]) for g in every}
    for g, w in weights.items():
        weights[g] = w - w.mean()
    # a language is a candidate for a script if it has a hundredth of the script's words or of its own in it
    own = {lang: sum(s[lang] for s in scripts.values()) for lang in languages}
    candidates = {name: np.array([n[lang] >= 0.01 * min(sum(n.values()), own[lang]) and n[lang] > 0 for lang in languages]) for name, n in scripts.items()}
    usual = max(languages, key=lambda lang: (letters[lang], lang)) if languages else None
    return {"languages": languages, "weights": weights, "candidates": candidates, "usual": usual}


class Labeller:
    """Labels texts in one worker."""

    def __init__(self, model: dict, cache_words: int = CACHE_WORDS) -> None:
        self.cache_words = cache_words
        self.languages, self.candidates = model["languages"], model["candidates"]
        self.usual = self.languages.index(model["usual"]) if self.languages else None
        self.some, self.all = ({name for name, c in self.candidates.items() if told(c)} for told in (np.any, np.all))
        self.grams = {g: k for k, g in enumerate(model["weights"])}
        self.weights = np.array([*model["weights"].values(), np.zeros(len(self.languages))]).reshape(len(self.grams) + 1, len(self.languages))
        self.index: dict[str, int] = {}
        #: For every word met: its scores, its length, and whether the scores tell anything.
        self.table, self.lengths, self.told = np.empty((1024, len(self.languages)), np.float32), np.empty(1024, np.int32), np.empty(1024, bool)

    def _add(self, words: list[str]) -> None:
        """Scores of new words: means of their n-grams' weights, far below all others where the script rules a language out."""
        first, last = len(self.index), len(self.index) + len(words)
        if last > len(self.table):
            grown = max(last, min(2 * last, self.cache_words))
            self.table = np.resize(self.table, (grown, len(self.languages)))
            self.lengths, self.told = np.resize(self.lengths, grown), np.resize(self.told, grown)
        flat, starts, get, none = [], [], self.grams.get, len(self.weights) - 1
        for w in words:
            starts.append(len(flat))
            flat.append(none)
            flat += map(get, grams(w.lower()), repeat(none))
        self.index.update(zip(words, range(first, last)))
        s = np.add.reduceat(self.weights[flat], starts, axis=0) / max(ORDERS)
        tells = np.ptp(s, axis=1) > 0
        for k, w in enumerate(words):
            name = "latin" if w[0] <= "\u024f" else script(w)
            if name in self.all:
                continue
            if name not in self.some:
                s[k], tells[k] = 0, False
            else:
                s[k][~self.candidates[name]] = -1e3
                tells[k] = True
        self.table[first:last], self.lengths[first:last] = s, list(map(len, words))
        self.told[first:last] = tells if len(self.languages) > 1 else True

    def look_up(self, words: list[str]) -> np.ndarray:
        """The rows of the words in the tables."""
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > self.cache_words:
            self.index, new = {}, set(words)
        if new:
            self._add(list(new))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of every word, switches costing SWITCH each.

        If no run of words favours another language over the text's best one by more than a switch, that language
        labels all words: every run another language could take would cost a switch at least and gain less.
        """
        best = int(np.argmax(s.sum(axis=0)))
        total = np.cumsum(s - s[:, [best]], axis=0)
        low = np.minimum.accumulate(np.vstack((np.zeros((1, s.shape[1])), total[:-1])), axis=0)
        if (total - low).max() <= SWITCH:
            return np.full(len(s), best)
        rows, back = s.tolist(), []
        value = rows[0]
        for row in rows[1:]:  # few languages: lists are faster than arrays
            most = max(value)
            top, switch = value.index(most), most - SWITCH
            back.append([k if v >= switch else top for k, v in enumerate(value)])
            value = [(v if v >= switch else switch) + x for v, x in zip(value, row)]
        at = value.index(max(value))
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return np.array(out[::-1], np.int64)

    def label(self, text: str) -> tuple[str, float, np.ndarray, list[int]]:
        """(language, score, labels of the words, where runs of one language begin and end in them)."""
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0, np.empty(0, np.int64), []
        at = self.look_up(words)
        path = self.path(self.table[at].astype(np.float64))
        lengths = self.lengths[at]
        shares = np.bincount(path, weights=lengths * self.told[at], minlength=len(self.languages))
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(words)]
        if not shares.any():
            return self.languages[self.usual], 0.0, path, edges
        top = int(shares.argmax())
        return self.languages[top], float(shares[top] / lengths.sum()), path, edges

    def spans(self, text: str, path: np.ndarray, edges: list[int]) -> list[tuple[int, int, str]]:
        """(start, end, language) of every run, in code points of the text."""
        if len(edges) == 2:  # from the first letter to the last
            first = next(i for i, c in enumerate(text) if c.isalpha())
            return [(first, next(i for i in range(len(text), first, -1) if text[i - 1].isalpha()), self.languages[path[0]])]
        found = [span for m in _words.finditer(text) for span in letters(m)] if edges else []
        return [(found[a][0], found[b - 1][1], self.languages[path[a]]) for a, b in zip(edges, edges[1:])]


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit the model on at most sample_rows labelled rows outside the held-out fold."""
    common.small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang")).where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = known.join(F.broadcast(chosen), "doc_id").select("text", "lang").orderBy(F.xxhash64("text", "lang")).limit(sample_rows)  # broadcast of sample_rows ids
    return fit([(r.text, r.lang) for r in rows.collect()])


_labellers: dict[tuple[int, int], Labeller] = {}
common.cached_by("language", _labellers.clear)


def labeller(blob: bytes, cache_words: int = CACHE_WORDS) -> Labeller:
    """The labeller of a pickled model, made once for each worker."""
    common.enter("language")
    key = hash(blob), cache_words
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(pickle.loads(blob), cache_words)
    return _labellers[key]


def languages(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, n_spans and spans (start and end in code points, lang) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    out = "doc_id long, lang_pred string, score double, n_spans int, spans array<struct<start:int,end:int,lang:string>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = labeller(sent.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = [who.label(t) for t in texts]
            columns = [b.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([max(0, len(r[3]) - 1) for r in rows], pa.int32())]
            columns.append(pa.array([[{"start": a, "end": z, "lang": x} for a, z, x in who.spans(t, r[2], r[3])] for t, r in zip(texts, rows)], span))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "n_spans", "spans"])

    return common.id_text(docs).mapInArrow(run, out)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans and spans (start, end, lang) of every document."""
    found = languages(docs, learn(docs, sample_rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans", "spans")


def keep(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """docs without those whose language is unknown or labels less than a share of their letters."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def prepare():
        label = labeller(sent.value, FEW_WORDS).label

        def test(b: pa.RecordBatch) -> list[bool]:
            found = (label(t or "") for t in b.column("text").to_pylist())
            return [lang != UNKNOWN and score >= least for lang, score, _, _ in found]

        return test

    return common.keep_rows(docs, prepare)
