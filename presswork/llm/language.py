"""Language identification, word first with backoff.

A model has, for each language, the log frequencies of known words and of character n-grams (4 down to 1, with word
edges). A known word adds its log frequency by language. For an unseen word the longest n-grams of which any is known
are used, by their mean, and shorter ones only if none is. The language with the largest sum over the whole text wins;
its score is the share that it has after the sums are divided by the square root of the number of words.

Training reads at most about max_train_docs labelled documents, chosen by a hash of the id, which bounds the model and the
driver's share; all their words and n-grams that occur twice or more are known ones.
Null texts and texts without a letter are "und" with score 0, and so is everything if there is nothing to learn from.
Languages that tie are settled by code point; repeated rows count as often as they are there and are judged alike; very long
texts are chunks of their own; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import _BASE, _UNBASE, U64, _power, chunks, mix

LONGEST = 4
#: Letters by category; number signs such as ² and Ⅳ are none.
_LETTER = regex.compile(r"\p{L}")
_EDGE = 0x20
_GRAM = U64(0x100000001B3)


class Points:
    """The code points of lower-cased texts joined by blanks, with the words cut at non-letters."""

    def __init__(self, texts: list[str]):
        joined = " \n ".join(texts) + " "
        self.code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        letter = _letters(self.code)
        before = np.concatenate(([False], letter[:-1]))
        self.start = np.flatnonzero(letter & ~before)
        self.end = np.flatnonzero(~letter & before)
        self.doc = np.searchsorted(np.flatnonzero(self.code == 10), self.start)

    def gram_hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n code points from each place on; the edges of a word count as a blank."""
        h = np.full(len(at), n, U64)
        for i in range(n):
            c = self.code[np.minimum(at + i, len(self.code) - 1)]
            h = h * _GRAM + c.astype(U64)
        return mix(h)


_table = np.zeros(0x110000, np.int8)


def _letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters; looked up once for each that occurs."""
    known = _table[code]
    if (new := np.unique(code[known == 0])).size:
        _table[new] = [1 if _LETTER.match(chr(c)) else -1 for c in new.tolist()]
        known = _table[code]
    return known > 0


def _lowered(texts: list[str]) -> list[str]:
    return [t.lower().replace("\n", " ") for t in texts]


def word_hashes(p: Points) -> np.ndarray:
    """64-bit hashes of the words of p."""
    n = len(p.code)
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(p.code.astype(U64) + U64(1)) * _power(_BASE, n), out=total[1:])
    return mix((total[p.end] - total[p.start]) * _power(_UNBASE, n + 1)[p.start] + (p.end - p.start).astype(U64))


def grams_of(p: Points, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into which, hash) of every n-gram of the given words, the blank on each side included for n > 1."""
    pad = 1 if n > 1 else 0
    first, length = p.start[which] - pad, p.end[which] - p.start[which] + 2 * pad - n + 1
    length = np.maximum(length, 0)
    owner = np.repeat(np.arange(len(which)), length)
    at = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return owner, p.gram_hashes(n, np.maximum(at, 0))


def _edged(p: Points) -> None:
    """All that isn't a letter counts as a blank in n-grams."""
    code = p.code.copy()
    code[~_letters(code)] = _EDGE
    p.code = code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for chunk in chunks(batches, "text"):
        texts, langs = chunk.strings(), chunk.column("lang").to_pylist()
        p = Points(_lowered(texts))
        hashes = word_hashes(p)
        _edged(p)
        codes = {lang: i for i, lang in enumerate(sorted(set(langs)))}
        names = list(codes)
        of = np.array([codes[x] for x in langs])[p.doc] if len(p.doc) else np.zeros(0, int)
        for n in range(LONGEST + 1):
            owner, h = (np.arange(len(hashes)), hashes) if n == 0 else grams_of(p, np.arange(len(p.start)), n)
            for i, lang in enumerate(names):
                values, times = np.unique(h[of[owner] == i], return_counts=True)
                for v, c in zip(values.tolist(), times.tolist(), strict=True):
                    counts[n, v, lang] += c
        if len(counts) > 1_000_000:
            yield _counted(counts)
            counts.clear()
    if counts:
        yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    n, h, lang = zip(*counts, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(np.array(h, U64).view(np.int64)), pa.array(lang), pa.array(list(counts.values()), pa.int64())], ["n", "h", "lang", "c"])


class Model:
    """known[n]: sorted hashes; logs[n]: log frequency by hash and language. n 0: words."""

    def __init__(self, langs: list[str], known: list[np.ndarray], logs: list[np.ndarray]):
        self.langs, self.known, self.logs = langs, known, logs

    def rows(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are known, their row)."""
        if not len(self.known[n]):
            return np.zeros(len(h), bool), np.zeros(len(h), int)
        at = np.minimum(np.searchsorted(self.known[n], h), len(self.known[n]) - 1)
        return self.known[n][at] == h, at

    def sums(self, p: Points, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log frequencies by document and language, number of words by document)."""
        values, where, back = np.unique(word_hashes(p), return_index=True, return_inverse=True)
        score = np.zeros((len(values), len(self.langs)))
        has, at = self.rows(0, values)
        score[has] = self.logs[0][at[has]]
        _edged(p)
        left = np.flatnonzero(~has)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            owner, h = grams_of(p, where[left], n)
            got, at = self.rows(n, h)
            times = np.bincount(owner[got], minlength=len(left))
            for j in range(len(self.langs)):
                total = np.bincount(owner[got], self.logs[n][at[got], j], minlength=len(left))
                score[left[times > 0], j] = total[times > 0] / times[times > 0]
            left = left[times == 0]
        out = np.stack([np.bincount(p.doc, score[back, j], minlength=docs) for j in range(len(self.langs))], 1)
        return out, np.bincount(p.doc, minlength=docs)


def train(labelled: DataFrame, max_train_docs: int = 10_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5, least: int = 1) -> Model | None:
    """A model of the languages of about max_train_docs rows (by hash of the id), or None if there are none with a letter.

    Words and n-grams that occur less than `least` times in these are not known ones; 1, the default, keeps all."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.select(id_col).count()
    share = min(1.0, max_train_docs / max(1, n))
    some = rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    some = some.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = some.mapInArrow(_count, "n int, h long, lang string, c long").groupBy("n", "h", "lang").agg(F.sum("c").alias("c"))
    by = counts.groupBy("n", "h").agg(F.sum("c").alias("total"), F.collect_list(F.struct("lang", "c")).alias("by")).filter(F.col("total") >= least)
    got = by.select("n", "h", F.explode("by").alias("x")).select("n", "h", "x.lang", "x.c").toArrow()
    langs = sorted(set(got["lang"].unique().to_pylist()))
    if not langs:
        return None
    n, h, c = (np.asarray(got[x]) for x in ("n", "h", "c"))
    lang = np.array([langs.index(x) for x in got["lang"].unique().to_pylist()], int)[np.asarray(got["lang"].combine_chunks().dictionary_encode().indices)]
    known, logs = [], []
    for i in range(LONGEST + 1):
        own = n == i
        hashes, row = np.unique(h[own].astype(np.int64).view(U64), return_inverse=True)
        count = np.zeros((len(hashes), len(langs)), np.float32)
        count[row, lang[own]] = c[own]
        known.append(hashes)
        logs.append(np.log((count + smooth) / (count.sum(0) + smooth * max(1, len(hashes)))).astype(np.float32))
    return Model(langs, known, logs)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row. Maps rows; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for chunk in chunks(batches, "text"):
            texts = chunk.strings()
            lettered = np.array([bool(_LETTER.search(t)) for t in texts], bool) & (model is not None)
            names, score = np.full(chunk.n, "und", object), np.zeros(chunk.n)
            if lettered.any():
                sums, words = model.sums(Points(_lowered(texts)), chunk.n)
                sums = sums / np.sqrt(np.maximum(words, 1))[:, None]
                odds = np.exp(sums - sums.max(1, keepdims=True))
                share = odds.max(1) / odds.sum(1)
                names[lettered] = np.array(model.langs, object)[sums.argmax(1)][lettered]
                score[lettered] = share[lettered]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
