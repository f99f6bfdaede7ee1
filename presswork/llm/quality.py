"""Quality rules and line labelling by a linear-chain conditional random field.

A text's lines (cut at \\n) are a sequence, each content (1) or boilerplate (0). Viterbi decoding finds the likeliest
labelling under line features and label transitions; the share of a text's words in content lines decides whether
it is kept, after the plain rules. The field's weights are trained here, by gradient ascent on the exact likelihood
(forward-backward), on a bounded sample of labelled documents: lines of documents of good quality are content but for
those repeated in the text, lines of the others are boilerplate.

Null texts have no words; they and texts without a word fail the plain rules; ties in decoding go to content; contradicting
labels of an id count as bad. Repeated rows are judged alike; very long texts are a chunk of their own; other columns are not
read; empty tables give no rows, and without labels every line counts as the untrained field says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U64, Chunk, Words, chunks, grams, inside, mix, span_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;')")] = True
FEATURES = 12


def in_row_repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more in its row, not the first of its kind in its row) for items in order."""
    key = mix(row.astype(U64) + U64(1)) ^ h
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


class Lines:
    """Counts and line features of a chunk; line i belongs to row doc[i]."""

    def __init__(self, chunk: Chunk):
        data, at = chunk.data, chunk.at
        words = self.words = Words(chunk)
        lead = (data & 0xC0) != 0x80  # first byte of each code point
        points = np.concatenate(([0], np.cumsum(lead)))
        length = points[words.end] - points[words.start]
        total = lambda x: np.concatenate(([0], np.cumsum(x)))
        per_row = lambda x: (lambda t: t[words.row[1:]] - t[words.row[:-1]])(total(x))
        self.n_words, self.word_chars = words.count, per_row(length)
        sym, up, dig = total(SYMBOLS[data]), total(_UPPER[data]), total(_DIGIT[data])
        self.n_symbols = sym[at[1:]] - sym[at[:-1]]

        h = words.hashes()
        g, ok = grams(h, 3), inside(words, 3)
        first = np.flatnonzero(ok)
        twice, _ = in_row_repeats(words.doc[first], g[first])
        covered = np.zeros(words.n + 1, np.int32)
        starts = first[twice]
        for i in range(3):
            covered[starts + i] = 1
        self.n_repeat_words = per_row(covered[: words.n])

        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(at, breaks, "right") - 1
        start = np.sort(np.concatenate((at[:-1], breaks + 1)))
        self.doc = np.repeat(np.arange(chunk.n), 1 + np.bincount(owner, minlength=chunk.n)) if chunk.n else np.zeros(0, int)
        end = np.empty(len(start), np.int64)
        if len(start):
            last = np.flatnonzero(np.append(self.doc[1:] != self.doc[:-1], True))
            end[:-1] = start[1:] - 1
            end[last] = at[1:]
        w0, w1 = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
        self.line_words = w1 - w0
        has = self.line_words > 0
        lh = span_hashes(data, start, end)
        with_word = np.flatnonzero(has)
        again, later = in_row_repeats(self.doc[with_word], lh[with_word])
        self.again, dup = np.zeros(len(start), bool), np.zeros(len(start), bool)
        self.again[with_word], dup[with_word] = again, later
        self.n_dup_lines = np.bincount(self.doc[dup], minlength=chunk.n)
        chars = np.maximum(points[end] - points[start], 1)
        n = np.maximum(self.line_words, 1)
        rep = total(covered[: words.n])
        tail = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(start), np.uint8)
        wl = total(length)
        self.x = np.stack(
            [
                np.ones(len(start)),
                np.log1p(self.line_words) / 3,
                self.line_words < 4,
                np.minimum((sym[end] - sym[start]) / chars * 10, 3),
                (up[end] - up[start]) / chars * 3,
                (dig[end] - dig[start]) / chars * 3,
                self.again,
                (rep[w1] - rep[w0]) / n * 2,
                np.where(has, _END[tail], False),
                np.minimum((wl[w1] - wl[w0]) / n / 6, 3),
                (wl[w1] - wl[w0]) / n > 15,
                ~has,
            ],
            1,
        ).astype(np.float64)
        self.bounds = np.searchsorted(self.doc, np.arange(chunk.n + 1))


class Field:
    """Weights of the field: emit (features x 2 labels) and move (from label x to label)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest label of each line, row by row."""
        score = x @ self.emit
        labels = np.zeros(len(x), np.int8)
        a, b = score[:, 0].tolist(), score[:, 1].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if lo == hi:
                continue
            s0, s1, back = a[lo], b[lo], []
            for i in range(lo + 1, hi):
                to0, via0 = (s1 + m10, 1) if s1 + m10 >= s0 + m00 else (s0 + m00, 0)
                to1, via1 = (s1 + m11, 1) if s1 + m11 >= s0 + m01 else (s0 + m01, 0)
                back.append((via0, via1))
                s0, s1 = to0 + a[i], to1 + b[i]
            y = 1 if s1 >= s0 else 0
            for i in range(hi - 1, lo, -1):
                labels[i] = y
                y = back[i - lo - 1][y]
            labels[lo] = y
        return labels


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.5, penalty: float = 1e-3) -> Field:
    """Gradient ascent on the likelihood of the labels; each sequence is (lines x features, labels)."""
    emit, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    if not sequences:
        emit[0, 1] = 1.0  # nothing to learn from: all is content
        return Field(emit, move)
    x = np.concatenate([s for s, _ in sequences])
    y = np.concatenate([t for _, t in sequences]).astype(int)
    size = np.array([len(t) for _, t in sequences])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    longest = int(size.max())
    one = np.eye(2)[y]
    g_emit, g_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(steps):
        s = x @ emit
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[first] = s[first]
        for t in range(1, longest):  # all sequences that are long enough, at once
            i = first[size > t] + t
            z = alpha[i - 1][:, :, None] + move
            alpha[i] = np.logaddexp(z[:, 0], z[:, 1]) + s[i]
        for t in range(longest - 2, -1, -1):
            i = first[size > t + 1] + t
            z = (beta[i + 1] + s[i + 1])[:, None, :] + move
            beta[i] = np.logaddexp(z[:, :, 0], z[:, :, 1])
        log_z = np.repeat(np.logaddexp(*alpha[first + size - 1].T), size)
        p = np.exp(alpha + beta - log_z[:, None])
        inner = np.ones(len(x), bool)
        inner[first] = False
        i = np.flatnonzero(inner)
        pair = np.exp(alpha[i - 1][:, :, None] + move + (beta[i] + s[i])[:, None, :] - log_z[i][:, None, None])
        d_emit = x.T @ (one - p) / len(x) - penalty * emit
        d_move = ((one[i - 1][:, :, None] * one[i][:, None, :]) - pair).sum(0) / len(x) - penalty * move
        g_emit, g_move = g_emit + d_emit**2, g_move + d_move**2
        emit, move = emit + rate * d_emit / np.sqrt(g_emit), move + rate * d_move / np.sqrt(g_move)
    return Field(emit, move)


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 2_000) -> Field:
    """The field from about max_train_docs labelled documents, chosen by a hash of the id, with all their lines."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    good = known.filter("quality = 1").count()
    each = max_train_docs / 2
    share = F.when(F.col("quality") == 1, each / max(1, good)).otherwise(each / max(1, n - good))
    known = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    # The sample is at most a few thousand rows of two numbers by max_train_docs.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            lines = Lines(chunk)
            quality = chunk.column("quality").to_pylist()
            for i in range(chunk.n):
                a, b = int(lines.bounds[i]), int(lines.bounds[i + 1])
                y = np.full(b - a, quality[i], np.int8) & ~(lines.again[a:b] & (lines.line_words[a:b] < 8))
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id").slice(i, 1).cast(pa.string()), pa.array([lines.x[a:b].tobytes()], pa.binary()), pa.array([y.astype(np.int8).tobytes()], pa.binary())], ["doc_id", "x", "y"])

    got = sorted((r["doc_id"], bytes(r["x"]), bytes(r["y"])) for r in sample.mapInArrow(run, "doc_id string, x binary, y binary").collect())
    return fit([(np.frombuffer(x).reshape(-1, FEATURES), np.frombuffer(y, np.int8)) for _, x, y in got if y])


def judge(docs: DataFrame, field: Field, least_words: int = 50, most_repeat: int = 50, least_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share. Maps rows; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((field.emit, field.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for chunk in chunks(batches):
            c = Lines(chunk)
            y = field.decode(c.x, c.bounds)
            content = np.bincount(c.doc, c.line_words * y, minlength=chunk.n)
            share = content / np.maximum(c.n_words, 1)
            failed = (c.n_words < least_words) | (100 * c.n_repeat_words > most_repeat * c.n_words)
            long = lambda x: pa.array(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *map(long, (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)), pa.array(failed), pa.array(~failed & (share >= least_content)), pa.array(share)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
