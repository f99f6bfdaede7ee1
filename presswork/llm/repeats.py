"""Removal of repeated passages by seed and extend.

Seeds: of each window of N words, the K-word gram with the least hash (the leftmost of equals) is the window's anchor.
Two equal windows have equal anchors at the same place, so joining documents on anchors loses no repeat; only about
one gram in (N - K) / 2 is an anchor. Extension: around an anchor stand all windows (N words each) of which it is the
anchor, to the left and to the right; two anchors' surroundings agree as far as their windows do, and neighbouring
anchors carry on from there, so the equal windows joined together are the maximal repeats of N words or more.

What moves is packed: for each anchor one record with the document, the place, and the hashes of its windows, in one
blob for each task, share of the texts and bucket of anchors. Before that, a task drops windows that it has itself seen
earlier (it knows already that they are repeats), so a passage in a third of all documents sends a few records for each
task. A bucket is worked off at a time, in sorted arrays.

Ids must be integers. Null and empty texts have no words. Rows of one id and different texts are documents of their own, in
the order of a hash of the text. A null id is never compared and loses nothing. Of equal windows the one with the smaller id,
then hash, then place, stays; a place that ties with itself (rows equal in id and text) is no repeat. Very long texts are a chunk of their own; other columns are not read;
empty tables give no rows. Windows are equal if 64 bits are: 48 of the window's hash, folded with the anchor's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U64, Words, chunks, grams, inside, mix

#: Words of an anchor.
K = 5
#: Bytes of text after which a task sends off its blobs.
FLUSH = 16_000_000
_LOW48 = U64((1 << 48) - 1)


def anchors_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, window hash, anchor hash) of every n-word window within a row."""
    h = words.hashes()
    start = np.flatnonzero(inside(words, n))
    if not len(start):
        return start, np.zeros(0, U64), np.zeros(0, U64)
    g = grams(h, K)
    width = n - K + 1
    best, span = np.arange(len(g)), 1  # place of the least hash among the next span grams
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best, span = np.where(g[a] <= g[b], a, b), span * 2
    if span < width:
        a, b = best[: len(best) - (width - span)], best[width - span :]
        best = np.where(g[a] <= g[b], a, b)
    return start, grams(h, n)[start], g[best[start]]


class Records:
    """Windows of many documents: key of the anchor, window hash, document (id, then the text's hash), place."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)

    def take(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.bytes = [], 0
        return out


def later(key: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which items have an equal key with an earlier (doc, tie, place)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    some = order[same[:-1] | same[1:]]
    out = np.zeros(len(key), bool)
    if len(some):
        some = some[np.lexsort((place[some], tie[some], doc[some], key[some]))]
        k, d, t, p = key[some], doc[some], tie[some], place[some]
        head = np.ones(len(some), bool)
        head[1:] = k[1:] != k[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))
        out[some] = (d != d[first]) | (t != t[first]) | (p != p[first])
    return out


def ranges(doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """For each document the first places and lengths of its runs of places, as bytes."""
    order = np.lexsort((place, tie, doc))
    doc, tie, place = doc[order], tie[order], place[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    new = other.copy()
    new[1:] |= place[1:] > place[:-1] + 1
    at = np.flatnonzero(new)
    length = place[np.append(at[1:], len(place)) - 1] - place[at] + 1
    runs = np.stack([place[at], length], 1).astype(np.int32)
    cut = np.append(np.flatnonzero(other[at]), len(at))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(doc[at[a]]), int(tie[at[a]]), runs[a:b].tobytes()


SENT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("runs", pa.binary()), ("anchors", pa.binary()), ("windows", pa.binary())])
RECORD = np.dtype([("anchor", "<u8"), ("doc", "<u4"), ("place", "<u4"), ("mask", "<u2")])


def pack(records: Records, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, and one for each document of which windows are repeats within these records."""
    anchor, window, doc, tie, place = records.take()
    gone = later(window ^ mix(anchor), doc, tie, place)
    if gone.any():
        docs, ties, runs = zip(*ranges(doc[gone], tie[gone], place[gone]), strict=True)
        docs = np.array(docs, np.int64)
        bucket = (mix(docs.view(U64)) % U64(buckets)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(docs), pa.array(ties, pa.int64()), pa.array(runs, pa.binary()), pa.nulls(len(docs), pa.binary()), pa.nulls(len(docs), pa.binary())], schema=SENT)
    # windows with one anchor stand together; a record has 16 of them at most
    run = np.ones(len(anchor), bool)
    run[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(run)
    step = np.arange(len(anchor)) - np.repeat(at, np.diff(np.append(at, len(anchor))))
    run |= step % 16 == 0
    at = np.flatnonzero(run)
    owner = np.cumsum(run) - 1
    step = np.arange(len(anchor)) - at[owner]
    other = np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))
    docs, number = np.unique(np.stack([doc[other], tie[other]], 1), axis=0, return_inverse=True)
    number = number.ravel()[np.cumsum(other) - 1]
    head = np.zeros(len(at), RECORD)
    head["anchor"], head["doc"], head["place"] = anchor[at], number[at], place[at]
    mask = np.zeros(len(at), np.uint16)
    keep = ~gone
    np.bitwise_or.at(mask, owner[keep], np.uint16(1) << step[keep].astype(np.uint16))
    head["mask"] = mask
    bucket = (mix(anchor[at]) % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    order = order[mask[order] != 0]
    per = np.bincount(owner[keep], minlength=len(at))
    first = np.concatenate(([0], np.cumsum(per)))
    low = window[keep].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    out = []
    for a, b in _groups(bucket[order]):
        own = order[a:b]
        used, new = np.unique(head["doc"][own], return_inverse=True)
        own_head = head[own]
        own_head["doc"] = new
        take = np.repeat(first[own], per[own]) + np.arange(per[own].sum()) - np.repeat(np.cumsum(per[own]) - per[own], per[own])
        out.append((int(bucket[own[0]]), docs[used].tobytes(), own_head.tobytes(), low[take].tobytes()))
    if out:
        n, ids, heads, lows = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()), pa.array(ids, pa.binary()), pa.array(heads, pa.binary()), pa.array(lows, pa.binary())], schema=SENT)


def _groups(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, int)
    return zip(cut, np.append(cut[1:], len(sorted_values)), strict=True)


def unpack(ids: bytes, heads: bytes, lows: bytes) -> tuple[np.ndarray, ...]:
    """(key, doc, tie, place) of the windows of a blob."""
    docs, head = np.frombuffer(ids, np.int64).reshape(-1, 2), np.frombuffer(heads, RECORD)
    low = np.frombuffer(lows, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    record, bit = np.nonzero((head["mask"][:, None] >> np.arange(16, dtype=np.uint16)) & 1)
    return wide.view("<u8").ravel().astype(U64) ^ mix(head["anchor"])[record], *docs[head["doc"][record]].T, head["place"][record].astype(np.int64) + bit


def repeated_runs(docs: DataFrame, n: int = 20, buckets: int | None = None) -> DataFrame:
    """doc_id, tie (a hash of the text), runs: places and lengths (pairs of int32) of runs of n-word windows that also start earlier; several rows for a document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = Records()
        for chunk in chunks(batches):
            ids, ties = np.asarray(chunk.column("doc_id")), np.asarray(chunk.column("tie"))
            words = Words(chunk)
            start, window, anchor = anchors_of(words, n)
            records.add(anchor, window & _LOW48, ids[words.doc[start]], ties[words.doc[start]], words.place[start])
            records.bytes += len(chunk.data)
            if records.bytes > FLUSH and records.parts:
                yield from pack(records, buckets)
        if records.parts:
            yield from pack(records, buckets)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                key, doc, tie, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                parts.clear()
                gone = later(key, doc, tie, place)
                if gone.any():
                    ids, ties, runs = zip(*ranges(doc[gone], tie[gone], place[gone]), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(runs, pa.binary())], ["doc_id", "tie", "runs"])

        for batch in batches:
            known = batch.filter(batch.column(1).is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), known.column(3)], ["doc_id", "tie", "runs"])
            rest = batch.filter(batch.column(1).is_null())
            for bucket, ids, heads, lows in zip(rest.column(0).to_pylist(), rest.column(3), rest.column(4), rest.column(5), strict=True):
                if bucket != at:
                    yield from done()
                    at = bucket
                parts.append(unpack(ids.as_py(), heads.as_py(), lows.as_py()))
        yield from done()

    sent = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(seeds, "bucket int, doc_id long, tie long, runs binary, anchors binary, windows binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(extend, "doc_id long, tie long, runs binary")


def remove_repeats(docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one blank), kept_sha256, passages: one row for each row of docs.

    passages: start (a word's number, from 0) and words of each maximal run of words that repeats.
    """
    span = pa.struct([("start", pa.int32()), ("words", pa.int32())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = repeated_runs(rows, n).groupBy(F.col("doc_id").alias("of"), "tie").agg(F.collect_list("runs").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                total, gone, kept, sha, passages = [], [], [], [], []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    total.append(len(words))
                    passages.append([])
                    if runs:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for place, length in np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2).tolist():
                            edge[place] += 1
                            edge[place + length + n - 1] -= 1
                        stay = np.cumsum(edge[:-1]) == 0
                        words = [w for w, ok in zip(words, stay.tolist(), strict=True) if ok]
                        turns = np.flatnonzero(np.diff(np.concatenate(([True], stay, [True]))))
                        passages[-1] = [{"start": a, "words": b - a} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
                    gone.append(total[-1] - len(words))
                    joined = b" ".join(words)
                    kept.append(joined.decode())
                    sha.append(hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string()), pa.array(passages, pa.list_(span))], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "passages"])

    joined = rows.join(runs, (rows["doc_id"] == runs["of"]) & (F.xxhash64(rows["text"]) == runs["tie"]), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, passages array<struct<start: int, words: int>>")
