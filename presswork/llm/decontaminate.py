"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with runs of blanks as one space. An item of m characters may differ by
k = floor(error_rate * m) edits. Cut into k + 1 pieces, one piece of it must then stand unchanged in the text. All
pieces of all items are one Aho-Corasick automaton; around each hit, Myers' bit-parallel algorithm gives the least edit
distance of the whole item to any substring, and where it ends.

Items are worked off in blocks of at most BLOCK_CHARS characters: the driver holds one block at a time and broadcasts it;
with more than one block each block's results are written before the next is read. Null or empty texts and items match
nothing; repeated items give a row each, repeated documents too; a text with several places for an item gives the best, then
the first; very long texts are searched whole; ids may be of any type; other columns are not read, or are carried along.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import written

#: Characters of items in one automaton.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) that cover the item and differ in length by one at most."""
    n = min(k + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(item: str, eq: dict[str, int], text: str, k: int, anchored: bool = False) -> tuple[int, int]:
    """(least distance, end in text) of the item against any substring of text, if anchored any prefix; distance k + 1 if none is within k."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = ((e & pv) + pv ^ pv) | e
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 | anchored, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


def first_of(item: str, text: str, end: int, distance: int) -> int:
    """Where the shortest substring of text that ends at end and is so far from the item starts."""
    back = text[max(0, end - len(item) - distance) : end][::-1]
    return end - myers(item[::-1], masks(item[::-1]), back, distance, anchored=True)[1]


class Matcher:
    """The automaton over the pieces of some items; made once for each task."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if t := normal(text):
                k = int(error_rate * len(t))
                self.items.append((item_id, t, k, masks(t)))
                for offset, piece in pieces(t, k):
                    at.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.auto = ahocorasick.Automaton()
        for piece, places in at.items():
            self.auto.add_word(piece, (len(piece), places))
        self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(number of the item, distance, start, end) in the normal form of text; one for each item that it holds."""
        if not len(self.auto):
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (n, places) in self.auto.iter(text):
            for i, offset in places:
                _, item, k, _ = self.items[i]
                start = last + 1 - n - offset
                lo, hi = max(0, start - k), min(len(text), start + len(item) + k)
                own = windows.setdefault(i, [])
                if own and lo <= own[-1][1]:  # neighbouring diagonals are one window
                    own[-1] = (min(lo, own[-1][0]), max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        found = []
        for i, spans in windows.items():
            _, item, k, eq = self.items[i]
            best = (k + 1, -1)
            for lo, hi in spans:
                d, end = myers(item, eq, text[lo:hi], k)
                if d < best[0]:
                    best = (d, lo + end)
            if best[0] <= k:
                found.append((i, best[0], first_of(item, text, best[1], best[0]), best[1]))
        return found


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of a bounded size, one after the other."""
    out, size = [], 0
    for item_id, text in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        if size + len(text or "") > BLOCK_CHARS and out:
            yield out
            out, size = [], 0
        out.append((item_id, text))
        size += len(text or "")
    yield out


def each_block(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[object, str]], bool]]:
    """(block, whether it is the only one)."""
    rest = blocks(items, id_col, text_col)
    block, next_ = next(rest), next(rest, None)
    only = next_ is None
    while block is not None:
        yield block, only
        block, next_ = next_, next(rest, None)


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, budget, match_start, match_end, matched: one row for each document and item that it holds within the budget.

    Places are those of the document's normal form, of which matched is the passage.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    arrow = to_arrow_type(items.schema[item_id_col].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block, only in each_block(items, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast((block, error_rate))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for batch in batches:
                ids, got = batch.column(0), []
                for row, text in enumerate(batch.column(1)):
                    t = normal(text.as_py())
                    got += [(row, *x, t[x[2] : x[3]]) for x in matcher.find(t)] if t else []
                if got:
                    row, item, dist, start, end, piece = zip(*got, strict=True)
                    own = [matcher.items[i] for i in item]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array([x[0] for x in own], arrow), pa.array(dist, pa.int32()), pa.array([x[2] for x in own], pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(piece)], ["doc_id", "item_id", "distance", "budget", "match_start", "match_end", "matched"])

        part = rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, distance int, budget int, match_start int, match_end int, matched string")
        if not only:
            part = written(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item within its budget. Maps rows; nothing is shuffled."""
    for block, only in each_block(items, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast((block, error_rate))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=docs.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = written(docs)
            sent.destroy()
    return docs
