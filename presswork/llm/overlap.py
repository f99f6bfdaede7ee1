"""n-gram Jaccard join over a two-level R-tree of count vectors.

A document is the set of its word n-grams. Its tokens are hashed into groups, and the counts of the groups make it a
point; the overlap of two sets is at most the sum of coordinate minima of their points. Two sets that link differ in
at most t tokens, t growing with the size.

Upper level: sizes are cut into bands, and in each band the tokens into t + 1 + m slabs of coordinates. Points that
link agree in all coordinates of m + 1 slabs at least (else they would differ in more than t tokens), so the tree's inner
nodes are the values of a slab, a box without extent in its coordinates; a point is in t + 1 + m nodes. Nodes with one
point are dropped at once, which is where nearly all points go, and of nodes with the same points one is kept.
A passage that very many texts share makes nodes of very many points. A point that is in m such nodes at most leaves them:
it shares another node with each point that it links with. Only points with more of them stay, such as large groups of
near copies. m grows with t, to MOST_LEFT; sets of a few tokens have none to spare.
Lower level: the points of a node, with as many groups as their size asks for, are packed into pages by size; a page has
a box. A point meets a page, then its points, if the sum of coordinate minima of box corner, then of counts, allows a link.

Rows stay linear in points, however large a group of near copies is: a node doesn't give out its pairs but at most one
pair less than it has points, those that span the components of "the bounds allow a link" (first with two hubs of
each node, then, in the nodes that are still in pieces, by a search that compares reached points with unreached ones).
The components of these pairs are clusters; no link leaves a cluster, and a point is in one cluster at most. So texts
move once, to their cluster, where all pairs that sizes allow are verified on their tokens; large clusters are dealt out by
pairs of parts. That gives every link: counted, listed, or as one pair less than points for the components.

Equal sets are one point. Sets are told apart by 64 bits, tokens by 64 bits: among 10^9 different sets the chance that
any two are taken for one is 3 %. Texts without a word are the empty set, linked with nothing. Null ids are returned
with a null component and linked with nothing; equal rows have equal sets and so one component; a component is named by
its least id, so ties need no rule; very long texts are a chunk of their own; other columns, whatever their name, are not
read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import bounded_batches, dropped, written
from .textvec import U64, Words, chunks, grams, mix

GROUPS = 64
#: Points of a node that one task may hold on each side.
PAGE_GROUP = 2_048
#: Points of a page.
PAGE = 64
#: Tokens of a component that one task may hold on each side.
PAGE_TOKENS = 4_000_000
#: Cells of the table of points by tokens that are multiplied at once.
CELLS = 4_000_000
FLUSH = 12_000_000
#: Points of a node that points may leave, and from how many such nodes at most.
CROWD = 2_048
MOST_LEFT = 4
#: Buckets of nodes, if there are fewer partitions.
BUCKETS = 512
_BAND = 1.5


@dataclass(frozen=True)
class Link:
    """Sets link if den * overlap >= num * union."""

    n: int
    num: int
    den: int

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges(), size, "right") - 1

    def edges(self) -> np.ndarray:
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * _BAND)))
        return np.array(out)

    def spare(self, differ):
        """How many more nodes than one two points share that differ in so many tokens at most: m."""
        return np.minimum(MOST_LEFT, (differ + 1) // 8)

    def slabs(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(t + 1 + m, m), t: the most tokens in which a set of the band and a set that isn't smaller can differ and link."""
        top = self.edges()[np.asarray(band) + 1] - 1
        differ = top * (self.den - self.num) // self.num
        return differ + 1 + self.spare(differ), self.spare(differ)

    def may_leave(self, size: Column) -> Column:
        """How many nodes a point may leave: m of the smallest set that it can link with, which no band's m is below."""
        least = F.ceil(size * self.num / self.den)
        return F.least(F.lit(MOST_LEFT), F.floor((F.floor(least * (self.den - self.num) / self.num) + 1) / 8))

    def least_partner(self, size: np.ndarray) -> np.ndarray:
        return -(-size * self.num // self.den)

    def need(self, total):
        """Least overlap of a link of sets that have total tokens together: overlap * (den + num) >= num * total."""
        return -(-self.num * total // (self.den + self.num))


def token_sets(chunk, link: Link) -> list[np.ndarray]:
    """The sorted distinct token hashes of each row."""
    words = Words(chunk)
    h = words.hashes(lower=True)
    g = grams(h, link.n)
    out = []
    for a, b, c in zip(words.row[:-1].tolist(), words.row[1:].tolist(), words.count.tolist(), strict=True):
        if c >= link.n:
            s = g[a : b - link.n + 1].copy()
            s.sort()
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif c:  # a sequence shorter than n is a token of its own kind
            out.append(mix(grams(h[a:b], c) ^ U64(0xA5A5A5A5)))
        else:
            out.append(np.zeros(0, U64))
    return out


def digest(s: np.ndarray) -> int:
    return int((mix(s).sum(dtype=U64) ^ mix(np.array([len(s)], U64))[0]).view(np.int64)) if len(s) else 0


def points(docs: DataFrame, link: Link) -> DataFrame:
    """doc_id, text_key, size, point (64-bit digest of the set): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            sets = token_sets(chunk, link)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64())], ["doc_id", "text_key", "size", "point"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, size long, point long")


def slab_values(sets: list[np.ndarray], link: Link) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) for every slab of every set: the node is a hash of band, slab and the counts in it.

    The fine groups are so many that a group's count is the tokens in it; a slab's value sums a hash of them.
    """
    size = np.array([len(s) for s in sets], np.int64)
    rows = np.flatnonzero(size)
    own = link.band(size[rows])
    other = link.band(link.least_partner(size[rows]))
    two = own != other
    row = np.concatenate((rows, rows[two]))
    band = np.concatenate((own, other[two]))
    k, spare = link.slabs(band)
    first = np.concatenate(([0], np.cumsum(k)))
    total = np.zeros(int(first[-1]), U64)
    if len(row):
        token = np.concatenate([sets[r] for r in row.tolist()])
        n = size[row]
        slab = ((token >> U64(24)) % np.repeat(k, n).astype(U64)).astype(np.int64) + np.repeat(first[:-1], n)
        np.add.at(total, slab, mix(token + U64(0x51)))
    owner = np.repeat(row, k)
    number = np.arange(int(first[-1])) - np.repeat(first[:-1], k)
    # Each slab with a token in which a pair doesn't agree has a difference. A set whose slabs with a token are by more than
    # m more than the differences it can have with any partner needn't be in empty slabs' nodes, which else would hold most sets.
    full = total != 0
    held = np.add.reduceat(full, first[:-1]) if len(k) else np.zeros(0, int)
    own = size[row] * (link.den - link.num) // link.num
    send = full | np.repeat(held <= own + spare, k)
    return owner[send], mix(total ^ mix(np.repeat(band, k).astype(U64) * U64(1 << 32) + number.astype(U64)))[send]


SENT = pa.schema([("bucket", pa.int32()), ("points", pa.binary()), ("owners", pa.binary()), ("nodes", pa.binary())])


def nodes(docs: DataFrame, link: Link) -> DataFrame:
    """node, point: the points of every node that has two or more."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * max(1, BUCKETS // parts)  # a task works off a bucket at a time

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            point, node = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (node % U64(buckets)).astype(np.int32)
            order = np.lexsort((point, bucket))
            cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            out = []
            for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
                own = order[a:b]
                used, owner = np.unique(point[own], return_inverse=True)
                # 40 bits of the node beside the bucket; a false match is found out when it is verified
                low = (node[own] >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                times = np.bincount(owner)
                out.append((int(bucket[own[0]]), used.tobytes(), times.astype(np.uint16 if times.max() < 65536 else np.uint32).tobytes(), np.ascontiguousarray(low).tobytes()))
            n, used, owner, low = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(used, pa.binary()), pa.array(owner, pa.binary()), pa.array(low, pa.binary())], schema=SENT)

        for chunk in chunks(batches):
            sets = token_sets(chunk, link)
            point = [digest(s) for s in sets]
            for i, p in enumerate(point):
                if p in seen:
                    sets[i] = sets[i][:0]  # a copy of what this task has dealt already
                elif len(seen) < 500_000:
                    seen.add(p)
            owner, node = slab_values(sets, link)
            if len(owner):
                held.append((np.array(point, np.int64)[owner], node))
            size += len(chunk.data)
            if size > FLUSH and held:
                yield from send()
                size = 0
        if held:
            yield from send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not got:
                return
            point, node = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            order = np.argsort(node, kind="stable")
            node, point = node[order], point[order]
            same = node[1:] == node[:-1]
            some = np.append(same, False) | np.append(False, same)
            node, point = node[some], point[some]
            order = np.lexsort((point, node))
            node, point = node[order], point[order]
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (point[1:] != point[:-1])
            node, point = node[new], point[new]
            same = node[1:] == node[:-1]
            some = np.append(same, False) | np.append(False, same) if len(node) else np.zeros(0, bool)
            if some.any():
                whole = node[some] * U64(buckets) + U64(at)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(point[some])], ["node", "point"])

        for batch in batches:
            for bucket, used, owner, low in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                if bucket != at:
                    yield from done()
                    at = bucket
                used, raw, low = np.frombuffer(used.as_py(), np.int64), owner.as_py(), np.frombuffer(low.as_py(), np.uint8).reshape(-1, 5)
                wide = np.zeros((len(low), 8), np.uint8)
                wide[:, :5] = low
                got.append((np.repeat(used, np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(used) else np.uint32)), wide.view("<u8").ravel().astype(U64)))
        yield from done()

    sent = docs.filter("doc_id is not null").select("text").mapInArrow(deal, "bucket int, points binary, owners binary, nodes binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "node long, point long")


def fine_counts(s: np.ndarray) -> bytes:
    """Counts (uint16) of so many groups, a power of two, that a group has one or two tokens. Finer counts fold onto coarser ones."""
    groups = max(GROUPS, 1 << max(0, len(s).bit_length() - 1))
    return np.bincount((s & U64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16).tobytes()


def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose first column isn't that of the row before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            p = np.asarray(batch.column(0))
            new = np.append(last is None or p[0] != last, p[1:] != p[:-1])
            last = p[-1]
            yield batch.filter(pa.array(new))


def with_fine(texts: DataFrame, link: Link) -> DataFrame:
    """point, text, size, fine. Of neighbouring rows of one point the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(firsts(batches)):
            sets = token_sets(chunk, link)
            yield pa.RecordBatch.from_arrays([chunk.column("point"), chunk.column("text"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fine_counts(s) for s in sets], pa.binary())], ["point", "text", "size", "fine"])

    return texts.select("point", "text").mapInArrow(run, "point long, text string, size long, fine binary")


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    """Counts (the last axis) of n groups from those of more groups."""
    return counts if counts.shape[-1] == n else counts.reshape(*counts.shape[:-1], -1, n).sum(-2)


def allowed(x: np.ndarray, y: np.ndarray, size_x: int, size_y: int, link: Link) -> bool:
    """Whether sizes and the sum of coordinate minima allow a link."""
    if min(size_x, size_y) * link.den < max(size_x, size_y) * link.num:
        return False
    n = min(len(x), len(y))
    return bool(np.minimum(folded(x, n), folded(y, n)).sum(dtype=np.int64) >= link.need(size_x + size_y))


def screened(pairs: DataFrame, texts: DataFrame, link: Link) -> DataFrame:
    """The pairs (a, b) for which sizes and fine counts allow a link. texts: point, size, fine."""
    left = texts.select(F.col("point").alias("a"), F.col("size").alias("size_a"), F.col("fine").alias("fine_a"))
    right = texts.select(F.col("point").alias("b"), F.col("size").alias("size_b"), F.col("fine").alias("fine_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(2, 6)]
            ok = [allowed(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), m, n, link) for m, n, x, y in zip(*cols, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    sizes = texts.select("point", "size")
    near = pairs.join(sizes.select(F.col("point").alias("a"), F.col("size").alias("of_a")).hint("merge"), "a").join(sizes.select(F.col("point").alias("b"), F.col("size").alias("of_b")).hint("merge"), "b")
    near = near.filter(F.least("of_a", "of_b") * link.den >= F.greatest("of_a", "of_b") * link.num).select("a", "b")
    return near.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "size_a", "size_b", "fine_a", "fine_b").mapInArrow(run, "a long, b long")


class Roots:
    """The components of n things as pairs of them are joined; the root of a component is its least number."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.of[a], self.of[b]
        apart = x != y
        if not apart.any():
            return
        n = len(self.of)
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while (to := parent.get(i, i)) != i:
                i = to
            return i

        for key in np.unique(x[apart] * n + y[apart]).tolist():
            i, j = find(key // n), find(key % n)
            parent[max(i, j)] = parent.setdefault(min(i, j), min(i, j))
        to = np.arange(n)
        for i in parent:
            to[i] = find(i)
        self.of = to[self.of]

    def one(self, u: slice, v: slice) -> bool:
        """Whether all things of both slices are in one component."""
        root = self.of[u.start]
        return bool((self.of[u] == root).all() and (self.of[v] == root).all())


class Level:
    """Points whose counts have one length, packed into pages; folded versions of both are made when asked for."""

    def __init__(self, at: np.ndarray, table: np.ndarray, size: np.ndarray):
        self.at, self.size = at, size
        starts = np.arange(0, len(at), PAGE)
        self.page = np.arange(len(at)) // PAGE
        self.least, self.most = np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)
        self.starts, self.tables = starts, {table.shape[1]: (table, np.maximum.reduceat(table, starts))}
        self.width = table.shape[1]

    def folded(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        if m not in self.tables:
            table = folded(self.tables[self.width][0], m)
            self.tables[m] = table, np.maximum.reduceat(table, self.starts)
        return self.tables[m]

    def near(self, x: np.ndarray, n: int, open_: np.ndarray, link: Link) -> np.ndarray:
        """Numbers of the open points that the bounds allow to link with counts x of n tokens."""
        alive = open_[self.at]
        pages = (self.most * link.den >= n * link.num) & (n * link.den >= self.least * link.num)
        pages &= np.bitwise_or.reduceat(alive, self.starts)
        if not pages.any():
            return self.at[:0]
        m = min(len(x), self.width)
        x, (table, corner) = folded(x, m), self.folded(m)
        live = np.flatnonzero(pages)
        pages[live] = np.minimum(corner[live], x).sum(1, dtype=np.int64) >= link.need(n + self.least[live])
        own = np.flatnonzero(alive & pages[self.page] & (np.minimum(n, self.size) * link.den >= np.maximum(n, self.size) * link.num))
        if not len(own):
            return self.at[:0]
        low = np.minimum(table[own], x).sum(1, dtype=np.int64)
        return self.at[own[low >= link.need(n + self.size[own])]]


def spanning(held: list[tuple], link: Link) -> list[tuple[int, int]]:
    """Pairs of labels, one less than there are, for each component of points that the bounds allow to link.

    held: (point, label, size, fine counts, part); points of a label count as joined already, and with two parts only
    points of different parts are compared. Labels are taken from the one with the fewest points on, each point being
    compared with all that aren't in its component yet; so the largest label's points needn't be taken at all.
    """
    held.sort(key=lambda x: (len(x[3]), x[2], x[0]))
    names, label = np.unique(np.array([x[1] for x in held], np.int64), return_inverse=True)
    if len(names) < 2:
        return []
    size = np.array([x[2] for x in held], np.int64)
    part = np.array([x[4] for x in held], np.int64)
    parted = bool((part != part[0]).any())
    width = np.array([len(x[3]) for x in held])
    cut = np.append(np.flatnonzero(np.append(True, width[1:] != width[:-1])), len(held))
    levels = [Level(np.arange(a, b), np.stack([x[3] for x in held[a:b]]), size[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    roots, out = Roots(len(names)), []
    order = np.argsort(np.bincount(label), kind="stable")
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    for own in order[:-1].tolist():
        for u in members[own].tolist():
            open_ = roots.of[label] != roots.of[own]
            if parted:
                open_ &= part != part[u]
            if not open_.any():
                if not parted:
                    break
                continue
            hit = [level.near(held[u][3], int(size[u]), open_, link) for level in levels]
            new = np.unique(label[np.concatenate(hit)])
            _, first = np.unique(roots.of[new], return_index=True)
            new = new[first]
            out += [(int(names[own]), int(names[x])) for x in new.tolist()]
            roots.join(np.full(len(new), own), new)
    return out


class Memo:
    """Labels that a task has told to be joined; so later nodes of the same points have less to look at."""

    def __init__(self, limit: int = 500_000):
        self.parent: dict[int, int] = {}
        self.limit = limit

    def find(self, x: int) -> int:
        while (to := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(to, to)
            x = to
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if len(self.parent) > self.limit:
            self.parent.clear()
        self.parent[max(a, b)] = min(a, b)
        return True


def node_edges(tree: DataFrame, labels: DataFrame, texts: DataFrame, link: Link) -> DataFrame:
    """a, b: labels (a point without one is its own) that join the pieces of nodes as far as the bounds allow; distinct."""
    with_label = tree.join(labels.withColumnRenamed("v", "point"), "point", "left").withColumn("label", F.coalesce("label", "point"))
    open_ = with_label.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("node", "n")
    rows = with_label.join(open_, "node").join(texts.select("point", "size", "fine").hint("merge"), "point")
    rows = rows.withColumn("parts", F.ceil(F.col("n") / PAGE_GROUP)).withColumn("part", F.pmod(F.xxhash64("point"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("node", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "point", "label", "size", "fine", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, memo, out = None, [], Memo(), []

        def done() -> None:
            out.extend(x for x in spanning(held, link) if memo.join(*x))
            held.clear()

        def told() -> Iterator[pa.RecordBatch]:
            if out:
                a, b = zip(*out, strict=True)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for node, p, q, point, label, size, fine, part in zip(*cols, strict=True):
                if (node, p, q) != at:
                    done()
                    at = node, p, q
                held.append((point, memo.find(label), size, np.frombuffer(fine, np.uint16), part))
            yield from told()
        done()
        yield from told()

    n = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "node", "p", "q").sortWithinPartitions("node", "p", "q").mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of shared tokens of each set of x with each of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    if len(x) * len(y) <= 16:
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                z = np.sort(np.concatenate((a, b)))
                out[i, j] = (z[1:] == z[:-1]).sum()
        return out
    tokens = [np.concatenate(side) for side in (x, y)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (x, y)]
    both = np.intersect1d(*tokens)
    if not len(both):
        return out
    at = [np.minimum(np.searchsorted(both, t), len(both) - 1) for t in tokens]
    ok = [both[i] == t for i, t in zip(at, tokens, strict=True)]
    step = max(1, CELLS // (len(x) + len(y)))
    for first in range(0, len(both), step):
        n, tables = min(step, len(both) - first), []
        for side, row, i, good in zip((x, y), rows, at, ok, strict=True):
            own = good & (i >= first) & (i < first + n)
            cells = np.zeros((len(side), n), np.float32)
            cells[row[own], i[own] - first] = 1
            tables.append(cells)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def linked(held: list[tuple[int, int, np.ndarray]], link: Link, roots: Roots | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers a, numbers b, shared, union) of all links; held: (point, side, set), sorted by size; side 0: both sides.

    With roots, pages that are in one component already are passed over.
    """
    side = np.array([x[1] for x in held], np.int64)
    size = np.array([len(x[2]) for x in held], np.int64)
    pages = range(0, len(held), 4 * PAGE)
    for i in pages:
        u = slice(i, i + 4 * PAGE)
        for j in pages:
            v = slice(j, j + 4 * PAGE)
            if j < i or size[u].max() * link.den < size[j] * link.num or roots is not None and roots.one(u, v):
                continue
            sides = side[u, None] + side[None, v]
            ok = (sides == 0) | (sides == 3)
            if i == j:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            if not ok.any():
                continue
            shared = overlaps([x[2] for x in held[u]], [x[2] for x in held[v]])
            union = size[u, None] + size[None, v] - shared
            a, b = np.nonzero(ok & (shared > 0) & (link.den * shared >= link.num * union))
            yield i + a, j + b, shared[a, b], union[a, b]


#: What all_links gives out: a, b, shared, n_union of each link; or a, b of pairs that span the components, and, with
#: DEGREES, the rows (a, null, n_links) too, to be summed by a.
LISTED, DEGREES, SPANNING = "listed", "degrees", "spanning"


def all_links(clusters: DataFrame, texts: DataFrame, link: Link, what: str) -> DataFrame:
    """The links within clusters. clusters: v, label; texts: point, text, size."""
    sizes = clusters.join(texts.select(F.col("point").alias("v"), "size").hint("merge"), "v")
    parts = sizes.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / PAGE_GROUP, F.sum("size") / PAGE_TOKENS)).alias("parts"))
    dealt = clusters.join(parts.hint("merge"), "label")
    rows = dealt.join(texts.select(F.col("point").alias("v"), "text").hint("merge"), "v")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("v"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    rows = rows.select("label", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "v", side.alias("side"), "text")
    names = ["a", "b", "shared", "n_union"] if what == LISTED else ["a", "b", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, n = None, [], [], 0
        seen: set[int] = set()

        def told() -> Iterator[pa.RecordBatch]:
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                out.clear()
                none = cols[2] > 0 if what != LISTED else None
                yield pa.RecordBatch.from_arrays([pa.array(c, mask=none if i == 1 else None) for i, c in enumerate(cols)], names)

        def done() -> None:
            if len(held) > 1:
                held.sort(key=lambda x: (len(x[2]), x[0]))
                p, roots = np.array([x[0] for x in held], np.int64), Roots(len(held))
                degree = np.zeros(len(held), np.int64)
                for a, b, shared, union in linked(held, link, roots if what == SPANNING else None):
                    if what == LISTED:
                        out.append((np.minimum(p[a], p[b]), np.maximum(p[a], p[b]), shared, union))
                        continue
                    roots.join(a, b)
                    degree += np.bincount(a, minlength=len(held)) + np.bincount(b, minlength=len(held))
                if what != LISTED:
                    own = np.flatnonzero(roots.of != np.arange(len(held)))
                    out.append((p[roots.of[own]], p[own], np.zeros(len(own), np.int64)))
                if what == DEGREES:
                    own = np.flatnonzero(degree)
                    out.append((p[own], p[own], degree[own]))
            held.clear()
            seen.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            row = 0
            for chunk in chunks(iter([batch])):
                for s in token_sets(chunk, link):
                    label, p, q, v, side = keys[row]
                    row += 1
                    if (label, p, q) != at:
                        done()
                        at = label, p, q
                        n += 1
                        if n % 500 == 0 or sum(len(x[0]) for x in out[-1:]) > 100_000:
                            yield from told()
                    if v not in seen:  # equal rows are one point
                        seen.add(v)
                        held.append((v, side, s))
        done()
        yield from told()

    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "label", "p", "q").sortWithinPartitions("label", "p", "q").mapInArrow(run, ", ".join(f"{x} long" for x in names))


@dataclass
class Found:
    """Clusters of a table: every row's point; each point's least document; texts of points; v, label of points that may link."""

    every: DataFrame
    known: DataFrame
    texts: DataFrame
    clusters: DataFrame
    ok: Column

    def groups(self, edges: DataFrame) -> DataFrame:
        """point, one: doc_id and text_key of the least document that each point reaches by edges."""
        by_point = self.known.select("point", "one").join(components(edges).withColumnRenamed("v", "point"), "point", "left")
        reach = by_point.filter("label is not null").groupBy("label").agg(F.min("one").alias("least"))
        return by_point.join(reach, "label", "left").select("point", F.coalesce("least", "one").alias("one"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), n_links (of the set with other sets, all of them): one row for each row of docs.

    Documents link if den * overlap >= num * union of their word n-grams. Ids must be integers.
    """
    link = Link(n, num, den)
    found = _found(docs, link, id_col, text_col)
    links = written(all_links(found.clusters, found.texts, link, DEGREES))
    dropped(found.texts)
    degree = links.filter("b is null").groupBy(F.col("a").alias("point")).agg(F.sum("n_links").alias("n_links"))
    groups = found.groups(links.filter("b is not null").select("a", "b"))
    out = found.every.select("doc_id", "size", "point").join(groups.join(degree, "point", "left"), "point", "left")
    own = F.when(found.ok, F.col("one.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_groups(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), component_id and component_key: one row for each row of docs that has an id and a word.

    component_id and component_key tell the least (doc_id, text_key) that the row reaches. Links are not counted.
    """
    link = Link(n, num, den)
    found = _found(docs, link, id_col, text_col)
    links = written(all_links(found.clusters, found.texts, link, SPANNING))
    dropped(found.texts)
    groups = found.groups(links.select("a", "b"))
    return found.every.filter(found.ok).join(groups, "point").select("doc_id", "text_key", F.col("one.doc_id").alias("component_id"), F.col("one.text_key").alias("component_key"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which each group of near copies keeps one: that with the least (id, text hash).

    Rows of one id with different texts are documents of their own. Of rows equal in id and text one stays (any one, if
    they differ in other columns). Rows without an id or without a word are in no group and stay.
    """
    groups = near_groups(docs, n, num, den, id_col, text_col)
    gone = (F.col("doc_id") != F.col("component_id")) | (F.col("text_key") != F.col("component_key"))
    judged = groups.groupBy(F.col("doc_id").alias("_near_id"), F.col("text_key").alias("_near_key")).agg(F.max(gone).alias("_near_gone"), F.count("*").alias("_near_rows"))
    judged = written(judged.filter("_near_gone or _near_rows > 1"))
    # By position, since columns of docs may have any name, or one name twice.
    same = (docs[id_col].cast("long") == judged["_near_id"]) & (F.xxhash64(docs[text_col]) == judged["_near_key"])
    one = docs.join(judged.select("_near_id", "_near_key"), same, "left_anti")
    again = judged.filter("not _near_gone")
    several = docs.join(again, (docs[id_col].cast("long") == again["_near_id"]) & (F.xxhash64(docs[text_col]) == again["_near_key"]), "left_semi")
    return one.unionByName(several.dropDuplicates([id_col, text_col])) if not again.isEmpty() else one


def near_pairs(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_a, doc_b, shared, n_union: each link of two different sets once, a set being told by its least doc_id."""
    link = Link(n, num, den)
    found = _found(docs, link, id_col, text_col)
    a, b = (found.known.select(F.col("point").alias(x), F.col("one.doc_id").alias(f"rep_{x}")) for x in "ab")
    pairs = all_links(found.clusters, found.texts, link, LISTED).join(a, "a").join(b, "b")
    return pairs.select(F.least("rep_a", "rep_b").alias("doc_a"), F.greatest("rep_a", "rep_b").alias("doc_b"), "shared", "n_union")


def _found(docs: DataFrame, link: Link, id_col: str, text_col: str) -> Found:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    every = written(points(rows, link))
    ok = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    known = written(every.filter(ok).groupBy("point").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.max("size").alias("size")))

    every_node = written(nodes(rows, link))
    crowds = every_node.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("node")
    crowded = written(every_node.join(crowds, "node"))
    few = crowded.groupBy("point").agg(F.count("*").alias("n")).join(known.select("point", "size"), "point").filter(F.col("n") <= link.may_leave(F.col("size"))).select("point")
    tree = written(every_node.join(crowded.join(few, "point"), ["node", "point"], "left_anti"))
    # Of nodes with the same points (told by 128 bits) one is kept. Its hubs are its least and its largest point.
    mark = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("point")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "point")).alias("y"))
    kept = tree.groupBy("node").agg(F.min("point").alias("lo"), F.max("point").alias("hi"), *mark).groupBy("n", "x", "y", "lo", "hi").agg(F.min("node").alias("node"))
    thinned, tree = tree, written(tree.join(kept.filter("n > 1").select("node", "lo", "hi"), "node"))
    dropped(every_node, crowded, thinned)

    # The texts of one document for each point in a node of several. They are merged by shuffling at every size: a
    # broadcast of ids would only do for small tables, and a plan that changes with the size can't be judged on them.
    wanted = tree.select("point").distinct().join(known, "point").select("point", "one.doc_id", "one.text_key")
    texts = written(rows.join(wanted.hint("merge"), ["doc_id", "text_key"]).select("point", "text").transform(with_fine, link))

    stars = tree.select("point", F.explode(F.array("lo", "hi")).alias("hub")).filter("point <> hub")
    stars = stars.select(F.least("point", "hub").alias("a"), F.greatest("point", "hub").alias("b")).distinct()
    edges = written(screened(stars, texts, link))
    labels = components(edges)
    more = written(node_edges(tree.select("node", "point"), labels, texts, link))
    joins = components(more)
    joins = joins.select(F.col("v").alias("_label"), F.col("label").alias("_to"))
    own = texts.select(F.col("point").alias("v")).distinct().join(labels, "v", "left").withColumn("_own", F.coalesce("label", "v"))
    clusters = own.join(joins, own["_own"] == joins["_label"], "left").filter("label is not null or _to is not null")
    clusters = written(clusters.select("v", F.coalesce("_to", "_own").alias("label")))
    dropped(edges, more, tree)
    return Found(every, known, texts, clusters, ok)
