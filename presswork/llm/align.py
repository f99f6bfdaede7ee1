"""Alignment of two tokenizers' tokens, and how often their ids go together in a corpus.

Tokens of a blank and the text: A's by a byte-level BPE file, B's by a piece model, both as byte ranges. The B tokens of a block
of texts make a static interval index; each A token's overlaps are found by two bisections. Where no B token spans the gap
between two A tokens, a group ends. The gaps at which texts are cut (pieces.cut_text) are never spanned by either tokenizer, so
each different part of a block is aligned once, and a text is the sequence of its parts.

align()        one row per text with its numbers of its block's parts, and one row per block with its parts' links
pair_counts()  corpus-wide links per (A id, B id), and whether the count is the B id's highest
rate()         one row per text: sums over its links

Only pairs of ids are shuffled: once per block and pair, not per link. A pair that every block has is one row per block,
a B id has at most as many pairs as A has ids. Blocks are bounded by bytes (or one text).

Null and empty texts have no tokens, nor have texts that either tokenizer doesn't give back byte by byte (U+2581 turns into a
blank in B). Rows are never joined by id: repeated and null ids give a row each. Further columns aren't read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import Parts, gathered, loaded

#: Bytes (characters) of texts of a block.
BLOCK = 8 << 20
#: Different parts of a block that are aligned at a time.
_PARTS = 16_000
#: Rows of a block that are handed on at a time.
_ROWS = 2_000


class ByteTokens:
    """A byte-level BPE tokenizer file: ids of strings, bytes of ids. Special tokens' strings are plain text."""

    def __init__(self, blob: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalisation is needed")
        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.tokenizer.encode_special_tokens = True
        # the byte-level alphabet: printable Latin-1 characters stand for themselves, the others for 256 and up
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.id_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.id_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.id_sizes = np.array([len(b) for b in self.id_bytes], np.int64)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each part with a blank before it."""
        ids, sizes = [], np.zeros(len(parts) + 1, np.int64)
        for at in range(0, len(parts), 2_000):
            for j, e in enumerate(self.tokenizer.encode_batch_fast([" " + p for p in parts[at : at + 2_000]], add_special_tokens=False)):
                own = e.ids
                ids.extend(own)
                sizes[at + j + 1] = len(own)
        return np.array(ids, np.int32), np.cumsum(sizes)


@functools.lru_cache(maxsize=4)
def byte_tokens(blob: bytes) -> ByteTokens:
    return ByteTokens(blob)


class IntervalIndex:
    """Half-open intervals that don't change, by start; which ones overlap a range is found by bisection."""

    def __init__(self, start: np.ndarray, end: np.ndarray) -> None:
        if (np.diff(start) < 0).any():
            raise ValueError("intervals must be in order of their starts")
        self.start, self.end = start, end
        self.reach = np.maximum.accumulate(end) if len(end) else end

    def stab(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range [low, high) the first interval that reaches beyond low, and the one after the last that starts before high.

        All overlaps lie between these two; of intervals that don't nest, nothing else does.
        """
        first = np.searchsorted(self.reach, low, side="right")
        return first, np.maximum(first, np.searchsorted(self.start, high, side="left"))

    def overlaps(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, interval) of each overlap, in order."""
        first, last = self.stab(low, high)
        size = last - first
        query = np.repeat(np.arange(len(low)), size)
        hit = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        # ranges and intervals without any item overlap with nothing
        real = (self.end[hit] > low[query]) & (self.start[hit] < self.end[hit]) & (low[query] < high[query])
        return query[real], hit[real]


def group_ends(n: int, query: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Of n A tokens with these overlaps, which end a group: no B token that overlaps them or earlier ones goes on after them."""
    last, first = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    np.maximum.at(last, query, hit)
    np.minimum.at(first, query, hit)
    last = np.maximum.accumulate(last) if n else last
    ahead = np.minimum.accumulate(first[::-1])[::-1] if n else first
    return np.r_[ahead[1:] > last[:-1], True] if n else np.empty(0, bool)


class Aligned:
    """The different parts of a block, aligned: links, groups and sizes of each."""

    def __init__(self, parts: list[str], a: ByteTokens, b) -> None:
        a_ids, self.a_at = a.encode(parts)
        b_ids, self.b_at = b.encode(parts)
        a_size, b_size = a.id_sizes[a_ids], b.id_sizes[b_ids]
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        self.whole = self._whole(parts, [(t, ids, np.r_[0, end][at]) for t, ids, end, at in ((a.id_bytes, a_ids, a_end, self.a_at), (b.id_bytes, b_ids, b_end, self.b_at))])
        # parts that don't come back whole shift what follows: leave them out of the index
        for at, ids, size, name in ((self.a_at, a_ids, a_size, "a"), (self.b_at, b_ids, b_size, "b")):
            keep = np.repeat(self.whole, np.diff(at))
            count = np.where(self.whole, np.diff(at), 0)
            setattr(self, f"{name}_at", np.r_[0, np.cumsum(count)])
            setattr(self, f"{name}_ids", ids[keep])
            setattr(self, f"{name}_end", np.cumsum(size[keep]))
        index = IntervalIndex(np.r_[0, self.b_end[:-1]] if len(self.b_end) else self.b_end, self.b_end)
        a_start = np.r_[0, self.a_end[:-1]] if len(self.a_end) else self.a_end
        self.query, self.hit = index.overlaps(a_start, self.a_end)
        self.ends = group_ends(len(self.a_ids), self.query, self.hit)
        self.link_at = np.searchsorted(self.query, self.a_at)
        self.group_at = np.r_[0, np.cumsum(self.ends)][self.a_at]

    @staticmethod
    def _whole(parts: list[str], sides: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which parts come back byte by byte from both sides' tokens; all are compared at once before they are one by one."""
        want = [b" " + p.encode("utf-8", "surrogatepass") for p in parts]
        ends = np.r_[0, np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))]
        all_of, whole = b"".join(want), np.ones(len(parts), bool)
        for table, ids, at in sides:
            joined = b"".join(map(table.__getitem__, ids.tolist()))
            if joined != all_of or (at != ends).any():
                at = at.tolist()
                whole &= np.fromiter((w == joined[i:j] for w, i, j in zip(want, at, at[1:], strict=False)), bool, len(want))
        return whole

    def sizes(self) -> np.ndarray:
        """A tokens, B tokens, groups and links of each part."""
        return np.stack([np.diff(x) for x in (self.a_at, self.b_at, self.group_at, self.link_at)], axis=1)

    def group_texts(self) -> list[str]:
        """Each part's groups as `a1,a2|b1;a3|b2,b3`."""
        close = np.flatnonzero(self.ends)
        last_hit = np.full(len(self.a_ids), -1)
        np.maximum.at(last_hit, self.query, self.hit)
        # the B tokens of a group are those up to the last that overlaps its last A token
        b_close = np.maximum.accumulate(last_hit)[close] + 1 if len(close) else close
        a_words, b_words = (_decimal(int(ids.max(initial=-1)) >> 12)[ids].tolist() for ids in (self.a_ids, self.b_ids))
        groups, a0, b0 = [], 0, 0
        for a1, b1 in zip((close + 1).tolist(), b_close.tolist(), strict=True):
            groups.append((a_words[a0] if a1 == a0 + 1 else ",".join(a_words[a0:a1])) + "|" + (b_words[b0] if b1 == b0 + 1 else ",".join(b_words[b0:b1])))
            a0, b0 = a1, b1
        at = self.group_at.tolist()
        return [";".join(groups[i:j]) for i, j in zip(at, at[1:], strict=False)]


@functools.lru_cache(maxsize=64)
def _decimal(blocks: int) -> np.ndarray:
    """Numbers below 4,096 * (blocks + 1) in decimal."""
    return np.array(list(map(str, range((blocks + 1) << 12))), object)


_ALIGNED = "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, parts array<int>, pairs array<long>, times array<long>, link_at array<int>, links array<int>"


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in _ALIGNED.split(", "))])


def _block(name: str, ids: list[int | None], index: Parts, rows: list[np.ndarray], a: ByteTokens, b) -> Iterator[pa.RecordBatch]:
    """A block's own row, then a row for each of its texts."""
    schema = _arrow_schema()
    whole, sizes, texts, pair = [], [np.zeros((0, 4), np.int64)], [], [np.empty(0, np.int64)]
    left = iter(index)
    while some := list(itertools.islice(left, _PARTS)):
        found = Aligned(some, a, b)
        whole.append(found.whole)
        sizes.append(found.sizes())
        texts += found.group_texts()
        pair.append((found.a_ids[found.query].astype(np.int64) << 32) | found.b_ids[found.hit])
    whole, sizes, pair = np.concatenate([*whole, np.empty(0, bool)]), np.vstack(sizes), np.concatenate(pair)
    link_at = np.r_[0, np.cumsum(sizes[:, 3])]
    spoilt = np.array([len(r) > 0 and not whole[r].all() for r in rows], bool)
    rows = [np.empty(0, np.int32) if bad else r for r, bad in zip(rows, spoilt.tolist(), strict=True)]
    held = np.bincount(np.concatenate(rows), minlength=len(index)) if rows else np.zeros(len(index), np.int64)
    pairs, links = np.unique(pair, return_inverse=True)
    links = links.astype(np.int32)
    times = np.bincount(links, weights=np.repeat(held, sizes[:, 3]), minlength=len(pairs)).astype(np.int64)
    head = {"block": [name], "pairs": [pairs], "times": [times], "link_at": [link_at.astype(np.int32)], "links": [links]}
    yield pa.RecordBatch.from_arrays([pa.array(head.get(f.name, [None]), f.type) for f in schema], schema=schema)
    for at in range(0, len(rows), _ROWS):
        some = rows[at : at + _ROWS]
        offsets = np.r_[0, np.cumsum([len(r) for r in some])]
        flat = np.concatenate(some) if some else np.empty(0, np.int32)
        sums = np.diff(np.vstack([np.zeros((1, 4), np.int64), np.cumsum(sizes[flat], axis=0)])[offsets], axis=0)
        n = len(some)
        values = {
            "block": pa.array([name] * n),
            "doc_id": pa.array(ids[at : at + n], pa.int64()),
            "groups": pa.array([";".join([t for t in map(texts.__getitem__, r.tolist()) if t]) for r in some], pa.string()),
            "parts": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
            **{k: pa.array(sums[:, i], pa.int64()) for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        }
        yield pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def align(docs: DataFrame, a_file: bytes, b_model: bytes, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) by blocks: rows of texts (doc_id, n_a, n_b, n_groups, n_links, groups, parts) and rows of blocks
    (pairs of ids and how many links hold each, links of each part as numbers of pairs), which have no n_a.

    Which texts make a block depends on the partitions, so write the table before it is read twice.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, seq, size = byte_tokens(a_file), loaded(b_model), 0, 0
        ids, rows, index = [], [], Parts()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(i)
                rows.append(index.number(text))
                size += len(text or "")
                if size >= block:
                    yield from _block(f"{part}-{seq}", ids, index, rows, a, b)
                    ids, rows, index, size, seq = [], [], Parts(), 0, seq + 1
        if ids:
            yield from _block(f"{part}-{seq}", ids, index, rows, a, b)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ALIGNED)


def _block_pairs(aligned: DataFrame) -> DataFrame:
    own = aligned.filter(F.col("n_a").isNull()).select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("i", "x"))
    return own.select("block", "i", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n (links in the corpus), best (n is its B id's highest). Pairs that no text with tokens holds are left out."""
    counts = _block_pairs(aligned).groupBy("pair").agg(F.sum("times").alias("n")).filter("n > 0")
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), "n")
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


_RATED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


def rate(aligned: DataFrame, counts: DataFrame, keep: tuple[str, ...] = ("groups",)) -> DataFrame:
    """One row per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and the named string columns of aligned."""
    of_block = _block_pairs(aligned).join(counts.select("pair", "n", "best"), "pair").groupBy(F.col("block").alias("of_block")).agg(F.collect_list(F.struct("i", "n", "best")).alias("rated"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *keep]
    own = aligned.select("block", *names, "parts", "link_at", "links")
    schema = pa.schema([("doc_id", pa.int64()), *((x.split(" ")[0], pa.int64()) for x in _RATED.split(", ")), *((k, pa.string()) for k in keep)])


    def one(texts: pa.Table, rated: pa.Table) -> pa.Table:
        head = texts.filter(pa.compute.is_null(texts["n_a"]))
        rows = texts.filter(pa.compute.is_valid(texts["n_a"]))
        flat = lambda col: col.combine_chunks().flatten() if len(col) else pa.array([])
        links, link_at = flat(head["links"]).to_numpy(), flat(head["link_at"]).to_numpy()
        n, best = np.zeros(links.max(initial=-1) + 1, np.int64), np.zeros(links.max(initial=-1) + 1, np.int64)
        if rated.num_rows:
            x = flat(rated["rated"])
            at = x.field("i").to_numpy()
            n[at], best[at] = x.field("n").to_numpy(), x.field("best").to_numpy(zero_copy_only=False)
        sums = [np.r_[0, np.cumsum(v[links])][link_at] for v in (best, n)]
        of_part = [np.diff(s) for s in sums]
        parts = rows["parts"].combine_chunks()
        offsets = np.r_[0, np.cumsum(parts.value_lengths().to_numpy())] if len(parts) else np.zeros(1, np.int64)
        flat_parts = parts.flatten().to_numpy()
        of_text = [np.diff(np.r_[0, np.cumsum(p[flat_parts])][offsets]) for p in of_part]
        out = {**{k: rows[k] for k in names}, "n_best": pa.array(of_text[0], pa.int64()), "count_sum": pa.array(of_text[1], pa.int64())}
        return pa.table([out[f.name] for f in schema], schema=schema)

    return own.groupBy("block").cogroup(of_block.groupBy("of_block")).applyInArrow(one, "doc_id long, " + _RATED + "".join(f", {k} string" for k in keep))
