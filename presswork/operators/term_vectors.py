"""TF-IDF vectors of documents in blocks (M13), and what rests on them: nearest to a profile (T9), profiles of users.

A block is some documents with the terms they hold: each term once, in order, and of each term its documents and counts there, as
compressed gaps. Only a block's distinct terms are shuffled, many in a row: they are dealt out by hash, counted over all blocks, and
their numbers come back to the block, where weights are computed. So neither a pair of document and term nor a pair of block and
term is ever a row, however frequent the term. Blocks are written by buckets and stay where they are: numbers move to them.

Rows of one id are one document: they are put together by term first; ids that stand once (most) are taken as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from .graph import bucketed, written

#: Bytes of the terms of a block and of the distinct terms that are counted in one group; rows that a task gives out at a time.
BLOCK_BYTES, PART_BYTES, ROWS = 32 << 20, 16 << 20, 200_000

#: Terms that fewer documents of a block hold are given out last.
FEW = 4


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def _compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _restored(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def _packed(numbers: np.ndarray) -> bytes:
    """Small integers: all their first bytes, then all their second bytes and so on, compressed."""
    return _compressed(np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    flat = np.frombuffer(_restored(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, len(flat) // 8).T).view(np.int64).ravel()


def _packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """(their sizes, their bytes) of some words, none null."""
    return _packed(pa.compute.binary_length(words).to_numpy(zero_copy_only=False)), _compressed(b"".join(words.cast(pa.binary()).to_pylist()))


def _words(sizes: bytes, data: bytes) -> pa.Array:
    size = _numbers(sizes)
    return pa.StringArray.from_buffers(len(size), pa.array(np.r_[0, np.cumsum(size)], pa.int32()).buffers()[1], pa.py_buffer(_restored(data)))


def _dealt(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words by part, a part's in order; words of each part)."""
    part = np.fromiter((zlib.crc32(x) % parts for x in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
    return np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)


WORDS = "word_sizes binary, words binary"
BLOCK = f"{WORDS}, word_bytes long, dfs binary, spans binary, docs binary, counts binary"


def _block(rows: pa.Table) -> pa.RecordBatch:
    """One row: words in order, dfs (documents of the block that hold each), and of the wanted documents ids and by word spans
    (how many hold it), docs (places in ids, of a word's the first and then the gaps) and counts (less 1)."""
    ids, terms, counts, wanted = (rows[c].combine_chunks() for c in ("id", "terms", "counts", "wanted"))
    size = pa.compute.fill_null(pa.compute.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)]
    each = None
    if counts.null_count < len(counts):
        each = np.ones(len(code), np.int64)
        each[np.repeat(counts.is_valid().to_numpy(zero_copy_only=False), size)] = counts.flatten().to_numpy(zero_copy_only=False)
    n = max(1, len(ids))
    pair, where = np.unique(code * n + np.repeat(np.arange(len(ids)), size), return_inverse=True)
    tf, (word, doc) = np.bincount(where, each, len(pair)).astype(np.int64), np.divmod(pair, n)
    dfs = np.bincount(word, minlength=len(words))
    keep = wanted.to_numpy(zero_copy_only=False)[doc]
    word, doc, tf = word[keep], doc[keep], tf[keep]
    own = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
    place = np.zeros(len(ids), np.int64)
    place[own] = np.arange(len(own))
    doc, first = place[doc], np.r_[True, word[1:] != word[:-1]][: len(word)]
    gaps = np.where(first, doc, np.diff(doc, prepend=0))
    packed = *_packed_words(words), words.nbytes, _packed(dfs), *(_packed(x) for x in (np.bincount(word, minlength=len(words)), gaps, tf - 1))
    kinds = [pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 4]
    values = [_lists(np.array([len(own)]), ids.take(pa.array(own))), *(pa.array([x], kind) for x, kind in zip(packed, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(values, ["ids", *(x.split()[0] for x in BLOCK.split(", "))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.nbytes
        if n >= BLOCK_BYTES:
            yield _block(pa.Table.from_batches(kept))
            kept, n = [], 0
    if kept:
        yield _block(pa.Table.from_batches(kept))


def _counted(rows: pa.Table) -> pa.Table:
    """block, part, df of each of the block's words in this part, over all blocks."""
    words = [_words(*x) for x in zip(rows["word_sizes"].to_pylist(), rows["words"].to_pylist(), strict=True)]
    code = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    df = np.bincount(code, np.concatenate([_numbers(x) for x in rows["dfs"].to_pylist()])).astype(np.int64)[code]
    each = np.split(df, np.cumsum([len(x) for x in words])[:-1])
    return pa.table({"block": rows["block"], "part": rows["part"], "df": pa.array([_packed(x) for x in each], pa.binary())})


def _met(rows: pa.Table, profile: pa.Table) -> pa.Table:
    """block, part, at, p: which of the block's words in this part the profile has, and its weights of them."""
    out = []
    terms, p = profile["term"].combine_chunks(), profile["p"].to_numpy()
    for block, part, sizes, data in zip(*(rows[c].to_pylist() for c in ("block", "part", "word_sizes", "words")), strict=True):
        place = pa.compute.fill_null(pa.compute.index_in(_words(sizes, data), terms), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(place >= 0)
        if len(at):
            out.append((block, part, _packed(at), _compressed(p[place[at]].tobytes())))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "part", "at", "p"])


class _Pairs:
    """The pairs of document and term of a block with their weights: by term doc (the place in ids), code (the term's number), w."""

    def __init__(self, row: dict, n: int, parts: int) -> None:
        self.words = _words(row["word_sizes"], row["words"])
        self.order, self.in_part = _dealt(self.words, parts)
        df = np.empty(len(self.words), np.int64)
        df[self.order] = np.concatenate([_numbers(x["df"]) for x in row["known"]])  # sorted by part
        span, gaps = _numbers(row["spans"]), _numbers(row["docs"])
        self.code, upto = np.repeat(np.arange(len(span)), span), np.cumsum(gaps)
        first = (np.cumsum(span) - span)[span > 0]
        self.doc = upto - np.repeat((upto - gaps)[first], span[span > 0])
        w = (_numbers(row["counts"]) + 1) * (np.log((1 + n) / (1 + df)) + 1)[self.code]
        self.w = w / np.sqrt(np.bincount(self.doc, w * w))[self.doc]

    def by_weight(self) -> np.ndarray:
        """Pairs by weight, so that equal ones meet and take little room where they are written; terms of few documents, too many for a file's dictionary, last."""
        return np.lexsort((self.w, np.bincount(self.code)[self.code] < FEW))


class TermVectors:
    """Vectors of length 1 of counts by smoothed inverse frequency, ln((1 + n) / (1 + df)) + 1, fitted once, on all of docs.

    of: ids (a table with the column id) whose vectors are wanted; by default all. Frequencies count all documents in any case.
    """

    def __init__(self, docs: DataFrame, id_col: str, terms_col: str, of: DataFrame | None = None) -> None:
        bounded_batches(docs.sparkSession)
        own = docs.select(F.col(id_col).alias("id"), F.col(terms_col).alias("terms"))
        self.n = own.count()
        none, twice = F.lit(None).cast("array<long>").alias("counts"), written(own.groupBy("id").count().filter("count > 1").select(F.col("id").alias("twice")))
        rows = own.select("id", "terms", none)
        if not twice.isEmpty():
            same = F.col("id").eqNullSafe(F.col("twice"))
            tf = own.join(twice, same, "left_semi").select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
            merged = tf.groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("x"))  # the terms of a document, each once
            rows = rows.join(twice, same, "left_anti").union(merged.select("id", "x.term", "x.tf"))
        if of is None:
            rows = rows.withColumn("wanted", F.lit(True))
        else:
            mark = written(of.select(F.col("id").alias("of")).filter("of is not null").distinct()).withColumn("wanted", F.lit(True))
            rows = rows.join(mark, F.col("id") == F.col("of"), "left").select("id", "terms", "counts", F.coalesce("wanted", F.lit(False)).alias("wanted"))
        self.id_kind = dict(own.dtypes)["id"]
        self.blocks = bucketed(rows.mapInArrow(_pack, f"ids array<{self.id_kind}>, {BLOCK}").withColumn("block", F.monotonically_increasing_id()), "block")
        total = self.blocks.agg(F.sum("word_bytes")).first()[0] or 0
        self.parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))

    def _slices(self) -> DataFrame:
        """block, part, words, dfs: the words of all blocks, dealt out by hash."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    words, dfs = _words(row["word_sizes"], row["words"]), _numbers(row["dfs"])
                    order, n = _dealt(words, parts)
                    own, edge = np.flatnonzero(n), np.r_[0, np.cumsum(n)]
                    each = [order[edge[k] : edge[k + 1]] for k in own]
                    packed = [(*_packed_words(words.take(pa.array(x))), _packed(dfs[x])) for x in each]
                    columns = list(zip(*packed, strict=True)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(own), pa.int64()), pa.array(own, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], ["block", "part", "word_sizes", "words", "dfs"])

        return self.blocks.select("block", "word_sizes", "words", "dfs").mapInArrow(run, f"block long, part int, {WORDS}, dfs binary")

    @cached_property
    def known(self) -> DataFrame:
        """block, part, df: documents that hold the block's words of a part, each word counted over all blocks."""
        return written(self._slices().groupBy("part").applyInArrow(_counted, "block long, part int, df binary"))

    def _looked_up(self, blocks: DataFrame, *columns: str) -> DataFrame:
        """Some of the blocks with what is known of their words, a few bytes a word."""
        known = self.known.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "df"))).alias("known"))  # as many as parts
        return blocks.select("block", "ids", "word_sizes", "words", "spans", "docs", "counts", *columns).join(known, "block")

    def weights(self, of: DataFrame | None = None) -> DataFrame:
        """id, term, weight of the wanted documents, a block's by weight; of: of these ids alone, looked for in their blocks. Documents without terms have no row."""
        blocks, n, parts = self.blocks.filter("size(ids) > 0"), self.n, self.parts
        if of is not None:
            held = blocks.select("block", F.explode("ids").alias("id")).join(of.select("id").distinct(), "id", "left_semi")
            blocks = blocks.join(written(held.select("block").distinct()), "block", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch[c][i].as_py() for c in batch.schema.names if c != "ids"}
                    ids, x = batch["ids"][i].values, _Pairs(row, n, parts)
                    order = x.by_weight()
                    for s in range(0, len(order), ROWS):
                        at = order[s : s + ROWS]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x.doc[at])), x.words.take(pa.array(x.code[at])), pa.array(x.w[at])], ["id", "term", "weight"])

        found = self._looked_up(blocks).mapInArrow(run, f"id {self.id_kind}, term string, weight double")
        return found if of is None else found.join(of.select("id").distinct(), "id", "left_semi")

    def dots(self, profile: DataFrame) -> DataFrame:
        """id, dot: products of the wanted documents with a profile (term, p; a term once), of those that share a term with it."""
        n, parts = self.n, self.parts
        own = profile.select("term", F.col("p").cast("double").alias("p")).filter("term is not null and p is not null")
        own = own.withColumn("part", F.pmod(F.crc32("term"), F.lit(parts)).cast("int"))
        met = self._slices().select("block", "part", "word_sizes", "words").groupBy("part").cogroup(own.groupBy("part")).applyInArrow(_met, "block long, part int, at binary, p binary")
        held = met.groupBy("block").agg(F.collect_list(F.struct("part", "at", "p")).alias("held"))  # as many as parts
        blocks = self.blocks.filter("size(ids) > 0").join(held, "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch[c][i].as_py() for c in batch.schema.names if c != "ids"}
                    ids, x = batch["ids"][i].values, _Pairs(row, n, parts)
                    p, there, edge = np.zeros(len(x.words)), np.zeros(len(x.words), bool), np.cumsum(x.in_part) - x.in_part
                    for y in row["held"]:
                        at = x.order[edge[y["part"]] + _numbers(y["at"])]
                        p[at], there[at] = np.frombuffer(_restored(y["p"])), True
                    shared = np.flatnonzero(np.bincount(x.doc, there[x.code], len(ids)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(shared)), pa.array(np.bincount(x.doc, x.w * p[x.code], len(ids))[shared])], ["id", "dot"])

        return self._looked_up(blocks, "held").mapInArrow(run, f"id {self.id_kind}, dot double")
