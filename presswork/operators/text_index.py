"""A stored positional inverted index of texts: phrases by intersecting positions, ranked search by block maxima.

Documents are numbered where they lie and make blocks of at most BLOCK documents. For each term and block there is one row: the
documents (gaps between their numbers in the block), how often and at which words (gaps) they hold the term, and their lengths.
The table is partitioned by a hash of the term and sorted by term, so a search reads the rows of its terms and no others:
the reader tells them by folders and by the least and greatest term of a row group. A frequent term is one row a block.

Words are what stands between white space, lower-cased. A ranked search first takes, from two numbers of each row alone, the
most that a document of a block can score; blocks are scored best first and those below the k-th score found are never read.

Null and empty texts are in the index as documents of length 0. Rows with a null id are hits without an id. Repeated ids are documents of
their own. Ties of the score go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import bounded_batches
from ..streaming.run import work_folder

#: Documents of a block, as a power of two, and words after which a block is cut into several rows a term.
BITS, WORDS = 12, 1 << 20
#: Folders of terms.
BUCKETS = 32
#: Blocks that a ranked search scores before it knows what to leave out.
FIRST = 16
#: What rounding may cost a bound.
SLACK = 1e-9

_POSTINGS = "term string, block long, docs array<int>, times array<int>, places array<int>, lengths array<int>, n int, most int, least int"


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; the first of each run as it is."""
    out = values.copy()
    out[1:] -= values[:-1]
    out[starts] = values[starts]
    return out


def ungapped(gaps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps)
    base = np.zeros(len(gaps), total.dtype)
    base[starts] = np.diff(np.r_[0, (total - gaps)[starts]])
    return total - np.cumsum(base)


def _postings(block: int, local: np.ndarray, words: pa.Array, offsets: np.ndarray) -> pa.RecordBatch:
    """The rows of some documents of a block: local numbers, all words, and where each document's begin."""
    size = np.diff(offsets)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code)) - offsets[:-1][row]
    order = np.argsort(code, kind="stable")  # within a term by document, then place
    code, row, place = code[order], row[order], place[order].astype(np.int32)
    new_term = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    new_doc = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
    term_at = np.searchsorted(new_doc, np.r_[new_term, len(code)])
    doc = local[row[new_doc]].astype(np.int32)
    times, length = np.diff(np.r_[new_doc, len(code)]).astype(np.int32), size[row[new_doc]].astype(np.int32)
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))
    columns = [
        coded.dictionary.take(pa.array(code[new_term])),
        pa.array(np.full(len(new_term), block)),
        lists(term_at, _gaps(doc, term_at[:-1])),
        lists(term_at, times),
        lists(np.r_[new_term, len(code)], _gaps(place, new_doc)),
        lists(term_at, length),
        pa.array(np.diff(term_at).astype(np.int32)),
        pa.array(np.maximum.reduceat(times, term_at[:-1])),
        pa.array(np.minimum.reduceat(length, term_at[:-1])),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _POSTINGS.split(", ")])


class TextIndex:
    """An index in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = bounded_batches(spark), path
        self.postings = spark.read.schema(_POSTINGS + ", bucket int").parquet(f"{path}/postings")
        self.terms = spark.read.parquet(f"{path}/terms")
        self.docs = spark.read.parquet(f"{path}/docs")
        self.size, self.mean, self.mean_idf = spark.read.parquet(f"{path}/stats").first()

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> TextIndex:
        spark = bounded_batches(docs.sparkSession)
        path = path or f"{work_folder(spark)}/index"
        own = docs.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        own.write.parquet(f"{path}/docs")  # numbers are what is written
        numbered = spark.read.parquet(f"{path}/docs").select("no", tokens(F.coalesce("text", F.lit(""))).alias("words"))

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[pa.RecordBatch] = []
            held = 0

            def cut() -> Iterator[pa.RecordBatch]:
                rows = pa.Table.from_batches(kept).combine_chunks()
                kept.clear()
                no = rows["no"].to_numpy()
                words = rows["words"].combine_chunks()
                offsets = np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]
                flat, block = words.flatten(), no >> BITS
                order = np.argsort(no, kind="stable")
                if (order != np.arange(len(no))).any():
                    taken = pa.Table.from_arrays([pa.array(no[order]), words.take(pa.array(order))], ["no", "words"])
                    no, words = no[order], taken["words"].combine_chunks()
                    offsets, flat, block = np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))], words.flatten(), no >> BITS
                edge = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(no)]
                for a, b in zip(edge, edge[1:], strict=False):
                    if offsets[b] > offsets[a]:
                        yield _postings(int(block[a]), no[a:b] & ((1 << BITS) - 1), flat.slice(offsets[a], offsets[b] - offsets[a]), offsets[a : b + 1] - offsets[a])

            for batch in batches:
                kept.append(batch)
                held += len(batch.column(1).flatten())
                if held > WORDS:
                    yield from cut()
                    held = 0
            if kept:
                yield from cut()

        rows = numbered.mapInArrow(invert, _POSTINGS).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/postings")
        terms = spark.read.schema(_POSTINGS + ", bucket int").parquet(f"{path}/postings").groupBy("term", "bucket").agg(F.sum("n").cast("long").alias("df"))
        terms.write.parquet(f"{path}/terms")
        stats = numbered.agg(F.count("*").alias("size"), F.avg(F.size("words")).alias("mean"))
        idf = spark.read.parquet(f"{path}/terms").join(F.broadcast(stats)).agg(F.avg(F.ln((F.col("size") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("mean_idf"))  # stats is one row
        stats.join(F.broadcast(idf)).coalesce(1).write.parquet(f"{path}/stats")
        return cls(spark, path)

    def rows(self, terms: list[str]) -> DataFrame:
        """The rows of the terms."""
        bucket = {r["term"]: r["bucket"] for r in self.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).collect()}
        return self.postings.filter(F.col("bucket").isin(sorted(set(bucket.values()))) & F.col("term").isin(sorted(bucket)))

    def _numbers(self, chains: DataFrame, steps: int) -> DataFrame:
        """no of documents that hold a word of step 0, one of step 1 right behind it, and so on. chains: step and the rows' columns."""

        def meet(rows: pa.Table) -> pa.Table:
            ends, found = None, rows["block"][0].as_py() << BITS
            for step in range(steps):
                own = rows.filter(pc.equal(rows["step"], step))
                keys = [np.empty(0, np.int64)]
                for i in range(own.num_rows):
                    docs, times, places = (own[k][i].values.to_numpy() for k in ("docs", "times", "places"))
                    at = np.cumsum(times) - times
                    keys.append((np.repeat(np.cumsum(docs).astype(np.int64), times) << 32) + ungapped(places.astype(np.int64), at) - step)
                keys = np.unique(np.concatenate(keys))
                ends = keys if ends is None else np.intersect1d(ends, keys, assume_unique=True)
                if not len(ends):
                    break
            return pa.table({"no": pa.array(np.unique(ends >> 32) + found, pa.int64())})

        return chains.groupBy("block").applyInArrow(meet, "no long")

    def phrase(self, words: list[str]) -> DataFrame:
        """no, id of documents with these words one behind the other."""
        words = [w.lower() for w in words]
        if not words:
            return self.docs.select("no", "id").limit(0)
        chains = self.rows(words).select(F.explode(F.array(*(F.when(F.col("term") == w, F.lit(i)) for i, w in enumerate(words)))).alias("step"), "block", "docs", "times", "places").filter("step is not null")
        return self.docs.select("no", "id").join(self._numbers(chains, len(words)), "no")

    def containing(self, text: str) -> DataFrame:
        """no, id of documents whose lower-cased text contains the lower-cased string, as a scan would tell.

        Terms that may hold its first and last word at their ends are told from the table of terms; the documents that have
        them in order are then read and looked at.
        """
        words = text.lower().split()
        found = self.docs
        if words:
            opened, closed = not text[:1].isspace(), not text[-1:].isspace()
            term, ways = F.col("term"), []
            for i, w in enumerate(words):
                loose_left, loose_right = i == 0 and opened, i == len(words) - 1 and closed
                ways.append(F.contains(term, F.lit(w)) if loose_left and loose_right else F.endswith(term, F.lit(w)) if loose_left else F.startswith(term, F.lit(w)) if loose_right else term == w)
            steps = self.terms.select("term", "bucket", F.explode(F.array_compact(F.array(*(F.when(way, F.lit(i)) for i, way in enumerate(ways))))).alias("step"))
            chains = self.postings.join(steps, ["bucket", "term"]).select("step", "block", "docs", "times", "places")
            found = found.join(self._numbers(chains, len(words)), "no")
        return found.filter(F.contains(F.lower("text"), F.lit(text.lower()))).select("no", "id")

    def _weights(self, terms: list[str], epsilon: float) -> dict[str, float]:
        df = {r["term"]: r["df"] for r in self.terms.filter(F.col("term").isin(terms)).collect()}  # a row for each term asked for
        raw = {t: float(np.log((self.size - n + 0.5) / (n + 0.5))) for t, n in df.items()}
        return {t: epsilon * (self.mean_idf or 0.0) if w < 0 else w for t, w in raw.items()}

    def scores(self, terms: list[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, blocks: DataFrame | None = None) -> DataFrame:
        """no, score (BM25) of documents that hold a term; terms count as often as they are given. blocks: only these."""
        terms = [t.lower() for t in terms]
        weight, mean = self._weights(sorted(set(terms)), epsilon), self.mean or 1.0
        times_asked = {t: terms.count(t) for t in weight}
        rows = self.rows(sorted(weight)) if weight else self.postings.limit(0)
        if blocks is not None:
            rows = rows.join(F.broadcast(blocks), "block", "left_semi")  # at most a number for each block

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    term, block, docs, tf, length = (batch.column(k)[i] for k in range(5))
                    tf, length = (x.values.to_numpy().astype(float) for x in (tf, length))
                    term = term.as_py()
                    value = weight[term] * times_asked[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                    no = np.cumsum(docs.values.to_numpy()).astype(np.int64) + (block.as_py() << BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(value)], ["no", "score"])

        return rows.select("term", "block", "docs", "times", "lengths").mapInArrow(score, "no long, score double").groupBy("no").agg(F.sum("score").alias("score"))

    def top(self, terms: list[str], k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """id, score, rank (from 1) of the k best documents with a score above 0; scores rounded to 9 places."""
        terms = [t.lower() for t in terms]
        weight, mean = self._weights(sorted(set(terms)), epsilon), self.mean or 1.0
        if not weight or k < 1:
            return self.docs.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        idf = F.lit(0.0)
        for t, w in weight.items():
            idf = F.when(F.col("term") == t, F.lit(w * terms.count(t))).otherwise(idf)
        most = F.col("most") * (k1 + 1) / (F.col("most") + k1 * (1 - b + b * F.col("least") / mean))
        # several rows of a term in a block: the greatest of their bounds
        bound = self.rows(sorted(weight)).select("term", "block", (idf * most).alias("x")).groupBy("block", "term").agg(F.max("x").alias("x")).groupBy("block").agg(F.sum("x").alias("bound"))
        path = f"{work_folder(self.spark)}/bounds"
        bound.write.parquet(path)
        bound = self.spark.read.parquet(path)
        best = bound.orderBy(F.desc("bound"), "block").limit(FIRST)
        first = self._best(self.scores(terms, k1, b, epsilon, best.select("block")), k)
        floor = first[-1]["score"] if len(first) == k else 0.0
        self.skipped = bound.filter(F.col("bound") < floor - SLACK).count()
        rest = bound.join(F.broadcast(best.select("block")), "block", "left_anti").filter(F.col("bound") >= floor - SLACK).select("block")
        second = self._best(self.scores(terms, k1, b, epsilon, rest), k)
        ranked = sorted(first + second, key=lambda r: (-r["score"], r["id"] is not None, r["id"]))[:k]
        kind = dict(self.docs.dtypes)["id"]
        return self.spark.createDataFrame([(r["id"], r["score"], i + 1) for i, r in enumerate(ranked)], f"id {kind}, score double, rank int")

    def _best(self, scores: DataFrame, k: int) -> list:
        """The k best rows, with their ids; ties by id, so those that tie with the k-th are looked up, too."""
        scores = scores.filter("score > 0").withColumn("score", F.round("score", 9))
        return scores.join(self.docs.select("no", "id"), "no").orderBy(F.desc("score"), F.col("id").asc_nulls_first()).limit(k).collect()

