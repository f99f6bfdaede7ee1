"""Offline stand-ins for model calls (M1-M6), profiles over TF-IDF (A26, T9), names and words of groups.

A provider is a function from Column to Column, so a real model (a pandas_udf) takes the place of a stand-in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bounded_batches
from .graph import written
from .term_vectors import TermVectors

Provider = Callable[[Column], Column]
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def terms(c: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def bucket(term: Column, dims: int = 64) -> Column:
    """Which of the coordinates a term counts for: its MD5 digest's first four digits, modulo their number."""
    return F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int") % dims


def hashed_weights(docs: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """id, bucket, weight: counts of terms by hash, of length 1 for each text (M1). Texts without terms have no row.

    Terms are counted before anything is looked up by coordinate, so the work is linear in terms.
    """
    n = docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("id", bucket(F.col("term"), dims).alias("bucket")).agg(F.count("*").alias("n"))
    norm = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def embed_hashed(docs: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """id, vector of each text that isn't null; zeros without terms."""
    held = hashed_weights(docs, id_col, text_col, dims).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w"))  # dims entries at most
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).join(held, "id", "left")
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0))).alias("vector"))


def failover(providers: list[Provider]) -> Provider:
    """The first provider's answer that is neither null nor blank (M6)."""
    return lambda c: F.coalesce(*(F.when(F.trim(p(c)) != "", p(c)) for p in providers))


def tag_entities(c: Column, known: dict[str, tuple[str, ...]], limit: int = 10_000) -> Column:
    """text, label of the known entities that the text holds: one word between other characters than letters of any script, digits and _, in any case, several as they
    stand in any case (M2, J7). The list is part of the plan, so its size is checked."""
    if (n := sum(map(len, known.values()))) > limit:
        raise ValueError(f"{n} entities; join a table of them instead")
    each = F.array(*(F.struct(F.lit(e).alias("text"), F.lit(label).alias("label"), F.lit(e.lower()).alias("low"), F.lit(len(e.split()) > 1).alias("many")) for label in sorted(known) for e in known[label]))
    low = F.lower(c)
    held = lambda e: F.when(e["many"], F.contains(low, e["low"])).otherwise(F.contains(low, e["low"]) & F.regexp_like(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), e["low"], F.lit(r"\E(?![\p{L}\p{N}_])"))))
    return F.transform(F.filter(each, held), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))


#: Ratings of a block of users, vectors' entries of a block of terms, products that are summed at a time, sums that are held.
RATINGS, ENTRIES, PRODUCTS, SUMS = 200_000, 200_000, 4_000_000, 16_000_000


def _known(ratings: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of users: users, sizes, ids, ratings, totals; blocks of terms: id, term and weight of each entry)."""
    spark = bounded_batches(ratings.sparkSession)
    weights = written(weights)
    parts = max(1, -(-weights.count() // ENTRIES))
    entries = weights.groupBy(F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "term", "weight")).alias("x")).select("x.id", "x.term", "x.weight")
    known = ratings.join(written(weights.select("id").distinct()), "id", "left_semi").filter("user_id is not null")
    # by user alone, so that a user's ratings stand in one task and are summed there
    summed = known.select("user_id", "id", "rating").repartition("user_id").groupBy("user_id", "id").agg(F.sum("rating").cast("double").alias("rating")).sortWithinPartitions("user_id", "id")
    kinds = dict(summed.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, n
            rows = pa.Table.from_batches(kept).combine_chunks()
            code = rows["user_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            end = len(code) if last else int(np.searchsorted(code, code[-1]))  # the last user may go on
            kept, n = rows.slice(end).to_batches(), len(code) - end
            if end:
                first = np.flatnonzero(np.r_[True, code[1:end] != code[: end - 1]])
                values = [rows["user_id"].combine_chunks().take(pa.array(first)), pa.array(np.diff(np.r_[first, end]), pa.int32()), rows["id"].combine_chunks()[:end], rows["rating"].combine_chunks()[:end]]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in values], ["users", "sizes", "ids", "ratings"])

        most = RATINGS
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from cut(False)
                most = max(RATINGS, 2 * n)
        if n:
            yield from cut(True)

    users = summed.mapInArrow(pack, f"users array<{kinds['user_id']}>, sizes array<int>, ids array<{kinds['id']}>, ratings array<double>")
    return written(users), written(entries)


def _profiles(ratings: DataFrame, weights: DataFrame, give: Callable, schema: str) -> DataFrame:
    """What give(users, words, place of the user, number of the word, weight) makes of the profiles of some users in some terms.

    Every block of users meets every block of terms, so that a user's weight of a term is summed in one place: neither the products
    nor the sums are shuffled.
    """
    users, entries = _known(ratings, weights)
    met = users.join(entries.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].values for c in batch.schema.names}
                size, rating = (row[c].to_numpy(zero_copy_only=False) for c in ("sizes", "ratings"))
                rating = np.nan_to_num(rating, posinf=np.inf, neginf=-np.inf) if row["ratings"].null_count else rating
                coded = row["term"].dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                ids = row["id"].dictionary_encode()
                held, at = ids.indices.to_numpy(zero_copy_only=False), pa.compute.index_in(row["ids"], ids.dictionary)
                order = np.argsort(held, kind="stable")
                code, weight = code[order], row["weight"].to_numpy(zero_copy_only=False)[order]
                edge = np.r_[0, np.cumsum(np.bincount(held, minlength=len(ids.dictionary)))]
                at = pa.compute.fill_null(at, -1).to_numpy(zero_copy_only=False)
                low, n = edge[at], np.where(at >= 0, edge[at + 1] - edge[at], 0)
                user, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
                total = np.bincount(user, rating, len(size))
                upto, most = np.r_[0, np.cumsum(n)], max(1, SUMS // max(1, len(words)))
                a = 0
                while a < len(size):
                    s = ends[a] - size[a]
                    b = max(a + 1, min(a + most, int(np.searchsorted(upto[ends], upto[s] + PRODUCTS, "right"))))
                    e = ends[b - 1]
                    each = np.repeat(np.arange(s, e), n[s:e])
                    entry = low[each] + np.arange(len(each)) - (upto[each] - upto[s])
                    key = (user[each] - a) * len(words) + code[entry]
                    there = np.bincount(key, minlength=(b - a) * len(words))
                    sums = np.bincount(key, rating[each] * weight[entry], len(there))
                    found = np.flatnonzero(there)
                    place, word = np.divmod(found, max(1, len(words)))
                    place += a
                    ok = total[place] != 0
                    place, word, found = place[ok], word[ok], found[ok]
                    if len(place):
                        yield from give(row["users"], words, place, word, sums[found] / total[place])
                    a = b

    return met.mapInArrow(run, schema)


def profiles(ratings: DataFrame, weights: DataFrame) -> DataFrame:
    """user_id, term, weight: rated documents' vectors, weighted by rating; rating weights sum to 1.

    ratings: user_id, id, rating. Only documents that have a vector count. Users whose ratings sum to 0 have no profile; null ratings weigh nothing.
    """

    def give(users: pa.Array, words: pa.Array, place: np.ndarray, word: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(word), ENTRIES):
            yield pa.RecordBatch.from_arrays([users.take(pa.array(place[s : s + ENTRIES])), words.take(pa.array(word[s : s + ENTRIES])), pa.array(weight[s : s + ENTRIES])], ["user_id", "term", "weight"])

    return _profiles(ratings, weights, give, f"user_id {dict(ratings.dtypes)['user_id']}, term string, weight double")


def profile_sizes(ratings: DataFrame, weights: DataFrame) -> DataFrame:
    """user_id, n_terms, total: of each profile the number of terms and the sum of weights, counted where the profile is made."""

    def give(users: pa.Array, words: pa.Array, place: np.ndarray, word: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.bincount(place)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([users.take(pa.array(own)), pa.array(n[own], pa.int64()), pa.array(np.bincount(place, weight)[own])], ["user_id", "n_terms", "total"])

    parts = _profiles(ratings, weights, give, f"user_id {dict(ratings.dtypes)['user_id']}, n_terms long, total double")
    return parts.groupBy("user_id").agg(F.sum("n_terms").alias("n_terms"), F.sum("total").alias("total"))


def group_terms(docs: DataFrame, group: str, terms_col: str) -> DataFrame:
    """group, term, tf, score: class-based TF-IDF, tf / words of the group * ln(1 + mean words of a group / tf in all)."""
    tf = docs.select(group, F.explode(terms_col).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy(group).agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("total"))
    return tf.join(total, "term").join(size, group).crossJoin(F.broadcast(mean)).select(group, "term", "tf", (F.col("tf") / F.col("size") * F.ln(1 + F.col("mean") / F.col("total"))).alias("score"))


def group_names(titles: DataFrame, group: str, id_col: str, title_col: str, stop: tuple[str, ...] = (), features: int = 5, words: int = 2) -> DataFrame:
    """group, name: of each group's `features` most frequent terms (one or two words), the `words` with the greatest sum
    of TF-IDF, joined by " / "; "General" without terms (A27). Ties go by the term."""
    kept = F.filter(terms(F.col(title_col)), lambda w: ~w.isin(*stop)) if stop else terms(F.col(title_col))
    grams = F.concat("w", F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>")))
    rows = titles.select(F.col(group).alias("g"), F.col(id_col).alias("id"), kept.alias("w"))
    tf = rows.select("g", "id", F.explode(grams).alias("term")).groupBy("g", "id", "term").agg(F.count("*").alias("tf"))
    n = rows.groupBy("g").agg(F.count("*").alias("n"))
    every = tf.groupBy("g", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    best = every.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("total"), "term"))).filter(F.col("r") <= features)
    raw = tf.join(best.join(n, "g"), ["g", "term"]).select("g", "id", "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("g", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    score = raw.join(norm, ["g", "id"]).groupBy("g", "term").agg(F.round(F.sum(F.col("w") / F.col("norm")), 9).alias("score"))
    top = score.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "term"))).filter(F.col("r") <= words)
    name = top.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: F.initcap(x["term"])), " / ").alias("name"))
    return n.join(name, n["g"].eqNullSafe(name["g"]), "left").select(n["g"].alias(group), F.coalesce("name", F.lit("General")).alias("name"))


def recommend(ratings: DataFrame, vectors: TermVectors, n: int, min_rating: float | None = None) -> DataFrame:
    """id, cosine of the n unrated documents nearest to one user's profile (T9). ratings: user_id, id, rating, of that user.

    min_rating: lower ratings don't shape the profile; by default all do. Ties go to the smaller id.
    """
    liked = ratings if min_rating is None else ratings.filter(F.col("rating") >= min_rating)
    rated = written(ratings.select("id").distinct())
    profile = written(profiles(liked, vectors.weights(written(liked.select("id").distinct()))).select("term", F.col("weight").alias("p")))
    norm = profile.agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    scored = vectors.dots(profile).join(rated, "id", "left_anti").crossJoin(F.broadcast(norm))
    return scored.select("id", F.round(F.try_divide("dot", "norm"), 9).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(n)


def similar(vectors: TermVectors, of: object, n: int) -> DataFrame:
    """id, cosine of the n documents nearest to the document `of`; vectors are of length 1."""
    own = written(vectors.weights().filter(F.col("id") == F.lit(of)).select("term", F.col("weight").alias("p")))
    scored = vectors.dots(own).filter(F.col("id") != F.lit(of)).select("id", F.round("dot", 9).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), "id").limit(n)


def categorise(titles: DataFrame, title_col: str, place_col: str, provider: Callable[[Column], Column], batch: int = 100) -> DataFrame:
    """titles with level1, level2, level3 and the number of the batch (place from 1) in which a provider is asked (M7)."""
    levels = provider(F.col(title_col))
    named = titles.withColumn("_levels", levels).withColumn("batch", F.floor((F.col(place_col) - 1) / batch))
    return named.select("*", *(F.get("_levels", F.lit(i)).alias(f"level{i + 1}") for i in range(3))).drop("_levels")
