"""Clusterings within groups of any size (M10, M11), and topics.

Rows of a group are cut into tiles; each pair of tiles gives the edges of its least spanning tree, and all these together hold
that of the group: the quadratic work is spread over pairs of tiles, and what is put out follows rows times tiles, not pairs.

Density clusters are read off the group's tree, which one task builds from those edges (without vectors). Average linkage never joins what no
chain of distances below the threshold joins, since a mean below it has a part below it: so each component is merged on its
own, with means in place of a matrix of distances. A component is in one task, with memory for its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from . import graph
from .ranking import global_rank

#: Rows of a tile.
TILE = 2_048


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def average_linkage(vectors: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Labels by merging the two clusters with the least mean cosine distance while it is below the threshold; numbered by first row.

    The mean distance of two clusters is that of their mean vectors, so memory follows the rows; of equal pairs the first rows' is merged.
    """
    n = len(vectors)
    mean = _unit(np.asarray(vectors, float)).copy()
    size, label, gone = np.ones(n), np.arange(n), np.zeros(n, bool)
    near, where = np.full(n, np.inf), np.zeros(n, int)

    def look(rows: np.ndarray) -> None:
        for s in range(0, len(rows), 512):
            at = rows[s : s + 512]
            far = np.round(1 - mean[at] @ mean.T, 12)
            far[:, gone] = np.inf
            far[np.arange(len(at)), at] = np.inf
            where[at] = far.argmin(1)
            near[at] = far[np.arange(len(at)), where[at]]

    look(np.arange(n))
    while n > 1 and (i := int(near.argmin())) >= 0 and near[i] < threshold:
        i, j = sorted((i, int(where[i])))
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        gone[j], near[j] = True, np.inf
        label[label == j] = i
        row = np.round(1 - mean @ mean[i], 12)
        row[gone] = row[i] = np.inf
        again = ((where == i) | (where == j)) & ~gone
        again[i] = True
        closer = (row < near) & ~again
        near[closer], where[closer] = row[closer], i
        look(np.flatnonzero(again))
    return np.unique(label, return_inverse=True)[1]


def spanning_edges(far: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, row, row) of the least spanning tree: of one tile with itself, or of two, the second's rows numbered after the first's."""
    m, back = len(far), far if same else np.ascontiguousarray(far.T)
    n = m if same else m + len(back)
    best, source, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    out = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1), int), np.zeros(max(0, n - 1), int)
    j = 0
    for k in range(n - 1):
        left[j], best[j] = False, np.inf
        at, row = (slice(0, m), far[j]) if same else (slice(m, n), far[j]) if j < m else (slice(0, m), back[j - m])
        closer = left[at] & (row < best[at])
        best[at][closer], source[at][closer] = row[closer], j
        j = int(best.argmin())
        out[0][k], out[1][k], out[2][k] = best[j], source[j], j
    return out


def hdbscan(vectors: np.ndarray, min_cluster: int = 5, min_samples: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(labels, -1 for noise; probabilities) by excess of mass over the tree of mutual reachability distances of unit vectors."""
    n = len(vectors)
    if n < max(2, min_cluster):
        return np.full(n, -1), np.zeros(n)
    v = _unit(vectors)
    far = np.maximum(np.round(1 - v @ v.T, 12), 0)
    np.fill_diagonal(far, 0)
    core = np.sort(far, 1)[:, min(min_samples, n) - 1]
    far, a, b = spanning_edges(np.maximum(far, np.maximum(core[:, None], core[None, :])), True)
    return density_tree(n, far, a, b, min_cluster)


def density_tree(n: int, far: np.ndarray, a: np.ndarray, b: np.ndarray, min_cluster: int) -> tuple[np.ndarray, np.ndarray]:
    """hdbscan() of n rows from edges (halves of squared distances) that hold a least spanning tree; of equal edges the first rows' counts first."""
    if n < max(2, min_cluster):
        return np.full(n, -1), np.zeros(n)
    # single linkage: node n + k joins two nodes at the distance of the k-th edge that joins anything
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), far))
    edges = zip(np.sqrt(2 * far[order]).tolist(), np.minimum(a, b)[order].tolist(), np.maximum(a, b)[order].tolist(), strict=True)
    top, parts, size = list(range(n)), {}, dict.fromkeys(range(n), 1)

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for d, a, b in edges:
        a, b, new = find(a), find(b), len(top)
        if a == b:
            continue
        top.append(new)
        top[a] = top[b] = new
        parts[new], size[new] = (a, b, d), size[a] + size[b]
    # condensed tree: a cluster goes on while only one side is large enough, and ends where both are
    born, kids, rows, score = {0: 0.0}, {0: []}, {0: []}, {0: 0.0}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            rows[c].append((node, np.inf))  # only if min_cluster is 1
            continue
        a, b, d = parts[node]
        lam = 1 / d if d > 0 else np.inf
        large = [x for x in (a, b) if size[x] >= min_cluster]
        if len(large) == 2:
            score[c] += (size[a] + size[b]) * (min(lam, 1e12) - born[c])
            for x in (a, b):
                new = len(born)
                born[new], kids[new], rows[new], score[new] = min(lam, 1e12), [], [], 0.0
                kids[c].append(new)
                stack.append((x, new))
            continue
        for x in (a, b):
            if x in large:
                stack.append((x, c))
            else:
                out = [x]
                while out:
                    y = out.pop()
                    if y < n:
                        rows[c].append((y, lam))
                        score[c] += min(lam, 1e12) - born[c]
                    else:
                        out += parts[y][:2]
    chosen, total = {}, {}
    for c in sorted(born, reverse=True):
        below = sum(total[k] for k in kids[c])
        chosen[c] = c > 0 and (not kids[c] or score[c] >= below)
        total[c] = max(score[c], below) if c > 0 else below
    labels, probability = np.full(n, -1), np.zeros(n)
    number = 0
    stack = [0]
    while stack:
        c = stack.pop()
        if not chosen[c]:
            stack += sorted(kids[c], reverse=True)
            continue
        inside, own = [c], []
        while inside:
            x = inside.pop()
            own += rows[x]
            inside += kids[x]
        lam = np.array([min(x, 1e12) for _, x in own])
        at = np.array([i for i, _ in own])
        labels[at], probability[at] = number, lam / lam.max()
        number += 1
    return labels, probability


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(np.round(1 - x @ y.T, 12), 0)  # products differ by rounding with what they are multiplied with


def _met(tiles: DataFrame, schema: str, give) -> DataFrame:
    """What give(keys, keys, distances, cores, cores, same) makes of each tile with itself and each two tiles of a group."""
    columns = ("group", "keys", "vectors", "cores")
    several = graph.written(tiles.groupBy("group").count().filter("count > 1").select(F.col("group").alias("of")))
    large = tiles.join(several, F.col("group").eqNullSafe(F.col("of")), "left_semi")
    sides = [large.select(*(F.col(c).alias(f"{c}_{side}") for c in (*columns, "tile"))) for side in "ab"]
    two = sides[0].join(sides[1].hint("shuffle_replicate_nl"), F.col("group_a").eqNullSafe(F.col("group_b")) & (F.col("tile_a") < F.col("tile_b")))
    one = [F.col(c).alias(f"{c}_a") for c in columns] + [F.lit(None).cast(dict(tiles.dtypes)[c]).alias(f"{c}_b") for c in columns[1:]]
    names = [f"{c}_a" for c in columns] + [f"{c}_b" for c in columns[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, vectors, cores, keys_b, vectors_b, cores_b = (batch.column(c)[i].values for c in range(1, 7))
                same = keys_b is None
                table = lambda v, k: _unit(v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(k), -1))
                number = lambda v: v.to_numpy(zero_copy_only=False)
                x = table(vectors, keys)
                far = _far(x, x if same else table(vectors_b, keys_b))
                values = give(number(keys), number(keys if same else keys_b), far, number(cores), number(cores if same else cores_b), same)
                if len(values[0]):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(values[0]), i))), *map(pa.array, values)], ["group", *(x.split()[0] for x in schema.split(", "))])

    return tiles.select(*one).union(two.select(*names)).mapInArrow(run, f"group {dict(tiles.dtypes)['group']}, {schema}")


def _edges(rows: DataFrame, min_samples: int = 1) -> DataFrame:
    """group, a, b, far: edges that hold a least spanning tree of each group's rows (group, key, v); far is 1 - cosine, or the greatest
    of it and the distances from both to their (min_samples - 1)-th nearest."""

    def tiled(rows: DataFrame) -> DataFrame:
        each = F.sort_array(F.collect_list(F.struct("key", "v", "core")))
        packed = rows.groupBy("group", F.floor(F.col("key") / TILE).alias("tile")).agg(each.alias("x"))
        return graph.written(packed.select("group", "tile", F.col("x.key").alias("keys"), F.col("x.v").alias("vectors"), F.col("x.core").alias("cores")))

    def nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray, _: np.ndarray, __: np.ndarray, same: bool) -> tuple:
        if same:
            np.fill_diagonal(far, np.inf)
        out = []
        for keys, table in ((a, far),) if same else ((a, far), (b, far.T)):
            least = np.partition(table, min(min_samples - 1, table.shape[1]) - 1, axis=1)[:, : min_samples - 1]
            out.append((np.repeat(keys, least.shape[1]), least.ravel()))
        key, value = (np.concatenate(z) for z in zip(*out, strict=True))
        return key[np.isfinite(value)], value[np.isfinite(value)]

    def spanning(a: np.ndarray, b: np.ndarray, far: np.ndarray, core_a: np.ndarray, core_b: np.ndarray, same: bool) -> tuple:
        d, i, j = spanning_edges(np.maximum(far, np.maximum(core_a[:, None], core_b[None, :])), same)
        keys = a if same else np.concatenate([a, b])
        return keys[i], keys[j], d

    plain = tiled(rows.withColumn("core", F.lit(0.0)))
    if min_samples > 2:  # with 2 it is the distance to the nearest, and no distance of a row is less
        found = _met(plain, "key long, far double", nearest).groupBy("key").agg(F.slice(F.sort_array(F.collect_list("far")), 1, min_samples - 1).alias("x"))
        plain = tiled(rows.join(found.select("key", F.element_at("x", -1).alias("core")), "key", "left").withColumn("core", F.coalesce("core", F.lit(0.0))))
    return _met(plain, "a long, b long, far double", spanning)


def by_group(vectors: DataFrame, group: str, id_col: str, vec_col: str, method: str = "average", most: int | None = None, **options) -> DataFrame:
    """group, id, cluster, probability of each row; clusters are numbered within a group. Null vectors are noise (-1).

    method: average (linkage) or density (hdbscan). most: rows of a group beyond which it is an error; by default there is no such bound.
    """
    bounded_batches(vectors.sparkSession)
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    rows = vectors.select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    if most is not None and (large := rows.groupBy("group").count().filter(F.col("count") > most).head(1)):
        raise ValueError(f"a group of {large[0]['count']} rows; at most {most} are wanted")
    rows = graph.written(global_rank(rows, [F.col("group"), F.col("id")], "key"))
    ok = rows.filter("v is not null").select("group", "key", "v")
    found = _density(ok, **options) if method == "density" else _average(ok, **options)
    return rows.select("group", "id", "key").join(found, "key", "left").select("group", "id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def _density(rows: DataFrame, min_cluster: int = 5, min_samples: int = 2) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.concatenate([frame["a"], frame["b"]]), return_inverse=True)
        cluster, probability = density_tree(len(keys), frame["far"].to_numpy(), at[: len(frame)], at[len(frame) :], min_cluster)
        return pd.DataFrame({"key": keys, "cluster": cluster, "probability": probability})

    return _edges(rows, min_samples).groupBy("group").applyInPandas(run, "key long, cluster int, probability double")


def _average(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        keys = frame["key"].to_numpy()
        labels = average_linkage(np.stack([np.asarray(x, float) for x in frame["v"]]), threshold)
        first = keys[np.unique(labels, return_index=True)[1]]
        return pd.DataFrame({"key": keys, "first": first[labels]})

    edges = graph.written(_edges(rows).filter(F.col("far") < threshold + 1e-9).select("a", "b"))
    linked = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = graph.components(linked, edges).withColumnRenamed("id", "key")
    merged = rows.join(label, "key").groupBy("label").applyInPandas(run, "key long, first long")
    placed = graph.written(rows.select("group", "key").join(merged, "key", "left").select("group", "key", F.coalesce("first", "key").alias("first")))
    numbered = global_rank(placed.filter("first = key").select("group", "first"), [F.col("first")], "number")
    least = numbered.groupBy("group").agg(F.min("number").alias("least"))
    own = numbered.alias("n").join(least.alias("l"), F.col("n.group").eqNullSafe(F.col("l.group"))).select("first", (F.col("number") - F.col("least")).alias("cluster"))
    return placed.join(own, "first").select("key", "cluster", F.lit(1.0).alias("probability"))


def topics(docs: DataFrame, id_col: str, terms_col: str, k: int = 8, vocabulary: int = 5_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, topic; topic, term, tf, score): k-means over TF-IDF vectors, and each topic's words by class-based TF-IDF."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    from .models import group_terms

    rows = docs.select(F.col(id_col).alias("id"), F.col(terms_col).alias("terms")).filter(F.size("terms") > 0)
    counted = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary).fit(rows).transform(rows)
    weighed = Normalizer(inputCol="raw", outputCol="features").transform(IDF(inputCol="tf", outputCol="raw").fit(counted).transform(counted))
    placed = KMeans(k=k, seed=seed, maxIter=20).fit(weighed).transform(weighed).select("id", F.col("prediction").alias("topic"), "terms")
    return placed.select("id", "topic"), group_terms(placed, "topic", "terms")
