"""A stored index of vectors for cosine search: cells of centroids, read with partition pruning.

Vectors are of length 1 and rotated to the principal axes of a sample, so that their first coordinates hold most of a product.
Each lives in the cell of its nearest centroid (by k-means on the same sample), in blocks of a bounded number of vectors with
like angles to the centroid. The table is partitioned by cell: a search reads the cells it visits and no others.

search() looks into the nearest cells of each query; with exact=True it then goes on to every cell, and in it every block,
that may by the triangle inequality of angles hold anything better than the n-th hit so far, so its result is that of a scan.

pairs_within() gives all pairs above a cosine, neighbours() the k nearest of each vector above a cosine, both exact. They join a
table with itself, so they need no index: vectors that are alike stand together in tiles of bounded size, written once, and each
pair of tiles that may hold a hit by their centres and radii is read from there (a Cartesian product of the tiles' partitions,
without a shuffle). Within it so are blocks of BLOCK vectors. Disk follows the vectors, work at worst the square of their number.

In a block the first coordinates are multiplied first; by Cauchy-Schwarz, the rest can add no more than the product of the
remaining lengths, and only vectors that could still be hits are multiplied in full. `offered` and `compared` count pairs.

A hot cell is many blocks, and queries meet blocks in batches of bounded size. What the driver holds is the sample (at most
`sample` vectors and SAMPLE_BYTES), the centroids and the numbers of cells. Null and zero vectors, those with nulls or of another length
than the first, and rows with a null id are in no index and have no hits. Ties go to the smaller id. Repeated ids are hits of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dot
from ..session import bounded_batches
from ..streaming.run import work_folder

#: Bytes of the sample that the driver takes.
SAMPLE_BYTES = 64 << 20
#: Vectors of a block, and queries that meet it at a time.
BLOCK, QUERIES = 256, 256
#: Vectors of a cell that one task sorts into blocks.
TASK_ROWS = 100_000
#: The share of coordinates that is multiplied first.
FIRST = 4
#: What rounding may cost a bound, and a cosine.
SLACK, ROUNDING = 1e-9, 1e-12
#: Bytes of a tile's vectors as doubles.
TILE_BYTES = 1 << 20


def _matrix(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are vectors of this length and not zero, those of length 1)."""
    fit = vectors.is_valid().to_numpy(zero_copy_only=False) & (pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == dims)
    flat = vectors.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return np.flatnonzero(fit)[good], flat[good] / norm[good, None]


def _angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centroids.T, -1, 1))


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; deterministic."""
    rng = np.random.default_rng(17)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(1))
        at = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], at)
    return np.unique(at, axis=0)


def _own(vectors: DataFrame, id_col: str, vec_col: str, kind: str = "double") -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).filter("id is not null and v is not null and size(v) > 0")


def _sample(own: DataFrame, sample: int) -> tuple[int, int, np.ndarray] | None:
    """(coordinates, rows that have as many, vectors of length 1 with the least hashes); None without vectors."""
    head = own.select(F.size("v").alias("dims")).groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not head:
        return None
    dims, rows = head[0]
    some = own.filter(F.size("v") == dims).orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample, SAMPLE_BYTES // (8 * dims)))).select("v").toArrow()
    known = _matrix(some["v"].combine_chunks(), dims)[1]
    return (dims, rows, known) if len(known) else None


class VectorIndex:
    """An index in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = bounded_batches(spark), path
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # one row for each centroid
        self.cells = np.array([r["cell"] for r in cells], int)
        self.centroids = np.array([r["centroid"] for r in cells])
        self.radius = np.array([r["radius"] for r in cells])
        self.size = np.array([r["size"] for r in cells])
        axes = spark.read.parquet(f"{path}/axes").orderBy("i").collect()
        self.axes = np.array([r["axis"] for r in axes])
        self.probes = 8
        self.offered, self.compared = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str, vec_col: str, path: str | None = None, cells: int | None = None, sample: int = 20_000) -> VectorIndex | None:
        """Writes the index of all rows into path (a new folder); None if no row has a vector. cells: by default the square root of the rows."""
        spark = bounded_batches(vectors.sparkSession)
        path = path or f"{work_folder(spark)}/index"
        own = _own(vectors, id_col, vec_col)
        sampled = _sample(own, sample)
        if sampled is None:
            return None
        dims, rows, known = sampled
        axes = np.linalg.eigh(known.T @ known)[1][:, ::-1].T  # rows, the widest first
        centroids = _centroids(known @ axes.T, cells or max(1, min(4096, math.isqrt(rows))))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, v = _matrix(batch.column(1), dims)
                if len(row):
                    v = v @ axes.T
                    angle = _angles(v, centroids)
                    cell = angle.argmin(1)
                    offsets = pa.array(np.arange(len(row) + 1) * dims, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.ListArray.from_arrays(offsets, pa.array(v.ravel())), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(row)), cell])], ["id", "v", "cell", "angle"])

        kind = dict(own.dtypes)["id"]
        placed_in = f"{path}/placed"
        own.mapInArrow(place, f"id {kind}, v array<double>, cell int, angle double").write.parquet(placed_in)
        placed = spark.read.parquet(placed_in)
        sizes = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("angle").alias("radius")).collect()  # a row for each centroid at most
        spark.createDataFrame([(r["cell"], centroids[r["cell"]].tolist(), r["radius"], r["size"]) for r in sizes], "cell int, centroid array<double>, radius double, size long").coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(axes)], "i int, axis array<double>").coalesce(1).write.parquet(f"{path}/axes")
        shares = spark.createDataFrame([(r["cell"], -(-r["size"] // TASK_ROWS)) for r in sizes], "cell int, shares long")
        dealt = placed.join(F.broadcast(shares), "cell").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")))
        dealt = dealt.repartition("cell", "share").sortWithinPartitions("cell", "share", "angle").select("id", "v", "angle", "cell", "share")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, n = [], 0

            def cut(last: bool) -> Iterator[pa.RecordBatch]:
                nonlocal kept, n
                rows = pa.Table.from_batches(kept).combine_chunks()
                key = np.stack([rows["cell"].to_numpy(), rows["share"].to_numpy()], 1)
                edge = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
                out = [(a, min(a + BLOCK, e)) for s, e in zip(edge, edge[1:], strict=False) for a in range(s, e, BLOCK)]
                if not last:  # the last block may go on
                    kept, n = rows.slice(out[-1][0]).to_batches(), len(key) - out[-1][0]
                    out = out[:-1]
                ids, flat, angle = rows["id"].combine_chunks(), rows["v"].combine_chunks(), rows["angle"].to_numpy()
                if out:
                    at = np.array([a for a, _ in out] + [out[-1][1]], np.int32)
                    values = flat.flatten()[int(at[0]) * dims : int(at[-1]) * dims]
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(pa.array(at - at[0]), ids[int(at[0]) : int(at[-1])]), pa.ListArray.from_arrays(pa.array((at - at[0]) * dims), values), pa.array(angle[at[:-1]]), pa.array(angle[at[1:] - 1]), pa.array(rows["cell"].to_numpy()[at[:-1]], pa.int32())],
                        ["ids", "vectors", "low", "high", "cell"],
                    )

            for batch in batches:
                kept.append(batch)
                n += batch.num_rows
                if n > 8 * BLOCK:
                    yield from cut(False)
            if n:
                yield from cut(True)

        dealt.mapInArrow(pack, f"ids array<{kind}>, vectors array<double>, low double, high double, cell int").write.partitionBy("cell").parquet(f"{path}/blocks")
        gone = spark._jvm.org.apache.hadoop.fs.Path(placed_in)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        return cls(spark, path)

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        """The stored blocks; of the named cells only, which the reader tells by their folders."""
        table = self.spark.read.parquet(f"{self.path}/blocks")
        return table if cells is None else table.filter(F.col("cell").isin(cells))

    def calibrate(self, n: int = 10, recall: float = 0.95, queries: int = 100) -> float:
        """Sets how many cells a search looks into so that it finds this share of the n nearest others, measured on stored vectors
        (the bounded number with the least hash) against the exact mode. Returns the share that it finds on these."""
        each = self.blocks().select("cell", F.explode(F.arrays_zip("ids", F.expr(f"transform(sequence(0, size(ids) - 1), i -> slice(vectors, i * {len(self.axes)} + 1, {len(self.axes)}))").alias("v"))).alias("x"))
        some = each.select("cell", F.col("x.ids").alias("id"), F.col("x.v").alias("v"))
        asked = self._kept(some.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(queries)).dropDuplicates(["id"]).withColumnRenamed("id", "query").withColumnRenamed("v", "q")
        first = self._kept(self._visit(self._visits(asked, "all", 0, -1.0), n, True))
        hits = self._ranked(first, n).select("query", "id").join(some.select("id", "cell"), "id").collect()  # n * queries rows, and copies of them
        if not hits:
            return 1.0
        vectors = {r["query"]: r["q"] for r in asked.collect()}
        order = {q: self.cells[np.argsort(_angles(np.array([v]), self.centroids)[0], kind="stable")].tolist() for q, v in vectors.items()}
        depth = np.sort([order[r["query"]].index(r["cell"]) + 1 for r in hits])
        self.probes = int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)])
        return float((depth <= self.probes).mean())

    def search(self, queries: DataFrame, id_col: str, vec_col: str, n: int, probes: int | None = None, exact: bool = False, least: float = -1.0, others: bool = False) -> DataFrame:
        """query, id, cos, rank (from 1) of the n best hits of each query, with a cosine of at least `least`.

        probes: cells that are looked into; by default as many as calibrate() found, or 8. others: a vector of the query's own id is no hit.
        """
        probes = probes or self.probes
        asked = self._asked(queries, id_col, vec_col)
        first = self._kept(self._visit(self._visits(asked, "nearest", probes, least), n, others))
        if exact:
            top = self._ranked(first, n)
            floor = top.groupBy("query").agg(F.when(F.count("*") >= n, F.min("cos")).alias("floor"))
            more = asked.join(floor, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(least)))
            first = top.drop("rank").unionByName(self._visit(self._visits(more, "beyond", probes, least), n, others))
        return self._ranked(first, n)

    def within(self, queries: DataFrame, id_col: str, vec_col: str, least: float, others: bool = False) -> DataFrame:
        """query, id, cos of all hits with a cosine of at least `least`; exact."""
        return self._visit(self._visits(self._asked(queries, id_col, vec_col), "all", 0, least), None, others)

    def _asked(self, queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        axes, dims = self.axes, len(self.axes)

        @F.arrow_udf("array<double>")
        def turned(vectors: pa.Array) -> pa.Array:
            row, v = _matrix(vectors, dims)
            v = v @ axes.T
            at = np.zeros(len(vectors) + 1, np.int64)
            at[row + 1] = dims
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(at), pa.int32()), pa.array(v.ravel()))
            return pa.compute.if_else(pa.array(at[1:] > 0), lists, pa.nulls(len(vectors), lists.type))

        own = queries.select(F.col(id_col).alias("query"), F.col(vec_col).cast("array<double>").alias("q"))
        return self._kept(own.select("query", turned("q").alias("q")).filter("q is not null and query is not null"))

    def _visits(self, asked: DataFrame, which: str, probes: int, least: float) -> DataFrame:
        """query, q, cell, theta (the angle between the query and the cell's centroid), floor."""
        centroids, radius, names, dims = self.centroids, self.radius, self.cells, len(self.axes)

        @F.arrow_udf("array<struct<cell:int,theta:double>>")
        def cells(vectors: pa.Array, floors: pa.Array) -> pa.Array:
            theta = _angles(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), centroids)
            order = np.argsort(theta, axis=1, kind="stable")
            near = np.zeros(theta.shape, bool)
            np.put_along_axis(near, order[:, :probes], True, axis=1)
            may = np.cos(np.maximum(theta - radius, 0)) >= floors.to_numpy()[:, None] - SLACK
            take = near if which == "nearest" else may if which == "all" else may & ~near
            row, cell = np.nonzero(take)
            items = pa.StructArray.from_arrays([pa.array(names[cell], pa.int32()), pa.array(theta[row, cell])], ["cell", "theta"])
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(theta) + 1)), pa.int32()), items)

        with_floor = asked if "floor" in asked.columns else asked.withColumn("floor", F.lit(least))
        out = with_floor.withColumn("to", F.explode(cells("q", F.col("floor").cast("double"))))
        return out.select("query", "q", F.col("to.cell").alias("cell"), F.col("to.theta").alias("theta"), F.greatest("floor", F.lit(least)).alias("floor"))

    def _visit(self, visits: DataFrame, n: int | None, others: bool) -> DataFrame:
        """query, id, cos of visits; at most n hits for each block, if n is given."""
        visits = self._kept(visits)
        count = visits.groupBy("cell").count().collect()  # a row for each centroid at most
        parts = self.spark.createDataFrame([(r["cell"], -(-r["count"] // QUERIES)) for r in count], "cell int, parts long")
        batches = visits.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts"))).groupBy("cell", "part").agg(F.collect_list(F.struct("query", "q", "theta", "floor")).alias("asked"))
        met = self.blocks([r["cell"] for r in count]).join(batches, "cell").select("ids", "vectors", "low", "high", "asked")
        dims, offered, compared = len(self.axes), self.offered, self.compared
        first = max(1, dims // FIRST)
        kind = dict(visits.dtypes)["query"]
        hit_kind = dict(self.blocks([]).dtypes)["ids"][6:-1]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, flat, low, high, asked = (batch.column(k)[i] for k in range(5))
                    ids, asked = ids.values, asked.values
                    x = flat.values.to_numpy(zero_copy_only=False).reshape(-1, dims)
                    q = asked.field("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    theta, floor = (asked.field(k).to_numpy(zero_copy_only=False) for k in ("theta", "floor"))
                    offered.add(len(x) * len(q))
                    gap = np.maximum(np.maximum(low.as_py() - theta, theta - high.as_py()), 0)  # of the block's ring of angles
                    live = np.flatnonzero(np.cos(gap) >= floor - SLACK)
                    if not len(live):
                        continue
                    q, floor = q[live], floor[live, None]
                    rest = [np.sqrt(np.maximum(0, 1 - (v[:, :first] ** 2).sum(1))) for v in (q, x)]
                    could = q[:, :first] @ x[:, :first].T + np.outer(*rest) >= floor - SLACK
                    rows, cols = np.flatnonzero(could.any(1)), np.flatnonzero(could.any(0))
                    compared.add(len(rows) * len(cols))
                    cos = q[rows] @ x[cols].T
                    if others:
                        own = asked.field("query").to_numpy(zero_copy_only=False)[live[rows]]
                        cos[own[:, None] == ids.to_numpy(zero_copy_only=False)[cols]] = -2.0
                    if n is not None and n < len(cols):  # what is below the n-th best of the block isn't among the n best
                        floor = np.maximum(floor[rows], np.partition(cos, len(cols) - n, axis=1)[:, len(cols) - n, None])
                    else:
                        floor = floor[rows]
                    r, c = np.nonzero((cos >= floor - SLACK) & (cos > -1.5))
                    yield pa.RecordBatch.from_arrays([asked.field("query").take(pa.array(live[rows[r]])), ids.take(pa.array(cols[c])), pa.array(cos[r, c])], ["query", "id", "cos"])

        return met.mapInArrow(score, f"query {kind}, id {hit_kind}, cos double")

    def _ranked(self, hits: DataFrame, n: int) -> DataFrame:
        # products of one pair of vectors differ by rounding with what they are multiplied with
        order = Window.partitionBy("query").orderBy(F.desc(F.round("cos", 12)), "id")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    def _kept(self, df: DataFrame) -> DataFrame:
        path = f"{work_folder(self.spark)}/rows"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _tiles(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int] | None:
    """(tile, ids, vectors, centre, radius; coordinates): vectors that are alike in tiles of TILE_BYTES, as a table."""
    spark = bounded_batches(vectors.sparkSession)
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # as they are, so that tiles take no more room
    own = _own(vectors, id_col, vec_col, kind)
    sampled = _sample(own, 20_000)
    if sampled is None:
        return None
    dims, rows, known = sampled
    centroids = _centroids(known, max(1, min(1024, math.isqrt(rows))))
    centroids = centroids[np.argsort(centroids @ np.linalg.eigh(known.T @ known)[1][:, -1], kind="stable")]  # along the widest axis
    most = max(16, TILE_BYTES // (8 * dims))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, v = _matrix(batch.column(1), dims)
            if len(row):
                angle = _angles(v, centroids)
                cell = angle.argmin(1)
                kept = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(row)), cell], pa.float32())], ["id", "v", "cell", "angle"])

    id_kind = dict(own.dtypes)["id"]
    placed = own.mapInArrow(place, f"id {id_kind}, v array<{kind}>, cell int, angle float")
    order = ["cell", "angle", F.xxhash64("id")]  # by the hash vectors that are equal are dealt out too
    placed = placed.repartitionByRange(max(1, min(4_000, -(-rows // most))), *order).sortWithinPartitions(*order).select("id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(part: pa.Table) -> pa.RecordBatch:
            ids, flat = part["id"].combine_chunks(), part["v"].combine_chunks()
            centre, radius = _rings(_matrix(flat, dims)[1], len(ids))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(ids) * dims], pa.int32()), flat.flatten()), pa.array(centre.tolist(), pa.list_(pa.float64())), pa.array(radius)], ["ids", "vectors", "centre", "radius"])

        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            while n >= most:
                rows_ = pa.Table.from_batches(kept)
                yield tile(rows_.slice(0, most))
                kept, n = rows_.slice(most).to_batches(), n - most
        if n:
            yield tile(pa.Table.from_batches(kept))

    path = f"{work_folder(spark)}/tiles"
    packed = placed.mapInArrow(pack, f"ids array<{id_kind}>, vectors array<{kind}>, centre array<double>, radius double").withColumn("tile", F.monotonically_increasing_id())
    packed.write.parquet(path)
    return spark.read.schema(packed.schema).parquet(path), dims


def _rings(v: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, the greatest angle to it) of every `rows` vectors of length 1."""
    parts = [v[i : i + rows] for i in range(0, len(v), rows)]
    centre = np.array([p.mean(0) for p in parts])
    norm = np.linalg.norm(centre, axis=1)
    centre = centre / np.maximum(norm, 1e-300)[:, None]
    radius = np.array([_angles(p, c[None])[:, 0].max() if n > 1e-6 else np.pi for p, c, n in zip(parts, centre, norm, strict=True)])
    return centre, radius


def _widest(least: float) -> float:
    """The angle beyond which no cosine is as large."""
    return math.acos(min(1.0, max(-1.0, least))) + 1e-6


def _apart() -> Column:
    """The least angle that vectors of tile a and tile b may have."""
    return F.acos(F.least(F.greatest(dot(F.col("centre_a"), F.col("centre_b")), F.lit(-1.0)), F.lit(1.0))) - F.col("radius_a") - F.col("radius_b")


def pairs_within(vectors: DataFrame, id_col: str, vec_col: str, least: float) -> DataFrame:
    """a, b (a < b), cos of all pairs of ids with a cosine of at least `least`; exact."""
    kind = dict(vectors.dtypes)[id_col]
    tiled = _tiles(vectors, id_col, vec_col)
    if tiled is None:
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cos double")
    tiles, dims = tiled
    sides = [tiles.select(*(F.col(c).alias(f"{c}_{side}") for c in ("ids", "vectors", "tile", "centre", "radius"))) for side in "ab"]
    near = (F.col("tile_a") <= F.col("tile_b")) & (_apart() <= _widest(least))
    met = sides[0].join(sides[1].hint("shuffle_replicate_nl"), near).select("ids_a", "vectors_a", "ids_b", "vectors_b", (F.col("tile_a") == F.col("tile_b")).alias("same"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids_a, flat_a, ids_b, flat_b, same = (batch.column(c)[i] for c in range(5))
                same = same.as_py()
                ids = pa.concat_arrays([ids_a.values, ids_b.values])
                codes = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                x, y = (_matrix(pa.ListArray.from_arrays(pa.array(np.arange(len(n.values) + 1) * dims, pa.int32()), f.values), dims)[1] for n, f in ((ids_a, flat_a), (ids_b, flat_b)))
                (cx, rx), (cy, ry) = _rings(x, BLOCK), _rings(y, BLOCK)
                live = _angles(cx, cy) - rx[:, None] - ry <= _widest(least)
                for block in np.flatnonzero(live.any(1)):
                    cols = np.flatnonzero(np.repeat(live[block], BLOCK)[: len(y)])
                    at = np.arange(block * BLOCK, min((block + 1) * BLOCK, len(x)))
                    cos = x[at] @ y[cols].T
                    hit = (cos >= least - ROUNDING) & (codes[at][:, None] != codes[len(x) + cols])
                    if same:
                        hit &= at[:, None] < cols
                    r, c = np.nonzero(hit)
                    q, o = at[r], len(x) + cols[c]
                    turned = codes[q] > codes[o]
                    q, o = np.where(turned, o, q), np.where(turned, q, o)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), ids.take(pa.array(o)), pa.array(cos[r, c])], ["a", "b", "cos"])

    return met.mapInArrow(score, f"a {kind}, b {kind}, cos double").withColumn("cos", F.least("cos", F.lit(1.0)))


def neighbours(vectors: DataFrame, id_col: str, vec_col: str, k: int, least: float = -1.0) -> DataFrame:
    """query, id, cos, rank of the k nearest others of each vector, with a cosine of at least `least`; exact. A bounded
    graph: k edges a vector.

    A task takes some tiles and reads all others one after the other. It holds each vector's k best so far, which bound what
    counts from then on, and gives them out at the end: so k rows of a vector are shuffled, however many tiles it meets.
    """
    kind = dict(vectors.dtypes)[id_col]
    tiled = _tiles(vectors, id_col, vec_col)
    if tiled is None:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, id {kind}, cos double, rank int")
    tiles, dims = tiled
    sides = [tiles.select(*(F.col(c).alias(f"{c}_{side}") for c in ("ids", "vectors", "tile", "centre", "radius"))) for side in "ab"]
    met = sides[0].join(sides[1].hint("shuffle_replicate_nl"), _apart() <= _widest(least)).select("ids_a", "vectors_a", "ids_b", "vectors_b", "tile_a")
    met = met.coalesce(tiles.rdd.getNumPartitions())  # pairs of partitions with the first in common stand in a row

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # of each tile: its ids, and of its hits rows, ids, cosines and what orders them
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids_a, flat_a, ids_b, flat_b, tile = (batch.column(c)[i] for c in range(5))
                ids, others, tile = ids_a.values.to_numpy(zero_copy_only=False), ids_b.values.to_numpy(zero_copy_only=False), tile.as_py()
                if tile not in held:
                    held[tile], floors[tile] = (ids_a.values, np.zeros(0, int), others[:0], np.zeros(0), np.zeros(0)), np.full(len(ids), least - ROUNDING)
                floor, found = floors[tile], []
                codes = np.unique(np.concatenate([ids, others]), return_inverse=True)[1]
                own = codes[: len(ids)], codes[len(ids) :]
                mixed = len(np.intersect1d(*own)) > 0
                x, y = (_matrix(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * dims, pa.int32()), f.values), dims)[1] for n, f in ((ids, flat_a), (others, flat_b)))
                (cx, rx), (cy, ry) = _rings(x, BLOCK), _rings(y, BLOCK)
                live = _angles(cx, cy) - rx[:, None] - ry <= _widest(least)
                for block in np.flatnonzero(live.any(1)):
                    cols = np.flatnonzero(np.repeat(live[block], BLOCK)[: len(y)])
                    at = np.arange(block * BLOCK, min((block + 1) * BLOCK, len(x)))
                    cos = x[at] @ y[cols].T
                    if mixed:
                        cos[own[0][at][:, None] == own[1][cols]] = -2.0
                    hit = cos >= floor[at, None]
                    if hit.sum() > 4 * k * len(at) and 0 < k < len(cols):  # what is below the k-th best isn't among the k best
                        hit &= cos >= np.partition(cos, len(cols) - k, axis=1)[:, len(cols) - k, None] - SLACK
                    r, c = np.nonzero(hit)
                    found.append((at[r], others[cols[c]], cos[r, c], np.round(cos[r, c], 12)))
                if any(len(f[0]) for f in found):
                    row, who, value, key = (np.concatenate(z) for z in zip(held[tile][1:], *found, strict=True))
                    order = np.lexsort((np.unique(who, return_inverse=True)[1], -key, row))
                    place = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
                    kept = order[place < k]
                    held[tile] = held[tile][0], row[kept], who[kept], value[kept], key[kept]
                    last = order[place == k - 1]
                    floor[row[last]] = np.maximum(floor[row[last]], key[last] - SLACK)
        for ids_, row, who, value, key in held.values():
            yield pa.RecordBatch.from_arrays([ids_.take(pa.array(row)), pa.array(who, ids_.type), pa.array(value), pa.array(key)], ["query", "id", "cos", "key"])

    hits = met.mapInArrow(best, f"query {kind}, id {kind}, cos double, key double")
    order = Window.partitionBy("query").orderBy(F.desc("key"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query", "id", F.least("cos", F.lit(1.0)).alias("cos"), "rank")


def search_within(index: VectorIndex, queries: DataFrame, id_col: str, vec_col: str, n: int, allowed: DataFrame | None = None, over: int = 10, **how: object) -> DataFrame:
    """The n best of n * over hits that are in allowed (id), as a search that filters what the index gives: fewer than n if the rest isn't allowed."""
    found = index.search(queries, id_col, vec_col, n * over, **how)
    if allowed is not None:
        found = found.join(allowed.select("id").distinct(), "id", "left_semi")
    return index._ranked(found.drop("rank"), n).select("query", "id", "cos", "rank")
