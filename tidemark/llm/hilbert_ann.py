"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

A vector x is scaled by the largest norm M and given the coordinate
sqrt(1 - |x|^2 / M^2), a query is scaled to 1 and given 0, so that the largest
inner product is the smallest distance. Each of CURVES orderings projects the
vectors onto DIMS random directions, places them by the quantiles of a bounded
sample, shifts the places at random and sorts by the Hilbert key. The key
range is cut into slabs of equal shares of the sample; every vector goes to
one slab of each curve, a query to its own and its neighbours. A slab compares
its queries with its vectors in one matrix product and reranks the best by
their exact products; the windows of all curves are merged by query.

Equal vectors are one node with its k + 1 smallest ids (no more can be among
anyone's k nearest), and equal queries are searched once, so a vector that
repeats makes no large group. The window is the same share of the rows at
every size: in some 60 dimensions without structure, neighbours are found with
a recall of 0.9 only if the windows together hold about as many rows as the
table. (Of a table of fewer than (k + 1) / SHARE rows a window is k + 1 rows.) A slab with many queries is worked on in parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import words as W

CURVES, DIMS, BITS = 32, 8, 4
#: Rows of the sample that quantiles and slabs are taken from.
SAMPLE = 20_000
#: A window is this share of the rows, in slabs; a slab has one SLABS-th of the rows, or SLAB_ROWS of a larger table.
SHARE, SLABS, SLAB_ROWS = 0.05, 60, 20_000
#: Queries that a task compares with a slab, about.
QUERY_ROWS = 20_000


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along the Hilbert curve of points with coordinates below 2**bits (rows of cells)."""
    n, dims = cells.shape
    gray = cells.astype(np.int64).T.copy()
    side = 1 << (bits - 1)
    while side > 1:  # undo the rotation of each sub-cube, from the largest
        low = side - 1
        for d in range(dims):
            flip = (gray[d] & side) != 0
            swap = np.where(flip, 0, (gray[0] ^ gray[d]) & low)
            gray[0] ^= np.where(flip, low, 0) ^ swap
            gray[d] ^= swap
        side >>= 1
    for d in range(1, dims):
        gray[d] ^= gray[d - 1]
    carry = np.zeros(n, np.int64)
    side = 1 << (bits - 1)
    while side > 1:
        carry ^= np.where(gray[dims - 1] & side, side - 1, 0)
        side >>= 1
    gray ^= carry
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | gray[d] >> b & 1
    return key


class Curves:
    """Projections, quantiles, shifts and slab bounds; of a size that doesn't depend on the data."""

    def __init__(self, sample: np.ndarray, largest: float, slabs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        self.largest, self.slabs = largest, slabs
        self.axes = [np.linalg.qr(rng.standard_normal((width, DIMS)))[0] if width >= DIMS else rng.standard_normal((width, DIMS)) for _ in range(CURVES)]
        self.shifts = rng.random((CURVES, DIMS))
        placed = self.lift(sample)
        grid = np.linspace(0, 1, (1 << BITS) + 1)[1:-1]
        self.edges = [np.quantile(placed @ a, grid, axis=0).T for a in self.axes]
        tie = rng.integers(0, 1 << 31, len(sample))
        self.bounds = [np.quantile(self.key(c, placed, tie), np.arange(1, slabs) / slabs, method="lower") for c in range(CURVES)]

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))])

    @staticmethod
    def aim(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])

    def key(self, curve: int, placed: np.ndarray, tie: np.ndarray) -> np.ndarray:
        p = placed @ self.axes[curve]
        at = np.column_stack([np.searchsorted(e, p[:, d]) for d, e in enumerate(self.edges[curve])])
        at = ((at / (1 << BITS) + self.shifts[curve]) / 2 * (1 << BITS)).astype(np.int64)
        return hilbert(at) << 31 | tie

    def slab(self, curve: int, placed: np.ndarray, tie: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.key(curve, placed, tie), "right")


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _deal(curves: Curves, width: int, reach: int, parts: int):
    """Rows by curve, slab and part: a vector goes to every part of its slab, a query to one part of each slab of its window."""
    names = ["curve", "slab", "part", "is_query", "node", "vector", "ids"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, node = _matrix(b.column(1), width), b.column(0).to_numpy()
            asked = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            tie = W.mix(pc.list_element(b.column(2), 0).to_numpy().astype(np.uint64)).astype(np.int64) & 0x7FFFFFFF
            lifted, aimed = curves.lift(x), curves.aim(x[asked])
            for c in range(CURVES):
                own = curves.slab(c, lifted, tie)
                at = curves.slab(c, aimed, tie[asked])
                low = np.clip(at - reach, 0, max(curves.slabs - 1 - 2 * reach, 0))
                count = np.minimum(low + 2 * reach, curves.slabs - 1) - low + 1
                rows = np.concatenate([np.repeat(np.arange(len(x)), parts), np.repeat(asked, count)])
                slab = np.concatenate([np.repeat(own, parts), np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
                part = np.concatenate([np.tile(np.arange(parts), len(x)), (np.repeat(tie[asked], count) >> 7) % parts])
                is_query = np.arange(len(rows)) >= len(x) * parts
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(slab.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(is_query), pa.array(node[rows]), b.column(1).take(take), b.column(2).take(take)], names=names)

    return run


def _search(width: int, k: int):
    """In a slab: of each query, the k + 1 best ids by exact product."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("is_query").to_numpy()
        own, query = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        out = {"node": [], "ids": [], "scores": []}
        if own.num_rows and query.num_rows:
            x, q = _matrix(own.column("vector"), width), _matrix(query.column("vector"), width)
            ids = own.column("ids").to_pylist()
            least = np.array([i[0] for i in ids])
            want = min(k + 12, len(x))
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                rough = part @ x.T
                best = np.argpartition(-rough, want - 1, axis=1)[:, :want]
                floor = np.take_along_axis(rough, best, 1).min(1)
                for r, node in enumerate(query.column("node")[a : a + 256].to_pylist()):
                    near = np.flatnonzero(rough[r] >= floor[r] - 1e-9)  # with all that tie with the last
                    exact = (x[near] * part[r]).sum(1)
                    order = np.lexsort((least[near], -exact))[: k + 1]
                    pairs = sorted((-s, i) for s, n in zip(exact[order].tolist(), near[order].tolist(), strict=True) for i in ids[n])[: k + 1]
                    out["node"].append(node)
                    out["ids"].append([i for _, i in pairs])
                    out["scores"].append([-s for s, _ in pairs])
        return pa.table(out, schema=pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries, the k nearest found of the rows of vectors with other ids.

    queries: rows of vectors. Nearest first by inner product, ties to the
    smaller id. Defined results: ids that are null and vectors that are null,
    zero, of another length than most, or hold nulls or non-finite numbers take
    no part; an id that repeats counts with each of its vectors, once for
    equal ones; fewer other rows than k give as many.
    """
    spark = vectors.sparkSession
    shared.prepare(spark)

    def clean(df):
        v = F.col(vector_col)
        fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
        return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("vector") if dict(df.dtypes)[vector_col] == "array<float>" else v.cast("array<double>").alias("vector"))

    rows = clean(vectors)
    sizes = rows.groupBy(F.size("vector").alias("s")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double"))).alias("m"))
    most = sizes.orderBy(F.desc("n"), "s").limit(1).collect()
    if not most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, largest = most[0]["s"], most[0]["n"], math.sqrt(most[0]["m"])
    keyed = rows.where(F.size("vector") == width)
    asked = clean(queries).where(F.size("vector") == width).withColumnRenamed("id", "query_id").distinct()
    first = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    nodes = keyed.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    wanted = asked.select("vector").distinct().withColumn("asked", F.lit(True))
    nodes = shared.written(nodes.join(wanted, "vector", "left").select(F.monotonically_increasing_id().alias("node"), "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")  # so numbered once
    asked = asked.join(nodes.where("asked").select("node", "vector"), "vector").select("query_id", "node")
    sample = nodes.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0], "vector").limit(SAMPLE).select("vector")
    sample = np.array([r["vector"] for r in sample.collect()], np.float64)
    slabs = max(SLABS, math.ceil(n / SLAB_ROWS))
    reach = math.ceil((max(SHARE, (k + 1) / n) * slabs - 1) / 2)  # a window holds k others
    n_asked = nodes.where("asked").count()
    parts = max(1, math.ceil(n_asked * (2 * reach + 1) / slabs / QUERY_ROWS))
    curves = Curves(sample, largest, slabs)
    kind = dict(nodes.dtypes)["vector"]
    dealt = nodes.select("node", "vector", "ids", "asked").mapInArrow(_deal(curves, width, reach, parts), f"curve int, slab int, part int, is_query boolean, node long, vector {kind}, ids array<long>")
    found = dealt.groupBy("curve", "slab", "part").applyInArrow(_search(width, k), "node long, ids array<long>, scores array<double>")
    pairs = F.arrays_zip("scores", "ids")
    best = found.select("node", F.explode(pairs).alias("p")).groupBy("node", F.col("p.ids").alias("vec_id")).agg(F.max("p.scores").alias("score"))
    ranked = asked.join(best, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the 20 nearest of each row of `embeddings` whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
