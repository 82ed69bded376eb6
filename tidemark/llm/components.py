"""Connected components of a graph in a table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: A node with more neighbours than this is joined apart, by a broadcast; there are at most twice as many such nodes as edges, divided by it.
HOT = 100_000
#: Nodes whose minima are broadcast (16 bytes each), and rows that are worth a task: a round over few edges is a few tasks, whatever the number of shuffle partitions.
BROADCAST_ROWS, TASK_ROWS = 1_000_000, 100_000


def _table(df: DataFrame, most: int | None = None) -> tuple[DataFrame, str]:
    """df, of at most so many rows if that is known, as a table."""
    path = tables.new_folder(df.sparkSession, "edges")
    (df if most is None else df.coalesce(most // TASK_ROWS + 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _with_least(around: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """around with the minimum m of each row's u; rows of a node with many are not brought together."""
    n, n_hot = least.agg(F.count("*"), F.count_if(F.col("n") > hot)).first()
    if n <= BROADCAST_ROWS:
        return around.join(F.broadcast(least.select("u", "m")), "u")
    if not n_hot:
        return around.join(least.select("u", "m"), "u")
    many = F.broadcast(least.where(F.col("n") > hot).select("u", "m"))
    few = around.join(F.broadcast(least.where(F.col("n") > hot).select("u")), "u", "left_anti")
    return around.join(many, "u").unionByName(few.join(least.where(F.col("n") <= hot).select("u", "m"), "u"))


def _stars(edges: DataFrame, large: bool, hot: int, most: int) -> tuple[DataFrame, list[str]]:
    """One round: every node points its larger (or its smaller) neighbours, or itself, to the smallest one it knows; and the tables it has made, of at most so many rows."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path = _table(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), most)
        out = _with_least(around, least, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least, path = _table(around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), most)
        out = _with_least(around, least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out, made = _table(out.where("u <> v").distinct(), most)
    return out, [path, made]


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) is connected with; the smallest nodes too.

    The rounds number as the logarithm of the longest chain. Each round's edges
    are a table in the shared folder; those of rounds before are removed. A
    node with many neighbours is no group of its own in any task: minima are
    pre-aggregated, and the edges of such nodes meet them by a broadcast, as all
    do where the nodes are few. Edges that are null, repeat or join a node with
    itself add nothing.
    """
    spark = edges.sparkSession
    edges, path = _table(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct())
    before = None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if before == tuple(after) or not after[0]:
            break
        before = tuple(after)
        most = 2 * after[0]  # a round adds none: large stars give one edge for each of edges, small ones two
        half, made = _stars(edges, True, hot, most)
        edges, more = _stars(half, False, hot, most)
        for old in [path, *made, more[0]]:
            tables.drop(spark, old)
        path = more[1]
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(after[0] // TASK_ROWS + 1)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
