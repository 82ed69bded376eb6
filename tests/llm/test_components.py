"""Components of random graphs with hot nodes, and the tables they leave."""

import importlib
import os
import random

import pytest

from tidemark.llm import tables
from tidemark.llm.components import components
from tidemark.sources.cluster import checkpoint_root


def plain(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [2, 100_000])
def test_hot_nodes_and_chains(spark, hot):
    rng = random.Random(hot)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(15)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(25)] + [(7, 7), (None, 3), (3, 0), (0, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), hot).collect()}
    assert got == plain(edges)


@pytest.mark.parametrize("hot", [2, 100_000])
def test_nodes_beyond_a_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(importlib.import_module("tidemark.llm.components"), "BROADCAST_ROWS", 10)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(15)] + [(200 + i % 7, 207 + i % 11) for i in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), hot).collect()}
    assert got == plain(edges)


def test_rounds_over_few_edges_are_few_tasks(spark, monkeypatch):
    """With many shuffle partitions that are not coalesced: each table of a round has as many files as its rows are worth."""
    of, files = importlib.import_module("tidemark.llm.components"), []
    written = of._table
    monkeypatch.setattr(of, "_table", lambda *a: files.append((out := written(*a))[0].inputFiles()) or out)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    edges = [(i, i + 1) for i in range(300)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame(edges, "u long, v long"))
        assert {r["node"]: r["component"] for r in found.collect()} == plain(edges)
        assert len(files) > 8 and all(len(x) == 1 for x in files[1:])
        few = monkeypatch.setattr(of, "TASK_ROWS", 50) or len(files)
        assert components(spark.createDataFrame(edges, "u long, v long")).count() == 301
        assert all(len(x) > 4 for x in files[few + 1 :][:2])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_of_a_scope_go(spark):
    root = checkpoint_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    with tables.scope(spark):
        edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long")
        found = tables.kept(components(edges), "components")
    assert found.count() == 10
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and next(iter(left)).startswith("components-")


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_buckets_groups_and_centres(docs, monkeypatch, seed):
    """A large class in the buckets of others, many exact copies, centres of many: as by brute force."""
    from test_text_ops import plain_classes

    from tidemark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "HOT", 4)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(25)]
    for i in range(25, 70):  # from near the base to half of it
        w = list(base)
        for _ in range(rng.choice([1, 2, 6, 12])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for k in range(6):  # families that share half of their words with the base
        other = base[:60] + [f"f{k}_{i}" for i in range(60)]
        rows += [(100 + 10 * k + j, " ".join(other[:-j] + [f"y{k}_{j}_{i}" for i in range(j)] if j else other)) for j in range(4)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(rows)).collect()}
    assert got == plain_classes(rows)


def test_records_within_records(spark):
    """Of two that have recorded nothing yet, the inner one ends first; what it has goes to the outer one."""
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    with tables.recorded() as outer:
        with tables.recorded() as inner:
            pass
        one = tables.written(edges, "one")
        with tables.recorded() as inner:
            two = tables.written(edges, "two")
        assert len(inner) == 1 and len(outer) == 2
    assert tables.unused(spark, outer, one) == outer[1:] and tables.unused(spark, outer, two) == outer[:1]
