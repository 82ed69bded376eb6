"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The rows of a source, in the order of a hash of their ids, are cut into blocks.
In the ideal mix every source that has rows left flows at its weight's share
of a slot for each slot; a source that is used up leaves its share to the
others. The flow sets each block's window: it may not start before the slot in
which the flow begins it (its release) and must be done when the flow has
finished it (its deadline). In each slot, of the blocks released, the one with
the earliest deadline runs. All comparisons are of whole numbers, so at every
slot each source has had its target share to within less than one block,
however long the mix and whenever sources end. No row is dropped.

The schedule is the same whatever the size. Up to DRIVER_SOURCES sources and
DRIVER_BLOCKS blocks the driver makes it slot by slot; beyond, DataFrame
operations make the very same one (`_divided`). EDF of blocks of one slot gives
each block, in the order of deadlines, the first free slot from its release on,
and which slots a set of blocks takes together does not depend on their order.
So the slots that the earlier half of the deadlines takes follow from its
releases alone, by a running maximum; the later half has the others. Each half
is then a mix of its own, and halving goes on down to single blocks.

Row numbers within a source come from the counts of hash ranges whose number
grows with the source, so a source with a third of all rows is numbered in many
tasks.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

#: Rows of a hash range within a source, about.
RANGE_ROWS = 1000
#: Blocks beyond which the table of their slots is not broadcast (24 bytes each).
BROADCAST_BLOCKS = 500_000
#: Ranges of deadlines in which many sources' blocks are ordered.
DEADLINE_RANGES = 256
#: What the driver schedules itself; beyond, the same schedule is made in tasks.
DRIVER_SOURCES, DRIVER_BLOCKS = 100_000, 1_000_000
#: Blocks of a source that are listed at once.
LISTED = 100_000
#: 2 ** LEAF_BITS blocks are halved on within one task.
LEAF_BITS = 17
#: Digits of DIGIT bits in which fractions are compared, and the bits of a whole number in Spark's decimals.
DIGIT, DECIMAL_BITS = 20, 126


def whole(weights: dict) -> dict:
    """The weights as whole numbers in the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*[w.denominator for w in exact.values()]) if exact else 1
    parts = {s: int(w * common) for s, w in exact.items()}
    shrink = math.gcd(*parts.values()) or 1
    return {s: p // shrink for s, p in parts.items()}


def exact_slots(blocks: dict, weights: dict) -> dict:
    """The slot of each block, by source; equal deadlines go to the smaller name.

    At time t the flow of the live sources, of weight P together, has got to
    V = (t - n) / P, where n are the blocks of the sources that are used up;
    a source has flowed min(its blocks, V * its weight).
    """
    names = sorted((s for s in blocks if blocks[s]), key=str)
    parts = whole({s: weights[s] for s in names})
    p, n = [parts[s] for s in names], [blocks[s] for s in names]
    out = [array("q") for _ in names]
    fine = 2 * max((x.bit_length() for x in p), default=1) + 1  # so that unequal fractions stay unequal
    key = lambda j, k: (j << fine) // p[k]
    ends = sorted(range(len(names)), key=lambda k: (key(n[k], k), k))
    waiting, ready = [(0, k) for k in range(len(names))], []  # (where the next block begins, source), (where it ends, source)
    heapq.heapify(waiting)
    used, live, e = 0, sum(p), 0
    for t in range(sum(n)):
        while e < len(ends) and n[ends[e]] * live <= (t + 1 - used) * p[ends[e]]:
            used, live, e = used + n[ends[e]], live - p[ends[e]], e + 1
        while waiting and (not live or len(out[waiting[0][1]]) * live < (t + 1 - used) * p[waiting[0][1]]):
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (key(len(out[k]) + 1, k), k))
        _, k = heapq.heappop(ready)
        out[k].append(t)
        if len(out[k]) < n[k]:
            heapq.heappush(waiting, (key(len(out[k]), k), k))
    return dict(zip(names, out)) | {s: array("q") for s in blocks if not blocks[s]}


def targets(rows: dict, given: dict | None, temperature: float) -> dict:
    """Target weights: those given; the others, and all by default, rows ** temperature to six decimals, scaled to what is given."""
    powers = {s: Fraction(max(1, round(n**temperature * 10**6))) for s, n in rows.items()}
    have = {s: Fraction(v) for s, v in (given or {}).items() if s in rows}
    if any(v <= 0 for v in (given or {}).values()):
        raise ValueError("weights must be positive")
    scale = sum(have.values()) / sum(powers[s] for s in have) if have else Fraction(1)
    return {s: have.get(s, powers[s] * scale) for s in rows}


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = 16, temperature: float = 0.5, max_blocks: int | None = None, max_sources: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with source_block, slot and position (without gaps between blocks' slots).

    weights: target weight by source; sources without one, and all by default,
    get (their rows) ** temperature, scaled to the given ones' share. Blocks
    have block_rows rows; a source's last one may be short. position is slot *
    the rows of a block + the row's place in its block, so sorting by it gives
    the mixed order. Two coarser mixes are there for who asks for them:
    max_blocks makes blocks so large that the table has about as many, and
    beyond max_sources sources blocks are ordered by their deadlines alone,
    without releases (all is done in time, but a source may be ahead). Defined
    results: null is a source of its own (and sorts as ''),
    rows with a null id come in the order of a hash of the row, equal ids in
    any order; an empty table gives an empty result; columns named like a
    result are replaced.
    """
    made = ("source_block", "slot", "position")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    found = docs.groupBy(name.alias("s")).agg(F.count("*").alias("n"))
    rows = {r["s"]: r["n"] for r in found.limit(DRIVER_SOURCES + 1).collect()}
    given = {("=" + k if k is not None else ""): v for k, v in (weights or {}).items()}
    listed = len(rows) <= DRIVER_SOURCES
    n_sources, total, most = (len(rows), sum(rows.values()), max(rows.values(), default=0)) if listed else found.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    per_block = max(block_rows, math.ceil(total / max_blocks)) if max_blocks else block_rows
    coarse = max_sources is not None and n_sources > max_sources
    n_blocks = sum(-(-n // per_block) for n in rows.values()) if listed else found.agg(F.sum(F.ceil(F.col("n") / per_block))).first()[0]
    ranges = max(1, math.ceil(most / RANGE_ROWS))
    known = docs.columns
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.to_json(F.struct(*known), {"ignoreNullFields": "false"})).cast("binary"))
    tagged = docs.select(F.struct(*known).alias("row"), F.col(id_col).alias("id"), name.alias("__s"), order.alias("__h")).withColumn("__range", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * ranges / 2.0**32).cast("long"))
    counts = tagged.groupBy("__s", "__range").agg(F.count("*").alias("n"))
    before = counts.select("__s", "__range", (F.sum("n").over(Window.partitionBy("__s").orderBy("__range")) - F.col("n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__s", "__range").orderBy("__h", "id")) - 1
    numbered = tagged.withColumn("__at", at).join(before, ["__s", "__range"]).withColumn("__at", F.col("__at") + F.col("__before"))
    blocks = numbered.withColumn("source_block", F.floor(F.col("__at") / per_block).cast("long"))
    if coarse:
        slots = _by_deadline(found, given, temperature, per_block)
    elif listed and n_blocks <= DRIVER_BLOCKS:
        slots = _scheduled(docs.sparkSession, rows, targets(rows, given, temperature), per_block)
    else:
        slots = _divided(found, given, temperature, per_block, n_sources, n_blocks)
    small = listed and not coarse and n_blocks <= BROADCAST_BLOCKS
    out = blocks.join(F.broadcast(slots) if small else slots, ["__s", "source_block"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in known], "source_block", "slot", (F.col("slot") * per_block + F.col("__at") % per_block).alias("position"))


def _scheduled(spark, rows: dict, target: dict, per_block: int) -> DataFrame:
    """(__s, source_block, slot) of the driver's schedule; a source's slots travel as one text."""
    slots = exact_slots({s: -(-n // per_block) for s, n in rows.items()}, target)
    lines = [(s, ",".join(map(str, found))) for s, found in slots.items()]
    table = spark.createDataFrame(lines, "__s string, slots string")
    return table.select("__s", F.posexplode(F.split("slots", ",")).alias("source_block", "slot")).select("__s", F.col("source_block").cast("long"), F.col("slot").cast("long"))


def _divided(found: DataFrame, given: dict, temperature: float, per_block: int, n_sources: int, n_blocks: int) -> DataFrame:
    """(__s, source_block, slot) as exact_slots has them, of any number of sources and blocks.

    The driver sees the different counts of rows, at most (2 * rows) ** 0.5 of
    them. Weights whose whole numbers are beyond Spark's decimals (which the
    default's are not) are left to the driver's loop, whatever the size.
    """
    spark = found.sparkSession
    counts = [r["n"] for r in found.select("n").distinct().collect()]
    have = {}
    if given:
        names = spark.createDataFrame([(s,) for s in given], "s string")
        have = {r["s"]: r["n"] for r in found.join(F.broadcast(names), "s").collect()}
    parts = whole(targets(have | {n: n for n in counts}, given, temperature))
    bits = max(p.bit_length() for p in parts.values())
    if bits + max(DIGIT, n_sources.bit_length() + n_blocks.bit_length()) >= DECIMAL_BITS:
        rows = {r["s"]: r["n"] for r in found.collect()}
        return _scheduled(spark, rows, targets(rows, given, temperature), per_block)
    with tables.recorded() as made:
        by_count = spark.createDataFrame([(n, str(parts[n])) for n in counts], "n long, p string")
        sized = found.join(F.broadcast(by_count), "n")
        if have:
            by_name = spark.createDataFrame([(s, str(parts[s])) for s in have], "s string, q string")
            sized = sized.join(F.broadcast(by_name), "s", "left").withColumn("p", F.coalesce("q", "p"))
        sized = sized.select("s", F.ceil(F.col("n") / per_block).cast("long").alias("blocks"), F.col("p").cast("decimal(38,0)"))
        jobs = tables.written(_windows(sized, bits), "mix-windows")
        taken = _halved(jobs.select("rank", "release"), n_blocks)
        out = tables.written(jobs.join(taken, "rank").select(F.col("s").alias("__s"), "source_block", "slot"), "mix-slots")
        for path in tables.unused(spark, made, out):
            tables.drop(spark, path)
            made.remove(path)
    return out


def _placed(df: DataFrame, *order) -> DataFrame:
    """df in a total order: `at` grows with it, `part` is one of many stretches of it of about equal length."""
    return df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))


def _windows(sized: DataFrame, bits: int) -> DataFrame:
    """(s, source_block, rank, release): a block's place in the order of deadlines and names, and the slot in which the flow begins it.

    A source has a row m of m / p for each of 0..blocks: where its block m
    begins and m - 1 ends, in digits that tell any two different fractions.
    """
    chunks = sized.select("*", F.explode(F.expr(f"sequence(0L, blocks div {LISTED})")).alias("chunk")).repartition("s", "chunk")
    each = chunks.select("*", F.explode(F.expr(f"sequence(chunk * {LISTED}, least(blocks, chunk * {LISTED} + {LISTED - 1}))")).alias("m")).drop("chunk")
    each = each.withColumn("v0", F.expr("CAST(m AS DECIMAL(38,0)) div p")).withColumn("rest", F.expr("CAST(CAST(m AS DECIMAL(38,0)) % p AS DECIMAL(38,0))"))
    digits = ["v0"]
    for k in range(1, (2 * bits + 1) // DIGIT + 2):
        each = each.withColumn("more", F.expr(f"CAST(rest * {1 << DIGIT} AS DECIMAL(38,0))"))
        each = each.withColumn(f"v{k}", F.expr("more div p")).withColumn("rest", F.expr("CAST(more % p AS DECIMAL(38,0))"))
        digits.append(f"v{k}")
    placed = tables.written(_placed(each, *digits, "s").select("s", "blocks", "p", "m", "at", "part"), "mix-flow")
    ends = F.col("m") == F.col("blocks")
    sums = {"done": F.when(F.col("m") > 0, 1).otherwise(0), "used": F.when(ends, F.col("blocks")).otherwise(0), "gone": F.when(ends, F.col("p")).otherwise(0).cast("decimal(38,0)")}
    over = placed.groupBy("part").agg(*[F.sum(c).alias(f"part_{k}") for k, c in sums.items()])
    before = over.select("part", *[(F.sum(f"part_{k}").over(Window.orderBy("part")) - F.col(f"part_{k}")).cast("decimal(38,0)").alias(f"part_{k}") for k in sums])  # few rows
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("*", *[F.sum(c).over(upto).alias(k) for k, c in sums.items()]).join(F.broadcast(before), "part")
    live = F.lit(str(sized.agg(F.sum("p")).first()[0])).cast("decimal(38,0)") - F.col("gone") - F.col("part_gone")
    run = run.withColumn("live", live.cast("decimal(38,0)")).select("s", "m", "blocks", (F.col("done") + F.col("part_done") - 1).cast("long").alias("rank"), (F.expr("CAST(CAST(m AS DECIMAL(38,0)) * live AS DECIMAL(38,0)) div p") + F.col("used") + F.col("part_used")).cast("long").alias("release"))
    none = F.lit(None).cast("long")
    sides = F.array(F.struct(F.col("m").alias("source_block"), none.alias("rank"), F.col("release").alias("release")), F.struct((F.col("m") - 1).alias("source_block"), F.col("rank").alias("rank"), none.alias("release")))
    both = run.select("s", "blocks", F.explode(sides).alias("x")).select("s", "blocks", "x.*").where("source_block BETWEEN 0 AND blocks - 1")
    return both.groupBy("s", "source_block").agg(F.max("rank").alias("rank"), F.max("release").alias("release"))


def _halved(jobs: DataFrame, n: int) -> DataFrame:
    """(rank, slot): each of the n jobs, by rank, has the first slot from its release on that no smaller rank has.

    Jobs and slots are rows at times t of a node. With `ahead` of the jobs of
    the node's first half released by slot t, the half leaves t + 1 - ahead of
    the slots up to t idle, or as many as it left before, if those are more. A
    row goes with its half, its new time the busy or idle slots before it.
    """
    levels = max(1, (n - 1).bit_length())
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    rows = jobs.select(zero.alias("node"), F.col("release").alias("t"), "rank", none.alias("slot"))
    rows = rows.unionByName(jobs.sparkSession.range(n).select(zero.alias("node"), F.col("id").alias("t"), none.alias("rank"), F.col("id").alias("slot")))
    for bit in range(levels - 1, LEAF_BITS - 1, -1):  # nodes of many tasks
        placed = _placed(rows, "node", "t", "slot", "rank")
        local = tables.written(_idle(placed, bit, ["part", "node"], ["at"]), "mix-halves")
        sums = local.groupBy("node", "part").agg(F.sum(_first(bit)).alias("h"), F.max("left").alias("most"))
        parts = Window.partitionBy("node").orderBy("part")
        sums = sums.withColumn("h", F.sum("h").over(parts) - F.col("h"))
        sums = sums.select("node", "part", "h", F.max(F.col("most") - F.col("h")).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("most"))
        joined = local.join(F.broadcast(sums), ["node", "part"]).withColumn("left", F.col("left") - F.col("h"))
        rows = _sent(joined.withColumn("idle", F.greatest(zero, "most", F.col("idle") - F.col("h"))), bit)
    rows = rows.withColumn("leaf", F.col("node")).repartition("leaf")
    for bit in range(min(levels, LEAF_BITS) - 1, -1, -1):
        rows = _sent(_idle(rows, bit, ["leaf", "node"], ["t", "slot"]).withColumn("idle", F.greatest(zero, "idle")), bit)
    return rows.groupBy("leaf", "node").agg(F.max("rank").alias("rank"), F.max("slot").alias("slot")).select("rank", "slot")


def _first(bit: int) -> Column:
    """1 for a job of its node's first half."""
    return F.when(F.shiftright("rank", bit).bitwiseAND(F.lit(1)) == 0, 1).otherwise(0).cast("long")


def _idle(rows: DataFrame, bit: int, by: list, order: list) -> DataFrame:
    """With `left`, at slots, what the first half leaves idle of all up to here, and `idle`, the most of it before."""
    over = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("ahead", F.sum(_first(bit)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("left", F.when(F.col("slot").isNotNull(), F.col("t") + 1 - F.col("ahead")))
    return rows.withColumn("idle", F.max("left").over(over.rowsBetween(Window.unboundedPreceding, -1))).drop("ahead", "at")


def _sent(rows: DataFrame, bit: int) -> DataFrame:
    """Rows with the node and time of the half they go to."""
    first = F.when(F.col("slot").isNotNull(), F.col("left") <= F.col("idle")).otherwise(_first(bit) == 1)
    node, t = F.col("node") * 2 + F.when(first, 0).otherwise(1), F.when(first, F.col("t") - F.col("idle")).otherwise(F.col("idle"))
    return rows.select(*[c for c in rows.columns if c == "leaf"], node.alias("node"), t.alias("t"), "rank", "slot")


def _by_deadline(found: DataFrame, given: dict, temperature: float, per_block: int) -> DataFrame:
    """(__s, source_block, slot) of any number of sources: the rank of each block by where the flow ends it, then by name."""
    power = F.greatest(F.lit(1.0), F.round(F.pow("n", F.lit(temperature)) * 10**6))
    sized = found.withColumn("power", power).withColumn("blocks", F.ceil(F.col("n") / per_block).cast("long"))
    if given:
        listed = F.create_map(*[F.lit(x) for s, v in given.items() for x in (s, float(v))])
        sized = sized.withColumn("w", F.try_element_at(listed, "s"))
        scale = sized.agg(F.sum("w"), F.sum(F.when(F.col("w").isNotNull(), F.col("power")))).first()
        sized = sized.withColumn("w", F.coalesce("w", F.col("power") * (scale[0] / scale[1] if scale[1] else 1.0)))
    else:
        sized = sized.withColumn("w", F.col("power"))
    each = sized.select("s", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("source_block")).withColumn("due", (F.col("source_block") + 1) / F.col("w"))
    bounds = each.agg(F.percentile_approx("due", [k / DEADLINE_RANGES for k in range(1, DEADLINE_RANGES)], 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    ranged = each.withColumn("range", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("due"))) if bounds else F.lit(0))
    before = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # DEADLINE_RANGES rows
    rank = F.row_number().over(Window.partitionBy("range").orderBy("due", "s", "source_block")) - 1
    placed = ranged.withColumn("rank", rank).join(F.broadcast(before), "range")
    return placed.select(F.col("s").alias("__s"), "source_block", (F.col("rank") + F.col("before")).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the place of every document of `documents` in the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)


#: The schedule slot by slot: `due` and `live` are where the flow ends and begins a block.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS place FROM d),
sized AS (SELECT s, CAST((count(*) + 15) // 16 AS HUGEINT) AS n, CAST(greatest(1, round(sqrt(count(*)) * 1000000)) AS HUGEINT) AS p FROM d GROUP BY s),
src AS (SELECT *, row_number() OVER (ORDER BY s) AS k FROM sized),
b AS (SELECT k, p, CAST(unnest(range(CAST(n AS BIGINT))) AS HUGEINT) AS j FROM src),
w AS (SELECT b.k, b.j, ((b.j + 1) * 1152921504606846976) // b.p AS due,
    CAST(coalesce(sum(e.n) FILTER (e.n * b.p <= b.j * e.p), 0) AS HUGEINT) + (b.j * CAST(coalesce(sum(e.p) FILTER (e.n * b.p > b.j * e.p), 0) AS HUGEINT)) // b.p AS release
  FROM b, src e GROUP BY b.k, b.j, b.p),
edf(t, nxt, pick) AS (
  SELECT 0, (SELECT list(CAST(0 AS BIGINT)) FROM src), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda x, i: CASE WHEN i = c THEN x + 1 ELSE x END), c
  FROM (SELECT e.t, e.nxt, arg_min(w.k, {'due': w.due, 'k': w.k}) AS c FROM edf e JOIN w ON w.j = e.nxt[w.k] AND w.release <= e.t GROUP BY e.t, e.nxt)),
slots AS (SELECT src.s, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j, t - 1 AS slot FROM edf JOIN src ON src.k = edf.pick)
SELECT doc_id, source, CAST(place // 16 AS BIGINT) AS source_block, CAST(slot AS BIGINT) AS slot, CAST(slot * 16 + place % 16 AS BIGINT) AS position
FROM numbered JOIN slots ON numbered.s = slots.s AND numbered.place // 16 = slots.j
"""
