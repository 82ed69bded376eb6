"""MinHash near-dedup with DartMinHash signatures.

A text is a weighted set: its shingles of `size` words, each with its number of
occurrences. Over every unit of a shingle's weight lies a row of darts, the
same for all texts, whose ranks are a Poisson process drawn from the shingle's
hash; a text throws the darts of rank below T = t / its weight, about
t = K (ln K + 2) whatever its length, and T doubles for a text that has left a
coordinate empty. A dart has a coordinate; the earliest dart of each makes the
signature. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity.

Texts that are equal in words are one node. Bands of ROWS coordinates join the
nodes: each member of a band's bucket is paired with the bucket's smallest
node, never with all. Pairs whose signatures agree too seldom fall out, the
others are compared exactly. Where a bucket then still holds several classes,
the members outside its first class are compared with each other and with that
class, in blocks of bounded size, by signature and then exactly, each pair in
the first of its buckets; a block gives at most one pair for each member: those
that join classes. Classes are the connected components of the pairs that are
similar enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import words as W
from .components import components

U = W.U
#: Coordinates and bands: a pair of similarity 0.8 misses every band with probability 3e-6.
BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: Signatures that agree in fewer coordinates than the threshold less this many standard errors are not compared exactly.
ERRORS = 4.5
#: Rows of a bucket that one task compares with as many others.
BLOCK = 1000
#: Rows of a table of pairs or ids that may be broadcast (16 bytes each), and bytes of a table of texts or signatures.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A key with more rows than this is joined apart, by a broadcast of what it meets; there are no more such keys than rows, divided by it.
HOT = 20_000


def cells(texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit weights as hashes, first of each text and the end, two hashes of each text's words)."""
    data, offsets = W.buffers(texts)
    data = W.LOWER[data]
    starts, ends, firsts = W.word_spans(data, offsets, W.ALNUM)
    h = W.word_hashes(data, starts, ends)
    counts = np.diff(firsts)
    whole = np.zeros((2, len(counts)), U)
    step = np.arange(len(h)) - np.repeat(firsts[:-1], counts)
    for i, x in enumerate((h, W.mix(h ^ U(0xA0761D6478BD642F)))):
        sums = np.concatenate([[U(0)], np.cumsum(x * W.powers(W._STEP, int(counts.max(initial=0)) + 1)[step], dtype=U)])
        whole[i] = W.mix(sums[firsts[1:]] - sums[firsts[:-1]] + counts.astype(U))
    begin = W.window_starts(firsts, size)
    grams = W.window_hashes(h, size)[begin] if len(begin) else np.zeros(0, U)
    doc = np.searchsorted(firsts, begin, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < size))  # one shingle of all words
    grams, doc = np.concatenate([grams, whole[0][short]]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    copy = np.arange(len(grams)) - np.repeat(at, np.diff(np.append(at, len(grams))))
    return W.mix(grams + copy.astype(U) * U(0xE7037ED1A0B428DB)), np.searchsorted(doc, np.arange(len(counts) + 1)), whole


def _throw(seed: np.ndarray, doc: np.ndarray, below: np.ndarray):
    """All darts of rank under below[doc]: (doc, coordinate, rank, identity)."""
    rank = np.zeros(len(seed))
    out = []
    j = 0
    while len(seed):
        h = W.mix(seed + U(j * 0x8EBC6AF09C88C6E3 % 2**64))
        rank = rank - np.log(((h >> U(11)).astype(np.float64) + 1) / 2.0**53)
        keep = rank < below[doc]
        seed, doc, rank, h = seed[keep], doc[keep], rank[keep], W.mix(h[keep] ^ U(0x589965CC75374CC3))
        out.append((doc, (h >> U(32)) % U(K), rank, h & U(0xFFFFFFFF)))
        j += 1
        if j > 1_000_000:
            raise AssertionError("a dart row does not end")
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, int)] * 4


def signatures(units: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """K identities for each text; texts without units get zeros."""
    n = len(firsts) - 1
    weight = np.diff(firsts)
    out = np.zeros((n, K), np.uint32)
    left, factor = np.flatnonzero(weight > 0), 1.0
    while len(left):
        below = np.zeros(n)
        below[left] = factor * K * (math.log(K) + 2) / weight[left]
        doc = np.repeat(np.arange(n), weight)
        use = below[doc] > 0
        d, c, r, i = _throw(units[use], doc[use], below)
        slot = d.astype(np.int64) * K + c.astype(np.int64)
        order = np.lexsort((r, slot))
        slot = slot[order]
        new = np.ones(len(slot), bool)
        new[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[new]] = i[order][new]
        full = np.bincount(slot[new] // K, minlength=n) == K
        left, factor = left[~full[left]], factor * 2
    return out


def _sign(size: int):
    def run(batches):
        for b in batches:
            W.release()
            texts = b.column(1).cast(pa.large_string())
            _, offsets = W.buffers(texts)
            for i, j in W.batches(None, offsets):
                units, firsts, whole = cells(texts.slice(i, j - i), size)
                sig = signatures(units, firsts)
                some = np.diff(firsts) > 0
                blobs = [s.tobytes() if k else None for s, k in zip(sig, some.tolist(), strict=True)]
                keys = [pa.array(x.view(np.int64)) for x in whole]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *keys, pa.array(blobs, pa.binary())], names=["id", "k1", "k2", "sig"])

    return run


@F.pandas_udf(T.IntegerType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    """Coordinates in which two signatures agree."""
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), K) if len(s) else np.zeros((0, K)) for s in (a, b))
    return pd.Series((x == y).sum(1).astype("int32"))


def _similar(size: int, threshold: float):
    """Pairs (u, v, text, text) that are similar enough, a few at a time: a batch of texts is as large as Arrow makes it."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                sides = [cells(part.column(c), size)[:2] for c in (2, 3)]
                out = []
                for k in range(part.num_rows):
                    x, y = (u[f[k] : f[k + 1]] for u, f in sides)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(both / max(len(x) + len(y) - both, 1))
                found = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], names=["u", "v", "similarity"])
                yield found.filter(pa.array([x >= threshold for x in out]))

    return run


def _block_links(size: int, threshold: float, least: int):
    """Of a block (or two): pairs of texts that are similar enough and join what nothing before joins, at most one for each text.

    Rows that may be similar to most come first, so that a text which many
    others are copies of joins them all and the rest needs no comparison. A
    pair that meets in several buckets is compared in that of its first band
    alone: there its two nodes are in a block, or one is the star's centre.
    """

    def run(table: pa.Table) -> pa.Table:
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        label = table.column("comp").to_numpy().copy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), K)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        bands = table.column("band").to_numpy()  # from 1; 0: another text of a node than the one that is in the bucket
        band = bands[bands > 0].min() - 1
        rows, cols = np.flatnonzero(part == i), np.flatnonzero(part == j)
        left, right = np.ascontiguousarray(sig[rows].T), np.ascontiguousarray(sig[cols].T)
        agree = np.zeros((len(rows), len(cols)), np.int8)
        may = label[rows][:, None] != label[cols][None, :]
        for b in range(BANDS):
            shared_band = None
            for k in range(b * ROWS, (b + 1) * ROWS):
                same = left[k][:, None] == right[k][None, :]
                agree += same
                if b < band:
                    shared_band = same if shared_band is None else shared_band & same
            if b < band:
                may &= ~shared_band
        may &= agree >= least
        us, vs = [], []
        if may.any():
            used = np.zeros(len(node), bool)
            used[rows[may.any(1)]] = used[cols[may.any(0)]] = True
            at = np.flatnonzero(used)
            units, firsts, _ = cells(table.column("t").take(pa.array(at)), size)
            ids = np.unique(units, return_inverse=True)[1]
            begin, weight = np.zeros((2, len(node)), np.int64)
            begin[at], weight[at] = firsts[:-1], np.diff(firsts)
            mark = np.zeros(len(ids) and int(ids.max()) + 1, bool)
            may &= (weight[rows] > 0)[:, None] & (weight[cols] > 0)[None, :]
            for r in np.argsort(-may.sum(1), kind="stable"):
                own = rows[r]
                other = cols[may[r]]
                if i == j:
                    may[:, r] = False
                other = other[label[other] != label[own]]
                if not len(other):
                    continue
                mine = ids[begin[own] : begin[own] + weight[own]]
                mark[mine] = True
                theirs = np.concatenate([ids[begin[c] : begin[c] + weight[c]] for c in other])
                both = np.add.reduceat(mark[theirs].astype(np.int64), np.cumsum(weight[other]) - weight[other])
                mark[mine] = False
                for c in other[both >= threshold * (len(mine) + weight[other] - both) - 1e-9]:
                    if label[c] != label[own]:
                        us.append(int(node[own]))
                        vs.append(int(node[c]))
                        label[label == label[c]] = label[own]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _band_keys():
    """The keys of a signature's bands, in their order."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring("sig", i * 4 * ROWS + 1, 4 * ROWS), i))


def _small(df: DataFrame) -> DataFrame:
    """df for broadcasting if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _meet(rows: DataFrame, table: DataFrame, key: str, column: str, hot: DataFrame) -> DataFrame:
    """rows with the row of table of their key; rows of a hot key (hot: the key alone, few) are not brought together if what they meet is small enough to broadcast."""
    if not hot.limit(1).count():
        return rows.join(table, key)
    met = table.join(F.broadcast(hot), key, "left_semi")
    if (met.agg(F.sum(F.octet_length(column))).first()[0] or 0) > BROADCAST_BYTES:
        return rows.join(table, key)  # left to the adaptive split of skewed joins
    cold = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(F.broadcast(met), key).unionByName(cold.join(table, key))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, n_copies): the smallest id of each row's class, and the number of rows that are equal to it in words.

    Words are runs of 0-9, a-z and characters beyond ASCII, after lower-casing
    A-Z. A class holds texts of equal words and what chains of pairs of weighted
    Jaccard similarity of at least threshold connect; a text of fewer than
    `size` words has one shingle. Defined results: a text without words (null,
    empty) is a class of its own; a row without an id has none; rows with the
    same id are one document, whose texts' classes are one; an empty table
    gives an empty result. Ids are integers.
    """
    shared.prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    signed = shared.written(texts.mapInArrow(_sign(size), "id long, k1 long, k2 long, sig binary"), "signatures")
    live = signed.where("id is not null and sig is not null")
    groups = live.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    groups = shared.written(groups, "groups")
    reps = live.join(groups.select(F.col("rep").alias("id")).distinct(), "id").select(F.col("id").alias("node"), "sig").distinct()
    reps = shared.written(reps, "nodes")
    banded = reps.select("node", F.explode(_band_keys()).alias("key"))
    centers = banded.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("last > center").select("key", "center")
    members = shared.written(banded.join(centers, "key"), "bands")
    stars = members.where("node > center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    sigs = lambda c: reps.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    error = math.sqrt(threshold * (1 - threshold) / K)
    least = math.floor(K * (threshold - ERRORS * error))
    stars = shared.written(stars, "stars")
    hot = _small(stars.groupBy("u").count().where(F.col("count") > HOT).select("u"))
    likely = _meet(stars, sigs("u"), "u", "sig_u", hot).join(sigs("v"), "v").where(_agree("sig_u", "sig_v") >= least).select("u", "v")
    known = shared.written(_verified(likely, texts, threshold, size), "pairs")
    # a document with several texts ties their groups
    ties = live.join(groups, ["k1", "k2"]).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")).join(live.groupBy("id").count().where("count > 1").select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")
    known = known.select("u", "v").unionByName(ties)
    classes = shared.written(components(known), "classes")
    extra = shared.written(_rest(members, reps, classes, texts, size, threshold, least), "pairs")
    if extra.limit(1).count():
        stars = classes.select(F.col("node").alias("u"), F.col("component").alias("v"))
        classes = shared.written(components(stars.unionByName(extra.select("u", "v"))), "classes")
    by_group = shared.written(groups.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("class_id"), "n_copies"), "classes")
    tagged = signed.withColumn("whole", F.col("id").isNotNull() & F.col("sig").isNotNull())
    found = tagged.where("whole").select("id", "k1", "k2")
    copied = _small(by_group.where(F.col("n_copies") > HOT))
    if copied.limit(1).count():  # a text that many rows hold is no group of a join
        few = found.join(copied.select("k1", "k2"), ["k1", "k2"], "left_anti").join(by_group.where(F.col("n_copies") <= HOT), ["k1", "k2"])
        found = found.join(copied, ["k1", "k2"]).unionByName(few)
    else:
        found = found.join(by_group, ["k1", "k2"])
    found = found.select(F.col("id").alias(id_col), "class_id", "n_copies")
    alone = tagged.where("not whole").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(alone)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(u, v, similarity) of the pairs that are similar enough, by their whole texts."""
    pairs = shared.written(pairs.distinct(), "candidates")
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    needed = texts.where("id is not null").join(_small(shared.written(ids, "ids")), "id", "left_semi")
    needed = shared.written(needed, "texts")
    side = lambda c: needed.select(F.col("id").alias(c), F.col("t").alias(f"t_{c}"))
    hot = _small(pairs.groupBy("u").count().where(F.col("count") > HOT).select("u"))
    both = _meet(pairs, side("u"), "u", "t_u", hot).join(side("v"), "v").select("u", "v", "t_u", "t_v")
    return both.mapInArrow(_similar(size, threshold), "u long, v long, similarity double")


def _rest(members: DataFrame, reps: DataFrame, classes: DataFrame, texts: DataFrame, size: int, threshold: float, least: int) -> DataFrame:
    """Pairs (u, v) that are similar enough and join classes that meet in a bucket; the star has compared its centre alone."""
    comp = classes.select("node", F.col("component").alias("comp"))
    tagged = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).where("node > center")
    several = tagged.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a < b")
    # parts 0 to first - 1 hold the class a, which is compared with the others only; the rest are all compared
    size_of = tagged.join(several.select("key", "a"), "key").groupBy("key", "a").agg(F.count_if(F.col("comp") == F.col("a")).alias("n_first"), F.count("*").alias("n"))
    blocks = size_of.select("key", "a", F.ceil(F.col("n_first") / BLOCK).cast("int").alias("first"), F.ceil((F.col("n") - F.col("n_first")) / BLOCK).cast("int").alias("others"))
    h = F.xxhash64("node")
    part = F.when(F.col("comp") == F.col("a"), F.pmod(h, F.col("first"))).otherwise(F.col("first") + F.pmod(h, F.col("others"))).cast("int")
    rows = tagged.join(blocks, "key").withColumn("part", part)
    rows = shared.written(rows.select("key", "first", "others", "part", "node", "comp"), "rest")
    ids = rows.select(F.col("node").alias("id")).distinct()
    needed = texts.where("id is not null").join(_small(shared.written(ids, "ids")), "id", "left_semi").select(F.col("id").alias("node"), "t").join(reps, "node")
    start = F.when(F.col("part") < F.col("first"), F.col("first")).otherwise(F.lit(0))
    dealt = rows.withColumn("k", F.explode(F.sequence(start, F.col("first") + F.col("others") - 1)))
    dealt = dealt.select("key", F.least("part", "k").cast("int").alias("i"), F.greatest("part", "k").cast("int").alias("j"), "part", "node", "comp")
    met = dealt.join(shared.written(needed, "texts"), "node").withColumn("band", F.array_position(_band_keys(), F.col("key")).cast("int"))
    return met.groupBy("key", "i", "j").applyInArrow(_block_links(size, threshold, least), "u long, v long").distinct()


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their class, one for each id; rows without an id stay."""
    classes = shared.written(near_duplicates(docs, threshold, size, id_col, text_col).select(F.col(id_col).alias("__id"), "class_id").where("__id is not null"), "classes")
    later = classes.where("__id <> class_id").select("__id").distinct()
    names = docs.columns
    out = docs.select(F.struct(*names).alias("__row"), F.col(id_col).cast("long").alias("__id")).join(_small(later), "__id", "left_anti")
    twice = classes.where("__id = class_id").groupBy("__id").count().where("count > 1").select("__id")
    if twice.limit(1).count():
        once = out.join(_small(twice), "__id", "left_semi").dropDuplicates(["__id"])
        out = out.join(_small(twice), "__id", "left_anti").unionByName(once)
    return out.select(*[F.col("__row").getField(c).alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the near-duplicate class of every document of `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
