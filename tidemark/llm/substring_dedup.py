"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are dealt, in the order of their ids, into blocks of a few MB. Every
block is at once a reference and something to factor. The index of all blocks
holds each block's distinct windows of `size` words by hash, is itself dealt
out by hash, and answers for a window with its first place: the earliest block
that holds it, the document there with the smallest id, and the word at which
it begins. A document is then parsed greedily: a factor begins with a window
that has a place before its document, and goes on as long as the next window's
place is the next word of the same document; the phrase stands there word for
word. At the factor's end the windows across the boundary are looked up on
their own: one of them with another place begins the next factor, which takes
over where the last one ended. A window without a place ends the phrase for
good, since no smaller document holds it. The factors' words are what is
removed.

What crosses the network is, for each window that is distinct in its block,
about six bytes, and for those that recur an answer, a question to the block
that has the place, and the place. No group is larger than a block of documents
or a share of the hashes: a passage that many documents hold counts once per
block. Within a share of the index, equality is that of a hash of 64 bits and of
the share's number, which comes from another.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import shared
from . import words as W

U = W.U
#: Windows in a share of the index, and about as many for each block and share at least.
SHARE_WINDOWS, ROW_WINDOWS = 2_000_000, 500
BLOCK_BYTES = (2 << 20, 32 << 20)
_BLOCK, _SHARE, _KIND, _N, _BLOB = "__block", "__share", "__kind", "__n", "__blob"
FACTORS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("source_id", T.LongType()), T.StructField("source_start", T.IntegerType())]))
#: What passes between the steps: by block and share, a kind and packed values.
_PASSED = f"{_SHARE} int, {_BLOCK} int, {_KIND} int, {_N} int, {_BLOB} binary"
_SCHEMA = pa.schema([(_SHARE, pa.int32()), (_BLOCK, pa.int32()), (_KIND, pa.int32()), (_N, pa.int32()), (_BLOB, pa.binary())])
#: Kinds: windows that recur (of the block that asks), windows asked for (of the block that has their place), their places.
_RECURS, _ASKED, _PLACES = 0, 1, 2


def _windows(texts, size: int):
    """Of one block: byte buffer, word starts, ends, firsts, window starts, hashes and second hashes."""
    data, offsets = W.buffers(texts)
    starts, ends, firsts, hashes = [], [], [np.zeros(1, np.int64)], []
    at = 0
    for i, j in W.batches(data, offsets):
        piece = data[offsets[i] : offsets[j]]
        s, e, f = W.word_spans(piece, offsets[i : j + 1] - offsets[i], W.SPACED)
        hashes.append(W.word_hashes(piece, s, e))
        starts.append(s + offsets[i])
        ends.append(e + offsets[i])
        firsts.append(f[1:] + at)
        at += len(s)
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    starts, ends, firsts, hashes = cat(starts, np.int64), cat(ends, np.int64), np.concatenate(firsts), cat(hashes, U)
    begin = W.window_starts(firsts, size)
    one = W.window_hashes(hashes, size)[begin] if len(begin) else np.zeros(0, U)
    two = W.window_hashes(W.mix(hashes ^ U(0x5851F42D4C957F2D)), size)[begin] if len(begin) else np.zeros(0, U)
    return data, starts, ends, firsts, begin, one, two


def _distinct(one: np.ndarray, two: np.ndarray, shares: int):
    """(order, index of the distinct window of each ordered one, distinct hashes by share and value, shares, place of each distinct one)."""
    order = np.argsort(one, kind="stable")
    ordered = one[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    share = (two[order[new]] % U(shares)).astype(np.int64)
    by_share = np.argsort(share, kind="stable")
    place = np.empty(len(by_share), np.int64)
    place[by_share] = np.arange(len(by_share))
    return order, group, new, ordered[new][by_share], share[by_share], place


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)


def _ordered(table: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """A block's rows in one order, whatever order they come in."""
    return table.take(pc.sort_indices(table.select([id_col, text_col]), sort_keys=[(id_col, "ascending"), (text_col, "ascending")]))


def _emit(text_col, size, shares):
    def run(table: pa.Table) -> pa.Table:
        W.release()
        block, rows = table.column(_BLOCK)[0].as_py(), []
        if block >= 0:
            *_, one, two = _windows(table.column(text_col), size)
            *_, hashes, share, _ = _distinct(one, two, shares)
            cuts = np.flatnonzero(np.diff(share)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(share)], strict=True):
                if b > a:
                    rows.append((int(share[a]), block, _RECURS, int(b - a), W.pack(hashes[a:b])))
        return _rows(rows)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each block, which of its windows in this share an earlier block holds, and the earliest such with the window's number there; for that block, the numbers that others ask for."""
    W.release()
    table = table.sort_by(_BLOCK)
    blocks, sizes = table.column(_BLOCK).to_numpy(), table.column(_N).to_numpy()
    hashes = np.concatenate([W.unpack(b.as_buffer(), int(n)) for b, n in zip(table.column(_BLOB), sizes, strict=True)])
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    begins = ends - sizes
    order = np.argsort(hashes, kind="stable")  # of equal ones the earliest block is first
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.empty(len(hashes), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    del order, ordered, hashes
    share, rows = table.column(_SHARE)[0].as_py(), []
    asked = np.zeros(len(first), bool)
    for k, (a, b) in enumerate(zip(begins, ends, strict=True)):
        hit = np.flatnonzero(row[first[a:b]] != k)
        if len(hit):
            at = first[a:b][hit]
            asked[at] = True
            rows.append((share, int(blocks[k]), _RECURS, len(hit), W.pack(hit) + W.planes(blocks[row[at]]) + W.planes(at - begins[row[at]])))
    for k, (a, b) in enumerate(zip(begins, ends, strict=True)):
        if (wanted := np.flatnonzero(asked[a:b])).size:
            rows.append((share, int(blocks[k]), _ASKED, len(wanted), W.pack(wanted)))
    return _rows(rows)


def _tell(id_col, text_col, size, shares):
    """A block's answers to what others ask of it: where each window first stands; what it asks itself is passed on."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        W.release()
        kinds = answers.column(_KIND).to_numpy()
        own = answers.filter(pa.array(kinds == _RECURS))
        wanted = answers.filter(pa.array(kinds == _ASKED))
        rows = []
        if wanted.num_rows and table.num_rows:
            table = _ordered(table, id_col, text_col)
            _, _, _, firsts, begin, one, two = _windows(table.column(text_col), size)
            order, _, new, _, share, place = _distinct(one, two, shares)
            at = np.empty(len(share), np.int64)
            at[place] = begin[order[np.flatnonzero(new)]]  # the first of equal windows: in the document with the smallest id
            doc = np.searchsorted(firsts, at, "right") - 1
            ids, offset = table.column(id_col).to_numpy()[doc], at - firsts[doc]
            block = table.column(_BLOCK)[0].as_py()
            for s, n, b in zip(wanted.column(_SHARE).to_pylist(), wanted.column(_N).to_pylist(), wanted.column(_BLOB), strict=True):
                number = W.unpack(b.as_buffer(), n)
                k = np.searchsorted(share, s) + number.astype(np.int64)
                rows.append((s, block, _PLACES, n, W.pack(number) + W.planes(at[k]) + W.planes(offset[k]) + W.pack_any(ids[k])))
        return pa.concat_tables([own.select(_SCHEMA.names).cast(_SCHEMA), _rows(rows)])

    return run


def _resolve(table: pa.Table) -> pa.Table:
    """Of a share: for each block its recurring windows with their places."""
    W.release()
    kinds = table.column(_KIND).to_numpy()
    told = table.filter(pa.array(kinds == _PLACES)).sort_by(_BLOCK)
    source, number, at, offset, ids = [], [], [], [], []
    for block, n, b in zip(told.column(_BLOCK).to_pylist(), told.column(_N).to_pylist(), told.column(_BLOB), strict=True):
        b = b.as_buffer()
        source.append(np.full(n, block, np.int64))
        number.append(W.unpack(b[: 8 * n], n).astype(np.int64))
        at.append(W.unplanes(b[8 * n : 12 * n], n))
        offset.append(W.unplanes(b[12 * n : 16 * n], n))
        ids.append(W.unpack_any(b[16 * n :], n))
    rows = []
    if source:
        key = np.concatenate(source) << 32 | np.concatenate(number)  # ascending
        at, offset, ids = np.concatenate(at), np.concatenate(offset), np.concatenate(ids)
        asks = table.filter(pa.array(kinds == _RECURS))
        for s, block, n, b in zip(asks.column(_SHARE).to_pylist(), asks.column(_BLOCK).to_pylist(), asks.column(_N).to_pylist(), asks.column(_BLOB), strict=True):
            b = b.as_buffer()
            where = W.unplanes(b[8 * n : 12 * n], n)
            k = np.searchsorted(key, where.astype(np.int64) << 32 | W.unplanes(b[12 * n :], n).astype(np.int64))
            rows.append((s, block, _PLACES, n, b[: 12 * n].to_pybytes() + W.planes(at[k]) + W.planes(offset[k]) + W.pack_any(ids[k])))
    return _rows(rows)


def _factors(begin, hit, block, at, size):
    """(first window, words, start) of greedy factors: maximal runs of windows whose places follow each other; each takes over where the one before ended."""
    joined = np.zeros(len(begin), bool)  # goes on with the factor of the window before
    joined[1:] = hit[1:] & hit[:-1] & (begin[1:] == begin[:-1] + 1) & (block[1:] == block[:-1]) & (at[1:] == at[:-1] + 1)
    opens = np.flatnonzero(hit & ~joined)
    ends = begin[np.flatnonzero(hit & ~np.append(joined[1:], False))] + size
    start = begin[opens].copy()
    start[1:] = np.maximum(start[1:], ends[:-1])  # a document ends before the next one's windows begin
    return opens, ends - start, start


def _parse(id_col, text_col, size, shares, schema):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        W.release()
        if not table.num_rows:
            return pa.table({f: pa.array([], to_arrow_type(schema[f].dataType)) for f in schema.names})
        table = _ordered(table, id_col, text_col)
        mine = table.column(_BLOCK)[0].as_py()
        texts = table.column(text_col)
        data, starts, ends, firsts, begin, one, two = _windows(texts, size)
        block, at = np.full(len(begin), -1, np.int64), np.zeros(len(begin), np.int64)
        offset, source = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        if mine >= 0 and len(begin):
            order, group, new, hashes, share, place = _distinct(one, two, shares)
            del one, two
            n = len(hashes)
            held = [np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)]
            ids = table.column(id_col).to_numpy()
            doc = np.searchsorted(firsts, begin, "right") - 1
            lead = order[np.flatnonzero(new)]  # of equal windows of this block the first, in the document with the smallest id
            held[1][place], held[2][place], held[3][place] = begin[lead], begin[lead] - firsts[doc[lead]], ids[doc[lead]]
            for s, m, b in zip(answers.column(_SHARE).to_pylist(), answers.column(_N).to_pylist(), answers.column(_BLOB), strict=True):
                b = b.as_buffer()
                k = np.searchsorted(share, s) + W.unpack(b[: 8 * m], m).astype(np.int64)
                held[0][k], held[1][k], held[2][k] = (W.unplanes(b[(8 + 4 * i) * m : (12 + 4 * i) * m], m) for i in range(3))
                held[3][k] = W.unpack_any(b[20 * m :], m)
            of = np.empty(len(begin), np.int64)
            of[order] = place[group]
            block, at, offset, source = (h[of] for h in held)
            block = np.where(block < 0, np.where(source < ids[doc], mine, -1), block)
        opens, n_factor, f_start = _factors(begin, block >= 0, block, at, size)
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, f_start, 1)
        np.add.at(change, f_start + n_factor, -1)
        removed = np.cumsum(change)[: len(starts)] > 0
        doc = np.searchsorted(firsts, f_start, "right") - 1
        n_removed = np.bincount(doc, n_factor, table.num_rows).astype(np.int64)
        blob, kept = data.tobytes(), []
        for i in range(table.num_rows):
            a, b = firsts[i], firsts[i + 1]
            if n_removed[i]:
                keep = a + np.flatnonzero(~removed[a:b])
                kept.append(b" ".join([blob[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
            else:
                kept.append(b" ".join(blob[starts[a] : ends[b - 1]].split()) if b > a else b"")
        lists = np.searchsorted(doc, np.arange(table.num_rows + 1))
        columns = (f_start - firsts[doc] if len(doc) else f_start, n_factor, block[opens], source[opens], offset[opens] + f_start - begin[opens])
        factor = pa.StructArray.from_arrays([pa.array(x, pa.int64() if k == 3 else pa.int32()) for k, x in enumerate(columns)], [f.name for f in FACTORS.elementType.fields])
        made = {
            "n_words": pa.array(np.diff(firsts), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "factors": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), factor),
        }
        return pa.table([made[f] if f in made else table.column(f) for f in schema.names], names=schema.names)

    return run


def _deal(bounds: list[int], blocks: int):
    edges = np.array(bounds, np.int64)

    @F.pandas_udf(T.IntegerType())
    def deal(ids: pd.Series) -> pd.Series:
        missing = ids.isna()
        out = np.searchsorted(edges, ids.fillna(0).astype("int64"), "right").astype("int32")
        return pd.Series(np.where(missing, -1 - np.arange(len(out)) % max(64, blocks), out).astype("int32"))

    return deal


def dedup_substrings(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words of windows of `size` words that also start in a document with a smaller id.

    Returns the columns of docs and n_words, n_removed, kept_text (the words
    kept, joined by one space) and factors: of each, its first word and number
    of words, and the block, document and word where the same words stand; a
    column of docs with one of these names is replaced. Factors don't overlap;
    all but those that take over from another have `size` words or more.
    Defined results: a null or empty text has no words; a row with a null id
    neither loses words nor counts as a reference; rows with the same id don't
    take words from each other, and are in one block; a text shorter than a
    window keeps all; an empty table gives an empty result. Ids are integers.
    """
    made = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType(), "factors": FACTORS}
    shared.prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in made]
    rest = [c for c in names if c not in (id_col, text_col)]
    types = {f.name: f.dataType for f in docs.schema.fields}
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")).alias("rest"))
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    shares = max(1, math.ceil(total / 6 / SHARE_WINDOWS), min(64, math.ceil(total / 6 / 100_000)))
    block_bytes = min(max(shares * ROW_WINDOWS * 6, BLOCK_BYTES[0]), BLOCK_BYTES[1])
    blocks = max(1, math.ceil(total / block_bytes))
    bounds = []
    if blocks > 1:  # by bytes: a document counts once for each mean size that it has
        weight = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / max(1, total // rows)).cast("int")
        weighed = docs.where(F.col("id").isNotNull()).select(F.explode(F.array_repeat(F.col("id"), F.greatest(weight, F.lit(1)))).alias("i"))
        bounds = weighed.agg(F.percentile_approx("i", [k / blocks for k in range(1, blocks)], min(10 * blocks, 1_000_000))).first()[0] or []
    dealt = docs.withColumn(_BLOCK, _deal(sorted(set(bounds)), blocks)("id"))
    by_block = dealt.groupBy(_BLOCK)
    index = by_block.applyInArrow(_emit("text", size, shares), _PASSED)
    answers = index.groupBy(_SHARE).applyInArrow(_answer, _PASSED)
    told = by_block.cogroup(answers.groupBy(_BLOCK)).applyInArrow(_tell("id", "text", size, shares), _PASSED)
    places = told.groupBy(_SHARE).applyInArrow(_resolve, _PASSED)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in made.items()]])
    cut = by_block.cogroup(places.groupBy(_BLOCK)).applyInArrow(_parse("id", "text", size, shares, schema), schema)
    back = {id_col: F.col("id"), text_col: F.col("text")}
    return cut.select(*[back[c].cast(types[c]).alias(c) if c in back else F.col("rest").getField(c).alias(c) for c in names], *made)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: what is left of each document of `documents`, as counts and a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
e AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS i FROM g JOIN e USING (s) WHERE first_id < doc_id),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
