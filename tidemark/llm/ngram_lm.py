"""Language model scoring: interpolated modified Kneser-Ney of any order.

Counting. Tasks turn texts into word sequences of the order's length, as hashes
of 56 bits, add up what recurs in some MB of text and deal them by a hash of
the whole sequence, so that a frequent context is no larger a group than any
other. Each share becomes a shard: the sequences' hashes in order, with their
counts. It passes on, to the shares of the next lower order, the sequences
without their first word, each with the number of different words before it,
which is what counts there; and for every context the number of its tokens and
of its sequences of one, two and more. So down to the words. The driver gets
the sums that set the discounts, one row for each share of the words.

Scoring. Workers memory-map the shards in the shared folder and look up a
batch's distinct words, sequences and contexts in order. With c a sequence's
count at its order, c(h) its context's, D the order's discount of a count of 1,
2 or more, N_k(h) the number of sequences of k (3: or more) tokens that h
begins, and h' the context without its first word:

    P(w|h) = (c - D(c)) / c(h) + sum_k D(k) N_k(h) / c(h) * P(w|h')

in a context never seen it is P(w|h'); without a context c(h) is the sum of all
counts and P(w|h') is 1 / (V + 1), so that the probabilities of the V known
words (the end is one) and of one unknown word sum to 1 in every context.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import words as W

U = W.U
_KEEP = U(0xFFFFFFFFFFFFFF00)  # 56 bits
BEGIN, END = U(0x0101010101010100), U(0xFEFEFEFEFEFEFE00)
#: Text counted at once, and sequences in a share at most, about; word shares, which get a value of many sequences at once, are fewer by this much.
TEXT_BYTES, SHARE_GRAMS, FEWER_WORDS = 12 << 20, 1_000_000, 2
_ROWS = "share int, kind int, n int, blob binary"
_SCHEMA = pa.schema([("share", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
#: Kinds of rows: sequences, contexts of the order above, words with their tokens, sums.
_GRAMS, _CONTEXTS, _TOKENS, _SUMS = 0, 1, 2, 3
#: Of each order: sequences, the sum of their counts, those with counts 1, 2, 3, 4, and 3 or more.
_STATS = 7


@dataclass
class Model:
    folder: str
    order: int
    shares: list[int]  # by order, the words' first
    tokens: int = 0
    types: int = 0
    stats: list[list[int]] = field(default_factory=list)  # by order

    def discounts(self, order: int) -> list[float]:
        return _discounts(*self.stats[order - 1][2:6])


def _share(h: np.ndarray, shares: int) -> np.ndarray:
    """Ascending with h."""
    return (((h >> U(32)) * U(shares)) >> U(32)).astype(np.int64)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(u + U(0x632BE59BD9B4E019)) ^ w)


def _seven(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8).T[1:].tobytes()


def _unseven(blob, n: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    out[1:] = np.frombuffer(blob, np.uint8).reshape(7, n)
    return np.ascontiguousarray(out.T).view(U).reshape(n)


def _hash(words: list[np.ndarray]) -> np.ndarray:
    """Of a sequence: the hash of what comes before its last word, with that word."""
    out = words[0]
    for w in words[1:]:
        out = _pair(out, w)
    return out


def tokens(texts, order: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of each token with the order - 1 before it, the token last; first token of each text and the end). A text's last token is the end; before its first there are beginnings."""
    data, offsets = W.buffers(texts)
    word, firsts = [], [0]
    for i, j in W.batches(data, offsets):
        piece = W.LOWER[data[offsets[i] : offsets[j]]]
        s, e, f = W.word_spans(piece, offsets[i : j + 1] - offsets[i], W.SPACED)
        h = W.word_hashes(piece, s, e) & _KEEP
        last = f[1:] + np.arange(j - i)  # places of the ends
        w = np.empty(len(h) + j - i, U)
        w[last] = END
        at = np.ones(len(w), bool)
        at[last] = False
        w[at] = h
        word.append(w)
        firsts += (last + 1 + firsts[-1]).tolist()
    w, firsts = np.concatenate(word) if word else np.zeros(0, U), np.array(firsts, np.int64)
    columns = [w]
    place = np.arange(len(w)) - np.repeat(firsts[:-1], np.diff(firsts))
    for k in range(1, order):
        before = np.full(len(w), BEGIN, U)
        before[k:] = w[:-k] if len(w) > k else w[:0]
        columns.insert(0, np.where(place >= k, before, BEGIN))
    return columns, firsts


def _added(columns: list[np.ndarray], key: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Rows of equal key as one, in the order of keys, with the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return [c[order][at] for c in columns], key[at], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _grams(columns: list[np.ndarray], key: np.ndarray, count: np.ndarray, shares: int) -> list[tuple]:
    """Rows of sequences by share; within one in the order of their first word, which then packs well."""
    share = _share(key, shares)
    order = np.lexsort((columns[0], share))
    columns, count, share = [c[order] for c in columns], count[order], share[order]
    cuts = np.searchsorted(share, np.arange(shares + 1)).tolist()
    return [(k, _GRAMS, b - a, W.pack(columns[0][a:b]) + b"".join(_seven(c[a:b]) for c in columns[1:]) + W.planes(count[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _values(kind: int, key: np.ndarray, values: list[np.ndarray], shares: int) -> list[tuple]:
    """Rows of ascending keys with their values, by share."""
    cuts = np.searchsorted(_share(key, shares), np.arange(shares + 1)).tolist()
    return [(k, kind, b - a, W.pack(key[a:b]) + b"".join(W.pack_any(v[a:b]) for v in values)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)


def _count(order: int, shares: int):
    def emit(texts):
        W.release()
        columns, _ = tokens(pa.chunked_array(texts), order)
        columns, key, (count,) = _added(columns, _hash(columns), [np.ones(len(columns[0]), np.int64)])
        return _batch(_grams(columns, key, count, shares))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).cast(pa.large_string()))
            size += held[-1].nbytes
            if size >= TEXT_BYTES:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return run


def _read_values(table: pa.Table, kind: int, parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys and added values of all rows of a kind; a key is once in each row."""
    rows = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    rows = [(n, blob.as_buffer()) for n, blob in zip(rows.column("n").to_pylist(), rows.column("blob"), strict=True)]
    key = np.unique(np.concatenate([np.zeros(0, U), *[W.unpack(b[: 8 * n], n) for n, b in rows]]))
    values = [np.zeros(len(key), np.int64) for _ in range(parts)]
    for n, b in rows:
        at = np.searchsorted(key, W.unpack(b[: 8 * n], n))
        for i in range(parts):
            values[i][at] += W.unpack_any(b[8 * n * (1 + i) : 8 * n * (2 + i)], n)
    return key, values


def _shard(folder: str, level: int, order: int, shares: list[int]):
    """Write a shard of the sequences of one length, and of the contexts of the length above; pass on what the shorter ones need."""

    def run(table: pa.Table) -> pa.Table:
        W.release()
        share = table.column("share")[0].as_py()
        kinds = table.column("kind").to_numpy()
        sums = np.zeros((order, _STATS), np.int64)
        for blob in table.filter(pa.array(kinds == _SUMS)).column("blob"):
            sums += np.frombuffer(blob.as_buffer(), np.int64).reshape(order, _STATS)
        columns, counts = [[np.zeros(0, U)] for _ in range(level)], [np.zeros(0, np.int64)]
        grams = table.filter(pa.array(kinds == _GRAMS))
        for n, blob in zip(grams.column("n").to_pylist(), grams.column("blob"), strict=True):
            b = blob.as_buffer()
            columns[0].append(W.unpack(b[: 8 * n], n))
            for i in range(1, level):
                columns[i].append(_unseven(b[(1 + 7 * i) * n : (8 + 7 * i) * n], n))
            counts.append(W.unplanes(b[(1 + 7 * level) * n :], n).astype(np.int64))
        columns, count = [np.concatenate(c) for c in columns], np.concatenate(counts)
        del grams, counts
        columns, key, (count,) = _added(columns, _hash(columns), [count])
        sums[level - 1] += [len(key), count.sum(), *[(count == k).sum() for k in (1, 2, 3, 4)], (count >= 3).sum()]
        if level < order:
            context, (total, *some) = _read_values(table, _CONTEXTS, 4)
            shared.save(f"{folder}/contexts-{level + 1}-{share}", {"key": context, "total": total, "some": np.stack(some, 1).astype(np.uint32)})
        if level == order:
            word, _, (token,) = _added([columns[-1]], columns[-1], [count])
            word = word[0]
        else:
            word, (token,) = _read_values(table, _TOKENS, 1)
        if level == 1:
            at = np.searchsorted(word, key)  # every word that ends a sequence is a token
            shared.save(f"{folder}/words-{share}", {"word": key, "ends": count.astype(np.uint32), "count": token[at]})
            return pa.table({"stats": pa.array([[*sums.reshape(-1).tolist(), int(token.sum()), len(word)]], pa.list_(pa.int64()))})
        big = count >= 255
        shared.save(f"{folder}/grams-{level}-{share}", {"key": key, "count": np.minimum(count, 255).astype(np.uint8), "big_key": key[big], "big_count": count[big]})
        below = shares[level - 2]
        _, context, values = _added([], _hash(columns[:-1]), [count, *[(x).astype(np.int64) for x in (count == 1, count == 2, count >= 3)]])
        rows = _values(_CONTEXTS, context, values, below)
        del context, values
        tail, key, (before,) = _added(columns[1:], _hash(columns[1:]), [np.ones(len(key), np.int64)])
        rows += _grams(tail, key, before, below) + _values(_TOKENS, word, [token], below)
        rows.append((share % below, _SUMS, 1, sums.tobytes()))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 0, 1, 2, 3 and more, by the counts of counts; where these are too few, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [0.0] + [min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def train(texts: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Count every row of texts (null: empty) into shards in the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = texts.sparkSession
    shared.prepare(spark)
    texts = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    most = max(1, math.ceil(total / 8 / SHARE_GRAMS), min(32, math.ceil(total / 1e6)))
    model = Model(shared.new_folder(spark, "ngram"), order, [max(1, math.ceil(most / FEWER_WORDS)), *[most] * (order - 1)])
    rows = texts.mapInArrow(_count(order, most), _ROWS)
    for level in range(order, 0, -1):
        rows = rows.groupBy("share").applyInArrow(_shard(model.folder, level, order, model.shares), _ROWS if level > 1 else "stats array<long>")
    sums = np.zeros(order * _STATS + 2, np.int64)
    for row in rows.collect():  # one row for each share of the words
        sums += np.array(row["stats"], np.int64)
    model.stats = sums[:-2].reshape(order, _STATS).tolist()
    model.tokens, model.types = (int(x) for x in sums[-2:])
    return model


class _Reader:
    """The shards of a model, mapped as they are needed."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def _map(self, kind: str, k: int, name: str, of) -> np.ndarray:
        key = kind, k, name
        if key not in self.maps:
            try:
                self.maps[key] = shared.mapped(f"{self.model.folder}/{kind}-{k}", name, of)
            except FileNotFoundError:  # a share that got nothing
                self.maps[key] = np.zeros(0, of)
        return self.maps[key]

    def _found(self, kind: str, name: str, level: int, h: np.ndarray):
        """(share, places in it, places in h) of what is found of ascending hashes."""
        shares = self.model.shares[level - 1]
        cuts = np.searchsorted(_share(h, shares), np.arange(shares + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            keys = self._map(kind, k, name, U)
            if len(keys):
                part = h[cuts[k] : cuts[k + 1]]
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                ok = keys[at] == part
                yield k, at[ok], np.flatnonzero(ok) + cuts[k]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(different words before, tokens) of ascending word hashes."""
        ends, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for k, at, i in self._found("words", "word", 1, h):
            ends[i] = self._map("words", k, "ends", np.uint32)[at]
            count[i] = self._map("words", k, "count", np.int64)[at]
        return ends, count

    def contexts(self, level: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sequences of 1, 2, more) of the contexts of a sequence length."""
        total, some = np.zeros(len(h), np.int64), np.zeros((len(h), 3), np.int64)
        for k, at, i in self._found(kind := f"contexts-{level}", "key", level - 1, h):
            total[i] = self._map(kind, k, "total", np.int64)[at]
            some[i] = self._map(kind, k, "some", np.uint32).reshape(-1, 3)[at]
        return total, some

    def grams(self, level: int, key: np.ndarray) -> np.ndarray:
        count = np.zeros(len(key), np.int64)
        for k, at, i in self._found(kind := f"grams-{level}", "key", level, key):
            count[i] = self._map(kind, k, "count", np.uint8)[at]
            if (many := i[count[i] == 255]).size:
                big = np.searchsorted(self._map(kind, k, "big_key", U), key[many])
                count[many] = self._map(kind, k, "big_count", np.int64)[big]
        return count

    def score(self, texts) -> dict[str, np.ndarray]:
        m = self.model
        columns, firsts = tokens(texts, m.order)
        w, n = columns[-1], np.diff(firsts)
        words, at = np.unique(w, return_inverse=True)
        ends, count = self.words(words)
        uniform = 1 / (m.types + 1)
        if everything := m.stats[0][1]:
            d = np.array(m.discounts(1))
            one, two, more = m.stats[0][2], m.stats[0][3], m.stats[0][6]
            lower = np.maximum(ends - d[np.minimum(ends, 3)], 0) / everything + (d[1] * one + d[2] * two + d[3] * more) / everything * uniform
        else:
            lower = np.full(len(words), uniform)
        p = lower[at]
        for level in range(2, m.order + 1):
            d = np.array(m.discounts(level))
            h = _hash(columns[-level:-1])
            key, of = np.unique(_pair(h, w), return_inverse=True)
            c = self.grams(level, key)[of]
            context, of = np.unique(h, return_inverse=True)
            total, some = self.contexts(level, context)
            back = np.where(total > 0, some @ d[1:], 1.0) / np.maximum(total, 1)
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[of], 1) + back[of] * p
        text = np.repeat(np.arange(len(n)), n)
        add = lambda x: np.bincount(text, x, len(n))
        base = np.log10((count + 1) / (m.tokens + m.types + 1))
        return {"n_tokens": n, "n_known": add((count > 0)[at]).astype(np.int64), "base_score": add(base[at]), "score": add(np.log10(p))}


_readers: dict[str, _Reader] = {}


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without its text and with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    Defined results: a null text is empty; an empty text is the end alone; a
    model of no texts gives every text the score 0; columns named like a result
    are replaced; an empty table gives an empty result.
    """
    shared.prepare(docs.sparkSession)
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rest = [c for c in docs.columns if c not in made and c != text_col]
    docs = docs.select(*rest, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]], "n_tokens long, n_known long, train_tokens long, base_score double, score double"])

    def run(batches):
        reader = _readers.setdefault(model.folder, _Reader(model))
        for b in batches:
            texts = b.column(len(rest))
            size = texts.nbytes
            rows = max(1, min(len(texts), int(len(texts) * (4 << 20) / max(size, 1))))
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                got = reader.score(part.column(len(rest)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"]), pa.array(np.full(part.num_rows, model.tokens), pa.int64()), pa.array(got["base_score"]), pa.array(got["score"])], names=[*rest, *made])

    return docs.mapInArrow(run, schema)


def fold(column: Column, parts: int) -> Column:
    """crc32 of a column's text modulo parts; null is the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document of `documents`, scored by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(fold(F.col("doc_id"), 7) != 2))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
