"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each by zstd's own trainer on the text
of its class. The toxic class's text is what its texts have of their own: the
words that begin as words of ordinary texts reliably seldom do. The ordinary
class's text is that of ordinary texts without words that hold such a beginning. A window of a text
is compressed once with the ordinary dictionary and once with the toxic one
laid over it, so that the two differ in what toxic texts add and in nothing
else; the bytes that the second saves are the window's distance. A text's
distances (mean, largest, share and number over thresholds) give its score by
a logistic calibration fitted on labelled texts that neither dictionary has
seen; 0.5 is the threshold.

The labelled sample is bounded in rows and bytes and drawn by a hash of the
ids; its texts are whole. Scoring covers all windows of all texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WINDOW = 64  # bytes
GRAM = 5  # bytes
LONGEST = 24  # bytes of a piece, with the spaces around it
REPEATS = 4
#: Bytes of the ordinary dictionary, and of the toxic one at most; a toxic one has a quarter of its training text at most.
BASE_BYTES, TOXIC_BYTES = 110_000, 8_000
#: What the trainer takes and counts at once: segments and sequences of bytes.
SEGMENT, SEQUENCE = LONGEST, 6
_OVER = (1, 2, 4)


@dataclass
class Model:
    """Dictionary contents and the calibration; some 230 KB whatever the corpus."""

    toxic: bytes
    ordinary: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]
    prior: float
    low: list[float] = field(default_factory=list)  # the features' range in calibration: a longer text counts as the longest there
    high: list[float] = field(default_factory=list)


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    # small windows, so small tables; matches of a trainer's sequence and more
    p = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=SEQUENCE, target_length=16, strategy=zstd.STRATEGY_BTLAZY2)
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=p)


def _plain(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().split())


def windows(plain: bytes) -> list[bytes]:
    """Runs of whole words of WINDOW bytes or a little more."""
    out, at = [], 0
    while at < len(plain):
        end = plain.find(b" ", at + WINDOW)
        end = len(plain) if end < 0 else end
        out.append(plain[at:end])
        at = end + 1
    return out


def _features(plain: bytes, toxic, ordinary) -> list[float]:
    d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(plain)] or [0], float)
    top = np.sort(d)[::-1]
    return [d.mean(), top[0], top[:3].mean(), *[(d >= k).mean() for k in _OVER], *[np.log1p((d >= k).sum()) for k in _OVER], np.log1p(len(d))]


def _pieces(own: list[bytes], other: list[bytes], z: float = 3.0, least: float = 4.0) -> list[bytes]:
    """Beginnings of words, surest last, that are at least `least` times as frequent in own texts, by z standard errors.

    A text counts a beginning up to REPEATS times. Of beginnings that share
    most of their places the longest stays; a longer one that is less sure than
    a shorter one that stays goes.
    """
    low = lambda n, m: np.log((n + 0.5) / (len(own) + 1)) - np.log((m + 0.5) / (len(other) + 1)) - z * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
    split: list[list] = [list(own), list(other)]  # texts, then the words that may still go on
    at: list[Counter] = [Counter(), Counter()]
    for size in range(GRAM, LONGEST + 1):
        found: list[Counter] = []
        for side in (0, 1):
            total: Counter = Counter()
            for k, words in enumerate(split[side]):
                words = Counter(b" " + w + b" " for w in words.split()) if size == GRAM else words
                known = found[0] if side else at[0] if size > GRAM else None
                split[side][k] = words = {w: n for w, n in words.items() if len(w) >= size and (known is None or w[: size if side else size - 1] in known)}
                mine: Counter = Counter()
                for w, n in words.items():
                    mine[w[:size]] += n
                total.update({p: min(n, REPEATS) for p, n in mine.items()})
            # too rare in own texts, were it in no other: so are all that go on from it
            found.append(Counter({p: n for p, n in total.items() if side or low(n, 0) > np.log(least)}))
        if not found[0]:
            break
        at[0].update(found[0])
        at[1].update(found[1])
    good = {p: x for p, n in at[0].items() if (x := low(n, at[1][p])) > np.log(least)}
    begins = lambda p: [p[:k] for k in range(GRAM, len(p)) if p[:k] in good]
    short = {q for p in good for q in begins(p) if at[0][p] >= 0.8 * at[0][q]}
    kept = [p for p in good if p not in short and not any(q not in short and good[q] >= good[p] for q in begins(p))]
    return sorted(kept, key=lambda p: (good[p], p))


def _sides(pieces: list[bytes], own: list[bytes], other: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Samples of 200 bytes: of own texts the words that begin with a piece, of the others the words that hold none anywhere; in an order of hashes."""
    begins, bare = tuple(pieces), {p.strip() for p in pieces}
    sizes = {len(p) for p in bare}
    begun: dict[bytes, bool] = {}
    clean: dict[bytes, bool] = {}
    for texts, known, test in (
        (own, begun, lambda w: (b" " + w + b" ").startswith(begins)),
        (other, clean, lambda w: not any(w[i : i + n] in bare for n in sizes for i in range(len(w) - n + 1))),
    ):
        known.update({w: test(w) for w in {w for t in texts for w in t.split()}})
    out = []
    for texts, known in ((own, begun), (other, clean)):
        lines = [b" " + b" ".join(w for w in t.split() if known[w]) + b" " for t in texts]
        out.append(sorted((s[i : i + 200] for s in lines if len(s) > 2 for i in range(0, len(s), 200)), key=zlib.crc32))
    return out[0], out[1]


def _trained(samples: list[bytes], size: int) -> bytes:
    """The trainer's dictionary; the samples themselves if they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples, k=SEGMENT, d=SEQUENCE).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[str, int]]) -> Model:
    """From (text, 1 if toxic). Texts that repeat count once; which train and which calibrate is a hash of the text."""
    texts = {_plain(t): int(k) for t, k in sorted(sample)}
    train = {t: k for t, k in texts.items() if zlib.crc32(t) % 10 < 7}
    held = {t: k for t, k in texts.items() if t not in train}
    prior = (sum(texts.values()) + 0.5) / (len(texts) + 1)
    own, other = [t for t, k in train.items() if k], [t for t, k in train.items() if not k]
    toxic_side, ordinary_side = _sides(_pieces(own, other), own, other)
    over = _trained(toxic_side, max(1000, min(TOXIC_BYTES, sum(map(len, toxic_side)) // 4))) if toxic_side else b""
    base = _trained(ordinary_side, BASE_BYTES) if ordinary_side else b""
    # zstd finds no match that begins in the last bytes of a dictionary
    model = Model(base + over + bytes([1]) * 16, base + bytes([1]) * (len(over) + 16), [], [], [], prior)
    if not over or not base or len(set(held.values())) < 2:
        return model
    made = _compressor(model.toxic), _compressor(model.ordinary)
    x, y = np.array([_features(t, *made) for t in held]), np.array(list(held.values()), float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    model.mean, model.scale = mean.tolist(), scale.tolist()
    model.low, model.high = x.min(0).tolist(), x.max(0).tolist()
    model.weights = _logistic((x - mean) / scale, y).tolist()
    return model


_made: dict = {}


def score_texts(texts, model: Model) -> np.ndarray:
    key = hashlib.sha256(model.toxic + model.ordinary).digest()
    if key not in _made:
        _made.clear()
        _made[key] = _compressor(model.toxic), _compressor(model.ordinary)
    if not model.weights:
        return np.full(len(texts), model.prior)
    x = np.array([_features(_plain(t), *_made[key]) for t in texts]).reshape(len(texts), -1)
    x = np.clip(x, model.low, model.high) if len(x) else x.reshape(0, len(model.mean))
    z = model.weights[0] + ((x - model.mean) / model.scale) @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(text: Column, model: Model) -> Column:
    """0 to 1, higher: likelier toxic. Null and empty texts have one window of distance 0; a model without either class gives the labels' share."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(score_texts(s.where(s.notna(), None).tolist(), model))

    return run(text)


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_ordinary: int = 6000, max_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a sample of labelled rows with their whole texts.

    Of each class the sample is the first max_toxic or max_ordinary rows in the
    order of a hash of their ids, and no more of them than have max_bytes
    together (the first one always counts). Null labels, ids and texts take no
    part; rows that repeat count once, an id with several texts with each.
    """
    shared.prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)").distinct()
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where("__id is not null and __t is not null")
    texts = texts.withColumn("__k", F.xxhash64("__t"))
    sizes = texts.select("__id", "__k", F.octet_length("__t").alias("__n")).distinct()
    picks = None
    for y, n in ((1, max_toxic), (0, max_ordinary)):
        some = known.where(F.col("__y") == y).join(sizes, "__id").orderBy(F.xxhash64("__id"), "__id", "__k").limit(n)
        before = F.sum("__n").over(Window.orderBy(F.xxhash64("__id"), "__id", "__k").rowsBetween(Window.unboundedPreceding, -1))  # n rows at most
        picked = some.select("__id", "__k", F.coalesce(before, F.lit(0)).alias("__b"), "__n").where((F.col("__b") == 0) | (F.col("__b") + F.col("__n") <= max_bytes)).select("__id", "__k", F.lit(y).alias("__y"))
        picks = picked if picks is None else picks.unionByName(picked)
    rows = texts.join(F.broadcast(picks), ["__id", "__k"]).dropDuplicates(["__id", "__k"]).select("__t", "__y").collect()  # 2 * max_bytes
    return fit([(r["__t"], r["__y"]) for r in rows])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the toxicity of every document of `documents`, learnt from the rows of `labels` that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id") != 0)
    model = learn(docs, labels)
    out = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
