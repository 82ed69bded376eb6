"""Language identification by Bayesian fusion of evidence.

The text gives a likelihood for each language: naive Bayes over hashed
sequences of four bytes, counted in tasks over a bounded sample of labelled
texts of every language; no language ("und") has the uniform distribution. The
table of probabilities is a file in the shared folder that workers map. What the text alone says of
all rows is then counted by host, by domain, by address suffix and by
declared language. The host's counts, smoothed towards its domain's and these
towards all rows', are the prior (without the row itself); the counts of
declared languages and suffixes give the likelihood of what a row declares.
All parts are added as logarithms and normalised; a row whose best language is
"und", or not likely enough, is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import words as W

BUCKETS = 1 << 16
UND = "und"
#: Overlapping sequences are not independent: the weight of one sequence's log-likelihood.
TEMPER = 0.2
#: Weights, in rows, of the next level's distribution where counts are smoothed.
SMOOTH_HOST, SMOOTH_DOMAIN, SMOOTH_ALL, SMOOTH_DECLARED = 5.0, 5.0, 10.0, 2.0
#: Part of any text that is in no language: names, codes, quotations. It keeps a short text with some of them from being "und".
FOREIGN = 0.1
#: Labelled rows per language that a model is fitted on, about; their texts are whole.
PER_LANGUAGE = 1500
#: Hosts whose counts may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_LETTER = np.array([W.LOWER[b] if W.LOWER[b] >= 0x61 and W.LOWER[b] <= 0x7A or b >= 0x80 else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    languages: list[str]  # sorted, without "und"
    table: np.ndarray | str  # log probability by language and bucket, float32; or the URI of such a file

    def rows(self) -> np.ndarray:
        """The table, with "und" as its last row."""
        table = self.table if isinstance(self.table, np.ndarray) else shared.mapped(self.table, "table", np.float32).reshape(-1, BUCKETS)
        return table if len(table) > len(self.languages) else np.vstack([table, np.full((1, BUCKETS), -math.log(BUCKETS), np.float32)])


def _grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every sequence of four bytes of letters and single spaces."""
    data, offsets = W.buffers(texts)
    n = len(data) - 3
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LETTER[data]
    code = np.zeros(n, np.uint32)
    for k in range(4):
        code = code << np.uint32(8) | b[k : k + n]
    space = b == 32
    fine = ~(space[:n] & space[1 : n + 1]) & ~(space[1 : n + 1] & space[2 : n + 2]) & ~(space[2 : n + 2] & space[3 : n + 3])
    at = np.flatnonzero(fine)
    text = np.searchsorted(offsets, at, "right") - 1
    whole = at + 4 <= offsets[text + 1]
    at, text = at[whole], text[whole]
    return ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), text


def _log_share(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.1
    return np.log((1 - FOREIGN) * counts / counts.sum() + FOREIGN / BUCKETS).astype(np.float32)


def fit(sample: list[tuple[str, str]]) -> Model:
    """From (text, language); the order of the sample doesn't matter."""
    languages = sorted({k for _, k in sample})
    table = np.zeros((len(languages), BUCKETS), np.float32)
    for i, k in enumerate(languages):
        table[i] = _log_share(sum((_bucket_counts([t]) for t, x in sample if x == k), np.zeros(BUCKETS)))
    return Model(languages, table)


def _bucket_counts(texts) -> np.ndarray:
    texts, out = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), np.zeros(BUCKETS)
    _, offsets = W.buffers(texts)
    for i, j in W.batches(None, offsets):
        out += np.bincount(_grams(texts.slice(i, j - i))[0], minlength=BUCKETS)
    return out


def _count(batches):
    """Of each batch and language: the buckets that occur, with their counts."""
    for b in batches:
        kinds = b.column(1).to_pylist()
        for k in sorted(set(kinds)):
            counts = _bucket_counts(b.column(0).filter(pa.array([x == k for x in kinds])))
            at = np.flatnonzero(counts).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"k": [k], "at": [at.tobytes()], "n": [counts[at].astype(np.int64).tobytes()]}, schema=pa.schema([("k", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))


def _add(table: pa.Table) -> pa.Table:
    counts = np.zeros(BUCKETS)
    for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
        counts[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
    return pa.table({"k": [table.column("k")[0].as_py()], "row": [_log_share(counts).tobytes()]}, schema=pa.schema([("k", pa.string()), ("row", pa.binary())]))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit every language of lang_col, each on about per_language whole texts chosen by a hash of the id and the text.

    Null languages and texts and "und" take no part; an empty table gives a
    model of no languages. The driver holds one row of 256 KB at a time.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(lang_col) != UND)).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("k"))
    share = known.groupBy("k").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64("i", "t", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    rows = known.join(F.broadcast(share), "k").where(draw < F.col("share")).select("t", "k")  # a row for each language
    counted = rows.mapInArrow(_count, "k string, at binary, n binary").groupBy("k").applyInArrow(_add, "k string, row binary")
    uri, languages = f"{shared.new_folder(spark, 'languages')}/model", []

    def table():
        for r in counted.orderBy("k").toLocalIterator():
            languages.append(r["k"])
            yield np.frombuffer(r["row"], np.float32)
        yield np.full(BUCKETS, -math.log(BUCKETS), np.float32)

    shared.save_rows(uri, "table", table())
    return Model(languages, uri)


_tables: dict[str, np.ndarray] = {}


def likelihoods(text: Column, model: Model) -> Column:
    """Tempered log-likelihoods of a text by language, "und" last; null and empty texts have zeros."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        if isinstance(model.table, str):
            if model.table not in _tables:
                _tables.clear()
                _tables[model.table] = model.rows()
            table = _tables[model.table]
        else:
            table = model.rows()
        texts = pa.array(s.where(s.notna(), None), pa.large_string())
        out = np.zeros((len(s), len(table)))
        _, offsets = W.buffers(texts)
        for i, j in W.batches(None, offsets):
            bucket, at = _grams(texts.slice(i, j - i))
            for k, row in enumerate(table):
                out[i:j, k] = np.bincount(at, row[bucket], j - i)
        return pd.Series(list(out * TEMPER))

    return run(text)


def _counts(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.count_if(F.col("__text") == k) for k in range(n)]).alias(name))


def _beside(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(table) if small else table, key, "left")


def identify(df: DataFrame, model: Model, text: Column, declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """df (of its columns those of keep, if given) and language, confidence, text_language and accepted; columns of these names are replaced.

    declared, host, domain and suffix are columns of text or None; a null is no
    evidence, and a declared language that the model doesn't know is counted
    like any other. Defined results: without text the other evidence decides; a
    row without any letters in its text is "und"; a model of no languages
    accepts nothing; rows that repeat stay; an empty table gives an empty
    result. The rows and what their texts say are written once, for they are
    read several times.
    """
    shared.prepare(df.sparkSession)
    made = ("language", "confidence", "text_language", "accepted")
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    names = [*model.languages, UND]
    n = len(names)
    none = F.lit(None).cast("string")
    keys = {"__declared": declared, "__host": host, "__domain": domain, "__suffix": suffix}
    keys = {k: F.lower(v.cast("string")) if v is not None else none for k, v in keys.items()}
    rows = df.select(F.struct(*kept).alias("__row"), *[v.alias(k) for k, v in keys.items()], F.rlike(F.coalesce(text, F.lit("")), F.lit(r"\p{L}")).alias("__letters"), likelihoods(text, model).alias("__ll"))
    rows = shared.written(rows.withColumn("__text", F.array_position("__ll", F.array_max("__ll")).cast("int") - 1), "evidence")
    seen = rows.select(*keys, "__text")
    everything = seen.agg(F.array(*[F.count_if(F.col("__text") == k) for k in range(n)])).first()[0] or [0] * n
    total = sum(everything) or 1
    overall = [(c + SMOOTH_ALL / n) / (total + SMOOTH_ALL) for c in everything]
    for key, name in (("__host", "__h"), ("__domain", "__d")):
        given = {"__host": host, "__domain": domain}[key]
        rows = _beside(rows, _counts(seen, key, n, name), key) if given is not None else rows.withColumn(name, F.lit(None).cast("array<long>"))
    tables = {}
    for key, name in (("__declared", "__c"), ("__suffix", "__s")):
        given = {"__declared": declared, "__suffix": suffix}[key]
        tables[name] = _counts(seen, key, n, name) if given is not None else None
        rows = _beside(rows, tables[name], key) if given is not None else rows.withColumn(name, F.lit(None).cast("array<long>"))
    spread = {k: max(t.count(), 1) if t is not None else 1 for k, t in tables.items()}
    ofs = {k: (t.agg(F.array(*[F.coalesce(F.sum(F.col(k)[i]), F.lit(0)) for i in range(n)])).first()[0] if t is not None else [0] * n) for k, t in tables.items()}

    def own(i):
        return (F.col("__text") == i).cast("double")

    def size(c):
        return F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)

    terms = []
    for i in range(n):
        up = F.lit(overall[i])
        dom = F.when(F.col("__d").isNotNull(), (F.greatest(F.col("__d")[i] - own(i), F.lit(0.0)) + SMOOTH_DOMAIN * up) / (size("__d") - 1 + SMOOTH_DOMAIN)).otherwise(up)
        prior = F.when(F.col("__h").isNotNull(), (F.greatest(F.col("__h")[i] - own(i), F.lit(0.0)) + SMOOTH_HOST * dom) / (size("__h") - 1 + SMOOTH_HOST)).otherwise(dom)
        term = F.col("__ll")[i] + F.log(prior)
        for c in ("__c", "__s"):  # P(what is declared | language), without the row itself
            own_i = F.greatest(F.col(c)[i] - own(i), F.lit(0.0))
            like = (own_i + SMOOTH_DECLARED / spread[c]) / (F.lit(float(ofs[c][i])) - own(i) + SMOOTH_DECLARED)
            term = term + F.when(F.col(c).isNotNull(), F.log(like)).otherwise(F.lit(0.0))
        terms.append(term)
    rows = rows.withColumn("__p", F.array(*terms)).withColumn("__best", F.array_max("__p"))
    best = F.array_position("__p", F.col("__best")).cast("int")
    sure = 1 / F.aggregate("__p", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__best")))
    listed = F.array(*[F.lit(k) for k in names])
    language = F.when(F.col("__letters"), F.element_at(listed, best)).otherwise(F.lit(UND))
    out = rows.withColumn("language", language).withColumn("confidence", F.when(F.col("__letters"), sure).otherwise(F.lit(1.0)))
    out = out.withColumn("text_language", F.element_at(listed, F.col("__text") + 1)).withColumn("accepted", (F.col("language") != UND) & (F.col("confidence") >= least))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in kept], *made)


def page_text(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles and tags; one that is not closed goes on to the end, so that no place is tried twice."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    return F.regexp_replace(bare, r"(?s)<[^<>]*>|&[#a-zA-Z0-9]{1,32};", " ")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the language of each row of `pages`, with a text model learnt from `documents`."""
    model = learn(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)
    parts = pages.select("page_id", F.nullif(F.nullif(F.lower(declared), F.lit("")), F.lit("x")).alias("declared"), F.nullif(host, F.lit("")).alias("host"), page_text(F.col("html")).alias("text"))
    parts = parts.withColumn("suffix", F.nullif(F.regexp_extract("host", r"([^.]+)$", 1), F.lit(""))).withColumn("domain", F.nullif(F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1), F.lit("")))
    out = identify(parts, model, F.col("text"), F.col("declared"), F.col("host"), F.col("domain"), F.col("suffix"), keep=["page_id", "declared", "host"])
    return out.select("page_id", "declared", "host", "text_language", "language", F.round("confidence", 6).alias("confidence"), "accepted")
