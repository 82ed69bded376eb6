"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Each window of a benchmark item (`size` consecutive words; a shorter item is
one window) must occur whole in a document, so the prefix of its words in
order of rarity needs one word only: the one that is rarest over all
documents. Document positions join the windows on that word; the word's place
in the window bounds where the window would begin and end (the length and
positional bounds), and the words there are compared with the window's (the
exact check). One pass over the documents counts the words that benchmark
items use, a second explodes, joins, checks and keeps what holds, all before
any row is written. Only hits are shuffled, by what their document is, and
joined to the documents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows broadcast at once (about 0.3 KB each); a larger benchmark takes several passes.
MAX_WINDOWS = 200_000
#: Words or documents with hits that may be broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z alone; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # then lower() touches A-Z alone
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower())), _GAPS), "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, n, win): the distinct windows of each item."""
    words = items.select(F.col("__item"), words_of(F.col("__text")).alias("w"))
    # sequence() must not see a negative end, whichever branch is taken
    wins = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.slice("w", i + 1, size))).when(F.size("w") > 0, F.array("w"))
    return words.where("__item is not null").select("__item", F.explode(wins).alias("win")).distinct().withColumn("n", F.size("win"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def prefixed(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """windows and the word of each that is rarest in docs (__text), with its place."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    few = vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    seen = docs.select(F.explode(words_of(F.col("__text"))).alias("word"))
    counts = seen.join(F.broadcast(vocabulary), "word").groupBy("word").count() if few else seen.groupBy("word").count().join(vocabulary, "word")
    places = windows.select("__item", "win", "n", F.posexplode("win").alias("off", "word"))
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "word", "off")).alias("r")
    # a word that many windows hold is no group of its own where the counts are broadcast
    return places.join(F.broadcast(counts) if few else counts, "word", "left").groupBy("__item", "win", "n").agg(rarest).select("__item", "win", "n", F.col("r.word").alias("word"), F.col("r.off").alias("off"))


def _what(text: Column) -> list[Column]:
    """What a text is known by, beside its document's id."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("__h"), F.crc32(text.cast("binary")).alias("__c"), F.octet_length(text).alias("__l")]


def _hits(docs: DataFrame, benchmark: DataFrame, size: int, share: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(__id, __h, __c, __l, n_hit, items, contaminated) of the documents with a hit."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    items = benchmark.select(F.col(item_col).alias("__item"), F.col(item_text_col).alias("__text"))
    windows = tables.written(item_windows(items, size), "windows")
    keyed = tables.written(prefixed(windows, base).select(F.col("word").alias("key"), "off", "n", "win", F.col("__item").alias("item")), "windows")
    passes = max(1, -(-keyed.count() // MAX_WINDOWS))
    words = base.select("__id", *_what(F.col("__text")), words_of(F.col("__text")).alias("w"))
    places = words.select("__id", "__h", "__c", "__l", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    begin = F.col("pos") - F.col("off")
    holds = (F.col("word") == F.col("key")) & (begin >= 0) & (begin + F.col("n") <= F.col("n_words")) & (F.slice("w", F.greatest(begin + 1, F.lit(1)), F.col("n")) == F.col("win"))
    found = None
    for k in range(passes):
        part = keyed if passes == 1 else keyed.where(F.pmod(F.xxhash64("win"), F.lit(passes)) == k)
        hit = places.join(F.broadcast(part), holds).select("__id", "__h", "__c", "__l", "n_words", F.struct(begin.alias("begin"), "n").alias("hit"), "item")
        found = hit if found is None else found.unionByName(hit)
    by_doc = found.groupBy("__id", "__h", "__c", "__l").agg(F.first("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("item").alias("found"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["begin"], h["begin"] + h["n"] - 1))))
    out = by_doc.select("__id", "__h", "__c", "__l", F.size(covered).cast("long").alias("n_hit"), F.sort_array(F.transform("found", lambda i: i.cast(T.StringType()))).alias("items"), "n_words")
    return tables.written(out.withColumn("contaminated", share * F.col("n_hit") >= F.col("n_words")).drop("n_words"), "hits")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & (left["__h"] == right["__h"]) & (left["__c"] == right["__c"]) & (left["__l"] == right["__l"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of docs: its id, n_words, n_hit, items (sorted as strings) and contaminated.

    A word is hit inside any occurrence of a window of a benchmark item; a
    document is contaminated if it has a hit word and at least 1/share of its
    words are hit. Defined results: null or empty texts have no words; items
    without words or with a null id have no windows; rows that repeat, ids
    included, stay rows of their own; an empty benchmark hits nothing; empty
    docs give no rows; other columns of docs are not returned.
    """
    hits = _hits(docs, benchmark, size, share, id_col, text_col, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("__id"), *_what(F.col(text_col)), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    small = _small(hits)
    out = rows.join(small, _same(rows, small), "left")
    none = F.array().cast("array<string>")
    return out.select(rows["__id"].alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that contamination() doesn't call contaminated, with all their columns; where few are, nothing but hits is moved."""
    bad = _hits(docs, benchmark, size, share, id_col, text_col, item_col, item_text_col).where("contaminated").select("__id", "__h", "__c", "__l")
    names = docs.columns
    rows = docs.withColumn("__row", F.struct(*names)).select("__row", F.col(id_col).alias("__id"), *_what(F.col(text_col)))
    bad = _small(bad)
    return rows.join(bad, _same(rows, bad), "left_anti").select(*[F.col("__row").getField(c).alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the contamination of each document of `documents` by `benchmark`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] AS w
  FROM documents),
b AS (
  SELECT item_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] AS w
  FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
i AS (SELECT item_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM k),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM i),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp),
hit AS (SELECT rid, dw.n, p, item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
places AS (SELECT DISTINCT rid, unnest(range(p, p + n)) AS q FROM hit),
counts AS (SELECT rid, count(*) AS n_hit FROM places GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counts USING (rid) LEFT JOIN found USING (rid)
"""
