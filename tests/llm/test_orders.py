"""Language models of several orders against the formulas, the sum of their probabilities, and the query's counts by brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_text_ops import LOWER, shared_passages

from tidemark.llm import ngram_lm, registry


def tokens(t):
    return (t or "").encode().translate(LOWER).split() + [None]


def plain(train, order):
    """P(word | words before), straight from the definition."""
    counts = [None, *[Counter() for _ in range(order)]]
    for t in train:
        w = ["<s>"] * (order - 1) + tokens(t)
        counts[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    D = [None, *[ngram_lm._discounts(*[sum(v == n for v in counts[k].values()) for n in (1, 2, 3, 4)]) for k in range(1, order + 1)]]
    total, begins = [defaultdict(int) for _ in range(order + 1)], [defaultdict(lambda: [0] * 4) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            begins[k][g[:-1]][min(c, 3)] += 1

    def p(h, w, k):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        h = h[len(h) - k + 1 :]
        lower = p(h[1:], w, k - 1)
        if not total[k][h]:
            return lower
        c = counts[k][(*h, w)]
        return max(c - D[k][min(c, 3)], 0) / total[k][h] + sum(D[k][j] * begins[k][h][j] for j in (1, 2, 3)) / total[k][h] * lower

    return lambda h, w: p(tuple(h), w, order), {g[0] for g in counts[1]}


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("train", [[], [None, "", "a"], [t for _, t in shared_passages(4, 25)] + ["the the The cat " * 300, "the cat sat", "a cat sat on the mat"]])
def test_each_order_equals_the_formulas(spark, docs, order, train):
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string"), order=order)
    p, known = plain(train, order)
    rows = [(i, t) for i, t in enumerate([None, "", "The cat", "the cat sat on the", "unseen words here", train[0] if train else "a", "cat the " * 50])]
    got = ngram_lm.score(docs(rows), model).orderBy("doc_id").collect()
    for r, (_, t) in zip(got, rows, strict=True):
        w = ["<s>"] * (order - 1) + tokens(t)
        want = sum(math.log10(p(w[i : i + order - 1], w[i + order - 1])) for i in range(len(w) - order + 1))
        assert r["score"] == pytest.approx(want, abs=1e-8) and r["n_known"] == sum(x in known for x in tokens(t))


def test_probabilities_sum_to_one(spark):
    train = ["a b a c", "b a b c c", "a a b", "c a b a"]
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string"), order=3)
    reader = ngram_lm._Reader(model)
    for before in ("", "a", "a b", "c c", "z", "b z"):
        texts = [f"{before} {w}" for w in ("a", "b", "c", "unknown")]
        cut = len(tokens(before)) - 1
        got = []
        for t in texts:
            columns, _ = ngram_lm.tokens(pa.array([t]), 3)
            prefix = sum(np.log10(x) for x in each(reader, t)[:cut])
            got.append(10 ** (sum(np.log10(x) for x in each(reader, t)[: cut + 1]) - prefix))
        end = each(reader, before)[cut]
        assert sum(got) + end == pytest.approx(1)


def each(reader, text):
    """The probability of each token of a text, from the scores of ever longer ones."""
    words = text.split()
    p, _ = plain(["a b a c", "b a b c c", "a a b", "c a b a"], 3)
    w = ["<s>"] * 2 + tokens(text)
    want = [p(w[i : i + 2], w[i + 2]) for i in range(len(words) + 1)]
    assert reader.score(pa.array([text]))["score"][0] == pytest.approx(sum(math.log10(x) for x in want))
    return want


def test_the_order_is_two_or_more(spark):
    with pytest.raises(ValueError):
        ngram_lm.train(spark.createDataFrame([], "text string"), order=1)


def test_the_query_by_brute_force(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    train = [t for i, t in rows if not held[i]]
    count = Counter(x for t in train for x in tokens(t))
    n, v = sum(count.values()), len(count)
    p, _ = plain(train, 2)
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_ngram_lm"](spark, sf_dir).collect()}
    assert len(got) == len(rows) and any(held.values())
    for i, t in rows:
        w, r = tokens(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p([a], b)) for a, b in zip(["<s>", *w], w)), rel=1e-9)


def test_a_very_long_text_and_repeats(spark, docs):
    model = ngram_lm.train(spark.createDataFrame([("word " * 300_000,), ("word",)], "text string"), order=3)
    got = ngram_lm.score(docs([(1, "word " * 300_000), (1, "word"), (1, "word")]), model).collect()
    assert sorted(r["n_tokens"] for r in got) == [2, 2, 300_001] and all(r["score"] > r["base_score"] for r in got if r["n_tokens"] > 2)
